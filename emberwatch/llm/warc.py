"""WARC archives: written by Spark, indexed first, then read by coalesced byte ranges.

An archive is a .warc.gz: a gzip member for each record, so any record can be read from its offset and length alone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from emberwatch.llm.common import cut, shared_path, table

#: Payloads of this size or more are written once.
MIN_DEDUP_BYTES = 1000
#: Payload bytes of an archive (more only where one payload alone has more), so that each can be read as one value; and
#: the payloads that count as large, which go to archives of their own, with fewer records.
ARCHIVE_BYTES, LARGE = 256 << 20, 64 << 10
#: Ranges closer than the gap are read together, up to the size of a read.
GAP, READ = 64 << 10, 8 << 20
INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(raw) + z.flush()
    # A member ends with its size as four bytes, least first, so its last byte is 0 below 16 MiB. Larger ones get an
    # empty member behind them. See write_archives().
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _header_value(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload; gzip. Ids of records come from their pages."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{i}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response" if refers_to is None else "Content-Type: application/http; msgtype=response; revisit",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        f"Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"Refers-To-Page: {refers_to}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines.append(f"Content-Length: {len(body)}")
    return _member(("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record that isn't compressed any more."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def members(content: bytes | memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each record. Empty members belong to the record before them."""
    view, at, held = memoryview(content), 0, None
    while at < len(view):
        z, out, pos = zlib.decompressobj(31), [], at
        while not z.eof:
            piece = view[pos : pos + (1 << 16)]
            if not piece:
                raise ValueError("a record is cut off")
            out.append(z.decompress(piece))
            pos += len(piece)
        end, raw = pos - len(z.unused_data), b"".join(out)
        if raw:
            if held:
                yield held
            held = (at, end - at, raw)
        elif held:
            held = (held[0], end - held[0], held[2])
        at = end
    if held:
        yield held


def _unpack(raw: bytes) -> bytes:
    z = zlib.decompressobj(31)
    return z.decompress(raw)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_DEDUP_BYTES) -> None:
    """A record a row into archives under `path`; a payload that occurs again is written once.

    Of rows with equal payloads of `min_bytes` or more, those of the largest id become response records and the others
    revisit records that name it. Null html is empty; a null url gives a record without one; a null id is never the
    largest (if all are null, all are responses). Repeated rows give records of their own. Other columns are not read.

    Spark's text writer commits the files: a member's last byte is 0, and that 0 is the separator it writes. A payload
    that all pages share is no hot spot: digests combine map-side, and the join meets a checkpointed table. Archives are
    bounded by bytes, however large a partition is: payloads are written by size class, so a very large one has no say in
    the files of others, and each class that the table has is a pass over it.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha1("payload")))
    big = src.where(F.octet_length("payload") >= min_bytes)
    again = cut(big.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("sha", "first"))
    told = src.join(again, "sha", "left")
    revisit = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = told.select("page_id", "url", "payload", revisit.alias("refers_to"))

    def run(batches):
        for batch in batches:
            ids, urls, payloads, refers = (batch.column(i) for i in range(4))
            rows = (build_record(i.as_py(), u.as_py(), p.as_py(), r.as_py())[:-1] for i, u, p, r in zip(ids, urls, payloads, refers, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    size = F.octet_length("payload")
    # Class k > 0 has the payloads of more than LARGE * 2^(k - 1) bytes and LARGE * 2^k at most: 16 classes in all.
    of = F.when(size <= LARGE, 0).otherwise(F.length(F.bin(F.floor((size - 1) / LARGE))))
    for k in sorted({0, *(r["k"] for r in src.select(of.alias("k")).distinct().collect())}):
        records = told.where(of == k).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        records.write.mode("append").option("lineSep", "\x00").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (LARGE << k))).text(path)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under `path`: where it stands, and its url and digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, length, raw in members(content.as_buffer()):
                    h, _ = parse_record(raw)
                    number = lambda k, h=h: int(h[k]) if k in h else None
                    rows.append((name, offset, length, number("page-id"), h.get("warc-target-uri"), h["warc-payload-digest"].removeprefix("sha1:"), number("payload-length"), h["warc-type"], number("refers-to-page")))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.string() if t.split()[1] == "string" else pa.int64() for t in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.mapInArrow(run, INDEX)


def coalesced(offsets, lengths, gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """Reads (start, end) for sorted ranges, each with the first and the last but one range that it serves."""
    out: list[list[int]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and o - out[-1][1] <= gap and max(out[-1][1], o + n) - out[-1][0] <= most:
            out[-1][1], out[-1][3] = max(out[-1][1], o + n), i + 1
        else:
            out.append([o, o + n, i, i + 1])
    return [tuple(x) for x in out]


def _read_ranges(rows: list[dict], read_at: Callable[[int, int], bytes]) -> Iterator[bytes]:
    """The records of sorted index rows of one archive."""
    offsets, lengths = [r["offset"] for r in rows], [r["length"] for r in rows]
    for start, end, a, b in coalesced(offsets, lengths):
        block = memoryview(read_at(start, end - start))
        for i in range(a, b):
            yield _unpack(block[offsets[i] - start : offsets[i] - start + lengths[i]])


def _open(archive: str):
    """A file that can be read at any place, or an error where pyarrow doesn't know or reach the store."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", archive))
    return fs.open_input_file(path)


def read_records(selected: DataFrame, out: T.StructType, emit: Callable[[dict, bytes, dict], tuple]) -> DataFrame:
    """Reads the records of the selected index rows; `emit` makes a row of `out` of headers, payload and index row.

    The rows of an archive are sorted by offset, and ranges that are near each other are read at once. Stores that
    pyarrow knows are read by range; for any other, Spark's binary reader fetches each archive that has a selected
    record (archives are small files), and the ranges are taken from its bytes.
    """
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in out.fields]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    def by_range(batches):
        for batch in batches:
            for archive, rows in itertools.groupby(batch.to_pylist(), lambda r: r["archive"]):
                rows = list(rows)
                with _open(archive) as f:
                    yield table_of([emit(*parse_record(raw), r) for raw, r in zip(_read_ranges(rows, lambda at, n: f.read_at(n, at)), rows, strict=True)])  # noqa: B023

    def by_file(batches):
        for batch in batches:
            for content, rows in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                view = memoryview(content.as_buffer())
                yield table_of([emit(*parse_record(raw), r) for raw, r in zip(_read_ranges(rows, lambda at, n: view[at : at + n]), rows, strict=True)])  # noqa: B023

    some = selected.select("archive").first()
    try:
        if some:
            _open(some["archive"]).close()
    except (OSError, ValueError, pa.ArrowException):
        folder = some["archive"].rpartition("/")[0]
        files = selected.sparkSession.read.format("binaryFile").load(folder).select("path", "content")
        rest = [c for c in selected.columns if c != "offset"]
        rows = selected.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", *rest))).alias("rows"))
        return files.join(rows, files["path"] == rows["archive"]).select("content", "rows").mapInArrow(by_file, out)
    return selected.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(by_range, out)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), f"{where}/archives")
    build_index(spark, f"{where}/archives").write.parquet(f"{where}/index")
    index = spark.read.parquet(f"{where}/index")

    def emit(headers, payload, row):
        digest = hashlib.sha1(payload).hexdigest() if row["record_type"] == "response" else row["payload_digest"]
        if digest != row["payload_digest"] or headers["warc-type"] != row["record_type"]:
            raise ValueError(f"the record at {row['offset']} of {row['archive']} isn't what the index says")
        size = len(payload) if row["record_type"] == "response" else row["payload_bytes"]
        return row["page_id"], size, digest, row["record_type"], row["refers_to"]

    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])
    return read_records(index, out, emit)


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.first_id IS NOT NULL AND p.page_id <> g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_bytes >= 1000 AND p.payload_digest = g.payload_digest
"""
