"""Fill-in-the-middle transformation, with cuts found by arithmetic on words of eight bytes.

A unit is a run of ASCII letters or one other code point. UTF-8 is read as 64-bit words; in each, the bytes that end a
unit are marked in their top bits without looking at single bytes: a byte ends a unit unless a continuation byte follows,
or it and the next one are letters. Marks are counted by word and summed up; the word of the k-th mark is found by search
in the sums, and the mark within it by clearing lower ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import fresh, table

P, S, M = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, and percent of these whose suffix comes first.
RATE, SPM_RATE = 90, 20
#: Bytes of texts that are worked on at once; a longer text is one piece of work.
CHUNK = 4 << 20
_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def _each(byte: int) -> np.uint64:
    return np.uint64(byte) * _ONES


def _next(marks: np.ndarray) -> np.ndarray:
    """Marks of the byte that follows each byte; none follows the last."""
    after = marks >> np.uint64(8)
    after[:-1] |= marks[1:] << np.uint64(56)
    return after


def unit_ends(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of eight bytes of the texts that stand behind each other in `raw` up to `ends`, with the top bit of each
    byte set that ends a unit; a text's last byte always does."""
    padded = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    padded[: len(raw)] = raw
    w = padded.view("<u8")
    low = (w & ~_TOPS) | _each(0x20)  # letters in lower case; sums below stay within their bytes
    letter = (low + _each(0x80 - ord("a"))) & ~(low + _each(0x80 - ord("z") - 1)) & ~w & _TOPS
    continuation = w & ~(w << np.uint64(1)) & _TOPS
    marks = ~(_next(continuation) | (letter & _next(letter))) & _TOPS
    last = ends[ends > np.concatenate([[0], ends[:-1]])] - 1 if len(ends) else ends
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << np.uint64(3)))
    if len(raw) % 8:
        marks[-1] &= np.uint64((1 << 8 * (len(raw) % 8)) - 1)  # not the padding
    return marks


class Units:
    """Ranks and places of unit ends in texts that stand behind each other."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray) -> None:
        self.marks = unit_ends(raw, ends)
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before byte `at`."""
        word = at >> 3
        inside = np.append(self.marks, np.uint64(0))[word] & ((np.uint64(1) << ((at & 7).astype(np.uint64) << np.uint64(3))) - np.uint64(1))
        return self.sums[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte behind the end of the k-th unit (from 1); 0 for k = 0."""
        word = np.maximum(np.searchsorted(self.sums, k, "left") - 1, 0)
        left = np.where(k > 0, k - self.sums[word], 0)
        w = self.marks[word].copy() if len(self.marks) else np.zeros(len(k), np.uint64)
        for _ in range(7):  # clear the lower marks of the word
            more = left > 1
            w = np.where(more, w & (w - np.uint64(1)), w)
            left = np.where(more, left - 1, left)
        lowest = w & (~w + np.uint64(1))
        return np.where(k > 0, word * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64) + 1, 0)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit integers of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _chunks(offs: np.ndarray):
    """Ranges of texts with CHUNK bytes at most, or of one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def _transform(id_at: int, text_at: int, seed: int, rate: int, spm_rate: int, names: list[str]):
    p, s, m = (x.encode() for x in (P, S, M))

    def run(batches):
        for batch in batches:
            text = batch.column(text_at).fill_null("").cast(pa.large_binary())
            _, offsets, data = text.buffers()
            offs = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            ids = batch.column(id_at)
            for i, j in _chunks(offs):
                raw, edges = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                units = Units(raw, edges[1:])
                upto = units.rank(edges)
                n = np.diff(upto)
                h = np.array([draws(x, seed) for x in ids.slice(i, j - i).to_pylist()], np.int64).reshape(-1, 4)
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                starts, stops = edges[:-1], edges[1:]
                cut_at = lambda k: np.where(k > 0, units.select(upto[:-1] + k), starts)  # noqa: E731, B023
                a, b = cut_at(np.minimum(one, two)), cut_at(np.maximum(one, two))
                # Code points: bytes that aren't continuations.
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                form, out = [], []
                for k, (x, y, z, e) in enumerate(zip(starts.tolist(), a.tolist(), b.tolist(), stops.tolist(), strict=True)):
                    body = raw[x:e].tobytes()
                    if not body or h[k, 2] % 100 >= rate or p in body or s in body or m in body:
                        form.append("plain")
                        out.append(body)
                        continue
                    prefix, middle, suffix = body[: y - x], body[y - x : z - x], body[z - x :]
                    form.append("spm" if h[k, 3] % 100 < spm_rate else "psm")
                    out.append(b"".join([s, suffix, p, prefix, m, middle] if form[-1] == "spm" else [p, prefix, s, suffix, m, middle]))
                plain = np.array([f == "plain" for f in form], bool)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, pa.array(n.astype(np.int64)), pa.array(form, pa.string()), pa.array(points[a] - points[starts], mask=plain),
                        pa.array(points[b] - points[a], mask=plain), pa.array(out, pa.binary()),
                    ],
                    names,
                )

    return run


ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """`docs` with `n` (units), `form` (plain, psm or spm), `prefix_chars` and `middle_chars` (code points; null if plain)
    and `output`, the transformed text. Where `docs` has a column of such a name, whatever its case, the added one gets
    `_` before its name, so that all columns of `docs` pass through as they are.

    psm: `<P>`prefix`<S>`suffix`<M>`middle; spm: `<S>`suffix`<P>`prefix`<M>`middle. The cuts are uniform over the borders of
    units and depend on `seed` and the id alone. A text that is empty, holds one of the marks, or isn't drawn is plain.

    Null text: an empty one. Null id: that of no digits. Rows of the same id get cuts by the same draws; repeated rows are
    kept. No rows: no rows. Whole texts are read, without a shuffle; a task holds a batch's texts, a text's own cuts need
    memory in proportion to its length.
    """
    names = [fresh(docs, x) for x in ADDED]
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{names[0]}` long, `{names[1]}` string, `{names[2]}` long, `{names[3]}` long, `{names[4]}` binary"])
    run = _transform(docs.columns.index(id_col), docs.columns.index(text_col), seed, rate, spm_rate, [*docs.columns, *names])
    return docs.mapInArrow(run, schema).withColumn(names[4], F.col(names[4]).cast("string"))


def restore(form: Column, output: Column) -> Column:
    """The text that a form and its output were made from. Parts hold no marks, so the output is cut at them."""
    part = F.split(output, f"{P}|{S}|{M}", -1)
    psm, spm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2))), F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), k, 8) AS BIGINT)) AS h
  FROM documents),
cuts AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(body) AS restored_sha256
FROM parts
"""
