"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes if and only if each pair of neighbours is the encoding of its
own bytes. So every prefix of a text has one valid last token: the one that spells a suffix of the prefix and agrees
with the last token of what stands before it. `PrefixEncoder` stores that token for every prefix. An append goes on
from the last prefix; an edit keeps all prefixes before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import Recent, table

#: Entries of a task's caches.
CACHE = 150_000
#: Bytes up to which prefixes are worked out on demand and remembered; longer texts fill the whole table once.
SHORT = 64


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.found.add_word(token.decode("latin-1"), (len(token), rank))
        self.found.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.agree: dict[tuple[int, int], bool] = {}
        self.prefixes = Recent(CACHE)

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost on ties; for the few bytes of a pair of tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[x] for x in parts]

    def last(self, raw: bytes) -> int:
        """The valid last token of a short text. Texts share prefixes, so these are remembered, and only those that a
        candidate stands on are worked out."""
        known = self.prefixes.get(raw)
        if known is None:
            known = self.prefixes.recall(raw)
        if known is None:
            get, agree = self.ranks.get, self.agree.get
            for start in range(len(raw)):
                known = get(raw[start:])
                if known is not None:
                    if not start:
                        break
                    left = self.last(raw[:start])
                    ok = agree((left, known))
                    if ok or (ok is None and self.neighbours(left, known)):
                        break
            else:
                raise ValueError("a byte without a token")
            self.prefixes.add(raw, known)
        return known

    def neighbours(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens, side by side, as they are."""
        key = (left, right)
        known = self.agree.get(key)
        if known is None:
            if len(self.agree) >= 2 * CACHE:
                self.agree.clear()
            known = self.agree[key] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known


class PrefixEncoder:
    """The last token of each prefix of the bytes so far."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b"") -> None:
        self.v, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def append(self, more: bytes) -> PrefixEncoder:
        v, last = self.v, self.last
        old = len(self.raw)
        self.raw += more
        back = max(0, old - v.longest + 1)
        agree, done = v.agree.get, old
        for end, (size, rank) in v.found.iter(self.raw[back:].decode("latin-1")):
            end += back + 1
            if end <= done:
                continue  # an old prefix, or one whose token is found
            if end == size or (ok := agree((left := last[end - size], rank))) or (ok is None and v.neighbours(left, rank)):
                last.append(rank)
                done += 1
                if done != end:
                    raise ValueError("a byte without a token")
        if done != len(self.raw):
            raise ValueError("a byte without a token")
        return self

    def replace(self, start: int, end: int, by: bytes) -> PrefixEncoder:
        """Re-encode after an edit: the prefixes up to `start` stay."""
        tail = self.raw[end:]
        self.raw, self.last = self.raw[:start], self.last[: start + 1]
        return self.append(by + tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            rank = self.last[end]
            out.append(rank)
            end -= len(self.v.tokens[rank])
        return out[::-1]


def latin(pattern: str) -> str:
    """The pattern for texts of code points below 256, with its classes spelled out, for Python's faster matcher."""
    members = lambda name: "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(name, chr(c)))
    spelled = {name: members(name) for name in (r"\p{L}", r"\p{N}", r"\s")}

    def spell(m: re.Match) -> str:
        if m[0] == r"\S":
            return f"[^{spelled[r'\s']}]"
        if m[0][0] == "[":
            return re.sub(r"\\p\{\w\}|\\s", lambda x: spelled[x[0]], m[0])
        return f"[{spelled[m[0]]}]"

    return re.sub(r"\[[^\]]*\]|\\p\{\w\}|\\s|\\S", spell, pattern)


class Encoder:
    """Encodes texts, each match of `pattern` separately, as tiktoken does without special tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        self.v = Vocabulary(path)
        self.split_any = regex.compile(pattern).findall
        self.split_latin = re.compile(latin(pattern)).findall
        self.cache = Recent(CACHE)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def piece(self, piece: str) -> bytes:
        """Ids of a match, as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.v.ranks.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        if len(raw) <= SHORT:
            packed, tokens = b"", self.v.tokens
            while raw:
                rank = self.v.last(raw)
                packed = struct.pack("<I", rank) + packed
                raw = raw[: -len(tokens[rank])]
            return packed
        ids = PrefixEncoder(self.v, raw).ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        cache, out = self.cache, []
        get = cache.get
        for piece in self.split(text):
            packed = get(piece)
            if packed is None:
                packed = cache.recall(piece)
                if packed is None:
                    packed = self.piece(piece)
                    if len(piece) <= 64:
                        cache.add(piece, packed)
            out.append(packed)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, memoryview(packed).cast("I")))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, digests: bool = False) -> DataFrame:
    """Ids of each whole text, and the bytes they decode to, one row a row, without a shuffle.

    Returns `id_col`, `n_tokens`, `ids` (array of ints) and `decoded` (binary, if asked for); with `digests`, instead
    of these two, `ids_sha256` (of the ids as little-endian unsigned 32-bit integers) and `decoded_sha256`.
    Null or empty text: no tokens. Null ids and repeated rows are kept as they are. Other columns are not read.
    The vocabulary file is read where tasks run: `path` is one that all executors have.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        enc = _encoder(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                packed = enc.encode(text.as_py() or "")
                raw = enc.decode(packed) if decode or digests else None
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest() if digests else memoryview(packed).cast("I").tolist())
                b.append(hashlib.sha256(raw).hexdigest() if digests else raw)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32()))]
            if decode or digests:
                cols.append(pa.array(b, pa.string() if digests else pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    types = [kind, "long", *(("string", "string") if digests else ("array<int>", "binary"))]
    if not (decode or digests):
        names, types = names[:3], types[:3]
    return src.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, types, strict=True))).withColumnRenamed("id", id_col)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return encode_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, digests=True)
