"""Count-only Viterbi over a unigram vocabulary whose matches an Aho-Corasick automaton enumerates."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import Recent, table

#: Fixed values of unigram tokenizers: what an unknown character scores below the least piece, and the mark of a blank.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
LETTERS, OTHERS = r"[^\W\d_²³¹¼½¾]+", rf"(?:(?!{SPACE})[\W\d_²³¹¼½¾])+"
WORDS = re.compile(rf"{SPACE}+(?:{LETTERS}|{OTHERS}(?:{LETTERS})?)?|{LETTERS}|{OTHERS}(?:{LETTERS})?")
#: The same for texts of code points below 256 besides the mark, whose letters can be spelled out.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
LATIN = re.compile(rf"{SPACE}+(?:[{_L}]+|[^{SPACE}{_L}]+[{_L}]*)?|[{_L}]+|[^{SPACE}{_L}]+[{_L}]*")
CROSSING = re.compile(rf"[^\W\d_²³¹¼½¾][\W\d_²³¹¼½¾]|[^{SPACE}]{SPACE}")
#: Words that a task remembers. Longer ones are not remembered.
CACHE, LONGEST_WORD = 250_000, 48


class Unigram:
    """Counts of pieces, and their scores, of the best segmentation of a text.

    The tie rule is the tokenizers': candidates for an end are tried from the earliest start (the longest piece) on,
    an unknown character last and only where no piece spells that character, and only a greater score replaces what
    is held. An unknown character counts as many pieces as it has bytes if the vocabulary has pieces for bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for piece, score in dict(pieces).items():
            self.found.add_word(piece, (len(piece), float(score)))
        self.found.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.singles = {p for p, _ in pieces if len(p) == 1}
        # Where no piece goes on from a letter to another kind of character, or to a blank from anything but a blank,
        # every segmentation has a border there, and the parts between such borders are independent.
        self.words_apart = not any(CROSSING.search(p) for p, _ in pieces)
        self.cache = Recent(CACHE)

    def viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        if self.singles.issuperset(text):  # no character is unknown
            held = -1
            for end, (size, score) in self.found.iter(text):
                start = end + 1 - size
                total = best[start] + score
                if end != held or total > best[end + 1]:
                    best[end + 1], count[end + 1], held = total, count[start] + 1, end
            return count[n], best[n]
        unknown, fallback = self.unknown, self.byte_fallback
        at, found, single = 0, False, False  # the end that is being filled
        # The automaton goes on from end to end, and at each from the longest match to the shortest.
        for end, (size, score) in self.found.iter(text):
            end += 1
            while at < end:
                if at and not single:
                    self._unknown(text, at, best, count, found, unknown, fallback)
                at, found, single = at + 1, False, False
            total = best[end - size] + score
            if not found or total > best[end]:
                best[end], count[end], found = total, count[end - size] + 1, True
            single = size == 1
        while at <= n:
            if at and not single:
                self._unknown(text, at, best, count, found, unknown, fallback)
            at, found, single = at + 1, False, False
        return count[n], best[n]

    @staticmethod
    def _unknown(text, at, best, count, found, unknown, fallback):
        total = best[at - 1] + unknown
        if not found or total > best[at]:
            best[at] = total
            count[at] = count[at - 1] + (len(text[at - 1].encode("utf-8", "surrogatepass")) if fallback else 1)

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of a whole text, with a blank put before it and blanks marked."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.words_apart:
            return self.viterbi(marked)
        pieces, score, cache = 0, 0.0, self.cache
        try:
            text.encode("latin-1")
            words = LATIN.findall(marked)
        except UnicodeEncodeError:
            words = WORDS.findall(marked)
        for word in words:
            known = cache.get(word)
            if known is None:
                known = cache.recall(word)
                if known is None:
                    known = self.viterbi(word)
                    if len(word) <= LONGEST_WORD:
                        cache.add(word, known)
            pieces += known[0]
            score += known[1]
        return pieces, score


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that may match text, with their scores, and whether there are pieces for bytes, from a sentencepiece file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score) for p in model.pieces if p.type == 1], any(p.type == 6 for p in model.pieces)


@lru_cache(maxsize=2)
def _model(path: str) -> Unigram:
    return Unigram(*load_pieces(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_tokens, best_score) a row, over whole texts, without a shuffle; no ids or pieces are built.

    Null or empty text: 0 tokens of score 0. Null ids and repeated rows are kept as they are; other columns are not
    read. The vocabulary file is read where tasks run: `path` is one that all executors have.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        model = _model(path)
        for batch in batches:
            got = [model.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], ["id", "n_tokens", "best_score"])

    return src.mapInArrow(run, f"id {kind}, n_tokens long, best_score double").withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return count_tokens(table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))
