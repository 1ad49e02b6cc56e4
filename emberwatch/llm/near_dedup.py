"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

Shingles are runs of five words (what ASCII white space parts). The weight of a shingle is its count in the text times
its inverse document frequency. The similarity of two texts is the sum of the lesser over the sum of the greater
weights. A sample of a text (improved consistent weighted sampling) is equal for two texts with a probability of their
similarity; a band is some samples together, and texts that share a band are candidates.

A bucket of a band is never expanded into pairs. In a round each bucket has one leader, the text that shares most
buckets with most others (the original of a group of copies, as a rule), and all members of other classes are verified
against it. Classes grow with every link, so a bucket of copies is one class after few rounds and drops out. Of what is
left, every pair of texts of different classes is compared exactly, in blocks of bounded size: a task gets two blocks of
a bucket and gives the links that join classes, fewer than it has texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import Recent, cut, fresh, table

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
#: A shingle in this share of the documents or less weighs 1 (times its count); one in all of them weighs 1 - DAMP.
#: A steep idf would part copies: what a group of copies shares is frequent for that very reason.
COMMON, DAMP, LEAST_DF = 0.01, 0.2, 8
#: Slots that tell which shingles may be frequent. These are then counted exactly, so slots that are full cost time only;
#: rare shingles put (distinct shingles of a mean document / SLOTS) of the documents in a slot, whatever the corpus.
SLOTS = 1 << 18
#: Rounds of leaders, and the bounds of a block: texts (on average; a hash deals them) and bytes of their shingles.
LEADERS, BLOCK, BLOCK_BYTES = 2, 1024, 8 << 20
#: Bytes of text, shingles, and rows of a batch that are worked on at once.
CHUNK, CELL, SLICE = 1 << 18, 1 << 13, 500
_LEVELS = 1 << 16
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, for the longest piece so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(CHUNK, 1 << n.bit_length())
            steps = np.full((2, size), [[_BASE], [_INVERSE]], np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that stand behind each other in `raw` (bytes) up to `ends`, and the number of
    words up to each end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    live = ~_SPACE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:], after[:-1], after[-1] = False, live[:-1], live[1:], False
    inner = ends[(ends > 0) & (ends < n)]
    before[inner], after[inner - 1] = False, False
    first, last = np.flatnonzero(live & ~before), np.flatnonzero(live & ~after) + 1
    up, down = _POWERS.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    return _mix((sums[last] - sums[first]) * down[first]), np.searchsorted(first, ends)


def _runs(h: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts whose word hashes stand behind each other, in order, and their numbers."""
    each = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    if not len(h):
        return np.zeros(0, np.uint64), each
    few = np.flatnonzero((counts > 0) & (counts < words))
    start = np.cumsum(counts) - counts
    m = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(len(h), np.uint64)
    k = len(h) - words + 1
    if k > 0:
        s = h[:k].copy()
        for i in range(1, words):
            s *= m
            s += h[i : i + k]
        out[:k] = s
    for i in few:  # a text of fewer words is one shingle
        s = 0
        for w in h[start[i] : start[i] + counts[i]].tolist():
            s = (s * int(m) + w) & (2**64 - 1)
        out[start[i]] = s
    at = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return _mix(out[at]), each


def _pieces(raw: np.ndarray, size: int):
    """Cuts a long text at white space into pieces of about `size` bytes."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end : end + size]])
            if len(gap):
                end += int(gap[0])
                break
            end += size
        yield raw[at:end]
        at = end


def shingle_runs(column: pa.Array, words: int = WORDS):
    """(first text, hashes, numbers) for each chunk of a column of texts: all shingles of the texts, in order. A chunk
    has CHUNK bytes of text, or one longer text, which is hashed by pieces. A null text is empty."""
    data = column.fill_null("").cast(pa.large_binary())
    _, offsets, buffer = data.buffers()
    offs = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(data):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        part = raw[offs[i] : offs[j]]
        if len(part) <= CHUNK:
            h, upto = _words(part, offs[i + 1 : j + 1] - offs[i])
            counts = np.diff(upto, prepend=0)
        else:
            h = np.concatenate([_words(x, np.array([len(x)]))[0] for x in _pieces(part, CHUNK)])
            counts = np.array([len(h)])
        yield (i, *_runs(h, counts, words))
        i = j


def _distinct(h: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, their counts, and their numbers."""
    h = h.copy()
    ends = np.cumsum(each)
    for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[(ends - each)[each > 0]] = True
    at = np.flatnonzero(first)
    return h[at], np.diff(at, append=len(h)), np.diff(np.searchsorted(at, ends), prepend=0)


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, and their counts. A text of fewer words is one shingle; one without a
    word has none."""
    (_, h, each), = shingle_runs(pa.array([text], pa.large_string()), words)
    return _distinct(h, each)[:2]


class Weights:
    """Inverse document frequencies: those of the frequent shingles, by sorted hash; all others weigh 1."""

    def __init__(self, h: np.ndarray, idf: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.idf = h[order], idf[order].astype(np.float64)

    def of(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = counts.astype(np.float64)
        if len(self.h) and len(h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            known = np.flatnonzero(self.h[at] == h)
            w[known] *= self.idf[at[known]]
        return w


def common_df(n: int) -> float:
    """Document frequency of `n` documents up to which a shingle weighs 1."""
    return max(LEAST_DF, COMMON * n)


def inverse_frequencies(df: np.ndarray, n: int, law: str = "flat") -> np.ndarray:
    """1 up to the common share, and less above: by `flat`, a log-linear law that ends at 1 - DAMP for what all have, or by
    `smooth`, the plain smoothed inverse frequency ln((1 + n) / (1 + df)) + 1 as a share of that of the common share."""
    base = common_df(n)
    df = np.maximum(df, base)
    if law == "smooth":
        return (np.log((1 + n) / (1 + np.minimum(df, n))) + 1) / (np.log((1 + n) / (1 + min(base, n))) + 1)
    over = np.log(df / base) / np.log(max(n / base, np.e))
    return 1 - DAMP * np.minimum(over, 1)


def frequent_shingles(docs: DataFrame, text: str, n: int, words: int = WORDS, law: str = "flat") -> Weights:
    """Exact document frequencies of all shingles above the common share, over all `n` documents.

    First all shingles are counted by slot of their hash, which bounds their frequency from above; then those of full
    slots by hash. Counts are added up in the task first. The driver gets the slots and the shingles above the share:
    a share s of all documents is reached by (shingles of a mean document) / s at most, whatever the number of documents.
    """
    least, mask = common_df(n), np.uint64(SLOTS - 1)
    texts = docs.select(F.col(text).cast("string").alias("body"))

    def by_slot(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, h, _ in shingle_runs(batch.column(0), words):
                total += np.bincount((h & mask).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

    slots = texts.mapInArrow(by_slot, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    full = np.zeros(SLOTS, bool)
    full[slots.select("slot").toArrow()["slot"].to_numpy()] = True

    def by_hash(batches):
        held, size = [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "df"])

        for batch in batches:
            for _, h, each in shingle_runs(batch.column(0), words):
                some = full[(h & mask).astype(np.int64)]
                doc = np.repeat(np.arange(len(each)), each)[some]
                h = h[some]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                held.append(h[keep])
                size += len(held[-1])
                if size > 1 << 20:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = texts.mapInArrow(by_hash, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") > least)
    got = counts.toArrow()
    return Weights(got["h"].to_numpy().view(np.uint64), inverse_frequencies(got["df"].to_numpy(), n, law))


class Sampler:
    """Improved consistent weighted sampling. For sample k a shingle's hash picks r and c from Gamma(2, 1) and b from
    [0, 1); t = floor(ln w / r + b); the shingle of least ln c - r (t + 1 - b) is taken, with its t."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        u = (np.arange(_LEVELS) + 0.5) / _LEVELS
        # Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection.
        low, high = np.zeros(_LEVELS), np.full(_LEVELS, 50.0)
        for _ in range(60):
            mid = (low + high) / 2
            less = 1 - (1 + mid) * np.exp(-mid) < u
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        gamma = ((low + high) / 2).astype(np.float32)
        self.r, self.inv, self.logc = gamma, 1 / gamma, np.log(gamma)
        self.keys = rng.integers(1, 2**63, samples, np.uint64) | np.uint64(1)

    def sample_many(self, h: np.ndarray, weights: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Values [texts, samples] of texts that have one shingle at least; `each` tells their numbers of shingles."""
        start = np.cumsum(each) - each
        odd = np.flatnonzero(weights != 1)  # for weights of 1, t is 0
        logw = np.log(weights[odd]).astype(np.float32)
        out = np.empty((len(each), len(self.keys)), np.uint64)
        for k, key in enumerate(self.keys):
            x = h * key
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            i = (x >> np.uint64(48)).view(np.int64)
            j = ((x >> np.uint64(32)) & np.uint64(_LEVELS - 1)).view(np.int64)
            b = ((x >> np.uint64(8)).astype(np.uint32) & np.uint32(0xFFFFFF)).astype(np.float32)
            b *= np.float32(2**-24)
            r, c = self.r.take(i), self.logc.take(j)
            a = c - r * (1 - b)
            if len(odd):
                t = np.floor(logw * self.inv.take(i[odd]) + b[odd])
                a[odd] = c[odd] - r[odd] * (t + 1 - b[odd])
            least = np.minimum.reduceat(a, start)
            hits = np.flatnonzero(a == np.repeat(least, each))
            best = hits[np.searchsorted(hits, start)]
            out[:, k] = h[best]
            if len(odd):
                at = np.minimum(np.searchsorted(odd, best), len(odd) - 1)
                with_t = odd[at] == best
                out[with_t, k] ^= t[at[with_t]].astype(np.int64).view(np.uint64) * np.uint64(_BASE)
        return out

    def sample(self, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit value for each sample of one text."""
        return self.sample_many(h, weights, np.array([len(h)]))[0]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    wa, wb = weights.of(ha, ca), weights.of(hb, cb)
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[ia], wb[ib]).sum())
    return low / float(wa.sum() + wb.sum() - low)


def _signatures(weights: Weights, words: int, bands: int, rows: int):
    """(rep, buckets) of (rep, body). A text that the task has met lately gives no second row."""

    def run(batches):
        sampler, met = Sampler(bands * rows), Recent(1 << 16)
        band = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            new = []
            for i, rep in enumerate(batch.column(0).to_pylist()):
                if rep not in met and met.recall(rep) is None:
                    met.add(rep, True)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            has, keys = np.zeros(len(new), bool), []
            for at, h, each in shingle_runs(batch.column(1), words):
                h, counts, each = _distinct(h, each)
                has[at : at + len(each)] = each > 0
                each = each[each > 0]
                w, ends = weights.of(h, counts), np.cumsum(each)
                a = 0
                while a < len(each):  # cells of CELL shingles, or one longer text
                    z = max(a + 1, int(np.searchsorted(ends, ends[a] - each[a] + CELL, "right")))
                    part = slice(ends[a] - each[a], ends[z - 1])
                    got = sampler.sample_many(h[part], w[part], each[a:z]).reshape(z - a, bands, rows)
                    key = np.tile(band, (z - a, 1))
                    for k in range(rows):
                        key = _mix(key * np.uint64(_BASE) + got[:, :, k])
                    keys.append(key.view(np.int64).ravel())
                    a = z
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(has) * bands]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["rep", "buckets"])

    return run


def _verify(weights: Weights, words: int, threshold: float):
    """(la, lb), the classes of a text and its leader, of the pairs (la, lb, b, body_a, body_b) that reach the threshold."""

    def run(batches):
        held = {}  # the leader's shingles: pairs come sorted by leader
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                lead = batch.column(2)[i].as_py()
                if lead not in held:
                    held.clear()
                    held[lead] = shingles(batch.column(4)[i].as_py(), words)
                keep.append(weighted_jaccard(shingles(batch.column(3)[i].as_py(), words), held[lead], weights) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["la", "lb"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingled(words: int):
    """(rep, h, counts) of (rep, body): the shingles as bytes."""

    def run(batches):
        for batch in batches:
            hs, cs = [], []
            for _, h, each in shingle_runs(batch.column(1), words):
                h, c, each = _distinct(h, each)
                cuts = np.cumsum(each)[:-1]
                hs += [x.tobytes() for x in np.split(h, cuts)]
                cs += [x.astype(np.int32).tobytes() for x in np.split(c, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], ["rep", "h", "counts"])

    return run


def _block_links(weights: Weights, threshold: float):
    """Links (la, lb) of classes within a block of a bucket, or between two: of the pairs of texts whose first common band
    this is and whose classes no link of this task has joined yet, those that reach the threshold."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        sides = [m.values for m in rows.column("members").combine_chunks()]
        members = pa.concat_arrays(sides) if len(sides) > 1 else sides[0]
        split = len(sides[0]) if len(sides) > 1 else 0
        reps, labels = members.field("rep").to_pylist(), members.field("label").to_pylist()
        cls = np.unique(np.array([x.hex() for x in labels]), return_inverse=True)[1]
        buckets = members.field("buckets").flatten().to_numpy().reshape(len(reps), -1)
        hs = [np.frombuffer(x, np.uint64) for x in members.field("h").to_pylist()]
        ws = [weights.of(h, np.frombuffer(c, np.int32)) for h, c in zip(hs, members.field("counts").to_pylist(), strict=True)]
        total = np.array([w.sum() for w in ws])
        kinds, ids = np.unique(np.concatenate(hs), return_inverse=True)
        ends = np.cumsum([len(h) for h in hs])
        own = np.zeros(len(kinds))
        out: list[tuple[bytes, bytes]] = []
        for a in range(split or len(reps)):
            others = np.arange(split or a + 1, len(reps))
            others = others[cls[others] != cls[a]]
            others = others[np.minimum(total[others], total[a]) >= threshold * np.maximum(total[others], total[a]) - 1e-9]
            same = buckets[others] == buckets[a]
            others = others[buckets[a][same.argmax(axis=1)] == bucket]
            if not len(others):
                continue
            mine = ids[ends[a] - len(hs[a]) : ends[a]]
            own[mine] = ws[a]
            for b in others.tolist():
                if cls[a] != cls[b]:
                    low = float(np.minimum(own[ids[ends[b] - len(hs[b]) : ends[b]]], ws[b]).sum())
                    if low / (total[a] + total[b] - low) >= threshold:
                        out.append((labels[a], labels[b]))
                        cls[cls == cls[b]] = cls[a]
            own[mine] = 0
        return pa.table({"la": pa.array([x[0] for x in out], pa.binary()), "lb": pa.array([x[1] for x in out], pa.binary())})

    return run


def block_links(members: DataFrame, texts: DataFrame, weights: Weights, words: int, threshold: float) -> DataFrame:
    """Links (la, lb) that join the classes of `members` (bucket, rep, label, buckets) as far as pairs of a bucket reach
    the threshold; `texts` is (rep, body), each once.

    A bucket's members are dealt to blocks by a hash, and each pair of its blocks is a task's work: a bucket of n texts
    is read n / BLOCK times, is spread over as many tasks, and gives fewer links than its texts times its blocks.
    """
    need = members.select("rep").distinct()
    shingled = cut(texts.join(need.hint("merge"), "rep", "left_semi").select("rep", "body").mapInArrow(_shingled(words), "rep binary, h binary, counts binary"))
    sized = members.select("bucket", "rep").join(shingled.select("rep", F.octet_length("h").alias("bytes")).hint("merge"), "rep")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1))
    sizes = cut(sized.groupBy("bucket").agg(blocks.cast("int").alias("blocks")))
    # Shingles come in after the blocks are dealt, so no task gets those of a whole bucket.
    dealt = members.join(sizes.hint("merge"), "bucket").withColumn("x", F.pmod(F.hash("rep"), F.col("blocks")))
    dealt = dealt.join(shingled.hint("merge"), "rep")
    blocked = dealt.groupBy("bucket", "blocks", "x").agg(F.collect_list(F.struct("rep", "label", "buckets", "h", "counts")).alias("members"))
    paired = blocked.select("bucket", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "members")
    paired = paired.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "members")
    # A block whose partner is empty would be compared with itself once more for each of them: one row is for i = j.
    run = _block_links(weights, threshold)

    def once(key: tuple, rows: pa.Table) -> pa.Table:
        if rows.num_rows == 1 and key[1].as_py() != key[2].as_py():
            return pa.table({"la": pa.array([], pa.binary()), "lb": pa.array([], pa.binary())})
        return run(key, rows)

    return paired.groupBy("bucket", "i", "j").applyInArrow(once, "la binary, lb binary")


def joined_classes(links: DataFrame) -> DataFrame:
    """(label, to): the least label of each connected component, for each label that a link (la, lb) touches.

    Every label takes the least among its neighbours until none changes. Links go to leaders, so components are flat and
    few rounds do; each is one checkpoint, and a leader with very many neighbours only meets checkpointed tables."""
    both = links.select(F.col("la").alias("u"), F.col("lb").alias("v")).unionByName(links.select(F.col("lb").alias("u"), F.col("la").alias("v")))
    held = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    while True:
        near = both.join(held.select(F.col("u").alias("v"), "m").hint("merge"), "v").groupBy("u").agg(F.min("m").alias("n"))
        held = cut(held.join(near.hint("merge"), "u").select("u", F.least("m", "n").alias("m"), (F.col("n") < F.col("m")).alias("moved")))
        if held.where("moved").isEmpty():
            return held.select(F.col("u").alias("label"), F.col("m").alias("to"))


def relabel(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """`rows` with `label` after the moves."""
    moved = rows.join(moves.hint("merge"), "label", "left")
    return cut(moved.select(*[F.coalesce("to", "label").alias("label") if c == "label" else F.col(c) for c in rows.columns]))


def near_duplicates(docs: DataFrame, text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, law: str = "flat") -> tuple[DataFrame, Column]:
    """(class of each distinct text, key of a row's text). The first is (`key`, `label`): `key` the 16-byte MD5 of a
    text, `label` the least key of its class; the second is the expression for that key over the rows of `docs`.

    Exact copies are one text from the start, so they cost a row of the first shuffle, whatever their number. `law`: how
    frequent shingles weigh less, see inverse_frequencies().
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(body))
    src = docs.select(key.alias("rep"), body.alias("body"))
    weights = frequent_shingles(src, "body", docs.count(), words, law)

    signed = src.mapInArrow(_signatures(weights, words, bands, rows), "rep binary, buckets array<long>")
    signed = cut(signed.groupBy("rep").agg(F.max("buckets").alias("buckets")))
    entries = signed.select("rep", F.explode("buckets").alias("bucket"))
    shared = cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = entries.join(shared.hint("merge"), "bucket")
    # How much of the corpus a text is a candidate for: the original of a group is a candidate for most copies.
    of_text = F.collect_list("bucket").alias("buckets")
    texts_in = cut(members.groupBy("rep").agg(of_text, F.sum("n").alias("w")))
    members = texts_in.select(F.explode("buckets").alias("bucket"), "rep", "w")
    # The texts that have a candidate, once each.
    texts = cut(src.groupBy("rep").agg(F.first("body").alias("body")).join(texts_in.select("rep").hint("merge"), "rep"))
    # Texts without a candidate are classes of their own; they come back at the end.
    labels = texts_in.select("rep", F.col("rep").alias("label"))
    ta, tb = texts.select(F.col("rep").alias("a"), F.col("body").alias("body_a")), texts.select(F.col("rep").alias("b"), F.col("body").alias("body_b"))
    waiting = members.select("bucket", "rep", "w", F.col("rep").alias("label"), F.lit(False).alias("led"))
    for turn in range(LEADERS + 1):
        at = waiting if turn < LEADERS else waiting.where(~F.col("led"))  # in the end, what has led is compared
        leads = at.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.max(F.when(~F.col("led"), F.struct("w", "rep", "label"))).alias("lead"))
        leads = cut(leads.where("l0 <> l1 AND lead IS NOT NULL").select("bucket", F.col("lead.rep").alias("lead"), F.col("lead.label").alias("lead_label")))
        if leads.isEmpty():
            break
        met = cut(at.join(leads.hint("merge"), "bucket"))
        if turn < LEADERS:
            # A text has a leader a bucket, so as many as bands at most.
            pairs = met.where(F.col("label") != F.col("lead_label")).groupBy(F.col("rep").alias("a")).agg(F.first("label").alias("la"), F.collect_set(F.struct(F.col("lead").alias("b"), F.col("lead_label").alias("lb"))).alias("leads"))
            pairs = pairs.join(ta.hint("merge"), "a").select("la", "body_a", F.explode("leads").alias("l")).select("la", "l.lb", "l.b", "body_a")
            both = pairs.join(tb.hint("merge"), "b").select("la", "lb", "b", "body_a", "body_b").sortWithinPartitions("b")
            links = both.mapInArrow(_verify(weights, words, threshold), "la binary, lb binary")
        else:
            rest = cut(met.join(signed.hint("merge"), "rep").select("bucket", "rep", "label", "buckets"))
            links = block_links(rest, texts, weights, words, threshold)
        links = cut(links.distinct())
        waiting = met.select("bucket", "rep", "w", "label", (F.col("led") | (F.col("rep") == F.col("lead"))).alias("led"))
        if not links.isEmpty():
            moves = joined_classes(links)
            labels = relabel(labels, moves)
            waiting = relabel(waiting, moves) if turn < LEADERS else waiting
    own = signed.select("rep").join(labels.hint("merge"), "rep", "left").select(F.col("rep").alias("key"), F.coalesce("label", "rep").alias("label"))
    return cut(own), key


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(`id_col`, class_id, class_size) a row. `class_id` is the least id of the class (connected texts).

    Null text is empty; texts without a word are copies of each other only if they are equal. Texts of fewer than five
    words are one shingle; long texts are read whole, by pieces. Null ids: their class has the least id of others, null
    if there is none. Repeated rows are copies. No rows: no rows. Other columns are not read.
    """
    labels, key = near_duplicates(docs, text_col, **how)
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("key"))
    placed = keyed.join(labels.hint("merge"), "key").select("id", "label")
    sizes = cut(placed.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")))
    return cut(placed).join(sizes.hint("merge"), "label").select(F.col("id").alias(id_col), "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` without those whose class has a row of smaller id (null ids last, ties by text; of repeated
    rows one stays). All columns pass through, whatever their names."""
    labels, key = near_duplicates(docs, text_col, **how)
    k, label, first, row = (fresh(docs, x) for x in ("_key", "_label", "_first", "_row"))
    # Ids and keys alone are grouped; `_row` is the whole row, so that no name of its columns can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(id_col).alias("id"), key.alias(k))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(k).alias("key"))
    named = labels.select(F.col("key").alias(k), F.col("label").alias(label))
    first_of = cut(keyed.join(named.hint("merge"), k).groupBy(label).agg(F.min(order).alias(first)))
    chosen = first_of.select(F.col(f"{first}.id").alias("chosen_id"), F.col(f"{first}.key").alias("chosen_key"))
    hit = keyed.join(chosen.hint("merge"), (F.col(k) == F.col("chosen_key")) & F.col("id").eqNullSafe(F.col("chosen_id")), "left_semi")
    return hit.dropDuplicates(["id", k]).select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
