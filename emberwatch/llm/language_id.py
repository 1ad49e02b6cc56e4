"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

It starts from a short training on the driver, on a bounded sample; then Spark's tasks train it on all windows of all labelled
documents, and their networks are averaged.

Texts are cut into windows of T bytes, the last one shorter. Within its window every byte gets a probability for each
language, from the states of both directions; a document's probabilities are the mean over all of its bytes.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from emberwatch.llm.common import BROADCAST_ROWS, fresh, table

#: Bytes of a window, states of a direction, windows that are worked on at a time.
T, HIDDEN, WINDOWS = 64, 8, 512
#: Bound of the sample that the network starts from: documents of a language (all windows of each), and of all languages together.
DOCS_PER_LANG, DOCS = 400, 80_000
#: A learned document in so many is not trained on, but tells what scores to expect.
CALIBRATE = 5
STEPS, BATCH, RATE = 320, 96, 0.02
#: Bytes of a group of documents that one task trains on, about; windows that it mixes; its rate.
GROUP, MIXED, FINE = 8 << 20, 1 << 15, 0.002
#: Steps of one that scores are told apart by in calibration, and of a parameter in the mean of the networks.
BINS, UNIT = 10_000, float(1 << 32)
REJECTED = 0.001
UNKNOWN = "und"


class Network:
    """Parameters: table (byte to gates), recurrent weights and their biases for each direction, and the output layer."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden, self.classes = hidden, classes
        #: Less is improbable for a text in one of the languages; see floor_of().
        self.floor = 0.0
        self.scratch: dict[str, np.ndarray] = {}
        self.p = {
            "table": (rng.standard_normal((2, 3 * hidden, 256)) * 0.3).astype(f),
            "u": (rng.standard_normal((2, 3 * hidden, hidden)) / np.sqrt(hidden)).astype(f),
            "b": np.zeros((2, hidden, 1), f),
            "out": (rng.standard_normal((2, classes, hidden)) * 0.3).astype(f),
            "bias": np.zeros((classes, 1), f),
        }

    def __getstate__(self) -> dict:
        return self.__dict__ | {"scratch": {}}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array for intermediate values, the same memory at each call: fresh pages cost a third of the training."""
        size, kind = math.prod(shape), self.p["u"].dtype
        if name not in self.scratch or self.scratch[name].size < size or self.scratch[name].dtype != kind:
            self.scratch[name] = np.empty(size, kind)
        return self.scratch[name][:size].reshape(shape)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table [(gate, direction, byte), hidden], recurrent weights [gate, direction, from, to] and biases [direction, 1,
        hidden] for states [windows, hidden]. Factors of the exponents are multiplied in: a gate is 1 / (1 + exp(-v)), the
        new value tanh(v) = 1 - 2 / (1 + exp(2 v))."""
        p, n = self.p, self.hidden
        factor = np.array([-1, -1, 2], p["u"].dtype).reshape(3, 1, 1, 1)
        table = p["table"].reshape(2, 3, n, 256).transpose(1, 0, 3, 2) * factor
        u = p["u"].reshape(2, 3, n, n).transpose(1, 0, 3, 2) * factor
        return np.ascontiguousarray(table).reshape(6 * 256, n), np.ascontiguousarray(u), 2 * p["b"].transpose(0, 2, 1)

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits [T, classes, windows] of bytes x [T, windows]. Beyond a window's length both states are 0, so the
        backward direction starts at the last byte of a shorter window.

        Arrays of a step are [direction, windows, hidden] and contiguous; the backward direction's step s reads byte T - 1 - s.
        `keep` gets what gradients() needs of all steps: the states, both gates with the recurrent value, and the new value."""
        (steps, count), n = x.shape, self.hidden
        table, u, b = self.packed()
        kept = 1 if keep is None else steps
        rows = np.stack([x, x[::-1]], axis=1)[:, None] + 256 * np.arange(6).reshape(1, 3, 2, 1)
        b = np.repeat(b, count, axis=1)
        states = self.room("states", 2, steps + 1, count, n)
        states[:, 0] = 0
        a = self.room("a", 3, 2, count, n)
        inner, new = self.room("inner", kept, 3, 2, count, n), self.room("new", kept, 2, count, n)
        ended = _ended(lengths, steps)
        with np.errstate(over="ignore"):  # the exponential of a gate that is shut
            for s in range(steps):
                r, c, h, after = inner[s % kept], new[s % kept], states[:, s], states[:, s + 1]
                table.take(rows[s], axis=0, out=a, mode="clip")
                np.matmul(h, u, out=r)
                zg, rn = r[:2], r[2]
                zg += a[:2]
                np.exp(zg, out=zg)
                zg += 1
                np.divide(1, zg, out=zg)
                rn += b
                np.multiply(zg[1], rn, out=c)
                c += a[2]
                np.exp(c, out=c)
                c += 1
                np.divide(-2, c, out=c)
                c += 1
                np.subtract(h, c, out=after)
                after *= zg[0]
                after += c
                _clear(after, ended, s)
        if keep is not None:
            keep += [states, inner, new, ended]
        y = np.matmul(self.p["out"], states[:, 1:].reshape(2, steps * count, n).transpose(0, 2, 1), out=self.room("y", 2, self.classes, steps * count))
        y = y.reshape(2, self.classes, steps, count)
        logits = y[0] + y[1, :, ::-1]
        logits += self.p["bias"][:, :, None]
        return logits.transpose(1, 0, 2)

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict]:
        """Mean cross entropy over all bytes, and its gradients by backpropagation through time. With `weight` a window's
        part in both is so many times as large."""
        keep: list = []
        (steps, count), n, p = x.shape, self.hidden, self.p
        probs = self.softmax(self.run(x, lengths, keep)).transpose(1, 0, 2)  # [classes, T, windows]
        states, inner, new, ended = keep
        kind, every = states.dtype, steps * count
        live = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        total = max(1.0, float(live.sum()))
        if weight is not None:
            live = live * weight.astype(np.float32)
        loss = float(-(np.log(np.maximum(probs[y, :, np.arange(count)].T, 1e-9)) * live).sum() / total)
        d = probs - np.eye(self.classes, dtype=np.float32)[y].T[:, None, :]
        d *= live / total
        d = np.stack([d, d[:, ::-1]]).reshape(2, self.classes, every)
        dy = np.matmul(d.transpose(0, 2, 1), p["out"], out=self.room("dy", 2, every, n)).reshape(2, steps, count, n)
        u = p["u"].copy()
        u[:, n : 2 * n] *= 0.5  # the kept recurrent value is twice itself, and so is the gradient of the second gate
        # Of a byte: the gradients of both gates' sums, of the recurrent value and of the new one's sum.
        dv, four = self.room("dv", 2, steps, count, 4 * n), self.room("four", 4, 2, count, n)
        moved = np.ascontiguousarray(np.arange(8 * count).reshape(4, 2, count).transpose(1, 2, 0))
        dz, dg, dr, dc = four
        dh, t, past = np.zeros((2, count, n), kind), self.room("t", 2, count, n), self.room("past", 2, count, n)
        for s in reversed(range(steps)):
            (z, g, rn), c = inner[s], new[s]
            dh += dy[:, s]
            _clear(dh, ended, s)
            np.multiply(dh, z, out=past)
            np.subtract(dh, past, out=t)
            np.subtract(states[:, s + 1], c, out=dz)  # z times what the new value takes from the state
            dz *= t
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= t
            np.multiply(dc, g, out=dr)
            np.subtract(1, g, out=dg)
            dg *= dr
            dg *= rn
            for k in range(2):
                four.reshape(8 * count, n).take(moved[k], axis=0, out=dv[k, s].reshape(count, 4, n), mode="clip")
            np.matmul(dv[:, s, :, : 3 * n], u, out=dh)
            dh += past
        dv = dv.reshape(2, every, 4 * n)
        grad = {"bias": d[0].sum(axis=1)[:, None], "out": np.matmul(d, states[:, 1:].reshape(2, every, n))}
        grad["u"] = np.matmul(dv[:, :, : 3 * n].transpose(0, 2, 1), states[:, :-1].reshape(2, every, n))
        grad["u"][:, n : 2 * n] *= 0.5
        sums = _sums_by_byte(x, dv, self.room("rows", 2, every, 4 * n))
        grad["b"] = sums[:, 2 * n : 3 * n].sum(axis=2, keepdims=True)
        grad["table"] = np.concatenate([sums[:, : 2 * n], sums[:, 3 * n :]], axis=1)
        grad["table"][:, n : 2 * n] *= 0.5
        return loss, grad

    def train(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, doc: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> float:
        """Adam over batches of windows x [windows, T] of documents `doc`; returns the last mean loss. Languages are drawn
        alike, then their documents, then windows of these, so that a long text doesn't stand for its language."""
        rng = np.random.default_rng(seed)
        groups = []
        for k in np.unique(y):
            own = np.flatnonzero(y == k)
            own = own[np.argsort(doc[own], kind="stable")]
            first = np.flatnonzero(np.diff(doc[own], prepend=doc[own[0]] - 1))
            groups.append((own, first, np.diff(first, append=len(own))))

        def draw(own, first, sizes, n):
            d = rng.integers(len(first), size=n)
            return own[first[d] + (rng.random(n) * sizes[d]).astype(np.int64)]

        loss, adam = 0.0, self.adam()
        for i in range(1, steps + 1):
            take = np.concatenate([draw(*g, max(1, batch // len(groups))) for g in groups])
            now, grad = self.gradients(np.ascontiguousarray(x[take].T), lengths[take], y[take])
            loss = now if i == 1 else 0.9 * loss + 0.1 * now
            adam(grad, rate * min(1.0, 2 - 2 * i / steps))
        return loss

    def adam(self):
        """Steps of Adam, each a call with gradients and a rate."""
        m, v, i = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0

        def step(grad: dict, rate: float) -> None:
            nonlocal i
            i += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)

        return step

    def documents(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities [documents, classes] of the texts raw[offsets[i]:offsets[i+1]]; zeros for empty ones."""
        sizes = np.diff(offsets)
        doc, start, length = _places(offsets)
        out = np.zeros((len(sizes), self.classes))
        order = np.argsort(-length, kind="stable")  # shorter windows together
        for a in range(0, len(order), WINDOWS):
            w = order[a : a + WINDOWS]
            at = start[w] + np.arange(T)[:, None]
            x = raw[np.minimum(at, len(raw) - 1)]
            probs = self.softmax(self.run(x, length[w]))
            probs *= (np.arange(T)[:, None] < length[w])[:, None, :]
            np.add.at(out, doc[w], probs.sum(axis=0).T)
        return out / np.maximum(sizes, 1)[:, None]


def _ended(lengths: np.ndarray, steps: int) -> list:
    """For each byte the windows that end before it: None, or a slice where the longest windows come first, or numbers."""
    order = np.argsort(-lengths, kind="stable")
    left = np.searchsorted(-lengths[order], -np.arange(steps))  # windows longer than so many bytes
    ordered = bool((order[1:] > order[:-1]).all())
    return [None if k == len(order) else slice(k, None) if ordered else order[k:] for k in left.tolist()]


def _clear(h: np.ndarray, ended: list, s: int) -> None:
    """Sets h [2, windows, hidden] to 0 where the byte of step s is beyond a window's end."""
    for k, windows in ((0, ended[s]), (1, ended[-1 - s])):
        if windows is not None:
            h[k, windows] = 0


def _sums_by_byte(x: np.ndarray, dv: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums [direction, gradient, byte] of dv [direction, places, gradients] over all places of a byte. `rows` is room for
    them in the order of the bytes."""
    steps, count = x.shape
    order = np.argsort(x.reshape(-1), kind="stable")
    for k, at in enumerate((order, (steps - 1 - order // count) * count + order % count)):
        dv[k].take(at, axis=0, out=rows[k], mode="clip")
    out, a = np.zeros((2, dv.shape[-1], 256), dv.dtype), 0
    ones = np.ones(len(order), dv.dtype)
    for byte, size in enumerate(np.bincount(x.reshape(-1), minlength=256)):
        if size:
            out[:, :, byte] = np.matmul(ones[:size], rows[:, a : a + size])
        a += size
    return out


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of all windows of the texts from offsets[i] to offsets[i+1]."""
    sizes = np.diff(offsets)
    each = -(-sizes // T)
    doc = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return doc, offsets[:-1][doc] + nth * T, np.minimum(T, sizes[doc] - nth * T)


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts, null as empty."""
    col = col.fill_null("").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), offs


def _pieces(batches, size: int):
    """All windows of (y, weight, body) rows, `size` at a time: bytes [windows, T], lengths, y, and the windows' weights, a
    document's divided by the number of its windows."""
    for batch in batches:
        raw, offs = _bytes(batch.column(2))
        y, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        doc, start, length = _places(offs)
        each = np.maximum(np.bincount(doc, minlength=len(y)), 1)
        for a in range(0, len(doc), size):
            d, n = doc[a : a + size], length[a : a + size]
            x = raw[np.minimum(start[a : a + size, None] + np.arange(T), len(raw) - 1)]
            x[np.arange(T) >= n[:, None]] = 0
            yield x, n, y[d], weight[d] / each[d]


def _windows(batches):
    """All windows of documents: (lang, doc, raw)."""
    for batch in batches:
        for lang, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            cuts = [raw[s : s + T] for s in range(0, len(raw), T)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cuts), pa.string()), pa.array([doc] * len(cuts), pa.int64()), pa.array(cuts, pa.binary())], ["lang", "doc", "raw"])


def learned_documents(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, docs: int = DOCS) -> DataFrame:
    """(lang, doc, body) of the documents to learn from: of each label those of least hash, `docs_per_lang` at most and
    `docs` over all labels, but one of each. Of a frequent label only the hashes below a bound are ranked, so that what is
    shuffled doesn't follow the corpus."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("body").rlike(r"\p{L}")).withColumn("doc", F.xxhash64("order"))
    counts = usable.groupBy("lang").count().collect()  # a row a label
    each = max(1, min(docs_per_lang, docs // max(1, len(counts))))
    limits = [(r["lang"], int(-(2**63) + min(1.0, 8 * each / r["count"]) * (2**64 - 2049))) for r in counts]
    limit = labelled.sparkSession.createDataFrame(limits, "lang string, most long")
    near = usable.join(F.broadcast(limit) if len(limits) <= BROADCAST_ROWS else limit, "lang").where("doc <= most")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc", "order")))
    return ranked.where(F.col("r") <= each).select("lang", "doc", "body")


def train_languages(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, floor: bool = True) -> tuple[list[str], Network]:
    """The network for (order, lang, body). Its start is fitted on the driver on the windows of learned_documents(), then
    learn_all() trains it on every document; with `floor` its floor comes from all that are kept for calibration. Every label is a
    class, so what is learned follows the number of labels."""
    rows = learned_documents(labelled, docs_per_lang).mapInArrow(_windows, "lang string, doc long, raw binary").toPandas().sort_values(["lang", "doc", "raw"])
    langs = sorted(set(rows["lang"]))
    net = Network(max(1, len(langs)))
    if len(langs) > 1:
        x = np.zeros((len(rows), T), np.uint8)
        lengths = np.array([len(r) for r in rows["raw"]])
        for i, r in enumerate(rows["raw"]):
            x[i, : len(r)] = np.frombuffer(r, np.uint8)
        y = np.searchsorted(langs, rows["lang"])
        unseen = calibration_rows(rows["doc"].to_numpy(), y)
        net.train(x[~unseen], lengths[~unseen], y[~unseen], rows["doc"].to_numpy()[~unseen])
        learn_all(net, labelled, langs, floor)
    return langs, net


def learn_all(net: Network, labelled: DataFrame, langs: list[str], floor: bool = True) -> None:
    """Trains `net` on all windows of all documents (order, lang, body) with a label and a letter but one in CALIBRATE, and
    with `floor` sets its floor by these. Languages weigh alike, and so do the documents of one, however long.

    Documents are dealt by hash to groups of about GROUP bytes. A task takes the network through the windows of its group, once
    and in an order that follows from the texts, and the networks of all groups are averaged: the outcome doesn't follow
    from how many executors there are, or how the table is split."""
    spark = labelled.sparkSession
    d = labelled.where(F.col("lang").isNotNull() & F.col("body").rlike(r"\p{L}")).withColumns({"kept": F.pmod(F.xxhash64("order"), F.lit(CALIBRATE)) == 0, "spot": F.xxhash64("order", "body")})
    size = F.octet_length("body")
    taught = lambda what: F.sum(F.when(~F.col("kept"), what))
    stats = d.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.ceil(size / T)).alias("w"), F.sum(size).alias("b"), taught(F.lit(1)).alias("tn"), taught(F.ceil(size / T)).alias("tw"), taught(size).alias("tb")).collect()  # a row a label
    used = {r["lang"]: (r["tn"], r["tw"], r["tb"], False) if r["tn"] else (r["n"], r["w"], r["b"], True) for r in stats}
    mean = sum(u[1] for u in used.values()) / len(used)
    rows = [(g, k, float(mean / used[g][0]), used[g][3]) for k, g in enumerate(langs)]
    of = spark.createDataFrame(rows, "lang string, y int, weight double, whole boolean")
    d = d.join(F.broadcast(of) if len(rows) <= BROADCAST_ROWS else of, "lang")
    groups = max(1, -(-sum(u[2] for u in used.values()) // GROUP))
    dealt = d.where(~F.col("kept") | F.col("whole")).select("y", "weight", "body", "spot").repartition(groups, "spot").sortWithinPartitions("spot", "y", "body")
    each = dealt.drop("spot").mapInArrow(lambda batches: _trained(net, batches), "k int, v long")
    total = {r["k"]: (r["v"], r["n"]) for r in each.groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n")).collect()}  # a row a parameter
    at = 0
    for name, p in net.p.items():
        net.p[name] = np.array([total[k][0] / total[k][1] / UNIT for k in range(at, at + p.size)], np.float32).reshape(p.shape)
        at += p.size
    if not floor:
        return
    apart = d.where(F.col("kept") & ~F.col("whole")).select("y", "weight", "body")
    counts = apart.mapInArrow(lambda batches: _tops(net, batches), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows at most
    net.floor = floor_of(net.classes, {r["bin"]: r["n"] for r in counts})


def _trained(start: Network, batches):
    """(k, v): the parameters of the network after the windows of a group, in units of 1 / UNIT, so that sums are exact."""
    net, rng, any_yet = copy.deepcopy(start), np.random.default_rng(7), False
    adam = net.adam()
    for x, lengths, y, weight in _mixed(_pieces(batches, MIXED)):
        any_yet, order = True, rng.permutation(len(y))
        for a in range(0, len(order), WINDOWS):
            take = order[a : a + WINDOWS]
            take = take[np.argsort(-lengths[take], kind="stable")]  # the longest first, so that those that have ended are a slice
            adam(net.gradients(np.ascontiguousarray(x[take].T), lengths[take], y[take], weight[take])[1], FINE)
    if any_yet:
        flat = np.concatenate([p.reshape(-1) for p in net.p.values()]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.round(flat * UNIT).astype(np.int64))], ["k", "v"])


def _mixed(pieces):
    """Pieces put together to about MIXED windows."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[1])
        if n >= MIXED:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _tops(net: Network, batches):
    """(bin, n): rightly judged windows by their score."""
    counts = np.zeros(BINS + 1, np.int64)
    for x, lengths, y, _ in _pieces(batches, WINDOWS):
        counts += np.bincount((judged(net, x, lengths, y) * BINS).astype(np.int64).clip(0, BINS), minlength=BINS + 1)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bin", "n"])


def judged(net: Network, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of the windows x [windows, T] that are rightly judged."""
    probs = net.softmax(net.run(np.ascontiguousarray(x.T), lengths))
    live = np.arange(x.shape[1])[:, None] < lengths
    mean = (probs * live[:, None, :]).sum(axis=0) / np.maximum(lengths, 1)
    return mean.max(axis=0)[mean.argmax(axis=0) == y]


def floor_of(classes: int, counts: dict[int, int]) -> float:
    """The score halfway between chance and what all but a share of REJECTED of the rightly judged windows reach (`counts` by
    score, in steps of 1 / BINS), which the network wasn't trained on: a document below is nearer to a guess than to a
    text in one of the languages."""
    left = REJECTED * sum(counts.values())
    for b in sorted(counts):
        left -= counts[b]
        if left <= 0:
            return (1 / classes + b / BINS) / 2
    return 1 / classes


def calibration_rows(doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which windows are kept from training: those of one document in CALIBRATE, of languages with more than one."""
    unseen = doc % CALIBRATE == 0
    for k in np.unique(y):
        if unseen[y == k].all():
            unseen &= y != k
    return unseen


def predict_languages(docs: DataFrame, langs: list[str], net: Network, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score` (the pooled probability of that language) behind their columns; where `docs` has
    columns of these names, whatever their case, the added ones get `_` before their names.

    Null texts, texts without a letter, and all where no language was learned: `und` of score 0. No rows: no rows.
    Whole texts are read, without a shuffle; other columns pass through and are no inputs."""
    at, added = docs.columns.index(text_col), [fresh(docs, "lang_pred"), fresh(docs, "score")]
    names = [*docs.columns, *added]

    def run(batches):
        for batch in batches:
            raw, offs = _bytes(batch.column(at))
            size = batch.num_rows
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            probs = net.documents(raw, offs) if langs else np.zeros((size, 1))
            known = known.astype(bool) & bool(langs)
            top = probs.argmax(axis=1)
            pred = [langs[k] if ok else UNKNOWN for k, ok in zip(top, known, strict=True)]
            score = np.where(known, np.minimum(probs.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names)

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = types.StructType([*docs.schema.fields, types.StructField(added[0], types.StringType()), types.StructField(added[1], types.DoubleType())])
    return docs.withColumn(fresh(docs, "has_letter"), letter).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, floor: bool = True) -> tuple[list[str], Network]:
    """Languages and network; the floor takes a pass over a fifth of the learned texts, and only a filter by it needs it."""
    return train_languages(docs.where(~held_out()).select(F.col("doc_id").alias("order"), "lang", F.coalesce("text", F.lit("")).alias("body")), floor=floor)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, net = learn(docs, floor=False)
    out = predict_languages(docs.select("doc_id", held_out().alias("held_out"), "text"), langs, net)
    return out.select("doc_id", "held_out", "lang_pred", "score")
