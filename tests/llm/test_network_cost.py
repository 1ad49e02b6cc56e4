"""The language network costs little a byte, and op9_language_id makes no pass that its rows don't need."""

import os
import pickle
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import language_id


def _windows(count, lengths, seed=4):
    rng = np.random.default_rng(seed)
    net = language_id.Network(4, seed=seed)
    net.p = {k: v + (rng.standard_normal(v.shape) * 0.1).astype(v.dtype) for k, v in net.p.items()}
    return net, rng.integers(97, 123, (language_id.T, count)).astype(np.uint8), lengths(rng)


def _gate_by_gate(net, x):
    """Logits of whole windows, each gate's logistic function by tanh over arrays [features, windows]."""
    p, n, (steps, count) = net.p, net.hidden, x.shape
    h = np.zeros((2, n, count), np.float32)
    logits = np.repeat(np.repeat(p["bias"][None], count, axis=2), steps, axis=0)
    for s in range(steps):
        back = steps - 1 - s
        a = np.stack([p["table"][0].take(x[s], axis=1), p["table"][1].take(x[back], axis=1)])
        r = np.matmul(p["u"], h)
        gates = a[:, : 2 * n] + r[:, : 2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, g = gates[:, :n], gates[:, n:]
        c = np.tanh(a[:, 2 * n :] + g * (r[:, 2 * n :] + p["b"]))
        h = c + z * (h - c)
        y = np.matmul(p["out"], h)
        logits[s] += y[0]
        logits[back] += y[1]
    return logits


def _least(call, times=9):
    spent = []
    for _ in range(times):
        start = time.process_time()
        call()
        spent.append(time.process_time() - start)
    return min(spent)


def costs():
    """Seconds of a pass gate by gate, of run() and of gradients()."""
    net, x, lengths = _windows(language_id.WINDOWS, lambda rng: np.sort(rng.integers(1, 65, language_id.WINDOWS))[::-1])
    y = np.arange(len(lengths)) % 4
    return [_least(f) for f in (lambda: _gate_by_gate(net, x), lambda: net.run(x, lengths), lambda: net.gradients(x, lengths, y))]


def test_costs():
    """On one core, as a task has it."""
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": str(Path(__file__).parents[2])}
    plain, run, gradients = map(float, subprocess.run([sys.executable, __file__], env=env, capture_output=True, text=True, check=True).stdout.split())
    assert run < 0.85 * plain and gradients < 2.5 * plain


def test_the_same_as_gate_by_gate():
    net, x, lengths = _windows(5, lambda rng: np.full(5, language_id.T))
    assert np.allclose(net.run(x, lengths), _gate_by_gate(net, x), atol=1e-5)


@pytest.mark.parametrize("ordered", [True, False])
def test_windows_do_not_meet_each_other_or_earlier_calls(ordered):
    net, x, lengths = _windows(9, lambda rng: np.array([64, 64, 63, 40, 40, 7, 2, 1, 1]) if ordered else np.array([1, 64, 40, 2, 63, 7, 64, 1, 40]))
    y = np.arange(9) % 4
    net.gradients(x[:, ::-1].copy(), lengths, y)  # leaves its values in the scratch memory
    got, (_, grad) = net.run(x, lengths), net.gradients(x, lengths, y)
    total = {k: np.zeros(v.shape) for k, v in grad.items()}
    for k, n in enumerate(lengths):
        one = language_id.Network(4)
        one.p = net.p
        assert np.allclose(got[:n, :, k], one.run(x[:n, k : k + 1], lengths[k : k + 1])[:, :, 0], atol=1e-5)
        for name, g in one.gradients(x[:n, k : k + 1], lengths[k : k + 1], y[k : k + 1])[1].items():
            total[name] += g * n / lengths.sum()
    assert all(np.allclose(grad[name], g, atol=1e-6) for name, g in total.items())


def test_scratch_memory_stays_where_it_is():
    net, x, lengths = _windows(9, lambda rng: np.full(9, 64))
    size = len(pickle.dumps(net))
    net.gradients(x, lengths, np.arange(9) % 4)
    assert net.scratch and len(pickle.dumps(net)) == size and pickle.loads(pickle.dumps(net)).scratch == {}


def test_a_shut_gate_is_no_warning():
    net, x, lengths = _windows(3, lambda rng: np.full(3, 64))
    net.p = {k: v * 200 for k, v in net.p.items()}
    with np.errstate(all="raise", under="ignore"):
        assert np.isfinite(net.run(x, lengths)).all()


def test_no_floor_where_none_is_asked_for(spark, monkeypatch):
    rows = [(k, t + f" {k}", g) for k in range(40) for t, g in (("the cat and the hat", "en"), ("der Hund und die Katze", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, net = language_id.learn(docs)
    monkeypatch.setattr(language_id, "floor_of", lambda *_: pytest.fail("documents were read for a floor"))
    same, plain = language_id.learn(docs, floor=False)
    assert langs == same and net.floor > 0 == plain.floor and all((net.p[k] == plain.p[k]).all() for k in net.p)
    monkeypatch.setattr(language_id, "table", lambda *_: docs)
    out = language_id.op9_language_id(spark, "")  # as its rows show no floor, none is found
    assert out.where(F.col("score") > 0).count() == len(rows)


if __name__ == "__main__":
    print(*costs())
