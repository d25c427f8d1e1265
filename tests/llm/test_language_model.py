"""The recurrent model against a plain step-by-step twin and numeric gradients."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsmill.llm import language, language_model as lm


def small(seed: int = 0, n: int = 23) -> lm.Model:
    rng = np.random.default_rng(seed)
    m = lm.Model(rng.integers(1, 50, n) + 0.1, hidden=5, share=1.0)
    m.vector += rng.normal(0, 0.3, len(m.vector)).astype(np.float32)
    return m


def plain(m: lm.Model, text) -> list[float]:
    """Log-probability of each symbol of a text, one number at a time."""
    p = {k: v.astype(float) for k, v in m.parts().items()}
    size = m.hidden
    sig = lambda v: 1 / (1 + math.exp(-v))
    h, x, out = [0.0] * size, lm.END, []
    for y in text:
        a, u = p["Wx"][x], p["U"]
        dot = lambda j: sum(h[i] * u[i, j] for i in range(size))  # noqa: E731, B023
        new = []
        for i in range(size):
            z = sig(a[i] + dot(i) + p["b"][i])
            r = sig(a[size + i] + dot(size + i) + p["b"][size + i])
            n = math.tanh(a[2 * size + i] + p["b"][2 * size + i] + r * dot(2 * size + i))
            new.append(n + z * (h[i] - n))
        h = new
        logit = lambda w: sum(h[i] * w[i] for i in range(size)) + w[size]  # noqa: E731, B023
        c = [logit(w) for w in p["Wc"]]
        own = [w for w in range(m.n) if m.cls[w] == m.cls[y]]
        inside = {w: logit(p["Ww"][m.place[w]]) for w in own}
        out.append(c[m.cls[y]] - math.log(sum(map(math.exp, c))) + inside[y] - math.log(sum(map(math.exp, inside.values()))))
        x = y
    return out


def some_texts(m: lm.Model, sizes) -> list[np.ndarray]:
    rng = np.random.default_rng(5)
    return [np.append(rng.integers(1, m.n, k), lm.END).astype(np.int32) for k in sizes]


@pytest.mark.parametrize("window, n", [(1, 1), (3, 2), (50, 4)])
def test_scores_equal_a_plain_twin(window, n):
    m = small()
    texts = some_texts(m, [0, 1, 7, 20, 3, 0, 12])
    want = [sum(plain(m, t)) for t in texts]
    assert np.allclose(lm.score_texts(m, texts, window=window, n=n), want, atol=1e-4)


def test_symbols_are_a_distribution():
    m = small(1)
    for h in np.random.default_rng(2).normal(0, 1, (3, m.hidden)).astype(np.float32):
        value = lm.targets(m, m.parts(), np.repeat(h[None], m.n, axis=0), np.arange(m.n))
        assert abs(np.exp(value).sum() - 1) < 1e-5


def test_gradients_are_the_slopes():
    m = small(3)
    texts = some_texts(m, [4, 9, 2, 6])
    y, x, fresh, _ = next(lm.windows(texts, 3, 40))
    h = np.zeros((3, m.hidden), np.float32)
    grad = {k: np.zeros_like(v) for k, v in m.parts().items()}
    _, rows, g = lm.gradients(m, m.parts(), x, y, fresh, h, grad)
    grad["Wx"][rows] = g
    wide = lambda: -sum(sum(plain(m, t)) for t in texts)
    rng = np.random.default_rng(4)
    for name, part in m.parts().items():
        flat, own = part.reshape(-1), grad[name].reshape(-1)
        for i in rng.choice(len(flat), 6, replace=False):
            was = flat[i]
            flat[i] = was + 1e-2
            up = wide()
            flat[i] = was - 1e-2
            slope = (up - wide()) / 2e-2
            flat[i] = was
            assert own[i] == pytest.approx(slope, abs=2e-2), (name, i)


def test_windows_hold_each_symbol_once():
    texts = some_texts(small(), [5, 0, 17, 3, 3])
    found = [[] for _ in texts]
    for y, x, fresh, own in lm.windows(texts, 2, 4):
        for t in range(y.shape[0]):
            for k in range(y.shape[1]):
                if y[t, k] >= 0:
                    have = found[own[t, k]]
                    assert fresh[t, k] == (not have) and x[t, k] == (have[-1] if have else lm.END)
                    have.append(y[t, k])
    assert [f == t.tolist() for f, t in zip(found, texts)] == [True] * len(texts)


def test_training_learns():
    m = lm.Model(np.ones(9), hidden=8)
    texts = [np.array([1, 2, 3, 4, 5, 6, 7, 8] * 6 + [lm.END], np.int32)] * 4
    before = lm.score_texts(m, texts).sum()
    seen = np.full_like(m.vector, lm.START)
    for _ in range(30):
        lm.train(m, texts, seen)
    assert lm.score_texts(m, texts).sum() > 0.5 * before


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("rid"), F.lit("x").alias("h"))
    training = docs.where(language.remainder(10) != 0)
    seen = []

    def record(share, model):
        seen.extend(r.doc_id for r in share.collect())
        return model.vector

    monkeypatch.setattr(lm, "average_round", record)
    lm.score_documents(docs).count()
    assert sorted(seen) == sorted(r.doc_id for r in training.collect())


def test_symbols_grow_with_the_vocabulary():
    assert lm.groups_for(100 * 5000) >= 9 * lm.groups_for(5000) > 500
    weight = 1.0 / np.arange(1, 4001)
    cls = lm.classes_for(weight)
    assert (np.diff(cls) >= 0).all() and (np.diff(cls) <= 1).all() and 10 < cls[-1] < 200


def test_most_frequent_are_whole_and_bounded(spark):
    counts = spark.createDataFrame([(i, 1000 // (i + 1) + 1) for i in range(300)], "h bigint, c bigint")
    for most in (0, 1, 7, 50, 299, 300, 1000):
        h, c = lm.most_frequent(counts, most)
        assert len(h) <= most and (np.diff(c) <= 0).all()
        rest = [r.c for r in counts.collect() if r.h not in set(h.view(np.int64).tolist())]
        assert not len(h) or not rest or min(c) > max(rest)
    assert len(lm.most_frequent(counts, 300)[0]) == 300


@pytest.mark.parametrize("frequent", [0, 9, 1000])
def test_untrained_scores_equal_unigram_counts(spark, monkeypatch, frequent):
    def biases(share, model):
        for k, v in model.parts().items():
            if k in ("Wc", "Ww"):
                v[:, :-1] = 0
            else:
                v[:] = 0
        return model.vector

    monkeypatch.setattr(lm, "average_round", biases)
    monkeypatch.setattr(lm, "WORDS", 4)
    most = lm.most_frequent
    monkeypatch.setattr(lm, "most_frequent", lambda counts: most(counts, frequent))
    texts = [" ".join(f"w{(i * k) % 37}" for k in range(1, 30)) for i in range(40)] + ["w1 never seen", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: [*(t or "").split(), "end"]
    n = Counter(w for i, t in enumerate(texts) if not held(i) for w in words(t))
    total = n.total() + 0.1 * (len(n) + 1)
    for r in lm.score_documents(docs).collect():
        own = words(texts[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((n[w] + 0.1) / total) for w in own))
        if r.n_known == r.n_tokens and frequent:  # without recurrent weights only smoothing parts the two
            assert r.score == pytest.approx(sum(math.log10(n[w] / n.total()) for w in own), abs=0.05 * r.n_tokens)
