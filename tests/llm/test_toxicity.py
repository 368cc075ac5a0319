import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest

from emberline.llm import toxicity as tx
from tests.llm.helpers import docs


def small_model(rng):
    vocab = {w: i + 1 for i, w in enumerate([b"aa", b"bb", b"cc", b"dd"])}
    k, d = tx.HIDDEN, tx.WORD_DIM + tx.CHAR_DIM
    p = {"words": rng.normal(size=(5, tx.WORD_DIM)), "chars": rng.normal(size=(tx.CHAR_ROWS, tx.CHAR_DIM)), "bo": rng.normal(size=1), "va": rng.normal(size=k), "wo": rng.normal(size=2 * k), "Wa": rng.normal(size=(2 * k, k)), "ba": rng.normal(size=k)}
    for way in "fb":
        p |= {"W" + way: rng.normal(size=(d, 3 * k)), "U" + way: rng.normal(size=(k, 3 * k)), "b" + way: rng.normal(size=3 * k)}
    return tx.Model(vocab, {n: (v * 0.5).astype(np.float32) for n, v in p.items()})


def plain_logit(model, words):
    """The network of one window, word by word."""
    p, k = {n: v.astype(np.float64) for n, v in model.p.items()}, tx.HIDDEN
    x = []
    for w in words:
        b = b"\x02" + w + b"\x03"
        rows = []
        for i in range(len(b) - 2):
            g = (b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B + b[i + 2] * 0xC2B2AE35) % 2**32
            rows.append((g ^ g >> 15) % tx.CHAR_ROWS)
        x.append(np.r_[p["words"][model.words.get(w, 0)], p["chars"][rows].mean(axis=0)])
    if not words:
        return p["bo"][0]
    sig = lambda v: 1 / (1 + np.exp(-v))
    ways = {}
    for way in "fb":
        h, out = np.zeros(k), []
        for v in x if way == "f" else x[::-1]:
            a, g = v @ p["W" + way] + p["b" + way], h @ p["U" + way]
            z, r = sig(a[:k] + g[:k]), sig(a[k : 2 * k] + g[k : 2 * k])
            n = np.tanh(a[2 * k :] + r * g[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        ways[way] = out if way == "f" else out[::-1]
    s = np.concatenate([np.array(ways["f"]), np.array(ways["b"])], axis=1)
    e = np.tanh(s @ p["Wa"] + p["ba"]) @ p["va"]
    a = np.exp(e - e.max())
    return float((a / a.sum()) @ s @ p["wo"] + p["bo"][0])


def test_scores_are_those_of_the_most_toxic_window():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    words = [b"aa", b"bb", b"cc", b"dd", b"zz", b"longer", "é".encode()]
    texts = [b" ".join(words[i] for i in rng.integers(0, len(words), n)).decode() for n in (0, 1, 5, 31, 32, 33, 48, 49, 64, 100, 333)]
    got = tx.Scorer(model).logits(texts)
    for text, g in zip(texts, got, strict=True):
        own = [w.lower().strip(tx._EDGES) or w for w in text.encode().split()]
        n = len(own)
        starts = [0] if n <= 32 else range(0, n - 16, 16)
        spans = [own[s : s + 32] for s in starts]
        assert n <= 32 or sum(map(len, spans)) >= n
        assert g == pytest.approx(max(plain_logit(model, s) for s in spans), abs=2e-4)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    at, lengths = rng.integers(0, 6, (4, tx.WINDOW)), np.array([32, 5, 17, 1])
    vectors = rng.normal(size=(6, tx.WORD_DIM + tx.CHAR_DIM)).astype(np.float32)
    target, scale = np.array([1, 0, 1, 0], np.float32), np.array([1, 2, 1, 1], np.float32)

    def loss(m, v):
        logit = tx.forward(m, at, lengths, m.project(v)).astype(np.float64)
        return (scale * (np.logaddexp(0, logit) - target * logit)).sum() / 4

    _, g = tx.gradients(model, at, lengths, [], vectors, model.project(vectors), target, scale)
    for name, grad in g.items():
        v = vectors if name == "vectors" else model.p[name]
        step = rng.normal(size=v.shape).astype(np.float32)
        keep, eps = v.copy(), 1e-2
        v += eps * step
        up = loss(model, vectors)
        v -= 2 * eps * step
        down = loss(model, vectors)
        v[:] = keep
        assert (up - down) / (2 * eps) == pytest.approx(float((grad * step).sum()), rel=0.05, abs=2e-3), name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(zip(*ds.dataset(f"{sf}/labels.parquet").to_table(columns=["doc_id", "toxic"]).to_pydict().values(), strict=True))
    rows = tx.op5_gru_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    hit = wrong = missed = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            hit += labels[r.doc_id] and r.predicted
            wrong += not labels[r.doc_id] and r.predicted
            missed += labels[r.doc_id] and not r.predicted
    # about one label in a hundred of this table is wrong either way
    assert hit / (hit + missed) > 0.85 and hit / (hit + wrong) > 0.9


def test_held_out_labels_are_never_learnt(spark):
    df = docs(spark, [(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    used = {r.doc_id for r in tx.training_rows(df, labels).collect()}
    assert used == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    assert tx.training_rows(df, labels, 7).count() == 14


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "a fine day " * 3 + ("you idiot " if i % 2 else "my friend ")) for i in range(40)]
    df = docs(spark, [*rows, (50, None), (50, ""), (None, "so so"), (51, "w " * 100_000)]).withColumnRenamed("lang", "score")
    out = tx.toxicity(df, labels).collect()
    assert len(out) == 44 and len({r.score for r in out if r.doc_id == 50}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    none = labels.limit(0)
    assert all(r.predicted == 0 for r in tx.toxicity(docs(spark, rows), none).collect())
    assert tx.toxicity(docs(spark, []), none).count() == 0
    kept = tx.without_toxic(df, labels)
    assert kept.columns == df.columns


def test_one_text_of_each_id_is_learnt_from(spark):
    df = docs(spark, [(1, f"text {i}") for i in range(500)] + [(2, "b"), (None, "c")])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [(r.doc_id, r.toxic, r.text) for r in tx.training_rows(df, labels).collect()] == [(1, 1, "text 0"), (2, 0, "b")]
