import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from emberline.llm import periodic_runs as pr
from tests.llm.helpers import corpus, docs


def plain_runs(words, least=24, times=3):
    """Every stretch at every lag, word by word; a smaller period of the same stretch wins."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                smallest = next(p for p in range(1, q + 1) if all(words[t] == words[t + p] for t in range(i, i + length - p)))
                if smallest == q:
                    out[i, length] = q
            i = j + 1 if j > i else i + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, w = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *top, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_whole_table_against_brute_force(spark, sf):
    texts = corpus(sf)
    rows = {r[0]: tuple(r[1:]) for r in pr.op11_periodic_runs(spark, sf).collect()}
    assert rows.keys() == texts.keys()
    small = {d for d, t in texts.items() if len((t or "").split()) <= 1500}
    assert len(small) > len(texts) * 0.8
    assert {d: rows[d] for d in small} == {d: plain(d, texts[d]) for d in small}
    assert sum(r[0] > 0 for r in rows.values()) > 5


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_random_words(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        ids = rng.integers(0, letters, rng.integers(0, 200))
        for _ in range(rng.integers(0, 3)):
            if len(ids) > 30:
                a, p = rng.integers(0, len(ids) - 25), rng.integers(1, 12)
                b = rng.integers(a + 20, len(ids) + 1)
                ids[a:b] = np.resize(ids[a : a + p], b - a)
        assert pr.runs_of(ids) == plain_runs(ids.tolist())
        assert pr.runs_of(ids, 4, 2) == plain_runs(ids.tolist(), 4, 2)


@pytest.mark.parametrize("n,letters", [(3000, 3), (5000, 40), (2000, 900)])
def test_counts_are_exact_for_frequent_and_rare_words(n, letters, monkeypatch):
    ids = np.minimum(np.random.default_rng(0).zipf(1.3, n), letters)
    plain = [n] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 3 + 1)]
    assert pr.lag_counts(ids, n // 3).tolist() == plain
    monkeypatch.setattr(pr, "HELD", 100)
    assert pr.lag_counts(ids, n // 3).tolist() == plain


def test_nested_and_adjoining_runs():
    words = (["a", "b"] * 20 + ["c"]) * 4 + ["d"] * 30
    ids = np.unique(words, return_inverse=True)[1]
    runs = pr.runs_of(ids)
    assert runs == plain_runs(words)
    assert (0, 164, 41) in runs and (0, 40, 2) in runs and (164, 30, 1) in runs
    assert pr.kept_words(len(ids), [(0, 164, 41), (0, 40, 2)]).sum() == 33  # a b, c and the d


def test_long_text_of_one_word_and_of_two():
    assert pr.runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    ids = np.random.default_rng(1).integers(0, 2, 20_000)
    ids[5000:9000] = np.resize(ids[5000:5700], 4000)
    assert any(q == 700 and length >= 4000 for _, length, q in pr.runs_of(ids))


def test_odd_rows(spark):
    df = docs(spark, [(None, None), (1, ""), (1, ""), (2, "x " * 40), (None, "a b " * 30)]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "a.b")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(df).collect())
    assert got == [(0, 0, [], ""), (0, 60, [(0, 60, 2)], "a b"), (1, 0, [], ""), (1, 0, [], ""), (2, 40, [(0, 40, 1)], "x")]
    assert pr.periodic_runs(docs(spark, [])).count() == 0
