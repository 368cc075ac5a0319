import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from emberline.llm import quality
from tests.llm.helpers import corpus, docs


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    total = sum(map(len, words))

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        return {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    dup_chars = sum(len(w) for x in dup for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    rep = len(covered(3))
    failed = len(words) < 50 or 100 * rep > 50 * len(words)
    chars = [sum(len(words[j]) for j in covered(n)) for n in quality.NGRAM_LIMITS]
    kept = not failed and dup_chars <= 0.2 * total and all(c <= s * total for c, s in zip(chars, quality.NGRAM_LIMITS.values()))
    return (len(words), total, sum(c in "#*$%&|<>" for c in text), len(dup), rep, failed, kept, dup_chars, *chars)


def test_whole_table_against_brute_force(spark, sf):
    rows = quality.op4_repetition_rules(spark, sf).collect()
    got = {r[0]: tuple(r[1:]) for r in rows}
    assert got == {d: plain(t) for d, t in corpus(sf).items()}


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = con.sql(quality.ORACLE)
    df = quality.op4_repetition_rules(spark, sf)
    assert r.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(r.fetchall())


def test_collisions_do_not_count(monkeypatch):
    monkeypatch.setattr(quality, "_powers", lambda n: np.zeros(n + 1, dtype=np.uint64))  # all hashes equal
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 9])
    assert quality.in_repeats(ids, 3).tolist() == [True] * 3 + [False] + [True] * 3 + [False]


@pytest.mark.parametrize("text", ["a b c " * 60, "x\ny\nx \nx\n\n \n" + " ".join(map(str, range(80))), "é ü " * 30, "\x1c\x85\xa0 a", "w" * 200000])
def test_odd_texts(text):
    assert tuple(quality.measure(text, quality.NGRAM_LIMITS, quality.LINE_LIMIT)) == plain(text)


def test_odd_rows(spark):
    df = docs(spark, [(None, None), (1, ""), (1, ""), (2, "a " * 60)]).withColumnRenamed("lang", "kept")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.repetition(df).collect())
    assert got == [(0, 0, True, False), (1, 0, True, False), (1, 0, True, False), (2, 60, True, False)]
    assert quality.repetition(docs(spark, [])).count() == 0
