import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberline.llm import simhash
from tests.llm.helpers import corpus, docs


def plain_fingerprint(text):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(prints):
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in ids}


def test_against_brute_force(spark, sf):
    prints = {d: plain_fingerprint(t) for d, t in corpus(sf).items()}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash_near_dedup(spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


@pytest.mark.parametrize("wide", [simhash.WIDE, 20])
def test_clusters_chains_and_bits(spark, wide):
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            values.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    values |= {base ^ a << 5 for a in range(64)} | {0, (1 << 64) - 1}
    want = plain_components({i: v for i, v in enumerate(sorted(values))})
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    linked = simhash.components(simhash.near_edges(fps, wide=wide))
    rows = {r.node: r.root for r in linked.collect()}
    classes = {}
    for i, v in enumerate(signed):
        classes.setdefault(rows.get(v, v), set()).add(i)
    expected = {}
    for i, r in want.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_parts_of_large_groups_are_bounded():
    for m in simhash._masks(3):
        assert {64 - x.bit_count() for x in simhash._masks(3, m)} <= {15, 16, 17, 18}
        assert all(x & m == m for x in simhash._masks(3, m))


def test_index_prunes_but_loses_nothing():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 14, 700, dtype=np.uint64) << np.uint64(20))
    runs = rng.integers(0, 3, len(values))
    index = simhash.GrayIndex(runs, values)
    label = simhash.rooted(len(values), list(index.links(3)))
    run = runs[index.order]
    prints = [(int(r), int(v)) for r, v in zip(run, index.leaves, strict=True)]
    for r in range(3):
        own = [i for i, p in enumerate(prints) if p[0] == r]
        want = plain_components({i: prints[i][1] for i in own})
        assert {i: label[i] for i in own} == want


def test_common_keys_meet_their_partners(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB", 3)
    monkeypatch.setattr(simhash, "HUBS", 5)
    rng = random.Random(4)
    values = sorted({0} | {1 << i for i in range(64)} | {rng.getrandbits(63) for _ in range(50)})
    want = plain_components(dict(enumerate(values)))
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    rows = {r.node: r.root for r in simhash.components(simhash.near_edges(fps)).collect()}
    assert len(set(rows.values())) == 1 and len(rows) == sum(r == want[0] for r in want.values())
    df = docs(spark, [(i, "one text in all rows") for i in range(200)] + [(200 + i, f"another {i} of {i * 7} words") for i in range(50)])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 250 and {got[i] for i in range(200)} == {0}


def test_a_full_part_takes_bounded_memory():
    """All values of 14 bits, a part of finer masks in small: millions of links, of which none is kept."""
    import tracemalloc

    values = np.arange(1 << 14, dtype=np.uint64)
    index = simhash.GrayIndex(np.zeros(len(values), dtype=np.int64), values)
    tracemalloc.start()
    label = simhash.rooted(len(values), index.links(3))
    assert not label.any() and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_one_row_of_each_group(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "x y z"), (None, "x y z"), (5, None), (4, "")]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1, F.expr("string(rand())")))
    df = spark.createDataFrame(df.collect(), df.schema).withColumn("__key", F.lit(1)).withColumn("n", F.create_map(F.lit("a"), F.lit(1))).drop("__key")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x y z"), (1, "a b c d"), (4, "")]
    assert sorted(r.lang or "" for r in got) == sorted(r.lang or "" for r in simhash.one_of_each(df.repartition(3)).collect())


def test_odd_rows(spark):
    df = docs(spark, [(5, None), (2, ""), (2, ""), (7, " \t"), (None, "one two"), (9, "ONE two"), (8, "x " * 20000)]).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    rows = {(r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert rows == {(5, True, 2), (2, True, 2), (7, True, 2), (None, False, 9), (9, False, 9), (8, False, 8)}
    assert simhash.near_duplicates(df).count() == 7
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(df.where(F.col("doc_id") == 8)).collect()[0].component_id == 8
