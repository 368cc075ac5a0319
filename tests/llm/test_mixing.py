import math
import random
import re

import pyarrow.dataset as ds
import pytest

from emberline.llm import mixing
from tests.llm.helpers import docs


def plain_targets(sizes):
    """Sizes by source: the excess over three times a source's size is shared again and again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while True:
        among = sum(weight[s] for s in order if s not in full)
        if not among:
            return target
        share = {s: left * weight[s] / among for s in order if s not in full}
        over = [s for s, t in share.items() if t >= 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


def checked(rows, most_off):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] for r in own)
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= most_off(own), s
        for r in own:
            assert r.copies in (0, 1, 2, 3) and r.taken == r.copies * r.size


def test_whole_table(spark, sf):
    t = ds.dataset(f"{sf}/documents.parquet").to_table().to_pydict()
    want = {d: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for d, x in zip(t["doc_id"], t["text"], strict=True)}
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id: r.size for r in rows} == want and len(rows) == len(want)
    checked(rows, lambda own: max(r.size for r in own))
    again = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").repartition(7)).collect()
    assert sorted(rows) == sorted(again)


def test_rates_are_tilted_by_size(spark):
    rng = random.Random(8)
    df = docs(spark, [(i, "w " * rng.randrange(1, 400), "abc"[i % 3] if i % 10 else "d") for i in range(900)])
    rows = mixing.mix(df).collect()
    checked(rows, lambda own: max(r.size for r in own))
    for s in {r.source for r in rows}:
        # log rate is in proportion to size, up to the bound of 3
        slope = [math.log(r.rate) / r.size for r in rows if r.source == s and 0.01 < r.rate < 2.99]
        assert not slope or max(slope) - min(slope) < 1e-2 * max(abs(x) for x in slope) + 1e-4
        expected = sum(r.rate * r.size for r in rows if r.source == s)
        target = next(r.target for r in rows if r.source == s)
        assert math.isclose(expected, target, rel_tol=1e-4)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {"a": 1000, "b": 1, "c": 1}, {"a": 5}, {"b": 0, "a": 40, None: 60}, {"a": 0}, {"": 3, "x": 3, "y": 900, "z": 2, None: 50}])
def test_targets(spark, sizes):
    df = docs(spark, [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())])
    rows = mixing.mix(df).collect()
    checked(rows, lambda own: max(r.size for r in own))


def test_odd_rows(spark):
    df = docs(spark, [(None, None, None), (1, "", "a"), (2, "a b c", None), (2, "a b c", None), (None, "x " * 50_000, "b")]).withColumnsRenamed({"lang": "size", "n_chars": "target"})
    rows = mixing.mix(df).collect()
    assert len(rows) == 5
    assert mixing.mix(docs(spark, [])).count() == 0


def test_null_and_repeated_ids_meet_targets(spark):
    rng = random.Random(9)
    rows = [(None, f"w{i} " + "w " * rng.randrange(5, 15), "a") for i in range(1000)]  # no ids
    rows += [(7, "one and the same text again", "b")] * 1500  # equal rows
    rows += [(i % 5, f"x{i} " + "w " * rng.randrange(1, 30), "c") for i in range(900)]  # few ids
    rows += [(i, "w " * rng.randrange(1, 200), "d") for i in range(400)]
    rng.shuffle(rows)
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    checked(got, lambda own: max(r.size for r in own))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source, r.size, r.copies, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    # the pipeline's form takes the same rows
    taken = {s: 0 for s in "abcd"}
    for r in mixing.mixed(df.repartition(3)).collect():
        taken[r.source] += len(r.text.split())
    want = {s: sum(r.taken for r in got if r.source == s) for s in "abcd"}
    assert taken == want


def test_unsolved_duals_are_not_used(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    monkeypatch.setattr(mixing, "STEPS", 1)
    df = docs(spark, [(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(200)])
    with pytest.raises(RuntimeError, match="no rates meet"):
        mixing.mix(df)
