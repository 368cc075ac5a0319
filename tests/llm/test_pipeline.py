from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as cp
from emberline.llm import mixing, packing, pii, simhash, toxicity, word_bpe
from tests.llm.helpers import docs
from tests.llm.test_mixing import plain_targets
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_simhash import plain_components, plain_fingerprint


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_one_by_one(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near-dedup", "personal-data", "mixing", "packing"]
    out = {}
    now = given
    for name, stage in cp.STAGES:
        now = stage(spark, now, sf).cache()
        out[name] = now
        if name != "packing":
            assert now.columns == given.columns
    # each decision takes effect on what the stage before kept
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(given, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert Counter(rows_of(out["toxicity"])) == Counter(r for r in rows_of(given) if not scored[r[0]])
    clean = rows_of(out["toxicity"])
    groups = plain_components({r[0]: plain_fingerprint(r[1]) for r in clean})
    assert Counter(rows_of(out["near-dedup"])) == Counter(r for r in clean if groups[r[0]] == r[0])
    single = {r[0]: r for r in rows_of(out["near-dedup"])}
    masked = {r[0]: r for r in rows_of(out["personal-data"])}
    assert set(masked) == set(single)
    for d, r in masked.items():
        text, at = "", 0
        for a, k, b in plain_spans(single[d][1] or ""):
            if a >= at:
                text += single[d][1][at:a] + f"<{pii.KINDS[k]}>"
                at = b
        assert r[1] == text + single[d][1][at:] and r[4] == len(r[1]) and r[2:4] == single[d][2:4]
    mixed = rows_of(out["mixing"])
    count = Counter(r[0] for r in mixed)
    assert max(count.values()) <= 3 and all(masked[r[0]] == r for r in mixed)
    copies = {r.doc_id: r.copies for r in mixing.mix(out["personal-data"]).collect()}
    assert {d: n for d, n in copies.items() if n} == dict(count)
    size = {d: len((r[1] or "").encode().split()) for d, r in masked.items()}
    sources = {}
    for d, r in masked.items():
        sources[r[3]] = sources.get(r[3], 0) + size[d]
    for s, t in plain_targets(sources).items():
        own = [d for d in masked if masked[d][3] == s]
        assert abs(sum(count[d] * size[d] for d in own) - t) <= max(size[d] for d in own)
    pieces = out["packing"].collect()
    bpe = word_bpe.loaded(word_bpe.default_path())
    tokens = Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert tokens == {d: n * (len(bpe.encode(masked[d][1])) + 1) for d, n in count.items()}
    assert max(Counter({s: sum(r.length for r in pieces if r.sequence_id == s) for s in {r.sequence_id for r in pieces}}).values()) <= packing.SEQUENCE


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == [x.split()[0] for x in packing.SCHEMA.split(", ")]


def test_odd_rows(spark):
    labels = "doc_id long, quality int, toxic int"
    df = docs(spark, [(1, None), (1, None), (2, ""), (None, "a b c d", None), (None, "x y z w", None), (5, "e f g a@b.c " * 20), (5, "e f g a@b.c " * 20), (6, "long " * 50_000, "t")])
    kept = simhash.one_of_each(df)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 5, 6]
    none = spark.createDataFrame([], labels)
    assert toxicity.without_toxic(df, none).count() == df.count()
    again = mixing.mixed(pii.masked(kept))
    assert again.columns == df.columns
    for f in (simhash.one_of_each, pii.masked, mixing.mixed, packing.pack):
        assert f(df.limit(0)).count() == 0


CLASHING = ["a.b", "__key", "__full", "__id", "__alt", "__row", "__score", "__toxic", "__spans", "row", "key", "full", "id", "score", "spans", "new", "size", "rate", "copies", "nth", "same", "c0", "a`b"]


def test_no_column_of_the_table_is_lost_or_overwritten(spark):
    rows = [(i, f"word{i} " * 30 + "x@y.org") for i in range(6)] + [(7, None), (8, "plain " * 5)]
    df = docs(spark, rows)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"own {c}"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    own = lambda d: sorted(tuple(r[len(docs(spark, []).columns):]) for r in d.collect())
    want = [tuple(f"own {c}" for c in CLASHING)]
    for f in (lambda d: toxicity.without_toxic(d, none), simhash.one_of_each, pii.masked, mixing.mixed):
        out = f(df)
        assert out.columns == df.columns
        assert set(own(out)) == set(want)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]
    assert {r.doc_id: r.text for r in pii.masked(df).collect()}[3] == "word3 " * 30 + "<email>"


def test_rows_with_swapped_nulls_are_told_apart(spark):
    schema = docs(spark, []).schema
    two = [(1, "a b c d", "en", None, None), (1, "a b c d", None, "en", None)]
    kept = [simhash.one_of_each(spark.createDataFrame(rows, schema)).collect() for rows in (two, two[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1
    assert mixing.mixed(spark.createDataFrame(two, schema)).columns == schema.names
