import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from emberline.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in out.items()}


def spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    rows = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        rows.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    t = ds.dataset(f"{sf}/conversations.parquet").to_table(columns=["conv_id", "turn", "role", "text"]).to_pydict()
    assert got(pt.op12_prefix_trie(spark, sf)) == plain(spliced(conversations(zip(*t.values(), strict=True))))


def test_sql_agrees(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    r = con.sql(pt.ORACLE)
    df = pt.op12_prefix_trie(spark, sf)
    assert r.columns == df.columns
    assert sorted((tuple(x) for x in r.fetchall()), key=str) == got(df)


@pytest.mark.parametrize("seed", range(2))
def test_long_shared_prefixes(spark, seed, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 4)
    monkeypatch.setattr(pt, "IDS", 2)
    rng = random.Random(seed)
    stem = [(rng.choice("us"), rng.choice(["a", "b", "é" * 3])) for _ in range(70)]
    convs = {}
    for c in rng.sample(range(-40, 60), 50):
        n = rng.choice([0, 1, 2, 7, 8, 15, 33, 64, 70])
        own = stem[:n] + [("u", rng.choice("xyz")) for _ in range(rng.randrange(4))]
        convs[c] = own or [("", "")]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(pt.conversation_trie(df)) == plain(convs)


def test_common_names_meet_by_broadcast(spark, monkeypatch):
    from emberline.llm import simhash

    monkeypatch.setattr(simhash, "HUB", 5)
    monkeypatch.setattr(simhash, "HUBS", 8)
    convs = {c: [("u", "same")] * 6 + [("a", str(c % 3))] for c in range(40)}
    df = spark.createDataFrame([(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)], SCHEMA)
    assert got(pt.conversation_trie(df)) == plain(convs)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 3, "u", "x"), (1, 3, "u", "x"), (2, None, "", ""), (None, 1, "u", "lost"), (7, 1, "u", "y" * 200_000), (7, 0, "a", None), (-3, 1, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1)).withColumn("node", F.lit("n")).withColumn("depth", F.lit(9))
    assert got(pt.conversation_trie(df)) == plain(conversations(rows))
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_of_one_conversation_over_many_tasks(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("conv_id"), (F.col("id") * 7919 % 3001).cast("int").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, sizes = pt.ordered_turns(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes.collect() == [(5, 3000)]
    want = [t for _, t in sorted((i * 7919 % 3001, str(i)) for i in range(3000))]
    digests = [hashlib.sha256(f"1:u{t}".encode()).digest() for t in want]
    assert [bytes(r.digest) for r in turns.orderBy("pos").collect()] == digests
