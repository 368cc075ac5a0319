"""Prefix trie of conversations, by naming ever longer blocks of turns."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, forget, table, text_or_empty
from .simhash import _met

#: Turns of a conversation that are summed in one group.
CHUNK = 1 << 12
#: Ids that are joined into one piece of text before hashing.
IDS = 1 << 12
#: Name of the textless root.
ROOT = -1


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, pos (from 0), digest (SHA-256 of role and text) and n_bytes of every turn; conv_id and n of every conversation.

    Turns are ordered by turn (null first), then role, then digest. A
    conversation may be dealt over several tasks: rows are sorted by ranges,
    and a row's place is that in its range and the rows of earlier ranges. Texts
    are hashed where they lie and go no further.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "digest", "n_bytes", F.monotonically_increasing_id().alias("at")), "sorted-turns")
    part = F.shiftright("at", 33)
    spans = placed.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "spans")
    sizes = spans.groupBy("conv_id").agg(F.sum("n").alias("n"))
    turns = placed.withColumn("part", part).join(spans.drop("n"), ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "digest", "n_bytes")
    return cut(turns, "turns"), cut(sizes, "conversation-sizes")


def named(rows: DataFrame, keys: list[str], base: int) -> tuple[DataFrame, int]:
    """rows with `name` in the place of keys: the numbers from base on, one for each distinct value; and the number after the last.

    Values are counted before the shuffle and numbered where they lie, by
    adding up how many each task has; very common ones meet their name by a
    broadcast.
    """
    distinct = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("at", F.monotonically_increasing_id()), "names")
    sizes = sorted(distinct.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect())
    starts = list(itertools.accumulate((r.k for r in sizes), initial=base))
    offset = F.broadcast(rows.sparkSession.createDataFrame([(r.part, s) for r, s in zip(sizes, starts, strict=False)], "part long, start long"))
    names = distinct.join(offset, F.shiftright("at", 33) == offset.part).select(*keys, "n", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("name"))
    out = cut(_met(rows, names, keys, sum(r.n for r in sizes)).drop(*keys), "named")
    forget(distinct)
    return out, starts[-1]


def prefixes(turns: DataFrame, base: int, longest: int) -> DataFrame:
    """conv_id, depth and node of every prefix of turns (conv_id, pos, name; names below base): equal sequences have one node, others don't.

    Blocks of 2 ** k turns at multiples of their length are named from the
    names of their halves, in one round for each k. A prefix falls into such
    blocks by the bits of its length: those of one block have its name, others
    get one for the pair of a shorter prefix and their last block, in one
    round for each bit more.
    """
    blocks = [turns.select("conv_id", F.col("pos").alias("i"), "name")]
    for _ in range(longest.bit_length() - 1):
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("j")).agg(half(0).alias("left"), half(1).alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
        block, base = named(pairs.withColumnRenamed("j", "i"), ["left", "right"], base)
        blocks.append(block)
    whole = [b.where("i = 0").select("conv_id", F.lit(1 << k).cast("long").alias("depth"), F.col("name").alias("node")) for k, b in enumerate(blocks)]
    found = [_union(whole)]
    last = _union([b.where("i > 0 AND i % 2 = 0").select("conv_id", F.shiftleft("i", k).alias("shorter"), F.shiftleft(F.col("i") + 1, k).alias("depth"), "name", F.bit_count("i").alias("bits")) for k, b in enumerate(blocks)])
    most = max((d.bit_count() for d in (longest, (1 << longest.bit_length() - 1) - 1)), default=0) if longest else 0
    for bits in range(1, most):
        before = found[-1].select("conv_id", F.col("depth").alias("shorter"), F.col("node").alias("before"))
        pairs = last.where(F.col("bits") == bits).join(before, ["conv_id", "shorter"]).select("conv_id", "depth", "before", "name")
        node, base = named(pairs.withColumnRenamed("name", "last"), ["before", "last"], base)
        found.append(node.select("conv_id", "depth", F.col("name").alias("node")))
    out = cut(_union(found), "prefixes")
    forget(*blocks[1:], *found[1:])
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _below(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (conv_id, depth) with each column summed over its conversation from this depth on; CHUNK depths in a group at most."""
    part = F.shiftright("depth", CHUNK.bit_length() - 1)
    within = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    later = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.withColumn("part", part)
    sums = dealt.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in columns])
    after = sums.select("conv_id", "part", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"after_{c}") for c in columns])
    own = dealt.withColumns({c: F.sum(c).over(within) for c in columns})
    return own.join(after, ["conv_id", "part"]).withColumns({c: F.col(c) + F.col(f"after_{c}") for c in columns}).drop("part", *[f"after_{c}" for c in columns])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """node and ends_sha256 for ends (node, conv_id): SHA-256 of the decimal ids in ascending order, joined by commas.

    Ids are sorted by ranges, so that any node's may lie in many tasks, and joined
    into pieces there. The hash itself reads a node's pieces one after the other,
    which its definition asks for, in one task that holds one piece.
    """
    by = ["node", "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IDS):
                part = batch.slice(at, IDS).to_pydict()
                nodes, firsts, texts = [], [], []
                for node, group in itertools.groupby(zip(part["node"], part["conv_id"], strict=True), key=lambda x: x[0]):
                    ids = [i for _, i in group]
                    nodes.append(node)
                    firsts.append(ids[0])
                    texts.append(",".join(map(str, ids)))
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], names=["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != node:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.record_batch([pa.array([node], pa.int64()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    joined = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(pieces, "node long, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digests, "node long, ends_sha256 string")


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of turns (conv_id, pos from 0, digest, n_bytes) of the conversations sizes (conv_id, n: 0 for those without turns).

    node, conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 as op12's contract has
    them. A subtree's sums are taken over its nodes' smallest members: a node's
    share stands at one conversation's depth, is summed along that conversation
    from the leaf up, and then over all members of each node.
    """
    longest = sizes.agg(F.max("n")).first()[0] or 0
    words, base = named(turns, ["digest"], 0)
    path = prefixes(words, base, longest)
    last = words.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes")
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("node"), F.lit(0).cast("long").alias("n_bytes"))
    path = cut(path.join(last, ["conv_id", "depth"]).select(root.columns).union(root), "paths")

    nodes = path.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    up = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = cut(nodes.join(up, ["conv_id", "depth"], "left"), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    tops = cut(nodes.join(kids.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tops")

    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    own = tops.select("conv_id", "depth", saved.alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    sums = ["saved_tokens", "n_leaves"]
    shares = path.select("conv_id", "depth", "node").join(own, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})
    totals = _below(shares, sums).groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])

    ends = path.join(sizes.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).select("node", "conv_id")
    parents = tops.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = tops.where("parent IS NOT NULL")
    total = path.count()
    out = _met(below, parents, "parent", total).unionByName(tops.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = out.join(totals, "node").join(hashed_ends(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and sizes of op12's rebuilt conversations: h turns of conversation conv_id - conv_id % 5, then the own ones after the first h; h is the CRC-32 of the id modulo 9."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    bases = sizes.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("have"))
    plan = sizes.withColumn("base", base).withColumn("h", h).join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("have", F.lit(0))))
    plan = cut(plan.select("conv_id", "n", "base", "h", "head"), "rebuilding")
    shift = F.col("pos") - F.col("h") + F.col("head")
    total = turns.count()
    tails = _met(turns, plan.select("conv_id", "n", "h", "head"), "conv_id", total).where("pos >= h").select("conv_id", shift.alias("pos"), "digest", "n_bytes")
    first = turns.where("pos < 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    heads = plan.join(first, "base").where("pos < head").select("conv_id", "pos", "digest", "n_bytes")
    size = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return cut(heads.union(tails), "rebuilt"), plan.select("conv_id", size.alias("n"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text) as they are; columns as in trie().

    Rows without a conv_id belong to no conversation and are left out. Null role
    and text are empty. Turns are ordered by turn, null first; ties by role, then
    by the SHA-256 of role and text, by which turns are told apart as well.
    Repeated rows are turns of their own. Texts of any length are hashed where
    they lie, and a conversation may have any number of turns. An empty table
    has no node; other columns are ignored.
    """
    return trie(*ordered_turns(conversations))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = rebuilt(*ordered_turns(table(spark, sf_dir, "conversations")))
    return trie(turns, sizes).drop("node")


#: CRC-32 of the decimal conv_id, bit by bit, modulo 9.
_H = """xor(4294967295, list_reduce(
    [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 9"""
ORACLE = """
WITH numbered AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
sized AS (SELECT c, count(*) AS n, c - c % 5 AS base, @h AS h FROM numbered GROUP BY c),
turns AS (SELECT s.c, p, role, text FROM sized s JOIN numbered t ON t.c = s.base WHERE p < h
    UNION ALL SELECT c, 10 + p, role, text FROM sized s JOIN numbered t USING (c) WHERE p >= h),
placed AS (SELECT c, sha256(concat(length(role), ':', role, text)) AS k, strlen(text) AS b, row_number() OVER (PARTITION BY c ORDER BY p) AS d FROM turns),
paths AS (SELECT c, d, b, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS k FROM placed UNION ALL SELECT c, 0, 0, '' FROM sized),
lengths AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (SELECT k, string_agg(c, ',' ORDER BY c) AS ids FROM paths JOIN lengths USING (c, d) GROUP BY k),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, any_value(b) AS b, CASE WHEN d > 0 THEN left(k, CAST(64 * (d - 1) AS BIGINT)) END AS up FROM paths GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
above AS (SELECT left(v.k, CAST(64 * a.d AS BIGINT)) AS k, (v.n - 1) * v.b AS saved, CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes v LEFT JOIN kids USING (k) JOIN (SELECT DISTINCT d FROM nodes) a ON a.d <= v.d),
totals AS (SELECT k, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children,
    CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes v JOIN totals USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes u ON u.k = v.up
""".replace("@h", _H.replace("conv_id", "c"))
