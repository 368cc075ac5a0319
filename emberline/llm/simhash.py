"""SimHash fingerprints and exact linking within a Hamming radius."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, named, pieces_of, table, text_or_empty, whole_row

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Groups of more distinct fingerprints than this are dealt out again by half of the bits that they vary in.
WIDE = 1 << 16
#: Children of a node of the hierarchical index.
FAN = 4
#: Node pairs that are looked at in one step; bounds memory.
CHUNK = 1 << 18
#: A key with more rows than this, and than one in HUBS of all, meets its one partner by a broadcast of those partners, HUBS at most.
HUB, HUBS = 1 << 16, 1 << 12

U = np.uint64


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=U)
    else:
        ends = list(itertools.accumulate((len(w) + 1 for w in words)))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype=U)
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (equal for equal doc_id and text), full (equal for equal rows) and fp (the fingerprint's 64 bits as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in pieces_of(whole)):
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(3)], dtype=U).view(np.int64)
            yield pa.record_batch([*batch.columns[:3], pa.array(fps)], names=["doc_id", "key", "full", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_keys(docs), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, full long, fp long")


def _keys(docs: DataFrame):
    """Hashes of doc_id and text, and of all columns that can be hashed, with which of them are null."""
    hashed = [named(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    all_of = [x for c in hashed for x in (c.isNull(), c)]
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("key"), F.xxhash64(F.lit(3), *all_of).alias("full")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Places of 64-bit words in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class GrayIndex:
    """Gray-ordered hierarchical index over fingerprints that are grouped in runs.

    Fingerprints of a run are sorted by Gray rank, so that neighbours share
    most bits. Each upper node keeps the pattern its members share: the bits
    that are one in all (`low`) and those that are one in any (`high`); where
    the two agree, the bit is part of the shared pattern.
    """

    def __init__(self, runs: np.ndarray, values: np.ndarray):
        """runs: equal numbers mark a run; each run's values are distinct."""
        order = np.lexsort((gray_rank(values), runs))
        self.order, run, self.leaves = order, runs[order], values[order]
        self.levels = [{"low": self.leaves, "high": self.leaves, "run": run, "first": np.arange(len(run)), "kids": None}]
        while True:
            below = self.levels[-1]
            run = below["run"]
            new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            if len(new) == len(run):
                break
            place = np.arange(len(run)) - np.repeat(new, np.diff(np.r_[new, len(run)]))
            bounds = np.flatnonzero(place % FAN == 0)
            self.levels.append({
                "low": np.bitwise_and.reduceat(below["low"], bounds),
                "high": np.bitwise_or.reduceat(below["high"], bounds),
                "run": run[bounds],
                "first": below["first"][bounds],
                "kids": (bounds, np.diff(np.r_[bounds, len(run)])),
            })

    def _size(self, level: int) -> np.ndarray:
        return np.diff(np.r_[self.levels[level]["first"], len(self.leaves)])

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that differ in at most `radius` bits and whose closure links all such pairs of a run.

        Pairs of nodes are followed from the roots down. The differences within
        the shared patterns of both only grow on the way; past `radius`, both
        groups are left out together. Where all bits that vary within two nodes
        are at most `radius`, everything in them is linked without going down.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top]["low"]))
        stack = [(top, roots, roots)]
        steps = np.arange(FAN)
        while stack:
            level, a, b = stack.pop()
            if len(a) > CHUNK:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            x = self.levels[level]
            low_a, low_b, high_a, high_b = x["low"][a], x["low"][b], x["high"][a], x["high"][b]
            fixed = ~((low_a ^ high_a) | (low_b ^ high_b))
            near = np.bitwise_count((low_a ^ low_b) & fixed) <= radius
            if level == 0:
                near &= a != b
                if near.any():
                    yield a[near], b[near]
                continue
            whole = near & (np.bitwise_count((high_a | high_b) ^ (low_a & low_b)) <= radius)
            if whole.any():
                p, q = a[whole], b[whole]
                two = p != q
                if two.any():
                    yield x["first"][p[two]], x["first"][q[two]]
                own = p[~two]
                if len(own):
                    size = self._size(level)[own]
                    first = np.repeat(x["first"][own], size)
                    yield first, first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
            go = near & ~whole
            if not go.any():
                continue
            a, b = a[go], b[go]
            start, count = x["kids"]
            left = (start[a][:, None, None] + steps[None, :, None]) + 0 * steps[None, None, :]
            right = (start[b][:, None, None] + steps[None, None, :]) + 0 * steps[None, :, None]
            real = (steps[None, :, None] < count[a][:, None, None]) & (steps[None, None, :] < count[b][:, None, None])
            real &= (a != b)[:, None, None] | (left <= right)
            stack.append((level - 1, left[real], right[real]))


def rooted(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each of n nodes' components. Links are merged one batch after the other, none is kept."""
    label = np.arange(n)
    for a, b in pairs:
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        while len(a):
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            a, b = label[low], label[high]
            open_ = a != b
            a, b = a[open_], b[open_]
        while True:
            after = label[label]
            if np.array_equal(after, label):
                break
            label = after
    return label


def _masks(radius: int, fixed: int = 0) -> list[int]:
    """Masks of `radius` of 2 * radius blocks of the bits outside `fixed`: two words that agree in `fixed` and differ in at most `radius` bits agree under one at least."""
    free = [i for i in range(64) if not fixed >> i & 1]
    n = max(min(2 * radius, len(free)), 1)
    cuts = [len(free) * i // n for i in range(n + 1)]
    block = [sum(1 << i for i in free[a:b]) for a, b in itertools.pairwise(cuts)]
    return [fixed | sum(x) for x in itertools.combinations(block, n - radius)]


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _groups(fps: DataFrame, radius: int, wide: int) -> DataFrame:
    """mask, bits and fp: each fingerprint in every group of those that agree with it under a mask; groups of more than `wide` are dealt out by finer masks."""
    masks = _masks(radius)
    spread = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _signed(masks)])).alias("mask", "bits"))
    large = cut(spread.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > wide).select("mask", "bits"), "large-groups")
    small = spread.join(large, ["mask", "bits"], "left_anti").select("mask", "bits", "fp")
    finer = F.array(*[F.array(*map(F.lit, _signed(_masks(radius, m)))) for m in masks])
    again = spread.join(large, ["mask", "bits"]).select("fp", "mask", F.posexplode(F.element_at(finer, F.col("mask") + 1)).alias("part", "by"))
    number = len(masks) + F.col("mask") * (1 << 10) + F.col("part")
    return small.union(again.select(number.alias("mask"), F.col("fp").bitwiseAND(F.col("by")).alias("bits"), "fp"))


def near_edges(fps: DataFrame, radius: int = RADIUS, wide: int = WIDE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within `radius`.

    Each fingerprint goes to the groups of the masks that it agrees with
    others under; each group is searched by a GrayIndex and gives a star for
    each of its components, fewer edges than members. Groups of more than
    `wide` are dealt out by masks of half the bits that are left: at a radius of
    3 such a part varies in 18 bits at most, so its size is bounded for good.
    """
    spread = _groups(fps, radius, wide).repartition("mask", "bits").sortWithinPartitions("mask", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), dtype=np.int64)

        def found(rows: np.ndarray) -> pa.RecordBatch:
            mask, bits, fp = rows
            new = np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])] if len(fp) else np.empty(0, bool)
            group = np.cumsum(new)
            several = np.bincount(group)[group] > 1 if len(fp) else new
            values = fp[several].view(U)
            if not len(values):
                return pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"])
            index = GrayIndex(group[several], values)
            label = rooted(len(values), index.links(radius))
            own = np.flatnonzero(label != np.arange(len(label)))
            leaf = index.leaves.view(np.int64)
            return pa.record_batch([pa.array(leaf[own]), pa.array(leaf[label[own]])], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            at = last[-1] + 1 if len(last) else 0
            held = rows[:, at:]  # the last group may go on in the next batch
            yield found(rows[:, :at])
        yield found(held)

    return spread.select("mask", "bits", "fp").mapInArrow(run, "a long, b long").distinct()


def _met(rows: DataFrame, partners: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """rows joined to their one partner each (key, `count`: how many rows have it, and others).

    Partners of very common keys are broadcast, of which there are HUBS at
    most as each has over total / HUBS rows; no task gets all rows of such a key.
    Of up to HUB rows in all, no key can have more.
    """
    if total <= HUB:
        return rows.join(partners.drop(count), key)
    limit = max(HUB, total // HUBS)
    hubs = F.broadcast(partners.where(F.col(count) > limit).drop(count))
    common = rows.join(hubs, key)
    rest = rows.join(hubs.select(key), key, "left_anti").join(partners.where(F.col(count) <= limit).drop(count), key)
    return rest.unionByName(common)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's smallest node) for every node of edges (a, b).

    Large-star and small-star rounds of aggregates and joins, each round
    written to the shared folder; ends when a round changes no edge.
    """
    signature = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    known = now.agg(*signature).first()
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = _met(both.where("v > u"), least, "u", 2 * known["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _met(large, least, "u", known["n"])
        small = joined.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        after = cut(small.where("u <> v").distinct(), "stars")
        then = after.agg(*signature).first()
        forget(now)
        if then == known:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(after.select("v", "v").distinct())
        now, known = after, then


def grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, key (equal for rows of equal doc_id and text), full (equal for equal rows), fp, root (one for each group) and component_id of every row of docs (doc_id, text)."""
    prints = cut(fingerprints(docs), "fingerprints")
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    linked = components(near_edges(groups.select("fp"), radius))
    rooted_groups = groups.join(linked, groups.fp == linked.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted_groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    count = groups.agg(F.sum("n"), F.count("*")).first()
    by_fp = cut(_met(rooted_groups, smallest, "root", count[1] or 0, "m"), "components")
    return _met(prints, by_fp, "fp", count[0] or 0).select("doc_id", "key", "full", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for every row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the
    smallest doc_id that can be reached. Equal fingerprints meet once, so
    groups of exact copies of any size cost one search. Null and empty texts
    have fingerprint 0 and link like others. Null doc_ids stay, and count for a
    component_id only where a component has no other. Repeated rows stay; an
    empty table gives none. Very long texts are hashed whole, one at a time.
    """
    return grouped(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates, with all its columns.

    Of rows with that doc_id, the one with the least hashes of its text and of
    all its columns; of equal rows, one. Rows of a group without any doc_id
    are ordered by these hashes as well. An empty table stays empty.
    """
    same = grouped(docs, radius).groupBy("root", "doc_id", "key", "full").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key", "full", "n")).alias("first")
    chosen = cut(same.groupBy("root").agg(first).select(F.col("first.doc_id").alias("chosen_id"), "first.key", "first.full", "first.n"), "chosen")
    keyed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), *_keys(docs))
    kept = keyed.join(chosen, ["key", "full"]).where(F.col("id").eqNullSafe(F.col("chosen_id")))
    # most are alone; only rows that repeat as a whole are brought together
    again = kept.where("n > 1").dropDuplicates(["id", "key", "full"])
    return kept.where("n = 1").select("row.*").union(again.select("row.*"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
