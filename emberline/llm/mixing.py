"""Mixing sources to target token weights by entropy balancing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, forget, table, text_or_empty, whole_row

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3
#: Newton stops where every source's expected tokens are this near its target, relatively.
TOLERANCE = 1e-9
#: Newton steps of a job, and of all jobs; bisection alone needs fewer than these.
STEPS, ROUNDS = 3, 150
#: Equal rows are numbered in so many parts, so that no task numbers all of a large group.
PARTS = 64
#: The rounding threshold is sought in so many buckets at a time, so many times over.
BUCKETS, DEPTH = 1024, 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target of each source of sizes (source, size, n: n documents of that size).

    All sizes are shared by weight. Targets stop at `most` times the source's
    size and the excess goes to the others by weight, until none is above: the
    level at which sources in the order of most * size / weight cease to be
    full.
    """
    each = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * most
    level = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shared = (
        weighted.withColumn("cap", cap)
        .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("among", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") * F.col("among") <= F.col("weight") * F.col("left"))
    )
    open_left = F.max(F.when(~F.col("full"), F.col("left"))).over(whole)
    open_among = F.max(F.when(~F.col("full"), F.col("among"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * open_left / open_among)
    return shared.select("source", "source_size", "weight", target.alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """targets with `scale` and `tilt`: the dual solution that brings each source's expected tokens to its target.

    Among rates between 0 and `most`, those nearest to 1 in relative entropy
    that meet the token constraints are least(most, exp(tilt * size / scale)).
    The dual is convex; each Newton step is one aggregate over the distinct
    sizes of all sources, kept within a bracket by bisection. Sources whose
    target is all that may be taken have a null tilt, and rate `most`.
    """
    per = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select(targets["*"], "size", "n")
    scaled = per.groupBy("source", "source_size", "weight", "target").agg((F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")) / F.nullif(F.sum(F.col("n") * F.col("size")), F.lit(0))).alias("scale"))
    solid = (F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size"))
    state = cut(
        scaled.withColumn("solid", solid)
        .withColumn("tilt", F.when(F.col("solid"), F.log(F.col("target") / F.col("source_size"))))
        .withColumn("low", F.when(F.col("solid"), F.lit(-700.0) * F.col("scale")))
        .withColumn("high", F.when(F.col("solid"), F.lit(1.2) * F.col("scale") + 1)),
        "tilts",
    )
    for _ in range(0, ROUNDS, STEPS):
        last = state
        for _ in range(STEPS):
            power = F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale")))
            mass = F.col("n") * F.col("size")
            columns = [c for c in state.columns if c != "done"]
            at = (
                sizes.join(state.where("solid").drop("done"), sizes.source.eqNullSafe(state.source))
                .select(*[state[c] for c in columns], mass.cast("double").alias("mass"), (F.col("size") / F.col("scale")).alias("x"), power.alias("power"))
                .groupBy(*columns)
                .agg(F.sum(F.col("mass") * F.least(F.lit(float(most)), F.col("power"))).alias("value"), F.sum(F.when(F.col("power") < most, F.col("mass") * F.col("x") * F.col("power")).otherwise(0.0)).alias("slope"))
                .withColumn("gap", F.col("value") - F.col("target"))
                .withColumn("low", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low")))
                .withColumn("high", F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high")))
                .withColumn("newton", F.col("tilt") - F.col("gap") / F.nullif(F.col("slope"), F.lit(0.0)))
                .withColumn("done", F.abs("gap") <= TOLERANCE * F.col("target"))
                .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2))
            )
            state = at.select(*columns, "done").union(state.where("NOT solid").select(*columns, F.lit(True).alias("done")))
        state = cut(state, "tilts")
        forget(last)
        open_ = state.where("NOT done")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"no rates meet the targets after {ROUNDS} steps: {open_.select('source', 'target', 'tilt').limit(5).collect()}")
    return state.select("source", "source_size", "weight", "target", "scale", F.round("tilt", 10).alias("tilt"))


def _rated(rows: DataFrame, state: DataFrame, most: int, seed: int) -> DataFrame:
    """rows (source, size, same, nth) with state's columns, rate, whole (its whole part) and key; a null key marks rows at the full rate."""
    full = F.lit(float(most))
    rate = F.when(F.col("tilt").isNull(), full).otherwise(F.least(full, F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale")))))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("same"), F.col("nth")), F.lit(1 << 40)) / float(1 << 40)
    own = state.withColumnRenamed("source", "__of")
    return (
        rows.join(own, rows.source.eqNullSafe(own["__of"]))
        .drop("__of")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("key", F.when(F.col("rate") < most, u - (F.col("rate") - F.col("whole"))))
    )


def _copies():
    return F.when(F.col("key").isNull(), F.col("whole")).otherwise(F.col("whole") + (F.col("key") < F.col("edge")).cast("long")).cast("int")


def _size():
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _same():
    """Equal for rows with equal doc_id, text and source."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_or_empty(), F.col("source"))


def _repeated(rows: DataFrame) -> DataFrame:
    """The values of `same` that several rows have."""
    return cut(rows.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"), "repeated")


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with nth, from 0 on among rows with one value of `same`.

    Only rows that repeat are numbered, in PARTS parts whose counts add up. Which
    of equal rows has which number is arbitrary; how many have each isn't.
    """
    alone = rows.join(repeated, "same", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    several = rows.join(repeated, "same", "left_semi").withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    own = several.withColumn("nth", F.row_number().over(Window.partitionBy("same", "__part").orderBy("same")) - 1)
    counts = own.groupBy("same", "__part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("same").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("same", "__part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    numbered = own.join(before, ["same", "__part"]).withColumn("nth", (F.col("nth") + F.col("before")).cast("long"))
    return alone.unionByName(numbered.select(alone.columns))


def solve(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """One row for each source of sized (source, size, same, nth): source_size, target, scale, tilt and edge, the threshold for one more copy."""
    counts = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    params = cut(tilts(counts, cut(source_targets(counts, weights, most), "targets"), most), "solved")
    base = _rated(sized, params, most, seed).groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure")).withColumnRenamed("source", "of")
    state = cut(params.join(base, params.source.eqNullSafe(base.of)).drop("of").withColumn("need", F.col("target") - F.col("sure")).drop("sure").withColumn("edge", F.lit(-1.0)), "thresholds")
    width = 2.0
    for _ in range(DEPTH):
        width /= BUCKETS
        bucket = F.floor((F.col("key") - F.col("edge")) / width)
        within = _rated(sized, state, most, seed).where((F.col("key") >= F.col("edge")) & (bucket < BUCKETS))
        filled = within.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = filled.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))).withColumnRenamed("source", "of")
        step = state.join(upto, state.source.eqNullSafe(upto.of), "left")
        # what lies below the bucket in which the need is passed is taken
        below = F.col("upto") <= F.col("need")
        after = step.groupBy(*state.columns).agg(
            F.coalesce(F.max(F.when(below, F.col("upto"))), F.lit(0)).alias("taken"),
            F.min(F.when(~below, F.col("bucket"))).alias("crossed"),
            F.max("bucket").alias("last"),
        )
        edge = F.col("edge") + width * F.coalesce("crossed", F.col("last") + 1, F.lit(0))
        last, state = state, cut(after.select(*[c for c in state.columns if c not in ("need", "edge")], (F.col("need") - F.col("taken")).alias("need"), edge.alias("edge")), "thresholds")
        forget(last)
    # the last bucket is taken as well if that comes nearer
    last = _rated(sized, state, most, seed).where((F.col("key") >= F.col("edge")) & (F.col("key") < F.col("edge") + width))
    rest = last.groupBy("source").agg(F.sum("size").alias("rest")).withColumnRenamed("source", "of")
    final = state.join(rest, state.source.eqNullSafe(rest.of), "left")
    nearer = (F.col("need") > 0) & (F.abs(F.col("rest") - F.col("need")) < F.col("need"))
    return cut(final.withColumn("edge", F.when(nearer, F.col("edge") + width).otherwise(F.col("edge"))).drop("of", "rest", "need"), "thresholds")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """How often each row of docs (doc_id, text, source) is taken so that sources come to their token targets.

    Columns: doc_id, source, size (words of the text), source_size, target (its
    source's tokens), rate, copies (0 to `most`) and taken (copies * size).

    Rates become whole copies by a hash of doc_id, text, source and a number
    among rows equal in these: a row gets one more copy where hash - fraction
    is below its source's threshold, and the threshold is placed, by counting
    ever finer buckets, where the source's tokens come nearest to its target.
    Nothing depends on partitioning, so reruns agree.

    Null text has size 0. Null source is a source of its own, the last. Null
    doc_ids are as good as others; of repeated rows each is rounded on its own.
    Rows of size 0 take no tokens. Very long texts are counted whole, where they lie. An
    empty table, or one without words, gives targets of 0. Other columns are ignored.
    Raises RuntimeError if the dual can't be solved.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size().alias("size"), _same().alias("same")), "rows")
    sized = cut(_numbered(rows, _repeated(rows)), "sizes")
    rated = _rated(sized, solve(sized, weights, most, seed), most, seed).withColumn("copies", _copies())
    return rated.select("doc_id", "source", "size", "source_size", "target", F.round("rate", 6).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it.

    Texts of rows that repeat are shuffled to be numbered, no others. Of rows equal
    in doc_id, text and source but not in other columns, any may be the one that is taken.
    """
    rows = cut(docs.select("source", _size().alias("size"), _same().alias("same")), "rows")
    repeated = _repeated(rows)
    state = solve(cut(_numbered(rows, repeated), "sizes"), weights, most, seed)
    own = _numbered(docs.select(whole_row(docs).alias("__row"), "source", "text", _same().alias("same")), repeated).withColumn("size", _size()).drop("text")
    rated = _rated(own, state, most, seed).withColumn("copies", _copies()).where("copies > 0")
    return rated.select("__row", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*")


def op7_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
