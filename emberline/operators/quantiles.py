"""Exact quantiles of tables of any size: histograms that narrow down to the ranks wanted."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.tables import forget, held

#: Buckets that each pass cuts an interval into.
BUCKETS = 4096


def exact_quantiles(rows: DataFrame, by: str, value: str, shares: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """by, q and value: the quantiles of each group, linear between the two nearest ranks.

    Each pass counts the values within the intervals that hold a wanted rank,
    by bucket, and goes on with the least and greatest value of the bucket where the rank lies, until these are equal. The
    counts are added up before they are shuffled, no task holds a group's
    values, and the driver sees one row for each group and rank; groups are
    those of a report. Null and NaN values are left out; a null group is a group. An empty table gives no row.
    """
    spark = rows.sparkSession
    own = held(rows.select(F.struct(by).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    wanted, intervals = [], {}  # (group, q, position); (group, low, high) -> (rows below, ranks)
    found: dict[tuple, float] = {}
    for r in own.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        ranks = set()
        for q in shares:
            at = q * (r.n - 1)
            wanted.append((r.g[0], q, at))
            ranks |= {math.floor(at), math.ceil(at)}
        intervals[r.g[0], r.low, r.high] = (0, ranks)
    kind = rows.schema[by].dataType.simpleString()
    while intervals:
        found |= {(g, rank): low for (g, low, high), (_, ranks) in intervals.items() if low == high for rank in ranks}
        intervals = {k: v for k, v in intervals.items() if k[1] < k[2]}
        if not intervals:
            break
        asked = F.broadcast(spark.createDataFrame([((g,), low, high, below, sorted(ranks)) for (g, low, high), (below, ranks) in intervals.items()], f"h struct<g:{kind}>, low double, high double, below long, ranks array<long>"))
        part = own.join(asked, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))
        half = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, as the width of an interval may pass the largest number
        counted = part.groupBy("h", "low", "below", "ranks", F.least(F.floor(half * buckets), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("h", "low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        here = counted.withColumn("before", before).withColumn("inside", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
        intervals = {}
        for r in here.where("size(inside) > 0").select("h", "least", "most", "before", "inside").collect():
            intervals[r.h[0], r.least, r.most] = (r.before, set(r.inside))
    forget(own)
    out = []
    for g, q, at in wanted:
        low, high = found[g, math.floor(at)], found[g, math.ceil(at)]
        out.append((g, float(q), low + (at - math.floor(at)) * (high - low)))
    return spark.createDataFrame(out, f"`{by}` {kind}, q double, value double")
