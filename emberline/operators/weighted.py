"""Weighted quantiles and scores of response times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import times


def running_weight(df: DataFrame, by: tuple[str, ...] = (), value: str = "response_s", weight: str = "w", width: float = 1.0) -> DataFrame:
    """by, value, w (summed over equal values), cum (running weight) and total.

    Equal values are summed first; then ranges of `width` are added up, and
    values run within their range, so that no task holds all values.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).alias("value")).agg(F.sum(weight).alias("w"))
    rows = rows.withColumn("part", F.floor(F.col("value") / width))
    parts = rows.groupBy(*by, "part").agg(F.sum("w").alias("part_w"))
    run = Window.partitionBy(*by).orderBy("part")
    parts = parts.select(*by, "part", (F.sum("part_w").over(run) - F.col("part_w")).alias("before"), F.sum("part_w").over(Window.partitionBy(*by)).alias("total"))
    inner = Window.partitionBy(*by, "part").orderBy("value")
    return rows.join(parts, [*by, "part"]).select(*by, "value", "w", (F.col("before") + F.sum("w").over(inner)).alias("cum"), "total")


def step_quantile(q: float) -> Column:
    """Of running_weight(): the first value whose share of weight reaches q; the last if none does."""
    return F.coalesce(F.min(F.when(F.col("cum") / F.col("total") >= q, F.col("value"))), F.max("value"))


def interpolated_quantile(running: DataFrame, q: float, into: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The value at q of the total weight, between the values whose running weights enclose it."""
    target = F.lit(q) * F.col("total")
    low = F.max(F.when(F.col("cum") <= target, F.struct("cum", "value"))).alias("lo")
    high = F.min(F.when(F.col("cum") >= target, F.struct("cum", "value"))).alias("hi")
    ends = running.groupBy(*by).agg(low, high, F.max("total").alias("t"))
    step = F.col("lo.value") + (F.col("t") * q - F.col("lo.cum")) / F.nullif(F.col("hi.cum") - F.col("lo.cum"), F.lit(0.0)) * (F.col("hi.value") - F.col("lo.value"))
    return ends.select(*by, F.coalesce(step, F.col("lo.value"), F.col("hi.value")).alias(into))


def posture_metrics(cells: DataFrame, threshold_s: float = 480.0) -> DataFrame:
    """One row: weighted mean, median, 90th percentile, worst, share within the threshold, cells; of cells (response_s, w)."""
    running = running_weight(cells)
    sums = cells.agg(
        (F.sum(F.col("w") * F.col("response_s")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("expected_response_s"),
        F.max("response_s").alias("worst_cell_response_s"),
        (F.sum(F.when(F.col("response_s") <= threshold_s, F.col("w")).otherwise(0.0)) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("coverage_share"),
        F.count("*").alias("demand_cells"),
    )
    return sums.crossJoin(interpolated_quantile(running, 0.5, "median_response_s")).crossJoin(interpolated_quantile(running, 0.9, "p90_response_s"))


def score_first_engine(rows: DataFrame, by: tuple[str, ...] = (), value: str = "response_s", weight: str | None = None) -> DataFrame:
    """Mean, step 90th percentile, shares within 6 and 10 minutes and whether the standard is met; nulls and weights of 0 left out."""
    own = rows.withColumn("w", F.lit(1.0) if weight is None else F.col(weight)).where((F.col("w") > 0) & F.col(value).isNotNull())
    running = running_weight(own, by, value)
    total = F.sum("w")
    out = running.groupBy(*by).agg(
        (F.sum(F.col("w") * F.col("value")) / total).alias("mean_s"),
        step_quantile(0.9).alias("p90_s"),
        (F.sum(F.when(F.col("value") <= times.FIRST_MEAN_S, F.col("w")).otherwise(0.0)) / total).alias("share_within_6min"),
        (F.sum(F.when(F.col("value") <= times.FIRST_P90_S, F.col("w")).otherwise(0.0)) / total).alias("share_within_10min"),
    )
    mean_ok, share_ok = F.col("mean_s") <= times.FIRST_MEAN_S, F.col("share_within_10min") > times.FIRST_SHARE
    return out.withColumn("meets_avg_6", mean_ok.cast("int")).withColumn("meets_90pct_10", share_ok.cast("int")).withColumn("passes", (mean_ok & share_ok).cast("int"))


def ecdf(rows: DataFrame, value: str = "response_s") -> DataFrame:
    return running_weight(rows, (), value).select("value", (F.col("cum") / F.col("total")).alias("share"))
