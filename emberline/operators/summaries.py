"""Grouped summaries behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import times
from emberline.operators.prep import away_trimmed

# Delay descriptions that mean none.
NO_DELAY = ("Not held up", "NULL")


def busy_rates(rows: DataFrame, hour: str | None = None) -> DataFrame:
    """n_incidents, n_busy and busy_prob by ground station, and by hour if its column is given; null stations dropped."""
    both = rows.dropna(subset=["station_ground", "deployed_from_station"])
    flag = away_trimmed(F.col("station_ground"), F.col("deployed_from_station"))
    keys = ["station_ground", *([hour] if hour else [])]
    return both.groupBy(*keys).agg(F.count("*").alias("n_incidents"), F.sum(flag).alias("n_busy")).withColumn("busy_prob", F.col("n_busy") / F.col("n_incidents"))


def median(c, q: float = 0.5) -> Column:
    return F.percentile(c, F.lit(q))


def pace(km, seconds) -> Column:
    """Seconds a km on trips of a km and more."""
    return F.when(km >= 1, seconds / km)


def hour_profile(trips: DataFrame) -> DataFrame:
    return trips.where("hour_of_call IS NOT NULL").groupBy("hour_of_call").agg(median(pace(F.col("road_km"), F.col("drive_s"))).alias("pace"), median("turnout_s").alias("turnout"))


def group_means(rows: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """Mean of value, and size with nulls counted, of groups of `least` rows or more; null keys dropped."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean_s"), F.count("*").alias("n")).where(F.col("n") >= least)


def largest_groups(rows: DataFrame, key: str, value: str, top: int = 8) -> DataFrame:
    """Size, nulls of value counted, and median of value of the largest groups; null keys dropped, ties to the first in order."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), median(value).alias("median_s")).orderBy(F.col("n").desc(), key).limit(top)


def delay_shares(mobilisations: DataFrame, least: float = 0.001) -> DataFrame:
    """Share of all mobilisations held up for each reason, of `least` or more."""
    total = mobilisations.agg(F.count("*").alias("total"))
    held = mobilisations.where(F.col("delay_code").isNotNull() & ~F.col("delay_code").isin(*NO_DELAY)).groupBy("delay_code").agg(F.count("*").alias("n"))
    return held.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= least).drop("total")


def monthly_median(trips: DataFrame, value: str = "drive_s") -> DataFrame:
    return trips.groupBy(F.trunc("date_of_call", "MM").alias("month")).agg(median(value).alias("median_s"), F.count("*").alias("n"))


def distance_bins(trips: DataFrame, km: str, value: str, width: float = 0.5, most: float = 10.0) -> DataFrame:
    """Median of value in bins that include their right edge; 0 is in none."""
    bin_ = F.ceil(F.col(km) / width).cast("int")
    return trips.where((F.col(km) > 0) & (F.col(km) <= most)).groupBy(bin_.alias("bin")).agg(median(value).alias("median_s"), F.count("*").alias("n"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins; the last includes its right edge."""
    i = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return rows.where(F.col(value).between(low, high)).groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def every_hour(rows: DataFrame, column: str = "hour_of_call") -> DataFrame:
    """Counts of all 24 hours, 0 where there is none."""
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias(column))
    return hours.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    total = Window.partitionBy()
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(total))


def errors(rows: DataFrame, observed: str, predicted: Sequence[str]) -> DataFrame:
    """model, mae, median_ae and bias of each predicted column against the observed one."""
    aggs = []
    for p in predicted:
        d = F.col(p) - F.col(observed)
        aggs += [F.avg(F.abs(d)).alias(f"{p}:mae"), median(F.abs(d)).alias(f"{p}:med"), F.avg(d).alias(f"{p}:bias")]
    one = rows.agg(*aggs)
    parts = ", ".join(f"'{p}', `{p}:mae`, `{p}:med`, `{p}:bias`" for p in predicted)
    return one.select(F.expr(f"stack({len(predicted)}, {parts}) AS (model, mae, median_ae, bias)"))


def overview(trips: DataFrame) -> DataFrame:
    """One row of medians, counts, years and span."""
    days = F.datediff(F.max("date_of_call"), F.min("date_of_call")) + 1
    return trips.agg(
        F.count("*").alias("n"), median("drive_s").alias("median_drive_s"), median("turnout_s").alias("median_turnout_s"), median("road_km").alias("median_road_km"),
        F.array_sort(F.collect_set("cal_year")).alias("years"), days.alias("days"), (F.count("*") / days).alias("per_day"), F.stddev_samp("drive_s").alias("sd_drive_s"),
        median("drive_s", 0.025).alias("p2_5"), median("drive_s", 0.975).alias("p97_5"),
    )


def quantile_bins(rows: DataFrame, value: str, of: str, key: str, bins: int = 20) -> DataFrame:
    """Medians of both columns in bins of equal size by rank of value; ties go by key.

    The rank is global but no task sorts all rows: counts of coarse value
    ranges come first, and rows are ranked within their range.
    """
    ranked = with_rank(rows, value, key)
    total = rows.agg(F.count("*").alias("total"))
    b = F.floor((F.col("rank") - 1) * bins / F.col("total")).cast("int")
    return ranked.crossJoin(F.broadcast(total)).groupBy(b.alias("bin")).agg(median(value).alias("value"), median(of).alias("median_of"), F.count("*").alias("n"))


def with_rank(rows: DataFrame, value: str, key: str, parts: int = 64) -> DataFrame:
    """rows with their rank by (value, key), ranked within ranges of about equal size whose counts are added up."""
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)]).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    dealt = rows.crossJoin(F.broadcast(cuts)).withColumn("part", part).drop("cuts")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(value, key))
    return dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + inner).drop("part", "before")


def baselines(trips: DataFrame, train_median: float, road_kph: float) -> DataFrame:
    """trips with the predictions of a constant, of two speeds and of the default curve, within the drive bounds."""
    bounds = (30.0, 1200.0)
    return trips.withColumns({
        "constant": times.clipped(F.lit(train_median), *bounds),
        "straight_32": times.clipped(F.col("crow_km") / 32.0 * 3600, *bounds),
        "road_speed": times.clipped(F.col("road_km") / road_kph * 3600, *bounds),
        "curve_crow": times.clipped(times.DEFAULT_CURVE.seconds(F.col("crow_km")), *bounds),
        "curve_road": times.clipped(times.DEFAULT_CURVE.seconds(F.col("road_km")), *bounds),
    })


def road_speed_kph(trips: DataFrame) -> DataFrame:
    """One row: the speed that the sums of road distance and drive time give."""
    return trips.agg((F.sum("road_km") / F.nullif(F.sum("drive_s"), F.lit(0.0)) * 3600).alias("kph"))


def ground_centroids(rows: DataFrame) -> DataFrame:
    """Median place of each station ground's incidents; null grounds dropped."""
    return rows.where("station_ground IS NOT NULL").groupBy("station_ground").agg(median("dest_lat").alias("lat"), median("dest_lon").alias("lon"), F.count("*").alias("n"))


def snap_quantiles(snapped: DataFrame, km: str = "km") -> DataFrame:
    """Median and 95th percentile of the distances that points were moved to their cells."""
    return snapped.agg(median(km).alias("p50_km"), median(km, 0.95).alias("p95_km"), F.count(km).alias("n"))
