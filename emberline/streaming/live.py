"""The grouped summaries on a stream of incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.prep import away_trimmed


def busy_by_window(stream: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n_incidents, n_busy and busy_prob by window and ground station; events later than `late` are left out."""
    flag = away_trimmed(F.col("station_ground"), F.col("deployed_from_station"))
    both = stream.withWatermark(at, late).dropna(subset=["station_ground", "deployed_from_station"])
    out = both.groupBy(F.window(at, window).alias("w"), "station_ground").agg(F.count("*").alias("n_incidents"), F.sum(flag).alias("n_busy"))
    return out.select(F.col("w.start").alias("start"), "station_ground", "n_incidents", "n_busy", (F.col("n_busy") / F.col("n_incidents")).alias("busy_prob"))
