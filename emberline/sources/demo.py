"""A made-up city: three places of much demand, some of it anywhere, and ten stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The middle; by hotspot its offset east and north, its spread and its share of the demand.
MIDDLE = (-0.12, 51.50)
HOTSPOTS = ((0.00, 0.00, 0.020, 0.45), (-0.06, -0.04, 0.015, 0.30), (0.07, 0.05, 0.018, 0.25))
IN_HOTSPOTS, STATIONS = 0.8, 10


def _even(seed: int, what: str, key: str = "id") -> Column:
    """Numbers between 0 and 1 from an md5 of seed, name and key: the same in every run, engine and partitioning."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col(key).cast("string"))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def incidents(spark: SparkSession, n: int = 4000, seed: int = 7) -> DataFrame:
    """incident_id, dest_lon, dest_lat, travel_seconds and borough."""
    lon0, lat0 = MIDDLE
    rows = spark.range(n)
    radius, turn = F.sqrt(-2 * F.log(_even(seed, "r"))), 2 * F.pi() * _even(seed, "t")
    lon, lat = F.lit(lon0) + (_even(seed, "x") - 0.5) * 0.24, F.lit(lat0) + (_even(seed, "y") - 0.5) * 0.18
    first = 0
    for east, north, spread, share in HOTSPOTS:
        own = F.col("id").between(first, first + int(n * share * IN_HOTSPOTS) - 1)
        lon = F.when(own, lon0 + east + spread * radius * F.cos(turn)).otherwise(lon)
        lat = F.when(own, lat0 + north + 0.8 * spread * radius * F.sin(turn)).otherwise(lat)
        first += int(n * share * IN_HOTSPOTS)
    return rows.select(F.col("id").alias("incident_id"), lon.alias("dest_lon"), lat.alias("dest_lat"), (180 + 420 * _even(seed, "s")).alias("travel_seconds"), F.lit("DEMO").alias("borough"))


def stations(spark: SparkSession, seed: int = 7) -> DataFrame:
    """station_id, facilityname, lat, lon and borough of ten stations."""
    lon0, lat0 = MIDDLE
    return spark.range(STATIONS).select(F.col("id").alias("station_id"), F.concat(F.lit("DEMO Station "), (F.col("id") + 1).cast("string")).alias("facilityname"), (lat0 + (_even(seed, "a") - 0.5) * 0.16).alias("lat"), (lon0 + (_even(seed, "o") - 0.5) * 0.22).alias("lon"), F.lit("DEMO").alias("borough"))
