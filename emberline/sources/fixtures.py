"""Stations, incidents, mobilisations and streets derived from the star-schema test tables by integer arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(x):
    return x.cast("double")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.cast("long").alias("station_id"),
        F.concat(F.lit("Station "), k.cast("string")).alias("facilityname"),
        (F.lit(51.30) + _d((k * 7919) % 4000) / 10000.0).alias("lat"),
        (F.lit(-0.50) + _d((k * 6271) % 8000) / 10000.0).alias("lon"),
        F.col("n_name").alias("borough"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = stations(spark, sf_dir).select("station_id", "facilityname", "lat", "lon")
    n = st.agg(F.count("*").alias("ns"))
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    k = F.col("o_orderkey")
    own = (
        table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
        .withColumn("g", k % F.col("ns")).withColumn("d", (k + 1) % F.col("ns"))
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
    )
    ground = st.select(F.col("station_id").alias("g"), F.col("facilityname").alias("ground"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    deployed = st.select(F.col("station_id").alias("d"), F.col("facilityname").alias("other"))
    placed = own.join(ground, "g").join(deployed, "d")
    away = k % 7 < 2
    return placed.select(
        k.cast("long").alias("incident_id"),
        F.when(k % 97 != 0, F.col("g_lat") + _d((k * 104729) % 401 - 200) / 10000.0).alias("dest_lat"),
        F.when(k % 97 != 0, F.col("g_lon") + _d((k * 130363) % 641 - 320) / 10000.0).alias("dest_lon"),
        F.when(k % 83 != 0, _d(20 + (k * 7 + F.col("o_custkey") * 13) % 900 + F.when(away, 240).otherwise(0))).alias("travel_seconds"),
        F.year("o_orderdate").alias("cal_year"),
        F.to_date("o_orderdate").alias("date_of_call"),
        (k % 24).cast("int").alias("hour_of_call"),
        F.col("n_name").alias("borough"),
        F.when(k % 89 != 0, F.col("ground")).alias("station_ground"),
        F.when(away, F.col("other")).otherwise(F.col("ground")).alias("deployed_from_station"),
        F.col("o_orderpriority").alias("incident_group"),
        (k % 5).cast("int").alias("severity"),
    )


def mobilisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    p = F.col("l_partkey")
    place = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(order)).where("rn = 1").select(
        F.col("l_orderkey").cast("long").alias("incident_id"),
        F.col("l_linenumber").cast("int").alias("pump_order"),
        F.when(place == "A", "Home Station").when(place == "R", "Other Station").otherwise("Elsewhere").alias("deployed_from_location"),
        F.when(p % 40 == 0, "Address incomplete/wrong").when(p % 17 == 0, "Traffic, roadworks, etc").when(p % 3 == 0, "Not held up").alias("delay_code"),
        _d(30 + (p * 13) % 120).alias("turnout_s"),
        _d(15 + (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1300).alias("travel_s"),
    )


def grid_side(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The side of the least square grid that holds all of part, and its nodes."""
    n = table(spark, sf_dir, "part").count()
    return math.isqrt(max(n, 1) - 1) + 1, n


def edges(spark: SparkSession, sf_dir: str, side: int | None = 12) -> DataFrame:
    """A grid of streets, some one-way; over all of part without a side."""
    side, n = grid_side(spark, sf_dir) if side is None else (side, side * side)
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") < n)
    u = F.col("p_partkey")
    step = F.explode(F.array(F.lit(1), F.lit(side))).alias("step")
    out = part.select(u.cast("long").alias("u"), "p_type", "p_size", step)
    out = out.where(((F.col("step") == 1) & (F.col("u") % side < side - 1) | (F.col("step") == side)) & (F.col("u") + F.col("step") < n))
    one = out.select("u", (F.col("u") + F.col("step")).alias("v"), _d(80 + (F.col("u") * 37 + F.col("step") * 11) % 120).alias("length"), (F.col("u") % 5 == 0).alias("oneway"), F.col("p_type").alias("road_class"), F.col("p_size").cast("int").alias("maxspeed"))
    back = one.where("NOT oneway").select(F.col("v").alias("u"), F.col("u").alias("v"), "length", "oneway", "road_class", "maxspeed")
    return one.unionByName(back)


#: The same tables as CTEs for SQL.
STATIONS_SQL = """st AS (SELECT CAST(s_suppkey AS BIGINT) AS station_id, concat('Station ', CAST(s_suppkey AS VARCHAR)) AS facilityname,
  CAST(51.30 AS DOUBLE) + CAST((s_suppkey * 7919) % 4000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
  CAST(-0.50 AS DOUBLE) + CAST((s_suppkey * 6271) % 8000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon, n_name AS borough
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
INCIDENTS_SQL = STATIONS_SQL + """,
ns AS (SELECT count(*) AS n FROM supplier),
inc AS (SELECT CAST(o_orderkey AS BIGINT) AS incident_id,
  CASE WHEN o_orderkey % 97 <> 0 THEN g.lat + CAST((o_orderkey * 104729) % 401 - 200 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS dest_lat,
  CASE WHEN o_orderkey % 97 <> 0 THEN g.lon + CAST((o_orderkey * 130363) % 641 - 320 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS dest_lon,
  CASE WHEN o_orderkey % 83 <> 0 THEN CAST(20 + (o_orderkey * 7 + o_custkey * 13) % 900 + CASE WHEN o_orderkey % 7 < 2 THEN 240 ELSE 0 END AS DOUBLE) END AS travel_seconds,
  CAST(year(o_orderdate) AS INT) AS cal_year, CAST(o_orderdate AS DATE) AS date_of_call, CAST(o_orderkey % 24 AS INT) AS hour_of_call, n_name AS borough,
  CASE WHEN o_orderkey % 89 <> 0 THEN g.facilityname END AS station_ground,
  CASE WHEN o_orderkey % 7 < 2 THEN d.facilityname ELSE g.facilityname END AS deployed_from_station,
  o_orderpriority AS incident_group, CAST(o_orderkey % 5 AS INT) AS severity
  FROM orders CROSS JOIN ns JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN st g ON g.station_id = o_orderkey % ns.n JOIN st d ON d.station_id = (o_orderkey + 1) % ns.n)"""
MOBILISATIONS_SQL = """mob AS (SELECT CAST(l_orderkey AS BIGINT) AS incident_id, CAST(l_linenumber AS INT) AS pump_order,
  CASE l_returnflag WHEN 'A' THEN 'Home Station' WHEN 'R' THEN 'Other Station' ELSE 'Elsewhere' END AS deployed_from_location,
  CASE WHEN l_partkey % 40 = 0 THEN 'Address incomplete/wrong' WHEN l_partkey % 17 = 0 THEN 'Traffic, roadworks, etc' WHEN l_partkey % 3 = 0 THEN 'Not held up' END AS delay_code,
  CAST(30 + (l_partkey * 13) % 120 AS DOUBLE) AS turnout_s, CAST(15 + (l_orderkey * 31 + l_linenumber * 17) % 1300 AS DOUBLE) AS travel_s
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)"""
EDGES_SQL = """one AS (SELECT CAST(p_partkey AS BIGINT) AS u, CAST(p_partkey + step AS BIGINT) AS v, CAST(80 + (p_partkey * 37 + step * 11) % 120 AS DOUBLE) AS length,
  p_partkey % 5 = 0 AS oneway, p_type AS road_class, CAST(p_size AS INT) AS maxspeed
  FROM part CROSS JOIN (VALUES (1), (12)) s(step) WHERE p_partkey < 144 AND ((step = 1 AND p_partkey % 12 < 11) OR (step = 12 AND p_partkey < 132))),
ed AS (SELECT * FROM one UNION ALL SELECT v, u, length, oneway, road_class, maxspeed FROM one WHERE NOT oneway)"""

#: The grid over all of part.
ALL_EDGES_SQL = """gr AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS side FROM part),
one AS (SELECT CAST(p_partkey AS BIGINT) AS u, CAST(p_partkey + step AS BIGINT) AS v, CAST(80 + (p_partkey * 37 + step * 11) % 120 AS DOUBLE) AS length,
  p_partkey % 5 = 0 AS oneway, p_type AS road_class, CAST(p_size AS INT) AS maxspeed
  FROM part CROSS JOIN gr CROSS JOIN LATERAL (SELECT unnest([1, side]) AS step) s WHERE p_partkey + step < n AND (step <> 1 OR p_partkey % side < side - 1)),
ed AS (SELECT * FROM one UNION ALL SELECT v, u, length, oneway, road_class, maxspeed FROM one WHERE NOT oneway)"""


# greatest() and least() skip nulls in SQL; adding 0 times the value brings the null back.
def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 6371.0) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return f"(CAST({2 * radius} AS DOUBLE) * asin(sqrt(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {h})) + 0 * {h})))"


def curve_sql(km: str) -> str:
    d = f"(greatest({km}, CAST(0 AS DOUBLE)) + 0 * {km})"
    return f"(CASE WHEN {d} <= CAST(1.913 AS DOUBLE) THEN CAST(15.846 AS DOUBLE) + CAST(180.913 AS DOUBLE) * sqrt({d}) ELSE CAST(145.697 AS DOUBLE) + CAST(71.783 AS DOUBLE) * {d} END)"
