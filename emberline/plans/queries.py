"""The engine's queries over the test tables, each with SQL that says the same in another way where SQL can.

A query's columns are given once, as "name:kind" (s text, i whole number,
d double to 4 places, f to 9), and hold for both ways.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import geo, text, times
from emberline.operators import facility, fitting, graph, ml, prep, raster, scenario, spatial, summaries, weighted
from emberline.plans import planner
from emberline.sources import fixtures as fx
from emberline.sources.tables import held

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TRAIN, TEST = (1995, 1996, 1997, 1998, 1999), (2000,)
INC, ST, MOB, ED = fx.INCIDENTS_SQL, fx.STATIONS_SQL, fx.MOBILISATIONS_SQL, fx.ALL_EDGES_SQL


#: Decimal places by kind, and what is added before rounding so that means of round numbers don't lie half way.
PLACES = {"d": 4, "f": 9}
NUDGE = {"d": 3e-8, "f": 3e-11}


def _shaped(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for c in columns.split():
        name, kind = c.split(":")
        col = F.col(name)
        out.append((col.cast("string") if kind == "s" else col.cast("long") if kind == "i" else (F.round(col.cast("double") + NUDGE[kind], PLACES[kind]) + F.lit(0.0))).alias(name))
    return df.select(*out)


def _shaped_sql(ctes: str, body: str, columns: str) -> str:
    out = []
    for c in columns.split():
        name, kind = c.split(":")
        out.append({"s": f"CAST({name} AS VARCHAR)", "i": f"CAST({name} AS BIGINT)"}.get(kind, f"round(CAST({name} AS DOUBLE) + CAST({NUDGE.get(kind)} AS DOUBLE), {PLACES.get(kind)}) + CAST(0 AS DOUBLE)") + f" AS {name}")
    return (f"WITH {ctes} " if ctes else "") + f"SELECT {', '.join(out)} FROM ({body}) AS q"


def query(columns: str, ctes: str = "", body: str | None = None):
    """Registers a query, and its SQL if there is some."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _shaped(f(spark, sf_dir), columns)
        if body is not None:
            ORACLES[f.__name__] = _shaped_sql(ctes, body, columns)
        return f

    return add


# SQL pieces
HAV = fx.haversine_sql
PTS = "pts AS (SELECT incident_id, dest_lat AS lat, dest_lon AS lon, travel_seconds, cal_year FROM inc WHERE dest_lat IS NOT NULL AND dest_lon IS NOT NULL)"
NEAR = INC + ", " + PTS + f", near AS (SELECT incident_id, min({HAV('p.lon', 'p.lat', 's.lon', 's.lat', 6371.0088)}) AS km FROM pts p CROSS JOIN st s GROUP BY incident_id)"
RESP = NEAR + f", resp AS (SELECT incident_id, round({fx.curve_sql('km')} + 60, 6) AS response_s FROM near)"
TRIPS = INC + ", " + MOB + f""",
trip0 AS (SELECT m.*, i.cal_year, i.date_of_call, i.hour_of_call, upper(i.borough) AS borough, i.station_ground, i.deployed_from_station, s.lat AS start_lat, s.lon AS start_lon, i.dest_lat, i.dest_lon,
  {HAV('s.lon', 's.lat', 'i.dest_lon', 'i.dest_lat', 6371.0088)} AS crow_km FROM mob m JOIN inc i USING (incident_id) JOIN st s ON s.facilityname = i.deployed_from_station
  WHERE deployed_from_location IN ('Home Station', 'Other Station') AND (delay_code IS NULL OR delay_code NOT IN ('On outside duty when mobilised', 'Address incomplete/wrong')) AND travel_s BETWEEN 30 AND 1200),
trips AS (SELECT *, CAST(1.25 AS DOUBLE) * crow_km AS road_km, travel_s AS drive_s, CASE WHEN station_ground IS NULL OR station_ground <> deployed_from_station THEN 1 ELSE 0 END AS busy_flag FROM trip0 WHERE crow_km > 0 AND crow_km <= 15)"""


def _grid_sql(cell_km: float, weight: str = "CAST(1 AS DOUBLE)") -> str:
    return f""", g0 AS (SELECT *, {weight} AS w FROM inc WHERE dest_lat IS NOT NULL AND dest_lon IS NOT NULL),
gs AS (SELECT CAST({cell_km} AS DOUBLE) / CAST(110.574 AS DOUBLE) AS dlat, CAST({cell_km} AS DOUBLE) / (CAST(111.32 AS DOUBLE) * greatest(cos(radians(avg(dest_lat))), CAST(0.1 AS DOUBLE))) AS dlon FROM g0),
gc AS (SELECT CAST(floor(dest_lon / dlon) AS BIGINT) AS ix, CAST(floor(dest_lat / dlat) AS BIGINT) AS iy, count(*) AS n_incidents, sum(w) AS weight,
  sum(greatest(w, CAST(1e-9 AS DOUBLE)) * dest_lat) / sum(greatest(w, CAST(1e-9 AS DOUBLE))) AS lat, sum(greatest(w, CAST(1e-9 AS DOUBLE)) * dest_lon) / sum(greatest(w, CAST(1e-9 AS DOUBLE))) AS lon FROM g0 CROSS JOIN gs GROUP BY 1, 2),
cells AS (SELECT row_number() OVER (ORDER BY round(weight, 6) DESC, ix, iy) - 1 AS cell_id, *, weight / sum(weight) OVER () AS share FROM gc)"""


GRID = INC + _grid_sql(2.0)
CAND = GRID + """, cand AS (SELECT row_number() OVER (ORDER BY part, pos) - 1 AS candidate_id, * FROM (
  SELECT 0 AS part, station_id AS pos, facilityname AS site_name, 'existing_firehouse' AS layer, lat, lon FROM st
  UNION ALL SELECT 1, cell_id, concat('Demand cell ', CAST(cell_id + 1 AS VARCHAR)), 'demand_cell', lat, lon FROM cells WHERE cell_id < 20))"""
#: Times from all candidates to all cells.
WHOLE = CAND + f""", tm AS (SELECT candidate_id AS site_id, layer, cell_id, weight AS w, greatest({fx.curve_sql(HAV('s.lon', 's.lat', 'c.lon', 'c.lat'))}, CAST(15 AS DOUBLE)) + 60 AS t FROM cand s CROSS JOIN cells c)"""


def _parts(spark, d):
    st, inc = fx.stations(spark, d), fx.incidents(spark, d)
    return st, inc


def _trips(spark, d):
    return prep.training_rows(fx.mobilisations(spark, d), *_parts(spark, d)[::-1])


def _cells(spark, d):
    return spatial.demand_grid(fx.incidents(spark, d), 2.0)


def _all_times(spark, d):
    """Times from every candidate to every cell, as a written table, and the existing sites."""
    cells = _cells(spark, d)
    sites = held(spatial.candidates(fx.stations(spark, d), cells, 20))
    m = spatial.travel_matrix(sites, cells)
    existing = [r.candidate_id for r in sites.where("is_existing").orderBy("candidate_id").collect()]
    return held(m.select("site_id", "cell_id", "w", (F.col("drive_s") + 60.0).alias("t"))), existing


def _near(spark, d):
    st, inc = _parts(spark, d)
    return spatial.nearest(spatial.points_of(inc), "incident_id", spatial.sites_of(st), "site", spatial.crow())


def _response(spark, d):
    return _near(spark, d).select("incident_id", F.round(times.DEFAULT_CURVE.seconds(F.col("km")) + times.TURNOUT_S, 6).alias("response_s"))


# ---- scores and distances ----
SCORE = "mean_s:d p90_s:d share_within_6min:d share_within_10min:d meets_avg_6:i meets_90pct_10:i passes:i"


def _score_sql(rows: str, by: str = "") -> str:
    b, p = (f"{by}, " if by else ""), (f"PARTITION BY {by} " if by else "")
    return f"""SELECT {b}avg(x) AS mean_s, min(CASE WHEN cum / n >= 0.9 THEN x END) AS p90_s, avg(CASE WHEN x <= 360 THEN 1.0 ELSE 0 END) AS share_within_6min, avg(CASE WHEN x <= 600 THEN 1.0 ELSE 0 END) AS share_within_10min,
  CAST(avg(x) <= 360 AS INT) AS meets_avg_6, CAST(avg(CASE WHEN x <= 600 THEN 1.0 ELSE 0 END) > 0.9 AS INT) AS meets_90pct_10, CAST(avg(x) <= 360 AND avg(CASE WHEN x <= 600 THEN 1.0 ELSE 0 END) > 0.9 AS INT) AS passes
  FROM (SELECT {b}response_s AS x, CAST(count(*) OVER ({p}ORDER BY response_s) AS DOUBLE) AS cum, CAST(count(*) OVER ({p}) AS DOUBLE) AS n FROM {rows}) {'GROUP BY ' + by if by else ''}"""


@query(SCORE, RESP, _score_sql("resp"))
def nearest_attendance_score(spark, d):
    return weighted.score_first_engine(_response(spark, d))


@query("incident_id:i km:d", NEAR, "SELECT * FROM near")
def nearest_station(spark, d):
    return _near(spark, d)


@query("incident_id:i km:d", NEAR, "SELECT * FROM near")
def nearest_station_by_cells(spark, d):
    st, inc = _parts(spark, d)
    return spatial.nearest(spatial.points_of(inc), "incident_id", spatial.sites_of(st), "site", spatial.crow(), small=0)


@query("station_id:i other_id:i km:d flat_km:d bearing:d", ST, f"""SELECT a.station_id, b.station_id AS other_id, {HAV('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km,
  sqrt(pow((b.lon - a.lon) * 111.32 * cos(radians(a.lat)), 2) + pow((b.lat - a.lat) * 110.574, 2)) AS flat_km,
  CASE WHEN degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) < 0 THEN degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) + 360 ELSE degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) END AS bearing
  FROM st a JOIN st b ON b.station_id > a.station_id""")
def haversine_pairs(spark, d):
    st = fx.stations(spark, d).select("station_id", "lat", "lon")
    a = st.repartition(8 * spark.sparkContext.defaultParallelism).alias("a")  # a small file is one task's else
    b = F.broadcast(st).alias("b")
    p = a.join(b, F.col("b.station_id") > F.col("a.station_id"))
    args = [F.col(c) for c in ("a.lon", "a.lat", "b.lon", "b.lat")]
    return p.select(F.col("a.station_id").alias("station_id"), F.col("b.station_id").alias("other_id"), geo.haversine_km(*args).alias("km"), F.sqrt(geo.flat_km2(*args, F.col("a.lat"))).alias("flat_km"), geo.bearing(*args).alias("bearing"))


@query("incident_id:i drive_s:d crow_s:d attend_s:d", NEAR, f"SELECT incident_id, {fx.curve_sql('km')} AS drive_s, 15 + km * CAST(1.3 AS DOUBLE) / 28 * 3600 AS crow_s, {fx.curve_sql('km')} + least(greatest(CAST(incident_id % 400 AS DOUBLE) - 50, CAST(0 AS DOUBLE)), CAST(300 AS DOUBLE)) AS attend_s FROM near")
def kolesar_predict(spark, d):
    km = F.col("km")
    drive = times.DEFAULT_CURVE.seconds(km)
    return _near(spark, d).select("incident_id", drive.alias("drive_s"), times.flat_speed_seconds(km).alias("crow_s"), times.attendance(drive, (F.col("incident_id") % 400).cast("double") - 50).alias("attend_s"))


# ---- cleaning ----
@query("incident_id:i dest_lat:f dest_lon:f travel_seconds:d cal_year:i hour_of_call:i borough:s station_ground:s deployed_from_station:s busy_flag:i", INC, """SELECT *, CASE WHEN station_ground IS NOT NULL AND deployed_from_station IS NOT NULL AND trim(station_ground) <> trim(deployed_from_station) THEN 1 ELSE 0 END AS busy_flag
  FROM inc WHERE dest_lat IS NOT NULL AND dest_lon IS NOT NULL AND travel_seconds BETWEEN 30 AND 1800""")
def planner_rows(spark, d):
    return prep.planner_rows(fx.incidents(spark, d))


@query("variant:s n:i n_busy:i", INC, """SELECT 'strict' AS variant, count(*) AS n, sum(CASE WHEN station_ground IS NOT NULL AND station_ground <> deployed_from_station THEN 1 ELSE 0 END) AS n_busy FROM inc
  UNION ALL SELECT 'trimmed', count(station_ground), sum(CASE WHEN station_ground <> deployed_from_station THEN 1 ELSE 0 END) FROM inc WHERE station_ground IS NOT NULL
  UNION ALL SELECT 'plain', count(*), sum(CASE WHEN station_ground IS DISTINCT FROM deployed_from_station THEN 1 ELSE 0 END) FROM inc""")
def busy_flag_variants(spark, d):
    g, s = F.col("station_ground"), F.col("deployed_from_station")
    flags = {"strict": prep.away_strict(g, s), "trimmed": prep.away_trimmed(g, s), "plain": prep.away_plain(g, s)}
    one = fx.incidents(spark, d).agg(*[x for k, f in flags.items() for x in (F.count(f).alias(f"{k}_n"), F.sum(f).alias(f"{k}_b"))])
    return one.select(F.expr("stack(3, " + ", ".join(f"'{k}', {k}_n, {k}_b" for k in flags) + ") AS (variant, n, n_busy)"))


@query("incident_id:i pump_order:i cal_year:i hour_of_call:i borough:s station_ground:s deployed_from_station:s busy_flag:i crow_km:d road_km:d turnout_s:d drive_s:d", TRIPS, "SELECT * FROM trips")
def training_rows(spark, d):
    return _trips(spark, d)


@query("step:s n:i", INC + ", " + MOB + f""", f0 AS (SELECT deployed_from_location IN ('Home Station', 'Other Station') AS a, delay_code IS NULL OR delay_code NOT IN ('On outside duty when mobilised', 'Address incomplete/wrong') AS b, travel_s BETWEEN 30 AND 1200 AS c, s.lat IS NOT NULL AS e,
  {HAV('s.lon', 's.lat', 'i.dest_lon', 'i.dest_lat', 6371.0088)} AS km FROM mob LEFT JOIN inc i USING (incident_id) LEFT JOIN st s ON s.facilityname = i.deployed_from_station)""", """SELECT 'mobilisations' AS step, count(*) AS n FROM f0 UNION ALL SELECT 'left_from_a_station', count(*) FROM f0 WHERE a
  UNION ALL SELECT 'not_outside_duty_or_bad_address', count(*) FROM f0 WHERE a AND b UNION ALL SELECT 'travel_30_1200s', count(*) FROM f0 WHERE a AND b AND c
  UNION ALL SELECT 'known_station', count(*) FROM f0 WHERE a AND b AND c AND e UNION ALL SELECT 'crow_km_0_15', count(*) FROM f0 WHERE a AND b AND c AND e AND km > 0 AND km <= 15""")
def training_funnel(spark, d):
    return prep.funnel(fx.mobilisations(spark, d), *_parts(spark, d)[::-1])


@query("incident_id:i dow:i month:i rush:i night:i", INC, "SELECT incident_id, isodow(date_of_call) - 1 AS dow, month(date_of_call) AS month, CAST(hour_of_call BETWEEN 7 AND 9 OR hour_of_call BETWEEN 16 AND 19 AS INT) AS rush, CAST(hour_of_call >= 22 OR hour_of_call <= 5 AS INT) AS night FROM inc")
def time_features(spark, d):
    return prep.time_features(fx.incidents(spark, d))


@query("incident_id:i code:d", INC + ", tr AS (SELECT DISTINCT borough FROM inc WHERE cal_year <= 1999 AND borough < 'R')", "SELECT incident_id, (SELECT count(*) FROM tr WHERE tr.borough < inc.borough) AS code FROM inc WHERE borough IN (SELECT borough FROM tr) UNION ALL SELECT incident_id, NULL FROM inc WHERE borough NOT IN (SELECT borough FROM tr)")
def borough_code(spark, d):
    inc = fx.incidents(spark, d)
    return prep.label_codes(inc.where("cal_year <= 1999 AND borough < 'R'"), inc, "borough", "code")


@query("incident_id:i dest_lat:f travel_seconds:d station_ground:s", "", """SELECT o_orderkey AS incident_id, CAST(o_totalprice AS DOUBLE) / 1000 AS dest_lat, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS travel_seconds, o_orderpriority AS station_ground FROM orders""")
def alias_normalise(spark, d):
    raw = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("incident_id"), (F.col("o_totalprice").cast("double") / 1000).alias("Latitude"), F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("FirstPumpArriving_AttendanceTime"), F.col("o_orderpriority").alias("IncidentStationGround"))
    return prep.with_aliases(raw).withColumn("travel_seconds", prep.number("travel_seconds"))


@query("name:s plain:s closed:s building:s titled:s", "n0 AS (SELECT n_name, concat('  ', n_name, '   Fire Station (Old) LFB ') AS name FROM nation)", r"""SELECT name, trim(regexp_replace(lower(trim(name)), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'), '\b(fire|station|stn|lfb)\b', ' ', 'g'), '\s+', ' ', 'g')) AS closed,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\([^)]*\)', '', 'g'), '\b(fire|station|stn|community|lfb|london fire brigade)\b', '', 'g'), '[^a-z ]', '', 'g'), '\s+', ' ', 'g')) AS building,
  list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda x: concat(upper(x[1]), x[2:])), 'string_agg', ' ') AS titled FROM n0""")
def name_normalise(spark, d):
    n = fx.table(spark, d, "nation").select("n_name", F.concat(F.lit("  "), "n_name", F.lit("   Fire Station (Old) LFB ")).alias("name"))
    c = F.col("name")
    return n.select("name", text.plain_name(c).alias("plain"), text.closed_name(c).alias("closed"), text.building_name(c).alias("building"), text.title(F.col("n_name")).alias("titled"))


@query("k:i least:d mean:d kph:d", "t0 AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN concat(CAST(p_size AS VARCHAR), ' mph') WHEN 1 THEN concat(CAST(p_size AS VARCHAR), ';', CAST(p_size + 7 AS VARCHAR), '.5') WHEN 2 THEN 'none' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE NULL END AS t FROM part)", r"""SELECT k, list_min(list_transform(regexp_extract_all(t, '\d+'), lambda x: CAST(x AS DOUBLE))) AS least, list_avg(list_transform(regexp_extract_all(t, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE))) AS mean,
  coalesce(try_cast(nullif(regexp_replace(string_split(lower(trim(t)), ' ')[1], '[^0-9.]', '', 'g'), '') AS DOUBLE) * CASE WHEN t LIKE '%mph%' THEN CAST(1.609344 AS DOUBLE) ELSE 1 END, CAST(32 AS DOUBLE)) AS kph FROM t0""")
def numbers_from_text(spark, d):
    n = F.col("p_size").cast("string")
    m = F.col("p_partkey") % 5
    t = F.when(m == 0, F.concat(n, F.lit(" mph"))).when(m == 1, F.concat(n, F.lit(";"), (F.col("p_size") + 7).cast("string"), F.lit(".5"))).when(m == 2, "none").when(m == 3, n)
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("k"), t.alias("t"))
    return p.select("k", text.least_number(F.col("t")).alias("least"), text.mean_number(F.col("t")).alias("mean"), text.limit_kph(F.col("t"), F.lit("other")).alias("kph"))


@query("p_size:i clock:s nice:d", "", "SELECT p_size, concat(CAST(p_size * 7 // 60 AS VARCHAR), ':', lpad(CAST(p_size * 7 % 60 AS VARCHAR), 2, '0')) AS clock, round(p_size * 123.0 / pow(10, floor(log10(p_size * 123.0)) - 1)) * pow(10, floor(log10(p_size * 123.0)) - 1) AS nice FROM (SELECT DISTINCT p_size FROM part)")
def label_formats(spark, d):
    s = fx.table(spark, d, "part").select("p_size").distinct()
    return s.select("p_size", text.minutes_seconds(F.col("p_size") * 7).alias("clock"), text.two_digits(F.col("p_size") * 123.0).alias("nice"))


# ---- summaries ----
@query("station_ground:s n_incidents:i n_busy:i busy_prob:d", INC, "SELECT station_ground, count(*) AS n_incidents, sum(CAST(station_ground <> deployed_from_station AS INT)) AS n_busy, avg(CAST(station_ground <> deployed_from_station AS INT)) AS busy_prob FROM inc WHERE station_ground IS NOT NULL GROUP BY 1")
def busy_by_station(spark, d):
    return summaries.busy_rates(fx.incidents(spark, d))


@query("station_ground:s hour_of_call:i n_incidents:i n_busy:i busy_prob:d", INC, "SELECT station_ground, hour_of_call, count(*) AS n_incidents, sum(CAST(station_ground <> deployed_from_station AS INT)) AS n_busy, avg(CAST(station_ground <> deployed_from_station AS INT)) AS busy_prob FROM inc WHERE station_ground IS NOT NULL GROUP BY 1, 2")
def busy_by_station_hour(spark, d):
    return summaries.busy_rates(fx.incidents(spark, d), "hour_of_call")


@query("hour_of_call:i pace:d turnout:d", TRIPS, "SELECT hour_of_call, quantile_cont(CASE WHEN road_km >= 1 THEN drive_s / road_km END, 0.5) AS pace, quantile_cont(turnout_s, 0.5) AS turnout FROM trips GROUP BY 1")
def hour_profile(spark, d):
    return summaries.hour_profile(_trips(spark, d))


@query("borough:s mean_s:d n:i", INC, "SELECT borough, avg(travel_seconds) AS mean_s, count(*) AS n FROM inc WHERE cal_year IN (1998, 1999) GROUP BY 1 HAVING count(*) >= 20")
def borough_attendance(spark, d):
    return summaries.group_means(fx.incidents(spark, d).where("cal_year IN (1998, 1999)"), "borough", "travel_seconds", 20)


@query("delay_code:s n:i share:d", MOB, "SELECT delay_code, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM mob) AS share FROM mob WHERE delay_code NOT IN ('Not held up', 'NULL') GROUP BY 1 HAVING count(*) >= 0.001 * (SELECT count(*) FROM mob)")
def delay_share(spark, d):
    return summaries.delay_shares(fx.mobilisations(spark, d))


@query("month:s median_s:d n:i", TRIPS, "SELECT CAST(date_trunc('month', date_of_call) AS DATE) AS month, quantile_cont(drive_s, 0.5) AS median_s, count(*) AS n FROM trips GROUP BY 1")
def monthly_median(spark, d):
    return summaries.monthly_median(_trips(spark, d))


@query("bin:i median_s:d n:i", TRIPS, "SELECT ceil(road_km / 0.5) AS bin, quantile_cont(drive_s, 0.5) AS median_s, count(*) AS n FROM trips WHERE road_km <= 10 GROUP BY 1")
def distance_bins(spark, d):
    return summaries.distance_bins(_trips(spark, d), "road_km", "drive_s")


@query("bin:i n:i", INC, "SELECT least(floor((travel_seconds - 0) / CAST(15 AS DOUBLE)), 79) AS bin, count(*) AS n FROM inc WHERE travel_seconds BETWEEN 0 AND 1200 GROUP BY 1")
def attendance_histogram(spark, d):
    return summaries.histogram(fx.incidents(spark, d), "travel_seconds", 0.0, 1200.0, 80)


@query("incident_group:s n:i share:d", INC, "SELECT incident_group, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM inc GROUP BY 1")
def incident_mix(spark, d):
    return summaries.shares(fx.incidents(spark, d), "incident_group")


@query("hour_of_call:i n:i", INC, "SELECT h AS hour_of_call, count(incident_id) AS n FROM range(24) r(h) LEFT JOIN (SELECT * FROM inc WHERE hour_of_call < 20) ON hour_of_call = h GROUP BY 1")
def hour_zero_fill(spark, d):
    return summaries.every_hour(fx.incidents(spark, d).where("hour_of_call < 20"))


@query("cal_year:i n:i", INC, "SELECT cal_year, count(*) AS n FROM inc GROUP BY 1")
def year_counts(spark, d):
    return fx.incidents(spark, d).groupBy("cal_year").agg(F.count("*").alias("n"))


@query("n:i median_drive_s:d median_turnout_s:d median_road_km:d years:s days:i per_day:d sd_drive_s:d p2_5:d p97_5:d", TRIPS, "SELECT count(*) AS n, quantile_cont(drive_s, 0.5) AS median_drive_s, quantile_cont(turnout_s, 0.5) AS median_turnout_s, quantile_cont(road_km, 0.5) AS median_road_km, string_agg(DISTINCT CAST(cal_year AS VARCHAR), ',' ORDER BY CAST(cal_year AS VARCHAR)) AS years, max(date_of_call) - min(date_of_call) + 1 AS days, CAST(count(*) AS DOUBLE) / (max(date_of_call) - min(date_of_call) + 1) AS per_day, stddev_samp(drive_s) AS sd_drive_s, quantile_cont(drive_s, 0.025) AS p2_5, quantile_cont(drive_s, 0.975) AS p97_5 FROM trips")
def overview(spark, d):
    return summaries.overview(_trips(spark, d)).withColumn("years", F.array_join("years", ","))


@query("bin:i value:d median_of:d n:i", TRIPS, "SELECT bin, quantile_cont(road_km, 0.5) AS value, quantile_cont(drive_s, 0.5) AS median_of, count(*) AS n FROM (SELECT *, floor((row_number() OVER (ORDER BY road_km, incident_id, pump_order) - 1) * 20 / count(*) OVER ()) AS bin FROM trips) GROUP BY 1")
def quantile_bins(spark, d):
    rows = _trips(spark, d).withColumn("key", F.struct("incident_id", "pump_order"))
    return summaries.quantile_bins(rows, "road_km", "drive_s", "key")


def _base_sql() -> str:
    c = lambda x: f"least(greatest({x}, CAST(30 AS DOUBLE)), CAST(1200 AS DOUBLE))"
    models = {"constant": c("CAST(600 AS DOUBLE)"), "straight_32": c("crow_km / 32 * 3600"), "road_speed": c("road_km / 35 * 3600"), "curve_crow": c(fx.curve_sql("crow_km")), "curve_road": c(fx.curve_sql("road_km"))}
    return " UNION ALL ".join(f"SELECT '{m}' AS model, avg(abs({x} - drive_s)) AS mae, quantile_cont(abs({x} - drive_s), 0.5) AS median_ae, avg({x} - drive_s) AS bias FROM trips WHERE cal_year = 2000" for m, x in models.items())


@query("model:s mae:d median_ae:d bias:d", TRIPS, _base_sql())
def baseline_mae(spark, d):
    rows = summaries.baselines(_trips(spark, d).where("cal_year = 2000"), 600.0, 35.0)
    return summaries.errors(rows, "drive_s", ["constant", "straight_32", "road_speed", "curve_crow", "curve_road"])


@query("part:s mae:d bias:d n:i", INC + f""", lo AS (SELECT i.*, coalesce(a.lat, b.lat) AS s_lat, coalesce(a.lon, b.lon) AS s_lon FROM inc i LEFT JOIN st a ON a.facilityname = deployed_from_station LEFT JOIN st b ON b.facilityname = station_ground),
lt AS (SELECT *, {HAV('s_lon', 's_lat', 'dest_lon', 'dest_lat', 6371.0088)} AS km, least(greatest(travel_seconds - 60, CAST(30 AS DOUBLE)), CAST(1200 AS DOUBLE)) AS drive_s, CASE WHEN station_ground IS NOT NULL AND station_ground <> deployed_from_station THEN 1 ELSE 0 END AS busy FROM lo),
le AS (SELECT *, {fx.curve_sql('km')} - drive_s AS e FROM lt WHERE km > 0 AND km <= 25 AND travel_seconds IS NOT NULL)""", "SELECT 'all' AS part, avg(abs(e)) AS mae, avg(e) AS bias, count(*) AS n FROM le UNION ALL SELECT 'non_busy', avg(abs(e)), avg(e), count(*) FROM le WHERE busy = 0")
def held_out_errors(spark, d):
    st, inc = _parts(spark, d)
    rows = prep.trips_with_origin(inc, st).where("drive_s IS NOT NULL").withColumn("busy", prep.away_strict(F.col("station_ground"), F.col("deployed_from_station")))
    e = rows.withColumn("e", times.DEFAULT_CURVE.seconds(F.col("crow_km")) - F.col("drive_s"))
    each = e.withColumn("part", F.explode(F.when(F.col("busy") == 0, F.array(F.lit("all"), F.lit("non_busy"))).otherwise(F.array(F.lit("all")))))
    return each.groupBy("part").agg(F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.count("*").alias("n"))


# ---- grids, snapping, quantiles ----
CELL = "cell_id:i ix:i iy:i n_incidents:i weight:d lat:f lon:f share:d"


@query(CELL, INC + _grid_sql(0.9), "SELECT * FROM cells")
def demand_grid(spark, d):
    return spatial.demand_grid(fx.incidents(spark, d), 0.9)


@query(CELL, INC + _grid_sql(2.0, "1 + (CAST(max(severity) OVER () AS DOUBLE) - severity) / max(severity) OVER ()"), "SELECT * FROM cells WHERE n_incidents >= 2")
def demand_grid_severity(spark, d):
    return spatial.demand_grid(fx.incidents(spark, d), 2.0, severity="severity").where("n_incidents >= 2")


@query("candidate_id:i site_name:s layer:s lat:f lon:f", CAND, "SELECT * FROM cand")
def candidates(spark, d):
    return spatial.candidates(fx.stations(spark, d), _cells(spark, d), 20)


@query("site_id:i cell_id:i drive_s:d crow_s:d", CAND, f"SELECT candidate_id AS site_id, cell_id, greatest({fx.curve_sql(HAV('c.lon', 'c.lat', 'x.lon', 'x.lat'))}, CAST(15 AS DOUBLE)) AS drive_s, 15 + {HAV('c.lon', 'c.lat', 'x.lon', 'x.lat')} * CAST(1.3 AS DOUBLE) / 28 * 3600 AS crow_s FROM cand c CROSS JOIN cells x")
def travel_matrix(spark, d):
    cells = _cells(spark, d)
    sites = spatial.candidates(fx.stations(spark, d), cells, 20)
    crow = spatial.travel_matrix(sites, cells, "crow").withColumnRenamed("drive_s", "crow_s").drop("w")
    return spatial.travel_matrix(sites, cells).join(crow, ["site_id", "cell_id"])


@query("incident_id:i km:d", GRID + ", l0 AS (SELECT avg(lat) AS lat0 FROM cells)", "SELECT incident_id, min(sqrt(pow((c.lon - dest_lon) * 111.32 * cos(radians(lat0)), 2) + pow((c.lat - dest_lat) * 110.574, 2))) AS km FROM inc CROSS JOIN cells c CROSS JOIN l0 WHERE dest_lat IS NOT NULL GROUP BY 1")
def snap_to_cells(spark, d):
    return spatial.snap_to_cells(fx.incidents(spark, d), _cells(spark, d))


@query("incident_id:i", INC + ", mid AS (SELECT quantile_cont(lat, 0.5) AS la, quantile_cont(lon, 0.5) AS lo FROM st)", f"SELECT incident_id FROM inc CROSS JOIN mid WHERE {HAV('dest_lon', 'dest_lat', 'lo', 'la')} <= 18")
def drop_far(spark, d):
    st, inc = _parts(spark, d)
    return spatial.drop_far(inc, st, 18.0)


CELL_RESP = GRID + f", cr AS (SELECT cell_id, max(weight) AS w, round(min({fx.curve_sql(HAV('s.lon', 's.lat', 'c.lon', 'c.lat'))}) + 60, 6) AS response_s FROM cells c CROSS JOIN st s GROUP BY cell_id)"


def _cell_responses(spark, d):
    cells = _cells(spark, d)
    m = spatial.travel_matrix(fx.stations(spark, d).select(F.col("station_id").alias("candidate_id"), "lat", "lon"), cells)
    km = m.groupBy("cell_id").agg(F.max("w").alias("w"), F.min("drive_s").alias("s"))
    return km.select("cell_id", "w", F.round(F.col("s") + 60.0, 6).alias("response_s"))


_QS = """qs AS (SELECT *, coalesce(lag(x) OVER (ORDER BY x), x) AS px, coalesce(lag(cw) OVER (ORDER BY x), cw) AS pw FROM (SELECT response_s AS x, sum(sum(w)) OVER (ORDER BY response_s) AS cw, sum(sum(w)) OVER () AS tw FROM cr GROUP BY response_s)),
q2 AS (SELECT q, first(CASE WHEN cw = pw THEN x ELSE px + (q * tw - pw) / (cw - pw) * (x - px) END ORDER BY x) AS v FROM qs CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) v(q) WHERE cw >= q * tw GROUP BY q)"""


@query("expected_response_s:d worst_cell_response_s:d coverage_share:d demand_cells:i median_response_s:d p90_response_s:d", CELL_RESP.replace("round(min(", "greatest(round(min(").replace("+ 60, 6)", "+ 60, 6), CAST(75 AS DOUBLE))") + ", " + _QS, "SELECT sum(w * response_s) / sum(w) AS expected_response_s, max(response_s) AS worst_cell_response_s, sum(CASE WHEN response_s <= 480 THEN w ELSE 0 END) / sum(w) AS coverage_share, count(*) AS demand_cells, (SELECT v FROM q2 WHERE q = 0.5) AS median_response_s, (SELECT v FROM q2 WHERE q = 0.9) AS p90_response_s FROM cr")
def posture_metrics(spark, d):
    return weighted.posture_metrics(_cell_responses(spark, d))


@query("value:f share:f", RESP, "SELECT response_s AS value, sum(count(*)) OVER (ORDER BY response_s) / sum(count(*)) OVER () AS share FROM resp GROUP BY response_s")
def weighted_ecdf(spark, d):
    return weighted.ecdf(_response(spark, d).withColumn("w", F.lit(1.0)))


# ---- choosing sites ----
def _greedy_sql(k: int, term: str, big: str) -> str:
    out, chosen = [], []
    for i in range(k):
        best = f"(SELECT cell_id, min(t) AS best FROM tm WHERE site_id IN (SELECT site_id FROM p{i - 1}) GROUP BY cell_id)" if i else None
        t = "least(t, best)" if i else "t"
        join = f"JOIN {best} b USING (cell_id) WHERE site_id NOT IN (SELECT site_id FROM p{i - 1})" if i else ""
        pick = f"SELECT site_id FROM (SELECT site_id, round(sum(w * {term.replace('$', t)}), 6) AS cost FROM tm {join} GROUP BY site_id) ORDER BY cost, site_id LIMIT 1"
        out.append(f"k{i} AS ({pick}), p{i} AS (SELECT * FROM k{i}{f' UNION ALL SELECT * FROM p{i - 1}' if i else ''})")
        chosen.append(f"SELECT {i} AS step, site_id FROM k{i}")
    return ", " + ", ".join(out), " UNION ALL ".join(chosen)


def _steps(spark, chosen):
    return spark.createDataFrame([(i, int(s)) for i, s in enumerate(chosen)], "step int, site_id long")


_G3, _G3_BODY = _greedy_sql(3, "$", "")
_C2, _C2_BODY = _greedy_sql(2, "CASE WHEN $ <= 480 THEN -1 ELSE 0 END", "")


@query("step:i site_id:i", WHOLE + _G3, _G3_BODY)
def greedy_k3(spark, d):
    return _steps(spark, facility.greedy(_all_times(spark, d)[0], 3))


@query("step:i site_id:i", WHOLE + _C2, _C2_BODY)
def coverage_greedy_k2(spark, d):
    return _steps(spark, facility.greedy(_all_times(spark, d)[0], 2, facility.COVERAGE))


#: Of every cell the nearest existing site, its time and the next one's; and what each swap of an existing for another site gives.
_SWAPS = WHOLE + """, wr AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY t, site_id) AS r FROM tm WHERE layer = 'existing_firehouse'),
tn AS (SELECT cell_id, max(w) AS w, max(CASE WHEN r = 1 THEN site_id END) AS n1, max(CASE WHEN r = 1 THEN t END) AS d1, coalesce(max(CASE WHEN r = 2 THEN t END), CAST(1e12 AS DOUBLE)) AS d2 FROM wr GROUP BY cell_id),
sw AS (SELECT o.site_id AS out_site, i.site_id AS in_site, round(sum(tn.w * least(i.t, CASE WHEN n1 = o.site_id THEN d2 ELSE d1 END)) / sum(tn.w), 9) AS value FROM (SELECT DISTINCT site_id FROM wr) o CROSS JOIN tn JOIN tm i ON i.cell_id = tn.cell_id AND i.layer <> 'existing_firehouse' GROUP BY 1, 2)"""


@query("out_site:i in_site:i value:d", _SWAPS, "SELECT * FROM sw")
def best_swap(spark, d):
    return facility.swap_values(*_all_times(spark, d))


@query("out_site:i in_site:i value:d", _SWAPS, "SELECT * FROM (SELECT out_site, in_site, value FROM sw ORDER BY round(value, 9), out_site, in_site LIMIT 1) WHERE value < (SELECT sum(w * d1) / sum(w) FROM tn) - 1e-9")
def replace_r1(spark, d):
    c = facility.replace(*_all_times(spark, d), 1)
    return spark.createDataFrame([(o, i, c.value) for o, i in c.swaps], "out_site long, in_site long, value double")


@query("value:d", _SWAPS, "SELECT min(value) AS value FROM (SELECT sum(tn.w * least(d1, a.t, b.t)) / sum(tn.w) AS value FROM tm a JOIN tm b ON a.cell_id = b.cell_id AND a.site_id < b.site_id AND b.layer <> 'existing_firehouse' JOIN tn ON tn.cell_id = a.cell_id WHERE a.layer <> 'existing_firehouse' GROUP BY a.site_id, b.site_id)")
def expand_m2(spark, d):
    c = facility.expand(*_all_times(spark, d), 2)
    return spark.createDataFrame([(c.value,)], "value double")


@query("site_id:i assigned_demand:d assigned_share:d", WHOLE, "SELECT s.site_id, coalesce(sum(w), 0) AS assigned_demand, coalesce(sum(w), 0) / (SELECT sum(weight) FROM cells) AS assigned_share FROM (SELECT DISTINCT site_id FROM tm WHERE layer = 'existing_firehouse') s LEFT JOIN (SELECT cell_id, w, site_id FROM tm WHERE layer = 'existing_firehouse' QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY t, site_id) = 1) c ON c.site_id = s.site_id GROUP BY 1")
def assigned_demand(spark, d):
    return facility.assigned(*_all_times(spark, d))


@query("site_id:i", CAND, "SELECT candidate_id AS site_id FROM cand ORDER BY md5(concat('0:', CAST(candidate_id AS VARCHAR))) LIMIT 4")
def random_baseline(spark, d):
    return facility.at_random(_all_times(spark, d)[0].select("site_id").distinct(), 4)


@query("cell_id:i response_s:d", WHOLE, """SELECT cell_id, max(CASE WHEN r = 1 THEN (1 - p) * t END) + max(CASE WHEN r = 2 THEN t END) * max(CASE WHEN r = 1 THEN p END) AS response_s FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY t, site_id) AS r, CAST(site_id % 5 AS DOUBLE) / 10 AS p FROM tm WHERE layer = 'existing_firehouse') GROUP BY 1""")
def busy_blend_response(spark, d):
    t, sites = _all_times(spark, d)
    p = spark.range(len(sites)).select(F.col("id").alias("site_id"), ((F.col("id") % 5).cast("double") / 10).alias("busy_prob"))
    return facility.responses(t, sites, p)


@query("label:s mode:s value:d n_swaps:i expected_response_s:d median_response_s:d p90_response_s:d coverage_share:d mean_s:d p90_s:d")
def plan_summary(spark, d):
    st, inc = _parts(spark, d)
    return planner.plan(inc, st, "expand", 2, demand_years=TRAIN, eval_years=TEST).summary


@query("plan_rank:i site_name:s assigned_share:d")
def redesign(spark, d):
    st, inc = _parts(spark, d)
    return planner.plan(inc, st, "redesign", 3).selected


# ---- scenarios ----
_CLOSED = "cl(pos, name, lat, lon) AS (VALUES " + ", ".join(f"({i}, '{n}', CAST({a} AS DOUBLE), CAST({o} AS DOUBLE))" for i, (n, (a, o)) in enumerate(scenario.CLOSED_2014.items())) + ")"
_TAKEN = ", cd AS (SELECT pos, station_id, round(" + HAV("cl.lon", "cl.lat", "st.lon", "st.lat", 6371.0088) + ", 9) AS km FROM cl CROSS JOIN st), " + ", ".join(f"t{i} AS (SELECT station_id FROM cd WHERE pos = {i}" + "".join(f" AND station_id NOT IN (SELECT station_id FROM t{j})" for j in range(i)) + " ORDER BY km, station_id LIMIT 1)" for i in range(10)) + ", gone AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(10)) + ")"
_NETS = NEAR + ", " + _CLOSED + _TAKEN + f""", nets AS (SELECT 'current' AS network, lat AS s_lat, lon AS s_lon FROM st UNION ALL SELECT 'minus_10_nearest', lat, lon FROM st WHERE station_id NOT IN (SELECT station_id FROM gone) UNION ALL SELECT 'plus_10_restored', lat, lon FROM st UNION ALL SELECT 'plus_10_restored', lat, lon FROM cl),
pts0 AS (SELECT * FROM pts WHERE cal_year = 2000), nk AS (SELECT network, incident_id, min({HAV('lon', 'lat', 's_lon', 's_lat', 6371.0088)}) AS km FROM pts0 CROSS JOIN nets GROUP BY 1, 2), nr AS (SELECT network, round({fx.curve_sql('km')} + 60, 6) AS response_s FROM nk)"""


def _points_2000(spark, d):
    return spatial.points_of(fx.incidents(spark, d).where("cal_year = 2000"))


@query("network:s " + SCORE, _NETS, _score_sql("nr", "network"))
def counterfactual_networks(spark, d):
    st, closed = fx.stations(spark, d).where("station_id >= 0"), scenario.closed_sites(spark)
    return scenario.network_scores(_points_2000(spark, d), scenario.networks(st, closed, scenario.nearest_untaken(closed, st)))


@query("name:s mean_seconds_saved:d total_hours_saved:d incidents_improved_pct:d mean_saved_when_improved_s:d p90_s_after:d within_6min_gain_pp:d nearest_current_station_km:d rank:i", NEAR + ", " + _CLOSED + f""", rr AS (SELECT name, round({fx.curve_sql('n.km')} + 60, 6) AS b, round({fx.curve_sql('least(n.km, ' + HAV('p.lon', 'p.lat', 'cl.lon', 'cl.lat', 6371.0088) + ')')} + 60, 6) AS a FROM pts p JOIN near n USING (incident_id) CROSS JOIN cl WHERE cal_year = 2000),
rs AS (SELECT name, avg(b - a) AS mean_seconds_saved, sum(b - a) / 3600 AS total_hours_saved, avg(CASE WHEN b - a > 1e-6 THEN 100.0 ELSE 0 END) AS incidents_improved_pct, coalesce(avg(CASE WHEN b - a > 1e-6 THEN b - a END), 0) AS mean_saved_when_improved_s, quantile_cont(a, 0.9) AS p90_s_after, (avg(CASE WHEN a <= 360 THEN 1.0 ELSE 0 END) - avg(CASE WHEN b <= 360 THEN 1.0 ELSE 0 END)) * 100 AS within_6min_gain_pp FROM rr GROUP BY 1)""", f"SELECT rs.*, (SELECT min({HAV('cl.lon', 'cl.lat', 'st.lon', 'st.lat', 6371.0088)}) FROM cl CROSS JOIN st WHERE cl.name = rs.name) AS nearest_current_station_km, row_number() OVER (ORDER BY round(mean_seconds_saved, 6) DESC, name) AS rank FROM rs")
def restore_ranking(spark, d):
    return scenario.restore_ranking(_points_2000(spark, d), fx.stations(spark, d), scenario.closed_sites(spark))


_RACE = INC + ", " + _CLOSED + f""", nw AS (SELECT pos AS new_id, lat AS n_lat, lon AS n_lon FROM cl WHERE lon BETWEEN -0.2 AND 0.1 AND lat BETWEEN 51.4 AND 51.6),
ol AS (SELECT new_id, n_lat, n_lon, station_id AS old_id, lat AS o_lat, lon AS o_lon FROM (SELECT *, round({HAV('n_lon', 'n_lat', 'lon', 'lat')}, 9) AS km, row_number() OVER (PARTITION BY new_id ORDER BY round({HAV('n_lon', 'n_lat', 'lon', 'lat')}, 9), station_id) AS r FROM nw CROSS JOIN st
  WHERE lon BETWEEN -0.22 AND 0.12 AND lat BETWEEN 51.38 AND 51.62 AND round({HAV('n_lon', 'n_lat', 'lon', 'lat')}, 9) > 0.6 AND round({HAV('n_lon', 'n_lat', 'lon', 'lat')}, 9) < 3.5) WHERE r = 1),
rw AS (SELECT new_id, old_id, incident_id, round({HAV('n_lon', 'n_lat', 'dest_lon', 'dest_lat')}, 9) AS d_new, round(round({HAV('o_lon', 'o_lat', 'dest_lon', 'dest_lat')}, 9) - round({HAV('n_lon', 'n_lat', 'dest_lon', 'dest_lat')}, 9), 9) AS gain FROM inc CROSS JOIN ol WHERE dest_lon BETWEEN -0.2 AND 0.1 AND dest_lat BETWEEN 51.4 AND 51.6)"""
_RACE_BODY = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY gain DESC, d_new, incident_id) AS r FROM rw WHERE d_new < 1.8 AND gain > 0.35) WHERE r = 1"


@query("new_id:i old_id:i incident_id:i gain:d d_new:d", _RACE, _RACE_BODY)
def race_scenario(spark, d):
    st, inc = _parts(spark, d)
    new = scenario.closed_sites(spark).select(F.col("at").alias("new_id"), "lat", "lon")
    return scenario.race(new, st, inc, (-0.2, 51.4, 0.1, 51.6))


_CL = "cl(pos, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(scenario.CLOSED_2014)) + ")"
_NAMES = ST + ", " + _CL + ", nm AS (SELECT CASE station_id % 4 WHEN 0 THEN facilityname WHEN 1 THEN concat(c.name, ' Fire Station') ELSE concat('Old ', c.name, ' (', CAST(station_id % 3 AS VARCHAR), ')') END AS name, c.name AS is_of, station_id % 4 AS kind FROM st JOIN cl c ON c.pos = station_id % 10 AND c.pos < 7)"


def _closed_names(spark, d):
    """Names of stations, some of which are those of closed sites in other words."""
    closed = scenario.closed_sites(spark)
    st = fx.stations(spark, d).join(F.broadcast(closed.select("at", F.col("name").alias("closed"))), (F.col("at") == F.col("station_id") % 10) & (F.col("at") < 7))
    kind = F.col("station_id") % 4
    return st.select(F.when(kind == 0, F.col("facilityname")).when(kind == 1, F.concat("closed", F.lit(" Fire Station"))).otherwise(F.concat(F.lit("Old "), "closed", F.lit(" ("), (F.col("station_id") % 3).cast("string"), F.lit(")"))).alias("name"))


@query("name:s closed:s tier:i", _NAMES, "SELECT DISTINCT name, is_of AS closed, CASE kind WHEN 1 THEN 1 ELSE 2 END AS tier FROM nm WHERE kind > 0")
def closed_name_match(spark, d):
    return scenario.closed_matches(_closed_names(spark, d), scenario.closed_sites(spark))


# ---- fitting ----
@query("intercept:d slope:d", TRIPS, "SELECT regr_intercept(drive_s, road_km) AS intercept, regr_slope(drive_s, road_km) AS slope FROM trips")
def ols_line(spark, d):
    return fitting.ols_line(_trips(spark, d), "road_km", "drive_s")


_PAIRSQ = INC + ", " + MOB + f""", kp0 AS (SELECT m.incident_id, pump_order, {HAV('s.lon', 's.lat', 'dest_lon', 'dest_lat')} AS km FROM mob m JOIN inc i USING (incident_id) JOIN st s ON s.facilityname = i.deployed_from_station),
kp AS (SELECT km, 60 + 75 * km + ((incident_id * 31 + pump_order * 17) % 61 - 30) AS z FROM kp0 WHERE km > 0),
qb AS (SELECT DISTINCT unnest(quantile_cont(km, [""" + ", ".join(f"{0.05 + 0.55 * i / 24!r}" for i in range(25)) + """])) AS bp FROM kp),
kf AS (SELECT bp, regr_intercept(z, sqrt(km)) FILTER (km <= bp) AS a, regr_slope(z, sqrt(km)) FILTER (km <= bp) AS b, regr_intercept(z, km) FILTER (km > bp) AS c, regr_slope(z, km) FILTER (km > bp) AS e FROM kp CROSS JOIN qb WHERE z > 0 GROUP BY bp HAVING count(*) FILTER (km <= bp) >= 20 AND count(*) FILTER (km > bp) >= 20),
kl AS (SELECT bp, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(e) AS e, round(sum(abs(z - CASE WHEN km <= bp THEN a + b * sqrt(km) ELSE c + e * km END)), 6) AS loss FROM kf JOIN kp ON z > 0 GROUP BY bp)"""


def _curve_pairs(spark, d):
    st, inc = _parts(spark, d)
    place = st.select(F.col("facilityname").alias("deployed_from_station"), "lat", "lon")
    rows = fx.mobilisations(spark, d).join(inc, "incident_id").join(F.broadcast(place), "deployed_from_station")
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("dest_lon"), F.col("dest_lat"))
    return rows.select(km.alias("km"), (60 + 75 * km + ((F.col("incident_id") * 31 + F.col("pump_order") * 17) % 61 - 30)).alias("seconds"))


def _curve_row(spark, c):
    return spark.createDataFrame([(c.a, c.b, c.c, c.e, c.breakpoint_km)], "a double, b double, c double, e double, bp double")


@query("a:d b:d c:d e:d bp:d", _PAIRSQ, "SELECT * FROM kl ORDER BY loss, bp LIMIT 1")
def kolesar_grid_ols(spark, d):
    return _curve_row(spark, fitting.fit_curve(_curve_pairs(spark, d), robust=False))


@query("a:d b:d c:d e:d bp:d")
def kolesar_robust(spark, d):
    return _curve_row(spark, fitting.fit_curve(_curve_pairs(spark, d)))


_OWN = INC + f", op AS (SELECT lower(s.facilityname) AS station, {HAV('lon', 'lat', 'dest_lon', 'dest_lat')} AS km, travel_seconds AS observed_s FROM inc i JOIN st s ON s.facilityname = station_ground WHERE station_ground = deployed_from_station AND travel_seconds IS NOT NULL AND dest_lat IS NOT NULL), oq AS (SELECT * FROM op WHERE km BETWEEN 0.05 AND 40 AND observed_s BETWEEN 60 AND 1800)"


@query("station:s turnout_s:d n:i", _OWN, f"SELECT station, least(greatest(60 + quantile_cont(observed_s - 60 - {fx.curve_sql('km')}, 0.5), CAST(30 AS DOUBLE)), CAST(180 AS DOUBLE)) AS turnout_s, count(*) AS n FROM oq GROUP BY 1 HAVING count(*) >= 20")
def turnout_prior(spark, d):
    return fitting.station_turnout(prep.own_station_pairs(fx.incidents(spark, d), fx.stations(spark, d)))


@query("name:s coefficient:d")
def pace_regression(spark, d):
    return fitting.pace_regression(_trips(spark, d))


@query("name:s low:d high:d")
def bootstrap_ci(spark, d):
    return fitting.bootstrap(_trips(spark, d))


# ---- streets ----
def _streets(spark, d, side=None):
    """The street grid with the attributes that features and costs read."""
    e = fx.edges(spark, d, side)
    side = side or fx.grid_side(spark, d)[0]
    kinds = F.array(*[F.lit(x) for x in ("primary", "residential", "trunk", "tertiary", "service", "secondary_link")])
    highway = F.element_at(kinds, (F.col("u") % 6 + 1).cast("int"))
    xy = lambda n: F.struct((F.lit(-0.1) + (F.col(n) % side) * 0.001).alias("x"), (F.lit(51.5) + F.floor(F.col(n) / side) * 0.001).alias("y"))
    return e.select("u", "v", F.lit(0).alias("key"), "length", highway.alias("hw"), F.array(highway).alias("highway"), "oneway", F.when(F.col("u") % 4 > 0, F.concat(F.col("maxspeed").cast("string"), F.lit(" mph"))).alias("maxspeed"), F.when(F.col("v") % 3 == 0, "2;3").alias("lanes"),
        F.when(F.col("u") % 11 == 0, "no").alias("bridge"), F.lit(None).cast("string").alias("tunnel"), F.when(F.col("v") % 13 == 0, "roundabout").alias("junction"), F.array(F.col("u") * 1000 + F.col("v")).alias("osmid"), F.array(xy("u"), xy("v")).alias("geometry"),
        (F.col("u") % 7 == 3).alias("contraflow"), (F.col("u") % 17 == 5).alias("busway"), (F.col("v") % 19 == 4).alias("noexit"))


def _points(spark, d, side=None):
    side, size = fx.grid_side(spark, d) if side is None else (side, side * side)
    n = spark.range(size).select(F.col("id").alias("n"))
    return n.select((F.lit(-0.1) + (F.col("n") % side) * 0.001).alias("lon"), (F.lit(51.5) + F.floor(F.col("n") / side) * 0.001).alias("lat"), F.when(F.col("n") % 5 == 0, "traffic_signals").when(F.col("n") % 5 == 1, "crossing").when(F.col("n") % 5 == 2, "stop").alias("highway"), F.lit(None).cast("string").alias("crossing"), F.when(F.col("n") % 5 == 3, "hump").when(F.col("n") % 5 == 4, "no").alias("traffic_calming"))


_SE = ED + """, se AS (SELECT u, v, length, oneway, (['primary', 'residential', 'trunk', 'tertiary', 'service', 'secondary_link'])[CAST(u % 6 + 1 AS INT)] AS hw, CASE WHEN u % 4 > 0 THEN maxspeed END AS mph FROM ed),
sf AS (SELECT *, CASE hw WHEN 'trunk' THEN 'major' WHEN 'primary' THEN 'primary' WHEN 'secondary_link' THEN 'secondary' WHEN 'tertiary' THEN 'tertiary' WHEN 'residential' THEN 'residential' ELSE 'minor' END AS road_class, CASE WHEN v % 3 = 0 THEN 2.5 END AS lanes, u % 11 = 0 AS bt, v % 13 = 0 AS rb, (u * 1000 + v) % 2 = 0 AS bl FROM se)"""


def _features(spark, d, side=None):
    streets = _streets(spark, d, side)
    bus = streets.select(F.explode("osmid").alias("osmid")).where("osmid % 2 = 0").distinct()
    return graph.edge_features(streets, _points(spark, d, side), bus)


_EF_BODY = """SELECT u, v, length, road_class, mph AS maxspeed_mph, lanes, bt AS bridge_tunnel, rb AS roundabout, bl AS bus_lane, CAST(v % 5 = 0 AS INT) AS signals, CAST(v % 5 = 3 AS INT) AS calming, CAST(v % 5 = 1 AS INT) AS crossing, CAST(v % 5 = 2 AS INT) AS give_way, CASE v - u WHEN 1 THEN 90 WHEN (SELECT side FROM gr) THEN 0 WHEN -1 THEN 270 ELSE 180 END AS bearing_start FROM sf"""


@query("u:i v:i length:d road_class:s maxspeed_mph:d lanes:d bridge_tunnel:s roundabout:s bus_lane:s signals:i calming:i crossing:i give_way:i bearing_start:d", _SE, _EF_BODY)
def edge_features(spark, d):
    return _features(spark, d).withColumn("bearing_start", F.pmod(F.round("bearing_start", 3), F.lit(360.0)))


_COST = """CASE WHEN u % 7 = 3 AND length > 80 THEN CAST(1e12 AS DOUBLE) WHEN u % 7 = 3 THEN length / 1000 / k * 3600 + 12 ELSE length / 1000 / k * 3600 END
  * CASE WHEN hw IN ('residential', 'service') THEN CAST(1.12 AS DOUBLE) WHEN hw IN ('trunk', 'primary') OR u % 17 = 5 THEN CAST(0.94 AS DOUBLE) ELSE 1 END * CASE WHEN v % 19 = 4 THEN CAST(1.35 AS DOUBLE) ELSE 1 END"""


_EC_BODY = f"SELECT u, v, {_COST} AS cost_s FROM (SELECT *, CAST(coalesce(least(greatest(mph, 15), 70), 35) AS DOUBLE) AS k FROM se)"


@query("u:i v:i cost_s:d", _SE, _EC_BODY)
def edge_cost_policy(spark, d):
    return graph.engine_cost(_streets(spark, d).drop("highway").withColumnRenamed("hw", "highway"))


_SS_BODY = "SELECT u, v, least(greatest(CAST(1.4 AS DOUBLE) * 3600 / CASE WHEN mph IS NOT NULL THEN mph * CAST(1.609344 AS DOUBLE) WHEN hw = 'trunk' THEN 96 WHEN hw IN ('primary', 'tertiary', 'secondary_link') THEN 48 ELSE 32 END, CAST(30 AS DOUBLE)), CAST(720 AS DOUBLE)) AS slowness FROM se"


@query("u:i v:i slowness:d", _SE, _SS_BODY)
def segment_slowness(spark, d):
    rows, cols, _ = graph.segment_features(_streets(spark, d).drop("highway").withColumnRenamed("hw", "highway").withColumn("width", F.lit(None).cast("string")), F.lit(8))
    return rows.withColumn("slowness", graph.slowness(cols, graph.prior_weights()))


def _origins(spark, d):
    """Every node whose number is divisible by 20."""
    return fx.table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").cast("long").alias("origin"))


ORIGINS = "SELECT CAST(p_partkey AS BIGINT) AS o FROM part WHERE p_partkey % 20 = 0"


def paths_sql(origins: str, edges: str, cost: str) -> str:
    """Recursive SQL for the least cost from each origin to each node: a row is made anew only where it gets nearer."""
    return f"""sp(origin, node, dist) USING KEY (origin, node) AS (SELECT o, o, CAST(0 AS DOUBLE) FROM ({origins})
  UNION SELECT s.origin, e.v, min(s.dist + e.{cost}) FROM sp s JOIN {edges} e ON e.u = s.node LEFT JOIN recurring.sp k ON k.origin = s.origin AND k.node = e.v WHERE k.dist IS NULL OR s.dist + e.{cost} < k.dist GROUP BY 1, 2)"""


_SP_BODY = f"WITH RECURSIVE {paths_sql(ORIGINS, 'ed', 'length')} SELECT origin, node, dist, dist AS length FROM sp"


@query("origin:i node:i dist:d", ED, _SP_BODY)
def shortest_paths(spark, d):
    return graph.shortest_paths(fx.edges(spark, d, None), _origins(spark, d))


@query("origin:i node:i dist:d", ED, _SP_BODY)
def paths_by_origin(spark, d):
    return graph.search_by_origin(fx.edges(spark, d, None), _origins(spark, d))


@query("origin:i node:i length:d", ED, _SP_BODY)
def tree_sums(spark, d):
    return graph.search_by_origin(fx.edges(spark, d, None), _origins(spark, d), values=["length"])


_RATIOS = "share_major:d share_residential:d share_oneway:d share_20mph:d share_bus_lane:d share_bridge_tunnel:d mean_lanes:d junctions_per_km:d roundabouts_per_km:d signals_per_km:d"


_ER_BODY = """SELECT u AS origin, v AS node, CAST(road_class = 'major' AS INT) AS share_major, CAST(road_class = 'residential' AS INT) AS share_residential, CAST(oneway AS INT) AS share_oneway, CAST(coalesce(mph <= 20, false) AS INT) AS share_20mph, CAST(bl AS INT) AS share_bus_lane, CAST(bt AS INT) AS share_bridge_tunnel, lanes AS mean_lanes, 1000 / length AS junctions_per_km, CAST(rb AS INT) * 1000 / length AS roundabouts_per_km, CAST(v % 5 = 0 AS INT) * 1000 / length AS signals_per_km FROM sf"""


@query("origin:i node:i " + _RATIOS, _SE, _ER_BODY)
def edge_ratios(spark, d):
    return graph.route_ratios(graph.route_values(_features(spark, d)).withColumnRenamed("u", "origin").withColumnRenamed("v", "node"))


@query("origin:i node:i " + _RATIOS + " n_turns:i")
def route_ratios(spark, d):
    e = graph.route_values(_features(spark, d, None))
    return graph.route_ratios(graph.search_by_origin(e, _origins(spark, d), values=graph.ROUTE_VALUES, last_turns=True), ["n_turns"])


@query("node:i")
def largest_scc(spark, d):
    return graph.largest_component(fx.edges(spark, d, None))


@query("name:s weight:d")
def segment_fit(spark, d):
    """The speed model fitted to single edges whose times are the prior's with a tenth more."""
    rows, cols, names = graph.segment_features(_streets(spark, d, None).drop("highway").withColumnRenamed("hw", "highway").withColumn("width", F.lit(None).cast("string")), F.lit(8))
    km = F.col("length") / 1000
    w = fitting.ridge_to_prior(rows, [c * km for c in cols], km * graph.slowness(cols, graph.prior_weights()) * 1.1, graph.prior_weights())
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, w, strict=True)], "name string, weight double")


# ---- raster ----
def raster_sql(pixel_m: int) -> str:
    """Pixels and their counts by layer."""
    return INC + f""", mp AS (SELECT *, CAST(6378137 AS DOUBLE) * radians(dest_lon) AS x, CAST(6378137 AS DOUBLE) * ln(tan(pi() / 4 + radians(dest_lat) / 2)) AS y FROM inc WHERE dest_lat IS NOT NULL),
k0 AS (SELECT round(1 / cos(radians(degrees(2 * atan(exp(avg(y) / 6378137)) - pi() / 2))), 9) AS k, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS e FROM mp),
rg AS (SELECT a - 2000 * k AS x0, c - 2000 * k AS y0, {pixel_m} * k AS px, CAST(ceil((b - a + 4000 * k) / ({pixel_m} * k)) AS INT) AS nx, CAST(ceil((e - c + 4000 * k) / ({pixel_m} * k)) AS INT) AS ny FROM k0),
rc AS (SELECT layer, ny - 1 - least(CAST(floor((y - y0) / px) AS INT), ny - 1) AS row, least(CAST(floor((x - x0) / px) AS INT), nx - 1) AS col, count(*) AS n FROM (SELECT 'all' AS layer, x, y FROM mp UNION ALL SELECT incident_group, x, y FROM mp) CROSS JOIN rg GROUP BY 1, 2, 3)"""


_RG = raster_sql(400)


def _raster(spark, d):
    pts = fx.incidents(spark, d).dropna(subset=["dest_lat"]).select(F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon"), "incident_group")
    g = raster.grid(pts, 400.0)
    return raster.counts(pts, g, "incident_group"), g


@query("layer:s row:i col:i n:i", _RG, "SELECT * FROM rc")
def density_counts(spark, d):
    return _raster(spark, d)[0]


def blur_sql(counted: str, sigma: float, of: str) -> str:
    """Layers that meet a condition, blurred along both axes."""
    weights = raster.kernel(sigma)
    kernel = ", ".join(f"({i - len(weights) // 2}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(weights))
    return counted + f""", kn(dd, g) AS (VALUES {kernel}),
b1 AS (SELECT layer, CASE WHEN ((row + dd) % (2 * ny) + 2 * ny) % (2 * ny) >= ny THEN 2 * ny - 1 - ((row + dd) % (2 * ny) + 2 * ny) % (2 * ny) ELSE ((row + dd) % (2 * ny) + 2 * ny) % (2 * ny) END AS row, col, sum(n * g) AS v FROM rc CROSS JOIN kn CROSS JOIN rg WHERE {of} GROUP BY 1, 2, 3),
b2 AS (SELECT layer, row, CASE WHEN ((col + dd) % (2 * nx) + 2 * nx) % (2 * nx) >= nx THEN 2 * nx - 1 - ((col + dd) % (2 * nx) + 2 * nx) % (2 * nx) ELSE ((col + dd) % (2 * nx) + 2 * nx) % (2 * nx) END AS col, sum(v * g) AS v FROM b1 CROSS JOIN kn CROSS JOIN rg GROUP BY 1, 2, 3)"""


_BLUR = blur_sql(_RG, 1.0, "layer = 'all'")


@query("layer:s row:i col:i v:d", _BLUR, "SELECT * FROM b2")
def density_blur(spark, d):
    pixels, g = _raster(spark, d)
    return raster.blur(pixels.where("layer = 'all'"), g, 1.0)


@query("layer:s block_row:i block_col:i per_year:d", _RG, "SELECT layer, row // 4 AS block_row, col // 4 AS block_col, sum(n) / 7.0 AS per_year FROM rc CROSS JOIN rg WHERE row < ny // 4 * 4 AND col < nx // 4 * 4 GROUP BY 1, 2, 3")
def block_readout(spark, d):
    pixels, g = _raster(spark, d)
    return raster.blocks(pixels, g, 7.0, 4)


_HOT = INC + """, hp AS (SELECT CAST(floor(dest_lon / CAST(0.02 AS DOUBLE)) AS BIGINT) AS gx, CAST(floor(dest_lat / CAST(0.02 AS DOUBLE)) AS BIGINT) AS gy, hour_of_call AS h, travel_seconds AS s FROM inc WHERE dest_lat IS NOT NULL),
hn AS (SELECT gx, gy, count(*) AS n FROM hp GROUP BY 1, 2), ht AS (SELECT *, row_number() OVER (ORDER BY n DESC, gx, gy) AS rank FROM hn),
hh AS (SELECT gx, gy, h, row_number() OVER (PARTITION BY gx, gy ORDER BY count(*) DESC, h) AS r FROM hp WHERE h IS NOT NULL GROUP BY 1, 2, 3),
hs AS (SELECT gx, gy, s, row_number() OVER (PARTITION BY gx, gy ORDER BY s) AS r, count(*) OVER (PARTITION BY gx, gy) AS k FROM hp WHERE s IS NOT NULL),
hm AS (SELECT gx, gy, avg(s) AS median_attend_s FROM hs WHERE r IN ((k + 1) // 2, k // 2 + 1) GROUP BY 1, 2)"""


# median and mode by rows in their order, as another form of this SQL ended in an internal error of DuckDB 2.0
@query("rank:i gx:i gy:i n:i common:i median_attend_s:d", _HOT, "SELECT ht.rank, ht.gx, ht.gy, ht.n, hh.h AS common, hm.median_attend_s FROM ht LEFT JOIN hh ON hh.gx = ht.gx AND hh.gy = ht.gy AND hh.r = 1 LEFT JOIN hm ON hm.gx = ht.gx AND hm.gy = ht.gy WHERE ht.rank <= 10")
def hotspots(spark, d):
    return raster.hotspots(fx.incidents(spark, d).dropna(subset=["dest_lat"]), 0.02, 10, 2404.0, "hour_of_call")


# ---- trees ----
def _model_rows(spark, d):
    trips = _trips(spark, d)
    train = trips.where("cal_year <= 1999")
    return held(ml.features(train, train)), held(ml.features(trips.where("cal_year = 2000"), train))


@query("model:s mae:d")
def gbt_bag(spark, d):
    train, test = _model_rows(spark, d)
    models = ml.fit_bag(train)
    return spark.createDataFrame([("trees", ml.mean_error(ml.predict_bag(models, test)))], "model string, mae double")


@query("dropped:s mae:d change:d")
def ablation(spark, d):
    train, test = _model_rows(spark, d)
    return ml.ablation(train, test, {"distance": ["road_km", "crow_km"], "time": ["hour_of_call", "dow", "month", "rush", "night"], "busy": ["busy_flag"], "borough": ["borough_code"]})


@query("feature:s rise:d")
def importance(spark, d):
    train, test = _model_rows(spark, d)
    models = ml.fit_bag(train)
    keyed = test.withColumn("key", F.col("incident_id") * 100 + F.col("pump_order"))
    return ml.permutation_importance(models, keyed, "key")


@query("feature:s mean_abs:d mean:d share:d")
def shap_importance(spark, d):
    """Shapley values of every held-out trip, by column."""
    train, test = _model_rows(spark, d)
    return ml.shap_importance(ml.fit_bag(train), test)


@query("feature:s bin:i n:i value:d phi:d")
def shap_dependence(spark, d):
    train, test = _model_rows(spark, d)
    return ml.dependence(ml.fit_bag(train), test)
