"""Further queries of the engine: streets under trips, held-out checks, matching of sources, other pictures of density."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberline.functions import geo, times
from emberline.functions.text import least_number
from emberline.operators import chains, facility, fitting, graph, ml, prep, raster, roads, scenario, spatial, summaries, weighted
from emberline.operators.quantiles import exact_quantiles
from emberline.plans import planner
from emberline.plans import queries as plans
from emberline.plans.queries import GRID, HAV, INC, ORACLES, ORIGINS, ST, TRIPS, WHOLE, _score_sql, _shaped_sql, paths_sql, query
from emberline.sources import demo
from emberline.sources import fixtures as fx
from emberline.sources.tables import held

GR = fx.ALL_EDGES_SQL

# ---- summaries ----


@query("kph:d", TRIPS, "SELECT sum(road_km) / sum(drive_s) * 3600 AS kph FROM trips")
def road_speed(spark, d):
    return summaries.road_speed_kph(plans._trips(spark, d))


@query("station_ground:s lat:f lon:f n:i", INC, "SELECT station_ground, quantile_cont(dest_lat, 0.5) AS lat, quantile_cont(dest_lon, 0.5) AS lon, count(*) AS n FROM inc WHERE station_ground IS NOT NULL GROUP BY 1")
def ground_centroids(spark, d):
    return summaries.ground_centroids(fx.incidents(spark, d))


@query("incident_id:i date_of_call:s", INC + ", sd AS (SELECT l_orderkey AS k, min(CAST(l_shipdate AS DATE)) AS s FROM lineitem GROUP BY 1)", "SELECT incident_id, coalesce(CASE WHEN incident_id % 3 > 0 THEN date_of_call END, s) AS date_of_call FROM inc LEFT JOIN sd ON k = incident_id")
def fill_dates(spark, d):
    rows = fx.incidents(spark, d).withColumn("date_of_call", F.when(F.col("incident_id") % 3 > 0, F.col("date_of_call")))
    other = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("incident_id"), F.to_date("l_shipdate").alias("date_of_call"))
    return prep.fill_dates(rows, other, "incident_id")


@query("borough:s n:i median_s:d", INC, "SELECT borough, count(*) AS n, quantile_cont(travel_seconds, 0.5) AS median_s FROM inc WHERE borough IS NOT NULL GROUP BY 1 ORDER BY n DESC, borough LIMIT 8")
def borough_top(spark, d):
    return summaries.largest_groups(fx.incidents(spark, d), "borough", "travel_seconds")


_OUTER = (0.01, 0.025, 0.95, 0.975, 0.99, 0.999)


@query("incident_group:s q:d value:d", INC, " UNION ALL ".join(f"SELECT incident_group, {q} AS q, quantile_cont(travel_seconds, {q}) AS value FROM inc WHERE travel_seconds IS NOT NULL GROUP BY 1" for q in _OUTER))
def outer_percentiles(spark, d):
    return exact_quantiles(fx.incidents(spark, d), "incident_group", "travel_seconds", _OUTER)


# ---- turnout ----
_GIVEN = {" STATION 0 ": 95.0, "station   1": 400.0, "Station 2": -5.0, "Nowhere": 10.0}
_TURNOUT = plans._OWN + ", " + plans.CAND.removeprefix(INC).lstrip(", ") + f""", tp AS (SELECT station, least(greatest(60 + quantile_cont(observed_s - 60 - {fx.curve_sql('km')}, 0.5), CAST(30 AS DOUBLE)), CAST(180 AS DOUBLE)) AS s FROM oq GROUP BY 1 HAVING count(*) >= 20),
tg(station, s) AS (VALUES ('station 0', 95), ('station 1', 400), ('station 2', -5)),
tv AS (SELECT candidate_id AS site_id, part = 0 AS old, part = 0 AND coalesce(g.s, p.s) IS NOT NULL AS own, least(greatest(CASE WHEN part = 0 THEN coalesce(g.s, p.s, 60) ELSE 60 END, 0), 300) AS turnout_s FROM cand LEFT JOIN tg g ON g.station = lower(site_name) LEFT JOIN tp p ON p.station = lower(site_name))"""


def _turnouts(spark, d):
    st, inc = plans._parts(spark, d)
    return spatial.candidates(st, plans._cells(spark, d), 20), fitting.station_turnout(prep.own_station_pairs(inc, st))


@query("site_id:i turnout_s:d", _TURNOUT, "SELECT site_id, turnout_s FROM tv")
def turnout_vector(spark, d):
    """Every candidate's turnout: what is given for some stations, else their estimates, else the default."""
    return planner.turnout_table(*_turnouts(spark, d), given=_GIVEN)


@query("source:s default_s:d n_existing_with_prior:i existing_min_s:d existing_median_s:d existing_max_s:d", _TURNOUT, "SELECT 'mapping+estimated' AS source, 60 AS default_s, count(*) FILTER (own) AS n_existing_with_prior, min(turnout_s) AS existing_min_s, quantile_cont(turnout_s, 0.5) AS existing_median_s, max(turnout_s) AS existing_max_s FROM tv WHERE old")
def turnout_report(spark, d):
    return planner.turnout_report(*_turnouts(spark, d), given=_GIVEN)


# ---- matching ----
_FEATURES = ST + """, fe AS (SELECT CASE WHEN k = 0 THEN 'node' ELSE 'way' END AS element, station_id * 10 + k AS feature_id, concat('  ', upper(facilityname), ' ') AS feature_name, CASE WHEN (station_id + k) % 3 = 0 THEN 'London Fire Brigade' WHEN station_id % 4 = 0 THEN 'Other' END AS operator, lat + k * CAST(0.001 AS DOUBLE) AS lat, lon AS lon
  FROM st CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE (station_id + k) % 5 <> 0 AND station_id % 6 <> 5),
ov AS (SELECT facilityname AS name, 'way' AS element, station_id * 10 + 1 AS feature_id FROM st WHERE station_id % 7 = 0),
mt AS (SELECT s.facilityname AS name, f.*, CASE WHEN o.name IS NULL THEN 'name' ELSE 'override' END AS how FROM st s LEFT JOIN ov o ON o.name = s.facilityname LEFT JOIN fe f ON CASE WHEN o.name IS NULL THEN trim(lower(f.feature_name)) = lower(s.facilityname) ELSE f.element = o.element AND f.feature_id = o.feature_id END)"""


@query("name:s element:s feature_id:i feature_name:s lat:f lon:f how:s", _FEATURES, "SELECT name, element, feature_id, feature_name, lat, lon, CASE WHEN feature_id IS NULL THEN 'missing' ELSE how END AS how FROM mt QUALIFY row_number() OVER (PARTITION BY name ORDER BY coalesce(operator LIKE '%London Fire%', false) DESC, element DESC, feature_id) = 1")
def matched_features(spark, d):
    st = fx.stations(spark, d)
    sid, k = F.col("station_id"), F.col("k")
    features = st.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).where(((sid + k) % 5 != 0) & (sid % 6 != 5)).select(
        F.when(k == 0, "node").otherwise("way").alias("element"), (sid * 10 + k).alias("feature_id"), F.concat(F.lit("  "), F.upper("facilityname"), F.lit(" ")).alias("feature_name"),
        F.when((sid + k) % 3 == 0, "London Fire Brigade").when(sid % 4 == 0, "Other").alias("operator"), (F.col("lat") + k * 0.001).alias("lat"), "lon")
    overrides = st.where(sid % 7 == 0).select(F.col("facilityname").alias("name"), F.lit("way").alias("element"), (sid * 10 + 1).alias("feature_id"))
    return prep.matched_features(st.select(F.col("facilityname").alias("name")), features, overrides)


@query("site:i name:s listed:s as_names:s", plans._NAMES, "SELECT pos AS site, cl.name, count(nm.name) > 0 AS listed, string_agg(DISTINCT nm.name, ', ' ORDER BY nm.name) AS as_names FROM cl LEFT JOIN nm ON nm.is_of = cl.name AND nm.kind > 0 GROUP BY 1, 2")
def closed_presence(spark, d):
    return scenario.presence(plans._closed_names(spark, d), scenario.closed_sites(spark)).withColumnRenamed("at", "site")


# ---- pictures ----
_HEX = TRIPS + f""", hx AS (SELECT road_km / (CAST(10 AS DOUBLE) / 70) AS u, drive_s / 60 / (CAST(20 AS DOUBLE) / {int(70 / math.sqrt(3))}) AS v FROM trips),
hd AS (SELECT round_even(u, 0) AS a1, round_even(v, 0) AS b1, floor(u) + 0.5 AS a2, floor(v) + 0.5 AS b2, u, v FROM hx),
hl AS (SELECT CASE WHEN pow(u - a1, 2) + 3 * pow(v - b1, 2) < pow(u - a2, 2) + 3 * pow(v - b2, 2) THEN 1 ELSE 2 END AS lattice, * FROM hd)"""


@query("lattice:i ix:i iy:i n:i log_n:d", _HEX, f"SELECT lattice, floor(CASE lattice WHEN 1 THEN a1 ELSE a2 END) AS ix, floor(CASE lattice WHEN 1 THEN b1 ELSE b2 END) AS iy, count(*) AS n, log10(count(*) + 1) AS log_n FROM hl WHERE CASE lattice WHEN 1 THEN a1 ELSE a2 END BETWEEN 0 AND 70 AND CASE lattice WHEN 1 THEN b1 ELSE b2 END BETWEEN 0 AND {int(70 / math.sqrt(3))} GROUP BY 1, 2, 3")
def hexbin(spark, d):
    return raster.hexbin(plans._trips(spark, d), F.col("road_km"), F.col("drive_s") / 60, (0.0, 10.0, 0.0, 20.0))


_FINE = plans.raster_sql(int(raster.PIXEL_M))
_FINE_BLUR = plans.blur_sql(_FINE, raster.SIGMA_PX, "true") + """, tk AS (SELECT layer, quantile_cont(v / 0.000625 / 7, CAST(0.999 AS DOUBLE)) AS top FROM b2 WHERE v > 0 GROUP BY 1)"""


@query("layer:s i:i tick:d", _FINE_BLUR, "SELECT layer, i, top / 100 * pow(CAST(10 AS DOUBLE), i / 2.0) AS tick FROM tk CROSS JOIN range(5) r(i)")
def colour_ticks(spark, d):
    """The colour scale of every layer's density at the default pixel and blur."""
    pts = fx.incidents(spark, d).dropna(subset=["dest_lat"]).select(F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon"), "incident_group")
    g = held(raster.grid(pts))
    dense = raster.density(raster.counts(pts, g, "incident_group"), g, 7.0)
    return raster.ticks(dense).select("layer", F.posexplode("ticks").alias("i", "tick"))


# ---- held-out checks ----
@query("p50_km:d p95_km:d n:i", GRID + ", l0 AS (SELECT avg(lat) AS lat0 FROM cells), sn AS (SELECT incident_id, min(sqrt(pow((c.lon - dest_lon) * 111.32 * cos(radians(lat0)), 2) + pow((c.lat - dest_lat) * 110.574, 2))) AS km FROM inc CROSS JOIN cells c CROSS JOIN l0 WHERE dest_lat IS NOT NULL AND cal_year = 2000 GROUP BY 1)", "SELECT quantile_cont(km, 0.5) AS p50_km, quantile_cont(km, 0.95) AS p95_km, count(*) AS n FROM sn")
def held_out_snap(spark, d):
    return summaries.snap_quantiles(spatial.snap_to_cells(fx.incidents(spark, d).where("cal_year = 2000"), plans._cells(spark, d)))


@query(plans.SCORE, INC + ", ob AS (SELECT round(travel_seconds, 6) AS response_s FROM inc WHERE cal_year = 2000 AND travel_seconds IS NOT NULL)", _score_sql("ob"))
def held_out_observed(spark, d):
    own = fx.incidents(spark, d).where("cal_year = 2000 AND travel_seconds IS NOT NULL")
    return weighted.score_first_engine(own.select(F.round("travel_seconds", 6).alias("response_s")))


@query("cell_id:i assigned_site:i response_s:d covered:s share:d", WHOLE, "SELECT cell_id, site_id AS assigned_site, t AS response_s, t <= 480 AS covered, share FROM tm JOIN (SELECT cell_id, share FROM cells) c USING (cell_id) WHERE layer = 'existing_firehouse' QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY t, site_id) = 1")
def cell_output(spark, d):
    t, sites = plans._all_times(spark, d)
    now = facility.responses(t, sites).withColumn("covered", F.col("response_s") <= 480)
    return now.join(plans._cells(spark, d).select("cell_id", "share"), "cell_id")


def _held_sql() -> str:
    clip = lambda x: f"least(greatest({x}, CAST(30 AS DOUBLE)), CAST(1200 AS DOUBLE))"
    models = {"curve": fx.curve_sql("km"), "straight_32": clip("km / 32 * 3600"), "constant": "(SELECT quantile_cont(drive_s, 0.5) FROM lt2 WHERE cal_year < 2000 AND busy = 0)"}
    parts = {"all": "", "non_busy": " AND busy = 0"}
    return " UNION ALL ".join(f"SELECT '{m}' AS model, '{p}' AS part, avg(abs({x} - drive_s)) AS mae, count(*) AS n FROM lt2 WHERE cal_year = 2000{w}" for m, x in models.items() for p, w in parts.items())


@query("model:s part:s mae:d n:i", INC + f""", lo AS (SELECT i.*, coalesce(a.lat, b.lat) AS s_lat, coalesce(a.lon, b.lon) AS s_lon FROM inc i LEFT JOIN st a ON a.facilityname = deployed_from_station LEFT JOIN st b ON b.facilityname = station_ground),
lt AS (SELECT *, {HAV('s_lon', 's_lat', 'dest_lon', 'dest_lat', 6371.0088)} AS km, least(greatest(travel_seconds - 60, CAST(30 AS DOUBLE)), CAST(1200 AS DOUBLE)) AS drive_s, CASE WHEN station_ground IS NOT NULL AND station_ground <> deployed_from_station THEN 1 ELSE 0 END AS busy FROM lo),
lt2 AS (SELECT * FROM lt WHERE km > 0 AND km <= 25 AND travel_seconds IS NOT NULL)""", _held_sql())
def held_out_models(spark, d):
    st, inc = plans._parts(spark, d)
    rows = prep.trips_with_origin(inc, st).where("drive_s IS NOT NULL").withColumn("busy", prep.away_strict(F.col("station_ground"), F.col("deployed_from_station")))
    middle = rows.where("cal_year < 2000 AND busy = 0").agg(summaries.median("drive_s").alias("constant"))
    km = F.col("crow_km")
    test = rows.where("cal_year = 2000").crossJoin(F.broadcast(middle)).withColumns({"curve": times.DEFAULT_CURVE.seconds(km), "straight_32": times.clipped(km / 32.0 * 3600, 30.0, 1200.0)})
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.abs(F.col(m) - F.col("drive_s")).alias("e")) for m in ("curve", "straight_32", "constant")])).alias("m")
    parts = F.explode(F.when(F.col("busy") == 0, F.array(F.lit("all"), F.lit("non_busy"))).otherwise(F.array(F.lit("all")))).alias("part")
    return test.select("drive_s", "busy", models).select("m.model", "m.e", parts).groupBy("model", "part").agg(F.avg("e").alias("mae"), F.count("*").alias("n"))


# ---- places ----
def _bng_sql() -> tuple[str, str]:
    """The published series for the projection and the shift, a step a CTE."""
    a, b = geo.AIRY["a"], geo.AIRY["b"]
    g, sh = geo.GRID, geo.SHIFT
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    lat0, lon0 = math.radians(g["lat0"]), math.radians(g["lon0"])
    num = lambda x: f"CAST({x!r} AS DOUBLE)"
    f0 = g["f0"]
    arc = f"({num(b * f0)} * ({num(1 + n + 1.25 * n**2 + 1.25 * n**3)} * (p - {num(lat0)}) - {num(3 * n + 3 * n**2 + 21 / 8 * n**3)} * sin(p - {num(lat0)}) * cos(p + {num(lat0)}) + {num(15 / 8 * (n**2 + n**3))} * sin(2 * (p - {num(lat0)})) * cos(2 * (p + {num(lat0)})) - {num(35 / 24 * n**3)} * sin(3 * (p - {num(lat0)})) * cos(3 * (p + {num(lat0)}))))"
    steps = [ST, f"n0 AS (SELECT station_id, CAST(503000 + (station_id * 613) % 55000 AS DOUBLE) AS e, CAST(156000 + (station_id * 977) % 45000 AS DOUBLE) AS no, (CAST(156000 + (station_id * 977) % 45000 AS DOUBLE) - {num(g['n0'])}) / {num(a * f0)} + {num(lat0)} AS p FROM st)"]
    steps += [f"n{i + 1} AS (SELECT station_id, e, no, p + (no - {num(g['n0'])} - {arc}) / {num(a * f0)} AS p FROM n{i})" for i in range(6)]
    steps.append(f"ai AS (SELECT station_id, p, e - {num(g['e0'])} AS x, {num(a * f0)} / sqrt(1 - {num(e2)} * pow(sin(p), 2)) AS nu, {num(a * f0 * (1 - e2))} / pow(1 - {num(e2)} * pow(sin(p), 2), 1.5) AS rho, tan(p) AS t FROM n6)")
    steps.append(f"""ll AS (SELECT station_id, p - t / (2 * rho * nu) * pow(x, 2) + t / (24 * rho * pow(nu, 3)) * (5 + 3 * pow(t, 2) + (nu / rho - 1) - 9 * pow(t, 2) * (nu / rho - 1)) * pow(x, 4) - t / (720 * rho * pow(nu, 5)) * (61 + 90 * pow(t, 2) + 45 * pow(t, 4)) * pow(x, 6) AS la,
  {num(lon0)} + x / (cos(p) * nu) - pow(x, 3) / (cos(p) * 6 * pow(nu, 3)) * (nu / rho + 2 * pow(t, 2)) + pow(x, 5) / (cos(p) * 120 * pow(nu, 5)) * (5 + 28 * pow(t, 2) + 24 * pow(t, 4)) - pow(x, 7) / (cos(p) * 5040 * pow(nu, 7)) * (61 + 662 * pow(t, 2) + 1320 * pow(t, 4) + 720 * pow(t, 6)) AS lo FROM ai)""")
    steps.append(f"ca AS (SELECT station_id, {num(a)} / sqrt(1 - {num(e2)} * pow(sin(la), 2)) * cos(la) * cos(lo) AS x, {num(a)} / sqrt(1 - {num(e2)} * pow(sin(la), 2)) * cos(la) * sin(lo) AS y, {num(1 - e2)} * {num(a)} / sqrt(1 - {num(e2)} * pow(sin(la), 2)) * sin(la) AS z FROM ll)")
    rx, ry, rz = (num(math.radians(sh[k] / 3600)) for k in ("rx", "ry", "rz"))
    s = num(1 + sh["s"] * 1e-6)
    steps.append(f"sh AS (SELECT station_id, {num(sh['tx'])} + {s} * x - {rz} * y + {ry} * z AS x, {num(sh['ty'])} + {rz} * x + {s} * y - {rx} * z AS y, {num(sh['tz'])} - {ry} * x + {rx} * y + {s} * z AS z FROM ca)")
    w2 = 1 - geo.WGS84["b"] ** 2 / geo.WGS84["a"] ** 2
    steps.append(f"w0 AS (SELECT *, atan2(z, sqrt(x * x + y * y) * {num(1 - w2)}) AS la FROM sh)")
    steps += [f"w{i + 1} AS (SELECT station_id, x, y, z, atan2(z + {num(w2)} * {num(geo.WGS84['a'])} / sqrt(1 - {num(w2)} * pow(sin(la), 2)) * sin(la), sqrt(x * x + y * y)) AS la FROM w{i})" for i in range(5)]
    return ", ".join(steps), "SELECT station_id, degrees(atan2(y, x)) AS lon, degrees(la) AS lat FROM w5"


@query("station_id:i lon:f lat:f", *_bng_sql())
def bng_to_wgs84(spark, d):
    """Longitude and latitude of points on a grid of easting and northing."""
    st = fx.stations(spark, d)
    lon, lat = geo.bng_to_wgs84(F.lit(503000.0) + (F.col("station_id") * 613) % 55000, F.lit(156000.0) + (F.col("station_id") * 977) % 45000)
    return st.select("station_id", lon.alias("lon"), lat.alias("lat"))


def _even_sql(what: str) -> str:
    return f"(CAST(CAST(concat('0x', substr(md5(concat('7:{what}:', CAST(i AS VARCHAR))), 1, 12)) AS BIGINT) AS DOUBLE) + 0.5) / CAST({1 << 48} AS DOUBLE)"


def _demo_sql() -> str:
    parts, first = [], 0
    for east, north, spread, share in demo.HOTSPOTS:
        n = int(4000 * share * demo.IN_HOTSPOTS)
        parts.append((f"i BETWEEN {first} AND {first + n - 1}", f"CAST({demo.MIDDLE[0] + east} AS DOUBLE) + CAST({spread} AS DOUBLE) * r * cos(t)", f"CAST({demo.MIDDLE[1] + north} AS DOUBLE) + CAST({0.8 * spread} AS DOUBLE) * r * sin(t)"))
        first += n
    lon = " ".join(f"WHEN {w} THEN {x}" for w, x, _ in parts)
    lat = " ".join(f"WHEN {w} THEN {y}" for w, _, y in parts)
    return f"SELECT i AS incident_id, CASE {lon} ELSE CAST({demo.MIDDLE[0]} AS DOUBLE) + ({_even_sql('x')} - 0.5) * CAST(0.24 AS DOUBLE) END AS dest_lon, CASE {lat} ELSE CAST({demo.MIDDLE[1]} AS DOUBLE) + ({_even_sql('y')} - 0.5) * CAST(0.18 AS DOUBLE) END AS dest_lat, 180 + 420 * {_even_sql('s')} AS travel_seconds FROM (SELECT i, sqrt(-2 * ln({_even_sql('r')})) AS r, 2 * pi() * {_even_sql('t')} AS t FROM range(4000) q(i))"


@query("incident_id:i dest_lon:f dest_lat:f travel_seconds:d", "", _demo_sql())
def demo_city(spark, d):
    return demo.incidents(spark)


# ---- streets under trips ----
ORACLES["largest_scc"] = _shaped_sql(GR, """WITH RECURSIVE pv AS (SELECT n FROM (SELECT u AS n FROM ed UNION ALL SELECT v FROM ed) GROUP BY n ORDER BY count(*) DESC, n LIMIT 1),
fw(node) AS (SELECT n FROM pv UNION SELECT e.v FROM fw JOIN ed e ON e.u = fw.node), bw(node) AS (SELECT n FROM pv UNION SELECT e.u FROM bw JOIN ed e ON e.v = bw.node) SELECT node FROM fw JOIN bw USING (node)""", "node:i")

_SUMS = {"len_total": "length", "major": "length * CAST(road_class = 'major' AS INT)", "residential": "length * CAST(road_class = 'residential' AS INT)", "ow": "length * CAST(oneway AS INT)", "slow": "length * CAST(coalesce(mph <= 20, false) AS INT)", "bus": "length * CAST(bl AS INT)", "br": "length * CAST(bt AS INT)", "lane": "coalesce(lanes * length, 0)", "tagged": "CASE WHEN lanes IS NULL THEN 0 ELSE length END", "j": "1", "ro": "CAST(rb AS INT)", "si": "CAST(v % 5 = 0 AS INT)"}
_ROUTES = f"""WITH RECURSIVE {paths_sql(ORIGINS, 'sf', 'length')},
par AS (SELECT s.origin, e.v AS node, min(e.u) AS parent FROM sp s JOIN sf e ON e.u = s.node JOIN sp t ON t.origin = s.origin AND t.node = e.v AND t.dist = s.dist + e.length WHERE e.v <> s.origin GROUP BY 1, 2),
tw AS (SELECT o AS origin, o AS node, CAST(NULL AS BIGINT) AS way, CAST(NULL AS INT) AS n_turns, {', '.join(f'CAST(0 AS DOUBLE) AS {k}' for k in _SUMS)} FROM ({ORIGINS})
  UNION ALL SELECT tw.origin, p.node, e.v - e.u, CAST(e.v - e.u <> tw.way AS INT), {', '.join(f'tw.{k} + {v}' for k, v in _SUMS.items())} FROM tw JOIN par p ON p.origin = tw.origin AND p.parent = tw.node JOIN sf e ON e.u = p.parent AND e.v = p.node)
SELECT origin, node, n_turns, major / nullif(len_total, 0) AS share_major, residential / nullif(len_total, 0) AS share_residential, ow / nullif(len_total, 0) AS share_oneway, slow / nullif(len_total, 0) AS share_20mph, bus / nullif(len_total, 0) AS share_bus_lane, br / nullif(len_total, 0) AS share_bridge_tunnel, lane / nullif(tagged, 0) AS mean_lanes, j / nullif(len_total, 0) * 1000 AS junctions_per_km, ro / nullif(len_total, 0) * 1000 AS roundabouts_per_km, si / nullif(len_total, 0) * 1000 AS signals_per_km FROM tw"""
ORACLES["route_ratios"] = _shaped_sql(plans._SE, _ROUTES, "origin:i node:i " + plans._RATIOS + " n_turns:i")

_LEFT = plans._SE + """, k AS (SELECT * FROM se WHERE (least(u, v) * 7 + abs(u - v)) % 10 < 6),
pn AS (SELECT node FROM (SELECT u AS node, v AS other, 1 AS o FROM k UNION ALL SELECT v, u, 0 FROM k) GROUP BY node HAVING count(DISTINCT other) = 2 AND sum(o) * 2 = count(*) AND (sum(o) = 1 OR (sum(o) = 2 AND count(DISTINCT CASE WHEN o = 1 THEN other END) = 2 AND count(DISTINCT CASE WHEN o = 0 THEN other END) = 2)))"""
_CHAINS = """WITH RECURSIVE w AS (SELECT u AS hu, v AS hv, u, v, hw, mph, length, 1 AS n FROM k WHERE u NOT IN (SELECT node FROM pn)
  UNION ALL SELECT hu, hv, k.u, k.v, k.hw, k.mph, w.length + k.length, n + 1 FROM w JOIN pn ON pn.node = w.v JOIN k ON k.u = w.v AND k.v <> w.u)
SELECT hu AS u, arg_max(v, n) AS v, max(n) AS n_parts, max(length) AS length, count(DISTINCT hw) AS n_types, min(mph) AS mph FROM w GROUP BY hu, hv
UNION ALL SELECT u, v, 1, length, 1, mph FROM k WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.u = k.u AND w.v = k.v)"""


@query("u:i v:i n_parts:i length:d n_types:i mph:i", _LEFT, _CHAINS)
def joined_streets(spark, d):
    """The streets of the grid with six of ten blocks left, chains joined."""
    left = plans._streets(spark, d).withColumn("width", F.lit(None).cast("string")).where((F.least("u", "v") * 7 + F.abs(F.col("u") - F.col("v"))) % 10 < 6)
    return chains.joined(left).select("u", "v", "n_parts", "length", F.size("highway").alias("n_types"), least_number(F.col("maxspeed")).alias("mph"))


_ND = ", nd AS (SELECT CAST(p_partkey AS BIGINT) AS node, CAST(51.30 AS DOUBLE) + floor(p_partkey / side) * (CAST(0.4 AS DOUBLE) / side) AS lat, CAST(-0.5 AS DOUBLE) + (p_partkey % side) * (CAST(0.8 AS DOUBLE) / side) AS lon FROM part CROSS JOIN gr)"


def _nodes(spark, d):
    """The street grid's nodes, spread over the city."""
    side, _ = fx.grid_side(spark, d)
    n = F.col("p_partkey")
    return fx.table(spark, d, "part").select(n.cast("long").alias("node"), (51.30 + F.floor(n / side) * (0.4 / side)).alias("lat"), (-0.5 + (n % side) * (0.8 / side)).alias("lon"))


_KM = f"{HAV('p.lon', 'p.lat', 'nd.lon', 'nd.lat', 6371.0088)}"
_BY_ROAD = TRIPS + ", " + GR + _ND + f""", sa AS (SELECT p.deployed_from_station, arg_min(node, {_KM}) AS node, min({_KM}) * 1000 AS m FROM (SELECT DISTINCT deployed_from_station, start_lat AS lat, start_lon AS lon FROM trips) p CROSS JOIN nd GROUP BY 1),
sb AS (SELECT p.incident_id, arg_min(node, {_KM}) AS node, min({_KM}) * 1000 AS m FROM (SELECT DISTINCT incident_id, dest_lat AS lat, dest_lon AS lon FROM trips) p CROSS JOIN nd GROUP BY 1)"""


@query("incident_id:i pump_order:i start_node:i dest_node:i crow_km:d road_km:d", _BY_ROAD, f"WITH RECURSIVE {paths_sql('SELECT DISTINCT node AS o FROM sa', 'ed', 'length')} SELECT t.incident_id, t.pump_order, sa.node AS start_node, sb.node AS dest_node, t.crow_km, (dist + sa.m + sb.m) / 1000 AS road_km FROM trips t JOIN sa USING (deployed_from_station) JOIN sb ON sb.incident_id = t.incident_id JOIN sp ON sp.origin = sa.node AND sp.node = sb.node")
def training_rows_by_road(spark, d):
    return _by_road(spark, d)


def _by_road(spark, d):
    return roads.road_rows(plans._trips(spark, d), _nodes(spark, d), plans._features(spark, d))


_COSTED = f", ec AS (SELECT u, v, length, c AS cost_s FROM (SELECT *, {plans._COST} AS c FROM (SELECT *, CAST(coalesce(least(greatest(mph, 15), 70), 35) AS DOUBLE) AS k FROM se)) WHERE c < 1e11)"


@query("origin:i node:i found:s cost_s:d", plans._SE + _COSTED, f"WITH RECURSIVE {paths_sql(ORIGINS, 'ec', 'cost_s')} SELECT a.o AS origin, b.o AS node, sp.dist IS NOT NULL AS found, sp.dist AS cost_s FROM ({ORIGINS}) a CROSS JOIN ({ORIGINS}) b LEFT JOIN sp ON sp.origin = a.o AND sp.node = b.o")
def engine_routes(spark, d):
    """Routes of a fire engine between all pairs of the grid's every twentieth node, and whether there is one."""
    e = graph.engine_cost(plans._streets(spark, d).drop("highway").withColumnRenamed("hw", "highway")).where("cost_s < 1e11")
    o = plans._origins(spark, d)
    pairs = o.crossJoin(o.withColumnRenamed("origin", "node"))
    return roads.route_table(e, pairs, "cost_s", ["length"]).withColumnRenamed("dist", "cost_s")


_TRACKS = plans._RACE + f", rc AS ({plans._RACE_BODY}), " + plans._SE + _ND + f""", cs AS (SELECT u, v, oneway, c FROM (SELECT *, {plans._COST} AS c FROM (SELECT *, CAST(coalesce(least(greatest(mph, 15), 70), 35) AS DOUBLE) AS k FROM se)) WHERE c < 1e11),
ec AS (SELECT u, v, c AS cost_s FROM cs UNION ALL SELECT v, u, c + 12 FROM cs WHERE oneway),
pl AS (SELECT rc.new_id, 'new' AS engine, n_lat AS lat, n_lon AS lon, rc.d_new AS crow FROM rc JOIN ol USING (new_id) UNION ALL SELECT rc.new_id, 'old', o_lat, o_lon, rc.d_new + rc.gain FROM rc JOIN ol USING (new_id)),
sa AS (SELECT new_id, engine, arg_min(node, {HAV('p.lon', 'p.lat', 'nd.lon', 'nd.lat', 6371.0088)}) AS node FROM pl p CROSS JOIN nd GROUP BY 1, 2),
sb AS (SELECT new_id, arg_min(node, {HAV('i.dest_lon', 'i.dest_lat', 'nd.lon', 'nd.lat', 6371.0088)}) AS node FROM rc JOIN inc i USING (incident_id) CROSS JOIN nd GROUP BY 1)"""
_TRACK_ROWS = f"""WITH RECURSIVE {paths_sql('SELECT DISTINCT node AS o FROM sa', 'ec', 'cost_s')},
par AS (SELECT s.origin, e.v AS node, min(e.u) AS parent FROM sp s JOIN ec e ON e.u = s.node JOIN sp t ON t.origin = s.origin AND t.node = e.v AND t.dist = s.dist + e.cost_s WHERE e.v <> s.origin GROUP BY 1, 2),
back AS (SELECT sa.new_id, engine, origin, sp.node FROM sa JOIN sb USING (new_id) JOIN sp ON sp.origin = sa.node AND sp.node = sb.node UNION ALL SELECT new_id, engine, b.origin, par.parent FROM back b JOIN par ON par.origin = b.origin AND par.node = b.node),
sq AS (SELECT b.new_id, engine, lat, lon, row_number() OVER w AS seq, count(*) OVER (PARTITION BY b.new_id, engine) AS n, dist / nullif(max(dist) OVER (PARTITION BY b.new_id, engine), 0) AS share FROM back b JOIN sp ON sp.origin = b.origin AND sp.node = b.node JOIN nd ON nd.node = b.node WINDOW w AS (PARTITION BY b.new_id, engine ORDER BY dist, b.node)),
tk AS (SELECT new_id, engine, i, min(CASE WHEN seq = n OR (seq > 1 AND share * 239 + 1e-9 >= i) THEN seq END) AS seq FROM sq CROSS JOIN range(240) r(i) WHERE n > 1 OR i = 0 GROUP BY 1, 2, 3),
ps AS (SELECT tk.new_id, tk.engine, tk.i, coalesce((i / CAST(239 AS DOUBLE) - a.share) / nullif(b.share - a.share, 0), 0) AS f, a.lat AS y0, a.lon AS x0, b.lat AS y, b.lon AS x FROM tk JOIN sq b ON b.new_id = tk.new_id AND b.engine = tk.engine AND b.seq = tk.seq LEFT JOIN sq a ON a.new_id = tk.new_id AND a.engine = tk.engine AND a.seq = tk.seq - 1)
SELECT new_id, engine, i, i * attend_s / 239 AS t, coalesce(y0 + f * (y - y0), y) AS lat, coalesce(x0 + f * (x - x0), x) AS lon, attend_s FROM ps JOIN (SELECT new_id, engine, {fx.curve_sql('crow')} + 60 AS attend_s FROM pl) USING (new_id, engine)"""


@query("new_id:i engine:s i:i t:d lat:d lon:d attend_s:d", _TRACKS, _TRACK_ROWS)
def race_tracks(spark, d):
    """Where both engines of each race are at 240 instants, over streets that an engine may take against their direction."""
    st, inc = plans._parts(spark, d)
    new = scenario.closed_sites(spark).select(F.col("at").alias("new_id"), "lat", "lon")
    races = held(scenario.race(new, st, inc, (-0.2, 51.4, 0.1, 51.6)))
    old = st.select(F.col("station_id").alias("old_id"), "lat", "lon")
    km = {"new": F.col("d_new"), "old": F.col("d_new") + F.col("gain")}
    at = [races.join(sites, on).select("new_id", F.lit(engine).alias("engine"), "lat", "lon", "incident_id", km[engine].alias("crow_km")) for engine, sites, on in (("new", new, "new_id"), ("old", old, "old_id"))]
    places = at[0].unionByName(at[1]).join(inc.select("incident_id", "dest_lat", "dest_lon"), "incident_id")
    e = graph.engine_cost(plans._streets(spark, d).drop("highway").withColumnRenamed("hw", "highway")).where("cost_s < 1e11").select("u", "v", "oneway", "cost_s")
    against = e.where("oneway").select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("cost_s") + 12).alias("cost_s"))
    return scenario.race_tracks(races, places, e.select("u", "v", "cost_s").unionByName(against), _nodes(spark, d), points=240)


@query("name:s weight:d")
def reroute_fit(spark, d):
    """The speed model fitted to trips on the street grid: routes and weights in turn, observed times from a slower prior."""
    e, trips = reroute_inputs(spark, d)
    weights, _ = roads.reroute_fit(e, trips)
    names = graph.segment_features(e, F.lit(0))[2]
    return spark.createDataFrame(list(zip(names, weights, strict=True)), "name string, weight double")


def reroute_inputs(spark, d):
    """The street grid, and a trip from each node divisible by 20 to three others, at hours of the day."""
    e = plans._streets(spark, d).drop("highway").withColumnRenamed("hw", "highway").withColumn("width", F.lit(None).cast("string"))
    n = fx.table(spark, d, "part").count()
    o = F.col("origin")
    each = plans._origins(spark, d).withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    node = F.pmod(o * 31 + F.col("i") * 977 + 7, F.lit(n))
    apart = F.abs(o - node).cast("double")
    return e, each.select((o * 3 + F.col("i")).alias("trip"), o, node.alias("node"), ((o + F.col("i")) % 24).cast("int").alias("hour"), (60 + apart * 0.4 + (o * 13 + F.col("i") * 7) % 90).alias("seconds"))


def od_inputs(spark, d):
    """The street grid, and a trip from each node divisible by 20 to three others over 300 m away, with the time of the curve over the straight km; a fifth are held out."""
    e, trips = reroute_inputs(spark, d)
    n = _nodes(spark, d)
    a, b = n.select(F.col("node").alias("origin"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), n.select("node", "lat", "lon")
    km = geo.haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat"))
    placed = trips.join(a, "origin").join(b, "node").withColumn("crow", km).where("crow >= 0.3")
    return e, placed.select("trip", "origin", "node", "hour", times.DEFAULT_CURVE.seconds(F.col("crow")).alias("seconds"), ((F.floor(F.col("origin") / 20) + F.col("trip") % 3) % 5 == 0).alias("test"))


#: Weights whose errors are checked: the prior's, and some by hand.
_BY_HAND = {"intercept": 5.0, "limit_s_per_km": 1.2, "rush": 9.0}
_LIMIT = "CASE WHEN mph IS NOT NULL THEN mph * CAST(1.609344 AS DOUBLE) WHEN hw = 'trunk' THEN 96 WHEN hw IN ('primary', 'tertiary', 'secondary_link') THEN 48 ELSE 32 END"
_OD = plans._SE + _ND + f""", ew AS (SELECT u, v, length, length / 1000 AS km, length / 1000 * 3600 / ({_LIMIT}) AS lim FROM se),
od AS (SELECT o AS origin, CAST((o * 31 + i * 977 + 7) % (SELECT count(*) FROM part) AS BIGINT) AS node, (o + i) % 24 AS hour, (o // 20 + i) % 5 = 0 AS test FROM ({ORIGINS}) CROSS JOIN (VALUES (0), (1), (2)) w(i)),
oc AS (SELECT od.*, {HAV('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS crow FROM od JOIN nd a ON a.node = od.origin JOIN nd b ON b.node = od.node),
os AS (SELECT *, {fx.curve_sql('crow')} AS seconds FROM oc WHERE crow >= 0.3 AND origin <> node)"""
_OD_BODY = f"""WITH RECURSIVE {paths_sql(ORIGINS, 'ew', 'length')},
par AS (SELECT s.origin, e.v AS node, min(e.u) AS parent FROM sp s JOIN ew e ON e.u = s.node JOIN sp t ON t.origin = s.origin AND t.node = e.v AND t.dist = s.dist + e.length WHERE e.v <> s.origin GROUP BY 1, 2),
tw AS (SELECT o AS origin, o AS node, CAST(0 AS DOUBLE) AS km, CAST(0 AS DOUBLE) AS lim FROM ({ORIGINS}) UNION ALL SELECT tw.origin, p.node, tw.km + e.km, tw.lim + e.lim FROM tw JOIN par p ON p.origin = tw.origin AND p.parent = tw.node JOIN ew e ON e.u = p.parent AND e.v = p.node),
er AS (SELECT abs(1.4 * lim - seconds) AS p, abs(5 * km + CAST(1.2 AS DOUBLE) * lim + 9 * km * CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 AS INT) - seconds) AS h FROM os JOIN tw USING (origin, node) WHERE test)
SELECT 'prior' AS model, count(*) AS n, avg(p) AS mae FROM er UNION ALL SELECT 'by_hand', count(*), avg(h) FROM er"""


@query("model:s n:i mae:d", _OD, _OD_BODY)
def od_route_errors(spark, d):
    """What given weights miss held-out trips by, on their shortest routes."""
    e, trips = od_inputs(spark, d)
    rows, columns, names = roads.trip_columns(e, trips.where("test"))
    return roads.route_errors(rows, columns, {"prior": graph.prior_weights(), "by_hand": [_BY_HAND.get(n, 0.0) for n in names]})


@query("model:s n:i mae:d")
def od_sampling_check(spark, d):
    """The prior's error and the fitted weights' on held-out trips."""
    e, trips = od_inputs(spark, d)
    return roads.sampling_check(e, trips, F.col("test"))


#: Street features of the pace regression; residential roads are the reference.
STREET = [f"share_{g}" for g in graph.ROAD_GROUPS if g != "residential"] + ["share_oneway", "share_20mph", "share_bus_lane", "share_bridge_tunnel", "junctions_per_km", "signals_per_km"]


@query("name:s coefficient:d")
def street_pace(spark, d):
    """The pace regression on street features, residential roads as the reference."""
    return fitting.pace_regression(held(_by_road(spark, d)), street=STREET)


@query("name:s coefficient:d low:d high:d sd:d")
def street_effects(spark, d):
    """What a standard deviation of each street feature adds to the pace, with its interval over resamples."""
    return fitting.street_effects(held(_by_road(spark, d)), STREET)


@query("dropped:s mae:d change:d")
def street_ablation(spark, d):
    """The error on held-out trips without each of ten groups of street features, and without all of them."""
    rows = held(_by_road(spark, d))
    train = rows.where("cal_year <= 1999")
    columns = [*ml.FEATURES, *[c for g in ml.STREET_GROUPS.values() for c in g]]
    return ml.ablation(held(ml.features(train, train)), ml.features(rows.where("cal_year = 2000"), train), ml.STREET_GROUPS, columns)
