"""What other networks would have done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.functions.text import closed_name
from emberline.functions.times import DEFAULT_CURVE, FIRST_MEAN_S, TURNOUT_S, Curve
from emberline.operators.quantiles import exact_quantiles
from emberline.operators.spatial import crow, nearest
from emberline.operators.weighted import score_first_engine
from emberline.sources.tables import held

#: The ten stations closed in 2014, at approximate places (latitude, longitude).
CLOSED_2014 = {
    "Belsize": (51.5486, -0.1650),
    "Bow": (51.5290, -0.0210),
    "Clerkenwell": (51.5265, -0.1085),
    "Downham": (51.4262, 0.0130),
    "Kingsland": (51.5459, -0.0759),
    "Knightsbridge": (51.5018, -0.1600),
    "Silvertown": (51.5030, 0.0300),
    "Southwark": (51.5025, -0.0985),
    "Westminster": (51.4975, -0.1325),
    "Woolwich": (51.4905, 0.0640),
}


def closed_sites(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, a, o) for i, (n, (a, o)) in enumerate(CLOSED_2014.items())], "at int, name string, lat double, lon double")


def nearest_untaken(closed: DataFrame, stations: DataFrame) -> list[int]:
    """For each closed site in its order, the nearest station that no earlier one took.

    Each closed site can only need as many of its nearest stations as there are
    closed sites; that many are ranked in Spark and taken on the driver.
    """
    n = closed.count()
    sites = held(stations.select("station_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")))
    ranked = nearest(closed, "at", sites, "station_id", lambda *ends: F.round(crow()(*ends), 9), k=n)
    taken: list[int] = []
    for row in ranked.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("rank", "station_id"))).alias("near")).orderBy("at").collect():
        taken.append(next(x.station_id for x in row.near if x.station_id not in taken))
    return taken


def networks(stations: DataFrame, closed: DataFrame, removed: Sequence[int]) -> DataFrame:
    """network, s_lat and s_lon of the current network, of it without the removed stations, and of it with the closed sites."""
    at = [F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")]
    now = stations.select("station_id", F.lit("current").alias("network"), *at)
    minus = stations.where(~F.col("station_id").isin(*removed)).select("station_id", F.lit("minus_10_nearest").alias("network"), *at)
    plus = stations.select("station_id", F.lit("plus_10_restored").alias("network"), *at).unionByName(closed.select((-1 - F.col("at")).cast("long").alias("station_id"), F.lit("plus_10_restored").alias("network"), *at))
    return now.unionByName(minus).unionByName(plus)


def network_scores(points: DataFrame, nets: DataFrame, curve: Curve = DEFAULT_CURVE) -> DataFrame:
    """First-engine scores by network of the predicted attendance at points (incident_id, lat, lon); networks are few."""
    names = [r.network for r in nets.select("network").distinct().orderBy("network").collect()]
    each = held(points.withColumn("network", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))))
    km = nearest(each, ["incident_id", "network"], nets, "station_id", crow(), by="network")
    return score_first_engine(km.withColumn("response_s", F.round(curve.seconds(F.col("km")) + TURNOUT_S, 6)), ("network",))


def restore_ranking(points: DataFrame, stations: DataFrame, closed: DataFrame, curve: Curve = DEFAULT_CURVE, scale: float = 1.0) -> DataFrame:
    """What each closed site, restored alone, would save."""
    sites = stations.select(F.col("station_id").alias("site"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    base = nearest(points, "incident_id", sites, "site", crow()).select("incident_id", F.col("km").alias("base_km"))
    each = points.join(base, "incident_id").crossJoin(F.broadcast(closed.select("at", "name", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))))
    before = F.round(curve.seconds(F.col("base_km")) + TURNOUT_S, 6)
    after = F.round(curve.seconds(F.least("base_km", "d")) + TURNOUT_S, 6)
    apart = held(each.select("name", "base_km", crow()(*map(F.col, ("lon", "lat", "s_lon", "s_lat"))).alias("d")))  # else each use of a column works distances out anew
    rows = apart.select("name", before.alias("b"), after.alias("a")).withColumn("saved", F.col("b") - F.col("a"))
    helped = F.col("saved") > 1e-6
    out = rows.groupBy("name").agg(
        F.avg("saved").alias("mean_seconds_saved"), (F.sum("saved") * scale / 3600).alias("total_hours_saved"), (F.avg(helped.cast("double")) * 100).alias("incidents_improved_pct"),
        F.coalesce(F.avg(F.when(helped, F.col("saved"))), F.lit(0.0)).alias("mean_saved_when_improved_s"),
        ((F.avg((F.col("a") <= FIRST_MEAN_S).cast("double")) - F.avg((F.col("b") <= FIRST_MEAN_S).cast("double"))) * 100).alias("within_6min_gain_pp"),
    )
    near = nearest(closed, "name", sites, "site", crow()).select("name", F.col("km").alias("nearest_current_station_km"))
    rank = F.row_number().over(Window.orderBy(F.round("mean_seconds_saved", 6).desc(), "name"))
    late = exact_quantiles(rows, "name", "a", [0.9]).select("name", F.col("value").alias("p90_s_after"))
    return out.join(late, "name", "left").join(near, "name").withColumn("rank", rank)


def race(opened: DataFrame, stations: DataFrame, incidents: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """new_id, old_id, incident_id, gain and d_new of the incident in a box that each new site would reach soonest against its nearest old house 0.6 to 3.5 km away."""
    west, south, east, north = box
    inside = lambda df, lon, lat, pad=0.0: df.where(F.col(lon).between(west - pad, east + pad) & F.col(lat).between(south - pad, north + pad))
    new = inside(opened, "lon", "lat").select("new_id", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    old = inside(stations, "lon", "lat", 0.02).select("station_id", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    apart = F.round(geo.haversine_km(F.col("n_lon"), F.col("n_lat"), F.col("o_lon"), F.col("o_lat")), 9)
    pair = new.crossJoin(old).withColumn("km", apart).where((F.col("km") > 0.6) & (F.col("km") < 3.5))
    pair = pair.groupBy("new_id", "n_lat", "n_lon").agg(F.min(F.struct("km", "station_id", "o_lat", "o_lon")).alias("o")).select("new_id", "n_lat", "n_lon", F.col("o.station_id").alias("old_id"), F.col("o.o_lat").alias("o_lat"), F.col("o.o_lon").alias("o_lon"))
    points = inside(incidents.dropna(subset=["dest_lat", "dest_lon"]), "dest_lon", "dest_lat").select("incident_id", "dest_lat", "dest_lon")
    d_new = F.round(geo.haversine_km(F.col("n_lon"), F.col("n_lat"), F.col("dest_lon"), F.col("dest_lat")), 9)
    d_old = F.round(geo.haversine_km(F.col("o_lon"), F.col("o_lat"), F.col("dest_lon"), F.col("dest_lat")), 9)
    rows = points.crossJoin(F.broadcast(pair)).withColumn("d_new", d_new).withColumn("gain", F.round(d_old - F.col("d_new"), 9)).where((F.col("d_new") < 1.8) & (F.col("gain") > 0.35))
    best = rows.groupBy("new_id", "old_id").agg(F.max(F.struct("gain", (-F.col("d_new")).alias("near"), (-F.col("incident_id")).alias("i"))).alias("b"))
    return best.select("new_id", "old_id", (-F.col("b.i")).alias("incident_id"), F.col("b.gain").alias("gain"), (-F.col("b.near")).alias("d_new"))


def track(steps: DataFrame, by: str | Sequence[str], total: str, points: int = 240) -> DataFrame:
    """by, i, t, x and y: positions at even instants along tracks of steps (by, seq, seconds, x, y and the total, one for each track).

    The first step of a track is where it starts; each further one takes its
    seconds (null and negative ones: 0) to come to its x and y. Times are scaled
    to the total, positions are linear between steps. Each step yields the
    instants that it covers, so that no step meets all instants. Instants that
    no step covers (none takes time) stay before the last step; a track of one
    step has one row, at 0. Tracks without a total give no rows.
    """
    keys = [by] if isinstance(by, str) else list(by)
    run, whole = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy(*keys)
    timed = steps.where(F.col(total).isNotNull()).select(*keys, "seq", "x", "y", F.col(total).alias("__total"), F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0)).alias("__s")).withColumn("__n", F.row_number().over(run)).withColumn("__last", F.count("*").over(whole))
    timed = timed.withColumn("__s", F.when(F.col("__n") > 1, F.col("__s")).otherwise(0.0)).withColumn("__at", F.sum("__s").over(run)).withColumn("__share", F.coalesce(F.col("__at") / F.nullif(F.sum("__s").over(whole), F.lit(0.0)), F.lit(0.0)))
    upto = F.when(F.col("__n") == 1, F.when(F.col("__last") == 1, 0).otherwise(-1)).when(F.col("__n") == F.col("__last"), points - 1).otherwise(F.floor(F.col("__share") * (points - 1) + 1e-9)).cast("int")
    before = timed.withColumn("__upto", upto).withColumns({c: F.lag(of).over(run) for c, of in (("__share0", "__share"), ("__x0", "x"), ("__y0", "y"), ("__upto0", "__upto"))})
    first = F.coalesce(F.col("__upto0") + 1, F.lit(0))
    # a step that no instant falls into has an end before its first
    each = before.where(F.col("__upto") >= first).withColumn("i", F.explode(F.sequence(first, F.col("__upto")))).withColumn("t", F.col("i") * F.col("__total") / max(points - 1, 1))
    share = F.coalesce((F.col("i") / max(points - 1, 1) - F.col("__share0")) / F.nullif(F.col("__share") - F.col("__share0"), F.lit(0.0)), F.lit(0.0))
    between = lambda c: F.coalesce(F.col(f"__{c}0") + share * (F.col(c) - F.col(f"__{c}0")), F.col(c))
    return each.select(*keys, "i", "t", between("x").alias("x"), between("y").alias("y"))


def race_tracks(races: DataFrame, places: DataFrame, edges: DataFrame, nodes: DataFrame, cost: str = "cost_s", curve: Curve = DEFAULT_CURVE, points: int = 240) -> DataFrame:
    """new_id, engine, i, t, lat, lon and attend_s: where both engines of each race are on their way over the streets.

    places: new_id, engine, lat, lon, dest_lat, dest_lon and crow_km of an engine's
    start and the incident. Each engine takes the cheapest route between the
    nodes (node, lat, lon) nearest to both; its time is predicted from the
    straight distance, turnout included, and spread over the route by cost. An
    engine without a route has no rows.
    """
    from emberline.operators import roads

    own = held(places.join(races.select("new_id").distinct(), "new_id", "left_semi").withColumn("attend_s", curve.seconds(F.col("crow_km")) + TURNOUT_S))
    starts = roads.snapped(own.select(F.struct("new_id", "engine").alias("k"), "lat", "lon"), "k", nodes).select("k.*", F.col("node").alias("origin"))
    ends = roads.snapped(own.select("new_id", F.col("dest_lat").alias("lat"), F.col("dest_lon").alias("lon")).distinct(), "new_id", nodes).select("new_id", F.col("node").alias("dest"))
    way = held(starts.join(ends, "new_id"))
    pairs = way.select("origin", F.col("dest").alias("node")).distinct()
    edges = held(edges.select("u", "v", cost))
    routes = roads.route_table(edges, pairs.where("origin <> node"), cost, places=nodes, ways=True).where("found").select("origin", "node", *roads.WAY)
    still = pairs.where("origin = node").select("origin", "node", F.array("origin").alias("way"), F.array(F.lit(0.0)).alias("way_cost"))
    each = routes.unionByName(still).select("origin", F.col("node").alias("dest"), F.explode(F.arrays_zip(*roads.WAY)).alias("s"))
    along = held(each.select("origin", "dest", F.col("s.way").alias("node"), F.col("s.way_cost").alias("dist"))).join(nodes.select("node", F.col("lon").alias("x"), F.col("lat").alias("y")), "node")
    by = ["new_id", "engine"]
    run = Window.partitionBy(*by).orderBy("dist", "node")
    steps = way.join(along, ["origin", "dest"]).join(own.select(*by, "attend_s"), by).withColumn("seq", F.row_number().over(run)).withColumn("seconds", F.col("dist") - F.lag("dist").over(run))
    out = track(steps.select(*by, "seq", "seconds", "x", "y", "attend_s"), by, "attend_s", points)
    return out.join(own.select(*by, "attend_s"), by).select(*by, "i", "t", F.col("y").alias("lat"), F.col("x").alias("lon"), "attend_s")


def closed_matches(names: DataFrame, closed: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """name and the closed site it means: equal, then a whole word of it, then the closest by matching blocks.

    The last way runs on the names that are left, a few at a time in Arrow
    batches, against the closed list alone.
    """
    import difflib
    from collections.abc import Iterator

    import pandas as pd

    c = closed.select(F.col("at"), F.col("name").alias("closed"), closed_name(F.col("name")).alias("key"))
    n = names.select("name").dropna().distinct().withColumn("plain", closed_name(F.col("name"))).where("plain <> ''")
    word = F.concat(F.lit(" "), F.col("plain"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("key"), F.lit(" ")))
    tier = F.when(F.col("plain") == F.col("key"), F.lit(1)).when(word, F.lit(2))
    direct = n.crossJoin(F.broadcast(c)).withColumn("tier", tier).where("tier IS NOT NULL").groupBy("name").agg(F.min(F.struct("tier", "at", "closed")).alias("b")).select("name", F.col("b.closed").alias("closed"), F.col("b.tier").alias("tier"))
    keys = {r.key: r.closed for r in c.orderBy("at").collect()}

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = [difflib.get_close_matches(p, list(keys), n=1, cutoff=cutoff) for p in b["plain"]]
            out = pd.DataFrame({"name": b["name"], "closed": [keys[h[0]] if h else None for h in hit], "tier": 3})
            yield out[out["closed"].notna()]

    rest = n.join(direct.select("name"), "name", "left_anti").mapInPandas(close, "name string, closed string, tier int")
    return direct.unionByName(rest)


def presence(names: DataFrame, closed: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """name, listed and as_names of each closed site: the names of a present list that mean it, if any."""
    hits = closed_matches(names, closed, cutoff).groupBy("closed").agg(F.array_sort(F.collect_set("name")).alias("names"))
    own = closed.select("at", F.col("name").alias("closed")).join(hits, "closed", "left")
    return own.select("at", F.col("closed").alias("name"), F.col("names").isNotNull().alias("listed"), F.array_join("names", ", ").alias("as_names"))
