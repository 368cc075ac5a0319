"""Street graphs: edge features, cost policies, shortest paths and sums along them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.functions.text import ROAD_GROUPS, ROAD_TYPES, least_number, limit_kph, mean_number, point_kind, road_group, road_type
from emberline.functions.times import is_rush
from emberline.operators import routing, search
from emberline.sources.tables import forget, held

# Fixed values of the fire-engine routing policy and of the segment speed model.
CONTRAFLOW_MOST_M, CONTRAFLOW_S, BLOCKED = 80.0, 12.0, 1e12
SLOW_FACTOR, FAST_FACTOR, DEADEND_FACTOR = 1.12, 0.94, 1.35
SLOW_ROADS = ("residential", "living_street", "service", "unclassified")
FAST_ROADS = ("trunk", "trunk_link", "primary", "primary_link")
# Patterns of the tags that keep cars out, found anywhere in the tag.
NOT_DRIVABLE = {
    "area": "yes",
    "access": "private",
    "highway": "abandoned|bridleway|bus_guideway|construction|corridor|cycleway|elevator|escalator|footway|no|path|pedestrian|planned|platform|proposed|raceway|razed|rest_area|service|services|steps|track",
    "motor_vehicle": "no",
    "motorcar": "no",
    "service": "alley|driveway|emergency_access|parking|parking_aisle|private",
}
SPEED_KPH = (5.0, 120.0)
POINT_KINDS = ("signals", "calming", "crossing", "give_way")
#: Graphs of so many edges are sent to every task for per-origin searches.
SMALL_GRAPH = 2_000_000
#: Edges of a range of node numbers, about, that one task searches for strongly connected parts.
RANGE_EDGES = 200_000


def drivable(df: DataFrame, highway: str = "highway", rules: dict[str, str] | None = None) -> DataFrame:
    """Ways with a highway tag and no tag that an exclusion pattern is found in."""
    keep = F.col(highway).isNotNull()
    for key, pattern in (rules or NOT_DRIVABLE).items():
        if key in df.columns:
            keep = keep & ~F.coalesce(F.col(key).rlike(pattern), F.lit(False))
    return df.where(keep)


def shortest_parallel(edges: DataFrame, cost: str = "length") -> DataFrame:
    """The cheapest edge of each pair of nodes; of equal ones the smaller key, if there are keys."""
    order = [F.col(cost), *([F.col("key")] if "key" in edges.columns else [])]
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy("u", "v").orderBy(*order))).where("__n = 1").drop("__n")


def edge_features(edges: DataFrame, points: DataFrame, bus_ways: DataFrame) -> DataFrame:
    """One row an edge with its street attributes, bearings and tagged points.

    edges: u, v, key, length, highway (array), oneway, maxspeed, lanes, bridge,
    tunnel, junction, osmid (array), geometry (array of x, y). points: lon, lat,
    highway, crossing, traffic_calming. bus_ways: osmid. Points count from the
    second vertex on; a bridge or tunnel tag counts whatever it says.
    """
    kinds = points.select(F.round("lon", 7).alias("px"), F.round("lat", 7).alias("py"), point_kind(F.col("highway"), F.col("crossing"), F.col("traffic_calming")).alias("kind")).where("kind IS NOT NULL").dropDuplicates(["px", "py"])
    vertex = edges.select("u", "v", "key", F.posexplode("geometry").alias("at", "p")).where("at > 0").select("u", "v", "key", F.round("p.x", 7).alias("px"), F.round("p.y", 7).alias("py"))
    counted = vertex.join(kinds, ["px", "py"]).groupBy("u", "v", "key").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in POINT_KINDS])
    on_bus = edges.select("u", "v", "key", F.explode("osmid").alias("osmid")).join(bus_ways.select("osmid").distinct(), "osmid", "left_semi").select("u", "v", "key").distinct().withColumn("bus_lane", F.lit(True))
    g = F.col("geometry")
    first, second, last, before = g[0], g[1], F.element_at(g, -1), F.element_at(g, -2)
    tagged = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return edges.join(counted, ["u", "v", "key"], "left").join(on_bus, ["u", "v", "key"], "left").select(
        "u", "v", "key", F.col("length").cast("double").alias("length"), road_group(F.col("highway")[0]).alias("road_class"), F.coalesce(F.col("oneway"), F.lit(False)).alias("oneway"),
        least_number(F.col("maxspeed")).alias("maxspeed_mph"), mean_number(F.col("lanes")).alias("lanes"), (tagged("bridge") | tagged("tunnel")).alias("bridge_tunnel"),
        F.coalesce(F.col("junction").isin("roundabout", "circular"), F.lit(False)).alias("roundabout"), F.coalesce("bus_lane", F.lit(False)).alias("bus_lane"),
        *[F.coalesce(k, F.lit(0)).alias(k) for k in POINT_KINDS],
        geo.bearing(first["x"], first["y"], second["x"], second["y"]).alias("bearing_start"), geo.bearing(before["x"], before["y"], last["x"], last["y"]).alias("bearing_end"),
    )


def engine_cost(edges: DataFrame) -> DataFrame:
    """edges (length, highway, maxspeed text, contraflow, busway, noexit) with the seconds of a fire engine, cost_s."""
    length = F.coalesce("length", F.lit(0.0))
    first = F.regexp_extract(F.coalesce("maxspeed", F.lit("")), r"(\d+)", 1).try_cast("double")
    kph = F.coalesce(F.least(F.greatest(first, F.lit(15.0)), F.lit(70.0)), F.lit(35.0))
    cost = F.when(length <= 0, F.lit(1.0)).otherwise(length / 1000.0 / kph * 3600.0)
    contra = F.coalesce("contraflow", F.lit(False))
    cost = F.when(contra & (length > CONTRAFLOW_MOST_M), F.lit(BLOCKED)).when(contra, cost + CONTRAFLOW_S).otherwise(cost)
    slow, fast = F.coalesce(F.col("highway").isin(*SLOW_ROADS), F.lit(False)), F.coalesce(F.col("highway").isin(*FAST_ROADS), F.lit(False)) | F.coalesce("busway", F.lit(False))
    cost = F.when(slow, cost * SLOW_FACTOR).when(fast, cost * FAST_FACTOR).otherwise(cost)
    end = F.coalesce("noexit", F.lit(False)) | F.coalesce(F.col("highway") == "turning_circle", F.lit(False))
    return edges.withColumn("cost_s", F.when(end, cost * DEADEND_FACTOR).otherwise(cost))


def segment_features(edges: DataFrame, hour: Column) -> tuple[DataFrame, list[Column], list[str]]:
    """edges with speed-model attributes, and the model's 14 columns for an hour."""
    kind = road_type(F.col("highway"))
    rows = edges.withColumn("road_type", kind).withColumn("limit_kph", limit_kph(F.col("maxspeed"), F.col("road_type")))
    narrow = F.when(F.col("road_type").isin("residential", "other"), F.lit(1.0)).otherwise(F.lit(2.0))
    lead = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"([0-9.]+)", 1).try_cast("double")
    rows = rows.withColumn("lanes_n", F.coalesce(lead("lanes"), narrow)).withColumn("width_m", F.coalesce(lead("width"), F.col("lanes_n") * 3.5))
    angle = F.lit(6.283185307179586) * F.pmod(hour, F.lit(24)) / 24.0
    cols = [F.lit(1.0), 3600.0 / F.greatest("limit_kph", F.lit(1.0)), F.col("lanes_n"), F.col("width_m"), *[(F.col("road_type") == t).cast("double") for t in ROAD_TYPES], is_rush(hour).cast("double"), F.sin(angle), F.cos(angle)]
    return rows, cols, ["intercept", "limit_s_per_km", "lanes", "width_m", *[f"rt_{t}" for t in ROAD_TYPES], "rush", "hour_sin", "hour_cos"]


def prior_weights(factor: float = 1.4) -> list[float]:
    return [0.0, factor, *[0.0] * 12]


def slowness(cols: Sequence[Column], weights: Sequence[float]) -> Column:
    """Seconds a km, within the bounds of speed."""
    raw = sum((c * float(w) for c, w in zip(cols, weights, strict=True)), F.lit(0.0))
    return F.least(F.greatest(raw, F.lit(3600.0 / SPEED_KPH[1])), F.lit(3600.0 / SPEED_KPH[0]))


def shortest_paths(edges: DataFrame, origins: DataFrame, cost: str = "length") -> DataFrame:
    """origin, node, dist and parent of the shortest path from each origin to each node it reaches, in graphs of any size.

    Graphs of up to SMALL_GRAPH edges are searched in the tasks of the origins, larger ones
    region by region. Of several shortest ways in, the
    parent is the smallest node (edges of no length only where there is no other).
    """
    return search_by_origin(edges, origins, cost)


def _by_region(edges: DataFrame, origins: DataFrame, cost: str) -> DataFrame:
    return routing.paths_by_region(shortest_parallel(edges, cost).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col(cost).cast("double").alias("c")), origins)


def search_by_origin(edges: DataFrame, origins: DataFrame, cost: str = "length", values: Sequence[str] = (), last_turns: bool = False) -> DataFrame:
    """The result of shortest_paths(), with the sums of edge values along each path, by searches in the tasks of the origins, for graphs of up to SMALL_GRAPH edges.

    The graph is sent to every task once its size is checked, and a task searches
    some origins together; larger graphs are searched by region, and sums made by tree_sums(). With last_turns,
    n_turns and n_sharp_turns at the junction before the last edge are told too, as by turns().
    """
    ends = ["bearing_start", "bearing_end"] if last_turns else []
    e = held(shortest_parallel(edges, cost).select("u", "v", F.col(cost).cast("double").alias("__cost"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values], *[F.col(c).cast("double").alias(c) for c in ends]))
    extra = ("n_turns", "n_sharp_turns") if last_turns else ()
    if e.count() > SMALL_GRAPH:
        paths = _by_region(edges, origins, cost)
        if not values and not last_turns:
            return paths
        paths = held(paths)
        sums = tree_sums(paths, edges, values, cost) if values else paths.select("origin", "node")
        sums = sums.join(turns(paths, edges, cost), ["origin", "node"], "left") if last_turns else sums
        return paths.join(sums, ["origin", "node"]).select("origin", "node", "dist", "parent", *values, *extra)
    t = e.toArrow()  # SMALL_GRAPH rows at most, as columns of numbers
    column = lambda c: t.column(c).to_numpy()
    net = search.Net(column("u").astype(np.int64), column("v").astype(np.int64), column("__cost"))
    table = np.stack([column(c)[net.order] for c in values], axis=1) if values else np.zeros((t.num_rows, 0))
    bearings = np.stack([column(c)[net.order] for c in ends], axis=1) if last_turns else None
    shipped = edges.sparkSession.sparkContext.broadcast((net, table, bearings))
    names = ["origin", "node", "dist", "parent", *values, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, table, bearings = shipped.value
        n, plain = len(net.nodes), None
        for batch in batches:
            origins = batch.column(0).to_numpy()
            at = net.places(origins)
            for origin in origins[at < 0]:
                yield pa.record_batch([pa.array([x], t) for x, t in zip([origin, origin, 0.0, None, *[0.0] * len(values), *[None] * len(extra)], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * len(values), *[pa.int32()] * len(extra)], strict=True)], names=names)
            at = at[at >= 0]
            free = len(net.cost) and not net.cost.min() > 0
            together = net.together(len(values) + 3)
            for k in range(0, len(at), together):
                own = at[k : k + together]
                if free:
                    plain = plain or _in_lists(net)
                    dist, last = (np.concatenate(x) for x in zip(*[_one_search(*plain, n, int(i)) for i in own], strict=True))
                    places = np.flatnonzero(np.isfinite(dist))
                    edges = last[places]
                    sums = _free_sums(net, dist, places, edges, table)
                else:
                    dist = net.distances(own)
                    places = np.flatnonzero(np.isfinite(dist))
                    edges = net.ways_in(dist, places)
                    sums = net.sums(dist, places, edges, table)[0] if values else np.zeros((len(places), 0))
                parent = np.where(edges >= 0, net.nodes[net.tail[edges]], -1) if len(net.cost) else np.full(len(places), -1)
                columns = [pa.array(net.nodes[own[places // n]]), pa.array(net.nodes[places % n]), pa.array(dist[places]), pa.array(parent, mask=edges < 0), *[pa.array(sums[:, i]) for i in range(len(values))]]
                if extra:
                    up = np.searchsorted(places, places - places % n + net.tail[edges])
                    before = np.where(edges >= 0, edges[np.minimum(up, len(places) - 1)], -1)
                    bend = np.abs(bearings[before, 1] - bearings[edges, 0]) % 360.0
                    bend = np.minimum(bend, 360.0 - bend)
                    columns += [pa.array((bend > most).astype(np.int32), mask=(before < 0) | np.isnan(bend)) for most in (45, 120)]
                whole = pa.record_batch(columns, names=names)
                for low in range(0, whole.num_rows, 1 << 16):
                    yield whole.slice(low, 1 << 16)

    asked = origins.select(F.col("origin").cast("long").alias("origin")).distinct().dropna()
    schema = ", ".join(["origin long, node long, dist double, parent long", *[f"`{v}` double" for v in values], *[f"{c} int" for c in extra]])
    return asked.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "origin").mapInArrow(run, schema)


def _in_lists(net: search.Net) -> tuple[list[int], list[float], list[int]]:
    return net.head.tolist(), net.cost.tolist(), net.first.tolist()


def _one_search(heads: list[int], costs: list[float], first: list[int], n: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all nodes and the last edges of their ways, by a heap, in graphs with edges of no cost."""
    dist, last, tail, heap, done = {start: 0.0}, {start: -1}, {start: -1}, [(0.0, start)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for e in range(first[u], first[u + 1]):
            v, far = heads[e], d + costs[e]
            known = dist.get(v, float("inf"))
            if far < known:
                dist[v], last[v], tail[v] = far, e, u
                heapq.heappush(heap, (far, v))
            elif far == known and costs[e] > 0 and v != start and u < tail[v]:
                last[v], tail[v] = e, u
    far, edges = np.full(n, np.inf), np.full(n, -1)
    far[list(dist)], edges[list(last)] = list(dist.values()), list(last.values())
    return far, edges


def _free_sums(net: search.Net, dist: np.ndarray, places: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of values along the ways, by doubling steps, where edges of no cost leave no order of distance."""
    n = len(net.nodes)
    out = np.where(edges[:, None] >= 0, table[edges], 0.0) if len(net.cost) else np.zeros((len(places), table.shape[1]))
    up = np.where(edges >= 0, np.searchsorted(places, places - places % n + net.tail[edges]), -1) if len(net.cost) else np.full(len(places), -1)
    while (up >= 0).any():
        rows = np.flatnonzero(up >= 0)
        out[rows], up[rows] = out[rows] + out[up[rows]], up[up[rows]]
    return out


def path_nodes(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """origin, dest, node and dist of every node on the path of each pair (origin, dest), both ends among them; nothing where there is no path.

    paths as from shortest_paths(). Nodes known to be on a path bring those as
    many steps before them as are known, so that a path takes as many rounds as
    its length has binary digits.
    """
    up = held(paths.where("parent IS NOT NULL").select("origin", "node", F.col("parent").alias("up")))
    on = held(pairs.distinct().join(paths.select("origin", F.col("node").alias("dest")), ["origin", "dest"], "left_semi").select("origin", "dest", F.col("dest").alias("node")))
    while True:
        more = held(on.join(up, ["origin", "node"]).select("origin", "dest", F.col("up").alias("node")))
        if more.isEmpty():
            break
        further = held(up.join(up.select("origin", F.col("node").alias("up"), F.col("up").alias("next")), ["origin", "up"]).select("origin", "node", F.col("next").alias("up")))
        both = held(on.unionByName(more))
        forget(on, more, up)
        on, up = both, further
    forget(more, up)
    return on.join(paths.select("origin", "node", "dist"), ["origin", "node"]).select("origin", "dest", "node", "dist")


def tree_sums(paths: DataFrame, edges: DataFrame, values: Sequence[str], cost: str = "length", at_nodes: DataFrame | None = None) -> DataFrame:
    """origin, node and the sums of edge values along the path from the origin, by pointer doubling.

    at_nodes (origin, node, and columns) adds values that depend on the origin,
    such as turns before a node. A pair that has come to its origin is not joined again.
    """
    e = shortest_parallel(edges, cost).select(F.col("u").alias("parent"), F.col("v").alias("node"), *values)
    own = paths.select("origin", "node", "parent").join(e, ["parent", "node"], "left")
    names = list(values)
    if at_nodes is not None:
        own = own.join(at_nodes, ["origin", "node"], "left")
        names += [c for c in at_nodes.columns if c not in ("origin", "node")]
    now = held(own.select("origin", "node", F.col("parent").alias("up"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in names]))
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select("origin", F.col("node").alias("up"), F.col("up").alias("next"), *[F.col(v).alias(f"a_{v}") for v in names])
        further = now.where("up IS NOT NULL").join(above, ["origin", "up"]).select("origin", "node", F.col("next").alias("up"), *[(F.col(v) + F.col(f"a_{v}")).alias(v) for v in names])
        last, now = now, held(now.where("up IS NULL").unionByName(further))
        forget(last)
    return now.drop("up")


def route_values(edges: DataFrame) -> DataFrame:
    """Edges with the length-weighted and counted columns that route ratios are made of."""
    n = F.col("length")
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0.0)
    return edges.withColumns({
        **{f"len_{g}": flag(F.col("road_class") == g) for g in ROAD_GROUPS},
        "len_total": n, "len_oneway": flag(F.col("oneway")), "len_20mph": flag(F.col("maxspeed_mph") <= 20), "len_bus_lane": flag(F.col("bus_lane")), "len_bridge_tunnel": flag(F.col("bridge_tunnel")),
        "lanes_x_len": F.coalesce(F.col("lanes") * n, F.lit(0.0)), "len_lanes_tagged": flag(F.col("lanes").isNotNull()),
        "n_junctions": F.lit(1.0), "n_roundabouts": F.col("roundabout").cast("double"), **{f"n_{k}": F.col(k).cast("double") for k in POINT_KINDS},
    })


ROUTE_VALUES = [*[f"len_{g}" for g in ROAD_GROUPS], "len_total", "len_oneway", "len_20mph", "len_bus_lane", "len_bridge_tunnel", "lanes_x_len", "len_lanes_tagged", "n_junctions", "n_roundabouts", *[f"n_{k}" for k in POINT_KINDS]]


def route_ratios(sums: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Shares of length and counts a km of routes; null on routes of no length. Columns to keep come last."""
    n = F.nullif("len_total", F.lit(0.0))
    return sums.select(
        "origin", "node", *[(F.col(f"len_{g}") / n).alias(f"share_{g}") for g in ROAD_GROUPS],
        *[(F.col(f"len_{c}") / n).alias(f"share_{c}") for c in ("oneway", "20mph", "bus_lane", "bridge_tunnel")],
        (F.col("lanes_x_len") / F.nullif("len_lanes_tagged", F.lit(0.0))).alias("mean_lanes"),
        *[(F.col(f"n_{c}") / (n / 1000.0)).alias(f"{c}_per_km") for c in ("junctions", "roundabouts", *POINT_KINDS)], *kept,
    )


def turns(paths: DataFrame, edges: DataFrame, cost: str = "length") -> DataFrame:
    """origin, node, n_turns and n_sharp_turns (over 45 and 120 degrees) at the junction before the last edge."""
    e = shortest_parallel(edges, cost).select("u", "v", "bearing_start", "bearing_end")
    p = paths.select("origin", "node", "parent")
    up = p.select("origin", F.col("node").alias("parent"), F.col("parent").alias("grand"))
    last = e.select(F.col("u").alias("parent"), F.col("v").alias("node"), "bearing_start")
    before = e.select(F.col("u").alias("grand"), F.col("v").alias("parent"), "bearing_end")
    angle = geo.turn_angle(F.col("bearing_end"), F.col("bearing_start"))
    return p.join(up, ["origin", "parent"]).join(last, ["parent", "node"]).join(before, ["grand", "parent"]).select("origin", "node", (angle > 45).cast("int").alias("n_turns"), (angle > 120).cast("int").alias("n_sharp_turns"))


def reached(edges: DataFrame, start: int) -> DataFrame:
    """node: all that can be reached from start, breadth first; each round joins the nodes that are new alone."""
    e = held(edges.select("u", "v").distinct())
    known = front = edges.sparkSession.createDataFrame([(start,)], "node long")
    while True:
        step = front.join(e, front.node == e.u).select(F.col("v").alias("node")).distinct()
        front = held(step.join(known, "node", "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def largest_component(edges: DataFrame) -> DataFrame:
    """node: the largest strongly connected component; of equally large ones, that with the smallest node.

    Graphs of up to SMALL_GRAPH edges are searched depth first on the driver,
    as arrays of their ends. Larger ones are contracted first: what is strongly
    connected among neighbouring numbers becomes one node, in a task for each
    range of them, as long as that takes a tenth of the edges away. If the graph is still
    larger then, forward and backward reach from the
    busiest node left are joined, until the rest is smaller.
    """
    ends = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct()
    if ends.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH:
        return _largest_in_memory(ends, None)
    every = held(ends)
    ends, names, n = _contracted(every)
    if n <= SMALL_GRAPH:
        tops = _largest_in_memory(ends, names).withColumnRenamed("node", "top")
        return names.join(tops, "top", "left_semi").select("node")
    ends = every
    left, best, best_n = held(ends), None, (0, 0)
    while True:
        nodes = left.select(F.col("u").alias("node")).union(left.select("v")).groupBy("node").agg(F.count("*").alias("d"))
        total = nodes.count()
        if total < best_n[0] or not total:
            return ends.select(F.col("u").alias("node")).where("false") if best is None else best
        pivot = nodes.agg(F.max(F.struct("d", (-F.col("node")).alias("n"))).alias("b")).first().b
        start = -pivot.n
        own = held(reached(left, start).join(reached(left.select(F.col("v").alias("u"), F.col("u").alias("v")), start), "node"))
        n, least = own.agg(F.count("*"), F.min("node")).first()
        if (n, -least) > best_n or best is None:
            best, best_n = own, (n, -least)
        left = held(left.join(own.select(F.col("node").alias("u")), "u", "left_anti").join(own.select(F.col("node").alias("v")), "v", "left_anti"))


def _contracted(ends: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Edges left, names (node, top: the least node of the part that it is in) and the number of edges left, after what is strongly connected among neighbouring numbers became one node, again and again."""
    n, names = ends.count(), None
    while n > SMALL_GRAPH or names is None:
        own = held(_tops_by_range(ends, n))
        names = own if names is None else held(names.join(own.select(F.col("node").alias("top"), F.col("top").alias("__to")), "top", "left").select("node", F.coalesce("__to", "top").alias("top")))
        a, b = own.select(F.col("node").alias("u"), F.col("top").alias("a")), own.select(F.col("node").alias("v"), F.col("top").alias("b"))
        ends = held(ends.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        last, n = n, ends.count()
        if n > last * 0.9:
            break
    return ends, names, n


def ranks(edges: DataFrame) -> DataFrame:
    """node and rank: no edge leads to a smaller rank, so that nothing of a smaller rank than a node's can be reached from it.

    Strongly connected parts are numbered in the order of the edges between them. Where these
    are too many to be numbered in memory (over SMALL_GRAPH), all ranks are 0, which is right and excludes nothing.
    """
    ends = held(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct())
    left, names, n = _contracted(ends)
    if n > SMALL_GRAPH:
        return names.select("node", F.lit(0).cast("long").alias("rank"))
    t = left.toArrow()  # SMALL_GRAPH rows at most
    parts = _strong_parts(t.column("u").to_numpy(), t.column("v").to_numpy())  # those that are led to come first
    tops = pa.table({"top": pa.array([x for p in parts for x in p], pa.int64()), "rank": pa.array(np.repeat(-np.arange(len(parts)), [len(p) for p in parts]), pa.int64())})
    return held(names.join(edges.sparkSession.createDataFrame(tops), "top", "left").select("node", F.coalesce("rank", F.lit(0)).alias("rank")))


def _largest_in_memory(ends: DataFrame, names: DataFrame | None) -> DataFrame:
    """node: the largest component of a small graph; of one whose nodes stand for others (names), by the number of these."""
    t = ends.toArrow()  # SMALL_GRAPH rows at most
    u, v, size = t.column("u").to_numpy(), t.column("v").to_numpy(), {}
    if names is not None:
        sizes = names.groupBy("top").agg(F.count("*").alias("n"))
        met = ends.select(F.col("u").alias("top")).union(ends.select("v")).distinct()
        # of nodes without an edge left only the largest counts, the smallest of equal ones
        alone = sizes.join(met, "top", "left_anti").agg(F.max(F.struct("n", (-F.col("top")).alias("least"))).alias("b")).select((-F.col("b.least")).alias("top"), "b.n").where("top IS NOT NULL")
        w = sizes.join(met, "top", "left_semi").where("n > 1").unionByName(alone).toArrow()
        size = dict(zip(w.column("top").to_pylist(), w.column("n").to_pylist(), strict=True))
        lone = np.array([x.top for x in alone.collect()], dtype=np.int64)
        u, v = np.concatenate([u, lone]), np.concatenate([v, lone])
    parts = _strong_parts(u, v)
    best = max(parts, key=lambda p: (sum(size.get(x, 1) for x in p), -min(p)), default=[])
    return ends.sparkSession.createDataFrame(pa.table({"node": pa.array(sorted(best), pa.int64())}))


def _tops_by_range(ends: DataFrame, n: int) -> DataFrame:
    """node and top: the least node of the strongly connected part that it is in by edges within its range of numbers; ranges have about RANGE_EDGES edges."""
    low, high = ends.agg(F.min(F.least("u", "v")), F.max(F.greatest("u", "v"))).first()
    width = max(1, (high - low + 1) * RANGE_EDGES // max(n, 1))
    at = lambda c: F.floor((F.col(c) - low) / width)

    def run(rows: pa.Table) -> pa.Table:
        u, v = rows.column("u").to_numpy(), rows.column("v").to_numpy()
        parts = _strong_parts(u, v)
        node = np.array([x for p in parts for x in p], dtype=np.int64)
        return pa.table({"node": node, "top": np.repeat(np.array([min(p) for p in parts], dtype=np.int64), [len(p) for p in parts])})

    # an edge to another range names its own end alone
    inner = F.when(at("u") == at("v"), F.col("v")).otherwise(F.col("u"))
    rows = ends.select(at("u").alias("range"), "u", inner.alias("v")).unionByName(ends.where(at("u") != at("v")).select(at("v").alias("range"), F.col("v").alias("u"), "v"))
    return rows.distinct().groupBy("range").applyInArrow(run, "node long, top long")


def _strong_parts(u: np.ndarray, v: np.ndarray) -> list[list[int]]:
    """Nodes of each strongly connected component, by one depth-first search with low links."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    order = np.argsort(a, kind="stable")
    head, first = b[order].tolist(), np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist()
    number, low, on = [-1] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    stack, parts, count = [], [], 0
    for root in range(len(nodes)):
        if number[root] >= 0:
            continue
        work = [(root, first[root])]
        while work:
            i, e = work.pop()
            if number[i] < 0:
                number[i] = low[i] = count
                count += 1
                stack.append(i)
                on[i] = True
            deeper = False
            while e < first[i + 1]:
                j = head[e]
                e += 1
                if number[j] < 0:
                    work += [(i, e), (j, first[j])]
                    deeper = True
                    break
                if on[j]:
                    low[i] = min(low[i], low[j])
            if deeper:
                continue
            if low[i] == number[i]:
                own = []
                while True:
                    j = stack.pop()
                    on[j] = False
                    own.append(j)
                    if j == i:
                        break
                parts.append(nodes[own].tolist())
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[i])
    return parts
