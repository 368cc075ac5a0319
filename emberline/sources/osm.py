"""OpenStreetMap extracts: PBF files to tables of nodes and ways, and on to street edges."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.operators.chains import joined
from emberline.operators.graph import drivable
from emberline.sources import ranges

NODES = "node_id long, lon double, lat double, tags map<string,string>"
WAYS = "way_id long, refs array<long>, tags map<string,string>"
# The tags that mark a way with a bus lane.
BUS_LANE_TAGS = ("busway", "busway:both", "busway:left", "busway:right", "bus:lanes", "lanes:bus", "lanes:psv", "psv:lanes", "bus:lanes:forward", "bus:lanes:backward")
#: Way tags that a street's rules and attributes are read from.
STREET_TAGS = ("highway", "area", "access", "motor_vehicle", "motorcar", "service", "oneway", "maxspeed", "lanes", "width", "bridge", "tunnel", "junction")


def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message: numbers, and bytes of whatever has a length."""
    at = 0
    while at < len(raw):
        key, at = _number(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(raw, at)
        elif kind == 2:
            size, at = _number(raw, at)
            value, at = raw[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a PBF block")
        yield key >> 3, value


def _message(raw: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in _fields(raw):
        out.setdefault(number, []).append(value)
    return out


def _packed(raw: bytes) -> np.ndarray:
    """Varints that follow each other, as unsigned 64-bit numbers."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    starts = np.r_[0, np.flatnonzero(data < 128)[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    return np.bitwise_or.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).view(np.int64) ^ -(values & np.uint64(1)).view(np.int64)


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blobs(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """Place and size of the data blobs of a file; their bytes are passed over."""
    at = 0
    while len(prefix := file.read(4)) == 4:
        (size,) = struct.unpack(">I", prefix)
        head = _message(file.read(size))
        at += 4 + size
        if head[1][0] == b"OSMData":
            yield at, head[3][0]
        at += head[3][0]
        file.seek(at)


def _unpacked(blob: bytes) -> dict[int, list]:
    part = _message(blob)
    if 1 in part:
        return _message(part[1][0])
    if 3 in part:
        return _message(zlib.decompress(part[3][0]))
    raise ValueError("a PBF block is compressed in a way other than zlib")


def _tags(strings: list[str], keys: list, values: list) -> list[tuple[str, str]]:
    if not keys:
        return []
    pairs = zip(_packed(keys[0]).tolist(), _packed(values[0]).tolist(), strict=True)
    return list({strings[k]: strings[v] for k, v in pairs}.items())


def _nodes(block: dict[int, list], strings: list[str]) -> Iterator[tuple]:
    step = block.get(17, [100])[0]
    off_lat, off_lon = (_long(block.get(n, [0])[0]) for n in (19, 20))
    degrees = lambda off, v: (off + step * v) / 1e9
    for group in map(_message, block.get(2, [])):
        for node in map(_message, group.get(1, [])):
            yield _signed(node[1][0]), degrees(off_lon, _signed(node[9][0])), degrees(off_lat, _signed(node[8][0])), _tags(strings, node.get(2), node.get(3))
        for dense in map(_message, group.get(2, [])):
            ids, lat, lon = (np.cumsum(_zigzag(_packed(dense[n][0]))) for n in (1, 8, 9))
            marks = _packed(dense[10][0]).tolist() if 10 in dense else []
            at = 0
            for d, x, y in zip(ids.tolist(), degrees(off_lon, lon).tolist(), degrees(off_lat, lat).tolist(), strict=True):
                tags = {}
                while at < len(marks) and marks[at]:
                    tags[strings[marks[at]]] = strings[marks[at + 1]]
                    at += 2
                at += 1
                yield d, x, y, list(tags.items())


def _ways(block: dict[int, list], strings: list[str]) -> Iterator[tuple]:
    for group in map(_message, block.get(2, [])):
        for way in map(_message, group.get(3, [])):
            refs = np.cumsum(_zigzag(_packed(way[8][0]))).tolist() if 8 in way else []
            yield _long(way[1][0]), refs, _tags(strings, way.get(2), way.get(3))


def _decoded(blocks: DataFrame, decode, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(blocks.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                block = _unpacked(blob.as_py())
                strings = [s.decode("utf-8", "replace") for s in _message(block[1][0]).get(1, [])] if 1 in block else []
                rows = list(decode(block, strings))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return blocks.mapInArrow(run, schema)


def pbf(spark: SparkSession, path: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lon, lat, tags) and ways (way_id, refs, tags) of PBF files of any size.

    One task a file reads the headers of its blocks and passes over the rest;
    the places of the blocks, up to 32 MB each by the format's rules, are dealt
    to `tasks` tasks (the session's shuffle partitions unless given), which read,
    unpack and decode one at a time. Relations and metadata are skipped. Tasks
    open the files themselves (ranges.opened), so executors must reach them.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with ranges.opened(uri) as file:
                    found = list(_blobs(file))  # a place and a size a block
                yield pa.record_batch([pa.array([uri] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["file", "at", "size"])

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = ranges.listed(spark, path).select("file").mapInArrow(index, "file string, at long, size long").repartition(tasks)
    blocks = ranges.read(places).select("data")
    return _decoded(blocks, _nodes, NODES), _decoded(blocks, _ways, WAYS)


def tagged_points(nodes: DataFrame) -> DataFrame:
    """lon, lat, highway, crossing and traffic_calming of the nodes that have one of the three tags."""
    tags = [F.col("tags")[t].alias(t) for t in ("highway", "crossing", "traffic_calming")]
    return nodes.select("lon", "lat", *tags).where("highway IS NOT NULL OR crossing IS NOT NULL OR traffic_calming IS NOT NULL")


def bus_ways(ways: DataFrame) -> DataFrame:
    """osmid of the streets that a bus tag other than no marks."""
    on = [F.coalesce(~F.col("tags")[t].isin("no", ""), F.lit(False)) for t in BUS_LANE_TAGS]
    return ways.where(F.col("tags")["highway"].isNotNull() & F.exists(F.array(*on), lambda x: x)).select(F.col("way_id").alias("osmid"))


def features(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float], key: str, value: str | None = None) -> DataFrame:
    """element (node or way), osm_id, lon, lat and tags of what carries a tag within a box of west, south, east and north.

    A node is in the box by its place, a way by any of its nodes; nodes missing
    from the table are left out of a way, and a way with none gives nothing.
    The point of a closed way lies inside it: midway on the widest stretch of a
    line of latitude through it, that between the two nodes next to its middle.
    The point of an open way is the inner node nearest to the line's centre, or
    the nearer end where there is none. Relations are skipped. Of an element
    that several files hold, one is taken.
    """
    west, south, east, north = box
    within = lambda lon, lat: F.col(lon).between(west, east) & F.col(lat).between(south, north)
    tag = F.col("tags")[key]
    tagged = tag.isNotNull() if value is None else F.coalesce(tag == value, F.lit(False))
    points = nodes.where(tagged & within("lon", "lat")).dropDuplicates(["node_id"]).select(F.lit("node").alias("element"), F.col("node_id").alias("osm_id"), "lon", "lat", "tags")
    steps = ways.where(tagged).select("way_id", "tags", F.posexplode("refs").alias("at", "node_id"))
    known = steps.join(nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "node_id").dropDuplicates(["way_id", "at"])
    # a way has 2000 nodes at most, by the data's rules
    line = known.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("at", "node_id", "x", "y"))).alias("line"), F.first("tags").alias("tags"), F.max(within("x", "y")).alias("near")).where("near")
    n, at = F.size("line"), lambda i: F.col("line")[i]
    hops = F.sequence(F.lit(1), n - 1)
    ys = F.transform("line", lambda p: p["y"])
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    scan = (F.array_max(F.filter(ys, lambda y: y <= middle)) + F.array_min(F.filter(ys, lambda y: y > middle))) / 2
    closed = (n > 3) & (at(0)["node_id"] == F.element_at("line", -1)["node_id"])
    met = F.filter(hops, lambda i: (at(i - 1)["y"] > F.col("scan")) != (at(i)["y"] > F.col("scan")))
    across = F.array_sort(F.transform(met, lambda i: at(i - 1)["x"] + (F.col("scan") - at(i - 1)["y"]) / (at(i)["y"] - at(i - 1)["y"]) * (at(i)["x"] - at(i - 1)["x"])))
    spans = F.transform(F.filter(F.sequence(F.lit(0), F.size("across")), lambda i: (i % 2 == 1) & (i < F.size("across"))), lambda i: F.struct((F.col("across")[i] - F.col("across")[i - 1]).alias("width"), (-i).alias("first"), ((F.col("across")[i] + F.col("across")[i - 1]) / 2).alias("x")))
    lengths = F.transform(hops, lambda i: F.sqrt(F.pow(at(i)["x"] - at(i - 1)["x"], 2) + F.pow(at(i)["y"] - at(i - 1)["y"], 2)))
    centre = lambda c: F.aggregate(hops, F.lit(0.0), lambda t, i: t + F.col("lengths")[i - 1] * (at(i - 1)[c] + at(i)[c]) / 2) / F.nullif(F.aggregate("lengths", F.lit(0.0), lambda t, d: t + d), F.lit(0.0))
    inner = F.when(n > 2, F.slice("line", F.lit(2), n - 2)).otherwise(F.col("line"))
    off = F.transform(inner, lambda p: F.struct(F.coalesce(F.pow(p["x"] - F.col("cx"), 2) + F.pow(p["y"] - F.col("cy"), 2), F.lit(0.0)).alias("d"), p["at"].alias("at"), p["x"].alias("x"), p["y"].alias("y")))
    rings = line.where(closed & scan.isNotNull()).withColumn("scan", scan).withColumn("across", across).withColumn("best", F.array_max(spans)).select("way_id", F.col("best.x").alias("lon"), F.col("scan").alias("lat"), "tags")
    lone = line.where(n == 1).select("way_id", at(0)["x"].alias("lon"), at(0)["y"].alias("lat"), "tags")
    lines = line.where((n > 1) & ~(closed & scan.isNotNull())).withColumn("lengths", lengths).withColumns({"cx": centre("x"), "cy": centre("y")}).withColumn("best", F.array_min(off)).select("way_id", F.col("best.x").alias("lon"), F.col("best.y").alias("lat"), "tags")
    drawn = rings.unionByName(lines).unionByName(lone)
    return points.unionByName(drawn.select(F.lit("way").alias("element"), F.col("way_id").alias("osm_id"), "lon", "lat", "tags"))


def street_edges(nodes: DataFrame, ways: DataFrame, join: bool = True) -> DataFrame:
    """Directed street edges of the drivable ways, as edge_features() takes them.

    Ways are cut where drivable ways meet or a way meets itself, and at their
    ends; those that merely go on in each other are joined then (chains.joined)
    unless `join` is false.
    One-way streets (oneway yes, true or 1) and roundabouts have the edge
    forward, those of -1 or reverse backward, all others one each way. length
    is in metres along the line; key numbers the edges between two nodes.
    Nodes missing from the table are left out of the line; a way with fewer
    than two known nodes gives nothing.
    """
    streets = drivable(ways.select("way_id", "refs", *[F.col("tags")[t].alias(t) for t in STREET_TAGS]))
    steps = streets.select("way_id", F.posexplode("refs").alias("at", "node_id"))
    met = steps.groupBy("node_id").agg((F.count("*") > 1).alias("met"))
    known = steps.join(met, "node_id").join(nodes.select("node_id", F.col("lon").alias("x"), F.col("lat").alias("y")).dropDuplicates(["node_id"]), "node_id")
    # a way has 2000 nodes at most, by the data's rules
    line = known.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("at", "node_id", "x", "y", "met"))).alias("line"))
    numbers = F.sequence(F.lit(0), F.size("line") - 1)
    cuts = F.filter(numbers, lambda i: (i == 0) | (i == F.size("line") - 1) | F.col("line")[i]["met"])
    spans = line.where(F.size("line") > 1).withColumn("cuts", cuts).select("way_id", "line", "cuts", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)).alias("n"))
    begin, end = F.col("cuts")[F.col("n") - 1], F.col("cuts")[F.col("n")]
    part = spans.select("way_id", F.slice("line", begin + 1, end - begin + 1).alias("part")).join(streets.drop("refs"), "way_id")
    back = F.col("oneway").isin("-1", "reverse")
    one = F.col("oneway").isin("yes", "true", "1") | back | (F.col("junction") == "roundabout")
    ways_of = F.when(F.coalesce(back, F.lit(False)), F.array(F.lit(True))).when(F.coalesce(one, F.lit(False)), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    turned = part.withColumn("reverse", F.explode(ways_of)).withColumn("oneway", F.coalesce(one, F.lit(False))).withColumn("part", F.when(F.col("reverse"), F.reverse("part")).otherwise(F.col("part")))
    geometry = F.transform("part", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    hop = lambda i: geo.haversine_km(F.col("part")[i - 1]["x"], F.col("part")[i - 1]["y"], F.col("part")[i]["x"], F.col("part")[i]["y"], geo.RADIUS_TRIP_KM)
    length = F.aggregate(F.sequence(F.lit(1), F.size("part") - 1), F.lit(0.0), lambda total, i: total + hop(i)) * 1000
    drawn = turned.select(
        F.col("part")[0]["node_id"].alias("u"), F.element_at("part", -1)["node_id"].alias("v"), "reverse", F.col("part")[0]["at"].alias("from"), "way_id",
        length.alias("length"), F.array("highway").alias("highway"), "oneway", "maxspeed", "lanes", "width", "bridge", "tunnel", "junction", F.array("way_id").alias("osmid"), geometry.alias("geometry"),
    )
    key = (F.row_number().over(Window.partitionBy("u", "v").orderBy("way_id", "from", "reverse")) - 1).alias("key")
    cut = drawn.select("u", "v", key, *[c for c in drawn.columns if c not in ("u", "v", "reverse", "from", "way_id")])
    return joined(cut).drop("n_parts") if join else cut
