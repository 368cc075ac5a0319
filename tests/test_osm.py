import struct
import zlib

import pytest

from emberline.operators.graph import edge_features
from emberline.sources import osm


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zigzag(n):
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values, strict=False))


def blob(kind, message, packed=True):
    body = field(2, len(message)) + field(3, zlib.compress(message)) if packed else field(1, message)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def block(strings, *groups):
    table = field(1, b"".join(field(1, s.encode()) for s in strings))
    return table + b"".join(field(2, g) for g in groups)


DENSE = {1: (51.5, -0.1), 2: (51.501, -0.1), 3: (51.502, -0.1), 4: (51.502, -0.098), 7_000_000_000: (51.503, -0.1)}
NEGATIVE = (-5, 51.4999999, 0.25)


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    path = tmp_path_factory.mktemp("osm") / "town.osm.pbf"
    ids = list(DENSE)
    tags = {2: [1, 2], 4: [3, 4, 1, 5]}
    marks = b"".join(b"".join(map(varint, tags.get(i, []))) + varint(0) for i in ids)
    dense = field(1, deltas(ids)) + field(8, deltas([round(DENSE[i][0] * 1e7) for i in ids])) + field(9, deltas([round(DENSE[i][1] * 1e7) for i in ids])) + field(10, marks)
    single = varint(1 << 3) + zigzag(NEGATIVE[0]) + varint(8 << 3) + zigzag(round(NEGATIVE[1] * 1e7)) + varint(9 << 3) + zigzag(round(NEGATIVE[2] * 1e7))
    nodes = block(["", "highway", "traffic_signals", "traffic_calming", "hump", "crossing"], field(2, dense), field(1, single))

    strings = ["", "highway", "primary", "residential", "oneway", "-1", "footway", "busway", "lane", "maxspeed", "30 mph"]

    def way(number, pairs, refs):
        keys, values = (b"".join(varint(strings.index(x)) for x in part) for part in zip(*pairs, strict=True))
        return field(3, field(1, number) + field(2, keys) + field(3, values) + field(8, deltas(refs)))

    ways = block(
        strings,
        way(10, [("highway", "primary"), ("busway", "lane"), ("maxspeed", "30 mph")], [1, 2, 3, 7_000_000_000]),
        way(11, [("highway", "residential"), ("oneway", "-1")], [3, 4]),
        way(12, [("highway", "footway")], [2, 4]),
        way(13, [("highway", "residential")], [1, 99]),
    )
    path.write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", nodes) + blob(b"OSMData", ways, packed=False))
    return str(path)


def test_reads_nodes_and_ways(spark, extract):
    nodes, ways = osm.pbf(spark, extract)
    got = {r.node_id: (r.lat, r.lon, r.tags) for r in nodes.collect()}
    want = {i: (*at, {}) for i, at in DENSE.items()} | {NEGATIVE[0]: (*NEGATIVE[1:], {})}
    want[2] = (*DENSE[2], {"highway": "traffic_signals"})
    want[4] = (*DENSE[4], {"traffic_calming": "hump", "highway": "crossing"})
    assert {k: (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9), t) for k, (a, b, t) in want.items()} == got
    assert {r.way_id: (r.refs, r.tags["highway"]) for r in ways.collect()} == {10: ([1, 2, 3, 7_000_000_000], "primary"), 11: ([3, 4], "residential"), 12: ([2, 4], "footway"), 13: ([1, 99], "residential")}
    assert sorted((r.highway, r.traffic_calming) for r in osm.tagged_points(nodes).collect()) == [("crossing", "hump"), ("traffic_signals", None)]
    assert [r.osmid for r in osm.bus_ways(ways).collect()] == [10]


def test_streets_are_cut_at_junctions_and_directed(spark, extract):
    nodes, ways = osm.pbf(spark, extract)
    edges = osm.street_edges(nodes, ways)
    got = {(r.u, r.v): r for r in edges.collect()}
    far = 7_000_000_000
    assert set(got) == {(1, 3), (3, 1), (3, far), (far, 3), (4, 3)}
    assert got[1, 3].length == pytest.approx(222.39, abs=0.05) and [p.y for p in got[3, 1].geometry] == pytest.approx([51.502, 51.501, 51.5])
    assert (got[4, 3].oneway, got[1, 3].oneway, got[1, 3].key) == (True, False, 0)
    features = {(r.u, r.v): r for r in edge_features(edges, osm.tagged_points(nodes), osm.bus_ways(ways)).collect()}
    assert (features[1, 3].signals, features[1, 3].bus_lane, features[1, 3].maxspeed_mph, features[4, 3].calming) == (1, True, 30.0, 0)


def test_no_streets(spark, extract):
    nodes, ways = osm.pbf(spark, extract)
    assert osm.street_edges(nodes, ways.where("way_id = 12")).count() == 0
    assert osm.street_edges(nodes.where("false"), ways).count() == 0


def test_features_have_a_point_inside(spark):
    tags = {"amenity": "fire_station", "name": "A"}
    # a U, open to the north: its centre of mass is outside it
    u = [(0, 0), (9, 0), (9, 6), (8, 6), (8, 2), (1, 2), (1, 6), (0, 6), (0, 0)]
    places = {i: at for i, at in enumerate(u[:-1])} | {20: (50, 50), 21: (3, 3), 22: (0, 10), 23: (4, 10), 24: (10, 10), 25: (60, 60)}
    nodes = spark.createDataFrame([(i, float(x), float(y), tags if i in (20, 21) else {}) for i, (x, y) in places.items()], osm.NODES)
    ways = spark.createDataFrame([(1, [*range(8), 0], tags), (2, [22, 23, 24], tags), (3, [24, 25], tags), (4, [25, 20], tags), (5, [*range(8), 0], {"amenity": "school"}), (6, [24, 99], tags), (7, [99], tags), (8, [], None)], osm.WAYS)
    box = (-1.0, -1.0, 11.0, 11.0)
    got = {(r.element, r.osm_id): (r.lon, r.lat) for r in osm.features(nodes.union(nodes), ways, box, "amenity", "fire_station").collect()}
    # the scan runs at 4, midway between the nodes at 2 and 6; both arms are as wide, the first counts
    assert got == {("node", 21): (3.0, 3.0), ("way", 1): (0.5, 4.0), ("way", 2): (4.0, 10.0), ("way", 3): (10.0, 10.0), ("way", 6): (10.0, 10.0)}
    assert osm.features(nodes, ways, box, "amenity").where("osm_id = 5").count() == 1
    assert osm.features(nodes.where("false"), ways, box, "amenity").count() == 0


def test_ways_that_go_on_in_each_other_are_one_edge(spark):
    nodes = spark.createDataFrame([(i, -0.1, 51.5 + i / 1000, {}) for i in range(6)], osm.NODES)
    ways = spark.createDataFrame([(1, [0, 1, 2], {"highway": "primary", "maxspeed": "30 mph"}), (2, [2, 3], {"highway": "primary", "maxspeed": "20 mph"}), (3, [5, 4, 3], {"highway": "residential"})], osm.WAYS)
    got = {(r.u, r.v): r for r in osm.street_edges(nodes, ways).collect()}
    assert set(got) == {(0, 5), (5, 0)} and osm.street_edges(nodes, ways, join=False).count() == 6
    assert (got[0, 5].osmid, got[5, 0].highway, got[0, 5].maxspeed) == ([1, 2, 3], ["residential", "primary"], "30 mph;20 mph")
    assert [round(p.y, 3) for p in got[5, 0].geometry] == [51.505, 51.504, 51.503, 51.502, 51.501, 51.5]
    assert got[0, 5].length == pytest.approx(555.97, abs=0.05)


def test_reads_several_files_in_ranges(spark, extract, tmp_path):
    import shutil

    for name in ("a b.pbf", "c%20d.pbf"):
        shutil.copy(extract, tmp_path / name)
    nodes, ways = osm.pbf(spark, str(tmp_path), tasks=3)
    assert (nodes.count(), ways.count()) == (12, 8)
