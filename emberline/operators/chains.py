"""Chains of street edges joined into one edge each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.tables import forget, held

#: Texts that a joined edge keeps all different values of.
TEXTS = ("maxspeed", "lanes", "width", "bridge", "tunnel")


def passing_nodes(edges: DataFrame) -> DataFrame:
    """node of each node that a street merely passes: two neighbours, and either one edge in and one out, or one each way to both.

    Loops and parallel edges make a node a junction.
    """
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), F.lit(0).alias("out")))
    sides = ends.groupBy("node", "other").agg(F.sum("out").alias("outs"), F.count("*").alias("n"), (F.col("node") == F.col("other")).alias("loop"))
    whole = sides.groupBy("node").agg(F.count("*").alias("neighbours"), F.sum("outs").alias("outs"), F.sum("n").alias("n"), F.max("outs").alias("most_out"), F.max(F.col("n") - F.col("outs")).alias("most_in"), F.bool_or("loop").alias("loop"))
    return whole.where("neighbours = 2 AND NOT loop AND most_out <= 1 AND most_in <= 1 AND n = 2 * outs").select("node")


def chain_heads(edges: DataFrame) -> DataFrame:
    """id, head (id of a chain's first edge) and hops (from it) of edges (id, u, v); rings without a junction have each edge as its own head.

    Each edge points at the one before it; each round doubles how far it points,
    so a chain takes as many rounds as its length has binary digits. Rounds hold
    a row for each edge that isn't at its head yet, and end when a round brings
    none there: what is left runs in rings.
    """
    node = held(passing_nodes(edges))
    before = edges.join(node, edges["v"] == node["node"], "left_semi").select(F.col("id").alias("prev"), F.col("v").alias("at"), F.col("u").alias("prev_u"))
    follows = edges.join(before, (edges["u"] == before["at"]) & (edges["v"] != before["prev_u"])).select("id", "prev")
    first = edges.join(follows.select("id"), "id", "left_anti").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("hops"))
    done, open_ = held(first), held(follows.select("id", F.col("prev").alias("to"), F.lit(1).cast("long").alias("hops")))
    forget(node)
    ended, left = [done], open_.count()
    while left:
        at_head = ended[0].select(F.col("id").alias("to"), "head", F.col("hops").alias("more"))
        for e in ended[1:]:
            at_head = at_head.unionByName(e.select(F.col("id").alias("to"), "head", F.col("hops").alias("more")))
        further = open_.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        ended.append(held(open_.join(at_head, "to").select("id", "head", (F.col("hops") + F.col("more")).alias("hops"))))
        after = held(open_.join(further, "to").select("id", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops")))
        forget(open_)
        open_, before_, left = after, left, after.count()
        if left == before_:
            break
    rings = open_.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("hops"))
    out = ended[0]
    for e in [*ended[1:], rings]:
        out = out.unionByName(e)
    result = held(out)
    forget(open_, *ended)
    return result


def joined(edges: DataFrame) -> DataFrame:
    """edges (u, v, key, length, highway, oneway, maxspeed, lanes, width, bridge, tunnel, junction, osmid, geometry) with those that go on in each other joined.

    An edge ends where more than one street leaves, at dead ends, where a
    one-way street becomes a two-way one, and at loops and parallel edges. Lengths are added up,
    lines are put together without their common points, highway and osmid keep
    all different values in their order, texts all different values with ";"
    between them, junction its first value. key numbers the edges between two
    nodes anew. Rings without a junction stay as they are. An empty table gives no rows.

    A row holds a whole chain, as a chain is one edge of the result.
    """
    e = held(edges.withColumn("id", F.monotonically_increasing_id()))
    heads = chain_heads(e)
    flat = lambda c: F.array_distinct(F.flatten(F.transform("parts", lambda p: p[c])))
    text = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("parts", lambda p: p[c]), lambda x: x.isNotNull())), ";")
    some = lambda c: F.exists("parts", lambda p: p[c].isNotNull())
    columns = [c for c in edges.columns if c not in ("u", "v", "key")]
    parts = e.join(heads, "id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("hops", "u", "v", *columns))).alias("parts"))
    out = parts.select(
        F.col("parts")[0]["u"].alias("u"), F.element_at("parts", -1)["v"].alias("v"), F.size("parts").alias("n_parts"),
        F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["length"]).alias("length"), flat("highway").alias("highway"), F.col("parts")[0]["oneway"].alias("oneway"),
        *[F.when(some(c), text(c)).alias(c) for c in TEXTS if c in columns], F.try_element_at(F.filter(F.transform("parts", lambda p: p["junction"]), lambda x: x.isNotNull()), F.lit(1)).alias("junction"), flat("osmid").alias("osmid"),
        F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["geometry"]).otherwise(F.slice(p["geometry"], F.lit(2), F.greatest(F.size(p["geometry"]) - 1, F.lit(0)))))).alias("geometry"),
    )
    key = (F.row_number().over(Window.partitionBy("u", "v").orderBy("osmid", "length", "geometry")) - 1).alias("key")
    return out.select("u", "v", key, *[c for c in out.columns if c not in ("u", "v")])
