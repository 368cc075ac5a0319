"""Incident density on a projected raster, kept sparse as (row, col, n)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.operators.quantiles import exact_quantiles

# Ground pixel and padding in metres, blur in pixels, readout block, hotspot cell.
PIXEL_M, PAD_M, SIGMA_PX, BLOCK_PX = 25.0, 2000.0, 3.6, 20
#: Side of the tiles that a raster is blurred by, in pixels.
TILE_PX = 256


def grid(points: DataFrame, pixel_m: float = PIXEL_M, pad_m: float = PAD_M) -> DataFrame:
    """One row: x0, y0, px, nx, ny of a raster around points (lon, lat), its pixels a ground size at the mean latitude."""
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    ext = points.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    lat0 = geo.from_mercator(F.col("mx"), F.col("my"))[1]
    k = ext.withColumn("k", F.round(1 / F.cos(F.radians(lat0)), 9))
    px, pad = F.lit(pixel_m) * F.col("k"), F.lit(pad_m) * F.col("k")
    n = lambda a, b: F.ceil((F.col(b) + pad - (F.col(a) - pad)) / px).cast("int")
    return k.select((F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), px.alias("px"), n("x0", "x1").alias("nx"), n("y0", "y1").alias("ny"))


def counts(points: DataFrame, g: DataFrame, layers: str | None = None) -> DataFrame:
    """layer, row (0 is the north), col and n; a layer for each value of a column, and "all"."""
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    own = points.withColumn("layer", F.explode(F.array(F.lit("all"), F.col(layers)) if layers else F.array(F.lit("all")))).crossJoin(F.broadcast(g))
    col = F.least(F.floor((x - F.col("x0")) / F.col("px")).cast("int"), F.col("nx") - 1)
    up = F.least(F.floor((y - F.col("y0")) / F.col("px")).cast("int"), F.col("ny") - 1)
    return own.groupBy("layer", (F.col("ny") - 1 - up).alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


def kernel(sigma: float = SIGMA_PX) -> list[float]:
    """Gaussian weights cut at four standard deviations, summing to 1."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def blur(pixels: DataFrame, g: DataFrame, sigma: float = SIGMA_PX) -> DataFrame:
    """layer, row, col and v: both axes blurred in turn, what passes an edge mirrored back in.

    Pixels go to square tiles, those near a side to the next tiles too, and their mirror
    images beyond an edge with them; a task blurs a tile as an array. Pixels that nothing reaches are left out.
    """
    weights = np.array(kernel(sigma))
    reach = len(weights) // 2
    side = max(TILE_PX, reach)

    def images(at: str, size: str) -> Column:
        """Where a pixel counts along an axis: itself, and its images within reach of the raster."""
        turns = F.sequence(-F.ceil(reach / (2 * F.col(size))) - 1, F.ceil(reach / (2 * F.col(size))) + 1)
        every = F.flatten(F.transform(turns, lambda k: F.array(F.col(at) + 2 * k * F.col(size), 2 * k * F.col(size) - 1 - F.col(at))))
        return F.filter(every, lambda p: (p >= -reach) & (p < F.col(size) + reach))

    def tiles(at: str, size: str) -> Column:
        return F.sequence(F.greatest(F.floor((F.col(at) - reach) / side), F.lit(0)), F.least(F.floor((F.col(at) + reach) / side), F.floor((F.col(size) - 1) / side)))

    own = pixels.select("layer", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("n").cast("double").alias("n")).crossJoin(F.broadcast(g.select("nx", "ny")))
    for at, size in (("row", "ny"), ("col", "nx")):
        inner = (F.col(at) >= reach) & (F.col(at) < F.col(size) - reach)
        own = own.withColumn(at, F.explode(F.when(inner, F.array(at)).otherwise(images(at, size)))).withColumn(f"t_{at}", F.explode(tiles(at, size)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        layer, top, left = key[0], key[1].as_py() * side, key[2].as_py() * side
        height, width = min(side, rows.column("ny")[0].as_py() - top), min(side, rows.column("nx")[0].as_py() - left)
        now = np.zeros((height + 2 * reach, width + 2 * reach))
        np.add.at(now, (rows.column("row").to_numpy() - top + reach, rows.column("col").to_numpy() - left + reach), rows.column("n").to_numpy())
        down = np.zeros((height, now.shape[1]))
        for i, w in enumerate(weights):
            down += w * now[i : i + height]
        out = np.zeros((height, width))
        for i, w in enumerate(weights):
            out += w * down[:, i : i + width]
        row, col = np.nonzero(out)
        return pa.table({"layer": pa.array([layer.as_py()] * len(row), layer.type), "row": (row + top).astype(np.int32), "col": (col + left).astype(np.int32), "v": out[row, col]})

    kind = pixels.schema["layer"].dataType.simpleString()
    return own.select("layer", "t_row", "t_col", "row", "col", "n", "nx", "ny").groupBy("layer", "t_row", "t_col").applyInArrow(run, f"layer {kind}, row int, col int, v double")


def density(pixels: DataFrame, g: DataFrame, years: float, pixel_m: float = PIXEL_M, sigma: float = SIGMA_PX) -> DataFrame:
    """Incidents a square km and year."""
    return blur(pixels, g, sigma).withColumn("v", F.col("v") / ((pixel_m / 1000) ** 2) / years)


def ticks(dense: DataFrame, decades: float = 2.0) -> DataFrame:
    """layer and five colour-scale values below the 99.9th percentile of its positive pixels."""
    top = exact_quantiles(dense.where("v > 0"), "layer", "v", [0.999]).withColumnRenamed("value", "top")
    return top.select("layer", F.transform(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))), lambda f: F.col("top") / (10**decades) * F.pow(F.lit(10.0), f * decades)).alias("ticks"))


def blocks(pixels: DataFrame, g: DataFrame, years: float, size: int = BLOCK_PX) -> DataFrame:
    """layer, block_row, block_col and incidents a year of whole blocks of pixels."""
    own = pixels.crossJoin(F.broadcast(g.select("nx", "ny")))
    whole = (F.col("row") < F.floor(F.col("ny") / size) * size) & (F.col("col") < F.floor(F.col("nx") / size) * size)
    return own.where(whole).groupBy("layer", F.floor(F.col("row") / size).cast("int").alias("block_row"), F.floor(F.col("col") / size).cast("int").alias("block_col")).agg((F.sum("n") / years).alias("per_year"))


def hotspots(rows: DataFrame, cell_deg: float, top: int, days: float, of: str = "borough") -> DataFrame:
    """The busiest cells: rank, place, count, rate, commonest value of a column (ties to the first in order), median attendance."""
    cells = rows.withColumn("gx", F.floor(F.col("dest_lon") / cell_deg)).withColumn("gy", F.floor(F.col("dest_lat") / cell_deg))
    best = cells.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.percentile("travel_seconds", F.lit(0.5)).alias("median_attend_s"), F.mode(of, True).alias("common"))
    lead = best.orderBy(F.col("n").desc(), "gx", "gy").limit(top)
    return lead.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "gx", "gy")).alias("rank"), "gx", "gy", "n", (F.col("n") / days).alias("per_day"), "common", "median_attend_s")


def hexbin(rows: DataFrame, x, y, extent: tuple[float, float, float, float], across: int = 70) -> DataFrame:
    """lattice, ix, iy, x, y, n and log_n of points counted on hexagons: each goes to the nearer of two offset lattices.

    extent: least and most x, least and most y; points beyond the outer
    hexagons are left out, null ones too.
    """
    x0, x1, y0, y1 = extent
    down = int(across / math.sqrt(3))
    sx, sy = (x1 - x0) / across, (y1 - y0) / down
    p = rows.select(((x - x0) / sx).alias("u"), ((y - y0) / sy).alias("v")).dropna()
    first = F.struct(F.lit(1).alias("lattice"), F.rint("u").alias("a"), F.rint("v").alias("b"))
    second = F.struct(F.lit(2).alias("lattice"), (F.floor("u") + 0.5).alias("a"), (F.floor("v") + 0.5).alias("b"))
    off = lambda c: F.pow(F.col("u") - c["a"], 2) + 3 * F.pow(F.col("v") - c["b"], 2)
    near = p.select(F.when(off(first) < off(second), first).otherwise(second).alias("h")).select("h.*")
    counted = near.where(F.col("a").between(0, across) & F.col("b").between(0, down)).groupBy("lattice", "a", "b").agg(F.count("*").alias("n"))
    return counted.select("lattice", F.floor("a").cast("int").alias("ix"), F.floor("b").cast("int").alias("iy"), (F.col("a") * sx + x0).alias("x"), (F.col("b") * sy + y0).alias("y"), "n", F.log10(F.col("n") + 1).alias("log_n"))
