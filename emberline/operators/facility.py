"""Choosing sites: p-median and coverage over a table of attendance times.

`times` is a table (site_id, cell_id, w, t): seconds from each candidate to each
demand cell. Sums over cells are rounded to 6 places before they are compared,
so that the order of additions can't decide; ties go to the smaller site. What is
told of each cell is written before it meets `times`, so that it is sent to every task
where it is small and `times`, a row for each pair of a site and a cell, isn't shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.sources.tables import forget, held

RESPONSE, COVERAGE = "response_time", "coverage"
FAR = 1e12


def _term(objective: str, threshold_s: float):
    """What a cell with time t adds for each unit of weight; lower is better."""
    if objective == RESPONSE:
        return lambda t: t
    if objective == COVERAGE:
        return lambda t: F.when(t <= threshold_s, F.lit(-1.0)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown objective {objective!r}")


def _sites(times: DataFrame, chosen: Sequence[int], name: str = "site_id") -> DataFrame:
    """The chosen sites as a table: a plan's choice, so that it may be sent to every task."""
    return F.broadcast(times.sparkSession.createDataFrame(pa.table({name: pa.array([int(s) for s in chosen], pa.int64())})))


def _of(times: DataFrame, chosen: Sequence[int]) -> DataFrame:
    return times.join(_sites(times, chosen), "site_id", "left_semi")


def _but(times: DataFrame, chosen: Sequence[int]) -> DataFrame:
    return times.join(_sites(times, chosen), "site_id", "left_anti")


def two_nearest(times: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """cell_id, w, n1, d1 and d2: the nearest chosen site, its time and the next one's (FAR without one)."""
    own = _of(times, chosen)
    pairs = own.groupBy("cell_id").agg(F.max("w").alias("w"), F.min(F.struct("t", "site_id")).alias("a"))
    first = held(pairs.select("cell_id", "w", F.col("a.site_id").alias("n1"), F.col("a.t").alias("d1")))
    rest = own.join(first.select("cell_id", "n1"), "cell_id").where("site_id <> n1").groupBy("cell_id").agg(F.min("t").alias("d2"))
    return first.join(rest, "cell_id", "left").withColumn("d2", F.coalesce("d2", F.lit(FAR)))


def objective_value(times: DataFrame, chosen: Sequence[int], objective: str = RESPONSE, threshold_s: float = 480.0) -> float:
    term = _term(objective, threshold_s)
    best = _of(times, chosen).groupBy("cell_id").agg(F.max("w").alias("w"), F.min("t").alias("t"))
    row = best.agg((F.sum(F.col("w") * term(F.col("t"))) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("v")).first()
    return float(row.v)


def gains(times: DataFrame, chosen: Sequence[int], objective: str = RESPONSE, threshold_s: float = 480.0) -> DataFrame:
    """site_id and the weighted sum if that site were added to the chosen ones."""
    return _gains(times, chosen, _best(times, chosen) if chosen else None, objective, threshold_s)


def _best(times: DataFrame, chosen: Sequence[int], so_far: DataFrame | None = None) -> DataFrame:
    """cell_id and the least time of the chosen sites, and of those whose best is known so far."""
    rows = _of(times, chosen).select("cell_id", F.col("t").alias("best"))
    return held((rows if so_far is None else rows.unionByName(so_far)).groupBy("cell_id").agg(F.min("best").alias("best")))


def _gains(times: DataFrame, chosen: Sequence[int], best: DataFrame | None, objective: str, threshold_s: float) -> DataFrame:
    term = _term(objective, threshold_s)
    rows = _but(times, chosen) if chosen else times
    t: Column = F.col("t")
    if best is not None:
        rows, t = rows.join(best, "cell_id"), F.least("t", "best")
    return rows.groupBy("site_id").agg(F.round(F.sum(F.col("w") * term(t)), 6).alias("cost"))


def greedy(times: DataFrame, k: int, objective: str = RESPONSE, threshold_s: float = 480.0, start: Sequence[int] = ()) -> list[int]:
    """Adds the site that lowers the sum most, up to k sites. One small job a step; the driver sees one row of each."""
    chosen = list(start)
    best = _best(times, chosen) if chosen and len(chosen) < k else None
    while len(chosen) < k:
        row = _gains(times, chosen, best, objective, threshold_s).agg(F.min(F.struct("cost", "site_id")).alias("b")).first()
        if row is None or row.b is None:
            break
        chosen.append(row.b.site_id)
        if len(chosen) < k:
            last, best = best, _best(times, chosen[-1:], best)
            forget(last)
    return chosen


def swap_values(times: DataFrame, chosen: Sequence[int], objective: str = RESPONSE, threshold_s: float = 480.0, outs: Sequence[int] | None = None) -> DataFrame:
    """out_site, in_site and the mean objective after each swap of a chosen for another site, all in one pass.

    With a cell's nearest and next chosen times d1 and d2, adding site i gives
    least(d1, t); taking o away changes only cells whose nearest is o, from
    least(d1, t) to least(d2, t). Both are sums by (in, nearest site).
    """
    term = _term(objective, threshold_s)
    near = held(two_nearest(times, chosen))
    rows = _but(times, chosen).select("site_id", "cell_id", "t").join(near, "cell_id")
    added = F.col("w") * term(F.least("d1", "t"))
    moved = F.col("w") * (term(F.least("d2", "t")) - term(F.least("d1", "t")))
    by = rows.groupBy("site_id", "n1").agg(F.sum(added).alias("base"), F.sum(moved).alias("change"), F.sum("w").alias("weight"))
    whole = by.groupBy("site_id").agg(F.sum("base").alias("base"), F.sum("weight").alias("weight"))
    pairs = whole.crossJoin(_sites(times, chosen if outs is None else outs, "out_site")).join(by.select("site_id", F.col("n1").alias("out_site"), "change"), ["site_id", "out_site"], "left")
    value = (F.col("base") + F.coalesce("change", F.lit(0.0))) / F.greatest("weight", F.lit(1e-9))
    return pairs.select("out_site", F.col("site_id").alias("in_site"), F.round(value, 9).alias("value"))


@dataclass
class Choice:
    sites: list[int]
    value: float
    first_value: float
    swaps: list[tuple[int, int]] = field(default_factory=list)


def improve(times: DataFrame, chosen: Sequence[int], objective: str = RESPONSE, threshold_s: float = 480.0, locked: Sequence[int] = (), rounds: int = 8) -> Choice:
    """Goes through the places again and again and makes each place's best swap at once if it gains over 1e-9.

    One pass scores the best swap of every place that isn't locked. Places
    before the first one that gains would be left as they are, so that one is swapped and
    the rest are scored anew: a job for each swap that is made, and one that finds none.
    The driver sees a row for each place.
    """
    sites = list(chosen)
    now = first = objective_value(times, sites, objective, threshold_s)
    fixed = set(locked)
    places = [p for p, s in enumerate(sites) if s not in fixed]
    swaps: list[tuple[int, int]] = []
    at, turn = 0, 0  # the place that is looked at next, and the round it is in
    while places and turn < rounds:
        outs = [sites[p] for p in places]
        best = {r.out_site: r.b for r in swap_values(times, sites, objective, threshold_s, outs).groupBy("out_site").agg(F.min(F.struct("value", "in_site")).alias("b")).collect()}
        gaining = [i for i, p in enumerate(places) if sites[p] in best and best[sites[p]].value < now - 1e-9]
        found = next((i for i in gaining if i >= at), None)
        if found is None:  # the rest of this round gains nothing; the next begins with the first place
            turn += 1
            found = gaining[0] if gaining and turn < rounds else None
        if found is None:
            break
        place, b = places[found], best[sites[places[found]]]
        swaps.append((sites[place], b.in_site))
        sites[place], now, at = b.in_site, b.value, found + 1
    return Choice(sites, now, first, swaps)


def redesign(times: DataFrame, k: int, objective: str = RESPONSE, threshold_s: float = 480.0, rounds: int = 10) -> Choice:
    return improve(times, greedy(times, k, objective, threshold_s), objective, threshold_s, rounds=rounds)


def expand(times: DataFrame, existing: Sequence[int], extra: int, objective: str = RESPONSE, threshold_s: float = 480.0, rounds: int = 4) -> Choice:
    """Keeps all existing sites and adds so many."""
    chosen = greedy(times, len(existing) + extra, objective, threshold_s, existing)
    return improve(times, chosen, objective, threshold_s, locked=existing, rounds=rounds)


def replace(times: DataFrame, existing: Sequence[int], moves: int, objective: str = RESPONSE, threshold_s: float = 480.0) -> Choice:
    """Each round makes the best of all swaps of a remaining existing site for a new one, while one gains over 1e-9."""
    if moves <= 0:
        raise ValueError("replace needs one move at least")
    sites, left = list(existing), list(existing)
    now = first = objective_value(times, sites, objective, threshold_s)
    swaps = []
    for _ in range(moves):
        options = swap_values(times, sites, objective, threshold_s, outs=left).join(_sites(times, existing, "in_site"), "in_site", "left_anti")
        row = options.agg(F.min(F.struct("value", "out_site", "in_site")).alias("b")).first()
        if row.b is None or row.b.value >= now - 1e-9:
            break
        sites[sites.index(row.b.out_site)] = row.b.in_site
        left.remove(row.b.out_site)
        swaps.append((row.b.out_site, row.b.in_site))
        now = row.b.value
    return Choice(sites, now, first, swaps)


def at_random(sites: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k sites in the order of an md5 of seed and id."""
    return sites.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("site_id").cast("string")))).limit(k)


def responses(times: DataFrame, chosen: Sequence[int], busy: DataFrame | None = None) -> DataFrame:
    """cell_id, w, assigned_site and response_s: the nearest time, or its blend with the next by the nearest site's busy probability."""
    near = two_nearest(times, chosen)
    if busy is None or len(chosen) < 2:
        return near.select("cell_id", "w", F.col("n1").alias("assigned_site"), F.col("d1").alias("response_s"))
    p = busy.select(F.col("site_id").alias("n1"), F.least(F.greatest("busy_prob", F.lit(0.0)), F.lit(1.0)).alias("p"))
    return near.join(F.broadcast(p), "n1").select("cell_id", "w", F.col("n1").alias("assigned_site"), ((1 - F.col("p")) * F.col("d1") + F.col("p") * F.col("d2")).alias("response_s"))


def assigned(times: DataFrame, chosen: Sequence[int]) -> DataFrame:
    """Demand and its share by chosen site, 0 where none is nearest."""
    near = two_nearest(times, chosen).groupBy(F.col("n1").alias("site_id")).agg(F.sum("w").alias("demand"))
    own = times.sparkSession.createDataFrame([(int(s),) for s in chosen], "site_id long")
    out = own.join(near, "site_id", "left").select("site_id", F.coalesce("demand", F.lit(0.0)).alias("assigned_demand"))
    return out.withColumn("assigned_share", F.col("assigned_demand") / F.sum("assigned_demand").over(Window.partitionBy()))
