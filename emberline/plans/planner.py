"""The whole placement plan, from incidents to scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.text import plain_name
from emberline.functions.times import TURNOUT_S, attendance
from emberline.operators import facility, fitting, prep, spatial, summaries, weighted
from emberline.sources.tables import held

MODES = ("redesign", "replace", "expand")


@dataclass
class Plan:
    candidates: DataFrame
    cells: DataFrame
    selected: DataFrame
    opened: DataFrame
    closed: DataFrame
    summary: DataFrame
    #: Of held-out incidents: median and 95th percentile of the way to their cells, and how many; None without any.
    snap: DataFrame | None = None


def turnout_table(sites: DataFrame, stations_turnout: DataFrame | None, default_s: float = TURNOUT_S, given: float | Mapping[str, float] | None = None) -> DataFrame:
    """site_id and turnout: a station's own estimate, the default for others and for new sites, within 0 and 300 s.

    given: a number is every site's turnout as it stands; a mapping from station names
    goes before the estimates.
    """
    if isinstance(given, (int, float)):
        return sites.select(F.col("candidate_id").alias("site_id"), F.lit(float(given)).alias("turnout_s"))
    own = sites.select(F.col("candidate_id").alias("site_id"), "is_existing", plain_name(F.col("site_name")).alias("station"))
    known = _known(stations_turnout, given)
    if known is None:
        return own.select("site_id", _clipped(F.lit(default_s)).alias("turnout_s"))
    value = F.when(F.col("is_existing"), F.coalesce("turnout_s", F.lit(default_s))).otherwise(F.lit(default_s))
    return own.join(known, "station", "left").select("site_id", _clipped(value).alias("turnout_s"))


def _clipped(seconds):
    return F.least(F.greatest(seconds, F.lit(0.0)), F.lit(300.0))


def _known(stations_turnout: DataFrame | None, given: Mapping[str, float] | None) -> DataFrame | None:
    """station and turnout_s, one row a name: the mapping's, else the estimate."""
    parts = [] if stations_turnout is None else [stations_turnout.select(plain_name(F.col("station")).alias("station"), F.lit(1).alias("after"), "turnout_s")]
    if given:
        spark = SparkSession.active()
        listed = spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(given.items())], "i int, station string, turnout_s double")
        parts.append(listed.select(plain_name(F.col("station")).alias("station"), (-F.col("i")).alias("after"), "turnout_s"))  # of names that become alike the last counts
    if not parts:
        return None
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy("station").agg(F.min_by("turnout_s", F.struct("after", "turnout_s")).alias("turnout_s"))


def turnout_report(sites: DataFrame, stations_turnout: DataFrame | None, default_s: float = TURNOUT_S, given: float | Mapping[str, float] | None = None) -> DataFrame:
    """One row: source, default_s, how many existing sites have a value of their own, and least, median and greatest turnout of existing sites (of all, where none exists)."""
    scalar = isinstance(given, (int, float))
    source = "scalar" if scalar else ("mapping" + ("+estimated" if stations_turnout is not None else "")) if given is not None else "default" if stations_turnout is None else "estimated_station_prior"
    rows = turnout_table(sites, stations_turnout, default_s, given).join(sites.select(F.col("candidate_id").alias("site_id"), "is_existing", plain_name(F.col("site_name")).alias("station")), "site_id")
    known = None if scalar else _known(stations_turnout, given)
    hit = F.lit(False)
    if known is not None:
        rows, hit = rows.join(known.select("station", F.lit(True).alias("known")), "station", "left"), F.col("is_existing") & F.coalesce("known", F.lit(False))
    some = rows.agg(F.max("is_existing").alias("some"))
    of = rows.crossJoin(F.broadcast(some)).where("is_existing OR NOT some")
    return of.agg(F.lit(source).alias("source"), F.lit(float(given) if scalar else default_s).alias("default_s"), F.count_if(hit).alias("n_existing_with_prior"), F.min("turnout_s").alias("existing_min_s"), F.percentile("turnout_s", F.lit(0.5)).alias("existing_median_s"), F.max("turnout_s").alias("existing_max_s"))


def busy_table(sites: DataFrame, incidents: DataFrame, least: int = 20) -> DataFrame | None:
    """site_id and busy_prob: a station's own rate, the mean of those for other sites; None without any rate."""
    rates = summaries.busy_rates(incidents).where(F.col("n_incidents") >= least).select(plain_name(F.col("station_ground")).alias("station"), F.col("busy_prob").alias("p"))
    if rates.isEmpty():
        return None
    own = sites.select(F.col("candidate_id").alias("site_id"), "is_existing", plain_name(F.col("site_name")).alias("station"))
    joined = own.join(rates, "station", "left").withColumn("p", F.when(F.col("is_existing"), F.col("p")))
    mean = joined.agg(F.avg("p").alias("mean")).crossJoin(rates.agg(F.avg("p").alias("any")))
    return joined.crossJoin(F.broadcast(mean)).select("site_id", F.coalesce("p", "mean", "any").alias("busy_prob"))


def plan(incidents: DataFrame, stations: DataFrame, mode: str = "expand", k: int = 2, cell_km: float = 2.0, top_cells: int = 30, objective: str = facility.RESPONSE, threshold_s: float = 480.0, scorer: str = "kolesar", busy: bool = False, demand_years=(), eval_years=(), turnout_s: float | Mapping[str, float] | None = None) -> Plan:
    """Chooses sites on the demand years' incidents and scores them, on the held-out years too if there are any.

    turnout_s: one turnout for all sites, or some stations' own, which go before the estimates.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    near = spatial.drop_far(incidents, stations)
    demand, held_out = prep.year_split(near, list(demand_years), list(eval_years))
    cells = held(spatial.demand_grid(demand, cell_km))
    sites = held(spatial.candidates(stations, cells, top_cells))
    pairs = prep.own_station_pairs(demand, stations)
    curve, travel = fitting.fit_drive_curve(pairs)
    turnout = turnout_table(sites, fitting.station_turnout(pairs, curve), given=turnout_s)
    matrix = spatial.travel_matrix(sites, cells, scorer, curve).join(F.broadcast(turnout), "site_id")
    times = held(matrix.select("site_id", "cell_id", "w", "drive_s", attendance(F.col("drive_s"), F.col("turnout_s")).alias("t")))
    existing = [r.candidate_id for r in sites.where("is_existing").orderBy("candidate_id").collect()]
    if mode == "redesign":
        choice = facility.redesign(times, k, objective, threshold_s)
    elif mode == "replace":
        choice = facility.replace(times, existing, k, objective, threshold_s)
    else:
        choice = facility.expand(times, existing, k, objective, threshold_s)
    p = busy_table(sites, demand) if busy else None
    p = held(p) if p is not None else None
    planned = held(facility.responses(times, choice.sites, p))
    current = held(facility.responses(times, existing, p))
    drive = times.select("cell_id", F.col("site_id").alias("assigned_site"), "drive_s")
    out_cells = cells.join(planned.select("cell_id", "response_s", "assigned_site").join(drive, ["cell_id", "assigned_site"]), "cell_id").join(current.select("cell_id", F.col("response_s").alias("response_s_current")), "cell_id").withColumn("response_s_delta", F.col("response_s") - F.col("response_s_current")).withColumn("covered", F.col("response_s") <= threshold_s).withColumn("covered_current", F.col("response_s_current") <= threshold_s)
    rank = sites.sparkSession.createDataFrame([(s, i + 1) for i, s in enumerate(choice.sites)], "candidate_id long, plan_rank int")
    selected = sites.join(rank, "candidate_id").join(facility.assigned(times, choice.sites).withColumnRenamed("site_id", "candidate_id"), "candidate_id")
    anywhere = [r.site_id for r in facility.at_random(sites.select(F.col("candidate_id").alias("site_id")), len(choice.sites)).collect()]
    by_chance = held(facility.responses(times, anywhere, p))

    def scored(label: str, rows: DataFrame) -> DataFrame:
        firsts = weighted.score_first_engine(rows.withColumn("v", F.col("response_s")).select("v", "w"), value="v", weight="w")
        return weighted.posture_metrics(rows, threshold_s).crossJoin(firsts).select(F.lit(label).alias("label"), "*")

    scores, snap = scored("plan", planned).unionByName(scored("current", current)).unionByName(scored("random", by_chance)), None
    if held_out is not None:
        snapped = held(spatial.snap_to_cells(held_out, cells))
        snap = summaries.snap_quantiles(snapped)
        for label, rows in (("held_out_plan", planned), ("held_out_current", current)):
            scores = scores.unionByName(scored(label, snapped.join(rows, "cell_id").select("cell_id", "response_s", F.lit(1.0).alias("w"))))
        seen = held_out.where("travel_seconds IS NOT NULL").select(F.col("incident_id").alias("cell_id"), F.col("travel_seconds").cast("double").alias("response_s"), F.lit(1.0).alias("w"))
        if not seen.isEmpty():
            scores = scores.unionByName(scored("held_out_observed", seen))
    summary = scores.select(F.lit(mode).alias("mode"), F.lit(objective).alias("objective"), F.lit(choice.value).alias("value"), F.lit(choice.first_value).alias("first_value"), F.lit(len(choice.swaps)).alias("n_swaps"), F.lit(travel["source"]).alias("curve_source"), "*")
    return Plan(sites, out_cells, selected, sites.where(~F.col("is_existing")).join(rank.select("candidate_id"), "candidate_id", "left_semi"), sites.where("is_existing").join(rank.select("candidate_id"), "candidate_id", "left_anti"), summary, snap)
