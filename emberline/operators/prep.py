"""Cleaning: raw records to planner rows and training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import geo, times
from emberline.functions.text import plain_name

# Spellings of the canonical columns, delay codes that don't count, bounds.
ALIASES = {
    "dest_lat": ("Latitude", "latitude", "lat"),
    "dest_lon": ("Longitude", "longitude", "lon"),
    "travel_seconds": ("FirstPumpArriving_AttendanceTime",),
    "cal_year": ("CalYear",),
    "hour_of_call": ("HourOfCall",),
    "station_ground": ("IncidentStationGround",),
    "deployed_from_station": ("FirstPumpArriving_DeployedFromStation",),
    "borough": ("IncGeo_BoroughName",),
    "facilityname": ("name",),
}
EXCLUDED_DELAYS = ("On outside duty when mobilised", "Address incomplete/wrong")
LEFT_FROM = ("Home Station", "Other Station")
ATTENDANCE_S, DRIVE_S, MOST_KM = (30.0, 1800.0), (30.0, 1200.0), 15.0
ROAD_PER_CROW = 1.25


def with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Renames the first spelling found of each canonical column that is missing."""
    have = set(df.columns)
    names = {}
    for target, spellings in (aliases or ALIASES).items():
        found = next((s for s in spellings if s in have and s not in names), None)
        if target not in have and found:
            names[found] = target
    return df.withColumnsRenamed(names)


def number(c) -> Column:
    """A double; what can't be read is null."""
    return F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")


def coordinates(df: DataFrame, lat: str, lon: str, east: str, north: str) -> tuple[Column, Column]:
    """Latitude and longitude, from grid metres where one of them is missing."""
    g_lon, g_lat = geo.bng_to_wgs84(number(east), number(north))
    missing = number(lat).isNull() | number(lon).isNull()
    return F.when(missing, F.coalesce(g_lat, number(lat))).otherwise(number(lat)), F.when(missing, F.coalesce(g_lon, number(lon))).otherwise(number(lon))


def away_strict(ground: Column, deployed: Column) -> Column:
    """1 where both names are given (not blank, not "nan") and differ."""
    g, d = F.trim(ground), F.trim(deployed)
    both = ground.isNotNull() & deployed.isNotNull() & (g != "") & (d != "") & (F.lower(g) != "nan") & (F.lower(d) != "nan")
    return F.coalesce((both & (g != d)).cast("int"), F.lit(0))


def away_trimmed(ground: Column, deployed: Column) -> Column:
    """1 where trimmed names differ; null if one is null."""
    return (F.trim(ground) != F.trim(deployed)).cast("int")


def away_plain(ground: Column, deployed: Column) -> Column:
    """1 where the names differ; a null ground counts as another."""
    return (~deployed.eqNullSafe(ground)).cast("int")


def planner_rows(incidents: DataFrame) -> DataFrame:
    """Incidents with coordinates and an attendance time within bounds, and the strict busy flag."""
    rows = incidents.withColumn("busy_flag", away_strict(F.col("station_ground"), F.col("deployed_from_station")))
    return rows.dropna(subset=["dest_lat", "dest_lon", "travel_seconds"]).where(F.col("travel_seconds").between(*ATTENDANCE_S))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row a key: the first in a total order."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


def _funnel_steps() -> list[tuple[str, Column]]:
    return [
        ("left_from_a_station", F.col("deployed_from_location").isin(*LEFT_FROM)),
        ("not_outside_duty_or_bad_address", ~F.coalesce(F.col("delay_code").isin(*EXCLUDED_DELAYS), F.lit(False))),
        ("travel_30_1200s", F.col("travel_s").between(*DRIVE_S)),
    ]


def one_incident(incidents: DataFrame) -> DataFrame:
    """One row an incident_id: the first by date, place and the other columns that can be ordered."""
    order = [c for c in ("date_of_call", "hour_of_call", "dest_lat", "dest_lon", "station_ground", "deployed_from_station", "borough", "travel_seconds") if c in incidents.columns]
    return first_by(incidents, ["incident_id"], [F.col(c).asc_nulls_last() for c in order])


def places(stations: DataFrame, name: str, prefix: str) -> DataFrame:
    """name, PREFIX_lat and PREFIX_lon of stations: one row a name, that with the least coordinates."""
    first = F.min(F.struct("lat", "lon")).alias("p")
    return stations.where("facilityname IS NOT NULL").groupBy(F.col("facilityname").alias(name)).agg(first).select(name, F.col("p.lat").alias(f"{prefix}_lat"), F.col("p.lon").alias(f"{prefix}_lon"))


def fill_dates(rows: DataFrame, other: DataFrame, key: str, date: str = "date_of_call") -> DataFrame:
    """rows whose missing dates come from another source (key, date); of several there, the earliest."""
    second = other.groupBy(key).agg(F.min(date).alias("__date"))
    return rows.join(second, key, "left").withColumn(date, F.coalesce(date, "__date")).drop("__date")


def matched_features(names: DataFrame, features: DataFrame, overrides: DataFrame) -> DataFrame:
    """name, feature, how and its lat and lon: the feature that an override names, or else one of equal normalised name.

    features: element, feature_id, feature_name, operator, lat, lon; overrides:
    name, element, feature_id. Of several, tagged ones of the brigade come first, then
    the later element name ("way" before "node"), then the smaller id. Names
    without a feature have how "missing".
    """
    own = features.withColumn("plain", plain_name(F.col("feature_name"))).withColumn("tagged", F.coalesce(F.col("operator").contains("London Fire"), F.lit(False)))
    n = names.select("name").distinct().withColumn("plain", plain_name(F.col("name")))
    told = n.drop("plain").join(overrides, "name").join(own, ["element", "feature_id"], "left").withColumn("how", F.lit("override"))
    by_name = n.join(overrides.select("name").distinct(), "name", "left_anti").join(own, "plain", "left").withColumn("how", F.lit("name"))
    columns = ["name", "element", "feature_id", "feature_name", "lat", "lon", "tagged", "how"]
    both = told.select(columns).unionByName(by_name.select(columns))
    best = first_by(both, ["name"], [F.col("lat").isNull(), F.col("tagged").desc(), F.col("element").desc(), "feature_id"])
    there = F.col("lat").isNotNull()
    return best.select("name", *[F.when(there, F.col(c)).alias(c) for c in ("element", "feature_id", "feature_name", "lat", "lon")], F.when(there, F.col("how")).otherwise("missing").alias("how"))


def training_rows(mobilisations: DataFrame, incidents: DataFrame, stations: DataFrame) -> DataFrame:
    """Engine trips that left from a known station, with distances and times: mobilisations joined to incidents.

    Of incidents with one incident_id, and of stations with one name, the first
    in an order of their columns counts, so that neither multiplies trips.
    """
    keep = mobilisations
    for _, step in _funnel_steps():
        keep = keep.where(step)
    joined = keep.join(one_incident(incidents).drop("travel_seconds"), "incident_id").join(places(stations, "deployed_from_station", "start"), "deployed_from_station")
    km = geo.haversine_km(F.col("start_lon"), F.col("start_lat"), F.col("dest_lon"), F.col("dest_lat"), geo.RADIUS_TRIP_KM)
    rows = joined.withColumn("crow_km", km).where((F.col("crow_km") > 0) & (F.col("crow_km") <= MOST_KM))
    return rows.select(
        "incident_id", "pump_order", "cal_year", "date_of_call", "hour_of_call", F.upper("borough").alias("borough"), "station_ground", "deployed_from_station", "deployed_from_location",
        away_plain(F.col("station_ground"), F.col("deployed_from_station")).alias("busy_flag"),
        "start_lat", "start_lon", "dest_lat", "dest_lon", "crow_km", (F.col("crow_km") * ROAD_PER_CROW).alias("road_km"), "turnout_s", F.col("travel_s").alias("drive_s"),
    )


def funnel(mobilisations: DataFrame, incidents: DataFrame, stations: DataFrame) -> DataFrame:
    """How many mobilisations each step of training_rows() leaves, in one pass (step, n)."""
    joined = mobilisations.join(one_incident(incidents).drop("travel_seconds"), "incident_id", "left").join(places(stations, "deployed_from_station", "start"), "deployed_from_station", "left")
    km = geo.haversine_km(F.col("start_lon"), F.col("start_lat"), F.col("dest_lon"), F.col("dest_lat"), geo.RADIUS_TRIP_KM)
    steps = [("mobilisations", F.lit(True)), *_funnel_steps(), ("known_station", F.col("start_lat").isNotNull()), ("crow_km_0_15", (km > 0) & (km <= MOST_KM))]
    so_far, counts = F.lit(True), []
    for name, step in steps:
        so_far = so_far & F.coalesce(step, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    one = joined.agg(*counts)
    pairs = ", ".join(f"'{n}', `{n}`" for n, _ in steps)
    return one.select(F.expr(f"stack({len(steps)}, {pairs}) AS (step, n)"))


def time_features(df: DataFrame, date: str = "date_of_call", hour: str = "hour_of_call") -> DataFrame:
    """dow (Monday 0), month, rush and night of each row."""
    return df.withColumns({
        "dow": F.weekday(date), "month": F.month(date), "rush": times.is_rush(F.col(hour)).cast("int"), "night": times.is_night(F.col(hour)).cast("int"),
    })


def label_codes(train: DataFrame, rows: DataFrame, column: str, into: str) -> DataFrame:
    """rows with the place of their value among the sorted values of train; null if unseen."""
    seen = train.select(column).dropna().distinct()
    codes = seen.withColumn(into, (F.row_number().over(Window.orderBy(column)) - 1).cast("double"))
    return rows.join(codes, column, "left")


def own_station_pairs(incidents: DataFrame, stations: DataFrame) -> DataFrame:
    """station, crow_km and observed_s of calls answered by the ground's own station."""
    same = plain_name(F.col("station_ground")) == plain_name(F.col("deployed_from_station"))
    place = first_by(stations.select(plain_name(F.col("facilityname")).alias("station"), "lat", "lon", "station_id"), ["station"], ["station_id"])
    rows = incidents.dropna(subset=["station_ground", "travel_seconds", "dest_lat", "dest_lon"]).where(same)
    joined = rows.withColumn("station", plain_name(F.col("station_ground"))).join(place, "station")
    km = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("dest_lon"), F.col("dest_lat"))
    out = joined.select("incident_id", "station", km.alias("crow_km"), F.col("travel_seconds").alias("observed_s"))
    return out.where(F.col("crow_km").between(0.05, 40.0) & F.col("observed_s").between(60, 1800))


def trips_with_origin(incidents: DataFrame, stations: DataFrame, most_km: float = 25.0) -> DataFrame:
    """Incidents with the coordinates of the deployed station, or of the ground's where that is unknown, and drive_s."""
    place = places(stations, "start_station", "start")
    known = stations.select(F.col("facilityname").alias("deployed_from_station"), F.lit(True).alias("known")).dropna().distinct()
    start = F.when(F.col("known"), F.col("deployed_from_station")).otherwise(F.col("station_ground"))
    rows = incidents.join(known, "deployed_from_station", "left").withColumn("start_station", start).drop("known").join(place, "start_station")
    km = geo.haversine_km(F.col("start_lon"), F.col("start_lat"), F.col("dest_lon"), F.col("dest_lat"), geo.RADIUS_TRIP_KM)
    drive = times.clipped(F.col("travel_seconds") - times.TURNOUT_S, *DRIVE_S)
    return rows.withColumn("crow_km", km).where((F.col("crow_km") > 0) & (F.col("crow_km") <= most_km)).withColumn("drive_s", drive)


def year_split(rows: DataFrame, demand: Sequence[int], held_out: Sequence[int]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the demand years, and those of the held-out years or None; no demand is an error."""
    if "cal_year" not in rows.columns:
        return rows, None
    own = rows.where(F.col("cal_year").isin(*demand)) if demand else rows
    if own.isEmpty():
        raise ValueError(f"no incidents in {list(demand)}")
    rest = rows.where(F.col("cal_year").isin(*held_out)) if held_out else None
    return own, None if rest is None or rest.isEmpty() else rest


def sample_exactly(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of an md5 of seed and key: exact in size, the same in every run."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).limit(n)
