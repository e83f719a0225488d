"""Model inputs: one row per trip, plain joins of the trip with the summary tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import rnd
from .quantiles import exact_quantiles
from .summaries import name_routes, reliable

NO = "dispatch_entry_no"
ROUTE = ["origin_id", "destination_id"]
# Feature columns in model order.
ETA_FEATURES = [
    "hour", "day_of_week", "is_weekend", "month", "time_bucket_encoded",
    "route_avg_duration", "route_avg_distance", "route_trip_count", "route_eta_success",
    "driver_avg_duration", "driver_avg_speed", "driver_eta_success", "driver_total_trips", "driver_vehicles_used",
    "vehicle_avg_speed", "vehicle_total_trips", "vehicle_eta_success",
    "time_pattern_avg_duration", "time_pattern_trip_count", "time_pattern_eta_success",
    "trip_km", "is_5am_default",
]
LEGACY_FEATURES = [
    "hour_of_day", "day_of_week", "is_weekend", "month", "time_bucket",
    "route_avg_duration", "route_avg_distance", "route_trip_count", "route_eta_success_rate",
    "driver_avg_duration", "driver_avg_speed", "driver_eta_success_rate", "driver_total_trips", "driver_avg_distance",
    "distance_km", "driver_vs_route_duration_ratio", "speed_estimated_duration", "driver_experience_log", "route_popularity_log", "has_driver",
]
SLA_FEATURES = [
    "hour", "day_of_week", "is_weekend", "month",
    "route_avg_duration", "route_trip_count", "route_eta_success", "route_avg_distance",
    "driver_avg_duration", "driver_avg_speed", "driver_eta_success", "driver_total_trips",
    "vehicle_avg_speed", "vehicle_total_trips", "vehicle_eta_success",
    "time_pattern_avg_duration", "time_pattern_trip_count", "time_pattern_eta_success",
    "trip_km", "driver_route_trips", "driver_route_eta_success",
]
FUEL_FEATURES = [
    "trip_km", "trip_duration_minutes", "avg_speed_kmph", "hour", "day_of_week", "is_weekend", "month", "load_weight_kg",
    "vehicle_avg_speed", "vehicle_total_trips", "driver_avg_speed", "driver_total_trips",
    "route_avg_distance", "route_avg_duration", "route_trip_count", "is_night_trip", "speed_variance_proxy",
]


def _renamed(summary: DataFrame, keys: list[str], prefix: str, columns: dict) -> DataFrame:
    return summary.select(*keys, *[F.col(c).alias(f"{prefix}_{n}") for n, c in columns.items()])


def with_summaries(rows: DataFrame, fleet) -> DataFrame:
    """Left joins of vehicle, driver and route figures under their feature names.

    The largest table comes first: what a join may have to move are the trips as they came, not yet widened by the others.
    """
    r = _renamed(fleet.route_summary, ROUTE, "route", {"avg_duration": "avg_duration_min", "avg_distance": "avg_distance_km", "avg_speed": "avg_speed_kmph", "trip_count": "trip_count", "eta_success": "eta_success_rate"})
    d = _renamed(fleet.driver_summary, ["driver_id"], "driver", {"avg_duration": "avg_duration_min", "avg_speed": "avg_speed_kmph", "eta_success": "eta_success_rate", "total_trips": "total_trips", "vehicles_used": "vehicles_used"})
    v = _renamed(fleet.vehicle_summary, ["vehicle_id"], "vehicle", {"avg_speed": "avg_speed_kmph", "total_trips": "total_trips", "eta_success": "eta_success_rate"})
    return rows.join(v, "vehicle_id", "left").join(d, "driver_id", "left").join(r, ROUTE, "left")


def calendar(start) -> dict:
    return {"hour": F.hour(start), "day_of_week": F.weekday(start), "is_weekend": T.is_weekend(start), "month": F.month(start)}


def _doubles(df: DataFrame, key: list, features: list[str], default: float = 0.0) -> DataFrame:
    return df.select(*key, *[F.coalesce(F.col(c).cast("double"), F.lit(default)).alias(c) for c in features])


def eta_features(trips: DataFrame, fleet) -> DataFrame:
    """Training rows: 22 features and the target; time-pattern columns repeat the route's."""
    rows = with_summaries(reliable(trips).filter((F.col("trip_duration_minutes") < 50000) & F.col("trip_start").isNotNull()), fleet)
    start = F.col("trip_start")
    rows = rows.withColumns({
        **calendar(start), "time_bucket_encoded": T.time_bucket_code(T.time_bucket(F.hour(start))),
        "time_pattern_avg_duration": F.col("route_avg_duration"), "time_pattern_trip_count": F.col("route_trip_count"), "time_pattern_eta_success": F.col("route_eta_success")})
    return _doubles(rows, [NO, F.col("trip_duration_minutes").cast("double").alias("target")], ETA_FEATURES)


def eta_features_serving(requests: DataFrame, fleet) -> DataFrame:
    """Rows for prediction: real hour and day pattern, fallbacks to route figures, then defaults.

    A zero figure counts as missing, as it does in the served answer.
    """
    start = F.col("trip_start")
    known = lambda c: F.when(F.col(c) != 0, F.col(c).cast("double"))
    rows = with_summaries(requests, fleet).withColumns({**calendar(start), "_sql_day": T.weekday_to_sql_day(F.weekday(start))})
    p = fleet.route_time_patterns.select(
        *ROUTE, F.col("hour_of_day").alias("hour"), F.col("day_of_week").alias("_sql_day"),
        F.col("avg_duration").alias("tp_d"), F.col("trip_count").alias("tp_n"), F.col("eta_success_rate").alias("tp_e"))
    rows = rows.join(p, [*ROUTE, "hour", "_sql_day"], "left")
    speed = F.coalesce(known("route_avg_speed"), F.lit(20.0))
    rows = rows.withColumns({
        "time_bucket_encoded": T.time_bucket_code(T.time_bucket(F.col("hour"))),
        "time_pattern_avg_duration": F.coalesce(known("tp_d"), known("route_avg_duration")),
        "time_pattern_trip_count": F.coalesce(known("tp_n"), F.col("route_trip_count")),
        "time_pattern_eta_success": F.coalesce(known("tp_e"), known("route_eta_success")),
        "trip_km": F.coalesce(known("trip_km"), known("route_avg_distance")),
        "driver_avg_duration": F.coalesce(known("driver_avg_duration"), known("route_avg_duration")),
        "driver_avg_speed": F.coalesce(known("driver_avg_speed"), speed),
        "driver_eta_success": F.coalesce(known("driver_eta_success"), known("route_eta_success")),
        "vehicle_avg_speed": F.coalesce(known("vehicle_avg_speed"), speed),
        "vehicle_eta_success": F.coalesce(known("vehicle_eta_success"), known("route_eta_success")),
        "is_5am_default": T.is_5am_default(start)})
    return _doubles(rows, [NO], ETA_FEATURES)


# ------------------------------------------------------------- older arrival model
def legacy_training_input(trips: DataFrame, fleet) -> DataFrame:
    rows = trips.filter(
        (F.col("trip_status") == "C") & (F.col("trip_duration_minutes") > 0) & F.col("trip_start").isNotNull() & F.col("trip_end").isNotNull() & F.col("ata_in").isNotNull())
    v = fleet.vehicles.select(F.col("id").alias("vehicle_id"), "asset_type")
    return name_routes(rows, fleet.locations).join(v, "vehicle_id", "left").select(
        NO, "trip_start", "trip_end", "ata_in", "trip_duration_minutes", "trip_km", "avg_speed_kmph", "eta_met", "eta_delay_minutes", "driver_id", *ROUTE, "origin", "destination", "asset_type")


def legacy_clean(rows: DataFrame, low: float = 10, high: float = 21600, min_trips: int = 10) -> DataFrame:
    """Plausible durations; on routes with enough trips only the middle 90 percent."""
    m = F.col("trip_duration_minutes")
    kept = rows.filter((m >= low) & (m <= high))
    counts = kept.groupBy(*ROUTE, "trip_duration_minutes").agg(F.count(F.lit(1)).alias("_f"))  # equal values once per route
    limits = counts.groupBy(*ROUTE).agg(
        F.sum("_f").alias("_n"), F.percentile(m.cast("double"), F.array(F.lit(0.05), F.lit(0.95)), F.col("_f")).alias("_q"))
    x = m.cast("double")
    return kept.join(limits, ROUTE).filter((F.col("_n") < min_trips) | x.between(F.col("_q")[0], F.col("_q")[1])).drop("_n", "_q")


def _legacy_derived(rows: DataFrame, ratio_needs_driver: bool) -> DataFrame:
    rd, dd, ds = F.col("route_avg_duration"), F.col("driver_avg_duration"), F.col("driver_avg_speed")
    usable = (rd > 0) & (dd > 0) if ratio_needs_driver else rd > 0
    return rows.withColumns({
        "driver_vs_route_duration_ratio": F.when(usable, F.try_divide(dd, rd)).otherwise(1.0),
        "speed_estimated_duration": F.when(ds > 0, F.try_divide(F.col("distance_km"), ds) * 60).otherwise(rd),
        "driver_experience_log": F.log1p("driver_total_trips"), "route_popularity_log": F.log1p("route_trip_count")})


def _legacy_calendar(start) -> dict:
    c = calendar(start)
    return {"hour_of_day": c.pop("hour"), **c, "time_bucket": T.time_bucket_legacy_code(F.hour(start))}


def _legacy_stats(rows: DataFrame, drivers_all: DataFrame, routes_all: DataFrame) -> DataFrame:
    r = routes_all.select(*ROUTE, F.col("avg_duration_min").alias("route_avg_duration"), F.col("avg_distance_km").alias("route_avg_distance"),
                          F.col("trip_count").cast("double").alias("route_trip_count"), F.col("eta_success_rate").alias("route_eta_success_rate"))
    d = drivers_all.select("driver_id", F.col("avg_duration_min").alias("driver_avg_duration"), F.col("avg_speed_kmph").alias("driver_avg_speed"),
                           F.col("eta_success_rate").alias("driver_eta_success_rate"), F.col("total_trips").cast("double").alias("driver_total_trips"), F.col("avg_distance_km").alias("driver_avg_distance"))
    return rows.join(r, ROUTE, "left").join(d, "driver_id", "left")


def eta_features_legacy(rows: DataFrame, drivers_all: DataFrame, routes_all: DataFrame) -> DataFrame:
    """20 features; missing figures become the table's medians, 50 percent or 0."""
    defaults = {"_minutes": ("trip_duration_minutes", 0.0), "_speed": ("avg_speed_kmph", 20.0), "_km": ("trip_km", 0.0)}
    found = exact_quantiles(rows, {name: (c, 0.5) for name, (c, _) in defaults.items()})
    medians = {name: F.lit(default if found[name] is None else found[name]) for name, (_, default) in defaults.items()}
    fill = {"route_avg_duration": "_minutes", "route_avg_distance": "_km", "driver_avg_duration": "_minutes", "driver_avg_speed": "_speed", "driver_avg_distance": "_km"}
    plain = {"route_trip_count": 0.0, "route_eta_success_rate": 50.0, "driver_eta_success_rate": 50.0, "driver_total_trips": 0.0}
    out = _legacy_stats(rows.withColumns(medians), drivers_all, routes_all)
    out = out.withColumns({**{c: F.coalesce(c, m) for c, m in fill.items()}, **{c: F.coalesce(c, F.lit(x)) for c, x in plain.items()}})
    out = out.withColumns({**_legacy_calendar(F.col("trip_start")), "distance_km": F.coalesce(F.col("trip_km").cast("double"), F.col("route_avg_distance")),
                           "has_driver": F.when(F.col("driver_id").isNotNull(), 1).otherwise(0)})
    return _doubles(_legacy_derived(out, False), [NO, F.col("trip_duration_minutes").cast("double").alias("target")], LEGACY_FEATURES)


def eta_features_legacy_serving(requests: DataFrame, drivers_all: DataFrame, routes_all: DataFrame) -> DataFrame:
    """The same columns for requests: 0 for a missing driver or route, ratio 1, rate 50, the route's distance."""
    out = _legacy_stats(requests, drivers_all, routes_all).withColumn("has_driver", F.when(F.col("driver_total_trips").isNotNull(), 1).otherwise(0))
    zero = ["route_avg_duration", "route_avg_distance", "route_trip_count", "driver_avg_duration", "driver_avg_speed", "driver_total_trips", "driver_avg_distance"]
    half = ["route_eta_success_rate", "driver_eta_success_rate"]
    out = out.withColumns({**{c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero}, **{c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(50.0)) for c in half}})
    out = out.withColumns({**_legacy_calendar(F.col("trip_start")), "distance_km": F.coalesce(F.col("trip_km").cast("double"), F.col("route_avg_distance"))})
    return _doubles(_legacy_derived(out, True), [NO], LEGACY_FEATURES)


def quantile_trim(rows: DataFrame, target: str = "target", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose target lies within the two quantiles. rows should be a stored table."""
    ends = exact_quantiles(rows, {"low": (target, low), "high": (target, high)})
    return rows.filter(F.col(target).between(*(F.lit(ends[k]).cast("double") for k in ("low", "high"))))


# ------------------------------------------------------------- on-time model
def driver_route_history(trips: DataFrame) -> DataFrame:
    from ..functions.numeric import on_time_rate

    rows = trips.filter((F.col("eta_met").isNotNull()) & (F.col("trip_duration_minutes") > 0) & (F.col("eta_data_status") == "available")
                        & F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull())
    return rows.groupBy("driver_id", *ROUTE).agg(F.count(F.lit(1)).alias("driver_route_trips"), on_time_rate().alias("driver_route_eta_success"))


def sla_input(trips: DataFrame, fleet) -> DataFrame:
    rows = reliable(trips).filter(F.col("eta_met").isNotNull() & F.col("trip_start").isNotNull())
    return with_summaries(rows, fleet)


def sla_features(rows: DataFrame, history: DataFrame) -> DataFrame:
    """21 features and the label; rows without any distance or route duration are left out."""
    out = rows.join(history, ["driver_id", *ROUTE], "left")
    fifty = ["route_eta_success", "driver_eta_success", "vehicle_eta_success", "driver_route_eta_success"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(50.0)) for c in fifty})
    out = out.withColumns({
        **calendar(F.col("trip_start")), "time_pattern_avg_duration": F.col("route_avg_duration"), "time_pattern_trip_count": F.col("route_trip_count"),
        "time_pattern_eta_success": F.col("route_eta_success")})
    out = _doubles(out, [NO, F.col("eta_met").alias("label")], SLA_FEATURES)
    return out.filter((F.col("route_avg_duration") > 0) | (F.col("trip_km") > 0))


def route_record(trips: DataFrame) -> DataFrame:
    """Trips and on-time rate per driver and route, whether or not an outcome is known (an unknown one is not on time)."""
    rows = reliable(trips).filter(F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull() & F.col("driver_id").isNotNull())
    met = F.sum(F.when(F.col("eta_met") == 1, 1).otherwise(0)).cast("double")
    return rows.groupBy("driver_id", *ROUTE).agg(F.count(F.lit(1)).alias("driver_route_trips"), rnd(met / F.count(F.lit(1)) * 100).alias("driver_route_eta_success"))


def sla_features_serving(requests: DataFrame, fleet) -> DataFrame:
    """The same 21 features for requests: a rate of 0 counts as missing and becomes 50, other figures 0.

    route_eta_known and driver_eta_known keep the rates as they are, 0 where there is none.
    """
    rows = with_summaries(requests, fleet).join(route_record(fleet.trips), ["driver_id", *ROUTE], "left")
    known = {f"{k}_eta_known": F.coalesce(F.col(f"{k}_eta_success").cast("double"), F.lit(0.0)) for k in ("route", "driver")}
    fifty = {c: F.coalesce(F.when(F.col(c) != 0, F.col(c).cast("double")), F.lit(50.0)) for c in ("route_eta_success", "driver_eta_success", "vehicle_eta_success", "driver_route_eta_success")}
    rows = rows.withColumns(known).withColumns({**fifty, **calendar(F.col("trip_start"))}).withColumns({
        "time_pattern_avg_duration": F.col("route_avg_duration"), "time_pattern_trip_count": F.col("route_trip_count"), "time_pattern_eta_success": F.col("route_eta_success")})
    return _doubles(rows, [NO], [*SLA_FEATURES, *known])


# Risk levels and what is said of them, by the least probability.
RISKS = [
    (0.85, "low", "High confidence of on-time delivery"),
    (0.65, "medium", "Moderate risk of delay — monitor this trip"),
    (0.45, "high", "Significant delay risk — consider alternatives"),
    (0.0, "critical", "Very likely to miss ETA — intervene now"),
]
# Reasons; {} is a rate in whole per cent.
NO_EXPERIENCE = "Driver has no experience on this route"
LOW_OWN_RATE = "Driver's route ETA success is low ({}%)"
LOW_ROUTE_RATE = "This route has low overall ETA success ({}%)"
LOW_DRIVER_RATE = "Driver overall ETA success is low ({}%)"
AT_NIGHT = "Night-time trip — historically lower on-time rates"


def sla_risk(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Risk level, message and reasons on a given on-time probability.

    Rates come from route_eta_known and driver_eta_known where there are such
    columns (0: none known), else from the features.
    """
    p = F.col(probability)
    by_risk = lambda k: F.coalesce(*[F.when(p >= least, F.lit((level, text)[k])) for least, level, text in RISKS], F.lit(RISKS[-1][k + 1]))
    level, message = by_risk(0), by_risk(1)
    route, driver = (f"{k}_eta_known" if f"{k}_eta_known" in scored.columns else f"{k}_eta_success" for k in ("route", "driver"))
    said = lambda text, c: F.concat(F.lit(text.partition("{}")[0]), whole(c), F.lit(text.partition("{}")[2]))
    whole = lambda c: F.bround(F.col(c).cast("decimal(38,10)"), 0).cast("bigint").cast("string")
    factors = F.array_compact(F.array(
        F.when(F.col("driver_route_trips") == 0, F.lit(NO_EXPERIENCE)).when(F.col("driver_route_eta_success") < 50, said(LOW_OWN_RATE, "driver_route_eta_success")),
        F.when(F.col(route) < 60, said(LOW_ROUTE_RATE, route)),
        F.when(F.col(driver) < 60, said(LOW_DRIVER_RATE, driver)),
        F.when((F.col("hour") >= 22) | (F.col("hour") <= 5), F.lit(AT_NIGHT)),
    ))
    return scored.withColumns({
        "prediction": F.when(p >= 0.5, "on_time").otherwise("likely_delayed"), "risk_level": level, "risk_message": message, "contributing_factors": factors})


# ------------------------------------------------------------- fuel
def fuel_features(trips: DataFrame, fleet) -> DataFrame:
    """17 features; recorded litres are kept beside them when the table has them."""
    rows = with_summaries(trips.filter((F.col("trip_duration_minutes") > 0) & F.col("trip_start").isNotNull()), fleet)
    litres = F.col("fuel_consumed").cast("double") if "fuel_consumed" in rows.columns else F.lit(None).cast("double")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = rows.withColumns({
        **calendar(F.col("trip_start")), "is_night_trip": T.night_flag(F.hour("trip_start")),
        "speed_variance_proxy": F.abs(zero("avg_speed_kmph") - zero("vehicle_avg_speed"))})
    return _doubles(rows, [NO, litres.alias("fuel_consumed")], FUEL_FEATURES)


def fuel_target(rows: DataFrame, min_records: int = 100) -> DataFrame:
    """Litres per trip: recorded ones if there are enough, else the consumption formula (without noise)."""
    recorded = rows.agg(F.count("fuel_consumed").alias("n")).scalar()
    minutes = F.col("trip_duration_minutes")
    km = F.greatest(F.when(F.col("trip_km") > 0, F.col("trip_km")).otherwise(minutes / 60 * 40), F.lit(0.1))
    speed = F.greatest(F.when(F.col("avg_speed_kmph") > 0, F.col("avg_speed_kmph")).otherwise(km / F.greatest(minutes / 60, F.lit(0.01))), F.lit(1.0))
    expected = km / speed * 60
    idle = F.least(F.greatest((minutes - expected) / F.greatest(expected, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    formula = (
        km * 0.35 * (1 + F.abs(speed - 55) * 0.005) * (1 + F.least(F.col("load_weight_kg") / 20000, F.lit(0.3)))
        * (1 - F.col("is_night_trip") * 0.03) * (1 + idle * 0.15))
    out = rows.withColumn("target", F.when(recorded > min_records, F.col("fuel_consumed")).otherwise(F.greatest(formula, F.lit(0.1))))
    return out.filter(F.col("target") > 0)


DIESEL_PRICE = 88.0


def fuel_fleet_stats(rows: DataFrame) -> DataFrame:
    """Litres per trip and km, total litres and cost over the given target column."""
    from ..functions.numeric import rnd

    return rows.agg(
        rnd(F.avg("target")).alias("avg_fuel_per_trip"), rnd(F.try_divide(F.avg("target"), F.avg("trip_km")), 4).alias("avg_fuel_per_km"),
        rnd(F.sum("target"), 0).alias("total_predicted_fuel"), rnd(F.try_divide(F.sum("trip_km"), F.sum("target")), 2).alias("fuel_efficiency_km_per_l"),
        rnd(F.avg("target") * DIESEL_PRICE).alias("avg_cost_per_trip"))
