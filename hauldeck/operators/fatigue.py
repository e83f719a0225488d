"""Fatigue risk per driver from the latest trips; 'now' is the driver's latest start."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import count_when, rnd
from .paging import top_per
from .summaries import reliable

FATIGUE_FEATURES = [
    "trips_last_24h", "trips_last_7d", "hours_driving_last_24h", "hours_driving_last_7d", "avg_trip_duration_recent", "max_trip_duration_recent",
    "avg_speed_recent", "speed_variance_recent", "night_trips_last_7d", "eta_delay_rate_recent", "avg_delay_min_recent", "hours_since_last_trip",
    "is_current_night", "consecutive_days_active",
]


def fatigue_input(trips: DataFrame, drivers: DataFrame) -> DataFrame:
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return reliable(trips).filter("trip_start is not null and driver_id is not null").join(names, "driver_id").select(
        "driver_id", "driver_name", "dispatch_entry_no", "trip_start", "trip_end", "trip_duration_minutes", "avg_speed_kmph", "eta_met", "eta_delay_minutes",
        F.hour("trip_start").alias("start_hour"))


def fatigue_raw(trips: DataFrame, min_trips: int = 3) -> DataFrame:
    """Unrounded features, one row per driver."""
    rows = reliable(trips).filter("trip_start is not null and driver_id is not null")
    latest = rows.groupBy("driver_id").agg(F.max("trip_start").alias("now"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_trips)

    # last 7 days and 24 hours
    age_ok = lambda days: F.col("trip_start") >= F.col("now") - F.make_dt_interval(days=F.lit(days))
    week = rows.select("driver_id", "trip_start", "trip_duration_minutes").join(latest, "driver_id").filter(age_ok(7))
    minutes = F.col("trip_duration_minutes")
    night = T.night_flag(F.hour("trip_start")) == 1
    windows = week.groupBy("driver_id").agg(
        F.first("now").alias("now"),
        count_when(age_ok(1)).alias("trips_last_24h"), F.count(F.lit(1)).alias("trips_last_7d"),
        (F.sum(F.when(age_ok(1), minutes).otherwise(0)).cast("double") / 60).alias("hours_driving_last_24h"),
        (F.sum(minutes).cast("double") / 60).alias("hours_driving_last_7d"),
        count_when(night).alias("night_trips_last_7d"))

    # last 20 trips: the rank limit runs before the shuffle
    last20 = top_per(rows.join(latest.select("driver_id"), "driver_id", "left_semi"), ["driver_id"], [F.desc("trip_start"), "dispatch_entry_no"], 20, rank="_k")
    speed = F.coalesce(F.col("avg_speed_kmph").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    delay = F.coalesce(F.col("eta_delay_minutes"), F.lit(0).cast("decimal(12,2)"))
    k = F.count(F.lit(1)).cast("double")
    recent = last20.groupBy("driver_id").agg(
        (F.sum(minutes).cast("double") / k).alias("avg_trip_duration_recent"), F.max(minutes).cast("double").alias("max_trip_duration_recent"),
        (F.sum(speed).cast("double") / k).alias("avg_speed_recent"), F.stddev_samp(speed.cast("double")).alias("speed_variance_recent"),
        (count_when(F.coalesce("eta_met", F.lit(0)) == 0).cast("double") * 100 / k).alias("eta_delay_rate_recent"),
        (F.sum(delay).cast("double") / k).alias("avg_delay_min_recent"),
        F.max(F.when(F.col("_k") == 1, F.coalesce("trip_end", "trip_start"))).alias("_end"), F.max(F.when(F.col("_k") == 2, F.col("trip_start"))).alias("_start2"))

    # run of active days that ends with the latest one
    days = rows.select("driver_id", F.to_date("trip_start").alias("day")).distinct()
    w = Window.partitionBy("driver_id").orderBy(F.desc("day"))
    steps = days.withColumns({"_i": F.row_number().over(w), "_last": F.first("day").over(w)})
    runs = steps.groupBy("driver_id").agg(count_when(F.datediff("_last", "day") == F.col("_i") - 1).alias("consecutive_days_active"))

    gap = (F.unix_micros("_end") - F.unix_micros("_start2")).cast("double") / 3.6e9
    return windows.join(recent, "driver_id").join(runs, "driver_id").withColumns({
        "hours_since_last_trip": F.greatest(F.lit(0.0), gap), "is_current_night": T.night_flag(F.hour("now"))}).drop("_end", "_start2")


def fatigue_score_of():
    """Sum of the risk points."""
    points = [
        F.when(F.col("hours_driving_last_24h") > 10, 3).when(F.col("hours_driving_last_24h") > 7, 2).otherwise(0),
        F.when(F.col("trips_last_24h") >= 4, 2).otherwise(0),
        F.when(F.col("night_trips_last_7d") >= 3, 1).otherwise(0),
        F.when(F.col("consecutive_days_active") >= 7, 2).when(F.col("consecutive_days_active") >= 5, 1).otherwise(0),
        F.when((F.col("hours_since_last_trip") < 4) & (F.col("trips_last_24h") >= 2), 2).otherwise(0),
        F.when(F.col("eta_delay_rate_recent") > 40, 1).otherwise(0),
        F.when(F.col("speed_variance_recent") > 15, 1).otherwise(0),
    ]
    total = points[0]
    for p in points[1:]:
        total = total + p
    return total


def fatigue_features(trips: DataFrame, drivers: DataFrame) -> DataFrame:
    """Rounded features with score and label (score from the unrounded ones)."""
    rows = fatigue_raw(trips).withColumn("fatigue_score", fatigue_score_of())
    rows = rows.withColumn("is_fatigued", F.when(F.col("fatigue_score") >= 4, 1).otherwise(0))
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    floats = [c for c, t in rows.dtypes if t == "double"]
    return rows.withColumns({c: rnd(c) for c in floats}).join(names, "driver_id").select(
        "driver_id", "driver_name", "now", *FATIGUE_FEATURES, "fatigue_score", "is_fatigued")


def fatigue_risk(score):
    return F.when(score >= 7, "critical").when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def _whole(c):
    return F.bround(F.col(c).cast("decimal(38,10)"), 0).cast("bigint").cast("string")


def _factors(texts: tuple):
    hours, trips24, days, nights, rest = texts
    count = lambda c: F.col(c).cast("string")
    return F.array_compact(F.array(
        F.when(F.col("hours_driving_last_24h") > 7, F.concat(F.lit(hours[0]), _whole("hours_driving_last_24h"), F.lit(hours[1]))),
        F.when(F.col("trips_last_24h") >= 4, F.concat(count("trips_last_24h"), F.lit(trips24))),
        F.when(F.col("consecutive_days_active") >= 5, F.concat(count("consecutive_days_active"), F.lit(days))),
        F.when(F.col("night_trips_last_7d") >= 3, F.concat(count("night_trips_last_7d"), F.lit(nights))),
        F.when((F.col("hours_since_last_trip") < 4) & (F.col("trips_last_24h") >= 2), F.lit(rest)),
    ))


# Factor wording of the status answer and of the alert message.
STATUS_TEXTS = (("Driving ", "h in last 24h"), " trips in last 24h", " consecutive active days", " night trips this week", "Insufficient rest between trips")
ALERT_TEXTS = (("", "h driving in last 24h"), " trips in 24h", " consecutive days active", " night trips this week", "Back-to-back trips with insufficient rest")


def fatigue_status(features: DataFrame) -> DataFrame:
    """Every driver with risk level and reasons."""
    return features.withColumns({"risk_level": fatigue_risk(F.col("fatigue_score")), "factors": _factors(STATUS_TEXTS)})


def fatigue_counts(features: DataFrame) -> DataFrame:
    return features.groupBy(fatigue_risk(F.col("fatigue_score")).alias("risk_level")).agg(F.count(F.lit(1)).alias("drivers"))


def fatigue_top(features: DataFrame, k: int = 20) -> DataFrame:
    """The k worst drivers of the two upper levels."""
    rows = fatigue_status(features).filter(F.col("risk_level").isin("critical", "high"))
    return top_per(rows, ["risk_level"], [F.desc("fatigue_score"), "driver_id"], k).select(
        "risk_level", "driver_id", "driver_name", "fatigue_score", F.col("hours_driving_last_24h").alias("hours_driving_24h"), F.col("trips_last_24h").alias("trips_24h"),
        F.col("consecutive_days_active").alias("consecutive_days"), F.col("night_trips_last_7d").alias("night_trips_7d"))


def fatigue_alerts(features: DataFrame, limit: int = 50) -> DataFrame:
    score = F.col("fatigue_score")
    rows = features.filter(score >= 4).orderBy(F.desc("fatigue_score"), "driver_id").limit(limit).withColumn("factors", _factors(ALERT_TEXTS))
    message = F.concat(F.lit("Driver "), F.col("driver_name"), F.lit(": fatigue risk score "), score.cast("string"), F.lit("/10. "), F.array_join("factors", "; "))
    return rows.select(
        F.lit("fatigue").alias("alert_type"), F.when(score >= 7, "high").when(score >= 5, "medium").otherwise("low").alias("severity"), "driver_id",
        F.lit(None).cast("string").alias("trip_no"), F.lit(None).cast("bigint").alias("vehicle_id"),
        F.lit("Driver Fatigue Risk").alias("title"), message.alias("message"), F.col("now").alias("created_at"))
