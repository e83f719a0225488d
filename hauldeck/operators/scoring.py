"""Driver scores and risk levels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import clip, count_when, rnd
from .quantiles import exact_quantiles
from .summaries import reliable


def driver_trip_stats(trips: DataFrame, min_trips: int = 3) -> DataFrame:
    hour = F.hour("trip_start")
    return (
        reliable(trips).filter(F.col("driver_id").isNotNull()).groupBy("driver_id")
        .agg(
            rnd(F.stddev_pop(F.col("trip_duration_minutes").cast("double"))).alias("duration_stddev"),
            rnd(F.stddev_pop(F.col("avg_speed_kmph").cast("double"))).alias("speed_stddev"),
            count_when(F.col("eta_delay_minutes") > 120).alias("severe_delays"),
            count_when((hour >= 22) | (hour <= 5)).alias("night_trips"),
            F.count(F.lit(1)).alias("total"),
        )
        .filter(F.col("total") >= min_trips)
    )


def driver_score_input(summary: DataFrame, stats: DataFrame, min_trips: int = 3) -> DataFrame:
    return summary.filter(F.col("total_trips") >= min_trips).join(stats, "driver_id", "left")


def or_else(value, default: float):
    """The value, or the default when it is 0 or missing."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def driver_score(rows: DataFrame) -> DataFrame:
    """Composite 0-100 score. rows should be a stored table: it is read for its priors, too."""
    n = F.col("total_trips").cast("double")
    rate = F.coalesce("eta_success_rate", F.lit(0.0))
    per_trip = F.coalesce("total_distance_km", F.lit(0.0)) / F.greatest(n, F.lit(1.0))
    priors = rows.agg(F.struct(
        (F.sum(F.col("eta_success_rate").cast("decimal(12,4)")).cast("double") / F.count("eta_success_rate")).alias("rate"),
        F.max("total_trips").alias("top"),
    ).alias("p")).scalar()
    usual = exact_quantiles(rows.select("duration_stddev", per_trip.alias("km")), {"spread": ("duration_stddev", 0.95), "km": ("km", 0.5)})
    spread, usual_km = (or_else(F.lit(usual[k]).cast("double"), 1.0) for k in ("spread", "km"))
    rows = rows.withColumns({"_spread": spread, "_km": usual_km, "_rate": or_else(priors["rate"], 55.0), "_top": or_else(priors["top"], 1.0)})
    scored = rows.withColumns({
        "eta_score": clip(T.smoothed_rate(n, rate, F.col("_rate"), 15), 0, 100),
        "speed_score": T.speed_score_scorer(F.coalesce("avg_speed_kmph", F.lit(0.0))),
        "consistency_score": clip((1 - F.coalesce("duration_stddev", "_spread") / F.col("_spread")) * 100, 0, 100),
        "experience_score": F.log1p("total_trips") / F.log1p("_top") * 100,
        "efficiency_score": (1 - clip(F.abs(per_trip - F.col("_km")) / F.col("_km"), 0, 1)) * 100,
        "safety_penalty": clip(F.coalesce("severe_delays", F.lit(0)) / F.greatest(n, F.lit(1.0)), 0, 0.5) * 20,
    })
    total = (
        F.col("eta_score") * 0.35 + F.col("speed_score") * 0.15 + F.col("consistency_score") * 0.20
        + F.col("experience_score") * 0.20 + F.col("efficiency_score") * 0.10 - F.col("safety_penalty")
    )
    scored = scored.withColumn("composite_score", rnd(clip(total, 0, 100)))
    parts = ["eta_score", "speed_score", "consistency_score", "experience_score", "efficiency_score", "safety_penalty"]
    return scored.select(
        "driver_id", "driver_name", "total_trips", "composite_score", risk_level(F.col("composite_score")).alias("risk_level"), *parts)


def risk_level(score):
    """Right-closed bands."""
    return F.when(score <= 35, "critical").when(score <= 55, "high").when(score <= 75, "medium").otherwise("low")


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Rows and mean score per risk level."""
    return scores.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("drivers"),
        rnd(F.sum(F.col("composite_score").cast("decimal(12,4)")).cast("double") / F.count("composite_score")).alias("avg_score"))


def score_predictions(scores: DataFrame, model_id, created_at) -> DataFrame:
    """Scores as prediction rows with the parts as JSON."""
    parts = ["eta_score", "speed_score", "consistency_score", "experience_score", "efficiency_score"]
    return scores.select(
        F.lit(model_id).cast("bigint").alias("model_id"), "driver_id", F.to_json(F.struct("risk_level", *parts)).alias("input_features"),
        F.col("composite_score").alias("predicted_value"), F.lit("driver_score").alias("prediction_type"), F.lit(created_at).cast("timestamp").alias("created_at"))


def driver_score_lookup(predictions: DataFrame, models: DataFrame, model_name: str = "driver_scorer") -> DataFrame:
    """Latest score per driver under the active version of the scorer."""
    from .paging import top_per

    active = models.filter((F.col("model_name") == model_name) & (F.col("is_active") == 1)).select(F.col("id").alias("model_id"), "version")
    rows = predictions.filter(F.col("prediction_type") == "driver_score").join(active, "model_id")
    return top_per(rows, ["driver_id"], [F.desc("created_at"), F.desc("model_id")], 1)


def driver_score_list(latest: DataFrame, drivers: DataFrame, limit: int = 100) -> DataFrame:
    """Drivers by score with the risk level kept in the JSON parts."""
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return latest.orderBy(F.desc("predicted_value"), "driver_id").limit(limit).join(names, "driver_id", "left").select(
        "driver_id", "driver_name", F.col("predicted_value").alias("composite_score"), F.get_json_object("input_features", "$.risk_level").alias("risk_level"), "version")
