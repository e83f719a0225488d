"""The table of trained models: versions, active flags, metrics as JSON."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .loading import upsert  # noqa: F401  (same replace-by-key rule as the other tables)


def model_register(trainings: DataFrame) -> DataFrame:
    """Version numbers per model in training order; the latest version is the active one.

    trainings: model_name, trained_at, model_type, metrics (JSON), training_data_count.
    """
    w = Window.partitionBy("model_name")
    rows = trainings.withColumn("version", F.row_number().over(w.orderBy("trained_at")).cast("bigint"))
    return rows.withColumn("is_active", F.when(F.col("version") == F.max("version").over(w), 1).otherwise(0))


def add_training(models: DataFrame, new: DataFrame) -> DataFrame:
    """Appends one training per model: next version, all older ones inactive."""
    top = models.groupBy("model_name").agg(F.max("version").alias("_top"))
    fresh = new.join(top, "model_name", "left").withColumns({"version": F.coalesce("_top", F.lit(0)) + 1, "is_active": F.lit(1)}).drop("_top")
    old = models.join(new.select("model_name", F.lit(1).alias("_again")), "model_name", "left")
    return old.withColumn("is_active", F.when(F.col("_again").isNotNull(), 0).otherwise(F.col("is_active"))).drop("_again").unionByName(fresh)


def model_list(models: DataFrame, metrics_schema: str) -> DataFrame:
    """All versions, newest first per model, metrics unpacked."""
    return models.withColumn("_m", F.from_json("metrics", metrics_schema)).select(
        "model_name", "version", "model_type", "training_data_count", "is_active", "trained_at", "_m.*").orderBy("model_name", F.desc("version"))


def model_compare(models: DataFrame, metrics_schema: str) -> DataFrame:
    """Active models side by side."""
    return model_list(models.filter("is_active = 1"), metrics_schema).drop("is_active").orderBy("model_name")


def model_info(models: DataFrame, metrics_schema: str, name: str) -> DataFrame:
    return model_list(models.filter((F.col("is_active") == 1) & (F.col("model_name") == name)), metrics_schema)
