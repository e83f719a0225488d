"""Writing results to text files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_MARK = "\\N"
# Column order of the bulk file.
BULK_COLUMNS = [
    "dispatch_entry_no", "driver_id", "vehicle_id", "origin_id", "destination_id", "customer_id",
    "trip_start", "trip_end", "trip_eta", "ata_in", "ata_out", "dt_created", "dt_updated",
    "trip_km", "total_dist", "cover_dist", "trip_duration_minutes", "eta_met", "eta_delay_minutes", "avg_speed_kmph",
    "trip_status", "is_active", "trip_close_remark", "material_desc", "invoice_no", "invoice_date", "ref_no", "ref_date",
    "entry_type", "own_market_type", "running_sts", "trip_seq", "delay_by", "device_id", "device_type", "entity_id",
    "cnr_id", "created_by", "updated_by", "track_link", "data_string",
]


def head_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def head_export(df: DataFrame, path: str, order: list, n: int = 100) -> None:
    head_rows(df, order, n).write.mode("overwrite").option("header", True).csv(path)


def bulk_rows(trips: DataFrame) -> DataFrame:
    """All bulk columns as text in file order; columns the input lacks are NULL."""
    cols = []
    for c in BULK_COLUMNS:
        if c not in trips.columns:
            cols.append(F.lit(None).cast("string").alias(c))
        elif trips.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz"):
            cols.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    return trips.select(*cols)


def bulk_export(trips: DataFrame, path: str) -> None:
    """Tab-separated, no header, \\N for NULL."""
    bulk_rows(trips).write.mode("overwrite").option("sep", "\t").option("nullValue", NULL_MARK).option("emptyValue", "").csv(path)


def report_rows(predicted: DataFrame) -> DataFrame:
    """Per-trip validation rows, largest arrival error first."""
    from ..functions.trips import arrival_time

    arrival = arrival_time(F.col("trip_start"), F.col("predicted_duration_minutes"))
    hours = F.abs(F.unix_micros(arrival) - F.unix_micros(F.col("ata_in").cast("timestamp"))).cast("double") / 3.6e9
    return (
        predicted.withColumns({"predicted_arrival": arrival, "error_hours": hours})
        .withColumns({"within_1h": F.col("error_hours") <= 1, "within_2h": F.col("error_hours") <= 2})
        .select(
            "dispatch_entry_no", "trip_start", "origin", "destination", F.col("ata_in").alias("actual_arrival_ata_in"),
            "predicted_arrival", "predicted_duration_minutes", F.col("trip_duration_minutes").alias("actual_duration_minutes"),
            "error_hours", "within_2h", "within_1h",
        )
        .orderBy(F.desc("error_hours"), "dispatch_entry_no")
    )


def report_export(predicted: DataFrame, path: str) -> None:
    report_rows(predicted).write.mode("overwrite").option("header", True).csv(path)


def quoted_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
