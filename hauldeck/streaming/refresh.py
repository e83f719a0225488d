"""Keeping figures up to date as trips arrive, with Structured Streaming.

Each micro-batch brings trips, new ones, repeated ones and new versions of
earlier ones. The store of trips, in buckets by dispatch number, says which
versions go; added and removed trips change the summaries' states
(operators.partials), in buckets by their keys. So a batch reads and writes
the buckets it touches, a repeat counts once however late it comes, and a
trip that moved to another driver or day changes both.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partials
from ..operators.loading import first_rows
from ..operators.staging import stage
from .buckets import Buckets

NUMBER = "dispatch_entry_no"


def trip_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_columns(columns: list[str], wanted: list[partials.Partial]) -> list[str]:
    """Those of a trip's columns that tell its versions apart or that the states read; a batch stores and moves no others."""
    read = " ".join(x for p in wanted for x in (p.where, *p.sums, *p.values, *(sql for _, sql in p.keys)))
    used = {NUMBER, "dt_updated", "dt_created", "eta_met", *re.findall(r"\w+", read)}
    return [c for c in columns if c in used]


def trip_store(spark: SparkSession, folder: str, schema) -> Buckets:
    return Buckets(spark, f"{folder}/trips", [NUMBER], schema)


def state_store(spark: SparkSession, folder: str, partial: partials.Partial, trips: DataFrame) -> Buckets:
    return Buckets(spark, f"{folder}/state-{'-'.join(partial.names)}", partial.names, partials.state_of(trips, partial).schema)


def latest_versions(batch: DataFrame) -> DataFrame:
    """One row per dispatch number: the one updated last, then created last; equal ones are told apart by a hash. Trips without a number are not counted."""
    order = [F.desc_nulls_last("dt_updated"), F.desc_nulls_last("dt_created"), F.xxhash64(*[F.col(c).cast("string") for c in batch.columns])]
    return first_rows(batch.filter(F.col(NUMBER).isNotNull()), [NUMBER], order)


def apply_batch(batch: DataFrame, number: int, folder: str, wanted: list[partials.Partial]) -> None:
    """Brings the trip store and the states from their versions before this batch to those after it."""
    spark = batch.sparkSession
    trips = trip_store(spark, folder, batch.schema)
    added = stage(latest_versions(batch), "added")
    touched = trips.touched(added)
    before = trips.read(number, touched)
    removed = stage(before.join(added.select(NUMBER), NUMBER, "left_semi").select(batch.columns), "removed")
    trips.write(number, before.join(added.select(NUMBER), NUMBER, "left_anti").select(batch.columns).unionByName(added), touched)
    for partial in wanted:
        store = state_store(spark, folder, partial, added)
        change = stage(partials.combined(partial, partials.state_of(added, partial), partials.state_of(removed, partial, -1)), "change")
        buckets = store.touched(change)
        store.write(number, partials.merged(partial, store.read(number, buckets), change), buckets)


def run(trips: DataFrame, folder: str, checkpoint: str, wanted: list[partials.Partial]) -> int:
    """Processes everything available, then stops; gives the number of batches that have been applied so far."""
    done = []

    def step(batch: DataFrame, number: int):
        apply_batch(batch, number, folder, wanted)
        done.append(number + 1)

    query = trips.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(done, default=0)


def state_after(spark: SparkSession, folder: str, partial: partials.Partial, trips: DataFrame, batches: int) -> DataFrame:
    """The state as it is after so many batches."""
    return state_store(spark, folder, partial, trips).read(batches)


def daily_with_open_days(state: DataFrame, latest, days: int = 7) -> DataFrame:
    """All days; is_provisional marks those that end less than `days` before the latest trip, for which trips still come."""
    stats = partials.daily_fleet_stats(state)
    closed = F.date_add("stat_date", 1).cast("timestamp") <= latest - F.make_dt_interval(days=F.lit(days))
    return stats.withColumn("is_provisional", F.when(closed, 0).otherwise(1))
