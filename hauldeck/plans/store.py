"""The fleet's tables for one input folder.

Dimensions are lazy projections of the given files. The trip fact and the
summary tables are used by nearly every read, so they are written once as
Parquet below spark.checkpoint.dir and read from there: later plans then
start at a pruned, filtered scan, and a lost executor only re-reads files.
"""

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loading, summaries
from ..operators.staging import shared_folder
from ..sources import driver_tables


class Fleet:
    _open: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = f"{shared_folder(spark)}/hauldeck-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}
        self._models: set[str] = set()
        self.exports: set[str] = set()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Fleet":
        key = (spark.sparkContext.applicationId, sf_dir)
        found = cls._open.get(key)
        if found is None or found.spark.sparkContext._jsc is None:
            found = cls._open[key] = cls(spark, sf_dir)
        return found

    def given(self, name: str) -> DataFrame:
        return driver_tables.given(self.spark, self.sf_dir, name)

    def stored(self, name: str, build, order_by: list[str] | None = None, looked_up: str | None = None) -> DataFrame:
        """A table that is written when first asked for.

        `order_by` orders every file in the task that writes it, without moving rows, so that a range of values is a few pages
        of a file; `looked_up` names a column whose row groups get a Bloom filter, so that a read of one value skips the others.
        """
        if name not in self._tables:
            df = build()
            if order_by:
                df = df.sortWithinPartitions(*order_by)
            path = f"{self.folder}/{name}"
            writer = df.write.mode("overwrite").option("compression", "zstd")
            if looked_up:
                writer = writer.option(f"parquet.bloom.filter.enabled#{looked_up}", "true").option(f"parquet.bloom.filter.expected.ndv#{looked_up}", "1000000").option("parquet.bloom.filter.adaptive.enabled", "true")
            writer.parquet(path)
            self._tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._tables[name]

    def model(self, name: str, fit) -> str:
        """The folder of a fitted model: fitted and saved by the first who asks, loaded from there by all."""
        path = f"{self.folder}/models/{name}"
        if path not in self._models:
            fit().write().overwrite().save(path)
            self._models.add(path)
        return path

    def trained(self, name: str, train) -> tuple[PipelineModel, DataFrame]:
        """A pipeline from the model store and the metrics kept beside it; train() gives both once."""
        path = f"{self.folder}/models/{name}"
        if path not in self._models:
            model, metrics = train()
            model.write().overwrite().save(path)
            metrics.write.mode("overwrite").parquet(f"{path}-metrics")
            self._models.add(path)
        return PipelineModel.load(path), self.spark.read.parquet(f"{path}-metrics")

    # raw rows and dimensions
    @property
    def raw(self) -> DataFrame:
        return driver_tables.raw_trips(self.spark, self.sf_dir)

    @property
    def raw_with_type(self) -> DataFrame:
        return self.raw_table.join(self.vehicles.select("asset_id", "asset_type"), "asset_id")

    @property
    def drivers(self) -> DataFrame:
        return driver_tables.drivers(self.spark, self.sf_dir)

    @property
    def vehicles(self) -> DataFrame:
        return driver_tables.vehicles(self.spark, self.sf_dir)

    @property
    def locations(self) -> DataFrame:
        return driver_tables.locations(self.spark, self.sf_dir)

    @property
    def customers(self) -> DataFrame:
        return driver_tables.customers(self.spark, self.sf_dir)

    @property
    def waypoints(self) -> DataFrame:
        return driver_tables.waypoints(self.spark, self.sf_dir)

    @property
    def expenses(self) -> DataFrame:
        return driver_tables.expenses(self.spark, self.sf_dir)

    @property
    def questions(self) -> DataFrame:
        return driver_tables.question_texts(self.spark, self.sf_dir)

    @property
    def labelled(self) -> DataFrame:
        return driver_tables.labelled_texts(self.spark, self.sf_dir)

    # written once per session
    @property
    def raw_table(self) -> DataFrame:
        """Raw rows for questions that read them several times."""
        return self.stored("raw", lambda: self.raw)

    @property
    def first(self) -> DataFrame:
        """Deduplicated raw rows."""
        return self.stored("first", lambda: driver_tables.first_trips(self.spark, self.sf_dir))

    @property
    def trips(self) -> DataFrame:
        return self.stored("trips", lambda: loading.trips_fact(self.first), ["trip_start", "dispatch_entry_no"], looked_up="dispatch_entry_no")

    @property
    def driver_summary(self) -> DataFrame:
        return self.stored("driver_summary", lambda: summaries.driver_summary(self.trips, self.drivers))

    @property
    def route_summary(self) -> DataFrame:
        return self.stored("route_summary", lambda: summaries.route_summary(self.trips, self.locations))

    @property
    def vehicle_summary(self) -> DataFrame:
        return self.stored("vehicle_summary", lambda: summaries.vehicle_summary(self.trips, self.vehicles))

    @property
    def route_time_patterns(self) -> DataFrame:
        return self.stored("route_time_patterns", lambda: summaries.route_time_patterns(self.trips, self.locations))

    @property
    def daily_fleet_stats(self) -> DataFrame:
        return self.stored("daily_fleet_stats", lambda: summaries.daily_fleet_stats(self.trips))


def portable(df: DataFrame) -> DataFrame:
    """Flattens types that engines print differently: decimals, dates, times, lists, flags."""
    cols = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "decimal":
            c = c.cast("double")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "boolean":
            c = c.cast("int").cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
