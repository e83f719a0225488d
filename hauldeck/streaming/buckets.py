"""Tables that grow by batches and are rewritten bucket by bucket.

A row's bucket is a hash of its key. Each batch writes the buckets it touches,
whole, as a version of its own, and a manifest that says which version each
bucket has now. A batch that runs again writes the same folder from the same
earlier versions, so a restart neither loses nor doubles anything.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MANIFEST = "bucket int, version long"


class Buckets:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, count: int = BUCKETS):
        self.spark, self.path, self.keys, self.schema, self.count = spark, path, keys, schema, count

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows, at most `count` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def versions(self, batch: int) -> dict[int, int]:
        """Bucket -> version before this batch."""
        if batch <= 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/batch={batch - 1}").collect()}

    def read(self, batch: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets (all, if none are named) as they were before this batch; other buckets' files are not opened."""
        at = self.versions(batch)
        folders = [f"{self.path}/version={v}/bucket={b}" for b, v in at.items() if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, batch: int, rows: DataFrame, touched: list[int]) -> None:
        """The touched buckets' whole content after this batch."""
        folder = f"{self.path}/version={batch}"
        rows.withColumn("bucket", self.bucket()).repartition(max(1, min(self.count, len(touched))), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        try:
            filled = [r[0] for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()]
        except AnalysisException:  # no row is left in any touched bucket, so there is no file
            filled = []
        now = {b: v for b, v in self.versions(batch).items() if b not in set(touched)} | dict.fromkeys(filled, batch)
        self.spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
