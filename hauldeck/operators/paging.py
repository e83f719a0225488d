"""Ranking and paging. Every order ends in an id, so pages are repeatable."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None, skip: int = 0) -> DataFrame:
    """Rows skip+1 .. k per key; the limit is applied map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    if skip:
        out = out.filter(F.col("_r") > skip)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def spread_rank(df: DataFrame, keys: list[str], bucket: Column, tie: list, name: str, descending: bool = False) -> DataFrame:
    """row_number per key ordered by (bucket, tie) without gathering a key in one task.

    Rows are numbered inside (key, bucket); a small table of bucket counts
    gives each bucket's offset. The bucket must have a bounded number of
    values per key (days, rounded scores).
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*tie))
    return df.withColumn("_i", inside).join(offsets, [*keys, "_b"]).withColumn(name, F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def page_per(df: DataFrame, keys: list[str], order: list, page: int, limit: int) -> DataFrame:
    """The same page of every key's rows, with the key's total and page count."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rows = top_per(df, keys, order, page * limit, skip=(page - 1) * limit)
    return rows.join(totals, keys).withColumn("total_pages", F.ceil(F.col("total") / limit))


def paginate(df: DataFrame, order: list, page: int = 1, limit: int = 20) -> DataFrame:
    """One page plus total and total_pages on every row."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return rows.withColumns({"total": total, "total_pages": F.ceil(total / limit)})


def chosen_order(sort_by: str, sort_order: str, allowed: list[str], default: str, tie: str) -> list[Column]:
    """Whitelisted sort column and direction; anything else falls back to the default, descending."""
    name = sort_by if sort_by in allowed else default
    first = F.asc(name) if sort_order == "asc" else F.desc(name)
    return [first, F.asc(tie)]
