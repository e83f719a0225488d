"""Expense entries by date range and category."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sum2


def _in_range(expenses: DataFrame, start: str, end: str) -> DataFrame:
    return expenses.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def ledger_range(expenses: DataFrame, start: str, end: str) -> DataFrame:
    """Entries of an inclusive range, newest first."""
    return _in_range(expenses, start, end).orderBy(F.desc("date"), F.desc("id"))


def ledger_by_category(expenses: DataFrame, start: str, end: str, category: str | None = None) -> DataFrame:
    rows = _in_range(expenses, start, end)
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.groupBy("category").agg(sum2("amount").alias("total_amount"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("total_amount"), "category")


def ledger_local(expenses: DataFrame, start: str, end: str) -> DataFrame:
    """Older listing: oldest id first."""
    return _in_range(expenses, start, end).orderBy("id")


def ledger_local_totals(expenses: DataFrame, start: str, end: str) -> DataFrame:
    return _in_range(expenses, start, end).groupBy("category").agg(sum2("amount").alias("total_amount")).orderBy("category")
