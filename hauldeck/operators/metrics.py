"""Quality figures of predictions, each one aggregate over the rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from .quantiles import exact_quantile


def _share(cond):
    return F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100


def regression_metrics(rows: DataFrame, actual: str = "target", predicted: str = "prediction", within=(15, 30, 60), guard: float = 0.0) -> DataFrame:
    """MAE, RMSE, R2, MAPE (actual not 0) and shares within limits. guard is added to the total variation."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    err = F.abs(y - p)
    nonzero = F.when(y != 0, err / F.abs(y))
    total = F.var_pop(y) * F.count(y) + guard
    return rows.filter(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("samples"), rnd(F.avg(err), 4).alias("mae"), rnd(F.sqrt(F.avg((y - p) * (y - p))), 4).alias("rmse"),
        rnd(1 - F.try_divide(F.sum((y - p) * (y - p)), total), 4).alias("r2"), rnd(F.avg(nonzero) * 100).alias("mape"),
        *[rnd(_share(err <= w)).alias(f"within_{w}min") for w in within], rnd(_share(F.when(y > 0, err / y) <= 0.20)).alias("within_20_pct"))


def arrival_metrics(rows: DataFrame, actual: str = "ata_in", predicted: str = "predicted_arrival") -> DataFrame:
    """Mean, median and bias of the arrival error in hours, shares within 1/2/4/8 hours."""
    signed = (F.unix_micros(F.col(predicted).cast("timestamp")) - F.unix_micros(F.col(actual).cast("timestamp"))).cast("double") / 3.6e9
    e = rows.select(signed.alias("s")).withColumn("e", F.abs("s"))
    out = e.agg(
        rnd(F.avg("e")).alias("mean_arrival_error_hours"), rnd(F.avg("s")).alias("bias_hours"),
        *[rnd(_share(F.col("e") <= h)).alias(f"within_{h}h_pct") for h in (1, 2, 4, 8)], F.count(F.lit(1)).alias("test_samples"))
    return out.withColumn("median_arrival_error_hours", rnd(F.lit(exact_quantile(e, "e", 0.5)).cast("double")))


def classification_metrics(rows: DataFrame, label: str = "label", probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC and class counts, all on the scores as they are.

    Equal scores count once. Ranks run inside 10,000 score ranges; the ranges'
    counts give each its offset, so no task orders all scores.
    """
    by_score = rows.select(F.col(probability).cast("double").alias("p"), F.col(label).alias("y")).groupBy("p").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    by_score = by_score.withColumn("b", F.floor(F.col("p") * 10000))
    ranges = by_score.groupBy("b").agg(F.sum("neg").alias("n"))
    offsets = ranges.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    below = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    s = by_score.withColumn("i", F.coalesce(F.sum("neg").over(below), F.lit(0))).join(offsets, "b", "left").withColumn("nb", F.coalesce("o", F.lit(0)) + F.col("i"))
    hit = F.col("p") >= threshold
    s = s.agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).cast("double").alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).cast("double").alias("fp"),
        F.sum("pos").cast("double").alias("np"), F.sum("neg").cast("double").alias("nn"), F.sum(F.col("pos") * (F.col("nb") + F.col("neg") / 2.0)).alias("w"))
    tp, fp, np_, nn = (F.col(c) for c in ("tp", "fp", "np", "nn"))
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, np_), F.lit(0.0))
    return s.select(
        rnd((tp + nn - fp) / (np_ + nn), 4).alias("accuracy"), rnd(precision, 4).alias("precision"), rnd(recall, 4).alias("recall"),
        rnd(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)), 4).alias("f1_score"), rnd(F.try_divide(F.col("w"), np_ * nn), 4).alias("auc_roc"),
        np_.cast("bigint").alias("on_time"), nn.cast("bigint").alias("delayed"))


# Confidence thresholds of the coverage report.
THRESHOLDS = [0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95]


def threshold_coverage(rows: DataFrame, label: str = "label", predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """Share routed and accuracy at each threshold, from one pass over the rows."""
    right, c = F.col(label) == F.col(predicted), F.col(confidence)
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, t in enumerate(THRESHOLDS):
        aggs += [F.sum(F.when(c >= t, 1).otherwise(0)).alias(f"r{k}"), F.sum(F.when((c >= t) & right, 1).otherwise(0)).alias(f"c{k}")]
    parts = ", ".join(f"{t}D, n, r{k}, c{k}" for k, t in enumerate(THRESHOLDS))
    wide = rows.agg(*aggs).selectExpr(f"stack({len(THRESHOLDS)}, {parts}) as (threshold, n, routed, correct)")
    return wide.select("threshold", rnd(F.col("routed") / F.col("n"), 4).alias("coverage"), rnd(F.coalesce(F.try_divide(F.col("correct"), F.col("routed")), F.lit(0.0)), 4).alias("accuracy"), "routed", "correct")


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(rows: DataFrame, classes: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(label).alias("actual")).pivot(predicted, classes).count().na.fill(0)


def class_report(rows: DataFrame, label: str = "label", predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """Per class: precision, recall (its accuracy), F1, mean confidence, samples."""
    right = F.col(label) == F.col(predicted)
    actual = rows.groupBy(F.col(label).alias("agent")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.when(right, 1).otherwise(0)).alias("_tp"), rnd(F.avg(confidence), 3).alias("avg_confidence"))
    chosen = rows.groupBy(F.col(predicted).alias("agent")).agg(F.count(F.lit(1)).alias("_chosen"))
    out = actual.join(chosen, "agent", "full").na.fill(0, ["samples", "_tp", "_chosen"])
    p = F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("_chosen")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("_tp").cast("double"), F.col("samples")), F.lit(0.0))
    return out.select("agent", rnd(p, 3).alias("precision"), rnd(r, 3).alias("recall"), rnd(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 3).alias("f1"), "avg_confidence", "samples")
