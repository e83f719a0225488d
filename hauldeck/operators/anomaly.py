"""Unusual trips: features, an isolation forest, contributions and alerts."""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trips as T
from .quantiles import exact_quantile
from .staging import stage
from .summaries import name_routes, reliable

# the small functions below run in tasks; executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANOMALY_FEATURES = ["trip_duration_minutes", "eta_delay_minutes", "duration_ratio", "delay_ratio", "hour_deviation", "is_night_trip"]
TREES, SAMPLE, DEPTH, CONTAMINATION = 200, 256, 8, 0.05


def anomaly_input(trips: DataFrame, drivers: DataFrame, locations: DataFrame, routes: DataFrame) -> DataFrame:
    """Reliable trips with names and route means; all of them."""
    means = routes.select(
        "origin_id", "destination_id", F.col("avg_duration_min").alias("route_avg_duration"),
        F.col("avg_distance_km").alias("route_avg_distance"), F.col("eta_success_rate").alias("route_eta_success"))
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    rows = reliable(trips).filter(F.col("trip_start").isNotNull()).join(means, ["origin_id", "destination_id"], "left").join(names, "driver_id", "left")
    return name_routes(rows, locations, "left", "origin_name", "destination_name").select(
        "dispatch_entry_no", "trip_duration_minutes", "eta_delay_minutes", "avg_speed_kmph", "trip_km", "trip_start", "driver_id", "vehicle_id",
        "origin_name", "destination_name", "driver_name", "route_avg_duration", "route_avg_distance", "route_eta_success")


def anomaly_features(rows: DataFrame) -> DataFrame:
    hour = F.hour("trip_start")
    minutes, delay = F.col("trip_duration_minutes").cast("double"), F.coalesce(F.col("eta_delay_minutes").cast("double"), F.lit(0.0))
    mean = F.when(F.col("route_avg_duration") != 0, F.col("route_avg_duration"))
    return rows.withColumns({
        "duration_ratio": F.coalesce(minutes / mean, F.lit(1.0)),
        "delay_ratio": delay / F.coalesce(mean, F.lit(1.0)),
        "hour_deviation": T.hour_deviation(hour).cast("double"),
        "is_night_trip": T.night_flag(hour).cast("double"),
        "trip_duration_minutes": minutes,
        "eta_delay_minutes": delay,
    })


def unscanned_trips(rows: DataFrame, alerts: DataFrame, now, days: int = 7) -> DataFrame:
    """Trips of the last days before 'now' without an anomaly alert."""
    known = alerts.filter((F.col("alert_type") == "anomaly") & F.col("trip_no").isNotNull()).select(F.col("trip_no").alias("dispatch_entry_no"))
    return rows.filter(F.col("trip_start") >= now - F.make_dt_interval(days=F.lit(days))).join(known, "dispatch_entry_no", "left_anti")


# ------------------------------------------------------------- isolation forest
def _mean_path(n):
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth value); feature -1 marks a leaf."""
    rng = np.random.default_rng(seed)
    nodes: list = []

    def grow(rows, depth):
        at = len(nodes)
        nodes.append(None)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= DEPTH or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (-1, 0.0, at, at, depth + _mean_path(len(rows)))
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        left = rows[:, f] <= cut
        lo, hi = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
        nodes[at] = (f, cut, lo, hi, 0.0)
        return at

    grow(x, 0)
    return nodes


def feature_scale(features: DataFrame) -> list[tuple[float, float]]:
    """Mean and population deviation of each feature (1 where nothing varies)."""
    row = features.agg(*[x for c in ANOMALY_FEATURES for x in (F.avg(c), F.stddev_pop(c))]).first()
    return [(row[2 * k] or 0.0, row[2 * k + 1] or 1.0) for k in range(len(ANOMALY_FEATURES))]


def standardised(features: DataFrame, scale: list[tuple[float, float]]) -> DataFrame:
    """z_ columns by the given means and deviations."""
    return features.withColumns({f"z_{c}": (F.col(c) - m) / s for c, (m, s) in zip(ANOMALY_FEATURES, scale, strict=True)})


def tree_samples(scaled: DataFrame, key: str = "dispatch_entry_no", seed: int = 42) -> DataFrame:
    """About SAMPLE rows for each of TREES trees, drawn by hash in one pass.

    A row may be drawn several times when the table is smaller than all
    samples together. Never more than SAMPLE rows reach one tree.
    """
    from .paging import top_per

    target = TREES * SAMPLE * 1.3
    n = scaled.agg(F.count(F.lit(1)).alias("n")).scalar().cast("double")
    copies = F.least(F.greatest(F.lit(1.0), F.ceil(F.lit(target) / F.greatest(n, F.lit(1.0)))), F.lit(float(TREES))).cast("int")
    drawn = scaled.withColumns({"_copy": F.explode(F.sequence(F.lit(1), copies)), "_keep": F.lit(target) / (n * copies)})
    h = F.xxhash64(F.col(key), F.col("_copy"), F.lit(seed))
    drawn = drawn.withColumns({"_u": F.pmod(h, F.lit(1000003)) / F.lit(1000003.0), "_tree": F.pmod(F.shiftright(h, 21), F.lit(TREES)).cast("int")})
    drawn = drawn.filter(F.col("_u") < F.col("_keep"))
    return top_per(drawn, ["_tree"], [F.xxhash64(F.col(key), F.col("_copy"), F.col("_tree")), key, "_copy"], SAMPLE)


def grow_forest(scaled: DataFrame, key: str = "dispatch_entry_no") -> DataFrame:
    """Nodes of trees grown in parallel: at most TREES * 511 short rows."""
    cols = [f"z_{c}" for c in ANOMALY_FEATURES]

    def one_tree(pdf):
        tree = int(pdf["_tree"].iloc[0])
        nodes = grow_tree(pdf.sort_values([key, "_copy"])[cols].to_numpy(float), tree)
        return pd.DataFrame([(tree, i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "lo", "hi", "depth"])

    samples = tree_samples(scaled, key).select("_tree", key, "_copy", *cols)
    return samples.groupBy("_tree").applyInPandas(one_tree, NODES)


def packed_tree(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, depth value) of a tree laid out in full: the children of place i are 2i+1 and 2i+2.

    A leaf above the last level is repeated on both sides below it, with a threshold that sends every row on.
    """
    inner = 2**DEPTH - 1
    feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
    todo = [(0, 0)]
    while todo:
        place, node = todo.pop()
        f, c, lo, hi, depth = nodes[node]
        if place >= inner:
            value[place - inner] = depth
            continue
        if f >= 0:
            feature[place], cut[place] = int(f), c
        todo += [(2 * place + 1, int(lo)), (2 * place + 2, int(hi))]
    return feature, cut, value


SCORED_AT_ONCE = 4096  # rows whose places fit the processor's caches


def path_sums(x: np.ndarray, trees: list) -> np.ndarray:
    """Sum of the leaves' depth values over the trees, for each row; a missing value goes right, as a comparison with it fails."""
    total = np.zeros(len(x))
    for a in range(0, len(x), SCORED_AT_ONCE):
        part = np.ascontiguousarray(x[a : a + SCORED_AT_ONCE])
        row, values, out = np.arange(len(part)) * part.shape[1], part.ravel(), total[a : a + SCORED_AT_ONCE]
        for feature, cut, value in trees:
            at = np.zeros(len(part), np.int64)
            for _ in range(DEPTH):
                low = values.take(row + feature.take(at)) <= cut.take(at)
                at *= 2
                at += 2
                at -= low
            out += value.take(at - (2**DEPTH - 1))
    return total


def score_forest(scaled: DataFrame, forest: pd.DataFrame) -> DataFrame:
    """raw_score per row: near 1 for isolated points, below 0.5 for ordinary ones."""
    cols = [f"z_{c}" for c in ANOMALY_FEATURES]
    packed = [packed_tree(g[["feature", "cut", "lo", "hi", "depth"]].to_numpy()) for _, g in forest.groupby("tree")]
    box = scaled.sparkSession.sparkContext.broadcast(packed)
    norm = _mean_path(SAMPLE)

    def score(batches):
        for pdf in batches:
            total = path_sums(pdf[cols].to_numpy(float), box.value)
            yield pdf.drop(columns=cols).assign(raw_score=np.power(2.0, -(total / len(box.value)) / norm))

    out = scaled.drop(*cols).schema.add("raw_score", "double")
    return scaled.mapInPandas(score, out)


NODES = "tree int, node int, feature int, cut double, lo int, hi int, depth double"


class AnomalyForest(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Isolation forest over ANOMALY_FEATURES; the share `contamination` of the fitted rows lies above the threshold."""

    contamination = Param(Params._dummy(), "contamination", "share of the fitted rows that counts as unusual", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, contamination: float = CONTAMINATION):
        super().__init__()
        self._setDefault(contamination=CONTAMINATION)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "AnomalyForestModel":
        """The table is read for its scale, the trees' samples and the scores; it should be stored."""
        scale = feature_scale(dataset)
        forest = grow_forest(standardised(dataset, scale)).toPandas().sort_values(["tree", "node"])
        scores = stage(score_forest(standardised(dataset, scale), forest).select("raw_score"), "anomaly-scores")
        low, high = scores.agg(F.min("raw_score"), F.max("raw_score")).first()
        cut = exact_quantile(scores, "raw_score", 1 - self.getOrDefault(self.contamination))
        return AnomalyForestModel(scale, low, high, cut, forest)._resetUid(self.uid + "_model")


class AnomalyForestModel(Model, MLReadable, MLWritable):
    """Scale, trees, range of the fitted scores and threshold; all of bounded size."""

    def __init__(self, scale: list[tuple[float, float]], low: float, high: float, cut: float, forest: pd.DataFrame):
        super().__init__()
        self.scale, self.low, self.high, self.cut, self.forest = scale, low, high, cut, forest

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds raw_score, anomaly_score (by the fitted range, within 0 and 1) and is_anomaly; rows need not be those of the fit."""
        return flagged(score_forest(standardised(dataset, self.scale), self.forest), self.low, self.high, self.cut)

    def write(self) -> "AnomalyForestWriter":
        return AnomalyForestWriter(self)

    @classmethod
    def read(cls) -> "AnomalyForestReader":
        return AnomalyForestReader()


class AnomalyForestWriter(MLWriter):
    def __init__(self, model: AnomalyForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = SparkSession.active(), self.model
        DefaultParamsWriter.saveMetadata(m, path, spark)
        spark.createDataFrame(m.forest, NODES).coalesce(1).write.parquet(f"{path}/nodes")
        state = [(c, float(a), float(b), float(m.low), float(m.high), float(m.cut)) for c, (a, b) in zip(ANOMALY_FEATURES, m.scale, strict=True)]
        spark.createDataFrame(state, "feature string, mean double, deviation double, low double, high double, cut double").coalesce(1).write.parquet(f"{path}/state")


class AnomalyForestReader(MLReader):
    def load(self, path: str) -> AnomalyForestModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        state = {r["feature"]: r for r in spark.read.parquet(f"{path}/state").collect()}
        some = state[ANOMALY_FEATURES[0]]
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
        model = AnomalyForestModel([(state[c]["mean"], state[c]["deviation"]) for c in ANOMALY_FEATURES], some["low"], some["high"], some["cut"], nodes)
        return model._resetUid(metadata["uid"])


def flagged(scored: DataFrame, low: float, high: float, cut: float) -> DataFrame:
    """raw_score scaled to 0-1 by a range, cut at its ends, and rows above the threshold marked."""
    share = (F.col("raw_score") - F.lit(low)) / (F.lit(high) - F.lit(low) + 1e-8)
    return scored.withColumns({"anomaly_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), "is_anomaly": F.when(F.col("raw_score") > F.lit(cut), 1).otherwise(0)})


def anomaly_flags(scored: DataFrame) -> DataFrame:
    """The same by the scored table's own range and top share."""
    scored = stage(scored, "scored")
    low, high = scored.agg(F.min("raw_score"), F.max("raw_score")).first()
    return flagged(scored, low, high, exact_quantile(scored, "raw_score", 1 - CONTAMINATION))


def anomaly_contrib(flagged: DataFrame) -> DataFrame:
    """Per feature: distance of the anomalous mean from the normal one in normal deviations."""
    odd, aggs = F.col("is_anomaly") == 1, []
    for c in ANOMALY_FEATURES:
        sd = F.stddev_samp(F.when(~odd, F.col(c)))
        sd = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        aggs.append((F.abs(F.avg(F.when(odd, F.col(c))) - F.avg(F.when(~odd, F.col(c)))) / sd).alias(c))
    wide = flagged.agg(*aggs)
    pairs = ", ".join(f"'{c}', {c}" for c in ANOMALY_FEATURES)
    return wide.selectExpr(f"stack({len(ANOMALY_FEATURES)}, {pairs}) as (feature, z_score)").withColumn("z_score", F.round("z_score", 3))


def anomaly_alerts(flagged: DataFrame, limit: int = 100, with_route: bool = False) -> DataFrame:
    """The most anomalous trips as alerts (100 after training, 200 with route text in a scan)."""
    score, mean = F.col("anomaly_score"), F.coalesce("route_avg_duration", F.lit(0.0))
    rows = flagged.filter(F.col("is_anomaly") == 1).orderBy(F.desc("anomaly_score"), "dispatch_entry_no").limit(limit)
    shown = lambda x, digits: F.format_string(f"%.{digits}f", F.bround(x, digits))  # noqa: E731  halves go to the even digit
    minutes = shown(F.col("trip_duration_minutes"), 0)
    ratio, avg = shown(F.col("trip_duration_minutes") / F.nullif(mean, F.lit(0.0)), 1), shown(mean, 0)
    tail = F.concat(F.lit("Anomaly score: "), shown(score, 3))
    if with_route:
        head = F.concat(F.lit("Driver "), F.coalesce("driver_name", F.lit("Unknown")), F.lit(": trip "), F.col("origin_name"), F.lit(" -> "),
                        F.col("destination_name"), F.lit(" took "), minutes, F.lit(" min"))
        text = F.when(mean > 0, F.concat(head, F.lit(" ("), ratio, F.lit("x route avg of "), avg, F.lit(" min). "), tail)).otherwise(F.concat(head, F.lit(". "), tail))
    else:
        text = F.when(mean > 0, F.concat(F.lit("Trip duration ("), minutes, F.lit(" min) is "), ratio, F.lit("x the route average ("), avg, F.lit(" min). "), tail)).otherwise(tail)
    return rows.select(
        F.lit("anomaly").alias("alert_type"), F.when(score < 0.7, "low").when(score < 0.85, "medium").otherwise("high").alias("severity"), "driver_id",
        F.col("dispatch_entry_no").alias("trip_no"), "vehicle_id", F.lit("Anomalous Trip Detected").alias("title"), text.alias("message"),
        F.col("trip_start").alias("created_at"))
