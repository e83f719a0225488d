"""Tree and linear models on the feature tables, trained and applied by Spark ML."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import rnd
from .metrics import classification_metrics, regression_metrics

SEED = 42


def hash_share(key: str, seed: int = SEED):
    """A repeatable number in [0, 1) per key: the first 32 bits of an md5, which other engines compute alike."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def split_80_20(rows: DataFrame, key: str = "dispatch_entry_no", test: float = 0.2) -> DataFrame:
    """Adds is_test. The hash is independent of any class, so every class is split in the same proportion."""
    return rows.withColumn("is_test", F.when(hash_share(key) < test, 1).otherwise(0))


def train_test(rows: DataFrame, key: str = "dispatch_entry_no") -> tuple[DataFrame, DataFrame]:
    marked = split_80_20(rows, key)
    return marked.filter("is_test = 0").drop("is_test"), marked.filter("is_test = 1").drop("is_test")


VALIDATION = "is_validation"
STILL_FALLING = 0.0001  # share of the validation error that a further tree must take off
TREES_AT_ONCE = 50  # trees of a forest that are grown together


def _pipeline(estimator, features: list[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), estimator])


def with_validation(rows: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Marks the rows on which boosting watches its error."""
    return rows.withColumn(VALIDATION, hash_share(key, SEED + 1) < share)


def boosted_regressor(trees: int = 300, depth: int = 8, rate: float = 0.05, label: str = "target"):
    """Up to `trees` trees; boosting ends when a tree takes less than STILL_FALLING off the error on the validation rows."""
    return GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, minInstancesPerNode=10, validationIndicatorCol=VALIDATION, validationTol=STILL_FALLING, seed=SEED)


class GroupedForest(RandomForestRegressor):
    """A forest grown TREES_AT_ONCE trees at a time and joined to one Spark ML model.

    Spark keeps a count and a node per row and tree while it trains; so the rows in memory do not grow with the forest.
    """

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        whole, grown = self.getNumTrees(), []
        for k, done in enumerate(range(0, whole, TREES_AT_ONCE)):
            group = self.copy({self.numTrees: min(TREES_AT_ONCE, whole - done), self.seed: self.getSeed() + 1_000_003 * k})
            grown.append(RandomForestRegressor._fit(group, dataset))
        sc, trees = dataset.sparkSession.sparkContext, [t for g in grown for t in g._java_obj.trees()]
        packed = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
        for i, t in enumerate(trees):
            packed[i] = t
        joined = sc._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(grown[0].uid, packed, grown[0].numFeatures)
        return self._copyValues(self._create_model(joined))


def forest_regressor(trees: int = 300, depth: int = 8, label: str = "target"):
    return GroupedForest(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=10, subsamplingRate=0.8, maxMemoryInMB=512, cacheNodeIds=True, seed=SEED)


def trained_regressor(train: DataFrame, test: DataFrame, features: list[str], estimator, key: str = "dispatch_entry_no") -> tuple[PipelineModel, DataFrame]:
    """A fitted model and its metrics on the test rows; both tables should be stored.

    Rows are sampled by their place, so they are ordered by key where they lie: the model does not hang on the order in which they were written.
    """
    model = _pipeline(estimator, features).fit(with_validation(train, key).sortWithinPartitions(key))
    return model, regression_metrics(model.transform(test)).withColumns({"n_train": F.lit(train.count()), "n_trees": F.lit(model.stages[-1].getNumTrees)})


def compared(metrics: dict[str, DataFrame]) -> DataFrame:
    """The candidates' metrics, the one of the smallest mean error marked."""
    out = None
    for name, table in metrics.items():
        row = table.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.min(F.struct("mae", "model")).alias("b")).scalar()
    return out.withColumn("is_best", F.when(F.col("model") == best["model"], 1).otherwise(0))


def cross_validate(train: DataFrame, features: list[str], estimator, folds: int = 5, key: str = "dispatch_entry_no") -> float:
    """Mean error over folds of the estimator as it is reported."""
    cv = CrossValidator(estimator=_pipeline(estimator, features), estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, seed=SEED, parallelism=folds,
                        evaluator=RegressionEvaluator(labelCol="target", metricName="mae"))
    return float(cv.fit(with_validation(train, key)).avgMetrics[0])


def feature_importance(spark, model, features: list[str]) -> DataFrame:
    """Named importances, largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def eta_predict(model, requests: DataFrame, starts: DataFrame, least: float = 0.0, key: str = "dispatch_entry_no") -> DataFrame:
    """Predicted minutes, arrival time and confidence by how often the route was driven."""
    minutes = F.greatest(F.col("prediction"), F.lit(float(least)))
    n = F.col("route_trip_count")
    rows = model.transform(requests).select(
        key, minutes.alias("predicted_duration_minutes"), F.when(n >= 50, "high").when(n >= 10, "medium").otherwise("low").alias("confidence"))
    return rows.join(starts.select(key, "trip_start"), key).withColumns({
        "predicted_arrival": T.arrival_time(F.col("trip_start"), F.col("predicted_duration_minutes")),
        "predicted_duration_minutes": rnd("predicted_duration_minutes")})


def classifier(train: DataFrame, features: list[str], trees: int = 300, depth: int = 8, rate: float = 0.05, key: str = "dispatch_entry_no") -> PipelineModel:
    boosting = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, minInstancesPerNode=5, validationIndicatorCol=VALIDATION, validationTol=STILL_FALLING, seed=SEED)
    return _pipeline(boosting, features).fit(with_validation(train, key))


def with_probability(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def trained_classifier(train: DataFrame, test: DataFrame, features: list[str], key: str = "dispatch_entry_no", **size) -> tuple[PipelineModel, DataFrame]:
    """A fitted classifier and its metrics on the test rows; both tables should be stored."""
    model = classifier(train, features, key=key, **size)
    return model, classification_metrics(with_probability(model, test)).withColumns({"n_train": F.lit(train.count()), "n_trees": F.lit(model.stages[-1].getNumTrees)})


def fatigue_rows(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.select("driver_id", F.col("is_fatigued").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns])


def enough_of_both(rows: DataFrame, least: int = 5) -> bool:
    """Whether both classes have so many rows; else no model is fitted and the score decides."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    return min(counts.get(0, 0), counts.get(1, 0)) >= least


# Inputs of the time-of-day estimate.
TIME_FEATURES = ["hour", "day_of_week", "is_weekend", "month", "route_avg_duration", "route_trip_count", "driver_avg_speed", "driver_eta_success", "vehicle_avg_speed"]


def time_aware_regressor():
    return boosted_regressor(trees=200, depth=6, rate=0.1)


def time_aware_estimates(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("dispatch_entry_no", rnd(F.greatest(F.col("prediction"), F.lit(0.0))).alias("time_aware_estimate_min"))
