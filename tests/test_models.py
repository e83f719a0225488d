import heapq
import itertools

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hauldeck.operators import anomaly as A
from hauldeck.operators import features as X
from hauldeck.operators import forecast as D
from hauldeck.operators import graph as N
from hauldeck.operators import models as M
from hauldeck.operators import recommend as R
from hauldeck.operators.metrics import classification_metrics, regression_metrics


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(a), float(b), float(3 * a - b + rng.normal())) for k in (1, 2) for a, b in rng.normal(size=(40, 2)) * (1 + k)]
    df = spark.createDataFrame(rows, "k int, a double, b double, y double")
    for r in D.ridge_per_group(df, ["k"], ["a", "b"], "y").collect():
        x = np.array([[a, b] for k, a, b, _ in rows if k == r["k"]])
        y = np.array([v for k, _, _, v in rows if k == r["k"]])
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
        assert r["coef"] == pytest.approx(beta, abs=1e-9) and r["intercept"] == pytest.approx(y.mean() - x.mean(0) @ beta, abs=1e-9)


def test_forecasts_are_seven_days_and_not_negative(fleet):
    rows = D.demand_forecast(D.demand_daily(fleet.trips)).collect()
    assert rows and all(r["predicted_trips"] >= 0 for r in rows) and len(rows) % 7 == 0


def test_planted_outliers_score_highest(spark, tmp_path):
    n = 2000
    base = spark.range(n).withColumns({
        "dispatch_entry_no": F.concat(F.lit("d"), F.col("id").cast("string")), "planted": F.when(F.col("id") % 100 == 0, 1).otherwise(0)})
    odd, u = F.col("planted") == 1, F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    cols = {c: F.when(odd, 50 + u * 20).otherwise(u + F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)) / 100.0) for c in A.ANOMALY_FEATURES}
    table = base.withColumns(cols).cache()
    model = A.AnomalyForest().fit(table)
    flagged = model.transform(table).cache()
    assert flagged.filter("planted = 1 and is_anomaly = 0").count() == 0
    assert 0 < flagged.filter("is_anomaly = 1").count() <= n * A.CONTAMINATION + 1
    again = {r["dispatch_entry_no"]: r["raw_score"] for r in A.AnomalyForest().fit(table.repartition(5)).transform(table).collect()}
    assert all(abs(again[r["dispatch_entry_no"]] - r["raw_score"]) < 1e-6 for r in flagged.collect())
    # the saved model scores rows it has not seen, by the fitted scale, range and threshold
    path = str(tmp_path / "forest")
    model.write().save(path)
    loaded = A.AnomalyForestModel.load(path)
    assert loaded.uid == model.uid and (loaded.low, loaded.high, loaded.cut) == (model.low, model.high, model.cut)
    assert {r["dispatch_entry_no"]: r["is_anomaly"] for r in loaded.transform(table).collect()} == {r["dispatch_entry_no"]: r["is_anomaly"] for r in flagged.collect()}
    far = table.filter("planted = 0").limit(3).withColumns({c: F.lit(x) for c, x in zip(A.ANOMALY_FEATURES, (900.0, 900.0, 900.0, 900.0, 900.0, 900.0), strict=True)})
    for r in loaded.transform(far).collect():
        assert r["is_anomaly"] == 1 and 0.9 < r["anomaly_score"] <= 1
    assert {r["anomaly_score"] for r in A.flagged(flagged.withColumn("raw_score", F.lit(2.0)), 0.3, 0.9, 0.8).collect()} == {1.0}
    assert loaded.transform(table.limit(0)).count() == 0


def test_scores_walk_every_tree_to_its_leaf():
    """Rows beyond one block, ties with thresholds, missing and infinite values, a tree of one leaf: the same sums as a walk from node to node."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(A.SCORED_AT_ONCE + 500, len(A.ANOMALY_FEATURES))), 1)
    trees = [np.array(A.grow_tree(x[rng.choice(len(x), n)], k)) for k, n in enumerate([256, 256, 40, 1, 2])]
    trees[0][trees[0][:, 0] >= 0, 1] = np.round(trees[0][trees[0][:, 0] >= 0, 1], 1)
    x[::97, 2], x[::89, 1], x[::83, 0] = np.nan, np.inf, -np.inf
    want = np.zeros(len(x))
    for t in trees:
        for i, r in enumerate(x):
            at = 0
            while t[at, 0] >= 0:
                at = int(t[at, 2] if r[int(t[at, 0])] <= t[at, 1] else t[at, 3])
            want[i] += t[at, 4]
    assert np.array_equal(A.path_sums(x, [A.packed_tree(t) for t in trees]), want)


def test_arrival_model_beats_the_mean(fleet):
    train, test = M.train_test(X.eta_features(fleet.trips, fleet))
    model, table = M.trained_regressor(train, test, X.ETA_FEATURES, M.boosted_regressor(trees=60, depth=4, rate=0.1))
    assert 1 < table.first()["n_trees"] < 60 and table.first()["n_train"] == train.count()  # the validation rows ended it
    mean = train.agg(F.avg("target")).first()[0]
    naive = regression_metrics(test.withColumn("prediction", F.lit(mean))).first()["mae"]
    assert table.first()["mae"] < naive
    top = M.feature_importance(fleet.spark, model, X.ETA_FEATURES).collect()
    assert len(top) == 22 and top[0]["importance"] >= top[-1]["importance"]


def test_forest_grown_in_groups_is_one_forest(spark, monkeypatch, tmp_path):
    """Ten trees, at most four at a time: all there, of their own samples, averaged, saved and loaded as one model."""
    monkeypatch.setattr(M, "TREES_AT_ONCE", 4)
    rows = spark.range(400).selectExpr("id as dispatch_entry_no", "cast(id % 20 as double) as a", "cast(id % 7 as double) as b", "cast(id % 20 as double) * 3 + id % 7 as target")
    model, table = M.trained_regressor(rows, rows, ["a", "b"], M.forest_regressor(trees=10, depth=4))
    model.write().save(str(tmp_path / "forest"))
    forest = PipelineModel.load(str(tmp_path / "forest")).stages[-1]
    point = Vectors.dense([7.0, 3.0])
    assert table.first()["n_trees"] == forest.getNumTrees == 10 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 10
    assert abs(forest.predict(point) - np.mean([t.predict(point) for t in forest.trees])) < 1e-9
    assert table.first()["mae"] < 8 and abs(forest.featureImportances.toArray().sum() - 1) < 1e-9


def test_split_is_stratified(fleet):
    rows = M.split_80_20(X.sla_features(X.sla_input(fleet.trips, fleet), X.driver_route_history(fleet.trips)))
    shares = [r["s"] for r in rows.groupBy("label").agg(F.avg("is_test").alias("s")).collect()]
    assert all(0.15 < s < 0.25 for s in shares)


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 1), (0.2, 1)]
    got = classification_metrics(spark.createDataFrame(rows, "probability double, label int")).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    assert got["auc_roc"] == round(float(want), 4) and got["on_time"] == 4


def brute_paths(edges, start, end, k=3, most=5):
    if start == end:
        return [(0.0, (start,))]
    nodes = {a for e in edges for a in e}
    out = []
    for n in range(most):
        for mid in itertools.permutations(nodes - {start, end}, n):
            path = (start, *mid, end)
            legs = list(zip(path, path[1:]))
            if all(leg in edges for leg in legs):
                out.append((round(sum(edges[leg] for leg in legs), 2), path))
    return sorted(out)[:k]


def test_k_best_routes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    names = list("ABCDEFG")
    edges = {(a, b): round(float(rng.uniform(1, 100)), 2) for a in names for b in names if a != b and rng.random() < 0.6}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()] + [("A", "A", 0.5)], "origin string, destination string, avg_duration double")
    pairs = [(a, b) for a in names[:3] for b in names]
    got = {}
    for r in N.k_best_routes(df, spark.createDataFrame(pairs, "start string, end string")).orderBy("start", "end", "rank").collect():
        got.setdefault((r["start"], r["end"]), []).append((r["total_duration_min"], tuple(r["path"])))
        assert len(set(r["path"])) == len(r["path"]) and r["stops"] <= 5
    for a, b in pairs:
        assert got.get((a, b), []) == brute_paths(edges, a, b)


def cheapest(edges, start, end, k=3, most=5):
    """The k cheapest simple paths, in order of cost, from a queue."""
    queue, out = [(0.0, (start,))], []
    while queue and (len(out) < k or queue[0][0] <= out[-1][0]):
        cost, path = heapq.heappop(queue)
        if path[-1] == end:
            out.append((round(cost, 2), path))
        elif len(path) <= most:
            for b, w in edges.get(path[-1], {}).items():
                if b not in path:
                    heapq.heappush(queue, (cost + w, (*path, b)))
    return sorted(out)[:k]


def test_routes_through_a_hub(spark):
    """Every place is linked with one hub, few with each other: paths through it are pruned from the first edge on."""
    rng = np.random.default_rng(8)
    edges: dict = {"H": {}}
    for i in range(120):
        edges[f"p{i}"] = {"H": float(rng.integers(10, 99))}
        edges["H"][f"p{i}"] = float(rng.integers(10, 99))
        for j in rng.choice(120, 3, replace=False):
            if i != j:
                edges[f"p{i}"][f"p{j}"] = float(rng.integers(5, 60))
    df = spark.createDataFrame([(a, b, w) for a, out in edges.items() for b, w in out.items()], "origin string, destination string, avg_duration double")
    pairs = [(f"p{i}", f"p{(7 * i + 3) % 120}") for i in range(40)] + [("H", "p5"), ("p5", "H"), ("p1", "nowhere")]
    got = {}
    for r in N.k_best_routes(df, spark.createDataFrame(pairs, "start string, end string")).orderBy("start", "end", "rank").collect():
        got.setdefault((r["start"], r["end"]), []).append((r["total_duration_min"], tuple(r["path"])))
    for a, b in pairs:
        assert got.get((a, b), []) == cheapest(edges, a, b)


@pytest.mark.parametrize("paired", [R.PAIRED, 3])
def test_similar_drivers_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(R, "PAIRED", paired)
    rng = np.random.default_rng(9)
    perf = [(int(d), int(o), int(t), int(rng.integers(2, 40)), float(rng.uniform(100, 900)), round(float(rng.uniform(10, 80)), 2), 100.0, round(float(rng.uniform(0, 100)), 2), 5.0, 10.0)
            for d in range(1, 60) for o in range(4) for t in range(4) if rng.random() < (0.5 if d % 9 == 0 else 0.12)]
    p = spark.createDataFrame(perf, "driver_id long, origin_id long, destination_id long, route_trips long, avg_duration_min double, avg_speed_kmph double, avg_distance_km double, eta_success_rate double, avg_delay_min double, duration_stddev double")
    total = {}
    for r in perf:
        total[r[0]] = total.get(r[0], 0) + r[3]
    overall = spark.createDataFrame([(d, f"n{d}", n) for d, n in total.items()], "driver_id long, driver_name string, total_trips long")
    requests = spark.createDataFrame([(o, t) for o in range(4) for t in range(4)], "origin_id long, destination_id long")
    got = {}
    for r in R.recommend_similar(p, overall, requests, 50.0, 5).collect():
        got.setdefault((r["origin_id"], r["destination_id"]), []).append((-r["composite_score"], r["driver_id"]))

    def score(records, n_all):
        n, rate, v = sum(x[3] for x in records), np.mean([x[7] for x in records]), np.mean([x[5] for x in records])
        speed = 100 if 35 <= v <= 55 else max(0, 100 - abs(v - 45) * 3) if v > 0 else 0
        return min(80, np.log1p(n) / np.log1p(30) * 80) * 0.2 + min(100, (n * rate + 750) / (n + 15)) * 0.3 + speed * 0.15 + 5 + min(100, np.log1p(n_all) / np.log1p(200) * 100) * 0.25

    for o in range(4):
        for t in range(4):
            exact = {x[0] for x in perf if x[1] == o and x[2] == t}
            best = []
            for d, n in total.items():
                mine = [x for x in perf if x[0] == d and ((x[1] == o) != (x[2] == t))]
                if mine and d not in exact:
                    best.append((-round(score(mine, n), 2), d))
            want = sorted(best)[:5]
            have = sorted(got.get((o, t), []))
            assert [d for _, d in have] == [d for _, d in want] and [a for a, _ in have] == pytest.approx([a for a, _ in want], abs=0.011)
