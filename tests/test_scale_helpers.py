"""The skew-safe helpers against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hauldeck.operators import sequences as S
from hauldeck.operators.paging import paginate, spread_rank, top_per
from hauldeck.operators.quantiles import exact_quantile, exact_quantiles


@pytest.mark.parametrize("p", [0.0, 0.01, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("kind", ["spread", "ties", "one", "two"])
def test_exact_quantile(spark, p, kind):
    rng = np.random.default_rng(3)
    data = {"spread": rng.lognormal(3, 2, 5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([7.0]), "two": np.array([1.0, 2.0])}[kind]
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "x double")
    assert exact_quantile(df, "x", p) == pytest.approx(float(np.quantile(data, p)), rel=1e-12)


def test_quantiles_of_many_values_and_columns(spark):
    """Over 100,000 distinct values, heavy ties, nulls, no numbers, an empty column: several columns and ranks in one call."""
    n = 150_000
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double")
    df = spark.range(n).select(
        F.when(F.col("id") % 50 != 0, F.exp(h / (1 << 36))).alias("wide"), F.when(F.col("id") % 3 == 0, h).otherwise(F.lit(5.5)).alias("ties"),
        F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(-h).alias("gaps"), F.lit(None).cast("double").alias("none")).repartition(5)
    wanted = {f"{c}{p}": (c, p) for c in ("wide", "ties", "gaps", "none") for p in (0.0, 0.013, 0.5, 0.6667, 0.95, 1.0)}
    got, data = exact_quantiles(df, wanted), df.toPandas()
    for name, (c, p) in wanted.items():
        assert got[name] == (None if c == "none" else pytest.approx(float(np.nanquantile(data[c], p)), rel=1e-12)), name


def test_selection_takes_several_rounds(spark, monkeypatch):
    """A coarse sketch leaves many rows between the ends; the answer stays exact."""
    from hauldeck.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    monkeypatch.setattr(quantiles, "MARGIN", 0.1)
    df = spark.range(40_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x")).repartition(3)
    data = df.toPandas()["x"]
    for p in (0.1, 0.5, 0.99):
        assert exact_quantile(df, "x", p) == pytest.approx(float(np.quantile(data, p)), rel=1e-12)


def hot(spark, n=600):
    """Key 1 holds most rows; several rows share a time."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 5 + 2).alias("k"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("tie"),
        F.timestamp_seconds(F.lit(1700000000) + F.floor(F.col("id") * 7919 % 500) * 3600).alias("t"), F.col("id").cast("double").alias("v"))


def test_numbered_and_lookback_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 17)
    rows = S.numbered(hot(spark), "k", "t", "tie")
    got = {r["tie"]: (r["n"], [p["v"] for p in r["past"]]) for r in S.lookback(rows, "k", ["v"], 10).collect()}
    by_key = {}
    for r in hot(spark).collect():
        by_key.setdefault(r["k"], []).append((r["t"], r["tie"], r["v"]))
    assert len(got) == 600
    for items in by_key.values():
        items.sort()
        for n, (_, tie, _v) in enumerate(items):
            assert got[tie] == (n + 1, [x[2] for x in items[max(0, n - 10):n]])


def test_spread_rank_equals_row_number(spark):
    from pyspark.sql import Window

    df = hot(spark).withColumn("b", F.col("v") % 13)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("b"), "tie")))
    got = spread_rank(df, ["k"], F.col("b"), ["tie"], "r", descending=True)
    assert {(r["tie"], r["r"]) for r in got.collect()} == {(r["tie"], r["r"]) for r in want.collect()}


def test_rank_limit_runs_before_the_shuffle(spark):
    plan = top_per(hot(spark), ["k"], ["tie"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_pages_cover_everything_once(spark):
    seen = [r["id"] for page in (1, 2, 3) for r in paginate(spark.range(25), ["id"], page, 10).collect()]
    assert seen == list(range(25))
    assert paginate(spark.range(25), ["id"], 1, 10).first()["total_pages"] == 3


@pytest.mark.parametrize("share", [0.8, 0.5, 0.33])
def test_sequential_split(spark, share):
    rows = hot(spark).withColumnsRenamed({"k": "driver_id", "t": "trip_start", "tie": "dispatch_entry_no"})
    order = sorted((r["driver_id"], r["trip_start"], r["dispatch_entry_no"]) for r in rows.collect())
    want = {x[2] for x in order[: int(600 * share)]}
    got = {r["dispatch_entry_no"] for r in S.sequential_split(rows, share).filter("is_train = 1").collect()}
    assert got == want


def test_waypoints_of_trips_of_any_length(spark):
    """Trips of a minute, of months and of a thousand years (a wrong year) against a plain scan; pieces stay few."""
    import datetime as dt

    from hauldeck.operators import reads as R

    rng = np.random.default_rng(6)
    day0 = dt.datetime(2019, 12, 30)
    at = lambda minutes: day0 + dt.timedelta(minutes=int(minutes))
    trips = [(f"t{i}", int(rng.integers(4)), at(a), at(a + rng.choice([0, 1, 700, 1440, 9000, 90_000, 1_300_000]))) for i, a in enumerate(rng.integers(0, 2_000_000, 120))]
    trips += [("wrong", 1, at(5), dt.datetime(2990, 1, 1)), ("early", 2, dt.datetime(1901, 3, 4), at(900_000)), ("back", 1, at(100), at(50)), ("open", 1, at(100), None), ("none", None, at(1), at(9))]
    points = [(int(rng.integers(5)), at(m), float(m % 90), "Moving", 1.0) for m in rng.integers(-3000, 3_400_000, 3000)]
    t = spark.createDataFrame(trips, "dispatch_entry_no string, vehicle_id int, trip_start timestamp, trip_end timestamp")
    w = spark.createDataFrame(points, "vehicle_id int, recorded_at timestamp, speed_kmph double, status string, distance_from_prev double")
    got = sorted((r["dispatch_entry_no"], r["recorded_at"], r["speed_kmph"]) for r in R.trip_waypoints(t, w).collect())
    want = sorted((n, p, s) for n, v, a, b in trips if v is not None and b for u, p, s, *_ in points if u == v and a <= p <= b)
    assert got == want and any(n == "wrong" for n, *_ in got)
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    pieces = t.filter("trip_end >= trip_start").select("dispatch_entry_no", F.size(R.day_pieces(day("trip_start"), day("trip_end"))).alias("n"))
    assert {r["dispatch_entry_no"]: r["n"] for r in pieces.collect()}["wrong"] <= 2 * 31 * 3 + 12


@pytest.mark.parametrize("share", [0.8, 0.5, 0.0, 1.0])
def test_sequential_split_numbers_one_driver_only(spark, share, monkeypatch):
    """A driver with most trips, ties in time, nulls: the first share in (driver, time) order; others than the cut's driver are not moved."""
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(d, f"d{d}-{i}", t0 + dt.timedelta(hours=7 * (i // 2))) for d, n in ((1, 5), (3, 60), (4, 20), (9, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "driver_id long, dispatch_entry_no string, trip_start timestamp").repartition(3)
    seen = []
    numbered = S.numbered
    monkeypatch.setattr(S, "numbered", lambda rows, *a: (seen.append(rows.select("driver_id").distinct().count()), numbered(rows, *a))[1])
    got = {r.dispatch_entry_no: r.is_train for r in S.sequential_split(df, share).collect()}
    placed = sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    cut = int(len(rows) * share)
    assert got == {r[1]: int(k < cut) for k, r in enumerate(placed)} and seen == [1]
