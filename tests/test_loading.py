import datetime as dt

from pyspark.sql import functions as F

from hauldeck.operators import loading as L
from hauldeck.operators import partials as P
from hauldeck.operators import summaries as S
from hauldeck.sources.driver_tables import FIRST_ROW_ORDER

SCHEMA = "dispatch_entry_no string, origin string, destination string, trip_start timestamp, trip_end_raw timestamp, ata_in timestamp, trip_eta timestamp, trip_km double"
T0 = dt.datetime(2024, 1, 5, 5)


def trip(no, minutes=60, km=100.0, start=T0, ata=True, origin="A"):
    end = start + dt.timedelta(minutes=minutes)
    return (no, origin, "B", start, end, end if ata else None, start + dt.timedelta(minutes=90), km)


def test_rejects_and_caps(spark):
    rows = spark.createDataFrame([
        trip("ok"), trip("early", start=dt.datetime(2018, 12, 31)), trip("back", minutes=-5), trip("zero", minutes=0),
        trip("big", minutes=20000, km=6000.0), trip("nokm", km=None), trip("open", ata=False), trip("far", km=None, origin="Z")], SCHEMA)
    screened = {r["dispatch_entry_no"]: r for r in L.screened_trips(rows).collect()}
    assert screened["early"]["reject_reason"] == "trip_start before 2019"
    assert screened["back"]["reject_reason"] == "ata_in before trip_start" and screened["back"]["trip_duration_minutes"] is None
    assert screened["zero"]["reject_reason"] == "zero duration"
    assert screened["ok"]["reject_reason"] is None and screened["ok"]["is_5am_default"] == 1
    kept = {r["dispatch_entry_no"]: r for r in L.outlier_cap(L.screened_trips(rows).filter("reject_reason is null")).collect()}
    assert (float(kept["big"]["trip_km"]), float(kept["big"]["trip_duration_minutes"]), float(kept["big"]["avg_speed_kmph"])) == (5000.0, 14400.0, 20.83)
    mean = round((100 * 5 + 6000.0) / 6, 2)  # ok, early, back, zero, open, big count towards the route mean
    assert float(kept["nokm"]["trip_km"]) == mean and float(kept["nokm"]["avg_speed_kmph"]) == 120.0
    assert kept["far"]["trip_km"] is None and kept["far"]["avg_speed_kmph"] is None
    assert kept["open"]["eta_data_status"] == "eta_data_unavailable" and kept["open"]["trip_duration_minutes"] == 60


def test_first_row_wins(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), (None, 0, "x"), ("b", 5, "only")], "dispatch_entry_no string, o int, v string")
    assert sorted(r["v"] for r in L.trip_dedup(rows, ["o"]).collect()) == ["first", "only"]


def test_driver_key_with_missing_mobile(spark):
    raw = spark.createDataFrame([("Ann", None, "V1", "A", "B", "c"), ("Ann", "9", "V1", "A", "B", "c"), (None, "9", "V2", "A", "C", None)],
                                "driver_name string, driver_mobile string, asset_id string, origin string, destination string, cust_login_id string")
    d = L.dim_drivers(raw)
    assert d.count() == 2
    v = L.dense_ids(raw.select("asset_id").distinct(), F.col("asset_id"))
    loc = L.dim_locations(raw)
    c = L.dense_ids(raw.select("cust_login_id").distinct().dropna(), F.col("cust_login_id"))
    rows = L.fk_resolve(raw, d, v, loc, c).collect()
    assert len(rows) == 3 and sum(r["driver_id"] is None for r in rows) == 1 and sum(r["customer_id"] is None for r in rows) == 1
    assert len({r["driver_id"] for r in rows if r["driver_id"]}) == 2


def test_dense_ids_are_gap_free_and_repeatable(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    a = {r["k"]: r["id"] for r in L.dense_ids(df, F.col("k"), digits=2).collect()}
    b = {r["k"]: r["id"] for r in L.dense_ids(df.repartition(7), F.col("k"), digits=2).collect()}
    assert sorted(a.values()) == list(range(1, 5001)) and a == b


def test_counts_of_the_given_tables(fleet):
    assert fleet.raw.count() == 6000 and fleet.first.count() == 4599
    report = {r["reason"]: r["trips"] for r in L.reject_report(fleet.raw, fleet.first).collect()}
    assert sum(report.values()) == fleet.first.count() and report["no dispatch number"] == 0
    assert report["accepted"] == fleet.trips.count()
    assert S.reliable(fleet.trips).count() == 3799
    assert L.trip_dedup(fleet.raw, FIRST_ROW_ORDER).count() == 4599


def test_refresh_by_states_equals_full(fleet):
    """New, changed, moved and deleted trips change the states; the fact is not read again."""
    trips = fleet.trips
    old = trips.filter("driver_id <> 2 or driver_id is null")
    pick = F.pmod(F.xxhash64("dispatch_entry_no"), F.lit(10))
    moved = old.filter(pick == 1).withColumns({"driver_id": F.lit(6), "vehicle_id": F.lit(9), "trip_duration_minutes": F.col("trip_duration_minutes") + 7})
    now = old.filter(pick > 2).unionByName(moved).unionByName(trips.filter("driver_id = 2"))  # pick 0 and 2: deleted
    added, removed = moved.unionByName(trips.filter("driver_id = 2")), old.filter(pick <= 2)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for partial, by_state, full in (
            (P.DRIVER, lambda s: P.driver_summary(s, fleet.drivers), lambda t: S.driver_summary(t, fleet.drivers)), (P.ROUTE, lambda s: P.route_summary(s, fleet.locations), lambda t: S.route_summary(t, fleet.locations)),
            (P.VEHICLE, lambda s: P.vehicle_summary(s, fleet.vehicles), lambda t: S.vehicle_summary(t, fleet.vehicles)), (P.DAILY, P.daily_fleet_stats, S.daily_fleet_stats)):
        fresh = by_state(P.refreshed(P.state_of(old, partial), partial, added, removed))
        assert fresh.columns == full(now).columns and rows(fresh) == rows(full(now))
        assert P.merged(partial, P.state_of(now, partial), P.state_of(now, partial, -1)).count() == 0


def test_daily_trips_add_up(fleet):
    assert S.daily_fleet_stats(fleet.trips).agg(F.sum("total_trips")).first()[0] == S.reliable(fleet.trips, positive=False).count()


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, L.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_one_trip_is_found_by_bloom_filters(spark, fleet, tmp_path):
    """The stored fact has a Bloom filter per row group: a number that lies between the ends but is not there reads no row."""
    number = fleet.trips.agg(F.max("dispatch_entry_no")).first()[0]
    absent = number[:-1] + "0"  # line numbers start at 1, so it sorts before the last and after most
    assert fleet.trips.filter(F.col("dispatch_entry_no") == number).count() == 1
    df = fleet.trips.filter(F.col("dispatch_entry_no") == absent).select("dispatch_entry_no", "trip_km")
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan()
    leaf = (plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan).collectLeaves().head()
    assert leaf.metrics().get("numOutputRows").get().value() == 0


def test_first_trips_equal_dedup_of_raw_rows(spark, tmp_path):
    """Lines and orders that come twice, null keys and null line numbers; repeated lines are found before rows are widened, and rows move once."""
    from hauldeck.sources import driver_tables as D

    day = dt.datetime(1995, 1, 1)
    lines = [(1, 5, 1, 1, 2.0, 30.0, day), (1, 4, 1, 1, 2.0, 30.0, day), (1, 4, 1, 1, 2.0, 30.0, day), (1, 9, 2, 2, 1.0, 3.0, day), (2, 3, 2, 1, 1.0, 3.0, day), (2, 1, 7, 1, 1.0, 3.0, day),
             (2, 1, None, 1, 1.0, 3.0, day), (2, None, 1, 2, 1.0, 3.0, None), (2, 2, 1, 2, None, 3.0, day), (3, 1, 1, None, 1.0, 3.0, day), (None, 1, 1, 1, 1.0, 3.0, day), (11, 1, 1, 1, 1.0, 3.0, day), (1, 1, 1, 11, 1.0, 3.0, day)]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
        "orders": ([(1, 1, "F", day), (1, 1, "F", day), (2, 2, "O", day), (3, 1, "F", day), (11, 1, "P", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "customer": ([(1, "c1", 0), (2, "c2", 1), (2, "c2", 1)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(1, "s1", 0), (2, "s2", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    raw, first = D.raw_trips(spark, str(tmp_path)), D.first_trips(spark, str(tmp_path))
    assert raw.count() > first.count() == 6 and raw.columns == first.columns
    assert sorted(map(str, first.collect())) == sorted(map(str, L.trip_dedup(raw, D.FIRST_ROW_ORDER).collect()))
    assert "hashpartitioning(dispatch_entry_no" not in first._jdf.queryExecution().executedPlan().toString()


def test_route_means_do_not_move_the_trips(fleet):
    plan = L.screened_trips(fleet.first)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_vehicles_of_a_driver_are_counted_apart(spark):
    from decimal import Decimal

    from hauldeck.operators import summaries as S

    rows = [(1, v, "available", 1, Decimal(10 + k), Decimal(40), Decimal(5), Decimal(1)) for k, v in enumerate([7, 7, 8, None])] + [(2, None, "available", 0, Decimal(3), None, None, None)]
    trips = spark.createDataFrame(rows, "driver_id long, vehicle_id long, eta_data_status string, eta_met int, trip_duration_minutes decimal(12,2), avg_speed_kmph decimal(12,2), trip_km decimal(12,2), eta_delay_minutes decimal(12,2)")
    found = S.driver_figures(trips)
    assert {r.driver_id: (r.total_trips, r.vehicles_used, r.max_duration_min, r.avg_distance_km) for r in found.collect()} == {1: (4, 2, 13.0, 5.0), 2: (1, 0, 3.0, None)}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString() and "count(distinct" not in found._jdf.queryExecution().executedPlan().toString()
