from pyspark.sql import functions as F

from hauldeck.operators import partials as P
from hauldeck.operators import questions as K
from hauldeck.operators import registry as G
from hauldeck.operators import summaries as S
from hauldeck.streaming import refresh


def test_entities(spark):
    texts = ["Where is MH12AB1234 from Pune to Nagpur on 2024-01-05?", "Mumbai to Goa route for driver 42", "trip 7 last 3 days", "subdriver 5 nothing", "Pune se Goa kal"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, query string")
    e = K.question_entities(df).orderBy("id").collect()
    assert (e[0]["vehicle_id"], e[0]["origin"], e[0]["destination"], e[0]["date_expr"]) == ("MH12AB1234", "Pune", "Nagpur", "2024-01-05")
    assert (e[1]["origin"], e[1]["destination"], e[1]["driver_id"]) == ("Mumbai", "Goa", 42)
    assert (e[2]["trip_id"], e[2]["date_expr"]) == (7, "last 3 days")
    assert e[3]["driver_id"] is None and e[4]["date_expr"] == "kal"
    f = K.question_features(df).orderBy("id").collect()
    assert [int(r["has_route_pair"]) for r in f] == [1, 1, 0, 0, 1] and [int(r["has_driver_id"]) for r in f] == [0, 1, 0, 0, 0]


def test_augment_fills_classes_without_repeats(spark):
    rows = [(f"a{i}", f"where is the truck number {i} right now", "x") for i in range(40)] + [(f"b{i}", f"please show me all late trips of week {i}", "y") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, query string, agent string")
    new = K.question_augment(df, "id", target=70).collect()
    counts = {a: sum(r["agent"] == a for r in new) for a in ("x", "y")}
    assert counts == {"x": 30, "y": 10}
    texts = [r["query"].lower().strip() for r in new]
    assert len(set(texts)) == len(texts) and not set(texts) & {q.lower() for _, q, _ in rows}
    assert sorted(map(tuple, new)) == sorted(map(tuple, K.question_augment(df.repartition(5), "id", target=70).collect()))


def test_clean(spark):
    df = spark.createDataFrame([(1, ' "hello there" ', "a"), (2, "hello there", "b"), (3, "ok", "a"), (4, None, "a"), (5, "query text", "agent")], "id int, query string, agent string")
    assert [(r["id"], r["query"]) for r in K.question_clean(df, ["id"]).collect()] == [(1, "hello there")]


def test_routing(spark):
    rows = [("q1", "a", 0.9), ("q1", "b", 0.1), ("q2", "a", 0.5), ("q2", "b", 0.45), ("q3", "a", 0.6), ("q3", "b", 0.4), ("q4", "a", 0.4), ("q4", "b", 0.2), ("q4", "c", 0.2)]
    got = {r["q"]: r["action"] for r in K.routing_action(spark.createDataFrame(rows, "q string, agent string, score double"), "q").collect()}
    assert got == {"q1": "route", "q2": "multi_agent", "q3": "route_monitor", "q4": "clarify"}


def test_one_active_version(spark):
    t = spark.createDataFrame([("m", "2024-01-01", "t", "{}", 1), ("m", "2024-02-01", "t", "{}", 2), ("n", "2024-01-01", "t", "{}", 3)], "model_name string, trained_at string, model_type string, metrics string, training_data_count long")
    models = G.model_register(t)
    later = G.add_training(models, spark.createDataFrame([("m", "2024-03-01", "t", "{}", 4)], t.schema))
    rows = {(r["model_name"], r["version"]): r["is_active"] for r in later.collect()}
    assert rows == {("m", 1): 0, ("m", 2): 0, ("m", 3): 1, ("n", 1): 1}


def states(spark, folder, trips, batches):
    return {p: refresh.state_after(spark, folder, p, trips, batches) for p in (P.DAILY, P.DRIVER)}


def same_rows(a, b):
    return sorted(map(tuple, a.select(b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_stream_equals_full_refresh(spark, fleet, tmp_path):
    """Repeats in later batches, trips that move to another driver and day, and trips that become unreliable."""
    trips, base = fleet.trips, str(tmp_path)
    moved = trips.filter("driver_id = 3").withColumns({"driver_id": F.lit(4), "trip_start": F.col("trip_start") + F.expr("interval 2 days"), "dt_updated": F.expr("timestamp '2030-01-01 00:00:00'")})
    lost = trips.filter("driver_id = 5 and eta_met = 1").withColumns({"eta_data_status": F.lit("missing"), "dt_updated": F.expr("timestamp '2030-01-01 00:00:00'")})
    trips.repartition(4).write.parquet(f"{base}/in")
    batches = refresh.run(refresh.trip_stream(spark, f"{base}/in", trips.schema, 2), base, f"{base}/checkpoint", [P.DAILY, P.DRIVER])
    assert batches == 2
    found = states(spark, base, trips, batches)
    assert same_rows(P.driver_summary(found[P.DRIVER], fleet.drivers), S.driver_summary(trips, fleet.drivers)) and same_rows(P.daily_fleet_stats(found[P.DAILY]), S.daily_fleet_stats(trips))
    more = moved.unionByName(lost).unionByName(trips.filter("driver_id = 7"))
    more.unionByName(moved).coalesce(1).write.mode("append").parquet(f"{base}/in")
    batches = refresh.run(refresh.trip_stream(spark, f"{base}/in", trips.schema, 2), base, f"{base}/checkpoint", [P.DAILY, P.DRIVER])
    assert batches == 3
    after = trips.join(moved.unionByName(lost).select("dispatch_entry_no"), "dispatch_entry_no", "left_anti").select(trips.columns).unionByName(moved).unionByName(lost)
    found = states(spark, base, trips, batches)
    assert same_rows(P.driver_summary(found[P.DRIVER], fleet.drivers), S.driver_summary(after, fleet.drivers)) and same_rows(P.daily_fleet_stats(found[P.DAILY]), S.daily_fleet_stats(after))
    assert P.driver_summary(found[P.DRIVER], fleet.drivers).filter("driver_id = 3").count() == 0
    # a batch that runs again gives the same
    refresh.apply_batch(more.unionByName(moved), 2, base, [P.DAILY, P.DRIVER])
    assert same_rows(P.driver_summary(states(spark, base, trips, batches)[P.DRIVER], fleet.drivers), S.driver_summary(after, fleet.drivers))
    # only touched buckets were written
    assert spark.read.parquet(f"{base}/state-driver_id/version=2").select("bucket").distinct().count() <= 4


def test_open_days_are_marked(spark, fleet):
    latest = fleet.trips.agg(F.max("trip_start")).first()[0]
    rows = refresh.daily_with_open_days(P.state_of(fleet.trips, P.DAILY), F.lit(latest)).collect()
    assert len(rows) == S.daily_fleet_stats(fleet.trips).count() and 0 < sum(r["is_provisional"] for r in rows) <= 8


def test_streams_move_only_what_the_states_read(fleet):
    from hauldeck.plans import cat_rest

    wanted = [P.DAILY, P.DRIVER]
    narrow = fleet.trips.select(refresh.read_columns(fleet.trips.columns, wanted))
    for p in wanted:
        assert sorted(map(str, P.state_of(narrow, p).collect())) == sorted(map(str, P.state_of(fleet.trips, p).collect()))
    batches, base = cat_rest._streamed(fleet)
    assert batches > 1 and fleet.spark.read.parquet(f"{base}/in").columns == narrow.columns and len(narrow.columns) < len(fleet.trips.columns)
