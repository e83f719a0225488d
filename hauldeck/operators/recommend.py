"""Which drivers suit a route: experienced ones first, then those who know one end of it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import avg2, on_time_rate, rnd
from .paging import spread_rank, top_per
from .staging import shared_folder
from .summaries import name_routes, reliable

ROUTE = ["origin_id", "destination_id"]


def driver_route_perf(trips: DataFrame, min_trips: int = 2) -> DataFrame:
    rows = reliable(trips).filter("driver_id is not null and origin_id is not null and destination_id is not null")
    return rows.groupBy("driver_id", *ROUTE).agg(
        F.count(F.lit(1)).alias("route_trips"),
        avg2("trip_duration_minutes").alias("avg_duration_min"),
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        avg2("trip_km").alias("avg_distance_km"),
        on_time_rate().alias("eta_success_rate"),
        avg2("eta_delay_minutes").alias("avg_delay_min"),
        rnd(F.stddev_pop(F.col("trip_duration_minutes").cast("double"))).alias("duration_stddev"),
    ).filter(F.col("route_trips") >= min_trips)


def _mean(c):
    return F.try_divide(F.sum(F.col(c).cast("decimal(12,4)")).cast("double"), F.count(c).cast("double"))


def fleet_priors(summary: DataFrame, perf: DataFrame, min_trips: int = 2) -> DataFrame:
    """One row: mean speed and rate of drivers with enough trips, distinct routes and drivers."""
    from .scoring import or_else

    means = summary.filter(F.col("total_trips") >= min_trips).agg(
        or_else(_mean("avg_speed_kmph"), 40.0).alias("global_avg_speed"), or_else(_mean("eta_success_rate"), 50.0).alias("global_avg_eta_success"))
    counts = perf.agg(F.struct(F.count_distinct(*ROUTE).alias("routes"), F.count_distinct("driver_id").alias("drivers")).alias("c")).scalar()
    return means.withColumns({"unique_routes": counts["routes"], "unique_drivers": counts["drivers"]})


def _composite(df: DataFrame, weights: tuple) -> DataFrame:
    names = ["route_experience_score", "eta_compliance_score", "speed_efficiency_score", "consistency_score", "overall_experience_score"]
    total = None
    for name, w in zip(names, weights, strict=True):
        part = F.col(name) * w
        total = part if total is None else total + part
    return df.withColumns({"composite_score": rnd(total), **{n: rnd(n) for n in names}})


def _column(prior):
    return prior if isinstance(prior, Column) else F.lit(float(prior))


def _experience(total):
    return F.least(F.lit(100.0), F.log1p(total) / F.log1p(F.lit(200.0)) * 100)


def recommend_exact(perf: DataFrame, overall: DataFrame, prior) -> DataFrame:
    """Score of every driver on every route driven before."""
    rows = perf.join(overall.select("driver_id", "driver_name", "total_trips"), "driver_id", "left").withColumn("_prior", _column(prior))
    n, sd = F.col("route_trips"), F.coalesce("duration_stddev", F.lit(0.0))
    rows = rows.withColumn("total_trips", F.coalesce("total_trips", "route_trips")).withColumns({
        "route_experience_score": F.least(F.lit(100.0), F.log1p(n) / F.log1p(F.lit(30.0)) * 100),
        "eta_compliance_score": F.least(F.lit(100.0), T.smoothed_rate(n, F.col("eta_success_rate"), F.col("_prior"), 10)),
        "speed_efficiency_score": T.speed_score_recommender(F.coalesce("avg_speed_kmph", F.lit(0.0))),
        "consistency_score": F.when(n <= 1, 50.0).when(sd == 0, 100.0).otherwise(
            F.greatest(F.lit(0.0), 100 - sd / F.greatest(F.col("avg_duration_min"), F.lit(1.0)) * 100)),
        "overall_experience_score": _experience(F.col("total_trips")),
    })
    return _composite(rows, (0.25, 0.30, 0.15, 0.10, 0.20))


def _similar_scores(sums: DataFrame, overall: DataFrame, prior) -> DataFrame:
    """Scores from summed records of one or both ends (columns n, rates, speeds, records)."""
    rows = sums.join(overall.select("driver_id", "driver_name", "total_trips"), "driver_id").withColumn("_prior", _column(prior))
    n, count = F.col("n"), F.col("records").cast("double")
    rate, speed = F.col("rates").cast("double") / count, F.col("speeds").cast("double") / count
    rows = rows.withColumns({
        "route_experience_score": F.least(F.lit(80.0), F.log1p(n) / F.log1p(F.lit(30.0)) * 80),
        "eta_compliance_score": F.least(F.lit(100.0), T.smoothed_rate(n, rate, F.col("_prior"), 15)),
        "speed_efficiency_score": T.speed_score_recommender(speed),
        "consistency_score": F.lit(50.0),
        "overall_experience_score": _experience(F.col("total_trips")),
    })
    return _composite(rows, (0.20, 0.30, 0.15, 0.10, 0.25))


def _by_end(perf: DataFrame, end: str) -> DataFrame:
    return perf.groupBy("driver_id", end).agg(
        F.sum("route_trips").alias("n"), F.sum(F.col("eta_success_rate").cast("decimal(12,4)")).alias("rates"),
        F.sum(F.col("avg_speed_kmph").cast("decimal(12,4)")).alias("speeds"), F.count(F.lit(1)).alias("records"))


PAIRED = 10_000  # pairs of places up to which a driver's own places are paired

SCORED = ["driver_id", "driver_name", "composite_score", "route_experience_score", "eta_compliance_score", "speed_efficiency_score",
          "consistency_score", "overall_experience_score", "total_trips"]


def recommend_similar(perf: DataFrame, overall: DataFrame, requests: DataFrame, prior, top_n: int = 10) -> DataFrame:
    """The top_n drivers per requested route who know one of its ends, but not the route.

    Drivers who know both ends are scored per route. All others are ranked
    once per place; a route then takes as many ranks of its origin and its
    destination as it needs to fill top_n after skipping drivers already
    counted. That keeps the work proportional to the result instead of
    pairing every route with every driver of a busy place. A driver pairs up
    to PAIRED pairs of places; one of more places costs a row per request at
    a known origin, and there are few of them: fewer than records over the
    root of PAIRED.
    """
    at_origin, at_destination = _by_end(perf, "origin_id"), _by_end(perf, "destination_id")
    shared_folder(perf.sparkSession)  # checkpoints need a folder
    exact = perf.join(requests, ROUTE, "left_semi").select("driver_id", *ROUTE)
    o = at_origin.select("driver_id", "origin_id", *[F.col(c).alias(f"o_{c}") for c in ("n", "rates", "speeds", "records")])
    d = at_destination.select("driver_id", "destination_id", *[F.col(c).alias(f"d_{c}") for c in ("n", "rates", "speeds", "records")])
    # drivers of few places pair their own places; for the few drivers of many places the requests are looked up instead
    ends = o.groupBy("driver_id").agg(F.count(F.lit(1)).alias("_o")).join(d.groupBy("driver_id").agg(F.count(F.lit(1)).alias("_d")), "driver_id")
    many = ends.filter(F.col("_o") * F.col("_d") > PAIRED).select("driver_id").checkpoint()
    paired = o.join(many, "driver_id", "left_anti").join(d, "driver_id").join(requests.select(*ROUTE), ROUTE, "left_semi")
    asked = requests.select(*ROUTE).distinct().join(o.join(many, "driver_id", "left_semi"), "origin_id").join(d, ["driver_id", "destination_id"])
    both = (
        paired.unionByName(asked).join(exact, ["driver_id", *ROUTE], "left_anti")
        .select("driver_id", *ROUTE, *[(F.col(f"o_{c}") + F.col(f"d_{c}")).alias(c) for c in ("n", "rates", "speeds", "records")])
    ).checkpoint()
    scored_both = _similar_scores(both, overall, prior)
    counted = both.select("driver_id", *ROUTE).unionByName(exact).checkpoint()
    skip = counted.groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("_skip"))
    wanted = requests.select(*ROUTE).join(skip, ROUTE, "left").withColumn(
        "_rank", F.explode(F.sequence(F.lit(1), (F.coalesce("_skip", F.lit(0)) + top_n).cast("int")))).drop("_skip")
    out = scored_both.select(*ROUTE, *SCORED, F.col("n").alias("similar_route_trips"))
    for end, sums in (("origin_id", at_origin), ("destination_id", at_destination)):
        ranked = spread_rank(_similar_scores(sums, overall, prior), [end], F.col("composite_score"), ["driver_id"], "_rank", descending=True)
        one_end = wanted.join(ranked, [end, "_rank"]).join(counted, ["driver_id", *ROUTE], "left_anti")
        out = out.unionByName(one_end.select(*ROUTE, *SCORED, F.col("n").alias("similar_route_trips")))
    return top_per(out, ROUTE, [F.desc("composite_score"), "driver_id"], top_n)


def recommend_drivers(perf: DataFrame, overall: DataFrame, requests: DataFrame, prior, top_n: int = 10) -> DataFrame:
    """Ranked drivers per requested route: experienced first, filled up with similar-route drivers."""
    exact = recommend_exact(perf.join(requests, ROUTE, "left_semi"), overall, prior)
    first = top_per(exact, ROUTE, [F.desc("composite_score"), "driver_id"], top_n).select(
        *ROUTE, *SCORED, "route_trips", F.lit(0).cast("bigint").alias("similar_route_trips"), F.lit("experienced").alias("category"), F.lit(1).alias("_c"))
    have = exact.groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("_have"))
    shared_folder(perf.sparkSession)
    short = requests.select(*ROUTE).join(have.filter(F.col("_have") >= top_n), ROUTE, "left_anti").checkpoint()  # the others need no filling
    second = recommend_similar(perf, overall, short, prior, top_n).select(
        *ROUTE, *SCORED, F.lit(0).cast("bigint").alias("route_trips"), "similar_route_trips", F.lit("similar_route").alias("category"), F.lit(2).alias("_c"))
    return top_per(first.unionByName(second), ROUTE, ["_c", F.desc("composite_score"), "driver_id"], top_n, rank="rank").drop("_c")


def similar_routes(recommended: DataFrame, perf: DataFrame, locations: DataFrame, k: int = 3) -> DataFrame:
    """For each similar-route recommendation, the driver's k most driven routes that share an end with it."""
    pairs = recommended.filter("category = 'similar_route'").select("driver_id", F.col("origin_id").alias("_o"), F.col("destination_id").alias("_d"))
    known = perf.select("driver_id", *ROUTE, "route_trips")
    shared = pairs.join(known, (pairs["driver_id"] == known["driver_id"]) & (pairs["_o"] == known["origin_id"])).drop(known["driver_id"])
    shared = shared.unionByName(pairs.join(known, (pairs["driver_id"] == known["driver_id"]) & (pairs["_d"] == known["destination_id"])).drop(known["driver_id"]))
    top = top_per(shared, ["_o", "_d", "driver_id"], [F.desc("route_trips"), "origin_id", "destination_id"], k, rank="rank")
    named = name_routes(top, locations)
    text = F.concat("origin", F.lit(" -> "), "destination", F.lit(" ("), F.col("route_trips").cast("string"), F.lit(" trips)"))
    return named.select(F.col("_o").alias("for_origin_id"), F.col("_d").alias("for_destination_id"), "driver_id", "rank", text.alias("route"))
