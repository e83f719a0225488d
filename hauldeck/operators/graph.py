"""The network of places: edges, hubs and cheapest multi-stop routes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import avg2, davg, rnd
from .paging import top_per
from .staging import stage
from .summaries import name_routes, reliable, value_median

ROUTE = ["origin_id", "destination_id"]


def route_edges(trips: DataFrame, locations: DataFrame) -> DataFrame:
    m = F.col("trip_duration_minutes")
    rows = reliable(trips).filter((m < 50000) & F.col("trip_start").isNotNull() & F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull())
    figures = rows.groupBy(*ROUTE).agg(
        avg2("trip_duration_minutes").alias("avg_duration"), rnd(F.stddev_samp(m.cast("double"))).alias("std_duration"),
        rnd(F.min(m)).alias("min_duration"), rnd(F.max(m)).alias("max_duration"), F.coalesce(avg2("trip_km"), F.lit(0.0)).alias("avg_distance"),
        F.coalesce(avg2("avg_speed_kmph"), F.lit(0.0)).alias("avg_speed"), F.count(F.lit(1)).alias("trip_count"),
        F.coalesce(rnd(davg("eta_met") * 100), F.lit(0.0)).alias("eta_success_rate"))
    medians = value_median(rows, ROUTE, "trip_duration_minutes", "_m")
    out = figures.join(medians, ROUTE).withColumn("median_duration", rnd("_m")).drop("_m")
    return name_routes(out, locations).drop(*ROUTE)


def graph_stats(edges: DataFrame) -> DataFrame:
    places = edges.select(F.explode(F.array("origin", "destination")).alias("p")).agg(F.count_distinct("p").alias("n")).scalar()
    out = edges.agg(F.count(F.lit(1)).alias("total_edges")).withColumn("total_locations", places)
    return out.withColumn("avg_connections_per_location", rnd(F.col("total_edges") / F.greatest(F.col("total_locations"), F.lit(1)), 1))


def hub_locations(trips: DataFrame, locations: DataFrame, min_trips: int = 100, k: int = 30) -> DataFrame:
    rows = reliable(trips).filter(F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull())
    pairs = rows.groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(F.col("origin_id").alias("id")).agg(F.sum("n").alias("outgoing_trips"))
    into = pairs.groupBy(F.col("destination_id").alias("id")).agg(F.sum("n").alias("incoming_trips"))
    both = out.join(into, "id", "full").na.fill(0)
    hi, lo = F.greatest("outgoing_trips", "incoming_trips"), F.least("outgoing_trips", "incoming_trips")
    both = both.withColumns({"total_trips": F.col("outgoing_trips") + F.col("incoming_trips"), "hub_score": rnd(lo / F.greatest(hi, F.lit(1)) * 100, 1)})
    named = both.join(locations.select("id", "name"), "id").filter(F.col("total_trips") >= min_trips)
    return named.orderBy(F.desc("total_trips"), "name").limit(k).select("name", "outgoing_trips", "incoming_trips", "total_trips", "hub_score")


COST = "decimal(20,2)"


def least_costs(edges: DataFrame, ends: DataFrame, most: int) -> list[DataFrame]:
    """For 1 to `most` edges: (_v, end, _low), the least cost of a walk from _v to each requested end. A lower bound for paths.

    Each step is a min-plus product of the edges and the last table: one
    equi-join and one map-side combined minimum per (place, end).
    """
    first = edges.join(ends, edges["_next"] == ends["end"]).groupBy(F.col("_at").alias("_v"), "end").agg(F.min("_w").cast(COST).alias("_low"))
    tables = [stage(first, "least")]
    for _ in range(most - 1):
        last = tables[-1]
        step = edges.join(last, edges["_next"] == last["_v"]).filter(F.col("_at") != F.col("end")).select(F.col("_at").alias("_v"), "end", (F.col("_w") + F.col("_low")).cast(COST).alias("_low"))
        tables.append(stage(last.unionByName(step).groupBy("_v", "end").agg(F.min("_low").alias("_low")), "least"))
    return tables


def k_best_routes(edges: DataFrame, requests: DataFrame, k: int = 3, max_edges: int = 5) -> DataFrame:
    """The k cheapest simple paths per requested (start, end), cost = sum of mean minutes, ties by path.

    Before paths grow, the least cost from every place to every requested end
    is known for each number of edges left, and paths of one and two edges
    give a first k-th best cost per request. So from the first edge on a
    partial path is dropped when its cost and the least cost of the rest
    exceed that: what grows stays close to the answer, hubs or not. Each
    round is written to the shared folder: it cuts the plan and survives lost executors.
    """
    e = stage(edges.filter(F.col("origin") != F.col("destination")).select(
        F.col("origin").alias("_at"), F.col("destination").alias("_next"), F.col("avg_duration").cast("decimal(14,2)").alias("_w")), "edges")
    pair, order = ["start", "end"], ["cost", "path"]
    begin = requests.select(*pair, F.array("start").alias("path"), F.col("start").alias("_at"), F.lit(0).cast(COST).alias("cost"))
    found = begin.filter(F.col("start") == F.col("end")).select(*pair, "path", "cost")
    front = begin.filter(F.col("start") != F.col("end"))
    left = least_costs(e, requests.select("end").distinct(), max_edges - 1) if max_edges > 1 else []

    def bounds(complete: DataFrame) -> DataFrame:
        return top_per(complete, pair, ["cost"], k).groupBy(*pair).agg(F.count(F.lit(1)).alias("_c"), F.max("cost").alias("_bound")).filter(F.col("_c") >= k).drop("_c")

    for edge in range(1, max_edges + 1):
        grown = stage(front.join(e, "_at").filter(~F.array_contains("path", F.col("_next"))).select(
            *pair, F.concat("path", F.array("_next")).alias("path"), F.col("_next").alias("_at"), (F.col("cost") + F.col("_w")).cast(COST).alias("cost")), "grown")
        complete = grown.filter(F.col("_at") == F.col("end")).select(*pair, "path", "cost")
        found = stage(top_per(found.unionByName(complete), pair, order, k), "found")
        if edge == max_edges:
            break
        rest = left[max_edges - edge - 1]
        open_ = grown.filter(F.col("_at") != F.col("end"))
        if edge == 1:  # with one edge more: the cheapest paths of two edges
            two = open_.join(left[0], (open_["_at"] == left[0]["_v"]) & (open_["end"] == left[0]["end"])).drop(left[0]["end"]).select(*pair, (F.col("cost") + F.col("_low")).cast(COST).alias("cost"))
            first = stage(bounds(complete.select(*pair, "cost").unionByName(two)), "bound")
        bound = first.unionByName(bounds(found.select(*pair, "cost"))).groupBy(*pair).agg(F.min("_bound").alias("_bound"))
        reach = open_.join(rest, (open_["_at"] == rest["_v"]) & (open_["end"] == rest["end"])).drop(rest["end"], rest["_v"])
        front = reach.join(bound, pair, "left").filter(F.col("_bound").isNull() | (F.col("cost") + F.col("_low") <= F.col("_bound"))).select(*pair, "path", "_at", "cost")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*pair).orderBy(*order)))
    direct = edges.select(F.col("origin").alias("start"), F.col("destination").alias("end"), F.col("avg_duration").alias("direct_duration_min"))
    return ranked.join(direct, pair, "left").select(
        *pair, "rank", "path", F.col("cost").cast("double").alias("total_duration_min"), (F.size("path") - 1).alias("stops"),
        F.when(F.col("direct_duration_min").isNotNull(), 1).otherwise(0).alias("direct_available"), "direct_duration_min")


def route_segments(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge of each path with the edge's figures."""
    legs = paths.filter(F.size("path") > 1).select("start", "end", "rank", F.posexplode(F.arrays_zip(
        F.slice("path", F.lit(1), F.size("path") - 1).alias("from"), F.slice("path", F.lit(2), F.size("path") - 1).alias("to"))).alias("leg", "s"))
    e = edges.select(F.col("origin").alias("from"), F.col("destination").alias("to"), F.col("avg_duration").alias("avg_duration_min"), F.col("avg_distance").alias("avg_distance_km"), "trip_count", "eta_success_rate")
    return legs.select("start", "end", "rank", (F.col("leg") + 1).alias("leg"), F.col("s")["from"].alias("from"), F.col("s")["to"].alias("to")).join(e, ["from", "to"])
