"""The dispatcher's questions on the stored tables.

Where a question concerns one driver, vehicle, route or trip, the function
answers it for all of them at once; filter the result, or pass filtered
trips, for a single one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.cleaning import like_search
from ..functions.numeric import avg2, count_when, on_time_rate, rnd, sum2
from .paging import chosen_order, page_per, paginate, top_per
from .summaries import name_routes

NO = "dispatch_entry_no"


def latest_first():
    return [F.desc("trip_start"), F.asc(NO)]


def _named(df: DataFrame, dim: DataFrame, key: str, **columns: str) -> DataFrame:
    """Left join of dimension columns by id."""
    picked = dim.select(F.col("id").alias(key), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(picked, key, "left")


def with_names(df: DataFrame, fleet, driver=True, vehicle=True, route=True, customer=False) -> DataFrame:
    if route:
        df = name_routes(df, fleet.locations, "left", "origin_name", "destination_name")
    if driver:
        df = _named(df, fleet.drivers, "driver_id", driver_name="name", driver_mobile="mobile1")
    if vehicle:
        df = _named(df, fleet.vehicles, "vehicle_id", asset_id="asset_id", asset_type="asset_type")
    if customer:
        df = _named(df, fleet.customers, "customer_id", customer_name="cne_name")
    return df


def actual_minutes():
    return T.minutes_truncated(F.col("trip_start"), F.col("ata_in"))


# ------------------------------------------------------------- dashboard
def fleet_summary(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.count_distinct("driver_id").alias("total_drivers"),
        F.count_distinct("vehicle_id").alias("total_vehicles"),
        sum2("trip_km").alias("total_distance_km"),
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        on_time_rate().alias("eta_success_rate"),
    )


def daily_trend(stats: DataFrame, days: int = 30) -> DataFrame:
    return stats.orderBy(F.desc("stat_date")).limit(days).orderBy("stat_date")


def top_drivers(summary: DataFrame, limit: int = 10, min_trips: int = 5) -> DataFrame:
    return (
        summary.filter(F.col("total_trips") >= min_trips).orderBy(F.desc("total_trips"), "driver_id").limit(limit)
        .select("driver_id", "driver_name", "driver_mobile", "total_trips", "eta_success_rate", "avg_speed_kmph", "total_distance_km")
    )


def route_heatmap(routes: DataFrame, limit: int = 20) -> DataFrame:
    return (
        routes.orderBy(F.desc("trip_count"), "origin", "destination").limit(limit)
        .select("origin", "destination", "route_name", "trip_count", "avg_duration_min", "eta_success_rate", "avg_distance_km")
    )


def recent_alerts(alerts: DataFrame, limit: int = 20) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), "alert_type", "driver_id", "title").limit(limit)


# ------------------------------------------------------------- drivers
# Columns a list may be sorted by.
DRIVER_SORTS = ["total_trips", "eta_success_rate", "avg_speed_kmph", "total_distance_km", "driver_name", "avg_duration_min"]
VEHICLE_SORTS = ["total_trips", "avg_speed_kmph", "total_distance_km", "eta_success_rate", "asset_id"]
ROUTE_SORTS = ["trip_count", "avg_duration_min", "eta_success_rate", "avg_distance_km"]


def drivers_list(summary: DataFrame, search=None, sort_by="total_trips", sort_order="desc", page=1, limit=20) -> DataFrame:
    rows = summary.filter(like_search(search, F.col("driver_name"), F.col("driver_mobile"))) if search else summary
    return paginate(rows, chosen_order(sort_by, sort_order, DRIVER_SORTS, "total_trips", "driver_id"), page, limit)


def driver_composite(page: DataFrame) -> DataFrame:
    """Composite score; the priors come from the given rows."""
    eta = F.coalesce(F.col("eta_success_rate"), F.lit(0.0))
    speed = F.coalesce(F.col("avg_speed_kmph"), F.lit(0.0)).cast("double")
    n = F.coalesce(F.col("total_trips"), F.lit(0))
    priors = page.agg(F.struct(
        (F.sum(eta.cast("decimal(12,4)")).cast("double") / F.count(F.lit(1))).alias("rate"), F.max(n).alias("top")
    ).alias("p")).scalar()
    score = (
        T.smoothed_rate(n, eta, priors["rate"], 15) * 0.35
        + T.log_experience(n, priors["top"]) * 0.25
        + T.speed_score_list(speed) * 0.20
        + F.least(eta, F.lit(100.0)) * 0.20
    )
    return page.withColumn("composite_score", rnd(score, 1))


def driver_recent_trips(trips: DataFrame, fleet, k: int = 20) -> DataFrame:
    rows = top_per(trips.filter("driver_id is not null"), ["driver_id"], latest_first(), k)
    return _driver_trip_columns(with_names(rows, fleet, driver=False))


def _driver_trip_columns(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(
        "driver_id", NO, "origin_name", "destination_name", "trip_start", F.col("ata_in").alias("trip_end"),
        actual_minutes().alias("trip_duration_minutes"), "eta_met", "avg_speed_kmph", "trip_km", "trip_status", "asset_id", *extra,
    )


def driver_trips_page(trips: DataFrame, fleet, page: int = 1, limit: int = 20) -> DataFrame:
    rows = page_per(trips.filter("driver_id is not null"), ["driver_id"], latest_first(), page, limit)
    return _driver_trip_columns(with_names(rows, fleet, driver=False), "total", "total_pages")


def driver_vehicles(trips: DataFrame, vehicles: DataFrame) -> DataFrame:
    counts = trips.groupBy("driver_id", "vehicle_id").agg(F.count(F.lit(1)).alias("trip_count"))
    v = vehicles.select(F.col("id").alias("vehicle_id"), "asset_id", "asset_type")
    return counts.join(v, "vehicle_id").select("driver_id", "vehicle_id", "asset_id", "asset_type", "trip_count")


def driver_routes(trips: DataFrame, locations: DataFrame, k: int = 10) -> DataFrame:
    counts = name_routes(trips.groupBy("driver_id", "origin_id", "destination_id").agg(F.count(F.lit(1)).alias("trip_count")), locations)
    return top_per(counts, ["driver_id"], [F.desc("trip_count"), "origin", "destination"], k).select("driver_id", "origin", "destination", "trip_count")


def driver_trend(trips: DataFrame, group_by: str = "month", date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Figures per driver and period; the end date counts to its last second."""
    rows = trips.filter(F.col("trip_start").isNotNull())
    if date_from:
        rows = rows.filter(F.col("trip_start") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        rows = rows.filter(F.col("trip_start") <= F.lit(f"{date_to} 23:59:59").cast("timestamp"))
    start = F.col("trip_start")
    bucket = {"day": F.to_date(start), "week": T.iso_week_start(start), "month": F.date_trunc("month", start)}[group_by]
    label = {"day": T.day_label, "week": T.week_label, "month": T.month_label}[group_by]
    return rows.groupBy("driver_id", bucket.alias("_bucket")).agg(
        label(F.min("trip_start")).alias("period"),
        F.count(F.lit(1)).alias("trip_count"),
        avg2("trip_duration_minutes").alias("avg_duration"),
        on_time_rate().alias("eta_success_rate"),
        avg2("avg_speed_kmph").alias("avg_speed"),
        avg2("trip_km").alias("avg_distance"),
        avg2("eta_delay_minutes").alias("avg_delay"),
    ).drop("_bucket")


# Driving patterns: waypoints are reduced per vehicle before they meet the
# (driver, vehicle) pairs, so a point is never copied once per driver.
def driver_vehicle_pairs(trips: DataFrame) -> DataFrame:
    return trips.filter("vehicle_id is not null and driver_id is not null").select("driver_id", "vehicle_id").distinct()


def _part_sums(*keys):
    """Mergeable speed figures of a group of waypoints."""
    stopped = (F.col("speed_kmph") == 0) | F.lower("status").contains("stop")
    return [
        F.sum("speed_kmph").alias("s"), F.count("speed_kmph").alias("c"), F.max("speed_kmph").alias("hi"),
        F.min(F.when(F.col("speed_kmph") > 0, F.col("speed_kmph"))).alias("lo"),
        F.count(F.lit(1)).alias("n"), count_when(stopped).alias("st"), F.sum("distance_from_prev").alias("km"),
    ]


def _mean_of_parts():
    return rnd(F.try_divide(F.sum("s").cast("double"), F.sum("c").cast("double")))


def driving_hourly(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    parts = waypoints.groupBy("vehicle_id", F.hour("recorded_at").alias("hour_of_day")).agg(*_part_sums())
    return parts.join(driver_vehicle_pairs(trips), "vehicle_id").groupBy("driver_id", "hour_of_day").agg(
        _mean_of_parts().alias("avg_speed"), rnd(F.max("hi")).alias("max_speed"), rnd(F.min("lo")).alias("min_speed"),
        F.sum("n").alias("data_points"),
        rnd(F.sum("st").cast("double") / F.sum("n") * 100).alias("stop_pct"),
    )


def driving_speed_dist(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    parts = (
        waypoints.filter(F.col("speed_kmph").isNotNull())
        .groupBy("vehicle_id", T.speed_range(F.col("speed_kmph")).alias("speed_range")).agg(F.count(F.lit(1)).alias("n"))
    )
    out = parts.join(driver_vehicle_pairs(trips), "vehicle_id").groupBy("driver_id", "speed_range").agg(F.sum("n").alias("count"))
    return out.withColumn("range_order", F.array_position(F.array(*[F.lit(x) for x in T.SPEED_RANGES]), F.col("speed_range")))


def driving_daily(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    day = [F.dayofweek("recorded_at").alias("day_num"), F.date_format("recorded_at", "EEEE").alias("day_name")]
    parts = waypoints.groupBy("vehicle_id", *day).agg(*_part_sums())
    return parts.join(driver_vehicle_pairs(trips), "vehicle_id").groupBy("driver_id", "day_num", "day_name").agg(
        _mean_of_parts().alias("avg_speed"), F.sum("n").alias("data_points"),
    )


def driving_totals(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    parts = waypoints.groupBy("vehicle_id", F.to_date("recorded_at").alias("day")).agg(*_part_sums())
    return parts.join(driver_vehicle_pairs(trips), "vehicle_id").groupBy("driver_id").agg(
        F.sum("n").alias("total_points"), F.count_distinct("day").alias("total_days"), _mean_of_parts().alias("overall_avg_speed"),
        rnd(F.max("hi")).alias("top_speed"), rnd(F.sum("km")).alias("total_distance_tracked"),
    )


# ------------------------------------------------------------- vehicles
def vehicles_list(summary: DataFrame, search=None, sort_by="total_trips", sort_order="desc", page=1, limit=20) -> DataFrame:
    rows = summary.filter(like_search(search, F.col("asset_id"), F.col("asset_type"))) if search else summary
    return paginate(rows, chosen_order(sort_by, sort_order, VEHICLE_SORTS, "total_trips", "vehicle_id"), page, limit)


def vehicle_drivers(trips: DataFrame, drivers: DataFrame, k: int = 10) -> DataFrame:
    counts = trips.filter("vehicle_id is not null and driver_id is not null").groupBy("vehicle_id", "driver_id").agg(F.count(F.lit(1)).alias("trip_count"))
    top = top_per(counts, ["vehicle_id"], [F.desc("trip_count"), "driver_id"], k)
    return top.join(drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name")), "driver_id").select(
        "vehicle_id", "driver_id", "driver_name", "trip_count")


def vehicle_recent_trips(trips: DataFrame, fleet, k: int = 20) -> DataFrame:
    rows = top_per(trips.filter("vehicle_id is not null"), ["vehicle_id"], latest_first(), k)
    return with_names(rows, fleet, vehicle=False).select(
        "vehicle_id", NO, "driver_name", "origin_name", "destination_name", "trip_start", "trip_duration_minutes", "eta_met", "avg_speed_kmph")


def vehicle_trips_page(trips: DataFrame, fleet, page: int = 1, limit: int = 20) -> DataFrame:
    rows = page_per(trips.filter("vehicle_id is not null"), ["vehicle_id"], latest_first(), page, limit)
    return with_names(rows, fleet, vehicle=False).select(
        "vehicle_id", NO, "driver_name", "origin_name", "destination_name", "trip_start", "trip_duration_minutes", "eta_met",
        "avg_speed_kmph", "trip_km", "trip_status", "total", "total_pages")


def _route_measures():
    return [
        avg2("trip_duration_minutes").alias("avg_duration_min"), avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        avg2("trip_km").alias("avg_distance_km"), on_time_rate().alias("eta_success_rate"),
    ]


def vehicle_route_benchmark(trips: DataFrame, locations: DataFrame, routes: DataFrame, k: int = 10) -> DataFrame:
    """Top routes per vehicle with the fleet's figures beside them."""
    own = trips.filter(F.col("trip_duration_minutes") > 0).groupBy("vehicle_id", "origin_id", "destination_id").agg(
        F.count(F.lit(1)).alias("trip_count"), *_route_measures())
    top = top_per(name_routes(own, locations), ["vehicle_id"], [F.desc("trip_count"), "origin", "destination"], k)
    names = ["avg_duration_min", "avg_speed_kmph", "avg_distance_km", "eta_success_rate", "trip_count"]
    fleet_side = routes.select("origin_id", "destination_id", *[F.col(n).alias(f"fleet_{n}") for n in names])
    return top.join(fleet_side, ["origin_id", "destination_id"], "left").drop("origin_id", "destination_id")


def vehicle_monthly(trips: DataFrame, months: int = 12) -> DataFrame:
    rows = trips.filter((F.col("trip_duration_minutes") > 0) & F.col("trip_start").isNotNull() & F.col("vehicle_id").isNotNull())
    by_month = rows.groupBy("vehicle_id", T.month_label(F.col("trip_start")).alias("month")).agg(
        F.count(F.lit(1)).alias("trips"), avg2("avg_speed_kmph").alias("avg_speed"), on_time_rate().alias("eta_rate"), sum2("trip_km").alias("total_km"))
    return top_per(by_month, ["vehicle_id"], [F.desc("month")], months)


# ------------------------------------------------------------- trips
def trips_filter(trips: DataFrame, locations: DataFrame, driver_id=None, vehicle_id=None, origin=None, destination=None,
                 trip_status=None, eta_met=None, date_from=None, date_to=None) -> DataFrame:
    """Any combination of the eight conditions. Text conditions pick location ids first."""
    rows = trips
    if driver_id is not None:
        rows = rows.filter(F.col("driver_id") == driver_id)
    if vehicle_id is not None:
        rows = rows.filter(F.col("vehicle_id") == vehicle_id)
    if trip_status is not None:
        rows = rows.filter(F.col("trip_status") == trip_status)
    if eta_met is not None:
        rows = rows.filter(F.col("eta_met") == int(eta_met))
    if date_from:
        rows = rows.filter(F.col("trip_start") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        rows = rows.filter(F.col("trip_start") <= F.lit(date_to).cast("timestamp"))
    for column, text in (("origin_id", origin), ("destination_id", destination)):
        if text:
            hits = locations.filter(like_search(text, F.col("name"))).select(F.col("id").alias(column))
            rows = rows.join(hits, column, "left_semi")
    return rows


def trips_list(trips: DataFrame, fleet, page: int = 1, limit: int = 20, **conditions) -> DataFrame:
    rows = paginate(trips_filter(trips, fleet.locations, **conditions), latest_first(), page, limit)
    return with_names(rows, fleet).select(
        NO, "driver_name", "asset_id", "origin_name", "destination_name", "trip_start", F.col("ata_in").alias("trip_end"),
        actual_minutes().alias("trip_duration_minutes"), "eta_met", "eta_delay_minutes", "avg_speed_kmph", "trip_km", "trip_status", "total", "total_pages")


def trip_stats(trips: DataFrame) -> DataFrame:
    done = F.col("trip_status") == "C"
    rows = trips.filter("trip_start is not null and ata_in is not null").withColumn("_m", actual_minutes())
    return rows.agg(
        F.count(F.lit(1)).alias("total_trips"), count_when(done).alias("completed_trips"),
        F.sum(F.when(done, 0).otherwise(1)).alias("active_trips"),
        avg2("_m").alias("avg_duration_minutes"), avg2("avg_speed_kmph").alias("avg_speed_kmph"), on_time_rate().alias("eta_success_rate"))


def trip_detail(trips: DataFrame, fleet, drivers: DataFrame, routes: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Each trip with its dimensions and its driver's, route's and vehicle's figures."""
    rows = with_names(trips, fleet, customer=True)
    d = drivers.select("driver_id", *[F.col(c).alias(f"driver_{c}") for c in ("total_trips", "eta_success_rate", "avg_speed_kmph", "avg_duration_min")])
    r = routes.select("origin_id", "destination_id", *[F.col(c).alias(f"route_{c}") for c in ("trip_count", "avg_duration_min", "eta_success_rate", "avg_distance_km")])
    v = vehicles.select("vehicle_id", *[F.col(c).alias(f"vehicle_{c}") for c in ("total_trips", "avg_speed_kmph", "eta_success_rate")])
    rows = rows.join(d, "driver_id", "left").join(r, ["origin_id", "destination_id"], "left").join(v, "vehicle_id", "left")
    return rows.withColumn("trip_duration_minutes_actual", actual_minutes())


SPAN, LEVELS = 32, 4  # days of a level's block are SPAN times those of the level below


def day_pieces(first: Column, last: Column) -> Column:
    """Blocks (level, number) that together cover the days from `first` to `last` (numbers, inclusive) exactly once.

    Level 0 has days, each next one blocks of SPAN blocks; a stretch of any
    length is at most 2 * (SPAN - 1) blocks per level, below the top one.
    """
    size = lambda k: F.lit(SPAN**k)
    low = [F.ceil(first / size(k)).cast("long") for k in range(LEVELS)]
    high = [F.floor((last + 1) / size(k)).cast("long") for k in range(LEVELS)]
    none = F.array().cast("array<bigint>")
    numbers = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    at_level = lambda k: lambda x: F.struct(F.lit(k).alias("level"), x.alias("block"))
    parts = []
    for k in range(LEVELS):
        if k + 1 < LEVELS:
            a, b = low[k + 1] * SPAN, high[k + 1] * SPAN
            own = F.when(a < b, F.concat(numbers(low[k], a), numbers(b, high[k]))).otherwise(numbers(low[k], high[k]))
        else:
            own = numbers(low[k], high[k])
        parts.append(F.transform(own, at_level(k)))
    return F.concat(*parts)


def trip_waypoints(trips: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Waypoints recorded while the vehicle was on the trip.

    Both sides meet on (vehicle, level, block): a trip is listed under the
    few blocks that make up its days, one of many years too, and a waypoint
    under its block of each level that its vehicle's trips use. So the join is
    an equi-join, a busy vehicle is spread over its days, and a trip with a
    wrong year costs some rows, not one per day.
    """
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    t = trips.filter(F.col("trip_end") >= F.col("trip_start")).select(NO, "vehicle_id", "trip_start", "trip_end", F.explode(day_pieces(day("trip_start"), day("trip_end"))).alias("_p"))
    t = t.select(NO, "vehicle_id", "trip_start", "trip_end", F.col("_p.level").alias("_level"), F.col("_p.block").alias("_block"))
    used = t.groupBy("vehicle_id").agg(F.collect_set("_level").alias("_levels"))  # at most LEVELS numbers per vehicle
    w = waypoints.join(used, "vehicle_id").withColumn("_level", F.explode("_levels")).drop("_levels")
    w = w.withColumn("_block", F.floor(day("recorded_at") / F.pow(F.lit(float(SPAN)), F.col("_level"))).cast("long"))
    return (
        t.join(w, ["vehicle_id", "_level", "_block"]).filter(F.col("recorded_at").between(F.col("trip_start"), F.col("trip_end")))
        .select(NO, "vehicle_id", "recorded_at", "speed_kmph", "status", "distance_from_prev")
    )


def driver_on_route(trips: DataFrame, locations: DataFrame) -> DataFrame:
    own = trips.filter((F.col("trip_duration_minutes") > 0) & F.col("driver_id").isNotNull()).groupBy("driver_id", "origin_id", "destination_id").agg(
        F.count(F.lit(1)).alias("route_trips"), *_route_measures())
    return name_routes(own, locations).drop("origin_id", "destination_id")


def route_peers(trips: DataFrame, drivers: DataFrame, k: int = 10) -> DataFrame:
    """The k latest other trips on each trip's route.

    Only the k+1 latest trips of a route can be anyone's peers, so each trip
    meets at most k+1 rows.
    """
    route = ["origin_id", "destination_id"]
    rows = trips.filter("origin_id is not null and destination_id is not null")
    latest = top_per(rows.filter(F.col("trip_duration_minutes") > 0), route, latest_first(), k + 1, rank="_rank")
    peers = latest.select(*route, F.col(NO).alias("peer_no"), F.col("driver_id").alias("peer_driver_id"), F.col("trip_start").alias("peer_start"),
                          F.col("trip_duration_minutes").alias("peer_minutes"), F.col("eta_met").alias("peer_eta_met"), F.col("trip_km").alias("peer_km"), "_rank")
    # a trip among the k+1 latest sees one row less than the others, so its own rank moves the cut
    own = latest.select(F.col(NO).alias("_own_no"), F.col("_rank").alias("_own_rank"))
    base = rows.select(NO, *route).join(own, F.col(NO) == F.col("_own_no"), "left")
    seen = base.join(peers, route).filter((F.col(NO) != F.col("peer_no")) & (F.col("_rank") <= F.when(F.col("_own_rank").isNotNull(), k + 1).otherwise(k)))
    named = seen.join(drivers.select(F.col("id").alias("peer_driver_id"), F.col("name").alias("peer_driver")), "peer_driver_id", "left")
    return named.select(NO, "peer_no", "peer_driver", "peer_start", "peer_minutes", "peer_eta_met", "peer_km")


# ------------------------------------------------------------- routes, places, clients
def routes_list(routes: DataFrame, search=None, sort_by="trip_count", sort_order="desc", page=1, limit=20) -> DataFrame:
    rows = routes.filter(like_search(search, F.col("route_name"))) if search else routes
    return paginate(rows, chosen_order(sort_by, sort_order, ROUTE_SORTS, "trip_count", "route_name"), page, limit)


def route_patterns_grid(patterns: DataFrame) -> DataFrame:
    """One row per route and hour, one column per day (1 = Sunday) with the mean duration."""
    return patterns.groupBy("origin", "destination", "hour_of_day").pivot("day_of_week", list(range(1, 8))).agg(F.first("avg_duration")).select(
        "origin", "destination", "hour_of_day", *[F.col(str(n)).alias(f"day_{n}") for n in range(1, 8)])


def route_top_drivers(trips: DataFrame, drivers: DataFrame, locations: DataFrame, k: int = 10) -> DataFrame:
    own = trips.filter("driver_id is not null").groupBy("origin_id", "destination_id", "driver_id").agg(
        F.count(F.lit(1)).alias("trip_count"), avg2("trip_duration_minutes").alias("avg_duration"), on_time_rate().alias("eta_rate"))
    top = top_per(own, ["origin_id", "destination_id"], [F.desc("trip_count"), "driver_id"], k)
    named = name_routes(top, locations).join(drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name")), "driver_id")
    return named.select("origin", "destination", "driver_id", "driver_name", "trip_count", "avg_duration", "eta_rate")


def route_recent(trips: DataFrame, fleet, k: int = 20) -> DataFrame:
    rows = top_per(trips.filter("origin_id is not null and destination_id is not null"), ["origin_id", "destination_id"], latest_first(), k)
    return with_names(rows, fleet).select(
        "origin_name", "destination_name", NO, "driver_name", "asset_id", "trip_start", F.col("ata_in").alias("trip_end"),
        actual_minutes().alias("trip_duration_minutes"), "eta_met", "avg_speed_kmph")


def locations_search(locations: DataFrame, search: str = "", limit: int = 200) -> DataFrame:
    rows = locations.filter(like_search(search, F.col("name"))) if search else locations
    return rows.orderBy("name", "id").limit(limit)


def route_preview(trips: DataFrame, locations: DataFrame) -> DataFrame:
    """Completed trips per route: how many, fastest, slowest, population deviation."""
    m = F.when(F.col("trip_duration_minutes") > 0, F.col("trip_duration_minutes"))
    figures = trips.filter(F.col("trip_status") == "C").groupBy("origin_id", "destination_id").agg(
        F.count(F.lit(1)).alias("total_trips"), rnd(F.min(m)).alias("fastest_minutes"), rnd(F.max(m)).alias("slowest_minutes"),
        rnd(F.stddev_pop(m.cast("double")), 4).alias("duration_stddev"))
    return name_routes(figures, locations).drop("origin_id", "destination_id")


def route_preview_recent(trips: DataFrame, fleet, k: int = 5) -> DataFrame:
    rows = top_per(trips.filter((F.col("trip_status") == "C") & F.col("driver_id").isNotNull()), ["origin_id", "destination_id"], latest_first(), k)
    return with_names(rows, fleet, vehicle=False).select(
        "origin_name", "destination_name", NO, "driver_name", "trip_duration_minutes", "avg_speed_kmph", "trip_km", "eta_met", "trip_start")


def clients_list(clients: DataFrame, search: str = "", sort_by: str = "total_trips", sort_order: str = "desc", name: str = "client") -> DataFrame:
    rows = clients.filter(like_search(search, F.col(name))) if search else clients
    first = F.coalesce(F.col(sort_by), F.lit(0)) if dict(rows.dtypes)[sort_by] != "string" else F.col(sort_by)
    return rows.orderBy(first.asc() if sort_order == "asc" else first.desc(), name)
