"""Questions of the older application; unfiltered figures unless stated."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.cleaning import like_search
from ..functions.numeric import avg2, count_when, on_time_rate, rnd, sum2
from .paging import page_per, paginate, top_per
from .reads import NO, with_names
from .summaries import name_routes


def latest_nulls_last():
    return [F.desc_nulls_last("trip_start"), F.asc(NO)]


def arrow_route(origin: str = "origin_name", destination: str = "destination_name"):
    return T.route_label(F.col(origin), F.col(destination), T.LEGACY_ARROW)


def record_count(trips: DataFrame) -> DataFrame:
    return trips.agg(F.count(F.lit(1)).alias("records"))


def data_summary(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_distinct("driver_id").alias("total_drivers"),
        F.count_distinct("vehicle_id").alias("total_vehicles"), F.min("trip_start").alias("date_start"), F.max("trip_start").alias("date_end"))


def drivers_older(summary_all: DataFrame, search=None, page=1, limit=50) -> DataFrame:
    rows = summary_all.filter(like_search(search, F.col("driver_name"), F.col("driver_mobile"))) if search else summary_all
    return paginate(rows.select(
        "driver_id", F.col("driver_name").alias("name"), F.coalesce("driver_mobile", F.lit("")).alias("mobile"), F.col("total_trips").alias("trip_count"),
        "eta_success_rate", "avg_speed_kmph", "total_distance_km",
        F.lower(F.concat_ws(" ", "driver_name", F.coalesce("driver_mobile", F.lit("")))).alias("search_text"),
    ), [F.desc("trip_count"), "driver_id"], page, limit)


def driver_profile(trips: DataFrame, summary_all: DataFrame, locations: DataFrame) -> DataFrame:
    """Summary figures with the most frequent route and the busiest start hour."""
    by_route = name_routes(trips.groupBy("driver_id", "origin_id", "destination_id").agg(F.count(F.lit(1)).alias("n")), locations)
    route = top_per(by_route, ["driver_id"], [F.desc("n"), "origin", "destination"], 1).select(
        "driver_id", arrow_route("origin", "destination").alias("most_frequent_route"))
    by_hour = trips.filter("trip_start is not null").groupBy("driver_id", F.hour("trip_start").alias("peak_operating_hour")).agg(F.count(F.lit(1)).alias("n"))
    hour = top_per(by_hour, ["driver_id"], [F.desc("n"), "peak_operating_hour"], 1).drop("n")
    return (
        summary_all.withColumn("eta_missed", F.col("total_trips") - F.col("eta_met_count"))
        .join(route, "driver_id", "left").join(hour, "driver_id", "left")
    )


def driver_cars(trips: DataFrame, vehicles: DataFrame) -> DataFrame:
    """One row per driver and car used (a list per driver would grow with the fleet)."""
    pairs = trips.select("driver_id", "vehicle_id").distinct()
    return pairs.join(vehicles.select(F.col("id").alias("vehicle_id"), "asset_id"), "vehicle_id").select("driver_id", "asset_id")


def driver_latest(trips: DataFrame, fleet, k: int = 5) -> DataFrame:
    rows = top_per(trips.filter("driver_id is not null and trip_start is not null"), ["driver_id"], [F.desc("trip_start"), NO], k)
    return with_names(rows, fleet, driver=False).select(
        "driver_id", F.col(NO).alias("trip_id"), F.to_date("trip_start").alias("date"), arrow_route().alias("route"),
        rnd(F.col("trip_duration_minutes").cast("double") / 60).alias("duration_hours"), "trip_km", F.col("asset_id").alias("vehicle"),
        F.coalesce("eta_met", F.lit(0)).alias("eta_met"))


def driver_vehicle_use(trips: DataFrame, vehicles: DataFrame) -> DataFrame:
    use = trips.groupBy("driver_id", "vehicle_id").agg(
        F.count(F.lit(1)).alias("trip_count"), F.coalesce(sum2("trip_km"), F.lit(0.0)).alias("total_km"), avg2("avg_speed_kmph", 6).alias("avg_speed"))
    return use.join(vehicles.select(F.col("id").alias("vehicle_id"), "asset_id", "asset_type"), "vehicle_id").drop("vehicle_id")


def trips_search(trips: DataFrame, fleet, search=None, driver_name=None, vehicle=None, status=None, start_date=None, end_date=None, page=1, limit=20) -> DataFrame:
    """Free text in number, origin or destination, plus exact conditions."""
    rows = with_names(trips, fleet)
    if status:
        rows = rows.filter(F.col("trip_status") == status)
    if start_date:
        rows = rows.filter(F.col("trip_start") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        rows = rows.filter(F.col("trip_start") <= F.lit(end_date).cast("timestamp"))
    if driver_name:
        rows = rows.filter(F.col("driver_name") == driver_name)
    if vehicle:
        rows = rows.filter(F.col("asset_id") == vehicle)
    if search:
        rows = rows.filter(like_search(search, F.col(NO), F.col("origin_name"), F.col("destination_name")))
    return paginate(rows, latest_nulls_last(), page, limit).select(*_trip_columns(), "trip_status", "driver_name", F.col("asset_id").alias("vehicle_id"), "total", "total_pages")


def _trip_columns():
    return [
        F.col(NO).alias("trip_id"), "trip_start", "trip_end", F.col("origin_name").alias("origin"), F.col("destination_name").alias("destination"),
        arrow_route().alias("route"), "trip_km", F.col("trip_duration_minutes").alias("duration_minutes"), "eta_met",
    ]


def driver_trips_legacy(trips: DataFrame, fleet, page=1, limit=20) -> DataFrame:
    rows = page_per(trips.filter("driver_id is not null"), ["driver_id"], latest_nulls_last(), page, limit)
    return with_names(rows, fleet).select("driver_name", *_trip_columns(), F.col("trip_status").alias("status"), F.col("asset_id").alias("vehicle"), "total", "total_pages")


def vehicle_trips_legacy(trips: DataFrame, fleet, page=1, limit=20) -> DataFrame:
    rows = page_per(trips.filter("vehicle_id is not null"), ["vehicle_id"], latest_nulls_last(), page, limit)
    return with_names(rows, fleet).select("asset_id", *_trip_columns(), "driver_name", "total", "total_pages")


def trip_details_legacy(trips: DataFrame, fleet) -> DataFrame:
    return with_names(trips, fleet).select(
        *_trip_columns(), "driver_name", "driver_mobile", F.col("asset_id").alias("vehicle_id"), F.col("asset_type").alias("vehicle_type"),
        "trip_eta", "avg_speed_kmph", "eta_delay_minutes", F.col("trip_status").alias("status"))


def vehicles_usage(trips: DataFrame, vehicles: DataFrame, search=None, page=1, limit=50) -> DataFrame:
    """All vehicles, unused ones included."""
    rows = vehicles.filter(like_search(search, F.col("asset_id"), F.col("asset_type"))) if search else vehicles
    use = trips.groupBy(F.col("vehicle_id").alias("id")).agg(
        F.count(F.lit(1)).alias("trip_count"), F.count_distinct("driver_id").alias("driver_count"), sum2("trip_km").alias("total_km"))
    out = rows.join(use, "id", "left").select("asset_id", "asset_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trip_count", "driver_count", "total_km")])
    return paginate(out, [F.desc("trip_count"), "asset_id"], page, limit) if limit else out


def overview(trips: DataFrame) -> DataFrame:
    met = count_when(F.col("eta_met") == 1)
    return trips.agg(
        F.count(F.lit(1)).alias("total_trips"), met.alias("eta_met"), (F.count(F.lit(1)) - met).alias("eta_missed"), on_time_rate().alias("eta_success_rate"),
        sum2("trip_km").alias("total_distance_km"), F.count_distinct("driver_id").alias("active_drivers"),
        F.count_distinct("vehicle_id").alias("active_vehicles"), avg2("trip_duration_minutes").alias("avg_trip_duration_min"))


def route_ranking(routes_all: DataFrame, limit: int = 20) -> DataFrame:
    return routes_all.orderBy(F.desc("trip_count"), "route_name").limit(limit).select(
        F.col("route_name").alias("route"), "trip_count", "avg_duration_min", "eta_success_rate", "avg_distance_km")


def top_performers(summary_all: DataFrame, limit: int = 10, min_trips: int = 5) -> DataFrame:
    rows = summary_all.filter(F.col("total_trips") >= min_trips).orderBy(F.desc("eta_success_rate"), "driver_id").limit(limit)
    return rows.select("driver_id", "driver_name", "total_trips", "eta_success_rate", F.col("eta_met_count").alias("eta_met"))


def eta_from_history(trips: DataFrame, fleet, by_driver: bool = False, by_vehicle: bool = False) -> DataFrame:
    """History-based estimate per route (and driver, vehicle)."""
    keys = ["origin_id", "destination_id"] + (["driver_id"] if by_driver else []) + (["vehicle_id"] if by_vehicle else [])
    n = F.col("sample_size")
    figures = trips.filter(F.col("trip_duration_minutes").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_size"), avg2("trip_duration_minutes").alias("predicted_duration_minutes"),
        rnd(F.try_divide(F.sum("trip_duration_minutes").cast("double"), F.count("trip_duration_minutes").cast("double")) / 60).alias("predicted_duration_hours"),
        rnd(F.min("trip_duration_minutes")).alias("min_duration_minutes"), rnd(F.max("trip_duration_minutes")).alias("max_duration_minutes"),
        avg2("trip_km").alias("avg_distance_km"), avg2("avg_speed_kmph").alias("avg_speed_kmph"),
    ).withColumn("confidence", F.when(n >= 10, "high").when(n >= 5, "medium").otherwise("low"))
    return name_routes(figures, fleet.locations).drop("origin_id", "destination_id")


def route_stats_all(trips: DataFrame, locations: DataFrame) -> DataFrame:
    figures = trips.groupBy("origin_id", "destination_id").agg(
        F.count(F.lit(1)).alias("total_trips"), avg2("trip_duration_minutes").alias("avg_duration_minutes"), avg2("trip_km").alias("avg_distance_km"),
        on_time_rate().alias("eta_success_rate"), F.count_distinct("driver_id").alias("unique_drivers"), F.count_distinct("vehicle_id").alias("unique_vehicles"))
    return name_routes(figures, locations).withColumn("route", arrow_route("origin", "destination")).drop("origin_id", "destination_id", "origin", "destination")


def name_lookups(dim: DataFrame) -> DataFrame:
    return dim.select("name").orderBy("name")


def validation_trips(trips: DataFrame, fleet) -> DataFrame:
    rows = trips.filter((F.col("trip_status") == "C") & F.col("trip_start").isNotNull() & F.col("ata_in").isNotNull()
                        & F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull())
    return with_names(rows, fleet).select(
        NO, "trip_start", "ata_in", "trip_duration_minutes", "trip_km", "avg_speed_kmph", "eta_met", "eta_delay_minutes", "driver_id", "driver_name",
        F.col("origin_name").alias("origin"), F.col("destination_name").alias("destination"), "asset_type")


def prediction_validate(predicted: DataFrame) -> DataFrame:
    """Arrival and duration errors of predicted_duration_minutes against the recorded arrival."""
    arrival = T.arrival_time(F.col("trip_start"), F.col("predicted_duration_minutes"))
    gap = (F.unix_micros(arrival) - F.unix_micros(F.col("ata_in").cast("timestamp"))).cast("double")
    rows = predicted.withColumns({"_signed": gap / 3.6e9, "_h": F.abs(gap) / 3.6e9})
    h = F.col("_h")
    return rows.select(
        NO, arrival.alias("predicted_arrival"), rnd(h).alias("arrival_error_hours"), rnd(h * 60).alias("arrival_error_minutes"), rnd("_signed").alias("difference_hours"),
        rnd(F.abs(F.col("predicted_duration_minutes") - F.col("trip_duration_minutes").cast("double"))).alias("duration_error_minutes"),
        (h <= 1).alias("within_1_hour"), (h <= 2).alias("within_2_hours"), (h <= 4).alias("within_4_hours"),
        F.when(h <= 1, "excellent").when(h <= 2, "good").when(h <= 4, "acceptable").otherwise("poor").alias("prediction_quality"))
