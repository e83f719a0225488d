"""Summary tables over the trip fact.

Every table aggregates by id first (map-side combine, one shuffle on the
key) and joins the much smaller result to the names afterwards.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import avg2, count_when, on_time_rate, rnd, sum2
from ..functions.trips import LEGACY_ARROW, route_label


def reliable(trips: DataFrame, positive: bool = True) -> DataFrame:
    """Trips with a recorded arrival and a (positive) duration."""
    rows = trips.filter((F.col("eta_data_status") == "available") & F.col("trip_duration_minutes").isNotNull())
    return rows.filter(F.col("trip_duration_minutes") > 0) if positive else rows


def name_routes(df: DataFrame, locations: DataFrame, how: str = "inner", origin: str = "origin", destination: str = "destination") -> DataFrame:
    o = locations.select(F.col("id").alias("origin_id"), F.col("name").alias(origin))
    d = locations.select(F.col("id").alias("destination_id"), F.col("name").alias(destination))
    return df.join(o, "origin_id", how).join(d, "destination_id", how)


def driver_figures(trips: DataFrame) -> DataFrame:
    """Vehicles are counted apart: beside a distinct count the sums would travel once per vehicle of a driver."""
    rows = trips.filter(F.col("driver_id").isNotNull())
    used = rows.select("driver_id", "vehicle_id").distinct().groupBy("driver_id").agg(F.count("vehicle_id").alias("vehicles_used"))
    figures = rows.groupBy("driver_id").agg(
        F.count(F.lit(1)).alias("total_trips"),
        count_when(F.col("eta_met") == 1).alias("eta_met_count"),
        on_time_rate().alias("eta_success_rate"),
        avg2("trip_duration_minutes").alias("avg_duration_min"),
        rnd(F.max("trip_duration_minutes")).alias("max_duration_min"),
        rnd(F.min("trip_duration_minutes")).alias("min_duration_min"),
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        sum2("trip_km").alias("total_distance_km"),
        avg2("trip_km").alias("avg_distance_km"),
        avg2("eta_delay_minutes").alias("avg_eta_delay_min"),
    ).join(used, "driver_id")
    own = [c for c in figures.columns if c != "vehicles_used"]
    at = own.index("total_distance_km")
    return figures.select(*own[:at], "vehicles_used", *own[at:])


def driver_summary(trips: DataFrame, drivers: DataFrame, filtered: bool = True) -> DataFrame:
    names = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"), F.col("mobile1").alias("driver_mobile"))
    figures = driver_figures(reliable(trips) if filtered else trips)
    out = figures.join(names, "driver_id")
    return out.select("driver_id", "driver_name", "driver_mobile", *[c for c in figures.columns if c != "driver_id"])


def route_figures(trips: DataFrame) -> DataFrame:
    return trips.filter(F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull()).groupBy("origin_id", "destination_id").agg(
        F.count(F.lit(1)).alias("trip_count"),
        avg2("trip_duration_minutes").alias("avg_duration_min"),
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        on_time_rate().alias("eta_success_rate"),
        avg2("trip_km").alias("avg_distance_km"),
    )


def route_summary(trips: DataFrame, locations: DataFrame, filtered: bool = True, arrow: str = " -> ") -> DataFrame:
    named = name_routes(route_figures(reliable(trips) if filtered else trips), locations)
    return named.withColumn("route_name", route_label(F.col("origin"), F.col("destination"), arrow)).select(
        "origin_id", "destination_id", "origin", "destination", "route_name", "trip_count",
        "avg_duration_min", "avg_speed_kmph", "eta_success_rate", "avg_distance_km",
    )


def vehicle_summary(trips: DataFrame, vehicles: DataFrame) -> DataFrame:
    figures = reliable(trips).filter(F.col("vehicle_id").isNotNull()).groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.count_distinct("driver_id").alias("drivers_used"),
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        sum2("trip_km").alias("total_distance_km"),
        avg2("trip_km").alias("avg_distance_km"),
        on_time_rate().alias("eta_success_rate"),
    )
    names = vehicles.select(F.col("id").alias("vehicle_id"), "asset_id", "asset_type")
    return figures.join(names, "vehicle_id").select("vehicle_id", "asset_id", "asset_type", *figures.columns[1:])


def daily_fleet_stats(trips: DataFrame) -> DataFrame:
    return (
        reliable(trips, positive=False).filter(F.col("trip_start").isNotNull())
        .groupBy(F.to_date("trip_start").alias("stat_date"))
        .agg(
            F.count(F.lit(1)).alias("total_trips"),
            sum2("trip_km").alias("total_distance_km"),
            avg2("avg_speed_kmph").alias("avg_speed"),
            on_time_rate().alias("eta_success_rate"),
            F.count_distinct("driver_id").alias("active_drivers"),
            F.count_distinct("vehicle_id").alias("active_vehicles"),
        )
    )


def route_time_patterns(trips: DataFrame, locations: DataFrame, min_trips: int = 2) -> DataFrame:
    figures = (
        reliable(trips, positive=False)
        .filter(F.col("trip_start").isNotNull() & F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull())
        .groupBy("origin_id", "destination_id", F.hour("trip_start").alias("hour_of_day"), F.dayofweek("trip_start").alias("day_of_week"))
        .agg(
            avg2("trip_duration_minutes").alias("avg_duration"),
            F.count(F.lit(1)).alias("trip_count"),
            on_time_rate().alias("eta_success_rate"),
        )
        .filter(F.col("trip_count") >= min_trips)
    )
    return name_routes(figures, locations).select(
        "origin_id", "destination_id", "origin", "destination", "hour_of_day", "day_of_week",
        "avg_duration", "trip_count", "eta_success_rate",
    )


def customer_summary(trips: DataFrame, customers: DataFrame) -> DataFrame:
    weeks = F.datediff(F.max("trip_start"), F.min("trip_start")).cast("double") / 7
    figures = reliable(trips).filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_trips"),
        sum2("trip_km").alias("total_distance_km"),
        avg2("trip_km").alias("avg_distance_km"),
        avg2("trip_duration_minutes").alias("avg_duration_min"),
        on_time_rate().alias("eta_success_rate"),
        F.count_distinct(F.concat(F.col("origin_id").cast("string"), F.lit("-"), F.col("destination_id").cast("string"))).alias("unique_routes"),
        F.count_distinct("driver_id").alias("unique_drivers"),
        F.count_distinct("vehicle_id").alias("unique_vehicles"),
        F.to_date(F.min("trip_start")).alias("first_trip_date"),
        F.to_date(F.max("trip_start")).alias("last_trip_date"),
        rnd(F.try_divide(F.count(F.lit(1)).cast("double"), weeks)).alias("avg_trips_per_week"),
    )
    names = customers.select(F.col("id").alias("customer_id"), F.col("cne_name").alias("customer_name"))
    return figures.join(names, "customer_id").select("customer_id", "customer_name", *figures.columns[1:])


def value_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per key from value counts.

    Counting equal values first is a plain distributed aggregate, so a hot
    key is reduced to its distinct values (minutes with two decimals, capped)
    before anything is gathered per key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_f"))
    return counts.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), 0.5, F.col("_f")).alias(name))


def route_patterns(trips: DataFrame, min_trips: int = 3) -> DataFrame:
    keys = ["origin_id", "destination_id"]
    rows = trips.filter(
        F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull() & F.col("trip_duration_minutes").isNotNull()
    )
    figures = rows.groupBy(*keys).agg(
        avg2("trip_duration_minutes").alias("avg_duration_minutes"),
        avg2("trip_km").alias("avg_distance_km"),
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        on_time_rate().alias("eta_success_rate"),
        F.count(F.lit(1)).alias("sample_size"),
    ).filter(F.col("sample_size") >= min_trips)
    medians = value_median(rows, keys, "trip_duration_minutes", "_median")
    return figures.join(medians, keys).withColumn("median_duration_minutes", rnd("_median")).drop("_median")


def top_list(counts: DataFrame, key: str, item: str, n: str, k: int, name: str) -> DataFrame:
    """The k most frequent items per key as an array, most frequent first, ties by item."""
    w = Window.partitionBy(key).orderBy(F.desc(n), F.col(item))
    ranked = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return ranked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda s: s[item]).alias(name)
    )


def driver_behavior(trips: DataFrame, locations: DataFrame, min_trips: int = 5) -> DataFrame:
    """Habits per driver; favourite routes and punctual hours over all of the driver's trips."""
    mine = trips.filter(F.col("driver_id").isNotNull())
    figures = mine.filter(F.col("trip_start").isNotNull()).groupBy("driver_id").agg(
        avg2("avg_speed_kmph").alias("avg_speed_kmph"),
        rnd(F.stddev_samp(F.col("avg_speed_kmph").cast("double"))).alias("speed_consistency"),
        on_time_rate().alias("eta_reliability_score"),
        avg2("trip_duration_minutes").alias("avg_trip_duration_minutes"),
        F.count(F.lit(1)).alias("total_trips"),
        sum2("trip_km").alias("total_distance_km"),
    ).filter(F.col("total_trips") >= min_trips)
    by_route = mine.groupBy("driver_id", "origin_id", "destination_id").agg(F.count(F.lit(1)).alias("n"))
    routes = top_list(
        name_routes(by_route, locations).withColumn("route", route_label(F.col("origin"), F.col("destination"), LEGACY_ARROW)),
        "driver_id", "route", "n", 5, "preferred_routes",
    )
    by_hour = mine.filter(F.col("eta_met") == 1).groupBy("driver_id", F.hour("trip_start").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hours = top_list(by_hour, "driver_id", "hour", "n", 5, "peak_performance_hours")
    return figures.join(routes, "driver_id", "left").join(hours, "driver_id", "left")
