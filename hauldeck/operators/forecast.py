"""Daily demand series, smoothing, ridge regression and seven-day forecasts.

A series has at most one row per calendar day, so everything gathered per
key is bounded by the length of the calendar, however busy the key is.
"""

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.trips import month_label
from .paging import top_per

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALPHA, RIDGE, HORIZON = 0.3, 1.0, 7
ROUTE = ["origin_id", "destination_id"]
ROUTE_FEATURES = ["day_idx", "day_of_week", "month", "is_weekend", "ma_7", "ma_14"]
FLEET_FEATURES = ["day_idx", "day_of_week", "is_weekend", "ma_7", "ma_14"]
CLIENT_FEATURES = [*ROUTE_FEATURES, "ma_30"]


def demand_daily(trips: DataFrame) -> DataFrame:
    rows = trips.filter((F.col("eta_data_status") == "available") & F.col("trip_start").isNotNull()
                        & F.col("origin_id").isNotNull() & F.col("destination_id").isNotNull())
    return rows.groupBy(*ROUTE, F.to_date("trip_start").alias("trip_date")).agg(F.count(F.lit(1)).alias("trip_count"))


def top_series(daily: DataFrame, keys: list[str], k: int, min_days: int) -> DataFrame:
    """The k keys with most trips, of these the ones with enough active days."""
    totals = daily.groupBy(*keys).agg(F.sum("trip_count").alias("total_trips"), F.count(F.lit(1)).alias("active_days"))
    return totals.orderBy(F.desc("total_trips"), *keys).limit(k).filter(F.col("active_days") >= min_days)


def moving_averages(daily: DataFrame, keys: list[str], sizes=(7, 14, 30)) -> DataFrame:
    """Means over the last n rows (days with trips), shorter at the start."""
    w = Window.partitionBy(*keys).orderBy("trip_date")
    out = {}
    for n in sizes:
        f = w.rowsBetween(1 - n, 0)
        out[f"ma_{n}"] = F.sum("trip_count").over(f).cast("double") / F.count("trip_count").over(f)
    return daily.withColumns(out)


def series_features(daily: DataFrame, keys: list[str]) -> DataFrame:
    first = F.min("trip_date").over(Window.partitionBy(*keys))
    return moving_averages(daily, keys).withColumns({
        "day_idx": F.datediff("trip_date", first), "day_of_week": F.weekday("trip_date"), "month": F.month("trip_date"),
        "is_weekend": F.when(F.weekday("trip_date") >= 5, 1).otherwise(0)})


def exp_smoothing(daily: DataFrame, keys: list[str], keep: int = 30) -> DataFrame:
    """Exponential smoothing in date order; the last 'keep' smoothed values, oldest first, in 'tail'."""
    series = daily.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("trip_date", "trip_count"))), lambda s: s["trip_count"].cast("double")).alias("_y"))
    step = lambda acc, y: F.slice(
        F.concat(acc, F.array(F.lit(ALPHA) * y + F.lit(1 - ALPHA) * F.element_at(acc, -1))), F.greatest(F.size(acc) + 2 - F.lit(keep), F.lit(1)), F.lit(keep))
    tail = F.aggregate(F.slice("_y", F.lit(2), F.size("_y")), F.slice("_y", 1, 1), step)
    out = series.select(*keys, F.size("_y").alias("days"), tail.alias("tail"))
    return out.withColumns({"smoothed_last": F.element_at("tail", -1), "smoothed_7": F.when(F.size("tail") >= 7, F.element_at("tail", -7))})


# ------------------------------------------------------------- ridge
def ridge_per_group(rows: DataFrame, keys: list[str], features: list[str], target: str = "trip_count") -> DataFrame:
    """Ridge coefficients per key (intercept unpenalised).

    Spark's covariances are centred and mergeable, so they are combined
    map-side without losing digits; one short row per key reaches Python,
    where each Arrow batch is one stack of small systems, solved at once.
    """
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    p = len(features)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg(y).alias("_y"), F.array(*[F.avg(c) for c in x]).alias("_x"),
        F.array(*[F.covar_pop(c, y) for c in x]).alias("_xy"), F.array(*[F.covar_pop(a, b) for a in x for b in x]).alias("_xx"))

    def solve(batches):
        for pdf in batches:
            n = pdf["_n"].to_numpy()[:, None]
            stacked = lambda c: np.stack(pdf[c].to_numpy()) if len(pdf) else np.empty((0, p))
            gram = stacked("_xx").reshape(-1, p, p) * n[:, :, None] + RIDGE * np.eye(p)
            beta = np.linalg.solve(gram, (stacked("_xy") * n)[:, :, None])[:, :, 0]
            yield pdf[keys].assign(coef=list(beta), intercept=pdf["_y"].to_numpy() - (stacked("_x") * beta).sum(1))

    fields = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return sums.mapInPandas(solve, f"{fields}, coef array<double>, intercept double")


def solved(rows: DataFrame, model: DataFrame, keys: list[str], features: list[str], target: str = "trip_count") -> DataFrame:
    """Whether each key's coefficients meet the normal equations: residuals sum to 0, and with each feature to RIDGE times its coefficient."""
    line = F.col("intercept")
    for n, c in enumerate(features):
        line = line + F.element_at("coef", n + 1) * F.col(c).cast("double")
    r = rows.join(model, keys).withColumn("_r", F.col(target).cast("double") - line)
    sums = r.groupBy(*keys).agg(F.sum("_r").alias("_0"), F.sum(F.abs("_r")).alias("_a"), *[F.sum(F.col("_r") * F.col(c)).alias(f"_s{n}") for n, c in enumerate(features)],
                                *[F.sum(F.abs(F.col("_r") * F.col(c))).alias(f"_a{n}") for n, c in enumerate(features)], F.first("coef").alias("coef"))
    good = F.abs("_0") <= 1e-6 * (F.col("_a") + 1)
    for n in range(len(features)):
        good = good & (F.abs(F.col(f"_s{n}") - RIDGE * F.element_at("coef", n + 1)) <= 1e-6 * (F.col(f"_a{n}") + 1))
    return sums.select(*keys, F.when(good, 1).otherwise(0).alias("solved"))


def next_days(daily: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Seven daily predictions per key after its last date, with the averages held at their last value."""
    rows = series_features(daily, keys)
    model = ridge_per_group(rows, keys, features)
    last = rows.groupBy(*keys).agg(
        F.max_by(F.struct("trip_date", "day_idx", "ma_7", "ma_14", "ma_30"), "trip_date").alias("z"), F.avg("trip_count").alias("_mean"), F.sum("trip_count").alias("_total"))
    steps = last.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(HORIZON)))).withColumn("date", F.date_add("z.trip_date", F.col("d")))
    inputs = {
        "day_idx": F.col("z.day_idx") + F.col("d"), "day_of_week": F.weekday("date"), "month": F.month("date"),
        "is_weekend": F.when(F.weekday("date") >= 5, 1).otherwise(0), "ma_7": F.col("z.ma_7"), "ma_14": F.col("z.ma_14"), "ma_30": F.col("z.ma_30")}
    out = steps.join(model, keys).join(exp_smoothing(daily, keys), keys)
    line = F.col("intercept")
    for n, c in enumerate(features):
        line = line + F.element_at("coef", n + 1) * inputs[c].cast("double")
    return out.select(
        *keys, "date", F.date_format("date", "EEEE").alias("day_of_week"), rnd(F.greatest(F.lit(0.0), line * 0.6 + F.col("smoothed_last") * 0.4), 1).alias("predicted_trips"),
        F.col("z.ma_7").alias("recent_avg_daily_7d"), F.col("_mean").alias("historical_avg_daily"), F.col("_total").alias("total_historical_trips"), "smoothed_last", "smoothed_7", "tail", "days")


def _week_total(keys):
    return rnd(F.sum(F.col("predicted_trips").cast("decimal(20,1)")).over(Window.partitionBy(*keys)), 1)


def demand_forecast(daily: DataFrame, keys: list[str] | None = None, k: int = 50, min_days: int = 14) -> DataFrame:
    """Forecast rows of the busiest routes."""
    keys = keys or ROUTE
    chosen = daily.join(top_series(daily, keys, k, min_days).select(*keys), keys, "left_semi")
    rows = next_days(chosen, keys, ROUTE_FEATURES)
    return rows.select(
        *keys, "date", "day_of_week", "predicted_trips", rnd("historical_avg_daily", 1).alias("historical_avg_daily"),
        F.when(F.col("smoothed_last") > F.col("smoothed_7"), "up").otherwise("down").alias("recent_trend"), _week_total(keys).alias("total_predicted_week"))


def fleet_forecast(daily: DataFrame) -> DataFrame:
    """The same for the fleet's daily totals (no month feature)."""
    total = daily.groupBy("trip_date").agg(F.sum("trip_count").alias("trip_count"), F.max(F.lit("all")).alias("fleet"))
    rows = next_days(total, ["fleet"], FLEET_FEATURES)
    return rows.select(
        "date", "day_of_week", "predicted_trips", rnd("historical_avg_daily", 1).alias("historical_avg_daily"), rnd("recent_avg_daily_7d", 1).alias("recent_avg_daily_7d"),
        F.when(F.col("smoothed_last") > F.coalesce("smoothed_7", F.element_at("tail", 1)), "up").otherwise("down").alias("recent_trend"), _week_total(["fleet"]).alias("total_predicted_week"))


def forecast_lookup(forecast: DataFrame, routes: DataFrame, origin: str | None = None, destination: str | None = None, k: int = 10) -> DataFrame:
    """One route's rows, or those of the k routes with the largest predicted week."""
    named = forecast.join(routes.select(*ROUTE, "origin", "destination"), ROUTE)
    if origin is not None:
        return named.filter((F.col("origin") == origin) & (F.col("destination") == destination))
    top = named.select(*ROUTE, "total_predicted_week").distinct().orderBy(F.desc("total_predicted_week"), *ROUTE).limit(k)
    return named.join(top.select(*ROUTE), ROUTE, "left_semi")


# ------------------------------------------------------------- clients
def client_daily(raw: DataFrame) -> DataFrame:
    rows = raw.filter("trip_start is not null and customer_name is not null")
    return rows.groupBy(F.trim("customer_name").alias("client"), F.to_date("trip_start").alias("trip_date")).agg(F.count(F.lit(1)).alias("trip_count"))


def client_growth(daily: DataFrame) -> DataFrame:
    """Smoothed level of the last 7 active days against that of days 30 to 24 before the end; 0 and stable for up to 30 days."""
    s = exp_smoothing(daily, ["client"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / 7
    recent, before = mean(F.slice("tail", -7, 7)), mean(F.slice("tail", 1, 7))
    pct = F.when(F.col("days") > 30, (recent - before) / F.greatest(before, F.lit(1.0)) * 100).otherwise(0.0)
    out = s.withColumn("growth_pct", pct)
    return out.select("client", "days", rnd("growth_pct", 1).alias("growth_pct_30d"),
                      F.when(F.col("growth_pct") > 5, "growing").when(F.col("growth_pct") < -5, "declining").otherwise("stable").alias("trend"))


def client_forecast(daily: DataFrame, k: int = 100, min_days: int = 30) -> DataFrame:
    chosen = daily.join(top_series(daily, ["client"], k, min_days).select("client"), "client", "left_semi")
    rows = next_days(chosen, ["client"], CLIENT_FEATURES).join(client_growth(chosen).drop("days"), "client")
    return rows.select(
        "client", "date", "day_of_week", "predicted_trips", rnd("historical_avg_daily", 1).alias("historical_avg_daily"), rnd("recent_avg_daily_7d", 1).alias("recent_avg_daily_7d"),
        "trend", "growth_pct_30d", _week_total(["client"]).alias("total_predicted_week"), "total_historical_trips")


DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def client_profile(raw: DataFrame, min_trips: int = 10) -> DataFrame:
    """Volume, weekly rate, top routes, weekday and month pattern per client."""
    rows = raw.filter("trip_start is not null and customer_name is not null").withColumn("client", F.trim("customer_name"))
    span = F.floor((F.unix_micros(F.max("trip_start")) - F.unix_micros(F.min("trip_start"))) / F.lit(86400000000))
    weekday = F.weekday("trip_start")
    figures = rows.groupBy("client").agg(
        F.count(F.lit(1)).alias("total_trips"), F.greatest(F.lit(1.0), span / 7).alias("_weeks"),
        F.to_date(F.min("trip_start")).alias("first_trip"), F.to_date(F.max("trip_start")).alias("last_trip"),
        *[F.sum(F.when(weekday == n, 1).otherwise(0)).alias(name.lower()) for n, name in enumerate(DAY_NAMES)],
    ).filter(F.col("total_trips") >= min_trips)

    def listing(df, order, k, text, name, rank_order):
        top = top_per(df, ["client"], order, k, rank="_r")
        return top.groupBy("client").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", text.alias("t"))), asc=rank_order), lambda s: s["t"]).alias(name))

    by_route = rows.groupBy("client", "origin", "destination").agg(F.count(F.lit(1)).alias("n"))
    routes = listing(by_route, [F.desc("n"), "origin", "destination"], 5, F.concat_ws(" -> ", "origin", "destination"), "top_routes", True)
    by_month = rows.groupBy("client", month_label(F.col("trip_start")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = listing(by_month, [F.desc("month")], 12, F.concat_ws(":", "month", F.col("n").cast("string")), "monthly_trend", False)
    return (
        figures.withColumns({"avg_trips_per_week": rnd(F.col("total_trips") / F.col("_weeks"), 1), "active_weeks": F.floor("_weeks")})
        .drop("_weeks").join(routes, "client", "left").join(months, "client", "left"))


def client_match(clients: DataFrame, text: str) -> DataFrame:
    """The client meant by a text: same name, else same letters, else a single partial hit; up to 10 candidates otherwise (a list to choose from)."""
    low = F.lower("client")
    level = F.when(F.col("client") == text, 1).when(low == text.lower(), 2).when(low.contains(text.lower()), 3)
    hits = clients.select("client", level.alias("level")).filter(F.col("level").isNotNull())
    counts = hits.groupBy("level").agg(F.count(F.lit(1)).alias("n"))  # at most three rows
    best = counts.agg(F.min(F.struct("level", "n")).alias("b")).scalar()
    found = hits.filter(F.col("level") == best["level"]).withColumn(
        "match", F.when(F.col("level") == 1, "exact").when(F.col("level") == 2, "case-insensitive").when(best["n"] == 1, "partial").otherwise("ambiguous"))
    ten = found.filter("match = 'ambiguous'").orderBy("client").limit(10)
    return found.filter("match <> 'ambiguous'").unionByName(ten).drop("level")


def client_overview(profiles: DataFrame, growth: DataFrame) -> DataFrame:
    """Clients by volume with forecast flag and trend; growth holds the forecast clients."""
    g = growth.select("client", "trend", F.lit(1).alias("has_forecast"))
    return profiles.select("client", "total_trips", "avg_trips_per_week", "active_weeks").join(g, "client", "left").withColumns({
        "has_forecast": F.coalesce("has_forecast", F.lit(0)), "trend": F.coalesce("trend", F.lit("unknown"))}).orderBy(F.desc("total_trips"), "client")
