"""Column functions on a single trip: ends, durations, speeds, calendar parts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip, rnd


def minutes_between(start: Column, end: Column) -> Column:
    """Signed minutes, two decimals."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros.cast("decimal(20,0)") / F.lit(60000000).cast("decimal(10,0)"), 2).cast("decimal(12,2)")


def trip_end_pick(ata_in: Column, trip_end: Column) -> Column:
    return F.coalesce(ata_in, trip_end)


def eta_data_status(ata_in: Column) -> Column:
    return F.when(ata_in.isNotNull(), "available").otherwise("eta_data_unavailable")


def trip_duration_minutes(start: Column, end: Column) -> Column:
    m = minutes_between(start, end)
    return F.when(m >= 0, m)


def eta_met(end: Column, eta: Column) -> Column:
    return F.when(end <= eta, 1).when(end > eta, 0)


def eta_delay(end: Column, eta: Column) -> Column:
    m = minutes_between(eta, end)
    return F.when(m.isNotNull(), F.greatest(m, F.lit(0).cast("decimal(12,2)")))


def avg_speed(km: Column, minutes: Column) -> Column:
    return F.when(
        (km != 0) & (minutes > 0),
        F.round((km.cast("double") / (minutes.cast("double") / 60)).cast("decimal(38,10)"), 2).cast("decimal(12,2)"),
    )


def is_5am_default(start: Column) -> Column:
    hit = (F.hour(start) == 5) & (F.minute(start) == 0) & (F.second(start) == 0)
    return F.when(hit, 1).otherwise(0)


def status_speed(status: Column, stopped_when_not_moving: bool = False) -> Column:
    """'Moving 65' gives 65.0, a stop text 0.0, anything else NULL (0.0 in the bulk variant)."""
    digits = F.regexp_extract(status, r"(\d+\.?\d*)", 1)
    low = F.lower(status)
    moving = low.contains("moving") & (digits != "")
    out = F.when(moving, digits.try_cast("double"))
    if stopped_when_not_moving:
        return out.otherwise(0.0)
    return out.when(low.contains("stop"), 0.0)


def time_bucket(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 11), "morning")
        .when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 20), "evening")
        .otherwise("night")
    )


def time_bucket_code(bucket: Column) -> Column:
    """Codes 0-3 for morning, afternoon, evening, night; -1 if unknown."""
    return (
        F.when(bucket == "morning", 0).when(bucket == "afternoon", 1)
        .when(bucket == "evening", 2).when(bucket == "night", 3).otherwise(-1)
    )


def time_bucket_legacy(hour: Column) -> Column:
    return (
        F.when(hour < 7, "night").when(hour < 13, "morning")
        .when(hour < 19, "afternoon").otherwise("evening")
    )


def time_bucket_legacy_code(hour: Column) -> Column:
    return F.when(hour < 7, 0).when(hour < 13, 1).when(hour < 19, 2).otherwise(3)


def is_weekend(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, 1).otherwise(0)


def weekday_to_sql_day(weekday: Column) -> Column:
    """0 = Monday to 1 = Sunday numbering."""
    d = (weekday + 2) % 7
    return F.when(d == 0, 7).otherwise(d)


def night_flag(hour: Column) -> Column:
    return F.when((hour >= 22) | (hour <= 5), 1).otherwise(0)


def hour_deviation(hour: Column) -> Column:
    return F.least(hour, F.lit(24) - hour)


def week_label(ts: Column) -> Column:
    """Calendar year with ISO week number."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def iso_week_start(ts: Column) -> Column:
    return F.date_sub(F.to_date(ts), F.weekday(ts))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def minutes_truncated(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    # integer division truncates toward zero
    return F.when(micros >= 0, F.floor(micros / 60000000)).otherwise(F.ceil(micros / 60000000)).cast("bigint")


# Labels of the speed ranges, in report order.
SPEED_RANGES = ["Stopped (0)", "Slow (1-20)", "Medium (21-40)", "Fast (41-60)", "Very Fast (61-80)", "Over 80"]


def speed_range(speed: Column) -> Column:
    """Whole-number ranges: 20.5 lies between two of them and lands in the last."""
    return (
        F.when(speed == 0, SPEED_RANGES[0])
        .when(speed.between(1, 20), SPEED_RANGES[1])
        .when(speed.between(21, 40), SPEED_RANGES[2])
        .when(speed.between(41, 60), SPEED_RANGES[3])
        .when(speed.between(61, 80), SPEED_RANGES[4])
        .otherwise(SPEED_RANGES[5])
    )


def route_label(origin: Column, destination: Column, arrow: str = " -> ") -> Column:
    return F.concat(origin, F.lit(arrow), destination)


LEGACY_ARROW = " → "


def smoothed_rate(n: Column, rate: Column, prior, k: float) -> Column:
    """Shrinks a rate towards the prior by k pseudo trips."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (n * rate + F.lit(float(k)) * prior) / (n + F.lit(float(k)))


def speed_score_list(v: Column) -> Column:
    """100 in 20-40 km/h, linear below, 2.5 points per km/h above."""
    return (
        F.when(v.between(20, 40), 100.0)
        .when(v < 20, F.greatest(F.lit(0.0), v / 20 * 100))
        .otherwise(F.greatest(F.lit(0.0), 100 - (v - 40) * 2.5))
    )


def speed_score_scorer(v: Column) -> Column:
    """Rises to 100 at 45 km/h and falls to 0 at 70."""
    return F.when(v <= 45, clip(v / 45 * 100, 0, 100)).otherwise(clip(100 - (v - 45) / 25 * 100, 0, 100))


def speed_score_recommender(v: Column) -> Column:
    """100 in 35-55 km/h, 3 points per km/h away from 45 outside; 0 for no speed."""
    return (
        F.when(v.between(35, 55), 100.0)
        .when(v > 0, F.greatest(F.lit(0.0), 100 - F.abs(v - 45) * 3))
        .otherwise(0.0)
    )


def log_experience(n: Column, top: Column) -> Column:
    return F.when(top > 0, F.least(F.lit(100.0), F.log1p(n) / F.log1p(F.greatest(top, F.lit(1e-9))) * 100)).otherwise(0.0)


def duration_text(minutes: Column) -> Column:
    """'45m' below an hour, else '3h 5m', or '3h' when no minutes are left over."""
    whole = lambda v: F.round(v.cast("decimal(38,10)"), 0).cast("bigint")
    h = F.floor(minutes / 60).cast("bigint")
    m = whole(minutes.cast("double") - h * 60)
    hours = F.concat(h.cast("string"), F.lit("h"))
    return (
        F.when(minutes < 60, F.concat(whole(minutes).cast("string"), F.lit("m")))
        .when(m > 0, F.concat(hours, F.lit(" "), m.cast("string"), F.lit("m")))
        .otherwise(hours)
    )


def rank_tier(score: Column) -> Column:
    return F.when(score >= 80, "Platinum").when(score >= 60, "Gold").when(score >= 40, "Silver").otherwise("Bronze")


def arrival_time(start: Column, minutes: Column) -> Column:
    """Start plus a number of minutes (to the microsecond)."""
    micros = F.unix_micros(start.cast("timestamp")) + F.round((minutes.cast("double") * 60000000).cast("decimal(38,10)"), 0).cast("bigint")
    return F.timestamp_micros(micros)
