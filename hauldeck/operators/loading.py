"""Raw trip rows to dimensions and the trip fact."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import davg, rnd
from .staging import stage

# Validation thresholds.
FIRST_VALID_START = "2019-01-01 00:00:00"
MAX_KM, MAX_MINUTES, MAX_SPEED = 5000, 14400, 120
# Reject reasons, in the order they are tested.
REJECT_REASONS = ["trip_start before 2019", "ata_in before trip_start", "zero duration", "negative duration"]


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in the stated order.

    The rank filter is pushed below the shuffle (window group limit), so each
    task ships at most one row per key and a hot key cannot pile up.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def trip_dedup(raw: DataFrame, order: list, key: str = "dispatch_entry_no") -> DataFrame:
    return first_rows(raw.filter(F.col(key).isNotNull()), [key], order)


def dense_ids(df: DataFrame, key: Column, id_name: str = "id", digits: int = 3) -> DataFrame:
    """Deterministic gap-free ids without a single-task sort.

    Rows are spread over 16**digits buckets by a hash prefix of the key; one
    small count per bucket gives its offset, and rows are numbered inside
    their bucket only.
    """
    rows = df.withColumns({"_key": key.cast("string"), "_bucket": F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits)})
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16**digits rows
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("_key")
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(id_name, F.col("_offset") + F.col("_rn"))
        .drop("_bucket", "_key", "_rn", "_offset")
    )


def dim_drivers(raw: DataFrame) -> DataFrame:
    """Distinct (name, mobile1); mobile2 is the smallest one seen."""
    mobile2 = F.min("driver_mobile2") if "driver_mobile2" in raw.columns else F.min(F.lit(None).cast("string"))
    pairs = (
        raw.filter(F.col("driver_name").isNotNull())
        .groupBy(F.col("driver_name").alias("name"), F.col("driver_mobile").alias("mobile1"))
        .agg(mobile2.alias("mobile2"))
    )
    return dense_ids(pairs, F.concat_ws("|", "name", F.coalesce("mobile1", F.lit("")))).select("id", "name", "mobile1", "mobile2")


def first_attribute(raw: DataFrame, key: str, attribute: str, order: list[str]) -> DataFrame:
    """Distinct keys with the attribute of the first row, combined map-side."""
    rank = F.struct(*order)
    return raw.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(attribute, rank).alias(attribute))


def dim_vehicles(raw: DataFrame, order: list[str]) -> DataFrame:
    v = first_attribute(raw, "asset_id", "asset_type", order)
    return dense_ids(v, F.col("asset_id")).select("id", "asset_id", "asset_type")


def dim_locations(raw: DataFrame) -> DataFrame:
    """Distinct union of every place column that is present."""
    places = [c for c in ("origin", "destination", "final_destination") if c in raw.columns]
    names = raw.select(F.explode(F.array_distinct(F.array(*places))).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return dense_ids(names, F.col("name")).select("id", "name")


def dim_customers(raw: DataFrame, order: list[str], key: str = "cust_login_id", name: str = "cne_name") -> DataFrame:
    c = first_attribute(raw, key, name, order)
    return dense_ids(c, F.col(key)).select("id", key, name)


def fk_resolve(raw: DataFrame, drivers: DataFrame, vehicles: DataFrame, locations: DataFrame, customers: DataFrame) -> DataFrame:
    """Natural keys to surrogate ids; unknown keys give NULL.

    No broadcast hint: the planner broadcasts a dimension only when its
    measured size is under the session threshold.
    """
    d = drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("_dn"), F.col("mobile1").alias("_dm"))
    v = vehicles.select(F.col("id").alias("vehicle_id"), F.col("asset_id").alias("_va"))
    o = locations.select(F.col("id").alias("origin_id"), F.col("name").alias("_on"))
    t = locations.select(F.col("id").alias("destination_id"), F.col("name").alias("_tn"))
    c = customers.select(F.col("id").alias("customer_id"), F.col("cust_login_id").alias("_cl"))
    ids = ["driver_id", "vehicle_id", "origin_id", "destination_id", "customer_id"]
    return (
        raw.drop(*ids)
        .join(d, (F.col("driver_name") == F.col("_dn")) & F.col("driver_mobile").eqNullSafe(F.col("_dm")), "left")
        .join(v, F.col("asset_id") == F.col("_va"), "left")
        .join(o, F.col("origin") == F.col("_on"), "left")
        .join(t, F.col("destination") == F.col("_tn"), "left")
        .join(c, F.col("cust_login_id") == F.col("_cl"), "left")
        .drop("_dn", "_dm", "_va", "_on", "_tn", "_cl")
    )


def route_avg_km(rows: DataFrame) -> DataFrame:
    """Mean km per route over positive distances, before any reject."""
    km = F.col("trip_km").cast("decimal(12,4)")
    return (
        rows.filter((F.col("trip_km") > 0) & F.col("origin").isNotNull() & F.col("destination").isNotNull())
        .groupBy("origin", "destination").agg(rnd(davg(km)).alias("route_km"))
    )


def km_fill(rows: DataFrame, route_km: DataFrame) -> DataFrame:
    km = F.col("trip_km")
    known_route = F.col("origin").isNotNull() & F.col("destination").isNotNull()
    return (
        rows.join(route_km, ["origin", "destination"], "left")
        .withColumn("trip_km", F.when((km.isNull() | (km <= 0)) & known_route, F.col("route_km")).otherwise(km))
        .drop("route_km")
    )


def with_trip_figures(rows: DataFrame) -> DataFrame:
    """Trip end, status, duration, punctuality; raw texts already typed."""
    rows = rows.withColumns({
        "trip_end": T.trip_end_pick(F.col("ata_in"), F.col("trip_end_raw")),
        "eta_data_status": T.eta_data_status(F.col("ata_in")),
    })
    return rows.withColumns({
        "trip_duration_minutes": T.trip_duration_minutes(F.col("trip_start"), F.col("trip_end")),
        "eta_met": T.eta_met(F.col("trip_end"), F.col("trip_eta")),
        "eta_delay_minutes": T.eta_delay(F.col("trip_end"), F.col("trip_eta")),
        "is_5am_default": T.is_5am_default(F.col("trip_start")),
    })


def trip_validate(rows: DataFrame) -> DataFrame:
    """Adds reject_reason (NULL for accepted rows)."""
    start, end, minutes = F.col("trip_start"), F.col("trip_end"), F.col("trip_duration_minutes")
    return rows.withColumn(
        "reject_reason",
        F.when(start < F.lit(FIRST_VALID_START).cast("timestamp"), REJECT_REASONS[0])
        .when(end < start, REJECT_REASONS[1])
        .when(minutes == 0, REJECT_REASONS[2])
        .when(minutes < 0, REJECT_REASONS[3]),
    )


def outlier_cap(rows: DataFrame, caps: bool = True) -> DataFrame:
    """Caps distances and duration, recomputes speed, caps speed. NULLs stay NULL."""

    def capped(name, top, kind):
        c = F.col(name)
        return F.when(c > top, F.lit(top)).otherwise(c).cast(kind) if caps else c.cast(kind)

    new = {
        "trip_km": capped("trip_km", MAX_KM, "decimal(12,2)"),
        "trip_duration_minutes": capped("trip_duration_minutes", MAX_MINUTES, "decimal(12,2)"),
    }
    for name in ("total_dist", "cover_dist"):
        if name in rows.columns:
            new[name] = capped(name, MAX_KM, "decimal(12,2)")
    rows = rows.withColumns(new)
    speed = T.avg_speed(F.col("trip_km"), F.col("trip_duration_minutes"))
    if caps:
        speed = F.when(speed > MAX_SPEED, F.lit(MAX_SPEED).cast("decimal(12,2)")).otherwise(speed)
    return rows.withColumn("avg_speed_kmph", speed.cast("decimal(12,2)"))


# Columns of the stored fact; ids first, then times, measures, flags.
FACT_COLUMNS = [
    "dispatch_entry_no", "driver_id", "vehicle_id", "origin_id", "destination_id", "customer_id",
    "trip_start", "trip_end", "trip_eta", "ata_in", "dt_created", "dt_updated",
    "trip_km", "trip_duration_minutes", "eta_met", "eta_delay_minutes", "avg_speed_kmph",
    "eta_data_status", "is_5am_default", "trip_status", "load_weight_kg",
]


def screened_trips(first: DataFrame) -> DataFrame:
    """Deduplicated rows with filled km, figures and reject_reason.

    The routes' means are stored first, so that the planner knows how small
    they are and does not move the trips to them.
    """
    return trip_validate(with_trip_figures(km_fill(first, stage(route_avg_km(first), "route-km"))))


def trips_fact(first: DataFrame, validate: bool = True) -> DataFrame:
    """The load chain on deduplicated typed rows; validate=False keeps rejects and skips caps."""
    rows = screened_trips(first)
    if validate:
        rows = rows.filter(F.col("reject_reason").isNull())
    return outlier_cap(rows, caps=validate).select(*[c for c in FACT_COLUMNS if c in rows.columns or c == "avg_speed_kmph"])


def reject_report(raw: DataFrame, first: DataFrame) -> DataFrame:
    """Rows per reject reason, plus accepted rows and rows without a dispatch number."""
    reasons = screened_trips(first).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("trips"))
    missing = raw.filter(F.col("dispatch_entry_no").isNull()).agg(F.count(F.lit(1)).alias("trips")).select(F.lit("no dispatch number").alias("reason"), "trips")
    return reasons.unionByName(missing)


def customer_backfill(trips: DataFrame, customers: DataFrame) -> DataFrame:
    """Fills a missing customer_id where the consignor id names a known consignee."""
    known = (
        customers.filter(F.col("cne_id").isNotNull())
        .groupBy(F.col("cne_id").alias("cnr_id")).agg(F.min("id").alias("_cid"))
    )
    return trips.join(known, "cnr_id", "left").withColumn("customer_id", F.coalesce("customer_id", "_cid")).drop("_cid")


def client_map(raw: DataFrame, order: list[str], key: str = "cnr_id", name: str = "cnr_name") -> DataFrame:
    """First non-missing name per consignor id."""
    return first_attribute(raw.filter(F.col(name).isNotNull()), key, name, order)


def link_counts(trips: DataFrame) -> DataFrame:
    return trips.agg(
        F.count("customer_id").alias("linked"),
        F.sum(F.when(F.col("customer_id").isNull(), 1).otherwise(0)).alias("unlinked"),
    )


def changed_entities(trips: DataFrame, keys: list[str], since) -> DataFrame:
    """Keys touched since the last refresh.

    Rows created later count as they are; the guards apply to updated rows
    only. NULL keys are dropped, as no summary row exists for them.
    """
    since = since if isinstance(since, Column) else F.lit(since).cast("timestamp")
    guards = (F.col("trip_duration_minutes") > 0) & (F.col("eta_data_status") == "available")
    for k in keys:
        guards = guards & F.col(k).isNotNull()
    return (
        trips.filter((F.col("dt_created") > since) | ((F.col("dt_updated") > since) & guards))
        .select(*keys).distinct().dropna(subset=keys)
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
