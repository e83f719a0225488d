"""Windows over each driver's latest trips, safe for a driver with a large share of all trips."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trips as T
from ..functions.numeric import rnd
from .paging import spread_rank, top_per
from .quantiles import exact_quantile

NO = "dispatch_entry_no"
LENGTH = 10
CHUNK = 20000
SEQUENCE_FEATURES = ["trip_duration_minutes", "trip_km", "avg_speed_kmph", "eta_delay_minutes", "hour", "day_of_week", "is_weekend"]
DECAYS = [0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def numbered(rows: DataFrame, key: str, time: str, tie: str, name: str = "n") -> DataFrame:
    """Position of each row within its key in time order, numbered day by day."""
    return spread_rank(rows, [key], F.to_date(time), [time, tie], name)


def lookback(rows: DataFrame, key: str, columns: list[str], length: int = LENGTH, position: str = "n") -> DataFrame:
    """Adds 'past': the last 'length' rows before each row, oldest first, as structs.

    Keys are cut into chunks of CHUNK rows; the last rows of a chunk are
    repeated at the head of the next one, so every window is complete.
    """
    chunk = F.floor((F.col(position) - 1) / CHUNK)
    near_end = (F.col(position) - 1) % CHUNK >= CHUNK - length
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = rows.withColumn("_copy", F.explode(copies)).withColumn("_chunk", chunk + F.col("_copy"))
    w = Window.partitionBy(key, "_chunk").orderBy(position).rowsBetween(-length, -1)
    return spread.withColumn("past", F.collect_list(F.struct(*columns)).over(w)).filter("_copy = 0").drop("_copy", "_chunk")


def sequence_input(trips: DataFrame) -> DataFrame:
    """Trips per driver in time order; no availability filter."""
    rows = trips.filter((F.col("trip_duration_minutes") > 0) & (F.col("trip_duration_minutes") < 50000) & F.col("trip_start").isNotNull() & F.col("driver_id").isNotNull())
    start = F.col("trip_start")
    rows = rows.select("driver_id", NO, "trip_start", "origin_id", "destination_id", *[F.col(c).cast("double") for c in SEQUENCE_FEATURES[:4]],
                       F.hour(start).alias("hour"), F.weekday(start).alias("day_of_week"), T.is_weekend(start).alias("is_weekend"))
    return numbered(rows, "driver_id", "trip_start", NO)


def trip_sequences(rows: DataFrame) -> DataFrame:
    """Ten past trips as standardised features, the next duration as target. rows: sequence_input, stored."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SEQUENCE_FEATURES}
    stats = rows.select([c.alias(n) for n, c in filled.items()]).agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in SEQUENCE_FEATURES]).alias("st")).scalar()
    z = {f"z_{c}": (x - stats[c]["m"]) / F.when(stats[c]["s"] == 0, F.lit(1.0)).otherwise(F.coalesce(stats[c]["s"], F.lit(1.0))) for c, x in filled.items()}
    out = lookback(rows.withColumns(z), "driver_id", [f"z_{c}" for c in SEQUENCE_FEATURES])
    return out.filter(F.size("past") == LENGTH).select("driver_id", NO, "n", "past", F.col("trip_duration_minutes").alias("target"))


def sequential_split(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds is_train for the first share of rows in (driver, time) order, without a global sort.

    The driver at the cut is found as a quantile; only inside that driver
    does the position decide, so only that driver's rows are numbered.
    """
    size = rows.agg(F.count(F.lit(1)).alias("c")).scalar()
    cut = F.floor(size * F.lit(share))
    near_cut = F.floor(F.lit(exact_quantile(rows, "driver_id", share)).cast("double"))  # at the cut row's driver, or between it and the next one
    per_driver = rows.groupBy("driver_id").agg(F.count(F.lit(1)).alias("_c"))
    near = per_driver.agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("driver_id") < near_cut, F.col("_c"))), F.lit(0)).alias("below"),
        F.min(F.when(F.col("driver_id") >= near_cut, F.col("driver_id"))).alias("id")).alias("x")).scalar()
    inside = cut - near["below"]
    others = rows.filter(F.col("driver_id") != near["id"]).withColumn("is_train", F.when(F.col("driver_id") < near["id"], 1).otherwise(0))
    placed = numbered(rows.filter(F.col("driver_id") == near["id"]), "driver_id", "trip_start", NO, "_pos")
    return others.unionByName(placed.withColumn("is_train", F.when(F.col("_pos") <= inside, 1).otherwise(0)).drop("_pos"))


def decay_inputs(rows: DataFrame) -> DataFrame:
    """Weighted means of the last ten durations for each decay, with the next duration as target."""
    past = lookback(rows.select("driver_id", NO, "trip_start", "n", "trip_duration_minutes"), "driver_id", ["trip_duration_minutes"])
    past = past.filter(F.size("past") == LENGTH)
    cols = {}
    for k, decay in enumerate(DECAYS):
        weights = [decay ** (LENGTH - 1 - j) for j in range(LENGTH)]
        total = None
        for j, w in enumerate(weights):
            part = F.col("past")[j]["trip_duration_minutes"] * (w / sum(weights))
            total = part if total is None else total + part
        cols[f"w{k}"] = total
    return past.withColumns(cols).select("driver_id", NO, "trip_start", "n", F.col("trip_duration_minutes").alias("target"), *cols)


def decay_predictor(train: DataFrame) -> DataFrame:
    """Slope, intercept and mean error per decay; 'chosen' marks the smallest error. train: stored decay_inputs."""
    fits = train.agg(F.struct(*[
        F.struct(F.regr_slope("target", f"w{k}").alias("a"), F.regr_intercept("target", f"w{k}").alias("b")).alias(f"f{k}") for k in range(len(DECAYS))]).alias("f")).scalar()
    mae = train.agg(*[F.avg(F.abs(F.col("target") - (F.col(f"w{k}") * fits[f"f{k}"]["a"] + fits[f"f{k}"]["b"]))).alias(f"m{k}") for k in range(len(DECAYS))])
    mae = mae.withColumn("f", fits)
    parts = ", ".join(f"{decay}D, f.f{k}.a, f.f{k}.b, m{k}" for k, decay in enumerate(DECAYS))
    out = mae.selectExpr(f"least({', '.join(f'm{k}' for k in range(len(DECAYS)))}) as _best", f"stack({len(DECAYS)}, {parts}) as (decay, slope, intercept, mae)")
    return out.select("decay", "slope", "intercept", "mae", F.when(F.col("mae") == F.col("_best"), 1).otherwise(0).alias("chosen"))


def decay_forecast(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Next duration per driver from the last ten trips, with an interval from the last five. fit: decay_predictor.

    A shorter history is padded with zeros at its beginning: it has the
    length and the weights of ten trips, and the zeros among the last five
    widen the interval.
    """
    best = fit.filter("chosen = 1").agg(F.max(F.struct("decay", "slope", "intercept")).alias("b")).scalar()
    last = top_per(rows.select("driver_id", "n", "trip_duration_minutes"), ["driver_id"], [F.desc("n")], LENGTH, rank="_k")
    weight = F.pow(best["decay"], F.col("_k") - 1)
    all_weights = sum((F.pow(best["decay"], F.lit(k)) for k in range(LENGTH)), F.lit(0.0))
    out = last.groupBy("driver_id").agg(
        F.lit(LENGTH).cast("bigint").alias("sequence_length_used"), (F.sum(weight * F.col("trip_duration_minutes")) / all_weights).alias("_w"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= 5, F.col("trip_duration_minutes").cast("double")))).alias("_last"))
    padded = F.concat("_last", F.array_repeat(F.lit(0.0), 5 - F.size("_last")))
    added = lambda a, x: a + x
    out = out.withColumn("_last", padded).withColumn("_m", F.aggregate("_last", F.lit(0.0), added) / 5)
    out = out.withColumn("_sd", F.sqrt(F.aggregate(F.transform("_last", lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), added) / 5))
    p = F.greatest(F.lit(0.0), F.col("_w") * best["slope"] + best["intercept"])
    return out.select("driver_id", "sequence_length_used", rnd(p).alias("predicted_duration_min"),
                      rnd(F.greatest(F.lit(0.0), p - 1.96 * F.col("_sd"))).alias("lower"), rnd(p + 1.96 * F.col("_sd")).alias("upper"))
