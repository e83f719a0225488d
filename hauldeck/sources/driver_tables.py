"""Fleet tables derived from the given star-schema Parquet files.

The given files hold order lines, not trips; FIXTURES.md defines how each
line becomes one raw trip row, each event one waypoint, and so on.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loading

# Columns that decide which row of a duplicate group comes first.
FIRST_ROW_ORDER = ["vehicle_id", "driver_id", "l_quantity", "l_extendedprice", "l_shipdate"]
# The same columns under their given names.
FIRST_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(c):
    return F.make_dt_interval(mins=c.cast("int"))


# The columns that name a trip: its dispatch number is made of them, one to one.
NUMBERED_BY = ["l_orderkey", "l_linenumber"]


def trip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with what a trip needs of their order, customer and supplier.

    Lines are dealt by order once, before anything is joined to them: the joins
    that follow add columns where the line already is, and so does the search
    for repeated lines. Customers meet orders, of which there are fewer.
    """
    line, orders = given(spark, sf_dir, "lineitem"), given(spark, sf_dir, "orders")
    customer, supplier = given(spark, sf_dir, "customer"), given(spark, sf_dir, "supplier")
    nation = given(spark, sf_dir, "nation")
    from_nation = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin"))
    to_nation = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("destination"))
    lines = line.select(*NUMBERED_BY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").repartition("l_orderkey")
    booked = (
        orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        .join(customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .drop("c_custkey")
    )
    return (
        lines.join(booked, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(from_nation, "s_nationkey")
        .join(to_nation, "c_nationkey")
    )


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_trips(trip_lines(spark, sf_dir))


def first_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw trips that come first under their dispatch number, found on the lines before they are widened."""
    return as_trips(loading.first_rows(trip_lines(spark, sf_dir).filter(F.col("l_linenumber").isNotNull()), NUMBERED_BY, FIRST_LINE_ORDER))


def as_trips(rows: DataFrame) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")
    rows = rows.withColumns({"k": k, "plan_min": (F.col("l_quantity") * 36).cast("bigint") + 60})
    kk = F.col("k")
    rows = rows.withColumns({
        "trip_start": (
            F.col("o_orderdate").cast("timestamp")
            + F.make_dt_interval(days=F.lit(8750))
            + _minutes(F.when(kk % 11 == 0, F.lit(300)).otherwise(kk % 1440))
        ),
        "dur": (
            F.when(kk % 101 == 0, F.lit(-30)).when(kk % 103 == 0, F.lit(0)).when(kk % 107 == 0, F.lit(20000))
            .otherwise(F.col("plan_min") + kk % 241 - 120)
        ),
    })
    rows = rows.withColumn("trip_end_raw", F.col("trip_start") + _minutes(F.col("dur")))
    return rows.select(
        F.concat(F.lit("D"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        .alias("dispatch_entry_no"),
        F.col("l_suppkey").alias("driver_id"),
        F.col("s_name").alias("driver_name"),
        F.concat(F.lit("9"), F.col("l_suppkey").cast("string")).alias("driver_mobile"),
        F.col("l_partkey").alias("vehicle_id"),
        F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("asset_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("s_nationkey").cast("bigint").alias("origin_id"),
        "origin",
        F.col("c_nationkey").cast("bigint").alias("destination_id"),
        "destination",
        "trip_start",
        "trip_end_raw",
        F.when(kk % 7 != 0, F.col("trip_end_raw")).alias("ata_in"),
        (F.col("trip_start") + _minutes(F.col("plan_min") + 30)).alias("trip_eta"),
        F.col("trip_start").alias("dt_created"),
        (F.col("trip_start") + F.make_dt_interval(days=(kk % 5).cast("int"))).alias("dt_updated"),
        F.when(kk % 17 == 0, None).when(kk % 19 == 0, 0.0).when(kk % 29 == 0, F.col("l_quantity") * 200)
        .otherwise(F.col("l_quantity") * 20).alias("trip_km"),
        F.when(F.col("o_orderstatus") == "F", "C").when(F.col("o_orderstatus") == "O", "O").alias("trip_status"),
        (F.col("l_extendedprice") / 10).cast("decimal(12,3)").alias("load_weight_kg"),
        "l_quantity", "l_extendedprice", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
    )


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("9"), F.col("s_suppkey").cast("string")).alias("mobile1"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("asset_id"),
        F.col("p_type").alias("asset_type"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("cne_name"))


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.trips import status_speed

    kind = F.col("event_type")
    status = (
        F.when(kind.isin("view", "click"), F.concat(F.lit("Moving "), F.floor("value").cast("int").cast("string")))
        .when(kind == "error", "Stopped").otherwise("Idle")
    )
    return given(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("vehicle_id"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
        status.alias("status"),
        status_speed(status).cast("decimal(8,2)").alias("speed_kmph"),
        F.round((F.col("value") / 10).cast("decimal(38,10)"), 2).cast("decimal(10,2)").alias("distance_from_prev"),
    )


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.to_date(F.col("ts").cast("timestamp")).alias("date"),
        F.round(F.col("value").cast("decimal(38,10)"), 2).cast("decimal(12,2)").alias("amount"),
        F.col("event_type").alias("category"),
    )


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts; the class is made of the two 0/1 labels."""
    labels = given(spark, sf_dir, "labels")
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("text").alias("query"),
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("agent"),
    )
