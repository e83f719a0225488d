"""Registered queries: sources, column functions, loading, summary tables."""

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import trips as T
from ..functions.numeric import rnd
from ..operators import loading as L
from ..operators import partials as P
from ..operators import summaries as S
from ..sources import exports, scans
from ..sources.driver_tables import FIRST_ROW_ORDER
from .sqltext import CTE, RELIABLE, avg2, d, davg, day, i, r, share, ts

ENTRIES = {}


def add(key, build, sql=None):
    ENTRIES[key] = (build, sql)


# ---------------------------------------------------------------- sources
# Export columns in the current wording, as text.
def export_rows(fleet, older=False):
    raw = fleet.raw
    t = lambda c: F.date_format(c, "dd-MM-yyyy HH:mm:ss")
    text = lambda c: F.col(c).cast("string")
    if older:
        return raw.select(
            F.col("dispatch_entry_no").alias("i_trip_no"), F.col("driver_name").alias("s_driver_name"),
            F.col("driver_mobile").alias("s_driver_mobile_no"), F.col("asset_id").alias("s_asset_id"),
            F.col("origin").alias("s_org_node_name"), F.col("destination").alias("s_dest_node_name"),
            F.col("customer_name").alias("s_cust_login_id"), t("trip_start").alias("dt_trip_start"),
            t("trip_end_raw").alias("dt_trip_end"), t("trip_eta").alias("dt_trip_eta"), t("ata_in").alias("dt_trip_ata"),
            text("trip_km").alias("i_trip_km"), F.col("trip_status").alias("c_trip_status"),
        )
    return raw.select(
        F.col("dispatch_entry_no").alias("s_dispatch_entry_no"), F.col("driver_name").alias("s_driver_name"),
        F.col("driver_mobile").alias("s_driver_mob1"), F.col("asset_id").alias("s_asset_id"),
        F.col("origin").alias("s_origin"), F.col("destination").alias("s_destination"),
        F.col("customer_name").alias("s_cnr_name"), t("trip_start").alias("dt_trip_start"),
        t("trip_end_raw").alias("dt_trip_end"), t("trip_eta").alias("dt_trip_eta"), t("ata_in").alias("dt_ata_in"),
        text("trip_km").alias("i_trip_km"), F.col("trip_status").alias("c_trip_status"),
    )


def csv_folder(fleet, name, build):
    """Writes a CSV export of the fleet's own rows once and gives its folder."""
    path = f"{fleet.folder}/{name}"
    if name not in fleet.exports:
        build(path)
        fleet.exports.add(name)
    return path


def current_export(fleet):
    return csv_folder(fleet, "export_current", lambda p: export_rows(fleet).write.option("header", True).csv(p))


def two_exports(fleet):
    def write(p):
        # rows with an even line number in the current wording, the others in the older one
        is_even = lambda c: F.substring_index(F.col(c), "-", -1).cast("int") % 2 == 0
        export_rows(fleet).filter(is_even("s_dispatch_entry_no")).write.option("header", True).csv(f"{p}/new")
        export_rows(fleet, older=True).filter(~is_even("i_trip_no")).write.option("header", True).csv(f"{p}/old")

    return csv_folder(fleet, "export_two", write)


EVEN = "cast(split_part(dispatch_entry_no,'-',2) as int)%2=0"
DMY = lambda c: f"strftime({c},'%d-%m-%Y %H:%M:%S')"
add("trip_csv_scan", lambda f: scans.trip_csv_scan(f.spark, current_export(f)),
    f"""select dispatch_entry_no as s_dispatch_entry_no, driver_name as s_driver_name, driver_mobile as s_driver_mob1, asset_id as s_asset_id, origin as s_origin, destination as s_destination, customer_name as s_cnr_name,
 {DMY('trip_start')} as dt_trip_start, {DMY('trip_end_raw')} as dt_trip_end, {DMY('trip_eta')} as dt_trip_eta, {DMY('ata_in')} as dt_ata_in, cast(cast(trip_km as double) as varchar) as i_trip_km, trip_status as c_trip_status from raw""")
add(
    "multi_file_scan",
    lambda f: scans.multi_file_scan(f.spark, two_exports(f)).groupBy(
        "s_origin", "s_org_node_name", "s_driver_mob1", "s_driver_mobile_no", "c_trip_status"
    ).agg(F.count(F.lit(1)).alias("n"), F.max("s_dispatch_entry_no").alias("last_no"), F.max("i_trip_no").alias("last_trip_no")),
    f"""select case when {EVEN} then origin end as s_origin, case when not ({EVEN}) then origin end as s_org_node_name,
 case when {EVEN} then driver_mobile end as s_driver_mob1, case when not ({EVEN}) then driver_mobile end as s_driver_mobile_no, trip_status as c_trip_status,
 count(*) as n, max(case when {EVEN} then dispatch_entry_no end) as last_no, max(case when not ({EVEN}) then dispatch_entry_no end) as last_trip_no
 from raw group by 1,2,3,4,5""",
)


FILES_PER_TASK = 256


def waypoint_export(fleet):
    """One folder per vehicle. What a task costs is its files, not its bytes, so tasks are counted by vehicles."""
    def write(p):
        w = fleet.waypoints
        v = fleet.vehicles.select(F.col("id").alias("vehicle_id"), F.col("asset_id").alias("Waypoint"))
        parts = w.select("vehicle_id").distinct().count() // FILES_PER_TASK + 1
        (
            w.join(v, "vehicle_id").select(
                "Waypoint", F.date_format("recorded_at", "dd-MM-yyyy HH:mm:ss").alias("Date Time"),
                F.col("distance_from_prev").cast("string").alias("Distance"), F.col("status").alias("Status"),
            ).repartition(parts, "Waypoint").write.partitionBy("Waypoint").option("header", True).csv(p)
        )

    return csv_folder(fleet, "export_waypoints", write)


add("waypoint_scan", lambda f: scans.waypoint_scan(f.spark, waypoint_export(f)),
    f"""select v.asset_id, {ts('recorded_at')} as recorded_at, status, {d('speed_kmph')} as speed_kmph, {d('distance_from_prev')} as distance_from_prev, cast(null as double) as latitude, cast(null as double) as longitude, cast(null as varchar) as location_text
 from waypoints w join vehicles v on w.vehicle_id=v.id""")
# vehicles whose number is no multiple of three are known; the others are known from the waypoint files only
add("waypoint_new_vehicles", lambda f: scans.new_vehicles(scans.waypoint_scan(f.spark, waypoint_export(f)), f.vehicles.filter("id % 3 <> 0")),
    "select distinct v.asset_id from waypoints w join vehicles v on w.vehicle_id=v.id where v.id%3=0 and w.recorded_at is not null")
add("pruned_scan", lambda f: scans.pruned_scan(f.given("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]),
    "select o_orderkey, o_custkey, o_orderstatus from orders")
add(
    "column_variant_resolve",
    lambda f: scans.typed_trips(scans.column_variant_resolve(scans.multi_file_scan(f.spark, two_exports(f)))).select(
        "dispatch_entry_no", "driver_name", "driver_mobile", "origin", "destination", "cust_login_id", "trip_start", "ata_in", "trip_km"),
    f"""select dispatch_entry_no, driver_name, case when {EVEN} then driver_mobile end as driver_mobile, case when {EVEN} then origin end as origin,
 case when {EVEN} then destination end as destination, case when {EVEN} then customer_name end as cust_login_id, {ts('trip_start')} as trip_start,
 case when {EVEN} then {ts('ata_in')} end as ata_in, cast(trip_km as double) as trip_km from raw""",
)
def profile_input(f):
    """Raw rows with an empty column, a constant one, and one that is constant where it is set."""
    return f.raw.withColumns({"trailer_type": F.lit(None).cast("string"), "is_active": F.lit("1"), "closed": F.when(F.col("trip_status") == "C", "C")})


CTE["prof"] = "select *, cast(null as varchar) as trailer_type, '1' as is_active, case when trip_status='C' then 'C' end as closed from raw"
RAW_COLUMNS = ["dispatch_entry_no", "driver_id", "driver_name", "driver_mobile", "vehicle_id", "asset_id", "customer_id", "customer_name", "origin_id", "origin", "destination_id", "destination", "trip_start",
               "trip_end_raw", "ata_in", "trip_eta", "dt_created", "dt_updated", "trip_km", "trip_status", "load_weight_kg", "l_quantity", "l_extendedprice", "l_shipdate", "trailer_type", "is_active", "closed"]
add("dead_column_profile", lambda f: scans.dead_columns(profile_input(f)), " union all ".join(f"select '{c}' as column_name from prof having count({c})=0 or count(distinct {c})=1" for c in RAW_COLUMNS))


# The raw columns' types.
RAW_TYPES = {"bigint": ["driver_id", "vehicle_id", "customer_id", "origin_id", "destination_id"], "double": ["trip_km", "l_quantity", "l_extendedprice"], "decimal(12,3)": ["load_weight_kg"],
             "timestamp": ["trip_start", "trip_end_raw", "ata_in", "trip_eta", "dt_created", "dt_updated", "l_shipdate"]}


def _profile_sql():
    kinds = {c: kind for kind, columns in RAW_TYPES.items() for c in columns}
    parts = []
    for c in RAW_COLUMNS[:-3]:
        kind, x = kinds.get(c, "string"), f"cast({c} as double)"
        nums = [f"avg({x})", f"stddev_samp({x})", f"min({x})", f"max({x})"] if kind in ("bigint", "double", "decimal(12,3)") else ["cast(null as double)"] * 4
        parts.append(
            f"select '{c}' as column_name, '{kind}' as data_type, count(*) as row_count, {i(f'sum(case when {c} is null then 1 else 0 end)')} as null_count,"
            f" {r(nums[0], 4)} as mean, {r(nums[1], 4)} as std, {nums[2]} as min, {nums[3]} as max from raw")
    return " union all ".join(parts)


add(
    "column_profile",
    lambda f: scans.column_profile(f.raw.select(RAW_COLUMNS[:-3])).withColumns({"mean": rnd("mean", 4), "std": rnd("std", 4)}),
    _profile_sql(),
)
add(
    "head_export", lambda f: f.spark.read.schema("dispatch_entry_no string, driver_id bigint, trip_start timestamp").option("header", True).csv(
        csv_folder(f, "head", lambda p: exports.head_export(f.trips.select("dispatch_entry_no", "driver_id", "trip_start"), p, ["dispatch_entry_no"], 100))),
    f"select dispatch_entry_no, driver_id, {ts('trip_start')} as trip_start from trips order by dispatch_entry_no limit 100",
)
add(
    "table_counts",
    lambda f: scans.table_counts(f.spark, {
        "drivers": f.drivers, "vehicles": f.vehicles, "locations": f.locations, "customers": f.customers, "trips": f.trips,
        "waypoints": f.waypoints, "driver_summary": f.driver_summary, "route_summary": f.route_summary,
        "vehicle_summary": f.vehicle_summary, "daily_fleet_stats": f.daily_fleet_stats, "route_time_patterns": f.route_time_patterns,
        "file_uploads": lambda: f.given("file_uploads"),
    }),
    " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in (
        "drivers", "vehicles", "locations", "customers", "trips", "waypoints", "driver_summary", "route_summary", "vehicle_summary",
        "daily_fleet_stats", "route_time_patterns")) + " union all select 'file_uploads', cast(-1 as bigint)",
)
add(
    "readiness_check", lambda f: scans.readiness_check(f.spark, f.trips, f.driver_summary, f.route_summary),
    f"""select *, cast(case when trips_with_duration>=100 and driver_summary>=10 and route_summary>=10 then 1 else 0 end as bigint) as ready from (
 select count(*) as trips, {i('sum(case when trip_duration_minutes>0 then 1 else 0 end)')} as trips_with_duration,
 (select count(*) from driver_summary) as driver_summary, (select count(*) from route_summary) as route_summary from trips)""",
)


def bulk_file(f):
    path = csv_folder(f, "bulk", lambda p: exports.bulk_export(f.trips, p))
    return f.spark.read.schema(", ".join(f"`{c}` string" for c in exports.BULK_COLUMNS)).option("sep", "\t").option("nullValue", exports.NULL_MARK).csv(path)


BULK_TIMES = ("trip_start", "trip_end", "trip_eta", "ata_in", "dt_created", "dt_updated")
add("bulk_export", bulk_file, "select " + ", ".join(
    f"cast(null as varchar) as {c}" if c not in L.FACT_COLUMNS else f"{ts(c)} as {c}" if c in BULK_TIMES else f"cast({c} as varchar) as {c}" for c in exports.BULK_COLUMNS) + " from trips")


def naive_predictions(f):
    """Route mean as the predicted duration."""
    route = f.route_summary.select("origin_id", "destination_id", "origin", "destination", F.col("avg_duration_min").alias("predicted_duration_minutes"))
    return S.reliable(f.trips).join(route, ["origin_id", "destination_id"])


def report_file(f):
    path = csv_folder(f, "report", lambda p: exports.report_export(naive_predictions(f), p))
    return f.spark.read.option("header", True).csv(path)


CTE["reported"] = """select t.dispatch_entry_no, t.trip_start, s.origin, s.destination, t.ata_in, s.avg_duration_min as p, cast(t.trip_duration_minutes as double) as y,
 t.trip_start+to_microseconds(cast(round(s.avg_duration_min*60000000) as bigint)) as arrival from rel t join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id"""
add("report_export", lambda f: report_file(f).select(
        "dispatch_entry_no", F.to_timestamp("trip_start").alias("trip_start"), "origin", "destination", F.to_timestamp("actual_arrival_ata_in").alias("actual_arrival_ata_in"), F.to_timestamp("predicted_arrival").alias("predicted_arrival"),
        F.col("predicted_duration_minutes").cast("double").alias("predicted_duration_minutes"), F.col("actual_duration_minutes").cast("double").alias("actual_duration_minutes"), rnd(F.col("error_hours").cast("double"), 6).alias("error_hours"),
        F.col("within_2h").cast("boolean").alias("within_2h"), F.col("within_1h").cast("boolean").alias("within_1h")),
    f"""select dispatch_entry_no, {ts('trip_start')} as trip_start, origin, destination, {ts('ata_in')} as actual_arrival_ata_in, {ts('arrival')} as predicted_arrival, p as predicted_duration_minutes, y as actual_duration_minutes, {r('e', 6)} as error_hours,
 cast(e<=2 as int)::bigint as within_2h, cast(e<=1 as int)::bigint as within_1h from (select *, abs(cast(epoch_us(arrival)-epoch_us(ata_in) as double))/3.6e9 as e from reported)""")
add("quoted_export", lambda f: f.spark.read.option("header", True).csv(csv_folder(f, "quoted", lambda p: exports.quoted_export(f.route_summary, p))),
    "select columns(*)::varchar from route_summary")

# ---------------------------------------------------------------- column functions
# Awkward texts made from the order comments of each line number; both engines build the same.
DIRTY = "case l_linenumber when 1 then concat('  ',s_name,' ') when 2 then 'nan' when 3 then ' NA ' when 4 then '' when 5 then 'None' when 6 then s_name else null end"
DIRTY_MOBILE = """case l_linenumber when 1 then concat('9',l_suppkey,'.0') when 2 then concat('98.0',l_partkey) when 3 then concat('+91 98-',l_partkey) when 4 then '0'
 when 5 then ' 0.0' when 6 then 'NaT' else concat(l_suppkey,'.05.0') end"""
DIRTY_NUMBER = "case l_linenumber when 1 then concat(l_quantity,'') when 2 then 'inf' when 3 then 'NaN' when 4 then 'abc' when 5 then concat('-',l_partkey,'.9') when 6 then '' else concat(l_partkey,'.5') end"
CTE["dirty"] = f"select l_orderkey, l_partkey, l_linenumber, l_suppkey, {DIRTY} as txt, {DIRTY_MOBILE} as mob, {DIRTY_NUMBER} as num, l_shipdate from lineitem join supplier on l_suppkey=s_suppkey"


def dirty(f):
    rows = f.given("lineitem").join(f.given("supplier"), F.expr("l_suppkey = s_suppkey"))
    return rows.selectExpr("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", f"{DIRTY} as txt", f"{DIRTY_MOBILE} as mob", f"{DIRTY_NUMBER} as num", "l_shipdate")


LINE = ["l_orderkey", "l_partkey", "l_linenumber"]
LINE_SQL = "l_orderkey, l_partkey, cast(l_linenumber as bigint) as l_linenumber"
SQL_CLEAN = lambda c: f"case when trim({c}) in ('','nan','None','NaN','NaT','NA','na') then null else trim({c}) end"
SQL_DIGITS = lambda c: f"case when regexp_replace({c},'[^0-9+]','','g') in ('','0') then null else regexp_replace({c},'[^0-9+]','','g') end"
add("clean_str", lambda f: dirty(f).select(*LINE, C.clean_str(F.col("txt")).alias("cleaned")), f"select {LINE_SQL}, {SQL_CLEAN('txt')} as cleaned from dirty")
add("clean_mobile", lambda f: dirty(f).select(*LINE, C.clean_mobile(F.col("mob")).alias("cleaned")),
    f"select {LINE_SQL}, {SQL_DIGITS('x')} as cleaned from (select *, replace({SQL_CLEAN('mob')},'.0','') as x from dirty)")
add("clean_mobile_suffix", lambda f: dirty(f).select(*LINE, C.clean_mobile_suffix(F.col("mob")).alias("cleaned")),
    f"select {LINE_SQL}, {SQL_DIGITS('x')} as cleaned from (select *, regexp_replace({SQL_CLEAN('mob')},'\\.0$','') as x from dirty)")
_MIX = {
    1: ("dd-MM-yyyy HH:mm:ss", "%d-%m-%Y %H:%M:%S"), 2: ("dd/MM/yyyy HH:mm:ss", "%d/%m/%Y %H:%M:%S"),
    3: ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), 4: ("dd-MM-yyyy", "%d-%m-%Y"), 5: ("yyyy-MM-dd", "%Y-%m-%d"),
}


def _date_texts(f):
    x = F.when(F.lit(False), "")
    for n, (p, _) in _MIX.items():
        x = x.when(F.col("l_linenumber") == n, F.date_format("l_shipdate", p))
    return dirty(f).select(*LINE, C.parse_datetime(x.otherwise("not a date")).alias("parsed"))


add("parse_datetime", _date_texts, f"select {LINE_SQL}, case when l_linenumber between 1 and 5 then {ts('l_shipdate')} end as parsed from dirty")
SQL_NUM = "case when try_cast(num as double) is null or isnan(try_cast(num as double)) or isinf(try_cast(num as double)) then null else try_cast(num as double) end"
add("safe_float", lambda f: dirty(f).select(*LINE, C.safe_float(F.col("num")).alias("value")), f"select {LINE_SQL}, {SQL_NUM} as value from dirty")
add("safe_int", lambda f: dirty(f).select(*LINE, C.safe_int(F.col("num")).alias("value")), f"select {LINE_SQL}, cast(trunc({SQL_NUM}) as bigint) as value from dirty")

NO = "dispatch_entry_no"
raw_key = [NO, "vehicle_id", "driver_id", "l_quantity"]
RAWK = "dispatch_entry_no, vehicle_id, driver_id, l_quantity"


def raw_figures(f):
    return L.with_trip_figures(f.raw)


CTE["raw_end"] = "select *, coalesce(ata_in, trip_end_raw) as trip_end from raw"
SQL_MIN = lambda a, b: f"cast({r(f'cast(epoch_us({b})-epoch_us({a}) as double)/60000000')} as double)"
add("trip_end_pick", lambda f: f.raw.select(*raw_key, T.trip_end_pick(F.col("ata_in"), F.col("trip_end_raw")).alias("trip_end")),
    f"select {RAWK}, {ts('trip_end')} as trip_end from raw_end")
add("eta_data_status", lambda f: f.raw.select(*raw_key, T.eta_data_status(F.col("ata_in")).alias("eta_data_status")),
    f"select {RAWK}, case when ata_in is null then 'eta_data_unavailable' else 'available' end as eta_data_status from raw")
add("trip_duration_minutes", lambda f: raw_figures(f).select(*raw_key, "trip_duration_minutes"),
    f"select {RAWK}, case when trip_end>=trip_start then {SQL_MIN('trip_start', 'trip_end')} end as trip_duration_minutes from raw_end")
add("eta_met", lambda f: raw_figures(f).select(*raw_key, "eta_met"), f"select {RAWK}, cast(trip_end<=trip_eta as bigint) as eta_met from raw_end")
add("eta_delay", lambda f: raw_figures(f).select(*raw_key, "eta_delay_minutes"),
    f"select {RAWK}, greatest({SQL_MIN('trip_eta', 'trip_end')},0.0) as eta_delay_minutes from raw_end")
add("avg_speed_kmph", lambda f: raw_figures(f).select(*raw_key, T.avg_speed(F.col("trip_km"), F.col("trip_duration_minutes")).alias("avg_speed_kmph")),
    f"""select {RAWK}, case when trip_km<>0 and m>0 then {r('trip_km/(m/60)')} end as avg_speed_kmph from
 (select *, case when trip_end>=trip_start then {SQL_MIN('trip_start', 'trip_end')} end as m from raw_end)""")
add("is_5am_default", lambda f: f.raw.select(*raw_key, T.is_5am_default(F.col("trip_start")).alias("is_5am_default")),
    f"select {RAWK}, cast(strftime(trip_start,'%H:%M:%S')='05:00:00' as bigint) as is_5am_default from raw")
add("status_speed", lambda f: f.waypoints.select("id", "status", T.status_speed(F.col("status")).alias("speed"), T.status_speed(F.col("status"), True).alias("speed_bulk")),
    "select id, status, case when status like 'Moving%' then cast(substr(status,8) as double) when status='Stopped' then 0.0 end as speed,"
    " case when status like 'Moving%' then cast(substr(status,8) as double) else 0.0 end as speed_bulk from waypoints")


def _temporal(f):
    h, s = F.hour("trip_start"), F.col("trip_start")
    b = T.time_bucket(h)
    return f.trips.select(NO, h.alias("hour_of_day"), F.weekday(s).alias("day_of_week"), T.is_weekend(s).alias("is_weekend"),
                          F.month(s).alias("month"), b.alias("time_bucket"), T.time_bucket_code(b).alias("time_bucket_code"))


SQL_BUCKET = "case when h between 6 and 11 then 'morning' when h between 12 and 16 then 'afternoon' when h between 17 and 20 then 'evening' else 'night' end"
SQL_BCODE = "case when h between 6 and 11 then 0 when h between 12 and 16 then 1 when h between 17 and 20 then 2 else 3 end"
add("temporal_features", _temporal,
    f"""select dispatch_entry_no, {i('h')} as hour_of_day, {i('isodow(trip_start)-1')} as day_of_week, {i('case when isodow(trip_start)>=6 then 1 else 0 end')} as is_weekend,
 {i('month(trip_start)')} as month, {SQL_BUCKET} as time_bucket, {i(SQL_BCODE)} as time_bucket_code from (select *, hour(trip_start) as h from trips)""")
add("time_bucket_legacy", lambda f: f.trips.select(NO, T.time_bucket_legacy(F.hour("trip_start")).alias("bucket"), T.time_bucket_legacy_code(F.hour("trip_start")).alias("code")),
    f"""select dispatch_entry_no, case when h<=6 then 'night' when h<=12 then 'morning' when h<=18 then 'afternoon' else 'evening' end as bucket,
 {i('case when h<=6 then 0 when h<=12 then 1 when h<=18 then 2 else 3 end')} as code from (select *, hour(trip_start) as h from trips)""")
add("weekday_convert", lambda f: f.trips.select(NO, T.weekday_to_sql_day(F.weekday("trip_start")).alias("sql_day")), f"select dispatch_entry_no, {i('dayofweek(trip_start)+1')} as sql_day from trips")
add("night_flag", lambda f: f.trips.select(NO, T.night_flag(F.hour("trip_start")).alias("is_night")),
    f"select dispatch_entry_no, {i('case when hour(trip_start)>=22 or hour(trip_start)<=5 then 1 else 0 end')} as is_night from trips")
add("hour_deviation", lambda f: f.trips.select(NO, T.hour_deviation(F.hour("trip_start")).alias("deviation")),
    f"select dispatch_entry_no, {i('least(hour(trip_start),24-hour(trip_start))')} as deviation from trips")
add("period_label", lambda f: f.trips.select(NO, T.day_label(F.col("trip_start")).alias("day"), T.month_label(F.col("trip_start")).alias("month"), T.week_label(F.col("trip_start")).alias("week")),
    "select dispatch_entry_no, strftime(trip_start,'%Y-%m-%d') as day, strftime(trip_start,'%Y-%m') as month, concat(year(trip_start),'-W',lpad(cast(week(trip_start) as varchar),2,'0')) as week from trips")
add("minutes_truncated", lambda f: f.trips.select(NO, T.minutes_truncated(F.col("trip_start"), F.col("ata_in")).alias("minutes")),
    "select dispatch_entry_no, date_sub('minute',trip_start,ata_in) as minutes from trips")
SQL_RANGE = """case when {v}=0 then 'Stopped (0)' when {v} between 1 and 20 then 'Slow (1-20)' when {v} between 21 and 40 then 'Medium (21-40)'
 when {v} between 41 and 60 then 'Fast (41-60)' when {v} between 61 and 80 then 'Very Fast (61-80)' else 'Over 80' end"""
add("speed_range", lambda f: f.trips.filter("avg_speed_kmph is not null").select(NO, T.speed_range(F.col("avg_speed_kmph")).alias("speed_range")),
    f"select dispatch_entry_no, {SQL_RANGE.format(v='avg_speed_kmph')} as speed_range from trips where avg_speed_kmph is not null")
add("route_label", lambda f: S.name_routes(f.trips.select(NO, "origin_id", "destination_id"), f.locations, "left").select(
        NO, T.route_label(F.col("origin"), F.col("destination")).alias("route"), T.route_label(F.col("origin"), F.col("destination"), T.LEGACY_ARROW).alias("route_legacy")),
    "select dispatch_entry_no, concat(origin_name,' -> ',destination_name) as route, concat(origin_name,' → ',destination_name) as route_legacy from named")
add("bayesian_rate", lambda f: f.driver_summary.select(
        "driver_id", rnd(T.smoothed_rate(F.col("total_trips"), F.col("eta_success_rate"), 55.0, 15), 6).alias("k15"),
        rnd(T.smoothed_rate(F.col("total_trips"), F.col("eta_success_rate"), 55.0, 10), 6).alias("k10")),
    f"select driver_id, {r('(total_trips*eta_success_rate+15*55.0)/(total_trips+15)', 6)} as k15, {r('(total_trips*eta_success_rate+10*55.0)/(total_trips+10)', 6)} as k10 from driver_summary")
def V():
    return F.col("avg_speed_kmph").cast("double")


SQL_SPEED_LIST = "case when v between 20 and 40 then 100.0 when v<20 then greatest(0.0,v/20*100) else greatest(0.0,100-(v-40)*2.5) end"
SQL_SPEED_SCORER = "case when v<=45 then least(100.0,greatest(0.0,v/45*100)) else least(100.0,greatest(0.0,100-(v-45)/25*100)) end"
SQL_SPEED_REC = "case when v between 35 and 55 then 100.0 when v>0 then greatest(0.0,100-abs(v-45)*3) else 0.0 end"
add("speed_score", lambda f: f.vehicle_summary.select(
        "vehicle_id", rnd(T.speed_score_list(V()), 6).alias("list_score"), rnd(T.speed_score_scorer(V()), 6).alias("scorer_score"), rnd(T.speed_score_recommender(V()), 6).alias("recommender_score")),
    f"select vehicle_id, {r(SQL_SPEED_LIST, 6)} as list_score, {r(SQL_SPEED_SCORER, 6)} as scorer_score, {r(SQL_SPEED_REC, 6)} as recommender_score from (select vehicle_id, avg_speed_kmph as v from vehicle_summary)")
add("log_experience", lambda f: f.driver_summary.select("driver_id", rnd(T.log_experience(F.col("total_trips"), f.driver_summary.agg(F.max("total_trips")).scalar()), 6).alias("experience")),
    f"select driver_id, {r('least(100.0,ln(1+total_trips)/ln(1+(select max(total_trips) from driver_summary))*100)', 6)} as experience from driver_summary")
def MIN():
    return F.col("trip_duration_minutes")


SQL_DUR = """case when m<60 then concat(cast(round(m,0) as bigint),'m') when round(m-60*floor(m/60),0)>0 then
 concat(cast(floor(m/60) as bigint),'h ',cast(round(m-60*floor(m/60),0) as bigint),'m') else concat(cast(floor(m/60) as bigint),'h') end"""
add("duration_text", lambda f: f.trips.select(NO, T.duration_text(MIN()).alias("duration")), f"select dispatch_entry_no, {SQL_DUR} as duration from (select *, trip_duration_minutes as m from trips)")
add("rank_tier", lambda f: f.driver_summary.select("driver_id", T.rank_tier(F.col("eta_success_rate")).alias("tier")),
    "select driver_id, case when eta_success_rate>=80 then 'Platinum' when eta_success_rate>=60 then 'Gold' when eta_success_rate>=40 then 'Silver' else 'Bronze' end as tier from driver_summary")
add("arrival_time", lambda f: f.trips.select(NO, T.arrival_time(F.col("trip_start"), MIN()).alias("arrival")),
    f"select dispatch_entry_no, {ts('trip_start+to_microseconds(cast(round(trip_duration_minutes*60000000) as bigint))')} as arrival from trips")
PARTS = ["eta_success_rate", "avg_speed_kmph", "total_trips"]
add("json_pack", lambda f: f.driver_summary.select("driver_id", F.to_json(F.struct(*PARTS)).alias("parts")),
    "select driver_id, cast(to_json({'eta_success_rate': eta_success_rate, 'avg_speed_kmph': avg_speed_kmph, 'total_trips': total_trips}) as varchar) as parts from driver_summary")
add("json_unpack", lambda f: f.driver_summary.select("driver_id", F.to_json(F.struct(*PARTS)).alias("parts")).select(
        "driver_id", F.from_json("parts", "eta_success_rate double, avg_speed_kmph double, total_trips bigint").alias("p")).select("driver_id", "p.*"),
    "select driver_id, eta_success_rate, avg_speed_kmph, total_trips from driver_summary")
add("like_search", lambda f: f.vehicles.filter(C.like_search("e1", F.col("asset_id"), F.col("asset_type")) | C.like_search("ECON", F.col("asset_type"))),
    "select id, asset_id, asset_type from vehicles where asset_id ilike '%e1%' or asset_type ilike '%e1%' or asset_type ilike '%econ%'")

# ---------------------------------------------------------------- loading
add("trip_dedup", lambda f: L.trip_dedup(f.raw, FIRST_ROW_ORDER).select(*raw_key, "trip_start"), f"select {RAWK}, {ts('trip_start')} as trip_start from first_rows")


def sql_ids(key, source, cols, sort_key=None):
    k = sort_key or key
    return f"select cast(row_number() over (order by substr(md5({k}),1,3), {k}) as bigint) as id, {cols} from ({source})"


CTE["dim_d"] = sql_ids("", "select distinct driver_name as name, driver_mobile as mobile1, cast(null as varchar) as mobile2 from raw", "name, mobile1, mobile2", "concat(name,'|',coalesce(mobile1,''))")
CTE["dim_v"] = sql_ids("asset_id", "select asset_id, min(p_type) as asset_type from raw join part on vehicle_id=p_partkey group by 1", "asset_id, asset_type")
CTE["dim_l"] = sql_ids("name", "select origin as name from raw union select destination from raw", "name")
CTE["dim_c"] = sql_ids("cust_login_id", """select cust_login_id, cne_name from (select customer_name as cust_login_id, destination as cne_name,
 row_number() over (partition by customer_name order by dispatch_entry_no, vehicle_id, driver_id, l_quantity, l_extendedprice, l_shipdate) as rn from raw) where rn=1""", "cust_login_id, cne_name")
ROW_ORDER = ["dispatch_entry_no", *FIRST_ROW_ORDER]


def as_customers(raw):
    return raw.withColumns({"cust_login_id": F.col("customer_name"), "cne_name": F.col("destination")})


add("dim_drivers", lambda f: L.dim_drivers(f.raw_table), "select * from dim_d")
add("dim_vehicles", lambda f: L.dim_vehicles(f.raw_with_type, ROW_ORDER), "select * from dim_v")
add("dim_locations", lambda f: L.dim_locations(f.raw_table), "select * from dim_l")
add("dim_customers", lambda f: L.dim_customers(as_customers(f.raw_table), ROW_ORDER), "select * from dim_c")


def stored_dims(f):
    """Dimensions are loaded before the trips that refer to them."""
    return (
        f.stored("dim_drivers", lambda: L.dim_drivers(f.raw_table)), f.stored("dim_vehicles", lambda: L.dim_vehicles(f.raw_with_type, ROW_ORDER)),
        f.stored("dim_locations", lambda: L.dim_locations(f.raw_table)), f.stored("dim_customers", lambda: L.dim_customers(as_customers(f.raw_table), ROW_ORDER)))


add("fk_resolve", lambda f: L.fk_resolve(as_customers(f.first), *stored_dims(f)).select(NO, "driver_id", "vehicle_id", "origin_id", "destination_id", "customer_id"),
    """select dispatch_entry_no, dd.id as driver_id, dv.id as vehicle_id, lo.id as origin_id, ld.id as destination_id, dc.id as customer_id from first_rows r
 left join dim_d dd on r.driver_name=dd.name and r.driver_mobile=dd.mobile1 left join dim_v dv on r.asset_id=dv.asset_id
 left join dim_l lo on r.origin=lo.name left join dim_l ld on r.destination=ld.name left join dim_c dc on r.customer_name=dc.cust_login_id""")
add("route_avg_km", lambda f: L.route_avg_km(f.first), "select * from route_km")
add("km_fill", lambda f: L.km_fill(f.first, L.route_avg_km(f.first)).select(NO, rnd("trip_km").alias("trip_km")), f"select dispatch_entry_no, {r('trip_km')} as trip_km from screened")
add("trip_validate", lambda f: L.screened_trips(f.first).select(NO, "reject_reason"), "select dispatch_entry_no, reject_reason from screened")
add("outlier_cap", lambda f: L.outlier_cap(L.screened_trips(f.first).filter("reject_reason is null")).select(NO, "trip_km", "trip_duration_minutes", "avg_speed_kmph"),
    f"select dispatch_entry_no, {d('trip_km')} as trip_km, {d('trip_duration_minutes')} as trip_duration_minutes, {d('avg_speed_kmph')} as avg_speed_kmph from trips")
TIMES = ("trip_start", "trip_end", "trip_eta", "ata_in", "dt_created", "dt_updated")
NUMS = ("trip_km", "trip_duration_minutes", "eta_delay_minutes", "avg_speed_kmph", "load_weight_kg")
FACT_SQL = ", ".join(
    f"{ts(c)} as {c}" if c in TIMES else f"{d(c)} as {c}" if c in NUMS else f"{i(c)} as {c}" if c in ("eta_met", "is_5am_default") else c for c in L.FACT_COLUMNS)
add("trips_fact", lambda f: L.trips_fact(f.first), f"select {FACT_SQL} from trips")
add("trips_fact_unvalidated", lambda f: L.trips_fact(f.first, validate=False), f"select {FACT_SQL} from trips_loose")
add("reject_report", lambda f: L.reject_report(f.raw, f.first),
    "select coalesce(reject_reason,'accepted') as reason, count(*) as trips from screened group by 1 union all select 'no dispatch number', count(*) from raw where dispatch_entry_no is null")


def _unlinked(f):
    return f.trips.withColumns({"cnr_id": F.col("customer_id"), "customer_id": F.when(F.col("trip_status").isNotNull(), F.col("customer_id"))})


add("customer_backfill", lambda f: L.customer_backfill(_unlinked(f), f.customers.withColumn("cne_id", F.col("id"))).select(NO, "cnr_id", "customer_id"),
    "select dispatch_entry_no, customer_id as cnr_id, coalesce(case when trip_status is not null then customer_id end, c.id) as customer_id from trips t left join customers c on t.customer_id=c.id")
add("client_map", lambda f: L.client_map(f.raw.withColumns({"cnr_id": F.col("customer_id"), "cnr_name": F.col("customer_name")}), ROW_ORDER),
    "select customer_id as cnr_id, min(customer_name) as cnr_name from raw group by 1")
add("client_link_counts", lambda f: L.link_counts(_unlinked(f)),
    f"select count(trip_status) as linked, {i('sum(case when trip_status is null then 1 else 0 end)')} as unlinked from trips")
SINCE_DAYS = 30


def since(f):
    """Thirty days before the latest creation time."""
    return f.trips.agg((F.max("dt_created") - F.make_dt_interval(days=F.lit(SINCE_DAYS))).alias("since")).scalar()


SQL_SINCE = "(select max(dt_created) - to_days(30) from trips)"
SQL_CHANGED = f"(dt_created>{SQL_SINCE} or (dt_updated>{SQL_SINCE} and trip_duration_minutes>0 and eta_data_status='available'))"


def _changed(f):
    out = None
    for kind, keys in (("driver", ["driver_id"]), ("vehicle", ["vehicle_id"]), ("route", ["origin_id", "destination_id"])):
        rows = L.changed_entities(f.trips, keys, since(f)).select(
            F.lit(kind).alias("kind"), F.col(keys[0]).alias("id"), (F.col(keys[1]) if len(keys) > 1 else F.lit(None).cast("bigint")).alias("id2"))
        out = rows if out is None else out.unionByName(rows)
    return out


add("changed_entities", _changed,
    f"""select distinct 'driver' as kind, driver_id as id, cast(null as bigint) as id2 from trips where {SQL_CHANGED} union all
 select distinct 'vehicle', vehicle_id, null from trips where {SQL_CHANGED} union all select distinct 'route', origin_id, destination_id from trips where {SQL_CHANGED}""")


def _refreshed(f, partial):
    """The last refresh's state, brought up to date by the trips created or updated since; those it had seen go with their old version."""
    seen = f.trips.filter(F.col("dt_created") <= since(f))
    state = f.stored(f"state_{'_'.join(partial.names)}", lambda: P.state_of(seen, partial))
    again = F.col("dt_updated") > since(f)
    return P.refreshed(state, partial, f.trips.filter((F.col("dt_created") > since(f)) | again), seen.filter(again))


def _incremental(f):
    return P.driver_summary(_refreshed(f, P.DRIVER), f.drivers)


def _incremental_routes(f):
    return P.route_summary(_refreshed(f, P.ROUTE), f.locations)


def _incremental_vehicles(f):
    return P.vehicle_summary(_refreshed(f, P.VEHICLE), f.vehicles)


add("incremental_refresh", _incremental, "select * from driver_summary")
add("incremental_refresh_routes", _incremental_routes, "select * from route_summary")
add("incremental_refresh_vehicles", _incremental_vehicles, "select * from vehicle_summary")
add("incremental_refresh_days", lambda f: P.daily_fleet_stats(_refreshed(f, P.DAILY)), f"select * replace ({day('stat_date')} as stat_date) from daily_fleet_stats")
add("upsert_patterns", lambda f: L.upsert(
        S.route_patterns(f.trips.filter(F.col("dt_created") <= since(f))), S.route_patterns(f.trips), ["origin_id", "destination_id"]),
    "select * from route_patterns")

# ---------------------------------------------------------------- summary tables
CTE["route_patterns"] = f"""select origin_id, destination_id, {avg2('trip_duration_minutes')} as avg_duration_minutes,
 {r('quantile_cont(cast(trip_duration_minutes as double),0.5)')} as median_duration_minutes, {avg2('trip_km')} as avg_distance_km,
 {avg2('avg_speed_kmph')} as avg_speed_kmph, {r(share('eta_met=1'))} as eta_success_rate, count(*) as sample_size
 from trips where trip_duration_minutes is not null group by 1,2 having count(*)>=3"""
add("driver_summary", lambda f: S.driver_summary(f.trips, f.drivers), "select * from driver_summary")
add("route_summary", lambda f: S.route_summary(L.trips_fact(f.first), f.locations), "select * from route_summary")
add("vehicle_summary", lambda f: S.vehicle_summary(f.trips, f.vehicles), "select * from vehicle_summary")
add("daily_fleet_stats", lambda f: S.daily_fleet_stats(f.trips), f"select * replace ({day('stat_date')} as stat_date) from daily_fleet_stats")
add("route_time_patterns", lambda f: S.route_time_patterns(f.trips, f.locations), "select * from route_time_patterns")
CTE["customer_summary"] = f"""select customer_id, c.cne_name as customer_name, count(*) as total_trips, {r('sum(trip_km)')} as total_distance_km, {avg2('trip_km')} as avg_distance_km,
 {avg2('trip_duration_minutes')} as avg_duration_min, {r(share('eta_met=1'))} as eta_success_rate, count(distinct origin_id*100000+destination_id) as unique_routes,
 count(distinct driver_id) as unique_drivers, count(distinct vehicle_id) as unique_vehicles, cast(min(trip_start) as date) as first_trip_date, cast(max(trip_start) as date) as last_trip_date,
 {r("cast(count(*) as double)/nullif(cast(date_diff('day',cast(min(trip_start) as date),cast(max(trip_start) as date)) as double)/7,0)")} as avg_trips_per_week
 from rel t join customers c on t.customer_id=c.id group by 1,2"""
add("customer_summary", lambda f: S.customer_summary(f.trips, f.customers),
    f"select * replace ({day('first_trip_date')} as first_trip_date, {day('last_trip_date')} as last_trip_date) from customer_summary")
add("driver_summary_all", lambda f: S.driver_summary(f.trips, f.drivers, filtered=False), "select * from driver_summary_all")
add("route_summary_all", lambda f: S.route_summary(f.trips, f.locations, filtered=False, arrow=T.LEGACY_ARROW), "select * from route_summary_all")
add("route_patterns", lambda f: S.route_patterns(f.trips), "select * from route_patterns")
add("driver_behavior", lambda f: S.driver_behavior(f.trips, f.locations),
    f"""select a.*, p.preferred_routes, h.peak_performance_hours from (
 select driver_id, {avg2('avg_speed_kmph')} as avg_speed_kmph, {r('stddev_samp(cast(avg_speed_kmph as double))')} as speed_consistency, {r(share('eta_met=1'))} as eta_reliability_score,
 {avg2('trip_duration_minutes')} as avg_trip_duration_minutes, count(*) as total_trips, {r('sum(trip_km)')} as total_distance_km from trips group by 1 having count(*)>=5) a
 left join (select driver_id, string_agg(route,'|' order by rn) as preferred_routes from (
  select driver_id, concat(origin_name,' → ',destination_name) as route, row_number() over (partition by driver_id order by count(*) desc, concat(origin_name,' → ',destination_name)) as rn
  from named group by 1,2) where rn<=5 group by 1) p on a.driver_id=p.driver_id
 left join (select driver_id, string_agg(cast(hr as varchar),'|' order by rn) as peak_performance_hours from (
  select driver_id, hour(trip_start) as hr, row_number() over (partition by driver_id order by count(*) desc, hour(trip_start)) as rn
  from trips where eta_met=1 group by 1,2) where rn<=5 group by 1) h on a.driver_id=h.driver_id""")
