"""Registered queries: the dispatcher's reads, current and older application."""

from pyspark.sql import functions as F

from ..operators import reads as R
from ..operators import reads_older as O
from .cat_loading import SQL_RANGE, SQL_SPEED_LIST, naive_predictions
from .sqltext import CTE, RATE, avg2, d, day, i, r, ts

ENTRIES = {}


def add(key, build, sql=None):
    ENTRIES[key] = (build, sql)


# Fixed parameters, the same on both sides.
PAGE, LIMIT, DAYS, TEXT = 2, 20, 30, "1"
MINS = "date_sub('minute',trip_start,ata_in) as trip_duration_minutes"
LATEST = "order by trip_start desc, dispatch_entry_no"
AVG_NUMS = f"""{avg2('trip_duration_minutes')} as avg_duration_min, {avg2('avg_speed_kmph')} as avg_speed_kmph, {avg2('trip_km')} as avg_distance_km, {RATE} as eta_success_rate"""


def rank_sql(keys, order, lo, hi, src="named"):
    return f"select * from (select *, row_number() over (partition by {keys} order by {order}) as rn, count(*) over (partition by {keys}) as total from {src}) where rn>{lo} and rn<={hi}"


BY_TIME = "trip_start desc, dispatch_entry_no"

# dashboard
add("fleet_summary", lambda f: R.fleet_summary(f.trips),
    f"""select count(*) as total_trips, count(distinct driver_id) as total_drivers, count(distinct vehicle_id) as total_vehicles, {r('sum(trip_km)')} as total_distance_km,
 {avg2('avg_speed_kmph')} as avg_speed_kmph, {RATE} as eta_success_rate from trips""")
add("daily_trend", lambda f: R.daily_trend(f.daily_fleet_stats, DAYS), f"select * replace ({day('stat_date')} as stat_date) from (select * from daily_fleet_stats order by stat_date desc limit {DAYS})")
add("top_drivers", lambda f: R.top_drivers(f.driver_summary),
    "select driver_id, driver_name, driver_mobile, total_trips, eta_success_rate, avg_speed_kmph, total_distance_km from driver_summary where total_trips>=5 order by total_trips desc, driver_id limit 10")
add("route_heatmap", lambda f: R.route_heatmap(f.route_summary),
    "select origin, destination, route_name, trip_count, avg_duration_min, eta_success_rate, avg_distance_km from route_summary order by trip_count desc, origin, destination limit 20")
add("paginate", lambda f: R.paginate(f.route_summary.select("origin", "destination", "trip_count"), [F.desc("trip_count"), "origin", "destination"], 3, LIMIT),
    f"select origin, destination, trip_count, (select count(*) from route_summary) as total, {i(f'ceil((select count(*) from route_summary)/{LIMIT}.0)')} as total_pages from route_summary order by trip_count desc, origin, destination limit {LIMIT} offset {2 * LIMIT}")

# drivers
DRIVER_PAGE = f"""select *, (select count(*) from driver_summary where driver_name ilike '%{TEXT}%' or driver_mobile ilike '%{TEXT}%') as total,
 {i(f"ceil((select count(*) from driver_summary where driver_name ilike '%{TEXT}%' or driver_mobile ilike '%{TEXT}%')/{LIMIT}.0)")} as total_pages
 from driver_summary where driver_name ilike '%{TEXT}%' or driver_mobile ilike '%{TEXT}%' order by total_distance_km asc, driver_id limit {LIMIT}"""
add("drivers_list", lambda f: R.drivers_list(f.driver_summary, TEXT, "total_distance_km", "asc", 1, LIMIT), DRIVER_PAGE)


def composite_sql(src):
    return f"""select * exclude (v), {r(f'''(total_trips*eta_success_rate+15*(select cast(sum(cast(eta_success_rate as decimal(12,4))) as double)/count(*) from {src}))/(total_trips+15)*0.35::double
 +least(100.0::double,ln(1+total_trips)/ln(1+(select max(total_trips) from {src}))*100)*0.25::double+({SQL_SPEED_LIST})*0.20::double+least(eta_success_rate,100.0)*0.20::double''', 1)} as composite_score
 from (select *, avg_speed_kmph as v from {src})"""


CTE["driver_page"] = f"select * from driver_summary where driver_name ilike '%{TEXT}%' or driver_mobile ilike '%{TEXT}%' order by total_distance_km asc, driver_id limit {LIMIT}"
add("driver_composite", lambda f: R.driver_composite(f.driver_summary), composite_sql("driver_summary"))
add("driver_composite_page", lambda f: R.driver_composite(R.drivers_list(f.driver_summary, TEXT, "total_distance_km", "asc", 1, LIMIT)).drop("total", "total_pages"), composite_sql("driver_page"))
DT = f"driver_id, dispatch_entry_no, origin_name, destination_name, {ts('trip_start')} as trip_start, {ts('ata_in')} as trip_end, {MINS}, {i('eta_met')} as eta_met, {d('avg_speed_kmph')} as avg_speed_kmph, {d('trip_km')} as trip_km, trip_status, asset_id"
PAGES = f"total, {i(f'ceil(total/{LIMIT}.0)')} as total_pages"
add("driver_recent_trips", lambda f: R.driver_recent_trips(f.trips, f), f"select {DT} from ({rank_sql('driver_id', BY_TIME, 0, 20)})")
add("driver_vehicles", lambda f: R.driver_vehicles(f.trips, f.vehicles), "select driver_id, vehicle_id, asset_id, asset_type, count(*) as trip_count from named group by 1,2,3,4")
add("driver_routes", lambda f: R.driver_routes(f.trips, f.locations),
    """select driver_id, origin, destination, trip_count from (select *, row_number() over (partition by driver_id order by trip_count desc, origin, destination) as rn from
 (select driver_id, origin_name as origin, destination_name as destination, count(*) as trip_count from named group by 1,2,3)) where rn<=10""")
add("driver_trips_page", lambda f: R.driver_trips_page(f.trips, f, PAGE, LIMIT), f"select {DT}, {PAGES} from ({rank_sql('driver_id', BY_TIME, LIMIT, 2 * LIMIT)})")
TREND = f"""count(*) as trip_count, {avg2('trip_duration_minutes')} as avg_duration, {RATE} as eta_success_rate, {avg2('avg_speed_kmph')} as avg_speed,
 {avg2('trip_km')} as avg_distance, {avg2('eta_delay_minutes')} as avg_delay"""
add("driver_trend", lambda f: R.driver_trend(f.trips, "month"), f"select driver_id, strftime(trip_start,'%Y-%m') as period, {TREND} from trips group by 1,2")
add("driver_trend_week", lambda f: R.driver_trend(f.trips, "week", "2020-01-01", "2024-12-31"),
    f"""select driver_id, concat(year(min(trip_start)),'-W',lpad(cast(week(min(trip_start)) as varchar),2,'0')) as period, {TREND} from trips
 where trip_start>='2020-01-01' and trip_start<=timestamp '2024-12-31 23:59:59' group by driver_id, yearweek(trip_start)""")
add("driver_trend_day", lambda f: R.driver_trend(f.trips, "day", "2022-01-01", "2022-06-30"),
    f"select driver_id, strftime(trip_start,'%Y-%m-%d') as period, {TREND} from trips where trip_start>='2022-01-01' and trip_start<=timestamp '2022-06-30 23:59:59' group by 1,2")
CTE["pairs"] = "select distinct driver_id, vehicle_id from trips"
CTE["dw"] = "select p.driver_id, w.* from pairs p join waypoints w on p.vehicle_id=w.vehicle_id"
add("driving_hourly", lambda f: R.driving_hourly(f.trips, f.waypoints),
    f"""select driver_id, {i('hour(recorded_at)')} as hour_of_day, {avg2('speed_kmph')} as avg_speed, {d('max(speed_kmph)')} as max_speed, {d('min(case when speed_kmph>0 then speed_kmph end)')} as min_speed,
 count(*) as data_points, {r("cast(sum(case when speed_kmph=0 or status ilike '%stop%' then 1 else 0 end) as double)/count(*)*100")} as stop_pct from dw group by 1,2""")
add("driving_speed_dist", lambda f: R.driving_speed_dist(f.trips, f.waypoints),
    f"""select *, {i("list_position(['Stopped (0)','Slow (1-20)','Medium (21-40)','Fast (41-60)','Very Fast (61-80)','Over 80'],speed_range)")} as range_order from
 (select driver_id, {SQL_RANGE.format(v='speed_kmph')} as speed_range, count(*) as count from dw where speed_kmph is not null group by 1,2)""")
add("driving_daily", lambda f: R.driving_daily(f.trips, f.waypoints),
    f"select driver_id, {i('dayofweek(recorded_at)+1')} as day_num, dayname(recorded_at) as day_name, {avg2('speed_kmph')} as avg_speed, count(*) as data_points from dw group by 1,2,3")
add("driving_totals", lambda f: R.driving_totals(f.trips, f.waypoints),
    f"""select driver_id, count(*) as total_points, count(distinct cast(recorded_at as date)) as total_days, {avg2('speed_kmph')} as overall_avg_speed, {d('max(speed_kmph)')} as top_speed,
 {r('sum(distance_from_prev)')} as total_distance_tracked from dw group by 1""")

# vehicles
VSEARCH = "asset_id ilike '%1%' or asset_type ilike '%1%'"
add("vehicles_list", lambda f: R.vehicles_list(f.vehicle_summary, TEXT, "eta_success_rate", "desc", 1, LIMIT),
    f"select *, (select count(*) from vehicle_summary where {VSEARCH}) as total, {i(f'ceil((select count(*) from vehicle_summary where {VSEARCH})/{LIMIT}.0)')} as total_pages from vehicle_summary where {VSEARCH} order by eta_success_rate desc, vehicle_id limit {LIMIT}")
add("vehicle_drivers", lambda f: R.vehicle_drivers(f.trips, f.drivers),
    """select vehicle_id, driver_id, driver_name, trip_count from (select *, row_number() over (partition by vehicle_id order by trip_count desc, driver_id) as rn from
 (select vehicle_id, driver_id, driver_name, count(*) as trip_count from named group by 1,2,3)) where rn<=10""")
VT = f"vehicle_id, dispatch_entry_no, driver_name, origin_name, destination_name, {ts('trip_start')} as trip_start, {d('trip_duration_minutes')} as trip_duration_minutes, {i('eta_met')} as eta_met, {d('avg_speed_kmph')} as avg_speed_kmph"
add("vehicle_trips_recent", lambda f: R.vehicle_recent_trips(f.trips, f), f"select {VT} from ({rank_sql('vehicle_id', BY_TIME, 0, 20)})")
add("vehicle_trips_page", lambda f: R.vehicle_trips_page(f.trips, f, 1, LIMIT), f"select {VT}, {d('trip_km')} as trip_km, trip_status, {PAGES} from ({rank_sql('vehicle_id', BY_TIME, 0, LIMIT)})")
add("vehicle_route_benchmark", lambda f: R.vehicle_route_benchmark(f.trips, f.locations, f.route_summary),
    f"""select v.vehicle_id, v.trip_count, v.avg_duration_min, v.avg_speed_kmph, v.avg_distance_km, v.eta_success_rate, v.origin, v.destination,
 s.avg_duration_min as fleet_avg_duration_min, s.avg_speed_kmph as fleet_avg_speed_kmph, s.avg_distance_km as fleet_avg_distance_km, s.eta_success_rate as fleet_eta_success_rate, s.trip_count as fleet_trip_count
 from (select *, row_number() over (partition by vehicle_id order by trip_count desc, origin, destination) as rn from (select vehicle_id, origin_name as origin, destination_name as destination, count(*) as trip_count, {AVG_NUMS}
 from named where trip_duration_minutes>0 group by 1,2,3)) v left join route_summary s on v.origin=s.origin and v.destination=s.destination where rn<=10""")
add("vehicle_monthly", lambda f: R.vehicle_monthly(f.trips),
    f"""select vehicle_id, month, trips, avg_speed, eta_rate, total_km from (select *, row_number() over (partition by vehicle_id order by month desc) as rn from
 (select vehicle_id, strftime(trip_start,'%Y-%m') as month, count(*) as trips, {avg2('avg_speed_kmph')} as avg_speed, {RATE} as eta_rate, {r('sum(trip_km)')} as total_km from trips where trip_duration_minutes>0 group by 1,2)) where rn<=12""")

# trips
TFILTER = "origin_name ilike '%nation_1%' and trip_status='C' and eta_met=1 and trip_start>='2020-01-01' and trip_start<='2024-01-01'"
add("trips_list", lambda f: R.trips_list(f.trips, f, 1, LIMIT, origin="nation_1", trip_status="C", eta_met=True, date_from="2020-01-01", date_to="2024-01-01"),
    f"""select dispatch_entry_no, driver_name, asset_id, origin_name, destination_name, {ts('trip_start')} as trip_start, {ts('ata_in')} as trip_end, {MINS}, {i('eta_met')} as eta_met,
 {d('eta_delay_minutes')} as eta_delay_minutes, {d('avg_speed_kmph')} as avg_speed_kmph, {d('trip_km')} as trip_km, trip_status, (select count(*) from named where {TFILTER}) as total,
 {i(f'ceil((select count(*) from named where {TFILTER})/{LIMIT}.0)')} as total_pages from named n where {TFILTER} order by n.trip_start desc, dispatch_entry_no limit {LIMIT}""")
add("trips_filter", lambda f: R.trips_filter(f.trips, f.locations, origin="nation_1", destination="nation_2", trip_status="C", eta_met=False, date_from="2020-01-01", date_to="2024-01-01").select("dispatch_entry_no", "driver_id", "vehicle_id"),
    "select dispatch_entry_no, driver_id, vehicle_id from named where origin_name ilike '%nation_1%' and destination_name ilike '%nation_2%' and trip_status='C' and eta_met=0 and trip_start>='2020-01-01' and trip_start<='2024-01-01'")
add("trip_stats", lambda f: R.trip_stats(f.trips),
    f"""select count(*) as total_trips, {i("sum(case when trip_status='C' then 1 else 0 end)")} as completed_trips, {i("sum(case when trip_status='C' then 0 else 1 end)")} as active_trips,
 {r("cast(sum(date_sub('minute',trip_start,ata_in)) as double)/count(*)")} as avg_duration_minutes, {avg2('avg_speed_kmph')} as avg_speed_kmph, {RATE} as eta_success_rate from trips where ata_in is not null""")
DETAIL = ["dispatch_entry_no", "driver_name", "driver_mobile", "asset_id", "asset_type", "origin_name", "destination_name", "customer_name", "trip_start", "ata_in", "eta_met", "trip_km",
          "trip_duration_minutes_actual", "driver_total_trips", "driver_eta_success_rate", "driver_avg_speed_kmph", "driver_avg_duration_min", "route_trip_count", "route_avg_duration_min",
          "route_eta_success_rate", "route_avg_distance_km", "vehicle_total_trips", "vehicle_avg_speed_kmph", "vehicle_eta_success_rate"]
DETAIL_SQL = f"""select dispatch_entry_no, n.driver_name, n.driver_mobile, n.asset_id, n.asset_type, origin_name, destination_name, customer_name, {ts('trip_start')} as trip_start, {ts('ata_in')} as ata_in, {i('eta_met')} as eta_met,
 {d('trip_km')} as trip_km, date_sub('minute',trip_start,ata_in) as trip_duration_minutes_actual, dd.total_trips as driver_total_trips, dd.eta_success_rate as driver_eta_success_rate, dd.avg_speed_kmph as driver_avg_speed_kmph,
 dd.avg_duration_min as driver_avg_duration_min, rr.trip_count as route_trip_count, rr.avg_duration_min as route_avg_duration_min, rr.eta_success_rate as route_eta_success_rate, rr.avg_distance_km as route_avg_distance_km,
 vv.total_trips as vehicle_total_trips, vv.avg_speed_kmph as vehicle_avg_speed_kmph, vv.eta_success_rate as vehicle_eta_success_rate
 from named n left join driver_summary dd on n.driver_id=dd.driver_id left join route_summary rr on n.origin_id=rr.origin_id and n.destination_id=rr.destination_id left join vehicle_summary vv on n.vehicle_id=vv.vehicle_id"""
add("trip_detail", lambda f: R.trip_detail(f.trips, f, f.driver_summary, f.route_summary, f.vehicle_summary).select(*DETAIL), DETAIL_SQL)


def one_trip(f):
    """The trip of the lowest number, read by its number: row groups without it are skipped by their Bloom filters."""
    number = f.trips.agg(F.min("dispatch_entry_no")).first()[0]
    return R.trip_detail(f.trips.filter(F.col("dispatch_entry_no") == number), f, f.driver_summary, f.route_summary, f.vehicle_summary).select(*DETAIL)


add("trip_detail_one", one_trip, DETAIL_SQL + " where n.dispatch_entry_no=(select min(dispatch_entry_no) from trips)")
add("trip_waypoints", lambda f: R.trip_waypoints(f.trips, f.waypoints),
    f"""select dispatch_entry_no, t.vehicle_id, {ts('recorded_at')} as recorded_at, {d('speed_kmph')} as speed_kmph, status, {d('distance_from_prev')} as distance_from_prev
 from trips t join waypoints w on t.vehicle_id=w.vehicle_id and w.recorded_at between t.trip_start and t.trip_end""")
add("driver_on_route", lambda f: R.driver_on_route(f.trips, f.locations),
    f"select driver_id, origin_name as origin, destination_name as destination, count(*) as route_trips, {AVG_NUMS} from named where trip_duration_minutes>0 group by 1,2,3")
CTE["route_latest"] = f"""select *, row_number() over (partition by origin_id, destination_id order by {BY_TIME}) as rk from named where trip_duration_minutes>0"""
add("route_peers", lambda f: R.route_peers(f.trips, f.drivers),
    f"""select dispatch_entry_no, peer_no, peer_driver, {ts('peer_start')} as peer_start, {d('peer_minutes')} as peer_minutes, {i('peer_eta_met')} as peer_eta_met, {d('peer_km')} as peer_km from (
 select t.dispatch_entry_no, p.dispatch_entry_no as peer_no, p.driver_name as peer_driver, p.trip_start as peer_start, p.trip_duration_minutes as peer_minutes, p.eta_met as peer_eta_met, p.trip_km as peer_km,
 row_number() over (partition by t.dispatch_entry_no order by p.trip_start desc, p.dispatch_entry_no) as rn from trips t
 join (select * from route_latest where rk<=11) p on t.origin_id=p.origin_id and t.destination_id=p.destination_id and t.dispatch_entry_no<>p.dispatch_entry_no) where rn<=10""")

# routes, places, clients
add("routes_list", lambda f: R.routes_list(f.route_summary, TEXT, "avg_duration_min", "asc", PAGE, LIMIT),
    f"select *, (select count(*) from route_summary where route_name ilike '%1%') as total, {i(f'''ceil((select count(*) from route_summary where route_name ilike '%1%')/{LIMIT}.0)''')} as total_pages from route_summary where route_name ilike '%1%' order by avg_duration_min, route_name limit {LIMIT} offset {LIMIT}")
add("route_patterns_of", lambda f: R.route_patterns_grid(f.route_time_patterns),
    "select origin, destination, hour_of_day, " + ", ".join(f"max(case when day_of_week={n} then avg_duration end) as day_{n}" for n in range(1, 8)) + " from route_time_patterns group by 1,2,3")
add("route_top_drivers", lambda f: R.route_top_drivers(f.trips, f.drivers, f.locations),
    f"""select origin, destination, driver_id, driver_name, trip_count, avg_duration, eta_rate from (select *, row_number() over (partition by origin, destination order by trip_count desc, driver_id) as rn from
 (select origin_name as origin, destination_name as destination, driver_id, driver_name, count(*) as trip_count, {avg2('trip_duration_minutes')} as avg_duration, {RATE} as eta_rate from named group by 1,2,3,4)) where rn<=10""")
add("route_recent", lambda f: R.route_recent(f.trips, f),
    f"""select origin_name, destination_name, dispatch_entry_no, driver_name, asset_id, {ts('trip_start')} as trip_start, {ts('ata_in')} as trip_end, {MINS}, {i('eta_met')} as eta_met, {d('avg_speed_kmph')} as avg_speed_kmph
 from ({rank_sql('origin_id, destination_id', BY_TIME, 0, 20)})""")
add("locations_search", lambda f: R.locations_search(f.locations, "nation_1"), "select id, name from locations where name ilike '%nation_1%' order by name, id limit 200")
add("route_preview", lambda f: R.route_preview(f.trips, f.locations),
    f"""select origin_name as origin, destination_name as destination, count(*) as total_trips, {d('min(case when trip_duration_minutes>0 then trip_duration_minutes end)')} as fastest_minutes,
 {d('max(case when trip_duration_minutes>0 then trip_duration_minutes end)')} as slowest_minutes, {r('stddev_pop(cast(case when trip_duration_minutes>0 then trip_duration_minutes end as double))', 4)} as duration_stddev
 from named where trip_status='C' group by 1,2""")
CTE["done"] = "select * from named where trip_status='C'"
add("route_preview_recent", lambda f: R.route_preview_recent(f.trips, f),
    f"""select origin_name, destination_name, dispatch_entry_no, driver_name, {d('trip_duration_minutes')} as trip_duration_minutes, {d('avg_speed_kmph')} as avg_speed_kmph, {d('trip_km')} as trip_km,
 {i('eta_met')} as eta_met, {ts('trip_start')} as trip_start from ({rank_sql('origin_id, destination_id', BY_TIME, 0, 5, 'done')})""")


def _clients(f):
    from ..operators.summaries import customer_summary

    return customer_summary(f.trips, f.customers).select(F.col("customer_name").alias("client"), "total_trips", "avg_trips_per_week")


add("clients_list", lambda f: R.clients_list(_clients(f), TEXT, "avg_trips_per_week", "desc"),
    f"select customer_name as client, total_trips, avg_trips_per_week from customer_summary where customer_name ilike '%{TEXT}%'")

# ---------------------------------------------------------------- older application
add("record_count", lambda f: O.record_count(f.trips), "select count(*) as records from trips")
add("data_summary", lambda f: O.data_summary(f.trips),
    f"select count(*) as total_records, count(distinct driver_id) as total_drivers, count(distinct vehicle_id) as total_vehicles, {ts('min(trip_start)')} as date_start, {ts('max(trip_start)')} as date_end from trips")


def _all_drivers(f):
    from ..operators.summaries import driver_summary

    return driver_summary(f.trips, f.drivers, filtered=False)


def _all_routes(f):
    from ..functions.trips import LEGACY_ARROW
    from ..operators.summaries import route_summary

    return route_summary(f.trips, f.locations, filtered=False, arrow=LEGACY_ARROW)


DSEARCH = "driver_name ilike '%1%' or driver_mobile ilike '%1%'"
add("drivers_list_older", lambda f: O.drivers_older(_all_drivers(f), TEXT, 1, 50),
    f"""select driver_id, driver_name as name, driver_mobile as mobile, total_trips as trip_count, eta_success_rate, avg_speed_kmph, total_distance_km, lower(concat(driver_name,' ',driver_mobile)) as search_text,
 (select count(*) from driver_summary_all where {DSEARCH}) as total, {i(f'ceil((select count(*) from driver_summary_all where {DSEARCH})/50.0)')} as total_pages from driver_summary_all where {DSEARCH} order by total_trips desc, driver_id limit 50""")
add("driver_profile", lambda f: O.driver_profile(f.trips, _all_drivers(f), f.locations),
    """select s.*, total_trips-eta_met_count as eta_missed, most_frequent_route, peak_operating_hour from driver_summary_all s left join (
 select driver_id, concat(origin_name,' → ',destination_name) as most_frequent_route from named group by driver_id, origin_name, destination_name
 qualify row_number() over (partition by driver_id order by count(*) desc, origin_name, destination_name)=1) p on s.driver_id=p.driver_id left join (
 select driver_id, hour(trip_start) as peak_operating_hour from trips group by 1,2 qualify row_number() over (partition by driver_id order by count(*) desc, hour(trip_start))=1) h on s.driver_id=h.driver_id""")
add("driver_profile_cars", lambda f: O.driver_cars(f.trips, f.vehicles), "select distinct driver_id, asset_id from named")
add("driver_profile_latest", lambda f: O.driver_latest(f.trips, f),
    f"""select driver_id, dispatch_entry_no as trip_id, {day('trip_start')} as date, concat(origin_name,' → ',destination_name) as route, {r('cast(trip_duration_minutes as double)/60')} as duration_hours,
 {d('trip_km')} as trip_km, asset_id as vehicle, {i('coalesce(eta_met,0)')} as eta_met from ({rank_sql('driver_id', BY_TIME, 0, 5)})""")
add("driver_vehicle_use", lambda f: O.driver_vehicle_use(f.trips, f.vehicles),
    f"select driver_id, asset_id, asset_type, count(*) as trip_count, coalesce({r('sum(trip_km)')},0) as total_km, {avg2('avg_speed_kmph', 6)} as avg_speed from named group by 1,2,3")
OT = f"""dispatch_entry_no as trip_id, {ts('trip_start')} as trip_start, {ts('trip_end')} as trip_end, origin_name as origin, destination_name as destination, concat(origin_name,' → ',destination_name) as route,
 {d('trip_km')} as trip_km, {d('trip_duration_minutes')} as duration_minutes, {i('eta_met')} as eta_met"""
OSEARCH = "trip_status='C' and trip_start>='2020-01-01' and trip_start<='2024-06-30' and (dispatch_entry_no ilike '%d12%' or origin_name ilike '%d12%' or destination_name ilike '%d12%')"
add("trips_search", lambda f: O.trips_search(f.trips, f, search="d12", status="C", start_date="2020-01-01", end_date="2024-06-30"),
    f"select {OT}, trip_status, driver_name, asset_id as vehicle_id, (select count(*) from named where {OSEARCH}) as total, {i(f'ceil((select count(*) from named where {OSEARCH})/20.0)')} as total_pages from named n where {OSEARCH} order by n.trip_start desc nulls last, dispatch_entry_no limit 20")
add("driver_trips_legacy", lambda f: O.driver_trips_legacy(f.trips, f, PAGE, LIMIT), f"select driver_name, {OT}, trip_status as status, asset_id as vehicle, {PAGES} from ({rank_sql('driver_id', BY_TIME, LIMIT, 2 * LIMIT)})")
add("vehicle_trips_legacy", lambda f: O.vehicle_trips_legacy(f.trips, f, 1, LIMIT), f"select asset_id, {OT}, driver_name, {PAGES} from ({rank_sql('vehicle_id', BY_TIME, 0, LIMIT)})")
add("trip_details_legacy", lambda f: O.trip_details_legacy(f.trips, f),
    f"select {OT}, driver_name, driver_mobile, asset_id as vehicle_id, asset_type as vehicle_type, {ts('trip_eta')} as trip_eta, {d('avg_speed_kmph')} as avg_speed_kmph, {d('eta_delay_minutes')} as eta_delay_minutes, trip_status as status from named")
CTE["usage"] = f"""select v.asset_id, v.asset_type, count(t.dispatch_entry_no) as trip_count, count(distinct t.driver_id) as driver_count, coalesce({r('sum(t.trip_km)')},0) as total_km
 from vehicles v left join trips t on v.id=t.vehicle_id group by 1,2"""
add("vehicles_usage", lambda f: O.vehicles_usage(f.trips, f.vehicles, limit=None), "select * from usage")
add("vehicles_usage_page", lambda f: O.vehicles_usage(f.trips, f.vehicles, TEXT, 1, 50),
    f"select *, (select count(*) from usage where {VSEARCH}) as total, {i(f'ceil((select count(*) from usage where {VSEARCH})/50.0)')} as total_pages from usage where {VSEARCH} order by trip_count desc, asset_id limit 50")
add("overview", lambda f: O.overview(f.trips),
    f"""select count(*) as total_trips, {i('sum(case when eta_met=1 then 1 else 0 end)')} as eta_met, {i('count(*)-sum(case when eta_met=1 then 1 else 0 end)')} as eta_missed, {RATE} as eta_success_rate,
 {r('sum(trip_km)')} as total_distance_km, count(distinct driver_id) as active_drivers, count(distinct vehicle_id) as active_vehicles, {avg2('trip_duration_minutes')} as avg_trip_duration_min from trips""")
add("overview_top_routes", lambda f: O.route_ranking(_all_routes(f), 10).select("route", F.col("trip_count").alias("count")), "select route_name as route, trip_count as count from route_summary_all order by trip_count desc, route_name limit 10")
add("route_ranking", lambda f: O.route_ranking(_all_routes(f)), "select route_name as route, trip_count, avg_duration_min, eta_success_rate, avg_distance_km from route_summary_all order by trip_count desc, route_name limit 20")
add("top_performers", lambda f: O.top_performers(_all_drivers(f)), "select driver_id, driver_name, total_trips, eta_success_rate, eta_met_count as eta_met from driver_summary_all where total_trips>=5 order by eta_success_rate desc, driver_id limit 10")
EH = f"""count(*) as sample_size, {avg2('trip_duration_minutes')} as predicted_duration_minutes, {r('cast(sum(trip_duration_minutes) as double)/count(*)/60')} as predicted_duration_hours,
 {d('min(trip_duration_minutes)')} as min_duration_minutes, {d('max(trip_duration_minutes)')} as max_duration_minutes, {avg2('trip_km')} as avg_distance_km, {avg2('avg_speed_kmph')} as avg_speed_kmph,
 case when count(*)>=10 then 'high' when count(*)>=5 then 'medium' else 'low' end as confidence"""
add("eta_from_history", lambda f: O.eta_from_history(f.trips, f), f"select origin_name as origin, destination_name as destination, {EH} from named where trip_duration_minutes is not null group by 1,2")
add("eta_from_history_driver", lambda f: O.eta_from_history(f.trips, f, by_driver=True), f"select origin_name as origin, destination_name as destination, driver_id, {EH} from named where trip_duration_minutes is not null group by 1,2,3")
add("route_stats_all", lambda f: O.route_stats_all(f.trips, f.locations),
    f"select concat(origin_name,' → ',destination_name) as route, count(*) as total_trips, {avg2('trip_duration_minutes')} as avg_duration_minutes, {avg2('trip_km')} as avg_distance_km, {RATE} as eta_success_rate, count(distinct driver_id) as unique_drivers, count(distinct vehicle_id) as unique_vehicles from named group by 1")
add("name_lookups", lambda f: O.name_lookups(f.locations), "select name from locations order by name")
add("name_lookups_drivers", lambda f: O.name_lookups(f.drivers), "select name from drivers order by name")
add("validation_trips", lambda f: O.validation_trips(f.trips, f),
    f"""select dispatch_entry_no, {ts('trip_start')} as trip_start, {ts('ata_in')} as ata_in, {d('trip_duration_minutes')} as trip_duration_minutes, {d('trip_km')} as trip_km, {d('avg_speed_kmph')} as avg_speed_kmph,
 {i('eta_met')} as eta_met, {d('eta_delay_minutes')} as eta_delay_minutes, driver_id, driver_name, origin_name as origin, destination_name as destination, asset_type from named where trip_status='C' and ata_in is not null""")
add("prediction_validate", lambda f: O.prediction_validate(naive_predictions(f)),
    f"""select dispatch_entry_no, {ts('arr')} as predicted_arrival, {r('h')} as arrival_error_hours, {r('h*60')} as arrival_error_minutes, {r('g/3.6e9')} as difference_hours, {r('abs(p-cast(trip_duration_minutes as double))')} as duration_error_minutes,
 {i('h<=1')} as within_1_hour, {i('h<=2')} as within_2_hours, {i('h<=4')} as within_4_hours, case when h<=1 then 'excellent' when h<=2 then 'good' when h<=4 then 'acceptable' else 'poor' end as prediction_quality
 from (select *, abs(g)/3.6e9 as h from (select *, cast(epoch_us(arr)-epoch_us(ata_in) as double) as g from (
 select t.*, s.avg_duration_min as p, trip_start+to_microseconds(cast(round(s.avg_duration_min*60000000) as bigint)) as arr from rel t join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id)))""")
