"""Registered queries: demand series, forecasts, clients."""

import re

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import forecast as D
from .sqltext import CTE, d, day, i, r

ENTRIES = {}


def add(key, build, sql=None):
    ENTRIES[key] = (build, sql)


def daily(f):
    return f.stored("demand_daily", lambda: D.demand_daily(f.trips))


def clients_daily(f):
    return f.stored("client_daily", lambda: D.client_daily(f.raw))


R = ["origin_id", "destination_id"]
CTE["demand_daily"] = "select origin_id, destination_id, cast(trip_start as date) as trip_date, count(*) as trip_count from trips where eta_data_status='available' group by 1,2,3"
CTE["top_volume"] = """select * from (select origin_id, destination_id, cast(sum(trip_count) as bigint) as total_trips, count(*) as active_days from demand_daily group by 1,2 order by total_trips desc, origin_id, destination_id limit 50) where active_days>=14"""
add("demand_daily", lambda f: D.demand_daily(f.trips), f"select * replace ({day('trip_date')} as trip_date) from demand_daily")
add("top_routes_volume", lambda f: D.top_series(daily(f), R, 50, 14), "select * from top_volume")


def ma(n):
    w = f"over (partition by origin_id, destination_id order by trip_date rows between {n - 1} preceding and current row)"
    return r(f"cast(sum(trip_count) {w} as double)/count(trip_count) {w}", 6) + f" as ma_{n}"


add("moving_averages", lambda f: (lambda m: m.withColumns({c: rnd(c, 6) for c in ("ma_7", "ma_14", "ma_30")}))(D.moving_averages(daily(f), R)),
    f"select origin_id, destination_id, {day('trip_date')} as trip_date, trip_count, {ma(7)}, {ma(14)}, {ma(30)} from demand_daily")
SMOOTH = "list_reduce({x}, lambda s, y: 0.3::double*y+0.7::double*s)"
add("exp_smoothing", lambda f: D.exp_smoothing(daily(f), R).select(*R, "days", rnd("smoothed_last", 6).alias("smoothed_last"), rnd("smoothed_7", 6).alias("smoothed_7")),
    f"""select origin_id, destination_id, {i('len(ys)')} as days, {r(SMOOTH.format(x='ys'), 6)} as smoothed_last, case when len(ys)>=7 then {r(SMOOTH.format(x='ys[1:greatest(len(ys)-6,1)]'), 6)} end as smoothed_7
 from (select origin_id, destination_id, list(cast(trip_count as double) order by trip_date) as ys from demand_daily group by 1,2)""")
add("ridge_per_group", lambda f: D.ridge_per_group(D.series_features(daily(f), R), R, D.ROUTE_FEATURES))
add("demand_forecast", lambda f: D.demand_forecast(daily(f)))
add("fleet_forecast", lambda f: D.fleet_forecast(daily(f)))


def _ridge_solved(f):
    rows = D.series_features(daily(f), R)
    return D.solved(rows, D.ridge_per_group(rows, R, D.ROUTE_FEATURES), R, D.ROUTE_FEATURES)


# what must hold for coefficients and forecasts, whatever the solver: the normal equations, and one week per series that adds up
add("ridge_normal_equations", _ridge_solved, "select distinct origin_id, destination_id, 1::bigint as solved from demand_daily")


def _weeks(rows, keys):
    week = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.min("date").alias("first_day"), F.min("predicted_trips").alias("least"),
                                   F.max(F.col("total_predicted_week")).alias("total"), F.sum(F.col("predicted_trips").cast("decimal(20,1)")).cast("double").alias("added"))
    good = (F.col("span") == 6) & (F.col("least") >= 0) & (F.abs(F.col("total") - F.col("added")) < 0.06)
    return week.select(*keys, "days", "first_day", F.when(good, 1).otherwise(0).alias("adds_up"))


add("demand_forecast_holds", lambda f: _weeks(route_forecast(f), R),
    f"select origin_id, destination_id, 7::bigint as days, {day('(max(trip_date)+1)')} as first_day, 1::bigint as adds_up from demand_daily join top_volume using (origin_id, destination_id) group by 1,2")
add("fleet_forecast_holds", lambda f: _weeks(D.fleet_forecast(daily(f)).withColumn("fleet", F.lit("all")), ["fleet"]), f"select 'all' as fleet, 7::bigint as days, {day('(max(trip_date)+1)')} as first_day, 1::bigint as adds_up from demand_daily")
add("forecast_lookup_holds", lambda f: _weeks(D.forecast_lookup(route_forecast(f), f.route_summary), R).agg(F.count(F.lit(1)).alias("n_routes"), F.sum("adds_up").alias("adds_up")),
    "select least(10,count(*)) as n_routes, least(10,count(*)) as adds_up from top_volume")


def route_forecast(f):
    return f.stored("demand_forecast", lambda: D.demand_forecast(daily(f)))


add("forecast_lookup", lambda f: D.forecast_lookup(route_forecast(f), f.route_summary))


def one_route(f, origin, destination):
    """The route is picked first, so only its series is forecast; a route outside the busiest has no forecast."""
    busiest = D.top_series(daily(f), R, 50, 14).select(*R)
    route = f.route_summary.filter((F.col("origin") == origin) & (F.col("destination") == destination)).join(busiest, R, "left_semi")
    return D.forecast_lookup(D.demand_forecast(daily(f).join(route.select(*R), R, "left_semi"), k=1), route, origin, destination)


add("forecast_lookup_route", lambda f: one_route(f, "NATION_0", "NATION_1"))

# clients
CTE["cl_raw"] = "select *, trim(customer_name) as client from raw"
CTE["cl_daily"] = "select client, cast(trip_start as date) as trip_date, count(*) as trip_count from cl_raw group by 1,2"
CTE["cl_series"] = "select client, list(cast(trip_count as double) order by trip_date) as ys from cl_daily group by 1"
TAIL = lambda a, b: f"list_transform(range(len(ys)-{a},len(ys){b}), lambda k: {SMOOTH.format(x='ys[1:k]')})"
MEAN7 = lambda a, b: f"list_reduce({TAIL(a, b)}, lambda p, q: p+q)/7"
CTE["cl_growth0"] = f"select client, len(ys) as days, case when len(ys)>30 then ({MEAN7(6, "+1")}-{MEAN7(29, "-22")})/greatest({MEAN7(29, "-22")},1.0::double)*100 else 0.0::double end as g from cl_series"
CTE["cl_growth"] = f"select client, {i('days')} as days, {r('g', 1)} as growth_pct_30d, case when g>5 then 'growing' when g<-5 then 'declining' else 'stable' end as trend from cl_growth0"
add("client_daily", lambda f: D.client_daily(f.raw), f"select * replace ({day('trip_date')} as trip_date) from cl_daily")
add("client_growth", lambda f: D.client_growth(clients_daily(f)), "select * from cl_growth")


def place_daily(f):
    """Receiving places taken as clients: single customers have about ten active days here, too few for a forecast."""
    return f.stored("place_daily", lambda: D.client_daily(f.raw.withColumn("customer_name", F.col("destination"))))


add("client_growth_places", lambda f: D.client_growth(place_daily(f)), "select * from pl_growth")
add("client_forecast", lambda f: D.client_forecast(place_daily(f)))
for _n in ("cl_daily", "cl_series", "cl_growth0", "cl_growth"):
    CTE[_n.replace("cl_", "pl_")] = re.sub(r"\bcl_(daily|series|growth0)\b", r"pl_\1", CTE[_n]).replace("from cl_raw", "from (select destination as client, trip_start from raw)")
DAYS = ", ".join(f"{i(f'sum(case when isodow(trip_start)={n + 1} then 1 else 0 end)')} as {name.lower()}" for n, name in enumerate(D.DAY_NAMES))
CTE["cl_profile"] = f"""select a.client, total_trips, {r('total_trips/weeks', 1)} as avg_trips_per_week, first_trip, last_trip, {i('floor(weeks)')} as active_weeks, mon, tue, wed, thu, fri, sat, sun, top_routes, monthly_trend from (
 select client, count(*) as total_trips, greatest(1.0::double, floor((epoch_us(max(trip_start))-epoch_us(min(trip_start)))/86400000000.0::double)/7) as weeks, {day('min(trip_start)')} as first_trip, {day('max(trip_start)')} as last_trip, {DAYS}
 from cl_raw group by 1 having count(*)>=10) a
 left join (select client, string_agg(concat(origin,' -> ',destination),'|' order by rn) as top_routes from (select client, origin, destination, row_number() over (partition by client order by count(*) desc, origin, destination) as rn from cl_raw group by 1,2,3) where rn<=5 group by 1) p on a.client=p.client
 left join (select client, string_agg(concat(mth,':',n),'|' order by mth) as monthly_trend from (select client, strftime(trip_start,'%Y-%m') as mth, count(*) as n, row_number() over (partition by client order by strftime(trip_start,'%Y-%m') desc) as rn from cl_raw group by 1,2) where rn<=12 group by 1) m on a.client=m.client"""
add("client_profile", lambda f: D.client_profile(f.raw_table), "select * from cl_profile")


def names(f):
    return f.customers.select(F.col("cne_name").alias("client"))


def match_sql(text):
    t = text.lower()
    return f"""with h as (select c_name as client, case when c_name='{text}' then 1 when lower(c_name)='{t}' then 2 when contains(lower(c_name),'{t}') then 3 end as level from customer)
 select client, match from (select client, case when level=1 then 'exact' when level=2 then 'case-insensitive' when (select count(*) from h where level=3)=1 then 'partial' else 'ambiguous' end as match,
 row_number() over (order by client) as k from h where level=(select min(level) from h)) where k<=10 or match<>'ambiguous'"""


add("client_match", lambda f: D.client_match(names(f), "mer#00000001"), match_sql("mer#00000001"))
add("client_match_case", lambda f: D.client_match(names(f), "CUSTOMER#000000012"), match_sql("CUSTOMER#000000012"))
add("client_match_partial", lambda f: D.client_match(names(f), "#000000123"), match_sql("#000000123"))
CTE["cl_top"] = "select * from (select client, sum(trip_count) as tot, count(*) as dd from cl_daily group by 1 order by tot desc, client limit 100) where dd>=30"


def _top_growth(f):
    top = D.top_series(clients_daily(f), ["client"], 100, 30).select("client")
    return D.client_growth(clients_daily(f).join(top, "client", "left_semi"))


add("client_overview", lambda f: D.client_overview(D.client_profile(f.raw_table), _top_growth(f)),
    f"select p.client, total_trips, avg_trips_per_week, active_weeks, coalesce(g.trend,'unknown') as trend, {i('case when g.client is null then 0 else 1 end')} as has_forecast from cl_profile p left join (select * from cl_growth where client in (select client from cl_top)) g on p.client=g.client")
