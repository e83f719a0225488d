"""Building blocks of the checking SQL: named common table expressions and rounding text."""

import re


def r(x: str, digits: int = 2) -> str:
    return f"cast(round(cast({x} as decimal(38,10)),{digits}) as double)"


def davg(x: str) -> str:
    return f"(cast(sum({x}) as double)/nullif(cast(count({x}) as double),0))"


def avg2(x: str, digits: int = 2) -> str:
    return r(davg(x), digits)


def share(cond: str) -> str:
    return f"(cast(sum(case when {cond} then 1 else 0 end) as double)*100/nullif(cast(count(*) as double),0))"


RATE = r(share("eta_met=1"))


def i(x: str) -> str:
    return f"cast({x} as bigint)"


def d(x: str) -> str:
    return f"cast({x} as double)"


def ts(x: str) -> str:
    return f"strftime({x},'%Y-%m-%d %H:%M:%S')"


def day(x: str) -> str:
    return f"strftime({x},'%Y-%m-%d')"


def minutes(a: str, b: str) -> str:
    return f"cast({r(f'cast(epoch_us({b})-epoch_us({a}) as double)/60000000')} as decimal(12,2))"


RELIABLE = "eta_data_status='available' and trip_duration_minutes is not null and trip_duration_minutes>0"

CTE: dict[str, str] = {}

CTE["rawk"] = """
select l_orderkey*7+l_partkey*3+l_linenumber as k, cast(l_quantity*36 as bigint)+60 as plan_min, l.*, o.*, c.c_name, c.c_nationkey,
 s.s_name, s.s_nationkey, so.n_name as origin, sd.n_name as destination
from lineitem l join orders o on l_orderkey=o_orderkey join customer c on o_custkey=c_custkey
join supplier s on l_suppkey=s_suppkey join nation so on s_nationkey=so.n_nationkey join nation sd on c_nationkey=sd.n_nationkey"""
CTE["rawt"] = """
select *, o_orderdate + to_days(8750) + to_minutes(cast(case when k%11=0 then 300 else k%1440 end as integer)) as trip_start,
 case when k%101=0 then -30 when k%103=0 then 0 when k%107=0 then 20000 else plan_min+k%241-120 end as dur from rawk"""
CTE["raw"] = """
select concat('D',l_orderkey,'-',l_linenumber) as dispatch_entry_no, l_suppkey as driver_id, s_name as driver_name, concat('9',l_suppkey) as driver_mobile,
 l_partkey as vehicle_id, concat('V',l_partkey) as asset_id, o_custkey as customer_id, c_name as customer_name,
 cast(s_nationkey as bigint) as origin_id, origin, cast(c_nationkey as bigint) as destination_id, destination,
 trip_start, trip_start+to_minutes(cast(dur as integer)) as trip_end_raw,
 case when k%7<>0 then trip_start+to_minutes(cast(dur as integer)) end as ata_in,
 trip_start+to_minutes(cast(plan_min+30 as integer)) as trip_eta, trip_start as dt_created, trip_start+to_days(cast(k%5 as integer)) as dt_updated,
 case when k%17=0 then null when k%19=0 then 0.0 when k%29=0 then l_quantity*200 else l_quantity*20 end as trip_km,
 case o_orderstatus when 'F' then 'C' when 'O' then 'O' end as trip_status,
 cast(l_extendedprice/10 as decimal(12,3)) as load_weight_kg, l_quantity, l_extendedprice, l_shipdate
from rawt"""
CTE["first_rows"] = """
select * from raw qualify row_number() over (partition by dispatch_entry_no order by driver_order)=1""".replace(
    "driver_order", "vehicle_id, driver_id, l_quantity, l_extendedprice, l_shipdate")
CTE["route_km"] = f"select origin, destination, {r(davg('cast(trip_km as decimal(12,4))'))} as route_km from first_rows where trip_km>0 group by 1,2"
CTE["screened0"] = """
select f.* exclude (trip_km), case when f.trip_km is null or f.trip_km<=0 then k.route_km else f.trip_km end as trip_km,
 coalesce(ata_in, trip_end_raw) as trip_end, case when ata_in is not null then 'available' else 'eta_data_unavailable' end as eta_data_status
from first_rows f left join route_km k on f.origin=k.origin and f.destination=k.destination"""
CTE["screened1"] = f"""
select *, case when trip_end>=trip_start then {minutes('trip_start', 'trip_end')} end as trip_duration_minutes,
 case when trip_end<=trip_eta then 1 when trip_end>trip_eta then 0 end as eta_met,
 greatest({minutes('trip_eta', 'trip_end')}, cast(0 as decimal(12,2))) as eta_delay_minutes,
 case when hour(trip_start)=5 and minute(trip_start)=0 and second(trip_start)=0 then 1 else 0 end as is_5am_default from screened0"""
CTE["screened"] = """
select *, case when trip_start<timestamp '2019-01-01 00:00:00' then 'trip_start before 2019' when trip_end<trip_start then 'ata_in before trip_start'
 when trip_duration_minutes=0 then 'zero duration' when trip_duration_minutes<0 then 'negative duration' end as reject_reason from screened1"""
CTE["capped"] = """
select * replace (cast(case when trip_km>5000 then 5000 else trip_km end as decimal(12,2)) as trip_km,
 cast(case when trip_duration_minutes>14400 then 14400 else trip_duration_minutes end as decimal(12,2)) as trip_duration_minutes)
from screened where reject_reason is null"""
SPEED = "cast(case when trip_km<>0 and trip_duration_minutes>0 then " + r("cast(trip_km as double)/(cast(trip_duration_minutes as double)/60)") + " end as decimal(12,2))"
CTE["speeded"] = f"select *, {SPEED} as raw_speed from capped"
CTE["trips"] = """select * exclude (raw_speed), case when raw_speed>120 then cast(120 as decimal(12,2)) else raw_speed end as avg_speed_kmph from speeded"""
CTE["trips_loose"] = f"""
select * exclude (trip_km, trip_duration_minutes, avg_speed_kmph), cast(trip_km as decimal(12,2)) as trip_km, trip_duration_minutes, avg_speed_kmph
from (select *, {SPEED} as avg_speed_kmph from screened)"""
CTE["drivers"] = "select s_suppkey as id, s_name as name, concat('9',s_suppkey) as mobile1 from supplier"
CTE["vehicles"] = "select p_partkey as id, concat('V',p_partkey) as asset_id, p_type as asset_type from part"
CTE["locations"] = "select cast(n_nationkey as bigint) as id, n_name as name from nation"
CTE["customers"] = "select c_custkey as id, c_name as cne_name from customer"
CTE["rel"] = f"select * from trips where {RELIABLE}"
CTE["rel0"] = "select * from trips where eta_data_status='available' and trip_duration_minutes is not null"
CTE["waypoints"] = f"""
select *, cast(case when status like 'Moving %' then cast(substr(status,8) as double) when status='Stopped' then 0.0 end as decimal(8,2)) as speed_kmph from (
 select event_id as id, user_id as vehicle_id, ts as recorded_at,
 case when event_type in ('view','click') then concat('Moving ', cast(floor(value) as integer)) when event_type='error' then 'Stopped' else 'Idle' end as status,
 cast({r('value/10')} as decimal(10,2)) as distance_from_prev from events)"""
CTE["expenses"] = f"select event_id as id, cast(ts as date) as date, cast({r('value')} as decimal(12,2)) as amount, event_type as category from events"
DRIVER_FIGURES = f"""count(*) as total_trips, {i('sum(case when eta_met=1 then 1 else 0 end)')} as eta_met_count, {RATE} as eta_success_rate,
 {avg2('trip_duration_minutes')} as avg_duration_min, {d('max(trip_duration_minutes)')} as max_duration_min, {d('min(trip_duration_minutes)')} as min_duration_min,
 {avg2('avg_speed_kmph')} as avg_speed_kmph, count(distinct vehicle_id) as vehicles_used, {r('sum(trip_km)')} as total_distance_km,
 {avg2('trip_km')} as avg_distance_km, {avg2('eta_delay_minutes')} as avg_eta_delay_min"""
for _name, _src in (("driver_summary", "rel"), ("driver_summary_all", "trips")):
    CTE[_name] = f"""select t.driver_id, d.name as driver_name, d.mobile1 as driver_mobile, {DRIVER_FIGURES}
 from {_src} t join drivers d on t.driver_id=d.id group by 1,2,3"""
ROUTE_FIGURES = f"""count(*) as trip_count, {avg2('trip_duration_minutes')} as avg_duration_min, {avg2('avg_speed_kmph')} as avg_speed_kmph,
 {RATE} as eta_success_rate, {avg2('trip_km')} as avg_distance_km"""
for _name, _src, _arrow in (("route_summary", "rel", " -> "), ("route_summary_all", "trips", " → ")):
    CTE[_name] = f"""select origin_id, destination_id, lo.name as origin, ld.name as destination, concat(lo.name,'{_arrow}',ld.name) as route_name, {ROUTE_FIGURES}
 from {_src} t join locations lo on t.origin_id=lo.id join locations ld on t.destination_id=ld.id group by 1,2,3,4,5"""
CTE["vehicle_summary"] = f"""select t.vehicle_id, v.asset_id, v.asset_type, count(*) as total_trips, count(distinct driver_id) as drivers_used,
 {avg2('avg_speed_kmph')} as avg_speed_kmph, {r('sum(trip_km)')} as total_distance_km, {avg2('trip_km')} as avg_distance_km, {RATE} as eta_success_rate
 from rel t join vehicles v on t.vehicle_id=v.id group by 1,2,3"""
CTE["daily_fleet_stats"] = f"""select cast(trip_start as date) as stat_date, count(*) as total_trips, {r('sum(trip_km)')} as total_distance_km,
 {avg2('avg_speed_kmph')} as avg_speed, {RATE} as eta_success_rate, count(distinct driver_id) as active_drivers, count(distinct vehicle_id) as active_vehicles
 from rel0 group by 1"""
CTE["route_time_patterns"] = f"""select origin_id, destination_id, lo.name as origin, ld.name as destination, {i('hour(trip_start)')} as hour_of_day,
 {i('dayofweek(trip_start)+1')} as day_of_week, {avg2('trip_duration_minutes')} as avg_duration, count(*) as trip_count, {RATE} as eta_success_rate
 from rel0 t join locations lo on t.origin_id=lo.id join locations ld on t.destination_id=ld.id group by 1,2,3,4,5,6 having count(*)>=2"""
CTE["named"] = """select t.* exclude (driver_name, driver_mobile, origin, destination, asset_id, customer_name), dr.name as driver_name, dr.mobile1 as driver_mobile, v.asset_id, v.asset_type,
 lo.name as origin_name, ld.name as destination_name, c.cne_name as customer_name
 from trips t left join drivers dr on t.driver_id=dr.id left join vehicles v on t.vehicle_id=v.id
 left join locations lo on t.origin_id=lo.id left join locations ld on t.destination_id=ld.id left join customers c on t.customer_id=c.id"""


def with_ctes(body: str) -> str:
    """Puts every needed CTE (found by name, transitively) in front of the query."""
    if body.startswith("with recursive"):  # brings its own
        return body
    order: list[str] = []

    def need(text: str):
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in CTE and word not in order:
                # reserve position after its own needs
                if word not in pending:
                    pending.add(word)
                    need(CTE[word])
                    order.append(word)

    pending: set[str] = set()
    need(body)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as materialized ({CTE[n].strip()})" for n in order) + "\n" + body
