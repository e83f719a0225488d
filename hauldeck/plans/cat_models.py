"""Registered queries: model inputs, metrics, sequences, trained models, network."""

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import fatigue as G
from ..operators import features as X
from ..operators import graph as N
from ..operators import metrics as Q
from ..operators import models as M
from ..operators import registry as R
from ..operators import sequences as S
from ..operators import summaries
from .cat_loading import naive_predictions
from .cat_reads import _all_drivers, _all_routes
from .cat_scoring import features as fatigue_rows
from .sqltext import CTE, RATE, avg2, d, davg, i, r, ts

ENTRIES = {}
NO = "dispatch_entry_no"


def add(key, build, sql=None):
    ENTRIES[key] = (build, sql)


def rounded(df, columns, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in columns})


def as_sql(columns, digits=6):
    return ", ".join(f"{r(c, digits)} as {c}" for c in columns)


# ---------------------------------------------------------------- arrival features
CTE["with_sums"] = """select t.* exclude (trip_km), cast(trip_km as double) as trip_km, s.avg_duration_min as route_avg_duration, s.avg_distance_km as route_avg_distance, s.avg_speed_kmph as route_avg_speed, s.trip_count as route_trip_count, s.eta_success_rate as route_eta_success,
 ds.avg_duration_min as driver_avg_duration, ds.avg_speed_kmph as driver_avg_speed, ds.eta_success_rate as driver_eta_success, ds.total_trips as driver_total_trips, ds.vehicles_used as driver_vehicles_used,
 vs.avg_speed_kmph as vehicle_avg_speed, vs.total_trips as vehicle_total_trips, vs.eta_success_rate as vehicle_eta_success,
 hour(trip_start) as hour, isodow(trip_start)-1 as day_of_week, case when isodow(trip_start)>=6 then 1 else 0 end as is_weekend, month(trip_start) as month,
 case when hour(trip_start) between 6 and 11 then 0 when hour(trip_start) between 12 and 16 then 1 when hour(trip_start) between 17 and 20 then 2 else 3 end as time_bucket_encoded,
 s.avg_duration_min as time_pattern_avg_duration, s.trip_count as time_pattern_trip_count, s.eta_success_rate as time_pattern_eta_success
 from trips t left join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id left join driver_summary ds on t.driver_id=ds.driver_id left join vehicle_summary vs on t.vehicle_id=vs.vehicle_id"""
REL = "eta_data_status='available' and trip_duration_minutes>0"


def filled(columns, default="0", digits=6):
    return ", ".join(f"{r(f'coalesce(cast({c} as double),{default})', digits)} as {c}" for c in columns)


CTE["eta_rows"] = f"select dispatch_entry_no, {d('trip_duration_minutes')} as target, {filled(X.ETA_FEATURES)} from with_sums where {REL} and trip_duration_minutes<50000"


def eta_rows(f):
    return f.stored("eta_features", lambda: X.eta_features(f.trips, f))


add("eta_features", lambda f: rounded(X.eta_features(f.trips, f), X.ETA_FEATURES), "select * from eta_rows")


def requests(f):
    """Every deduplicated trip as a request; some without driver, vehicle or distance."""
    return f.first.withColumns({
        "driver_id": F.when(F.col("trip_status").isNotNull(), F.col("driver_id")), "vehicle_id": F.when(F.col("ata_in").isNotNull(), F.col("vehicle_id"))})


CTE["requests"] = "select * exclude (driver_id, vehicle_id), case when trip_status is not null then driver_id end as driver_id, case when ata_in is not null then vehicle_id end as vehicle_id from first_rows"
NZ = lambda c: f"nullif(cast({c} as double),0)"
CTE["serve0"] = f"""select t.dispatch_entry_no, hour(trip_start) as hour, isodow(trip_start)-1 as day_of_week, case when isodow(trip_start)>=6 then 1 else 0 end as is_weekend, month(trip_start) as month,
 case when hour(trip_start) between 6 and 11 then 0 when hour(trip_start) between 12 and 16 then 1 when hour(trip_start) between 17 and 20 then 2 else 3 end as time_bucket_encoded,
 s.avg_duration_min as route_avg_duration, s.avg_distance_km as route_avg_distance, s.trip_count as route_trip_count, s.eta_success_rate as route_eta_success,
 coalesce({NZ('ds.avg_duration_min')},{NZ('s.avg_duration_min')}) as driver_avg_duration, coalesce({NZ('ds.avg_speed_kmph')},{NZ('s.avg_speed_kmph')},20.0) as driver_avg_speed,
 coalesce({NZ('ds.eta_success_rate')},{NZ('s.eta_success_rate')}) as driver_eta_success, ds.total_trips as driver_total_trips, ds.vehicles_used as driver_vehicles_used,
 coalesce({NZ('vs.avg_speed_kmph')},{NZ('s.avg_speed_kmph')},20.0) as vehicle_avg_speed, vs.total_trips as vehicle_total_trips, coalesce({NZ('vs.eta_success_rate')},{NZ('s.eta_success_rate')}) as vehicle_eta_success,
 coalesce({NZ('p.avg_duration')},{NZ('s.avg_duration_min')}) as time_pattern_avg_duration, coalesce({NZ('p.trip_count')},s.trip_count) as time_pattern_trip_count, coalesce({NZ('p.eta_success_rate')},{NZ('s.eta_success_rate')}) as time_pattern_eta_success,
 coalesce({NZ('t.trip_km')},{NZ('s.avg_distance_km')}) as trip_km, case when strftime(trip_start,'%H:%M:%S')='05:00:00' then 1 else 0 end as is_5am_default
 from requests t left join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id left join driver_summary ds on t.driver_id=ds.driver_id left join vehicle_summary vs on t.vehicle_id=vs.vehicle_id
 left join route_time_patterns p on t.origin_id=p.origin_id and t.destination_id=p.destination_id and p.hour_of_day=hour(trip_start) and p.day_of_week=dayofweek(trip_start)+1"""
add("eta_features_serving", lambda f: rounded(X.eta_features_serving(requests(f), f), X.ETA_FEATURES), f"select dispatch_entry_no, {filled(X.ETA_FEATURES)} from serve0")
LT = f"""dispatch_entry_no, {ts('trip_start')} as trip_start, {ts('trip_end')} as trip_end, {ts('ata_in')} as ata_in, {d('trip_duration_minutes')} as trip_duration_minutes, {d('trip_km')} as trip_km, {d('avg_speed_kmph')} as avg_speed_kmph, {i('eta_met')} as eta_met,
 {d('eta_delay_minutes')} as eta_delay_minutes, driver_id, origin_id, destination_id, origin_name as origin, destination_name as destination, asset_type"""
CTE["legacy_in"] = "select * from named where trip_status='C' and ata_in is not null and trip_duration_minutes>0"
CTE["legacy_kept"] = "select * from legacy_in where trip_duration_minutes>=10 and trip_duration_minutes<=21600"
CTE["legacy_lim"] = "select origin_id, destination_id, count(*) as n, quantile_cont(cast(trip_duration_minutes as double),0.05) as lo, quantile_cont(cast(trip_duration_minutes as double),0.95) as hi from legacy_kept group by 1,2"


def legacy_in(f):
    return f.stored("legacy_input", lambda: X.legacy_training_input(f.trips, f))


add("legacy_training_input", lambda f: X.legacy_training_input(f.trips, f), f"select {LT} from legacy_in")
add("legacy_clean", lambda f: X.legacy_clean(legacy_in(f)).select(NO, "origin", "destination", "trip_duration_minutes"),
    f"select dispatch_entry_no, origin_name as origin, destination_name as destination, {d('trip_duration_minutes')} as trip_duration_minutes from legacy_kept k join legacy_lim l on k.origin_id=l.origin_id and k.destination_id=l.destination_id where n<10 or cast(trip_duration_minutes as double) between lo and hi")
CTE["legacy_med"] = "select quantile_cont(cast(trip_duration_minutes as double),0.5) as md, coalesce(quantile_cont(cast(avg_speed_kmph as double),0.5),20) as ms, coalesce(quantile_cont(cast(trip_km as double),0.5),0) as mk from legacy_in"
LSTAT = """coalesce(r.avg_duration_min,{md}) as route_avg_duration, coalesce(r.avg_distance_km,{mk}) as route_avg_distance, coalesce(cast(r.trip_count as double),0) as route_trip_count, coalesce({nz}(r.eta_success_rate{z}),50) as route_eta_success_rate,
 coalesce(dr.avg_duration_min,{md}) as driver_avg_duration, coalesce(dr.avg_speed_kmph,{ms}) as driver_avg_speed, coalesce({nz}(dr.eta_success_rate{z}),50) as driver_eta_success_rate, coalesce(cast(dr.total_trips as double),0) as driver_total_trips, coalesce(dr.avg_distance_km,{mk}) as driver_avg_distance"""
LCAL = """hour(trip_start) as hour_of_day, isodow(trip_start)-1 as day_of_week, case when isodow(trip_start)>=6 then 1 else 0 end as is_weekend, month(trip_start) as month,
 case when hour(trip_start)<=6 then 0 when hour(trip_start)<=12 then 1 when hour(trip_start)<=18 then 2 else 3 end as time_bucket"""
LDER = """case when {cond} then driver_avg_duration/route_avg_duration else 1.0 end as driver_vs_route_duration_ratio, case when driver_avg_speed>0 then distance_km/driver_avg_speed*60 else route_avg_duration end as speed_estimated_duration,
 ln(1+driver_total_trips) as driver_experience_log, ln(1+route_trip_count) as route_popularity_log"""
LJOIN = "left join route_summary_all r on t.origin_id=r.origin_id and t.destination_id=r.destination_id left join driver_summary_all dr on t.driver_id=dr.driver_id"
CTE["legacy_f0"] = f"select t.dispatch_entry_no, cast(trip_duration_minutes as double) as target, {LCAL}, {LSTAT.format(md='md', mk='mk', ms='ms', nz='', z='')}, cast(t.trip_km as double) as km, case when t.driver_id is null then 0 else 1 end as has_driver from legacy_in t {LJOIN}, legacy_med".replace(f"from legacy_in t {LJOIN}, legacy_med", f"from legacy_med, legacy_in t {LJOIN}")
CTE["legacy_f1"] = "select *, coalesce(km,route_avg_distance) as distance_km from legacy_f0"
CTE["legacy_f"] = f"select *, {LDER.format(cond='route_avg_duration>0')} from legacy_f1"
add("eta_features_legacy", lambda f: rounded(X.eta_features_legacy(legacy_in(f), _all_drivers(f), _all_routes(f)), X.LEGACY_FEATURES), f"select dispatch_entry_no, target, {filled(X.LEGACY_FEATURES)} from legacy_f")
CTE["legacy_s0"] = f"select t.dispatch_entry_no, {LCAL}, {LSTAT.format(md='0', mk='0', ms='0', nz='nullif', z=',0')}, t.trip_km as km, case when dr.driver_id is null then 0 else 1 end as has_driver from requests t {LJOIN}"
CTE["legacy_s1"] = "select *, coalesce(km,route_avg_distance) as distance_km from legacy_s0"
CTE["legacy_s"] = f"select *, {LDER.format(cond='route_avg_duration>0 and driver_avg_duration>0')} from legacy_s1"
add("eta_features_legacy_serving", lambda f: rounded(X.eta_features_legacy_serving(requests(f), _all_drivers(f), _all_routes(f)), X.LEGACY_FEATURES), f"select dispatch_entry_no, {filled(X.LEGACY_FEATURES)} from legacy_s")
add("quantile_trim", lambda f: X.quantile_trim(eta_rows(f)).select(NO, "target"),
    "select dispatch_entry_no, target from eta_rows where target between (select quantile_cont(target,0.01) from eta_rows) and (select quantile_cont(target,0.99) from eta_rows)")
SHARE = lambda key: f"(cast('0x'||substr(md5(cast({key} as varchar)||'#42'),1,8) as bigint)/4294967296.0::double)"
add("split_80_20", lambda f: M.split_80_20(eta_rows(f)).select(NO, "is_test"), f"select dispatch_entry_no, cast(case when {SHARE('dispatch_entry_no')}<0.2::double then 1 else 0 end as bigint) as is_test from eta_rows")

# ---------------------------------------------------------------- metrics
CTE["naive"] = "select t.*, s.avg_duration_min as p, cast(trip_duration_minutes as double) as y, trip_start+to_microseconds(cast(round(s.avg_duration_min*60000000) as bigint)) as arr from rel t join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id"


def metrics_sql(src, guard="0", y="y", p="p"):
    pct = lambda c: r(f"avg(case when {c} then 1.0 else 0.0 end)*100")
    return f"""select count(*) as samples, {r(f'avg(abs({y}-{p}))', 4)} as mae, {r(f'sqrt(avg(({y}-{p})*({y}-{p})))', 4)} as rmse, {r(f'1-sum(({y}-{p})*({y}-{p}))/(var_pop({y})*count({y})+{guard})', 4)} as r2,
 {r(f'avg(case when {y}<>0 then abs({y}-{p})/abs({y}) end)*100')} as mape, {pct(f'abs({y}-{p})<=15')} as within_15min, {pct(f'abs({y}-{p})<=30')} as within_30min, {pct(f'abs({y}-{p})<=60')} as within_60min,
 {pct(f'{y}>0 and abs({y}-{p})/{y}<=0.20')} as within_20_pct from {src}"""


add("regression_metrics", lambda f: Q.regression_metrics(naive_predictions(f), "trip_duration_minutes", "predicted_duration_minutes"), metrics_sql("naive"))


def naive_arrivals(f):
    from ..functions.trips import arrival_time

    return naive_predictions(f).withColumn("predicted_arrival", arrival_time(F.col("trip_start"), F.col("predicted_duration_minutes")))


PCT = lambda c: r(f"avg(case when {c} then 1.0 else 0.0 end)*100")
add("arrival_metrics", lambda f: Q.arrival_metrics(naive_arrivals(f)),
    f"""select {r('avg(e)')} as mean_arrival_error_hours, {r('quantile_cont(e,0.5)')} as median_arrival_error_hours, {r('avg(s)')} as bias_hours, {PCT('e<=1')} as within_1h_pct, {PCT('e<=2')} as within_2h_pct,
 {PCT('e<=4')} as within_4h_pct, {PCT('e<=8')} as within_8h_pct, count(*) as test_samples from (select s, abs(s) as e from (select cast(epoch_us(arr)-epoch_us(ata_in) as double)/3.6e9 as s from naive))""")

# ---------------------------------------------------------------- on-time model
CTE["history"] = f"select driver_id, origin_id, destination_id, count(*) as driver_route_trips, {RATE} as driver_route_eta_success from trips where eta_met is not null and {REL} group by 1,2,3"
CTE["sla_rows"] = f"select dispatch_entry_no, {i('eta_met')} as label, " + ", ".join(
    f"{r(f'''coalesce(cast({c} as double),{50 if 'eta_success' in c else 0})''', 6)} as {c}" for c in X.SLA_FEATURES) + f""" from with_sums w left join history h on w.driver_id=h.driver_id and w.origin_id=h.origin_id and w.destination_id=h.destination_id
 where {REL} and eta_met is not null and (coalesce(route_avg_duration,0)>0 or coalesce(trip_km,0)>0)"""


def sla_rows(f):
    return f.stored("sla_features", lambda: X.sla_features(X.sla_input(f.trips, f), X.driver_route_history(f.trips)))


add("driver_route_history", lambda f: X.driver_route_history(f.trips), "select * from history")
SLA_IN = ["route_avg_duration", "route_trip_count", "route_eta_success", "route_avg_distance", "driver_avg_duration", "driver_avg_speed", "driver_eta_success", "driver_total_trips", "vehicle_avg_speed", "vehicle_total_trips", "vehicle_eta_success"]
add("sla_input", lambda f: X.sla_input(f.trips, f).select(NO, "eta_met", "driver_id", "vehicle_id", *SLA_IN), f"select dispatch_entry_no, {i('eta_met')} as eta_met, driver_id, vehicle_id, {', '.join(SLA_IN)} from with_sums where {REL} and eta_met is not null")
add("sla_features", lambda f: rounded(X.sla_features(X.sla_input(f.trips, f), X.driver_route_history(f.trips)), X.SLA_FEATURES), "select * from sla_rows")


def given_scores(f):
    """Mean of driver and route rates as the on-time probability."""
    return sla_rows(f).withColumn("probability", (F.col("driver_eta_success") + F.col("route_eta_success")) / 200)


CTE["given_scores"] = "select *, (driver_eta_success+route_eta_success)/200 as probability from sla_rows"
CTE["by_score"] = "select cast(probability as double) as p, sum(case when label=1 then 1 else 0 end) as pos, sum(case when label=1 then 0 else 1 end) as neg from given_scores group by 1"
CTE["cls"] = """select cast(sum(case when p>=0.5 then pos else 0 end) as double) as tp, cast(sum(case when p>=0.5 then neg else 0 end) as double) as fp, cast(sum(pos) as double) as np, cast(sum(neg) as double) as nn, cast(sum(pos*(nb+neg/2.0::double)) as double) as w
 from (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding),0) as nb from by_score)"""
add("classification_metrics", lambda f: Q.classification_metrics(given_scores(f)),
    f"""select {r('(tp+nn-fp)/(np+nn)', 4)} as accuracy, {r('coalesce(tp/nullif(tp+fp,0),0)', 4)} as precision, {r('coalesce(tp/nullif(np,0),0)', 4)} as recall,
 {r('coalesce(2*(tp/nullif(tp+fp,0))*(tp/np)/nullif(tp/nullif(tp+fp,0)+tp/np,0),0)', 4)} as f1_score, {r('w/nullif(np*nn,0)', 4)} as auc_roc, {i('np')} as on_time, {i('nn')} as delayed from cls""")
PC = lambda c: f"cast(round_even({c},0) as bigint)"
add("sla_risk", lambda f: X.sla_risk(given_scores(f)).select(NO, "prediction", "risk_level", "risk_message", "contributing_factors"),
    f"""select dispatch_entry_no, case when probability>=0.5 then 'on_time' else 'likely_delayed' end as prediction, case when probability>=0.85 then 'low' when probability>=0.65 then 'medium' when probability>=0.45 then 'high' else 'critical' end as risk_level,
 case when probability>=0.85 then 'High confidence of on-time delivery' when probability>=0.65 then 'Moderate risk of delay — monitor this trip' when probability>=0.45 then 'Significant delay risk — consider alternatives' else 'Very likely to miss ETA — intervene now' end as risk_message,
 concat_ws('|', case when driver_route_trips=0 then 'Driver has no experience on this route' when driver_route_eta_success<50 then concat('Driver''s route ETA success is low (',{PC('driver_route_eta_success')},'%)') end,
 case when route_eta_success<60 then concat('This route has low overall ETA success (',{PC('route_eta_success')},'%)') end, case when driver_eta_success<60 then concat('Driver overall ETA success is low (',{PC('driver_eta_success')},'%)') end,
 case when hour>=22 or hour<=5 then 'Night-time trip — historically lower on-time rates' end) as contributing_factors from given_scores""")


CTE["record"] = f"select driver_id, origin_id, destination_id, count(*) as driver_route_trips, {r('cast(sum(case when eta_met=1 then 1 else 0 end) as double)/count(*)*100')} as driver_route_eta_success from trips where {REL} and driver_id is not null group by 1,2,3"
OR50 = lambda c: f"coalesce(nullif(cast({c} as double),0),50.0)"
CTE["sla_serve"] = f"""select t.dispatch_entry_no, hour(trip_start) as hour, isodow(trip_start)-1 as day_of_week, case when isodow(trip_start)>=6 then 1 else 0 end as is_weekend, month(trip_start) as month, s.avg_duration_min as route_avg_duration, s.trip_count as route_trip_count,
 {OR50('s.eta_success_rate')} as route_eta_success, s.avg_distance_km as route_avg_distance, ds.avg_duration_min as driver_avg_duration, ds.avg_speed_kmph as driver_avg_speed, {OR50('ds.eta_success_rate')} as driver_eta_success, ds.total_trips as driver_total_trips,
 vs.avg_speed_kmph as vehicle_avg_speed, vs.total_trips as vehicle_total_trips, {OR50('vs.eta_success_rate')} as vehicle_eta_success, s.avg_duration_min as time_pattern_avg_duration, s.trip_count as time_pattern_trip_count, {OR50('s.eta_success_rate')} as time_pattern_eta_success,
 t.trip_km as trip_km, h.driver_route_trips as driver_route_trips, {OR50('h.driver_route_eta_success')} as driver_route_eta_success, coalesce(s.eta_success_rate,0) as route_eta_known, coalesce(ds.eta_success_rate,0) as driver_eta_known
 from requests t left join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id left join driver_summary ds on t.driver_id=ds.driver_id left join vehicle_summary vs on t.vehicle_id=vs.vehicle_id
 left join record h on t.driver_id=h.driver_id and t.origin_id=h.origin_id and t.destination_id=h.destination_id"""
SERVED = [*X.SLA_FEATURES, "route_eta_known", "driver_eta_known"]


def sla_served(f):
    return f.stored("sla_served", lambda: X.sla_features_serving(requests(f), f))


add("sla_features_serving", lambda f: rounded(sla_served(f), SERVED), f"select dispatch_entry_no, {filled(SERVED)} from sla_serve")
add("sla_risk_serving", lambda f: X.sla_risk(sla_served(f).withColumn("probability", (F.col("driver_eta_success") + F.col("route_eta_success")) / 200)).select(NO, "risk_level", "contributing_factors"),
    f"""select dispatch_entry_no, case when p>=0.85 then 'low' when p>=0.65 then 'medium' when p>=0.45 then 'high' else 'critical' end as risk_level,
 concat_ws('|', case when coalesce(driver_route_trips,0)=0 then 'Driver has no experience on this route' when driver_route_eta_success<50 then concat('Driver''s route ETA success is low (',{PC('driver_route_eta_success')},'%)') end,
 case when route_eta_known<60 then concat('This route has low overall ETA success (',{PC('route_eta_known')},'%)') end, case when driver_eta_known<60 then concat('Driver overall ETA success is low (',{PC('driver_eta_known')},'%)') end,
 case when hour>=22 or hour<=5 then 'Night-time trip — historically lower on-time rates' end) as contributing_factors from (select *, (driver_eta_success+route_eta_success)/200 as p from sla_serve)""")


def parts_of(f, name, rows):
    """Train and test rows, stored."""
    both = f.stored(f"{name}_split", lambda: M.split_80_20(rows()))
    return both.filter("is_test = 0").drop("is_test"), both.filter("is_test = 1").drop("is_test")


def sla_trained(f):
    train, test = parts_of(f, "sla", lambda: sla_rows(f))
    return f.trained("sla_predictor", lambda: M.trained_classifier(train, test, X.SLA_FEATURES))


add("sla_model", lambda f: sla_trained(f)[1])
# what must hold for a trained model, whatever its trees: one row
add("sla_model_holds", lambda f: sla_trained(f)[1].select(*[(F.col("on_time") + F.col("delayed")).alias("n_test"), "n_train", (F.col("auc_roc") > 0.5).cast("int").alias("better_than_chance")]),
    f"select count(*) filter ({SHARE('dispatch_entry_no')}<0.2::double) as n_test, count(*) filter ({SHARE('dispatch_entry_no')}>=0.2::double) as n_train, 1::bigint as better_than_chance from sla_rows")

# ---------------------------------------------------------------- fuel
CTE["fuel_rows"] = f"""select dispatch_entry_no, cast(null as double) as fuel_consumed, {filled([c for c in X.FUEL_FEATURES if c not in ('is_night_trip', 'speed_variance_proxy')], digits=10)}, {d('case when hour>=22 or hour<=5 then 1 else 0 end')} as is_night_trip,
 {r('abs(coalesce(cast(avg_speed_kmph as double),0)-coalesce(vehicle_avg_speed,0))', 10)} as speed_variance_proxy from with_sums where trip_duration_minutes>0"""
CTE["fuel_t"] = """select *, case when avg_speed_kmph>0 then greatest(avg_speed_kmph,1.0) else greatest(dist/greatest(trip_duration_minutes/60,0.01),1.0) end as sp from (
 select *, greatest(case when trip_km>0 then trip_km else trip_duration_minutes/60*40 end,0.1) as dist from fuel_rows)"""
CTE["fuel_tt"] = """select *, greatest(0.1::double,dist*0.35::double*(1+abs(sp-55)*0.005::double)*(1+least(load_weight_kg/20000,0.3::double))*(1-is_night_trip*0.03::double)*(1+0.15::double*least(1.0::double,greatest(0.0::double,(trip_duration_minutes-dist/sp*60)/greatest(dist/sp*60,1.0::double))))) as target from fuel_t"""


def fuel_rows(f):
    return f.stored("fuel_rows", lambda: X.fuel_target(X.fuel_features(f.trips, f)))


add("fuel_features", lambda f: rounded(X.fuel_features(f.trips, f), X.FUEL_FEATURES), f"select dispatch_entry_no, fuel_consumed, {as_sql(X.FUEL_FEATURES)} from fuel_rows")
add("fuel_target", lambda f: X.fuel_target(X.fuel_features(f.trips, f)).select(NO, rnd("target", 4).alias("litres")), f"select dispatch_entry_no, {r('target', 4)} as litres from fuel_tt")
add("fuel_fleet_stats", lambda f: X.fuel_fleet_stats(fuel_rows(f)),
    f"""select {r('avg(target)')} as avg_fuel_per_trip, {r('avg(target)/avg(trip_km)', 4)} as avg_fuel_per_km, {r('sum(target)', 0)} as total_predicted_fuel, {r('sum(trip_km)/sum(target)')} as fuel_efficiency_km_per_l, {r('avg(target)*88')} as avg_cost_per_trip from fuel_tt""")


def _fuel_model(f):
    train, test = parts_of(f, "fuel", lambda: X.quantile_trim(fuel_rows(f)))
    sized = {"gradient_boosting": M.boosted_regressor(200, 6, 0.1), "random_forest": M.forest_regressor(200, 10)}
    return M.compared({name: f.trained(f"fuel_{name}", lambda e=e: M.trained_regressor(train, test, X.FUEL_FEATURES, e))[1] for name, e in sized.items()})


add("fuel_model", _fuel_model)

# ---------------------------------------------------------------- sequences
CTE["seq"] = """select driver_id, dispatch_entry_no, trip_start, origin_id, destination_id, cast(trip_duration_minutes as double) as trip_duration_minutes, cast(trip_km as double) as trip_km, cast(avg_speed_kmph as double) as avg_speed_kmph, cast(eta_delay_minutes as double) as eta_delay_minutes,
 cast(hour(trip_start) as bigint) as hour, cast(isodow(trip_start)-1 as bigint) as day_of_week, cast(case when isodow(trip_start)>=6 then 1 else 0 end as bigint) as is_weekend, row_number() over (partition by driver_id order by trip_start, dispatch_entry_no) as n
 from trips where trip_duration_minutes>0 and trip_duration_minutes<50000"""
SEQ = f"select * replace ({ts('trip_start')} as trip_start) from seq"


def seq(f):
    return f.stored("sequence_input", lambda: S.sequence_input(f.trips))


add("sequence_input", lambda f: S.sequence_input(f.trips), SEQ)
ZS = {c: f"(coalesce(cast({c} as double),0)-(select avg(coalesce(cast({c} as double),0)) from seq))/(select stddev_samp(coalesce(cast({c} as double),0)) from seq)" for c in S.SEQUENCE_FEATURES}
CTE["seq_z"] = "select driver_id, dispatch_entry_no, n, trip_duration_minutes as target, " + ", ".join(f"{x} as z_{c}" for c, x in ZS.items()) + " from seq"
LAG = lambda c, k: f"lag({c},{k}) over (partition by driver_id order by n)"


def _sequences_flat(f):
    """All steps' values: ten trips of seven figures each."""
    rows = S.trip_sequences(seq(f))
    return rows.select("driver_id", NO, "n", "target", *[rnd(F.col("past")[k][f"z_{c}"], 4).alias(f"{c}_{k}") for k in range(10) for c in S.SEQUENCE_FEATURES])


add("trip_sequences", _sequences_flat,
    "select * from (select driver_id, dispatch_entry_no, n, target, " + ", ".join(f"{r(LAG(f'z_{c}', 10 - k), 4)} as {c}_{k}" for k in range(10) for c in S.SEQUENCE_FEATURES) + " from seq_z) where n>10")


def decay_rows(f):
    """The rows between the two quantiles, read from all of them."""
    return X.quantile_trim(f.stored("decay_all", lambda: S.decay_inputs(seq(f))))


def decay_train(f):
    return f.stored("decay_train", lambda: S.sequential_split(decay_rows(f)))


def decay_fit(f):
    return f.stored("decay_fit", lambda: S.decay_predictor(decay_train(f).filter("is_train = 1")))


def _w(decay):
    ws = [decay ** (9 - j) for j in range(10)]
    return "+".join(f"{LAG('trip_duration_minutes', 10 - j)}*{ws[j] / sum(ws)!r}::double" for j in range(10))


CTE["decay_all"] = "select * from (select driver_id, dispatch_entry_no, trip_start, n, trip_duration_minutes as target, " + ", ".join(f"{_w(x)} as w{k}" for k, x in enumerate(S.DECAYS)) + " from seq) where n>10"
CTE["decay_in"] = "select *, row_number() over (order by driver_id, trip_start, dispatch_entry_no) as pos from decay_all where target between (select quantile_cont(target,0.01) from decay_all) and (select quantile_cont(target,0.99) from decay_all)"
CTE["decay_tr"] = "select * from decay_in where pos<=floor((select count(*) from decay_in)*0.8::double)"
CTE["decay_f"] = " union all ".join(
    f"select {x}::double as decay, a as slope, b as intercept, (select avg(abs(target-(w{k}*a+b))) from decay_tr) as mae from (select regr_slope(target,w{k}) as a, regr_intercept(target,w{k}) as b from decay_tr)" for k, x in enumerate(S.DECAYS))
add("sequential_split", lambda f: decay_train(f).select("driver_id", NO, "is_train"), f"select driver_id, dispatch_entry_no, {i('case when pos<=floor((select count(*) from decay_in)*0.8::double) then 1 else 0 end')} as is_train from decay_in")
add("decay_predictor", lambda f: rounded(S.decay_predictor(decay_train(f).filter("is_train = 1")), ["slope", "intercept", "mae"], 4),
    f"select decay, {r('slope', 4)} as slope, {r('intercept', 4)} as intercept, {r('mae', 4)} as mae, {i('case when mae=(select min(mae) from decay_f) then 1 else 0 end')} as chosen from decay_f")
add("decay_forecast", lambda f: S.decay_forecast(seq(f), decay_fit(f)),
    f"""select driver_id, 10::bigint as sequence_length_used, {r('greatest(0.0::double,p)')} as predicted_duration_min, {r('greatest(0.0::double,greatest(0.0::double,p)-1.96::double*sd)')} as lower, {r('greatest(0.0::double,p)+1.96::double*sd')} as upper from (
 select driver_id, sum(pow(b.decay,k-1)*y)/((1-pow(any_value(b.decay),10))/(1-any_value(b.decay)))*any_value(b.slope)+any_value(b.intercept) as p, list_aggregate(list_resize(list(y order by k) filter (k<=5),5,0.0::double),'stddev_pop') as sd from (
 select driver_id, trip_duration_minutes as y, row_number() over (partition by driver_id order by n desc) as k from seq) s, (select * from decay_f order by mae limit 1) b where k<=10 group by 1)""")


def decay_scored(f):
    best = decay_fit(f).filter("chosen = 1").agg(F.max(F.struct("decay", "slope", "intercept")).alias("b")).scalar()
    w = F.lit(None).cast("double")
    for k, x in enumerate(S.DECAYS):
        w = F.when(best["decay"] == x, F.col(f"w{k}")).otherwise(w)
    return decay_train(f).filter("is_train = 0").withColumn("prediction", w * best["slope"] + best["intercept"])


BEST_W = "case (select decay from decay_f order by mae limit 1) " + " ".join(f"when {x}::double then w{k}" for k, x in enumerate(S.DECAYS)) + " end"
CTE["decay_te"] = f"select target as y, ({BEST_W})*(select slope from decay_f order by mae limit 1)+(select intercept from decay_f order by mae limit 1) as p from decay_in where pos>floor((select count(*) from decay_in)*0.8::double)"
add("sequence_metrics", lambda f: Q.regression_metrics(decay_scored(f), guard=1e-8), metrics_sql("decay_te", "1e-8"))

# ---------------------------------------------------------------- trained models
ETA_ESTIMATORS = {"gradient_boosting": M.boosted_regressor, "random_forest": M.forest_regressor}


def eta_split(f):
    return parts_of(f, "eta", lambda: X.quantile_trim(eta_rows(f)))


def eta_trained(f, name):
    return f.trained(f"eta_{name}", lambda: M.trained_regressor(*eta_split(f), X.ETA_FEATURES, ETA_ESTIMATORS[name]()))


def eta_compared(f):
    return f.stored("eta_compared", lambda: M.compared({name: eta_trained(f, name)[1] for name in ETA_ESTIMATORS}))


def eta_best(f):
    """The model of the smallest test error."""
    return eta_trained(f, eta_compared(f).filter("is_best = 1").first()["model"])[0]


def _eta_model(f):
    """Both candidates, and the cross-validated error of the one that is used."""
    def validated():
        best = eta_compared(f).filter("is_best = 1").first()["model"]
        cv = M.cross_validate(eta_split(f)[0], X.ETA_FEATURES, ETA_ESTIMATORS[best]())
        return eta_compared(f).withColumn("cv_mae", F.when(F.col("is_best") == 1, rnd(F.lit(cv), 4)))

    return f.stored("eta_validated", validated)


add("eta_model", _eta_model)
add("eta_predict", lambda f: M.eta_predict(eta_best(f), X.eta_features_serving(requests(f), f), f.first))
add("feature_importance", lambda f: M.feature_importance(f.spark, eta_best(f), X.ETA_FEATURES))
CTE["eta_trimmed"] = "select *, " + SHARE("dispatch_entry_no") + " as share from eta_rows where target between (select quantile_cont(target,0.01) from eta_rows) and (select quantile_cont(target,0.99) from eta_rows)"
add("eta_model_holds", lambda f: eta_compared(f).crossJoin(eta_split(f)[1].agg(F.avg(F.abs(F.col("target") - eta_split(f)[0].agg(F.avg("target")).scalar())).alias("plain"))).filter("is_best = 1").select(
        F.col("samples").alias("n_test"), "n_train", (F.col("mae") < F.col("plain")).cast("int").alias("better_than_mean"), (F.col("n_trees") <= 300).cast("int").alias("within_size")),
    "select count(*) filter (share<0.2::double) as n_test, count(*) filter (share>=0.2::double) as n_train, 1::bigint as better_than_mean, 1::bigint as within_size from eta_trimmed")


def fatigue_trained(f):
    """The stored model and its metrics on held-out drivers; None where a class has too few drivers."""
    rows = M.fatigue_rows(fatigue_rows(f), G.FATIGUE_FEATURES)
    if not M.enough_of_both(rows):
        return None
    train, test = parts_of(f, "fatigue", lambda: rows.withColumn("dispatch_entry_no", F.col("driver_id").cast("string")))
    if not M.enough_of_both(train, 1):
        return None
    return f.trained("fatigue_predictor", lambda: M.trained_classifier(train, test, G.FATIGUE_FEATURES, trees=150, depth=5, rate=0.1))


def _fatigue_model(f):
    """Probabilities of the held-out drivers; none where the score decides."""
    found, scored = fatigue_trained(f), fatigue_rows(f).select("driver_id", "fatigue_score")
    if found is None:
        return scored.withColumn("probability", F.lit(None).cast("double"))
    test = parts_of(f, "fatigue", None)[1]
    return M.with_probability(found[0], test).select("driver_id", "probability").join(scored, "driver_id").select("driver_id", "fatigue_score", "probability")


add("fatigue_model", _fatigue_model)


def time_trained(f):
    train, test = parts_of(f, "time_aware", lambda: X.quantile_trim(eta_rows(f)))
    return f.trained("time_aware", lambda: M.trained_regressor(train, test, M.TIME_FEATURES, M.time_aware_regressor())), test


def _time_aware(f):
    (model, _), test = time_trained(f)
    return M.time_aware_estimates(model, test)


add("time_aware_duration", _time_aware)
add("time_aware_metrics", lambda f: time_trained(f)[0][1])


def _models_trained(f):
    """The model store as the register has it: one version per model, its metrics on held-out rows as JSON."""
    at = f.trips.agg(F.max("trip_start")).scalar()
    metrics = {"sla_predictor": sla_trained(f)[1], "time_aware": time_trained(f)[0][1], **{f"eta_{name}": eta_trained(f, name)[1] for name in ETA_ESTIMATORS}}
    out = None
    for name, table in metrics.items():
        row = table.select(F.lit(name).alias("model_name"), F.lit("tree ensemble").alias("model_type"), F.lit(at).alias("trained_at"), F.col("n_train").alias("training_data_count"), F.to_json(F.struct(*table.columns)).alias("metrics"))
        out = row if out is None else out.unionByName(row)
    return out


add("models_trained", lambda f: R.model_register(_models_trained(f)).withColumn("metrics", (F.length("metrics") > 2).cast("int")),
    f"""select model_name, 'tree ensemble' as model_type, {ts('(select max(trip_start) from trips)')} as trained_at, n as training_data_count, 1::bigint as metrics, 1::bigint as version, 1::bigint as is_active from (
 select unnest(['eta_gradient_boosting','eta_random_forest','time_aware']) as model_name, (select count(*) from eta_trimmed where share>=0.2::double) as n union all select 'sla_predictor', (select count(*) from sla_rows where {SHARE('dispatch_entry_no')}>=0.2::double))""")

# ---------------------------------------------------------------- network
CTE["edges"] = f"""select origin_name as origin, destination_name as destination, {avg2('trip_duration_minutes')} as avg_duration, {r('quantile_cont(cast(trip_duration_minutes as double),0.5)')} as median_duration, {r('stddev_samp(cast(trip_duration_minutes as double))')} as std_duration,
 {d('min(trip_duration_minutes)')} as min_duration, {d('max(trip_duration_minutes)')} as max_duration, coalesce({avg2('trip_km')},0) as avg_distance, coalesce({avg2('avg_speed_kmph')},0) as avg_speed, count(*) as trip_count, coalesce({r(davg('eta_met') + '*100')},0) as eta_success_rate
 from named where {REL} and trip_duration_minutes<50000 group by 1,2"""


def edges(f):
    return f.stored("route_edges", lambda: N.route_edges(f.trips, f.locations))


add("route_edges", lambda f: N.route_edges(f.trips, f.locations), "select * from edges")
add("graph_stats", lambda f: N.graph_stats(edges(f)),
    f"select count(*) as total_edges, (select count(distinct p) from (select origin as p from edges union all select destination from edges)) as total_locations, {r('cast(count(*) as double)/(select count(distinct p) from (select origin as p from edges union all select destination from edges))', 1)} as avg_connections_per_location from edges")
add("hub_locations", lambda f: N.hub_locations(f.trips, f.locations),
    f"""select name, {i('og')} as outgoing_trips, {i('ic')} as incoming_trips, {i('og+ic')} as total_trips, {r('cast(least(og,ic) as double)/greatest(greatest(og,ic),1)*100', 1)} as hub_score from (
 select l.name, (select count(*) from rel where origin_id=l.id) as og, (select count(*) from rel where destination_id=l.id) as ic from locations l) where og+ic>=100 order by og+ic desc, name limit 30""")
CTE["ew"] = "select origin, destination, cast(avg_duration as decimal(14,2)) as w from edges where origin<>destination"
CTE["two"] = """select s, e, cost, row_number() over (partition by s, e order by cost) as rn from (select origin as s, destination as e, w as cost from ew union all
 select a.origin, b.destination, a.w+b.w from ew a join ew b on a.destination=b.origin where a.origin<>b.destination)"""
CTE["lim"] = "select s, e, max(cost) as cap from two where rn<=3 group by 1,2 having count(*)=3"
# every requested pair grows its own paths; a path over the third-best short one can never be among the best three
KB = """with recursive {ctes}, walk(s, e, here, path, cost) as (
 select q.origin, q.destination, q.origin, [q.origin], cast(0 as decimal(20,2)) from route_summary q where q.origin<>q.destination
 union all select w.s, w.e, x.destination, list_append(w.path, x.destination), cast(w.cost+x.w as decimal(20,2)) from walk w join ew x on w.here=x.origin left join lim l on w.s=l.s and w.e=l.e
 where w.here<>w.e and len(w.path)<6 and not list_contains(w.path, x.destination) and (l.cap is null or w.cost+x.w<=l.cap)),
 best as (select s, e, path, cost, row_number() over (partition by s, e order by cost, path) as rank from walk where here=e union all select origin, destination, [origin], 0, 1 from route_summary where origin=destination)
 select s as start, e as end, rank, array_to_string(path,'|') as path, cast(cost as double) as total_duration_min, cast(len(path)-1 as bigint) as stops, cast(case when d.avg_duration is null then 0 else 1 end as bigint) as direct_available, d.avg_duration as direct_duration_min
 from best left join edges d on d.origin=s and d.destination=e where rank<=3"""


def k_best_sql():
    from .sqltext import with_ctes

    head = with_ctes("select 1 from route_summary, ew, lim, edges")
    ctes = head[len("with "):head.rindex("\nselect 1 from")]
    return KB.replace("{ctes}", ctes).replace("e as end,", 'e as "end",')


def pairs(f):
    return f.route_summary.select(F.col("origin").alias("start"), F.col("destination").alias("end"))


def best_paths(f):
    return f.stored("best_paths", lambda: N.k_best_routes(edges(f), pairs(f)))


add("k_best_routes", lambda f: N.k_best_routes(edges(f), pairs(f)), k_best_sql())
KB_LEGS = """select b.start, b."end", b.rank, leg, l[leg] as "from", l[leg+1] as "to", x.avg_duration as avg_duration_min, x.avg_distance as avg_distance_km, x.trip_count, x.eta_success_rate
 from (select *, unnest(range(1, stops+1)) as leg, string_split(path,'|') as l from ({best})) b join edges x on x.origin=l[leg] and x.destination=l[leg+1]"""


def segments_sql():
    whole = k_best_sql()
    cut = whole.rindex("\n select s as start")
    return whole[:cut] + "\n " + KB_LEGS.replace("{best}", whole[cut:])


add("k_best_routes_segments", lambda f: N.route_segments(best_paths(f), edges(f)), segments_sql())
