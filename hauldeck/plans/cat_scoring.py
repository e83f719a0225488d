"""Registered queries: scores, recommendations, fatigue, anomalies."""

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import anomaly as A
from ..operators import fatigue as G
from ..operators import reads as R
from ..operators import recommend as M
from ..operators import scoring as S
from .cat_loading import SQL_SPEED_REC, SQL_SPEED_SCORER
from .sqltext import CTE, RATE, avg2, d, i, r, ts

ENTRIES = {}


def add(key, build, sql=None):
    ENTRIES[key] = (build, sql)


def score_input(f):
    return f.stored("driver_score_input", lambda: S.driver_score_input(f.driver_summary, S.driver_trip_stats(f.trips)))


def scores(f):
    return f.stored("driver_scores", lambda: S.driver_score(score_input(f)))


CTE["trip_stats_d"] = f"""select driver_id, {r('stddev_pop(cast(trip_duration_minutes as double))')} as duration_stddev, {r('stddev_pop(cast(avg_speed_kmph as double))')} as speed_stddev,
 {i('sum(case when eta_delay_minutes>120 then 1 else 0 end)')} as severe_delays, {i('sum(case when hour(trip_start)>=22 or hour(trip_start)<=5 then 1 else 0 end)')} as night_trips, count(*) as total
 from rel group by 1 having count(*)>=3"""
CTE["score_input"] = "select s.*, t.* exclude (driver_id) from driver_summary s left join trip_stats_d t on s.driver_id=t.driver_id where total_trips>=3"
CTE["score_priors"] = """select cast(sum(cast(eta_success_rate as decimal(12,4))) as double)/count(eta_success_rate) as rate, max(total_trips) as top,
 quantile_cont(duration_stddev,0.95) as spread, quantile_cont(total_distance_km/total_trips,0.5) as km from score_input"""
CTE["score_parts"] = f"""select driver_id, driver_name, total_trips, least(100::double,greatest(0::double,(total_trips*eta_success_rate+15*rate)/(total_trips+15))) as eta_score,
 {SQL_SPEED_SCORER.replace('v', 'avg_speed_kmph')} as speed_score, least(100::double,greatest(0::double,(1-coalesce(duration_stddev,spread)/spread)*100)) as consistency_score,
 ln(1+total_trips)/ln(1+top)*100 as experience_score, (1-least(1::double,abs(total_distance_km/total_trips-km)/km))*100 as efficiency_score,
 least(0.5::double,cast(severe_delays as double)/total_trips)*20 as safety_penalty from score_input, score_priors"""
CTE["scores"] = f"""select *, {r('least(100::double,greatest(0::double,eta_score*0.35::double+speed_score*0.15::double+consistency_score*0.20::double+experience_score*0.20::double+efficiency_score*0.10::double-safety_penalty))')} as composite_score from score_parts"""
RISK = "case when composite_score<=35 then 'critical' when composite_score<=55 then 'high' when composite_score<=75 then 'medium' else 'low' end"
PARTS = ["eta_score", "speed_score", "consistency_score", "experience_score", "efficiency_score", "safety_penalty"]
add("driver_trip_stats", lambda f: S.driver_trip_stats(f.trips), "select * from trip_stats_d")
add("driver_score_input", lambda f: S.driver_score_input(f.driver_summary, S.driver_trip_stats(f.trips)), "select * from score_input")
add("driver_score", lambda f: S.driver_score(score_input(f)).withColumns({p: rnd(p, 4) for p in PARTS}),
    f"select driver_id, driver_name, total_trips, composite_score, {RISK} as risk_level, " + ", ".join(f"{r(p, 4)} as {p}" for p in PARTS) + " from scores")
add("risk_distribution", lambda f: S.risk_distribution(scores(f)),
    f"select {RISK} as risk_level, count(*) as drivers, {r('cast(sum(cast(composite_score as decimal(12,4))) as double)/count(*)')} as avg_score from scores group by 1")


def prediction_tables(f):
    """Two versions of the scorer; the second is active and scores differ by version."""
    spark = f.spark
    models = spark.range(1, 3).select("id", F.lit("driver_scorer").alias("model_name"), F.col("id").alias("version"), F.when(F.col("id") == 2, 1).otherwise(0).alias("is_active"))
    old = S.score_predictions(scores(f), 1, "2025-01-01 00:00:00").withColumn("predicted_value", F.lit(0.0))
    return old.unionByName(S.score_predictions(scores(f), 2, "2025-02-01 00:00:00")), models


add("driver_score_lookup", lambda f: S.driver_score_lookup(*prediction_tables(f)).select("driver_id", "predicted_value", "version"),
    "select driver_id, composite_score as predicted_value, cast(2 as bigint) as version from scores")
add("driver_score_list", lambda f: S.driver_score_list(S.driver_score_lookup(*prediction_tables(f)), f.drivers),
    f"select driver_id, driver_name, composite_score, {RISK} as risk_level, cast(2 as bigint) as version from scores order by composite_score desc, driver_id limit 100")

# ---------------------------------------------------------------- recommendations
def perf(f):
    return f.stored("driver_route_perf", lambda: M.driver_route_perf(f.trips))


def overall(f):
    return f.driver_summary.filter("total_trips >= 2")


def prior(f):
    return M.fleet_priors(f.driver_summary, perf(f)).select("global_avg_eta_success").scalar()


def requests(f):
    """Every known route."""
    return f.route_summary.select("origin_id", "destination_id")


CTE["perf"] = f"""select driver_id, origin_id, destination_id, count(*) as route_trips, {avg2('trip_duration_minutes')} as avg_duration_min, {avg2('avg_speed_kmph')} as avg_speed_kmph, {avg2('trip_km')} as avg_distance_km,
 {RATE} as eta_success_rate, {avg2('eta_delay_minutes')} as avg_delay_min, {r('stddev_pop(cast(trip_duration_minutes as double))')} as duration_stddev from rel group by 1,2,3 having count(*)>=2"""
CTE["overall2"] = "select * from driver_summary where total_trips>=2"
MEAN = lambda c: f"coalesce(nullif(cast(sum(cast({c} as decimal(12,4))) as double)/count({c}),0)"
CTE["fleet_prior"] = f"select {MEAN('avg_speed_kmph')},40.0::double) as global_avg_speed, {MEAN('eta_success_rate')},50.0::double) as global_avg_eta_success from overall2"
EXPERIENCE = "least(100.0::double,ln(1+total_trips)/ln(201)*100)"
CTE["exact_parts"] = f"""select *, least(100.0::double,ln(1+route_trips)/ln(31)*100) as p1, least(100.0::double,(route_trips*eta_success_rate+10*pr)/(route_trips+10)) as p2, {SQL_SPEED_REC} as p3,
 case when route_trips<=1 then 50.0 when coalesce(duration_stddev,0)=0 then 100.0 else greatest(0.0::double,100-duration_stddev/greatest(avg_duration_min,1.0)*100) end as p4, {EXPERIENCE} as p5
 from (select p.*, o.driver_name, coalesce(o.total_trips,p.route_trips) as total_trips, p.avg_speed_kmph as v, (select global_avg_eta_success from fleet_prior) as pr from perf p left join overall2 o on p.driver_id=o.driver_id)"""
COMPOSITE = lambda w: r("+".join(f"p{n + 1}*{x}::double" for n, x in enumerate(w)))
SCORE_COLS = f"{r('p1')} as route_experience_score, {r('p2')} as eta_compliance_score, {r('p3')} as speed_efficiency_score, {r('p4')} as consistency_score, {r('p5')} as overall_experience_score"
CTE["exact_scores"] = f"select driver_id, driver_name, origin_id, destination_id, route_trips, total_trips, {COMPOSITE((0.25, 0.30, 0.15, 0.10, 0.20))} as composite_score, {SCORE_COLS} from exact_parts"
CTE["similar_pairs"] = """select q.origin_id, q.destination_id, p.driver_id, sum(p.route_trips) as n, cast(sum(cast(p.eta_success_rate as decimal(12,4))) as double)/count(*) as rate, cast(sum(cast(p.avg_speed_kmph as decimal(12,4))) as double)/count(*) as v
 from route_summary q join perf p on (p.origin_id=q.origin_id and p.destination_id<>q.destination_id) or (p.destination_id=q.destination_id and p.origin_id<>q.origin_id)
 where not exists (select 1 from perf e where e.driver_id=p.driver_id and e.origin_id=q.origin_id and e.destination_id=q.destination_id) group by 1,2,3"""
CTE["similar_parts"] = f"""select *, least(80.0::double,ln(1+n)/ln(31)*80) as p1, least(100.0::double,(n*rate+15*pr)/(n+15)) as p2, {SQL_SPEED_REC} as p3, 50.0 as p4, {EXPERIENCE} as p5
 from (select s.*, o.driver_name, o.total_trips, (select global_avg_eta_success from fleet_prior) as pr from similar_pairs s join overall2 o on s.driver_id=o.driver_id)"""
CTE["similar_scores"] = f"select driver_id, driver_name, origin_id, destination_id, {i('n')} as similar_route_trips, total_trips, {COMPOSITE((0.20, 0.30, 0.15, 0.10, 0.25))} as composite_score, {SCORE_COLS} from similar_parts"
CTE["similar_top"] = "select * exclude (rn) from (select *, row_number() over (partition by origin_id, destination_id order by composite_score desc, driver_id) as rn from similar_scores) where rn<=10"
add("driver_route_perf", lambda f: M.driver_route_perf(f.trips), "select * from perf")
add("fleet_priors", lambda f: M.fleet_priors(f.driver_summary, perf(f)).withColumns({c: rnd(c, 6) for c in ("global_avg_speed", "global_avg_eta_success")}),
    f"select {r('global_avg_speed', 6)} as global_avg_speed, {r('global_avg_eta_success', 6)} as global_avg_eta_success, (select count(distinct origin_id*100000+destination_id) from perf) as unique_routes, (select count(distinct driver_id) from perf) as unique_drivers from fleet_prior")
EXACT = ["driver_id", "driver_name", "origin_id", "destination_id", "route_trips", "total_trips", "composite_score", "route_experience_score", "eta_compliance_score", "speed_efficiency_score", "consistency_score", "overall_experience_score"]
add("recommend_exact", lambda f: M.recommend_exact(perf(f), overall(f), prior(f)).select(*EXACT), "select * from exact_scores")
add("recommend_similar", lambda f: M.recommend_similar(perf(f), overall(f), requests(f), prior(f)), "select * from similar_top")
CTE["recommended"] = """select * exclude (c) from (select *, row_number() over (partition by origin_id, destination_id order by c, composite_score desc, driver_id) as rank from (
 select *, cast(0 as bigint) as similar_route_trips, 'experienced' as category, 1 as c from exact_scores union all by name select *, cast(0 as bigint) as route_trips, 'similar_route' as category, 2 as c from similar_scores)) where rank<=10"""


def recommended(f):
    return f.stored("recommended", lambda: M.recommend_drivers(perf(f), overall(f), requests(f), prior(f)))


add("recommend_drivers", lambda f: M.recommend_drivers(perf(f), overall(f), requests(f), prior(f)),
    "select * from recommended")
add("recommend_similar_routes", lambda f: M.similar_routes(recommended(f), perf(f), f.locations),
    """select s.*exclude (o, d, route_trips), concat(lo.name,' -> ',ld.name,' (',route_trips,' trips)') as route from (
 select q.origin_id as for_origin_id, q.destination_id as for_destination_id, q.driver_id, p.origin_id as o, p.destination_id as d, p.route_trips,
 row_number() over (partition by q.origin_id, q.destination_id, q.driver_id order by p.route_trips desc, p.origin_id, p.destination_id) as rank
 from recommended q join perf p on p.driver_id=q.driver_id and (p.origin_id=q.origin_id or p.destination_id=q.destination_id) where category='similar_route') s
 join locations lo on o=lo.id join locations ld on d=ld.id where rank<=3""")

# ---------------------------------------------------------------- fatigue
def features(f):
    return f.stored("fatigue_features", lambda: G.fatigue_features(f.trips, f.drivers))


CTE["fat_now"] = "select driver_id, max(trip_start) as now from rel group by 1 having count(*)>=3"
CTE["fat_week"] = """select driver_id, now, sum(case when trip_start>=now-to_days(1) then 1 else 0 end) as trips_last_24h, count(*) as trips_last_7d,
 cast(sum(case when trip_start>=now-to_days(1) then trip_duration_minutes else 0 end) as double)/60 as hours_driving_last_24h, cast(sum(trip_duration_minutes) as double)/60 as hours_driving_last_7d,
 sum(case when hour(trip_start)>=22 or hour(trip_start)<=5 then 1 else 0 end) as night_trips_last_7d from rel join fat_now using (driver_id) where trip_start>=now-to_days(7) group by 1,2"""
CTE["fat_20"] = "select * from (select rel.*, row_number() over (partition by driver_id order by trip_start desc, dispatch_entry_no) as k from rel join fat_now using (driver_id)) where k<=20"
CTE["fat_recent"] = """select driver_id, cast(sum(trip_duration_minutes) as double)/count(*) as avg_trip_duration_recent, cast(max(trip_duration_minutes) as double) as max_trip_duration_recent,
 cast(sum(coalesce(avg_speed_kmph,0)) as double)/count(*) as avg_speed_recent, stddev_samp(cast(coalesce(avg_speed_kmph,0) as double)) as speed_variance_recent,
 cast(sum(case when coalesce(eta_met,0)=0 then 1 else 0 end) as double)*100/count(*) as eta_delay_rate_recent, cast(sum(coalesce(eta_delay_minutes,0)) as double)/count(*) as avg_delay_min_recent,
 max(case when k=1 then coalesce(trip_end,trip_start) end) as t1, max(case when k=2 then trip_start end) as t2 from fat_20 group by 1"""
CTE["fat_days"] = "select driver_id, dy, lag(dy) over (partition by driver_id order by dy desc) as later from (select distinct driver_id, cast(trip_start as date) as dy from rel)"
CTE["fat_run"] = """select driver_id, 1 + count(*) filter (dy > brk) - count(*) filter (dy > brk and later is null) as consecutive_days_active from (
 select d.*, coalesce((select max(b.dy) from fat_days b where b.driver_id=d.driver_id and date_diff('day',b.dy,b.later)>1), date '1900-01-01') as brk from fat_days d) group by 1"""
CTE["fat_raw"] = """select w.*, r.* exclude (driver_id, t1, t2), greatest(0.0::double,cast(epoch_us(t1)-epoch_us(t2) as double)/3.6e9) as hours_since_last_trip, case when hour(now)>=22 or hour(now)<=5 then 1 else 0 end as is_current_night,
 consecutive_days_active from fat_week w join fat_recent r using (driver_id) join fat_run using (driver_id)"""
CTE["fat"] = """select f.*, d.name as driver_name, case when hours_driving_last_24h>10 then 3 when hours_driving_last_24h>7 then 2 else 0 end + case when trips_last_24h>=4 then 2 else 0 end + case when night_trips_last_7d>=3 then 1 else 0 end
 + case when consecutive_days_active>=7 then 2 when consecutive_days_active>=5 then 1 else 0 end + case when hours_since_last_trip<4 and trips_last_24h>=2 then 2 else 0 end
 + case when eta_delay_rate_recent>40 then 1 else 0 end + case when speed_variance_recent>15 then 1 else 0 end as fatigue_score from fat_raw f join drivers d on f.driver_id=d.id"""
_INT = ("trips_last_24h", "trips_last_7d", "night_trips_last_7d", "is_current_night", "consecutive_days_active")
FAT_COLS = ", ".join(f"{i(c)} as {c}" if c in _INT else f"{r(c)} as {c}" for c in G.FATIGUE_FEATURES)
CTE["fatf"] = f"select driver_id, driver_name, now, {FAT_COLS}, {i('fatigue_score')} as fatigue_score, {i('case when fatigue_score>=4 then 1 else 0 end')} as is_fatigued from fat"
FRISK = "case when fatigue_score>=7 then 'critical' when fatigue_score>=5 then 'high' when fatigue_score>=3 then 'medium' else 'low' end"
H0 = "cast(round_even(hours_driving_last_24h,0) as bigint)"


def factor_sql(texts, sep):
    h, t24, days, nights, rest = texts
    return f"""concat_ws('{sep}', case when hours_driving_last_24h>7 then concat('{h[0]}',{H0},'{h[1]}') end, case when trips_last_24h>=4 then concat(trips_last_24h,'{t24}') end,
 case when consecutive_days_active>=5 then concat(consecutive_days_active,'{days}') end, case when night_trips_last_7d>=3 then concat(night_trips_last_7d,'{nights}') end,
 case when hours_since_last_trip<4 and trips_last_24h>=2 then '{rest}' end)"""


add("fatigue_input", lambda f: G.fatigue_input(f.trips, f.drivers),
    f"""select t.driver_id, d.name as driver_name, dispatch_entry_no, {ts('trip_start')} as trip_start, {ts('trip_end')} as trip_end, {d('trip_duration_minutes')} as trip_duration_minutes,
 {d('avg_speed_kmph')} as avg_speed_kmph, {i('eta_met')} as eta_met, {d('eta_delay_minutes')} as eta_delay_minutes, {i('hour(trip_start)')} as start_hour from rel t join drivers d on t.driver_id=d.id""")
add("fatigue_features", lambda f: G.fatigue_features(f.trips, f.drivers), f"select * replace ({ts('now')} as now) from fatf")
add("fatigue_score", lambda f: features(f).select("driver_id", "fatigue_score", "is_fatigued"), "select driver_id, fatigue_score, is_fatigued from fatf")
add("fatigue_status", lambda f: G.fatigue_status(features(f)).select("driver_id", "driver_name", "fatigue_score", "risk_level", "factors"),
    f"select driver_id, driver_name, fatigue_score, {FRISK} as risk_level, {factor_sql(G.STATUS_TEXTS, '|')} as factors from fatf")
add("fatigue_status_counts", lambda f: G.fatigue_counts(features(f)), f"select {FRISK} as risk_level, count(*) as drivers from fatf group by 1")
add("fatigue_status_top", lambda f: G.fatigue_top(features(f)),
    f"""select risk_level, driver_id, driver_name, fatigue_score, hours_driving_last_24h as hours_driving_24h, trips_last_24h as trips_24h, consecutive_days_active as consecutive_days, night_trips_last_7d as night_trips_7d from (
 select *, row_number() over (partition by risk_level order by fatigue_score desc, driver_id) as rn from (select *, {FRISK} as risk_level from fatf) where risk_level in ('critical','high')) where rn<=20""")
CTE["fat_alerts"] = f"""select 'fatigue' as alert_type, case when fatigue_score>=7 then 'high' when fatigue_score>=5 then 'medium' else 'low' end as severity, driver_id, cast(null as varchar) as trip_no, cast(null as bigint) as vehicle_id,
 'Driver Fatigue Risk' as title, concat('Driver ',driver_name,': fatigue risk score ',fatigue_score,'/10. ',{factor_sql(G.ALERT_TEXTS, '; ')}) as message, now as created_at from fatf where fatigue_score>=4 order by fatigue_score desc, driver_id limit 50"""
add("fatigue_alerts", lambda f: G.fatigue_alerts(features(f)), f"select * replace ({ts('created_at')} as created_at) from fat_alerts")
add("recent_alerts", lambda f: R.recent_alerts(G.fatigue_alerts(features(f))),
    f"select * replace ({ts('created_at')} as created_at) from (select * from fat_alerts order by created_at desc, driver_id limit 20)")

# ---------------------------------------------------------------- anomalies
def anomaly_rows(f):
    return A.anomaly_input(f.trips, f.drivers, f.locations, f.route_summary)


def anomaly_table(f):
    return f.stored("anomaly_features", lambda: A.anomaly_features(anomaly_rows(f)))


def anomaly_store(f):
    """The folder of the model that was fitted on all trips."""
    return f.model("anomaly_detector", lambda: A.AnomalyForest().fit(anomaly_table(f)))


def anomaly_forest(f):
    return A.AnomalyForestModel.load(anomaly_store(f))


def scored(f):
    """All trips by the stored model."""
    return f.stored("anomaly_scores", lambda: anomaly_forest(f).transform(anomaly_table(f)))


def fresh(f):
    """Trips of the scan's window without an alert."""
    return A.unscanned_trips(anomaly_table(f), slow_trip_alerts(f), f.trips.agg(F.max("trip_start")).scalar(), SCAN_DAYS)


SCAN_DAYS = 365


CTE["an_in"] = """select t.* exclude (origin, destination, driver_name), lo.name as origin_name, ld.name as destination_name, dr.name as driver_name, s.avg_duration_min as route_avg_duration, s.avg_distance_km as route_avg_distance, s.eta_success_rate as route_eta_success
 from rel t left join locations lo on t.origin_id=lo.id left join locations ld on t.destination_id=ld.id left join drivers dr on t.driver_id=dr.id left join route_summary s on t.origin_id=s.origin_id and t.destination_id=s.destination_id"""
AN = f"""dispatch_entry_no, {d('trip_duration_minutes')} as trip_duration_minutes, {d('eta_delay_minutes')} as eta_delay_minutes, {d('avg_speed_kmph')} as avg_speed_kmph, {d('trip_km')} as trip_km, {ts('trip_start')} as trip_start,
 driver_id, vehicle_id, origin_name, destination_name, driver_name, route_avg_duration, route_avg_distance, route_eta_success"""
add("anomaly_input", anomaly_rows, f"select {AN} from an_in")
add("anomaly_features", lambda f: A.anomaly_features(anomaly_rows(f)).select(
        "dispatch_entry_no", "trip_duration_minutes", "eta_delay_minutes", rnd("duration_ratio", 6).alias("duration_ratio"), rnd("delay_ratio", 6).alias("delay_ratio"), "hour_deviation", "is_night_trip"),
    f"""select dispatch_entry_no, {d('trip_duration_minutes')} as trip_duration_minutes, coalesce({d('eta_delay_minutes')},0) as eta_delay_minutes,
 {r('coalesce(cast(trip_duration_minutes as double)/nullif(route_avg_duration,0),1.0)', 6)} as duration_ratio, {r('coalesce(cast(eta_delay_minutes as double),0)/coalesce(nullif(route_avg_duration,0),1)', 6)} as delay_ratio,
 {d('least(hour(trip_start),24-hour(trip_start))')} as hour_deviation, {d('case when hour(trip_start)>=22 or hour(trip_start)<=5 then 1 else 0 end')} as is_night_trip from an_in""")


def slow_trip_alerts(f):
    """Stand-in alert table: trips over twice their route's mean."""
    return anomaly_rows(f).filter(F.col("trip_duration_minutes") > 2 * F.col("route_avg_duration")).select(
        F.lit("anomaly").alias("alert_type"), F.col("dispatch_entry_no").alias("trip_no"))


add("unscanned_trips", lambda f: A.unscanned_trips(anomaly_rows(f), slow_trip_alerts(f), f.trips.agg(F.max("trip_start")).scalar(), SCAN_DAYS).select("dispatch_entry_no", "driver_id", "trip_start"),
    f"select dispatch_entry_no, driver_id, {ts('trip_start')} as trip_start from an_in where trip_start>=(select max(trip_start) from trips)-to_days(365) and not (cast(trip_duration_minutes as double)>2*route_avg_duration)")
add("anomaly_model", lambda f: scored(f).select("dispatch_entry_no", "raw_score", "anomaly_score", "is_anomaly"))
add("anomaly_contrib", lambda f: A.anomaly_contrib(scored(f)))
add("anomaly_alerts", lambda f: A.anomaly_alerts(scored(f)))
add("anomaly_alerts_scan", lambda f: A.anomaly_alerts(anomaly_forest(f).transform(fresh(f)), 200, with_route=True))

# The same steps on a stated score, minutes over minutes plus the route's mean, which SQL can repeat.
STATED = "coalesce(duration_ratio/(1+duration_ratio),0)"


def stated(f):
    return A.anomaly_flags(anomaly_table(f).withColumn("raw_score", F.expr(STATED)))


CTE["an_feat"] = """select *, cast(trip_duration_minutes as double) as minutes, coalesce(cast(trip_duration_minutes as double)/nullif(route_avg_duration,0),1.0) as duration_ratio, coalesce(cast(eta_delay_minutes as double),0) as delay,
 coalesce(cast(eta_delay_minutes as double),0)/coalesce(nullif(route_avg_duration,0),1) as delay_ratio, cast(least(hour(trip_start),24-hour(trip_start)) as double) as hour_deviation, cast(case when hour(trip_start)>=22 or hour(trip_start)<=5 then 1 else 0 end as double) as is_night_trip from an_in"""
CTE["an_raw"] = f"select *, {STATED} as raw_score from an_feat"
CTE["an_flags"] = """select *, (raw_score-lo)/(hi-lo+1e-8) as anomaly_score, case when raw_score>cut then 1 else 0 end as is_anomaly from an_raw, (select min(raw_score) as lo, max(raw_score) as hi, quantile_cont(raw_score,0.95) as cut from an_raw)"""
SEVERITY = "case when anomaly_score<0.7 then 'low' when anomaly_score<0.85 then 'medium' else 'high' end"
SCORE_TEXT = "printf('Anomaly score: %.3f', anomaly_score)"


def _alerts_sql(rows, limit, text):
    return f"""select 'anomaly' as alert_type, {SEVERITY} as severity, driver_id, dispatch_entry_no as trip_no, vehicle_id, 'Anomalous Trip Detected' as title, {text} as message, {ts('trip_start')} as created_at
 from (select * from {rows} where is_anomaly=1 order by anomaly_score desc, dispatch_entry_no limit {limit})"""


MEAN = "coalesce(route_avg_duration,0)"
add("anomaly_flags_stated", lambda f: stated(f).select("dispatch_entry_no", rnd("anomaly_score", 6).alias("anomaly_score"), "is_anomaly"),
    f"select dispatch_entry_no, {r('anomaly_score', 6)} as anomaly_score, cast(is_anomaly as bigint) as is_anomaly from an_flags")
add("anomaly_contrib_stated", lambda f: A.anomaly_contrib(stated(f)), " union all ".join(
    f"select '{name}' as feature, round(abs(avg(case when is_anomaly=1 then {x} end)-avg(case when is_anomaly=0 then {x} end))/coalesce(nullif(stddev_samp(case when is_anomaly=0 then {x} end),0),1),3) as z_score from an_flags"
    for name, x in zip(A.ANOMALY_FEATURES, ("minutes", "delay", "duration_ratio", "delay_ratio", "hour_deviation", "is_night_trip"), strict=True)))
add("anomaly_alerts_stated", lambda f: A.anomaly_alerts(stated(f)),
    _alerts_sql("an_flags", 100, f"case when {MEAN}>0 then printf('Trip duration (%.0f min) is %.1fx the route average (%.0f min). ', minutes, minutes/nullif({MEAN},0), {MEAN})||{SCORE_TEXT} else {SCORE_TEXT} end"))
# what must hold for the stored model's scores, whatever the trees: one row of counts
SCAN_HOLDS = {"n_rows": "count(*)", "n_in_range": "count_if(anomaly_score between 0 and 1)", "n_flagged_ordinary": "count_if(is_anomaly=1 and raw_score<0.4)"}
add("anomaly_scan_holds", lambda f: anomaly_forest(f).transform(fresh(f)).agg(*[F.expr(x).alias(c) for c, x in SCAN_HOLDS.items()]),
    f"select count(*) as n_rows, count(*) as n_in_range, cast(0 as bigint) as n_flagged_ordinary from an_in where trip_start>=(select max(trip_start) from trips)-to_days(365) and not (cast(trip_duration_minutes as double)>2*route_avg_duration)")
