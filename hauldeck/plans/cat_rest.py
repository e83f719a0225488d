"""Registered queries: model register, question texts, ledger, streams."""

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import ledger as L
from ..operators import metrics as Q
from ..operators import partials as P
from ..operators import questions as K
from ..operators import registry as R
from ..operators import summaries
from ..streaming import refresh
from .sqltext import CTE, d, day, i, r, ts

ENTRIES = {}


def add(key, build, sql=None):
    ENTRIES[key] = (build, sql)


# ---------------------------------------------------------------- model register
METRICS = "trips bigint, avg_speed double"


def trainings(f):
    """One training per trip status and year: data volume and mean speed as metrics."""
    rows = f.trips.filter("trip_status is not null").groupBy(F.concat(F.lit("model_"), F.col("trip_status")).alias("model_name"), F.year("trip_start").alias("_y")).agg(
        F.max("trip_start").alias("trained_at"), F.count(F.lit(1)).alias("training_data_count"),
        F.to_json(F.struct(F.count(F.lit(1)).alias("trips"), rnd(F.sum("avg_speed_kmph").cast("double") / F.count("avg_speed_kmph")).alias("avg_speed"))).alias("metrics"))
    return rows.withColumn("model_type", F.lit("yearly")).drop("_y")


CTE["trainings"] = f"select concat('model_',trip_status) as model_name, max(trip_start) as trained_at, count(*) as training_data_count, {r('cast(sum(avg_speed_kmph) as double)/count(avg_speed_kmph)')} as avg_speed from trips where trip_status is not null group by 1, year(trip_start)"
CTE["models"] = "select *, 'yearly' as model_type, cast(row_number() over (partition by model_name order by trained_at) as bigint) as version, cast(case when row_number() over (partition by model_name order by trained_at desc)=1 then 1 else 0 end as bigint) as is_active from trainings"
MODEL_COLS = f"model_name, version, model_type, training_data_count, is_active, {ts('trained_at')} as trained_at, training_data_count as trips, avg_speed"
add("model_register", lambda f: R.model_register(trainings(f)).drop("metrics"), f"select model_name, model_type, version, is_active, training_data_count, {ts('trained_at')} as trained_at from models")


def _registered_twice(f):
    t = trainings(f)
    cut = F.make_timestamp(F.lit(2025), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))
    return R.add_training(R.model_register(t.filter(F.col("trained_at") < cut)), t.filter(F.col("trained_at") >= cut)).drop("metrics")


add("model_register_append", _registered_twice, f"select model_name, model_type, version, is_active, training_data_count, {ts('trained_at')} as trained_at from models")
add("model_list", lambda f: R.model_list(R.model_register(trainings(f)), METRICS), f"select {MODEL_COLS} from models")
add("model_compare", lambda f: R.model_compare(R.model_register(trainings(f)), METRICS), f"select {MODEL_COLS.replace(' is_active,', '')} from models where is_active=1")
add("model_info", lambda f: R.model_info(R.model_register(trainings(f)), METRICS, "model_C"), f"select {MODEL_COLS} from models where is_active=1 and model_name='model_C'")

# ---------------------------------------------------------------- questions
# Question texts: user turns of the conversations, and one request text per trip, so that every pattern occurs.
ASK = """case k % 7 when 0 then concat('Predict how long will trip ', driver_id, ' take from ', origin, ' to ', destination, ' on ', dt)
 when 1 then concat('"Suggest the best ', origin, ' to ', destination, ' route for driver ', driver_id, ' "')
 when 2 then concat('Any unusual alert for vehicle MH12AB', lpad(cast(vehicle_id % 10000 as varchar(9)), 4, '0'), ' last week?') when 3 then concat('  ', origin, ' se ', destination, ' kal ')
 when 4 then concat('fleet kpi for March 2024 ', customer_id % 50) when 5 then 'ok' else concat('Is driver ', driver_id, ' tired after the last 7 days?') end"""
ASK_AGENT = "case k % 7 when 0 then 'eta_sla_prediction' when 1 then 'route_optimization' when 2 then 'anomaly_alert' when 3 then 'route_intelligence' when 4 then 'fleet_overview' when 5 then 'agent' else 'driver_safety' end"


def questions(f):
    said = f.questions.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "query", F.lit("trip_management").alias("agent"))
    asked = f.first.withColumns({"k": F.col("vehicle_id") + F.col("driver_id"), "dt": F.date_format("trip_start", "yyyy-MM-dd")}).select(
        F.col("dispatch_entry_no").alias("id"), F.expr(ASK.replace("varchar(9)", "string")).alias("query"), F.expr(ASK_AGENT).alias("agent"))
    return said.unionByName(asked)


CTE["q_all"] = f"""select concat('c',conv_id,'-',turn) as id, text as query, 'trip_management' as agent from conversations where role='user' union all
 select dispatch_entry_no, {ASK}, {ASK_AGENT} from (select *, vehicle_id+driver_id as k, strftime(trip_start,'%Y-%m-%d') as dt from first_rows)"""
CTE["q_strip"] = r"""select id, agent, regexp_replace(regexp_replace(query,'^\s+|\s+$','','g'),'^"+|"+$','','g') as query from q_all where query is not null and agent<>'agent'"""
CTE["q_clean"] = "select * from q_strip where length(query)>3 qualify row_number() over (partition by query order by id)=1"


def clean(f):
    return f.stored("questions_clean", lambda: K.question_clean(questions(f), ["id"]))


add("question_clean", lambda f: K.question_clean(questions(f), ["id"]), "select id, query, agent from q_clean")


def re_sql(p):
    return "'" + p.replace("'", "''") + "'"


def _feature_sql():
    cols = [f"{d(f'case when regexp_matches(query,{re_sql(p)}) then 1 else 0 end')} as {n}" for n, p in K.PATTERN_FLAGS.items()]
    for n, words in K.INTENT_WORDS.items():
        cond = " or ".join(f"contains(lower(query),'{w}')" for w in words)
        cols.append(f"{d(f'case when {cond} then 1 else 0 end')} as {n}")
    cols.append("least(length(query)/100.0::double,1.0::double) as length_share")
    cols.append(r"least(len(list_filter(regexp_split_to_array(query,'\s+'), lambda w: w<>''))/20.0::double,1.0::double) as word_share")
    return "select id, " + ", ".join(cols) + " from q_clean"


add("question_features", lambda f: K.question_features(clean(f)).select("id", *K.QUESTION_FEATURES), _feature_sql())


def _ent(p, g=1):
    return f"nullif(regexp_extract(query,{re_sql(p)},{g}),'')"


add("question_entities", lambda f: K.question_entities(clean(f)).drop("query", "agent"),
    f"""select id, {_ent(K.VEHICLE)} as vehicle_id, try_cast({_ent(K.DRIVER_NO)} as bigint) as driver_id, try_cast({_ent(K.TRIP_NO)} as bigint) as trip_id, coalesce({_ent(K.FROM_TO, 1)},{_ent(K.TO_ROUTE, 1)}) as origin,
 coalesce({_ent(K.FROM_TO, 2)},{_ent(K.TO_ROUTE, 2)}) as destination, regexp_replace({_ent(K.DATE)},'^[^\\p{{L}}\\p{{N}}_]|[^\\p{{L}}\\p{{N}}_]$','','g') as date_expr from q_clean""")
CTE["lab"] = "select doc_id, text as query, concat('q',quality,'t',toxic) as agent from labels join documents using (doc_id)"
add("class_counts", lambda f: K.class_counts(clean(f)), f"select agent, count(*) as n, {i('greatest(0,1500-count(*))')} as deficit from q_clean group by 1")
add("class_counts_labelled", lambda f: K.class_counts(f.labelled), f"select agent, count(*) as n, {i('greatest(0,1500-count(*))')} as deficit from lab group by 1")
add("class_weights", lambda f: K.class_weights(f.labelled), f"select agent, count(*) as n, {r('cast((select count(*) from lab) as double)/((select count(distinct agent) from lab)*count(*))', 6)} as weight from lab group by 1")
add("question_dedup", lambda f: K.question_dedup(f.labelled, ["doc_id"]).select("doc_id", "agent"),
    "select doc_id, agent from lab qualify row_number() over (partition by lower(trim(query)) order by agent, doc_id)=1")
add("question_augment", lambda f: K.question_augment(clean(f), "id"))
HASHED = "(cast('0x'||substr(md5(id||'#42'),1,8) as bigint)/4294967296.0::double)"
PART = f"case when {HASHED}<0.8::double then 'train' when {HASHED}<0.9::double then 'validation' else 'test' end"
add("stratified_80_10_10", lambda f: K.stratified_80_10_10(clean(f), "id").groupBy("agent", "part").agg(F.count(F.lit(1)).alias("n")), f"select agent, {PART} as part, count(*) as n from q_clean group by 1, 2")


def _classified(f):
    rows = f.stored("question_rows", lambda: K.stratified_80_10_10(K.question_features(clean(f)), "id"))
    model = K.question_classifier(rows.filter("part = 'train'"))
    return K.classified(model, rows.filter("part <> 'train'"), ["id", "agent", "part"])


add("question_classifier", _classified)
# what must hold for the classifier: every held-out question has a class, and four of five have their own
add("question_classifier_holds", lambda f: f.stored("question_classes", lambda: _classified(f)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence").between(0, 1)).alias("n_sure"), (F.avg(F.when(F.col("agent") == F.col("predicted"), 1.0).otherwise(0.0)) > 0.8).cast("int").alias("good")),
    f"select count(*) as n, count(*) as n_sure, 1::bigint as good from (select {PART} as part from q_clean) where part<>'train'")


# Class scores per order: share of its trips by origin.
def order_scores(f):
    rows = f.trips.withColumn("order_no", F.substring_index("dispatch_entry_no", "-", 1))
    n = rows.groupBy("order_no", "origin_id").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("order_no").agg(F.count(F.lit(1)).alias("t"))
    out = n.join(total, "order_no").select("order_no", "origin_id", (F.col("n") / F.col("t")).alias("score"))
    return out.join(f.locations.select(F.col("id").alias("origin_id"), F.col("name").alias("agent")), "origin_id").drop("origin_id")


CTE["o_scores"] = "select split_part(dispatch_entry_no,'-',1) as order_no, origin_name as agent, count(*)/cast(sum(count(*)) over (partition by split_part(dispatch_entry_no,'-',1)) as double) as score from named group by 1,2"
CTE["o_rank"] = "select *, row_number() over (partition by order_no order by score desc, agent) as rk from o_scores"
CTE["o_top"] = """select order_no, max(case when rk=1 then agent end) as agent, max(case when rk=1 then score end) as s1, coalesce(max(case when rk=2 then score end),0) as s2, string_agg(agent,'|' order by rk) filter (rk<=3) as top_3 from o_rank group by 1"""
add("routing_action", lambda f: K.routing_action(order_scores(f), "order_no"),
    f"select order_no, agent, {r('s1', 4)} as confidence, case when s1-s2<0.15::double then 'multi_agent' when s1>=0.85 then 'route' when s1>=0.5 then 'route_monitor' else 'clarify' end as action, top_3 from o_top")


def predictions(f):
    return f.stored("class_predictions", lambda: _predictions(f))


def _predictions(f):
    """The order's most frequent origin as prediction for each of its trips."""
    top = K.routing_action(order_scores(f), "order_no").select("order_no", F.col("agent").alias("predicted"), "confidence")
    rows = summaries.name_routes(f.trips, f.locations).withColumn("order_no", F.substring_index("dispatch_entry_no", "-", 1))
    return rows.select("order_no", F.col("origin").alias("label")).join(top, "order_no")


CTE["preds"] = f"select origin_name as label, t.agent as predicted, {r('s1', 4)} as confidence from named n join o_top t on split_part(n.dispatch_entry_no,'-',1)=t.order_no"
add("threshold_coverage", lambda f: Q.threshold_coverage(predictions(f)), " union all ".join(
    f"select {t}::double as threshold, {r(f'cast(sum(case when confidence>={t} then 1 else 0 end) as double)/count(*)', 4)} as coverage, {r(f'coalesce(cast(sum(case when confidence>={t} and label=predicted then 1 else 0 end) as double)/nullif(sum(case when confidence>={t} then 1 else 0 end),0),0)', 4)} as accuracy,"
    f" {i(f'sum(case when confidence>={t} then 1 else 0 end)')} as routed, {i(f'sum(case when confidence>={t} and label=predicted then 1 else 0 end)')} as correct from preds" for t in Q.THRESHOLDS))
add("confusion", lambda f: Q.confusion(predictions(f)), "select label as actual, predicted, count(*) as n from preds group by 1,2")
add("class_report", lambda f: Q.class_report(predictions(f)),
    f"""select agent, {r('p', 3)} as precision, {r('rc', 3)} as recall, {r('coalesce(2*p*rc/nullif(p+rc,0),0)', 3)} as f1, avg_confidence, samples from (select coalesce(a.label,b.predicted) as agent, coalesce(tp,0)/nullif(cast(coalesce(c,0) as double),0) as p0, coalesce(coalesce(tp,0)/nullif(cast(coalesce(c,0) as double),0),0) as p,
 coalesce(coalesce(tp,0)/nullif(cast(coalesce(n,0) as double),0),0) as rc, avg_confidence, coalesce(n,0) as samples from
 (select label, count(*) as n, sum(case when label=predicted then 1 else 0 end) as tp, {r('avg(confidence)', 3)} as avg_confidence from preds group by 1) a full join (select predicted, count(*) as c from preds group by 1) b on a.label=b.predicted)""")

# ---------------------------------------------------------------- ledger
A, B = "2024-01-05", "2024-01-20"
RANGE = f"date between date '{A}' and date '{B}'"
EXP = f"id, {day('date')} as date, {d('amount')} as amount, category"
add("ledger_range", lambda f: L.ledger_range(f.expenses, A, B), f"select {EXP} from expenses where {RANGE}")
add("ledger_local", lambda f: L.ledger_local(f.expenses, A, B), f"select {EXP} from expenses where {RANGE}")
add("ledger_local_totals", lambda f: L.ledger_local_totals(f.expenses, A, B), f"select category, {r('sum(amount)')} as total_amount from expenses where {RANGE} group by 1")
add("ledger_by_category", lambda f: L.ledger_by_category(f.expenses, A, B), f"select category, {r('sum(amount)')} as total_amount, count(*) as count from expenses where {RANGE} group by 1")
add("ledger_by_category_one", lambda f: L.ledger_by_category(f.expenses, A, B, "purchase"), f"select category, {r('sum(amount)')} as total_amount, count(*) as count from expenses where {RANGE} and category='purchase' group by 1")


# ---------------------------------------------------------------- streams
def _streamed(f):
    """The fleet's trips as a stream of several batches, some sent twice, with two states kept; (number of batches, folder)."""
    base = f"{f.folder}/stream"
    if "stream" not in f.exports:
        wanted = [P.DAILY, P.DRIVER]
        again = f.trips.filter("trip_status = 'C'")
        trips = f.trips.unionByName(again).select(refresh.read_columns(f.trips.columns, wanted))
        trips.write.mode("overwrite").parquet(f"{base}/in")
        half = -(-len(f.spark.read.parquet(f"{base}/in").inputFiles()) // 2)  # as many files as tasks wrote them
        f.streamed = refresh.run(refresh.trip_stream(f.spark, f"{base}/in", trips.schema, files_per_trigger=max(1, half)), base, f"{base}/checkpoint", wanted)
        f.exports.add("stream")
    return f.streamed, base


def _stream_state(f, partial):
    batches, base = _streamed(f)
    return refresh.state_after(f.spark, base, partial, f.trips, batches)


add("stream_daily_fleet", lambda f: refresh.daily_with_open_days(_stream_state(f, P.DAILY), f.trips.agg(F.max("trip_start")).scalar()),
    f"select * replace ({day('stat_date')} as stat_date), cast(case when stat_date+1<=(select max(trip_start) from trips)-to_days(7) then 0 else 1 end as bigint) as is_provisional from daily_fleet_stats")
add("stream_changed_drivers", lambda f: P.driver_summary(_stream_state(f, P.DRIVER), f.drivers), "select * from driver_summary")
