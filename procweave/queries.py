"""The registered queries over the test log, with the SQL that must give the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procweave.functions.calendars import calendar_frame, closed_hours, move_minutes
from procweave.functions.rules import compiled
from procweave.operators import alignment, attributes, calendars, control_flow, distributions, durations, features, hoeffding, resources, trees
from procweave.registry import query
from procweave.sources.event_log import from_tables
from procweave.sources.petri_net import flower, net, sequence

LABELS = ["click", "error", "purchase", "signup", "view"]

LOG = """log as (
  select *, row_number() over (partition by case_id order by start_ts, event_id) - 1 as event_idx from (
    select user_id*100+day(ts) as case_id, event_id, event_type as activity,
      'res_'||lpad(cast((k*k)//1000 as varchar),2,'0') as resource,
      ts - to_seconds(cast(floor(value*60) as bigint)) as start_ts, ts as end_ts,
      c_mktsegment as segment, c_nationkey as nation
    from (select *, cast(json_extract_string(props,'$.k') as bigint) as k from events) e
    join customer on user_id=c_custkey))"""

OPENED = """hist as (
  select resource, isodow(ts)-1 as wd, hour(ts) as h, count(*) as n
  from (select resource, start_ts as ts from log union all select resource, end_ts from log) group by all
), wk as (
  select resource, wd, coalesce(sum(n) over (partition by resource order by n desc, wd rows between unbounded preceding and 1 preceding),0)
    / cast(sum(n) over (partition by resource) as double) as before
  from (select resource, wd, sum(n) as n from hist group by all)
), hk as (
  select resource, wd, h, coalesce(sum(n) over (partition by resource, wd order by n desc, h rows between unbounded preceding and 1 preceding),0)
    / cast(sum(n) over (partition by resource, wd) as double) as before from hist
), opened as (
  select hk.resource, hk.wd, hk.h from hk join wk on hk.resource=wk.resource and hk.wd=wk.wd where wk.before<0.95 and hk.before<0.95)"""

ENABLED = """f as (
  select *, coalesce(lag(end_ts) over (partition by case_id, activity order by start_ts, event_id),
    first_value(start_ts) over (partition by case_id order by start_ts, event_id)) as enabled_ts from log)"""


HISTORY = ", ".join(f"coalesce(sum(case when activity='{x}' then 1 else 0 end) over b, 0) as {x}" for x in LABELS)


def naive_minutes(start: str, end: str, rows: str, name: str) -> str:
    """One row for each sampled hour, on purpose unlike the closed form."""
    return f"""{name}_g as (
  select event_id, resource, unnest(generate_series({start}, {end}, interval 1 hour)) as t, {end} as e from {rows}
), {name}_c as (
  select event_id, count(*) as n from {name}_g left join opened o on o.resource={name}_g.resource and o.wd=isodow(t)-1 and o.h=hour(t)
  where t<e and o.resource is null group by 1
), {name} as (
  select {rows}.event_id, coalesce(n, 0) as closed, greatest(epoch_us({end})-epoch_us({start})-3600000000*coalesce(n,0),0)/6e7 as minutes
  from {rows} left join {name}_c using(event_id))"""


def _calendars(log: DataFrame) -> DataFrame:
    return calendar_frame(log.sparkSession, calendars.slots(calendars.resource_calendars(log), ["resource"]))


@query("q_log_flatten", f"with {LOG} select event_id, case_id, cast(event_idx as integer) as event_idx, activity, resource, start_ts, end_ts, segment, nation from log")
def log_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).select("event_id", "case_id", "event_idx", "activity", "resource", "start_ts", "end_ts", "segment", "nation")


@query("q_activity_counts", f"with {LOG} select activity, count(*) as n from log where activity is not null group by activity")
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.value_counts(from_tables(spark, sf_dir), "activity")


@query("q_resource_share", f"with {LOG} select resource, count(*)/cast(sum(count(*)) over () as double) as share from log group by resource")
def resource_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.shares(from_tables(spark, sf_dir))


RETAINED = """retained as (
  select resource, n/cast(tot as double) as share from (
    select resource, n, sum(n) over (order by n desc, resource rows unbounded preceding) as cum, sum(n) over () as tot
    from (select resource, count(*) as n from log group by resource)) where cast(cum as double)/tot<=0.95)"""


@query("q_resources_retained", f"with {LOG}, {RETAINED} select resource, share from retained")
def resources_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources.retained(from_tables(spark, sf_dir))


@query(
    "q_act_resource_prob",
    f"""with {LOG}, {RETAINED}, d as (
  select a.activity, r.resource, count(l.event_id) as n from (select distinct activity from log) a cross join retained r
  left join log l on l.activity=a.activity and l.resource=r.resource group by all
), p as (select activity, resource, case when sum(n) over w=0 then 1.0/count(*) over w else n/cast(sum(n) over w as double) end as prob from d window w as (partition by activity))
select activity, resource, prob from p where prob>0""",
)
def act_resource_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_tables(spark, sf_dir)
    return resources.activity_resources(log, resources.retained(log))


@query("q_attr_distribution", f"with {LOG} select segment, nation, count(*)/cast(sum(count(*)) over () as double) as prob from log where event_idx=0 group by segment, nation")
def attr_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.joint_distribution(from_tables(spark, sf_dir), ["segment", "nation"])


@query("q_hour_histogram", f"with {LOG} select resource, cast(isodow(ts)-1 as integer) as wd, cast(hour(ts) as integer) as h, count(*) as n from (select resource, start_ts as ts from log union all select resource, end_ts from log) group by all")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.hour_histogram(from_tables(spark, sf_dir))


@query("q_res_calendar", f"with {LOG}, {OPENED} select resource, cast(wd as integer) as wd, cast(h as integer) as h from opened")
def res_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.resource_calendars(from_tables(spark, sf_dir))


ARRIVAL = f"""{LOG.replace("log as", "full_log as")}, log as (select * replace ('' as resource) from full_log where event_idx=0), {OPENED}"""


@query("q_arrival_calendar", f"with {ARRIVAL} select cast(wd as integer) as wd, cast(h as integer) as h from opened")
def arrival_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.arrival_calendar(from_tables(spark, sf_dir))


@query("q_case_start", f"with {LOG} select case_id, min(start_ts) as start_ts from log group by case_id")
def case_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.case_starts(from_tables(spark, sf_dir))


@query("q_interarrival", f"with {LOG} select case_id, s as start_ts, lag(s) over (order by s, case_id) as prev_ts from (select case_id, min(start_ts) as s from log group by case_id)")
def interarrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.interarrivals(from_tables(spark, sf_dir))


@query("q_closed_hours", f"with {LOG}, {OPENED}, {naive_minutes('start_ts', 'end_ts', 'log', 'm')} select event_id, closed as closed_hours from m")
def closed_hours_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_tables(spark, sf_dir)
    held = log.join(_calendars(log), "resource")
    return held.select("event_id", closed_hours(F.col("start_ts"), F.col("end_ts"), F.col("closed")).alias("closed_hours"))


@query("q_working_minutes", f"with {LOG}, {OPENED}, {naive_minutes('start_ts', 'end_ts', 'log', 'm')} select event_id, minutes from m")
def working_minutes_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_tables(spark, sf_dir)
    return durations.timed(log, _calendars(log), "start_ts", "end_ts", "minutes").select("event_id", "minutes")


@query("q_waiting_minutes", f"with {LOG}, {OPENED}, {ENABLED}, {naive_minutes('enabled_ts', 'start_ts', 'f', 'm')} select event_id, minutes from m")
def waiting_minutes_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_tables(spark, sf_dir)
    return durations.timed(features.flower_enabled(log), _calendars(log), "enabled_ts", "start_ts", "minutes").select("event_id", "minutes")


@query(
    "q_move_minutes",
    f"""with recursive {LOG}, {OPENED}, s as (select event_id, resource, start_ts, event_id % 97 as m from log
), w(event_id, resource, t, m) as (
  select event_id, resource, start_ts, m from s
  union all
  select w.event_id, w.resource,
    case when o.resource is null then date_trunc('hour', w.t) + interval 1 hour + (w.t - date_trunc('minute', w.t)) else w.t + interval 1 minute end,
    case when o.resource is null then w.m else w.m - 1 end
  from w left join opened o on o.resource=w.resource and o.wd=isodow(w.t)-1 and o.h=hour(w.t) where w.m>0)
select event_id, t as moved from w where m=0""",
)
def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's start moved on by event_id % 97 working minutes; the SQL walks minute by minute."""
    log = from_tables(spark, sf_dir)
    held = log.join(_calendars(log), "resource")
    end = move_minutes(F.col("start_ts"), F.col("event_id") % 97, F.col("opened"), F.col("open"), F.col("open_slots"))
    return held.select("event_id", end.alias("moved"))


@query(
    "q_arrival_training",
    f"""with {ARRIVAL}, p as (
  select case_id as event_id, s as start_ts, lag(s) over (order by s, case_id) as prev_ts, '' as resource from (select case_id, min(start_ts) as s from full_log group by case_id)
), q as (select * from p where prev_ts is not null), {naive_minutes('prev_ts', 'start_ts', 'q', 'm')}
select q.event_id as case_id, cast(hour(prev_ts) as integer) as hour, cast(isodow(prev_ts)-1 as integer) as weekday, minutes from q join m using (event_id)""",
)
def arrival_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_tables(spark, sf_dir)
    return durations.arrivals(log, calendar_frame(spark, calendars.slots(calendars.arrival_calendar(log), []))).drop("start_ts")


@query(
    "q_workload",
    f"""with {LOG}, {ENABLED} select p.event_id, (select count(*) from log q where q.resource=p.resource and q.end_ts>p.enabled_ts and q.start_ts<p.enabled_ts) as workload from f p""",
)
def workload_at_enabling(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = from_tables(spark, sf_dir)
    return features.workload(log, features.flower_enabled(log), "enabled_ts")




@query("q_history", f"with {LOG} select event_id, {', '.join(f'cast({x} as bigint) as {x}' for x in LABELS)} from (select event_id, {HISTORY} from log window b as (partition by case_id order by start_ts, event_id rows between unbounded preceding and 1 preceding))")
def history_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.history(from_tables(spark, sf_dir), LABELS, ["event_idx"], "activity").select("event_id", *LABELS)


@query("q_enabled_time", f"with {LOG}, {ENABLED} select event_id, enabled_ts from f")
def enabled_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By replay on the flower net, joined back to the events; the SQL uses windows."""
    log = from_tables(spark, sf_dir)
    steps = alignment.stepped(log.drop("event_id"), flower(LABELS)).where("log_idx is not null")
    return steps.join(log.select("case_id", F.col("event_idx").alias("log_idx"), "event_id"), ["case_id", "log_idx"]).select("event_id", "enabled_ts")


WEIGHTS = f"""with {LOG}, n as (select count(*) + count(distinct case_id) as n, count(distinct case_id) as c from log)
select activity as transition, count(*)/cast((select n from n) as double) as weight from log group by activity
union all select 'tau_in', 1.0 union all select 'tau_out', (select c/cast(n as double) from n)"""


@query("q_transition_weights", WEIGHTS)
def transition_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_flow.frequency_weights(alignment.aligned(alignment.log_variants(from_tables(spark, sf_dir)), flower(LABELS)))


@query(
    "q_cf_training",
    f"""with {LOG}, h as (select case_id, event_idx, activity, nation, segment, {HISTORY} from log window b as (partition by case_id order by event_idx rows between unbounded preceding and 1 preceding)
), e as (select unnest(['{"','".join([*LABELS, "tau_out"])}']) as key),
closing as (select case_id, null as activity, nation, segment, {", ".join(f"sum(case when activity='{x}' then 1 else 0 end) as {x}" for x in LABELS)} from log group by case_id, nation, segment),
steps as (select case_id, activity, nation, segment, {", ".join(LABELS)} from h union all select case_id, 'tau_out', nation, segment, {", ".join(LABELS)} from closing),
every as (select e.key, steps.* from steps cross join e union all select 'tau_in', case_id, 'tau_in', nation, segment, {", ".join("0" for _ in LABELS)} from closing)
select key, count(*) as n, cast(sum(case when key=activity then 1 else 0 end) as bigint) as fired, {", ".join(f"cast(sum({x}) as bigint) as {x}" for x in LABELS)}, cast(sum(nation) as bigint) as nation,
  cast(sum(case when segment='BUILDING' then 1 else 0 end) as bigint) as building from every group by key""",
)
def cf_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by transition of the control-flow training rows."""
    log = from_tables(spark, sf_dir)
    values = {"segment": attributes.vocabulary(log, "segment")}
    steps = features.history(alignment.stepped(log, flower(LABELS)), LABELS, ["step_idx"])
    rows, names = control_flow.training_rows(steps, LABELS, ["nation"], values)
    at = {n: k for k, n in enumerate(names)}
    total = lambda n: F.sum(F.col("x")[at[n]]).cast("bigint")
    return rows.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("y").cast("bigint").alias("fired"), *[total(x).alias(x) for x in LABELS], total("nation").alias("nation"), total("segment = BUILDING").alias("building")
    )


TRAINED = f"{', '.join(f'cast(h.{x} as double) as {x}' for x in LABELS)}, cast(nation as double) as nation, cast(segment='BUILDING' as integer)::double as building"


def _trained(rows: DataFrame, names: list[str], first: dict[str, str]) -> DataFrame:
    """Training rows with some of their features as columns."""
    at = {n: k for k, n in enumerate(names)}
    shown = first | {x: x for x in LABELS} | {"nation": "nation", "segment = BUILDING": "building"}
    return rows.select("row_id", "key", F.col("y").alias("minutes"), *[F.col("x")[at[n]].alias(c) for n, c in shown.items()])


@query(
    "q_exec_training",
    f"""with {LOG}, {OPENED}, {RETAINED}, {naive_minutes('start_ts', 'end_ts', 'log', 'm')}, h as (select event_id, {HISTORY} from log window b as (partition by case_id order by start_ts, event_id rows between unbounded preceding and 1 preceding))
select l.case_id || '|' || (l.event_idx + 1) as row_id, activity as key, minutes, {", ".join(f"cast(l.resource='res_0{k}' as integer)::double as r{k}" for k in range(3))}, {TRAINED}
from log l join retained r on r.resource=l.resource join m on m.event_id=l.event_id join h on h.event_id=l.event_id""",
)
def exec_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that execution times are learned from, on the flower net."""
    log = from_tables(spark, sf_dir)
    kept = [r["resource"] for r in resources.retained(log).collect()]
    steps = alignment.feature_table(log.drop("event_id"), flower(LABELS)).where("start_ts is not null").where(F.col("resource").isin(kept))
    values = {"segment": attributes.vocabulary(log, "segment")}
    rows, names = durations.training_rows(durations.timed(steps, _calendars(log), "start_ts", "end_ts", "minutes"), "label", "minutes", ["nation"], values, LABELS, resources=kept)
    return _trained(rows, names, {f"resource = res_0{k}": f"r{k}" for k in range(3)})


@query(
    "q_wait_training",
    f"""with {LOG}, {OPENED}, {ENABLED}, {RETAINED}, {naive_minutes('enabled_ts', 'start_ts', 'f', 'm')}, h as (select event_id, {HISTORY} from log window b as (partition by case_id order by start_ts, event_id rows between unbounded preceding and 1 preceding))
select p.case_id || '|' || (p.event_idx + 1) as row_id, p.resource as key, minutes,
  (select count(*) from log q where q.resource=p.resource and q.end_ts>p.enabled_ts and q.start_ts<p.enabled_ts)::double as workload, {TRAINED}
from f p join retained r on r.resource=p.resource join m on m.event_id=p.event_id join h on h.event_id=p.event_id""",
)
def wait_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that waiting times are learned from, on the flower net."""
    log = from_tables(spark, sf_dir)
    steps = alignment.feature_table(log.drop("event_id"), flower(LABELS)).where("start_ts is not null").join(resources.retained(log).select("resource"), "resource", "left_semi")
    values = {"segment": attributes.vocabulary(log, "segment")}
    rows, names = durations.training_rows(durations.timed(steps, _calendars(log), "enabled_ts", "start_ts", "minutes"), "resource", "minutes", ["nation"], values, LABELS)
    return _trained(rows, names, {"workload": "workload"})


MINUTES = "cast(date_diff('microsecond', start_ts, end_ts) as double)/6e7"


def _minutes(log: DataFrame) -> DataFrame:
    return log.withColumn("minutes", F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / F.lit(6e7))


@query(
    "q_duration_stats",
    f"with {LOG}, m as (select activity, {MINUTES} as x from log) select activity, count(*) as n, min(x) as lo, max(x) as hi, round(avg(x), 6) as avg, round(median(x), 6) as median, count(distinct x) as n_distinct from m group by activity",
)
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(from_tables(spark, sf_dir)).groupBy("activity").agg(
        F.count("*").alias("n"), F.min("minutes").alias("lo"), F.max("minutes").alias("hi"), F.round(F.avg("minutes"), 6).alias("avg"), F.round(F.median("minutes"), 6).alias("median"), F.countDistinct("minutes").alias("n_distinct")
    )


def fit_sql(rows: str, keys: str) -> str:
    """CTEs of the families' fits of (keys, x): s, one row a key; q, its quantiles; w, the families' distances."""
    lists = ", ".join(f"unnest([{', '.join(map(repr, values))}]) as {name}" for name, values in (("p", distributions.PROBABILITIES), ("z", distributions.NORMAL)))
    probabilities = ", ".join(map(repr, distributions.PROBABILITIES))
    distances = {"fixed": "a", "norm": "a+sd*z", "expon": "lo-(a-lo)*ln(1-p)", "lognorm": "ll+lc*exp(ls*z)", "uniform": "lo+(hi-lo)*p"}
    return f"""s0 as (select {keys}, count(*) as n, avg(x) as a, stddev_pop(x) as sd, min(x) as lo, max(x) as hi from {rows} group by {keys}),
q as (select {keys}, {lists}, unnest(quantile_disc(x, [{probabilities}])) as v from {rows} group by {keys}),
gaps as (select unnest(range(0, {len(distributions.GAPS)})) as k, unnest([{", ".join(map(repr, distributions.GAPS))}]) as g),
l0 as (select {keys}, k, lo-g*(a-lo) as loc, avg(ln(v-(lo-g*(a-lo)))) as m, avg(ln(v-(lo-g*(a-lo)))**2) as sq from q join s0 using ({keys}), gaps where hi>lo group by {keys}, k, g, lo, a),
l1 as (select {keys}, k, loc, m, sqrt(greatest(sq-m*m, 1e-18)) as ls from l0),
l2 as (select {keys}, loc as ll, ls, exp(m) as lc from l1 qualify row_number() over (partition by {keys} order by -ln(ls)-m desc, k)=1),
s as (select * from s0 left join l2 using ({keys})),
w as (select {keys}, {", ".join(f"avg(abs(v-({form}))) as w_{f}" for f, form in distances.items())} from q join s using ({keys}) group by {keys})"""


#: The parameters of each family from s, in the order in which families win ties.
FITS = {"fixed": ["a"], "norm": ["a", "sd"], "expon": ["lo", "a-lo"], "lognorm": ["ls", "ll", "lc"], "uniform": ["lo", "hi-lo"]}


def best_sql(keys: str) -> str:
    """What fitted() gives, from the CTEs of fit_sql()."""
    best = f"(select {keys}, min_by(f, w*1e6+k*1e-9) as dist from (select {keys}, unnest([{', '.join(map(repr, FITS))}]) as f, unnest(range(0, {len(FITS)})) as k, unnest([{', '.join(f'w_{f}' for f in FITS)}]) as w from w) where w is not null group by {keys})"
    part = lambda i: " ".join(f"when dist='{f}' then {own[i]}" for f, own in FITS.items() if i < len(own))
    shown = ", ".join(f"round(cast(case when lo=hi then {'lo' if i == 0 else 'null'} {part(i)} end as double), 6) as p{i}" for i in range(3))
    return f"select {keys}, n, case when lo=hi then 'fixed' else dist end as dist, {shown}, lo as min, hi as max, round(a, 6) as mean from s left join {best} using ({keys})"


def _shown_fit(fits: DataFrame, *keys: str) -> DataFrame:
    return fits.select(*keys, "n", "fit.dist", *[F.round(F.get("fit.params", F.lit(k)), 6).alias(f"p{k}") for k in range(3)], "fit.min", "fit.max", F.round("fit.mean", 6).alias("mean"))


TIMES = f"m as (select activity, {MINUTES} as x from log)"


def _fit_query(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = distributions.summaries(_minutes(from_tables(spark, sf_dir)), ["activity"], "minutes")
        p = distributions.parameters(family)
        return base.select("activity", *[F.round(p[k], 6).alias(f"p{k}") for k in range(len(FITS[family]))])

    return run


def _distance_query(family: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = distributions.summaries(_minutes(from_tables(spark, sf_dir)), ["activity"], "minutes")
        return base.select("activity", F.round(distributions.distance(family), 6).alias("w1"))

    return run


for _family, _parts in FITS.items():
    query(f"q_dist_fit_{_family}", f"with {LOG}, {TIMES}, {fit_sql('m', 'activity')} select activity, {', '.join(f'round(cast({e} as double), 6) as p{k}' for k, e in enumerate(_parts))} from s")(_fit_query(_family))
    query(f"q_wasserstein_{_family}", f"with {LOG}, {TIMES}, {fit_sql('m', 'activity')} select activity, round(w_{_family}, 6) as w1 from w")(_distance_query(_family))


@query(
    "q_best_dist",
    f"""with {LOG}, {TIMES}, {fit_sql("m", "activity")} select activity, case when w_fixed<=w_expon and w_fixed<=w_uniform then 'fixed' when w_expon<=w_uniform then 'expon' else 'uniform' end as dist from w""",
)
def best_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = distributions.fitted(_minutes(from_tables(spark, sf_dir)), ["activity"], "minutes", ("fixed", "expon", "uniform"))
    return fits.select("activity", "fit.dist")


@query("q_best_dist_all", f"with {LOG}, {TIMES}, {fit_sql('m', 'activity')} {best_sql('activity')}")
def best_dist_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_fit(distributions.fitted(_minutes(from_tables(spark, sf_dir)), ["activity"], "minutes"), "activity")


@query("q_onehot", f"with {LOG} select event_id, " + ", ".join(f"cast(activity='{x}' as integer) as {x}" for x in LABELS) + " from log")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).select("event_id", *[c.alias(x) for c, x in zip(attributes.one_hot("activity", LABELS), LABELS, strict=True)])


@query(
    "q_histogram",
    f"""with {LOG}, m as (select {MINUTES} as x from log), e as (select min(x) as a, (max(x)-min(x))/30 as w, count(*) as t from m), b as (select least(cast(floor((x-a)/w) as integer), 29) as bin, a, w, t from m, e)
select bin, round(a+bin*w, 9) as lo, round(a+(bin+1)*w, 9) as hi, count(*) as n, round(count(*)/(t*w), 9) as density from b group by bin, a, w, t""",
)
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distributions.histogram(_minutes(from_tables(spark, sf_dir)), "minutes")
    return out.select("bin", "n", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "density")])


@query("q_variants", f"with {LOG} select activities, count(*) as n from (select case_id, string_agg(activity, '>' order by event_idx) as activities from log group by case_id) group by activities")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.log_variants(from_tables(spark, sf_dir)).select(F.array_join("activities", ">").alias("activities"), "n")


@query(
    "q_transition_frequency",
    f"with {LOG} select activity as transition, count(*) as n from log group by activity union all select 'tau_in', count(distinct case_id) from log union all select 'tau_out', count(distinct case_id) from log",
)
def transition_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.transition_frequency(from_tables(spark, sf_dir), flower(LABELS))


@query(
    "q_alignment_cost",
    f"""with {LOG}, s as (select case_id, activity, event_idx, row_number() over (partition by case_id order by event_idx) as i from log where activity in ('click','view')),
t as (select case_id, count(*) as n from log group by case_id),
c as (select case_id, max(case when activity='click' and exists (select 1 from s v where v.case_id=s.case_id and v.activity='view' and v.event_idx>s.event_idx) then 2
  else 1 end) as matched from s group by case_id)
select t.case_id, cast(n + 2 - 2*coalesce(matched, 0) as bigint) as cost from t left join c using (case_id)""",
)
def alignment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each case on the sequence click, view; the SQL is by the longest common subsequence."""
    by_case = alignment.cases(from_tables(spark, sf_dir))
    costs = alignment.aligned(alignment.variants(by_case), sequence(["click", "view"]))
    return by_case.select("case_id", "variant").join(costs.select("variant", "cost"), "variant").select("case_id", "cost")


RULES = {
    0: {"feature": "nation", "threshold": 11.5, "yes_id": 1, "no_id": 2, "value": 0.0}, 1: {"feature": None, "value": 2.5},
    2: {"feature": "event_idx", "threshold": 1.0, "yes_id": 5, "no_id": 6, "value": 0.0}, 5: {"feature": None, "value": 7.0}, 6: {"feature": None, "value": 9.25},
}


@query("q_rules_eval", f"with {LOG} select event_id, cast(case when nation<=11.5 then 2.5 when event_idx<=1 then 7.0 else 9.25 end as double) as value from log")
def rules_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_tables(spark, sf_dir).select("event_id", compiled(RULES).alias("value"))


STUMP = f"""with {LOG}, r as (select activity, {MINUTES} as y, unnest(['event_idx','nation']) as feature, unnest([event_idx, nation]) as v from log),
g as (select activity, feature, v, count(*) as n, sum(y) as s from r group by all),
c as (select activity, feature, v, lead(v) over w as nx, sum(n) over (w rows unbounded preceding) as nl, sum(s) over (w rows unbounded preceding) as sl,
  sum(n) over (partition by activity, feature) as nt, sum(s) over (partition by activity, feature) as st from g window w as (partition by activity, feature order by v)),
k as (select activity, feature, (v+nx)/2.0 as threshold, sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)-st*st/nt as gain from c where nx is not null)
select activity, feature, cast(threshold as double) as threshold from k qualify row_number() over (partition by activity order by round(gain, 9) desc, feature, threshold)=1"""


@query("q_tree_stump", STUMP)
def tree_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _minutes(from_tables(spark, sf_dir)).select("activity", F.col("minutes").alias("y"), F.array(F.col("event_idx").cast("double"), F.col("nation").cast("double")).alias("x"))
    names = F.array(F.lit("event_idx"), F.lit("nation"))
    return trees.best_splits(rows, ["activity"]).select("activity", F.element_at(names, F.col("feature").cast("int") + 1).alias("feature"), "threshold")


def tree_sql(rows: str, features: list[str], depth: int, folds: int = trees.FOLDS) -> str:
    """CTEs of the trees of rows (key, row_id, y, features...): tree, the full trees' nodes up to their chosen
    depth; leaves, the rows with their leaf; picked, the depths."""
    fold = f"cast('0x'||substr(md5(row_id),1,8) as bigint) % {folds}"
    out = [f"d0 as (select *, fold<>tree as learn, 0 as n0 from (select *, {fold} as fold, unnest(range(0, {folds + 1})) as tree from {rows}))"]
    for d in range(depth):
        own = f"n{d}"
        out.append(f"g{d} as (select key, tree, {own} as node, feature, v, count(*) as n, sum(y) as s from (select key, tree, {own}, y, unnest(range(0, {len(features)})) as feature, unnest([{', '.join(f'cast({f} as double)' for f in features)}]) as v from d{d} where learn and {own}>={(1 << d) - 1}) group by all)")
        out.append(f"c{d} as (select key, tree, node, feature, v, lead(v) over w as nx, sum(n) over (w rows unbounded preceding) as nl, sum(s) over (w rows unbounded preceding) as sl, sum(n) over (partition by key, tree, node, feature) as nt, sum(s) over (partition by key, tree, node, feature) as st from g{d} window w as (partition by key, tree, node, feature order by v))")
        out.append(f"k{d} as (select key, tree, node, feature, (v+nx)/2 as threshold, round(sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)-st*st/nt, 9) as gain from c{d} where nx is not null)")
        out.append(f"b{d} as (select * from k{d} where gain>1e-9 qualify row_number() over (partition by key, tree, node order by gain desc, feature, threshold)=1)")
        value = "case b.feature " + " ".join(f"when {k} then {f}" for k, f in enumerate(features)) + " end"
        out.append(f"d{d + 1} as (select d.*, case when b.feature is null then d.{own} when {value}<=b.threshold then 2*d.{own}+1 else 2*d.{own}+2 end as n{d + 1} from d{d} d left join b{d} b on b.key=d.key and b.tree=d.tree and b.node=d.{own})")
    path = [f"n{d}" for d in range(depth + 1)]
    out.append(f"v as (select key, tree, node, count(*) as n, avg(y) as value from (select key, tree, y, unnest(list_distinct([{', '.join(path)}])) as node from d{depth} where learn) group by all)")
    out.append(f"tests as (select key, tree, y, unnest(range(1, {depth + 1})) as depth, unnest([{', '.join(path[1:])}]) as node from d{depth} where tree=fold)")
    out.append("scores as (select key, tree, depth, 1-sum((y-value)**2)/nullif(sum(y*y)-sum(y)*sum(y)/count(*), 0) as score from tests join v using (key, tree, node) group by all)")
    out.append("picked as (select key, depth from (select key, depth, round(avg(coalesce(score, 0)), 9) as score from scores group by all) qualify row_number() over (partition by key order by score desc, depth)=1)")
    out.append(f"tree as (select v.*, p.depth, floor(log2(v.node+1.0)) as level, {' '.join(['coalesce(' + ', '.join(f'b{d}.feature' for d in range(depth)) + ') as feature', ', coalesce(' + ', '.join(f'b{d}.threshold' for d in range(depth)) + ') as threshold'])} from v join picked p using (key) {' '.join(f'left join b{d} on b{d}.key=v.key and b{d}.tree=v.tree and b{d}.node=v.node' for d in range(depth))} where v.tree={folds} and floor(log2(v.node+1.0))<=p.depth)")
    out.append(f"leaves as (select d.key, row_id, y, [{', '.join(path)}][p.depth+1] as leaf from d{depth} d join picked p using (key) where tree={folds})")
    return ",\n".join(out)


TREE_ROWS = f"r as (select activity as key, cast(event_id as varchar) as row_id, {MINUTES} + case when nation<=11 then 40*(event_idx%3) else 0 end as y, event_idx, nation from log)"


def _tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations, with some that depend on two features."""
    more = F.when(F.col("nation") <= 11, 40 * (F.col("event_idx") % 3)).otherwise(0)
    x = F.array(F.col("event_idx").cast("double"), F.col("nation").cast("double"))
    return _minutes(from_tables(spark, sf_dir)).select(F.col("activity").alias("key"), F.col("event_id").cast("string").alias("row_id"), (F.col("minutes") + more).alias("y"), x.alias("x"))


@query(
    "q_tree_rules",
    f"""with {LOG}, {TREE_ROWS}, {tree_sql("r", ["event_idx", "nation"], 3)}
select key, cast(node as integer) as node_id, coalesce(case when level<depth then ['event_idx', 'nation'][feature+1] end, '') as feature, coalesce(case when level<depth then threshold end, -1) as threshold,
  cast(case when level<depth and feature is not null then 2*node+1 else -1 end as integer) as yes_id, cast(case when level<depth and feature is not null then 2*node+2 else -1 end as integer) as no_id, round(value, 9) as value, n from tree""",
)
def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of up to three levels, of the depths that cross-validation chooses; -1 and '' stand for what leaves lack."""
    rules = trees.fit(_tree_rows(spark, sf_dir), ["event_idx", "nation"], 3)[0]
    return rules.select("key", "node_id", F.coalesce("feature", F.lit("")).alias("feature"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("threshold", "yes_id", "no_id")], F.round("value", 9).alias("value"), "n")


@query("q_leaf_fits", f"with {LOG}, {TREE_ROWS}, {tree_sql('r', ['event_idx', 'nation'], 2)}, x as (select key, cast(leaf as integer) as leaf, y as x from leaves), {fit_sql('x', 'key, leaf')} {best_sql('key, leaf')}")
def leaf_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of each leaf of trees of up to two levels."""
    return _shown_fit(distributions.fitted(trees.fit(_tree_rows(spark, sf_dir), ["event_idx", "nation"], 2)[1], ["key", "leaf"], "y"), "key", "leaf")


@query("q_case_index", f"with {LOG} select case_id, 'case_' || row_number() over (order by min(start_ts), case_id) as name from log group by case_id")
def case_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense case names in order of start; counted day by day, so no task sorts all cases."""
    from procweave.operators.windows import running_sum

    starts = features.case_starts(from_tables(spark, sf_dir)).withColumn("one", F.lit(1))
    placed = running_sum(starts, "one", [], F.date_trunc("day", "start_ts"), ["start_ts", "case_id"], "place")
    return placed.select("case_id", F.concat(F.lit("case_"), F.col("place").cast("string")).alias("name"))




def _norules(spark: SparkSession, sf_dir: str):
    from procweave.plans.discovery import SimulatorParameters

    log = from_tables(spark, sf_dir).drop("event_id")
    return SimulatorParameters(flower(LABELS)).discover_from_eventlog(log, max_depth_tree=0)


START = datetime(2024, 3, 4, 9, 0, 0)


@query(
    "q_simulate_deterministic",
    """with c as (select unnest(range(200)) as i), a as (select i, timestamp '2024-03-04 09:00:00' + to_minutes(10*(i+1)) as t from c)
select 'case_'||(i+1) as case_id, 'A' as activity, 'auto' as resource, t as enabled_ts, t as start_ts, t + interval 5 minute as end_ts from a
union all select 'case_'||(i+1), 'B', 'auto', t + interval 5 minute, t + interval 7 minute, t + interval 12 minute from a
union all select 'case_'||(i+1), 'C', 'auto', t + interval 12 minute, t + interval 14 minute, t + interval 19 minute from a""",
)
def simulate_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procweave.plans.discovery import SimulatorParameters
    from procweave.plans.simulation import SimulatorEngine

    fixed = lambda x: {"dist": "fixed", "params": [x], "min": x, "max": x, "mean": x}
    p = SimulatorParameters(sequence(["A", "B", "C"]), arrival=fixed(10.0), execution=dict.fromkeys("ABC", fixed(5.0)), waiting={"auto": fixed(2.0)})
    return SimulatorEngine(p).apply(spark, 200, START, deterministic_time=True)


@query("q_simulate")
def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of 1000 cases from what the test log taught, without rules."""
    from procweave.plans.simulation import SimulatorEngine

    return SimulatorEngine(_norules(spark, sf_dir)).apply(spark, 1000, START, seed=7)


def _leaf(value: float) -> dict:
    return {"feature": None, "value": value, "dist": "fixed", "params": [value], "min": value, "max": value}


def _choice(feature: str, threshold: float, yes: float, no: float) -> dict[int, dict]:
    return {0: {"feature": feature, "threshold": threshold, "yes_id": 1, "no_id": 2, "value": 0.0}, 1: _leaf(yes), 2: _leaf(no)}


@query(
    "q_simulate_rules",
    """with recursive a(i, t) as (select 0, timestamp '2024-03-04 09:00:00' + to_minutes(30) union all
  select i+1, t + to_minutes(case when hour(t)<=11 then 30 else 60 end) from a where i<199),
e(k, activity, enabled, started, ended) as (select * from (values (0, 'A', 0, 0, 5), (1, 'R', 5, 7, 10), (2, 'A', 10, 16, 23), (3, 'B', 23, 29, 33)))
select 'case_'||(i+1) as case_id, activity, 'auto' as resource, t + to_minutes(enabled) as enabled_ts, t + to_minutes(started) as start_ts, t + to_minutes(ended) as end_ts from a, e""",
)
def simulate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for every kind of decision on a net with a choice and a loop; they leave nothing to chance.

    A is done, done again after R, and then B: R is chosen while it wasn't done before. Waiting takes 2
    minutes before R and 6 after, A takes 5 minutes and 7 the second time, cases come every half hour and, from 12, every hour."""
    from procweave.plans.discovery import SimulatorParameters
    from procweave.plans.simulation import SimulatorEngine

    loop = net([("A", "A", ["src"], ["p1"]), ("R", "R", ["p1"], ["src"]), ("B", "B", ["p1"], ["snk"])], "src", "snk")
    p = SimulatorParameters(
        loop, rules_mode=True, weights={"A": None, "R": _choice("R", 0.5, 1.0, 0.0), "B": _choice("R", 0.5, 0.0, 1.0)}, arrival=_choice("hour", 11.5, 30.0, 60.0),
        execution={"A": _choice("A", 0.5, 5.0, 7.0), "R": {0: _leaf(3.0)}, "B": _choice("resource = auto", 0.5, 9.0, 4.0)}, waiting={"auto": _choice("R", 0.5, 2.0, 6.0)},
    )
    return SimulatorEngine(p).apply(spark, 200, START, deterministic_time=True)


PLANTED = "minutes + case when nation<=11 then 100 else 0 end"


@query(
    "q_incremental_split",
    f"""with {LOG}, m as (select activity as key, event_id, {MINUTES} as minutes, event_idx, nation from log),
r as (select key, {PLANTED} as y, event_idx, nation, row_number() over (partition by key order by event_id) as i from m),
f as (select key, y, unnest(['event_idx','nation']) as feature, cast(unnest([event_idx, nation]) as double) as v from r where i<=1000 and key in (select key from r where i=1000)),
g as (select key, feature, v, count(*) as n, sum(y) as s from f group by all),
c as (select key, feature, v, lead(v) over w as nx, sum(n) over (w rows unbounded preceding) as nl, sum(s) over (w rows unbounded preceding) as sl,
  sum(n) over (partition by key, feature) as nt, sum(s) over (partition by key, feature) as st from g window w as (partition by key, feature order by v)),
k as (select key, feature, (v+nx)/2 as threshold, sl*sl/nl+(st-sl)*(st-sl)/(nt-nl)-st*st/nt as gain from c where nx is not null),
best as (select key, feature, max(gain) as gain, max_by(threshold, gain) as threshold from k group by all),
ranked as (select key, list(gain order by gain desc) as gains, max_by(feature, gain) as feature, max_by(threshold, gain) as threshold from best group by key),
split as (select * from ranked where gains[2]/gains[1] < 1-sqrt(ln(1e7)/2000))
select s.key, s.feature, s.threshold, count(*) filter (v<=threshold) as n_yes, round(avg(y) filter (v<=threshold), 6) as mean_yes, count(*) filter (v>threshold) as n_no, round(avg(y) filter (v>threshold), 6) as mean_no
from split s join (select key, y, i, event_idx, nation, unnest(['event_idx','nation']) as feature, unnest([event_idx, nation]) as v from r) r on r.key=s.key and r.feature=s.feature and i>1000 group by all""",
)
def incremental_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental trees of one level with the usual grace period, over labels that depend on the nation: the split
    after the first 1000 rows, and what the leaves learned from the rows after them."""
    x = F.array(F.col("event_idx").cast("double"), F.col("nation").cast("double"))
    rows = _minutes(from_tables(spark, sf_dir)).select(F.col("activity").alias("key"), F.col("event_id").alias("ord"), F.expr(PLANTED).alias("y"), x.alias("x"))
    nodes = hoeffding.folded(rows, ["event_idx", "nation"], max_depth=1)
    return nodes.groupBy("key").agg(
        F.max("feature").alias("feature"), F.max("threshold").alias("threshold"),
        *[F.max(F.when(F.col("node_id") == k, v)).alias(f"{name}_{side}") for k, side in ((1, "yes"), (2, "no")) for name, v in (("n", F.col("n")), ("mean", F.round("value", 6)))],
    ).where("feature is not null")


@query(
    "q_incremental_leaf",
    f"with {LOG}, m as (select activity, {MINUTES} as x from log) select activity as key, count(*) as n, round(avg(x), 6) as value, round(stddev_pop(x), 6) as sd, min(x) as lo, max(x) as hi from m group by activity",
)
def incremental_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees under their grace period are one leaf, with the mean and deviation of what they saw."""
    rows = _minutes(from_tables(spark, sf_dir)).select(F.col("activity").alias("key"), F.col("event_id").alias("ord"), F.col("minutes").alias("y"), F.array(F.col("nation").cast("double")).alias("x"))
    out = hoeffding.folded(rows, ["nation"], grace_period=1 << 40)
    return out.select("key", "n", F.round("value", 6).alias("value"), F.round("sd", 6).alias("sd"), F.col("min").alias("lo"), F.col("max").alias("hi"))


FEATURE_HISTORY = ", ".join(f"cast({x} as bigint) as {x}" for x in LABELS)


@query(
    "q_features",
    f"""with {LOG}, {ENABLED}, h as (select event_id, {HISTORY} from log window b as (partition by case_id order by event_idx rows between unbounded preceding and 1 preceding))
select f.event_id, cast(event_idx + 1 as integer) as step_idx, activity as transition, resource, enabled_ts, start_ts, end_ts, 6 as n_enabled,
  (select count(*) from log q where q.resource=f.resource and q.end_ts>f.enabled_ts and q.start_ts<f.enabled_ts) as workload, {FEATURE_HISTORY}
from f join h using (event_id)""",
)
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature table on the flower net, for steps with an event."""
    log = from_tables(spark, sf_dir)
    steps = alignment.feature_table(log.drop("event_id"), flower(LABELS)).where("log_idx is not null")
    ids = log.select("case_id", F.col("event_idx").alias("log_idx"), "event_id")
    return steps.join(ids, ["case_id", "log_idx"]).select("event_id", "step_idx", "transition", "resource", "enabled_ts", "start_ts", "end_ts", F.size("prev_enabled").alias("n_enabled"), "workload", *LABELS)


@query(
    "q_density",
    f"""with {LOG}, {TIMES}, {fit_sql("m", "activity")}, g as (select unnest(range(0, 200, 10)) as x)
select activity, cast(x as double) as x, round(exp(-(((x-a)/sd)**2)/2)/(sd*sqrt(2*pi())), 9) as norm, round(case when x>=lo then exp(-(x-lo)/(a-lo))/(a-lo) else 0 end, 9) as expon,
  round(case when x between lo and hi then 1/(hi-lo) else 0 end, 9) as uniform, round(case when x>ll then exp(-((ln((x-ll)/lc)/ls)**2)/2)/((x-ll)*ls*sqrt(2*pi())) else 0 end, 9) as lognorm from s, g""",
)
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = distributions.summaries(_minutes(from_tables(spark, sf_dir)), ["activity"], "minutes")
    points = base.withColumn("x", F.explode(F.array(*[F.lit(float(k)) for k in range(0, 200, 10)])))
    return points.select("activity", "x", *[F.round(distributions.density(f, distributions.parameters(f), F.col("x")), 9).alias(f) for f in ("norm", "expon", "uniform", "lognorm")])


@query(
    "q_logistic",
    f"select key as transition, feature, cast(0 as double) as slope from (select unnest({[*LABELS, 'tau_out']}) as key), (select unnest({['intercept', 'nation', *LABELS]}) as feature)",
)
def logistic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of each transition's penalized likelihood at its logistic model, by coefficient: 0 at the one optimum."""
    from procweave.operators import logistic
    from procweave.session import Staging

    log = from_tables(spark, sf_dir)
    steps = features.history(alignment.stepped(log.drop("event_id"), flower(LABELS)), LABELS, ["step_idx"])
    rows, names = control_flow.training_rows(steps, LABELS, ["nation"], {})
    rows = Staging(spark, "logistic").write(rows, "rows")
    models = logistic.fit(rows, names)
    found = spark.createDataFrame([(k, m["intercept"], [m["coefficients"][f] for f in names]) for k, m in models.items()], "key string, b double, w array<double>")
    z = F.col("b") + F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    off = rows.join(found, "key").withColumn("off", 1 / (1 + F.exp(-z)) - F.col("y"))
    terms = F.concat(F.array(F.struct(F.lit("intercept").alias("feature"), F.lit(1.0).alias("v"), F.lit(0.0).alias("w"))), F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("x").alias("v"), F.col("w").alias("w")))
    each = off.select(F.col("key").alias("transition"), "off", F.explode(terms).alias("t"))
    slope = (F.sum(F.col("off") * F.col("t.v")) + F.max("t.w")) / F.count("*")
    return each.groupBy("transition", F.col("t.feature").alias("feature")).agg(F.abs(F.round(slope, 4)).alias("slope"))


@query(
    "q_case_attributes",
    f"with {LOG} select case_id, segment, nation, start_ts from log where event_idx=0",
)
def case_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's attributes, of its first event."""
    return alignment.cases(from_tables(spark, sf_dir)).select("case_id", "segment", "nation", F.col("first_start").alias("start_ts"))


@query("q_net_arcs", "select unnest(['src','tau_in','p','p','p','p','p','p','click','error','purchase','signup','view','tau_out']) as source, unnest(['tau_in','p','click','error','purchase','signup','view','tau_out','p','p','p','p','p','snk']) as target, 1 as weight")
def net_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flower(LABELS).frames(spark)[2]
