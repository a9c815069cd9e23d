"""Queries of linear baselines, assembled trajectories and unified reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linear, trajectories
from ..sources import datasets as U
from ..sources import flow_files as R
from ..sources.tables import flows, series
from .base import FLOWS, SERIES, query, rounded
from .logs import _BOTNET_SQL, _DAILY_SQL, _daily

_STEPS = 3


def _histories(s, d):
    x = series(s, d).select("event_id", "host", "t", "score", F.col("is_attack").cast("double").alias("attack"))
    return linear.flattened(x, ["host"], "t", "event_id", ["score", "attack"], _STEPS)


_HISTORY = f"""{SERIES}, h as (select event_id, host, t, score, is_attack::int::double a, lag(t,1) over o t1, lag(t,2) over o t2, lag(score,1) over o s1, lag(score,2) over o s2, lag(is_attack::int::double,1) over o a1, lag(is_attack::int::double,2) over o a2 from series window o as (partition by host order by t, event_id)),
 f as (select event_id, unnest([coalesce(s2,0),coalesce(a2,0),coalesce(s1,0),coalesce(a1,0),score,a,-ln(1+t-coalesce(t2,t1,t)),-ln(1+t-coalesce(t1,t)),0.0::double]) x, unnest(range(9)) k from h)"""


@query(f"with {_HISTORY} select k feature, count(*) n, round(avg(x),6) mean, round(sqrt(greatest(var_pop(x),1e-12)),6) scale from f group by k")
def r13_history_moments(s, d):
    """Section 2.13: running moments of flattened histories, merged in a tree; one row a feature."""
    n, mean, m2 = linear.moments(_histories(s, d))
    rows = [(k, int(n), float(mean[k]), float(max(m2[k] / max(n, 2.0), linear.FLAT) ** 0.5)) for k in range(len(mean))]
    return rounded(s.createDataFrame(rows, "feature int, n long, mean double, scale double"))


@query(None)
def r13_logistic_baseline(s, d):
    """Section 2.13: the attack of an event's successor from its host's history; events without one are censored."""
    following = F.lead(F.col("is_attack").cast("int")).over(Window.partitionBy("host").orderBy("t", "event_id"))
    labels = series(s, d).select("event_id", "host", "t", "is_attack").select("event_id", following.alias("y"))
    rows = _histories(s, d).join(labels, "event_id")
    model = linear.fit_logistic(rows, "y")
    return rows.select("event_id", "y", F.round(model.probability(F.col("features")), 6).alias("p"))


@query(f"""with {SERIES}, h as (select event_id, host, score, lead(score) over (partition by host order by t, event_id)-score dy from series), m as (select regr_slope(dy, score) b, regr_intercept(dy, score) a from h) select event_id, round(score + a + b*score, 6) next_score from h, m""")
def r13_linear_baseline(s, d):
    """Section 2.13: a linear model of the next score: the last one and a change by least squares."""
    w = Window.partitionBy("host").orderBy("t", "event_id")
    rows = series(s, d).select("event_id", "score", F.array("score").alias("features"), (F.lead("score").over(w) - F.col("score")).alias("change"))
    model = linear.fit_linear(rows, "change")
    return rounded(rows.select("event_id", (F.col("score") + model.score(F.col("features"))).alias("next_score")))


@query(f"""with {SERIES}, o as (select 'h'||host host, row_number() over (partition by host order by t, event_id) w, t, category, case when category='Benign' then null else 'T'||(event_id%9) end tech, score from series), l as (select host, max(w) w, max(t) t, arg_max(score, w) s from o group by host), k as (select unnest([1,2,3]) k),
 st as (select l.host, l.w+k w, l.t+k*30.0::double t, case k when 1 then 'Recon' when 2 then 'C2' else 'Impact' end category, case when k<3 then 'T10'||k else '' end tech, 0.9::double-0.1::double*k conf, s*k/4 risk from l, k where l.s>=0.05), r as (select host, 1-(1-s/4)*(1-s*2/4)*(1-s*3/4) x from l where s>=0.05)
 select o.host, o.w "window", o.t, 'OBSERVED' provenance, o.category, case when o.w=l.w and l.s>=0.05 then 'T0' else coalesce(tech,'Benign') end technique, round(case when o.w=l.w and l.s>=0.05 then 0.5::double else 0.95::double end,9) confidence, round(case when o.w=l.w and l.s>=0.05 then least(1,2*l.s) else score end,9) risk, round(coalesce(r.x,0),9) forecast_risk from o join l using (host) left join r using (host)
 union all select st.host, w, t, 'FORECAST', category, tech, round(conf,9), round(risk,9), round(r.x,9) from st join r using (host)""")
def r16_assembled_trajectories(s, d):
    """Section 2.16: observed windows and three forecast steps a host."""
    c = F.col
    order = Window.partitionBy("host").orderBy("t", "event_id")
    x = series(s, d).withColumn("host", F.concat(F.lit("h"), c("host").cast("string"))).withColumn("window", F.row_number().over(order))
    observed = x.select("host", "window", "t", "category", F.when(c("category") != "Benign", F.concat(F.lit("T"), (c("event_id") % 9).cast("string"))).alias("technique"), c("score").alias("risk"))
    last = observed.groupBy("host").agg(F.max_by("risk", "window").alias("s")).where("s >= 0.05")
    step = lambda k, name: F.struct(F.lit(name).alias("category"), (F.lit(f"T10{k}") if k < 3 else F.lit(None).cast("string")).alias("technique"), F.lit(0.9 - 0.1 * k).alias("confidence"), (c("s") * k / 4).alias("risk"))
    scored = last.select("host", F.lit("T0").alias("technique"), F.lit(0.5).alias("confidence"), F.least(F.lit(1.0), 2 * c("s")).alias("risk"), F.array(step(1, "Recon"), step(2, "C2"), step(3, "Impact")).alias("steps"))
    return rounded(trajectories.assembled(observed, scored, 30.0), 9)


@query(f"""with {FLOWS}, k as (select *, seq%12 k from flows), u as (select 'daily-2017' dataset, {_DAILY_SQL} category, k from k union all select 'daily-2018', {_DAILY_SQL}, k from k),
 c as (select dataset, count(*) total, count_if(category='UNKNOWN') unresolved, count(distinct case when category='UNKNOWN' then k end) unmapped from u group by 1)
 select dataset, category, count(*) n, any_value(total) total, any_value(unresolved) unresolved, round(any_value(unresolved)/any_value(total),6) rate, any_value(unmapped) unmapped from u join c using (dataset) where category<>'UNKNOWN' group by dataset, category""")
def s18_unified_read(s, d):
    """Two data sets by one call each, unresolved rows dropped and counted."""
    out = None
    for year, names in (("2017", R.DAILY_2017), ("2018", R.DAILY_2018)):
        rows, coverage = U.read_flows(s, f"daily-{year}", _daily(year, names)(s, d))
        mine = rows.groupBy(F.col("coarse_category").alias("category")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(coverage))
        out = mine if out is None else out.unionByName(mine)
    return rounded(out)


@query(f"""with {FLOWS}, t as (select *, greatest(end_time-start_time,0) dur, fwd_bytes+bwd_bytes tot, fwd_packets+bwd_packets pk from flows) select seq, round(dur,6) duration, tot total_bytes, pk total_packets, round(case when dur>0 then tot/dur else tot end,6) byte_rate, round(case when dur>0 then pk/dur else pk end,6) packet_rate, case when is_attack then 'T1;'||coarse_category else '' end attck_technique_ids_str from t""")
def k07_records(s, d):
    """Flows with their derived columns."""
    techniques = F.when(F.col("is_attack"), F.array(F.lit("T1"), F.col("coarse_category"))).otherwise(F.array().cast("array<string>"))
    x = U.as_records(flows(s, d).withColumn("attck_technique_ids", techniques))
    return rounded(x.select("seq", "duration", "total_bytes", "total_packets", "byte_rate", "packet_rate", "attck_technique_ids_str"))
