"""Queries of metrics over labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as P
from ..operators import metrics as M
from ..sources.tables import scores, series
from .base import HORIZON, SCORES, SERIES, query, rounded


@query(f"""with {SCORES}, b as (select ceil(p*10) b, count(*) n, avg(p) m, avg(y) s from scores where p>0 group by 1) select round(sum(n*abs(m-s))/(select count(*) from scores),6) ece, round(max(abs(m-s)),6) mce, (select round(avg((p-y)*(p-y)),6) from scores) brier from b""")
def m07_right_closed_error(s, d):
    return rounded(M.right_closed_error(scores(s, d)))


@query(f"""with {SCORES}, g as (select k/4.0::double t from range(2,21) r(k)), z as (select y, ln(least(greatest(p,1e-6::double),1-1e-6::double)/(1-least(greatest(p,1e-6::double),1-1e-6::double))) z from scores), q as (select t, round(avg(-(y*ln(1/(1+exp(-z/t)))+(1-y)*ln(1-1/(1+exp(-z/t))))),9) nll from z, g group by t) select t temperature, round(nll,6) nll from q order by q.nll, t limit 1""")
def m08_temperature(s, d):
    return rounded(M.best_temperature(scores(s, d), [k / 4 for k in range(2, 21)]))


@query(f"""with {SCORES}, h as (select floor(p*100) b, sum(y) pos, count(*)-sum(y) neg from scores group by 1), c as (select pos, neg, sum(neg) over (order by b) below from h) select round((sum(pos*(below-neg/2))/(sum(pos)*sum(neg)))::double,6) auc from c""")
def m15_histogram_auc(s, d):
    return rounded(M.histogram_auc(scores(s, d)))


@query(f"""with {SCORES}, r as (select abs(y-p) r, row_number() over (order by abs(y-p)) k, count(*) over () n from scores where doc_id%2=0), q as (select min(case when k>=ceil((n+1)*0.8::double) then r end) q from r) select doc_id%3 "group", count(*) n, round(avg((abs(y-p)<=q)::int),6) coverage, round(2*max(q),6) width from scores, q where doc_id%2=1 group by 1""")
def m11_split_intervals(s, d):
    x = scores(s, d).withColumn("group", F.col("doc_id") % 3)
    return rounded(M.split_intervals(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"), 0.2, "group"))


@query(f"""with {SCORES}, r as (select y, case when y=1 then 1-p else p end r, row_number() over (partition by y order by case when y=1 then 1-p else p end) k, count(*) over (partition by y) n from scores where doc_id%2=0), q as (select y, min(case when k>=ceil((n+1)*0.8::double) then r end) q from r group by y), c as (select max(case when y=1 then q end) q1, max(case when y=0 then q end) q0 from q),
 s as (select y, coalesce(1-p<=q1,true) o, coalesce(p<=q0,true) z from scores, c where doc_id%2=1) select y, count(*) n, count_if(case when y=1 then o else z end) held, count_if(o and z) "both", count_if(not o and not z) "none" from s group by y""")
def m12_label_sets(s, d):
    x = scores(s, d)
    return M.label_sets(x.where("doc_id % 2 = 0"), x.where("doc_id % 2 = 1"), 0.2)


@query(f"""with {SERIES}, o as (select host, t onset from series where event_id%20=0), a as (select host, t from series where score>=0.3) select o.host, o.onset, min(case when a.t<o.onset and o.onset<=a.t+{HORIZON} then a.t end) alert from o left join a on a.host=o.host group by o.host, o.onset""")
def m21_early_warning(s, d):
    """J15 and M21."""
    a = series(s, d)
    return M.covered_onsets(a.where("score >= 0.3").select("host", "t"), a.where("event_id % 20 = 0").select("host", F.col("t").alias("onset")), HORIZON)


@query(f"""with {SERIES}, f as (select *, lead(is_attack,1) over w a1, lead(is_attack,2) over w a2, lead(is_attack,3) over w a3 from series window w as (partition by host order by t,event_id)), e as (select event_id, unnest([1,2,3]) step, unnest([a1,a2,a3]) y, score p from f), q as (select * from e where y is not null)
 select step, count(*) n, round(avg(y::int),6) base, round(avg((p-y::int)*(p-y::int)),6) brier, count_if(p>=0.5 and y) tp from q group by step""")
def m03_horizon_metrics(s, d):
    """One score held against each of the next three rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("t", "event_id")
    ahead = series(s, d).select(F.col("score").alias("p"), F.array(*[F.lead("is_attack", k).over(w) for k in (1, 2, 3)]).alias("ahead"))
    each = ahead.select("p", F.posexplode("ahead").alias("step", "y")).where("y is not null")
    y = F.col("y").cast("int")
    return rounded(each.groupBy((F.col("step") + 1).alias("step")).agg(F.count("*").alias("n"), F.avg(y).alias("base"), F.avg((F.col("p") - y) ** 2).alias("brier"), F.count_if((F.col("p") >= 0.5) & F.col("y")).alias("tp")))


@query(f"""with {SERIES}, f as (select *, lead(is_attack,1) over w a1, lead(is_attack,2) over w a2 from series window w as (partition by host order by t,event_id)), q as (select (a1 or a2)::int y, 1-(1-score/2)*(1-score) p from f where a2 is not null and not is_attack) select count(*) n, count_if(p>=0.5 and y=1) tp, count_if(p>=0.5 and y=0) fp, round(avg((p-y)*(p-y)),6) brier from q""")
def m04_onset_metrics(s, d):
    """The chance of an attack in any of two steps, for rows that are not attacked yet."""
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("t", "event_id")
    ahead = F.lead("is_attack", 1).over(w) | F.lead("is_attack", 2).over(w)
    x = series(s, d).select("is_attack", F.lead("is_attack", 2).over(w).alias("whole"), ahead.cast("int").alias("y"), P.cumulative_hazard(F.array(F.col("score") / 2, F.col("score"))).alias("p"))
    return rounded(M.detection_report(x.where("whole is not null and not is_attack").select("y", "p")).select("n", "tp", "fp", "brier"))


@query(None)
def m13_group_bootstrap(s, d):
    return rounded(M.group_bootstrap(series(s, d), "host", "score", 200, 1))


@query(None)
def x09_adaptive_intervals(s, d):
    x = series(s, d).where("score is not null").select("host", "t", F.col("is_attack").cast("int").alias("y"), F.col("score").alias("p"))
    return rounded(M.adaptive_intervals(x, "host", "t", 0.1).groupBy("key").agg(F.count("*").alias("n"), F.avg(F.col("covered").cast("int")).alias("coverage")))
