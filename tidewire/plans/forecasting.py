"""Queries of samples, targets, histories and spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import forecast as P
from ..operators import temporal as T
from ..sources.tables import scores, series
from .base import HOUR, PAUSE, SCORES, SERIES, query, rounded

_SEG = f"""{SERIES}, p as (select *, t-lag(t) over (partition by host order by t,event_id) gap from series), seg as (select *, sum(case when gap is null or gap>{20 * PAUSE} then 1 else 0 end) over (partition by host order by t,event_id rows unbounded preceding) seg from p)"""


def _segments(s, d):
    df = T.gap_segments(series(s, d), ["host"], "t", "event_id", 20 * PAUSE)
    return df.select("host", "segment", "event_id", "t", F.col("is_attack").alias("attack"), "category", F.col("score").alias("value"))


@query(f"""with {_SEG}, f as (select event_id, list(score) over a inp, list(struct_pack(x := is_attack, c := category, v := score)) over b fut from seg window a as (partition by host, seg order by t,event_id rows between 2 preceding and current row), b as (partition by host, seg order by t,event_id rows between 1 following and 4 following)), g as (select * from f where len(inp)=3 and len(fut)=4),
 k as (select event_id, inp, unnest([0,1]) b, fut from g) select event_id, round(inp[1]+inp[2]+inp[3],8) input_sum, b step, fut[2*b+1].x or fut[2*b+2].x attack, array_to_string(list_sort(list_distinct(list_filter([fut[2*b+1].c, fut[2*b+2].c], lambda x: x<>'Benign'))),',') categories, round((fut[2*b+1].v+fut[2*b+2].v)/2,8) "value" from k""")
def w07_forecast_samples(s, d):
    df = P.forecast_samples(_segments(s, d), ["host", "segment"], "t", "event_id", 3, 2, 2)
    each = df.select("event_id", F.aggregate("input", F.lit(0.0), lambda a, x: a + x).alias("input_sum"), F.posexplode("steps").alias("step", "x"))
    return rounded(each.select("event_id", "input_sum", "step", "x.attack", F.array_join("x.categories", ",").alias("categories"), "x.value"), 8)


@query(f"""with {_SEG}, f as (select event_id, is_attack now, list(is_attack) over (partition by host, seg order by t,event_id rows between 1 following and 5 following) fut from seg), g as (select event_id, now, fut, list_position(fut, true) p from f where len(fut)=5)
 select event_id, case when not now and p>0 then p-1 end onset, case when now then 0 when p>0 then p else 5 end at_risk, now censored from g""")
def w08_hazard_targets(s, d):
    df = P.forecast_samples(_segments(s, d), ["host", "segment"], "t", "event_id", 1, 5, 1).join(series(s, d).select("event_id", "is_attack"), "event_id")
    x = df.select("event_id", P.hazard_targets(F.col("is_attack"), F.transform("steps", lambda r: r["attack"])).alias("x"))
    return x.select("event_id", "x.onset", F.size(F.filter("x.at_risk", lambda b: b)).alias("at_risk"), "x.censored")


@query(f"""with {_SEG}, f as (select event_id, list(score) over (partition by host, seg order by t,event_id rows between 4 preceding and current row) h, lead(score) over w target, row_number() over w k from seg window w as (partition by host, seg order by t,event_id))
 select event_id, 5-len(h) padding, round(list_sum(h),8) total, round(h[-1],8) last, round(target,8) target from f where k>=2 and target is not null""")
def w09_next_row_samples(s, d):
    df = P.next_row_samples(_segments(s, d), ["host", "segment"], "t", "event_id", "value", 5, 2).join(_segments(s, d).select("event_id", F.col("value").alias("last")), "event_id")
    real = Window.partitionBy("host", "segment").orderBy("t", "event_id")
    count = _segments(s, d).select("event_id", F.least(F.row_number().over(real), F.lit(5)).alias("n"))
    return rounded(df.join(count, "event_id").select("event_id", (5 - F.col("n")).cast("long").alias("padding"), F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("total"), "last", "target"), 8)


@query(f"""with {_SEG}, f as (select event_id, list(score) over (partition by host, seg order by t,event_id rows between 3 preceding and current row) h from seg) select event_id, round(h[1]*(4-len(h))+list_sum(h),8) total from f""")
def w10_edge_padded_history(s, d):
    """Histories that repeat their first value in front."""
    df = P.padded_history(_segments(s, d), ["host", "segment"], "t", "event_id", "value", 4, "edge")
    return rounded(df.select("event_id", F.aggregate("history", F.lit(0.0), lambda a, x: a + x).alias("total")), 8)


@query(f"""with {SERIES}, f as (select event_id, list(case category when 'Benign' then 3 when 'Recon' then 4 when 'Impact' then 5 when 'InitialAccess' then 7 else 9 end) over (partition by host order by t,event_id rows between 4 preceding and current row) h from series) select event_id, array_to_string(list_concat(case len(h) when 1 then [0,0,0,0] when 2 then [0,0,0] when 3 then [0,0] when 4 then [0] else [] end, [1], h),' ') tokens from f""")
def w11_token_histories(s, d):
    from ..functions import labels as L

    df = series(s, d).withColumn("token", L.token_id(L.macro_token(F.col("category"), F.lit(None).cast("string"))))
    return P.token_history(df, ["host"], "t", "event_id", "token", 6, 0, 1).select("event_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""with {SERIES}, a as (select host, t, event_id, t+value_s e from (select *, 3600*(1+event_id%9) value_s from series)), m as (select *, max(e) over (partition by host order by t,event_id rows between unbounded preceding and 1 preceding) reach from a), r as (select *, sum(case when reach is null or t-reach>{HOUR} then 1 else 0 end) over (partition by host order by t,event_id rows unbounded preceding) run from m)
 select host, cast(run as bigint) run, min(t) "start", max(e) "end", count(*) n from r group by host, run""")
def w06_merged_spans(s, d):
    """Spans that overlap, or lie at most an hour apart, become one."""
    spans = series(s, d).select("host", "event_id", F.col("t").alias("start"), (F.col("t") + 3600 * (1 + F.col("event_id") % 9)).alias("end"))
    return T.merged_spans(spans, ["host"], "start", "end", "event_id", HOUR)


@query(f"""with {SERIES}, s as (select host, min(t) lo, max(t) hi from series group by host), x as (select event_id, (t-lo)/greatest(hi-lo,1e-9::double) progress from series join s using (host)) select event_id, round(progress,6) progress, row_number() over (order by round(progress,6), event_id) "position" from x""")
def w15_interleaved(s, d):
    """Rows of all hosts in order of their host's progress; positions come from a distributed count."""
    span = series(s, d).groupBy("host").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    x = series(s, d).join(span, "host").select("event_id", F.round((F.col("t") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)), 6).alias("progress"))
    return T.ranged(x, ["progress", "event_id"], "position")


@query(f"""with {SERIES}, e as (select user_id n, 0 side, epoch_us(ts)/1000000 t, event_id from events union all select event_id%40+1000, 1, epoch_us(ts)/1000000, event_id from events), f as (select n, min(struct_pack(t := t, e := event_id, s := side)) m from e group by n) select n node, row_number() over (order by m)-1 id from f""")
def w17_first_seen_ids(s, d):
    """Nodes numbered by their first appearance, sources before targets of the same row."""
    e = series(s, d).select(F.explode(F.array(F.struct(F.col("host").alias("node"), F.lit(0).alias("side")), F.struct((F.col("event_id") % 40 + 1000).alias("node"), F.lit(1).alias("side")))).alias("x"), "t", "event_id")
    first = e.groupBy("x.node").agg(F.min(F.struct("t", "event_id", "x.side")).alias("m"))
    return T.ranged(first.select("node", "m.*"), ["t", "event_id", "side"], "id").select("node", (F.col("id") - 1).alias("id"))


@query(f"""with {SERIES}, r as (select event_id, category, score, row_number() over (partition by host order by score desc, event_id) k from series), q as (select category, 1/k rr, k from r where score is not null) select category, count(*) n, round(avg(rr),6) mrr, round(avg((k<=1)::int),6) hits1, round(avg((k<=3)::int),6) hits3 from q group by category""")
def w18_reciprocal_ranks(s, d):
    """Rank of each row in its host's list."""
    k = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "event_id"))
    r = series(s, d).withColumn("k", k).where("score is not null")
    return rounded(r.groupBy("category").agg(F.count("*").alias("n"), F.avg(1 / F.col("k")).alias("mrr"), F.avg((F.col("k") <= 1).cast("int")).alias("hits1"), F.avg((F.col("k") <= 3).cast("int")).alias("hits3")))


@query(f"""with {SERIES} select event_id, round(avg(score) over a/greatest(avg(score) over b,1e-9::double),5) ratio from series window a as (partition by host order by t,event_id rows between 4 preceding and current row), b as (partition by host order by t,event_id rows between 49 preceding and current row)""")
def w19_drift_ratio(s, d):
    w = Window.partitionBy("host").orderBy("t", "event_id")
    return rounded(series(s, d).select("event_id", (F.avg("score").over(w.rowsBetween(-4, 0)) / F.greatest(F.avg("score").over(w.rowsBetween(-49, 0)), F.lit(1e-9))).alias("ratio")), 5)


@query(f"""with {SERIES}, l as (select score x, lag(score) over (partition by host order by t,event_id) b from series), q as (select * from l where b is not null) select count(*) n, round(avg((x-b)*(x-b)),6) mse, round(var_pop(x),6) variance from q""")
def m25_persistence_error(s, d):
    """W20 and M25."""
    return rounded(P.persistence_error(series(s, d), ["host"], "t", "event_id", "score"))


_STEPS = f"""{SERIES}, l as (select category, lag(category) over (partition by host order by t,event_id) b from series), c as (select b "before", category, count(*) n from l where b is not null group by all), st as (select "before", category, round((n+1)/(sum(n) over (partition by "before")+5),6) p from c)"""


@query(f"""with {_STEPS} select a."before", b.category, round(sum(a.p*b.p),5) p from st a join st b on a.category=b."before" group by all""")
def w21_two_steps(s, d):
    return rounded(P.transition_power(rounded(A.transitions(series(s, d)).select("before", "category", "p")), 2), 5)


@query(f"""with {_STEPS}, r as (select *, row_number() over (partition by "before" order by p desc, category) k from st), o as (select *, list_position(['Recon','CredentialAccess','InitialAccess','Execution','C2','LateralMovement','Exfiltration','Impact'],"before") x, list_position(['Recon','CredentialAccess','InitialAccess','Execution','C2','LateralMovement','Exfiltration','Impact'],category) y from r)
 select o."before", cast(o.k as int) "rank", o.category, o.p, f.category "then", case when coalesce(y,0)>coalesce(x,0) then 'escalation' when coalesce(y,0)<coalesce(x,0) then 'backoff' else 'pivot' end kind from o left join r f on f."before"=o.category and f.k=1 where o.k<=3""")
def m28_forecast_branches(s, d):
    return P.forecast_branches(rounded(A.transitions(series(s, d)).select("before", "category", "p")))


@query(f"""with {SCORES} select doc_id, case when p>=0.8::double then 'CRITICAL' when p>=0.625::double then 'ELEVATED' when p>=0.5::double then 'WARNING' else 'NOMINAL' end band, round(1/(1+exp(-ln(least(greatest(p,1e-6::double),1-1e-6::double)/(1-least(greatest(p,1e-6::double),1-1e-6::double)))/2)),6) tempered,
 round(1-(1-p/4)*(1-p/2)*(1-p),6) any_step, round(greatest(p-0.1::double,0),6) low, round(least(p+0.1::double,1),6) high, case when p/4>=0.3::double then 0.0::double when p/2>=0.3::double then 2.0::double when p>=0.3::double then 4.0::double end lead, round(cos(p),6) c0, round(cos(p*0.01::double),6) c1, round(least(greatest(p*5000/2,0),300),6) step from scores""")
def f24_score_functions(s, d):
    """F19, F24, F26, F27, F28, M26 and M27."""
    p = F.col("p")
    x = scores(s, d).select(
        "doc_id", P.alert_band(p, 0.5).alias("band"), P.with_temperature(p, 2.0).alias("tempered"), P.cumulative_hazard(F.array(p / 4, p / 2, p)).alias("any_step"), P.forecast_band(p, F.lit(0.1)).alias("b"), P.lead_seconds(F.array(p / 2, p), p / 4, 0.3, 2.0).alias("lead"),
        P.time_encoding(p, 3).alias("e"), P.normal_step(p * 5000, 2.0).alias("step"),
    )
    return rounded(x.select("doc_id", "band", "tempered", "any_step", "b.low", "b.high", "lead", F.get("e", F.lit(0)).alias("c0"), F.get("e", F.lit(1)).alias("c1"), "step"))


@query(f"""with {SERIES}, u as (select host, t lo, t+1800 hi from series where event_id%11=0) select event_id, min(case when lo>t then lo-t when lo<=t then 0.0::double end) wait from series s left join u on u.host=s.host and u.hi>=s.t group by event_id""")
def j13_next_span(s, d):
    """The wait until the first unknown span that is not over yet, 0 inside one."""
    a = series(s, d)
    spans = a.where("event_id % 11 = 0").select("host", F.col("t").alias("start"), (F.col("t") + 1800).alias("end"))
    return T.next_span(a.select("event_id", "host", "t"), spans, ["host"], "t", "event_id").select("event_id", "wait")
