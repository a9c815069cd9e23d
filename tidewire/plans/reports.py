"""Queries of reports: detections, operating points, classes, links, concentration, compaction, campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common.store import written
from ..operators import alerts as A
from ..operators import forecast as P
from ..operators import hosts as H
from ..operators import reports as R
from ..operators import temporal as T
from ..sources.tables import flows, scores, sent_flows, series, table
from .base import FLOW_WINDOW, FLOWS, GRID, HORIZON, PAUSE, SCORES, SERIES, STAGE, query, rounded

_HOURS = 24.0


@query(f"""with {SCORES}, c as (select count(*) n, count_if(p>=0.5 and y=1) tp, count_if(p>=0.5 and y=0) fp, count_if(p<0.5 and y=1) fn, count_if(p<0.5 and y=0) tn from scores),
 h as (select p, sum(y) pos, count(*) m from scores group by p), g as (select pos, sum(pos) over (order by p desc) t, sum(m) over (order by p desc) a from h), ap as (select sum(pos*t/a)/sum(pos) v from g)
 select n, round((tp+fn)/n,6) base_rate, round((tp+tn)/n,6) accuracy, round((tp/(tp+fn)+tn/(tn+fp))/2,6) balanced_accuracy, round(fp/(fp+tn),6) fpr, round(fp/{_HOURS}::double,6) false_alarms_per_hour, round(case when (tp+fn)/n<0.05::double or (tp+fn)/n>0.95::double then (v-(tp+fn)/n)::double end,6) pr_auc_lift from c, ap""")
def m01_detection_details(s, d):
    """Accuracy, balanced accuracy, base rate, false alarms an hour."""
    return rounded(R.detection_details(scores(s, d), hours=_HOURS).select("n", "base_rate", "accuracy", "balanced_accuracy", "fpr", "false_alarms_per_hour", "pr_auc_lift"))


@query(f"""with {SCORES}, x as (select y, least(cast(floor(p*100) as bigint),100) b from scores), g as (select unnest(range(101)) b), t as (select g.b, count_if(x.b>=g.b and y=1) tp, count_if(x.b>=g.b) fl, count_if(y=1) ps, count(*) n from g, x group by g.b),
 c as (select *, 2*tp/(fl+ps) f1, tp/ps recall, fl/n alert_rate, fl/n <= 1.05::double*ps/n fits from t where fl>0 and fl<n and ps>0 and ps<n),
 k as (select 'max_f1' criterion, arg_max(c, (f1,-b)) x from c union all select 'budgeted_f1', coalesce(arg_max(c, (f1,-b)) filter (fits), arg_max(c, (f1,-b))) from c union all select 'max_recall_at_budget', coalesce(arg_max(c, (recall,-b)) filter (fits), arg_max(c, (f1,-b))) from c)
 select criterion, round(x.b/100,6) threshold, x.tp tp, x.fl-x.tp fp, x.ps-x.tp fn, x.n-x.fl-(x.ps-x.tp) tn, round(x.tp/x.fl,6) "precision", round(x.recall,6) recall, round(x.f1,6) f1, round((x.fl-x.tp)/(x.n-x.ps),6) fpr, round(x.alert_rate,6) alert_rate, round(x.ps/x.n,6) base_rate, x.fits within_budget from k""")
def m14_budgeted_points(s, d):
    """Three criteria for a threshold, two of them within a budget of alerts."""
    return rounded(R.operating_points(scores(s, d), budget=1.05))


@query("""with e as (select label y, vec_id%10 g from embeddings), k as (select y c from e union select g from e), p as (select c, count_if(y=c) s, count_if(g=c) gs, count_if(y=c and g=c) h from k, e group by c), t as (select sum(s) n, sum(h) h, max(s) m, avg(case when s>0 then 2*h/(s+gs) end) f, count_if(s>0) cp, count_if(gs>0) cg from p)
 select n::bigint n, round(h/n,6) accuracy, round(f,6) macro_f1, round(m/n,6) majority_baseline, round(h/n-m/n,6) lift, round(2*(m/n)/(m/n+1)/cp,6) macro_f1_baseline, round(f-2*(m/n)/(m/n+1)/cp,6) macro_f1_lift, cp classes_present, cg classes_predicted from t""")
def m17_confusion_summary(s, d):
    """Accuracy and macro F1 against naming the commonest class."""
    e = table(s, d, "embeddings").select(F.col("label").cast("long").alias("y"), (F.col("vec_id") % 10).alias("guess"))
    return rounded(R.confusion_summary(e))


def _class_scores(s, d):
    """Ten scores between 0 and 1 a row, and the index of the true class."""
    e = table(s, d, "embeddings")
    scores_ = F.transform(F.slice("embedding", 1, 10), lambda x: F.round(1 / (1 + F.exp(-x.cast("double"))), 3))
    return e.select("vec_id", F.col("label").cast("int").alias("y"), scores_.alias("scores"))


_CLASS = "x as (select vec_id, label y, list_transform(embedding[1:10], lambda v: round(1/(1+exp(-v::double)),3)) s from embeddings)"


@query(f"""with {_CLASS}, r as (select 1+len(list_filter(s, lambda v: v>s[y+1])) k, (list_position(s, list_max(s))-1=y)::int h from x), t as (select count(*) n, avg(1/k) mrr, avg((k<=1)::int) h1, avg((k<=3)::int) h3, avg((k<=5)::int) h5, sum(h) tp from r)
 select n, round(mrr,6) mrr, round(h1,6) hits1, round(h3,6) hits3, round(h5,6) hits5, round(tp/n,6) accuracy, round((n-tp)/((n-tp)+9*n-(n-tp)),6) fpr, round((n-tp)/n,6) fnr, round(tp/n,6) tpr, round((9*n-(n-tp))/(9*n),6) tnr from t""")
def m23_class_ranks(s, d):
    """MRR, hits, and rates over all classes."""
    return rounded(R.class_ranks(_class_scores(s, d), "scores", "y", 10))


@query(f"""with {_CLASS}, e as (select y, unnest(range(10)) c, unnest(s) p from x), r as (select c, y=c pos, rank() over (partition by c order by p)+(count(*) over (partition by c, p)-1)/2.0 k from e)
 select cast(c as int) "class", count_if(pos) support, round(((sum(case when pos then k end)-count_if(pos)*(count_if(pos)+1)/2)/(count_if(pos)*(count(*)-count_if(pos))))::double,6) auc from r group by c""")
def m23_class_curves(s, d):
    """ROC-AUC of each class against all others."""
    return rounded(R.class_curves(_class_scores(s, d), "scores", "y"))


@query(f"""with {FLOWS}, k as (select row_number() over (order by dst_ip)-1 k, dst_ip from (select distinct dst_ip from flows)), e as (select 1 y, (seq*7919)%1000/1000 p from flows union all select 0, (seq*104729+13)%997/1000 from flows), h as (select p, sum(y) pos, count(*) m from e group by p),
 g as (select pos, m, sum(pos) over (order by p desc) t, sum(m) over (order by p desc) a from h) select round((sum(pos*t/a)/sum(pos))::double,6) average_precision, round((sum((m-pos)*(t-pos)+(m-pos)*pos/2)/(sum(pos)*sum(m-pos)))::double,6) roc_auc from g""")
def m23_link_scores(s, d):
    """Average precision and ROC-AUC of real edges against as many that are not."""
    f = sent_flows(s, d).select("seq")
    real = f.select(F.lit(1).alias("y"), (F.col("seq") * 7919 % 1000 / 1000).alias("p"))
    drawn = f.select(F.lit(0).alias("y"), ((F.col("seq") * 104729 + 13) % 997 / 1000).alias("p"))
    return rounded(R.detection_report(real.union(drawn)).select("average_precision", "roc_auc"))


@query(f"""with {SCORES} select count(*) n, round(avg(-(y*ln(least(greatest(p,1e-7::double),1-1e-7::double))+(1-y)*ln(1-least(greatest(p,1e-7::double),1-1e-7::double)))),6) nll from scores""")
def m06_log_loss(s, d):
    return rounded(R.log_loss(scores(s, d)))


@query(f"""with {SERIES}, r as (select event_id%5 seed, category metric, avg(score) v from series group by all) select metric, count(*) runs, round(avg(v),6) mean, round(coalesce(stddev_samp(v),0),6) sd from r group by metric""")
def m13_seed_summary(s, d):
    """A metric over runs of five seeds."""
    runs = series(s, d).groupBy((F.col("event_id") % 5).alias("seed"), F.col("category").alias("metric")).agg(F.avg("score").alias("v"))
    return rounded(R.seed_summary(runs, "metric", "v"))


@query(f"""with {FLOWS}, c as (select coarse_category category, src_ip, count(*) n from flows group by all), w as (select *, sum(n) over (partition by category order by n desc, src_ip) upto, sum(n) over (partition by category) records, count(*) over (partition by category) hosts, row_number() over (partition by category order by n desc, src_ip) k from c)
 select category, any_value(records)::bigint records, any_value(hosts) hosts, min(case when upto>=0.9::double*records then k end) covering from w group by category""")
def a20_covering_hosts(s, d):
    """How many hosts cover nine tenths of a category's records."""
    return R.hosts_for_share(flows(s, d), "coarse_category", "src_ip", 0.9)


@query(f"""with {FLOWS}, a as (select start_time-lag(start_time,1,0) over (partition by src_ip order by start_time, seq) x, start_time-lag(start_time,1,0) over (partition by dst_ip order by start_time, seq) y from flows) select 'source' side, count(*) n, round(avg(x),3) mean, round(stddev_pop(x)/1000,3) std_k from a union all select 'target', count(*), round(avg(y),3), round(stddev_pop(y)/1000,3) from a""")
def a15_both_ends(s, d):
    """Time since the previous edge of the source, and of the target."""
    each = [R.time_statistics(f, node, "start_time", "seq").select(F.lit(side).alias("side"), "n", "mean", (F.col("std") / 1000).alias("std_k")) for side, node, f in (("source", "src_ip", sent_flows(s, d)), ("target", "dst_ip", flows(s, d)))]
    return rounded(each[0].unionByName(each[1]), 3)



@query(f"""with {FLOWS}, g as ({GRID} from ends), t as (select host, w, start_time, seq, unnest([1,2]) place, unnest(['T'||(dst_port%5),'T'||(seq%3)]) technique from g where is_attack), f as (select host, w, technique, min((start_time, seq, place)) m from t group by all),
 l as (select host, w, string_agg(technique, ';' order by m, technique) techniques from f group by all), n as (select host, w, count(*) n, count_if(is_attack) n_attack from g group by all) select host, w "window", n, n_attack, coalesce(techniques,'') techniques from n left join l using (host, w)""")
def a05_window_techniques(s, d):
    """A window's techniques in the order in which they appear."""
    x = T.on_grid(flows(s, d), "start_time", FLOW_WINDOW).withColumn("techniques", F.array(F.concat(F.lit("T"), (F.col("dst_port") % 5).cast("string")), F.concat(F.lit("T"), (F.col("seq") % 3).cast("string"))))
    return H.labelled_windows(x, ["start_time", "seq"]).select("host", "window", "n", "n_attack", F.array_join("techniques", ";").alias("techniques"))


_SEG = f"""{SERIES}, p as (select *, t-lag(t) over (partition by host order by t,event_id) gap from series), seg as (select *, sum(case when gap is null or gap>{PAUSE} then 1 else 0 end) over (partition by host order by t,event_id rows unbounded preceding) seg from p)"""


@query(f"""with {_SEG}, f as (select event_id, t, list(score) over a h, list(t) over a ht, list(score) over b n, list(t) over b nt from seg window a as (partition by host, seg order by t,event_id rows between 2 preceding and current row), b as (partition by host, seg order by t,event_id rows between 1 following and 4 following))
 select event_id, round(list_sum(h),6) seen, round(h[1],6) oldest, round(ht[1]-t,3) oldest_seconds, round(list_sum(n)+(4-len(n))*n[len(n)],6) ahead, round(nt[least(4,len(nt))]-t,3) last_seconds, len(n) valid from f where len(h)=3 and len(n)>0""")
def w10_rollout_samples(s, d):
    """Histories and futures with their real seconds, and which futures are real."""
    x = T.gap_segments(series(s, d), ["host"], "t", "event_id", PAUSE)
    r = P.rollout_samples(x, ["host", "segment"], "t", "event_id", "score", 3, 4)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    out = r.select(
        "event_id", total("input").alias("seen"), F.get("input", 0).alias("oldest"), F.round(F.get("input_seconds", 0), 3).alias("oldest_seconds"), total("future").alias("ahead"), F.round(F.get("future_seconds", 3), 3).alias("last_seconds"),
        F.size(F.filter("future_valid", lambda v: v)).cast("long").alias("valid"),
    )
    return rounded(out)


_ENTRIES = f"""{SERIES}, en as (select host, event_id, t, category, case when category='Benign' then null else 'T'||(event_id%2) end technique, case when event_id%10=0 then 'FORECAST' else 'OBSERVED' end provenance, score risk, (event_id%100)/100 confidence from series),
 lg as (select *, lag(t) over o pt, lag(category) over o pc, lag(technique) over o pq, lag(provenance) over o pp from en window o as (partition by host order by t,event_id)), rn as (select *, sum(case when pt is not null and t-pt<={HORIZON} and pc=category and pq is not distinct from technique and pp=provenance then 0 else 1 end) over (partition by host order by t,event_id rows unbounded preceding) run from lg),
 nd as (select host, run, any_value(category) category, any_value(technique) technique, any_value(provenance) provenance, arg_min(event_id, (t,event_id)) node, min(t) "start", max(t) "end", count(*) n, max(risk) risk, avg(confidence) confidence, count_if(category<>'Benign' or risk>0.5) attacks from rn group by host, run)"""


def _entries(s, d):
    c = F.col
    technique = F.when(c("category") != "Benign", F.concat(F.lit("T"), (c("event_id") % 2).cast("string")))
    return series(s, d).select("host", "event_id", "t", "category", technique.alias("technique"), F.when(c("event_id") % 10 == 0, "FORECAST").otherwise("OBSERVED").alias("provenance"), c("score").alias("risk"), (c("event_id") % 100 / 100).alias("confidence"))


@query(f"""with {_ENTRIES} select host, node, category, technique, provenance, "start", "end", n, round(risk,6) risk, round(confidence,6) confidence, attacks from nd""")
def w22_full_compaction(s, d):
    """Entries alike in category, technique and provenance."""
    return rounded(A.compact_alike(_entries(s, d), HORIZON).drop("run"))


_LINKS = f"""lk as (select * from (select x.node u, y.node v, (case when {STAGE.format("x.category")} is null or {STAGE.format("y.category")} is null then 0.1::double when x.category=y.category then 0.85::double when {STAGE.format("y.category")} > {STAGE.format("x.category")} then round(greatest(0.2::double, 0.95::double-0.15::double*({STAGE.format("y.category")}-{STAGE.format("x.category")})),4) else 0.2::double end)*(1-(y."start"-x."start")/{HORIZON}) score
  from nd x join nd y on x.host=y.host and y."start"-x."start" between 0 and {HORIZON} and (y."start">x."start" or x.node<y.node) where not (x.category='Benign' and y.category='Benign')) where score>=0.35)"""


def _nodes_and_links(s, d):
    # Both are read several times.
    nodes = written(A.compact_alike(_entries(s, d), HORIZON), "nodes")
    links = A.score_edges(nodes.select("host", F.col("node").alias("event_id"), F.col("start").alias("t"), "category"), HORIZON, 0.35)
    return nodes, written(links.select("u", "v", "score"), "links")


@query(f"""with {_ENTRIES}, {_LINKS}, en2 as (select distinct unnest([u,v]) node from lk where score>=0.7), kp as (select *, node in (select node from en2) or category not in ('Benign','None','Unknown') or coalesce(technique,'') not in ('Benign','None','') or risk>=0.9::double stays from nd),
 ek as (select count(*) k from lk where score>=0.7 and u in (select node from kp where stays) and v in (select node from kp where stays)), t as (select count(*) nodes, count_if(stays) kept, (select count(*) from lk) edges, (select k from ek) edges_kept, sum(n) en, sum(attacks) att, sum(case when stays then n else 0 end) enk, sum(case when stays then attacks else 0 end) atk from kp)
 select nodes, kept, edges, edges_kept, round(greatest(0,1-(kept+edges_kept)/(nodes+edges)),6) compaction_ratio, round(atk/att,6) attack_recall, round(case when en>enk then (att-atk)/(en-enk) else 0 end,6) false_pruning_rate from t""")
def g08_pruning_report(s, d):
    """Nodes that stay, numbered anew, and what pruning cost."""
    nodes, links = _nodes_and_links(s, d)
    kept, between, report = A.pruned_nodes(nodes, links, strong=0.7, risky=0.9)
    return rounded(report)


@query(f"""with recursive {_ENTRIES}, {_LINKS}, bw as (select u a, v b from lk union select v, u from lk), rc as (select a x, b y from bw union select r.x, bw.b from rc r join bw on r.y=bw.a), cp as (select node, coalesce((select least(min(y), nd.node) from rc where x=nd.node), nd.node) campaign from nd),
 m as (select nd.*, campaign from nd join cp using (node)), tq as (select campaign, technique, min(("start", node)) fst from m where technique is not null group by all), tl as (select campaign, string_agg(technique, ';' order by fst, technique) techniques from tq group by 1), ec as (select campaign, count(*) e from lk join cp on cp.node=lk.u group by 1)
 select campaign, count(*) n, count(distinct host) hosts, min("start") "start", max("end") "end", round(max("end")-min("start"),3) duration, round(max(risk),6) risk, coalesce(any_value(e),0) edges, coalesce(any_value(techniques),'') techniques, bool_or(provenance='FORECAST') has_forecast from m left join ec using (campaign) left join tl using (campaign) group by campaign""")
def g11_campaign_details(s, d):
    """Campaigns with their edges inside, techniques and forecasts."""
    nodes, links = _nodes_and_links(s, d)
    return rounded(A.campaign_details(nodes, links).withColumns({"techniques": F.array_join("techniques", ";"), "duration": F.round("duration", 3)}))
