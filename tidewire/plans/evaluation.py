"""Queries of the prediction reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import evaluation as E
from ..operators import metrics as M
from ..sources.tables import scores, series, table
from .base import HORIZON, SCORES, SERIES, query, rounded

_LABELS = """m as (select doc_id, k, case k when 0 then toxic when 1 then quality else (n_chars%3=0)::int end y, (n_chars*(k+2)%1000)/1000.0::double p from documents join labels using (doc_id), (select unnest([0,1,2]) k))"""
_CURVE = "select {k} p, pos, n, sum(pos) over (partition by {part} order by p desc) tp, sum(n) over (partition by {part} order by p desc) al from (select {k} p, sum(y) pos, count(*) n from {t} group by all)"


def _labels(s, d):
    x = table(s, d, "documents").select("doc_id", "n_chars").join(table(s, d, "labels"), "doc_id")
    ys = F.array(F.col("toxic"), F.col("quality"), (F.col("n_chars") % 3 == 0).cast("int"))
    return x.select("doc_id", F.posexplode(ys).alias("k", "y"), "n_chars").select("doc_id", "k", F.col("y").cast("int").alias("y"), (F.col("n_chars") * (F.col("k") + 2) % 1000 / 1000.0).alias("p"))


@query(f"""with {_LABELS}, c as ({_CURVE.format(k="k,", part="k", t="m")}), l as (select k, count_if(p>=.5 and y=1) tp, count_if(p>=.5 and y=0) fp, count_if(p<.5 and y=1) fn from m group by k), r as (select doc_id, count_if(p>=.5 and y=1) tp, count_if(p>=.5 and y=0) fp, count_if(p<.5 and y=1) fn, sum(y) s from m group by doc_id),
 t as (select *, row_number() over (partition by doc_id order by p desc, k) i from m), h as (select doc_id, sum(case when i<=1 then y end) h1, sum(y) h3 from t where i<=3 group by doc_id)
 select round(2*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn)),6) micro_f1, round(avg(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)),6) macro_f1, round((select avg(coalesce(2*tp/nullif(2*tp+fp+fn,0),0)) from r),6) samples_f1, round((select avg(ap) from (select k, sum(pos*tp/al)/sum(pos) ap from c group by k having sum(pos)>0)),6) mean_ap,
  round((select avg(h1) from h),6) precision_at_1, round((select avg(h1/greatest(s,1)) from h join r using (doc_id)),6) recall_at_1, round((select avg(h3)/3 from h),6) precision_at_3, round((select avg(h3/greatest(s,1)) from h join r using (doc_id)),6) recall_at_3 from l""")
def m02_multilabel_report(s, d):
    return rounded(E.multilabel_report(_labels(s, d), "doc_id", "k"))


@query(f"""with {_LABELS}, t as (select doc_id, k, row_number() over (partition by doc_id order by p desc, k) place from m) select doc_id, k, cast(place as int) place from t where place<=2""")
def l08_top_labels(s, d):
    return E.top_labels(_labels(s, d), "doc_id", "k", 2).select("doc_id", "k", "place")


_COVERED = f"""o as (select host, t onset from series where event_id%20=0), a as (select host, t from series where score>=0.3), v as (select o.host, o.onset, o.onset-min(case when a.t<o.onset and o.onset<=a.t+{HORIZON} then a.t end) lead from o left join a on a.host=o.host group by o.host, o.onset)"""


@query(f"""with {SERIES}, {_COVERED} select count(*) episodes, count(lead) detected, count_if(lead is null) missed, round(avg(lead),3) "mean", round(min(lead),3) least, round(max(lead),3) most, round(count_if(lead>=3600)/count(*),3) an_hour, round(count_if(lead>=43200)/count(*),3) half_a_day,
 round(quantile_cont(lead,0.1),3) p10, round(quantile_cont(lead,0.5),3) "median", round(quantile_cont(lead,0.9),3) p90 from v""")
def m05_lead_times(s, d):
    a = series(s, d)
    covered = M.covered_onsets(a.where("score >= 0.3").select("host", "t"), a.where("event_id % 20 = 0").select("host", F.col("t").alias("onset")), HORIZON)
    return rounded(E.lead_time_report(covered, {"an_hour": 3600, "half_a_day": 43200}), 3)


@query(f"""with {SCORES}, h as (select floor(abs(y-p)*100) b, count(*) c from scores group by 1), u as (select b, sum(c) over (order by b) u, sum(c) over () n from h), k as (select min(b) b, min(u) u, max(n) n from u where u>=ceil((n+1)*(1-0.2::double))) select n::bigint n, round(least((b+1)/100,1),6) half_width, round(u/n,6) coverage from k""")
def m10_histogram_half_width(s, d):
    return rounded(E.half_width(scores(s, d), 0.2, 101))


_PREVIOUS = "l as (select *, lag(is_attack) over (partition by host order by t,event_id) b, lag(category) over (partition by host order by t,event_id) bc from series)"


@query(f"""with {SERIES}, {_PREVIOUS}, x as (select is_attack::int y, unnest([{{'m':'score','g':(score>=0.3)::int}},{{'m':'persistence','g':b::int}}]) r, b from l where b is not null), z as (select y, r.m model, r.g g, unnest(case when b then ['overall'] else ['overall','onset'] end) scope from x)
 select model, scope, count(*) n, round(avg((y=g)::int),6) accuracy, round(coalesce(2*count_if(y=1 and g=1)/nullif(2*count_if(y=1 and g=1)+count_if(y=0 and g=1)+count_if(y=1 and g=0),0),0),6) f1 from z group by all""")
def m16_benchmark(s, d):
    before = F.lag("is_attack").over(Window.partitionBy("host").orderBy("t", "event_id"))
    rows = series(s, d).select(F.col("is_attack").cast("int").alias("y"), "score", before.alias("before")).where("before is not null")
    return rounded(E.benchmark(rows, {"score": F.col("score") >= 0.3, "persistence": F.col("before")}, {"overall": F.lit(True), "onset": ~F.col("before")}))


_CLASSES = f"""{_PREVIOUS}, q as (select category tr, bc pr from l where bc is not null), n as (select category c, count(*) k from series where event_id%2=0 and category<>'Impact' group by 1),
 cl as (select c "class", count_if(tr=c) support, count_if(pr=c) predicted, count_if(tr=c and pr=c) tp, coalesce(max(n.k),0) trained from (select distinct tr c from q union select distinct pr from q) join q on true left join n using (c) group by c)"""


def _classes(s, d):
    before = F.lag("category").over(Window.partitionBy("host").orderBy("t", "event_id"))
    x = series(s, d)
    pairs = x.select(F.col("category").alias("truth"), before.alias("predicted")).where("predicted is not null")
    return E.classes(pairs, x.where("event_id % 2 = 0 and category <> 'Impact'").select(F.col("category").alias("label")))


@query(f"""with {SERIES}, {_CLASSES} select "class", support, predicted, tp, trained, round(coalesce(tp/nullif(predicted,0),0),6) "precision", round(coalesce(tp/nullif(support,0),0),6) recall, round(coalesce(2*tp/nullif(support+predicted,0),0),6) f1 from cl""")
def m18_classes(s, d):
    return rounded(_classes(s, d))


@query(f"""with {SERIES}, {_CLASSES}, f as (select *, coalesce(2*tp/nullif(support+predicted,0),0) f1 from cl where support>0) select round(avg(case when trained>0 then f1 end),6) macro_f1_seen, round(avg(f1),6) macro_f1_all, round(sum(case when trained>0 then tp end)/sum(case when trained>0 then support end),6) accuracy_seen, round(sum(tp)/sum(support),6) accuracy_all, round(coalesce(sum(case when trained=0 then support end),0)/sum(support),6) unseen_share from f""")
def m18_unseen_summary(s, d):
    return rounded(E.unseen_summary(_classes(s, d)))


@query(f"""with {SERIES}, {_PREVIOUS}, n as (select bc b, category c, count(*) k from l where bc is not null group by all), s1 as (select b, c nx from (select *, row_number() over (partition by b order by k desc, c) i from n) where i=1), mj as (select category m from series group by 1 order by count(*) desc, 1 limit 1),
 f as (select category t0, lead(category,1) over w t1, lead(category,2) over w t2, lead(category,3) over w t3 from series window w as (partition by host order by t,event_id)),
 g as (select f.*, coalesce(a.nx,t0) f1 from f left join s1 a on a.b=t0), g2 as (select g.*, coalesce(a.nx,f1) f2 from g left join s1 a on a.b=f1), g3 as (select g2.*, coalesce(a.nx,f2) f3, coalesce(c.nx,t1) c2, coalesce(e.nx,t2) c3 from g2 left join s1 a on a.b=f2 left join s1 c on c.b=t1 left join s1 e on e.b=t2),
 z as (select t0, unnest([{{'s':1,'t':t1,'f':f1,'c':f1}},{{'s':2,'t':t2,'f':f2,'c':c2}},{{'s':3,'t':t3,'f':f3,'c':c3}}]) r from g3)
 select r.s step, count(*) n, round(avg((r.t=r.f)::int),6) free, round(avg((r.t=r.c)::int),6) forced, round(avg((r.t=t0)::int),6) persistence, round(avg((r.t=m)::int),6) majority, round(avg(case when r.t<>t0 then (r.t=r.f)::int end),6) on_change from z, mj where r.t is not null group by r.s""")
def m19_token_scores(s, d):
    x = series(s, d)
    return rounded(E.token_scores(x, ["host"], ["t", "event_id"], "category", A.transitions(x).select("before", "category", "n"), 3))


@query("""with e as (select vec_id, embedding::double[] v from embeddings), j as (select a.vec_id%4 step, a.v p, b.v t from e a join e b on b.vec_id=a.vec_id+1), x as (select step, list_sum(list_transform(list_zip(p,t), lambda z: (z[1]-z[2])*(z[1]-z[2]))) dd, list_sum(list_transform(list_zip(p,t), lambda z: abs(z[1]-z[2]))) ad, len(p) n, list_dot_product(p,t)/sqrt(list_dot_product(p,p)*list_dot_product(t,t)) c, list_dot_product(t,t) tt from j),
 g as (select step, sum(dd)/sum(n) mse, sum(ad)/sum(n) mae, avg(c) cosine, sqrt(sum(dd))/sqrt(sum(tt)) relative from x group by step) select step, round(mse,5) mse, round(mae,5) mae, round(cosine,5) cosine, round(relative,5) relative, round(mse/(select mse from g where step=0),5) growth from g""")
def m20_dynamics(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    target = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target"))
    return rounded(E.dynamics(e.join(target, "vec_id").withColumn("step", F.col("vec_id") % 4), "step", "embedding", "target"), 5)


@query(f"""with {SCORES}, c as ({_CURVE.format(k="", part="1", t="scores")}) select round(min((al-tp)/((select count(*)-sum(y) from scores))),6) fpr from c where tp>=0.95::double*(select sum(y) from scores)""")
def m22_false_positives(s, d):
    return rounded(E.false_positives_at(scores(s, d), 0.95))


@query(f"""with {_LABELS}, c as ({_CURVE.format(k="k,", part="k", t="m")}), f as (select c.k, p, 2*tp/(al+(select sum(y) from m where m.k=c.k)) f1 from c), b as (select k, max(struct_pack(f := f1, q := -p)) b from f group by k) select k, -(b.q) threshold, round(b.f,6) f1 from b""")
def m24_best_thresholds(s, d):
    return rounded(E.best_threshold(_labels(s, d), ("k",)))


@query("""with x as (select doc_id, case when doc_id%11=0 then null else (n_chars%1000)/1000.0::double end a, case when doc_id%13=0 then 'nan'::double when doc_id%17=0 then 0 else (n_chars%7)/7.0::double end b from documents) select doc_id, round(case when b is null or isnan(b) then a when a is null then b when a+b<=0 then 0 else 2*a*b/(a+b) end,6) score from x""")
def m24_selection_score(s, d):
    n = F.col("n_chars")
    a = F.when(F.col("doc_id") % 11 != 0, n % 1000 / 1000.0)
    b = F.when(F.col("doc_id") % 13 == 0, float("nan")).when(F.col("doc_id") % 17 == 0, 0.0).otherwise(n % 7 / 7.0)
    return rounded(table(s, d, "documents").select("doc_id", E.selection_score(a, b).alias("score")))
