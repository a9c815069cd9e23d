"""Queries of the flow and alert operators over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import flow as X
from ..operators import alerts as A
from ..operators import hosts as H
from ..operators import metrics as M
from ..operators import temporal as T
from ..sources.tables import flows, scores, series, start_times, table
from ..streaming.windows import incidents, windowed_totals
from .base import EDGES, FLOW_WINDOW, FLOWS, GRID, HORIZON, HOUR, LATER, LEAST_RATE, PAUSE, PRIVATE, SCORES, SERIES, SEV, query, rounded


def _windowed(s, d):
    return T.on_grid(flows(s, d), "start_time", FLOW_WINDOW, times=start_times(s, d))


@query(f"""with {FLOWS} select seq, round(ln(1+fwd_bytes)/20,6) f0, round(ln(1+bwd_bytes)/20,6) f1, round(ln(1+fwd_packets)/10,6) f2, round(ln(1+bwd_packets)/10,6) f3, round(least(end_time-start_time,300)/300,6) f4,
 round(ln(1+{LEAST_RATE.format("fwd_bytes+bwd_bytes")})/20,6) f5, round(ln(1+{LEAST_RATE.format("fwd_packets+bwd_packets")})/10,6) f6, (protocol=6)::int::double f7, (protocol=17)::int::double f8, (protocol=1)::int::double f9,
 round(ln(1+dst_port)/ln(65536),6) f10, round((fwd_bytes-bwd_bytes)/(fwd_bytes+bwd_bytes+1e-5),6) f11 from flows""")
def f02_edge_features(s, d):
    return rounded(flows(s, d).select("seq", *[c.cast("double").alias(f"f{k}") for k, c in enumerate(X.edge_features())]))


@query(f"""with {FLOWS}, q as (select *, end_time-start_time dur, fwd_bytes+bwd_bytes tot, fwd_bytes/greatest(fwd_packets,1) sf, bwd_bytes/greatest(bwd_packets,1) sb, dst_port in (80,443,8000,8080,8443) web from flows),
 k as (select *, case when not web and dur>=2 and fwd_packets>=4 and bwd_packets>=4 and sf<=250 and sb<=350 and tot<50000 then 1 when web and dur>=10 and fwd_packets>=15 and bwd_packets>=15 and sf<=200 and sb<=250 and tot<50000 then 2
  when dur<=0.5 and fwd_packets+bwd_packets<=3 and bwd_packets<=1 then 3 when fwd_bytes>30000 and (fwd_bytes-bwd_bytes)/(tot+1e-5)>0.75 and sf>800 then 4
  when tot<=1200 and fwd_packets between 1 and 3 and bwd_packets between 1 and 3 and tot/(fwd_packets+bwd_packets)<180 then 5 when web then 6 else 7 end k from q)
 select seq, ['InteractiveShell','InteractiveShell','BurstRecon','BulkExfiltration','C2Beaconing','BenignWeb','Unknown'][k] profile,
  case when k in (1,2) then dst_port not in (22,23) when k=4 then dst_port in (53,22,23) when k=5 then not web else false end mismatch, (case when k in (1,2) then case when dst_port in (22,23) then 0.85 else 0.92 end else [0,0,0.9,0.95,0.8,0.7,0.7][k] end)::double confidence from k""")
def f07_fingerprint(s, d):
    return flows(s, d).select("seq", X.fingerprint().alias("x")).select("seq", "x.*")


@query("""with t as (select page_id, url from pages) select page_id, round(length(regexp_replace(url,'[A-Za-z0-9/._-]','','g'))/greatest(length(url),1),6) special, regexp_extract(url,'^[a-z]+://([^/]+)',1) host from t""")
def f09_url_specials(s, d):
    return rounded(table(s, d, "pages").select("page_id", X.special_share(F.col("url")).alias("special"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host")))


@query("""with e as (select vec_id, embedding::double[] v from embeddings) select a.vec_id, round(list_dot_product(a.v,b.v)/sqrt(list_dot_product(a.v,a.v)*list_dot_product(b.v,b.v)),5) cosine,
 round((list_dot_product(a.v,a.v)+list_dot_product(b.v,b.v)-2*list_dot_product(a.v,b.v))/len(a.v),5) mse from e a join e b on b.vec_id=a.vec_id+1""")
def f32_vector_distances(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    aa, bb, ab = X.dot(F.col("embedding"), F.col("embedding")), X.dot(F.col("other"), F.col("other")), X.dot(F.col("embedding"), F.col("other"))
    return rounded(e.join(b, "vec_id").select("vec_id", (ab / F.sqrt(aa * bb)).alias("cosine"), ((aa + bb - 2 * ab) / F.size("embedding")).alias("mse")), 5)


@query(f"""with {FLOWS}, r as (select case when seq%97=0 then null when seq%89=0 then -1 when seq%83=0 then 1e12 else start_time+{LATER} end t, case when seq%79=0 then 0 else protocol end pr, case when seq%79=0 or seq%73=0 then 0 else dst_port end po, case when seq%71=0 then 'NaN ' when seq%67=0 then '' when seq%61=0 then 'None' when seq%59=0 then '0' else src_ip end ip from flows),
 g as (select t is null or t<1262304000 or t>1893456000 bad_time, pr=0 and po=0 offload, lower(trim(ip)) in ('nan','','none','0') blank from r)
 select count(*) n, count_if(bad_time) bad_time, count_if(offload) offload, count_if(blank) blank, count_if(not (bad_time or offload or blank)) kept from g""")
def p04_row_guards(s, d):
    """P01 to P04, with bad rows of every kind put among the flows."""
    each = lambda n: F.col("seq") % n == 0
    rows = flows(s, d).select(
        F.when(each(97), F.lit(None)).when(each(89), -1.0).when(each(83), 1e12).otherwise(F.col("start_time") + LATER).alias("start_time"), F.when(each(79), 0).otherwise(F.col("protocol")).alias("protocol"),
        F.when(each(79) | each(73), 0).otherwise(F.col("dst_port")).alias("dst_port"), F.when(each(71), "NaN ").when(each(67), "").when(each(61), "None").when(each(59), "0").otherwise(F.col("src_ip")).alias("src_ip"),
    )
    bad, offload = X.invalid_time(F.col("start_time")), (F.col("protocol") == 0) & (F.col("dst_port") == 0)
    blank = F.lower(F.trim("src_ip")).isin("nan", "", "none", "0")
    return rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad_time"), F.count_if(offload).alias("offload"), F.count_if(blank).alias("blank"), F.count_if(~(bad | offload | blank)).alias("kept"))


@query(f"""with {FLOWS}, g as (select *, {PRIVATE.format("src_ip")} a, {PRIVATE.format("dst_ip")} b from flows)
 select case when not a and b then 'inbound' when a and not b then 'outbound' else 'internal' end direction, count(*) n, cast(sum(fwd_bytes) as bigint) bytes from g group by 1""")
def p16_direction(s, d):
    return flows(s, d).groupBy(X.direction(F.col("src_ip"), F.col("dst_ip")).alias("direction")).agg(F.count("*").alias("n"), F.sum("fwd_bytes").alias("bytes"))


@query(f"with {FLOWS}, g as ({GRID} from flows) select w \"window\", count(*) n, dense_rank() over (order by w)-1 window_idx from g group by w")
def w01_window_grid(s, d):
    from pyspark.sql import Window

    return _windowed(s, d).groupBy("window").agg(F.count("*").alias("n")).withColumn("window_idx", F.dense_rank().over(Window.orderBy("window")).cast("long") - 1)


@query(f"with {SERIES} select host, cast(floor(t/{HOUR}) as bigint) bucket, count(*) n, count_if(is_attack) attacks from series group by all")
def w02_absolute_buckets(s, d):
    return series(s, d).groupBy("host", F.floor(F.col("t") / HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.count_if("is_attack").alias("attacks"))


@query(f"with {SERIES} select event_id, round(min(case when is_attack then t end) over (partition by host order by t, event_id rows between current row and unbounded following)-t,3) wait from series")
def w03_next_attack(s, d):
    df = T.next_time_sliced(series(s, d), ["host"], "t", "event_id", F.col("is_attack"), 86_400, "next")
    return rounded(df.select("event_id", (F.col("next") - F.col("t")).alias("wait")), 3)


@query(f"""with {SERIES}, p as (select *, t-lag(t) over (partition by host order by t,event_id) gap from series), r as (select *, sum(case when gap is null or gap>{PAUSE} then 1 else 0 end) over (partition by host order by t,event_id rows unbounded preceding) seg from p)
 select host, cast(seg as bigint) segment, count(*) n, min(t) "start", max(t) "end" from r group by host, seg""")
def w04_gap_segments(s, d):
    df = T.sliced_segments(series(s, d), ["host"], "t", "event_id", PAUSE, 86_400)
    return df.groupBy("host", "segment").agg(F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"))


@query(f"""with {SERIES}, a as (select * from series where category<>'Benign'), p as (select *, t-lag(t) over (partition by category order by t,event_id) gap from a), r as (select *, sum(case when gap is null or gap>300 then 1 else 0 end) over (partition by category order by t,event_id rows unbounded preceding) seg from p)
 select category, cast(seg as bigint) run, min(t) "start", max(t) "end", count(*) n from r group by category, seg""")
def w05_attack_intervals(s, d):
    df = T.sliced_segments(series(s, d).where("category <> 'Benign'"), ["category"], "t", "event_id", 300, 86_400, "run")
    return df.groupBy("category", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))


@query(f"""with {SERIES}, n as (select event_id, min(case when is_attack then t end) over (partition by host order by t, event_id rows between current row and unbounded following)-t wait from series) select event_id, round(coalesce(exp(-wait/21600),0),6) hazard from n""")
def w12_hazard(s, d):
    df = T.next_time_sliced(series(s, d), ["host"], "t", "event_id", F.col("is_attack"), 86_400, "next")
    return rounded(df.select("event_id", T.hazard(F.col("next") - F.col("t"), 21600).alias("hazard")))


@query(f"""with {SERIES}, x as (select *, host%3 capture, min(case when is_attack then t end) over (partition by host order by t, event_id rows between current row and unbounded following)-t dt from series), sp as (select host%3 capture, t a, t+1800 b from series where category='InitialAccess' union all select capture, max(t)+900, 'infinity'::double from x group by 1),
 u as (select event_id, any_value(dt) dt, greatest(min(a)-any_value(t),0) du from x left join sp on sp.capture=x.capture and sp.b>=x.t group by event_id)
 select event_id, case when du<=coalesce(dt,'infinity'::double) and exp(-du/21600)>=0.01::double and coalesce(dt,1)<>0 then null else round(coalesce(exp(-dt/21600),0),6) end hazard from u""")
def w12_censored_hazard(s, d):
    """W12 with J13: null where an unknown span, or the end of the capture, comes before the next attack."""
    x = series(s, d).select("event_id", "host", "t", "is_attack", "category", (F.col("host") % 3).alias("capture"))
    unknown = x.where("category = 'InitialAccess'").select("capture", F.col("t").alias("start"), (F.col("t") + 1800).alias("end"))
    return rounded(T.censored_hazard(x, "host", "capture", "t", "event_id", F.col("is_attack"), unknown, 21600, 900).select("event_id", "hazard"))


@query(f"""with {SERIES}, r as (select *, sum(case when score>=0.3 then 0 else 1 end) over (partition by host order by t,event_id rows unbounded preceding) g from series), q as (select host, min(t) t, count(*) n from r where score>=0.3 group by host, g having count(*)>=2) select host, min(t) first_alert from q group by host""")
def w13_first_alert(s, d):
    low = F.col("score") < 0.3
    runs = T.islands(series(s, d), ["host"], ["t", "event_id"], low).where(~low).groupBy("host", "run").agg(F.min("t").alias("t"), F.count("*").alias("n")).where("n >= 2")
    return runs.groupBy("host").agg(F.min("t").alias("first_alert"))


@query(f"""with {SERIES}, l as (select *, lag(is_attack) over (partition by host order by t,event_id) p from series) select host, count(*) onsets, min(t) first_onset from l where is_attack and p=false group by host""")
def w14_episode_onsets(s, d):
    from pyspark.sql import Window

    before = F.lag("is_attack").over(Window.partitionBy("host").orderBy("t", "event_id"))
    return series(s, d).withColumn("p", before).where("is_attack and p = false").groupBy("host").agg(F.count("*").alias("onsets"), F.min("t").alias("first_onset"))


@query(f"""with {SERIES}, l as (select category, lag(category) over (partition by host order by t,event_id) b from series), c as (select b "before", category, count(*) n from l where b is not null group by all) select "before", category, n, round((n+1)/(sum(n) over (partition by "before")+5),6) p from c""")
def w21_markov_transitions(s, d):
    return rounded(A.transitions(series(s, d)))


@query(f"""with {SERIES}, l as (select *, lag(category) over w pc, lag(t) over w pt from series window w as (partition by host order by t,event_id)), r as (select *, sum(case when pc is null or pc<>category or t-pt>{HORIZON} then 1 else 0 end) over (partition by host order by t,event_id rows unbounded preceding) run from l)
 select host, cast(run as bigint) run, min(category) category, min(t) "start", max(t) "end", count(*) n, round(max(score),6) score from r group by host, run""")
def w22_compaction(s, d):
    return A.compact(series(s, d), HORIZON).select("host", "run", "category", "start", "end", "n", F.round("score", 6).alias("score"))


@query(f"""with {FLOWS}, g as ({GRID} from ends), a as (select host, w, count(*) n, sum(case when is_src then fwd_bytes else bwd_bytes end) s, sum(case when is_src then bwd_bytes else fwd_bytes end) r, sum(case when is_src then fwd_packets else bwd_packets end) ps, sum(case when is_src then bwd_packets else fwd_packets end) pr,
 sum(fwd_bytes+bwd_bytes) b, sum(fwd_packets+bwd_packets) p, count(distinct peer) peers, count(distinct dst_port) ports, count_if(protocol=6) tcp, count_if(protocol=17) udp, sum(end_time-start_time) secs from g group by host, w)
 select host, w "window", round(least(1,ln(1+n)/10),6) flows, round(least(1,ln(1+s)/20),6) sent, round(least(1,ln(1+r)/20),6) received, round(least(1,ln(1+b)/20),6) bytes, round(least(1,ln(1+ps)/10),6) psent, round(least(1,ln(1+pr)/10),6) preceived, round(least(1,ln(1+p)/10),6) packets,
 round(least(1,ln(1+peers)/10),6) peers, round(least(1,ln(1+ports)/ln(65536)),6) ports, round(tcp/n,6) tcp, round(udp/n,6) udp, round(least(1,secs/n/300),6) duration, round(least(1,ln(1+b/{FLOW_WINDOW})/15),6) byte_rate, round(least(1,ln(1+p/{FLOW_WINDOW})/10),6) packet_rate, round(least(1,peers/n),6) peer_share from a""")
def a04_host_window_attributes(s, d):
    return rounded(H.window_attributes(_windowed(s, d), FLOW_WINDOW))


@query(f"""with {FLOWS}, g as ({GRID} from ends), a as (select host, w, count(*) n, count_if(is_attack) na, max(case when is_attack then struct_pack(s := {SEV.format("coarse_category")}, c := coarse_category) end) m from g group by host, w)
 select host, w "window", n, na n_attack, coalesce(m.c,'Benign') category, case when na>0 then round(least(1,greatest(0.2,m.s+0.04*least(1,na/n)+0.04*least(1,ln(1+na)/5))),6) else 0.0::double end risk from a""")
def a05_host_window_labels(s, d):
    return rounded(H.window_labels(_windowed(s, d)))


@query(f"with {FLOWS}, c as (select host, dst_port, count(*) c from ends group by all) select host, round(log2(sum(c))-sum(c*log2(c))/sum(c),6) entropy from c group by host")
def a06_port_entropy(s, d):
    return rounded(H.entropy(H.incidence(flows(s, d)), "host", "dst_port"))


@query(f"""with {FLOWS}, e as (select src_ip host, fwd_bytes+0.25*bwd_bytes+fwd_packets+25 s from flows union all select dst_ip, (bwd_bytes+0.25*fwd_bytes+bwd_packets+25)*case when not {PRIVATE.format("src_ip")} and {PRIVATE.format("dst_ip")} then 50 else 1 end from flows) select host, round(sum(s)::double,3) activity from e group by host""")
def a12_endpoint_activity(s, d):
    return rounded(H.activity(flows(s, d)), 3)


@query(f"""with {FLOWS}, l as (select start_time-lag(start_time,1,0) over (partition by src_ip order by start_time,seq) dt from flows) select count(*) n, round(avg(dt),3) mean, round(stddev_pop(dt)/1000,3) std_k from l""")
def a15_time_statistics(s, d):
    from pyspark.sql import Window

    dt = F.col("start_time") - F.lag("start_time", 1, 0.0).over(Window.partitionBy("src_ip").orderBy("start_time", "seq"))
    return rounded(flows(s, d).select(dt.alias("dt")).agg(F.count("*").alias("n"), F.avg("dt").alias("mean"), (F.stddev_pop("dt") / 1000).alias("std_k")), 3)


@query(f"""with {FLOWS}, c as (select coarse_category category, src_ip host, count(*) n from flows group by all) select category, cast(sum(n) as bigint) records, count(*) hosts, max(struct_pack(n := n, h := host)).h top_host, round(max(n)/sum(n),6) top_share from c group by category""")
def a20_concentration(s, d):
    c = flows(s, d).groupBy(F.col("coarse_category").alias("category"), F.col("src_ip").alias("host")).agg(F.count("*").alias("n"))
    return rounded(c.groupBy("category").agg(F.sum("n").alias("records"), F.count("*").alias("hosts"), F.max(F.struct("n", "host"))["host"].alias("top_host"), (F.max("n") / F.sum("n")).alias("top_share")))


@query("""with e as (select unnest(embedding::double[]) x, generate_subscripts(embedding,1)-1 pos from embeddings) select cast(pos as int) pos, round(avg(x),5) mean from e group by pos""")
def a26_pooled_embedding(s, d):
    return rounded(table(s, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean")), 5)


@query(f"""with {FLOWS}, g as ({GRID} from flows), r as (select *, row_number() over (partition by w order by end_time desc, start_time desc, seq) rank from g) select w "window", seq, cast(rank as int) "rank" from r where rank<=5""")
def l02_most_recent_flows(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("window").orderBy(F.desc("end_time"), F.desc("start_time"), "seq")
    return _windowed(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("window", "seq", "rank")


@query(f"""with {FLOWS}, q as (select protocol, quantile_cont(start_time,0.7) a, quantile_cont(start_time,0.85) b from flows group by protocol) select protocol, case when start_time>b then 'test' when start_time>a then 'val' else 'train' end split, count(*) n from flows join q using (protocol) group by all""")
def g05_chronological_split(s, d):
    f = flows(s, d)
    cuts = T.exact_quantiles(f, ["protocol"], "start_time", {"a": 0.7, "b": 0.85})
    split = F.when(F.col("start_time") > F.col("b"), "test").when(F.col("start_time") > F.col("a"), "val").otherwise("train")
    return f.join(F.broadcast(cuts), "protocol").groupBy("protocol", split.alias("split")).agg(F.count("*").alias("n"))


@query(f"with {FLOWS} select dst_ip host from flows where is_attack intersect select dst_ip from flows where not is_attack and dst_port=22")
def u03_shared_hosts(s, d):
    f = flows(s, d)
    return f.where("is_attack").select(F.col("dst_ip").alias("host")).intersect(f.where("not is_attack and dst_port = 22").select("dst_ip"))


@query(f"with {SERIES}, {EDGES} select host, u, v, round(score,6) score from edges")
def j08_alert_range_join(s, d):
    return rounded(A.score_edges(series(s, d), HORIZON))


@query(f"""with {SERIES}, n as (select event_id, lag(event_id,1) over w a, lag(event_id,2) over w b, lag(event_id,3) over w c from series window w as (partition by host order by t,event_id)) select event_id, 1 "rank", a neighbour from n where a is not null union all select event_id, 2, b from n where b is not null union all select event_id, 3, c from n where c is not null""")
def j10_recent_neighbours(s, d):
    return A.recent_neighbours(series(s, d), 3)


_LABELS = f"""with recursive {SERIES}, {EDGES}, b as (select u x, v y from edges union all select v, u from edges), reach as (select x, y from b union select r.x, b.y from reach r join b on r.y=b.x), lab as (select x event_id, min(y) campaign from reach group by x)"""


@query(f"{_LABELS} select event_id node, campaign component from lab")
def g09_alert_components(s, d):
    from ..common.components import connected_components

    return connected_components(A.score_edges(series(s, d), HORIZON), "u", "v")


@query(f"""{_LABELS} select campaign, count(*) n, min(t) "start", max(t) "end", max({SEV.format("category")}) severity, count(distinct host) hosts from lab join series using (event_id) group by campaign""")
def g11_campaigns(s, d):
    a = series(s, d)
    return A.campaigns(a, A.score_edges(a, HORIZON))


@query(f"""with {SERIES} select host, cast(floor(epoch_us(ts)/3600000000) as bigint)*3600000000 start_us, count(*) n, count_if(is_attack) n_attack from series group by all""")
def x01_tumbling_windows(s, d):
    return windowed_totals(series(s, d), "1 hour", "10 minutes")


@query(f"""with {SERIES}, a as (select * from series where category<>'Benign'), p as (select *, t-lag(t) over (partition by host order by t,event_id) gap from a), r as (select *, sum(case when gap is null or gap>{PAUSE} then 1 else 0 end) over (partition by host order by t,event_id rows unbounded preceding) seg from p)
 select host, count(*) n, round(max(score),6) peak, min(t) "first", max(t) "last" from r group by host, seg""")
def x06_incidents(s, d):
    return incidents(series(s, d).where("category <> 'Benign'"), f"{PAUSE} seconds", "10 minutes").select("host", "n", F.round("peak", 6).alias("peak"), "first", "last")


@query(f"""with {SCORES}, c as (select count(*) n, count_if(p>=0.5 and y=1) tp, count_if(p>=0.5 and y=0) fp, count_if(p<0.5 and y=1) fn, count_if(p<0.5 and y=0) tn, avg((p-y)*(p-y)) brier from scores),
 r as (select y, rank() over (order by p)+(count(*) over (partition by p)-1)/2.0 k from scores), auc as (select (sum(case when y=1 then k end)-sum(y)*(sum(y)+1)/2)/(sum(y)*(count(*)-sum(y))) a from r),
 h as (select p, sum(y) pos, count(*) m from scores group by p), g as (select pos, sum(pos) over (order by p desc) t, sum(m) over (order by p desc) a from h), ap as (select sum(pos*t/a)/sum(pos) v from g)
 select n, tp, fp, fn, tn, round(brier,6) brier, round(tp/(tp+fp),6) "precision", round(tp/(tp+fn),6) recall, round(2*tp/(2*tp+fp+fn),6) f1, round(a::double,6) roc_auc, round(v::double,6) average_precision from c, auc, ap""")
def m01_detection_report(s, d):
    return rounded(M.detection_report(scores(s, d)))


@query(f"""with {SCORES}, b as (select least(floor(p*15),14) b, count(*) n, avg(p) p, avg(y) y from scores group by 1) select round(sum(n*abs(p-y))/sum(n),6) ece, round(max(abs(p-y)),6) mce from b""")
def m06_calibration_error(s, d):
    return rounded(M.calibration_error(scores(s, d)))


@query(f"""with {SCORES}, r as (select abs(y-p) r, row_number() over (order by abs(y-p)) k, count(*) over () n from scores) select max(n) n, round(min(case when k>=ceil((n+1)*0.9::double) then r end),6) "quantile" from r""")
def m09_conformal_quantile(s, d):
    return rounded(M.conformal_quantile(scores(s, d), 0.1))


@query(f"""with {SCORES}, h as (select cast(floor(p*100) as bigint) b, sum(y) pos, count(*) n from scores group by 1), c as (select b, sum(pos) over (order by b desc) tp, sum(n) over (order by b desc) fl from h), t as (select sum(y) ap, count(*) a from scores),
 f as (select b, 2*tp/(fl+ap) f1, tp, fl from c, t where fl<a) select b/100 threshold, round(f1::double,6) f1, cast(tp as bigint) tp, cast(fl as bigint) flagged from f order by f1 desc, b limit 1""")
def m14_operating_point(s, d):
    return M.operating_point(scores(s, d)).select("threshold", F.round("f1", 6).alias("f1"), "tp", "flagged")


@query("""with e as (select label y, vec_id%10 g from embeddings), k as (select y c from e union select g from e) select cast(c as bigint) "class", count_if(y=c) support, round(case when count_if(g=c)>0 then count_if(y=c and g=c)/count_if(g=c) end,6) "precision", round(case when count_if(y=c)>0 then count_if(y=c and g=c)/count_if(y=c) end,6) recall,
 round(2*count_if(y=c and g=c)/(count_if(y=c)+count_if(g=c)),6) f1 from k, e group by c""")
def m17_per_class(s, d):
    e = table(s, d, "embeddings").select(F.col("label").cast("long").alias("y"), (F.col("vec_id") % 10).alias("guess"))
    return rounded(M.per_class(e))
