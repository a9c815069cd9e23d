"""Queries of the labelling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common.store import written
from ..functions import flow as X
from ..operators import hosts as H
from ..operators import labelling as L
from ..operators import packets as P
from ..operators import temporal as T
from ..sources.tables import flows, packets, series, table
from .base import FLOW_WINDOW, FLOWS, GRID, LATER, SERIES, query, rounded
from .captures import PACKETS, WEEK

_SCOPES = """pr as (select distinct coarse_category l, least(src_ip,dst_ip) a, greatest(src_ip,dst_ip) b from flows where coarse_category in ('Recon','InitialAccess') and seq%3=0), mb as (select distinct coarse_category l, dst_ip ip from flows where coarse_category in ('C2','InitialAccess') and seq%5=0),
 h as (select seq, is_attack, coarse_category, case when coarse_category in (select l from pr) then exists (select 1 from pr where l=coarse_category and a=least(src_ip,dst_ip) and b=greatest(src_ip,dst_ip)) when coarse_category in (select l from mb) then exists (select 1 from mb where l=coarse_category and (ip=src_ip or ip=dst_ip)) end hit from flows)"""


def _hits(s, d):
    f = written(flows(s, d).select("seq", "src_ip", "dst_ip", "is_attack", "coarse_category"), "scoped-flows")
    own = f.select(F.col("coarse_category").alias("label"), F.col("src_ip").alias("a"), F.col("dst_ip").alias("b"), "seq")
    pairs = own.where("label in ('Recon', 'InitialAccess') and seq % 3 = 0").select("label", "a", "b")
    members = own.where("label in ('C2', 'InitialAccess') and seq % 5 = 0").select("label", F.col("b").alias("ip"))
    return L.flow_hits(f, "coarse_category", pairs, members)


@query(f"with {FLOWS}, {_SCOPES} select coarse_category label, hit, count(*) n from h group by all")
def j04_flow_hits(s, d):
    return _hits(s, d).groupBy(F.col("coarse_category").alias("label"), "hit").agg(F.count("*").alias("n"))


@query(f"with {FLOWS}, {_SCOPES} select seq, case when not is_attack then 'Benign' when hit is null then 'UNKNOWN' when hit then coarse_category else 'Benign' end category from h")
def j04_scoped_categories(s, d):
    return _hits(s, d).select("seq", L.scoped_category(F.col("is_attack"), F.col("hit"), F.col("coarse_category")).alias("category"))


_NAMES = """k as (select distinct 'DoS attacks-'||upper(p_name) label from part), t as (select distinct case when p_size%3=0 then 'dos attacks '||p_name when p_size%3=1 then split_part(p_name,' ',2) else '--' end nm, '10.9.0.'||p_size ip from part),
 w as (select label, regexp_replace(lower(label),'[^a-z0-9]+','','g') want from k), v as (select distinct nm, regexp_replace(lower(nm),'[^a-z0-9]+','','g') have from t where regexp_replace(lower(nm),'[^a-z0-9]+','','g')<>''), m as (select label, nm, want=have eq from w join v on contains(want,have) or contains(have,want)),
 n as (select label, nm from m where eq or label not in (select label from m where eq))"""


def _names(s, d):
    part = table(s, d, "part")
    labels = part.select(F.concat(F.lit("DoS attacks-"), F.upper("p_name")).alias("label")).distinct()
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("dos attacks "), F.col("p_name"))).when(F.col("p_size") % 3 == 1, F.get(F.split("p_name", " "), 1)).otherwise("--")
    return labels, part.select(name.alias("name"), F.concat(F.lit("10.9.0."), F.col("p_size")).alias("ip")).distinct()


@query(f"with {_NAMES} select label, nm \"name\" from n")
def f23_lenient_names(s, d):
    labels, names = _names(s, d)
    return L.lenient_matches(labels, names, "label", "name")


@query(f"with {_NAMES} select label, coalesce(string_agg(distinct ip, ',' order by ip),'') participants from k left join n using (label) left join t on t.nm=n.nm where not starts_with(label,'DoS attacks-SMALL') group by label union all select label, '10.0.0.1' from k where starts_with(label,'DoS attacks-SMALL')")
def j05_interval_participants(s, d):
    """Intervals that know their participants keep them; the others take those of the names that mean their label."""
    labels, names = _names(s, d)
    known = F.when(F.startswith("label", F.lit("DoS attacks-SMALL")), F.array(F.lit("10.0.0.1")))
    filled = L.with_participants(labels.withColumn("participants", known), names)
    return filled.select("label", F.coalesce(F.array_join("participants", ","), F.lit("")).alias("participants"))


@query(f"""with {SERIES}, x as (select event_id, case when event_id%50=0 then 'junk' when event_id%51=0 then '31/02/2024 09:00:00' when event_id%52=0 then '01/13/2024 09:00:00' else strftime(ts,'%d/%m/%Y %H:%M:%S') end v, ts from series)
 select event_id, case when event_id%50=0 or event_id%51=0 or event_id%52=0 then null else epoch(date_trunc('second',ts))+case when hour(ts)<8 then 43200 else 0 end+14400 end t from x""")
def f22_local_times(s, d):
    n = F.col("event_id")
    stamp = F.when(n % 50 == 0, "junk").when(n % 51 == 0, "31/02/2024 09:00:00").when(n % 52 == 0, "01/13/2024 09:00:00").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    return series(s, d).select("event_id", L.local_time(stamp, 14_400).alias("t"))


@query(f"""with {FLOWS} select 'target' "role", dst_ip host, count(*) n from flows where is_attack group by 2 union all select 'source', src_ip, count(*) from flows where is_attack group by 2 union all select 'either', host, count(*) from ends where is_attack group by 2""")
def p17_attack_roles(s, d):
    out = None
    for role in ("target", "source", "either"):
        one = L.attacked_hosts(flows(s, d), role).select(F.lit(role).alias("role"), "host", "n")
        out = one if out is None else out.union(one)
    return out


@query(f"with {FLOWS} select seq, false is_attack, 'UNKNOWN' coarse_category, 'UNLABELED' raw_label from flows")
def p19_unlabelled(s, d):
    return L.unlabelled(flows(s, d)).select("seq", "is_attack", "coarse_category", "raw_label")


@query(f"""with {FLOWS}, x as (select protocol, day(to_timestamp(start_time+{LATER})) dd, sum(greatest(bwd_packets,1)) n from flows where is_attack group by all), b as (select protocol, max(struct_pack(n := n, l := -dd)) m from x group by protocol) select protocol, cast(-(m.l) as int) "day" from b""")
def p20_label_days(s, d):
    x = flows(s, d).where("is_attack").withColumn("t", F.col("start_time") + LATER)
    return L.label_days(x, "protocol", "t", "bwd_packets").select("protocol", F.col("day").cast("int").alias("day"))


@query(f"""with {FLOWS}, g as ({GRID} from ends), a as (select host, w, count(*) n, count_if(is_attack) na from g group by all), b as (select *, na>0 atk, case when na>0 then 'Recon' else 'Benign' end c, case when na>0 then 'T1595' else '' end t, na/n r, (n%3=0) bf, n%7 fl, (n%5)/5.0::double sc, (na%2=1) sh, n%4 mm from a),
 q as (select *, bf or fl>=5 g, sh or mm>=2 o from b), e as (select host, w, atk or g or o is_attack, case when g then 'CredentialAccess' else c end c1, case when g then 'T1110'||case when t='' then '' else ','||t end else t end t1, case when g then greatest(r,least(1,0.75+0.25*sc)) else r end r1, o, sc from q)
 select host, w "window", is_attack, case when o and c1='Benign' then 'Execution' else c1 end category, case when o then 'T1059'||case when t1='' then '' else ','||t1 end else t1 end techniques, round(case when o then greatest(r1,least(1,0.65+0.35*sc)) else r1 end,6) risk from e""")
def a09_augmented_labels(s, d):
    x = H.incidence(T.on_grid(flows(s, d), "start_time", FLOW_WINDOW)).groupBy("host", "window").agg(F.count("*").alias("n"), F.count_if("is_attack").alias("na"))
    n, na = F.col("n"), F.col("na")
    labels = x.select(
        "host", "window", (na > 0).alias("is_attack"), F.when(na > 0, "Recon").otherwise("Benign").alias("category"), F.when(na > 0, F.array(F.lit("T1595"))).otherwise(F.array().cast("array<string>")).alias("techniques"), (na / n).alias("risk"),
        (n % 3 == 0).cast("int").alias("brute_force"), (n % 7).alias("failed"), (n % 5 / 5.0).alias("brute_score"), (na % 2).alias("shell"), (n % 4).alias("mismatches"), (n % 5 / 5.0).alias("threat"),
    )
    return rounded(L.augmented(labels).select("host", "window", "is_attack", "category", F.array_join("techniques", ",").alias("techniques"), "risk"))


@query(f"""with {PACKETS}, g as (select src_ip host, w, avg(ttl) tm, count(distinct ttl) tu, coalesce(avg(tcp_window),0) wm, avg(payload_length) ym, avg((payload_length=0)::int) yz, count(distinct dst_ip) ti, count_if(protocol=17 and dst_port=53) dns from packets group by all)
 select host, w "window", round(least(1,tm/255),6) ttl_mean, round(least(1,ln(1+tu)/ln(65)),6) ttls, round(least(1,wm/65535),6) tcp_window_mean, round(least(1,ym/1500),6) payload_mean, round(least(1,yz),6) payload_zero_ratio, round(least(1,ln(1+ti)/10),6) targets, round(least(1,ln(1+dns)/10),6) dns_queries from g""")
def f03_normal_packet_features(s, d):
    x = P.packet_statistics(packets(s, d), WEEK)
    names = ("ttl_mean", "ttls", "tcp_window_mean", "payload_mean", "payload_zero_ratio", "targets", "dns_queries")
    return rounded(x.select("host", "window", *[L.normal_packet_feature(n, F.col(n)).alias(n) for n in names]))


@query(f"with {FLOWS} select seq, round(ln(1+fwd_bytes)/20,6) f0, 0.0::double f1, 0.0::double f11 from flows")
def p13_masked_features(s, d):
    names = [f"f{k}" for k in range(12)]
    kept = L.masked(F.array(*[c.cast("double") for c in X.edge_features()]), names, ("f1", "f11"))
    return rounded(flows(s, d).select("seq", kept.alias("x")).select("seq", *[(F.get("x", k) + 0.0).alias(f"f{k}") for k in (0, 1, 11)]))
