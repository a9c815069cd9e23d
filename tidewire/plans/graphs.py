"""Queries of graphs, splits and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import address
from ..operators import graphs as G
from ..operators import splits as D
from ..operators import temporal as T
from ..sources.tables import flows, sent_flows, series, table
from .base import FLOW_WINDOW, FLOWS, GRID, HORIZON, PRIVATE, SERIES, STAGE, query, rounded

_NOW, _NODE_TTL, _EDGE_TTL = 900_000_000, 30_000_000, 15_000_000
_PAST = f"start_time <= {_NOW}"


@query(f"with {FLOWS} select host node, count(*) degree, count(distinct peer) peers from ends group by host")
def g01_interaction_graph(s, d):
    return G.both_ways(flows(s, d)).groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("peer").alias("peers"))


@query(f"""with {FLOWS}, l as (select src_ip, row_number() over (order by src_ip)-1 u from (select distinct src_ip from flows)), r as (select dst_ip, row_number() over (order by dst_ip)-1+(select count(*) from l) i from (select distinct dst_ip from flows)) select seq, u, i from flows join l using (src_ip) join r using (dst_ip)""")
def g02_bipartite_ids(s, d):
    return G.bipartite(flows(s, d).select("seq", "src_ip", "dst_ip"), "src_ip", "dst_ip").select("seq", "u", "i")


@query(f"""with {FLOWS}, r as (select protocol, dst_ip, row_number() over (partition by protocol order by dst_ip)-1 k, count(*) over (partition by protocol) n from (select distinct protocol, dst_ip from flows)), o as (select f.seq, f.protocol, r.k, (f.seq*2654435761+7)%(r.n-1) q from flows f join r using (protocol, dst_ip) where r.n>1)
 select o.seq, r.dst_ip negative from o join r on r.protocol=o.protocol and r.k=o.q+case when o.q>=o.k then 1 else 0 end""")
def g04_negative_targets(s, d):
    return G.negative_targets(flows(s, d).select("seq", "protocol", "dst_ip"), "protocol", "dst_ip", "seq", 7).select("seq", "negative")


@query(f"""with {FLOWS} select seq, ('0x'||substr(sha256('salt'||src_ip),1,8))::bigint < 429496729 or ('0x'||substr(sha256('salt'||dst_ip),1,8))::bigint < 429496729 inductive from flows""")
def g06_inductive_hold_out(s, d):
    """G06 and J17."""
    return G.held_out_edges(flows(s, d).select("seq", "src_ip", "dst_ip"), "src_ip", "dst_ip", 0.1, "salt").select("seq", "inductive")


_HELD = "('0x'||substr(sha256('salt'||{0}),1,8))::bigint < 429496729"


@query(f"""with {FLOWS}, e as (select seq, src_ip, dst_ip, src_ip||':'||(dst_port%2) k, start_time < {_NOW} train, {_HELD.format('src_ip')} hs, {_HELD.format('dst_ip')} hd from flows), l as (select k from e where k not in ('10.0.0.7:0','10.0.0.7:1') group by k having not bool_or(train and not hs and not hd)),
 s as (select distinct unnest([src_ip,dst_ip]) ip from e where k in (select k from l)) select seq, (hs and src_ip not in (select ip from s)) or (hd and dst_ip not in (select ip from s)) inductive from e""")
def g06_repaired_hold_out(s, d):
    """Classes that the draw would leave without training edges get their hosts back."""
    f = flows(s, d).select("seq", "src_ip", "dst_ip", F.concat_ws(":", "src_ip", (F.col("dst_port") % 2).cast("string")).alias("k"), "start_time")
    return G.repaired_hold_out(f, "src_ip", "dst_ip", "k", 0.1, "salt", F.col("start_time") < _NOW, ("10.0.0.7:0", "10.0.0.7:1")).select("seq", "inductive")


@query(f"""with {FLOWS}, c as (select case when is_attack then concat_ws(':', dst_ip, dst_port, protocol) else 'Benign' end k, src_ip, count(*) n from flows group by all)
 select k, count(*) carriers, sum(n)::bigint edges, arg_max(src_ip, (n, src_ip)) main_carrier from c where k<>'Benign' group by k having count(*)<=2""")
def g06_few_carriers(s, d):
    """Classes that one or two hosts carry."""
    label = F.when(F.col("is_attack"), F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"), F.col("protocol").cast("string"))).otherwise("Benign")
    return G.few_carriers(flows(s, d).withColumn("k", label), "src_ip", "k")


_G07 = f"""{SERIES}, talks as (select distinct user_id a, user_id%7+1 b from events), prs as (select distinct least(a,b) a, greatest(a,b) b from talks where a<>b), pl as (select a, b, 0.8::double place from prs union all select b, a, 0.8::double from prs union all select distinct host, host, 1.0::double from series),
 g7 as (select * from (select x.event_id u, y.event_id v, (case when {STAGE.format("x.category")} is null or {STAGE.format("y.category")} is null then 0.1::double when x.category=y.category then 0.85::double when {STAGE.format("y.category")} > {STAGE.format("x.category")} then round(greatest(0.2::double, 0.95::double-0.15::double*({STAGE.format("y.category")}-{STAGE.format("x.category")})),4) else 0.2::double end)
  * (1-(y.t-x.t)/{HORIZON}) * place * case when x.event_id%10=0 and y.event_id%10=0 then 0.5::double when x.event_id%10=0 or y.event_id%10=0 then 0.75::double else 1.0::double end score
  from series x join pl on pl.a=x.host join series y on y.host=pl.b and y.t-x.t between 0 and {HORIZON} and (y.t>x.t or (y.t=x.t and x.event_id<y.event_id)) where not (x.category='Benign' and y.category='Benign')) where score>=0.35::double)"""


def _scored(s, d):
    a = series(s, d).withColumn("forecast", F.col("event_id") % 10 == 0)
    talks = a.select(F.col("host").alias("a"), (F.col("host") % 7 + 1).alias("b")).distinct()
    return a, G.edge_scores(a, talks, HORIZON, 0.35)


@query(f"with {_G07} select u, v, round(score,6) score from g7")
def g07_edge_scores(s, d):
    """Hosts that talk to each other, with provenance."""
    return rounded(_scored(s, d)[1])


@query(f"""with {_G07}, k as (select distinct unnest([u,v]) event_id from g7 where score>=0.4::double), kept as (select * from series where event_id in (select event_id from k) or is_attack or score>=0.2) select count(*) kept, (select count(*) from series) total, count_if(is_attack) attacks, (select count_if(is_attack) from series) all_attacks from kept""")
def g08_pruning(s, d):
    a, edges = _scored(s, d)
    total = a.agg(F.count("*").alias("total"), F.count_if("is_attack").alias("all_attacks"))
    return G.pruned(a, edges).agg(F.count("*").alias("kept"), F.count_if("is_attack").alias("attacks")).crossJoin(F.broadcast(total))


@query(f"""with {SERIES}, m as (select event_id, host campaign, t from series), e as (select event_id u, event_id+3 v from series where event_id%2=0), free as (select campaign, event_id from m where event_id not in (select v from e)) select * from free union all select campaign, (min(struct_pack(t := t, e := event_id))).e from m where campaign not in (select campaign from free) group by campaign""")
def g11_roots(s, d):
    m = series(s, d).select("event_id", F.col("host").alias("campaign"), "t")
    edges = m.where("event_id % 2 = 0").select(F.col("event_id").alias("u"), (F.col("event_id") + 3).alias("v"))
    return G.roots(m, edges)


@query(f"""with {FLOWS}, f as (select * from flows where {_PAST}), n as (select node, max(end_time) last, count(*) flows from (select src_ip node, end_time from f union all select dst_ip, end_time from f where src_ip<>dst_ip) group by node having {_NOW}-max(end_time)<={_NODE_TTL}),
 e as (select src_ip, dst_ip, max(end_time) last, count(*) flows, cast(sum(fwd_bytes+bwd_bytes) as bigint) bytes from f group by all having {_NOW}-max(end_time)<={_EDGE_TTL}) select src_ip, dst_ip, flows, bytes, last, {_NOW}-last>0.75*{_EDGE_TTL} stale from e where src_ip in (select node from n) and dst_ip in (select node from n)""")
def x04_topology_edges(s, d):
    """X04 and J16 as of a moment."""
    return G.topology(flows(s, d).where(_PAST), _NOW, _NODE_TTL, _EDGE_TTL)[1]


@query(f"""with {FLOWS}, f as (select * from flows where {_PAST}) select node, count(*) flows, max(end_time) last, {_NOW}-max(end_time)>0.75*{_NODE_TTL} stale, {PRIVATE.format("node")} inside from (select src_ip node, end_time from f union all select dst_ip, end_time from f where src_ip<>dst_ip) group by node having {_NOW}-max(end_time)<={_NODE_TTL}""")
def x04_topology_nodes(s, d):
    return G.topology(flows(s, d).where(_PAST), _NOW, _NODE_TTL, _EDGE_TTL)[0]


@query(f"""with {FLOWS}, v as (select host node, count(*)::double x from ends group by host), p as (select distinct host node, peer from ends where host<>peer union select node, node from v), g as (select node, count(*) d from p group by node) select p.node, round(sum(v.x/sqrt(h.d))/sqrt(any_value(g.d)),6) x from p join v on v.node=p.peer join g h on h.node=p.peer join g on g.node=p.node group by p.node""")
def g14_normalised_step(s, d):
    """Values spread once over the normalised graph."""
    f = flows(s, d)
    values = G.both_ways(f).groupBy("node").agg(F.count("*").cast("double").alias("x"))
    return rounded(G.spread_once(f.select("src_ip", "dst_ip"), values, "x"))


@query(f"with {FLOWS} select distinct dst_ip from flows where dst_port=22 and dst_ip not in (select dst_ip from flows where dst_port<>22 and protocol=6)")
def u04_new_targets(s, d):
    f = flows(s, d).where("dst_port = 22 or protocol = 6")
    return G.new_targets(f, F.col("dst_port") != 22)


@query("""with o as (select o_custkey g, o_orderdate t from orders), c as (select g, min(t) t, count(*) n from o group by g), r as (select *, row_number() over (order by t, g) i, sum(n) over (order by t, g) cum, sum(n) over () total, count(*) over () k from c),
 q as (select min(case when cum>=0.6::double*total then i end) a, min(case when cum>=0.75::double*total then i end) b, min(case when cum>=0.85::double*total then i end) c from r) select case when i<=a then 'train' when i<=b then 'validation' when i<=q.c then 'calibration' else 'test' end split, count(*) groups, cast(sum(n) as bigint) rows from r, q group by 1""")
def d02_chronological_groups(s, d):
    """Whole groups, in order of their first time, to shares of the rows."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderdate").alias("t"))
    return D.chronological_groups(o, "g", "t").groupBy("split").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


@query("""with c as (select o_custkey g, count(*) n, count_if(o_orderpriority='1-URGENT') a from orders group by 1), r as (select g, n, a/n f, (row_number() over (order by a/n, g)-1)%6 k from c) select case when k<4 then 'train' when k=4 then 'validation' else 'test' end split, count(*) groups, round(avg(f),6) share from r group by 1""")
def a22_stratified_rotation(s, d):
    c = table(s, d, "orders").groupBy(F.col("o_custkey").alias("g")).agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count("*")).alias("f"))
    return rounded(D.rotated(c, "f", "g").groupBy("split").agg(F.count("*").alias("groups"), F.avg("f").alias("share")))


@query("""with s as (select o_custkey g, case when o_orderkey%3=0 then 'test' else 'train' end split from orders) select count(*) shared from (select g from s where split='train' intersect select g from s where split='test')""")
def d05_leakage(s, d):
    """Groups that stand in more than one split."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("g"), F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"))
    return D.shared_groups(o, "g").agg(F.count("*").alias("shared"))


@query(f"""with {FLOWS}, h as (select distinct src_ip host from flows), r as (select host, regexp_extract(host,'^(.*)\\.[0-9]+$',1) net, row_number() over (partition by regexp_extract(host,'^(.*)\\.[0-9]+$',1) order by host) k, count(*) over (partition by regexp_extract(host,'^(.*)\\.[0-9]+$',1)) n from h) select a.host, b.host as "as" from r a join r b on a.net=b.net and b.k=(a.k-1+3)%a.n+1""")
def d06_permuted_addresses(s, d):
    """Addresses moved round inside their network."""
    return D.permuted(flows(s, d).select(F.col("src_ip").alias("host")).distinct(), "host", 3)


def _feistel_sql(n: str, bits: int, keep: str = "") -> str:
    """SQL of the permutation's rounds: each ties a half to the other, its key a fixed number."""
    half, mask = bits // 2, (1 << bits // 2) - 1
    out = f"select host{keep}, ({n}) >> {half} l, ({n}) & {mask} r from h"
    for key in address.round_keys(7):
        out = f"select host{keep}, r l, xor(l, ((r * 2654435761 + {key}) >> 11) & {mask}) r from ({out})"
    return f"select host{keep}, (l << {half}) + r p from ({out})"


@query(f"""with {FLOWS}, x as (select distinct unnest([src_ip,dst_ip]) host from flows), h as (select host, split_part(host,'.',1)::bigint*16777216+split_part(host,'.',2)::bigint*65536+split_part(host,'.',3)::bigint*256+split_part(host,'.',4)::bigint n from x),
 w as ({_feistel_sql("n", 32)}), b as ({_feistel_sql("n & 255", 8, ", n")}) select host, concat_ws('.', w.p>>24, (w.p>>16)&255, (w.p>>8)&255, w.p&255) "as", concat_ws('.', n>>24, (n>>16)&255, (n>>8)&255, b.p) near from w join b using (host)""")
def d06_address_bijection(s, d):
    """Every address under another, of all addresses and of its /24, by a seeded bijection."""
    hosts = flows(s, d).select(F.explode(F.array("src_ip", "dst_ip")).alias("host")).distinct()
    return hosts.select("host", address.permuted_address(F.col("host"), 7).alias("as"), address.permuted_address(F.col("host"), 7, keep_network=True).alias("near"))


@query(f"""with {FLOWS}, e as (select *, ('0x'||substr(sha256('d'||src_ip),1,8))::bigint < {int(0.3 * 2**32)} a, ('0x'||substr(sha256('d'||dst_ip),1,8))::bigint < {int(0.3 * 2**32)} b from flows)
 select case when a and b then 'test' when not a and not b then 'train' end split, count(*) n, count(distinct src_ip) sources, count_if(is_attack) attacks from e group by 1""")
def d06_host_disjoint_split(s, d):
    """No host in both splits."""
    x = D.host_disjoint(flows(s, d), ["src_ip", "dst_ip"], 0.3, "d")
    return x.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("src_ip").alias("sources"), F.count_if("is_attack").alias("attacks"))


@query(f"""with {FLOWS}, c as (select coarse_category c, count(*) n from flows group by 1) select c category, (select cast(floor(median(n)) as bigint) from c) "rows" from c""")
def a16_median_resample(s, d):
    """Classes cut or repeated to the median size."""
    f = sent_flows(s, d).select("seq", F.col("coarse_category").alias("category"))
    return D.to_median(f, "category", F.pmod(F.col("seq") * 2654435761, F.lit(1000003)), "seq").groupBy("category").agg(F.count("*").alias("rows"))


@query(f"with {FLOWS}, g as ({GRID} from flows) select seq, w \"window\" from g where seq%10=0")
def p11_strided_windows(s, d):
    """P11 by key: every tenth row, on the grid of all of them."""
    return T.on_grid(flows(s, d), "start_time", FLOW_WINDOW).where("seq % 10 = 0").select("seq", "window")


@query(f"""with {FLOWS}, r as (select *, row_number() over (partition by src_ip order by start_time desc, seq desc) k from flows) select src_ip, count(*) kept, min(start_time) oldest from r where k<=16 group by 1""")
def l07_last_rows(s, d):
    """The sixteen latest rows of each host."""
    k = F.row_number().over(Window.partitionBy("src_ip").orderBy(F.desc("start_time"), F.desc("seq")))
    return flows(s, d).select("src_ip", "start_time", k.alias("k")).where("k <= 16").groupBy("src_ip").agg(F.count("*").alias("kept"), F.min("start_time").alias("oldest"))
