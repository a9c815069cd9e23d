"""Queries of captures, packets and their flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common.store import new_path
from ..operators import labelling as L
from ..operators import packets as P
from ..sources import capture, capture_ranges
from ..sources.tables import frames, packets, spoken
from .base import PRIVATE, query, rounded

#: Windows of packets: a week.
WEEK = 604_800

PACKETS = """packets as (select cast(l_orderkey*8+l_linenumber as bigint) seq, epoch_us(l_shipdate)/1000000+l_partkey%86400+l_linenumber*0.25::double "timestamp", cast(floor((epoch_us(l_shipdate)/1000000+l_partkey%86400+l_linenumber*0.25::double)/604800) as bigint) w,
  case when l_linenumber%2=1 then a else b end src_ip, case when l_linenumber%2=1 then b else a end dst_ip, case when tcp then 6 else 17 end protocol, cast(case when tcp then 54 else 42 end + pay as int) packet_length,
  cast(case when l_linenumber%2=1 then pa else pb end as int) src_port, cast(case when l_linenumber%2=1 then pb else pa end as int) dst_port, case when l_suppkey%2=0 then 64 else 128 end ttl, cast(case when tcp then list_extract([16,2,18,16,24,4,17], l_linenumber%7+1) end as int) tcp_flags,
  case when tcp then l_partkey*100 end tcp_seq, cast(case when tcp then cast(l_quantity as int)*100 end as int) tcp_window, cast(pay as int) payload_length
  from (select *, '10.0.0.'||(l_suppkey%20+1) a, case when l_orderkey%5=0 then '203.0.113.' else '10.1.0.' end||(l_orderkey%20+1) b, 40000+l_suppkey%50 pa, list_extract([22,53,80,443,445,3389,6667,8080], l_partkey%8+1) pb, l_partkey%3<2 tcp,
   case when l_linenumber in (3,4) then cast(l_quantity as int)*10 else 0 end pay from lineitem))"""
_PFLOWS = f"""{PACKETS}, keyed as (select *, least(src_ip||' '||src_port, dst_ip||' '||dst_port) lo, greatest(src_ip||' '||src_port, dst_ip||' '||dst_port) hi, "timestamp"-lag("timestamp") over (partition by w, protocol, least(src_ip||' '||src_port, dst_ip||' '||dst_port), greatest(src_ip||' '||src_port, dst_ip||' '||dst_port) order by "timestamp", seq) pause from packets),
 firsts as (select *, first_value(src_ip||' '||src_port) over (partition by w, protocol, lo, hi order by "timestamp", seq)=src_ip||' '||src_port fwd from keyed),
 pf as (select w, split_part(max(case when fwd then src_ip||' '||src_port else dst_ip||' '||dst_port end),' ',1) src_ip, split_part(max(case when fwd then dst_ip||' '||dst_port else src_ip||' '||src_port end),' ',1) dst_ip, cast(split_part(max(case when fwd then src_ip||' '||src_port else dst_ip||' '||dst_port end),' ',2) as int) src_port,
  cast(split_part(max(case when fwd then dst_ip||' '||dst_port else src_ip||' '||src_port end),' ',2) as int) dst_port, protocol, min("timestamp") s, max("timestamp") e, count(*) n, count_if(fwd) fp, count_if(not fwd) bp, cast(sum(case when fwd then packet_length else 0 end) as bigint) fb, cast(sum(case when fwd then 0 else packet_length end) as bigint) bb,
  count_if(fwd and payload_length>0) fd, count_if(coalesce(tcp_flags,0) & 1 > 0) fin, count_if(coalesce(tcp_flags,0) & 2 > 0) syn, count_if(coalesce(tcp_flags,0) & 4 > 0) rst, count_if(coalesce(tcp_flags,0) & 8 > 0) psh, count_if(coalesce(tcp_flags,0) & 16 > 0) ack, count_if(coalesce(tcp_flags,0) & 32 > 0) urg from firsts group by w, protocol, lo, hi)"""


@query(f'with {PACKETS} select src_ip, dst_ip, protocol, packet_length, src_port, dst_port, ttl, tcp_flags, tcp_seq, tcp_window, payload_length, round("timestamp",3) "timestamp" from packets')
def s01_capture_round_trip(s, d):
    """Packets written as captures (K02) and read back."""
    capture.register(s)
    path = new_path(s, "captures")
    frames(packets(s, d)).write.format("capture").mode("append").save(path)
    return rounded(s.read.format("capture").load(path).select("src_ip", "dst_ip", "protocol", "packet_length", "src_port", "dst_port", "ttl", "tcp_flags", "tcp_seq", "tcp_window", "payload_length", "timestamp"), 3)


_FIELDS = ["src_ip", "dst_ip", "protocol", "packet_length", "src_port", "dst_port", "ttl", "tcp_flags", "tcp_seq", "tcp_window", "payload_length", "timestamp"]


@query(f'with {PACKETS} select src_ip, dst_ip, protocol, packet_length, src_port, dst_port, ttl, tcp_flags, tcp_seq, tcp_window, payload_length, round("timestamp",3) "timestamp" from packets')
def s01_capture_ranges(s, d):
    """Captures read in byte ranges that are smaller than a file."""
    capture.register(s)
    path = new_path(s, "captures")
    frames(packets(s, d)).write.format("capture").mode("append").save(path)
    return rounded(capture_ranges.packets(s, path, _FIELDS, range_bytes=1 << 19), 3)


@query(f"""with {PACKETS} select src_ip capture_host, count(*) packets, sum(packet_length)::bigint bytes, count(distinct dst_ip) peers, round(min("timestamp"),3) "first", round(max("timestamp"),3) "last" from packets group by src_ip""")
def s04_host_captures(s, d):
    """Captures of a host, one a year, named after it; packets by the host of their capture's name."""
    capture.register(s)
    path = new_path(s, "host-captures")
    named = packets(s, d).withColumn("capture", F.concat(F.lit("UCAP"), "src_ip"))
    # A host goes on in another capture each year, so that its packets are no one task's.
    year = F.floor(F.col("timestamp") / (365 * 86_400))
    frames(named, "capture").repartition("capture", year).sortWithinPartitions("capture").write.format("capture").mode("append").save(path)
    read = capture_ranges.packets(s, path, ["capture_host", "timestamp", "packet_length", "dst_ip"], range_bytes=1 << 20)
    return rounded(read.groupBy("capture_host").agg(F.count("*").alias("packets"), F.sum("packet_length").alias("bytes"), F.count_distinct("dst_ip").alias("peers"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")), 3)


@query(f'with {_PFLOWS} select w "window", src_ip, dst_ip, src_port, dst_port, protocol, s "start", e "end", n, fp fwd_packets, bp bwd_packets, fb fwd_bytes, bb bwd_bytes, fd fwd_data_packets, fin, syn, rst, psh, ack, urg from pf')
def a01_packet_flows(s, d):
    f = P.packet_flows(P.windowed(packets(s, d), WEEK), ["window"])
    return f.select("window", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start", "end", "n", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_data_packets", "fin", "syn", "rst", "psh", "ack", "urg")


@query(f"""with {_PFLOWS}, x as (select *, fb+bb t, fp+bp p, greatest(e-s,0.001::double) sp, greatest({WEEK}-(e-s),0) idle, {PRIVATE.format("src_ip")} and {PRIVATE.format("dst_ip")} inside from pf),
 lens as (select w, avg(packet_length) m, stddev_pop(packet_length) sd, max(packet_length) mx, count(*) n from packets group by w), skews as (select l.w, avg(power((packet_length-m)/sd,3)) sk from packets join lens l using (w) where sd>1e-5::double and l.n>2 group by l.w),
 pauses as (select w, pause from keyed where pause is not null union all select w, 0 from pf), ps as (select w, avg(pause) m, stddev_pop(pause) sd, max(pause) mx from pauses group by w),
 steps as (select w, dst_port-lag(dst_port) over (partition by w order by dst_port) st from pf where dst_port>0), st as (select w, coalesce(stddev_pop(st),0) sd, coalesce(max((st=1)::int),0) mx, coalesce(avg((st=1)::int),0) m from steps where st is not null group by w),
 pc as (select w, dst_port, count(*) c from pf where dst_port>0 group by all), pe as (select w, count(*) ports, log2(sum(c))-sum(c*log2(c))/sum(c) h from pc group by w), ic as (select w, dst_ip, count(*) c from x where inside group by all), ie as (select w, log2(sum(c))-sum(c*log2(c))/sum(c) h from ic group by w),
 ne as (select w, count(*) c from (select min(w) w from x where inside group by src_ip, dst_ip) group by w), nf as (select w, count(*) c from (select min(w) w from pf group by src_ip, dst_ip, src_port, dst_port, protocol) group by w),
 g as (select w, count(*) flows, sum(fp) fp, sum(bp) bp, sum(fb) fb, sum(bb) bb, avg(t/sp) br, max(p/sp) pm, avg(p/sp) pr, avg(fd) fd, avg(idle) im, stddev_pop(idle) isd, sum(fin) fin, sum(syn) syn, sum(rst) rst, sum(psh) psh, sum(ack) ack, sum(urg) urg, count_if(dst_port>0) ported, count_if(dst_port between 1 and 1023) known, count_if(inside) ins,
  count_if(inside and dst_port in (22,88,139,389,445,464,3389,5985,5986)) adm, count_if(bp=0) sil, count_if(t/n<100) small, count_if(protocol=6) tcp, count_if(protocol=17) udp from x group by w)
 select g.w "window", coalesce(nf.c,0)::double new_flows, flows::double flows, fp::double fwd_packets, bp::double bwd_packets, fb::double fwd_bytes, bb::double bwd_bytes, round((fb/(bb+1e-5::double))::double,3) byte_ratio, round(br,3) byte_rate_mean, round(pm,3) packet_rate_max, round(pr,3) packet_rate_mean, round((fp/(bp+1e-5::double))::double,3) packet_ratio,
  round(lens.m,3) length_mean, round(lens.sd,3) length_std, lens.mx::double length_max, round(coalesce(sk,0),3) length_skew, round(fd,3) fwd_data_packets_mean, round(ps.m,3) pause_mean, round(ps.sd,3) pause_std, round(ps.mx,3) pause_max, round(im,3) idle_mean, round(isd,3) idle_std, syn::double syn, ack::double ack, rst::double rst, psh::double psh, fin::double fin, urg::double urg,
  round((syn/(ack+1e-5::double))::double,3) syn_ack_ratio, round((rst/(syn+1e-5::double))::double,3) rst_syn_ratio, coalesce(ports,0)::double ports, round(coalesce(pe.h,0),3) port_entropy, round(coalesce(known/nullif(ported,0),0),3) known_port_ratio, coalesce(st.mx,0)::double sequential_max, round(coalesce(st.m,0),3) sequential_mean, round(coalesce(st.sd,0),3) port_step_std,
  coalesce(ne.c,0)::double new_edges, round(coalesce(ie.h,0),3) fanout_entropy, round(coalesce(adm/nullif(ins,0),0),3) admin_ratio, round(sil/flows,3) silent_ratio, round(small/flows,3) small_ratio, round(tcp/flows,3) tcp_ratio, round(udp/flows,3) udp_ratio
 from g join lens using (w) left join skews using (w) join ps using (w) left join st using (w) left join pe using (w) left join ie using (w) left join ne using (w) left join nf using (w)""")
def a02_flow_features(s, d):
    return rounded(P.flow_features(packets(s, d), WEEK), 3)


@query(f"""with {PACKETS}, l as (select *, "timestamp"-lag("timestamp") over (partition by src_ip, w order by "timestamp") pause from packets), g as (select src_ip host, w, count(*) n, avg(ttl) tm, stddev_pop(ttl) ts, count(distinct ttl) tu, coalesce(avg(tcp_window),0) wm, coalesce(stddev_pop(tcp_window),0) ws, coalesce(avg(pause),0) pm, coalesce(stddev_pop(pause),0) psd,
  avg(payload_length) ym, stddev_pop(payload_length) ys, avg((payload_length=0)::int) yz, count_if(protocol=17 and dst_port=53) dns, count(distinct dst_ip) targets, count(distinct case when {PRIVATE.format("dst_ip")} then dst_ip end) ti, count(distinct case when not {PRIVATE.format("dst_ip")} then dst_ip end) te from l group by all),
 v as (select host, w, max(k) vertical from (select src_ip host, w, dst_ip, count(distinct dst_port) k from packets group by all) group by all), h as (select host, w, max(k) horizontal from (select src_ip host, w, dst_port, count(distinct dst_ip) k from packets group by all) group by all),
 e as (select host, w, log2(sum(c))-sum(c*log2(c))/sum(c) x from (select src_ip host, w, dst_ip, count(*) c from packets where {PRIVATE.format("dst_ip")} group by all) group by all)
 select host, w "window", n, round(tm,4) ttl_mean, round(ts,4) ttl_std, tu ttls, round(wm,4) tcp_window_mean, round(ws,4) tcp_window_std, round(pm,4) pause_mean, round(psd,4) pause_std, round(ym,4) payload_mean, round(ys,4) payload_std, round(yz,4) payload_zero_ratio, dns dns_queries, targets, vertical, ti targets_inside, te targets_outside, round(coalesce(x,0),4) fanout_entropy, horizontal, round(psd/(pm+1e-7::double),4) pause_cv
 from g join v using (host,w) join h using (host,w) left join e using (host,w)""")
def a03_packet_statistics(s, d):
    return rounded(P.packet_statistics(packets(s, d), WEEK), 4)


@query(f"""with {PACKETS}, t as (select w, seq, "timestamp" ts, concat(src_ip,':',src_port) a, concat(dst_ip,':',dst_port) b, tcp_flags & 2 > 0 s, tcp_flags & 16 > 0 k, tcp_flags & 4 > 0 r, tcp_seq q, payload_length n from packets where protocol=6),
 o as (select *, row_number() over (partition by w, least(a,b), greatest(a,b) order by ts, seq) i from t),
 e as (select x.*, (select max(y.i) from o y where y.w=x.w and y.a=x.a and y.b=x.b and y.s and not y.k and y.i<=x.i) own, (select max(y.i) from o y where y.w=x.w and y.a=x.b and y.b=x.a and y.s and not y.k and y.i<=x.i) other,
   (select max(y.i) from o y where y.w=x.w and y.a=x.b and y.b=x.a and y.s and y.k and y.i<=x.i) answer, (select max(y.i) from o y where y.w=x.w and y.a=x.a and y.b=x.b and y.s and y.k and y.i<=x.i) answer_other from o x),
 f as (select *, n>0 and ((s and not k) or coalesce(q < (select max(z.q+z.n) from e z where z.w=e.w and z.a=e.a and z.b=e.b and z.i<e.i and z.own is not distinct from e.own), false)) again from e)
 select w "window", concat(least(a,b),'|',greatest(a,b)) pair, count(*) tcp, count_if(again) retransmitted, count_if(s and not k) syn, count_if(s and k) syn_ack, count_if(r and not s and not k and other is not null and not coalesce(answer_other>other,false)) rst_after_syn,
  count_if(s and not k) attempts, count(distinct case when k and not s and answer>own then concat(a,'/',own) end) completed from f group by all""")
def a03_sessions(s, d):
    return P.sessions(packets(s, d), WEEK)


# Targets and names as the payloads of the test packets have them.
_SPOKEN = f"""{PACKETS}, spoken as (select src_ip host, w, seq // 8 k, protocol=6 and least(src_port,dst_port) in (80,8080) and payload_length>0 and (seq//8)%3<2 web, protocol=17 and least(src_port,dst_port)=53 and payload_length>0 asks, '/p/'||((seq//8)%97)||'?a=%41&b='||(seq%8) uri,
   'h'||((seq//8)%31)||'.example.'||case when (seq//8)%2=0 then 'org' else 'com' end dns from packets),
 chars as (select x, unnest(string_split(x,'')) ch from (select distinct uri x from spoken where web union select distinct dns from spoken where asks)), ent as (select x, log2(sum(c))-sum(c*log2(c))/sum(c) h from (select x, ch, count(*) c from chars where ch<>'' group by all) group by x)"""


@query(f"""with {_SPOKEN} select host, w "window", count_if(web) http_requests, round(coalesce(avg(case when web then u.h end),0),6) http_uri_entropy_mean, round(coalesce(avg(case when web then 1-length(translate(uri,'/?=%&',''))/length(uri) end),0),6) http_special_ratio,
 count_if(asks) dns_queries, count(distinct case when asks then dns end) dns_domains, round(coalesce(avg(case when asks then n.h end),0),6) dns_entropy_mean from spoken left join ent u on u.x=uri left join ent n on n.x=dns group by host, w""")
def a03_payload_features(s, d):
    """Requests and names out of the payload bytes of captures."""
    capture.register(s)
    path = new_path(s, "captures")
    frames(spoken(packets(s, d))).write.format("capture").mode("append").save(path)
    read = capture_ranges.packets(s, path, ["timestamp", "src_ip", "protocol", "src_port", "dst_port", "payload_length", "payload"])
    return rounded(P.payload_features(read, WEEK))


_SESSION = """t as (select w, seq, "timestamp" ts, concat(src_ip,':',src_port) a, concat(dst_ip,':',dst_port) b, tcp_flags & 2 > 0 s, tcp_flags & 16 > 0 k, tcp_flags & 4 > 0 r, tcp_flags=2 bare, tcp_seq q, payload_length n from packets where protocol=6),
 o as (select *, row_number() over (partition by w, least(a,b), greatest(a,b) order by ts, seq) i from t),
 e as (select x.*, (select max(y.i) from o y where y.w=x.w and y.a=x.a and y.b=x.b and y.s and not y.k and y.i<=x.i) own, (select max(y.i) from o y where y.w=x.w and y.a=x.b and y.b=x.a and y.s and not y.k and y.i<=x.i) other,
   (select max(y.i) from o y where y.w=x.w and y.a=x.b and y.b=x.a and y.s and y.k and y.i<=x.i) answer, (select max(y.i) from o y where y.w=x.w and y.a=x.a and y.b=x.b and y.s and y.k and y.i<=x.i) answer_other from o x),
 f as (select *, n>0 and ((s and not k) or coalesce(q < (select max(z.q+z.n) from e z where z.w=e.w and z.a=e.a and z.b=e.b and z.i<e.i and z.own is not distinct from e.own), false)) again from e),
 last_open as (select w, a, b, max(i) i from o where s and not k group by all), last_answer as (select w, b a, a b, max(i) i from o where s and k group by all), lost as (select x.w, least(x.a,x.b) lo, greatest(x.a,x.b) hi, count(*) n from last_open x left join last_answer y using (w,a,b) where y.i is null or y.i<x.i group by all),
 g as (select w, least(a,b) lo, greatest(a,b) hi, count(*) tcp, count_if(again) again, count_if(s and not k) syn, count_if(s and k) sa, count_if(bare) bare, count_if(r and not s and not k and other is not null and not coalesce(answer_other>other,false)) rst, count(distinct case when k and not s and answer>own then concat(a,'/',own) end) done from f group by all),
 h as (select unnest(list_distinct([split_part(lo,':',1), split_part(hi,':',1)])) host, g.*, coalesce(lost.n,0) lost from g left join lost using (w,lo,hi))"""
_RATIOS = f"{PACKETS}, {_SESSION}"


@query(f"""with {_RATIOS} select host, w "window", sum(again)::bigint retransmitted, round(sum(again)/sum(tcp),6) retransmission_ratio, round(sum(bare)/sum(tcp),6) syn_only_ratio, round(coalesce(sum(sa)/nullif(sum(syn),0),0),6) syn_ack_response_ratio, round(coalesce(sum(lost)/nullif(sum(syn),0),0),6) syn_no_response_ratio,
 round(coalesce(sum(rst)/nullif(sum(syn),0),0),6) rst_after_syn_ratio, round(coalesce(sum(done)/nullif(sum(syn),0),0),6) completion_ratio from h group by host, w""")
def a03_session_ratios(s, d):
    return rounded(P.session_ratios(packets(s, d), WEEK))


_GIVEN = ("retransmission_ratio", "syn_only_ratio", "syn_ack_response_ratio", "syn_no_response_ratio", "rst_after_syn_ratio", "completion_ratio", "http_requests", "http_uri_entropy_mean", "http_special_ratio", "dns_domains", "dns_entropy_mean")


@query(f"""with {_SPOKEN}, {_SESSION}, y as (select host, w, count_if(web) hr, coalesce(avg(case when web then u.h end),0) he, coalesce(avg(case when web then 1-length(translate(uri,'/?=%&',''))/length(uri) end),0) hs, count(distinct case when asks then dns end) dd, coalesce(avg(case when asks then n.h end),0) de from spoken left join ent u on u.x=uri left join ent n on n.x=dns group by host, w),
 z as (select host, w, sum(again) again, sum(tcp) tcp, sum(bare) bare, sum(sa) sa, sum(lost) lost, sum(rst) rst, sum(done) done, sum(syn) syn from h group by host, w)
 select host, w "window", round(coalesce(again/tcp,0),6) retransmission_ratio, round(coalesce(bare/tcp,0),6) syn_only_ratio, round(least(1,coalesce(sa/nullif(syn,0),0)),6) syn_ack_response_ratio, round(least(1,coalesce(lost/nullif(syn,0),0)),6) syn_no_response_ratio, round(least(1,coalesce(rst/nullif(syn,0),0)),6) rst_after_syn_ratio,
  round(least(1,coalesce(done/nullif(syn,0),0)),6) completion_ratio, round(least(1,ln(1+hr)/10),6) http_requests, round(least(1,he/8),6) http_uri_entropy_mean, round(hs,6) http_special_ratio, round(least(1,ln(1+dd)/10),6) dns_domains, round(least(1,de/8),6) dns_entropy_mean from y left join z using (host, w)""")
def f03_normal_session_features(s, d):
    """The normalised features of sessions and payloads, the rest of the thirty."""
    x = P.packet_features(spoken(packets(s, d)), WEEK)
    return rounded(x.select("host", "window", *[L.normal_packet_feature(n, F.col(n)).alias(n) for n in _GIVEN]))


_DAY, _IDLE = 86_400, 60 * 86_400


@query(f"""with {PACKETS}, k as (select *, cast(floor("timestamp"/{_DAY}) as bigint) dayno, src_ip a, dst_ip b, least(src_ip, dst_ip) lo, greatest(src_ip, dst_ip) hi from packets),
 g as (select *, "timestamp"-lag("timestamp") over (partition by protocol, lo, hi order by "timestamp", seq) pause from k), f as (select *, sum(case when pause is null or pause>{_IDLE} then 1 else 0 end) over (partition by protocol, lo, hi order by "timestamp", seq) flow from g),
 w1 as (select *, first_value(a) over (partition by protocol, lo, hi, flow order by "timestamp", seq) src, first_value(b) over (partition by protocol, lo, hi, flow order by "timestamp", seq) dst, first_value("timestamp") over (partition by protocol, lo, hi, flow order by "timestamp", seq) st from f),
 s as (select protocol, lo, hi, flow, dayno, src, dst, st, max("timestamp") lt, count_if(a=src) fp, count_if(a<>src) bp, sum(case when a=src then packet_length else 0 end) fb, sum(case when a=src then 0 else packet_length end) bb from w1 group by all)
 select src src_ip, dst dst_ip, 0 src_port, 0 dst_port, protocol, dayno "window", round(st,3) "start", round(lt,3) "last", row_number() over o=1 new_flow, fp fwd_packets, bp bwd_packets, fb::bigint fwd_bytes, bb::bigint bwd_bytes,
  (sum(fp) over o)::bigint total_fwd_packets, (sum(bp) over o)::bigint total_bwd_packets, (sum(fb) over o)::bigint total_fwd_bytes, (sum(bb) over o)::bigint total_bwd_bytes from s window o as (partition by protocol, lo, hi, flow order by dayno)""")
def a02_flow_steps(s, d):
    """Flows between hosts that live on over the borders of windows, and what each window adds."""
    portless = packets(s, d).withColumns({"src_port": F.lit(None).cast("int"), "dst_port": F.lit(None).cast("int")})
    return rounded(P.flow_steps(portless, _DAY, _IDLE), 3)
