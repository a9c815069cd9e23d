"""Queries of file sources, labels and logins. Sources are read back from files written from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common.store import new_path, once
from ..functions import labels as L
from ..operators import hosts as H
from ..sources import flow_files as R
from ..sources.tables import flows, sent_flows, series
from .base import FLOWS, LATER, SERIES, query, rounded

#: Seven thousand days: the flows of the test tables are of the nineties, which the row guards refuse.
RAW = ("BENIGN", "DoS Hulk", "PortScan", "FTP-Patator", "flow=From-Botnet-V42-TCP", "flow=Background-UDP", "Bot", "Infiltration", "Heartbleed", "Web Attack – Brute  Force", "mystery", "Normal")


def _raw(column: str):
    return F.get(F.array(*[F.lit(x) for x in RAW]), (F.col(column) % len(RAW)).cast("int"))


_RAW_SQL = "list_extract([" + ",".join(f"'{x}'" for x in RAW) + "], cast({} % 12 as int)+1)"
# The meaning of the twelve labels, by the rules for daily files and for botnet captures.
_DAILY_SQL = "case k when 0 then 'Benign' when 1 then 'Impact' when 2 then 'Recon' when 3 then 'InitialAccess' when 4 then 'C2' when 6 then 'C2' when 7 then 'InitialAccess' when 9 then 'InitialAccess' when 11 then 'Benign' else 'UNKNOWN' end"
_BOTNET_SQL = "case k when 0 then 'Benign' when 1 then 'Impact' when 2 then 'Recon' when 3 then 'InitialAccess' when 4 then 'C2' when 5 then 'Benign' when 6 then 'C2' when 7 then 'InitialAccess' when 9 then 'InitialAccess' when 11 then 'Benign' else 'UNKNOWN' end"


def _written(df, label, **options):
    path = new_path(df.sparkSession, label)
    df.write.options(**options).csv(path, header=True)
    return path


def _later(s, d):
    return flows(s, d).withColumns({"start_time": F.col("start_time") + LATER, "end_time": F.col("end_time") + LATER})


def _stamp(pattern: str):
    return F.date_format(F.timestamp_seconds("start_time"), pattern)


def _daily(year: str, names: dict):
    text = {"time": _stamp("dd/MM/yyyy HH:mm:ss"), "duration": ((F.col("end_time") - F.col("start_time")) * 1_000_000).cast("long"), "label": _raw("seq")}
    lead = " " if year == "2017" else ""
    return lambda s, d: _written(_later(s, d).select(*[text.get(n, F.col(n) if n not in text else None).alias(lead + c.title()) for c, n in names.items()]), f"daily-{year}", encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False)


_DAILY_ORACLE = f"with {FLOWS}, k as (select *, seq%12 k from flows) select src_ip, dst_ip, src_port::bigint src_port, dst_port::bigint dst_port, protocol::bigint protocol, start_time+{LATER} start_time, end_time+{LATER} end_time, fwd_bytes, bwd_bytes, fwd_packets, bwd_packets, {_DAILY_SQL} coarse_category from k"


def _plain(df):
    return df.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "start_time", "end_time", "fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets", "coarse_category")


@query(_DAILY_ORACLE)
def s05_daily_flow_files(s, d):
    return _plain(R.daily_flows(s, _daily("2017", R.DAILY_2017)(s, d), "2017"))


@query(_DAILY_ORACLE)
def s06_later_daily_flow_files(s, d):
    return _plain(R.daily_flows(s, _daily("2018", R.DAILY_2018)(s, d), "2018"))


@query(f"""with {FLOWS}, k as (select *, seq%12 k, fwd_bytes+bwd_bytes t, fwd_packets+bwd_packets p from flows), q as (select *, round_even(p*case when t>0 then fwd_bytes/t else 1 end,0)::bigint f from k), r as (select *, case when fwd_bytes>0 and p>0 then greatest(f,1) else f end g from q),
 z as (select *, least(greatest(case when bwd_bytes>0 and p>1 then least(g,p-1) else g end,0),p) h from r)
 select src_ip, dst_ip, src_port, dst_port, protocol, start_time, end_time, fwd_bytes, bwd_bytes, h fwd_packets, p-h bwd_packets, {_BOTNET_SQL} coarse_category from z""")
def s07_botnet_flow_files(s, d):
    c = F.col
    name = F.when(c("protocol") == 6, "tcp").when(c("protocol") == 17, "udp").otherwise("icmp")
    path = _written(flows(s, d).select(
        _stamp("yyyy/MM/dd HH:mm:ss.SSSSSS").alias("StartTime"), (c("end_time") - c("start_time")).alias("Dur"), name.alias("Proto"), c("src_ip").alias("SrcAddr"), c("src_port").alias("Sport"), c("dst_ip").alias("DstAddr"), c("dst_port").alias("Dport"),
        (c("fwd_packets") + c("bwd_packets")).alias("TotPkts"), (c("fwd_bytes") + c("bwd_bytes")).alias("TotBytes"), c("fwd_bytes").alias("SrcBytes"), _raw("seq").alias("Label"),
    ), "botnet")
    return _plain(R.botnet_flows(s, path))


@query(f"""with {SERIES}, k as (select *, event_id%12 k, case when event_id%7=0 then 1 else event_id%50 end n from series) select '10.0.0.'||host src_ip, case when event_id%9=0 then '0.0.0.0' else '10.9.9.9' end dst_ip, case when event_id%5=0 then 0 else 443 end dst_port, t start_time, t+10 end_time, greatest(n,1)*64 fwd_bytes, greatest(n,1) fwd_packets, {_DAILY_SQL} coarse_category from k""")
def s09_alert_files(s, d):
    c = F.col
    path = _written(series(s, d).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("DetectTime"), F.concat(F.lit("10.0.0."), c("host").cast("string")).alias("SourceIP"), F.when(c("event_id") % 9 != 0, "10.9.9.9").alias("TargetIP"), _raw("event_id").alias("Category"),
        F.lit("tcp").alias("Proto"), F.when(c("event_id") % 5 == 0, "n/a").otherwise("443").alias("Port"), F.when(c("event_id") % 7 == 0, "?").otherwise((c("event_id") % 50).cast("string")).alias("FlowCount"),
    ), "alerts")
    return R.alert_flows(s, path).select("src_ip", "dst_ip", "dst_port", "start_time", "end_time", "fwd_bytes", "fwd_packets", "coarse_category")


def _logins(s, d):
    """Logins of three logs, each read back from its own format; seconds are whole."""
    c, e = F.col, series(s, d).withColumn("user", F.concat(F.lit("u"), (F.col("event_id") % 17).cast("string"))).withColumn("from", F.concat(F.lit("10.2.0."), (F.col("event_id") % 200).cast("string")))
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" box sshd[7]: "), F.when(c("is_attack"), "Failed password for invalid user ").otherwise("Accepted publickey for "), c("user"), F.lit(" from "), c("from"), F.lit(" port 22 ssh2"))
    root = new_path(s, "logins")
    e.where("event_id % 3 = 0").select(line.alias("value")).write.text(f"{root}/ssh")
    stamp = F.floor("t").cast("long")
    e.where("event_id % 3 = 1").select(F.when(c("is_attack"), 4625).otherwise(4624).alias("EventID"), F.date_format(F.timestamp_seconds(stamp), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("TimeCreated"), F.lit("box").alias("Computer"), F.lit("-").alias("IpAddress"), c("from").alias("WorkstationName"), c("user").alias("TargetUserName")).write.json(f"{root}/windows")
    e.where("event_id % 3 = 2").select(F.when(c("is_attack"), 401).otherwise(200).alias("status_code"), stamp.alias("timestamp"), F.lit("box").alias("server_ip"), c("from").alias("client_ip"), "user").write.json(f"{root}/web")
    windows = R.json_lines(s, f"{root}/windows", "EventID int, TimeCreated string, Computer string, IpAddress string, WorkstationName string, TargetUserName string")
    web = R.json_lines(s, f"{root}/web", "status_code int, timestamp double, server_ip string, client_ip string, user string")
    return R.ssh_logins(s.read.text(f"{root}/ssh"), "box", 2024).unionByName(R.domain_logins(windows)).unionByName(R.web_logins(web))


_LOGINS = f"""{SERIES}, logins as (select floor(t)::double t, 'box' host, '10.2.0.'||(event_id%200) source, 'u'||(event_id%17) account, is_attack failed, ['ssh','windows','web'][event_id%3+1] log from series)"""


@query(f"with {_LOGINS} select * from logins")
def s12_login_sources(s, d):
    return _logins(s, d)


@query(f"""with {_LOGINS}, a as (select floor(t/3600)::bigint h, * from logins), b as (select h, host, failed, account, source from a union all select h-1, host, failed, account, source from a where t=h*3600), g as (select host, h*3600::double "start", count_if(failed) f, count_if(not failed) ok, count(distinct account) users, count(distinct source) sources from b group by all)
 select host, "start", f fails, ok successes, round(f/(f+ok),6) ratio, users, sources, round(0.5::double*least(1,f/10)+0.3::double*f/(f+ok)+0.2::double*least(1,users/5),6) score, f>=5 and f/(f+ok)>=0.7::double brute from g where "start">=(select min(h) from a)*3600""")
def a07_login_windows(s, d):
    """Each hour and the logins in it, both ends included."""
    logins = _logins(s, d)
    hours = logins.select("host", (F.floor(F.col("t") / 3600) * 3600).cast("double").alias("start")).distinct().withColumn("end", F.col("start") + 3600)
    extra = hours.select("host", (F.col("start") - 3600).alias("start"), F.col("start").alias("end"))
    first = logins.agg((F.floor(F.min("t") / 3600) * 3600).alias("low"))
    windows = hours.union(extra).distinct().join(first, F.col("start") >= F.col("low")).drop("low")
    return rounded(H.login_windows(logins, windows, 3600).drop("end"))


@query(f"with k as (select distinct cast(l_orderkey*8+l_linenumber as bigint)%12 k from lineitem) select {_RAW_SQL.format('k')} raw_label, case when k=8 then 'Impact' else {_BOTNET_SQL} end category, case when k=8 then 'T1189;T1005' when k=1 then 'T1498' when k=2 then 'T1046' when k in (3,9) then 'T1110' when k in (4,6) then 'T1071' when k=7 then 'T1190' else '' end techniques, k not in (0,5,10,11) is_attack from k")
def j02_resolved_labels(s, d):
    """A label table first, then the words of a label."""
    known = s.createDataFrame([("HEARTBLEED ", "Impact", "T1189;T1005", True)], "raw_label string, coarse_category string, attck_technique_ids string, is_attack boolean")
    # Labels are resolved, not rows.
    found = L.resolve_labels(flows(s, d).select(_raw("seq").alias("raw_label")).distinct(), "raw_label", known, botnet=True)
    return found.select("raw_label", "resolved.category", F.array_join("resolved.techniques", ";").alias("techniques"), "resolved.is_attack")


@query(f"""with {FLOWS}, k as (select seq%12 k, {_RAW_SQL.format("seq")} raw from flows), t as (select count(*) n, count_if({_DAILY_SQL}='UNKNOWN') bad from k), u as (select raw, count(*) c from k where {_DAILY_SQL}='UNKNOWN' group by raw) select raw raw_label, c n, n total, round(bad/n,6) rate from u, t""")
def p10_label_coverage(s, d):
    """Rows without a meaning, and the twenty commonest labels among them."""
    # Labels are judged, not rows; a filter on the verdict before the limit would be pushed down to the rows.
    counts = flows(s, d).select(_raw("seq").alias("raw_label")).groupBy("raw_label").agg(F.count("*").alias("n"))
    counts = counts.withColumn("known", L.guessed_label(F.col("raw_label"))["category"] != L.UNRESOLVED)
    total = counts.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("bad"))
    worst = counts.orderBy("known", F.desc("n"), "raw_label").limit(20).where("not known").select("raw_label", "n")
    return rounded(worst.crossJoin(F.broadcast(total)).select("raw_label", "n", "total", (F.col("bad") / F.col("total")).alias("rate")))


@query(f"""with {FLOWS}, k as (select distinct coarse_category c from flows) select c category, case c when 'Benign' then 'Benign.None' when 'Recon' then 'Recon.T1595' when 'InitialAccess' then 'InitialAccess.T1190' when 'C2' then 'C2.T1071' when 'Impact' then 'Impact.T1498' end token,
 case c when 'Benign' then 3 when 'Recon' then 4 when 'Impact' then 5 when 'InitialAccess' then 7 when 'C2' then 8 end token_id, c lane, case c when 'Recon' then 0 when 'InitialAccess' then 2 when 'C2' then 4 when 'Impact' then 7 else -1 end lane_rank, case c when 'Benign' then 0 when 'Recon' then 1 when 'InitialAccess' then 2 else 3 end "level" from k""")
def f13_tokens_and_lanes(s, d):
    """F13, F14, F15 and F17."""
    k = flows(s, d).select(F.col("coarse_category").alias("category")).distinct()
    token = L.macro_token(F.col("category"), F.lit(None).cast("string"))
    return k.select("category", L.token_of(L.token_id(token)).alias("token"), L.token_id(token).alias("token_id"), L.lane(token).alias("lane"), L.lane_rank(L.lane(token)).alias("lane_rank"), L.level(F.col("category")).alias("level"))


@query(f"""with {FLOWS}, a as (select floor(start_time/86400)*86400+{LATER}+seq*37%86400 t from flows), h as (select year(to_timestamp(t)) y, case cast(floor(t/3600) as bigint)%12 when 0 then 12 else cast(floor(t/3600) as bigint)%12 end h from a), n as (select y, count(*)>=500 and count_if(h between 1 and 7)>0 and count_if(h between 8 and 12)>0 dial from h group by y)
 select y::int "day", (case when dial and h between 1 and 7 then h+12 else h end) "hour", count(*) n from h join n using (y) group by all""")
def p07_clock_repair(s, d):
    """Times set to a twelve-hour dial a year (midnight and noon read 12), then put right."""
    t = F.col("t")
    rows = once(sent_flows(s, d).select("start_time", "seq"), t=(F.floor(F.col("start_time") / 86400) * 86400 + LATER + F.col("seq") * 37 % 86400).cast("double"))
    hour = F.floor(t / 3600) % 24
    dial = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    rows = rows.select(F.year(F.timestamp_seconds(t)).alias("day"), (t + (dial - hour) * 3600).alias("t"))
    return R.clock_repair(rows, "t", "day").groupBy("day", (F.floor(t / 3600) % 24).alias("hour")).agg(F.count("*").alias("n"))


@query(f"with {SERIES}, d as (select distinct t from series), l as (select t-lag(t) over (order by t) s from d) select round(min(s),6) resolution from l")
def p06_time_resolution(s, d):
    return rounded(R.time_resolution(series(s, d), "t"))
