"""The registry of queries, and the SQL that gives the test tables the same views as ``sources.tables``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import SEVERITY, STAGES

#: Window of flows (30 days), of alerts (an hour), horizon of alert pairs (a day), pause that ends a segment.
FLOW_WINDOW, HOUR, HORIZON, PAUSE = 2_592_000, 3600, 86_400, 3 * 3600
#: Seconds that move the flows of the test tables to where their times are valid.
LATER = 604_800_000

FLOWS = """flows as (select cast(l_orderkey*8+l_linenumber as bigint) seq,
  concat('10.0.',cast(l_suppkey // 250 as varchar),'.',cast(l_suppkey%250+1 as varchar)) src_ip,
  concat(case when o_custkey%5=0 then '203.0.' else '10.1.' end,cast(o_custkey // 250 as varchar),'.',cast(o_custkey%250+1 as varchar)) dst_ip,
  cast(1024+l_partkey%60000 as int) src_port, cast(list_extract([22,53,80,443,445,3389,6667,8080], l_partkey%8+1) as int) dst_port,
  case l_linenumber%3 when 0 then 6 when 1 then 17 else 1 end protocol,
  epoch_us(l_shipdate)/1000000+l_orderkey%86400 start_time, epoch_us(l_shipdate)/1000000+l_orderkey%86400+cast(l_quantity as double) end_time,
  cast(floor(l_extendedprice) as bigint) fwd_bytes, cast(floor(l_extendedprice*l_discount*10) as bigint) bwd_bytes,
  cast(l_quantity as bigint) fwd_packets, cast(l_linenumber-1 as bigint) bwd_packets, l_returnflag='R' is_attack,
  case when l_returnflag<>'R' then 'Benign' else case l_partkey%4 when 0 then 'Recon' when 1 then 'InitialAccess' when 2 then 'C2' else 'Impact' end end coarse_category
  from lineitem join orders on l_orderkey=o_orderkey),
 ends as (select *, src_ip host, dst_ip peer, true is_src from flows union all select *, dst_ip, src_ip, false from flows where src_ip<>dst_ip)"""
SERIES = """series as (select event_id, user_id host, ts, epoch_us(ts)/1000000 t, event_type='error' is_attack,
  case event_type when 'view' then 'Benign' when 'click' then 'Recon' when 'signup' then 'InitialAccess' when 'purchase' then 'Exfiltration' else 'Impact' end category,
  least(1.0, value/400) score from events)"""
SCORES = "scores as (select doc_id, cast(toxic as int) y, (n_chars % 1000)/1000.0::double p from documents join labels using (doc_id))"
GRID = f"select *, cast(floor((start_time-min(start_time) over ())/{FLOW_WINDOW}) as bigint) w"
PRIVATE = "regexp_matches({}, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')"


def case(values: dict, key: str, other: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {other} end"


SEV = case({k: f"{v}::double" for k, v in SEVERITY.items()}, "{}", "0.5::double")
STAGE = case({k: i for i, k in enumerate(STAGES)}, "{}", "null")
LEAST_RATE = "(case when end_time>start_time then ({0})/(end_time-start_time) else {0} end)"
EDGES = f"""edges as (select * from (select x.host, x.event_id u, y.event_id v,
   (case when {STAGE.format("x.category")} is null or {STAGE.format("y.category")} is null then 0.1::double when x.category=y.category then 0.85::double
      when {STAGE.format("y.category")} > {STAGE.format("x.category")} then round(greatest(0.2::double, 0.95::double-0.15::double*({STAGE.format("y.category")}-{STAGE.format("x.category")})),4) else 0.2::double end) * (1-(y.t-x.t)/{HORIZON}) score
   from series x join series y on x.host=y.host and y.t-x.t between 0 and {HORIZON} and (y.t>x.t or (y.t=x.t and x.event_id<y.event_id))
   where not (x.category='Benign' and y.category='Benign')) where score >= 0.35)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of floats come in no fixed order."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a query with its SQL; None where SQL cannot express it, and tests hold it against small cases."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add
