"""Flow records, alerts and logins from text files, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, once, written
from ..functions.flow import invalid_time
from ..functions.labels import guessed_label

# Columns of the daily flow files of two years, and what stands in for values that are no numbers.
DAILY_2017 = {
    "source ip": "src_ip", "destination ip": "dst_ip", "source port": "src_port", "destination port": "dst_port", "protocol": "protocol", "timestamp": "time", "flow duration": "duration",
    "total fwd packets": "fwd_packets", "total backward packets": "bwd_packets", "total length of fwd packets": "fwd_bytes", "total length of bwd packets": "bwd_bytes", "label": "label",
}
DAILY_2018 = {
    "src ip": "src_ip", "dst ip": "dst_ip", "src port": "src_port", "dst port": "dst_port", "protocol": "protocol", "timestamp": "time", "flow duration": "duration",
    "tot fwd pkts": "fwd_packets", "tot bwd pkts": "bwd_packets", "totlen fwd pkts": "fwd_bytes", "totlen bwd pkts": "bwd_bytes", "label": "label",
}
#: Days (or files) up to which a table of them is broadcast.
DAYS = 100_000
PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}


@dataclass
class Layout:
    """Columns of a daily flow file (lower case, stripped) and the numbers that replace unreadable ones."""

    columns: dict[str, str]
    instead: dict[str, float] = field(default_factory=dict)


LAYOUTS = {"2017": Layout(DAILY_2017, {"protocol": 6}), "2018": Layout(DAILY_2018, {"protocol": 6, "dst_port": 80, "fwd_packets": 1, "fwd_bytes": 64})}


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header in Latin-1, all columns text, their names stripped and in lower case. No pass to infer types."""
    df = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def number(column: str, instead: float = 0) -> Column:
    """A finite number, or what stands in for one."""
    x = F.trim(F.col(column)).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), float(instead)).otherwise(x)


def clock_repair(df: DataFrame, t: str, day: str) -> DataFrame:
    """``df`` with afternoon hours put right on days whose clock has twelve hours.

    Such a day has at least 500 valid rows, none in hour 0 or from 13 on, some from 1 to 7 and some from 8 to 12. The
    verdict is one row a day, from an aggregate of at most 24 hours a day.
    """
    hour, names = F.floor(F.pmod(F.col(t), F.lit(86400)) / 3600), df.columns
    df = once(df, **{t: F.col(t)})
    per = df.where(~invalid_time(F.col(t))).groupBy(day).agg(
        F.count("*").alias("n"), F.count_if((hour == 0) | (hour >= 13)).alias("late"), F.count_if(hour.between(1, 7)).alias("early"), F.count_if(hour.between(8, 12)).alias("noon"),
    )
    days = per.select(F.col(day).alias("clock day"), ((F.col("n") >= 500) & (F.col("late") == 0) & (F.col("early") > 0) & (F.col("noon") > 0)).alias("dial"))
    fixed = F.when(F.coalesce("dial", F.lit(False)) & hour.between(1, 7) & (F.col(t) > 0), F.col(t) + 43200).otherwise(F.col(t))
    # A few days hold all rows: a join by the day would shuffle them to as many tasks.
    few = bounded_broadcast(written(days, "clock-days"), DAYS)
    return df.join(few, F.col(day).eqNullSafe(F.col("clock day")), "left").withColumn(t, fixed).select(*names)


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with a plausible time, a port or protocol, and a source host."""
    blank = F.lower(F.trim("src_ip")).isin("nan", "", "none", "0") | F.col("src_ip").isNull()
    return df.where(~(invalid_time(F.col("start_time")) | ((F.col("protocol") == 0) & (F.col("dst_port") == 0)) | blank))


def _with_label(df: DataFrame, raw: Column, botnet: bool = False) -> DataFrame:
    found = guessed_label(raw, botnet)
    return df.withColumns({"raw_label": raw, "coarse_category": found["category"], "attck_technique_ids": found["techniques"], "is_attack": found["is_attack"]}).drop("label")


def daily_flows(spark: SparkSession, path: str, year: str = "2017") -> DataFrame:
    """Flows of daily CSV files: day-first times, durations in microseconds (0 to a day), clocks put right a file, bad rows dropped."""
    layout = LAYOUTS[year]
    df = text_table(spark, path)
    df = df.select(*[F.col(c).alias(n) for c, n in layout.columns.items() if c in df.columns], F.col("_metadata.file_path").alias("file")) if "_metadata" in df.columns else df.select(*[F.col(c).alias(n) for c, n in layout.columns.items()], F.input_file_name().alias("file"))
    whole = {c: number(c, layout.instead.get(c, 0)).cast("long") for c in ("src_port", "dst_port", "protocol", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")}
    start = F.coalesce(F.unix_micros(F.try_to_timestamp("time", F.lit("d/M/yyyy H:m[:s]"))) / 1_000_000, F.lit(0.0))
    df = df.withColumns({**whole, "start_time": start, "duration": F.least(F.greatest(number("duration") / 1_000_000, F.lit(0.0)), F.lit(86400.0))}).drop("time")
    df = clock_repair(df, "start_time", "file").drop("file").withColumn("end_time", F.col("start_time") + F.col("duration")).drop("duration")
    return _with_label(valid_rows(df), F.col("label"))


def _protocol(column: str) -> Column:
    name = F.lower(F.trim(F.col(column)))
    out = F.lit(6)
    for word, value in PROTOCOLS.items():
        out = F.when(name == word, value).otherwise(out)
    return out


def botnet_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flows of bidirectional flow files of botnet captures.

    Packets are shared out by bytes, rounded half to even: one at least for a direction that has bytes, if there are enough.
    """
    df = text_table(spark, path)
    c = F.col
    total, packets = number("totbytes", 64).cast("long"), number("totpkts", 1).cast("long")
    df = df.withColumns({"total": total, "packets": packets, "fwd_bytes": F.coalesce(F.trim("srcbytes").try_cast("double").cast("long"), F.floor(total / 2))})
    df = df.withColumn("bwd_bytes", F.greatest(c("total") - c("fwd_bytes"), F.lit(0)))
    share = F.when(c("total") > 0, c("fwd_bytes") / F.greatest(c("total"), F.lit(1))).otherwise(1.0)
    fwd = F.rint(c("packets") * share).cast("long")
    fwd = F.when((c("fwd_bytes") > 0) & (c("packets") > 0), F.greatest(fwd, F.lit(1))).otherwise(fwd)
    fwd = F.when((c("bwd_bytes") > 0) & (c("packets") > 1), F.least(fwd, c("packets") - 1)).otherwise(fwd)
    start = F.coalesce(F.unix_micros(F.try_to_timestamp("starttime", F.lit("yyyy/MM/dd HH:mm:ss[.SSSSSS]"))) / 1_000_000, F.lit(0.0))
    df = df.select(
        c("srcaddr").alias("src_ip"), c("dstaddr").alias("dst_ip"), number("sport").cast("int").alias("src_port"), number("dport").cast("int").alias("dst_port"), _protocol("proto").alias("protocol"), start.alias("start_time"),
        (start + number("dur")).alias("end_time"), "fwd_bytes", "bwd_bytes", F.least(F.greatest(fwd, F.lit(0)), c("packets")).alias("fwd_packets"), "packets", "label",
    ).withColumn("bwd_packets", c("packets") - c("fwd_packets")).drop("packets")
    return _with_label(df, c("label"), botnet=True)


def alert_flows(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of one or more CSV files (a folder or a pattern) as flows of ten seconds, 64 bytes for each flow they stand for."""
    df = text_table(spark, path)
    n = F.greatest(number("flowcount", 1).cast("long"), F.lit(1))
    start = F.coalesce(F.unix_micros(F.col("detecttime").try_cast("timestamp")) / 1_000_000, F.lit(0.0))
    df = df.select(
        F.coalesce("sourceip", F.lit("0.0.0.0")).alias("src_ip"), F.coalesce("targetip", F.lit("0.0.0.0")).alias("dst_ip"), F.lit(0).alias("src_port"), number("port").cast("int").alias("dst_port"), _protocol("proto").alias("protocol"),
        start.alias("start_time"), (start + 10).alias("end_time"), (n * 64).alias("fwd_bytes"), F.lit(0).cast("long").alias("bwd_bytes"), n.alias("fwd_packets"), F.lit(0).cast("long").alias("bwd_packets"), F.col("category").alias("label"),
    )
    return _with_label(df, F.col("label"))


# Lines of failed and accepted logins.
_WHEN = r"^([A-Za-z]{3})\s+(\d+)\s+(\d+:\d+:\d+).*sshd\[\d+\]:\s+"
FAILED = _WHEN + r"(?:Failed password|Invalid user)\s+(?:for\s+invalid\s+user\s+|for\s+)?(\S+)\s+from\s+(\d+\.\d+\.\d+\.\d+)"
ACCEPTED = _WHEN + r"Accepted\s+\S+\s+for\s+(\S+)\s+from\s+(\d+\.\d+\.\d+\.\d+)"


def ssh_logins(lines: DataFrame, host: str, year: int, line: str = "value") -> DataFrame:
    """Logins in lines of an authentication log, which names no year; other lines give no row."""
    x = F.col(line)
    failed = x.rlike(FAILED)
    part = lambda k: F.when(failed, F.regexp_extract(x, FAILED, k)).otherwise(F.regexp_extract(x, ACCEPTED, k))
    stamp = F.concat_ws(" ", F.lit(str(year)), F.initcap(part(1)), part(2), part(3))
    return lines.where(failed | x.rlike(ACCEPTED)).select(
        (F.unix_micros(F.try_to_timestamp(stamp, F.lit("yyyy MMM d H:m:s"))) / 1_000_000).alias("t"), F.lit(host).alias("host"), part(5).alias("source"), part(4).alias("account"), failed.alias("failed"), F.lit("ssh").alias("log"),
    )


def domain_logins(events: DataFrame) -> DataFrame:
    """Logins of Windows security events (4625 failed, 4624 succeeded); a local source gives way to the workstation's name."""
    c = F.col
    when = F.coalesce(c("TimeCreated").try_cast("double"), F.unix_micros(c("TimeCreated").try_cast("timestamp")) / 1_000_000, F.lit(0.0))
    source = F.when(F.coalesce("IpAddress", F.lit("")).isin("-", "::1", "127.0.0.1", ""), F.coalesce("WorkstationName", "IpAddress")).otherwise(c("IpAddress"))
    return events.select(when.alias("t"), F.coalesce("Computer", F.lit("127.0.0.1")).alias("host"), source.alias("source"), F.coalesce("TargetUserName", F.lit("Administrator")).alias("account"), (F.coalesce(c("EventID").cast("int"), F.lit(4625)) == 4625).alias("failed"), F.lit("windows").alias("log"))


def web_logins(events: DataFrame) -> DataFrame:
    """Logins of web requests: 401 and 403 failed."""
    return events.select(
        F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0)).alias("t"), F.coalesce("server_ip", F.lit("127.0.0.1")).alias("host"), F.coalesce("client_ip", F.lit("")).alias("source"), F.coalesce("user", F.lit("anonymous")).alias("account"),
        F.coalesce(F.col("status_code").cast("int"), F.lit(401)).isin(401, 403).alias("failed"), F.lit("web").alias("log"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Well-formed lines of JSON files; others are left out."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null").drop("_corrupt_record")


def participants(spark: SparkSession, path: str) -> DataFrame:
    """Who took part in the attacks of each day and label, of a JSON map, one row an address: (day, label, role, ip)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,map<string,array<string>>>>").alias("m"))
    days = raw.select(F.explode("m").alias("day", "labels")).select("day", F.explode("labels").alias("label", "roles"))
    return days.select("day", "label", F.explode("roles").alias("role", "ips")).select("day", "label", "role", F.explode("ips").alias("ip"))


def time_resolution(df: DataFrame, t: str) -> DataFrame:
    """The least positive step between distinct valid times; 0 where there are not two.

    Times are put in ranges first, so no task orders all of them: steps lie inside a range, or between one's
    last and the next's first.
    """
    stamps = df.where(~invalid_time(F.col(t))).select(F.col(t).alias("t")).distinct().withColumn("day", F.floor(F.col("t") / 86400))
    inside = stamps.withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy("day").orderBy("t")))
    ends = inside.groupBy("day").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min("step").alias("step"))
    across = ends.withColumn("jump", F.col("first") - F.lag("last").over(Window.orderBy("day")))
    return across.agg(F.coalesce(F.min(F.least("step", "jump")), F.lit(0.0)).alias("resolution"))
