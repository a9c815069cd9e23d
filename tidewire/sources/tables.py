"""Flows, event series and scored rows from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Epoch seconds of a timestamp, as a double."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1_000_000


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bidirectional flows: a line item is a flow from its supplier's host to its customer's."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return _flows(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))


def _flows(df: DataFrame) -> DataFrame:
    start = epoch("l_shipdate") + F.col("l_orderkey") % 86400
    ports = F.array(*[F.lit(p) for p in (22, 53, 80, 443, 445, 3389, 6667, 8080)])
    attack = F.col("l_returnflag") == "R"
    kind = F.col("l_partkey") % 4
    return df.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
        F.concat(F.lit("10.0."), F.floor(F.col("l_suppkey") / 250).cast("string"), F.lit("."), (F.col("l_suppkey") % 250 + 1).cast("string")).alias("src_ip"),
        F.concat(F.when(F.col("o_custkey") % 5 == 0, "203.0.").otherwise("10.1."), F.floor(F.col("o_custkey") / 250).cast("string"), F.lit("."), (F.col("o_custkey") % 250 + 1).cast("string")).alias("dst_ip"),
        (1024 + F.col("l_partkey") % 60000).cast("int").alias("src_port"),
        F.get(ports, (F.col("l_partkey") % 8).cast("int")).alias("dst_port"),
        F.when(F.col("l_linenumber") % 3 == 0, 6).when(F.col("l_linenumber") % 3 == 1, 17).otherwise(1).alias("protocol"),
        start.alias("start_time"),
        (start + F.col("l_quantity").cast("double")).alias("end_time"),
        F.floor(F.col("l_extendedprice")).cast("long").alias("fwd_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount") * 10).cast("long").alias("bwd_bytes"),
        F.col("l_quantity").cast("long").alias("fwd_packets"),
        (F.col("l_linenumber") - 1).cast("long").alias("bwd_packets"),
        attack.alias("is_attack"),
        F.when(~attack, "Benign").when(kind == 0, "Recon").when(kind == 1, "InitialAccess").when(kind == 2, "C2").otherwise("Impact").alias("coarse_category"),
    )


def sent_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows without their targets, and without the join that finds these: every line item has its order."""
    return _flows(table(spark, sf_dir, "lineitem").withColumn("o_custkey", F.lit(0).cast("long"))).drop("dst_ip")


def start_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start times of all flows, without the join: every line item has its order."""
    return table(spark, sf_dir, "lineitem").select((epoch("l_shipdate") + F.col("l_orderkey") % 86400).alias("start_time"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts: events of a user's host, with a category and a score."""
    names = {"view": "Benign", "click": "Recon", "signup": "InitialAccess", "purchase": "Exfiltration"}
    category = F.lit("Impact")
    for event, name in names.items():
        category = F.when(F.col("event_type") == event, name).otherwise(category)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("ts"), epoch("ts").alias("t"), (F.col("event_type") == "error").alias("is_attack"), category.alias("category"),
        F.least(F.lit(1.0), F.col("value") / 400).alias("score"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: labelled documents with a made-up probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select("doc_id", F.col("toxic").cast("int").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("p"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: a line item is one, from its supplier's host to its order's or back."""
    c, n = F.col, F.col("l_linenumber")
    df = table(spark, sf_dir, "lineitem")
    near = F.concat(F.lit("10.0.0."), (c("l_suppkey") % 20 + 1).cast("string"))
    far = F.concat(F.when(c("l_orderkey") % 5 == 0, "203.0.113.").otherwise("10.1.0."), (c("l_orderkey") % 20 + 1).cast("string"))
    port_near, port_far = (40000 + c("l_suppkey") % 50).cast("int"), F.get(F.array(*[F.lit(p) for p in (22, 53, 80, 443, 445, 3389, 6667, 8080)]), (c("l_partkey") % 8).cast("int"))
    out, tcp = n % 2 == 1, c("l_partkey") % 3 < 2
    bits = F.get(F.array(*[F.lit(b) for b in (16, 2, 18, 16, 24, 4, 17)]), (n % 7).cast("int"))
    payload = F.when(n.isin(3, 4), c("l_quantity").cast("int") * 10).otherwise(0)
    flip = lambda a, b: F.when(out, a).otherwise(b)
    return df.select(
        (c("l_orderkey") * 8 + n).cast("long").alias("seq"), (epoch("l_shipdate") + c("l_partkey") % 86400 + n * 0.25).alias("timestamp"), flip(near, far).alias("src_ip"), flip(far, near).alias("dst_ip"),
        F.when(tcp, 6).otherwise(17).alias("protocol"), (F.when(tcp, 54).otherwise(42) + payload).alias("packet_length"), flip(port_near, port_far).alias("src_port"), flip(port_far, port_near).alias("dst_port"),
        F.when(c("l_suppkey") % 2 == 0, 64).otherwise(128).alias("ttl"), F.when(tcp, bits).alias("tcp_flags"), F.when(tcp, (c("l_partkey") * 100).cast("long")).alias("tcp_seq"), F.when(tcp, c("l_quantity").cast("int") * 100).alias("tcp_window"), payload.alias("payload_length"),
    )


def spoken(packets: DataFrame) -> DataFrame:
    """Packets with a ``payload``: those that carry one to or from a web port a request, those of port 53 by UDP a question for a name.

    Lengths follow the payload; other payloads are letters.
    """
    c, port = F.col, F.least("src_port", "dst_port")
    number = F.floor(c("seq") / 8)
    web, name = (c("protocol") == 6) & port.isin(80, 8080), (c("protocol") == 17) & (port == 53)
    verb = F.get(F.array(*map(F.lit, ("GET", "POST", "BREW"))), (number % 3).cast("int"))
    request = F.concat(verb, F.lit(" /p/"), (number % 97).cast("string"), F.lit("?a=%41&b="), (c("seq") % 8).cast("string"), F.lit(" HTTP/1.1\r\nHost: x\r\n\r\n"))
    labels = [F.concat(F.lit("h"), (number % 31).cast("string")), F.lit("example"), F.get(F.array(F.lit("org"), F.lit("com")), (number % 2).cast("int"))]
    question = F.concat(F.lit("00" * 4 + "0001" + "00" * 6), *[F.concat(F.lpad(F.hex(F.length(x).cast("long")), 2, "0"), F.hex(F.encode(x, "UTF-8"))) for x in labels], F.lit("0000010001"))
    plain = F.repeat(F.lit("A"), c("payload_length"))
    payload = F.when(c("payload_length") == 0, F.encode(F.lit(""), "UTF-8")).when(web, F.encode(request, "UTF-8")).when(name, F.unhex(question)).otherwise(F.encode(plain, "UTF-8"))
    sized = packets.withColumn("payload", payload)
    longer = F.octet_length("payload") - c("payload_length")
    return sized.withColumn("packet_length", c("packet_length") + longer).withColumn("payload_length", c("payload_length") + longer)


def frames(packets: DataFrame, *keep: str) -> DataFrame:
    """Ethernet frames (``timestamp``, ``frame``) of IPv4 packets as :func:`packets` gives them, with the payload of :func:`spoken` if there is one."""
    c = F.col
    h = lambda e, digits: F.lpad(F.hex(e.cast("long")), digits, "0")
    ip = lambda e: F.concat(*[h(F.get(F.split(e, r"\."), k), 2) for k in range(4)])
    lit = F.lit
    body = F.when(c("protocol") == 6, F.concat(h(c("src_port"), 4), h(c("dst_port"), 4), h(c("tcp_seq"), 8), lit("00000000"), lit("50"), h(c("tcp_flags"), 2), h(c("tcp_window"), 4), lit("00000000"))).otherwise(
        F.concat(h(c("src_port"), 4), h(c("dst_port"), 4), h(c("payload_length") + 8, 4), lit("0000"))
    )
    head = F.concat(lit("0" * 24 + "0800" + "4500"), h(c("packet_length") - 14, 4), lit("00000000"), h(c("ttl"), 2), h(c("protocol"), 2), lit("0000"), ip(c("src_ip")), ip(c("dst_ip")))
    payload = F.hex("payload") if "payload" in packets.columns else F.repeat(lit("41"), c("payload_length"))
    return packets.select("timestamp", F.unhex(F.concat(head, body, payload)).alias("frame"), *keep)
