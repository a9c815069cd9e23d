"""Packets to flows, and features of windows of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payload as Y
from ..functions.address import text_entropy
from ..functions.flow import internal
from ..sources.capture import FLAGS
from .temporal import sliced_segments

# Ports of administration.
ADMIN_PORTS = (22, 88, 139, 389, 445, 464, 3389, 5985, 5986)
TINY = 1e-5


def flag(name: str) -> Column:
    return F.col("tcp_flags").bitwiseAND(FLAGS[name]) > 0


def windowed(packets: DataFrame, width: float) -> DataFrame:
    """Packets with the number of their window on the absolute grid."""
    return packets.withColumn("window", F.floor(F.col("timestamp") / width).cast("long"))


def packet_flows(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Bidirectional flows of the packets of each ``keys``; the first packet (by time, then ``seq``) is forward.

    Both directions meet under an ordered pair of ends. Sums are kept per end and named once the first packet is
    known, so one shuffle does. Pauses come from a window over the same partitioning. Besides the pauses each flow has
    one of nought seconds at its start. Packets without ports count as port 0.
    """
    end = lambda ip, port: F.struct(F.col(ip).alias("ip"), F.coalesce(F.col(port), F.lit(0)).alias("port"))
    a, b = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    keyed = packets.select("*", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a <= b).alias("up"))
    group = [*keys, "protocol", "low", "high"]
    w = Window.partitionBy(*group).orderBy("timestamp", "seq")
    paused = keyed.withColumn("pause", F.col("timestamp") - F.lag("timestamp").over(w))
    up, length, data = F.col("up"), F.col("packet_length"), F.col("payload_length") > 0
    sums = paused.groupBy(*group).agg(
        F.min(F.struct("timestamp", "seq", "up"))["up"].alias("first_up"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("n"),
        F.count_if(up).alias("n_up"), F.sum(F.when(up, length).otherwise(0)).alias("b_up"), F.sum(length).alias("bytes"), F.count_if(up & data).alias("d_up"), F.count_if(data).alias("d"),
        *[F.count_if(flag(f)).alias(f) for f in FLAGS], F.max(length).alias("longest"), F.sum(length.cast("double") ** 2).alias("len2"), F.sum(length.cast("double") ** 3).alias("len3"),
        F.sum(F.col("pause") ** 2).alias("pause2"), F.max("pause").alias("longest_pause"),
    )
    first = F.col("first_up")
    pick = lambda one, total: F.when(first, F.col(one)).otherwise(F.col(total) - F.col(one))
    src, dst = F.when(first, F.col("low")).otherwise(F.col("high")), F.when(first, F.col("high")).otherwise(F.col("low"))
    return sums.select(
        *keys, src["ip"].alias("src_ip"), dst["ip"].alias("dst_ip"), src["port"].alias("src_port"), dst["port"].alias("dst_port"), "protocol", "start", "end", "n", pick("n_up", "n").alias("fwd_packets"), (F.col("n") - pick("n_up", "n")).alias("bwd_packets"),
        pick("b_up", "bytes").alias("fwd_bytes"), (F.col("bytes") - pick("b_up", "bytes")).alias("bwd_bytes"), pick("d_up", "d").alias("fwd_data_packets"), *FLAGS, "longest", "len2", "len3",
        F.coalesce("pause2", F.lit(0.0)).alias("pause2"), F.coalesce("longest_pause", F.lit(0.0)).alias("longest_pause"),
    )


def _spread(total: Column, squares: Column, n: Column) -> Column:
    """Standard deviation (of the population) from sums."""
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) ** 2))


def _entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    c = df.groupBy(key, value).agg(F.count("*").alias("c"))
    return c.groupBy(key).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def flow_features(packets: DataFrame, width: float) -> DataFrame:
    """Forty-two features of the flows of each window.

    Everything is a sum over flows, but for port steps, which come from the counts of at most 65,536 ports, and
    first-seen edges. Windows without packets give no row. A flow or an edge is new where it is first seen.
    """
    c, d = F.col, lambda x: F.col(x).cast("double")
    flows = packet_flows(windowed(packets, width), ["window"])
    private = internal(c("src_ip")) & internal(c("dst_ip"))
    span = F.greatest(c("end") - c("start"), F.lit(0.001))
    idle = F.greatest(F.lit(float(width)) - (c("end") - c("start")), F.lit(0.0))
    port, ported = c("dst_port"), c("dst_port") > 0
    total, packets_ = c("fwd_bytes") + c("bwd_bytes"), c("fwd_packets") + c("bwd_packets")
    s = flows.groupBy("window").agg(
        F.count("*").alias("flows"), *[F.sum(x).alias(x) for x in ("fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "n", *FLAGS)], F.avg(total / span).alias("byte_rate_mean"), F.max(packets_ / span).alias("packet_rate_max"),
        F.avg(packets_ / span).alias("packet_rate_mean"), F.sum("len2").alias("len2"), F.sum("len3").alias("len3"), F.max("longest").alias("longest"), F.avg("fwd_data_packets").alias("fwd_data_packets_mean"),
        F.sum(c("end") - c("start")).alias("pauses"), F.sum("pause2").alias("pause2"), F.max("longest_pause").alias("pause_max"), F.avg(idle).alias("idle_mean"), F.stddev_pop(idle).alias("idle_std"),
        F.count_if(ported).alias("ported"), F.count_if(ported & (port < 1024)).alias("known"), F.count_if(private).alias("inside"), F.count_if(private & port.isin(*ADMIN_PORTS)).alias("admin"),
        F.count_if(c("bwd_packets") == 0).alias("silent"), F.count_if(total / c("n") < 100).alias("small"), F.count_if(c("protocol") == 6).alias("tcp"), F.count_if(c("protocol") == 17).alias("udp"),
    )
    by_port = flows.where(ported).groupBy("window", "dst_port").agg(F.count("*").alias("c"))
    step = port - F.lag("dst_port").over(Window.partitionBy("window").orderBy("dst_port"))
    ports = by_port.withColumn("step", step).groupBy("window").agg(
        F.count("*").alias("ports"), (F.log2(F.sum("c")) - F.sum(c("c") * F.log2("c")) / F.sum("c")).alias("port_entropy"), F.count_if(c("step") == 1).alias("unit_steps"), F.sum(d("step") ** 2).alias("step2"), (F.max("dst_port") - F.min("dst_port")).alias("range"),
    )
    fanout = _entropy(flows.where(private), "window", "dst_ip").withColumnRenamed("entropy", "fanout_entropy")
    edges = flows.where(private).groupBy("src_ip", "dst_ip").agg(F.min("window").alias("window")).groupBy("window").agg(F.count("*").alias("new_edges"))
    fresh = flows.groupBy("src_ip", "dst_ip", "src_port", "dst_port", "protocol").agg(F.min("window").alias("window")).groupBy("window").agg(F.count("*").alias("new_flows"))
    x = s.join(ports, "window", "left").join(fanout, "window", "left").join(edges, "window", "left").join(fresh, "window", "left")
    none = lambda e: F.coalesce(e, F.lit(0.0)).cast("double")
    n, length = c("n"), c("fwd_bytes") + c("bwd_bytes")
    mean, sd = length / n, _spread(length, c("len2"), n)
    third = c("len3") / n - 3 * mean * c("len2") / n + 2 * mean**3
    steps = c("ported") - 1
    out = {
        "new_flows": none(c("new_flows")), "flows": d("flows"), "fwd_packets": d("fwd_packets"), "bwd_packets": d("bwd_packets"), "fwd_bytes": d("fwd_bytes"), "bwd_bytes": d("bwd_bytes"), "byte_ratio": c("fwd_bytes") / (c("bwd_bytes") + TINY),
        "byte_rate_mean": c("byte_rate_mean"), "packet_rate_max": c("packet_rate_max"), "packet_rate_mean": c("packet_rate_mean"), "packet_ratio": c("fwd_packets") / (c("bwd_packets") + TINY), "length_mean": mean, "length_std": sd,
        "length_max": d("longest"), "length_skew": F.when((n > 2) & (sd > TINY), third / sd**3).otherwise(0.0), "fwd_data_packets_mean": c("fwd_data_packets_mean"), "pause_mean": c("pauses") / n, "pause_std": _spread(c("pauses"), c("pause2"), n),
        "pause_max": c("pause_max"), "idle_mean": c("idle_mean"), "idle_std": c("idle_std"), "syn": d("syn"), "ack": d("ack"), "rst": d("rst"), "psh": d("psh"), "fin": d("fin"), "urg": d("urg"), "syn_ack_ratio": c("syn") / (c("ack") + TINY),
        "rst_syn_ratio": c("rst") / (c("syn") + TINY), "ports": none(c("ports")), "port_entropy": none(c("port_entropy")), "known_port_ratio": none(F.when(c("ported") > 0, c("known") / c("ported"))), "sequential_max": none((c("unit_steps") > 0).cast("double")),
        "sequential_mean": none(F.when(steps > 0, c("unit_steps") / steps)), "port_step_std": none(F.when(steps > 0, _spread(c("range"), c("step2"), steps))), "new_edges": none(c("new_edges")), "fanout_entropy": none(c("fanout_entropy")),
        "admin_ratio": none(F.when(c("inside") > 0, c("admin") / c("inside"))), "silent_ratio": c("silent") / c("flows"), "small_ratio": c("small") / c("flows"), "tcp_ratio": c("tcp") / c("flows"), "udp_ratio": c("udp") / c("flows"),
    }
    return x.select("window", *[v.alias(k) for k, v in out.items()])


def packet_statistics(packets: DataFrame, width: float) -> DataFrame:
    """Order-free packet features of each source host in each window: times to live, pauses, payloads, fan-out, DNS."""
    c = F.col
    p = windowed(packets, width).withColumnRenamed("src_ip", "host").withColumn("dst_port", F.coalesce("dst_port", F.lit(0)))
    pause = c("timestamp") - F.lag("timestamp").over(Window.partitionBy("host", "window").orderBy("timestamp"))
    tcp = c("protocol") == 6
    s = p.withColumn("pause", pause).groupBy("host", "window").agg(
        F.count("*").alias("n"), F.avg("ttl").alias("ttl_mean"), F.stddev_pop("ttl").alias("ttl_std"), F.count_distinct("ttl").alias("ttls"), F.avg(F.when(tcp, c("tcp_window"))).alias("tcp_window_mean"), F.stddev_pop(F.when(tcp, c("tcp_window"))).alias("tcp_window_std"),
        F.avg("pause").alias("pause_mean"), F.stddev_pop("pause").alias("pause_std"), F.avg("payload_length").alias("payload_mean"), F.stddev_pop("payload_length").alias("payload_std"), F.avg((c("payload_length") == 0).cast("int")).alias("payload_zero_ratio"),
        F.count_if((c("protocol") == 17) & (c("dst_port") == 53)).alias("dns_queries"),
    )
    # One row per (destination, port) is all that the fan-out figures need.
    pairs = p.groupBy("host", "window", "dst_ip", "dst_port").agg(F.count("*").alias("c"))
    by_ip = pairs.groupBy("host", "window", "dst_ip").agg(F.count("*").alias("ports"), F.sum("c").alias("c"))
    inside = internal(c("dst_ip"))
    cin = F.when(inside, c("c"))
    fan = by_ip.groupBy("host", "window").agg(
        F.count("*").alias("targets"), F.max("ports").alias("vertical"), F.count_if(inside).alias("targets_inside"), F.count_if(~inside).alias("targets_outside"), (F.log2(F.sum(cin)) - F.sum(cin * F.log2(cin)) / F.sum(cin)).alias("fanout_entropy"),
    )
    flat = pairs.groupBy("host", "window", "dst_port").agg(F.count("*").alias("ips")).groupBy("host", "window").agg(F.max("ips").alias("horizontal"))
    x = s.join(fan, ["host", "window"]).join(flat, ["host", "window"])
    filled = x.na.fill(0.0, ["tcp_window_mean", "tcp_window_std", "pause_mean", "pause_std", "fanout_entropy"])
    return filled.withColumn("pause_cv", c("pause_std") / (c("pause_mean") + 1e-7))


def payload_features(packets: DataFrame, width: float) -> DataFrame:
    """What the payloads of each source host in each window say: web requests and their targets, names asked for.

    Needs ``payload``, which a capture gives if it is asked for. A request is a TCP payload of a web port whose first line begins with a
    verb; a question is a UDP payload of the name port that is long enough. Means are 0 where there is nothing to take them of.
    """
    c, long_enough = F.col, lambda n: F.col("payload_length") >= n
    of_port = lambda ports: F.coalesce(c("src_port").isin(*ports) | c("dst_port").isin(*ports), F.lit(False))
    web, asks = (c("protocol") == 6) & of_port(Y.WEB_PORTS) & long_enough(Y.LEAST_REQUEST), (c("protocol") == 17) & of_port((Y.NAME_PORT,)) & long_enough(Y.LEAST_QUESTION)
    # Payloads of other packets go no further.
    marked = windowed(packets, width).select(c("src_ip").alias("host"), "window", asks.alias("asks"), F.when(web, Y.web_request(c("payload"))).alias("request"), Y.question_name(F.when(asks, c("payload"))).alias("name"))
    told = marked.withColumn("uri", Y.target(c("request")))
    found = told.groupBy("host", "window").agg(
        F.count("request").alias("http_requests"), F.avg(F.when(c("uri").isNotNull(), text_entropy(c("uri")))).alias("http_uri_entropy_mean"), F.avg(Y.special_ratio(c("uri"))).alias("http_special_ratio"),
        F.count_if("asks").alias("dns_queries"), F.count_distinct("name").alias("dns_domains"), F.avg(F.when(c("name").isNotNull(), text_entropy(c("name")))).alias("dns_entropy_mean"),
    )
    return found.na.fill(0.0, ["http_uri_entropy_mean", "http_special_ratio", "dns_entropy_mean"])


def session_ratios(packets: DataFrame, width: float) -> DataFrame:
    """Shares of a host's TCP packets, SYNs and handshakes in each window, of all sessions that it is an end of; 0 where there is nothing to share.

    ``syn_only_ratio`` counts SYNs without any other flag, ``syn_no_response_ratio`` the sessions, one a direction, that were opened
    last and not answered.
    """
    c, end = F.col, lambda k: F.regexp_replace(F.get(F.split("pair", r"\|"), k), r":\d+$", "")
    by_host = _progress(packets, width).withColumn("host", F.explode(F.array_distinct(F.array(end(0), end(1)))))
    names = ("tcp", "retransmitted", "syn", "syn_only", "syn_ack", "unanswered", "rst_after_syn", "completed")
    sums = by_host.groupBy("host", "window").agg(*[F.sum(n).alias(n) for n in names])
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    return sums.select(
        "host", "window", "retransmitted", share("retransmitted", "tcp").alias("retransmission_ratio"), share("syn_only", "tcp").alias("syn_only_ratio"), share("syn_ack", "syn").alias("syn_ack_response_ratio"),
        share("unanswered", "syn").alias("syn_no_response_ratio"), share("rst_after_syn", "syn").alias("rst_after_syn_ratio"), share("completed", "syn").alias("completion_ratio"),
    )


def packet_features(packets: DataFrame, width: float) -> DataFrame:
    """All thirty packet features of each source host in each window; a host without TCP has no retransmissions or ratios, 0."""
    both = ["host", "window"]
    spoken = payload_features(packets, width)
    ratios = session_ratios(packets, width)
    out = packet_statistics(packets, width).drop("dns_queries").join(spoken, both).join(ratios, both, "left")
    return out.na.fill(0, [c for c in ratios.columns if c not in both])


def flow_steps(packets: DataFrame, width: float, idle: float = 30.0) -> DataFrame:
    """What each window adds to each flow, flows living on until they are idle.

    A flow ends after ``idle`` seconds without a packet, not with a window; the next packet of its ends begins a new one. A row is a flow
    in a window in which it has packets: ``start``, ``last`` (so far), ``new_flow``, packets and bytes of either direction that the window
    adds, and as ``total_...`` all of the flow so far. The flow's first packet (by time, then ``seq``) says which end is the source.

    Pauses are found slice by slice (:func:`sliced_segments`), so a flow that holds most packets is no one task's.
    """
    c = F.col
    end = lambda ip, port: F.struct(c(ip).alias("ip"), F.coalesce(c(port), F.lit(0)).alias("port"))
    a, b = end("src_ip", "src_port"), end("dst_ip", "dst_port")
    keys = ["protocol", "low", "high"]
    keyed = packets.select("protocol", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (a <= b).alias("up"), "timestamp", "seq", "packet_length")
    parted = windowed(sliced_segments(keyed, keys, "timestamp", "seq", idle, width, "flow"), width)
    up, size = c("up"), c("packet_length")
    steps = parted.groupBy(*keys, "flow", "window").agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.min(F.struct("timestamp", "seq", "up"))["up"].alias("first_up"),
        F.count_if(up).alias("n_up"), F.count_if(~up).alias("n_down"), F.sum(F.when(up, size).otherwise(0)).alias("b_up"), F.sum(F.when(up, 0).otherwise(size)).alias("b_down"),
    )
    # One row a window of a flow: what follows runs over these.
    flow = Window.partitionBy(*keys, "flow").orderBy("window")
    opened = steps.withColumns({"way": F.first("first_up").over(flow), "start": F.first("first").over(flow), "new_flow": F.row_number().over(flow) == 1})
    source, far = F.when(c("way"), c("low")).otherwise(c("high")), F.when(c("way"), c("high")).otherwise(c("low"))
    pick = lambda x, y: F.when(c("way"), c(x)).otherwise(c(y))
    added = {"fwd_packets": pick("n_up", "n_down"), "bwd_packets": pick("n_down", "n_up"), "fwd_bytes": pick("b_up", "b_down"), "bwd_bytes": pick("b_down", "b_up")}
    rows = opened.select(*keys, "flow", "window", source["ip"].alias("src_ip"), far["ip"].alias("dst_ip"), source["port"].alias("src_port"), far["port"].alias("dst_port"), "start", "last", "new_flow", *[v.alias(k) for k, v in added.items()])
    upto = flow.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "window", "start", "last", "new_flow", *added, *[F.sum(k).over(upto).alias(f"total_{k}") for k in added])


def sessions(packets: DataFrame, width: float) -> DataFrame:
    """TCP progress of each pair of ends in each window: retransmissions, handshakes, resets.

    Inside a window packets go by time, then ``seq``. A SYN without ACK opens a session of its direction. The session
    is answered by the next SYN with ACK from the other side, and completed by the first plain ACK of its own
    side after that; a reset from the other side counts while it is not answered. A packet with a payload is a
    retransmission if its direction has sent a byte beyond its first one since the session was opened, or if it opens one.
    Everything comes from windows over (window, pair), which Spark sorts and may spill.
    """
    return _progress(packets, width).select("window", "pair", "tcp", "retransmitted", "syn", "syn_ack", "rst_after_syn", F.col("syn").alias("attempts"), "completed")


def _progress(packets: DataFrame, width: float) -> DataFrame:
    """What :func:`sessions` gives, with ``syn_only`` and ``unanswered``."""
    c = F.col
    a, b = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    flag = lambda bit: c("tcp_flags").bitwiseAND(bit) > 0
    tcp = windowed(packets.where("protocol = 6"), width).select(
        "window", F.concat_ws("|", F.least(a, b), F.greatest(a, b)).alias("pair"), (a <= b).alias("forth"), "timestamp", "seq", flag(2).alias("s"), flag(16).alias("a"), flag(4).alias("r"), (c("tcp_flags").bitwiseAND(63) == 2).alias("bare"),
        F.coalesce("tcp_seq", F.lit(0)).alias("first"), F.coalesce("payload_length", F.lit(0)).alias("size"),
    )
    order = Window.partitionBy("window", "pair").orderBy("timestamp", "seq")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    opens, answers = c("s") & ~c("a"), c("s") & c("a")
    rows = tcp.withColumn("at", F.row_number().over(order))
    for way, own in (("forth", c("forth")), ("back", ~c("forth"))):
        # When this direction opened its latest session, how many it opened, and when the other side last answered.
        rows = rows.withColumn(f"{way} opened", F.max(F.when(opens & own, c("at"))).over(seen)).withColumn(f"{way} n", F.count(F.when(opens & own, 1)).over(seen)).withColumn(f"{way} answered", F.max(F.when(answers & ~own, c("at"))).over(seen))
    by_way = lambda name, own: F.when(c("forth") == own, c(f"forth {name}")).otherwise(c(f"back {name}"))
    opened, number, answered = (by_way(x, True) for x in ("opened", "n", "answered"))
    completes = c("a") & ~c("s") & (answered > opened)
    other_opened, other_answered = by_way("opened", False), by_way("answered", False)
    resets = c("r") & ~c("s") & ~c("a") & other_opened.isNotNull() & ~F.coalesce(other_answered > other_opened, F.lit(False))
    sent = Window.partitionBy("window", "pair", "forth", "session").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.select("window", "pair", "forth", "timestamp", "seq", "first", "size", opens.alias("opens"), answers.alias("answers"), number.alias("session"), completes.alias("completes"), resets.alias("resets"), "at", "bare")
    repeats = (c("size") > 0) & (c("opens") | F.coalesce(c("first") < F.max(c("first") + c("size")).over(sent), F.lit(False)))
    n = lambda x: F.count_if(x)
    by_session = marked.withColumn("repeats", repeats).groupBy("window", "pair", "forth", "session").agg(
        F.count("*").alias("tcp"), n("repeats").alias("retransmitted"), n("opens").alias("syn"), n("answers").alias("syn_ack"), n("resets").alias("rst_after_syn"), F.max(c("completes").cast("int")).alias("completed"), n("bare").alias("syn_only"),
        F.max(F.when(c("opens"), c("at"))).alias("opened at"), F.max(F.when(c("answers"), c("at"))).alias("answers at"),
    )
    latest = lambda what, forth: F.max(F.when(c("forth") == forth, c(what)))
    lost = lambda forth: F.coalesce((latest("opened at", forth) > F.coalesce(latest("answers at", not forth), F.lit(0))).cast("long"), F.lit(0))
    return by_session.groupBy("window", "pair").agg(
        *[F.sum(x).cast("long").alias(x) for x in ("tcp", "retransmitted", "syn", "syn_ack", "rst_after_syn", "syn_only")], F.sum(F.coalesce("completed", F.lit(0))).cast("long").alias("completed"), (lost(True) + lost(False)).cast("long").alias("unanswered"),
    )
