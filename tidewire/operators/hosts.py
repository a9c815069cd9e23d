"""Hosts in windows: incidence, attributes, labels, activity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flow import duration, internal, scaled_log, severity, window_risk


def incidence(flows: DataFrame) -> DataFrame:
    """Each flow once per endpoint, seen from it; a flow of a host with itself once, as its source."""
    own = lambda host, peer, source: F.struct(F.col(host).alias("host"), F.col(peer).alias("peer"), F.lit(source).alias("is_src"))
    both = F.array(own("src_ip", "dst_ip", True), own("dst_ip", "src_ip", False))
    ends = F.when(F.col("src_ip") == F.col("dst_ip"), F.slice(both, 1, 1)).otherwise(both)
    return flows.withColumn("end", F.explode(ends)).select("*", "end.*").drop("end")


def window_attributes(flows: DataFrame, width: float, window: str = "window") -> DataFrame:
    """Fifteen attributes of each host in each window of a flow table that has a window column."""
    c, lower = F.col, F.coalesce(F.col("src_ip") <= F.col("dst_ip"), F.col("dst_ip").isNull())  # the source is the lower end; a null is the higher one
    way = lambda a, b: F.sum(F.when(lower, F.col(a)).otherwise(F.col(b)))
    # First a row for two hosts and a window, from which both of them are seen: flows are shuffled once and not once an end.
    pairs = flows.groupBy(F.when(lower, c("src_ip")).otherwise(c("dst_ip")).alias("low"), F.when(lower, c("dst_ip")).otherwise(c("src_ip")).alias("high"), window).agg(
        F.count("*").alias("n"), way("fwd_bytes", "bwd_bytes").alias("up"), way("bwd_bytes", "fwd_bytes").alias("down"), way("fwd_packets", "bwd_packets").alias("pup"), way("bwd_packets", "fwd_packets").alias("pdown"),
        F.count_if(c("protocol") == 6).alias("tcp"), F.count_if(c("protocol") == 17).alias("udp"), F.sum(duration()).alias("seconds"), F.collect_set("dst_port").alias("ports"),
    )
    end = lambda host, peer, way: F.struct(c(host).alias("host"), c(peer).isNotNull().cast("long").alias("peers"), *[c(f"{p}{k}").alias(f"{p}{name}") for p in ("", "p") for k, name in zip(way, ("sent", "received"), strict=True)])
    both = F.array(end("low", "high", ("up", "down")), end("high", "low", ("down", "up")))
    ends = pairs.select(window, "n", "tcp", "udp", "seconds", "ports", F.inline(F.when(c("low") == c("high"), F.slice(both, 1, 1)).otherwise(both)))
    # A row a port, of which a pair's first has its sums: ports, at most 65,536, are then told apart as the sums are added, with no table expanded for distinct counts.
    added = ("n", "sent", "received", "psent", "preceived", "tcp", "udp", "seconds", "peers")
    first = F.coalesce(c("place"), F.lit(0)) == 0
    each = ends.select("host", window, *added, F.posexplode_outer("ports").alias("place", "port")).select("host", window, "port", *[F.when(first, c(x)).alias(x) for x in added])
    sums = each.groupBy("host", window).agg(*[F.sum(x).alias(x) for x in added], F.size(F.collect_set("port")).alias("ports"))
    sums = sums.withColumns({"bytes": c("sent") + c("received"), "packets": c("psent") + c("preceived")})
    one, span = F.lit(1.0), max(1.0, width)
    return sums.select(
        "host", window, scaled_log(c("n"), 10).alias("flows"), scaled_log(c("sent"), 20).alias("sent"), scaled_log(c("received"), 20).alias("received"), scaled_log(c("bytes"), 20).alias("bytes"),
        scaled_log(c("psent"), 10).alias("psent"), scaled_log(c("preceived"), 10).alias("preceived"), scaled_log(c("packets"), 10).alias("packets"), scaled_log(c("peers"), 10).alias("peers"),
        scaled_log(c("ports"), math.log(65536)).alias("ports"), (c("tcp") / c("n")).alias("tcp"), (c("udp") / c("n")).alias("udp"), F.least(one, c("seconds") / c("n") / 300).alias("duration"),
        scaled_log(c("bytes") / span, 15).alias("byte_rate"), scaled_log(c("packets") / span, 10).alias("packet_rate"), F.least(one, c("peers") / c("n")).alias("peer_share"),
    )


def window_labels(flows: DataFrame, window: str = "window") -> DataFrame:
    """Label of each host in each window: the most severe attack category present, and its risk."""
    attack, category = F.col("is_attack"), F.col("coarse_category")
    sums = incidence(flows).groupBy("host", window).agg(F.count("*").alias("n"), F.count_if(attack).alias("n_attack"), F.max(F.when(attack, F.struct(severity(category).alias("s"), category.alias("c"))))["c"].alias("category"))
    return sums.select("host", window, "n", "n_attack", F.coalesce("category", F.lit("Benign")).alias("category"), F.when(F.col("n_attack") > 0, window_risk(F.col("category"), F.col("n_attack"), F.col("n"))).otherwise(0.0).alias("risk"))


def window_techniques(flows: DataFrame, order: list[str], window: str = "window") -> DataFrame:
    """Techniques (an array ``techniques`` a flow) of each host's attacks in each window, each once, in the order in which they first appear.

    Each technique of a window is one row before they are listed, so the list is no longer than the catalogue of techniques.
    """
    named = incidence(flows.where("is_attack")).select("host", window, F.struct(*order).alias("at"), F.posexplode("techniques").alias("place", "technique"))
    first = named.groupBy("host", window, "technique").agg(F.min(F.struct("at", "place")).alias("first"))
    return first.groupBy("host", window).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "technique"))), lambda x: x["technique"]).alias("techniques"))


def labelled_windows(flows: DataFrame, order: list[str], window: str = "window") -> DataFrame:
    """:func:`window_labels` with the techniques of the window's attacks, empty where there are none."""
    found = window_labels(flows, window).join(window_techniques(flows, order, window), ["host", window], "left")
    return found.withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>")))


def activity(flows: DataFrame) -> DataFrame:
    """Activity score of each endpoint; what comes in from outside counts fifty times."""
    inbound = ~internal(F.col("src_ip")) & internal(F.col("dst_ip"))
    source = F.col("fwd_bytes") + 0.25 * F.col("bwd_bytes") + F.col("fwd_packets") + 25
    target = (F.col("bwd_bytes") + 0.25 * F.col("fwd_bytes") + F.col("bwd_packets") + 25) * F.when(inbound, 50).otherwise(1)
    ends = F.explode(F.array(F.struct(F.col("src_ip").alias("host"), source.alias("s")), F.struct(F.col("dst_ip").alias("host"), target.alias("s"))))
    return flows.select(ends.alias("x")).groupBy("x.host").agg(F.sum("x.s").alias("activity"))


def entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """Shannon entropy (bits) of ``value`` within each ``key``."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("c"))
    # H = log2 n - sum(c log2 c) / n needs no second pass over the counts.
    return counts.groupBy(key).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def login_windows(logins: DataFrame, windows: DataFrame, width: float) -> DataFrame:
    """Login figures of each window (``host``, ``start``, ``end``) of at most ``width`` seconds; both ends belong to it.

    Windows and logins meet on the host and a time bucket of the window's width: a window touches two buckets, so each
    login is compared with the windows of its own bucket only.
    """
    c = F.col
    at = lambda x: F.floor(x / width).cast("long")
    spread = windows.select("*", F.explode(F.sequence(at(c("start")), at(c("end")))).alias("bucket"))
    inside = logins.withColumn("bucket", at(c("t"))).join(spread, ["host", "bucket"]).where((c("t") >= c("start")) & (c("t") <= c("end")))
    f, n = c("fails"), c("fails") + c("successes")
    sums = inside.groupBy("host", "start", "end").agg(F.count_if("failed").alias("fails"), F.count_if(~c("failed")).alias("successes"), F.count_distinct("account").alias("users"), F.count_distinct(F.when(c("source") != "", c("source"))).alias("sources"))
    ratio = f / n
    score = 0.5 * F.least(F.lit(1.0), f / 10) + 0.3 * ratio + 0.2 * F.least(F.lit(1.0), c("users") / 5)
    return sums.select("host", "start", "end", "fails", "successes", ratio.alias("ratio"), "users", "sources", score.alias("score"), ((f >= 5) & (ratio >= 0.7)).alias("brute"))


def behaviour(flows: DataFrame) -> DataFrame:
    """Flows of each source by what they look like, and a threat score of the mix."""
    from ..functions.flow import fingerprint

    c, x = F.col, flows.select(F.col("src_ip").alias("host"), fingerprint().alias("f")).select("host", "f.*")
    is_ = lambda name: F.count_if(c("profile") == name)
    sums = x.groupBy("host").agg(F.count("*").alias("n"), is_("InteractiveShell").alias("shells"), is_("BurstRecon").alias("scans"), is_("BulkExfiltration").alias("exfiltrations"), is_("C2Beaconing").alias("beacons"), F.count_if("mismatch").alias("mismatches"))
    score = (0.4 * c("shells") + 0.3 * c("mismatches") + 0.2 * c("beacons") + 0.3 * c("exfiltrations")) / F.greatest(F.lit(1.0), 0.5 * c("n"))
    return sums.withColumn("threat", F.least(F.lit(1.0), score))


def exposure(flows: DataFrame, k: int, window: str = "window") -> DataFrame:
    """How much of each window the last ``k`` flows of a host show: one row of totals.

    Of flows that share time and number, attacks count as the later ones, so that the totals do not depend on how the rows come.
    """
    from pyspark.sql import Window

    c = F.col
    recent = F.row_number().over(Window.partitionBy("host", window).orderBy(F.desc("start_time"), F.desc("seq"), F.desc("is_attack")))
    per = incidence(flows).select("host", window, "is_attack", recent.alias("k")).groupBy("host", window).agg(F.count("*").alias("n"), F.count_if("is_attack").alias("attacks"), F.count_if(c("is_attack") & (c("k") <= k)).alias("shown"))
    return per.agg(F.count("*").alias("windows"), F.count_if(c("n") > k).alias("cut"), F.sum(F.greatest(c("n") - k, F.lit(0))).alias("hidden"), F.count_if((c("attacks") > 0) & (c("shown") == 0)).alias("blind"))


def class_weights(rows: DataFrame, label: str, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Weights of classes: the root of their inverse share, clipped, with geometric mean 1."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    raw = sizes.crossJoin(F.broadcast(total)).select(label, "n", F.least(F.greatest(F.sqrt(F.col("rows") / (F.col("classes") * F.col("n"))), F.lit(low)), F.lit(high)).alias("raw"))
    centre = raw.agg(F.exp(F.avg(F.ln("raw"))).alias("centre"))
    return raw.crossJoin(F.broadcast(centre)).select(label, "n", (F.col("raw") / F.col("centre")).alias("weight"))


def credibility(rows: DataFrame) -> DataFrame:
    """Per-host figures of a labelled series (``host``, ``t``, ``event_id``, ``category``, ``is_attack``) in one row."""
    from pyspark.sql import Window

    c, before = F.col, F.lag("category").over(Window.partitionBy("host").orderBy("t", "event_id"))
    steps = rows.select("host", "category", "is_attack", (before != c("category")).cast("int").alias("turn"))
    cells = steps.groupBy("host", "category").agg(F.count("*").alias("n"), F.count_if("is_attack").alias("attacks"), F.sum("turn").alias("turns"), F.count("turn").alias("steps"))
    hosts = cells.groupBy("host").agg(F.sum("n").alias("n"), F.max("n").alias("modal"), F.sum("attacks").alias("attacks"), F.sum("turns").alias("turns"), F.sum("steps").alias("steps"))
    return hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), (F.sum("attacks") / F.sum("n")).alias("positive_rate"), (F.sum("modal") / F.sum("n")).alias("modal_accuracy"), (F.sum("turns") / F.sum("steps")).alias("churn"),
        F.percentile("n", F.lit(0.5)).alias("median_length"), F.max("n").alias("longest"), F.count_if(c("n") >= 16).alias("long_hosts"),
    )


def missed_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers that a key's sequence leaves out.

    Neighbours are compared inside slices of 4,096 numbers and slices with each other, so one long sequence is many tasks.
    """
    from pyspark.sql import Window

    sliced = rows.select(key, F.col(number).alias("k"), F.floor(F.col(number) / 4096).alias("slice")).distinct()
    per = sliced.groupBy(key, "slice").agg(F.count("*").alias("seen"), F.min("k").alias("low"), F.max("k").alias("high"))
    jump = F.col("low") - F.lag("high").over(Window.partitionBy(key).orderBy("slice")) - 1
    gaps = per.select(key, "seen", (F.col("high") - F.col("low") + 1 - F.col("seen")).alias("inside"), F.coalesce(jump, F.lit(0)).alias("between"))
    return gaps.groupBy(key).agg(F.sum("seen").alias("seen"), F.sum(F.col("inside") + F.col("between")).alias("missed"))


def advice(flows: DataFrame) -> DataFrame:
    """A rule of thumb per internal target about the flows that come in from outside: risk and label."""
    c, inbound = F.col, ~internal(F.col("src_ip")) & internal(F.col("dst_ip"))
    sums = flows.where(inbound).groupBy("dst_ip").agg(F.count("*").alias("n"), F.count_distinct("dst_port").alias("ports"), F.max(c("dst_port").isin(80, 443, 8080)).alias("web"))
    risk = F.least(F.lit(0.96), 0.40 + F.least(F.lit(0.65), c("n") / 75 * 0.50 + 0.25))
    return sums.select(c("dst_ip").alias("host"), "n", risk.alias("risk"), F.when(c("ports") >= 5, "PortScan").when(c("web"), "WebAttack").otherwise("Exploit").alias("label"))


def primary_target(flows: DataFrame, assets: list[str]) -> DataFrame:
    """The host most worth watching, one row: the one with most flows from outside, assets first; else the most active
    asset; else the most active internal host; else the most active one. Equal ones by name."""
    c = F.col
    inbound = flows.where(~internal(c("src_ip")) & internal(c("dst_ip"))).groupBy(c("dst_ip").alias("host")).agg(F.count("*").cast("double").alias("x"))
    active = activity(flows).select("host", c("activity").alias("x"))
    asset = c("host").isin(*assets)
    ranked = inbound.select("host", "x", F.when(asset, 1).otherwise(2).alias("rule")).union(active.select("host", "x", F.when(asset, 3).when(internal(c("host")), 4).otherwise(5).alias("rule")))
    return ranked.orderBy("rule", F.desc(F.round("x", 6)), "host").limit(1)
