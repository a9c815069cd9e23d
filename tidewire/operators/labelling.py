"""Labels of flows and windows: who took part in an attack, at what time, and what heuristics add."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common.store import bounded_broadcast, written
from .hosts import incidence

#: Distinct labels up to which a table of them is broadcast for lenient comparison.
LABELS = 100_000


def flow_hits(flows: DataFrame, label: str, pairs: DataFrame, participants: DataFrame) -> DataFrame:
    """``flows`` with ``hit``: whether a flow belongs to the attack of its interval's ``label``.

    If the label has ``pairs`` (``label``, ``a``, ``b``), the flow's ends have to be one, in either direction; else if it has
    ``participants`` (``label``, ``ip``), one end has to be among them; else null: the interval cannot say. ``flows`` is read several times: best a written table.
    """
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    known = pairs.select(F.col("label").alias("pair label"), F.least("a", "b").alias("low ip"), F.greatest("a", "b").alias("high ip")).distinct().withColumn("by pair", F.lit(True))
    scoped = pairs.select("label", F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(participants.select("label", F.lit(0).alias("p"), F.lit(1).alias("q")))
    scoped = scoped.groupBy(F.col("label").alias("scope label")).agg((F.max("p") == 1).alias("has pairs"), (F.max("q") == 1).alias("has participants"))
    members = participants.select(F.col("label").alias("member label"), "ip").distinct()
    # Labels are few and hold all flows, so their scopes are broadcast; only flows whose label has pairs, or participants, are then shuffled to look for these.
    x = flows.join(bounded_broadcast(written(scoped, "scopes"), LABELS), F.col(label) == F.col("scope label"), "left")
    by_pair, by_member = F.coalesce("has pairs", F.lit(False)), F.coalesce("has participants", F.lit(False))
    paired = x.where(by_pair).join(known, (F.col(label) == F.col("pair label")) & (low == F.col("low ip")) & (high == F.col("high ip")), "left")
    listed = x.where(~by_pair & by_member)
    for end in ("src_ip", "dst_ip"):
        own = members.select(F.col("member label").alias(f"{end} label"), F.col("ip").alias(f"{end} member"))
        listed = listed.join(own, (F.col(label) == F.col(f"{end} label")) & (F.col(end) == F.col(f"{end} member")), "left")
    either = F.col("src_ip member").isNotNull() | F.col("dst_ip member").isNotNull()
    hits = ((paired, F.coalesce("by pair", F.lit(False))), (listed, either), (x.where(~by_pair & ~by_member), F.lit(None).cast("boolean")))
    a, b, c = (rows.select(*flows.columns, hit.alias("hit")) for rows, hit in hits)
    return a.unionByName(b).unionByName(c)


def scoped_category(is_attack: Column, hit: Column, category: Column) -> Column:
    """Category of a flow in an interval: its attack's where it took part, Benign where not, UNKNOWN where nobody can say."""
    return F.when(~is_attack, "Benign").when(hit.isNull(), "UNKNOWN").when(hit, category).otherwise("Benign")


def plain(label: Column) -> Column:
    """A label's letters and digits in lower case."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")


def lenient_matches(labels: DataFrame, table: DataFrame, label: str, name: str) -> DataFrame:
    """Pairs of a distinct ``label`` and the ``name``s of a table that mean it: equal but for case and punctuation, else those of
    which one holds the other. Both sides are dictionaries of labels, compared as such and not row by row; a table of more than
    ``LABELS`` different names is no dictionary, and refused.
    """
    left = labels.select(F.col(label).alias("label")).distinct().withColumn("want", plain(F.col("label")))
    right = table.select(F.col(name).alias("name")).distinct().withColumn("have", plain(F.col("name"))).where("have <> ''")
    few = bounded_broadcast(right, LABELS)
    if few is right:
        raise ValueError(f"more than {LABELS} different names")
    both = left.join(few, F.col("want").contains(F.col("have")) | F.col("have").contains(F.col("want")))
    equal = both.where("want = have")
    rest = both.join(equal.select("label").distinct(), "label", "left_anti")
    return equal.select("label", "name").unionByName(rest.select("label", "name"))


def with_participants(intervals: DataFrame, table: DataFrame) -> DataFrame:
    """``intervals`` (``label``, ``participants``) whose participants are null filled from a table (``name``, ``ip``) by lenient names."""
    matches = lenient_matches(intervals.where("participants is null"), table, "label", "name")
    found = table.join(matches, "name").groupBy("label").agg(F.array_sort(F.collect_set("ip")).alias("found ips"))
    return intervals.join(found, "label", "left").withColumn("participants", F.coalesce("participants", "found ips")).drop("found ips")


def local_time(stamp: Column, shift: float, afternoon_below: int = 8) -> Column:
    """Epoch seconds of a local ``dd/MM/yyyy HH:mm:ss``: hours below ``afternoon_below`` are of the afternoon; null if malformed."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(stamp), r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", k), F.lit("")).cast("int")
    hour = F.when(part(4) < afternoon_below, part(4) + 12).otherwise(part(4))
    valid = part(2).between(1, 12) & part(1).between(1, 31) & (part(3) > 2000) & (hour <= 23)
    t = F.try_make_timestamp_ntz(part(3), part(2), part(1), hour, part(5), part(6).cast("decimal(8,6)"))
    return F.when(valid, F.unix_seconds(t.cast("timestamp")).cast("double") + shift)


def attacked_hosts(flows: DataFrame, role: str) -> DataFrame:
    """Attack flows per host in one role: ``target``, ``source`` or ``either`` end of the flow."""
    if role not in ("target", "source", "either"):
        raise ValueError(f"no role {role!r}")
    x = incidence(flows.where("is_attack"))
    own = {"target": F.col("host") == F.col("dst_ip"), "source": F.col("host") == F.col("src_ip"), "either": F.lit(True)}[role]
    return x.where(own).groupBy("host").agg(F.count("*").alias("n"))


def unlabelled(flows: DataFrame) -> DataFrame:
    """Flows as a live sensor gives them: no attack, category UNKNOWN, label UNLABELED."""
    return flows.withColumns({"is_attack": F.lit(False), "coarse_category": F.lit("UNKNOWN"), "raw_label": F.lit("UNLABELED")})


def label_days(intervals: DataFrame, key: str, t: str, weight: str) -> DataFrame:
    """The day of the month that holds most of a key's labelled rows (each interval counts once at least), the lower of equal ones."""
    days = intervals.groupBy(key, F.dayofmonth(F.timestamp_seconds(F.col(t))).alias("day")).agg(F.sum(F.greatest(F.col(weight), F.lit(1))).alias("n"))
    return days.groupBy(key).agg(F.max(F.struct("n", (-F.col("day")).alias("low")))["low"].alias("low")).select(key, (-F.col("low")).alias("day"))


def augmented(labels: DataFrame) -> DataFrame:
    """Window labels (``is_attack``, ``category``, ``techniques``, ``risk``) overruled by logins and behaviour.

    Five failed logins or a brute-force flag make CredentialAccess; a shell or two port mismatches make an attack, Execution where
    nothing else was known. Columns read: ``brute_force``, ``failed``, ``brute_score``, ``shell``, ``mismatches``, ``threat``.
    """
    guessed = F.coalesce((F.col("brute_force") == 1) | (F.col("failed") >= 5), F.lit(False))
    odd = F.coalesce((F.col("shell") == 1) | (F.col("mismatches") >= 2), F.lit(False))
    first = lambda technique, to: F.when(F.array_contains(to, technique), to).otherwise(F.concat(F.array(F.lit(technique)), to))
    category = F.when(guessed, "CredentialAccess").otherwise(F.col("category"))
    techniques = F.when(guessed, first("T1110", F.col("techniques"))).otherwise(F.col("techniques"))
    risk = F.when(guessed, F.greatest("risk", F.least(F.lit(1.0), 0.75 + 0.25 * F.coalesce("brute_score", F.lit(0.5))))).otherwise(F.col("risk"))
    step = labels.withColumns({"category": category, "techniques": techniques, "risk": risk, "is_attack": F.col("is_attack") | guessed})
    return step.withColumns(
        {
            "category": F.when(odd & (F.col("category") == "Benign"), "Execution").otherwise(F.col("category")),
            "techniques": F.when(odd, first("T1059", F.col("techniques"))).otherwise(F.col("techniques")),
            "risk": F.when(odd, F.greatest("risk", F.least(F.lit(1.0), 0.65 + 0.35 * F.coalesce("threat", F.lit(0.5))))).otherwise(F.col("risk")),
            "is_attack": F.col("is_attack") | odd,
        }
    )


#: How each packet feature is brought to [0, 1]: as a ratio, divided, or by log1p over a scale.
PACKET_SCALES = {
    "ttl_mean": ("div", 255.0),
    "ttl_std": ("div", 128.0),
    "ttls": ("log1p of", 64),
    "tcp_window_mean": ("div", 65535.0),
    "tcp_window_std": ("div", 32768.0),
    "retransmitted": ("log", 10.0),
    "retransmission_ratio": ("ratio", 1.0),
    "pause_mean": ("div", 2.0),
    "pause_std": ("div", 2.0),
    "pause_cv": ("div", 4.0),
    "payload_mean": ("div", 1500.0),
    "payload_std": ("div", 750.0),
    "payload_zero_ratio": ("ratio", 1.0),
    "targets": ("log", 10.0),
    "vertical": ("log1p of", 65535),
    "horizontal": ("log", 10.0),
    "syn_only_ratio": ("ratio", 1.0),
    "syn_ack_response_ratio": ("ratio", 1.0),
    "syn_no_response_ratio": ("ratio", 1.0),
    "rst_after_syn_ratio": ("ratio", 1.0),
    "completion_ratio": ("ratio", 1.0),
    "http_requests": ("log", 10.0),
    "http_uri_entropy_mean": ("div", 8.0),
    "http_special_ratio": ("ratio", 1.0),
    "dns_queries": ("log", 10.0),
    "dns_domains": ("log", 10.0),
    "dns_entropy_mean": ("div", 8.0),
    "targets_inside": ("log", 10.0),
    "targets_outside": ("log", 10.0),
    "fanout_entropy": ("div", 16.0),
}


def normal_packet_feature(name: str, value: Column) -> Column:
    """A packet feature in [0, 1]; 0 where it is null, not finite or not positive."""
    kind, scale = PACKET_SCALES[name]
    v = value.cast("double")
    scaled = {"ratio": v, "div": v / scale, "log": F.log1p(v) / scale, "log1p of": F.log1p(v) / F.log1p(F.lit(float(scale)))}[kind]
    return F.when(v.isNull() | F.isnan(v) | (v <= 0) | (v == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), scaled))


def masked(values: Column, names: list[str], drop: Iterable[str]) -> Column:
    """A feature array with the named features zeroed; an unknown name is an error."""
    drop = set(drop)
    if unknown := drop - set(names):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    keep = F.array(*[F.lit(0.0 if n in drop else 1.0) for n in names])
    return F.zip_with(values, keep, lambda v, k: v * k)
