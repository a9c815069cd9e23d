"""Column expressions on flows and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contract import EARLIEST, LATEST, QUIET_PORTS, SEVERITY, SHELL_PORTS, STAGES, UNKNOWN_SEVERITY, WEB_PORTS


def scaled_log(x: Column, d: float) -> Column:
    """log(1 + x) / d, at most 1."""
    return F.least(F.lit(1.0), F.log1p(x) / d)


def duration() -> Column:
    return F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))


def rate(total: Column) -> Column:
    """Per second; the total itself for a flow without duration."""
    return F.when(duration() > 0, total / duration()).otherwise(total.cast("double"))


def edge_features() -> list[Column]:
    """Twelve features of a flow: volumes, duration, rates, protocol, port, asymmetry."""
    fb, bb, fp, bp = (F.col(c) for c in ("fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets"))
    port = F.least(F.greatest(F.col("dst_port"), F.lit(0)), F.lit(65535))
    flag = lambda n: (F.col("protocol") == n).cast("double")
    return [
        F.log1p(fb) / 20, F.log1p(bb) / 20, F.log1p(fp) / 10, F.log1p(bp) / 10, F.least(duration(), F.lit(300.0)) / 300, F.log1p(rate(fb + bb)) / 20, F.log1p(rate(fp + bp)) / 10,
        flag(6), flag(17), flag(1), F.log1p(port) / F.log1p(F.lit(65535)), (fb - bb) / (fb + bb + 1e-5),
    ]


def fingerprint() -> Column:
    """What a flow looks like: the first rule that fits, as a struct of profile, mismatch and confidence."""
    fb, bb, fp, bp, port = (F.col(c) for c in ("fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets", "dst_port"))
    total, packets = fb + bb, fp + bp
    size = lambda b, p: b / F.greatest(p, F.lit(1))
    web = port.isin(*WEB_PORTS)
    asymmetry = (fb - bb) / (total + 1e-5)
    plain = ~web & (duration() >= 2) & (fp >= 4) & (bp >= 4) & (size(fb, fp) <= 250) & (size(bb, bp) <= 350) & (total < 50000)
    hidden = web & (duration() >= 10) & (fp >= 15) & (bp >= 15) & (size(fb, fp) <= 200) & (size(bb, bp) <= 250) & (total < 50000)
    recon = (duration() <= 0.5) & (packets <= 3) & (bp <= 1)
    exfiltration = (fb > 30000) & (asymmetry > 0.75) & (size(fb, fp) > 800)
    beacon = (total <= 1200) & fp.between(1, 3) & bp.between(1, 3) & (size(total, packets) < 180)

    def result(name, mismatch: Column, confidence) -> Column:
        return F.struct(name.alias("profile"), mismatch.alias("mismatch"), F.lit(confidence).alias("confidence"))

    off_port = ~port.isin(*SHELL_PORTS)
    shell = result(F.lit("InteractiveShell"), off_port, F.when(off_port, 0.92).otherwise(0.85))

    return (
        F.when(plain | hidden, shell)
        .when(recon, result(F.lit("BurstRecon"), F.lit(False), 0.90))
        .when(exfiltration, result(F.lit("BulkExfiltration"), port.isin(*QUIET_PORTS), 0.95))
        .when(beacon, result(F.lit("C2Beaconing"), ~web, 0.80))
        .otherwise(result(F.when(web, "BenignWeb").otherwise("Unknown"), F.lit(False), 0.70))
    )


def invalid_time(t: Column) -> Column:
    return t.isNull() | F.isnan(t) | (t < EARLIEST) | (t > LATEST)


def internal(ip: Column) -> Column:
    """Private IPv4 addresses by their prefix."""
    return ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)")


def direction(src: Column, dst: Column) -> Column:
    a, b = internal(src), internal(dst)
    return F.when(~a & b, "inbound").when(a & ~b, "outbound").otherwise("internal")


def _lookup(values: dict[str, float], key: Column, other: float | None) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(other))


def severity(category: Column) -> Column:
    return _lookup(SEVERITY, category, UNKNOWN_SEVERITY)


def window_risk(category: Column, n_attack: Column, n: Column) -> Column:
    """Risk of an attacked window: severity, share of attack flows, volume."""
    density, volume = F.least(F.lit(1.0), n_attack / F.greatest(n, F.lit(1))), F.least(F.lit(1.0), F.log1p(n_attack) / 5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.2), severity(category) + 0.04 * density + 0.04 * volume))


def plausibility(before: Column, after: Column) -> Column:
    """How likely one category follows another."""
    order = {name: float(k) for k, name in enumerate(STAGES)}
    a, b = _lookup(order, before, None), _lookup(order, after, None)
    forward = F.round(F.greatest(F.lit(0.2), 0.95 - 0.15 * (b - a)), 4)
    return F.when(a.isNull() | b.isNull(), 0.1).when(a == b, 0.85).when(b > a, forward).otherwise(0.2)


def special_share(text: Column) -> Column:
    """Share of characters other than letters, digits, slash, dot, dash and underscore."""
    return F.length(F.regexp_replace(text, r"[A-Za-z0-9/._-]", "")) / F.greatest(F.length(text), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
