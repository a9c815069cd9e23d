"""Addresses as columns: numbers, blocks, features, keys."""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BYTE = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"^{_BYTE}(\.{_BYTE}){{3}}$"
#: Groups of an IPv6 address beside its shortened middle, and an address that ends in an IPv4 one.
_GROUPS = "^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"
_TAIL = r"^(.*:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$"


def _block(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


# Special blocks of IPv4 by registry.
PRIVATE_BLOCKS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32")
PUBLIC_WITHIN = ("192.0.0.9/32", "192.0.0.10/32")
SHARED_BLOCK, MULTICAST, LINK_LOCAL = "100.64.0.0/10", "224.0.0.0/4", "169.254.0.0/16"
RESERVED = ("127.0.0.0/8", "240.0.0.0/4", "0.0.0.0/32")
# Special blocks of IPv6 by registry; IPv4 addresses are mapped into the last.
PRIVATE_BLOCKS_V6 = ("::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
PUBLIC_WITHIN_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MULTICAST_V6, LINK_LOCAL_V6, MAPPED = "ff00::/8", "fe80::/10", "::ffff:0:0/96"
RESERVED_V6 = ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")


def dotted_parts(ip: Column) -> Column:
    """The four numbers of a dotted text as an array, bytes or not; null for anything else."""
    return F.when(F.trim(ip).rlike(r"^[0-9]{1,9}(\.[0-9]{1,9}){3}$"), F.transform(F.split(F.trim(ip), r"\."), lambda x: x.cast("long")))


def ipv4_number(ip: Column, beyond: str | None = None) -> Column:
    """An IPv4 address as a number, null for anything else.

    Hosts that are made from keys may have numbers beyond 255: ``carry`` them into the number before, or ``clip`` them, which leaves the
    other three as they are. Without ``beyond`` such text is no address.
    """
    if beyond not in (None, "carry", "clip"):
        raise ValueError(f"no way {beyond!r}")
    o = dotted_parts(ip) if beyond else F.split(F.trim(ip), r"\.")
    whole = lambda k: F.get(o, F.lit(k)).cast("long")
    part = (lambda k: F.least(whole(k), F.lit(255))) if beyond == "clip" else whole
    number = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    return F.when(o.isNotNull(), number) if beyond else F.when(F.trim(ip).rlike(V4), number)


def in_blocks(number: Column, *cidrs: str) -> Column:
    out = F.lit(False)
    for low, high in map(_block, cidrs):
        out = out | number.between(low, high)
    return out


def _private_v4(n: Column) -> Column:
    return in_blocks(n, *PRIVATE_BLOCKS) & ~in_blocks(n, *PUBLIC_WITHIN)


def ipv6_numbers(ip: Column) -> Column:
    """An IPv6 address as a struct of two signed longs, ``high`` and ``low``; null for anything else. A zone is left out."""
    text = F.lower(F.trim(ip))
    empty = F.array().cast("array<string>")
    groups = lambda side: F.when(side == "", empty).otherwise(F.split(side, ":"))
    half = lambda whole, k: F.conv(F.array_join(F.transform(F.slice(whole, k, 4), lambda g: F.lpad(g, 4, "0")), ""), 16, -10).cast("long")

    def without_tail(named: Column) -> Column:
        # An IPv4 end counts as two groups; one that is no address leaves its dots, which no group has.
        tail = ipv4_number(F.regexp_extract(named, _TAIL, 2))
        last = lambda n: F.concat(F.regexp_extract(named, _TAIL, 1), F.lower(F.concat_ws(":", F.hex(F.shiftright(n, 16)), F.hex(n.bitwiseAND(0xFFFF)))))
        return F.when(named.contains(":") & named.contains("."), _named(tail, lambda n: F.when(n.isNotNull(), last(n)).otherwise(named))).otherwise(named)

    def of_sides(sides: Column) -> Column:
        left, right = F.get(sides, 0), F.coalesce(F.get(sides, 1), F.lit(""))
        ok = (F.size(sides) <= 2) & left.rlike(_GROUPS) & right.rlike(_GROUPS)
        return F.when(ok, _named(F.struct(groups(left).alias("l"), groups(right).alias("r"), F.size(sides).alias("n")), of_groups))

    def of_groups(g: Column) -> Column:
        given = F.size(g["l"]) + F.size(g["r"])
        whole = F.concat(g["l"], F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), g["r"])
        fits = F.when(g["n"] == 1, given == 8).otherwise(given <= 7)
        return F.when(fits, _named(whole, lambda w: F.struct(half(w, 1).alias("high"), half(w, 5).alias("low"))))

    named = F.when(text.contains(":") & text.rlike("^[^%]*(%[^%]+)?$"), F.substring_index(text, "%", 1))
    plain = _named(named, without_tail)
    return F.when(plain.contains(":"), _named(F.split(plain, "::", -1), of_sides))


def _named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used: a one-element transform names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def in_blocks_v6(numbers: Column, *cidrs: str) -> Column:
    """Whether the two longs of an address lie in one of the blocks: their leading bits are those of the block."""
    out = F.lit(False)
    for net in map(ipaddress.ip_network, cidrs):
        low = (1 << 64) - 1
        base, mask = int(net.network_address), int(net.netmask)
        inside = numbers["high"].bitwiseAND(_signed(mask >> 64)) == _signed(base >> 64)
        if mask & low:
            inside = inside & (numbers["low"].bitwiseAND(_signed(mask & low)) == _signed(base & low))
        out = out | inside
    return out


def site(ip: Column, inside: tuple[str, ...], beyond: str | None = None) -> Column:
    """``internal``, ``external`` or ``unknown`` (no address) by the blocks of a site, of either version; ``beyond`` as in :func:`ipv4_number`."""
    return site_of(address_numbers(ip, beyond), inside)


def site_of(numbers: Column, inside: tuple[str, ...]) -> Column:
    """:func:`site` of a column of :func:`address_numbers`."""
    n, wide = numbers["v4"], [c for c in inside if ":" in c]
    narrow = F.when(in_blocks(n, *[c for c in inside if ":" not in c]), "internal").otherwise("external")
    return F.when(n.isNotNull(), narrow).when(numbers["v6"].isNull(), "unknown").when(in_blocks_v6(numbers["v6"], *wide), "internal").otherwise("external")


def address_numbers(ip: Column, beyond: str | None = None) -> Column:
    """An address of either version as a struct of ``v4`` and ``v6``, one of them null at least; ``beyond`` as in :func:`ipv4_number`."""
    return F.struct(ipv4_number(ip, beyond).alias("v4"), ipv6_numbers(ip).alias("v6"))


def address_features(numbers: Column) -> list[Column]:
    """Twelve features of an address: valid, IPv4, private, global, multicast, reserved, link-local, the last four bytes, bias.

    ``numbers`` is a column of :func:`address_numbers`, by ``store.once``, so that a text is read once for all of them. Anything that is no address has the bias
    only. An IPv4 address that is mapped into IPv6 is private or global as itself, and otherwise an IPv6 one.
    """
    n, wide = numbers["v4"], numbers["v6"]
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    either = lambda four, six: F.when(n.isNotNull(), four).when(wide.isNotNull(), six)
    mapped, inner = in_blocks_v6(wide, MAPPED), wide["low"].bitwiseAND(0xFFFFFFFF)
    private_v6 = F.when(mapped, _private_v4(inner)).otherwise(in_blocks_v6(wide, *PRIVATE_BLOCKS_V6) & ~in_blocks_v6(wide, *PUBLIC_WITHIN_V6))
    loopback = in_blocks_v6(wide, "::1/128", "::/128") | (mapped & in_blocks(inner, RESERVED[0]))
    byte = lambda k: F.coalesce(F.shiftright(either(n, inner), 24 - 8 * k).bitwiseAND(255) / 255, F.lit(0.0))
    return [
        flag(n.isNotNull() | wide.isNotNull()), flag(n.isNotNull()), flag(either(_private_v4(n), private_v6)), flag(either(~_private_v4(n) & ~in_blocks(n, SHARED_BLOCK), ~private_v6)), flag(either(in_blocks(n, MULTICAST), in_blocks_v6(wide, MULTICAST_V6))),
        flag(either(in_blocks(n, *RESERVED), loopback | in_blocks_v6(wide, *RESERVED_V6))), flag(either(in_blocks(n, LINK_LOCAL), in_blocks_v6(wide, LINK_LOCAL_V6))), *[byte(k) for k in range(4)], F.lit(1.0),
    ]


def address_feature_array(numbers: Column) -> Column:
    """:func:`address_features` as one array. It is computed by expressions and not by generated code, which for all features at once gets too long for Java to compile."""
    return _named(numbers, lambda n: F.array(*address_features(n)))


def dotted_cohesion(a: Column, b: Column) -> Column:
    """Share of leading numbers that two dotted texts have in common, bytes or not; 0 where one is none."""
    x, y = dotted_parts(a), dotted_parts(b)
    same = lambda k: (F.slice(x, 1, k) == F.slice(y, 1, k)).cast("int")
    return F.coalesce(sum((same(k) for k in range(1, 5)), F.lit(0)) / 4, F.lit(0.0))


def cohesion(a: Column, b: Column) -> Column:
    """Share of leading bytes that two addresses have in common, of the four bytes that are features: the last four of an IPv6 address; 0 where one is none."""
    last = lambda ip: F.coalesce(ipv4_number(ip), ipv6_numbers(ip)["low"].bitwiseAND(0xFFFFFFFF))
    x, y = last(a), last(b)
    same = lambda k: (F.shiftright(x, 32 - 8 * k) == F.shiftright(y, 32 - 8 * k)).cast("int")
    return F.coalesce(sum((same(k) for k in range(1, 5)), F.lit(0)) / 4, F.lit(0.0))


def _mixed(half: Column, key: int, bits: int) -> Column:
    """A number of ``bits`` bits that depends on all of ``half`` and the key."""
    return F.shiftright(half * 2_654_435_761 + key, 11).bitwiseAND((1 << bits) - 1)


def round_keys(seed: int, rounds: int = 4) -> list[int]:
    """Keys of the rounds of a permutation, from its seed."""
    return [int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16) for k in range(rounds)]


def permuted_number(n: Column, seed: int, bits: int = 32) -> Column:
    """A bijection of the numbers of ``bits`` bits (an even number up to 32): rounds that change one half by the other.

    Each round can be undone, so different numbers stay different, whichever are there and wherever they lie: no sort, no table.
    """
    half = bits // 2
    left, right = F.shiftright(n, half), n.bitwiseAND((1 << half) - 1)
    for key in round_keys(seed):
        left, right = right, left.bitwiseXOR(_mixed(right, key, half))
    return F.shiftleft(left, half) + right


def permuted_address(ip: Column, seed: int, keep_network: bool = False) -> Column:
    """An IPv4 address under another: of all of them, or with ``keep_network`` of its /24 by a permutation that all networks share.

    Addresses that differ stay different. Text that is no IPv4 address stays as it is, and no address becomes such text.
    """
    n = ipv4_number(ip)
    other = F.shiftleft(F.shiftright(n, 8), 8) + permuted_number(n.bitwiseAND(255), seed, 8) if keep_network else permuted_number(n, seed)
    text = F.concat_ws(".", *[F.shiftright(other, 24 - 8 * k).bitwiseAND(255).cast("string") for k in range(4)])
    return F.when(n.isNotNull(), text).otherwise(ip)


def stable_id(text: Column, n: int) -> Column:
    """A number below ``n`` from the SHA-256 of a text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), F.lit(n))


def text_entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of a text; 0 for none."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))).otherwise(0.0)


def request(line: Column) -> Column:
    """Verb and target of an HTTP request line; nulls for other text."""
    pattern = r"^(GET|POST|HEAD|PUT) (\S+)"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("verb"), F.regexp_extract(line, pattern, 2).alias("target")))


def first_containing(points: DataFrame, spans: DataFrame, t: str, width: float) -> DataFrame:
    """``points`` with ``span``: the first span (``span``, ``start``, ``end``) that contains their time, ends included.

    Of the spans that end no earlier than a point, the one that starts first contains it, or none does. So a running minimum over points and
    ends on one line finds it, in slices of ``width`` and with one row a slice for what ends later: no pairs, however many spans overlap.
    """
    cut, first = F.floor(F.col("at") / width), F.struct("start", "span")
    row = points.select(F.col(t).cast("double").alias("at"), F.lit(0).alias("kind"), F.struct(*points.columns).alias("row"))
    ends = spans.where("start is not null and end is not null").select(F.col("end").cast("double").alias("at"), F.lit(1).alias("kind"), first.alias("first"))
    line = row.unionByName(ends, allowMissingColumns=True).withColumn("slice", cut)
    firsts = ends.groupBy(cut.alias("slice")).agg(F.min("first").alias("first"))
    slices = row.select(cut.alias("slice")).distinct().unionByName(firsts, allowMissingColumns=True).groupBy("slice").agg(F.min("first").alias("first"))
    later = slices.select(F.col("slice").alias("own slice"), F.min("first").over(Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    ahead = Window.partitionBy("slice").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("first", F.min("first").over(ahead)).where("kind = 0").join(later, F.col("slice").eqNullSafe(F.col("own slice")))
    best = F.least("first", "later")  # least leaves nulls out
    return found.select("row.*", F.when(best["start"] <= F.col("at"), best["span"]).alias("span"))


def site_profile(given: dict) -> dict:
    """A site's settings: address blocks, assets, times to live, with what was not given set to its default; unknown keys are refused."""
    default = {"inside": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"], "assets": [], "node_ttl": 120.0, "edge_ttl": 60.0, "max_nodes": 500}
    if unknown := set(given) - set(default):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = default | given
    for block in out["inside"]:
        _block(block)
    return out
