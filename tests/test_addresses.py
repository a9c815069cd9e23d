"""Addresses of both versions against the standard library, and permutations of them."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidewire.functions import address as A


def _cases():
    rng = random.Random(9)
    out = ["", " ", "::", "::1", " FE80::1%eth0 ", "fe80::1%", "fe80::1%a%b", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":1", "1:", ":::", "12345::", "g::", "::ffff:10.1.2.3", "::ffff:8.8.8.8", "::ffff:100.64.0.1", "::ffff:127.0.0.1"]
    out += ["::1.2.3.4", "1.2.3.4::", "::1.2.3", "::256.1.1.1", "::01.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "64:ff9b:1::5", "64:ff9b::5", "2001:db8::7", "2001:3::1", "2001:20::1", "2002::1", "fd00::1", "ff02::1", "fe80::", "fec0::1", "2606:4700::1111", "100::1", "5f00::", "3fff::1"]
    out += ["0.0.0.0", "127.0.0.1", "10.0.0.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "192.0.0.9", "192.0.0.8", "192.0.0.171", "100.64.1.1", "224.0.0.1", "240.0.0.1", "255.255.255.255", "169.254.9.9", " 8.8.8.8 ", "host", "1.2.3.4%5", "١.2.3.4"]
    for _ in range(300):
        n = rng.getrandbits(128) if rng.random() < 0.5 else rng.getrandbits(64) << rng.choice((0, 32, 64))
        six = ipaddress.IPv6Address(n)
        out += [str(six), six.exploded, str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    nets = [ipaddress.ip_network(c) for c in (*A.PRIVATE_BLOCKS_V6, *A.PUBLIC_WITHIN_V6, *A.RESERVED_V6, A.MULTICAST_V6, *A.PRIVATE_BLOCKS, *A.PUBLIC_WITHIN, A.SHARED_BLOCK)]
    for net in nets:  # the ends of the blocks and what lies beside them
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= n < 1 << net.max_prefixlen:
                out.append(str(type(net[0])(n)))
    return out


def _features(text):
    f = [0.0] * 11 + [1.0]
    try:
        a = ipaddress.ip_address(text.strip())
    except ValueError:
        return f
    f[:7] = [1.0, float(a.version == 4), *map(float, (a.is_private, a.is_global, a.is_multicast, a.is_loopback or a.is_reserved or a.is_unspecified, a.is_link_local))]
    f[7:11] = [x / 255 for x in a.packed[-4:]]
    return f


def test_features_equal_the_library(spark):
    cases = _cases()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, ip string")
    got = {r.i: r for r in rows.withColumn("numbers", A.address_numbers(F.col("ip"))).select("i", F.array(*A.address_features(F.col("numbers"))).alias("f"), A.ipv6_numbers(F.col("ip")).alias("n"), A.site(F.col("ip"), ("10.0.0.0/8", "2001:db8::/32", "fe80::/10")).alias("s")).collect()}
    for i, text in enumerate(cases):
        assert got[i].f == _features(text), text
        try:
            a = ipaddress.ip_address(text.strip())
        except ValueError:
            assert got[i].n is None and got[i].s == "unknown", text
            continue
        inside = any(a in net for net in map(ipaddress.ip_network, ("10.0.0.0/8", "2001:db8::/32", "fe80::/10")) if a.version == net.version)
        assert got[i].s == ("internal" if inside else "external"), text
        if a.version == 6:
            assert (got[i].n.high % 2**64) << 64 | got[i].n.low % 2**64 == int(a), text
        else:
            assert got[i].n is None
    assert got[len(cases)].f == [0.0] * 11 + [1.0]


def test_cohesion_of_both_versions(spark):
    cases = [("172.31.69.25", "172.31.69.30", 0.75), ("172.31.69.25", "8.8.8.8", 0.0), ("1.2.3.4", "1.2.3.4", 1.0), ("200.1.1.1", "200.1.1.1", 1.0), ("2001:db8::1", "2001:db9::2", 0.75), ("::ff00:0", "::ff01:0", 0.25), ("8000::", "0::", 1.0), ("::1", "0.0.0.1", 1.0), ("x", "x", 0.0)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(A.cohesion(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in rows] == [c[2] for c in cases]


def test_permutations_are_bijections(spark):
    every = spark.range(1 << 16).select(A.permuted_number(F.col("id"), 5, 16).alias("p"))
    assert every.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()[:] == (1 << 16, 0, (1 << 16) - 1)
    small = spark.range(256).select(A.permuted_number(F.col("id"), 5, 8).alias("p")).distinct().count()
    assert small == 256
    hosts = spark.createDataFrame([(f"10.{a}.{b}.{c}",) for a in range(4) for b in range(8) for c in range(1, 250)] + [("::1",), ("name",), (None,)], "ip string")
    other = hosts.select("ip", A.permuted_address(F.col("ip"), 1).alias("as"), A.permuted_address(F.col("ip"), 1, keep_network=True).alias("near"))
    rows = other.collect()
    assert len({r["as"] for r in rows}) == len({r.near for r in rows}) == len(rows)
    assert {r.ip: r["as"] for r in rows} == {r.ip: r["as"] for r in other.repartition(7).collect()}
    assert all(r.near.rsplit(".", 1)[0] == r.ip.rsplit(".", 1)[0] for r in rows if r.ip and "." in r.ip)
    assert sum(r["as"] != r.ip for r in rows) > len(rows) - 10 and all(r["as"] == r.ip for r in rows if r.ip in ("::1", "name", None))
    assert {r["as"] for r in hosts.select(A.permuted_address(F.col("ip"), 2).alias("as")).collect()} != {r["as"] for r in rows}
