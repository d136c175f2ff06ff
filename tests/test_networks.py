import ipaddress
import random

from pyspark.sql import functions as F

from veloscope.operators.networks import address_bits, network_risk


def bits(ip):
    try:
        a = ipaddress.ip_address(ip)
    except (ValueError, TypeError):
        return None
    return None if "." in ip and ":" in ip else f"{int(a):0{a.max_prefixlen}b}"


def test_bits_of_addresses(spark):
    rnd = random.Random(1)
    ips = ["0.0.0.0", "255.255.255.255", "1.2.3", "1.2.3.4.5", "256.1.1.1", "a.b.c.d", "", None, "::", "::1", "1::", "2001:db8::8a2e:370:7334",
           "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:::2", "g::1", "::ffff:1.2.3.4",
           "1:2:3:4:5:6:7::", "FE80::ABCD"]
    ips += [str(ipaddress.IPv6Address(rnd.getrandbits(128) & ~(0xFFFFFFFF << rnd.randrange(90)))) for _ in range(60)]
    ips += [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(40)]
    d = spark.createDataFrame([(i,) for i in ips], "ip string")
    got = {r["ip"]: r["b"] for r in d.select("ip", address_bits(F.col("ip")).alias("b")).collect()}
    wrong = {i: (got[i], bits(i)) for i in ips if got[i] != bits(i)}
    assert not wrong, wrong


def test_most_specific_network_against_all_networks(spark):
    rnd = random.Random(2)
    nets = []
    for _ in range(150):
        v4 = rnd.random() < 0.6
        top = (10 << 24) + rnd.getrandbits(24) if v4 else (0x20010DB8 << 96) + (rnd.getrandbits(4) << 80) + rnd.getrandbits(8)
        length = rnd.choice([0, 8, 12, 16, 24, 31, 32]) if v4 else rnd.choice([0, 32, 44, 48, 120, 128])
        a = ipaddress.IPv4Address(top) if v4 else ipaddress.IPv6Address(top)
        nets.append((f"{a}/{length}", round(rnd.random(), 6), rnd.random() < 0.5))
    nets += [("10.9.8.7", 0.5, True), ("10.0.0.0/33", 0.9, True), ("no network", 0.9, True), (None, 0.9, True), ("10.0.0.0/x", 0.9, True)]
    ips = [str(ipaddress.IPv4Address((10 << 24) + rnd.getrandbits(24))) for _ in range(150)] + ["10.9.8.7", "10.9.8.7", None, "junk", "9.9.9.9", "ffff::"]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rnd.getrandbits(4) << 80) + rnd.getrandbits(8))) for _ in range(150)]
    ips += [n.split("/")[0] for n, *_ in nets[:50]]
    table = []
    for n, s, v in nets:
        try:
            table.append((ipaddress.ip_network(n, strict=False), s, v, n))
        except (ValueError, TypeError, AttributeError):
            continue

    def want(ip):
        if bits(ip) is None:
            return 0.0, 0
        a = ipaddress.ip_address(ip)
        best = max(((n.prefixlen, s, v) for n, s, v, _ in table if n.version == a.version and a in n), default=(0, 0.0, False))
        return best[1], int(best[2])
    d = spark.createDataFrame([(i, ip, "clash") for i, ip in enumerate(ips)], "transaction_id long, ip_address string, family string")
    r = network_risk(d, spark.createDataFrame(nets, "network string, ip_risk_score double, vpn_detected boolean"))
    assert r.columns == [*d.columns, "ip_risk_score", "vpn_detected", "ip_network"]
    got = {x["transaction_id"]: (x["ip_risk_score"], x["vpn_detected"]) for x in r.collect()}
    assert len(got) == len(ips)
    assert not [(ip, got[i], want(ip)) for i, ip in enumerate(ips) if got[i] != want(ip)]
    assert network_risk(d, spark.createDataFrame([], "network string, ip_risk_score double, vpn_detected boolean")).where("ip_risk_score = 0").count() == len(ips)
