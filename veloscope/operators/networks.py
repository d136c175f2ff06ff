"""Network join (M11): the most specific network that holds an address, IPv4 and IPv6.

An address becomes the text of its bits. Each different address asks once for every prefix length that the network
table has (33 + 129 at most), so longest-prefix match is one equality join on (family, prefix), spread by prefix, and the
longest hit wins by a partial aggregate; no range join, no sort, no broadcast. Rows get the answer of their address.

Defined cases: an address that is null or no address, and one in no network, has score 0 and no network; bits of a network beyond its
length are ignored; a network without a length is a single address, one that is no network holds nothing; of networks
with the same prefix the one with the highest score counts, then the one flagged. IPv6 may be shortened by "::"; a dotted tail is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

V4 = r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
V6 = r"^(?=.*:)[0-9A-Fa-f:]+$"


def _bits(hexadecimal: Column, width: int) -> Column:
    return F.lpad(F.conv(hexadecimal, 16, 2), width, "0")


def address_bits(ip: Column) -> Column:
    """The bits of an address as text: 32 or 128 digits, null if it is none."""
    octets = F.transform(F.split(ip, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0"))
    v4 = F.when(ip.rlike(V4), F.array_join(octets, ""))
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    halves = F.split(ip, "::")
    head, tail = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    short, given = F.size(halves) == 2, F.size(head) + F.size(tail)
    missing = F.when(short, F.greatest(8 - given, F.lit(0))).otherwise(0)
    whole = F.concat(head, F.array_repeat(F.lit("0"), missing), tail)
    # as written: one "::" at most, no other empty group, groups of four digits at most
    clean = (F.size(halves) <= 2) & ~ip.rlike("^:[^:]|[^:]:$|:::") & F.forall(whole, lambda g: F.length(g) <= 4) & (F.size(whole) == 8) & (~short | (given < 8))
    text = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    v6 = F.when(ip.rlike(V6) & clean, F.concat(_bits(F.substring(text, 1, 16), 64), _bits(F.substring(text, 17, 16), 64)))
    return F.coalesce(v4, v6)


def network_prefix(network: Column) -> Column:
    """struct(family, prefix) of ``address/length``; null if it is no network."""
    parts = F.split(network, "/")
    bits = address_bits(F.get(parts, F.lit(0)))
    length = F.when(F.size(parts) == 1, F.length(bits)).when(F.get(parts, F.lit(1)).rlike("^[0-9]{1,3}$"), F.get(parts, F.lit(1)).cast("int"))
    good = (F.size(parts) <= 2) & (length <= F.length(bits))
    return F.when(good, F.struct(F.length(bits).alias("family"), F.substring(bits, F.lit(1), length).alias("prefix")))


def network_risk(df: DataFrame, networks: DataFrame, ip_col: str = "ip_address") -> DataFrame:
    """``df`` with ip_risk_score, vpn_detected and ip_network of the most specific of ``networks`` (network, ip_risk_score, vpn_detected)."""
    n = networks.select("network", F.col("ip_risk_score").cast("double").alias("score"), F.col("vpn_detected").cast("int").alias("vpn"),
                        network_prefix(F.col("network")).alias("p")).where("p IS NOT NULL")
    n = n.groupBy("p.family", "p.prefix").agg(F.max(F.struct("score", "vpn", "network")).alias("hit"))
    lengths = n.groupBy("family").agg(F.collect_set(F.length("prefix")).alias("lengths"))            # two rows, of 129 numbers at most
    ask = df.select(F.col(ip_col).alias("ip")).distinct().withColumn("bits", address_bits(F.col("ip"))).where("bits IS NOT NULL")
    ask = ask.withColumn("family", F.length("bits")).join(F.broadcast(lengths), "family") \
        .select("ip", "family", "bits", F.explode("lengths").alias("length")) \
        .select("ip", "family", "length", F.substring("bits", F.lit(1), F.col("length")).alias("prefix"))
    hits = ask.join(n, ["family", "prefix"]).groupBy(F.col("ip").alias("_ip")).agg(F.max_by("hit", "length").alias("_hit"))
    out = df.join(hits, F.col(ip_col) == F.col("_ip"), "left")
    return out.select(*df.columns, F.coalesce("_hit.score", F.lit(0.0)).alias("ip_risk_score"),
                      F.coalesce("_hit.vpn", F.lit(0)).alias("vpn_detected"), F.col("_hit.network").alias("ip_network"))
