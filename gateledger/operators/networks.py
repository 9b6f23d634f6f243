"""Addresses against a table of networks, as an equi-join on prefixes.

A network is (version, length, first bits).  An address has one such key for each
length that occurs in the table, of which there are 162 at most, so networks and
addresses meet by equality: no interval or nested-loop join, and no limit on the
number of networks.  Different addresses are looked up once, however often they
occur; the rows then join the answers, whose keys are unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions.principals import ipv4_number

_GROUP = "[0-9a-f]{1,4}"
_FULL = f"^{_GROUP}(?::{_GROUP}){{7}}$"
_SHORT = f"^(?:{_GROUP}(?::{_GROUP}){{0,6}}+)?::(?:{_GROUP}(?::{_GROUP}){{0,6}}+)?$"


def _binary(number: Column, width: int, base: int = 10) -> Column:
    return F.lpad(F.conv(number, base, 2), width, "0")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _ipv6_bits(ip: Column) -> Column:
    def plain(text: Column) -> Column:
        # A dotted tail is two groups.
        dotted = F.regexp_extract(text, r"^[0-9a-f:]*:([0-9.]+)$", 1)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(dotted))
        tail = _let(ipv4_number(dotted), lambda n: F.concat(
            F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n % 65536))))
        return F.when(F.contains(text, F.lit(".")), F.concat(head, tail)).otherwise(text)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def joined(left: Column, right: Column, short: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        return F.when(~short | (missing >= 1), F.array_join(F.transform(filled, lambda g: _binary(g, 16, 16)), ""))

    def bits(text: Column) -> Column:
        short = F.contains(text, F.lit("::"))
        sides = _let(F.split(text, "::", -1), lambda s: F.struct(
            groups(F.get(s, F.lit(0))).alias("left"), groups(F.coalesce(F.get(s, F.lit(1)), F.lit(""))).alias("right")))
        return F.when(text.rlike(_FULL) | text.rlike(_SHORT), _let(sides, lambda s: joined(s["left"], s["right"], short)))

    # A zone index is no part of the address.
    return _let(F.lower(F.regexp_replace(ip, "%[^%]+$", "")), lambda t: _let(plain(t), bits))


def address_bits(ip: Column) -> Column:
    """The 32 or 128 bits of an address as text; null for anything else."""
    return F.when(F.contains(ip, F.lit(":")), _ipv6_bits(ip)).otherwise(_binary(ipv4_number(ip).cast("string"), 32))


def parsed_networks(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``networks`` with width, length and prefix; all null where the text is no network.

    Without a length a network is one address; bits behind the length are ignored.
    """
    text = F.col(cidr)
    given = F.try_to_number(F.regexp_extract(text, r"^[^/]*/([0-9]{1,3})$", 1), F.lit("999")).cast("int")
    staged = networks.withColumn("_bits", address_bits(F.substring_index(text, "/", 1))).withColumn("width", F.length("_bits"))
    staged = staged.withColumn("length", F.when(F.contains(text, F.lit("/")), given).otherwise(F.col("width")))
    good = F.col("length") <= F.col("width")
    return staged.withColumns({
        "prefix": F.when(good, F.left("_bits", F.col("length"))),
        "width": F.when(good, F.col("width")), "length": F.when(good, F.col("length"))}).drop("_bits")


def malformed_networks(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """The rows that name no network."""
    return parsed_networks(networks, cidr).where("prefix is null").drop("width", "length", "prefix")


def network_owners(
    df: DataFrame, networks: DataFrame, ip: str = "client_ip", cidr: str = "cidr", position: str = "position",
    carry: tuple[str, ...] = (), longest: bool = False,
) -> DataFrame:
    """``df`` with the network that holds each address (``network``) and its ``carry`` columns.

    Of several networks the first by ``position`` wins (equal positions: the least
    text), or with ``longest`` the narrowest.  Malformed and null addresses, and
    addresses in no network, have nulls; malformed networks hold nothing.
    """
    nets = parsed_networks(networks, cidr).where(F.col("prefix").isNotNull())
    # At most 33 + 129 pairs, whatever the table's size.
    lengths: dict[int, list[int]] = {}
    for row in nets.select("width", "length").distinct().collect():
        lengths.setdefault(row.width, []).append(row.length)
    held = nets.select(
        "width", "prefix",
        F.struct(*([(-F.col("length")).alias("rank")] if longest else []), F.col(position).alias("position"),
                 F.col(cidr).alias("network"), *carry).alias("net"))
    first = held.groupBy("width", "prefix").agg(F.min("net").alias("net"))
    asked = df.select(F.col(ip).alias("_ip")).where(F.col("_ip").isNotNull()).distinct().withColumn("bits", address_bits(F.col("_ip")))
    of_width = F.lit(None).cast("array<int>")
    for width, some in lengths.items():
        of_width = F.when(F.length("bits") == width, F.array(*map(F.lit, sorted(some)))).otherwise(of_width)
    keys = asked.where(F.col("bits").isNotNull()).select(
        "_ip", F.length("bits").alias("width"), F.explode(of_width).alias("length"), "bits",
    ).select("_ip", "width", F.left("bits", F.col("length")).alias("prefix"))
    answers = keys.join(first, ["width", "prefix"]).groupBy("_ip").agg(F.min("net").alias("_net"))
    return df.join(answers, F.col(ip) == F.col("_ip"), "left").select(
        *[df[c] for c in df.columns], F.col("_net.network").alias("network"), *[F.col(f"_net.{c}").alias(c) for c in carry])
