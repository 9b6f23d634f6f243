"""Headers, owners, levels and network ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gateledger import schema as S
from gateledger.functions import text as X


def header_ci(headers: Column, name: str) -> Column:
    """Exact key first, then any spelling; trimmed; empty when absent."""
    exact = F.try_element_at(headers, F.lit(name))
    entries = F.filter(
        F.map_entries(headers),
        lambda e: (F.lower(e["key"]) == name.lower()) & (F.length(e["value"]) > 0),
    )
    folded = F.get(entries, 0)["value"]
    chosen = F.when(F.length(exact) > 0, exact).otherwise(folded)
    return F.coalesce(X.strip_space(chosen), F.lit(""))


def owner_string(owner_type: Column, owner_id: Column) -> Column:
    return F.when(owner_type == "unresolved", "unresolved").otherwise(
        F.concat(owner_type, F.lit(":"), owner_id)
    )


def usable_principal(folded: Column) -> Column:
    """Non-empty, of bounded length and free of control characters, else null."""
    bad = folded.rlike(r"[\x00-\x1f\x7f]") | (F.length(folded) > S.MAX_PRINCIPAL_CHARS)
    return F.when((F.length(folded) > 0) & ~bad, folded)


def sanitize_principal(value: Column) -> Column:
    """Trimmed, compatibility-folded principal, or null when it is unusable."""
    return usable_principal(
        X.fold_confusables(X.normalize_unicode(X.strip_space(value), "NFKC"))
    )


def _lookup(mapping: Mapping[str, int], key: Column) -> Column:
    pairs: list[Column] = []
    for name, number in mapping.items():
        pairs += [F.lit(name), F.lit(number)]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_classification(value: Column, default: int = 0) -> Column:
    """Alias → 0..4; empty → ``default``; unknown → null."""
    folded = F.upper(X.strip_space(X.normalize_unicode(value, "NFKC")))
    empty = value.isNull() | (F.length(value) == 0)
    return F.when(empty, F.lit(default)).otherwise(_lookup(S.LEVEL_ALIASES, folded))


def level_name(level: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in S.LEVEL_NAMES]), level)


def coerce_risk_tier(value: Column) -> Column:
    """Tier name or ordinal text → 0..3, else null."""
    folded = F.lower(X.strip_space(value.cast("string")))
    names = {name.lower(): i for i, name in enumerate(S.RISK_TIERS)}
    names.update({str(i): i for i in range(len(S.RISK_TIERS))})
    return _lookup(names, folded)


def tier_name(tier: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in S.RISK_TIERS]), tier)


def valid_session_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_.:\-]+\n?$") & (
        F.octet_length(value) <= S.MAX_SESSION_ID_BYTES
    )


def valid_call_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_.:\-]{1,256}$")


def header_value_safe(value: Column) -> Column:
    return value.rlike(r"^[\t\x20-\x7e]*\z")


def ipv4_number(ip: Column) -> Column:
    """Dotted quad → integer; null for anything else."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    well_formed = ip.rlike(rf"^{octet}(\.{octet}){{3}}\z")
    parts = F.split(ip, r"\.")
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.get(parts, i).cast("bigint")
    return F.when(well_formed, total)


def first_network(ip: Column, cidrs: Sequence[str]) -> Column:
    """The first listed network holding ``ip``; malformed addresses match none.

    IPv4 stays native; only rows with a colon reach the Python parser.
    """
    nets = [ipaddress.ip_network(c) for c in cidrs]
    number = ipv4_number(ip)
    arms = [
        F.when(
            number.between(int(n.network_address), int(n.broadcast_address)), F.lit(str(n))
        )
        for n in nets
        if n.version == 4
    ]
    v4 = F.coalesce(*arms) if arms else F.lit(None).cast("string")
    v6_nets = [n for n in nets if n.version == 6]
    if not v6_nets:
        return v4

    @F.pandas_udf(T.StringType())
    def v6_match(values: pd.Series) -> pd.Series:
        def locate(text: str) -> str | None:
            try:
                address = ipaddress.ip_address(text)
            except ValueError:
                return None
            return next((str(n) for n in v6_nets if address in n), None)

        return values.map(locate, na_action="ignore")

    return F.coalesce(v4, v6_match(F.when(F.instr(ip, ":") > 0, ip)))


def ip_in_cidrs(ip: Column, cidrs: Sequence[str]) -> Column:
    return first_network(ip, cidrs).isNotNull()
