"""Keyed MACs, fingerprints and tree hashes as native Column expressions.

HMAC-SHA256 is two ``sha2`` calls over padded keys.  The pads are computed once
on the driver, so the whole MAC stays inside code generation.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 64


@dataclass(frozen=True)
class SigningKey:
    key_id: str
    secret: bytes

    def __post_init__(self) -> None:
        if not self.key_id.strip():
            raise ValueError("a signing key needs a non-blank id")
        if len(self.secret) < 16:
            raise ValueError("a signing key needs at least 16 secret bytes")

    def __repr__(self) -> str:
        return f"SigningKey({self.key_id!r}, <{len(self.secret)} bytes>)"

    def pads(self) -> tuple[bytes, bytes]:
        import hashlib

        secret = self.secret
        if len(secret) > _BLOCK:
            secret = hashlib.sha256(secret).digest()
        secret = secret.ljust(_BLOCK, b"\0")
        return bytes(b ^ 0x36 for b in secret), bytes(b ^ 0x5C for b in secret)


class KeyRing:
    """The signing key plus retired keys that still verify old rows."""

    def __init__(self, active: SigningKey, retired: Iterable[SigningKey] = ()) -> None:
        self.active = active
        self._keys: dict[str, SigningKey] = {active.key_id: active}
        for key in retired:
            self.add_retired(key)

    def add_retired(self, key: SigningKey) -> None:
        if key.key_id in self._keys:
            raise ValueError(f"key id {key.key_id!r} is already in the ring")
        self._keys[key.key_id] = key

    def rotate(self, key: SigningKey) -> None:
        self.add_retired(key)
        self.active = key

    def ids(self) -> list[str]:
        """Active key first, then the others as they were added."""
        rest = [k for k in self._keys if k != self.active.key_id]
        return [self.active.key_id, *rest]

    def keys(self) -> list[SigningKey]:
        return [self._keys[k] for k in self.ids()]

    def secrets(self) -> dict[str, bytes]:
        return {k.key_id: k.secret for k in self.keys()}


def _as_binary(message: Column) -> Column:
    return F.encode(message, "UTF-8")


def hmac_with_pads(ipad: Column, opad: Column, message: Column) -> Column:
    """HMAC-SHA256 hex of a string column under per-row pad columns."""
    inner = F.unhex(F.sha2(F.concat(ipad, _as_binary(message)), 256))
    return F.sha2(F.concat(opad, inner), 256)


def hmac_sha256(key: SigningKey, message: Column) -> Column:
    ipad, opad = key.pads()
    return hmac_with_pads(F.lit(ipad), F.lit(opad), message)


def ring_hmac(ring: KeyRing, key_id: Column, message: Column) -> Column:
    """HMAC under the key each row names; null when the ring lacks that key.

    The pads sit in a literal map (the ring is driver-side configuration), so
    one MAC is computed per row however many keys the ring holds.
    """
    inner_pads: list[Column] = []
    outer_pads: list[Column] = []
    for key in ring.keys():
        ipad, opad = key.pads()
        inner_pads += [F.lit(key.key_id), F.lit(ipad)]
        outer_pads += [F.lit(key.key_id), F.lit(opad)]
    return hmac_with_pads(
        F.try_element_at(F.create_map(*inner_pads), key_id),
        F.try_element_at(F.create_map(*outer_pads), key_id),
        message,
    )


def request_fingerprint(body: Column) -> Column:
    """``sha256:<hex>`` of the raw body, empty when there is no body."""
    empty = body.isNull() | (F.octet_length(body) == 0)
    return F.when(empty, "").otherwise(
        F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))
    )


def anonymize_owner(owner: Column, salt: str) -> Column:
    if not salt:
        raise ValueError("anonymising owners needs a salt")
    digest = F.sha2(_as_binary(F.concat(F.lit(f"{salt}:"), owner)), 256)
    return F.concat(F.lit("owner_"), F.substring(digest, 1, 16))


def leaf_hash(mac: Column) -> Column:
    return F.sha2(_as_binary(mac), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def signed_text(raw_line: Column) -> Column:
    """The text a MAC covers: the canonical line without its ``hmac`` member.

    Keys are sorted, so the first ``,"hmac":"…"`` is the member itself: quotes
    inside the earlier string values are escaped, and ``metadata`` comes later.
    """
    return F.regexp_replace(raw_line, r'(?s)^(.*?),"hmac":"[0-9a-f]*"', "$1")


_CANONICAL = json.JSONEncoder(
    sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False
)


def canonical_json(value: object) -> str:
    """Compact, key-sorted, unescaped JSON; refuses NaN and infinities."""
    return _CANONICAL.encode(value)


_LINE_DEFAULTS: Mapping[str, object] = {
    "approval_chain": [],
    "metadata": {},
    "prev_hmac": "",
    "request_fingerprint": "",
}
_LINE_KEYS = (
    "approval_chain",
    "check_name",
    "decision",
    "entry_id",
    "metadata",
    "owner_id",
    "owner_type",
    "prev_hmac",
    "reason",
    "request_fingerprint",
    "ts_ns",
)


def resigned_text(line: str) -> str | None:
    """Rebuild the covered text from parsed values (re-formatted lines)."""
    try:
        row = json.loads(line)
        known = {k: row[k] if k in row else _LINE_DEFAULTS[k] for k in _LINE_KEYS}
        return canonical_json(known)
    except (ValueError, KeyError, TypeError):
        return None


@F.pandas_udf(T.StringType())
def resigned_text_udf(lines: pd.Series) -> pd.Series:
    """Null in, null out: only rows that failed the fast path carry a value."""
    return lines.map(resigned_text, na_action="ignore")
