"""Receipts: a MAC over a stored row, handed out as one header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateledger.functions.crypto import KeyRing, hmac_sha256, ring_hmac, signed_text

ALGORITHM = "hmac-sha256"
VERSION = "v1"


def issue_receipts(df: DataFrame, ring: KeyRing, tag: str = "gateledger") -> DataFrame:
    """(entry_id, header) for sealed rows, under the active key."""
    sig = hmac_sha256(ring.active, signed_text(F.col("raw_line")))
    header = F.concat(
        F.lit(f"{tag}={VERSION}; alg={ALGORITHM}; entry="), F.col("entry_id"),
        F.lit(f"; key={ring.active.key_id}; sig="), sig,
    )
    return df.select("entry_id", header.alias("header"))


def parse_receipt(header: Column, tag: str = "gateledger") -> Column:
    """struct<alg, entry, key, sig>, or null for a bad header.

    Pairs split on ``;``; the version must be known; a missing ``alg`` means
    HMAC; the last of repeated names counts.
    """
    pairs = F.filter(
        F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 0
    )
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("v"),
        ),
    )

    def member(name: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["k"] == name), F.lit(-1))["v"]

    complete = (
        (member(tag) == VERSION)
        & member("entry").isNotNull()
        & member("key").isNotNull()
        & member("sig").isNotNull()
    )
    return F.when(
        complete,
        F.struct(
            F.coalesce(member("alg"), F.lit(ALGORITHM)).alias("alg"),
            member("entry").alias("entry"), member("key").alias("key"), member("sig").alias("sig"),
        ),
    )


def verify_receipts(
    receipts: DataFrame, df: DataFrame, ring: KeyRing, tag: str = "gateledger"
) -> DataFrame:
    """Add ``valid`` and ``problem`` to receipts (entry_id, header)."""
    rows = df.select("entry_id", "raw_line")
    joined = receipts.join(rows, "entry_id", "left").withColumn(
        "_r", parse_receipt(F.col("header"), tag)
    )
    expected = ring_hmac(ring, F.col("_r.key"), signed_text(F.col("raw_line")))
    problem = (
        F.when(F.col("_r").isNull(), "bad_header")
        .when(F.col("_r.alg") != ALGORITHM, "bad_algorithm")
        .when(F.col("_r.entry") != F.col("entry_id"), "wrong_entry")
        .when(~F.col("_r.key").isin(ring.ids()), "unknown_key")
        .when(F.col("raw_line").isNull(), "no_such_entry")
        .when(~F.col("_r.sig").eqNullSafe(expected), "bad_signature")
    )
    return (
        joined.withColumn("problem", problem)
        .withColumn("valid", F.col("problem").isNull())
        .drop("_r", "raw_line")
    )
