"""Strict reader and writer for line-delimited decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gateledger import schema as S
from gateledger.functions.jsontext import strict_json, variant_kind
from gateledger.session import durable_table


_BLANK = r"(?U)^[\s\x1c-\x1f]*\z"
_SPLIT = ["chain_id", "_file", "_start"]


def read_lines(spark: SparkSession, path: str, chain_id: str = "main") -> DataFrame:
    """Every physical line with its place: file, split offset, order in the task.

    Only LF ends a line.  ``_row`` grows by one per line within a split.
    """
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.lit(chain_id).alias("chain_id"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
            F.col("value").alias("raw_line"),
        )
    )


def _member(document: Column, name: str) -> Column:
    return F.variant_get(document, f"$.{name}", "variant")


def _is_kind(value: Column, kind: str) -> Column:
    return value.isNotNull() & (variant_kind(value) == kind)


def _whole_number(value: Column) -> Column:
    return value.isNotNull() & F.schema_of_variant(value).rlike(
        r"^(BIGINT|DECIMAL\(\d+,0\))$"
    )


def row_errors(document: Column, raw_line: Column) -> Column:
    """Array of rule violations, first one first; empty for a valid row."""

    def text(name: str, optional: bool = False) -> Column:
        value = _member(document, name)
        absent = value.isNull()
        wrong = ~absent & (variant_kind(value) != "STRING")
        bad = F.when(wrong, F.lit(f"{name} must be str"))
        return bad if optional else F.when(absent, F.lit(f"missing {name}")).otherwise(bad)

    def mac(name: str) -> Column:
        value = F.try_variant_get(document, f"$.{name}", "string")
        bad = (value != "") & ~value.rlike(r"^[0-9a-f]{64}\z")
        return F.when(bad, F.lit(f"{name} must be empty or 64 lowercase hex digits"))

    ts = _member(document, "ts_ns")
    ts_number = F.try_variant_get(document, "$.ts_ns", "decimal(38,0)")
    chain = _member(document, "approval_chain")
    links = F.try_variant_get(document, "$.approval_chain", "array<variant>")
    metadata = _member(document, "metadata")
    owner_type = F.try_variant_get(document, "$.owner_type", "string")
    decision = F.try_variant_get(document, "$.decision", "string")
    owner_id = F.try_variant_get(document, "$.owner_id", "string")
    checks = [
        F.when(ts.isNull(), F.lit("missing ts_ns")),
        F.when(~_whole_number(ts), F.lit("ts_ns must be int")),
        F.when(
            ~ts_number.between(0, F.lit(str(S.MAX_TS_NS)).cast("decimal(38,0)")),
            F.lit("ts_ns is outside the supported range"),
        ),
        text("hmac", optional=True),
        text("prev_hmac", optional=True),
        text("entry_id"),
        text("check_name"),
        text("reason"),
        text("request_fingerprint", optional=True),
        text("owner_id"),
        F.when(
            metadata.isNotNull() & (variant_kind(metadata) != "OBJECT"),
            F.lit("metadata must be dict"),
        ),
        F.when(
            chain.isNotNull() & (variant_kind(chain) != "ARRAY"),
            F.lit("approval_chain must be list"),
        ),
        F.when(
            F.exists(links, lambda v: ~F.coalesce(_is_kind(v, "STRING"), F.lit(False))),
            F.lit("approval_chain elements must be str"),
        ),
        mac("hmac"),
        mac("prev_hmac"),
        F.when(
            owner_type.isNull() | ~owner_type.isin(*S.OWNER_TYPES),
            F.lit("unknown owner_type"),
        ),
        F.when(
            (owner_type != "unresolved") & (owner_id == ""),
            F.lit("owner_id must not be empty"),
        ),
        F.when(
            decision.isNull() | ~decision.isin(*S.DECISIONS), F.lit("unknown decision")
        ),
    ]
    parsed = F.array_compact(F.array(*checks))
    return (
        F.when(~F.is_valid_utf8(raw_line), F.array(F.lit("invalid UTF-8")))
        .when(document.isNull(), F.array(F.lit("invalid JSON")))
        .when(variant_kind(document) != "OBJECT", F.array(F.lit("line is not an object")))
        .otherwise(parsed)
    )


def validate_decisions(lines: DataFrame) -> DataFrame:
    """Parse ``raw_line`` and add ``parse_error`` (null when the row is valid)."""
    readable = F.when(F.is_valid_utf8("raw_line"), F.col("raw_line"))
    document = strict_json(readable)
    parsed = lines.withColumn("_document", document)
    return parsed.withColumn(
        "parse_error", F.get(row_errors(F.col("_document"), F.col("raw_line")), 0)
    )


def _fields(document: Column, raw_line: Column) -> list[Column]:
    def text(name: str, default: str | None = None) -> Column:
        value = F.try_variant_get(document, f"$.{name}", "string")
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        return value.alias(name)

    chain = F.try_variant_get(document, "$.approval_chain", "array<string>")
    return [
        text("entry_id"),
        F.try_variant_get(document, "$.ts_ns", "decimal(20,0)").alias("ts_ns"),
        text("owner_type"),
        text("owner_id"),
        F.coalesce(chain, F.array().cast("array<string>")).alias("approval_chain"),
        text("check_name"),
        text("decision"),
        text("reason"),
        text("request_fingerprint", ""),
        F.coalesce(
            F.to_json(F.try_variant_get(document, "$.metadata", "variant")), F.lit("{}")
        ).alias("metadata"),
        text("prev_hmac", ""),
        text("hmac", ""),
        raw_line.alias("raw_line"),
    ]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse, validate and store every line once, as a columnar table."""
    checked = validate_decisions(
        lines.withColumn("_blank", F.col("raw_line").rlike(_BLANK))
    )
    fields = _fields(F.col("_document"), F.col("raw_line"))
    return durable_table(
        checked.select(
            *_SPLIT, "_row", "_blank",
            F.when(~F.col("_blank"), F.col("parse_error")).alias("parse_error"), *fields,
        )
    )


def _numbered(table: DataFrame) -> DataFrame:
    """Add ``line_number`` and ``seq`` from per-split counts.

    Lines of a split are consecutive, so a line's place is its distance from
    the split's first line plus the lines in earlier splits: a join with one
    row per split, no sort.  Only splits with blank or bad lines need to rank
    their valid rows.
    """
    valid = (~F.col("_blank")) & F.col("parse_error").isNull()
    splits = table.groupBy(*_SPLIT).agg(
        F.min("_row").alias("_first"),
        F.count(F.lit(1)).alias("_lines"),
        F.count(F.when(valid, 1)).alias("_valid"),
    )
    before = (
        Window.partitionBy("chain_id").orderBy("_file", "_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    places = splits.select(
        *_SPLIT, "_first", (F.col("_lines") == F.col("_valid")).alias("_whole"),
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_valid").over(before), F.lit(0)).alias("_valid_before"),
    )
    placed = table.join(places, _SPLIT).withColumn(
        "line_number", F.col("_lines_before") + F.col("_row") - F.col("_first") + 1
    )
    whole = placed.where("_whole").withColumn(
        "seq", F.col("_valid_before") + F.col("_row") - F.col("_first")
    )
    order = Window.partitionBy(*_SPLIT).orderBy("_row")
    mixed = placed.where("not _whole").withColumn(
        "seq", F.col("_valid_before") + F.sum(valid.cast("long")).over(order) - 1
    )
    return whole.unionByName(mixed)


def split_lines(table: DataFrame, on_malformed: str = "stop") -> tuple[DataFrame, DataFrame]:
    """Parsed lines → (decisions, malformed).

    ``stop`` keeps what precedes the first bad line of each chain; ``skip``
    keeps every valid line.  Blank lines count as lines but not as rows.
    """
    if on_malformed not in ("stop", "skip"):
        raise ValueError("on_malformed must be 'stop' or 'skip'")
    numbered = _numbered(table)
    bad = numbered.where("not _blank and parse_error is not null")
    good = numbered.where("not _blank and parse_error is null")
    if on_malformed == "stop":
        stops = bad.groupBy("chain_id").agg(F.min("line_number").alias("_stop"))
        good = (
            good.join(stops, "chain_id", "left")
            .where("_stop is null or line_number < _stop")
            .drop("_stop")
        )
        bad = bad.join(stops, "chain_id").where("line_number = _stop").drop("_stop")
    names = ["chain_id", "seq", *[name for name, _ in S.ENTRY_FIELDS], "raw_line"]
    return good.select(*names), bad.select("chain_id", "line_number", "raw_line", "parse_error")


def read_decisions(
    spark: SparkSession, path: str, on_malformed: str = "stop", chain_id: str = "main"
) -> tuple[DataFrame, DataFrame]:
    return split_lines(parse_lines(read_lines(spark, path, chain_id)), on_malformed)


def write_decisions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append canonical lines, sorted within range partitions of the order."""
    (
        df.repartitionByRange("chain_id", "seq")
        .sortWithinPartitions("chain_id", "seq")
        .select("raw_line")
        .write.mode(mode)
        .text(path)
    )


def write_decision_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by day, so report windows prune whole folders."""
    from gateledger.functions.times import ns_to_timestamp

    day = F.to_date(ns_to_timestamp(F.col("ts_ns")))
    df.withColumn("date", day).write.mode(mode).partitionBy("date").parquet(path)
