"""Shared pieces of the text operators.

Every operator selects the columns it needs by name first, so further columns,
whatever they are called, never clash with its own.
"""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.session import durable_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


FILE_ROWS = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, path: str | None = None) -> DataFrame:
    """A table in the shared folder; the shuffle files behind it go once it stands."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return durable_table(df, path)
    finally:
        conf.set(CLEANUP, was)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """A file for every FILE_ROWS of the ``rows`` that the table has at most, if those are fewer than its tasks.

    For narrow rows straight after a shuffle or a scan.  Every file that a task writes to
    a local disk starts processes, and a table of a few thousand rows needs no hundreds.
    """
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a settled table that no later plan reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def per_text(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns computed from each whole text, one row per input row.

    ``make`` runs once per task and returns the function for a batch of texts;
    texts reach it in slices of bounded size.
    """
    source = slim(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                found = compute(texts)
                arrays = [part.column(0)] + [pa.array(v) for v in found.values()]
                yield pa.RecordBatch.from_arrays(
                    [a.cast(t) for a, t in zip(arrays, types, strict=True)], names
                )

    full = f"doc_id long, {schema}"
    names, types = arrow_fields(full)
    return source.mapInArrow(run, full)


def text_column(
    make: Callable[[], Callable[[list[str]], list]], kind: str, text_col: str = "text",
) -> Column:
    """A column computed from each whole text (null counts as empty), beside all others."""

    @F.pandas_udf(kind)
    def column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compute = make()
        for part in texts:
            yield pd.Series(list(compute(part.tolist())))

    return column(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()),
}


def arrow_fields(schema: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [p.strip().split(" ", 1) for p in schema.split(",")]
    return [p[0] for p in pairs], [_ARROW[p[1]] for p in pairs]


def slices(batch: pa.RecordBatch, limit: int = 1 << 23, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = batch.column(text).nbytes
    step = max(1, n if size <= limit else int(n * limit / size))
    for at in range(0, n, step):
        yield batch.slice(at, min(step, n - at))
