"""Drive a streaming query over what is available and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gateledger.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_durable_state(spark: SparkSession) -> None:
    """Keyed state in RocksDB: larger than memory, with time-to-live."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process all present input, then return the sink as a batch DataFrame.

    Sink and checkpoint live in the shared checkpoint folder, so a restarted
    driver or lost executors resume from there.
    """
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One sample table, a file or a folder of files, as a file stream."""
    from gateledger.sources.tables import load

    schema = load(spark, folder, name).schema
    # A glob that only this table meets: a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
