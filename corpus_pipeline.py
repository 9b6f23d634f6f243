"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, as a table in the shared folder, and
its decisions take effect: toxic documents go, then poor ones; one document of
each group of near copies stays; byte strings that repeat are cut out of the
texts; the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateledger.llm import packing, quality, sigtrees, suffixindex, toxicity
from gateledger.llm.common import table
from gateledger.session import durable_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_poor(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Near copies share four fifths of their five-word shingles; op6's contract is stricter.
    return sigtrees.one_of_each(docs, num=80, den=100, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixindex.strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

# Trees, signatures and tokens are beyond SQL; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
