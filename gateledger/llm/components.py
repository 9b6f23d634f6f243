"""Connected components by repeated contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateledger.llm.common import few_files, settled


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) for every endpoint of ``edges`` (columns a, b), by least id.

    Each round sends every node to its least neighbour and rewrites the edges;
    the mappings are composed at the end.  Minima combine before they shuffle,
    and the rewriting joins have one row per node on one side, so a node with
    very many edges can be split.  Every round is written to the shared folder,
    in as many files as its rows ask for.  ``rows``: the most that ``edges`` has, if known.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    edges = settled(edges if rows is None else few_files(edges, rows))
    maps: list[DataFrame] = []
    while rows := edges.count():
        both = edges.union(edges.select("b", "a"))
        step = settled(few_files(
            both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
            .select("id", F.least("id", "least").alias("to")), 2 * rows))
        maps.append(step)
        left, right = step.toDF("a", "to_a"), step.toDF("b", "to_b")
        edges = settled(few_files(
            edges.join(left, "a").join(right, "b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .where(F.col("a") != F.col("b")).distinct(), rows))
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = maps[0].toDF("id", "component")
    for step in maps[1:]:
        found = found.join(step.toDF("component", "to"), "component", "left").select(
            "id", F.coalesce("to", "component").alias("component"))
    return found
