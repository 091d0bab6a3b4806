"""Iterative graph operators within pages, and edge sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/leafgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_ancestor(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The least node from which each node can be reached, itself included, as ``chunk``.

    Each node has at most one outgoing edge, to a greater node.  ``far`` jumps twice
    as far in every round, so the rounds are logarithmic in the longest path.
    """
    state = stored(nodes.select(*PAGE, "ord", F.col("ord").alias("chunk")))
    jump = stored(edges.select(*PAGE, F.col("source").alias("ord"), F.col("target").alias("far")))
    while not jump.isEmpty():
        sent = state.join(jump, [*PAGE, "ord"]).groupBy(*PAGE, F.col("far").alias("ord")).agg(F.min("chunk").alias("got"))
        state = stored(state.join(sent, [*PAGE, "ord"], "left").select(*PAGE, "ord", F.least("chunk", F.coalesce("got", "chunk")).alias("chunk")))
        jump = stored(jump.join(jump.select(*PAGE, F.col("ord").alias("far"), F.col("far").alias("next")), [*PAGE, "far"]).select(*PAGE, "ord", F.col("next").alias("far")))
    return state


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges within a page, named by their least node."""
    both = edges.select(*PAGE, F.col("source").alias("x"), F.col("target").alias("y"))
    both = stored(both.unionByName(both.select(*PAGE, F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    state, changed = stored(nodes.select(*PAGE, "ord", F.col("ord").alias("chunk"))), 1
    while changed:
        sent = both.join(state.withColumnRenamed("ord", "x"), [*PAGE, "x"]).groupBy(*PAGE, F.col("y").alias("ord")).agg(F.min("chunk").alias("got"))
        new = state.join(sent, [*PAGE, "ord"], "left").select(*PAGE, "ord", "chunk", F.least("chunk", F.coalesce("got", "chunk")).alias("low"))
        # a node also takes the name that its name has by now
        names = new.select(*PAGE, F.col("ord").alias("low"), F.col("low").alias("lower"))
        new = stored(new.join(names, [*PAGE, "low"]).select(*PAGE, "ord", "chunk", F.least("low", "lower").alias("low")))
        changed = new.filter("low <> chunk").count()
        state = new.select(*PAGE, "ord", F.col("low").alias("chunk"))
    return state


def both_ways(edges: DataFrame, back: str) -> DataFrame:
    """Edges and their reversals under another name."""
    turned = F.array(F.struct("source_id", "target_id", "relation", "score"), F.struct(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit(back).alias("relation"), "score"))
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "relation", "score")]
    return edges.select(*rest, F.explode(turned).alias("e")).select(*rest, "e.*")


def dedupe(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of edges alike in ``keys`` the one with the highest score, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(order))
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def consecutive(rows: DataFrame, group: list[str], order: list[str], node: str) -> DataFrame:
    """Edges from each row to the next one of its group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.select(*group, F.col(node).alias("source"), F.lead(node).over(w).alias("target")).filter("target IS NOT NULL")
