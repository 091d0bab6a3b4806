"""Graphs, enriched graphs and embeddings on disk: tables of their nodes, edges and vectors, and JSON for exchange.

A store is a folder with the Parquet tables ``nodes``, ``edges`` and ``embeddings`` of any number
of documents, each row with its ``doc_id``; a job writes it as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions.text import strip

BOX = "struct<left:double,top:double,right:double,bottom:double,width:double,height:double,center_x:double,center_y:double>"
#: Shape of a graph file; fields that a kind of node or a plain graph lacks are null.
NODE = (
    f"struct<id:string,node_type:string,page:int,text:string,label:string,modality:string,score:double,parent_id:string,line_ids:array<string>,bbox:{BOX},metadata:map<string,string>,"
    "embedding_row:bigint,deg_in:bigint,deg_out:bigint,deg:bigint,hub:double,lambda_hub:double>"
)
EDGE = "struct<source_id:string,target_id:string,relation:string,score:double,conf_off:double>"
GRAPH = f"document struct<image_path:string,ocr_path:string>, nodes array<{NODE}>, edges array<{EDGE}>"


@dataclass(frozen=True)
class Store:
    """The tables of a store."""

    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame


def save(store: Store, path: str) -> None:
    """Write the tables of a store; the last table to come, ``embeddings``, makes it complete."""
    for name in ("nodes", "edges", "embeddings"):
        getattr(store, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Store:
    return Store(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "embeddings")))


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a store has all its tables."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return all(files.exists(hadoop(f"{path}/{name}/_SUCCESS")) for name in ("nodes", "edges", "embeddings"))


def graph_rows(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, value) of JSON graphs as (doc_id, document, nodes, edges)."""
    return rows.select("doc_id", F.from_json("value", GRAPH).alias("g")).select("doc_id", "g.*")


def graph_nodes(graphs: DataFrame) -> DataFrame:
    """The nodes of graphs, in their order; those without an id are dropped."""
    return graphs.select("doc_id", F.posexplode("nodes").alias("node_ord", "n")).select("doc_id", "node_ord", "n.*").filter(F.coalesce(strip(F.col("id")), F.lit("")) != "")


def graph_edges(graphs: DataFrame) -> DataFrame:
    """The edges of graphs, in their order; a score that is missing is one."""
    rows = graphs.select("doc_id", F.posexplode("edges").alias("edge_ord", "e")).select("doc_id", "edge_ord", "e.*")
    return rows.withColumn("score", F.coalesce("score", F.lit(1.0)))


def node_rows(meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of nodes: ``meta(doc_id, node_id, row)`` with ``vectors(doc_id, row, vec)``; blank ids and rows out of bounds are dropped."""
    good = meta.filter((F.coalesce(strip(F.col("node_id")), F.lit("")) != "") & (F.col("row") >= 0))
    return good.join(vectors, ["doc_id", "row"]).select("doc_id", "node_id", "row", "vec")


def report(entries: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """How a build went for each entry: ``build`` gives (key, error) for those it tried, with a null error where it succeeded."""
    done = build(entries).select(key, F.lit(True).alias("_tried"), F.col("error").alias("_error"))
    status = F.when(F.col("_tried").isNull(), "error: not built").when(F.col("_error").isNull(), "ok").otherwise(F.concat(F.lit("error: "), F.col("_error")))
    return entries.join(done, key, "left").withColumn("status", status).drop("_tried", "_error")
