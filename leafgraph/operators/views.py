"""Filters of the graph views: what is shown of nodes and edges, and counts beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Relations between chunks, and those of lines with their chunks.
CHUNK_RELATIONS, MEMBERSHIP = ("next_chunk", "near_chunk"), "line_to_chunk"


def edge_search(edges: DataFrame, relation: str | None = None, words: str = "", source: str = "source", target: str = "target") -> DataFrame:
    """Edges of a relation, if one is given, whose ends and relation as JSON have the words, in any case."""
    some = edges.filter(F.col("relation") == relation) if relation else edges
    hay = F.lower(F.to_json(F.array(F.col(source).cast("string"), F.col(target).cast("string"), F.col("relation"))))
    words = words.strip().lower()
    return some.filter(hay.contains(words)) if words else some


def visible(nodes: DataFrame, edges: DataFrame, types: list[str], relations: list[str], words: str = "", node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Nodes of the types that have the words, and edges of the relations with both ends among them."""
    from leafgraph.operators.nodes import induced

    hay = F.lower(F.to_json(F.array(F.col(node).cast("string"), F.col("text"))))
    words = words.strip().lower()
    shown = nodes.filter(F.col("node_type").isin(*types))
    shown = shown.filter(hay.contains(words)) if words else shown
    return shown, induced(edges.filter(F.col("relation").isin(*relations)), shown, [], node=node)


def adjacent(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected nodes that have an edge, with themselves and their neighbours on either side: (selected, node)."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    met = both.join(selected.select(F.col("node").alias("source")), "source")
    rows = met.select(F.col("source").alias("selected"), F.explode(F.array("source", "target")).alias("node"))
    return rows.distinct()


def displayed(edges: DataFrame, owners: DataFrame, page: list[str], limit: int | None = None, cross_chunk_only: bool = False) -> DataFrame:
    """Line edges with both ends among the first ``limit`` lines of a page, and if asked for, in different chunks."""
    known = owners.filter(F.col("ord") <= limit) if limit is not None else owners
    out = edges
    for end in ("source", "target"):
        out = out.join(known.select(*page, F.col("ord").alias(end), F.col("chunk").alias(f"_{end}")), [*page, end])
    if cross_chunk_only:
        out = out.filter(~F.col("_source").eqNullSafe(F.col("_target")))
    return out.select(*edges.columns)


def relation_classes(line_edges: DataFrame, graph_edges: DataFrame, key: list[str]) -> DataFrame:
    """Counts of edges between lines, of lines with chunks, and between chunks, for each document."""
    lines = line_edges.groupBy(*key).agg(F.count(F.lit(1)).alias("line"))
    others = graph_edges.groupBy(*key).agg(F.count_if(F.col("relation") == MEMBERSHIP).alias("membership"), F.count_if(F.col("relation").isin(*CHUNK_RELATIONS)).alias("chunk"))
    return lines.join(others, key, "full").fillna(0, ["line", "membership", "chunk"])
