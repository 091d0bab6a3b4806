"""Coarse and fine nodes, node records, payloads, and filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.geometry import Box
from leafgraph.functions.text import modality, sentences

NODE = ["doc_id", "page", "node_id", "node_type", "label", "modality", "text", "l", "t", "r", "b"]


def coarse_nodes(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Chunks as paragraphs, and regions as tables or images."""
    a = chunks.select("doc_id", "page", F.format_string("p%d_chunk_%03d", "page", "chunk").alias("node_id"), F.lit("chunk").alias("node_type"), F.lit("").alias("label"), F.lit("paragraph").alias("modality"), "text", "l", "t", "r", "b")
    return a.unionByName(region_nodes(regions))


def region_nodes(regions: DataFrame) -> DataFrame:
    """Regions as tables or images."""
    return regions.select("doc_id", "page", F.format_string("p%d_%s_%03d", "page", "label", "region").alias("node_id"), F.lit("region").alias("node_type"), "label", modality(F.col("label")).alias("modality"), F.col("content").alias("text"), "l", "t", "r", "b")


def sentence_nodes(coarse: DataFrame) -> DataFrame:
    """A node for each sentence of the paragraphs."""
    rows = coarse.filter("modality = 'paragraph'").select("doc_id", "page", "node_id", F.posexplode(sentences(F.col("text"))).alias("i", "text"), "l", "t", "r", "b")
    return rows.select("doc_id", "page", F.format_string("%s_sent_%03d", "node_id", "i").alias("node_id"), F.lit("fine").alias("node_type"), F.lit("").alias("label"), F.lit("sentence").alias("modality"), "text", "l", "t", "r", "b", F.col("node_id").alias("parent_id"))


def patch_nodes(coarse: DataFrame, rows: int = 1, cols: int = 1) -> DataFrame:
    """Images cut into a grid; the last row and column end at the image's edge."""
    cells = coarse.filter("modality = 'image'").select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    w, h = (F.col("r") - F.col("l")) / cols, (F.col("b") - F.col("t")) / rows
    i = F.col("row") * cols + F.col("col")
    return cells.select(
        "doc_id", "page", F.format_string("%s_patch_%03d", "node_id", i).alias("node_id"), F.lit("fine").alias("node_type"), F.lit("").alias("label"), F.lit("image_patch").alias("modality"), "text",
        (F.col("l") + w * F.col("col")).alias("l"), (F.col("t") + h * F.col("row")).alias("t"),
        F.when(F.col("col") == cols - 1, F.col("r")).otherwise(F.col("l") + w * (F.col("col") + 1)).alias("r"),
        F.when(F.col("row") == rows - 1, F.col("b")).otherwise(F.col("t") + h * (F.col("row") + 1)).alias("b"),
        F.col("node_id").alias("parent_id"),
    )


def layer_edges(fine: DataFrame) -> DataFrame:
    """Edges between fine nodes and their parents, both ways."""
    pair = F.array(
        F.struct(F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("coarse_to_fine").alias("relation")),
        F.struct(F.col("node_id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("fine_to_coarse").alias("relation")),
    )
    return fine.select("doc_id", F.explode(pair).alias("e")).select("doc_id", "e.*", F.lit(1.0).alias("score"))


def records(nodes: DataFrame, types: tuple[str, ...] = ("chunk", "region", "fine")) -> DataFrame:
    """Nodes to embed, numbered within their document."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("node_id")
    return nodes.filter(F.col("node_type").isin(*types)).withColumn("row", (F.row_number().over(w) - 1).cast("long"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def search(nodes: DataFrame, types: list[str] | None, words: str) -> DataFrame:
    """Nodes of some types whose JSON contains the words, in any case."""
    some = nodes.filter(F.col("node_type").isin(*types)) if types else nodes
    return some.filter(F.lower(F.to_json(F.struct("node_id", "node_type", "text"))).contains(words.lower()))


def induced(edges: DataFrame, kept: DataFrame, keys: list[str], source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """Edges with both ends kept."""
    a = edges.join(kept.select(*keys, F.col(node).alias(source)), [*keys, source], "left_semi")
    return a.join(kept.select(*keys, F.col(node).alias(target)), [*keys, target], "left_semi").select(edges.columns)


def box_json(box: str = "") -> Column:
    """A box as graphs keep it: its edges and what follows from them."""
    x = Box.of(box)
    named = {"left": x.l, "top": x.t, "right": x.r, "bottom": x.b, "width": x.width, "height": x.height, "center_x": x.cx, "center_y": x.cy}
    return F.struct(*(c.alias(n) for n, c in named.items()))


#: Kinds of nodes in the order of a graph, and the fields that each has besides id, type, page, text and box.
KINDS = {"line": ("metadata",), "chunk": ("line_ids",), "region": ("label", "score", "metadata"), "fine": ("modality", "parent_id", "metadata")}


def payload(nodes: DataFrame, edges: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A JSON document for each graph: (doc_id, graph) with its document, stats, nodes and edges.

    ``nodes(doc_id, node_type, node_ord, node_id, page, text, l, t, r, b)`` may have any of the fields of KINDS;
    a node keeps those of its kind.  ``counts(doc_id, image_path, ocr_path, num_words, num_paragraph_lines,
    num_region_lines)`` has what nodes and edges don't show.  The lists are those of one document.
    """
    given = [c for c in ("label", "score", "modality", "parent_id", "line_ids", "metadata") if c in nodes.columns]
    own = lambda c: F.when(F.col("node_type").isin(*(k for k, v in KINDS.items() if c in v)), F.col(c)).alias(c)
    node = F.struct(F.col("node_id").alias("id"), "node_type", "page", "text", box_json().alias("bbox"), *map(own, given))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("node_type"))
    rows = F.array_sort(F.collect_list(F.struct(place.alias("k"), F.col("node_ord").alias("o"), F.col("node_id").alias("i"), node.alias("x"))))
    n = nodes.groupBy("doc_id").agg(F.transform(rows, lambda s: s["x"]).alias("nodes"), *(F.count_if(F.col("node_type") == k).alias(f"_{k}") for k in KINDS))
    listed = F.array_sort(F.collect_list(F.struct("edge_ord", F.struct("source_id", "target_id", "relation", F.coalesce("score", F.lit(1.0)).alias("score")).alias("x"))))
    e = edges.groupBy("doc_id").agg(F.transform(listed, lambda s: s["x"]).alias("edges"))
    both = n.join(e, "doc_id", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<source_id:string,target_id:string,relation:string,score:double>>)")))
    if counts is not None:
        both = both.join(counts, "doc_id", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if counts is not None and c in counts.columns else F.lit(0).cast("long")
    stats = F.struct(
        known("num_words").alias("num_words"), F.col("_line").alias("num_lines"), known("num_paragraph_lines").alias("num_paragraph_lines"), known("num_region_lines").alias("num_region_lines"),
        F.col("_chunk").alias("num_chunks"), F.col("_region").alias("num_regions"), F.col("_fine").alias("num_fine_nodes"), F.size("edges").cast("long").alias("num_edges"),
    )
    path = lambda c: F.col(c) if counts is not None and c in counts.columns else F.lit(None).cast("string")
    document = F.struct(path("image_path").alias("image_path"), path("ocr_path").alias("ocr_path"))
    return both.select("doc_id", F.to_json(F.struct(document.alias("document"), stats.alias("stats"), "nodes", "edges")).alias("graph"))


def save(graphs: DataFrame, path: str) -> None:
    """One JSON file part per task, committed as a whole."""
    graphs.write.mode("overwrite").text(path) if graphs.columns == ["graph"] else graphs.write.mode("overwrite").json(path)
