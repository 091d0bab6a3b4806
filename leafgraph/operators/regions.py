"""Layout regions and their relations with lines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import geometry as G
from leafgraph.functions.text import joined, tokens
from leafgraph.operators.joins import PAGE, best, prefixed

BOX = ["l", "t", "r", "b"]


def layout_regions(detections: DataFrame) -> DataFrame:
    """Detections with an area; ids keep the numbers of the unfiltered list."""
    return detections.filter("r > l AND b > t")


def _pairs(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines and regions of a page that meet, with the share of the line that is covered."""
    a = prefixed(lines.select(*PAGE, "ord", "text", *BOX), "s_", PAGE)
    b = prefixed(regions.select(*PAGE, "region", "label", *BOX), "g_", PAGE)
    s, g = G.Box.of("s_"), G.Box.of("g_")
    # regions of a page are few: joined on the page with the overlap as residual
    meet = (F.col("g_l") < F.col("s_r")) & (F.col("s_l") < F.col("g_r")) & (F.col("g_t") < F.col("s_b")) & (F.col("s_t") < F.col("g_b"))
    return a.join(b, PAGE).filter(meet).withColumn("share", G.cover(s, g))


def line_regions(lines: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """The region that covers most of each line, the first of equals: (doc_id, page, ord, region, score)."""
    found = best(_pairs(lines, regions).filter(F.col("share") >= least), [*PAGE, "s_ord"], F.col("share").desc(), F.col("g_region"))
    return found.select(*PAGE, F.col("s_ord").alias("ord"), F.col("g_region").alias("region"), G.rounded(F.least(F.lit(1.0), "share")).alias("score"))


def split_lines(lines: DataFrame, regions: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Lines inside regions, with the region and its share, and lines outside all."""
    found = line_regions(lines, regions, least)
    return lines.join(found, [*PAGE, "ord"]), lines.join(found, [*PAGE, "ord"], "left_anti")


def expanded(lines: DataFrame, regions: DataFrame, least: float = 0.5, padding: float = 0.0, clamp: bool = False) -> DataFrame:
    """Regions widened to the lines they hold."""
    inside = _pairs(lines, regions).filter(F.col("share") >= least)
    held = inside.groupBy(*PAGE, F.col("g_region").alias("region")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("s_l").alias("min_left"), F.max("s_r").alias("max_right"))
    out = regions.join(held, [*PAGE, "region"], "left")
    left = F.when(F.col("n_lines") > 0, F.least("l", "min_left") - F.lit(padding)).otherwise(F.col("l"))
    right = F.when(F.col("n_lines") > 0, F.greatest("r", "max_right") + F.lit(padding)).otherwise(F.col("r"))
    if clamp:
        left, right = F.greatest("l", left), F.least("r", right)
    return out.select(
        *PAGE, "region", "label", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), left.alias("l"), "t", right.alias("r"), "b",
        F.coalesce("min_left", "l").alias("min_line_left"), F.coalesce("max_right", "r").alias("max_line_right"),
    )


def region_text(lines: DataFrame, regions: DataFrame, least: float = 0.35) -> DataFrame:
    """Text of the lines in each region, in order; regions without any keep an empty one."""
    inside = _pairs(lines, regions).filter(F.col("share") >= least)
    held = inside.groupBy(*PAGE, F.col("g_region").alias("region")).agg(joined("s_ord", "s_text", "\n").alias("content"))
    return regions.drop("content").join(held, [*PAGE, "region"], "left").select(*PAGE, "region", F.coalesce("content", F.lit("")).alias("content"))


def bridge_scores(edges: DataFrame, owners: DataFrame, inside: DataFrame) -> DataFrame:
    """Chunks and regions joined by a line edge: (doc_id, page, chunk, region, bridge)."""
    found = []
    for here, there in (("source", "target"), ("target", "source")):
        one = edges.join(owners.withColumnRenamed("ord", here), [*PAGE, here])
        one = one.join(inside.select(*PAGE, F.col("ord").alias(there), "region", F.col("score").alias("held")), [*PAGE, there])
        found.append(one.select(*PAGE, "chunk", "region", G.rounded(F.least(F.lit(1.0), F.col("score") * F.col("held"))).alias("bridge")))
    return found[0].unionByName(found[1]).groupBy(*PAGE, "chunk", "region").agg(F.max("bridge").alias("bridge"))


def region_chunks(regions: DataFrame, chunks: DataFrame, lines: DataFrame, owners: DataFrame, bridges: DataFrame, min_line: float = 0.35, min_chunk: float = 0.10, min_spatial: float = 0.25) -> DataFrame:
    """Related regions and chunks of a page: (doc_id, page, region, chunk, score)."""
    best_line = (
        _pairs(lines, regions).join(owners.withColumnRenamed("ord", "s_ord"), [*PAGE, "s_ord"])
        .groupBy(*PAGE, "chunk", F.col("g_region").alias("region")).agg(F.max("share").alias("line"))
    )
    a = prefixed(regions.select(*PAGE, "region", *BOX), "g_", [*PAGE, "region"])
    b = prefixed(chunks.select(*PAGE, F.col("head").alias("chunk"), *BOX), "c_", [*PAGE, "chunk"])
    g, c = G.Box.of("g_"), G.Box.of("c_")
    pairs = a.join(b, PAGE).filter((g.area > 0) & (c.area > 0))
    pairs = pairs.join(best_line, [*PAGE, "chunk", "region"], "left").join(bridges, [*PAGE, "chunk", "region"], "left").fillna(0.0, ["line", "bridge"])
    overlap = G.intersection(g, c) / F.least(g.area, c.area)
    pairs = pairs.withColumns({"overlap": overlap, "spatial": G.spatial_score(c, g)})
    kept = pairs.filter((F.col("bridge") > 0) | (F.col("spatial") >= min_spatial) | (F.col("line") >= min_line) | (F.col("overlap") >= min_chunk))
    return kept.select(*PAGE, "region", "chunk", G.rounded(F.least(F.lit(1.0), F.greatest("overlap", "line", "spatial", "bridge"))).alias("score"))


def lexical_top(left: DataFrame, right: DataFrame, group: list[str], least: float = 0.08, k: int = 2) -> DataFrame:
    """For each ``right(id, text)`` the ``k`` (one at least) most alike ``left(id, text)`` of its group.

    TF-IDF over the texts of both sides that have a token, by an inverted index:
    tokens are exploded, weighted and joined, and products summed; no pair without a
    common token is formed.  Rows (group, left_id, right_id, score).
    """
    both = left.select(*group, F.lit("a").alias("side"), "id", tokens(F.col("text")).alias("ts")).unionByName(right.select(*group, F.lit("b").alias("side"), "id", tokens(F.col("text")).alias("ts")))
    counts = both.select(*group, "side", "id", F.explode("ts").alias("token")).groupBy(*group, "side", "id", "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    n = counts.groupBy(*group).agg(F.count_distinct("side", "id").alias("n"))
    df = counts.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(n, group).withColumn("idf", F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1)
    size = counts.groupBy(*group, "side", "id").agg(F.sum("tf").alias("size"))
    w = counts.join(idf, [*group, "token"]).join(size, [*group, "side", "id"]).withColumn("w", F.col("tf") / F.col("size") * F.col("idf"))
    norm = w.groupBy(*group, "side", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, [*group, "side", "id"]).select(*group, "side", "id", "token", (F.col("w") / F.col("norm")).alias("w"))
    a = w.filter("side = 'a'").select(*group, "token", F.col("id").alias("left_id"), F.col("w").alias("x"))
    b = w.filter("side = 'b'").select(*group, "token", F.col("id").alias("right_id"), F.col("w").alias("y"))
    score = a.join(b, [*group, "token"]).groupBy(*group, "left_id", "right_id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    top = best(score.withColumn("score", F.round("score", 6)).filter(F.col("score") >= least), [*group, "right_id"], F.col("score").desc(), F.col("left_id"), k=max(1, k))
    return top.select(*group, "left_id", "right_id", F.round("score", 4).alias("score"))
