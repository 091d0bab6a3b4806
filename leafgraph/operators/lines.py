"""Relations between lines, and chunks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions import geometry as G
from leafgraph.functions.text import joined
from leafgraph.operators.graph import components
from leafgraph.operators.joins import PAGE, band_pairs, best, prefixed

COLS = [*PAGE, "ord", "l", "t", "r", "b"]


def _near(lines: DataFrame, heights: float) -> DataFrame:
    """Pairs s, c of one page where c starts after the top of s, by at most ``heights`` mean heights below it."""
    tallest = lines.groupBy(*PAGE).agg((F.max(G.Box.of().height) * (1 + heights) + heights + 1).alias("step"))
    s = prefixed(lines.select(*COLS), "s_", PAGE).join(tallest.withColumnRenamed("step", "far"), PAGE)
    s = s.withColumn("s_far", F.col("s_t") + F.col("far")).drop("far")
    c = prefixed(lines.select(*COLS), "c_", PAGE)
    return band_pairs(s, c, "s_t", "s_far", "c_t", tallest).drop("s_far")


def next_line(lines: DataFrame, max_gap: float = 3.5, min_overlap: float = 0.05) -> DataFrame:
    """For each line the cheapest line below it: (doc_id, page, source, target, score)."""
    s, c = G.Box.of("s_"), G.Box.of("c_")
    h, gap, ov = G.mean_height(s, c), G.v_gap(s, c), G.h_ratio(s, c)
    left = F.abs(s.l - c.l)
    cost = gap / h + F.lit(0.75) * left / F.greatest(s.width, c.width, F.lit(1.0)) + F.lit(0.5) * (F.lit(1.0) - ov)
    pairs = _near(lines, max_gap).filter((c.t > s.t) & (gap / h <= max_gap) & ~((ov < min_overlap) & (left > h * 4)))
    first = best(pairs.withColumn("cost", cost), [*PAGE, "s_ord"], F.col("cost"), F.col("c_ord"))
    return first.select(*PAGE, F.col("s_ord").alias("source"), F.col("c_ord").alias("target"), G.rounded(F.lit(1.0) / (F.lit(1.0) + F.col("cost"))).alias("score"))


def continues(lines: DataFrame, edges: DataFrame, max_gap: float = 1.6, max_left: float = 0.06, min_overlap: float = 0.35) -> DataFrame:
    """The next-line edges along which a chunk goes on."""
    s, c = G.Box.of("s_"), G.Box.of("c_")
    both = edges.join(prefixed(lines.select(*COLS), "s_", PAGE).withColumnRenamed("s_ord", "source"), [*PAGE, "source"])
    both = both.join(prefixed(lines.select(*COLS), "c_", PAGE).withColumnRenamed("c_ord", "target"), [*PAGE, "target"])
    close = F.abs(s.l - c.l) / F.greatest(s.r, c.r, F.lit(1.0)) <= max_left
    return both.filter((G.v_gap(s, c) / G.mean_height(s, c) <= max_gap) & (close | (G.h_ratio(s, c) >= min_overlap))).select(*PAGE, "source", "target", "score")


def chunk_chains(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines with the chunk they belong to: (doc_id, page, ord, chunk).

    Walking along valid edges in reading order, a line belongs to the earliest of
    its ancestors, as every edge leads forward: the least line from which it can be
    reached.  Path doubling finds it in a logarithmic number of joins.
    """
    from leafgraph.operators.graph import least_ancestor

    return least_ancestor(lines.select(*PAGE, "ord"), edges)


def chunk_table(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """Chunks with their text and box: (doc_id, page, chunk, n_lines, text, l, t, r, b)."""
    rows = lines.join(owners, [*PAGE, "ord"])
    out = rows.groupBy(*PAGE, F.col("chunk").alias("head")).agg(F.count(F.lit(1)).alias("n_lines"), joined("ord", "text", "\n").alias("text"), *G.union())
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("head")).cast("long")
    return out.select(*PAGE, "head", number.alias("chunk"), "n_lines", "text", "l", "t", "r", "b")


def page_extent(boxes: DataFrame) -> DataFrame:
    """Width, height and diagonal of the pages, of one at least."""
    out = boxes.groupBy(*PAGE).agg(F.greatest(F.max("r"), F.lit(1.0)).alias("page_w"), F.greatest(F.max("b"), F.lit(1.0)).alias("page_h"))
    return out.withColumn("diagonal", F.hypot("page_w", "page_h"))


def next_below(boxes: DataFrame, max_gap: float, min_overlap: float, max_shift: float) -> DataFrame:
    """Infographic reading order: for each box the best-scoring one below it."""
    s, c = G.Box.of("s_"), G.Box.of("c_")
    gap = G.v_gap(s, c) / G.mean_height(s, c)
    ov = G.h_ratio(s, c)
    left, centre = F.abs(s.l - c.l) / F.col("page_w"), F.abs(s.cx - c.cx) / F.col("page_w")
    pairs = _near(boxes, max_gap).join(page_extent(boxes), PAGE).filter((c.t > s.t) & (gap <= max_gap) & ((ov >= min_overlap) | (left <= max_shift) | (centre <= max_shift)))
    align = F.greatest(ov, F.lit(1.0) - F.least(left, centre) / max_shift, F.lit(0.0))
    score = F.lit(0.45) * (F.lit(1.0) - gap / max_gap) + F.lit(0.35) * align + F.lit(0.20) * G.height_similarity(s, c)
    first = best(pairs.withColumn("score", score).filter("score > 0"), [*PAGE, "s_ord"], F.col("score").desc(), F.col("c_ord"))
    return first.select(*PAGE, F.col("s_ord").alias("source"), F.col("c_ord").alias("target"), G.rounded(F.col("score")).alias("score"))


def near_pairs(boxes: DataFrame, owner: str | None, max_distance: float, heights: bool, k: int = 1) -> DataFrame:
    """The ``k`` nearest boxes of each box, of another owner, as undirected pairs.

    A pair found from both sides is kept as its earlier source gives it.  Boxes
    further apart than the share ``max_distance`` of the page's diagonal are no
    candidates, so pairs come from a band join on the centres.
    """
    keep = [*COLS, *([owner] if owner else [])]
    page = page_extent(boxes)
    far = page.select(*PAGE, (F.col("diagonal") * max_distance * 2 + 1).alias("step"))
    s = prefixed(boxes.select(*keep), "s_", PAGE).join(page, PAGE)
    s = s.withColumn("low", G.Box.of("s_").cy - F.col("diagonal") * max_distance).withColumn("high", G.Box.of("s_").cy + F.col("diagonal") * max_distance)
    c = prefixed(boxes.select(*keep), "c_", PAGE).withColumn("c_y", G.Box.of("c_").cy)
    pairs = band_pairs(s, c, "low", "high", "c_y", far).filter("s_ord <> c_ord")
    if owner:
        pairs = pairs.filter(~F.col(f"s_{owner}").eqNullSafe(F.col(f"c_{owner}")))
    a, b = G.Box.of("s_"), G.Box.of("c_")
    distance = G.centre_distance(a, b) / F.col("diagonal")
    near = F.lit(1.0) - distance / max_distance
    side = F.greatest(G.h_ratio(a, b), G.v_ratio(a, b))
    score = F.lit(0.60) * near + F.lit(0.20) * side + F.lit(0.20) * G.height_similarity(a, b) if heights else F.lit(0.70) * near + F.lit(0.30) * side
    top = best(pairs.filter(distance <= max_distance).withColumn("score", score), [*PAGE, "s_ord"], F.col("score").desc(), F.col("c_ord"), k=k, name="rank")
    pair = [F.least("s_ord", "c_ord").alias("one"), F.greatest("s_ord", "c_ord").alias("two")]
    first = best(top.select("*", *pair), [*PAGE, "one", "two"], F.col("s_ord"), F.col("rank"))
    return first.select(*PAGE, F.col("s_ord").alias("source"), F.col("c_ord").alias("target"), G.rounded(F.col("score")).alias("score"))


def merge_pairs(lines: DataFrame, max_gap: float = 1.2, max_side: float = 0.10, max_shift: float = 0.04, min_overlap: float = 0.35, least: float = 0.55) -> DataFrame:
    """Pairs of lines that belong to one infographic chunk."""
    s, c = G.Box.of("s_"), G.Box.of("c_")
    h, w = G.mean_height(s, c), F.greatest((s.width + c.width) / 2, F.lit(1.0))
    gap, side, ov = G.v_gap(s, c), G.h_gap(s, c), G.h_ratio(s, c)
    reach = F.greatest(s.r, c.r, F.lit(1.0))
    left, centre = F.abs(s.l - c.l) / reach, F.abs(s.cx - c.cx) / reach
    aligned = (ov >= min_overlap) | (left <= max_shift) | (centre <= max_shift)
    score = F.lit(0.45) * (F.lit(1.0) - F.least(F.lit(1.0), gap / (h * max_gap))) + F.lit(0.35) * F.greatest(ov, F.lit(1.0) - F.least(F.lit(1.0), left / max_shift, centre / max_shift)) + F.lit(0.20) * G.height_similarity(s, c)
    pairs = _near(lines, 1.5 * max_gap).filter("s_ord < c_ord")
    # looking down from a line ends at the first one that is far below it
    far = F.when(c.t - s.b > h * max_gap * 1.5, F.col("c_ord"))
    pairs = pairs.withColumn("end", F.min(far).over(Window.partitionBy(*PAGE, "s_ord"))).filter("end IS NULL OR c_ord < end")
    pairs = pairs.filter((gap <= h * max_gap) & (side <= w * max_side) & aligned)
    return pairs.withColumn("score", score).filter(F.col("score") >= least).select(*PAGE, F.col("s_ord").alias("source"), F.col("c_ord").alias("target"), G.rounded(F.col("score")).alias("score"))


def chunk_components(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Connected lines: (doc_id, page, ord, chunk), a chunk named by its least line."""
    return components(lines.select(*PAGE, "ord"), pairs)
