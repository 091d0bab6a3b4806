"""Queries of the scans and stores: small files in the formats of the readers are made from the test tables and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import geometry as G
from leafgraph.operators import graph
from leafgraph.plans.queries import Walk, query
from leafgraph.sources import scans, stores



def corners() -> Column:
    return F.array("l", "t", "r", "t", "r", "b", "l", "b")


def _ocr(spark, d) -> DataFrame:
    """Polygon OCR of every document: a page for each region, with a line of three words, one blank."""
    word = lambda text, box: F.struct(text.alias("text"), box.alias("boundingBox"))
    box = F.when((F.col("region") == 1) & (F.col("doc_id") % 5 == 0), F.slice(corners(), 1, 6)).otherwise(corners())
    words = F.array(word(F.col("label"), corners()), word(F.lit(" "), corners()), word(F.concat(F.lit("r"), F.col("region").cast("string")), corners()))
    line = F.struct(F.concat_ws(" ", "label", F.col("region").cast("string")).alias("text"), box.alias("boundingBox"), words.alias("words"))
    page = F.struct((F.col("region") + 1).alias("page"), F.array(line).alias("lines"))
    rows = scans.text_regions(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region", page.alias("p")))).alias("ps"))
    texts = rows.select("doc_id", F.to_json(F.struct(F.col("ps.p").alias("recognitionResults"))).alias("value"))
    return scans.json_rows(graph.stored(texts), scans.POLYGON_OCR)


@query
def ocr_word_scan(spark, d):
    return scans.ocr_words(_ocr(spark, d))


@query
def ocr_line_scan(spark, d):
    return scans.ocr_lines(_ocr(spark, d))


@query
def ocr_page_lookup(spark, d):
    return scans.page_of(scans.ocr_lines(_ocr(spark, d)), 2).select("doc_id", "text")


def _blocks(spark, d) -> tuple[DataFrame, DataFrame]:
    """Block OCR of every document: a line with one word and an unknown child, and the sizes of the pages."""
    box = F.struct((F.col("l") / 1000).alias("Left"), (F.col("t") / 500).alias("Top"), ((F.col("r") - F.col("l")) / 1000).alias("Width"), ((F.col("b") - F.col("t")) / 500).alias("Height"))
    place = F.struct(box.alias("BoundingBox")).alias("Geometry")
    word = F.struct(F.lit("w0").alias("Id"), F.col("label").alias("Text"), F.lit(99.0).alias("Confidence"), place)
    child = F.array(F.struct(F.lit("CHILD").alias("Type"), F.array(F.lit("w0"), F.lit("none")).alias("Ids"))).alias("Relationships")
    line = F.struct(F.lit("l0").alias("Id"), F.concat("label", F.lit(" x")).alias("Text"), F.lit(98.0).alias("Confidence"), place, child)
    rows = scans.text_regions(spark, d).filter("region = 0")
    texts = graph.stored(rows.select("doc_id", F.to_json(F.struct(F.array(word).alias("WORD"), F.array(line).alias("LINE"))).alias("value")))
    return scans.json_rows(texts, scans.BLOCK_OCR), rows.select("doc_id", F.lit(1000.0).alias("width"), F.lit(500.0).alias("height"))


@query
def block_scan(spark, d):
    (kind,) = scans.block_types("")
    return scans.blocks(*_blocks(spark, d), kind).select("doc_id", "id", "text", "confidence", *(F.round(c, 6).alias(c) for c in "ltrb"))


@query
def line_word_children(spark, d):
    files, sizes = _blocks(spark, d)
    return scans.children(scans.blocks(files, sizes), scans.blocks(files, sizes, "WORD")).select("doc_id", "line_id", "id", "text")


@query
def detection_scan(spark, d):
    box = F.array("l", "t", "r", "b").alias("bbox_xyxy")
    one = F.struct("label", (F.col("region") / 2 + 0.25).alias("score"), box, "content")
    rows = scans.text_regions(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region", one.alias("x")))).alias("xs"))
    listed = F.col("xs.x")
    texts = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(listed.alias("detections")))).otherwise(F.to_json(listed)).alias("value"))
    read = graph.stored(texts).select("doc_id", scans.listed_detections(F.col("value")).alias("listed"))
    return scans.detection_rows(read).select("doc_id", F.col("region").cast("long").alias("region"), "label", "score", F.md5("content").alias("content_md5"), "l", "t", "r", "b")


@query
def question_scan(spark, d):
    one = F.struct(F.col("c_custkey").alias("questionId"), F.concat(F.lit("who is "), "c_name", F.lit("?")).alias("question"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".png")).alias("image"))
    files = scans.table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(one)).alias("data"))
    texts = graph.stored(files.select(F.col("c_nationkey").alias("doc_id"), F.to_json(F.struct("data")).alias("value")))
    return scans.question_rows(scans.json_rows(texts, scans.QUESTIONS)).select(F.col("ord").cast("long").alias("ord"), "question_id", "question", "image")


@query
def answer_scan(spark, d):
    one = F.struct(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey")).alias("questionId"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("answer"))
    files = scans.table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(one).alias("x"))
    return scans.answer_rows(graph.stored(files.select(F.to_json("x").alias("value"))))


@query
def pixel_boxes(spark, d):
    rows = scans.text_regions(spark, d).withColumns({"w": F.lit(200.0), "h": F.lit(150.0)})
    x = G.clamped(G.Box.of(), F.col("w"), F.col("h"))
    return rows.select("doc_id", "region", x.l.alias("l"), x.t.alias("t"), x.r.alias("r"), x.b.alias("b")).filter("r > l AND b > t")


@query
def polygon_anchor(spark, d):
    rows = scans.text_regions(spark, d)
    return rows.select("doc_id", "region", F.size(G.polygon_points(corners())).alias("points"), G.polygon_points(corners())[2]["x"].alias("third_x"), *G.polygon_anchor(corners()))


@query
def sentence_slots(spark, d):
    rows = scans.text_regions(spark, d).withColumns({"n": F.col("doc_id") % 4, "i": F.col("doc_id") % 3 + F.col("region"), "modality": F.when(F.col("doc_id") % 5 == 0, "patch").otherwise("sentence")})
    x = G.slot(G.Box.of(), F.col("modality"), F.col("n"), F.col("i"))
    return rows.select("doc_id", "region", x.l.alias("l"), F.round(x.t, 6).alias("t"), x.r.alias("r"), F.round(x.b, 6).alias("b"))


def _store(spark, d) -> stores.Store:
    """A store of the vector graph, written and read again."""
    w = Walk(spark, d)
    path = f"{graph.shared_dir(spark)}/leafgraph-store-{graph.uuid.uuid4().hex}"
    one = F.lit("g").alias("doc_id")
    text = lambda c: F.col(c).cast("string")
    kept = w.nodes.select(one, text("node").alias("node_id"), "node_type", "label", "modality", "text")
    edges = w.edges.select(one, "edge_ord", text("source").alias("source_id"), text("target").alias("target_id"), "relation", "conf_off")
    stores.save(stores.Store(kept, edges, w.vectors.select(one, text("node").alias("node_id"), F.col("node").alias("row"), "vec")), path)
    if not stores.complete(spark, path):
        raise OSError(f"incomplete store {path}")
    return stores.load(spark, path)


@query
def store_round_trip(spark, d):
    s = _store(spark, d)
    ends = s.edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("conf_off").alias("confident"))
    return s.nodes.join(s.embeddings.select("node_id", F.size("vec").alias("dimensions")), "node_id").join(ends, "node_id", "left").fillna(0).select("node_id", "node_type", "dimensions", "confident")


@query
def embedding_bounds(spark, d):
    v = scans.vectors(spark, d).select(F.lit(1).alias("doc_id"), F.col("node").alias("row"), "vec")
    meta = v.select("doc_id", F.when(F.col("row") % 3 > 0, F.concat(F.lit("n"), F.col("row").cast("string"))).otherwise(" ").alias("node_id"), (F.col("row") * 2 - 10).alias("row"))
    return stores.node_rows(meta, v).select("node_id", "row", F.size("vec").alias("dimensions"))


@query
def graph_scan(spark, d):
    r = scans.text_regions(spark, d)
    node = F.struct(F.when(F.col("region") == 1, F.lit("b")).otherwise("a").alias("id"), F.lit("region").alias("node_type"), F.lit(1).alias("page"), "label", F.lit(0.5).alias("score"), F.struct(F.col("l").alias("left"), F.col("r").alias("right")).alias("bbox"), F.col("region").alias("deg"))
    files = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region", node.alias("x")))).alias("xs"))
    edges = F.array(F.struct(F.lit("a").alias("source_id"), F.lit("b").alias("target_id"), F.lit("next_region").alias("relation")))
    texts = files.select("doc_id", F.to_json(F.struct(F.struct(F.lit("i.png").alias("image_path")).alias("document"), F.col("xs.x").alias("nodes"), edges.alias("edges"))).alias("value"))
    read = stores.graph_rows(graph.stored(texts))
    n = stores.graph_nodes(read)
    e = stores.graph_edges(read).select("doc_id", F.col("source_id").alias("id"), "target_id", F.col("score").alias("edge_score"), "conf_off")
    return n.join(e, ["doc_id", "id"], "left").select("doc_id", "id", F.col("node_ord").cast("long").alias("node_ord"), "label", F.col("bbox.left").alias("l"), "deg", "target_id", "edge_score", "conf_off")


@query
def build_report(spark, d):
    entries = scans.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name")
    build = lambda e: e.filter("doc_id % 4 > 0").select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("no page in "), "c_name")).alias("error"))
    return stores.report(entries, build).select("doc_id", "status")
