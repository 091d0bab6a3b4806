"""Scans of OCR, layout, question and answer files, and the tables derived from the test tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions import geometry as G
from leafgraph.functions.text import strip
from leafgraph.operators.joins import reading_order

#: Shapes of the files; readers give missing fields as null.
POLYGON_OCR = (
    "recognitionResults array<struct<page:int,lines:array<struct<text:string,boundingBox:array<double>,"
    "words:array<struct<text:string,boundingBox:array<double>>>>>>>"
)
BLOCK = "array<struct<Id:string,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>,Relationships:array<struct<Type:string,Ids:array<string>>>>>"
BLOCK_OCR = f"WORD {BLOCK}, LINE {BLOCK}, PAGE {BLOCK}"
DETECTION = "struct<label:string,score:double,bbox_xyxy:array<double>,content:string>"
QUESTIONS = "data array<struct<questionId:bigint,question:string,image:string>>"
ANSWERS = "array<struct<questionId:bigint,answer:string>>"


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON objects with the name of their document."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("doc_id")
    return spark.read.schema(schema).json(path, multiLine=True).select(name, "*")


def json_rows(rows: DataFrame, schema: str) -> DataFrame:
    """Rows (doc_id, value) of JSON objects, one a document: for corpora of more documents than a folder should have files."""
    return rows.select("doc_id", F.from_json("value", schema).alias("x")).select("doc_id", "x.*")


def block_types(listed: str) -> list[str]:
    """The kinds of blocks in a comma-separated option; LINE if there is none."""
    found = [x.strip().upper() for x in listed.split(",") if x.strip()]
    if wrong := [x for x in found if x not in ("WORD", "LINE", "PAGE")]:
        raise ValueError(f"unknown block types {', '.join(wrong)}")
    return found or ["LINE"]


def ocr_words(files: DataFrame, page: int | None = 1) -> DataFrame:
    """Words of polygon OCR with their boxes, in the order of the file; blank ones are dropped."""
    pages = files.select("doc_id", F.explode("recognitionResults").alias("p"))
    if page is not None:
        pages = pages.filter(F.col("p.page") == page)
    lines = pages.select("doc_id", F.col("p.page").alias("page"), F.posexplode("p.lines").alias("line_no", "line"))
    words = lines.select("doc_id", "page", "line_no", F.posexplode("line.words").alias("word_no", "w")).filter(strip(F.col("w.text")) != "")
    return words.select("doc_id", "page", (F.col("line_no").cast("long") * 100_000 + F.col("word_no")).alias("input_ord"), F.col("w.text").alias("text"), *G.from_polygon(F.col("w.boundingBox"))).filter("l IS NOT NULL")


def ocr_lines(files: DataFrame) -> DataFrame:
    """Lines of all pages of polygon OCR whose polygon has exactly eight numbers."""
    pages = files.select("doc_id", F.explode("recognitionResults").alias("p"))
    lines = pages.select("doc_id", F.col("p.page").alias("page"), F.posexplode("p.lines").alias("input_ord", "x")).filter(F.size("x.boundingBox") == 8)
    return lines.select("doc_id", "page", "input_ord", F.col("x.text").alias("text"), *G.from_polygon(F.col("x.boundingBox")))


def page_of(lines: DataFrame, page: int) -> DataFrame:
    """Lines of one page; fails if there is no such page."""
    found = lines.filter(F.col("page") == page)
    if found.isEmpty():
        raise ValueError(f"no page {page}")
    return found


def blocks(files: DataFrame, pages: DataFrame, kind: str = "LINE") -> DataFrame:
    """Blocks of block OCR in pixels; ``pages(doc_id, width, height)`` has the images' sizes."""
    if kind not in ("WORD", "LINE", "PAGE"):
        raise ValueError(f"unknown block type {kind}")
    rows = files.select("doc_id", F.posexplode(kind).alias("input_ord", "x")).join(pages, "doc_id")
    return rows.select("doc_id", F.col("x.Id").alias("id"), "input_ord", F.col("x.Text").alias("text"), F.col("x.Confidence").alias("confidence"), *G.to_pixels(F.col("x.Geometry.BoundingBox"), F.col("width"), F.col("height")), F.flatten(F.transform(F.filter("x.Relationships", lambda r: r["Type"] == "CHILD"), lambda r: r["Ids"])).alias("children"))


def children(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Words of each line by child ids; unknown ids are dropped."""
    asked = lines.select("doc_id", F.col("id").alias("line_id"), F.posexplode("children").alias("pos", "id"))
    return asked.join(words.select("doc_id", "id", "text"), ["doc_id", "id"])


def listed_detections(value: Column) -> Column:
    """The list in a JSON text that is an object with ``detections``, or the list itself."""
    inside = F.from_json(value, f"struct<detections:array<{DETECTION}>>")["detections"]
    bare = F.substring(F.ltrim(value), 1, 1) == "["
    return F.when(bare, F.from_json(value, f"array<{DETECTION}>")).otherwise(inside)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Layout detections of files that hold an object with a list, or the list alone."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("doc_id"), "value")
    listed = listed_detections(F.col("value"))
    return detection_rows(raw.select("doc_id", listed.alias("listed")))


def detection_rows(files: DataFrame) -> DataFrame:
    """Detections of ``files(doc_id, listed)``, numbered in the order of their list."""
    rows = files.select("doc_id", F.posexplode("listed").alias("region", "d"))
    box = [F.col("d.bbox_xyxy")[i].alias(c) for i, c in enumerate("ltrb")]
    return rows.select("doc_id", F.lit(1).alias("page"), "region", "d.label", "d.score", "d.content", *box)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return question_rows(spark.read.schema(QUESTIONS).json(path, multiLine=True))


def question_rows(files: DataFrame) -> DataFrame:
    """Questions of ``files(data)``, in the order of their list."""
    rows = files.select(F.posexplode("data").alias("ord", "q"))
    return rows.select("ord", F.col("q.questionId").alias("question_id"), "q.question", "q.image")


def answers(spark: SparkSession, path: str) -> DataFrame:
    return answer_rows(spark.read.text(path, wholetext=True))


def answer_rows(files: DataFrame) -> DataFrame:
    """Prior answers of JSON texts ``files(value)``; entries without an id or an answer are ignored."""
    rows = files.select(F.explode(F.from_json("value", ANSWERS)).alias("a"))
    return rows.select(F.col("a.questionId").alias("question_id"), "a.answer").filter("question_id IS NOT NULL AND answer IS NOT NULL")


def resolve(path: str, base: str | None = None) -> Path:
    """An existing path: as it is, or below ``base``."""
    for p in (Path(path), Path(base or ".") / path):
        if p.exists():
            return p.resolve()
    raise FileNotFoundError(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of ``documents`` with a made-up layout, in reading order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("input_ord", "text"))
    n, i = F.length("text"), F.col("input_ord")
    left, top = ((n + i) % 3) * 130 + (n * 7) % 60, i * 9 + F.floor(i / 5) * 24 + n % 5
    rows = rows.withColumns({"page": F.lit(1), "l": left.cast("double"), "t": top.cast("double")})
    rows = rows.withColumns({"r": F.col("l") + (F.lit(6) * F.least(n, F.lit(50)) + 6), "b": F.col("t") + (F.lit(10) + n % 6)})
    return reading_order(rows).select("doc_id", "page", "ord", "text", "l", "t", "r", "b")


def text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two made-up regions for each document, with a benchmark passage as content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("region"))
    d, k = F.col("doc_id"), F.col("region")
    label = F.element_at(F.array(*map(F.lit, ("table", "figure", "chart", "image"))), ((d + k) % 4 + 1).cast("int"))
    rows = docs.withColumns({"page": F.lit(1), "label": label, "l": ((d % 3) * 40).cast("double"), "t": (k * 120 + (d % 7) * 10).cast("double"), "item_id": (d * 2 + k) % 40})
    rows = rows.withColumns({"r": F.col("l") + 330, "b": F.col("t") + 70 + (d % 5) * 10})
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("content"))
    return rows.join(bench, "item_id", "left").select("doc_id", "page", "region", "label", "l", "t", "r", "b", F.coalesce("content", F.lit("")).alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"), "label")


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("line", "chunk", "region", "fine")))
    rows = vectors(spark, sf_dir)
    kind, name = F.element_at(kinds, F.col("label") % 4 + 1), F.col("label").cast("string")
    label, modality = F.when(kind != "fine", F.concat(F.lit("class "), name)).otherwise(""), F.when(kind == "fine", F.concat(F.lit("part "), name)).otherwise("")
    return rows.select("node", kind.alias("node_type"), label.alias("label"), modality.alias("modality"), F.concat(F.lit("text of "), F.col("node").cast("string")).alias("text"))


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to the next vector of the class, to the one seven ids on, and to the first of the class."""
    from pyspark.sql import Window

    v = vectors(spark, sf_dir).select("node", "label")
    w = Window.partitionBy("label").orderBy("node")
    first = v.groupBy("label").agg(F.min("node").alias("target"))
    follow = v.select(F.col("node").alias("source"), F.lead("node").over(w).alias("target"), F.lit("next").alias("relation"), F.lit(0).alias("no")).filter("target IS NOT NULL")
    skip = v.select(F.col("node").alias("source"), (F.col("node") + 7).alias("target")).join(v.select(F.col("node").alias("target")), "target").select("source", "target", F.lit("skip").alias("relation"), F.lit(1).alias("no"))
    hub = v.join(first, "label").filter("node <> target").select(F.col("node").alias("source"), "target", F.lit("hub").alias("relation"), F.lit(2).alias("no"))
    return follow.unionByName(skip).unionByName(hub).select("source", "target", "relation", (F.col("no") * F.lit(10_000_000_000) + F.col("source")).alias("edge_ord"))
