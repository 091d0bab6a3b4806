"""Resumable batches of questions, and the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.text import strip

FAILED = "ERROR"


def distinct_entries(entries: DataFrame, key: str, order: str) -> DataFrame:
    """The first entry of each key that isn't blank."""
    w = Window.partitionBy(key).orderBy(order)
    return entries.filter(strip(F.col(key)) != "").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pending(questions: DataFrame, answers: DataFrame, overwrite: bool = False) -> DataFrame:
    """Questions that have no answer yet; failed ones count as answered, and with ``overwrite`` none do."""
    return questions if overwrite else questions.join(answers, "question_id", "left_anti")


def upsert(questions: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Answers in the order of the questions: new ones first, then old ones."""
    joined = questions.join(new.withColumnRenamed("answer", "_new"), "question_id", "left").join(old.withColumnRenamed("answer", "_old"), "question_id", "left")
    return joined.select("ord", "question_id", F.coalesce("_new", "_old").alias("answer")).filter("answer IS NOT NULL")


def bundle(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose image is there, with the image's bare name, and the distinct images that are missing."""
    named = entries.withColumn("file", F.regexp_extract("image", r"([^/\\]*)$", 1))
    return named.join(files, "file", "left_semi"), named.join(files, "file", "left_anti").select("file").distinct()


def backfill(payloads: DataFrame, siblings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Payloads without a document take that of the graph beside them."""
    other = siblings.select(key, F.col("document").alias("_document"))
    return payloads.join(other, key, "left").withColumn("document", F.coalesce("document", "_document")).drop("_document")
