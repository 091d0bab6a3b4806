"""A corpus pipeline: toxic documents go, then copies, then near copies; personal data
becomes pseudonyms; what is left is packed into training sequences.

Each stage is ``f(spark, docs, sf_dir)``; its result is written as Parquet and read again
as the next one's ``docs``.  All stages but the last return the columns of ``docs``, in
their order and with their types, whatever their names: columns that a stage adds for
itself take names that ``docs`` has not.

Defined cases, for all stages: a null text counts as empty and stays null; null and
repeated ids are allowed, each row is a document of its own; of rows alike in all that a
stage looks at one stays where one may stay, else all; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle and least share of common shingles in the near-duplicate stage.
SHINGLE = 5
SIMILARITY = 0.8
#: Bytes of words whose ids a packing worker remembers; few, as executors that ran the other stages are large.
WORD_MEMORY = 2 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go; learned from ``labels`` outside the held-out fold.

    Texts without a word score 0 and stay; without labels of both kinds all stay.
    """
    from leafgraph.llm.common import free_name, named, ready, table
    from leafgraph.llm.toxicity import THRESHOLD, fit, score

    ready(spark)
    found = free_name(docs, "_score")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, docs.columns, found).filter(F.col(found) < THRESHOLD).select(*named(docs.columns))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique key and its name: doc_id, or where ids repeat or are null, a frozen row number."""
    from leafgraph.llm.common import durable, free_name

    key = free_name(docs, "_key")
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if counted.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return durable(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def kept(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is among ``ids(doc_id)``, without the key."""
    from leafgraph.llm.common import named

    found = docs.join(ids.select(F.col("doc_id").alias(key)), key, "left_semi")
    return found.select(*named([c for c in docs.columns if c != key]))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (up to white space) the one with the least id stays; null is the empty text."""
    from leafgraph.llm.common import ready
    from leafgraph.llm.exact_dedup import deduplicate

    ready(spark)
    docs, key = keyed(docs)
    found = deduplicate(docs.select(F.col(key).alias("doc_id"), "text"))
    return kept(docs, key, found.filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of five-word shingles of 0.8 or more, the one with the least id stays.

    Documents without a word are linked with each other.
    """
    from leafgraph.llm.common import ready
    from leafgraph.llm.similar import similar_documents

    ready(spark)
    docs, key = keyed(docs)
    found = similar_documents(docs.select(F.col(key).alias("doc_id"), "text"), SHINGLE, SIMILARITY)
    return kept(docs, key, found.filter("doc_id = component_id"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format; n_chars, if there, follows the new text.

    The key is that of ``leafgraph.llm.pii``: a Spark setting, else one drawn for the session.
    """
    from leafgraph.llm.common import free_name, named, ready
    from leafgraph.llm.pii import pseudonymise

    ready(spark)
    count = free_name(docs, "n_pii")
    out = pseudonymise(docs, count=count)
    columns = dict(zip(docs.columns, named(docs.columns)))
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col(count) > 0, length).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*columns.values())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 4096 ids; an empty document is its end id alone."""
    import public_tokenizers

    from leafgraph.llm.common import ready
    from leafgraph.llm.packing import pack

    ready(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), memory=WORD_MEMORY)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Scores, SimHash and Feistel networks have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    from leafgraph.llm.common import durable, table

    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
