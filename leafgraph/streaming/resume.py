"""A stream of questions answered once each: the resumable batch as a streaming query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def answer_stream(questions: DataFrame, solve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that appends answers of questions not answered yet to the table at ``path``.

    The checkpoint makes each file of questions count once; the anti-join keeps a
    question that comes again, or a batch that runs again, from being answered twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["question_id"])
        old = known(batch.sparkSession, path)
        if old is not None:
            new = new.join(old, "question_id", "left_anti")
        solve(new).write.mode("append").parquet(path)

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known(spark: SparkSession, path: str) -> DataFrame | None:
    """Ids answered so far; none before the first batch."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select("question_id")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
