"""Join helpers of the layout operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def band_pairs(left: DataFrame, right: DataFrame, low: str, high: str, at: str, band: DataFrame) -> DataFrame:
    """Pairs of one page with ``right[at]`` between ``left[low]`` and ``left[high]``.

    ``band`` gives each page a ``step`` of at least ``high - low``, so a left row
    meets at most two bands: an equi-join whose work follows the near pairs, where
    a join on the page alone would form all pairs of a page.
    """
    step = F.greatest(F.col("step"), F.lit(1.0))
    a = left.join(band, PAGE).withColumn("band", F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))).drop("step")
    b = right.join(band, PAGE).withColumn("band", F.floor(F.col(at) / step)).drop("step")
    return a.join(b, [*PAGE, "band"]).filter(F.col(at).between(F.col(low), F.col(high))).drop("band")


def best(df: DataFrame, keys: list[str], *order: Column, k: int = 1, name: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key (Spark limits the groups before the shuffle)."""
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
    return out if name else out.drop(rank)


def reading_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rank of each row of a page by top, left and the order of input."""
    w = Window.partitionBy(*PAGE).orderBy("t", "l", "input_ord")
    return df.withColumn(name, F.row_number().over(w).cast("long"))
