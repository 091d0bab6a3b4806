"""Document fingerprints: SimHash by weighted term votes, searched by permuted block tables.

Native: DataFrame and SQL functions only.  A term is a pair of adjacent words,
weighted by its length; each set bit of its 64-bit hash votes for that bit and
each clear bit against it.  Two 32-bit counters share a long, so 32 sums count all
64 bits of a document of any length that a string can have.

Defined cases: null text counts as empty; a text without words has fingerprint
zero, one with a single word has that word as its term; null ids come after all
others; rows alike in id and text count as one document wherever "the next
document" is asked for and each give a row; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import durable

BITS = 64
RADIUS = 3
BLOCKS = 6
SPACES = "[ \\t-\\r]+"
LAST = 2**63 - 1


def terms(text: Column) -> Column:
    """Array of (hash, weight) of the terms of a text."""
    words = F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")

    def term(a: Column, b: Column) -> Column:
        size = F.length(a) + F.length(b)
        return F.struct(F.xxhash64(a, b).alias("h"), (F.lit(1) + (size >= 8).cast("int") + (size >= 14).cast("int")).cast("long").alias("w"))

    return F.element_at(
        F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), term)).otherwise(F.transform(ws, lambda a: term(a, F.lit(""))))), 1
    )


def votes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """SimHash ``fp`` of ``text`` for each combination of ``keys``."""
    spread = df.select(*keys, F.explode_outer(terms(F.col(text))).alias("t")).select(*keys, F.col("t.h").alias("h"), F.col("t.w").alias("w"))
    lane = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(lane) * F.col("w")).alias(f"v{i}") for i in range(32)]
    counted = spread.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    low = F.lit(0xFFFFFFFF)
    fp = F.lit(0).cast("long")
    for i in range(32):
        for shift, count in ((i, F.col(f"v{i}").bitwiseAND(low)), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("total"), F.lit(1 << shift if shift < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, fp.alias("fp"))


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def hexed(c: str) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def successors(docs: DataFrame) -> DataFrame:
    """Distinct (id, none, th) of the documents in order of id, each with its next and its previous.

    Only ids are moved: they are split into ranges; within a range a window finds
    the neighbours, and the ends of the ranges (a row for each) are linked.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = docs.select("id", "none", "th", F.length("text").cast("long").alias("n_chars")).distinct()
    nodes = durable(nodes.repartitionByRange(parts, "id", "none", "th").withColumn("part", F.spark_partition_id()), "ids")
    node = "struct(id, none, th, n_chars)"
    ends = nodes.groupBy("part").agg(F.expr(f"min({node})").alias("first"), F.expr(f"max({node})").alias("last"))
    linked = ends.selectExpr(
        "part",
        "coalesce(lead(first) OVER (ORDER BY part), first_value(first) OVER (ORDER BY part)) AS after",
        "lag(last) OVER (ORDER BY part) AS before",
        "max(last) OVER () AS final",
    ).selectExpr("part AS p", "after", "coalesce(before, final) AS before")
    within = nodes.selectExpr(
        "*",
        f"lead({node}) OVER (PARTITION BY part ORDER BY id, none, th) AS nx",
        f"lag({node}) OVER (PARTITION BY part ORDER BY id, none, th) AS pv",
    )
    return within.join(linked, within.part == linked.p).selectExpr("id", "none", "th", "n_chars", "coalesce(nx, after) AS nx", "coalesce(pv, before) AS pv")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a key that is never null: (id, none, th)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(LAST)).alias("id"), doc_id.isNull().alias("none"), F.xxhash64(text).alias("th"), text.alias("text"))


KEY = ["id", "none", "th"]


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, fp) of distinct fingerprints that differ in ``radius`` bits or fewer.

    The bits are cut into ``blocks``; ``radius`` wrong bits leave at least
    ``blocks - radius`` blocks alike, so a table is kept for each choice of that
    many blocks, permuted to the front as its key.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than blocks")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    tables = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        tables.append(F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    spread = lambda df: df.select("fp", F.explode(F.array(*tables)).alias("e")).select("fp", "e.table", "e.key")
    asked = spread(queries).withColumnRenamed("fp", "query")
    met = spread(prints).join(asked, ["table", "key"])
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("query"))) <= radius).select("query", "fp").distinct()


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, every: int = 100) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    In the edited text the last quarter is replaced by the start of the next
    document.  ``near_count`` (for ids divisible by ``every``; else null) is the
    number of other rows whose fingerprint lies within ``radius``.
    """
    source = keyed(docs)
    order = durable(successors(source), "order")
    order = order.select(
        *KEY, "n_chars", F.col("nx.id").alias("nx_id"), F.col("nx.none").alias("nx_none"), F.col("nx.th").alias("nx_th"),
        F.col("pv.id").alias("pv_id"), F.col("pv.none").alias("pv_none"), F.col("pv.th").alias("pv_th"), F.expr("pv.n_chars div 4").alias("wanted"),
    )
    here = source.join(order, KEY)
    start = here.select(
        F.col("pv_id").alias("id"), F.col("pv_none").alias("none"), F.col("pv_th").alias("th"), F.expr("substring(text, 1, cast(wanted AS int))").alias("start")
    ).dropDuplicates(KEY)
    both = here.join(start, KEY).selectExpr(
        *KEY, "n_chars", "nx_id", "nx_none", "nx_th", "text", "concat(substring(text, 1, cast(n_chars - n_chars div 4 AS int)), start) AS edited"
    )
    facts = [*KEY, "n_chars", "nx_id", "nx_none", "nx_th"]
    two = both.select(*facts, F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("x")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("x")))).alias("e"))
    two = two.withColumns({"which": F.col("e.which"), "x": F.col("e.x")})
    voted = durable(votes(two, [*facts, "edited_sha256", "which"], "x"), "votes")
    pairs = voted.groupBy(*facts, "edited_sha256").agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    pairs = durable(pairs, "pairs")
    following = pairs.select(F.col("id").alias("nx_id"), F.col("none").alias("nx_none"), F.col("th").alias("nx_th"), F.col("fp").alias("next_fp"))
    done = pairs.join(following, ["nx_id", "nx_none", "nx_th"])
    # rows alike in id and text were one so far; the counts bring them back
    often = source.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"))
    done = durable(done.join(often, KEY), "likeness")
    prints = done.groupBy("fp").agg(F.sum("rows").alias("rows"))
    asked = done.filter((F.col("id") % every == 0) & ~F.col("none")).select("fp").distinct()
    found = neighbours(prints.select("fp"), asked, radius, blocks).join(prints, "fp").groupBy("query").agg((F.sum("rows") - 1).alias("near"))
    near = done.filter((F.col("id") % every == 0) & ~F.col("none")).select(*KEY, "fp").join(found, F.col("fp") == F.col("query")).select(*KEY, F.col("near").alias("near_count"))
    return done.join(near, KEY, "left").select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "near_count",
        F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))).alias("_"),
    ).drop("_")
