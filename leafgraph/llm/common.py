"""What the operators share: durable tables, skew-safe joins, connected components."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy when it holds at least 1/HEAVY_SHARE of all rows, so there are
#: never more than HEAVY_SHARE heavy keys and a table of them may be broadcast.
HEAVY_SHARE = 2000

#: Bytes of one Arrow batch sent to a Python worker (text columns are wide).
ARROW_BATCH_BYTES = 2 << 20

#: Share of its bound that the driver's heap may take before its garbage is collected.
HEAP_SHARE = 0.5

#: Bits of the map of document ids that texts are chosen with, 8 MB at any size.
MAP_BITS = 1 << 26

#: Bytes of a text that are split into words at once.
TEXT_BLOCK = 4 << 20
BLANK = re.compile(rb"[ \t-\r]")

#: Folders of durable tables that are deleted when the driver ends.
_kept: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a dataset folder, by any path that Spark can read."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and let local Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root = str(Path(__file__).resolve().parents[2])
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is made only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of this application, which goes when its driver ends."""
    folder = f"{shared_dir(spark)}/leafgraph-{spark.sparkContext.applicationId}"
    if folder not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _kept.add(folder)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without
    recomputing, and values that depend on a task (row ids) are frozen.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Give memory that the driver's JVM has freed back to the system, as ``trim`` does for a worker.

    Many short jobs leave it in the C library's pools, and a heap over HEAP_SHARE of its
    bound as garbage, which the JVM has no reason of its own to collect.
    """
    jvm = spark._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # a JVM without the command
        invoke.invoke(server, args)


def forget(table: DataFrame) -> None:
    """Delete the files of a durable table that nothing reads any more."""
    spark = table.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has a column of that name in any case, one that it has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, which may have dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int, how: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with one row of ``facts`` per key, whatever the skew.

    ``facts[size]`` is the number of rows with that key and ``total`` the number
    of all rows.  Rows of heavy keys (at most HEAVY_SHARE keys, so their facts are
    broadcast) never meet in one task; the others go through an ordinary join, with the
    strategy ``how`` if it should be the same at all sizes.
    """
    heavy = facts.filter(F.col(size) * HEAVY_SHARE >= F.lit(total))
    light = facts.filter(F.col(size) * HEAVY_SHARE < F.lit(total))
    light = light.hint(how) if how else light
    few = F.broadcast(heavy)
    hot = rows.join(few, keys, "inner")
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "inner")
    return hot.select(*rest.columns).unionByName(rest)


def chosen_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with at least the ids in ``keys(key)``, through a broadcast map of MAP_BITS bits."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)) + 1
    bits = keys.select(place("key").alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket"))
    bits = bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    found = docs.withColumn("place", place("doc_id")).withColumn("bucket", F.expr("bitmap_bucket_number(place)"))
    byte = "cast(conv(hex(substring(bits, cast(bitmap_bit_position(place) div 8 as int) + 1, 1)), 16, 10) as int)"
    found = found.join(F.broadcast(bits), "bucket").filter(F.expr(f"getbit({byte}, cast(bitmap_bit_position(place) % 8 as int)) = 1"))
    return found.select(*docs.columns)


#: Edges (16 bytes each) that one task may join in memory.
LOCAL_EDGES = 500_000


def united(batches: Iterator) -> Iterator:
    """Union by least root of the edges of one task."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])
    root.clear()
    nodes.clear()
    trim()


def components(edges: DataFrame, tag: str = "cc", local: int = LOCAL_EDGES) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` as ``(node, root)``.

    ``root`` is the smallest node of the component.  Alternates the large-star and
    small-star steps until nothing changes; a node of any degree is reduced by
    partial aggregation and its edges are joined through ``join_by_key``.  Up to
    ``local`` edges, counted first, are joined by one task instead; the result is
    the same.  Nodes are non-null longs; loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    current = durable(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag
    )
    if current.count() <= local:
        return current.repartition(1).mapInArrow(united, "node long, root long")
    before = None
    while True:
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0:
            return spark.createDataFrame([], "node long, root long")
        if before == (mark["n"], mark["h"]):
            break
        before = (mark["n"], mark["h"])
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("deg"))
        least = least.withColumn("m", F.least("m", "a"))
        large = join_by_key(both, least, ["a"], "deg", 2 * mark["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("deg"))
        small = join_by_key(large, down, ["a"], "deg", mark["n"]).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        current = durable(small.select("e.a", "e.b").filter("a <> b").distinct(), tag)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def texts_of(batch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column of an Arrow batch; null counts as empty."""
    import pyarrow as pa

    for x in batch.column(name).cast(pa.binary()).to_pylist():
        yield x or b""


def word_blocks(raw: bytes, overlap: int = 0, block: int = TEXT_BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, block by block; each block but the first begins with the last ``overlap`` words before it."""
    if len(raw) <= block:
        yield raw.split()
        return
    at, held = 0, []
    while at < len(raw):
        gap = BLANK.search(raw, min(len(raw), at + block))
        end = gap.start() if gap else len(raw)
        words = held + raw[at:end].split()
        yield words
        held = words[-overlap:] if overlap else []
        at = end


def trim() -> None:
    """Give the freed memory of this worker back to the system; a reused worker would hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)
