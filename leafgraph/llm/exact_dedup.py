"""Exact deduplication by composable polynomial fingerprints.

Every text, with runs of ASCII white space made one space, gets the polynomial
sum of its bytes modulo three primes.  The hash of two joined parts follows from
their hashes, shifted by the length of the second part, so a huge text is cut
into segments that are hashed in parallel and combined.  Texts with equal
fingerprint and length are then compared chunk by chunk with the one of their
group that stays; only members of groups of two or more are read again.

Defined cases: null text counts as empty; of equal texts the row with the
smallest doc_id stays (null ids last; of rows that share the id too, one);
texts are found again by their id and the hash of their bytes, so many rows under
one id, or none, never meet each other; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import ARROW_BATCH_BYTES, chosen_texts, durable, join_by_key, texts_of

#: Primes below 2**31, and one base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 69621, 1664525)
#: Sums of STEP products of a byte and a residue stay exact in doubles.
STEP = 8192
SEGMENT_BYTES = 4 << 20
CHUNK_BYTES = 256 << 10
#: Members of a group that are compared with one copy of the row that stays.
COMPARED_TOGETHER = 32
RUN = re.compile(rb"[ \t-\r]+")

_powers: dict = {}


def normalise(raw: bytes) -> bytes:
    """Every run of space and \\t \\n \\v \\f \\r becomes one space."""
    if len(raw) > SEGMENT_BYTES:  # a list of the words of a huge text takes many times its size
        return RUN.sub(b" ", raw)
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + b" ".join(words) + b" " * raw[-1:].isspace()


def powers(primes: tuple = PRIMES, bases: tuple = BASES):
    """Residues base**(STEP-1), ..., base**0, a column for each prime, and base**STEP."""
    import numpy as np

    if (primes, bases) not in _powers:
        table = np.empty((STEP, len(primes)))
        value = [1] * len(primes)
        for i in range(STEP - 1, -1, -1):
            table[i] = value
            value = [v * b % p for v, b, p in zip(value, bases, primes)]
        _powers[primes, bases] = table, value
    return _powers[primes, bases]


def fingerprint(data: bytes, primes: tuple = PRIMES, bases: tuple = BASES) -> tuple[int, ...]:
    """Polynomial residues of ``data``: one product for all its chunks, then Horner's rule."""
    import numpy as np

    table, step = powers(primes, bases)
    n = len(data)
    if n <= STEP:
        sums = np.frombuffer(data, np.uint8).astype(np.float64) @ table[STEP - n :]
        return tuple(int(s) % p for s, p in zip(sums, primes))
    rest = -n % STEP
    rows = np.frombuffer(bytes(rest) + data, np.uint8).reshape(-1, STEP).astype(np.float64) @ table
    out = [0] * len(primes)
    for row in rows.tolist():
        out = [(h * s + int(x)) % p for h, s, x, p in zip(out, step, row, primes)]
    return tuple(out)


def shift(n: int, primes: tuple = PRIMES, bases: tuple = BASES) -> tuple[int, ...]:
    """What a hash is multiplied by when ``n`` bytes follow."""
    return tuple(pow(b, n, p) for b, p in zip(bases, primes))


def combine(left: tuple, right: tuple, primes: tuple = PRIMES) -> tuple:
    """Monoid of ``(hash, shift)`` pairs: the pair of the joined bytes."""
    (h, s), (g, t) = left, right
    return (
        tuple((a * b + c) % p for a, b, c, p in zip(h, t, g, primes)),
        tuple(a * b % p for a, b, p in zip(s, t, primes)),
    )


HEAD = ("uid", "doc_id", "th", "n_bytes", "text_sha256")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th")


def fingerprints(docs: DataFrame, segment: int = SEGMENT_BYTES, primes: tuple = PRIMES, bases: tuple = BASES) -> DataFrame:
    """Rows (uid, doc_id, th, n_bytes, text_sha256, f array) of ``docs(doc_id, text)``, durable; ``th`` is a hash of the text as it is."""

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for uid, doc_id, th, raw in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "th")), texts_of(batch)):
                data = normalise(raw)
                head = (uid, doc_id, th, len(data), hashlib.sha256(data).hexdigest())
                if len(data) <= segment:
                    out.append((*head, list(fingerprint(data, primes, bases)), None, None))
                else:
                    out += [(*head, None, k, data[k * segment : (k + 1) * segment]) for k in range(-(-len(data) // segment))]
            cols = list(zip(*out)) if out else [[]] * 8
            kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            names = [*HEAD, "f", "seg", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data = batch.column("payload").to_pylist()
            f = pa.array([list(fingerprint(x, primes, bases)) for x in data], pa.list_(pa.int64()))
            t = pa.array([list(shift(len(x), primes, bases)) for x in data], pa.list_(pa.int64()))
            kept = [batch.column(c) for c in (*HEAD, "seg")]
            yield pa.RecordBatch.from_arrays([*kept, f, t], names=[*HEAD, "seg", "f", "t"])

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), text_hash(), F.col("text").cast("string"))
    head = "uid long, doc_id long, th long, n_bytes long, text_sha256 string"
    read = durable(source.mapInArrow(first, f"{head}, f array<long>, seg int, payload binary"), "fingerprints")
    whole = read.filter("payload is null").select(*HEAD, "f")
    parts = read.filter("payload is not null")
    if parts.isEmpty():
        return whole
    parts = parts.repartition("uid", "seg").drop("f").mapInArrow(hashed, f"{head}, seg int, f array<long>, t array<long>")
    mod = F.array(*map(F.lit, primes)).cast("array<long>")
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("seg", "f", "t"))),
        F.array_repeat(F.lit(0).cast("long"), len(primes)),
        lambda h, x: F.transform(F.arrays_zip(h.alias("h"), x["f"].alias("g"), x["t"].alias("t"), mod.alias("p")), lambda y: (y["h"] * y["t"] + y["g"]) % y["p"]),
    )
    return durable(whole.unionByName(parts.groupBy(*HEAD).agg(joined.alias("f"))), "fingerprints")


def _rep() -> Column:
    # null ids last; of rows that share an id, the first that was read
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid"))).alias("rep")


def mismatches(docs: DataFrame, members: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Members whose text differs from that of the row that stays: (keep_uid, text_sha256).

    ``members(doc_id, th, text_sha256, keep_uid, group_size, stays)``.  The texts come
    as chunks, sorted so that each chunk of the row that stays is followed by the
    members' chunks of the same number; a task holds one chunk to compare with.
    Large groups are split over copies of the row that stays, and each chunk is dealt
    out on its own.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["gid", "part", "chunk", "role", "sha", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            sha, gid = batch.column("text_sha256").to_pylist(), batch.column("keep_uid").to_pylist()
            size, salt = batch.column("group_size").to_pylist(), batch.column("salt").to_pylist()
            out: list[tuple] = []
            held = 0
            for k, raw in enumerate(texts_of(batch)):
                data = normalise(raw)
                if hashlib.sha256(data).hexdigest() != sha[k]:
                    continue  # another row with the same id
                parts = -(-size[k] // COMPARED_TOGETHER)
                stays = salt[k] < 0
                mine = range(parts) if stays else [salt[k] % parts]
                for c in range(max(1, -(-len(data) // chunk))):
                    piece = data[c * chunk : (c + 1) * chunk]
                    for part in mine:
                        out.append((gid[k], part, c, 1 - stays, sha[k], piece))
                        held += len(piece)
                        if len(out) >= 1000 or held >= ARROW_BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, held = None, b""
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("gid", "part", "chunk", "role", "sha", "data")]
            for gid, part, c, role, sha, data in zip(*cols):
                if role == 0:
                    at, held = (gid, part, c), data
                elif at != (gid, part, c) or held != data:
                    out.append((gid, sha))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["keep_uid", "text_sha256"])

    doc_id = F.col("doc_id").cast("long")
    key = [F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), "th"]
    ids = members.groupBy(*key, "text_sha256", "keep_uid", "group_size").agg(F.max("stays").cast("int").alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = durable(ids, "members")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_003)).alias("salt")
    # only texts with the id of a member are dealt out
    asked = ids.select(F.when(~F.col("none"), F.col("id")).alias("key"))
    texts = chosen_texts(docs.select(doc_id.alias("doc_id"), F.col("text").cast("string"), salt), asked)
    source = texts.select("doc_id", "text", text_hash(), "salt").select(*key, "text", "salt")
    total = ids.agg(F.sum("n")).first()[0] or 0
    found, facts = ["id", "none", "th"], ["text", "text_sha256", "keep_uid", "group_size"]
    # the text that stays comes once, however many rows have it
    stay = join_by_key(source, ids.filter("stays = 1"), found, "n", total, "merge").select(*facts).distinct().withColumn("salt", F.lit(-1).cast("long"))
    rows = stay.unionByName(join_by_key(source, ids, found, "n", total, "merge").select(*facts, "salt"))
    chunks = rows.mapInArrow(cut, "gid long, part long, chunk long, role int, sha string, data binary")
    ordered = chunks.repartition("gid", "part", "chunk").sortWithinPartitions("gid", "part", "chunk", "role")
    return ordered.mapInArrow(compare, "keep_uid long, text_sha256 string").distinct()


def deduplicate(docs: DataFrame, segment: int = SEGMENT_BYTES, primes: tuple = PRIMES, bases: tuple = BASES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = fingerprints(docs, segment, primes, bases).withColumn("tie", F.lit(""))
    key = ["n_bytes", "f", "tie"]
    while True:
        groups = durable(rows.groupBy(*key).agg(_rep(), F.count(F.lit(1)).alias("group_size")).select(*key, "rep.keep_id", "rep.keep_uid", "group_size"), "groups")
        total = rows.count()
        copies = groups.filter("group_size > 1")
        members = join_by_key(rows, copies, key, "group_size", total).withColumn("stays", F.col("uid") == F.col("keep_uid"))
        wrong = durable(mismatches(docs, members), "mismatches")
        if wrong.isEmpty():
            break
        # different texts with one fingerprint: their groups are split by SHA-256 and compared again
        split = groups.join(wrong.select("keep_uid").distinct(), "keep_uid", "left_semi").select(*key, "group_size")
        again = join_by_key(rows, split, key, "group_size", total).select("uid", F.lit(True).alias("again"))
        rows = durable(
            rows.join(again, "uid", "left").withColumn("tie", F.when(F.col("again"), F.col("text_sha256")).otherwise(F.col("tie"))).drop("again"), "split"
        )
    out = join_by_key(rows, groups, key, "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
