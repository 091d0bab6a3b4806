"""Near-duplicates by the share of word shingles that two texts have in common.

Documents whose SimHash fingerprints the Golay keys of ``simhash_dedup`` link, and whose
texts prove similar to that of their group's least id, form the first groups.  Repeated
lines outvote the rest of a text in its fingerprint, so a link alone is no proof; pairs
it doesn't prove are left to what follows.  Fingerprints of texts that share just 0.8 of their five-word shingles
differ in six to fourteen of 64 bits, beyond what those keys can find; so every text
whose similarity (shared shingles over all shingles of both) reaches the threshold is
looked for exactly:

* shingle hashes are put in one order, the common ones last; two sets of n and m hashes
  with similarity t share a hash among the first n - ceil(t n) + 1 and m - ceil(t m) + 1,
  so only these leading hashes are dealt out, once, and those that no other document has
  are dropped as they are read;
* the members of a hash of over DENSE documents of about one size are compared with their
  pivot, in ROUNDS rounds.  The pivot is the member with the least share of leading hashes
  of its own: of a text and its edited copies, the text.  Linked documents form groups,
  and what is left to compare are members of different groups;
* of these pairs only those go on whose leading hashes that other documents have, and
  then the ones both have, are so many that the rest of the sets could make them similar.
  With common hashes last an edited copy's own hashes lead, so copies too far from their
  text are left out before they meet each other;
* a comparison counts the hashes of both whole texts; only texts that have a comparison
  are dealt out.  The text of a pivot goes to as many slots as its partners need, and each
  slot is read as a stream.

Defined cases: null text counts as empty; texts without words are linked with each
other; fewer words than a shingle has make one shingle; ids must be unique and not
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import chosen_texts, components, durable, join_by_key, texts_of, trim
from leafgraph.llm.simhash_dedup import SEED, near_duplicates, shingle_blocks

SHINGLE = 5
SIMILARITY = 0.8
ROUNDS = 2
#: Hashes of the most documents that come last in the order; the number changes costs only.
COMMON = 100_000
#: A hash is common from this number of documents on.
DENSE = 64
#: Hashes that a task counts at once; only those seen FREQUENT times go on, so rare ones are never dealt out to be counted.
COUNTED = 2_000_000
FREQUENT = 4
#: Tasks that the rows of one common hash are dealt to.
SPREAD = 64
#: Bytes of one Arrow batch; hashing a text takes several times its size.
BATCH_BYTES = 2 << 20
#: Partners of a pivot that are compared in one slot.
SLOT = 256
#: Members of a hash that one task holds in the last round.
SPLIT = 500


def hashes(raw: bytes, shingle: int):
    """Distinct hashes of the shingles of a text, ascending."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh64

    parts = []
    for part in shingle_blocks(raw, shingle):
        count = max(1, len(part) - shingle + 1)
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        parts.append(np.unique(np.fromiter((xxh64(g, SEED) for g in grams), "<u8", count).view(np.int64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.int64), *parts]))


def frequent(docs: DataFrame, shingle: int) -> list[int]:
    """Up to COMMON hashes of many documents, by counts of COUNTED hashes of a task at a time.

    Which hashes are found changes the order of hashes and so the costs, never the links.
    """

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def counted(parts: list):
            token, times = np.unique(np.concatenate(parts), return_counts=True)
            often = times >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(token[often]), pa.array(times[often])], names=["token", "times"])

        parts, held = [], 0
        for batch in batches:
            for raw in texts_of(batch):
                parts.append(hashes(raw, shingle))
                held += len(parts[-1])
                if held >= COUNTED:
                    yield counted(parts)
                    parts, held = [], 0
                    trim()
        if held:
            yield counted(parts)
        del parts
        trim()

    counts = docs.select("text").mapInArrow(scan, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    return [r.token for r in counts.filter(F.col("times") >= DENSE).orderBy(F.desc("times"), "token").limit(COMMON).collect()]


def leading(docs: DataFrame, shingle: int, similarity: Fraction, common: list[int]) -> DataFrame:
    """The hashes (token, key, n, hot) of each document that a similar one may share; hot ones are common."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last = np.sort(np.asarray(common, np.int64))
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            tokens, owners, sizes, hots = [], [], [], []
            for key, raw in zip(keys, texts_of(batch)):
                own = hashes(raw, shingle)
                n = len(own)
                if not n:
                    continue
                late = np.zeros(n, bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                    own, late = np.concatenate([own[~late], own[late]]), np.sort(late)
                lead = n + 1 - -(-similarity.numerator * n // similarity.denominator)
                tokens.append(own[:lead])
                hots.append(late[:lead])
                owners.append(np.full(lead, key, np.int64))
                sizes.append(np.full(lead, n, np.int64))
            if tokens:
                columns = [pa.array(np.concatenate(x)) for x in (tokens, owners, sizes, hots)]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "key", "n", "hot"])
            del tokens, owners, sizes, hots
            trim()

    return docs.mapInArrow(scan, "token long, key long, n long, hot boolean")


def repeated(rows: DataFrame) -> DataFrame:
    """The ``rows`` (token, key, n) of hashes that two documents have; of hot hashes all rows."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]  # the last row so far, if its hash was seen once
        seen = None  # the last hash so far, if it was seen more often
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "key", "n", "hot")]
            token, key, n, hot = (np.concatenate(x) for x in zip(held, now))
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            kept = hot.copy()
            kept[1:] |= same
            kept[:-1] |= same
            if seen is not None:
                kept |= token == seen
            seen = token[-1] if kept[-1] else None
            held = [x[-1:] if seen is None else x[:0] for x in (token, key, n, hot)]
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (token, key, n)], names=["token", "key", "n"])

    dealt = rows.repartition("token", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SPREAD))).otherwise(F.lit(0)))
    return dealt.sortWithinPartitions("token").mapInArrow(scan, "token long, key long, n long")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` whose texts are similar."""

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        place, held = None, None
        for batch in batches:
            found = []
            for a, slot, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "slot", "b")), texts_of(batch)):
                own = hashes(raw, shingle)
                if b is None:
                    place, held = (a, slot), own
                    continue
                assert place == (a, slot), "a pivot comes before its partners"
                both = len(np.intersect1d(held, own, assume_unique=True))
                if both * similarity.denominator >= similarity.numerator * (len(held) + len(own) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            trim()

    members = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    docs = durable(chosen_texts(docs, members), "texts")
    slots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SLOT).alias("slots"), F.count(F.lit(1)).alias("size"))
    slots = durable(slots, "slots")
    placed = join_by_key(pairs, slots, ["a"], "size", pairs.count())
    placed = durable(placed.select("a", F.pmod(F.xxhash64("b"), "slots").alias("slot"), "b"), "placed")
    partners = placed.join(docs, placed.b == docs.doc_id).select("a", "slot", "b", "text")
    used = placed.groupBy("a", "slot").agg(F.lit(None).cast("long").alias("b"))
    pivots = used.join(docs, used.a == docs.doc_id).select("a", "slot", "b", "text")
    rows = pivots.unionByName(partners).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return rows.mapInArrow(compare, "a long, b long")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with unique ids: doc_id, component_id.

    ``component_id`` is the least id reachable through links of a similarity of at least ``similarity``.
    """
    settings, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = settings.get(name)
    settings.set(name, str(BATCH_BYTES))
    try:
        return linked_documents(docs, shingle, Fraction(str(similarity)))
    finally:
        settings.set(name, usual)


def linked_documents(docs: DataFrame, shingle: int, least_share: Fraction) -> DataFrame:
    """``similar_documents`` under the settings that it makes."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    start = durable(near_duplicates(docs, shingle).select("doc_id", "component_id"), "start")
    tested = durable(start.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "linked")
    bare = docs.filter(~F.coalesce("text", F.lit("")).rlike(r"\S")).select(F.col("doc_id").alias("b"))
    least = bare.agg(F.min("b")).first()[0]
    bare = bare.select(F.lit(least).cast("long").alias("a"), "b").filter("a <> b")
    edges = durable(verified(tested, docs, shingle, least_share).unionByName(bare), "edges")

    common = frequent(docs, shingle)
    rows = distinct_buckets(durable(repeated(leading(docs, shingle, least_share, common)), "leading"), least_share)
    total = rows.count()

    groups = None  # of the edges so far
    for step in range(ROUNDS + 1 if total else 0):
        groups = durable(components(edges), "groups") if groups is None else groups
        known = grouped(rows, groups)
        if step < ROUNDS:
            known = known.withColumn("class", F.floor(F.log("n") / F.log(F.lit(float(1 / least_share))) + step / ROUNDS))
            first = F.struct("lone", F.xxhash64("key").alias("x"), "key", "n", "root")
            mixed = known.groupBy("token", "class").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(first).alias("p"), F.count(F.lit(1)).alias("size"))
            mixed = durable(mixed.filter((F.col("low") != F.col("high")) & (F.col("size") > DENSE)).select("token", "class", "p", "size"), "mixed")
            if mixed.isEmpty():
                continue
            left = join_by_key(known, mixed, ["token", "class"], "size", total)
            met = left.filter(F.col("root") != F.col("p.root")).select(F.col("p.key").alias("a"), F.col("key").alias("b"), F.col("p.n").alias("n"), F.col("n").alias("m"))
            pairs = met.filter(alike(least_share)).select("a", "b").distinct()
        else:
            mixed = known.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
            mixed = durable(mixed.filter("low <> high").select("token", "size"), "mixed")
            if mixed.isEmpty():
                break
            left = durable(join_by_key(known, mixed, ["token"], "size", total).select("token", "size", "key", "n", "w", "s", "root"), "left")
            # a hash of many members is split: each task holds a share of them and meets all others
            parts = F.ceil(F.col("size") / SPLIT)
            here = left.withColumn("part", F.pmod(F.xxhash64("key"), parts)).drop("size")
            other = left.select("token", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("key").alias("b"), F.col("n").alias("m"), F.col("s").alias("r"), F.col("root").alias("q"))
            possible = alike(least_share) & enough(F.least("s", "r"), least_share)
            met = here.join(other, ["token", "part"]).filter((F.col("key") < F.col("b")) & (F.col("root") != F.col("q")) & possible)
            met = met.groupBy(F.col("key").alias("a"), "b").agg(F.sum("w").alias("c"), F.min("n").alias("n"), F.min("m").alias("m"))
            pairs = met.filter(enough(F.col("c"), least_share)).select("a", "b")
        either = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = durable(pairs.join(either, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        edges, groups = durable(edges.unionByName(verified(pairs, docs, shingle, least_share)), "edges"), None
    named = (components(edges) if groups is None else groups).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    return start.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def distinct_buckets(rows: DataFrame, share: Fraction) -> DataFrame:
    """``rows`` of one hash for each set of members, and the number ``w`` of such hashes.

    Near copies share many hashes.  Sets of members are told apart by their number and 128 bits of their ids' hashes.
    ``s`` is the number of a document's leading hashes that others have, ``lone`` the share of those that are its own.
    """
    marks = [F.bit_xor(F.xxhash64("key", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)]
    buckets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *marks).filter("size > 1")
    kept = durable(buckets.groupBy("size", "m1", "m2").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("w")).select("token", "size", "w"), "kept")
    total = kept.agg(F.sum("size")).first()[0] or 0
    rows = durable(join_by_key(rows, kept, ["token"], "size", total).select("token", "key", "n", "w"), "buckets")
    shared = rows.groupBy("key").agg(F.sum("w").alias("s"))
    lead = F.col("n") - after("n", share)
    return durable(rows.join(shared, "key").withColumn("lone", 1 - F.col("s") / lead), "members")


def after(n: str, share: Fraction):
    """How many hashes of a set of ``n`` follow the leading ones: ceil(t n) - 1."""
    p, q = share.numerator, share.denominator
    return F.expr(f"({p} * {n} + {q - 1}) div {q} - 1")


def alike(share: Fraction):
    """Whether the sizes ``n`` and ``m`` of two sets allow the similarity."""
    return F.least("n", "m") * share.denominator >= F.greatest("n", "m") * share.numerator


def enough(c, share: Fraction):
    """Whether two sets of ``n`` and ``m`` may be similar that have at most ``c`` of their leading hashes in common.

    Of the set whose leading hashes end first, ceil(t n) - 1 hashes follow; the sets have
    at most c and these in common, and similar ones at least t / (1 + t) of n + m.
    """
    p, q = share.numerator, share.denominator
    return (c + after("greatest(n, m)", share)) * (p + q) >= (F.col("n") + F.col("m")) * p


def grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their group so far."""
    found = rows.join(groups.withColumnRenamed("node", "key"), "key", "left")
    return found.select(*rows.columns, F.coalesce("root", "key").alias("root"))
