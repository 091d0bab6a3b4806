"""Near-duplicates by SimHash and Golay-code fuzzy hashing.

A document's 64-bit fingerprint has the majority bits of the hashes of its word
shingles.  Fingerprints within RADIUS bits are found without comparing all pairs:

* the 64 bits are cut into three segments; of at most two wrong bits, some segment
  has none while the next one (cyclically) has at most one;
* a segment is decoded by the perfect binary Golay code of 23 bits.  The codewords
  nearest to the word and to its 23 neighbours (one or six of them) are its keys;
  a word at distance one decodes to one of these;
* fingerprints that share an exact segment and a key are compared.

Buckets of over DENSE fingerprints aren't compared pairwise: each of their members
emits the 65 words of its ball of radius one, and members that meet in a word are
linked to the least of them.  Two words meet just when they differ in two bits or
fewer, so no link is lost, and at most 65 members meet in a word.

Defined cases: null text counts as empty; texts without words have fingerprint
zero and are linked like any other; null ids are ignored in a component's least
id; repeated rows share a fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import HEAVY_SHARE, components, durable, join_by_key, texts_of, trim, word_blocks

SHINGLE = 3
SEED = 42
RADIUS = 2
DENSE = 64
#: Words whose shingles are held at once.
BLOCK_WORDS = 100_000
#: Fixed value: generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))

_golay: list = []


def shingle_blocks(raw: bytes, shingle: int) -> Iterator[list[bytes]]:
    """Lower-case words in blocks that share ``shingle`` - 1 words, so that each shingle is in one; of a shorter text all words."""
    words: list[bytes] = []
    found = False
    for words in word_blocks(raw.lower(), shingle - 1):
        for at in range(0, len(words) - shingle + 1, BLOCK_WORDS):
            found = True
            yield words[at : at + BLOCK_WORDS + shingle - 1]
    if words and not found:
        yield words


def simhash(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text as a signed 64-bit number."""
    import numpy as np
    from xxhash import xxh64_intdigest as xxh64

    votes, n = np.zeros(64, np.int64), 0
    for part in shingle_blocks(raw, shingle):
        count = max(1, len(part) - shingle + 1)
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(part) >= shingle else [b" ".join(part)]
        hashes = np.fromiter((xxh64(g, seed) for g in grams), "<u8", count)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(count, 64)
        votes += bits.sum(axis=0, dtype=np.uint32)
        n += count
    if not n:
        return 0
    out = np.packbits(2 * votes > n, bitorder="little").tobytes()
    return int.from_bytes(out, "little", signed=True)


def golay():
    """(syndrome of each byte of a 24-bit word, error pattern of each syndrome)."""
    import numpy as np

    if not _golay:
        def remainder(x: int) -> int:
            for i in range(22, 10, -1):
                if x >> i & 1:
                    x ^= GENERATOR << (i - 11)
            return x

        single = [remainder(1 << i) for i in range(23)] + [0]
        by_byte = np.zeros((3, 256), np.int64)
        for k in range(3):
            for v in range(256):
                for i in range(8):
                    if v >> i & 1:
                        by_byte[k, v] ^= single[8 * k + i]
        error = np.zeros(2048, np.int64)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    flips = {a, b, c} if len({a, b, c}) != 2 else {a, b} | {c}
                    error[np.bitwise_xor.reduce([single[i] for i in flips])] = sum(1 << i for i in flips)
        _golay.extend((by_byte, error))
    return _golay


def decode(words):
    """Index of the codeword nearest to each 23-bit word."""
    by_byte, error = golay()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ error[syndrome]) >> 11


def bucket_keys(prints):
    """Rows (key, index of the fingerprint, whether the key is its own codeword)."""
    import numpy as np

    x = prints.view(np.uint64)
    parts = [((x >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    keys, owners, centres = [], [], []
    for i in range(3):
        word = parts[(i + 1) % 3]
        own = decode(word)
        near = np.stack([own, *(decode(word ^ (1 << b)) for b in range(23))], axis=1)
        order = np.sort(near, axis=1)
        fresh = np.ones(order.shape, bool)
        fresh[:, 1:] = order[:, 1:] != order[:, :-1]
        row, col = np.nonzero(fresh)
        code = order[row, col]
        keys.append((i << 34) | (parts[i][row] << 12) | code)
        owners.append(row)
        centres.append(code == own[row])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(centres)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, fp)."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prints = pa.array([simhash(raw, shingle, seed) for raw in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), prints], names=["doc_id", "fp"])
            trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``prints(fp)`` within RADIUS bits."""

    def keyed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            key, owner, centre = bucket_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner]), pa.array(centre)], names=["key", "fp", "centre"])

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held_key, held_fp, held_centre = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        crowded = None  # key of a bucket that is known to be dense and goes on

        def flush(key, fp, centre):
            """Links of whole buckets; members of dense ones have no partner."""
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            size = np.repeat(sizes, sizes)
            full = (size > dense) | (key == crowded if crowded is not None else np.zeros(len(key), bool))
            a, b, none = [fp[full]], [fp[full]], [np.ones(full.sum(), bool)]
            key, fp, centre = key[~full], fp[~full], centre[~full]
            for d in range(1, int(min(dense, sizes.max(initial=0)))):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                x, y = fp[i], fp[i + d]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
                near &= np.where(x < y, centre[i], centre[i + d])
                a.append(x[near])
                b.append(y[near])
                none.append(np.zeros(near.sum(), bool))
            a, b, none = np.concatenate(a), np.concatenate(b), np.concatenate(none)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=none)], names=["a", "b"])

        for batch in batches:
            key = np.r_[held_key, np.asarray(batch.column("key"))]
            fp = np.r_[held_fp, np.asarray(batch.column("fp"))]
            centre = np.r_[held_centre, batch.column("centre").to_numpy(zero_copy_only=False)]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if last:
                yield flush(key[:last], fp[:last], centre[:last])
                crowded = None
            key, fp, centre = key[last:], fp[last:], centre[last:]
            if len(key) > dense or crowded is not None:
                crowded = key[0]
                yield flush(key, fp, centre)
                key, fp, centre = key[:0], fp[:0], centre[:0]
            held_key, held_fp, held_centre = key, fp, centre
        if len(held_key):
            yield flush(held_key, held_fp, held_centre)

    spread = prints.mapInArrow(keyed, "key long, fp long, centre boolean")
    sizes = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    floor = max(dense, 6 * 3 * prints.count() // HEAVY_SHARE)
    heavy = durable(sizes.filter(F.col("n") > floor).select("key"), "heavy")  # fewer than HEAVY_SHARE keys
    few = spread.join(F.broadcast(heavy), "key", "left_anti")
    pairs = few.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")
    crowd = spread.join(F.broadcast(heavy), "key", "left_semi").select(F.col("fp").alias("a"), F.lit(None).cast("long").alias("b"))
    found = durable(pairs.unionByName(crowd), "links")
    ball = F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("word")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct().select("fp", ball)
    met = crowded.groupBy("word").agg(F.collect_list("fp").alias("who")).filter("size(who) > 1")  # 65 at most
    stars = met.select(F.array_min("who").alias("b"), F.explode("who").alias("a")).filter("a <> b").select("a", "b").distinct()
    return found.filter("b is not null and a <> b").unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fp, fingerprint, component_id."""
    rows = durable(fingerprints(docs, shingle, seed), "simhash")
    total = rows.count()
    prints = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
    found = components(links(prints.select("fp"), dense))
    linked = prints.join(found, prints.fp == found.node)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n"))
    grouped = join_by_key(linked.drop("n"), least, ["root"], "n", total).select("fp", "component_id")
    known = durable(prints.join(grouped, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_by_key(rows, known, ["fp"], "n", total).select("doc_id", "fp", hexed, "component_id")
