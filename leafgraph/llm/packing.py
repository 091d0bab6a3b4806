"""Packing of tokenised documents into fixed-length sequences.

Shortest-pack-first over the length histogram: only the histogram of piece
lengths (at most ``context`` rows) reaches the driver.  Lengths are placed
longest first into the open packing pattern with the most room, updating how
often each pattern is used; the patterns are joined back to the pieces by the
rank of a piece among those of its length.

Defined cases: null text counts as empty; an empty document is its end id
alone; repeated rows are packed as often as they occur; an empty table gives no
rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import durable, trim

CONTEXT = 4096
END_ID = 2
#: Characters of a text that are split into words at once; longer texts are cut at spaces.
BLOCK = 4 << 20
#: Bytes of words whose ids a worker remembers before it starts afresh.
MEMORY_BYTES = 8 << 20

_tokenizers: dict[str, WordIds] = {}


class WordIds:
    """Ids of whole texts from ids of white-space separated words.

    The vocabulary never has a token across white space, so the ids of a text are
    those of its words in order; each new word goes through ``tokenizers`` once.
    """

    def __init__(self, path: str, memory: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.memory = memory

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    def learn(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        if self.held > self.memory:
            self.known, self.held = {"": b""}, 0
        new: dict[str, bytes] = {}
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cuts = np.searchsorted(starts, np.cumsum(sizes))
            ends, raw = (cuts * 4).tolist(), ids.tobytes()
            for word, a, b in zip(part, [0, *ends[:-1]], ends):
                new[word] = raw[a:b]
        for word, value in new.items():
            if len(word) <= 256:
                self.known[word] = value
                self.held += len(word)
        return new

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if text.isascii():
            text = text.lower()
        for c in "\n\t\r\x0b\x0c":
            if c in text:
                text = text.replace(c, " ")
        if len(text) <= BLOCK:
            return self.ids(text.split(" "))
        parts, at = [], 0
        while at <= len(text):
            end = text.find(" ", at + BLOCK)
            end = len(text) if end < 0 else end
            parts.append(self.ids(text[at:end].split(" ")))
            at = end + 1
        return b"".join(parts)

    def ids(self, words: list[str]) -> bytes:
        """The ids of some words in a row."""
        try:
            known = self.known
            return b"".join([known[w] for w in words])
        except KeyError:
            known = self.known
            more = self.learn([w for w in dict.fromkeys(words) if w not in known])
            if known is not self.known:  # memory was cleared
                more |= self.learn([w for w in dict.fromkeys(words) if w not in more and w not in self.known])
            known = self.known
            return b"".join([known[w] if w in known else more[w] for w in words])


def word_ids(path: str, memory: int = MEMORY_BYTES) -> WordIds:
    held = _tokenizers.get(path)
    if held is None or held.memory != memory:
        held = _tokenizers[path] = WordIds(path, memory)
    return held


def pieces(docs: DataFrame, tokenizer: str, context: int = CONTEXT, end_id: int = END_ID, memory: int = MEMORY_BYTES) -> DataFrame:
    """One row per piece: whole sequences of ``context`` ids, then what is left over."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of, end = word_ids(tokenizer, memory), end_id.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = ids_of.encode(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, context):
                    part = ids[4 * at : 4 * (at + context)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        if memory < MEMORY_BYTES:  # where memory is short, a reused worker forgets its words
            _tokenizers.clear()
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def plan(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for counts of lengths.

    Longest lengths first; each goes to the shortest packs that are open (those
    with the most room), and to new packs only when it fits none.
    """
    open_packs: dict[int, list[list]] = {}  # room -> [[count, pattern]]
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # may name rooms that are empty by now
    import heapq

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= context:
            raise ValueError(f"a piece of {length} ids doesn't fit {context}")
        while left:
            while rooms and not open_packs.get(-rooms[0]):
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= length:
                packs = open_packs[room]
                count, pattern = packs.pop()
                used = min(count, left)
                if count > used:
                    packs.append([count - used, pattern])
            else:
                used, room, pattern = left, context, ()
            left -= used
            pattern, room = (*pattern, length), room - length
            if room:
                if not open_packs.get(room):
                    heapq.heappush(rooms, -room)
                    open_packs.setdefault(room, [])
                open_packs[room].append([used, pattern])
            else:
                done.append((pattern, used))
    done += [(tuple(p), n) for packs in open_packs.values() for n, p in packs]
    return sorted(done, reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, last_rank, first_sequence, offset)`` of the patterns.

    The pieces of a length with ranks first..last go to sequences counted up from
    ``first_sequence``, at ``offset``.
    """
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            first = ranks.get(length, 0)
            rows.append((length, first, first + count - 1, base, at))
            ranks[length] = first + count
            at += length
        base += count
    return rows


def pack(
    docs: DataFrame, tokenizer: str, context: int = CONTEXT, end_id: int = END_ID, planner: Callable = plan, memory: int = MEMORY_BYTES
) -> DataFrame:
    """Pack ``docs(doc_id, text)``: the columns of ``pieces`` with sequence_id and offset.

    ``memory`` bounds the words whose ids a worker remembers; it changes time, never the result.
    """
    spark = docs.sparkSession
    blocks = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # (block, length) groups stay small even if one length has a third of all pieces
    cut = durable(pieces(docs, tokenizer, context, end_id, memory), "pieces").withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(1)), F.lit(blocks))
    )
    counts = durable(cut.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    filled = slots(planner(histogram, context))
    per_length = "array<struct<first:long,last:long,sequence:long,offset:long>>"
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in filled:
        by_length.setdefault(length, []).append(tuple(rest))
    runs = spark.createDataFrame(list(by_length.items()), f"length long, runs {per_length}")
    bases = counts.selectExpr(
        "length", "block", "sum(n) OVER (PARTITION BY length ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base"
    ).fillna(0, "base")
    ranked = cut.selectExpr(
        "*", "row_number() OVER (PARTITION BY length, block ORDER BY doc_id, start, ids_crc32) - 1 AS rn"
    ).join(bases, ["length", "block"])
    # at most `context` lengths: the joined table is bounded by the context, not by the corpus
    placed = ranked.withColumn("rank", F.col("base") + F.col("rn")).join(F.broadcast(runs), "length")
    run = F.expr("filter(runs, r -> r.first <= rank AND rank <= r.last)[0]")
    return placed.withColumn("run", run).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"),
        F.col("run.offset").alias("offset"),
    )
