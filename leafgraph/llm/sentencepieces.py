"""SentencePiece encoding and decoding over a relational lattice.

A text falls into units that no piece can span (words with their leading spaces,
and lines).  The new units of a batch make one relation: all their substrings up to
the longest piece are exploded, equi-joined to the piece table by a 64-bit hash, and
grouped by unit.  The fold over a unit's edges follows the order in which the model
merges (the best-ranked edge first, the leftmost of equals), for all units of one
length at once.  The model here is a BPE model: its scores are merge ranks, and a
Viterbi fold, which adds scores up, gives other ids than the model's own encoder for
many words (the README has figures), so ``viterbi`` is kept for models with log
probabilities.  Ids of units are remembered up to MEMORY_BYTES of them.

Defined cases: null text has null ids, empty text none; characters without a piece
become bytes; repeated rows are encoded each; an empty table gives no rows; only
the id and the text are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MEMORY_BYTES = 8 << 20
#: Units of more characters are folded one by one.
LONG = 32
#: Units in one lattice.
TOGETHER = 5_000
NONE = 1 << 30
#: Characters of the texts that are encoded together.
SLICE_CHARS = 1 << 20
MARK = "\x01"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

_models: dict[str, Pieces] = {}


class Pieces:
    """The piece table of a model, and its encoder."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.scores = {self.texts[i]: model.get_score(i) for i in plain}
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.by_rank = np.array([*order, 0], "<u4")
        self.rank = {self.texts[i]: r for r, i in enumerate(order)}
        self.bytes_of = {int(self.texts[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.raw = [b"" if model.is_control(i) else self.texts[i].encode() for i in range(n)]
        for value, i in self.bytes_of.items():
            self.raw[i] = bytes([value])
        self.longest = max(map(len, self.rank))
        if any(SPACE in t.lstrip(SPACE) for t in self.rank) or any("\n" in t for t in self.rank):
            raise ValueError("pieces of this model span words or lines")
        codes = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64) for t in self.rank]
        hashes = np.array([self._hash(c) for c in codes], np.uint64)
        at = np.argsort(hashes)
        self.hashes, self.ranks = hashes[at], at.astype(np.int32)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        back = [r.replace(SPACE.encode(), b" ") for r in self.raw]
        self.back = np.frombuffer(b"".join(back), np.uint8)
        self.back_size = np.array([len(r) for r in back])
        self.back_start = np.cumsum(self.back_size) - self.back_size

    BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

    def _hash(self, codes) -> int:
        h = 0
        for c in codes.tolist():
            h = (h * self.BASE + c + 1) % (1 << 64)
        h ^= h >> 32
        return h * self.MIX % (1 << 64)

    def _ranks_of(self, h):
        """Ranks of substrings by their hashes: the equi-join with the piece table."""
        import numpy as np

        h = (h ^ (h >> np.uint64(32))) * np.uint64(self.MIX)
        out = np.full(h.shape, NONE, np.int32)
        at = np.nonzero(self.maybe[h >> np.uint64(44)])
        asked = h[at]
        place = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        found = self.hashes[place] == asked
        out[tuple(a[found] for a in at)] = self.ranks[place[found]]
        return out

    def lattice(self, units: list[str], size: int):
        """Ranks (units, start, length - 1) of the substrings of units that are pieces."""
        import numpy as np

        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").reshape(len(units), size).astype(np.uint64) + np.uint64(1)
        longest = min(size, self.longest)
        edges = np.full((len(units), size, longest), NONE, np.int32)
        h = np.zeros_like(codes)
        for n in range(1, longest + 1):
            h = h[:, : size - n + 1] * np.uint64(self.BASE) + codes[:, n - 1 :]
            edges[:, : size - n + 1, n - 1] = self._ranks_of(h)
        return edges

    def fold(self, units: list[str], size: int) -> list[bytes]:
        """Ids of units of one length: the best edge of each unit is taken, again and again."""
        import numpy as np

        edges = self.lattice(units, size)
        longest = edges.shape[2]
        cuts = np.broadcast_to(np.arange(size + 2), (len(units), size + 2)).copy()
        cuts[:, size + 1] = size
        number = np.full(len(units), size)
        active = np.arange(len(units))
        for _ in range(size - 1):
            c = cuts[active]
            a, n = c[:, :-2], c[:, 2:] - c[:, :-2]
            fits = (n <= longest) & (np.arange(size) < (number[active] - 1)[:, None])
            score = np.where(fits, edges[active[:, None], np.minimum(a, size - 1), np.clip(n, 1, longest) - 1], NONE)
            best = score.argmin(axis=1)
            go = score[np.arange(len(active)), best] < NONE
            active, best, c = active[go], best[go], c[go]
            if not len(active):
                break
            later = np.arange(size + 1) > best[:, None]
            c[:, :-1] = np.where(later, c[:, 1:], c[:, :-1])
            cuts[active] = c
            number[active] -= 1
        a, n = cuts[:, :size], np.diff(cuts, axis=1)[:, :size]
        inside = np.arange(size) < number[:, None]
        rank = np.where(inside, edges[np.arange(len(units))[:, None], np.minimum(a, size - 1), np.clip(n, 1, longest) - 1], 0)
        plain = (rank < NONE).all(axis=1)
        ids = self.by_rank[np.minimum(rank, len(self.by_rank) - 1)]
        raw, ends = ids[inside].tobytes(), (4 * np.cumsum(number)).tolist()
        return [raw[e - 4 * k : e] if ok else self.scalar(u) for u, e, k, ok in zip(units, ends, number.tolist(), plain.tolist())]

    def scalar(self, unit: str) -> bytes:
        """The same for one unit, with a heap of its edges."""
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        out = []
        for p in parts:
            if p is None:
                continue
            if p in self.rank:
                out.append(int(self.by_rank[self.rank[p]]))
            elif self.bytes_of:
                out += [self.bytes_of[x] for x in p.encode()]
            else:
                out.append(self.unknown)
        return b"".join(i.to_bytes(4, "little") for i in out)

    def viterbi(self, unit: str) -> list[str]:
        """The segmentation with the highest sum of scores, for models of log probabilities."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(unit) + 1):
            options = [(best[a][0] + self.scores[unit[a:end]], a) for a in range(max(0, end - self.longest), end) if unit[a:end] in self.scores]
            best.append(max(options, key=lambda x: (x[0], -x[1])) if options else (best[end - 1][0] - 1e6, end - 1))
        cuts = [len(unit)]
        while cuts[-1]:
            cuts.append(best[cuts[-1]][1])
        cuts.reverse()
        return [unit[a:b] for a, b in zip(cuts, cuts[1:])]

    def units_of(self, text: str) -> list[str]:
        """The units of a text, which gets a space put before it; line ends are units."""
        if "  " in text or text[:1] == " " or SPACE in text or MARK in text:
            lines = [UNIT.findall(line.replace(" ", SPACE)) for line in (" " + text).split("\n")]
            return lines[0] + [u for line in lines[1:] for u in ("\n", *line)]
        return (" " + text).replace(" ", MARK + SPACE).replace("\n", MARK + "\n" + MARK).split(MARK)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of whole texts."""
        if self.held > MEMORY_BYTES:
            self.known, self.held = {"": b""}, 0
        split = [self.units_of(t) if t else [] for t in texts]
        known = self.known
        new = {u for units in split for u in units if u not in known}
        by_size: dict[int, list[str]] = {}
        for u in new:
            by_size.setdefault(len(u), []).append(u)
        once: dict[str, bytes] = {}
        for size, units in by_size.items():
            for a in range(0, len(units), TOGETHER):
                part = units[a : a + TOGETHER]
                if size > LONG:
                    once.update(zip(part, map(self.scalar, part)))
                else:
                    known.update(zip(part, self.fold(part, size)))
                    self.held += size * len(part)
        if once:
            known = known | once
        return [b"".join([known[u] for u in units]) for units in split]

    def decode_batch(self, ids, sizes) -> list[bytes]:
        """The texts, in UTF-8, of ids in a row; ``sizes`` ids belong to each text."""
        import numpy as np

        n = self.back_size[ids]
        ends = np.cumsum(n)
        data = self.back[np.repeat(self.back_start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = np.r_[0, ends][np.cumsum(np.r_[0, sizes])].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, in UTF-8."""
        import numpy as np

        return self.decode_batch(np.asarray(ids, np.int64), [len(ids)])[0]


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def sliced(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts a batch into slices of about SLICE_CHARS characters."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_CHARS or k == len(texts) - 1:
            yield start, k + 1
            start, held = k + 1, 0


def encode(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, ids), and with ``back`` the text ``decoded`` from the ids."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            every = batch.column("text").to_pylist()
            for a, b in sliced(every):
                texts = every[a:b]
                raw = model.encode_batch(texts)
                sizes = np.array([len(x) // 4 for x in raw])
                values = np.frombuffer(b"".join(raw), "<i4")
                missing = pa.array([t is None for t in texts], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, sizes]).astype(np.int32)), pa.array(values), mask=missing)
                out = [batch.column("doc_id").slice(a, b - a), ids]
                if back:
                    out.append(pa.array([None if t is None else x.decode("utf-8", "replace") for t, x in zip(texts, model.decode_batch(values, sizes))], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"][: len(out)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * back
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the ``decoded`` text of its ``ids``; bytes that aren't UTF-8 become U+FFFD."""
    columns = [c for c in encoded.columns if c != "decoded"]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = pieces(path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, "decoded"])

    schema = encoded.select(*columns).withColumn("decoded", F.lit(None).cast("string")).schema
    return encoded.select(*columns).mapInArrow(scan, schema)
