"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters the network as a learned vector, the log odds of its class and the
mean vector of its character trigrams, so unknown words still have their characters.
The network reads overlapping windows of words in both directions; attention pools
its states into one logit.  A document's score is the calibrated logit of its
highest window: FOLDS networks, each trained without one fold, judge the documents of
that fold, and slope and offset are fitted to all of these logits; the network that
scores is trained on all folds.  All is trained in numpy, by one task, on a bounded sample of the
labelled documents (at most POSITIVES and NEGATIVES, of at most SAMPLE_CHARS
characters each); every window of every whole text is scored, block by block.

Defined cases: texts without a word score 0; without labelled rows of both classes
all score 0; rows with a null id or label are not learned from and a document
labelled twice counts as toxic if one label says so; repeated rows are scored
each; an empty table gives no rows; other columns are not read, or kept as they are
whatever their names.
"""

from __future__ import annotations

import os
import re
import subprocess
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.common import named

WINDOW, STRIDE = 40, 30
HIDDEN, WORD_DIM, CHAR_DIM = 8, 12, 8
BUCKETS = 4096
POSITIVES, NEGATIVES, SAMPLE_CHARS = 3000, 4000, 20_000
MIN_DF, MAX_VOCABULARY = 3, 100_000
FOLDS = 4
ROUNDS, EPOCHS, BATCH = 3, 3, 256
#: Steps of a round at least; small samples go in smaller batches, more often.
LEAST_STEPS = 80
THRESHOLD = 0.7
#: Windows scored at once.
CHUNK = 2048
WORD = re.compile(r"[^\W\d_]+")
#: Characters of a text split into words at once, and words whose windows start in one block.
BLOCK = 1 << 20
BLOCK_WORDS = STRIDE * 5000

_loaded: list = []


def word_blocks(text: str) -> Iterator[list[str]]:
    """The lower-case words of a whole text, block by block; no word is cut."""
    if len(text) <= BLOCK:
        yield WORD.findall(text.lower())
        return
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and WORD.match(text[end]):
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end


def words_of(text: str) -> list[str]:
    """The lower-case words of a whole text."""
    return [w for block in word_blocks(text) for w in block]


def window_blocks(text: str) -> Iterator[list[str]]:
    """Lists of words whose windows together are those of the whole text."""
    held: list[str] = []
    for words in word_blocks(text):
        held += words
        while len(held) >= BLOCK_WORDS + WINDOW:
            yield held[: BLOCK_WORDS + WINDOW - STRIDE]  # its last window starts before BLOCK_WORDS
            held = held[BLOCK_WORDS:]
    yield held


def trigrams(words: list[str]):
    """Hashed trigrams of the words' bytes between marks: (flat buckets, number for each word)."""
    import numpy as np

    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in raw) + b"\0\0", np.uint8).astype(np.uint32)
    h = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA6B) + data[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return h[inside].astype(np.int16), sizes


def mean_rows(table, flat, sizes):
    """Mean of the table's rows for each word."""
    import numpy as np

    sums = np.vstack([np.zeros(table.shape[1]), np.cumsum(table[flat], axis=0, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return ((sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)[:, None]).astype(np.float32)


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_network(vocabulary: int, seed: int = 5) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + 1 + CHAR_DIM, HIDDEN
    draw = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
    net = {"words": draw(vocabulary, WORD_DIM), "chars": draw(BUCKETS, CHAR_DIM), "va": draw(h, scale=0.3), "wa": draw(2 * h, h, scale=0.3), "ba": np.zeros(h, np.float32)}
    net |= {"wo": draw(2 * h, scale=0.3), "bo": np.zeros(1, np.float32)}
    for k in "fb":
        net |= {f"wx{k}": draw(d, 3 * h, scale=0.3), f"bx{k}": np.zeros(3 * h, np.float32), f"u{k}": draw(h, 3 * h, scale=0.3)}
    return net


def recur(gates, mask, u, keep: list | None = None):
    """States (T, B, H) of one direction, from projected inputs (T, B, 3H); masked steps keep the state."""
    import numpy as np

    steps, batch, _ = gates.shape
    n = u.shape[0]
    h = np.zeros((batch, n), np.float32)
    out = np.empty((steps, batch, n), np.float32)
    for t in range(steps):
        g, hu = gates[t], h @ u
        rz = sigmoid(g[:, : 2 * n] + hu[:, : 2 * n])
        r, z = rz[:, :n], rz[:, n:]
        c = np.tanh(g[:, 2 * n :] + r * hu[:, 2 * n :])
        new = c + z * (h - c)
        m = mask[t][:, None]
        new = np.where(m, new, h)
        if keep is not None:
            keep.append((h, r, z, c, hu[:, 2 * n :], m))
        out[t] = h = new
    return out


def recur_back(grad_out, kept, u):
    """Gradients of the projected inputs and of ``u``."""
    import numpy as np

    n = u.shape[0]
    grad_gates = np.empty((*grad_out.shape[:2], 3 * n), np.float32)
    grad_u = np.zeros_like(u)
    dh = np.zeros_like(grad_out[0])
    for t in range(len(kept) - 1, -1, -1):
        h, r, z, c, hc, m = kept[t]
        dh = dh + grad_out[t]
        dn = np.where(m, dh, 0)
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        grad_gates[t] = np.concatenate([dr, dz, dc], axis=1)
        du = np.concatenate([dr, dz, dc * r], axis=1)
        grad_u += h.T @ du
        dh = np.where(m, dn * z, dh) + du @ u.T
    return grad_gates, grad_u


def pool(net, states, mask):
    """Attention pooling of states (T, B, 2H): logits and what the gradient needs."""
    import numpy as np

    s = np.tanh(states @ net["wa"] + net["ba"])
    a = np.where(mask, s @ net["va"], -1e9)
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * states).sum(axis=0)
    return pooled @ net["wo"] + net["bo"], (s, a, pooled)


def forward(net, x, mask, keep: bool = True):
    """Logits of windows from inputs (T, B, D), and what the gradient needs."""
    import numpy as np

    kf, kb = ([], []) if keep else (None, None)
    f = recur(x @ net["wxf"] + net["bxf"], mask, net["uf"], kf)
    b = recur((x @ net["wxb"] + net["bxb"])[::-1], mask[::-1], net["ub"], kb)[::-1]
    states = np.concatenate([f, b], axis=2)
    logits, extra = pool(net, states, mask)
    return logits, (states, extra, kf, kb)


def gradients(net, x, mask, grad_logits, saved):
    """Gradients of the parameters and of the inputs."""
    import numpy as np

    states, (s, a, pooled), kf, kb = saved
    n = HIDDEN
    g = {"wo": pooled.T @ grad_logits, "bo": grad_logits.sum(keepdims=True)}
    dp = grad_logits[:, None] * net["wo"]
    ds = a[:, :, None] * dp
    da = (states * dp).sum(axis=2)
    da = a * (da - (a * da).sum(axis=0))
    g["va"] = np.tensordot(da, s, ([0, 1], [0, 1]))
    dt = da[:, :, None] * net["va"] * (1 - s * s)
    g["wa"] = np.tensordot(states, dt, ([0, 1], [0, 1]))
    g["ba"] = dt.sum(axis=(0, 1))
    ds = ds + dt @ net["wa"].T
    gf, g["uf"] = recur_back(ds[:, :, :n], kf, net["uf"])
    gb, g["ub"] = recur_back(ds[::-1, :, n:], kb, net["ub"])
    gb = gb[::-1]
    for k, gates in (("f", gf), ("b", gb)):
        g["wx" + k] = np.tensordot(x, gates, ([0, 1], [0, 1]))
        g["bx" + k] = gates.sum(axis=(0, 1))
    return g, gf @ net["wxf"].T + gb @ net["wxb"].T


def windows(sizes) -> tuple:
    """(first word, end of the document, document) of all overlapping windows, for documents in a row."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    ends = np.cumsum(sizes)
    start = (ends - sizes)[doc] + STRIDE * (np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc])
    return start, ends[doc], doc


def gathered(flat, start, end):
    """Word numbers (T, B) of windows, and which of them are words."""
    import numpy as np

    at = start + np.arange(WINDOW)[:, None]
    mask = at < end
    return flat[np.minimum(at, len(flat) - 1)], mask


class Trainer:
    """Fits the network to documents: lists of words with a label each."""

    def __init__(self, docs: Iterable[list[str]], labels: list[int]):
        import numpy as np

        self.y = np.asarray(labels, np.float32)
        # words become numbers as the documents are read; no list of words is kept
        index: dict[str, int] = {}
        numbered = [np.fromiter((index.setdefault(w, len(index)) for w in d), np.int32) for d in docs]
        sizes = [len(d) for d in numbered]
        fold = np.arange(len(numbered)) % FOLDS
        flat = np.concatenate([np.empty(0, np.int32), *numbered])
        unique = [np.unique(d) for d in numbered]
        del numbered
        df = np.bincount(np.concatenate([np.empty(0, np.int32), *unique]), minlength=len(index))
        every = list(index)
        del index
        common = np.flatnonzero(df >= MIN_DF)
        order = sorted(common.tolist(), key=lambda i: (-df[i], every[i]))[:MAX_VOCABULARY]
        self.number = {every[i]: k + 1 for k, i in enumerate(order)}  # 0: unknown
        self.word = np.zeros(len(every), np.int32)
        self.word[order] = np.arange(1, len(order) + 1)
        self.flat = flat
        del flat, df, common
        parts = [trigrams(every[a : a + 20_000]) for a in range(0, len(every), 20_000)]
        self.tri = np.concatenate([np.empty(0, np.int16), *(t for t, _ in parts)])
        self.tri_size = np.concatenate([np.empty(0, np.int64), *(n for _, n in parts)])
        self.tri_start = np.cumsum(self.tri_size) - self.tri_size
        del every
        # log odds of the known words, for each fold from the other folds, and from all
        counts = np.zeros((FOLDS, 2, len(order) + 1))
        for d, c, k in zip(unique, labels, fold):
            counts[k, c, self.word[d]] += 1
        counts[:, :, 0] = 0
        members = np.array([[((fold == k) & (self.y == c)).sum() for c in (0, 1)] for k in range(FOLDS)])
        total, n = counts.sum(axis=0), members.sum(axis=0)

        def odds(c, n):
            out = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
            out[0] = 0
            return (out * np.minimum(1, c.sum(axis=0) / 8) / 3).astype(np.float32)

        self.odds = [odds(total - counts[k], n - members[k]) for k in range(FOLDS)] + [odds(total, n)]
        self.start, self.end, self.doc = windows(sizes)
        self.fold = fold
        self.net = new_network(len(order) + 1)
        self.state: dict = {}
        self.steps = 0

    def inputs(self, rows):
        import numpy as np

        index, mask = gathered(self.flat, self.start[rows], self.end[rows])
        unique, place = np.unique(index, return_inverse=True)
        place = place.reshape(index.shape)
        word, size = self.word[unique], self.tri_size[unique]
        flat = self.tri[np.repeat(self.tri_start[unique] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        chars = mean_rows(self.net["chars"], flat, size)
        odds = np.stack(self.odds[:FOLDS])[self.fold[self.doc[rows]][None, :], word[place]]
        x = np.concatenate([self.net["words"][word][place], odds[:, :, None], chars[place]], axis=2)
        return x, mask, (place, word, size, flat)

    def logits(self, rows):
        import numpy as np

        out = [forward(self.net, *self.inputs(rows[a : a + CHUNK])[:2], keep=False)[0] for a in range(0, len(rows), CHUNK)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def update(self, g: dict, rate: float) -> None:
        """One step of Adam."""
        import numpy as np

        self.steps += 1
        for k, v in g.items():
            m, s = self.state.setdefault(k, (np.zeros_like(self.net[k]), np.zeros_like(self.net[k])))
            m *= 0.9
            m += 0.1 * v
            s *= 0.99
            s += 0.01 * v * v
            self.net[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-6)

    def step(self, rows, y, rate: float) -> None:
        import numpy as np

        x, mask, (place, word, size, flat) = self.inputs(rows)
        logits, saved = forward(self.net, x, mask)
        g, dx = gradients(self.net, x, mask, ((sigmoid(logits) - y) / len(rows)).astype(np.float32), saved)
        dx = np.where(mask[:, :, None], dx, 0)
        per = np.zeros((len(word), dx.shape[2]), np.float32)
        np.add.at(per, place.ravel(), dx.reshape(-1, dx.shape[2]))
        g["words"] = np.zeros_like(self.net["words"])
        np.add.at(g["words"], word, per[:, :WORD_DIM])
        g["chars"] = np.zeros_like(self.net["chars"])
        np.add.at(g["chars"], flat, np.repeat(per[:, WORD_DIM + 1 :] / np.maximum(size, 1)[:, None], size, axis=0))
        self.update(g, rate)

    def best(self, value):
        """The window of each document with the highest value."""
        import numpy as np

        order = np.lexsort((-value, self.doc))
        first = np.r_[True, self.doc[order][1:] != self.doc[order][:-1]] if len(order) else np.zeros(0, bool)
        return order[first]

    def fit(self) -> dict:
        """The model of all folds, calibrated on the logits of networks that did not learn from a document."""
        import numpy as np

        logits, y = [], []
        for fold in range(FOLDS):
            self.train(fold)
            rows = np.flatnonzero(self.fold[self.doc] == fold)
            value = np.full(len(self.doc), -1e9, np.float32)
            value[rows] = self.logits(rows)
            top = self.best(value)
            top = top[self.fold[self.doc[top]] == fold]
            logits.append(value[top])
            y.append(self.y[self.doc[top]])
        a, b = calibrated(np.concatenate(logits), np.concatenate(y))
        self.train(None)
        return self.model() | {"a": a, "b": b}

    def train(self, left_out: int | None) -> None:
        """Train a new network on the highest windows, chosen anew in each round, of all folds but one."""
        import numpy as np

        rng = np.random.default_rng(3)
        self.net, self.state, self.steps = new_network(len(self.number) + 1), {}, 0
        learn = np.flatnonzero(self.fold[self.doc] != (-1 if left_out is None else left_out))
        value = np.full(len(self.doc), -1e9, np.float32)
        for a in range(0, len(learn), 10_000):
            some = learn[a : a + 10_000]
            index, mask = gathered(self.flat, self.start[some], self.end[some])
            odds = np.stack(self.odds[:FOLDS])[self.fold[self.doc[some]][None, :], self.word[index]]
            value[some] = np.where(mask, odds, -9).max(axis=0)
        clean = learn[self.y[self.doc[learn]] == 0]
        for turn in range(ROUNDS):
            top = self.best(value)
            top = top[value[top] > -1e8]
            more = rng.choice(clean, min(len(clean), len(top)), replace=False) if len(clean) else clean
            rows = np.concatenate([top, more])
            y = self.y[self.doc[rows]]
            batch = min(BATCH, max(32, len(rows) // 16))
            for _ in range(max(EPOCHS, -(-LEAST_STEPS * batch // max(1, len(rows))))):
                order = rng.permutation(len(rows))
                for a in range(0, len(order), batch):
                    part = order[a : a + batch]
                    self.step(rows[part], y[part], 0.01 / (1 + turn))
            if turn < ROUNDS - 1 and len(learn):
                hard = learn[value[learn] >= np.quantile(value[learn], 0.5)]
                value[learn] -= 100
                value[hard] = self.logits(hard)

    def model(self) -> dict:
        """What scoring needs: each known word's projected input, and that of unknown ones' characters."""
        import numpy as np

        net, n = self.net, len(self.number) + 1
        wx, bx = np.hstack([net["wxf"], net["wxb"]]), np.r_[net["bxf"], net["bxb"]]
        flat, size = trigrams(list(self.number))
        chars = np.vstack([np.zeros(CHAR_DIM, np.float32), mean_rows(net["chars"], flat, size)])
        x = np.hstack([net["words"], self.odds[FOLDS][:, None], chars[:n]])
        base = np.r_[net["words"][0], 0, np.zeros(CHAR_DIM)] @ wx + bx
        small = {k: net[k] for k in ("uf", "ub", "wa", "ba", "va", "wo", "bo", "chars")}
        return small | {"number": self.number, "known": (x @ wx + bx).astype(np.float32), "base": base.astype(np.float32), "wc": wx[WORD_DIM + 1 :]}


def calibrated(logits, y) -> tuple[float, float]:
    """Slope and offset of the logit by a few steps of Newton's method."""
    import numpy as np

    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)], axis=1).astype(float)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + 0.1 * (w - [1, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w = w - np.clip(move, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def score_texts(m: dict, texts: list[str]):
    """Scores of whole texts."""
    import numpy as np

    top = np.full(len(texts), -np.inf)
    lists: list[list[str]] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if lists:
            np.maximum.at(top, owners, top_logits(m, lists))
        lists.clear()
        owners.clear()
        held = 0

    for k, text in enumerate(texts):
        for words in window_blocks(text):
            lists.append(words)
            owners.append(k)
            held += len(words)
            if held >= BLOCK_WORDS:
                flush()
    flush()
    out = np.zeros(len(texts))
    has = top > -np.inf
    out[has] = sigmoid(m["a"] * top[has] + m["b"])
    return out


def top_logits(m: dict, lists: list[list[str]]):
    """The logit of the highest window of each list of words."""
    import numpy as np

    get, extra = m["number"].get, {}
    flat: list[int] = []
    first = len(m["number"]) + 1
    for words in lists:
        for w in words:
            i = get(w)
            if i is None:
                i = extra.get(w)
                if i is None:
                    i = extra[w] = first + len(extra)
            flat.append(i)
    top = np.full(len(lists), -np.inf)
    if not flat:
        return top
    table = m["known"]
    if extra:
        chars = mean_rows(m["chars"], *trigrams(list(extra)))
        table = np.vstack([table, m["base"] + chars @ m["wc"]])
    numbers = np.asarray(flat, np.int64)
    start, end, doc = windows([len(words) for words in lists])
    for a in range(0, len(start), CHUNK):
        index, mask = gathered(numbers, start[a : a + CHUNK], end[a : a + CHUNK])
        gates = table[index]
        n = 3 * HIDDEN
        f = recur(gates[:, :, :n], mask, m["uf"])
        b = recur(gates[::-1, :, n:], mask[::-1], m["ub"])[::-1]
        logits, _ = pool(m, np.concatenate([f, b], axis=2), mask)
        np.maximum.at(top, doc[a : a + CHUNK], logits)
    return top


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """The model learned from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64("doc_id", F.lit(11))
    chosen = [known.filter(F.col("toxic") == c).orderBy(mixed, "doc_id").limit(n) for c, n in ((1, POSITIVES), (0, NEGATIVES))]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # POSITIVES + NEGATIVES rows at most
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.length("text") <= SAMPLE_CHARS)
    found = texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    def train(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        from leafgraph.llm.common import trim

        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("k", "doc_id", "text", "toxic"))))
        if len({r[3] for r in rows}) == 2:
            # a process of its own gives its memory back before the texts are scored
            path = os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])
            data = pickle.dumps(([r[2] for r in rows], [r[3] for r in rows]))
            rows.clear()
            trim()
            done = subprocess.run([sys.executable, "-m", "leafgraph.llm.toxicity"], input=data, stdout=subprocess.PIPE, env=os.environ | {"PYTHONPATH": path}, check=True)
            yield pa.RecordBatch.from_arrays([pa.array([done.stdout], pa.binary())], names=["model"])

    # the sample is bounded, so one task trains; the driver gets the model alone
    fitted = found.select(mixed.alias("k"), "doc_id", "text", "toxic").repartition(1).mapInArrow(train, "model binary").collect()
    return bytes(fitted[0]["model"]) if fitted else None


def loaded(data: bytes) -> dict:
    """The model from its bytes, once for each task."""
    import pickle

    if not _loaded or _loaded[0] != data:
        _loaded[:] = [data, pickle.loads(data)]
    return _loaded[1]


def score(docs: DataFrame, model: bytes | None, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Scores of ``docs``: (doc_id, held_out, score), or the columns ``keep`` and ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    if keep:  # columns go by their place, as they may have any names
        kept = [f"c{i}" for i in range(len(keep))]
        source, read = docs.select(*(c.alias(k) for c, k in zip(named(keep), kept))), kept[keep.index("text")]
    else:
        kept, read = ["doc_id", "held_out"], "text"
        source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from leafgraph.llm.common import trim

        for batch in batches:
            texts = [t or "" for t in batch.column(read).to_pylist()]
            scores = score_texts(loaded(held.value), texts) if held.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "found"])
            del texts, scores
            trim()
        _loaded.clear()  # a reused worker has other work to do
        trim()

    out = source.mapInArrow(scan, source.select(*kept, F.lit(0.0).alias("found")).schema)
    return out.toDF(*(keep or kept), name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every document."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def train_here() -> None:
    """Read pickled texts and labels, write the pickled model."""
    import pickle

    texts, labels = pickle.load(sys.stdin.buffer)
    texts.reverse()
    trainer = Trainer((words_of(texts.pop()) for _ in range(len(texts))), labels)  # texts go as they are read
    sys.stdout.buffer.write(pickle.dumps(trainer.fit()))


if __name__ == "__main__":
    train_here()
