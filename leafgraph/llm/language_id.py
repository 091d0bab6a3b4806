"""Language identification: sparse multinomial logistic regression on character n-grams.

Hashed n-grams of one to three characters, weighted by TF-IDF, are classified by a
model that is trained with follow-the-regularised-leader (proximal, elastic net) in
numpy; a temperature fitted on held-back documents calibrates its probabilities.

The document frequencies cover all training documents.  The model is fitted on a
sample of at most SAMPLE different texts for each language, those with the least hashes.
One task fits it: the sample streams through it, EPOCHS times in different orders and
once more for the temperature, so what it holds is the model, FEATURES numbers a
language, and the driver gets the model alone.  Every language found is learned.

Defined cases: a text that is null or has no letter (Unicode class L) is ``und`` with score 0;
with no training rows all texts are; rows with a null lang or id are not learned from;
repeated texts count as often as they occur in the frequencies and once in the fit; an
empty table gives no rows; only id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.common import durable

BITS = 13
FEATURES = 1 << BITS
SAMPLE = 800
#: Rows of a table that is broadcast at most; a longer one is joined in the ordinary way.
BROADCAST_ROWS = 1_000_000
#: Values of a text's hash that choose the sample.
HASHES = 1 << 40
#: Characters whose n-grams are counted at once.
BLOCK = 1 << 20
EPOCHS = 4
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
LETTER = regex.compile(r"\p{L}")

_letters: list = []


def letters():
    """For code points below 2**16 (others count as letters): itself if a letter, else a space."""
    import numpy as np

    if not _letters:
        _letters.append(np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32))
    return _letters[0]


def ngram_counts(text: str):
    """Counts of the hashed n-grams of a whole text."""
    import numpy as np

    out = np.zeros(FEATURES, np.int64)
    text = " " + text.lower() + " "
    for at in range(0, len(text), BLOCK):
        x = np.frombuffer(text[max(0, at - 2) : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        x = np.where(x < 1 << 16, letters()[x & 0xFFFF], x)
        one = x * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(0x85EBCA6B) + x[1:]
        three = two[:-1] * np.uint32(0xC2B2AE35) + x[2:]
        old = 2 if at else 0  # grams that the block before has counted
        h = np.concatenate([one[old:], two[max(0, old - 1) :], three])
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
        out += np.bincount(h >> np.uint32(32 - BITS), minlength=FEATURES)
    return out


def weigh(counts, idf):
    import numpy as np

    x = np.log1p(counts) * idf
    return x / max(1e-12, float(np.sqrt(x @ x)))


class Fitter:
    """FTRL-proximal with elastic net: takes examples one by one, then gives weights and a temperature."""

    def __init__(self, classes: int):
        import numpy as np

        self.z, self.n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))
        self.judged: list[tuple] = []

    def weights(self, i):
        import numpy as np

        z = self.z[i]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2), 0.0)

    def learn(self, c: int, i, v) -> None:
        """One step on an example of class ``c`` with values ``v`` of features ``i``."""
        import numpy as np

        w = self.weights(i)
        p = softmax(v @ w)
        p[c] -= 1
        g = v[:, None] * p
        more = self.n[i] + g * g
        self.z[i] += g - (np.sqrt(more) - np.sqrt(self.n[i])) / ALPHA * w
        self.n[i] = more

    def judge(self, c: int, i, v) -> None:
        """Keep the logits of an example that was not learned from."""
        self.judged.append((c, v @ self.weights(i)))

    def temperature(self) -> float:
        import numpy as np

        best = (np.inf, 1.0)
        for t in np.exp(np.linspace(-3, 2, 51)) if self.judged else []:
            loss = -sum(np.log(max(1e-12, softmax(s / t)[c])) for c, s in self.judged)
            best = min(best, (loss, t))
        return float(best[1])


def softmax(s):
    import numpy as np

    e = np.exp(s - s.max())
    return e / e.sum()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model learned from ``docs(doc_id, text, lang)`` outside the held-out fold."""
    import numpy as np

    known = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def frequencies(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += ngram_counts(text) > 0
                n += 1
        if n:
            cols = [np.arange(-1, FEATURES), np.r_[n, total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["feature", "df"])

    sums = known.select("text").mapInArrow(frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(FEATURES + 1)
    for r in sums:  # FEATURES + 1 rows at most
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    marked = known.withColumn("h", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HASHES)))
    each = durable(marked.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).select("lang", "h"), "hashes")
    sizes = durable(each.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    few = sizes.count() * sample <= BROADCAST_ROWS
    light = F.broadcast if few else lambda df: df  # tables of a row a language, or of a sample
    # hashes so low that twice the sample is expected below them; of these the least of a language, exactly
    low = each.join(light(sizes), "lang").filter(F.col("h") <= F.lit(2.0 * sample * HASHES) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = low.select("lang", "h", rank.alias("k")).filter(F.col("k") <= sample)
    # texts that share the hash of one that was chosen count as one
    chosen = durable(chosen, "chosen")
    texts = marked.join(light(chosen), ["lang", "h"]).groupBy("lang", "h", "k").agg(F.min("text").alias("text"))

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [weigh(ngram_counts(t), idf) for t in batch.column("text").to_pylist()]
            i = [np.flatnonzero(v).astype(np.int32) for v in x]
            arrays = [batch.column("lang"), batch.column("k"), pa.array(i, pa.list_(pa.int32())), pa.array([v[k].astype(np.float32) for v, k in zip(x, i)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "k", "i", "v"])

    found = durable(texts.select("lang", "k", "text").mapInArrow(features, "lang string, k int, i array<int>, v array<float>"), "features")
    langs = [r["lang"] for r in found.select("lang").distinct().orderBy("lang").collect()]  # a row a language
    if not langs:
        return {"langs": langs, "idf": idf.astype(np.float32), "w": np.zeros((FEATURES, 0), np.float32), "t": 1.0}
    enough = found.count() >= 50  # fewer examples are all learned from, at temperature 1
    # each example comes once an epoch, in an order of its own; every fifth one of a language is kept back and judged at the end
    back = F.lit(enough) & (F.col("k") % 5 == 0)
    turns = F.when(back, F.array(F.lit(EPOCHS))).otherwise(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))
    stream = found.withColumn("turn", F.explode(turns)).withColumn("at", F.xxhash64("lang", "k", "turn"))

    def fitted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = {lang: c for c, lang in enumerate(langs)}
        fitter = Fitter(len(langs))
        for batch in batches:
            for lang, turn, i, v in zip(*(batch.column(c).to_pylist() for c in ("lang", "turn", "i", "v"))):
                act = fitter.judge if turn == EPOCHS else fitter.learn
                act(number[lang], np.asarray(i), np.asarray(v, float))
        t = fitter.temperature()
        w = fitter.weights(slice(None)).astype(np.float32)
        used = np.flatnonzero(w.any(axis=1))
        for a in range(0, len(used), 256):
            some = used[a : a + 256]
            data = [x.tobytes() for x in w[some]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary()), pa.array([t] * len(some))], names=["feature", "w", "t"])

    ordered = stream.select("lang", "turn", "at", "k", "i", "v").repartition(1).sortWithinPartitions("turn", "at", "lang", "k")
    rows = ordered.mapInArrow(fitted, "feature int, w binary, t double").collect()  # the model: FEATURES rows at most
    w, t = np.zeros((FEATURES, len(langs)), np.float32), 1.0
    for r in rows:
        w[r["feature"]] = np.frombuffer(r["w"], np.float32)
        t = r["t"]
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w, "t": t}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, held_out, lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = held.value
        for batch in batches:
            out, scores = [], []
            for text in batch.column("text").to_pylist():
                if not m["langs"] or text is None or not LETTER.search(text):
                    out.append("und")
                    scores.append(0.0)
                    continue
                s = weigh(ngram_counts(text), m["idf"]) @ m["w"] / m["t"]
                p = np.exp(s - s.max())
                out.append(m["langs"][int(p.argmax())])
                scores.append(float(1 / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))
    return source.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from ``docs(doc_id, text, lang)`` and predict the language of every text."""
    return predict(docs, fit(docs, sample))
