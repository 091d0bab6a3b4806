import math
import random
import zlib

import numpy as np

from leafgraph.llm import language_id
from leafgraph.llm.language_id import identify, ngram_counts

DOCS = "doc_id long, text string, lang string, held_out string, score string"
WORDS = {
    "en": "the of and to in that was for with his they this have from one had word but not what".split(),
    "de": "der die und den von das mit sich des auf für ist nicht ein eine als auch werden über schön".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans elle au des été".split(),
}


def test_blocks_count_every_gram_once(monkeypatch):
    text = "Straße und été, 日本 😀 ok " * 40
    whole = ngram_counts(text)
    for block in (3, 7, 64, 1000):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert (ngram_counts(text) == whole).all()


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[g]) for _ in range(rng.randint(2, 40))), g, "x", "y") for i, g in enumerate(rng.choices(list(WORDS), k=500))]
    extra = [(None, "the of and", "en", "", ""), (1000, None, "en", "", ""), (1001, "", "fr", "", ""), (1002, "12 _ 34! \u00b2 \u00bd \u2460", "de", "", ""), (1003, "the and of", None, "", ""), rows[0]]
    out = identify(spark.createDataFrame(rows + extra, DOCS)).collect()
    assert len(out) == len(rows) + len(extra)
    got = {r.doc_id: r for r in out}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [(r[2], got[r[0]].lang_pred) for r in rows if got[r[0]].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "en" and got[None].held_out is False


def test_nothing_to_learn(spark):
    assert identify(spark.createDataFrame([], DOCS)).count() == 0
    assert identify(spark.createDataFrame([(1, "abc", None, "", "")], DOCS)).first().lang_pred == "und"
    assert identify(spark.createDataFrame([(1, "abc", "en", "", "")], DOCS)).first().lang_pred == "en"


def test_steps_are_those_of_plain_ftrl():
    """Weights after some steps, against the update rule written out for each coordinate."""
    rng = np.random.default_rng(0)
    classes, steps = 3, 40
    fitter = language_id.Fitter(classes)
    z, n = {}, {}
    for _ in range(steps):
        c, i, v = int(rng.integers(classes)), np.sort(rng.choice(50, 6, replace=False)), rng.random(6)
        w = {}
        for f in i.tolist():
            for k in range(classes):
                a, b = z.get((f, k), 0.0), n.get((f, k), 0.0)
                sign = 1 if a > 0 else -1
                w[f, k] = 0.0 if abs(a) <= language_id.L1 else -(a - sign * language_id.L1) / ((language_id.BETA + math.sqrt(b)) / language_id.ALPHA + language_id.L2)
        s = [sum(x * w[f, k] for f, x in zip(i.tolist(), v)) for k in range(classes)]
        e = [math.exp(x) for x in s]
        for f, x in zip(i.tolist(), v):
            for k in range(classes):
                g = x * (e[k] / sum(e) - (k == c))
                old = n.get((f, k), 0.0)
                z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language_id.ALPHA * w[f, k]
                n[f, k] = old + g * g
        fitter.learn(c, i, v)
    assert all(abs(fitter.z[f, k] - x) < 1e-9 for (f, k), x in z.items()) and abs(fitter.z).sum() > 1


def test_one_text_repeated_is_one_example(spark):
    """The sample is bounded for each language, whatever is repeated, and every language is learned."""
    rows = [(i, "the same text again and again", "en", "", "") for i in range(3000)]
    rows += [(10_000 + i, f"{WORDS['de'][i % 20]} und {WORDS['de'][i * 7 % 20]} {i}", "de", "", "") for i in range(200)]
    rows += [(20_000 + i, f"zz{chr(97 + i % 26)}{chr(97 + i // 26)} qq{chr(97 + i // 26)} {chr(97 + i % 26)}{chr(97 + i // 26)}xx", f"l{i}", "", "") for i in range(120) if zlib.crc32(str(20_000 + i).encode()) % 5]
    model = language_id.fit(spark.createDataFrame(rows, DOCS), sample=50)
    assert {"en", "de"} <= set(model["langs"]) and len(model["langs"]) == 2 + sum(r[0] >= 20_000 for r in rows)
    got = language_id.predict(spark.createDataFrame([(1, "the same text again and again", "", "", ""), (2, "und der die nicht", "", "", "")], DOCS), model).collect()
    assert {r.doc_id: r.lang_pred for r in got}[2] == "de"
