import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from leafgraph.llm.packing import WordIds, pack, plan, slots

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start string, length string, sequence_id int"  # names that clash


def direct(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def test_word_ids_are_those_of_whole_texts():
    ids = WordIds(PATH)
    for text in ["", "  ", "Don't stop<|endoftext|>now", "a\x85b\xa0c İΑΣ 日本語 ́é\tx\x1cy z", "x" * 3000, "a\nb\r\n\x0b\x0cA B."]:
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == direct(text)[:-1]


def test_plan_places_every_length_once():
    rng = random.Random(1)
    for _ in range(50):
        hist = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 300)))
        patterns = plan(dict(hist), 64)
        assert all(sum(p) <= 64 for p, _ in patterns)
        assert Counter({k: sum(n * p.count(k) for p, n in patterns) for k in hist}) == hist
        taken = Counter()
        for length, a, b, _, _ in slots(patterns):
            taken[length] += b - a + 1
        assert taken == hist
    assert plan({}, 64) == []


def test_pack_is_a_partition_without_gaps(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["red", "green", "Blue,", "ñandú", "x1y2"]) for _ in range(rng.choice([0, 1, 3, 90, 400]))) for _ in range(80)]
    rows = [(i, t, "s", "l", 5) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None), (None, "tail", "", "", 1), (90, None, "", "", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = [r.asDict() for r in pack(docs, PATH, context=128).collect()]
    by_id = {r[0]: direct(r[1]) for r in rows}
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    covered = Counter()
    for r in out:
        ids = by_id[r["doc_id"]]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
    assert covered == Counter({k: len(v) * (2 if k == 3 else 1) for k, v in by_id.items()})
    fills = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert fills.get(r["sequence_id"], 0) == r["offset"]
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 128 and set(fills) == set(range(len(fills)))


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_ids_do_not_depend_on_blocks(monkeypatch):
    import public_tokenizers

    from leafgraph.llm import packing

    ids_of = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "one  two\n three " * 20, "a" * 500, "Été déjà 12.5 " * 30 + " "]
    whole = [ids_of.encode(t) for t in texts]
    for block in (1, 7, 100):
        monkeypatch.setattr(packing, "BLOCK", block)
        assert [ids_of.encode(t) for t in texts] == whole
