import random
import time

import pytest

from leafgraph.llm import similar
from leafgraph.llm.similar import similar_documents
from leafgraph.llm.simhash_dedup import simhash


def plain_groups(texts, shingle=5, share=0.8):
    """Least id of each document's group, by comparing all pairs."""
    sets, prints = {}, {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
        prints[i] = simhash((t or "").encode(), shingle) % (1 << 64)
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or (both and both >= share * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: root(i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    line = " ".join(rng.choice(plain) for _ in range(40))
    texts = []
    for _ in range(60):
        words = rng.choices(plain, k=rng.randint(3, 120))
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words = list(words)
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(plain)
            texts.append(" ".join(words))
    texts += [" ".join(rng.choices(plain, k=rng.randint(2, 30))) + " " + line for _ in range(90)]
    base = rng.choices(plain, k=100)
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randint(1, 2)):
            words[rng.randrange(100)] = rng.choice(plain)
        texts.append(" ".join(words))
    texts += ["", None, "  ", "one", "One", "one two", " ".join(rng.choices(plain, k=3000))]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("slot, common", [(256, 20_000), (4, 3)])
def test_groups_equal_all_pairs(spark, monkeypatch, slot, common):
    monkeypatch.setattr(similar, "SLOT", slot)
    monkeypatch.setattr(similar, "COMMON", common)
    texts = corpus(slot)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts.items()], "doc_id long, text string, token string, n int")
    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    assert got == plain_groups(texts)


def test_empty_and_lone_tables(spark):
    shape = "doc_id long, text string"
    assert similar_documents(spark.createDataFrame([], shape)).count() == 0
    rows = similar_documents(spark.createDataFrame([(7, None), (9, "a b c")], shape)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(7, 7), (9, 9)}


def test_a_repeated_line_alone_does_not_link(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    texts = {}
    for k in range(10):
        line = fresh(9)
        texts |= {2 * k + i: fresh(60) + (" " + line) * 100 for i in range(2)}
    same = fresh(60)
    texts |= {100 + i: same + " " + fresh(1) for i in range(3)} | {200: "", 201: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    assert got == {i: i for i in range(20)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_rounds_without_crowds_read_no_texts(spark, monkeypatch):
    """Rounds in which nothing is left to compare are left out, with their tables and exchanges (driver's memory)."""
    calls, verified = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda *a: calls.append(1) or verified(*a))
    base = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(base if k < 2 else [f"u{k}"] * 10 + [f"v{k}x{i}" for i in range(50)])) for k in range(8)]
    found = dict(map(tuple, similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()))
    assert found == {k: 0 if k < 2 else k for k in range(8)}
    assert len(calls) == 1


def test_the_driver_gives_back_what_it_freed(spark):
    from leafgraph.llm.common import release

    heap = spark._jvm.java.lang.Runtime.getRuntime()
    size = min(int(0.3 * heap.maxMemory()), 2_000_000_000)
    held = [spark.sparkContext._gateway.new_array(spark._jvm.long, size // 8) for _ in range(2)]
    assert heap.totalMemory() > 2 * size
    del held
    for _ in range(20):  # the gateway lets go of them a little later
        time.sleep(0.5)
        release(spark)
        if heap.totalMemory() - heap.freeMemory() < size:
            break
    assert heap.totalMemory() - heap.freeMemory() < size
