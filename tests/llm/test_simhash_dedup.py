import random

import numpy as np
import xxhash

from leafgraph.llm.common import components
from leafgraph.llm.simhash_dedup import bucket_keys, decode, links, near_duplicates, simhash

DOCS = "doc_id long, text string, fp string, component_id string"


def plain_simhash(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least index reachable, for a list of unsigned fingerprints."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def clustered(rng, centres, each, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_simhash_is_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["Red", "GREEN", "blue", "ÉA", "x", "y z"]) for _ in range(n))
        assert simhash(text.encode()) % (1 << 64) == plain_simhash(text)


def test_every_word_is_within_three_bits_of_its_codeword():
    words = np.random.default_rng(0).integers(0, 1 << 23, 20_000)
    index = decode(words)
    codewords = {}
    for w, i in zip(words.tolist(), index.tolist()):
        codewords.setdefault(i, []).append(w)
    assert all(bin(a ^ b).count("1") <= 6 for ws in codewords.values() for a in ws[:20] for b in ws[:20])
    assert len(codewords) > 4000


def test_keys_meet_for_all_pairs_of_up_to_two_flips():
    rng = random.Random(2)
    for _ in range(30):
        x = rng.getrandbits(64)
        pairs = [x] + [x ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)] + [x ^ (1 << a) for a in range(64)]
        key, owner, centre = bucket_keys(np.array(pairs, np.uint64).view(np.int64))
        own = set(key[(owner == 0) & centre])
        assert set(owner[np.isin(key, list(own))]) == set(range(len(pairs)))


def test_links_keep_all_components(spark):
    rng = random.Random(3)
    prints = list(dict.fromkeys(clustered(rng, 6, 60, 4) + clustered(rng, 200, 1, 0) + [0, 1, 3, (1 << 64) - 1]))
    expected = plain_components(prints)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for dense in (64, 2):  # the other way for crowded buckets gives the same
        found = {r.node: r.root for r in components(links(df, dense)).collect()}
        got = [found.get(signed(x), signed(x)) for x in prints]
        assert {(a, b) for a, b in zip(expected, got)}.__len__() == len(set(expected)) == len(set(got))


def test_against_plain_version(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("one two three four five six seven eight".split()) for _ in range(rng.choice([1, 5, 80]))) for _ in range(30)]
    texts = base + [t + " end" for t in base] + ["", " \n", None, "hot"] + ["hot"] * 300
    rows = [(i + 5, t, "a", "b") for i, t in enumerate(texts)] + [(5, texts[0], "", ""), (None, "lone null", "", ""), (None, "hot", "", "")]
    prints = [plain_simhash(r[1] or "") for r in rows]
    roots = plain_components(prints)
    least = {}
    for r, c in zip(rows, roots):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    expected = sorted(((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, roots)), key=repr)
    out = near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, out.collect()), key=repr) == expected


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    for local in (0, 10_000):  # by rounds of stars, and by one task
        found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), local=local).collect()}
        assert all(found[i] == 0 for i in range(41)) and all(found[1000 + i] == 1000 for i in range(300)) and len(found) == 341
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
