import hashlib
import random

from leafgraph.llm.fingerprints import edited_fingerprints, likeness, neighbours

DOCS = "doc_id long, text string, n_chars string, fp string, id string"


def rows_of(rng):
    words = "red green blue cyan magenta yellow black white orange".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))) for _ in range(60)]
    texts += [None, "", "ñandú 日本語 text 😀😀 end", "one", " \n\t "]
    rows = [(i * 50, t) for i, t in enumerate(texts)] + [(100, "twin"), (100, "twin"), (None, "null id"), (None, None)]
    return [(*r, "a", "b", "c") for r in rows]


def test_edited_texts_against_plain_version(spark):
    rows = rows_of(random.Random(1))
    out = edited_fingerprints(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(out) == len(rows)
    # the order of rows that share an id is free; the others' edited texts aren't
    unique = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None and r[0] != 100})
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for (i, text), (j, after) in zip(unique, unique[1:]):
        if j - i != 50:
            continue
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[i][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i][0].n_chars == len(text)
    by_text = {}
    for r in rows:
        if r[0] not in (100, None):
            by_text.setdefault(" ".join((r[1] or "").split()), set()).add(got[r[0]][0].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    for r in out:
        a, b = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert r.near_edited == 1 - bin(a ^ b).count("1") / 64 and 0 <= r.near_next <= 1
        if r.doc_id is not None and r.doc_id % 100 == 0:
            assert r.near_count == sum(bin(a ^ int(x.fingerprint, 16)).count("1") <= 3 for x in out) - 1
        else:
            assert r.near_count is None


def test_single_and_no_document(spark):
    one = edited_fingerprints(spark.createDataFrame([(5, "abcdefgh", "", "", "")], DOCS)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(12):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    some = sorted(prints)[::7]
    asked = spark.createDataFrame([(x,) for x in some], "fp long")
    for radius, blocks in ((3, 6), (2, 4), (0, 1)):
        found = {tuple(r) for r in neighbours(df, asked, radius, blocks).collect()}
        assert found == {(q, x) for q in some for x in prints if bin((q ^ x) % (1 << 64)).count("1") <= radius}
