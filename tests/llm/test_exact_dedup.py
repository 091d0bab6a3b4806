import hashlib
import random
import re
from collections import defaultdict

from leafgraph.llm.exact_dedup import BASES, PRIMES, combine, deduplicate, fingerprint, normalise, shift

DOCS = "doc_id long, text string, uid string, f string, kept int"  # names that clash


def plain(rows):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append((i is None, i, k))
    out = []
    for t, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1] or 0, m[2]))
        for m in members:
            out.append((m[1], first[1], len(members), m == first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_normalise_is_the_regex():
    rng = random.Random(3)
    for _ in range(500):
        s = "".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x85\xa0é") for _ in range(rng.randint(0, 9)))
        assert normalise(s.encode()) == re.sub(r"[ \t-\r]+", " ", s).encode()


def test_fingerprints_compose():
    rng = random.Random(4)
    data = rng.randbytes(100_003)
    direct = tuple(sum(b * pow(base, len(data) - 1 - i, p) for i, b in enumerate(data)) % p for base, p in zip(BASES, PRIMES))
    assert fingerprint(data) == direct
    for cut in (0, 1, 8192, 50_000, len(data)):
        a, b = data[:cut], data[cut:]
        assert combine((fingerprint(a), shift(len(a))), (fingerprint(b), shift(len(b))))[0] == fingerprint(data)


def rows_with_copies():
    rng = random.Random(5)
    texts = ["", " ", "\t\n", "a b", "a  b", "a\tb ", "á b", "x" * 30_000, "long text " * 2000, "long  text " * 2000, None]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(i, "hot copy") for i in range(100, 700)]
    rows += [(7, "twice"), (7, "twice"), (7, "other"), (None, "twice"), (None, "only null"), (None, "only null")]
    return [(*r, "u", "f", 1) for r in rows]


def test_against_plain_version(spark):
    rows = rows_with_copies()
    out = deduplicate(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows)


def test_segments_and_collisions(spark):
    rows = rows_with_copies()
    docs = spark.createDataFrame(rows, DOCS)
    # segments of 1000 bytes, and primes so small that different texts collide
    assert sorted(map(tuple, deduplicate(docs, segment=1000).collect()), key=repr) == plain(rows)
    more = rows + [(1000 + i, f"t{i:03}", "", "", 0) for i in range(200)]
    weak = deduplicate(spark.createDataFrame(more, DOCS), primes=(3,), bases=(2,))
    assert sorted(map(tuple, weak.collect()), key=repr) == plain(more)


def test_many_rows_under_one_id(spark):
    rows = [(None if i % 2 else 5, ("same text " if i % 3 else f"text {i % 7}  ") * 40, "", "", 0) for i in range(20_000)]
    out = deduplicate(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows)


def test_huge_text_is_normalised_in_place(monkeypatch):
    monkeypatch.setattr("leafgraph.llm.exact_dedup.SEGMENT_BYTES", 10)
    for s in ("a  b\t\n c" * 9, " \x0b\x0c" * 9, "  lead and trail \r\n", "á\x85b\xa0c  d" * 3):
        assert normalise(s.encode()) == re.sub(r"[ \t-\r]+", " ", s).encode()


def test_nothing(spark):
    assert deduplicate(spark.createDataFrame([], DOCS)).count() == 0
