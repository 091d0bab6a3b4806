import base64
import hashlib
import random

from leafgraph.llm.warc import LoserTree, parse, record, round_trip, url_key

PAGES = "page_id long, url string, html string, kind string, sha string, file string"


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.choice([0, 1, 5, 20]))) for _ in range(k)]
        assert list(LoserTree(runs, key=lambda x: x)) == sorted(sum(runs, []))


def test_url_keys():
    assert url_key("https://www.Example.com/A?b=C#x") == "com,example)/a?b=c" and url_key(None) == "-" and url_key("http://[bad") == "http://[bad"


def plain(rows):
    groups = {}
    for p, _, h in rows:
        groups.setdefault(h or "", []).append(-1 if p is None else p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        top = max(groups[h or ""])
        first = (-1 if p is None else p) == top
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((p, len(data), sha, "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "<p>é\r\n\r\n</p>", "x" * 100_000, "WARC/1.1\r\n\r\n"] + [f"<html>{i}</html>" for i in range(20)]
    rows = [(i, rng.choice([None, "http://a.com/" + str(i % 7), "https://b.org/x y\nz"]), rng.choice(texts)) for i in range(80)]
    rows += [(100 + i, "http://hot.com/", "same") for i in range(200)] + [(5, *rows[5][1:]), (None, "http://n.com", "lone"), (None, None, "same")]
    pages = spark.createDataFrame([(*r, "k", "s", "f") for r in rows], PAGES).repartition(3)
    out = round_trip(pages, file_bytes=3000)
    got = out.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(rows)
    order = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order) and len({r.file for r in got}) > 3


def test_records():
    import zlib

    def gz(data):
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    two = gz(record("response", 1, "http://x", b"abc", 3, "S", None)) + gz(record("revisit", 2, None, b"abc", 3, "S", 1))
    (a, n, h, block), (b, m, g, other) = parse(two)
    assert (a, a + n, b + m) == (0, b, len(two)) and block.endswith(b"\r\n\r\nabc") and h["WARC-Type"] == "response"
    assert other.endswith(b"\r\n\r\n") and g["WARC-Refers-To"] == "<urn:page:1>" and g["X-Payload-Length"] == "3"


def test_nothing(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0
