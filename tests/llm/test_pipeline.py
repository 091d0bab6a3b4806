import random

import corpus_pipeline as P
from tests.llm.test_similar import plain_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(tmp_path, spark):
    rng = random.Random(1)
    plain = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            words[10:10] = ["grubscum", "stupido"]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1].replace(" ", "  "), "en", "s", 1) for i in range(0, 100)]
    rows += [(2000 + i, rows[i][1] + " " + " ".join(rows[i][1].split()), "en", "s", 1) for i in range(1, 4)]
    rows += [(3000, "call +1 (743) 555-3824 or 8.8.4.4 now", "en", "s", 1), (3001, "", None, None, None), (3002, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_against_plain_versions(spark, tmp_path):
    d, rows = fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = P.toxicity(spark, docs, d)
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    bad = {r[0] for r in rows if r[1] and "grubscum" in r[1]}
    assert len(ids & bad) <= 0.05 * len(bad) and len({r[0] for r in rows} - bad - ids) <= 0.02 * len(rows), (len(ids & bad), len({r[0] for r in rows} - bad - ids))
    unique = P.exact_dedup(spark, clean, d)
    kept = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        kept.setdefault(" ".join((r.text or "").split()), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(kept.values()) and unique.columns == docs.columns
    apart = P.near_dedup(spark, unique, d)
    group = plain_groups({r.doc_id: r.text for r in unique.collect()})
    assert any(i >= 2000 for i in group) and not any(2000 <= r.doc_id < 3000 for r in apart.collect())
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(group.values()))
    masked = P.pii(spark, apart, d)
    before, after = {r.doc_id: r for r in apart.collect()}, {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and before.keys() == after.keys()
    assert {i for i in before if before[i] != after[i]} == {3000} and after[3000].n_chars == len(after[3000].text)
    packed = P.packing(spark, masked, d).collect()
    assert {r.doc_id for r in packed} == set(after)
    whole = P.run(spark, d).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "c d", "en", "s", 3), (None, "a  b", "en", "s", 4), (None, "e f g", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = P.exact_dedup(spark, docs, "")
    assert sorted(" ".join(r.text.split()) for r in out.collect()) == ["a b", "c d", "e f g"]
    assert P.near_dedup(spark, out, "").count() == 3
    empty = spark.createDataFrame([], DOCS)
    assert P.exact_dedup(spark, empty, "").count() == P.near_dedup(spark, empty, "").count() == P.pii(spark, empty, "").count() == 0


CLASH = "doc_id long, text string, _key string, _score string, _parts string, _new string, n_pii string, N_chars int, `a.b` string, uid long, component_id long, kept boolean"


def test_clashing_names(spark, tmp_path):
    d, _ = fixture(tmp_path, spark)
    texts = ["a b c d e f g", "a  b c d e f g", "call 8.8.4.4", None, "", "w" * 10]
    rows = [(i, t, f"k{i}", f"s{i}", f"p{i}", f"n{i}", f"c{i}", i, f"d{i}", -i, i, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASH)
    for stage in (P.toxicity, P.exact_dedup, P.near_dedup, P.pii):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], stage
        got = {r[0]: tuple(r) for r in out.collect()}
        change = {2} if stage is P.pii else set()
        assert all(got[i] == rows[i] or i in change and got[i][2:] == rows[i][2:] for i in got), stage
        assert len(got) == {P.toxicity: 6, P.exact_dedup: 4, P.near_dedup: 4, P.pii: 6}[stage], (stage, got)
    assert {r.doc_id for r in P.packing(spark, docs, d).collect()} == set(range(6))
