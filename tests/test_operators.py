"""Hand-worked cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from leafgraph.functions import geometry as G
from leafgraph.functions import text as T
from leafgraph.operators import batch, graph, lines, models, nodes, regions, subgraphs, words
from leafgraph.operators.subgraphs import Expansion
from leafgraph.sources import scans

LINE = "doc_id long, page int, ord long, text string, l double, t double, r double, b double"


def page(spark, boxes):
    return spark.createDataFrame([(1, 1, i + 1, f"line {i}", *map(float, b)) for i, b in enumerate(boxes)], LINE)


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 100.0, 20.0, 50.0, 30.0, 150.0, 90.0)], "a_l double, a_t double, a_r double, a_b double, b_l double, b_t double, b_r double, b_b double")
    a, b = G.Box.of("a_"), G.Box.of("b_")
    got = df.select(a.width, b.height, G.h_overlap(a, b), G.h_ratio(a, b), G.v_overlap(a, b), G.v_gap(a, b), G.v_gap(b, a), G.intersection(a, b), G.alignment(a, b), G.spatial_score(a, b)).first()
    assert tuple(got) == pytest.approx((100, 60, 50, 0.5, 0, 10, 10, 0, 0.5, 0.4))
    poly = spark.createDataFrame([([1.0, 2.0, 5.0, 2.0, 5.0, 9.0, 1.0, 9.0],), ([1.0, 2.0, 3.0],), ([1.0] * 9,)], "p array<double>").select(*G.from_polygon(F.col("p"))).collect()
    assert tuple(poly[0]) == (1, 2, 5, 9) and poly[1].l is None and poly[2].l is None


def test_next_line_and_chunks(spark):
    p = page(spark, [(10, 10, 110, 20), (10, 25, 110, 35), (200, 12, 300, 22)])
    edges = lines.next_line(p)
    assert [tuple(r)[2:] for r in edges.collect()] == [(1, 2, 0.6667)]
    owners = {r.ord: r.chunk for r in lines.chunk_chains(p, lines.continues(p, edges)).collect()}
    assert owners == {1: 1, 2: 1, 3: 3}
    table = lines.chunk_table(p, lines.chunk_chains(p, lines.continues(p, edges))).orderBy("chunk").collect()
    assert [(r.chunk, r.n_lines, r.text) for r in table] == [(1, 2, "line 0\nline 1"), (2, 1, "line 2")]


def test_infographic_pair(spark):
    p = page(spark, [(10, 10, 110, 20), (10, 24, 90, 34)])
    assert [r.score for r in lines.merge_pairs(p).collect()] == [0.85]
    assert [r.score for r in lines.next_below(p, 2.0, 0.1, 0.1).collect()] == [0.91]
    assert {r.chunk for r in lines.chunk_components(p, lines.merge_pairs(p)).collect()} == {1}


def test_least_ancestor_is_the_greedy_walk(spark):
    rng = random.Random(1)
    n = 120
    edges = [(i, rng.randint(i + 1, min(n, i + 9))) for i in range(1, n) if rng.random() < 0.8]
    out = dict(edges)
    owner = {}
    for i in range(1, n + 1):
        j = i
        while j is not None and j not in owner:
            owner[j] = i
            j = out.get(j)
    all_nodes = spark.createDataFrame([(1, 1, i) for i in range(1, n + 1)], "doc_id long, page int, ord long")
    e = spark.createDataFrame([(1, 1, a, b) for a, b in edges], "doc_id long, page int, source long, target long")
    assert {r.ord: r.chunk for r in graph.least_ancestor(all_nodes, e).collect()} == owner


def test_lexical(spark):
    a = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "x y"), (1, 3, None)], "page int, id long, text string")
    b = spark.createDataFrame([(1, 9, "Alpha, gamma!")], "page int, id long, text string")
    assert [tuple(r) for r in regions.lexical_top(a, b, ["page"], k=0).collect()] == [(1, 1, 9, 0.3361)]


def test_texts(spark):
    df = spark.createDataFrame([("Hi there. Ok!  Yes? no",), ("  ",), (None,)], "x string")
    assert [r[0] for r in df.select(T.sentences(F.col("x"))).collect()] == [["Hi there.", "Ok!", "Yes?", "no"], [], []]
    df = spark.createDataFrame([('```json\n{"answer": "a"}\n```',), ('so {"answer": "b"} ok',), ("[1]",), ('{"answer":',)], "x string")
    assert [r[0] for r in df.select(T.json_field(F.col("x"), "answer")).collect()] == ["a", "b", "[1]", '{"answer":']
    labels = spark.createDataFrame([(" Bar-Chart ",), ("Data_Table",), ("photo",)], "x string")
    assert [tuple(r) for r in labels.select(T.canonical_label(F.col("x")), T.label_matches(F.col("x"), ["image"]), T.label_matches(F.col("x"), [])).collect()] == [("chart", False, True), ("data table", False, True), ("image", True, True)]
    v = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(T.cosine01(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.9, 0.5, 0, 0.5])


def walk(spark, **more):
    edges = [("a", "b", 0.9), ("a", "c", 0.6), ("b", "d", 0.8), ("c", "d", 0.7), ("d", "e", 0.5), ("b", "a", 0.9)]
    code = {c: i for i, c in enumerate("abcde")}
    e = spark.createDataFrame([(code[s], code[t], "r", c, i) for i, (s, t, c) in enumerate(edges)], "source long, target long, relation string, conf_off double, edge_ord long")
    n = spark.createDataFrame([(i,) for i in range(5)], "node long")
    rel = spark.createDataFrame([(0, i, r) for i, r in enumerate((0.95, 0.7, 0.4, 0.6, 0.2))], "query long, node long, rel double")
    seed = spark.createDataFrame([(0, 0, 0.95, 1)], "query long, seed long, rel double, rank long")
    p = Expansion(**({"top_m": 2} | more))
    hubs = subgraphs.degrees(n, e)
    scores = subgraphs.edge_scores(e, hubs, rel, p)
    chosen = subgraphs.expand(seed, subgraphs.pruned(scores, p), p)
    name = "abcde"
    return p, seed, rel, hubs, scores, chosen, [(r.hop, name[r.source] + name[r.target]) for r in chosen.orderBy("seq").collect()]


def test_expansion(spark):
    p, seed, rel, hubs, scores, chosen, order = walk(spark)
    assert {r.node: (r.deg, r.hub) for r in hubs.collect()} == {0: (3, 1.386294), 1: (3, 1.386294), 2: (2, 1.098612), 3: (3, 1.386294), 4: (1, 0.693147)}
    assert sorted(float(r.score) for r in scores.collect()) == [0.380685, 0.590139, 0.811371, 0.861371, 1.011371, 1.261371]
    assert order == [(1, "ab"), (1, "ac"), (2, "ba"), (2, "bd"), (2, "cd")]
    scored = subgraphs.node_scores(seed, chosen)
    assert {r.node: float(r.score) for r in scored.collect()} == {0: 1.261371, 1: 1.011371, 2: 0.590139, 3: 0.861371}
    assert float(subgraphs.subgraph_scores(seed, scored).first().score) == 1.044704
    kept, inside = subgraphs.prune(seed, scored, chosen, rel, 2)
    assert {r.node for r in kept.collect()} == {0, 1} and {(r.source, r.target) for r in inside.collect()} == {(0, 1), (1, 0)}
    assert subgraphs.prune(seed, scored, chosen, rel, 0)[0].count() == 0
    assert walk(spark, top_m=1)[-1] == [(1, "ab"), (2, "ba")]
    assert walk(spark, max_nodes=3)[-1] == [(1, "ab"), (1, "ac")]
    assert walk(spark, hops=3)[-1][-1] == (3, "de")


def test_dedupe_and_order(spark):
    rows = [("x", "y", "r", 0.4, 0), ("x", "y", "r", 0.9, 1), ("x", "y", "q", 0.1, 2), ("x", "y", "r", 0.9, 3)]
    out = graph.dedupe(spark.createDataFrame(rows, "source string, target string, relation string, score double, n int"), ["source", "target", "relation"], "n")
    assert sorted((r.relation, r.n) for r in out.collect()) == [("q", 2), ("r", 1)]


def test_patches(spark):
    image = spark.createDataFrame([(1, 1, "i", "region", "image", "image", "", 0.0, 0.0, 100.0, 50.0)], "doc_id long, page int, node_id string, node_type string, label string, modality string, text string, l double, t double, r double, b double")
    out = nodes.patch_nodes(image, 2, 3).orderBy("node_id").collect()
    assert len(out) == 6 and out[-1].r == 100 and out[-1].b == 50 and [r.t for r in out] == [0] * 3 + [25] * 3
    edges = graph.both_ways(spark.createDataFrame([(1, 0, "i", "j", "r", 1.0)], "doc_id long, edge_ord int, source_id string, target_id string, relation string, score double"), "back")
    made = nodes.payload(image.withColumn("node_ord", F.lit(0)), edges).first().graph
    assert '"num_regions":1,"num_fine_nodes":0,"num_edges":2}' in made and '"center_x":50.0' in made and '"label":"image"' in made and "modality" not in made


def test_resume(spark):
    asked = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "ord int, question_id long")
    done = spark.createDataFrame([(2, "good"), (3, batch.FAILED)], "question_id long, answer string")
    assert sorted(r.question_id for r in batch.pending(asked, done).collect()) == [1, 4]
    assert batch.pending(asked, done, overwrite=True).count() == 4
    new = spark.createDataFrame([(1, "n"), (3, "m")], "question_id long, answer string")
    assert [(r.question_id, r.answer) for r in batch.upsert(asked, done, new).orderBy("ord").collect()] == [(1, "n"), (2, "good"), (3, "m")]


def test_words_to_lines(spark):
    rows = [("b", 60, 11, 100, 21), ("a", 10, 10, 50, 20), ("c", 10, 40, 50, 50), ("d", 55, 41, 90, 51)]
    df = spark.createDataFrame([(1, 1, i, w, *map(float, box)) for i, (w, *box) in enumerate(rows)], "doc_id long, page int, input_ord long, text string, l double, t double, r double, b double")
    assert [(r.ord, r.text) for r in words.group_words(df).orderBy("ord").collect()] == [(0, "a b"), (1, "c d")]


def test_files(spark, tmp_path):
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr/d1.json").write_text('{"recognitionResults": [{"page": 1, "lines": [{"text": "Hi you", "boundingBox": [0,0,9,0,9,5,0,5], "words": [{"text": "Hi", "boundingBox": [0,0,4,0,4,5,0,5]}, {"text": " ", "boundingBox": [4,0,5,0,5,5,4,5]}, {"text": "you", "boundingBox": [5,0,9,0,9,5,5,5]}]}, {"text": "bad", "boundingBox": [1,2], "words": []}]}]}')
    files = scans.json_files(spark, str(tmp_path / "ocr"), scans.POLYGON_OCR)
    assert [r.text for r in scans.ocr_words(files).orderBy("input_ord").collect()] == ["Hi", "you"]
    assert [(r.doc_id, r.text, r.r) for r in scans.ocr_lines(files).collect()] == [("d1", "Hi you", 9.0)]
    with pytest.raises(ValueError):
        scans.page_of(scans.ocr_lines(files), 7)
    (tmp_path / "det").mkdir()
    (tmp_path / "det/a.json").write_text('{"detections": [{"label": "table", "score": 0.9, "bbox_xyxy": [0, 0, 5, 5]}]}')
    (tmp_path / "det/b.json").write_text('[{"label": "image", "score": 0.8, "bbox_xyxy": [1, 1, 1, 5]}]')
    found = scans.detections(spark, str(tmp_path / "det"))
    assert sorted((r.doc_id, r.label) for r in found.collect()) == [("a", "table"), ("b", "image")]
    assert [r.doc_id for r in regions.layout_regions(found).collect()] == ["a"]
    (tmp_path / "q.json").write_text('{"data": [{"questionId": 5, "question": "q?", "image": "i.png"}]}')
    (tmp_path / "a.json").write_text('[{"questionId": 5, "answer": "x"}, {"questionId": 6}]')
    assert scans.questions(spark, str(tmp_path / "q.json")).first().question_id == 5
    assert [r.answer for r in scans.answers(spark, str(tmp_path / "a.json")).collect()] == ["x"]
    block = '{"Id": "%s", "Text": "%s", "Confidence": 9.0, "Geometry": {"BoundingBox": {"Left": 0.1, "Top": 0.2, "Width": 0.5, "Height": 0.1}}, "Relationships": [{"Type": "CHILD", "Ids": ["w1", "zz"]}]}'
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks/d.json").write_text('{"WORD": [%s], "LINE": [%s], "PAGE": []}' % (block % ("w1", "word"), block % ("l1", "line")))
    raw, size = scans.json_files(spark, str(tmp_path / "blocks"), scans.BLOCK_OCR), spark.createDataFrame([("d", 100.0, 200.0)], "doc_id string, width double, height double")
    line = scans.blocks(raw, size)
    assert tuple(line.first())[5:9] == pytest.approx((10, 40, 60, 60))
    assert [r.text for r in scans.children(line, scans.blocks(raw, size, "WORD")).collect()] == ["word"]


def test_models(spark):
    df = spark.createDataFrame([("q", "[1] x\nfirst\n\n[2] y\nsecond"), ("q", None)], "question string, context string")
    assert [r.answer for r in models.answer(df).collect()] == ["first", ""]

    def broken():
        def fail(q, c):
            raise RuntimeError("no")

        return fail

    assert {r.error for r in models.answer(df, broken).collect()} == {"RuntimeError: no"}
    vec = models.embed_nodes(spark.createDataFrame([("a b",), (None,)], "context string")).collect()
    assert len(vec[0].vec) == 64 and sum(x * x for x in vec[0].vec) == pytest.approx(1)


def test_stream_answers_each_question_once(spark, tmp_path):
    from leafgraph.streaming.resume import answer_stream

    schema = "question_id long, question string"
    solve = lambda df: df.withColumn("answer", F.upper("question"))
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        answer_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), solve, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.question_id, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_texts_for_models(spark):
    from leafgraph.functions import prompts as P

    df = spark.createDataFrame([("A-Chart", "  ", 2, "subgraph_001_x", " ", 0.25), ("borderless", " seen ", 1, "subgraph_002_y", "n1", 1.0)], "label string, ocr string, rank int, sid string, seed string, score double")
    got = df.select(P.prompt_kind(F.col("label")).alias("k"), P.region_prompt(F.col("label"), F.col("ocr")).alias("p"), P.bundle_header(F.col("rank"), F.col("sid"), F.col("seed"), F.col("score"), F.array(F.lit(""), "ocr")).alias("h")).collect()
    assert [r.k for r in got] == ["chart", "table"] and got[0].p == P.PROMPTS["chart"] and got[1].p.endswith("\nseen")
    assert got[0].h.split("\n") == ["Expanded subgraph rank: 2", "Subgraph id: subgraph_001_x", "Seed node: [unknown]", "Subgraph score: 0.2500", "Associated region image node ids:   "]
    texts = spark.createDataFrame([(" a ",), ("a</s>",), (None,)], "x string").select(P.instructed(F.col("x"), None, "</s>").alias("x")).collect()
    assert [r.x for r in texts] == ["a</s>", "a</s>", "[EMPTY NODE CONTEXT]</s>"] and P.options(" a, ,b,") == ("a", "b") and P.options(None) == ()
    replies = spark.createDataFrame([('{"summary": "s", "visible_text": ["v", " "], "region_type": ""}', "photo"), ("{broken", "photo"), (None, "x_y")], "reply string, label string")
    a = replies.select(P.region_reply(F.col("reply"), F.col("label")).alias("a")).select("a.*").collect()
    assert (a[0].region_type, a[0].summary, a[0].visible_text) == ("", "s", ["v"]) and (a[1].region_type, a[1].summary) == ("image", "{broken") and (a[2].region_type, a[2].summary, a[2].key_points) == ("x y", "", [])


def test_seams(spark):
    df = spark.createDataFrame([(1, "table", "cells"), (2, "title", "words"), (3, "photo", None)], "region long, label string, content string")
    read = lambda: lambda prompts_, images: ['{"summary": "read"}' for _ in prompts_]
    got = {r.region: r for r in models.analyse_regions(df, read).collect()}
    assert got[1].graph_text == "Summary: read\n\nOCR text:\ncells" and got[2].graph_text == "words" and got[2].analysis is None and got[3].graph_text == "Summary: read"

    def fails():
        def run(prompts_, images):
            raise RuntimeError("no")

        return run

    assert {r.error for r in models.analyse_regions(df, fails).collect()} == {"RuntimeError: no", None}
    images = spark.createDataFrame([(1, bytearray(b"x"))], "doc_id long, content binary")
    found = models.detect(images, lambda: lambda x: [("Chart", 0.3, [0, 0, 1, 1]), ("table", 0.9, [0, 0, 2, 2]), ("table", 0.1, [0, 0, 3, 3])])
    assert [(r.region, r.label) for r in found.orderBy("region").collect()] == [(0, "table"), (1, "Chart")]
    assert [r.label for r in models.detect(images, lambda: lambda x: [("Chart", 0.3, [0, 0, 1, 1]), ("table", 0.9, [0, 0, 2, 2])], ["chart"]).collect()] == ["Chart"]
    assert models.resolved("hub/Big-2", {"big": int, "big-2": float})[0] is float and models.resolved("big", {"big": int}, accelerated=True)[1] == "cuda"
    with pytest.raises(ValueError):
        models.resolved("x", {"big": int})


def test_capped_trace_and_joint_expansion(spark):
    p, seed, rel, hubs, scores, chosen, _ = walk(spark, max_nodes=3)
    traced = subgraphs.trace(chosen, subgraphs.pruned(scores, p))
    assert traced.count() == 2 and subgraphs.extents(seed, chosen, p).first().stopped_early
    two = seed.unionByName(spark.createDataFrame([(0, 2, 0.4, 2)], "query long, seed long, rel double, rank long"))
    joint = subgraphs.expand(subgraphs.merged(two), subgraphs.pruned(scores, Expansion(top_m=2)), Expansion(top_m=2))
    assert [(r.hop, r.source, r.target) for r in joint.orderBy("seq").collect()] == [(1, 0, 1), (1, 0, 2), (1, 2, 3), (2, 1, 0), (2, 1, 3), (2, 3, 4)]


def test_many_questions_go_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "node long, vec array<double>")
    q = v.select(F.col("node").alias("query"), F.col("vec").alias("qvec"))
    whole = sorted(map(tuple, subgraphs.relevance(v, q).collect()))
    monkeypatch.setattr(subgraphs, "BLOCK", 7)
    assert sorted(map(tuple, subgraphs.relevance(v, q).collect())) == whole and len(whole) == 1600


def test_questions_without_an_edge_have_no_merged_payload(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from leafgraph.plans.oracle import SQL
    from leafgraph.plans.queries import REGISTRY

    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (100, [-1.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name, count in (("merged_payload", 1), ("legacy_payload", 2)):
        got = REGISTRY[name](spark, str(tmp_path))
        theirs = con.sql(SQL[name])
        assert sorted(map(tuple, got.select(*theirs.columns).collect())) == sorted(theirs.fetchall()) and got.count() == count


def test_words_of_a_text_are_hashed_once(spark):
    import time

    text = " ".join(f"word{i}" for i in range(300))
    rows = spark.range(200).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("context"))
    start = time.time()
    got = models.embed_nodes(rows).agg(F.sum(F.size(F.filter("vec", lambda x: x != 0)))).first()[0]
    assert got > 200 * 50 and time.time() - start < 60  # thousands of seconds when each entry made the list again


def odd_walk(spark):
    """Vectors with copies, zeros, nulls and another size, questions and edges over them."""
    rng = random.Random(5)
    vecs = [[rng.choice((-1.0, 0.5, 2.0)) for _ in range(3)] for _ in range(50)] + [[0.0] * 3, None, [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 0.0, 1.0]]
    v = spark.createDataFrame(list(enumerate(vecs)), "node long, vec array<double>")
    q = v.filter("node % 10 = 0 or node >= 50").select(F.col("node").alias("query"), F.col("vec").alias("qvec"))
    e = spark.createDataFrame([(rng.randrange(55), rng.randrange(55), "ab"[k % 2], k) for k in range(200)], "source long, target long, relation string, edge_ord long")
    e = subgraphs.edge_confidence(e, v)
    return v, q, e, subgraphs.degrees(v.select("node"), e)


def test_nearest_nodes_without_all_pairs(spark, monkeypatch):
    v, q, _, _ = odd_walk(spark)
    text = lambda df: sorted(map(str, df.select("query", "node", "rel", "rank").collect()))
    all_pairs = subgraphs.best(subgraphs.relevance(v, q), ["query"], F.col("rel").desc(), F.col("node"), k=5, name="rank")
    monkeypatch.setattr(subgraphs, "SENT", 4)
    assert text(subgraphs.nearest(v, q, 5)) == text(all_pairs)


def test_edges_of_some_sources_are_pruned_alone(spark):
    v, q, e, hubs = odd_walk(spark)
    p = Expansion(top_m=2, threshold=0.3)
    cols = ["query", "source", "target", "relation", "edge_ord", "score", "k"]
    whole = subgraphs.pruned(subgraphs.edge_scores(e, hubs, subgraphs.relevance(v, q), p), p)
    some = q.select("query").crossJoin(v.filter("node % 3 = 0").select(F.col("node").alias("source")))
    got = subgraphs.pruned_of(some, e, hubs, v, q, p)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, whole.filter("source % 3 = 0").select(cols).collect())) and got.count() > 50


def test_all_edges_are_scored_by_blocks(spark, monkeypatch):
    v, q, e, hubs = odd_walk(spark)
    cols = ["query", "source", "target", "relation", "edge_ord", "score"]
    whole = sorted(map(str, subgraphs.edge_scores(e, hubs, subgraphs.relevance(v, q)).select(cols).collect()))
    monkeypatch.setattr(subgraphs, "BLOCK", 3)
    monkeypatch.setattr(subgraphs, "SENT", 4)
    assert sorted(map(str, subgraphs.all_edge_scores(e, hubs, v, q).select(cols).collect())) == whole and len(whole) == 2000
