"""DuckDB SQL of the scans' queries: what the files were made from."""

from __future__ import annotations

from leafgraph.plans.oracle import GRAPH, REGIONS, on

HEIGHT = "(CASE WHEN doc_id%5=0 THEN NULL ELSE (b-t)/greatest(1, doc_id%4) END)"
INDEX = "greatest(0, least(doc_id%3+region, greatest(1, doc_id%4)-1))"

SQL = {
    "ocr_word_scan": on(REGIONS) + "SELECT doc_id, 1 AS page, 0::BIGINT AS input_ord, label AS text, l, t, r, b FROM regions WHERE region=0 UNION ALL SELECT doc_id, 1, 2, 'r0', l, t, r, b FROM regions WHERE region=0",
    "ocr_line_scan": on(REGIONS) + "SELECT doc_id, region+1 AS page, 0 AS input_ord, label || ' ' || region AS text, l, t, r, b FROM regions WHERE NOT (region=1 AND doc_id%5=0)",
    "ocr_page_lookup": on(REGIONS) + "SELECT doc_id, label || ' 1' AS text FROM regions WHERE region=1 AND doc_id%5<>0",
    "block_scan": on(REGIONS) + "SELECT doc_id, 'l0' AS id, label || ' x' AS text, 98.0::DOUBLE AS confidence, round(l,6) AS l, round(t,6) AS t, round(r,6) AS r, round(b,6) AS b FROM regions WHERE region=0",
    "line_word_children": on(REGIONS) + "SELECT doc_id, 'l0' AS line_id, 'w0' AS id, label AS text FROM regions WHERE region=0",
    "detection_scan": on(REGIONS) + "SELECT doc_id, region, label, region/2+0.25::DOUBLE AS score, md5(content) AS content_md5, l, t, r, b FROM regions",
    "question_scan": "SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord, c_custkey AS question_id, 'who is ' || c_name || '?' AS question, c_nationkey || '.png' AS image FROM customer",
    "answer_scan": "SELECT c_custkey AS question_id, c_name AS answer FROM customer WHERE c_custkey%7>0 AND c_custkey%5>0",
    "pixel_boxes": on(REGIONS) + "SELECT doc_id, region, greatest(0,l) AS l, greatest(0,t) AS t, least(200,r) AS r, least(150,b) AS b FROM regions WHERE least(200,r) > greatest(0,l) AND least(150,b) > greatest(0,t)",
    "polygon_anchor": on(REGIONS) + "SELECT doc_id, region, 4 AS points, r AS third_x, l AS x, t AS y FROM regions",
    "sentence_slots": on(REGIONS) + f"SELECT doc_id, region, l, round(coalesce(t + {INDEX}*{HEIGHT}, t),6) AS t, r, round(CASE WHEN doc_id%5=0 OR {INDEX} = greatest(1, doc_id%4)-1 THEN b ELSE t + ({INDEX}+1)*{HEIGHT} END,6) AS b FROM regions",
    "store_round_trip": on(GRAPH) + "SELECT node::VARCHAR AS node_id, node_type, len(vec) AS dimensions, (SELECT count(*) FROM edges WHERE source=node) AS confident FROM nodes",
    "embedding_bounds": on(GRAPH) + "SELECT 'n' || a.node AS node_id, b.node AS row, len(b.vec) AS dimensions FROM nodes a JOIN nodes b ON b.node = a.node*2-10 WHERE a.node%3>0 AND a.node >= 5",
    "graph_scan": on(REGIONS) + "SELECT doc_id, CASE region WHEN 1 THEN 'b' ELSE 'a' END AS id, region::BIGINT AS node_ord, label, l, region::BIGINT AS deg, CASE region WHEN 0 THEN 'b' END AS target_id, CASE region WHEN 0 THEN 1.0::DOUBLE END AS edge_score, NULL::DOUBLE AS conf_off FROM regions",
    "build_report": "SELECT c_custkey AS doc_id, CASE c_custkey%4 WHEN 0 THEN 'error: not built' WHEN 1 THEN 'error: no page in ' || c_name ELSE 'ok' END AS status FROM customer",
}
