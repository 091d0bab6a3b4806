"""DuckDB SQL of the answer path's queries, written on its own but for the texts of prompts."""

from __future__ import annotations

from leafgraph.functions import prompts
from leafgraph.plans.oracle import CAPPED, GRAPH, LINES, NEXT, OWNERS, PAGE, REGIONS, VALID, CHUNKS, on


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RANKED = """
top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, seed ORDER BY score DESC, node) <= 3),
means AS (SELECT query, seed, round((sum(score)/count(*))::DECIMAL(18,12), 6)::DECIMAL(12,6) AS score FROM top GROUP BY ALL),
ranked AS (SELECT s.query, s.seed, s.rank, s.rel, m.score, row_number() OVER (PARTITION BY s.query ORDER BY m.score DESC, s.rank) AS place FROM seeds s JOIN means m USING (query, seed)),
edge_lists AS (
  SELECT query, seed, 1 AS hop, source, target, k, 0 AS found FROM hop1 UNION ALL SELECT query, seed, 2, source, target, k, hop2.at FROM hop2
),
sizes AS (SELECT query, seed, count(*) AS n_nodes, string_agg(node::VARCHAR, ',' ORDER BY score DESC, node) AS node_ids FROM scored GROUP BY ALL),
edge_sizes AS (SELECT query, seed, count(*) AS n_edges, string_agg(source || '>' || target, ',' ORDER BY hop, found, k) AS edge_ids FROM edge_lists GROUP BY ALL),
sub AS (SELECT *, printf('subgraph_%03d_%d', rank, seed) AS subgraph_id, coalesce(n_edges, 0) AS edges FROM ranked JOIN sizes USING (query, seed) LEFT JOIN edge_sizes USING (query, seed))"""
IMAGES = """
images AS (SELECT query, seed, node, row_number() OVER (PARTITION BY query, seed ORDER BY rel DESC, node) AS place FROM scored JOIN nodes USING (node) JOIN rel USING (query, node) WHERE node_type = 'region' QUALIFY place <= 2)"""
MERGED = """
m1 AS (SELECT DISTINCT s.query, p.source, p.target, p.relation FROM seeds s JOIN pruned p ON p.query=s.query AND p.source=s.seed),
fresh AS (SELECT DISTINCT query, target AS node FROM m1 WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.query=m1.query AND seeds.seed=m1.target)),
m2 AS (SELECT DISTINCT f.query, p.source, p.target, p.relation FROM fresh f JOIN pruned p ON p.query=f.query AND p.source=f.node),
joint AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
reached AS (SELECT query, seed AS node FROM seeds UNION SELECT query, target FROM joint),
joint_nodes AS (SELECT query, count(*) AS n_nodes, string_agg(node::VARCHAR, ',' ORDER BY rel DESC, node) AS node_ids FROM reached JOIN rel USING (query, node) GROUP BY ALL),
joint_edges AS (SELECT query, count(*) AS n_edges FROM joint GROUP BY ALL)"""
ROUTE = "CASE p_partkey%5 WHEN 0 THEN 'chart' WHEN 1 THEN 'table' WHEN 2 THEN 'table' WHEN 3 THEN 'other' ELSE 'chart' END"
NEAR = "round(conf_off, 6)::DECIMAL(8,6)"

SQL = {
    "cse_trace": on(GRAPH, CAPPED, "kept AS (SELECT query, seed, 1::BIGINT AS hop, source FROM k1 UNION SELECT query, seed, 2::BIGINT, source FROM c2 WHERE n - new < 3 AND e - 1 < 4)")
    + "SELECT query, seed, hop, source, target, relation, score::DOUBLE AS score FROM kept JOIN pruned USING (query, source)",
    "cse_stopped_early": on(GRAPH, CAPPED, "kept AS (SELECT query, seed, target FROM k1 UNION ALL SELECT query, seed, target FROM c2 WHERE n - new < 3 AND e - 1 < 4)")
    + """SELECT s.query, s.seed, 1 + count(DISTINCT CASE WHEN target <> s.seed THEN target END) AS n_nodes, count(target) AS n_edges, count(target) > 0 AND (1 + count(DISTINCT CASE WHEN target <> s.seed THEN target END) >= 3 OR count(target) >= 4) AS stopped_early
      FROM seeds s LEFT JOIN kept k USING (query, seed) GROUP BY ALL""",
    "subgraph_payload": on(GRAPH, RANKED) + """SELECT query, subgraph_id, rank, node_type AS seed_type, score::DOUBLE AS subgraph_score, n_nodes AS num_selected_nodes, edges AS num_selected_edges, false AS stopped_early, node_ids, coalesce(edge_ids, '') AS edge_ids, edges AS traced
      FROM sub JOIN nodes ON node = seed""",
    "multi_payload": on(GRAPH, RANKED) + """SELECT query, 'like ' || query || '?' AS text, 'graph of ' || query AS document, 5 AS top_k, 2 AS hops, 3 AS top_m, 0.6::DOUBLE AS threshold, 0.5::DOUBLE AS alpha, 0.1::DOUBLE AS lambda_hub,
      count(*) AS num_subgraphs, count(*) AS num_seed_nodes, sum(n_nodes)::BIGINT AS num_total_nodes, sum(edges)::BIGINT AS num_total_edges, string_agg(seed::VARCHAR, ',' ORDER BY rank) AS seed_ids, string_agg(subgraph_id, ',' ORDER BY place) AS subgraph_ids FROM sub GROUP BY ALL""",
    "merged_payload": on(GRAPH, MERGED) + "SELECT query, n_nodes AS num_selected_nodes, n_edges AS num_selected_edges, false AS stopped_early, node_ids, n_edges FROM joint_nodes JOIN joint_edges USING (query)",
    "legacy_payload": on(GRAPH, MERGED) + "SELECT query, 'subgraph_001' AS subgraph_id, 1 AS rank, 0.0::DOUBLE AS subgraph_score, n_nodes FROM joint_nodes",
    "prune_totals": on(GRAPH, """kept AS (SELECT query, seed, node FROM scored JOIN rel USING (query, node) QUALIFY row_number() OVER (PARTITION BY query, seed ORDER BY (node=seed) DESC, greatest(score, rel::DECIMAL(12,6), 0) DESC, node) <= 3),
      inside AS (SELECT s.query FROM selected s WHERE EXISTS (SELECT 1 FROM kept a WHERE a.query=s.query AND a.seed=s.seed AND a.node=s.source) AND EXISTS (SELECT 1 FROM kept a WHERE a.query=s.query AND a.seed=s.seed AND a.node=s.target))""")
    + """SELECT c.query, n_subgraphs, nodes_after, (SELECT count(*) FROM inside i WHERE i.query=c.query) AS edges_after, n - nodes_after AS pruned
      FROM (SELECT query, count(DISTINCT seed) AS n_subgraphs, count(*) AS n FROM scored GROUP BY 1) c JOIN (SELECT query, count(*) AS nodes_after FROM kept GROUP BY 1) k USING (query)""",
    "neighbor_structs": on(GRAPH) + f"""SELECT node, coalesce((SELECT string_agg(target || ':' || relation || ':' || {NEAR}, ',' ORDER BY edge_ord) FROM conf WHERE source=node), '') AS outgoing,
      md5(coalesce((SELECT string_agg(source || ':' || relation || ':' || {NEAR}, ',' ORDER BY edge_ord) FROM conf WHERE target=node), '')) AS incoming_md5,
      coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT target AS x FROM edges WHERE source=node UNION SELECT source FROM edges WHERE target=node)), '') AS neighbor_ids FROM nodes""",
    "region_images": on(GRAPH, IMAGES) + "SELECT * FROM images",
    "bundle_header": on(GRAPH, RANKED, IMAGES, """blocks AS (SELECT query, seed, string_agg('[' || node || '] type=' || node_type || ' rel=' || round(rel::DECIMAL(12,6),4)::DECIMAL(12,4) || ' final=' || round(score,4)::DECIMAL(12,4) || ' label=' || CASE WHEN label = '' THEN modality ELSE label END || chr(10) || text, chr(10)||chr(10) ORDER BY score DESC, node) AS context
      FROM scored JOIN nodes USING (node) JOIN rel USING (query, node) GROUP BY ALL)""")
    + """SELECT query, seed, 'Expanded subgraph rank: ' || rank || chr(10) || 'Subgraph id: ' || subgraph_id || chr(10) || 'Seed node: ' || seed || chr(10) || 'Subgraph score: ' || round(score, 4)::DECIMAL(12,4) || chr(10) || 'Associated region image node ids: '
      || coalesce((SELECT string_agg(node::VARCHAR, ', ' ORDER BY place) FROM images i WHERE i.query=sub.query AND i.seed=sub.seed), 'none') AS header, md5('Expanded subgraph context:' || chr(10) || context) AS context_md5 FROM sub JOIN blocks USING (query, seed)""",
    "prompt_routing": f"""SELECT p_partkey, {ROUTE} AS kind, md5(CASE {ROUTE} WHEN 'table' THEN {text(prompts.PROMPTS["table"])} WHEN 'chart' THEN {text(prompts.PROMPTS["chart"])} ELSE {text(prompts.PROMPTS["other"])} END
      || CASE WHEN p_partkey%3=0 THEN chr(10) || chr(10) || {text(prompts.OCR_NOTE)} || chr(10) || trim(p_name) ELSE '' END) AS prompt_md5 FROM part""",
    "answer_prompt": f"""SELECT conv_id, turn, md5({text(prompts.ANSWER)} || chr(10) || chr(10) || 'User question:' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Number of expanded subgraphs:' || chr(10) || (turn+1)) AS prompt_md5 FROM conversations""",
    "instructed_text": "SELECT p_partkey, 'Instruct: Find it.' || chr(10) || 'Input: ' || CASE WHEN p_partkey%4=0 THEN '[EMPTY NODE CONTEXT]' ELSE trim(p_name) END || '<end>' AS text FROM part",
    "region_analysis": """WITH x AS (SELECT *, ['table','chart','title','image'][p_partkey%4+1] AS kind, p_partkey%3=0 AS json, '```json' || chr(10) || '{"summary": "a ' || p_type || '", "key_points": ["' || p_brand || '", " ", "x"], "title_or_topic": ""}' || chr(10) || '```' AS reply FROM part)
      SELECT p_partkey, CASE WHEN kind <> 'title' THEN kind END AS region_type, CASE WHEN kind = 'title' THEN NULL WHEN json THEN 'a ' || p_type ELSE 'plain ' || p_name END AS summary, CASE WHEN kind <> 'title' THEN json::INT * 2 END AS points,
      md5(CASE WHEN kind = 'title' THEN CASE WHEN json THEN reply ELSE 'plain ' || p_name END WHEN json THEN 'Summary: a ' || p_type || chr(10) || chr(10) || 'Key points: ' || p_brand || '; x' || chr(10) || chr(10) || 'OCR text:' || chr(10) || reply
        ELSE 'Summary: plain ' || p_name || chr(10) || chr(10) || 'OCR text:' || chr(10) || 'plain ' || p_name END) AS graph_text_md5 FROM x""",
    "response_text": "SELECT c_custkey, CASE c_custkey%3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'R(' || c_name || ')' END AS text FROM customer",
    "edge_filter": on(GRAPH) + "SELECT source, target, relation FROM edges WHERE relation = 'skip' AND (source::VARCHAR LIKE '1%' OR target::VARCHAR LIKE '1%')",
    "graph_view": on(GRAPH, "seen AS (SELECT node FROM nodes WHERE node_type <> 'fine' AND contains(text, 'of 1'))") + "SELECT source, target, relation FROM edges WHERE relation <> 'skip' AND source IN (SELECT node FROM seen) AND target IN (SELECT node FROM seen)",
    "view_adjacent": on(GRAPH, "both_ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges)") + "SELECT a AS selected, b AS node FROM both_ways WHERE a%100=0 UNION SELECT a, a FROM both_ways WHERE a%100=0",
    "display_filter": on(LINES, NEXT, VALID, OWNERS) + """SELECT e.doc_id, e.source, e.target FROM next_line e JOIN owners a ON a.doc_id=e.doc_id AND a.page=e.page AND a.ord=e.source JOIN owners b ON b.doc_id=e.doc_id AND b.page=e.page AND b.ord=e.target
      WHERE e.source <= 50 AND e.target <= 50 AND a.chunk <> b.chunk""",
    "relation_classes": on(*PAGE, CHUNKS) + """SELECT doc_id, coalesce(line, 0) AS line, membership, coalesce(chunk, 0) AS chunk FROM (SELECT doc_id, count(*) AS membership FROM owners GROUP BY 1) LEFT JOIN (SELECT doc_id, count(*) AS line FROM next_line GROUP BY 1) USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) - 1 AS chunk FROM chunks GROUP BY 1) USING (doc_id)""",
    "graph_payload": on(REGIONS) + """SELECT doc_id, source || '.png' AS document_image_path, n_chars::VARCHAR AS stats_num_words, '2' AS stats_num_regions, '0' AS stats_num_lines, '1' AS stats_num_edges,
      (SELECT string_agg(printf('p1_%s_001', label), '') FROM regions r WHERE r.doc_id=d.doc_id AND region=1) AS nodes1_id, (SELECT max(label) FROM regions r WHERE r.doc_id=d.doc_id AND region=1) AS nodes1_label, 'next_region' AS edges0_relation, '1.0' AS edges0_score FROM documents d""",
}
