"""DuckDB SQL of the queries, written on its own."""

from __future__ import annotations

LINES = """
raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), boxed AS (
  SELECT doc_id, 1 AS page, i, text, ((length(text)+i)%3*130 + (length(text)*7)%60)::DOUBLE AS l, (i*9 + (i//5)*24 + length(text)%5)::DOUBLE AS t, length(text) AS n FROM raw
), lines AS (
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY t, l, i) AS ord, text, l, t, l + 6*least(n,50)+6 AS r, t + 10 + n%6 AS b FROM boxed
)"""
REGIONS = """
regions AS (
  SELECT d.doc_id, 1 AS page, k AS region, ['table','figure','chart','image'][(d.doc_id+k)%4+1] AS label, (d.doc_id%3*40)::DOUBLE AS l, (k*120 + d.doc_id%7*10)::DOUBLE AS t,
         (d.doc_id%3*40)::DOUBLE + 330 AS r, (k*120 + d.doc_id%7*10)::DOUBLE + 70 + d.doc_id%5*10 AS b, coalesce(bm.text, '') AS content
  FROM documents d CROSS JOIN (VALUES (0),(1)) v(k) LEFT JOIN benchmark bm ON bm.item_id = (d.doc_id*2+k)%40
)"""


def w(a: str) -> str:
    return f"greatest({a}.r-{a}.l,0)"


def h(a: str) -> str:
    return f"greatest({a}.b-{a}.t,0)"


def hov(a: str, b: str) -> str:
    return f"greatest(0, least({a}.r,{b}.r)-greatest({a}.l,{b}.l))"


def vov(a: str, b: str) -> str:
    return f"greatest(0, least({a}.b,{b}.b)-greatest({a}.t,{b}.t))"


def over(x: str, y: str) -> str:
    return f"(CASE WHEN {y} > 0 THEN {x}/({y}) ELSE 0 END)"


def hr(a: str, b: str) -> str:
    return over(hov(a, b), f"least({w(a)},{w(b)})")


def vr(a: str, b: str) -> str:
    return over(vov(a, b), f"least({h(a)},{h(b)})")


def gap(a: str, b: str) -> str:
    return f"(CASE WHEN {b}.t >= {a}.b THEN {b}.t-{a}.b WHEN {a}.t >= {b}.b THEN {a}.t-{b}.b ELSE 0 END)"


def mh(a: str, b: str) -> str:
    return f"greatest(({h(a)}+{h(b)})/2,1)"


def cx(a: str) -> str:
    return f"(({a}.l+{a}.r)/2)"


def cy(a: str) -> str:
    return f"(({a}.t+{a}.b)/2)"


def sim(a: str, b: str) -> str:
    return f"(least({h(a)},{h(b)})/greatest({h(a)},{h(b)},1))"


def inter(a: str, b: str) -> str:
    return f"({hov(a, b)}*{vov(a, b)})"


def area(a: str) -> str:
    return f"({w(a)}*{h(a)})"


def align(a: str, b: str) -> str:
    return f"greatest(0, 1-abs({cx(a)}-{cx(b)})/greatest({w(a)},{w(b)},1))"


def spatial(a: str, b: str) -> str:
    return f"least(1, greatest({over(inter(a, b), f'least({area(a)},{area(b)})')}, (0.65::DOUBLE*{hr(a, b)}+0.35::DOUBLE*{align(a, b)})/(1+{gap(a, b)}/{mh(a, b)})))"


COST = f"{gap('s', 'c')}/{mh('s', 'c')} + 0.75::DOUBLE*abs(s.l-c.l)/greatest({w('s')},{w('c')},1) + 0.5::DOUBLE*(1-{hr('s', 'c')})"
NEXT = f"""
next_line AS (
  SELECT s.doc_id, s.page, s.ord AS source, c.ord AS target, round(1/(1+{COST}) + 1e-9::DOUBLE,4) AS score
  FROM lines s JOIN lines c ON s.doc_id=c.doc_id AND s.page=c.page AND c.t > s.t AND {gap('s', 'c')}/{mh('s', 'c')} <= 3.5
   AND NOT ({hr('s', 'c')} < 0.05 AND abs(s.l-c.l) > 4*{mh('s', 'c')})
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.page, s.ord ORDER BY {COST}, c.ord) = 1
)"""
VALID = f"""
valid AS (
  SELECT e.* FROM next_line e JOIN lines s ON s.doc_id=e.doc_id AND s.page=e.page AND s.ord=e.source JOIN lines c ON c.doc_id=e.doc_id AND c.page=e.page AND c.ord=e.target
  WHERE {gap('s', 'c')}/{mh('s', 'c')} <= 1.6 AND (abs(s.l-c.l)/greatest(s.r,c.r,1) <= 0.06 OR {hr('s', 'c')} >= 0.35)
)"""
OWNERS = """
reach AS (
  SELECT doc_id, page, ord, ord AS chunk FROM lines
  UNION
  SELECT r.doc_id, r.page, v.target, r.chunk FROM reach r JOIN valid v ON v.doc_id=r.doc_id AND v.page=r.page AND v.source=r.ord
), owners AS (SELECT doc_id, page, ord, min(chunk) AS chunk FROM reach GROUP BY ALL)"""
CHUNKS = r"""
chunks AS (
  SELECT l.doc_id, l.page, o.chunk AS head, count(*) AS n_lines,
   coalesce(string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY l.ord) FILTER (regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''), '') AS text,
   min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, row_number() OVER (PARTITION BY l.doc_id, l.page ORDER BY o.chunk) AS chunk
  FROM lines l JOIN owners o ON o.doc_id=l.doc_id AND o.page=l.page AND o.ord=l.ord GROUP BY l.doc_id, l.page, o.chunk
)"""
MEET = "s.doc_id=g.doc_id AND s.page=g.page AND g.l < s.r AND s.l < g.r AND g.t < s.b AND s.t < g.b"
SHARE = over(inter("s", "g"), area("s"))
INSIDE = f"""
inside AS (
  SELECT s.doc_id, s.page, s.ord, g.region, round(least(1,{SHARE}) + 1e-9::DOUBLE,4) AS score FROM lines s JOIN regions g ON {MEET} WHERE {SHARE} >= 0.5
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.page, s.ord ORDER BY {SHARE} DESC, g.region) = 1
)"""
BRIDGE = """
bridges AS (
  SELECT doc_id, page, chunk, region, max(bridge) AS bridge FROM (
    SELECT e.doc_id, e.page, o.chunk, i.region, round(least(1, e.score*i.score) + 1e-9::DOUBLE,4) AS bridge FROM next_line e JOIN owners o ON o.doc_id=e.doc_id AND o.page=e.page AND o.ord=e.source JOIN inside i ON i.doc_id=e.doc_id AND i.page=e.page AND i.ord=e.target
    UNION ALL
    SELECT e.doc_id, e.page, o.chunk, i.region, round(least(1, e.score*i.score) + 1e-9::DOUBLE,4) FROM next_line e JOIN owners o ON o.doc_id=e.doc_id AND o.page=e.page AND o.ord=e.target JOIN inside i ON i.doc_id=e.doc_id AND i.page=e.page AND i.ord=e.source
  ) GROUP BY ALL
)"""


def extent(table: str) -> str:
    return f"extent AS (SELECT doc_id, page, greatest(max(r),1) AS page_w, greatest(max(b),1) AS page_h, sqrt(greatest(max(r),1)**2 + greatest(max(b),1)**2) AS diagonal FROM {table} GROUP BY ALL)"


def below(table: str, gaps: float, ov: float, shift: float) -> str:
    g = f"{gap('s', 'c')}/{mh('s', 'c')}"
    left, centre = "abs(s.l-c.l)/x.page_w", f"abs({cx('s')}-{cx('c')})/x.page_w"
    score = f"(0.45::DOUBLE*(1-{g}/{gaps}::DOUBLE) + 0.35::DOUBLE*greatest({hr('s', 'c')}, 1-least({left},{centre})/{shift}::DOUBLE, 0) + 0.2::DOUBLE*{sim('s', 'c')})"
    return f"""SELECT s.doc_id, s.page, s.ord AS source, c.ord AS target, round({score} + 1e-9::DOUBLE,4) AS score FROM {table} s JOIN {table} c ON s.doc_id=c.doc_id AND s.page=c.page AND c.t > s.t
      JOIN extent x ON x.doc_id=s.doc_id AND x.page=s.page WHERE {g} <= {gaps} AND ({hr('s', 'c')} >= {ov} OR {left} <= {shift} OR {centre} <= {shift}) AND {score} > 0
      QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.page, s.ord ORDER BY {score} DESC, c.ord) = 1"""


def near(table: str, far: float, owner: bool) -> str:
    dist = f"sqrt(({cx('s')}-{cx('c')})**2 + ({cy('s')}-{cy('c')})**2)/x.diagonal"
    side = f"greatest({hr('s', 'c')},{vr('s', 'c')})"
    score = f"(0.6::DOUBLE*(1-{dist}/{far}::DOUBLE) + 0.2::DOUBLE*{side} + 0.2::DOUBLE*{sim('s', 'c')})" if owner else f"(0.7::DOUBLE*(1-{dist}/{far}::DOUBLE) + 0.3::DOUBLE*{side})"
    other = "AND s.chunk <> c.chunk" if owner else ""
    return f"""SELECT doc_id, page, source, target, score FROM (
        SELECT s.doc_id, s.page, s.ord AS source, c.ord AS target, round({score} + 1e-9::DOUBLE,4) AS score FROM {table} s JOIN {table} c ON s.doc_id=c.doc_id AND s.page=c.page AND s.ord<>c.ord {other}
        JOIN extent x ON x.doc_id=s.doc_id AND x.page=s.page WHERE {dist} <= {far}
        QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.page, s.ord ORDER BY {score} DESC, c.ord) = 1)
      QUALIFY row_number() OVER (PARTITION BY doc_id, page, least(source,target), greatest(source,target) ORDER BY source) = 1"""


_MW = f"greatest(({w('s')}+{w('c')})/2,1)"
_REACH = "greatest(s.r,c.r,1)"
_LEFT, _CENTRE = f"abs(s.l-c.l)/{_REACH}", f"abs({cx('s')}-{cx('c')})/{_REACH}"
_MERGE = f"(0.45::DOUBLE*(1-least(1,{gap('s', 'c')}/({mh('s', 'c')}*1.2::DOUBLE))) + 0.35::DOUBLE*greatest({hr('s', 'c')}, 1-least(1,{_LEFT}/0.04::DOUBLE,{_CENTRE}/0.04::DOUBLE)) + 0.2::DOUBLE*{sim('s', 'c')})"
MERGED = f"""
looked AS (
  SELECT s.doc_id, s.page, s.ord AS source, c.ord AS target, {_MERGE} AS score, {gap('s', 'c')} <= {mh('s', 'c')}*1.2::DOUBLE AND greatest(0, c.l-s.r, s.l-c.r) <= {_MW}*0.1::DOUBLE
    AND ({hr('s', 'c')} >= 0.35 OR {_LEFT} <= 0.04 OR {_CENTRE} <= 0.04) AS ok,
    min(CASE WHEN c.t-s.b > {mh('s', 'c')}*1.2::DOUBLE*1.5::DOUBLE THEN c.ord END) OVER (PARTITION BY s.doc_id, s.page, s.ord) AS stop
  FROM lines s JOIN lines c ON s.doc_id=c.doc_id AND s.page=c.page AND s.ord < c.ord
), merged AS (SELECT doc_id, page, source, target, round(score + 1e-9::DOUBLE,4) AS score FROM looked WHERE ok AND (stop IS NULL OR target < stop) AND score >= 0.55)"""
COMPONENTS = """
twoway AS (SELECT doc_id, page, source AS x, target AS y FROM merged UNION SELECT doc_id, page, target, source FROM merged),
walk AS (
  SELECT doc_id, page, ord, ord AS chunk FROM lines
  UNION
  SELECT k.doc_id, k.page, e.y, k.chunk FROM walk k JOIN twoway e ON e.doc_id=k.doc_id AND e.page=k.page AND e.x=k.ord
), owners AS (SELECT doc_id, page, ord, min(chunk) AS chunk FROM walk GROUP BY ALL)"""
SENT = r"""list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda y: string_split(regexp_replace(regexp_replace(y, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '')"""
COARSE = f"""
coarse AS (
  SELECT doc_id, page, printf('p%d_chunk_%03d', page, chunk) AS node_id, 'chunk' AS node_type, '' AS label, 'paragraph' AS modality, text, l, t, r, b FROM chunks
  UNION ALL
  SELECT doc_id, page, printf('p%d_%s_%03d', page, label, region), 'region', label, CASE WHEN label = 'table' THEN 'table' ELSE 'image' END, content, l, t, r, b FROM regions
)"""
GRAPH = """
nodes AS (SELECT vec_id AS node, ['line','chunk','region','fine'][label%4+1] AS node_type, CASE WHEN label%4=3 THEN '' ELSE 'class ' || label END AS label, CASE WHEN label%4=3 THEN 'part ' || label ELSE '' END AS modality, 'text of ' || vec_id AS text, label AS class, embedding::DOUBLE[] AS vec FROM embeddings),
edges AS (
  SELECT node AS source, lead(node) OVER (PARTITION BY class ORDER BY node) AS target, 'next' AS relation, node AS edge_ord FROM nodes QUALIFY target IS NOT NULL
  UNION ALL SELECT a.node, b.node, 'skip', 10000000000 + a.node FROM nodes a JOIN nodes b ON b.node = a.node+7
  UNION ALL SELECT * FROM (SELECT node AS source, min(node) OVER (PARTITION BY class) AS target, 'hub', 20000000000 + node FROM nodes) WHERE source <> target
),
conf AS (SELECT e.*, round((1+list_cosine_similarity(s.vec, t.vec))/2, 6) AS conf_off FROM edges e LEFT JOIN nodes s ON s.node=e.source LEFT JOIN nodes t ON t.node=e.target),
hubs AS (
  SELECT n.node, coalesce(i,0) AS deg_in, coalesce(o,0) AS deg_out, coalesce(i,0)+coalesce(o,0) AS deg, round(ln(1+coalesce(i,0)+coalesce(o,0)),6) AS hub
  FROM nodes n LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY 1) a ON a.source=n.node LEFT JOIN (SELECT target, count(*) AS i FROM edges GROUP BY 1) b ON b.target=n.node
),
rel AS (SELECT q.node AS query, n.node, round((1+list_cosine_similarity(n.vec, q.vec))/2, 6) AS rel FROM nodes n JOIN nodes q ON q.node % 100 = 0),
seeds AS (SELECT query, node AS seed, rel, row_number() OVER (PARTITION BY query ORDER BY rel DESC, node) AS rank FROM rel QUALIFY rank <= 5),
scores AS (
  SELECT query, source, target, relation, edge_ord, round(coalesce(conf_off,0)::DECIMAL(12,6)*0.5::DECIMAL(4,3) + rel::DECIMAL(12,6) - hub::DECIMAL(12,6)*0.1::DECIMAL(4,3), 6)::DECIMAL(12,6) AS score
  FROM conf JOIN hubs ON hubs.node=target JOIN rel ON rel.node=target
),
pruned AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, edge_ord) AS k FROM scores WHERE score >= 0.6 QUALIFY k <= 3),
hop1 AS (SELECT s.query, s.seed, 1::BIGINT AS hop, p.source, p.target, p.relation, p.score, p.k, row_number() OVER (PARTITION BY s.query, s.seed ORDER BY p.k) AS e FROM seeds s JOIN pruned p ON p.query=s.query AND p.source=s.seed),
new1 AS (SELECT query, seed, target AS node, min(e) AS at FROM hop1 WHERE target <> seed GROUP BY ALL),
hop2 AS (SELECT n.query, n.seed, 2::BIGINT AS hop, p.source, p.target, p.relation, p.score, p.k, n.at FROM new1 n JOIN pruned p ON p.query=n.query AND p.source=n.node),
selected AS (SELECT query, seed, hop, source, target, relation, score FROM hop1 UNION ALL SELECT query, seed, hop, source, target, relation, score FROM hop2),
scored AS (
  SELECT query, seed, node, max(score) AS score FROM (SELECT query, seed, seed AS node, rel::DECIMAL(12,6) AS score FROM seeds UNION ALL SELECT query, seed, target, score FROM selected) GROUP BY ALL
)"""


CAPPED = """
      o1 AS (SELECT *, (target <> seed AND row_number() OVER (PARTITION BY query, seed, target ORDER BY e) = 1)::INT AS new FROM hop1),
      c1 AS (SELECT *, 1 + sum(new) OVER (PARTITION BY query, seed ORDER BY e) AS n FROM o1), k1 AS (SELECT * FROM c1 WHERE e = 1 OR (n - new < 3 AND e - 1 < 4)),
      s1 AS (SELECT query, seed, max(n) AS n, max(e) AS e FROM k1 GROUP BY ALL), f1 AS (SELECT k.query, k.seed, k.target AS node, k.e AS at FROM k1 k JOIN s1 USING (query, seed) WHERE new = 1 AND s1.n < 3 AND s1.e < 4),
      o2 AS (SELECT f.query, f.seed, p.source, p.target, p.relation, f.at, p.k, s1.n AS n0, s1.e + row_number() OVER (PARTITION BY f.query, f.seed ORDER BY f.at, p.k) AS e,
        (p.target <> f.seed AND NOT EXISTS (SELECT 1 FROM k1 WHERE k1.query=f.query AND k1.seed=f.seed AND k1.target=p.target) AND row_number() OVER (PARTITION BY f.query, f.seed, p.target ORDER BY f.at, p.k) = 1)::INT AS new
        FROM f1 f JOIN pruned p ON p.query=f.query AND p.source=f.node JOIN s1 ON s1.query=f.query AND s1.seed=f.seed),
      c2 AS (SELECT *, n0 + sum(new) OVER (PARTITION BY query, seed ORDER BY e) AS n FROM o2)"""


def on(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + " "


PAGE = (LINES, NEXT, VALID, OWNERS)
INFO = (LINES, MERGED, COMPONENTS)
INFO_CHUNKS = "boxes AS (SELECT *  EXCLUDE (chunk, head), chunk AS ord FROM chunks)"
OWNED = "owned AS (SELECT l.*, o.chunk FROM lines l JOIN owners o ON o.doc_id=l.doc_id AND o.page=l.page AND o.ord=l.ord)"
NODE_TEXT = r"regexp_replace(coalesce(text,''), '^\s+|\s+$', '', 'g')"
ASKED = "asked AS (SELECT o_orderkey AS question_id, o_orderkey AS ord, 'img/' || o_custkey || '.png' AS image, o_orderstatus AS s FROM orders)"

SQL = {
    "reading_order": on(LINES) + "SELECT doc_id, page, ord, length(text) AS n, l, t, r, b FROM lines",
    "next_line_page": on(LINES, NEXT) + "SELECT * FROM next_line",
    "chunk_continuation": on(LINES, NEXT, VALID) + "SELECT doc_id, page, source, target, score FROM valid",
    "chunk_chains": on(*PAGE) + "SELECT * FROM owners",
    "chunk_table": on(*PAGE, CHUNKS) + "SELECT doc_id, page, chunk, n_lines, md5(text) AS text_md5, l, t, r, b FROM chunks",
    "membership_edges": on(*PAGE) + """SELECT doc_id, 'line_'||ord AS source_id, 'chunk_'||chunk AS target_id, 'line_to_chunk' AS relation, 1.0::DOUBLE AS score FROM owners
      UNION ALL SELECT doc_id, 'chunk_'||chunk, 'line_'||ord, 'chunk_to_line', 1.0::DOUBLE FROM owners""",
    "next_chunk_lead": on(*PAGE, CHUNKS) + "SELECT doc_id, chunk AS source, lead(chunk) OVER (PARTITION BY doc_id ORDER BY page, t, l, chunk) AS target FROM chunks QUALIFY target IS NOT NULL",
    "next_region": on(REGIONS) + "SELECT doc_id, region AS source, lead(region) OVER (PARTITION BY doc_id ORDER BY page, t, l, region) AS target FROM regions QUALIFY target IS NOT NULL",
    "region_boxes": on(REGIONS) + "SELECT doc_id, page, region, label, l, t, r, b FROM regions",
    "line_region_best": on(LINES, REGIONS, INSIDE) + "SELECT * FROM inside",
    "lines_outside_regions": on(LINES, REGIONS, INSIDE) + "SELECT doc_id, page, ord FROM lines ANTI JOIN inside USING (doc_id, page, ord)",
    "region_expand": on(LINES, REGIONS, f"held AS (SELECT g.doc_id, g.region, count(*) AS n, min(s.l) AS ml, max(s.r) AS mr FROM lines s JOIN regions g ON {MEET} WHERE {SHARE} >= 0.5 GROUP BY ALL)")
    + "SELECT g.doc_id, g.page, g.region, g.label, coalesce(n,0) AS n_lines, CASE WHEN n > 0 THEN least(l,ml)-2 ELSE l END AS l, t, CASE WHEN n > 0 THEN greatest(r,mr)+2 ELSE r END AS r, b, coalesce(ml,l) AS min_line_left, coalesce(mr,r) AS max_line_right FROM regions g LEFT JOIN held USING (doc_id, region)",
    "region_text_capture": on(LINES, REGIONS, f"held AS (SELECT g.doc_id, g.region, string_agg(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY s.ord) FILTER (regexp_replace(s.text, '^\\s+|\\s+$', '', 'g') <> '') AS x FROM lines s JOIN regions g ON {MEET} WHERE {SHARE} >= 0.35 GROUP BY ALL)")
    + "SELECT doc_id, page, region, md5(coalesce(x,'')) AS content_md5 FROM regions LEFT JOIN held USING (doc_id, region)",
    "bridge_scores": on(*PAGE, REGIONS, INSIDE, BRIDGE) + "SELECT * FROM bridges",
    "region_chunk_edges": on(*PAGE, CHUNKS, REGIONS, INSIDE, BRIDGE, f"""
      held AS (SELECT s.doc_id, s.page, o.chunk, g.region, max({SHARE}) AS line FROM lines s JOIN regions g ON {MEET} JOIN owners o ON o.doc_id=s.doc_id AND o.page=s.page AND o.ord=s.ord GROUP BY ALL),
      pairs AS (SELECT g.doc_id, g.page, g.region, c.head AS chunk, {inter('g', 'c')}/least({area('g')},{area('c')}) AS overlap, {spatial('c', 'g')} AS near, coalesce(h.line,0) AS line, coalesce(br.bridge,0) AS bridge
        FROM regions g JOIN chunks c ON c.doc_id=g.doc_id AND c.page=g.page LEFT JOIN held h ON h.doc_id=g.doc_id AND h.page=g.page AND h.chunk=c.head AND h.region=g.region
        LEFT JOIN bridges br ON br.doc_id=g.doc_id AND br.page=g.page AND br.chunk=c.head AND br.region=g.region WHERE {area('g')} > 0 AND {area('c')} > 0)""")
    + "SELECT doc_id, page, region, chunk, round(least(1, greatest(overlap, line, near, bridge)) + 1e-9::DOUBLE,4) AS score FROM pairs WHERE bridge > 0 OR near >= 0.25 OR line >= 0.35 OR overlap >= 0.1",
    "tfidf_lexical_topk": r"""WITH texts AS (SELECT 'a' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
      toks AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM texts), tf AS (SELECT side, id, token, count(*)::DOUBLE AS tf FROM toks WHERE length(token) > 1 GROUP BY ALL),
      n AS (SELECT count(*) AS n FROM (SELECT DISTINCT side, id FROM tf)), idf AS (SELECT token, ln((1+n)/(1+count(*))) + 1 AS idf FROM tf, n GROUP BY token, n),
      wt AS (SELECT side, id, token, tf/sum(tf) OVER (PARTITION BY side, id) * idf AS w FROM tf JOIN idf USING (token)), nw AS (SELECT side, id, token, w/sqrt(sum(w*w) OVER (PARTITION BY side, id)) AS w FROM wt),
      sc AS (SELECT a.id AS left_id, b.id AS right_id, round(sum(a.w*b.w),6) AS score FROM nw a JOIN nw b ON a.token=b.token AND a.side='a' AND b.side='b' GROUP BY ALL)
      SELECT 1 AS page, left_id, right_id, round(score,4) AS score FROM sc WHERE score >= 0.08 QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY score DESC, left_id) <= 2""",
    "edge_dedupe": """SELECT l_suppkey%50 AS source, l_partkey%50 AS target, l_returnflag AS relation, l_quantity AS score, l_orderkey*10+l_linenumber AS edge_ord FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY score DESC, edge_ord) = 1""",
    "next_line_info": on(LINES, extent("lines")) + below("lines", 2.0, 0.10, 0.10),
    "merge_pairs": on(LINES, MERGED) + "SELECT * FROM merged",
    "chunk_components": on(*INFO) + "SELECT * FROM owners",
    "near_line_pairs": on(*INFO, OWNED, extent("lines")) + near("owned", 0.14, True),
    "next_chunk_info": on(*INFO, CHUNKS, INFO_CHUNKS, extent("boxes")) + below("boxes", 3.0, 0.05, 0.18),
    "near_chunk_pairs": on(*INFO, CHUNKS, INFO_CHUNKS, extent("boxes")) + near("boxes", 0.30, False),
    "page_extent": on(LINES, extent("lines")) + "SELECT doc_id, page, page_w, page_h, round(diagonal,6) AS diagonal FROM extent",
    "sentence_nodes": f"SELECT doc_id, unnest(range(len(s))) AS i, md5(unnest(s)) AS sentence_md5 FROM (SELECT doc_id, {SENT} AS s FROM documents)",
    "coarse_nodes": on(*PAGE, CHUNKS, REGIONS, COARSE) + "SELECT doc_id, node_id, node_type, label, modality, md5(text) AS text_md5 FROM coarse",
    "patch_grid": on(REGIONS) + """SELECT doc_id, printf('p%d_%s_%03d_patch_%03d', page, label, region, i*3+j) AS node_id, printf('p%d_%s_%03d', page, label, region) AS parent_id,
      round(l+(r-l)/3*j,6) AS l, round(t+(b-t)/2*i,6) AS t, round(CASE WHEN j=2 THEN r ELSE l+(r-l)/3*(j+1) END,6) AS r, round(CASE WHEN i=1 THEN b ELSE t+(b-t)/2*(i+1) END,6) AS b
      FROM regions, (VALUES (0),(1)) a(i), (VALUES (0),(1),(2)) c(j) WHERE label <> 'table'""",
    "layer_edges": on(*PAGE, CHUNKS, REGIONS, COARSE, f"fine AS (SELECT doc_id, node_id AS parent_id, printf('%s_sent_%03d', node_id, unnest(range(len(s)))) AS node_id FROM (SELECT doc_id, node_id, {SENT} AS s FROM coarse WHERE modality='paragraph'))")
    + "SELECT doc_id, parent_id AS source_id, node_id AS target_id, 'coarse_to_fine' AS relation, 1.0::DOUBLE AS score FROM fine UNION ALL SELECT doc_id, node_id, parent_id, 'fine_to_coarse', 1.0::DOUBLE FROM fine",
    "node_context": on(*PAGE, CHUNKS, REGIONS, COARSE) + f"""SELECT doc_id, node_id, md5('Node type: ' || node_type || chr(10) || 'Page: ' || page || chr(10) || CASE WHEN node_type='region' THEN 'Region label: ' || label || chr(10) ELSE '' END
      || 'Content:' || chr(10) || CASE WHEN {NODE_TEXT} = '' THEN '[EMPTY NODE CONTEXT]' ELSE {NODE_TEXT} END) AS context_md5 FROM coarse""",
    "embedding_records": on(*PAGE, CHUNKS) + "SELECT doc_id, printf('p%d_chunk_%03d', page, chunk) AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY printf('p%d_chunk_%03d', page, chunk)) - 1 AS row FROM chunks",
    "node_type_histogram": on(GRAPH) + "SELECT node_type AS value, count(*) AS n FROM nodes GROUP BY 1",
    "relation_histogram": on(GRAPH) + "SELECT relation AS value, count(*) AS n FROM edges GROUP BY 1",
    "graph_stats": on(GRAPH) + "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE node_type='line') AS n_lines, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(conf_off) FROM conf) AS n_confident",
    "node_search": on(GRAPH) + "SELECT node, node_type FROM nodes WHERE node_type IN ('line','region') AND contains(lower(text), 'text of 1')",
    "facet_values": on(GRAPH) + "SELECT DISTINCT label FROM nodes WHERE label <> ''",
    "induced_subgraph": on(GRAPH) + "SELECT source, target, relation FROM edges WHERE source IN (SELECT node FROM nodes WHERE node_type IN ('line','chunk')) AND target IN (SELECT node FROM nodes WHERE node_type IN ('line','chunk'))",
    "enrich_conf_off": on(GRAPH) + "SELECT source, target, relation, conf_off FROM conf",
    "enrich_degree_hub": on(GRAPH) + "SELECT * FROM hubs",
    "neighbor_summary": on(GRAPH) + """SELECT node, coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT DISTINCT target AS x FROM edges WHERE source=node)), '') AS outgoing,
      coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM (SELECT DISTINCT source AS x FROM edges WHERE target=node)), '') AS incoming FROM nodes""",
    "cse_relevance": on(GRAPH) + "SELECT * FROM rel",
    "cse_seeds": on(GRAPH) + "SELECT * FROM seeds",
    "cse_edge_scores": on(GRAPH) + "SELECT query, source, target, relation, score::DOUBLE AS score FROM scores",
    "cse_expand_2hop": on(GRAPH) + "SELECT query, seed, hop, source, target, relation, score::DOUBLE AS score FROM selected",
    "cse_expand_capped": on(GRAPH, CAPPED)
    + "SELECT query, seed, 1::BIGINT AS hop, e AS seq, source, target, relation FROM k1 UNION ALL SELECT query, seed, 2::BIGINT, e, source, target, relation FROM c2 WHERE n - new < 3 AND e - 1 < 4",
    "cse_subgraph_scores": on(GRAPH, """top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, seed ORDER BY score DESC, node) <= 3),
      m AS (SELECT query, seed, round((sum(score)/count(*))::DECIMAL(18,12), 6)::DECIMAL(12,6) AS score FROM top GROUP BY ALL), z AS (SELECT query, seed, count(*) AS n_nodes FROM scored GROUP BY ALL)""")
    + "SELECT s.query, s.seed, s.rank, n_nodes, score::DOUBLE AS score, row_number() OVER (PARTITION BY s.query ORDER BY score DESC, s.rank) AS place FROM seeds s JOIN m USING (query, seed) JOIN z USING (query, seed)",
    "cse_prune_topn": on(GRAPH, """kept AS (SELECT query, seed, node FROM scored JOIN rel USING (query, node) QUALIFY row_number() OVER (PARTITION BY query, seed ORDER BY (node=seed) DESC, greatest(score, rel::DECIMAL(12,6), 0) DESC, node) <= 3)""")
    + """SELECT k.query, k.seed, count(*) AS kept_nodes, (SELECT count(*) FROM selected s WHERE s.query=k.query AND s.seed=k.seed AND EXISTS (SELECT 1 FROM kept a WHERE a.query=s.query AND a.seed=s.seed AND a.node=s.source)
      AND EXISTS (SELECT 1 FROM kept a WHERE a.query=s.query AND a.seed=s.seed AND a.node=s.target)) AS kept_edges FROM kept k GROUP BY ALL""",
    "context_block": on(GRAPH) + """SELECT query, seed, md5(string_agg('[' || node || '] type=' || node_type || ' rel=' || round(rel::DECIMAL(12,6),4)::DECIMAL(12,4) || ' final=' || round(score,4)::DECIMAL(12,4) || ' label=' || CASE WHEN label = '' THEN modality ELSE label END || chr(10) || text, chr(10)||chr(10) ORDER BY score DESC, node)) AS context_md5
      FROM scored JOIN nodes USING (node) JOIN rel USING (query, node) GROUP BY ALL""",
    "json_extract": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "json_fallback": "SELECT conv_id, turn, CASE WHEN turn%2=0 THEN conv_id::VARCHAR ELSE 'plain words' END AS answer FROM conversations",
    "label_canonical": """WITH x AS (SELECT p_partkey, ['data table','bar chart','figure 2','image/photo','borderless'][p_partkey%5+1] AS norm FROM part)
      SELECT p_partkey, norm, CASE p_partkey%5 WHEN 1 THEN 'chart' WHEN 2 THEN 'figure' WHEN 3 THEN 'image' WHEN 4 THEN 'table' ELSE norm END AS canonical, p_partkey%5=1 AS is_chart, CASE WHEN p_partkey%5=0 THEN 'table' ELSE 'image' END AS modality FROM x""",
    "box_measures": on(REGIONS) + ("SELECT x.doc_id, " + ", ".join(f"round(({e})::DOUBLE,6) AS {n}" for n, e in {"h_overlap": hov("x", "y"), "v_overlap": vov("x", "y"), "h_ratio": hr("x", "y"), "gap": gap("x", "y"), "inter": inter("x", "y"), "align": align("x", "y"), "spatial": spatial("x", "y"), "sim": sim("x", "y"), "dist": f"sqrt(({cx('x')}-{cx('y')})**2+({cy('x')}-{cy('y')})**2)"}.items()) + " FROM regions x JOIN regions y ON x.doc_id=y.doc_id AND x.region=0 AND y.region=1"),
    "polygon_boxes": on(REGIONS) + "SELECT doc_id, region, l, t, r, b FROM regions",
    "distinct_entries": "SELECT event_type || '/' || user_id AS image, min(event_id) AS event_id FROM events GROUP BY 1",
    "resume_pending": "SELECT o_orderkey AS question_id FROM orders WHERE o_orderstatus <> 'F'",
    "batch_upsert": on(ASKED) + "SELECT ord, question_id, CASE WHEN question_id%2=0 THEN 'new' ELSE 'old ' || question_id END AS answer FROM asked WHERE question_id%2=0 OR s='F'",
    "bundle_missing": on(ASKED) + "SELECT DISTINCT substr(image, 5) AS file FROM asked WHERE substr(image, 5) NOT IN (SELECT c_custkey || '.png' FROM customer WHERE c_nationkey < 12)",
    "document_backfill": "SELECT c_custkey AS doc_id, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, (SELECT max(o_orderpriority) FROM orders WHERE o_custkey=c_custkey)) AS document FROM customer",
    "chunk_counts_by_doc": on(*PAGE) + "SELECT doc_id, count(DISTINCT chunk) AS n_chunks, count(*) AS n_lines FROM owners GROUP BY 1",
    "embed_nodes": on(GRAPH, """words AS (SELECT node, unnest(string_split(lower(text), ' ')) AS w FROM nodes), hashed AS (SELECT node, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM words),
      sums AS (SELECT node, h%64 AS d, sum(CASE WHEN (h >> 16)%2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM hashed GROUP BY ALL)""")
    + """SELECT n.node, 64 AS dimensions, coalesce((SELECT string_agg(d || ':' || round(v / z, 4)::DECIMAL(6,4), ' ' ORDER BY d) FROM sums s, (SELECT sqrt(sum(v*v)) AS z FROM sums WHERE node=n.node) WHERE s.node=n.node AND v <> 0), '') AS filled FROM nodes n""",
    "answer_questions": on(GRAPH) + """SELECT query, seed, arg_max(text, (score, -node)) AS answer, NULL::VARCHAR AS error FROM scored JOIN nodes USING (node) GROUP BY ALL""",
    "first_relations": on(GRAPH) + "SELECT relation, row_number() OVER (PARTITION BY relation ORDER BY edge_ord) AS n, source, target FROM edges QUALIFY n <= 10",
}

from leafgraph.plans.answer_oracle import SQL as _ANSWERS  # noqa: E402
from leafgraph.plans.scan_oracle import SQL as _SCANS  # noqa: E402

SQL |= _ANSWERS | _SCANS
