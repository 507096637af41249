"""SQL (DuckDB) that says what the queries say; none where SQL cannot, or only very slowly on whole tables."""

from __future__ import annotations

from quirework.operators.agent import QUANTITATIVE, QUANTITATIVE_CLI, REFUSAL
from quirework.operators.triage import LEXICON, STOPWORDS

#: The limit of tokens of the queries that cut units.
SPLIT_TOKENS = 40
_B = "b AS (SELECT DISTINCT ON (block_id) * FROM text_blocks)"
_U = "u AS (SELECT * FROM ldus QUALIFY row_number() OVER (PARTITION BY ldu_id ORDER BY ingested_at DESC) = 1)"
_P = "p AS (SELECT * FROM profiles QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY profiled_at DESC) = 1)"
_F = "facts_ AS (SELECT *, TRY_CAST(nullif(regexp_extract(value, '^\\s*([-+]?[0-9]*\\.?[0-9]+)', 1), '') AS DOUBLE) AS value_num FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
_S = "s AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY doc_id, section_id ORDER BY ingested_at DESC) = 1)"
_TOK = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
_TOKS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_TITLE = "(regexp_matches({0}, '[\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({0}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}][\\p{{Lu}}\\p{{Lt}}]') AND NOT regexp_matches({0}, '(^|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}])\\p{{Ll}}'))"
_LIST = r"regexp_matches({0}, '^(\d+\.|-|\*)\s+')"


def r4(x: str, n: int = 4) -> str:
    """Rounded half up by its decimal digits, as Spark does."""
    return f"CAST(round(CAST(round({x}, 6) AS DECIMAL(28,6)), {n}) AS DOUBLE)"


def tok(c: str) -> str:
    return _TOK.format(c)


def header(c: str) -> str:
    return f"(length({c}) < 100 AND {_TITLE.format(c)} AND {c} NOT LIKE '%.')"


def _hits(stems: list[str]) -> str:
    return " + ".join(rf"len(regexp_extract_all(low, '\b{s}[\p{{L}}\p{{N}}_]*'))" for s in stems)


_DOMAIN = ", ".join(f"({_hits(st)}){' * 2' if d == 'governmental' else ''} AS {d}" for d, st in LEXICON.items())
_NAMES = list(LEXICON)
_LANGS = list(STOPWORDS)


def _rank(names: list[str], rows: str, key: str) -> str:
    """(key, name, best, second, total) with ties in the order of names."""
    union = " UNION ALL ".join(f"SELECT {key}, n, {i} AS i, '{x}' AS name, {x} AS v FROM {rows}" for i, x in enumerate(names))
    return f"r AS (SELECT {key}, any_value(n) AS n, sum(v) AS total, arg_min(name, (-v) * 100 + i) AS name, max(v) AS best, list_reverse_sort(list(v))[2] AS second FROM ({union}) GROUP BY {key})"


_BOX = "x AS (SELECT doc_id, page_number AS page_ix, CASE WHEN source_strategy = 'vision' THEN 'image' WHEN contains(text, '|') THEN 'vector' ELSE 'char' END AS kind, (x1 - x0) * (y1 - y0) AS area, CASE WHEN source_strategy <> 'vision' THEN length(text) END AS nc, CASE WHEN source_strategy <> 'vision' THEN round(y1 - y0, 2) END AS font FROM b)"
_STATS = f"""WITH {_B}, {_BOX}, st AS (SELECT doc_id, page_ix, coalesce(sum(area) FILTER (kind = 'char'), 0) AS ink, coalesce(sum(area) FILTER (kind = 'image'), 0) AS img, coalesce(sum(nc), 0) AS chars, count(DISTINCT font) AS font_count, count(*) FILTER (kind = 'vector') AS vector_count FROM x GROUP BY 1, 2),
sc AS (SELECT *, round(ink, 9) AS i9, round(img, 9) AS g9, round(greatest(0, 1 - ink - img), 9) AS w9 FROM st),
pg AS (SELECT *, round(0.35 * least(i9 / 0.02, 1) + 0.25 * (1 - least(w9 / 0.95, 1)) + 0.2 * (1 - least(g9, 1)) + 0.1 * least(font_count, 1) + 0.1 * least(vector_count / 5, 1), 6) AS score FROM sc),
lb AS (SELECT *, CASE WHEN score >= 0.6 THEN 'digital' WHEN score <= 0.4 THEN 'scanned' ELSE 'ambiguous' END AS label FROM pg)
"""
_LAY = f"""WITH {_B}, st AS (SELECT doc_id, page_number AS page_ix, count(DISTINCT round(y1 - y0, 2)) AS uf, count(*) FILTER (contains(text, '|')) AS td, round(avg(CASE WHEN source_strategy = 'vision' THEN 1.0 ELSE 0.0 END), 9) AS ir, count(*) AS gg FROM b GROUP BY 1, 2),
dx AS (SELECT doc_id, page_number AS page_ix, x0 - lag(x0) OVER (PARTITION BY doc_id, page_number ORDER BY x0) AS g, y0 - lag(y0) OVER (PARTITION BY doc_id, page_number ORDER BY y0) AS dy FROM b),
co AS (SELECT doc_id, page_ix, CAST(least(1 + count(*) FILTER (g > 0.1), 3) AS INTEGER) AS columns, round(coalesce(var_samp(dy) FILTER (dy > 0), 0) * 10000, 6) AS lv FROM dx GROUP BY 1, 2),
si AS (SELECT doc_id, page_ix, columns, least(uf / 10, 1) AS font, least(gg / 20, 1) AS grp, least(lv / 200, 1) AS lv, least(columns / 3, 1) AS col, least(td / 5, 1) AS tab, ir FROM st JOIN co USING (doc_id, page_ix))
"""
_ONE = "least(greatest({0}, 0), 1)"
_TYPE = f"CASE WHEN {_LIST.format('content')} THEN 'list' WHEN {header('content')} THEN 'header' ELSE 'text' END"
_SNIP = "array_to_string({t}[1:30], ' ') || CASE WHEN len({t}) > 30 THEN '...' ELSE '' END".replace("{t}", _TOKS.format("content"))
_FT = "regexp_replace(CAST(CAST(round(CAST(bounding_box.{0} AS DECIMAL(18,9)), 4) AS DECIMAL(9,4)) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"
_REFX = r"(?i)(?:see\s+|as\s+shown\s+in\s+)(table|figure|section)\s+([a-zA-Z0-9.\-]+)"
_RELX = r"(?i)(?:as\s+shown\s+in\s+table|table)\s+([a-zA-Z0-9.\-]+)\s+(?:shows|illustrates|demonstrates|details)"
_REFS = rf"""WITH {_U}, rf AS (SELECT ldu_id, doc_id, lower(regexp_extract(content, '{_REFX}', 1)) AS ref_type, lower(regexp_extract(content, '{_REFX}', 2)) AS ref_value FROM u WHERE regexp_matches(content, '{_REFX}')),
hit AS (SELECT rf.ldu_id, arg_min(t.ldu_id, t.ldu_ix) AS target FROM rf JOIN u t ON t.doc_id = rf.doc_id AND t.chunk_type = rf.ref_type AND contains(lower(t.content), rf.ref_type || ' ' || rf.ref_value) GROUP BY 1),
rs AS (SELECT rf.*, target, target IS NULL AS dangling FROM rf LEFT JOIN hit USING (ldu_id))
"""
_SEC = f"""WITH {_U}, un AS (SELECT *, {{sec}} AS section_id FROM u WHERE {{sec}} IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, section_id, coalesce(arg_min(content, ldu_ix) FILTER (chunk_type = 'header'), 'Unknown Section') AS title, list_min(flatten(list(page_refs))) AS page_start, list_max(flatten(list(page_refs))) AS page_end, array_to_string(list_sort(list(DISTINCT chunk_type)), ',') AS data_types, count(*) AS units, left(string_agg(content, chr(10) ORDER BY ldu_ix, ldu_id), 10000) AS content FROM un GROUP BY 1, 2)
"""
_DIST = "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)))"
_KNN = f"WITH ds AS MATERIALIZED (SELECT q.vec_id AS query_id, e.vec_id AS item_id, q.label = e.label AS same, {_DIST} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM ds), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM ds WHERE same)"
_JUNK = "(length(w) = 0 OR length(w) > 40 OR (NOT regexp_matches(w, '\\p{L}') AND NOT regexp_matches(w, '\\d')) OR (regexp_matches(w, '\\d') AND NOT regexp_matches(w, '\\p{L}') AND length(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g')) / length(w) < 0.5) OR regexp_matches(w, '" + "|".join(f"{c}{{4}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + "'))"
_TOT = f"""WITH {_B}, k AS (SELECT *, CASE WHEN contains(text, '|') THEN 'table' WHEN {header('text')} THEN 'header' ELSE 'text' END AS kind FROM b),
pgs AS (SELECT doc_id, page_number, count(*) AS b, count(*) FILTER (kind = 'table') AS t, count(*) FILTER (kind = 'header') AS h, sum(length(coalesce(text, ''))) AS c, bool_and(trim(coalesce(text, '')) = '') AS e FROM k GROUP BY 1, 2),
tt AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (NOT e) AS pages_with_content, sum(b) AS blocks, sum(t) AS tables, sum(h) AS headers, sum(c) AS chars, count(*) FILTER (e) AS empty_pages FROM pgs GROUP BY 1)
"""
_DENS = f"""WITH {_B}, pgs AS (SELECT doc_id, page_number, sum(length(coalesce(text, ''))) AS c, 1 - sum((y1 - y0) * (x1 - x0)) AS ws, count(*) FILTER (contains(text, '|')) AS v FROM b GROUP BY 1, 2),
bx AS (SELECT doc_id, avg(y1 - y0) AS hm, coalesce(stddev_samp(y1 - y0), 0) AS hs, avg(x1 - x0) AS wm, coalesce(stddev_samp(x1 - x0), 0) AS wsd FROM b GROUP BY 1),
dd AS (SELECT doc_id, sum(c) AS total_chars, count(*) AS pages, coalesce(var_samp(c), 0) AS var, avg(ws) AS ws, avg(v) AS v FROM pgs GROUP BY 1),
de AS (SELECT *, CASE WHEN ws > 0.95 AND total_chars / pages < 500 AND v < 5 THEN 'likely_scanned' WHEN v > 20 THEN 'layout_complex' ELSE 'likely_native' END AS hint FROM dd JOIN bx USING (doc_id))
"""
_TERM = "lower(regexp_replace(query, '\\?+\\s*$', ''))"
_ASK = f"""WITH {_F}, q AS (SELECT id AS query_id, document_name, 'What is the ' || fact_type || ' ' || string_split(entity, ' ')[1] || '?' AS query FROM facts_ WHERE id % 20 = 0),
t AS (SELECT query_id, document_name, lower(string_split(regexp_replace(query, '\\?+\\s*$', ''), ' ')[-1]) AS term FROM q),
h AS (SELECT term, arg_min(f.value, f.id) AS value FROM (SELECT DISTINCT term FROM t) x JOIN facts_ f ON lower(f.entity) LIKE '%' || x.term || '%' GROUP BY 1),
an AS (SELECT query_id, document_name, t.term, h.value FROM t LEFT JOIN h ON t.term = h.term)
"""


def _any(words: list[str]) -> str:
    return "CASE WHEN " + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + " THEN 'quantitative' ELSE 'conceptual' END"


def _facts(sql: str) -> str:
    return f"WITH {_F} " + sql.replace("FROM facts", "FROM facts_").replace("JOIN facts", "JOIN facts_")


# The tree of the current sections: links, then a walk down from the roots; what it does not reach is in a cycle or below one.
_TREE = f"""WITH RECURSIVE {_S}, claimed AS (SELECT doc_id, child AS section_id, min(section_id) AS claimant FROM (SELECT doc_id, section_id, unnest(child_sections) AS child FROM s) WHERE child IS NOT NULL GROUP BY 1, 2),
named AS (SELECT s.doc_id, s.section_id, s.title, coalesce(nullif(trim(s.parent_id), ''), c.claimant) AS p FROM s LEFT JOIN claimed c USING (doc_id, section_id) WHERE s.doc_id IS NOT NULL AND s.section_id IS NOT NULL),
links AS (SELECT n.doc_id, n.section_id, n.title, q.section_id AS parent_id, [format('{{:02d}}', CAST(('0x' || left(md5(n.section_id), 2)) AS INT) % 64), n.section_id] AS k FROM named n LEFT JOIN named q ON q.doc_id = n.doc_id AND q.section_id = n.p),
walk AS (SELECT doc_id, section_id, title, parent_id, k AS ks, [section_id] AS path FROM links WHERE parent_id IS NULL
  UNION ALL SELECT l.doc_id, l.section_id, l.title, l.parent_id, w.ks || l.k, w.path || [l.section_id] FROM walk w JOIN links l ON l.doc_id = w.doc_id AND l.parent_id = w.section_id),
pairs AS (SELECT doc_id, unnest(path) AS ancestor, section_id AS descendant, len(path) AS n, generate_subscripts(path, 1) AS i FROM walk),
below AS (SELECT doc_id, ancestor AS section_id, count(*) - 1 AS descendants FROM pairs GROUP BY 1, 2),
tree AS (SELECT w.*, CAST(len(path) - 1 AS INTEGER) AS depth, row_number() OVER (PARTITION BY w.doc_id ORDER BY ks) AS lft, descendants FROM walk w JOIN below USING (doc_id, section_id))
"""
# Greedy packing as a fold: chunks done, parts of the open one, their tokens.
_N = lambda x: tok(x)


def _packed(items: str, full: str, kept: str, sep: str, limit: int, head: str = "", head_n: str = "0") -> str:
    start = f"list_transform({items}, lambda x: {{'c': CAST([] AS VARCHAR[]), 'cur': [x], 'n': {_N('x')}}})"
    text = f"{head}array_to_string({{0}}.cur, {sep})"
    rest = "{'c': a.c || [" + text.format("a") + "], 'cur': " + (f"[a.cur[-1], x.cur[1]], 'n': {_N('a.cur[-1]')} + x.n" if kept == "last" else "x.cur, 'n': x.n") + "}"
    fold = f"list_reduce({start}, lambda a, x: CASE WHEN {full} AND {head_n} + a.n + x.n > {limit} THEN {rest} ELSE {{'c': a.c, 'cur': a.cur || x.cur, 'n': a.n + x.n}} END)"
    return f"list_transform([{fold}], lambda r: r.c || [{text.format('r')}])[1]"


def _parts(c: str, kind: str, limit: int) -> str:
    lines = f"string_split({_STRIP.format(c)}, chr(10))"
    head = f"array_to_string({lines}[1:2], chr(10))"
    table = f"CASE WHEN len({lines}) < 3 THEN [{c}] ELSE {_packed(lines + '[3:]', 'true', 'none', 'chr(10)', limit, head + ' || chr(10) || ', _N(head))} END"
    items = _packed(f"string_split({c}, chr(10))", _LIST.format(_STRIP.format("x.cur[1]")), "none", "chr(10)", limit)
    sentences = _packed(rf"string_split(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", "true", "last", "' '", limit)
    return f"CASE WHEN {kind} = 'table' THEN {table} WHEN {kind} = 'list' THEN {items} ELSE {sentences} END"


_CTX = "'[Context: ' || {0} || ' (Continued)]'"
_BUILT = f"""WITH RECURSIVE {_B}, kd AS (SELECT doc_id, page_number, block_id, x0, y0, x1, y1, CASE WHEN source_strategy = 'vision' THEN 'figure' WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS kind, {_STRIP.format("coalesce(text, '')")} AS content, block_ix FROM b WHERE doc_id IS NOT NULL),
ct AS (SELECT * EXCLUDE (content), CASE WHEN kind = 'figure' AND content = '' THEN '[Figure Content]' ELSE content END AS content FROM kd),
ty AS (SELECT *, CASE WHEN kind <> 'text' THEN kind {_TYPE[5:]} AS chunk_type, kind = 'text' AND {header('content')} AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, CASE kind WHEN 'figure' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, block_ix, block_id) AS pos FROM ct WHERE content <> ''),
li AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, {tok('content')} AS n, left(string_split(content, chr(10))[1], 50) AS f FROM ty WHERE chunk_type = 'list'),
st AS (SELECT doc_id, block_id, k, CAST(NULL AS VARCHAR) AS carried, CASE WHEN n > {{limit}} THEN f END AS own FROM li WHERE k = 1
  UNION ALL SELECT li.doc_id, li.block_id, li.k, st.own, CASE WHEN li.n + coalesce({tok(_CTX.format('st.own'))}, 0) > {{limit}} THEN left(coalesce({_CTX.format('st.own')}, li.f), 50) END FROM st JOIN li ON li.doc_id = st.doc_id AND li.k = st.k + 1),
cc AS (SELECT ty.* EXCLUDE (content), own, coalesce({_CTX.format('carried')} || chr(10) || content, content) AS content FROM ty LEFT JOIN st USING (doc_id, block_id)),
pt AS (SELECT *, CASE WHEN chunk_type <> 'figure' AND {tok('content')} > {{limit}} THEN {{parts}} ELSE [content] END AS raw FROM cc),
fs AS (SELECT *, list_transform(raw, lambda x, i: CASE WHEN i > 1 AND own IS NOT NULL THEN {_CTX.format('own')} || chr(10) || x ELSE x END) AS ps FROM pt),
ix AS (SELECT *, coalesce(sum(len(ps)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM fs),
sc AS (SELECT *, last_value(CASE WHEN opens THEN 'section_' || CAST(first AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent_section FROM ix),
bu AS (SELECT doc_id, CAST(first + generate_subscripts(ps, 1) - 1 AS INTEGER) AS ldu_ix, block_id, chunk_type, parent_section, unnest(ps) AS content, x0, y0, x1, y1 FROM sc)
"""
_BUILT = _BUILT.replace("{limit}", str(SPLIT_TOKENS)).replace("{parts}", _parts("content", "chunk_type", SPLIT_TOKENS))
_REFS_OF = _REFS.split("rf AS", 1)[1]
_UNITS = r"percent|million|billion|thousand|units|lakh|birr|USD|kg|km"
_FACT = rf"((?:[\p{{L}}'’-]+\s+){{0,2}})(\d[\d.,]*)\s+({_UNITS})\b"


_NB = lambda x, m: f"least(greatest({x} / {m}, 0), 1)"

ORACLE = {
    "domain_score": f"WITH t AS (SELECT doc_id, lower(text) AS low, {tok('text')} AS n FROM documents), h AS (SELECT doc_id, n, {_DOMAIN} FROM t), {_rank(_NAMES, 'h', 'doc_id')} SELECT doc_id, CASE WHEN n >= 50 AND total > 0 THEN name ELSE 'general' END AS domain_hint, CASE WHEN n >= 50 AND total > 0 THEN round((best - second) / total, 6) ELSE 0.0 END AS domain_confidence FROM r",
    "language_guess": f"WITH t AS (SELECT doc_id, {_TOKS.format('lower(text)')} AS t FROM documents), h AS (SELECT doc_id, len(t) AS n, " + ", ".join(f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in ws)}))) AS {k}" for k, ws in STOPWORDS.items()) + f" FROM t), {_rank(_LANGS, 'h', 'doc_id')} SELECT doc_id, CASE WHEN n >= 20 AND total > 0 THEN name ELSE 'unknown' END AS language, CASE WHEN n >= 20 AND total > 0 THEN round(best / total, 6) ELSE 0.0 END AS language_confidence FROM r",
    "page_sample": f"WITH {_P} SELECT doc_id, CAST(unnest(CASE WHEN page_count > 5 THEN list_sort(list_distinct([0, 1, page_count // 2, page_count - 2, page_count - 1])) WHEN page_count > 0 THEN range(0, page_count) ELSE [] END) AS INTEGER) AS page_ix FROM p",
    "page_stats": _STATS + "SELECT doc_id, page_ix, round(ink, 6) AS ink_density, round(greatest(0, 1 - ink - img), 6) AS whitespace_ratio, round(img, 6) AS image_ratio, CAST(chars AS BIGINT) AS chars, font_count, vector_count FROM st",
    "origin_pages": _STATS + "SELECT doc_id, page_ix, " + r4("score", 5) + " AS page_score, label AS page_label FROM lb",
    "origin_documents": _STATS + ", g AS (SELECT doc_id, count(*) FILTER (label = 'digital') AS d, count(*) FILTER (label = 'scanned') AS s, avg(score) AS m, avg(w9) AS w, avg(i9) AS i, avg(g9) AS g FROM lb GROUP BY 1), k AS (SELECT *, CASE WHEN d > 0 AND s > 0 THEN 'mixed' WHEN s > 0 THEN 'scanned' ELSE 'digital_native' END AS origin_type FROM g) SELECT doc_id, origin_type, " + r4("CASE origin_type WHEN 'scanned' THEN 1 - m WHEN 'mixed' THEN 1 - 2 * abs(m - 0.5) ELSE m END") + " AS origin_confidence, " + ", ".join(f"{r4(c)} AS {n}" for c, n in (("w", "avg_whitespace"), ("i", "avg_ink"), ("g", "avg_image"))) + " FROM k",
    "page_warnings": _STATS + "SELECT doc_id, coalesce(string_agg(w, ';' ORDER BY w) FILTER (w IS NOT NULL), '') AS warnings FROM (SELECT doc_id, CASE WHEN chars = 0 THEN 'page ' || page_ix || ': empty' WHEN ink < 0.001 THEN 'page ' || page_ix || ': text without ink' END AS w FROM st) GROUP BY 1",
    "layout_signals": _LAY + "SELECT doc_id, page_ix, columns, round(font, 5) AS font_score, round(grp, 5) AS group_score, round(lv, 9) AS line_var_score, round(col, 5) AS column_score, round(tab, 5) AS table_score, round(font * 0.2 + grp * 0.2 + lv * 0.2 + col * 0.2 + tab * 0.2, 4) AS layout_score FROM si",
    "layout_documents": _LAY + """, a AS (SELECT doc_id, avg(font) AS font, avg(grp) AS grp, avg(lv) AS lv, round(avg(col), 9) AS col, avg(tab) AS tab, round(avg(tab) + avg(grp), 9) AS tg, round(avg(ir), 9) AS fig FROM si GROUP BY 1),
c AS (SELECT *, greatest(0, 1 - greatest(tg, fig, col)) AS sg, (round(font, 9) > 0.3)::INT + (round(grp, 9) > 0.3)::INT + (round(lv, 9) > 0.3)::INT + (round(col, 9) > 0.3)::INT + (round(tab, 9) > 0.3)::INT AS active FROM a),
o AS (SELECT *, CASE WHEN tg >= fig AND tg >= col AND tg >= sg THEN 'table_heavy' WHEN fig >= col AND fig >= sg THEN 'figure_heavy' WHEN col >= sg THEN 'multi_column' ELSE 'single_column' END AS top, list_reverse_sort([tg, fig, col]) AS st FROM c),
m AS (SELECT *, CASE WHEN top = 'single_column' THEN sg - st[1] ELSE st[1] - st[2] END AS conf FROM o)
SELECT doc_id, CASE WHEN active >= 3 AND conf < 0.15 THEN 'mixed' ELSE top END AS layout_type, """ + r4("least(greatest(conf, 0), 1)") + """ AS layout_confidence FROM m""",
    "profile_counts": f"WITH {_P} SELECT origin_type, layout_type, d.doc_id IS NOT NULL AS extracted, count(*) AS documents, CAST(sum(page_count) AS BIGINT) AS pages FROM p LEFT JOIN (SELECT DISTINCT doc_id FROM text_blocks) d ON p.doc_id = d.doc_id GROUP BY 1, 2, 3",
    "normalize_boxes": f"WITH {_B}, n AS (SELECT block_id, block_ix % 17 <> 0 AS ok, {_NB('x1 * 650', 612)} AS a, {_NB('x0 * 650', 612)} AS c, {_NB('y0 * 800', 792)} AS p, {_NB('y1 * 800', 792)} AS q, block_ix % 2 = 0 AS flip FROM b), f AS (SELECT block_id, ok, a, c, CASE WHEN flip THEN 1 - p ELSE p END AS p, CASE WHEN flip THEN 1 - q ELSE q END AS q FROM n) SELECT block_id, CASE WHEN ok THEN round(least(a, c), 6) ELSE 0 END AS x0, CASE WHEN ok THEN round(least(p, q), 6) ELSE 0 END AS y0, CASE WHEN ok THEN round(greatest(a, c), 6) ELSE 0 END AS x1, CASE WHEN ok THEN round(greatest(p, q), 6) ELSE 0 END AS y1 FROM f",
    "invalid_boxes": f"WITH {_B} SELECT block_id FROM b WHERE NOT coalesce(x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AND x0 < x1 AND y0 < y1, false)",
    "reading_order": f"WITH {_B}, m AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_number ORDER BY x0, y0, block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b), c AS (SELECT * EXCLUDE (column_id, reading_order), CAST(sum(CASE WHEN x0 - seen > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY x0, y0, block_ix ROWS UNBOUNDED PRECEDING) AS INTEGER) AS column_id FROM m) SELECT block_id, column_id, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY column_id, y0, x0, block_ix) AS INTEGER) AS reading_order FROM c",
    "block_types": f"WITH {_U} SELECT ldu_id, {_TYPE} AS block_type, CAST({tok('content')} AS INTEGER) AS tokens, {_SNIP} AS snippet FROM u",
    "junk_words": f"WITH w AS (SELECT doc_id, unnest({_TOKS.format('text')}) AS w FROM documents) SELECT doc_id, count(*) AS words, count(*) FILTER ({_JUNK}) AS junk FROM w GROUP BY 1",
    "section_assign": f"WITH {_U} SELECT ldu_id, last_value(CASE WHEN {header('content')} THEN 'section_' || ldu_ix END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ldu_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_section FROM u",
    "list_context": f"WITH {_U} SELECT ldu_id, lag(CASE WHEN {tok('content')} > 30 THEN left(string_split(content, chr(10))[1], 50) END) OVER (PARTITION BY doc_id ORDER BY ldu_ix) AS carried FROM u WHERE chunk_type = 'list'",
    "ldu_hashes": f"WITH {_U}, h AS (SELECT ldu_id, sha256({_STRIP.format('content')} || '|bbox:[' || {_FT.format('x0')} || ', ' || {_FT.format('y0')} || ', ' || {_FT.format('x1')} || ', ' || {_FT.format('y1')} || ']|type:' || chunk_type) AS hash FROM u WHERE bounding_box.x0 IS NOT NULL) SELECT ldu_id, hash, row_number() OVER (PARTITION BY hash ORDER BY ldu_id) = 1 AS first FROM h",
    "references": _REFS + "SELECT ldu_id, ref_type, ref_value, target, dangling FROM rs",
    "table_relations": rf"WITH {_U} SELECT ldu_id, 'table_' || lower(regexp_extract(content, '{_RELX}', 1)) AS related_table_id FROM u WHERE regexp_matches(content, '{_RELX}')",
    "dangling_counts": _REFS + "SELECT doc_id, count(*) AS dangling FROM rs WHERE dangling GROUP BY 1",
    "violations": f"""WITH {_U}, r AS (SELECT ldu_id, unnest([
CASE WHEN NOT coalesce(bounding_box.x0 >= 0 AND bounding_box.y0 >= 0 AND bounding_box.x1 <= 1 AND bounding_box.y1 <= 1 AND bounding_box.x0 <= bounding_box.x1 AND bounding_box.y0 <= bounding_box.y1, false) OR page_refs IS NULL OR len(page_refs) = 0 THEN 'V1' END,
CASE WHEN token_count IS DISTINCT FROM {tok('content')} THEN 'V2' END,
CASE WHEN chunk_type = 'figure' AND metadata.image_bbox IS NULL THEN 'V3' END,
CASE WHEN chunk_type = 'table' AND {_STRIP.format('content')} <> '' AND NOT contains(content, '|') THEN 'V4' END,
CASE WHEN chunk_type = 'list' AND NOT regexp_matches({_STRIP.format('content')}, '^(\\d+\\.|-|\\*|\\[Context:)') THEN 'V5' END,
CASE WHEN contains(content, '(Continued)]') AND NOT contains(content, '[Context:') THEN 'V6' END]) AS rule FROM u) SELECT ldu_id, rule FROM r WHERE rule IS NOT NULL""",
    "section_index": _SEC.format(sec="nullif(parent_section, '')") + ", par AS (SELECT *, CASE WHEN contains(section_id, '.') THEN 'section_' || regexp_extract(regexp_extract(section_id, '([^_]*)$', 1), '^(.*)\\.[^.]*$', 1) END AS named FROM g) SELECT a.doc_id, a.section_id, b.section_id AS parent_id, a.title, a.page_start, a.page_end, a.data_types, a.units, md5(a.content) AS content_md5, 'Summary unavailable.' AS summary FROM par a LEFT JOIN g b ON a.doc_id = b.doc_id AND a.named = b.section_id",
    "section_index_global": _SEC.format(sec="coalesce(nullif(parent_section, ''), 'global')") + f", {_S} SELECT g.doc_id, g.section_id, g.units, md5(coalesce(s.summary, 'Summary unavailable.')) AS summary_md5 FROM g LEFT JOIN s ON g.doc_id = s.doc_id AND g.section_id = s.section_id",
    "section_navigate": f"WITH {_S}, q AS (SELECT ['annual', 'budget', 'of', 'the', 'digital', 'archive'] AS q), sc AS (SELECT doc_id, section_id, 2.0 * len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(title, '')), '\\s+')), q)) + len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(summary, '')), '\\s+')), q)) + 1.5 * len(list_intersect(list_distinct(list_transform(coalesce(key_entities, []), lambda x: lower(x))), q)) AS score FROM s, q) SELECT doc_id, section_id, CAST(score AS DOUBLE) AS score FROM sc ORDER BY score DESC, doc_id, section_id LIMIT 5",
    "section_search": f"WITH {_S} SELECT doc_id, section_id FROM s WHERE list_contains(list_transform(coalesce(key_entities, []), lambda x: lower(x)), 'tables') OR list_contains(list_transform(coalesce(data_types_present, []), lambda x: lower(x)), 'tables')",
    "section_texts": f"WITH {_S} SELECT doc_id, section_id, md5('Section: ' || coalesce(title, '') || chr(10) || 'Summary: ' || coalesce(summary, '')) AS text_md5 FROM s WHERE parent_id IS NULL",
    "knn_global": _KNN + " SELECT query_id, item_id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM a WHERE rank <= 5",
    "knn_sections": _KNN + " SELECT query_id, item_id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 3",
    "hybrid_retrieve": _KNN + ", m AS (SELECT query_id, item_id, distance, 0 AS src FROM s WHERE rank <= 3 UNION ALL SELECT query_id, item_id, distance, 1 FROM a WHERE rank <= 3) SELECT query_id, item_id, round(min(distance), 5) AS distance, CASE WHEN min(src) = 0 THEN 'section' ELSE 'global' END AS source FROM m GROUP BY 1, 2",
    "recall_at_k": _KNN + " SELECT s.query_id, round(count(a.item_id) / count(*), 6) AS recall FROM s LEFT JOIN a ON a.query_id = s.query_id AND a.item_id = s.item_id AND a.rank <= 10 WHERE s.rank <= 10 GROUP BY 1",
    "facts_rollup": _facts("SELECT fact_type, unit, count(*) AS n, count(DISTINCT entity) AS entities, CAST(sum(CAST(value_num AS DECIMAL(28,8))) AS DOUBLE) AS total FROM facts WHERE unit IS NOT NULL GROUP BY fact_type, unit HAVING count(*) > 3"),
    "facts_cube": _facts("SELECT fact_type, unit, count(*) AS n FROM facts GROUP BY GROUPING SETS ((fact_type), (unit), ())"),
    "facts_window": _facts("SELECT id, entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY id) AS INTEGER) AS nth, lag(id) OVER (PARTITION BY entity ORDER BY id) AS before, count(*) OVER (PARTITION BY entity ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM facts"),
    "facts_setops": _facts("SELECT entity FROM facts WHERE fact_type = 'metric' INTERSECT SELECT entity FROM facts WHERE fact_type = 'derived' EXCEPT SELECT entity FROM facts WHERE time_period IS NULL"),
    "facts_union": _facts("SELECT entity, 'u' AS src FROM facts WHERE unit = 'kg' UNION SELECT entity, 'n' AS src FROM facts WHERE unit IS NULL"),
    "facts_selfjoin": _facts("SELECT a.id AS id_a, b.id AS id_b FROM facts a JOIN facts b ON a.entity = b.entity AND a.time_period = b.time_period AND a.id < b.id WHERE a.unit = b.unit"),
    "facts_page": _facts("SELECT id, entity FROM facts ORDER BY entity, id LIMIT 20 OFFSET 10"),
    "facts_like": _facts("SELECT id FROM facts WHERE lower(entity) LIKE '%loan%' AND value_num BETWEEN 1 AND 500"),
    "facts_semi_anti": f"WITH {_F} SELECT id, CASE WHEN source_hash IN (SELECT content_hash FROM ldus WHERE content_hash IS NOT NULL) THEN 'found' ELSE 'dangling' END AS source FROM facts_",
    "facts_values": f"WITH {_F} SELECT id, value_num FROM facts_",
    "facts_lookup": _ASK + "SELECT query_id, term, value FROM an",
    "answers_cited": _ASK + "SELECT query_id, CASE WHEN value IS NOT NULL THEN 'SQL Result: ' || value || chr(10) || chr(10) || 'Sources:' || chr(10) || '[1] ' || coalesce(document_name, 'Unknown') || ' (p.0)' ELSE '" + REFUSAL.replace("'", "''") + "' END AS final_answer FROM an",
    "page_confidence": f"WITH {_B}, pg AS (SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY block_ix, block_id) AS text, round(avg(CASE WHEN source_strategy = 'vision' THEN 1.0 ELSE 0.0 END), 6) AS ir, count(DISTINCT round(y1 - y0, 2)) AS fc FROM b GROUP BY 1, 2), t AS (SELECT *, length(text) AS chars, {_TOKS.format('text')} AS ws FROM pg), j AS (SELECT *, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: {_JUNK})) / len(ws) ELSE 1.0 END AS junk FROM t), s AS (SELECT *, CASE WHEN chars < 100 THEN 0.1 ELSE 1.0 END AS s1 FROM j), s2 AS (SELECT *, CASE WHEN ir > 0.5 AND chars < 50 THEN 0 WHEN ir > 0.5 THEN s1 * 0.5 ELSE s1 END * CASE WHEN fc = 0 AND chars > 0 THEN 0.5 ELSE 1 END * CASE WHEN chars / 484704.0 < 0.0005 AND chars > 0 THEN 0.8 ELSE 1 END AS st FROM s) SELECT doc_id, page_number, round(round(least(st, CASE WHEN junk > 0.3 THEN 0 ELSE 1 - junk END), 6), 5) AS confidence FROM s2",
    "document_confidence": f"WITH {_B}, pg AS (SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY block_ix, block_id) AS text, round(avg(CASE WHEN source_strategy = 'vision' THEN 1.0 ELSE 0.0 END), 6) AS ir, count(DISTINCT round(y1 - y0, 2)) AS fc FROM b GROUP BY 1, 2), t AS (SELECT *, length(text) AS chars, {_TOKS.format('text')} AS ws FROM pg), j AS (SELECT *, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: {_JUNK})) / len(ws) ELSE 1.0 END AS junk FROM t), s AS (SELECT *, CASE WHEN chars < 100 THEN 0.1 ELSE 1.0 END AS s1 FROM j), s2 AS (SELECT *, CASE WHEN ir > 0.5 AND chars < 50 THEN 0 WHEN ir > 0.5 THEN s1 * 0.5 ELSE s1 END * CASE WHEN fc = 0 AND chars > 0 THEN 0.5 ELSE 1 END * CASE WHEN chars / 484704.0 < 0.0005 AND chars > 0 THEN 0.8 ELSE 1 END AS st FROM s) SELECT doc_id, round(min(round(least(st, CASE WHEN junk > 0.3 THEN 0 ELSE 1 - junk END), 6)), 5) AS confidence, bool_and(round(least(st, CASE WHEN junk > 0.3 THEN 0 ELSE 1 - junk END), 6) > 0) AS all_healthy FROM s2 GROUP BY 1",
    "extraction_totals": _TOT + "SELECT doc_id, pages, pages_with_content, CAST(blocks AS BIGINT) AS blocks, CAST(tables AS BIGINT) AS tables, CAST(headers AS BIGINT) AS headers, CAST(chars AS BIGINT) AS chars, round(CASE WHEN blocks = tables AND tables > 0 THEN 0.8 ELSE least(greatest(least(1, 0.5 + blocks / (pages * 50) * 0.4) + CASE WHEN headers / blocks > 0.5 THEN 0.1 ELSE -0.1 END, 0), 1) END, 5) AS layout_confidence, round(least(greatest(0.4 * pages_with_content / pages + 0.3 * CASE WHEN tables > 0 THEN least(1, 0.8 + 0.02 * tables) ELSE 0.5 END + 0.2 * least(1, blocks / (10 * pages)) + 0.092, 0.1), 1), 5) AS ocr_confidence, round(0.5 + CASE WHEN blocks / pages > 2 THEN 0.2 ELSE 0 END + CASE WHEN chars / pages > 100 THEN 0.2 ELSE 0 END, 5) AS vision_confidence FROM tt",
    "extraction_health": _TOT + f", {_P} SELECT doc_id, round(pages / greatest(1, coalesce(page_count, 0)), 6) AS completeness, round(1 - empty_pages / pages, 6) AS content_health, round(least(greatest(pages / greatest(1, coalesce(page_count, 0)) * (1 - empty_pages / pages), 0), 1), 6) AS score, CASE WHEN pages / greatest(1, coalesce(page_count, 0)) < 0.5 OR 1 - empty_pages / pages < 0.5 THEN 'LOW' ELSE 'HEALTHY' END AS flag FROM tt JOIN p USING (doc_id)",
    "ledger_attempts": "SELECT user_id AS file_hash, event_type AS strategy, count(*) AS attempts FROM events GROUP BY 1, 2",
    "ledger_prefix": "WITH r AS (SELECT event_id, user_id, sum(CAST(round(value, 2) AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events), k AS (SELECT *, min(CASE WHEN running <= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ok FROM r) SELECT event_id, user_id FROM k WHERE ok = 1",
    "ledger_missing": "SELECT event_id, array_to_string(list_filter(['k', 'status'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing FROM events WHERE NOT (list_contains(json_keys(props), 'k') AND list_contains(json_keys(props), 'status'))",
    "ledger_stream": "SELECT date_trunc('day', ts) AS start, event_type AS strategy, count(*) AS attempts, round(sum(value), 4) AS confidence FROM events GROUP BY 1, 2",
    "query_classify": f"WITH {_U} SELECT ldu_id, {_any(QUANTITATIVE)} AS engine, {_any(QUANTITATIVE_CLI)} AS cli FROM u",
    "provenance_links": f"WITH {_U} SELECT ldu_id, coalesce(metadata.document_name, 'Unknown') AS document_name, coalesce(page_refs[1], 1) AS page_number, content_hash, {_SNIP} AS text_snippet FROM u",
    "p6_found": _TREE + "SELECT doc_id, section_id FROM links ANTI JOIN walk USING (doc_id, section_id)",
    "p6_hierarchy": _TREE + "SELECT l.doc_id, l.section_id, l.parent_id, path[1] AS root, depth, lft, lft + descendants AS rgt, descendants, array_to_string(path, '/') AS path, t.section_id IS NULL AS in_cycle FROM links l LEFT JOIN tree t ON t.doc_id = l.doc_id AND t.section_id = l.section_id",
    "p6_descendants": _TREE + "SELECT doc_id, ancestor, descendant, CAST(n - i AS INTEGER) AS distance FROM pairs WHERE i < n",
    "p6_units": _TREE + ", u AS (SELECT * FROM ldus QUALIFY row_number() OVER (PARTITION BY ldu_id ORDER BY ingested_at DESC) = 1), o AS (SELECT doc_id, parent_section AS section_id, count(*) AS own FROM u WHERE parent_section IS NOT NULL GROUP BY 1, 2), h AS (SELECT l.doc_id, l.section_id, coalesce(own, 0) AS own FROM links l LEFT JOIN o USING (doc_id, section_id)), t AS (SELECT p.doc_id, p.ancestor AS section_id, CAST(sum(own) AS BIGINT) AS with_below FROM pairs p JOIN h ON h.doc_id = p.doc_id AND h.section_id = p.descendant GROUP BY 1, 2) SELECT h.doc_id, h.section_id, own, with_below FROM h LEFT JOIN t USING (doc_id, section_id)",
    "section_json": _TREE + ", g AS (SELECT *, lag(depth) OVER (PARTITION BY doc_id ORDER BY lft) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY lft DESC) = 1 AS ends FROM tree) SELECT doc_id, '[' || string_agg(CASE WHEN last IS NULL OR depth > last THEN '' ELSE repeat(']}', last - depth + 1) || ',' END || regexp_replace(json_object('section_id', section_id, 'title', title)::VARCHAR, '\\}$', ',\"child_sections\":[') || CASE WHEN ends THEN repeat(']}', depth + 1) ELSE '' END, '' ORDER BY lft) || ']' AS json FROM g GROUP BY 1",
    "chunks": f"WITH {_U}, k AS (SELECT ldu_id, chunk_type, CASE WHEN {tok('content')} > {SPLIT_TOKENS} THEN {_parts('content', 'chunk_type', SPLIT_TOKENS)} ELSE [content] END AS ps FROM u WHERE content IS NOT NULL), x AS (SELECT ldu_id, chunk_type, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS sub_ix, unnest(ps) AS content FROM k) SELECT *, CAST({tok('content')} AS INTEGER) AS token_count FROM x",
    "units_built": _BUILT + f"SELECT doc_id, ldu_ix, block_id, chunk_type, parent_section, CAST({tok('content')} AS INTEGER) AS token_count, md5(content) AS content_md5, sha256({_STRIP.format('content')} || '|bbox:[' || " + " || ', ' || ".join(_FT.format(c).replace("bounding_box.", "") for c in ("x0", "y0", "x1", "y1")) + " || ']|type:' || chunk_type) AS content_hash FROM bu",
    "units_references": _BUILT + ", u AS (SELECT *, doc_id || ':' || ldu_ix AS ldu_id FROM bu), rf AS" + _REFS_OF + "SELECT ldu_id, ref_type, ref_value, target, dangling FROM rs",
    "table_relations_built": rf"WITH {_U}, t AS (SELECT ldu_id, CASE WHEN ldu_ix % 3 = 0 THEN 'As shown in Table ' ELSE 'Table ' END || ldu_ix || CASE WHEN ldu_ix % 2 = 0 THEN ' illustrates ' ELSE ' and ' END || left(content, 20) AS content FROM u) SELECT ldu_id, 'table_' || lower(regexp_extract(content, '{_RELX}', 1)) AS related_table_id FROM t WHERE regexp_matches(content, '{_RELX}')",
    "invalid_scaled_boxes": f"WITH {_B}, v AS (SELECT block_id, x0 * 1.2 - 0.05 AS x0, y0 * 1.2 AS y0, CASE WHEN block_ix % 7 = 0 THEN x0 ELSE x1 * 1.2 END AS x1, y1 * 1.2 AS y1 FROM b) SELECT block_id, " + ", ".join(f"round(greatest(0, least(1, {c})), 6) AS {c}" for c in ("x0", "y0", "x1", "y1")) + " FROM v WHERE NOT coalesce(x0 >= 0 AND y0 >= 0 AND x1 <= 1 AND y1 <= 1 AND x0 < x1 AND y0 < y1, false)",
    "facts_extracted": f"WITH {_U}, h AS (SELECT ldu_id, unnest(regexp_extract_all(content, '{_FACT.replace(chr(39), chr(39) * 2)}', 0)) AS m FROM u) SELECT ldu_id, trim(regexp_replace(regexp_extract(m, '{_FACT.replace(chr(39), chr(39) * 2)}', 1), '\\s+', ' ', 'g')) AS entity, regexp_extract(m, '{_FACT.replace(chr(39), chr(39) * 2)}', 2) AS value, regexp_extract(m, '{_FACT.replace(chr(39), chr(39) * 2)}', 3) AS unit FROM h",
    "profile_flags": "SELECT doc_id, bool_or(coalesce(is_encrypted, true)) AS encrypted, bool_or(coalesce(contains(origin_type, 'form'), false)) AS form FROM profiles WHERE doc_id IS NOT NULL GROUP BY 1",
    "section_summaries": _SEC.format(sec="nullif(parent_section, '')") + r"SELECT doc_id, section_id, md5(array_to_string(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:2], ' ')) AS summary_md5 FROM g",
    "facts_ingested": f"WITH {_F}, m AS (SELECT max(id) AS top FROM facts_), n AS (SELECT fact_type, count(*) AS n FROM facts_ GROUP BY 1) SELECT fact_type, CASE WHEN fact_type = 'metric' THEN 2 ELSE 1 END * n AS facts, CASE WHEN fact_type = 'metric' THEN 2 ELSE 1 END * n AS ids, CASE WHEN fact_type = 'metric' THEN top + n ELSE (SELECT max(id) FROM facts_ f WHERE f.fact_type IS NOT DISTINCT FROM n.fact_type) END AS last FROM n, m",
    "vector_metadata": f"WITH {_U} SELECT ldu_id, concat_ws(';', 'chunk_type=' || chunk_type, 'content_hash=' || content_hash, 'parent_section=' || parent_section) AS metadata FROM u",
    "audit_units": rf"WITH {_U}, c AS (SELECT *, string_split(regexp_replace(ltrim(content), '([.!?])\s+([\"“«(]*[\p{{Lu}}\p{{Lo}}])', '\1' || chr(1) || '\2'), chr(1))[1] AS claim FROM u), g AS (SELECT c.ldu_id AS claim_id, c.claim, string_agg(lower(o.content), ' ' ORDER BY lower(o.content)) AS t, count(DISTINCT o.content_hash) AS h FROM c LEFT JOIN u o ON o.doc_id = c.doc_id AND o.ldu_id <> c.ldu_id GROUP BY 1, 2) SELECT claim_id, CASE WHEN contains(t, lower(claim)) THEN 'Verified' ELSE 'Not Found / Unverifiable' END AS status, CAST(CASE WHEN contains(t, lower(claim)) THEN h ELSE 0 END AS INTEGER) AS hashes FROM g".replace('\"', '"'),
    "semantic_search": rf"""WITH {_U}, w AS (SELECT ldu_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '\s+'), lambda x: x <> '')) AS t FROM u),
n AS (SELECT ldu_id, CAST(('0x' || left(md5(t), 8)) AS BIGINT) % 64 AS b, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT ldu_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1),
v AS (SELECT ldu_id, b, CAST(CAST(n / norm AS FLOAT) AS DOUBLE) AS x FROM n JOIN l USING (ldu_id)), e AS (SELECT u.ldu_id, coalesce(sum(x * x), 0) AS sq FROM u LEFT JOIN v USING (ldu_id) GROUP BY 1),
dt AS (SELECT q.ldu_id AS q, i.ldu_id AS i, sum(q.x * i.x) AS p FROM v q JOIN v i ON q.b = i.b WHERE q.ldu_id % 20 = 0 GROUP BY 1, 2),
ds AS (SELECT q.ldu_id AS query_id, i.ldu_id AS item_id, round(greatest(q.sq + i.sq - 2 * coalesce(p, 0), 0), 9) AS distance FROM e q CROSS JOIN e i LEFT JOIN dt ON dt.q = q.ldu_id AND dt.i = i.ldu_id WHERE q.ldu_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank FROM ds) SELECT query_id, item_id, round(distance, 5) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""",
    "audit_claims": rf"WITH {_U}, c AS (SELECT *, string_split(regexp_replace(ltrim(content), '([.!?])\s+([\"“«(]*[\p{{Lu}}\p{{Lo}}])', '\1' || chr(1) || '\2'), chr(1))[1] AS claim FROM u), g AS (SELECT c.ldu_id AS claim_id, c.claim, string_agg(lower(o.content), ' ' ORDER BY lower(o.content)) AS t, count(DISTINCT o.content_hash) AS h FROM c LEFT JOIN u o ON o.doc_id = c.doc_id AND o.ldu_ix IN (c.ldu_ix - 1, c.ldu_ix + 1) GROUP BY 1, 2) SELECT claim_id, CASE WHEN contains(t, lower(upper(claim))) THEN 'Verified' ELSE 'Not Found / Unverifiable' END AS status, CAST(CASE WHEN contains(t, lower(upper(claim))) THEN h ELSE 0 END AS INTEGER) AS hashes FROM g".replace('\"', '"'),
    "density_report": _DENS + "SELECT doc_id, CAST(total_chars AS BIGINT) AS total_chars, pages, " + ", ".join(f"{r4(c)} AS {n}" for c, n in (("hm", "bbox_height_mean"), ("hs", "bbox_height_std"), ("wm", "bbox_width_mean"), ("wsd", "bbox_width_std"), ("ws", "avg_whitespace"), ("v", "avg_vectors"))) + ", round(var, 2) AS page_char_variance, hint FROM de",
    "markdown_report": "WITH l AS (SELECT doc_id, length(coalesce(text, '')) AS chars, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), m AS (SELECT *, list_transform(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS s FROM l), f AS (SELECT *, list_filter(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS ful FROM m), c AS (SELECT doc_id, chars, CAST(len(list_filter(s, lambda x: starts_with(x, '#'))) AS INTEGER) AS num_headings, CAST(len(list_filter(s, lambda x: starts_with(x, '- ') OR starts_with(x, '* '))) AS INTEGER) AS num_list_markers, CASE WHEN len(ful) > 0 THEN round(list_sum(list_transform(ful, lambda x: length(x))) / len(ful), 4) ELSE 0 END AS avg_line_length, round((len(l) - len(ful)) / len(l), 6) AS empty_line_ratio FROM f) SELECT doc_id, CAST(chars AS INTEGER) AS chars, num_headings, num_list_markers, avg_line_length, empty_line_ratio, array_to_string(list_filter([CASE WHEN chars = 0 THEN 'empty_output' WHEN chars < 500 THEN 'extremely_short_markdown' END, CASE WHEN num_headings = 0 AND chars > 1000 THEN 'layout_flattening' END], lambda x: x IS NOT NULL), ',') AS failure_modes FROM c",
    "compare_report": _DENS + f", {_U}, uu AS (SELECT doc_id, sum(length(content)) AS b FROM u GROUP BY 1) SELECT doc_id, CAST(b - total_chars AS BIGINT) AS difference, round(CASE WHEN total_chars > 0 THEN b / total_chars ELSE 0 END, 2) AS ratio, array_to_string(list_filter([CASE WHEN b / total_chars < 0.5 AND total_chars > 1000 THEN 'severe_text_loss' WHEN b / total_chars > 1.5 AND total_chars > 1000 THEN 'potential_hallucination_or_over_segmentation' END, CASE WHEN hint = 'likely_scanned' AND b / total_chars < 0.2 THEN 'scanned_pdf_failure' END], lambda x: x IS NOT NULL), ',') AS issues FROM de JOIN uu USING (doc_id)",
    "table_headers": f"WITH {_U}, l AS (SELECT ldu_id, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS l FROM u WHERE chunk_type = 'table') SELECT ldu_id, CAST(greatest(len(l) - 2, 0) AS INTEGER) AS rows, CASE WHEN len(list_filter(l, lambda x: regexp_matches(x, '^[|\\-: ]+$') AND contains(x, '-'))) > 0 THEN round(1 / (greatest(len(l) - 2, 0) + 1), 6) ELSE 0 END AS header_ratio FROM l",
    "page_overlay": f"WITH {_U}, {_B} SELECT u.ldu_id, u.doc_id, u.page_refs[1] AS page_number, round(bounding_box.x0 * 612.0, 4) AS px0, round(bounding_box.y0 * 792.0, 4) AS py0, round(bounding_box.x1 * 612.0, 4) AS px1, round(bounding_box.y1 * 792.0, 4) AS py1, CASE chunk_type WHEN 'header' THEN 'red' WHEN 'text' THEN 'blue' WHEN 'table' THEN 'green' WHEN 'figure' THEN 'orange' WHEN 'list' THEN 'purple' ELSE 'grey' END AS colour FROM u JOIN (SELECT DISTINCT doc_id, page_number FROM b) g ON g.doc_id = u.doc_id AND g.page_number = u.page_refs[1]",
    "page_units": f"WITH {_U}, n AS (SELECT ldu_id, page_refs[1] AS first_page, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ldu_ix, ldu_id) - 1 AS k FROM u) SELECT ldu_id, first_page, CAST(CASE WHEN n < 3 THEN 2 ELSE least(k // (n // 3), 2) END AS INTEGER) AS third, k = n // 10 OR k = n // 2 OR k = n - 1 - n // 10 AS picked FROM n",
    "vector_upsert": f"WITH {_U}, i AS (SELECT content_hash AS id, min(ldu_id) AS ldu_id FROM u WHERE content_hash IS NOT NULL GROUP BY 1) SELECT id, CASE WHEN ldu_id % 3 = 0 THEN -ldu_id ELSE ldu_id END AS ldu_id FROM i",
}
