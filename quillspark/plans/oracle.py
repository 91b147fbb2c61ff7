"""The same queries in SQL, written from their definitions."""

from __future__ import annotations

import re as _re

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_REF = r"(\d+[a-zA-Z]?)\s*§|§\s*(\d+[a-zA-Z]?)"
_PAIR = r"(\d+[a-zA-Z]?)\s+ja\s+(\d+[a-zA-Z]?)\s*§"


def _numbers(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '{_REF}'), lambda m: regexp_extract(m, '(\d+[a-zA-Z]?)', 1))"


CTE: dict[str, str] = {}
CTE["d"] = """
SELECT doc_id, text, lang, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'vero' ELSE 'finlex' END AS source, 'L' || (doc_id % 6) AS statute,
  CASE WHEN doc_id % 5 = 0 THEN 'Laki L' || (doc_id % 6) || ' ' || (doc_id % 23) || ' ja ' || (doc_id % 29) || ' §:n muuttamisesta' ELSE 'Ohje ' || doc_id || ' - ' || lang END AS title,
  CASE WHEN doc_id % 7 = 0 THEN 'COURT_CASE' WHEN source IN ('src0', 'src1', 'src2') THEN 'GUIDANCE' WHEN doc_id % 7 IN (1, 2) THEN 'STATUTE' ELSE 'ARTICLE' END AS type,
  CASE WHEN doc_id % 3 <> 0 THEN '20' || lpad(CAST(doc_id % 20 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' END AS date,
  CASE WHEN doc_id % 10 = 3 THEN 'Tuloverosopimukset_' ELSE 'd_' END || doc_id AS parent_id
FROM documents"""
_HEADINGS = (r"(\n\s*[A-ZÄÖÅ][A-ZÄÖÅ ]{4,})\n", r"(\n\s*\d+(?:\.\d+){0,3}\s+[A-ZÄÖÅ])", r"(\n\s*\d+\s*§\s)")
_MARKED = f"regexp_replace(text, '{_HEADINGS[0]}', chr(1) || '\\1' || chr(10), 'g')"
for _h in _HEADINGS[1:]:
    _MARKED = f"regexp_replace({_MARKED}, '{_h}', chr(1) || '\\1', 'g')"
CTE["sections"] = f"""
SELECT *, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: {_STRIP.format("x")}), lambda x: length(x) > 0) AS parts FROM d"""
CTE["pieces"] = f"""
SELECT *, CASE WHEN length(text) <= 800 THEN [text] WHEN len(flat) > 0 THEN flat ELSE [substr(text, 1, 800)] END AS pieces
FROM (SELECT *, flatten(list_transform(parts, lambda s: CASE WHEN length(s) <= 800 THEN [s]
  ELSE list_filter(list_transform(range(0, length(s), 650), lambda a: substr(s, a + 1, 800)), lambda x: length({_STRIP.format("x")}) >= 120) END)) AS flat FROM sections)"""
CTE["cut"] = """
SELECT * EXCLUDE (text, parts, flat, pieces), unnest(pieces) AS text, generate_subscripts(pieces, 1) - 1 AS chunk_index, len(pieces) AS chunk_total FROM pieces"""
CTE["marked"] = """
SELECT *, text || ' ' || ((doc_id * 13 + chunk_index * 5) % 31) || ' § ' || ((doc_id * 7 + chunk_index) % 31) || ' §' AS marks FROM cut"""
CTE["numbered"] = f"SELECT *, list_transform({_numbers('marks')}, lambda n: statute || '_§' || n) AS all_refs FROM marked"
CTE["chunks"] = f"""
SELECT substr(CASE WHEN chunk_total > 1 THEN parent_id || '#chunk' || chunk_index ELSE parent_id END, 1, 140) AS id, * EXCLUDE (marks, all_refs),
  {_distinct("all_refs")} AS refs, doc_id * 1000 + chunk_index AS chunk_ord FROM numbered"""
CTE["first_refs"] = """
SELECT parent_id, r, min((chunk_ord, i)) AS o FROM (SELECT parent_id, chunk_ord, unnest(refs) AS r, generate_subscripts(refs, 1) AS i FROM chunks) GROUP BY ALL"""
CTE["parent_refs"] = "SELECT parent_id, list(r ORDER BY o) AS refs FROM first_refs GROUP BY parent_id"
CTE["parents"] = """
SELECT c.parent_id AS id, arg_min(source, chunk_ord) AS source, arg_min(type, chunk_ord) AS type, arg_min(statute, chunk_ord) AS statute, arg_min(title, chunk_ord) AS title,
  arg_min(date, chunk_ord) FILTER (coalesce(date, '') <> '') AS date, list(c.id ORDER BY chunk_ord) AS chunk_ids, coalesce(any_value(r.refs), CAST([] AS VARCHAR[])) AS refs, min(chunk_ord) AS parent_ord
FROM chunks c LEFT JOIN parent_refs r USING (parent_id) GROUP BY c.parent_id"""
CTE["titled"] = rf"""
SELECT *, list_transform(list_concat({_numbers("title")}, regexp_extract_all(title, '{_PAIR}', 1), regexp_extract_all(title, '{_PAIR}', 2)), lambda n: statute || '_§' || n) AS title_keys FROM parents"""
CTE["psec"] = """
SELECT ref_key, row_number() OVER (PARTITION BY ref_key ORDER BY parent_ord) - 1 AS pos, id AS parent_id
FROM (SELECT DISTINCT id, parent_ord, unnest(list_concat(refs, title_keys)) AS ref_key FROM titled)"""
CTE["cites"] = """
SELECT * FROM (
  SELECT p.id AS f, t.id AS t, 'cites' AS relation, CAST(0.85 AS DOUBLE) AS confidence, p.ref_key, 0 AS phase, p.parent_ord AS p, p.i AS i, row_number() OVER (PARTITION BY p.id, p.ref_key ORDER BY s.pos) AS n
  FROM (SELECT id, parent_ord, unnest(refs) AS ref_key, generate_subscripts(refs, 1) - 1 AS i FROM parents) p JOIN psec s USING (ref_key) JOIN parents t ON t.id = s.parent_id
  WHERE t.id <> p.id AND t.source = 'finlex') WHERE n <= 3"""
CTE["amend_keys"] = r"""
SELECT id, parent_ord, ref_key, row_number() OVER (PARTITION BY id ORDER BY CAST(regexp_extract(ref_key, '§(\d+)', 1) AS BIGINT), ref_key) - 1 AS i
FROM (SELECT DISTINCT id, parent_ord, unnest(title_keys) AS ref_key FROM titled WHERE source = 'finlex' AND regexp_matches(title, '(?i)muuttamisesta'))"""
CTE["amends"] = """
SELECT * FROM (
  SELECT a.id AS f, t.id AS t, 'amends' AS relation, CAST(0.75 AS DOUBLE) AS confidence, a.ref_key, 1 AS phase, a.parent_ord AS p, a.i AS i, row_number() OVER (PARTITION BY a.id, a.ref_key ORDER BY s.pos) AS n
  FROM amend_keys a JOIN psec s USING (ref_key) JOIN parents t ON t.id = s.parent_id
  WHERE t.id <> a.id AND t.source = 'finlex' AND NOT regexp_matches(t.title, '(?i)muuttamisesta')) WHERE n <= 3"""
CTE["raw_edges"] = "SELECT *, (phase, p, i, n) AS o FROM (SELECT * FROM cites UNION ALL SELECT * FROM amends)"
CTE["edges"] = "SELECT f, t, arg_max(relation, o) AS relation, arg_max(confidence, o) AS confidence, arg_max(ref_key, o) AS ref_key, min(o) AS adj FROM raw_edges GROUP BY f, t"
CTE["numbered_edges"] = r"SELECT *, CAST(regexp_extract(f, '_(\d+)$', 1) AS BIGINT) AS x, CAST(regexp_extract(t, '_(\d+)$', 1) AS BIGINT) AS y FROM edges"
_NAMES = "['none', 'interpreted_by', 'clarified_by', 'overrides', 'references', 'cites']"
CTE["log"] = f"""
SELECT x * 100000 + y AS line, f, t, {_NAMES}[(x * 7 + y * 3) % 6 + 1] AS relation, ((x + y * 5) % 10) / 10 AS confidence FROM numbered_edges
UNION ALL SELECT x * 100000 + y + 1000000000000, f, t, {_NAMES}[(x * 3 + y * 11) % 6 + 1], ((x * 2 + y) % 10) / 10 FROM numbered_edges
UNION ALL SELECT x * 100000 + y + 2000000000000, f, 'nowhere_1', 'cites', 0.9 FROM numbered_edges WHERE x % 50 = 0"""
CTE["gone"] = "SELECT l.f, l.t, min(line) AS gone FROM log l JOIN edges e ON l.f = e.f AND l.t = e.t WHERE l.relation = 'none' AND l.confidence >= 0.7 GROUP BY ALL"
CTE["judged_log"] = """
SELECT l.*, e.f IS NULL OR coalesce(l.line > g.gone, FALSE) AS missing FROM log l LEFT JOIN edges e ON l.f = e.f AND l.t = e.t LEFT JOIN gone g ON l.f = g.f AND l.t = g.t"""
CTE["steps"] = """
SELECT f, t, line, relation, confidence, row_number() OVER (PARTITION BY f, t ORDER BY line) AS k FROM judged_log
WHERE NOT missing AND confidence >= 0.7 AND relation IN ('interpreted_by', 'clarified_by', 'overrides', 'references')"""
CTE["v2"] = """
SELECT e.f, e.t, CASE WHEN b.relation IN ('interpreted_by', 'clarified_by', 'overrides') THEN b.relation WHEN a.relation IN ('interpreted_by', 'clarified_by', 'overrides') THEN a.relation ELSE e.relation END AS relation,
  CASE WHEN b.relation = 'references' THEN least(CASE WHEN a.relation = 'references' THEN least(e.confidence, 0.6) WHEN a.relation IS NULL THEN e.confidence ELSE a.confidence END, 0.6)
       WHEN b.relation IS NOT NULL THEN b.confidence WHEN a.relation = 'references' THEN least(e.confidence, 0.6) WHEN a.relation IS NOT NULL THEN a.confidence ELSE e.confidence END AS confidence,
  a.relation IS NOT NULL AS llm_typed
FROM edges e LEFT JOIN gone g ON g.f = e.f AND g.t = e.t LEFT JOIN steps a ON a.f = e.f AND a.t = e.t AND a.k = 1 LEFT JOIN steps b ON b.f = e.f AND b.t = e.t AND b.k = 2
WHERE g.f IS NULL"""
CTE["doc_tokens"] = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zäöå0-9§]+')) AS token FROM documents"
CTE["doc_posts"] = "SELECT doc_id, token, count(*) AS tf FROM doc_tokens GROUP BY ALL"
CTE["tokens"] = "SELECT chunk_ord, unnest(regexp_extract_all(lower(title || ' ' || text), '[a-zäöå0-9§]+')) AS token FROM chunks"
CTE["posts"] = "SELECT chunk_ord, token, count(*) AS tf FROM tokens GROUP BY ALL"
CTE["lens"] = "SELECT chunk_ord, sum(tf) AS dl FROM posts GROUP BY ALL"
CTE["n_docs"] = "SELECT count(*) AS n, (SELECT sum(dl) FROM lens) / count(*) AS avgdl FROM chunks"
CTE["dfs"] = "SELECT token, count(*) AS df, ln((SELECT n FROM n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY token"
CTE["idf"] = "SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs"
CTE["qtok"] = "SELECT item_id AS qid, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zäöå0-9§]+')) AS token FROM benchmark) GROUP BY ALL"
CTE["bm25"] = """
SELECT qid, chunk_ord, round(sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n_docs)))) * qtf), 6) AS score
FROM posts JOIN idf USING (token) JOIN qtok USING (token) JOIN lens USING (chunk_ord) GROUP BY ALL"""
CTE["lexall"] = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) - 1 AS rnk FROM bm25 WHERE score > 0"
CTE["lex"] = "SELECT * FROM lexall WHERE rnk < 50"
CTE["lexwide"] = "SELECT qid, id, rnk FROM lexall JOIN chunks USING (chunk_ord) WHERE rnk < 150"
CTE["vec"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) - 1 AS rnk FROM (
  SELECT q.vec_id AS qid, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id, embeddings v) WHERE score > 0) WHERE rnk < 50"""
CTE["lexc"] = "SELECT qid, id, rnk FROM lex JOIN chunks USING (chunk_ord)"
CTE["vecc"] = "SELECT qid, id, rnk FROM vec JOIN chunks ON doc_id = vec_id AND chunk_index = 0"
CTE["fused"] = """
SELECT qid, id, rrf, row_number() OVER (PARTITION BY qid ORDER BY seen) - 1 AS fuse_ord FROM (
  SELECT qid, id, sum(1.0 / (60 + rnk)) AS rrf, min((l, rnk)) AS seen FROM (SELECT qid, id, rnk, 0 AS l FROM vecc UNION ALL SELECT qid, id, rnk, 1 AS l FROM lexc) GROUP BY qid, id)"""
CTE["hits"] = """
SELECT qid, id, rrf * CASE WHEN source = 'vero' THEN 1.15 WHEN contains(id, 'Tuloverosopimukset') THEN 1.15 ELSE 1.0 END AS score, fuse_ord, parent_id, chunk_index, refs FROM fused JOIN chunks USING (id)"""
CTE["csec"] = rf"""
SELECT ref_key, id AS chunk_id, row_number() OVER (PARTITION BY ref_key ORDER BY chunk_ord) - 1 AS pos FROM (
  SELECT DISTINCT id, chunk_ord, statute || '_§' || unnest({_numbers("title || ' ' || substr(text, 1, 1500)")}) AS ref_key FROM chunks)"""
CTE["cands"] = """
SELECT qid, id, score, (fuse_ord, 0, 0, 0) AS o, score AS own FROM hits
UNION ALL SELECT qid, chunk_id, score * 0.6, (fuse_ord, 1, CAST(i AS INT), CAST(pos AS INT)), NULL FROM (SELECT qid, score, fuse_ord, unnest(refs[1:3]) AS ref_key, generate_subscripts(refs[1:3], 1) - 1 AS i FROM hits) JOIN csec USING (ref_key) WHERE pos < 2
UNION ALL SELECT h.qid, n.id, h.score * 0.75, (h.fuse_ord, 2, CAST(n.chunk_index - h.chunk_index AS INT), 0), NULL FROM hits h JOIN chunks n ON n.parent_id = h.parent_id AND n.chunk_index <> h.chunk_index AND abs(n.chunk_index - h.chunk_index) <= 3
  WHERE contains(h.id, 'Tuloverosopimukset') AND contains(h.id, '#chunk')"""
CTE["expanded"] = "SELECT qid, id, greatest(arg_min(score, o), max(own)) AS score, min(o) AS tie FROM cands GROUP BY qid, id"
CTE["capped"] = """
SELECT * FROM (SELECT e.qid, e.id, c.parent_id, round(e.score, 9) AS score, tie,
  row_number() OVER (PARTITION BY e.qid, c.parent_id ORDER BY round(e.score, 9) DESC, tie) AS own FROM expanded e JOIN chunks c USING (id))
WHERE own <= CASE WHEN contains(id, 'Tuloverosopimukset') THEN 4 ELSE 2 END"""
CTE["wide"] = "SELECT * FROM (SELECT qid, id, parent_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tie) AS rank FROM capped) WHERE rank <= 30"
CTE["found"] = "SELECT * FROM wide WHERE rank <= 10"
CTE["entry"] = "SELECT qid, parent_id AS id, min(rank) AS ord, 0 AS hop FROM wide GROUP BY qid, parent_id"
CTE["moves"] = """
SELECT f AS id, t AS next, relation, adj, 0 AS dir FROM edges WHERE relation IN ('cites', 'amends', 'interpreted_by', 'overrides')
UNION ALL SELECT t, f, 'amends (newer)', adj, 1 FROM edges WHERE relation = 'amends'"""


def _hop(n: int, frontier: str, visited: str) -> None:
    CTE[f"first{n}"] = f"""
SELECT qid, next, arg_min((via, relation), place) AS m, min(place) AS place FROM (
  SELECT f.qid, m.next, f.id AS via, m.relation, (f.ord, m.dir, m.adj) AS place FROM {frontier} f JOIN moves m USING (id)
  WHERE NOT EXISTS (SELECT 1 FROM {visited} v WHERE v.qid = f.qid AND v.id = m.next)) GROUP BY qid, next"""
    CTE[f"open{n}"] = f"""
SELECT qid, f FROM (SELECT qid, f, coalesce(sum(c) OVER (PARTITION BY qid ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT qid, place[1] AS f, count(*) AS c FROM first{n} GROUP BY ALL)) WHERE before < 20"""
    CTE[f"hop{n}"] = f"""
SELECT a.qid, a.next AS id, {n} AS hop, row_number() OVER (PARTITION BY a.qid ORDER BY a.place) - 1 AS ord, a.m[1] AS via, a.m[2] AS relation FROM first{n} a JOIN open{n} o ON o.qid = a.qid AND o.f = a.place[1]"""


_hop(1, "entry", "entry")
CTE["front2"] = "SELECT * FROM hop1 WHERE ord < 20"
CTE["seen2"] = "SELECT qid, id FROM entry UNION ALL SELECT qid, id FROM hop1"
_hop(2, "front2", "seen2")

CTE["visited"] = "SELECT qid, id, hop, CAST(ord AS BIGINT) AS ord FROM entry UNION ALL SELECT qid, id, hop, ord FROM hop1 UNION ALL SELECT qid, id, hop, ord FROM hop2"
CTE["walked"] = """
SELECT qid, hop, ord, CASE WHEN relation = 'amends (newer)' THEN id ELSE via END AS f, CASE WHEN relation = 'amends (newer)' THEN via ELSE id END AS t, relation
FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)"""
CTE["ordered"] = """
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY hop > 0, CASE WHEN hop = 0 THEN ord END NULLS FIRST,
  CASE WHEN hop > 0 THEN CASE type WHEN 'ARTICLE' THEN 0 WHEN 'STATUTE' THEN 0 WHEN 'GUIDANCE' THEN 1 WHEN 'COURT_CASE' THEN 2 ELSE 3 END END NULLS FIRST,
  CASE WHEN hop > 0 THEN ascii(dd) END DESC NULLS FIRST, CASE WHEN hop > 0 THEN dd END NULLS FIRST, id) AS parent_ord
FROM (SELECT v.*, p.type, coalesce(p.date, '0000-00-00') AS dd FROM visited v LEFT JOIN parents p USING (id))"""
CTE["regrown"] = """
SELECT qid, parent_id, id, row_number() OVER (PARTITION BY qid ORDER BY parent_ord, nth) AS rank FROM (
  SELECT o.qid, o.parent_ord, c.parent_id, c.id, row_number() OVER (PARTITION BY o.qid, c.parent_id ORDER BY w.rank NULLS LAST, c.chunk_ord) AS nth
  FROM ordered o JOIN chunks c ON c.parent_id = o.id LEFT JOIN wide w ON w.qid = o.qid AND w.id = c.id)
WHERE nth <= CASE WHEN contains(parent_id, 'Tuloverosopimukset') THEN 4 ELSE 2 END"""
CTE["excerpt"] = """
SELECT parent_id AS id, arg_min(title, chunk_ord) AS title, string_agg(substr(text, 1, CAST(2500 - before AS INT)), chr(10) ORDER BY chunk_ord) AS excerpt
FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY parent_id ORDER BY chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks) WHERE before < 2500 GROUP BY parent_id"""

_used = {name: [n for n in CTE if n != name and _re.search(rf"\b(?:FROM|JOIN|,)\s+\(?{n}\b", sql)] for name, sql in CTE.items()}


def sql(select: str) -> str:
    """``select`` with the definitions it needs."""
    need: list[str] = []

    def add(text_of: list[str]) -> None:
        for n in text_of:
            if n not in need:
                add(_used[n])
                need.append(n)

    add([n for n in CTE if _re.search(rf"\b(?:FROM|JOIN|,)\s+\(?{n}\b", select)])
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in need) + "\n" if need else "") + select
