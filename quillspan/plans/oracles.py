"""SQL that says in another way what the queries compute; DuckDB runs it on the same tables."""

from __future__ import annotations

from quillspan.operators.headings import HEADING_LINE, NUMBERED_LINE

SEPARATORS = (("chr(10) || chr(10)", 2), ("chr(10)", 1), ("' '", 1))


def chunk_ctes(source: str) -> str:
    """CTEs that end in chunks(doc_id, chunk_index, chunk, start_byte, end_byte) over source(doc_id, text)."""
    kind = lambda first: "CASE " + " ".join(f"WHEN contains(text, {s}) THEN {i}" for i, (s, _) in enumerate(SEPARATORS) if i >= first) + " ELSE 3 END"
    out = [f"nodes0 AS (SELECT doc_id, text, 0::BIGINT AS start_byte, {kind(0)} AS lvl FROM ({source}) WHERE text <> '')"]
    nodes = ["nodes0"]
    for i, (s, g) in enumerate(SEPARATORS):
        every = " UNION ALL ".join(f"SELECT * FROM {n} WHERE lvl = {i}" for n in nodes)
        out.append(f"""cut{i} AS (SELECT doc_id, start_byte AS node, unnest(string_split(text, {s})) AS piece, generate_subscripts(string_split(text, {s}), 1) AS i FROM ({every})),
placed{i} AS (SELECT doc_id, node, i, piece, node + coalesce(sum(strlen(piece) + {g}) OVER (PARTITION BY doc_id, node ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM cut{i}),
runs{i} AS (SELECT *, sum((length(piece) >= 1000)::INT) OVER (PARTITION BY doc_id, node ORDER BY i) AS run FROM placed{i} WHERE piece <> '')""")
        if i < 2:
            out.append(f"nodes{i + 1} AS (SELECT doc_id, piece AS text, start_byte, {kind(i + 1).replace('text', 'piece')} AS lvl FROM runs{i} WHERE length(piece) >= 1000)")
            nodes.append(f"nodes{i + 1}")
    small = " UNION ALL ".join(f"SELECT doc_id, {i} AS lvl, node, run, i, piece, start_byte, {g} AS gap, {s} AS sep FROM runs{i} WHERE length(piece) < 1000" for i, (s, g) in enumerate(SEPARATORS))
    chars = " UNION ALL ".join([f"SELECT doc_id, text, start_byte FROM {n} WHERE lvl = 3" for n in nodes] + ["SELECT doc_id, piece, start_byte FROM runs2 WHERE length(piece) >= 1000"])
    out.append(f"""small AS (SELECT *, row_number() OVER w AS k, sum(length(piece) + gap) OVER w AS reach, sum(length(piece) + gap) OVER w - length(piece) - gap AS base, lead(length(piece)) OVER w AS ahead
  FROM ({small}) WINDOW w AS (PARTITION BY doc_id, lvl, node, run ORDER BY i)),
ends AS (SELECT p.doc_id, p.lvl, p.node, p.run, p.k AS a, max(q.k) AS b, arg_max(q.reach, q.k) AS b_reach, arg_max(coalesce(q.ahead, -1), q.k) AS ahead, any_value(p.gap) AS gap
  FROM small p JOIN small q ON p.doc_id = q.doc_id AND p.lvl = q.lvl AND p.node = q.node AND p.run = q.run AND q.k >= p.k AND q.k <= p.k + 1000 AND q.reach - q.gap - p.base <= 1000
  GROUP BY ALL),
nexts AS (SELECT e.doc_id, e.lvl, e.node, e.run, e.a, e.b, coalesce(min(j.k), e.b + 1) AS n
  FROM ends e LEFT JOIN small j ON e.doc_id = j.doc_id AND e.lvl = j.lvl AND e.node = j.node AND e.run = j.run AND j.k > e.a AND j.k <= e.b AND e.b_reach - e.gap - j.base <= 100 AND e.b_reach - e.gap - j.base + e.gap + e.ahead <= 1000
  WHERE e.ahead >= 0 GROUP BY e.doc_id, e.lvl, e.node, e.run, e.a, e.b),
chain AS (SELECT doc_id, lvl, node, run, 1::BIGINT AS a FROM small WHERE k = 1
  UNION ALL SELECT c.doc_id, c.lvl, c.node, c.run, n.n FROM chain c JOIN nexts n ON c.doc_id = n.doc_id AND c.lvl = n.lvl AND c.node = n.node AND c.run = n.run AND c.a = n.a),
merged AS (SELECT c.doc_id, c.lvl, c.node, c.run, c.a, left(string_agg(s.piece || s.sep, '' ORDER BY s.k), sum(length(s.piece) + s.gap)::BIGINT - max(s.gap)) AS chunk, min(s.start_byte) AS start_byte, max(s.start_byte + strlen(s.piece)) AS end_byte
  FROM chain c JOIN ends e ON c.doc_id = e.doc_id AND c.lvl = e.lvl AND c.node = e.node AND c.run = e.run AND c.a = e.a
  JOIN small s ON c.doc_id = s.doc_id AND c.lvl = s.lvl AND c.node = s.node AND c.run = s.run AND s.k BETWEEN e.a AND e.b GROUP BY ALL),
windows AS (SELECT doc_id, substr(text, s + 1, 1000) AS chunk, start_byte + strlen(substr(text, 1, s)) AS start_byte, start_byte + strlen(substr(text, 1, s + 1000)) AS end_byte
  FROM (SELECT doc_id, text, start_byte, unnest(generate_series(0, greatest(length(text) - 101, 0), 900)) AS s FROM ({chars}))),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start_byte) - 1)::INT AS chunk_index, chunk, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte
  FROM (SELECT doc_id, chunk, start_byte, end_byte FROM merged UNION ALL SELECT * FROM windows))""")
    return "WITH RECURSIVE " + ",\n".join(out)


CHAR_CHUNKS = """SELECT doc_id, (s / 900)::INT AS chunk_index, substr(text, s + 1, 1000) AS chunk, strlen(substr(text, 1, s))::BIGINT AS start_byte, strlen(substr(text, 1, s + 1000))::BIGINT AS end_byte
FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 101, 0), 900)) AS s FROM documents WHERE text <> '')"""

ACTS = """SELECT doc_id, 'CHAPTER X' || chr(10) || 'Rules of ' || source || chr(10) || chr(10) || 'Article ' || doc_id || chr(10) || 'Terms in ' || lang || chr(10) || chr(10)
 || substr(text, 1, 900) || chr(10) || chr(10) || 'Section B' || chr(10) || '1. ' || substr(text, 901) || chr(10) || 'article the last' AS text FROM documents"""

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_HEADING = f"(length({{0}}) <= 60 AND regexp_matches({{0}}, '{HEADING_LINE}'))"

HEADING_CTES = f"""act AS ({ACTS}),
cut_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM act),
lines AS (SELECT doc_id, i, {_TRIM.format('raw')} AS line, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
  lead({_TRIM.format('raw')}) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM cut_lines),
headings AS (SELECT doc_id, byte_offset, CASE WHEN below <> '' AND length(below) <= 120 AND NOT regexp_matches(below, '{NUMBERED_LINE}') AND NOT {_HEADING.format('below')} THEN line || ' — ' || below ELSE line END AS label
  FROM lines WHERE {_HEADING.format('line')})"""

PAIRS = """(SELECT conv_id, turn, text AS "user", assistant FROM (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS assistant FROM {0}) WHERE role = 'user' AND next = 'assistant')"""
RECENT = "(SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)"
HISTORY = f"""(SELECT c.conv_id, least(coalesce(p.n, 0), 3)::INT AS n_pairs, coalesce('CONVERSATION HISTORY:' || chr(10) || p.body, '') AS history FROM (SELECT DISTINCT conv_id FROM conversations) c
 LEFT JOIN (SELECT conv_id, max(n) AS n, string_agg('User: ' || substr("user", 1, 800) || chr(10) || 'Assistant: ' || substr(assistant, 1, 800), chr(10) ORDER BY turn) AS body
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {PAIRS.format(RECENT)}) WHERE back <= 3 GROUP BY conv_id) p USING (conv_id))"""

COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
HITS = f"""(SELECT query_id, vec_id, label, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank
 FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, {COSINE} AS similarity FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE similarity >= 0.3 QUALIFY rank <= 15)"""
CONTEXT = f"""(SELECT query_id, count(*) AS n_sources, string_agg('[' || d.source || '/' || d.doc_id || '.txt]' || chr(10) || d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS context
 FROM {HITS} h JOIN documents d ON d.doc_id = h.vec_id GROUP BY query_id)"""

HTML = r"""SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM (
 SELECT page_id, i, regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(substr(part, 2), '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS line, part
 FROM (SELECT page_id, unnest(string_split(marked, chr(1))) AS part, generate_subscripts(string_split(marked, chr(1)), 1) AS i FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'),
   '<(p|h[1-6]|li|td|th)(\s[^>]*)?>', chr(1) || 'T', 'g'), '</?(p|h[1-6]|li|td|th|ul|ol|div|article|footer|nav|body|head|html|section|table|tr|header|main|aside|title)(\s[^>]*)?>', chr(1) || 'N', 'g') AS marked FROM pages)))
 WHERE part LIKE 'T%' AND line <> '' GROUP BY page_id"""

REPEATS = """SELECT doc_id, strlen(t) >= 150 AND len(list_filter(CASE WHEN length(t) >= 50 THEN generate_series(0, length(t) - 50, 25) ELSE [] END,
  lambda i: regexp_replace(substr(t, i + 1, 50), '\\s', '', 'g') <> '' AND (length(t) - length(replace(t, substr(t, i + 1, 50), ''))) / 50 >= 3)) > 0 AS repeats
 FROM (SELECT doc_id, right(text, list_max(list_filter(generate_series(0, 800), lambda k: strlen(right(text, k)) <= 800))) AS t FROM documents)""".replace("\\\\", "\\")
