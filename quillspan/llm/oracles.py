"""SQL of the operators that SQL can express."""

REPEATED_WORDS = r"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM texts WHERE len(ws) >= 35),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM starts) QUALIFY count(*) OVER (PARTITION BY h) > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM texts),
marked AS (SELECT w.doc_id, w.i, w.word, coalesce(max((r.i IS NOT NULL)::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
 FROM words w LEFT JOIN repeated r ON w.doc_id = r.doc_id AND w.i = r.i),
cut AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT t.doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(c.gone, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256 FROM texts t LEFT JOIN cut c USING (doc_id)"""

#: Bytes as pairs of hexadecimal digits.
REPEATED_BYTES = """WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(generate_series(0, length(h) // 2 - 100), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS k, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM texts WHERE length(h) >= 200),
later AS (SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, generate_subscripts(regexp_extract_all(h, '..'), 1) - 1 AS i FROM texts WHERE h <> ''),
marked AS (SELECT b.doc_id, b.i, b.b, max((l.i IS NOT NULL)::INT) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone
 FROM bytes b LEFT JOIN later l ON b.doc_id = l.doc_id AND b.i = l.i),
runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM marked),
cut AS (SELECT doc_id, count(*) AS n, sum(gone) AS gone, count(*) FILTER (opens) AS spans, string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept FROM runs GROUP BY doc_id)
SELECT t.doc_id, coalesce(c.n, 0)::BIGINT AS n_bytes, coalesce(c.gone, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(c.kept, ''))) AS kept_sha256 FROM texts t LEFT JOIN cut c USING (doc_id)"""

EXACT_TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e)::BIGINT DESC, c.vec_id)::INT AS rank, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""
