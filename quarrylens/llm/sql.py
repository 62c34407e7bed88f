"""DuckDB equivalents of the queries that plain SQL can express over whole tables."""

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

_LEAKS = f"""
WITH item_words AS (SELECT item_id, {_WORDS.format('passage')} AS w FROM golden_items),
grams AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item_words WHERE len(w) >= 12)
),
doc_words AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
doc_grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc_words WHERE len(w) >= 12)
),
hits AS (SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN grams USING (g))
"""

_DOI = r"regexp_replace(regexp_extract(lower(url_decode(replace(doi, '+', '%2B'))), '(10\.[0-9]+/\S+)', 1), '[\s\])}>.(\[{<]+$', '')"
_PAIRS = rf"""
WITH pp AS (SELECT DISTINCT ON (paper_key) paper_key, CASE WHEN regexp_matches({_DOI}, '^10\.[0-9]+/.') THEN {_DOI} END AS d,
              trim(regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM papers),
grams AS (SELECT DISTINCT paper_key, g FROM (SELECT paper_key, t[i:i + 2] AS g FROM (SELECT paper_key, t, unnest(range(1, length(t) - 1)) AS i FROM pp))),
sizes AS (SELECT paper_key, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.paper_key AS ka, b.paper_key AS kb, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.paper_key < b.paper_key GROUP BY 1, 2),
same_work AS (
  SELECT a.paper_key AS ka, b.paper_key AS kb FROM pp a JOIN pp b ON a.d = b.d AND a.paper_key < b.paper_key
  UNION ALL
  SELECT ka, kb FROM shared JOIN sizes x ON x.paper_key = ka JOIN sizes y ON y.paper_key = kb JOIN pp a ON a.paper_key = ka JOIN pp b ON b.paper_key = kb
  WHERE (a.d IS NULL OR b.d IS NULL) AND shared.n >= 0.8 * (x.n + y.n - shared.n) - 1e-9),
cw AS (SELECT DISTINCT ON (id) id, {_WORDS.format('text')} AS w FROM chunks),
cg AS (SELECT DISTINCT id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM cw)),
cn AS (SELECT id, count(*) AS n FROM cg GROUP BY 1 HAVING count(*) >= 60),
cs AS (SELECT a.id AS ia, b.id AS ib, count(*) AS n FROM cg a JOIN cg b USING (g) WHERE a.id < b.id AND a.id IN (SELECT id FROM cn) AND b.id IN (SELECT id FROM cn) GROUP BY 1, 2),
same_text AS (SELECT ia::VARCHAR AS ka, ib::VARCHAR AS kb FROM cs JOIN cn x ON x.id = ia JOIN cn y ON y.id = ib WHERE cs.n >= 0.6 * (x.n + y.n - cs.n) - 1e-9)
SELECT 'paper' AS record_kind, least(ka, kb) AS key_a, greatest(ka, kb) AS key_b FROM same_work
UNION ALL SELECT 'chunk', least(ka, kb), greatest(ka, kb) FROM same_text
"""

ORACLE = {
    "p2_found": _PAIRS,
    "p6_found": _LEAKS + "SELECT doc_id, item_id FROM hits",
    "p6_kept": _LEAKS + "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
}
