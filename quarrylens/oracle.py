"""DuckDB SQL of the registered queries that SQL can express over whole tables."""

from __future__ import annotations

from .functions import rules


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n)})" for n in needles) + ")"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')"


def _squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g'))"


def _rank(x: str) -> str:
    return _squash(f"translate(lower({x}), '-‐‑–—/_', '       ')")


def _occ(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, {term}, ''))) // greatest(length({term}), 1))"


_CHUNKS = "c AS (SELECT DISTINCT ON (id) * FROM chunks WHERE id IS NOT NULL)"
_SOURCE = (
    _CHUNKS
    + """, s AS (
  SELECT c.id, c.paper_key, p.author, p.title, coalesce(p.doi, '') AS doi, coalesce(p.year, '') AS year, c.chunk_index, c.section,
         coalesce(c.section_kind, 'body') AS section_kind, p.source_hash, c.text
  FROM c JOIN papers p USING (paper_key))"""
)
_LOGS = "l AS (SELECT DISTINCT ON (id) * FROM qa_logs WHERE id IS NOT NULL)"

_META = """m AS (
  SELECT paper_key, paper_id, metadata, CASE WHEN json_valid(fetch_result) THEN fetch_result END AS f FROM articles)"""


def _field(name: str, default: str) -> str:
    return f"coalesce(metadata['{name}'], f ->> '$.{name}', f ->> '$.record.{name}', {default})"


_RESOLVED = f"SELECT paper_key, {_squash(_field('title', 'paper_id'))} AS title, {_strip(_field('doi', chr(39) * 2))} AS doi, {_strip(_field('year', chr(39) * 2))} AS year FROM m"
_FINGERPRINT = (
    f"sha256('parser:{rules.PARSER_VERSION}' || chr(10) || 'cleaner:{rules.CLEANER_VERSION}' || chr(10) || coalesce(raw_body, '') || coalesce(fetch_result, ''))"
)

# terms of a question: base runs, then numbers, quoted and English phrases, unique ignoring case
_BASE = r"list_filter(regexp_extract_all(q, '[一-鿿]+|[A-Za-z0-9_/.\-\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}]+'), lambda t: length(t) > 1 OR regexp_matches(t, '^[A-Za-z0-9]+$'))"
_TOKENS = r"list_transform(list_filter(regexp_split_to_array(q, '[\s\x{a0}\x{3000}]+'), lambda t: length(t) > 0), lambda t: regexp_replace(t, '^[^A-Za-z0-9./_-]+|[^A-Za-z0-9./_-]+$', '', 'g'))"
_NUMBERS = f"list_filter({_TOKENS}, lambda t: regexp_matches(t, '[0-9]'))"
_QUOTED = "list_filter(list_transform(list_filter(string_split(q, '\"'), lambda t, i: i % 2 = 0), lambda t: trim(t)), lambda t: length(t) > 2)"
_PHRASES = r"list_filter(list_transform(regexp_split_to_array(q, '[^A-Za-z0-9\- ]'), lambda t: trim(t)), lambda t: regexp_matches(t, '\S +\S') AND length(t) <= 80)"


def _unique(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position(list_transform({x}, lambda u: lower(u)), lower(t)) = i)"


def _terms(source: str, key: str, more: str = "") -> str:
    return f"""b AS (SELECT {key}{more}, question AS q, {_BASE.replace('(q,', '(question,')} AS base FROM {source}),
  a AS (SELECT {key}{more}, q, CASE WHEN len(base) > 0 THEN {_unique('base')} WHEN length(trim(q)) > 0 THEN [trim(q)] ELSE [] END AS base,
        list_concat(list_concat({_NUMBERS}, {_QUOTED}), {_PHRASES}) AS extra FROM b),
  j AS (SELECT {key}{more}, q, list_concat(base, extra) AS x FROM a),
  terms AS (SELECT {key}{more}, q, {_unique('x')} AS terms FROM j)"""


def _intents() -> str:
    cases = []
    for kind, needles in rules.FACT_INTENTS:
        tests = []
        for n in needles:
            if n.isascii() and all(c.isalnum() or c in "-_" for c in n):
                tests.append(f"list_contains(w, {_q(n)}) OR list_contains(w, {_q(n + 's')})")
            else:
                tests.append(f"contains(low, {_q(n)})")
        cases.append(f"CASE WHEN {' OR '.join(tests)} THEN '{kind}' END")
    return "list_filter([" + ", ".join(cases) + "], lambda t: t IS NOT NULL)"


def _synonym_case(alike: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN t = {_q(k)} THEN [{', '.join(map(_q, v))}]" for k, v in alike.items()) + " ELSE [] END"


_STOP = ", ".join(map(_q, rules.RANK_STOP))
_RANK_TERMS = (
    f"list_filter(list_transform(terms, lambda t: {_rank('t')}), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"
)


def _ranked_terms(alike: dict[str, list[str]]) -> str:
    spread = f"flatten(list_transform({_RANK_TERMS}, lambda t: list_concat(list_concat([t], {_synonym_case(alike)}), CASE WHEN NOT ends_with(t, 's') THEN [t || 's'] WHEN length(t) >= 5 THEN [t[:-2]] ELSE [] END)))"
    return f"list_filter({spread}, lambda t, i: list_position({spread}, t) = i)"


_RANKED_TERMS = _ranked_terms(rules.SYNONYMS)


def _class_case(field: int) -> str:
    """0 the kind, 1 the score, 2 the reason of the cascade."""

    def out(kind: str, score: float, reason: str | None) -> str:
        return [f"'{kind}'", f"{score}::DOUBLE", "NULL" if reason is None else f"'{reason}'"][field]

    furniture = f"len(f) > 0 AND len(list_filter(f, lambda x: {_any('x', rules.PUBLISHER_PHRASES)})) = len(f)"
    parts = [
        f"WHEN section_kind = 'figure_caption' THEN {out('figure_caption', 0.95, None)}",
        f"WHEN section_kind = 'table_caption' THEN {out('table_caption', 0.95, None)}",
        f"WHEN {_any('sec', rules.REFERENCE_NEEDLES)} THEN {out('bibliography_or_reference', 0.0, 'reference_section')}",
        f"WHEN {furniture} THEN {out('publisher_noise', 0.0, 'publisher_noise')}",
        f"WHEN solid < 40 THEN {out('low_information', 0.0, 'very_short')}",
    ]
    parts += [f"WHEN {_any('sec', needles)} THEN {out(name, score, None)}" for name, score, needles in rules.SECTION_KINDS]
    parts += [f"WHEN {_any('low', rules.MECHANISM_NEEDLES)} THEN {out('mechanism', 0.8, None)}", f"WHEN {_any('low', rules.METRIC_NEEDLES)} THEN {out('metric', 0.8, None)}"]
    return "CASE " + " ".join(parts) + f" ELSE {out('unknown', 0.5, None)} END"


_WS = r"[\s\x{a0}\x{3000}]"
_CLASSES = (
    _CHUNKS
    + f""", n AS (SELECT id AS chunk_id, paper_key, chunk_index, section, coalesce(section_kind, 'body') AS section_kind, text,
  {_squash('lower(section)')} AS sec, {_squash('lower(text)')} AS low, length(regexp_replace(text, '{_WS}', '', 'g')) AS solid,
  list_filter(string_split(lower(text), chr(10)), lambda x: length(trim(x)) > 0) AS f FROM c),
k AS (SELECT chunk_id, paper_key, chunk_index, text, {_class_case(0)} AS chunk_kind, {_class_case(1)} AS usefulness_score, {_class_case(2)} AS skip_reason FROM n)"""
)
_FACT_CASE = "CASE chunk_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.FACT_TYPES.items()) + " END"
_RANK_CASE = "CASE fact_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.FACT_RANKS.items()) + " ELSE 10 END"
_FACTS = (
    _CLASSES
    + f""", g AS (SELECT chunk_id, paper_key, chunk_index, {_FACT_CASE} AS fact_type, {_squash('text')} AS claim FROM k WHERE skip_reason IS NULL AND usefulness_score >= 0.5),
facts AS (SELECT 'chunk-fact-v1:' || sha256(paper_key || chr(0) || fact_type || chr(0) || claim || chr(0) || chunk_index) AS claim_uid, *,
  CASE WHEN fact_type = 'context' THEN 'medium' ELSE 'high' END AS confidence FROM g WHERE fact_type IS NOT NULL AND claim <> ''),
d AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY paper_key, fact_type, claim ORDER BY chunk_index, claim_uid) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY {_RANK_CASE} DESC, chunk_index, claim_uid)::INT AS rank_position FROM d)"""
)
_KSTOP = ", ".join(map(_q, rules.KEYWORD_STOP))
_PROFILES = (
    _FACTS
    + f""", w0 AS (SELECT p.paper_key, p.author, p.title, coalesce(p.doi, '') AS doi, coalesce(p.year, '') AS year, count(*) AS facts,
  coalesce(arg_min(claim, rank_position) FILTER (fact_type = 'context'), arg_min(claim, rank_position) FILTER (fact_type = 'result'), arg_min(claim, rank_position)) AS lead,
  list(claim ORDER BY rank_position) AS every,
  least(count(*) FILTER (fact_type NOT IN ('limitation', 'context')), 6)::INT AS contributions, least(count(*) FILTER (fact_type = 'limitation'), 6)::INT AS limitations
  FROM r JOIN papers p USING (paper_key) GROUP BY ALL),
kinds AS (SELECT paper_key, string_agg(fact_type, ',' ORDER BY {_RANK_CASE} DESC, fact_type) AS contribution_types FROM (SELECT DISTINCT paper_key, fact_type FROM r WHERE fact_type <> 'context') GROUP BY 1),
w1 AS (SELECT *, list_filter(flatten(list_transform(list_concat([title], every), lambda t: regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}-]+'))), lambda w: strlen(w) >= 4 AND lower(w) NOT IN ({_KSTOP})) AS ws FROM w0),
kw0 AS (SELECT paper_key, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w1), kw1 AS (SELECT paper_key, w, min(i) AS i FROM kw0 GROUP BY ALL),
kw AS (SELECT paper_key, list_sort(list(w)) AS topic_keywords FROM (SELECT * FROM kw1 QUALIFY row_number() OVER (PARTITION BY paper_key ORDER BY i) <= 12) GROUP BY 1),
pr AS (SELECT w1.*, title || ': ' || lead AS one_sentence_summary, coalesce(contribution_types, '') AS contribution_types,
  coalesce(topic_keywords, []) AS topic_keywords FROM w1 LEFT JOIN kinds USING (paper_key) LEFT JOIN kw USING (paper_key))"""
)

_QUESTIONS = "questions AS (SELECT item_id AS query_id, author, question FROM golden_items)"
_LIKE_BODY = f"""blob AS (
  SELECT id, author, year, title, chunk_index, lower(concat_ws(' ', title, doi, section, text)) AS t FROM s),
scored AS (SELECT query_id, id, year, title, chunk_index, list_sum(list_transform(terms, lambda x: {_occ('t', 'lower(x)')})) AS score FROM blob JOIN terms USING (author)),
liked AS (SELECT query_id, 'like' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, year DESC, title, chunk_index, id)::INT AS position, id AS chunk_id, score::DOUBLE AS route_score
  FROM scored WHERE score > 0 QUALIFY position <= {rules.ROUTE_LIMIT})"""
_LIKE = f"{_QUESTIONS}, {_terms('questions', 'query_id', ', author')}, {_LIKE_BODY}"
_BM25 = f"""ph AS (SELECT DISTINCT query_id, author, array_to_string(regexp_extract_all(lower(term), '[\\p{{L}}\\p{{N}}]+'), '  ') AS phrase
  FROM (SELECT query_id, author, unnest(terms[:12]) AS term FROM terms)),
ph2 AS (SELECT * FROM ph WHERE phrase <> ''),
tok AS (SELECT id AS chunk_id, author, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM s),
tot AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM tok),
sq AS (SELECT chunk_id, author, len(w) AS length, ' ' || array_to_string(w, '  ') || ' ' AS sequence, w FROM tok),
cnt AS (SELECT chunk_id, sq.author, length, phrase, {_occ('sequence', "(' ' || phrase || ' ')")} AS f FROM (SELECT DISTINCT phrase FROM ph2) JOIN sq ON contains(sequence, ' ' || phrase || ' ')),
df AS (SELECT phrase, count(*) AS df FROM cnt GROUP BY 1),
wt AS (SELECT chunk_id, cnt.author, phrase, greatest(ln((n - df + 0.5) / (df + 0.5)), {rules.BM25_FLOOR}) * f * {rules.BM25_K1 + 1} / (f + {rules.BM25_K1} * (1 - {rules.BM25_B} + {rules.BM25_B} * length / mean_length)) AS w
  FROM cnt JOIN df USING (phrase), tot),
bs AS (SELECT query_id, chunk_id, round(sum(w), 9) AS score FROM ph2 JOIN wt USING (phrase, author) GROUP BY 1, 2),
fts AS (SELECT query_id, 'fts' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS position, chunk_id, score AS route_score FROM bs QUALIFY position <= {rules.ROUTE_LIMIT})"""

_BODY = "section_kind NOT IN ('figure_caption', 'table_caption')"


def _level(representative: bool) -> str:
    tail = f"WHEN {_BODY} AND contains(said, 'abstract') THEN 3 WHEN {_BODY} THEN 4 ELSE 5" if representative else f"WHEN {_BODY} THEN 3 ELSE 4"
    return f"""CASE WHEN {_BODY} AND chunk_index > 0 AND contains(said, 'abstract') THEN 0
  WHEN {_BODY} AND chunk_index > 0 AND contains(said, 'introduction') THEN 1 WHEN {_BODY} AND chunk_index > 0 THEN 2 {tail} END"""


_ANSWERS = r"""l AS (SELECT DISTINCT ON (id) id, answer_json AS t FROM qa_logs WHERE id IS NOT NULL),
o AS (SELECT id, CASE WHEN json_valid(t) AND starts_with(trim(t), '{') THEN t ELSE regexp_extract(t, '(?s)\{.*\}', 0) END AS j FROM l),
v AS (SELECT id AS log_id, CASE WHEN j <> '' AND json_valid(j) THEN j::JSON END AS j FROM o)"""
_TOTALS = """count(*) AS questions, round(avg(latency_ms), 6) AS mean_latency_ms, sum(prompt_tokens)::BIGINT AS prompt_tokens,
  sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens"""
_ITEMS = """i AS (SELECT response_id, lower(trim(model)) AS model, model_version, received_at, target_ids, unnest(data) AS d FROM embedding_responses),
it AS (SELECT response_id, model, model_version, received_at, d.index AS position, target_ids[d.index + 1] AS chunk_id, d.embedding AS vector FROM i WHERE d.index >= 0)"""

_EVIDENCE_TYPE = '[{"paper_key":"VARCHAR","title":"VARCHAR","doi":"VARCHAR","year":"VARCHAR","chunk_id":"BIGINT","section":"VARCHAR","quote_or_summary":"VARCHAR"}]'
_CLAIM_TYPE = '[{"claim":"VARCHAR","evidence_indices":["INTEGER"],"support":"VARCHAR"}]'
_WORDS3 = r"list_filter(regexp_split_to_array(lower(quote), '[^\p{L}\p{N}]+'), lambda t: length(t) >= 3)[:12]"
_NUMBERS_OF = r"list_filter(regexp_split_to_array(quote, '[^0-9.]'), lambda t: regexp_matches(t, '[0-9]'))"


def _differs(mine: str, theirs: str, fold: bool = False) -> str:
    a, b = f"trim(coalesce({mine}, ''))", f"trim(coalesce({theirs}, ''))"
    x, y = (f"lower({a})", f"lower({b})") if fold else (a, b)
    return f"({a} <> '' AND {b} <> '' AND {x} <> {y})"


_EVIDENCE = (
    _ANSWERS
    + f""", ev AS (SELECT log_id, from_json(j -> '$.evidence', '{_EVIDENCE_TYPE}') AS es FROM v WHERE j IS NOT NULL AND json_type(j, '$.evidence') = 'ARRAY'),
er AS (SELECT log_id, unnest(range(len(es)))::INT AS position, unnest(es) AS e FROM ev),
sc AS (SELECT DISTINCT ON (c.id) c.id, c.paper_key, coalesce(p.doi, '') AS doi, coalesce(p.year, '') AS year, c.section, c.text FROM chunks c JOIN papers p USING (paper_key)),
eq AS (SELECT log_id, position, e, sc.*, trim(coalesce(e.quote_or_summary, '')) AS quote, coalesce(sc.text, '') AS ctext FROM er LEFT JOIN sc ON sc.id = e.chunk_id),
ee AS (SELECT log_id, position, e.chunk_id AS chunk_id, CASE WHEN id IS NULL THEN 'unknown_chunk' WHEN e.paper_key IS DISTINCT FROM paper_key THEN 'other_paper'
  WHEN {_differs('e.doi', 'doi')} THEN 'other_doi' WHEN {_differs('e.year', 'year')} THEN 'other_year' WHEN {_differs('e.section', 'section', True)} THEN 'other_section'
  WHEN quote = '' OR (length({_squash('lower(quote)')}) >= 12 AND contains({_squash('lower(ctext)')}, {_squash('lower(quote)')})) THEN NULL
  WHEN len(list_filter({_NUMBERS_OF}, lambda t: NOT contains(ctext, t))) > 0 THEN 'number'
  WHEN length(quote) >= 12 AND len(list_filter({_WORDS3}, lambda t: contains({_squash('lower(ctext)')}, t))) = 0 THEN 'overlap' END AS error FROM eq)"""
)


def _insufficient(x: str) -> str:
    return _any(f"lower({x})", rules.INSUFFICIENT)


_CLAIMS = f"""cl AS (SELECT log_id, coalesce(j ->> '$.answer', '') AS answer, coalesce(j ->> '$.uncertainty', '') AS unsure, coalesce(json_array_length(j, '$.evidence'), 0) AS n,
  from_json(j -> '$.claims', '{_CLAIM_TYPE}') AS cs FROM v WHERE j IS NOT NULL AND json_type(j, '$.claims') = 'ARRAY'),
cr AS (SELECT log_id, answer, unsure, n, unnest(range(len(cs)))::INT AS position, unnest(cs) AS c FROM cl),
ce AS (SELECT log_id, position, CASE WHEN trim(coalesce(c.claim, '')) = '' THEN 'empty' WHEN lower(trim(coalesce(c.support, ''))) NOT IN ('', 'strong', 'partial', 'weak') THEN 'bad_support'
  WHEN len(coalesce(c.evidence_indices, [])) = 0 AND NOT {_insufficient('answer')} THEN 'no_evidence'
  WHEN len(list_filter(coalesce(c.evidence_indices, []), lambda i: i >= n)) > 0 THEN 'missing_evidence'
  WHEN lower(trim(coalesce(c.support, ''))) = 'weak' AND NOT (trim(unsure) <> '' OR {_any('lower(answer)', rules.UNCERTAIN)}) THEN 'weak_but_certain' END AS error FROM cr)"""
_VERDICTS = f"""fe AS (SELECT log_id, 0 AS part, position, 'evidence:' || error AS error FROM ee WHERE error IS NOT NULL
  UNION ALL SELECT log_id, 1, 0, 'no_evidence' FROM v WHERE j IS NOT NULL AND coalesce(json_array_length(j, '$.evidence'), 0) <= 0 AND NOT {_insufficient("coalesce(j ->> '$.answer', '')")}
  UNION ALL SELECT log_id, 2, position, 'claim:' || error FROM ce WHERE error IS NOT NULL),
ff AS (SELECT log_id, error FROM fe QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY part, position, error) = 1)"""
#: The end of a window of 800 from ``start``: after the last line or sentence end of its second half, else its end.
def _cut(start: str, size: int) -> str:
    half = size // 2
    return f"""(SELECT CASE WHEN m >= 0 THEN {start} + {half} + m + 1 ELSE {start} + {size} END FROM (SELECT {half} - length(regexp_extract(t[{start} + {half + 1}:{start} + {size}], '[^\\n。.]*$')) - 1 AS m))"""


_CUT = """(SELECT CASE WHEN m >= 0 THEN start + 400 + m + 1 ELSE start + 800 END FROM (SELECT 400 - length(regexp_extract(t[start + 401:start + 800], '[^\\n。.]*$')) - 1 AS m))"""
_RANKED_QUESTIONS = f"{_QUESTIONS}, {_terms('questions', 'query_id', ', author')}, rt AS (SELECT query_id, author, {_RANKED_TERMS} AS rterms FROM terms)"

# --- cleaning and sections in SQL -------------------------------------------


def _normal_line(x: str) -> str:
    return f"lower({_squash(f"regexp_replace({_strip(x)}, '^[#*_:|-]+|[#*_:|-]+$', '', 'g')")})"


def _noise(low: str, layers: list[str]) -> str:
    chosen = [rules.SOURCE_LAYERS[n] for n in layers]
    exact = rules.NOISE_LINES + [x for layer in chosen for x in layer["lines"]]
    counted = rules.COUNT_PREFIX_LINES + [x for layer in chosen for x in layer["counts"]]
    prefixes = [x for layer in chosen for x in layer["prefixes"]]
    tests = [f"{low} IN ({', '.join(map(_q, exact))})", rf"regexp_matches({low}, '^(?:{'|'.join(counted)})[0-9\s()\[\]:|,-]*$')"]
    tests += [f"starts_with({low}, {_q(x)})" for x in prefixes]
    return f"({low} <> '' AND ({' OR '.join(tests)}))"


def _clean(x: str) -> str:
    out = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    for old, new in rules.NOISE_REPLACEMENTS:
        out = f"replace({out}, {_q(old)}, {_q(new)})"
    out = rf"regexp_replace({out}, 'Download: Download (?:high-res|full-size) image(?: \([^)]*\))?', ' ', 'g')"
    kept = f"list_filter(string_split({out}, chr(10)), lambda y: NOT {_noise(_normal_line('y'), [])})"
    squashed = f"array_to_string(list_transform({kept}, lambda y: {_squash('y')}), chr(10))"
    return _strip(f"regexp_replace({squashed}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_PLAIN = rf"""{_strip(r"regexp_replace(regexp_replace(raw_body, '\r\n?', chr(10), 'g'), '(?s)\A---[ \t]*\n(?:.*?\n)??---[ \t]*(?:\n|\z)', '')")}"""
_HEAD = r"'^\s*(#{1,6})\s*([^#\s].*)$'"
_SECTIONS = rf"""pb AS (SELECT paper_key, {_PLAIN} AS b FROM articles WHERE raw_body IS NOT NULL),
po AS (SELECT paper_key, CASE WHEN instr(b, chr(10) || '## Article Body') > 0 THEN b[instr(b, chr(10) || '## Article Body') + 1:] ELSE b END AS b FROM pb),
pm AS (SELECT paper_key, {_clean('b')} AS b FROM po),
ln AS (SELECT paper_key, unnest(range(len(string_split(b, chr(10))))) AS line_no, unnest(string_split(b, chr(10))) AS line FROM pm),
hd AS (SELECT *, length(regexp_extract(line, {_HEAD}, 1)) AS level, {_strip(f"regexp_extract(line, {_HEAD}, 2)")} AS heading FROM ln),
nm AS (SELECT *, greatest(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_key ORDER BY line_no), 1) AS sec FROM hd),
gr AS (SELECT paper_key, sec, max(heading) FILTER (level > 0) AS heading, max(level) FILTER (level > 0) AS hl, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (level = 0), '') AS content FROM nm GROUP BY 1, 2),
cs AS (SELECT paper_key, sec, coalesce(heading, 'Body') AS title, coalesce(hl, 1)::INT AS level, {_clean('content')} AS content FROM gr),
ks AS (SELECT * FROM cs WHERE content <> '' AND lower(regexp_replace({_strip('title')}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')) NOT IN ({', '.join(map(_q, rules.REFERENCE_TITLES))})),
sections AS (SELECT paper_key, (row_number() OVER (PARTITION BY paper_key ORDER BY sec) - 1)::INT AS position, title, level, content FROM ks)"""
_SECTION_FACT = (
    "CASE WHEN (starts_with(lower(title), 'figure') AND contains(lower(title), 'caption')) OR starts_with(lower(title), 'fig ') OR starts_with(title, '图 ') THEN 'figure_caption' "
    "WHEN (starts_with(lower(title), 'table') AND contains(lower(title), 'caption')) OR starts_with(title, '表 ') THEN 'table_caption' "
    + " ".join(f"WHEN {_any('lower(title)', needles)} THEN '{name}'" for name, needles in rules.SECTION_FACTS)
    + " END"
)
_LABEL = r"[\p{L}\p{N}-]*[0-9][\p{L}\p{N}-]*(?:,[\p{L}\p{N}-]+)*"
_CAP_EN = rf"(?i)^(figure|fig|table)(?:\.+\s*|\s+|)({_LABEL})\s*[.:|)-]*\s*(.*)$"
_CAP_CJK = rf"^(图|表)\s*({_LABEL})\s*[.:|)-]*\s*(.*)$"
_UNIT = r"(?:%|°C|K\b|mol/L|min\b|h\b|s\b|nm\b|mV\b|V\b|mA\b|g\b|mg\b|eV\b)"
_NUMBER = r"[-+−]?[0-9][0-9.]*"
_METRICS = "|".join(sorted(rules.METRIC_PHRASES, key=len, reverse=True))
_PREFERRED = "'abstract', 'introduction', 'results', 'results and discussion', 'discussion', 'conclusions', 'conclusion'"


def _part(pattern: str, i: int) -> str:
    return f"regexp_extract(tail, '{pattern}', {i})"


_LIST, _PRANGE, _ORANGE, _TRAIL = (
    r"^(.*[0-9])([A-Za-z])((?:\s*,\s*[A-Za-z])+)$", r"^(.*[0-9])([A-Za-z])\s*-\s*([A-Za-z])$", r"^([A-Za-z]*)([0-9]+)\s*-\s*([A-Za-z]*)([0-9]+)$", r"^(.*[0-9])([A-Za-z])$",
)
_IS_RANGE = (
    f"(regexp_matches(tail, '{_ORANGE}') AND {_part(_ORANGE, 3)} IN ('', {_part(_ORANGE, 1)}) AND try_cast({_part(_ORANGE, 2)} AS BIGINT) <= try_cast({_part(_ORANGE, 4)} AS BIGINT) "
    f"AND try_cast({_part(_ORANGE, 4)} AS BIGINT) - try_cast({_part(_ORANGE, 2)} AS BIGINT) <= 50)"
)
_OBJECTS = rf"""{_CHUNKS}, lb AS (SELECT id, regexp_extract(caption_label, '^\s*(\S+)\s+(.*\S)\s*$', 1) AS prefix, regexp_extract(caption_label, '^\s*(\S+)\s+(.*\S)\s*$', 2) AS tail FROM c WHERE caption_label IS NOT NULL),
lk AS (SELECT *, CASE WHEN lower(prefix) IN ('figure', 'fig') OR prefix = '图' THEN 'figure' WHEN lower(prefix) = 'table' OR prefix = '表' THEN 'table' END AS kind FROM lb),
lp AS (SELECT *, CASE WHEN kind IS NULL THEN NULL WHEN regexp_matches(tail, '{_LIST}') THEN {_part(_LIST, 1)} WHEN regexp_matches(tail, '{_PRANGE}') THEN {_part(_PRANGE, 1)}
    WHEN {_IS_RANGE} THEN tail WHEN regexp_matches(tail, '{_TRAIL}') THEN {_part(_TRAIL, 1)} ELSE tail END AS base,
  CASE WHEN regexp_matches(tail, '{_LIST}') THEN list_concat([{_part(_LIST, 2)}], list_filter(list_transform(string_split({_part(_LIST, 3)}, ','), lambda x: trim(x)), lambda x: x <> ''))
    WHEN regexp_matches(tail, '{_PRANGE}') THEN CASE WHEN ascii({_part(_PRANGE, 2)}) <= ascii({_part(_PRANGE, 3)}) AND (lower({_part(_PRANGE, 2)}) = {_part(_PRANGE, 2)}) = (lower({_part(_PRANGE, 3)}) = {_part(_PRANGE, 3)})
      THEN list_transform(range(ascii({_part(_PRANGE, 2)}), ascii({_part(_PRANGE, 3)}) + 1), lambda x: chr(x::INT)) ELSE [{_part(_PRANGE, 2)}, {_part(_PRANGE, 3)}] END
    WHEN {_IS_RANGE} THEN [] WHEN regexp_matches(tail, '{_TRAIL}') THEN [{_part(_TRAIL, 2)}] ELSE [] END AS panels FROM lk)"""
_OBJECT_ROWS = f"""SELECT id, kind AS object_type, base AS object_label, CASE WHEN kind IS NOT NULL THEN array_to_string(panels, ',') ELSE '' END AS panels,
  CASE WHEN kind IS NULL THEN '' WHEN len(panels) > 0 THEN array_to_string(list_transform(panels, lambda x: prefix || ' ' || base || x), ',')
    WHEN {_IS_RANGE} THEN array_to_string(list_transform(range(try_cast({_part(_ORANGE, 2)} AS BIGINT), try_cast({_part(_ORANGE, 4)} AS BIGINT) + 1), lambda x: prefix || ' ' || {_part(_ORANGE, 1)} || x), ',')
    ELSE prefix || ' ' || tail END AS targets FROM lp"""

# --- the hybrid plan in SQL -------------------------------------------------


def _folded(key: str, source: str, text: str) -> str:
    """``(key, term)``: the distinct lower-cased terms of texts."""
    base = _BASE.replace(r"[A-Za-z0-9_/.\-\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}]", r"[\p{L}\p{N}_/.\-]").replace("(q,", f"({text},")
    extra = f"list_concat(list_concat({_NUMBERS}, {_QUOTED}), {_PHRASES})".replace("(q,", f"({text},")
    return f"SELECT DISTINCT {key}, author, lower(unnest(list_concat({base}, {extra}))) AS term FROM {source}"


_BUCKET = "list_reduce(list_prepend(3, list_transform(range(0, strlen(term)), lambda i: ('0x' || hex(term)[2 * i + 1:2 * i + 2])::INT)), lambda h, b: (xor(h, b & 63) * 51) & 63)"


def _vector(name: str, key: str, folded: str) -> str:
    return f"""{name}_t AS ({folded}), {name}_b AS (SELECT {key}, author, {_BUCKET} AS bucket, count(*) AS n FROM {name}_t GROUP BY ALL),
  {name}_v AS (SELECT {key}, author, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM {name}_b)"""


_LOCAL = f"""lc0 AS (SELECT id, author, concat_ws(' ', title, doi, section, text) AS body FROM s), {_vector('lq', 'query_id', _folded('query_id', 'questions', 'question'))},
{_vector('lc', 'id', _folded('id', 'lc0', 'body'))},
ld AS (SELECT query_id, id, round(sum(lq_v.x * lc_v.x), 6) AS score FROM lq_v JOIN lc_v USING (author, bucket) GROUP BY 1, 2),
local AS (SELECT query_id, 'local_embedding' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS position, id AS chunk_id, score AS route_score FROM ld WHERE score > 0 QUALIFY position <= {rules.ROUTE_LIMIT})"""

_S_OF_C = """s AS (SELECT c.id, c.paper_key, p.author, p.title, coalesce(p.doi, '') AS doi, coalesce(p.year, '') AS year, c.chunk_index, c.section,
  coalesce(c.section_kind, 'body') AS section_kind, p.source_hash, c.text FROM c JOIN papers p USING (paper_key))"""
_PROFILE_SCORES = f"""parts AS (
  SELECT paper_key, {_rank('doi')} AS said, 11 AS w FROM pr UNION ALL SELECT paper_key, {_rank('title')}, 6 FROM pr
  UNION ALL SELECT paper_key, {_rank("array_to_string(topic_keywords, ' ')")}, 5 FROM pr UNION ALL SELECT paper_key, {_rank('one_sentence_summary')}, 3 FROM pr
  UNION ALL SELECT paper_key, {_rank('claim')}, CASE fact_type WHEN 'result' THEN 5 WHEN 'method' THEN 4 WHEN 'limitation' THEN 4 ELSE 1 END
    FROM (SELECT DISTINCT paper_key, fact_type, claim FROM facts)),
py AS (SELECT query_id, pr.paper_key, pr.year, pr.title, sum(w * coalesce(list_sum(list_transform(rterms, lambda t: {_occ('said', 't')})), 0))::BIGINT AS score
  FROM pr JOIN rt USING (author) JOIN parts USING (paper_key) GROUP BY ALL)"""
_HYBRID = f"""{_PROFILES}, {_S_OF_C}, {_RANKED_QUESTIONS}, {_LIKE_BODY}, {_BM25}, {_LOCAL},
tz AS (SELECT query_id, author, terms, lower(array_to_string(terms, ' ')) AS low FROM terms), ty AS (SELECT query_id, author, terms, low, regexp_split_to_array(low, '[^a-z0-9_-]+') AS w FROM tz),
ti AS (SELECT query_id, author, terms, {_intents()} AS intents FROM ty),
fb AS (SELECT s.id, s.author, fact_type, lower(concat_ws(' ', fact_type, claim, title, doi, section, s.text)) AS t FROM facts JOIN s ON s.id = facts.chunk_id),
fs AS (SELECT query_id, fb.id, fact_type, list_sum(list_transform(terms, lambda x: {_occ('t', 'lower(x)')})) + CASE WHEN list_contains(intents, fact_type) THEN 3 ELSE 0 END AS score
  FROM fb JOIN ti USING (author) WHERE len(intents) = 0 OR list_contains(intents, fact_type)),
fact AS (SELECT query_id, 'fact' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, fact_type)::INT AS position, id AS chunk_id, score::DOUBLE AS route_score FROM fs WHERE score > 0 QUALIFY position <= {rules.ROUTE_LIMIT}),
{_PROFILE_SCORES},
pz AS (SELECT query_id, paper_key, score, row_number() OVER (PARTITION BY query_id ORDER BY (score > 0) DESC, score DESC, year DESC, title, paper_key)::INT AS position FROM py QUALIFY position <= 20),
bx AS (SELECT *, {_rank("concat_ws(' ', section, text)")} AS said FROM s), bl AS (SELECT paper_key, id, chunk_index, {_level(True)} AS level FROM bx),
rep AS (SELECT paper_key, id AS chunk_id FROM bl QUALIFY row_number() OVER (PARTITION BY paper_key ORDER BY level, chunk_index, id) = 1),
profile AS (SELECT query_id, 'profile' AS route, position, chunk_id, score::DOUBLE AS route_score FROM pz JOIN rep USING (paper_key)),
allr AS (SELECT * FROM fts UNION ALL SELECT * FROM liked UNION ALL SELECT * FROM fact UNION ALL SELECT * FROM local UNION ALL SELECT * FROM profile),
fo AS (SELECT query_id, route, chunk_id, min(position) AS position FROM allr GROUP BY 1, 2, 3),
fx AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / ({rules.RRF_OFFSET} + position)), 12) AS rrf_score, min(position) FILTER (route = 'fts' AND position <= {rules.LEXICAL_SEEDS}) AS seed FROM fo GROUP BY 1, 2),
hybrid AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seed ASC NULLS LAST, rrf_score DESC, chunk_id)::INT AS position, chunk_id, rrf_score, seed FROM fx QUALIFY position <= 8)"""


def _cases(source: str, name: str) -> str:
    """Golden cases of a fused table."""
    return f"""{name}_r AS (SELECT g.item_id AS query_id, must_cite, must_include, s.paper_key, lower(s.text) AS low, list_contains(must_cite, s.paper_key) AS wanted
  FROM {source} h JOIN s ON s.id = h.chunk_id JOIN golden_items g ON g.item_id = h.query_id),
{name}_p AS (SELECT query_id, list(DISTINCT paper_key) AS keys, count(*) AS n, count(*) FILTER (wanted) AS good,
  list_distinct(flatten(list(list_filter(must_include, lambda t: contains(low, lower(t)))) FILTER (wanted))) AS seen FROM {name}_r GROUP BY 1),
{name}_m AS (SELECT item_id AS query_id, must_cite, keys, n, good, list_sort(list_filter(must_include, lambda t: NOT list_contains(coalesce(seen, []), t))) AS missing FROM golden_items LEFT JOIN {name}_p ON query_id = item_id),
{name} AS (SELECT query_id, len(list_filter(must_cite, lambda k: NOT list_contains(coalesce(keys, []), k))) = 0 AS hit,
  CASE WHEN coalesce(n, 0) = 0 THEN 0.0 WHEN len(must_cite) = 0 THEN 1.0 ELSE good::DOUBLE / n END AS precision, len(missing) = 0 AS covered, array_to_string(missing, ',') AS missing_terms FROM {name}_m)"""


_SUMMARY = "count(*) AS questions, round(avg(hit::INT), 6) AS hit_at_k, round(avg(precision), 6) AS mean_precision, round(avg(covered::INT), 6) AS coverage"
_LEXICAL = f"""lu AS (SELECT * FROM fts UNION ALL SELECT * FROM liked),
lx AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / ({rules.RRF_OFFSET} + position)), 12) AS rrf_score, min(position) FILTER (route = 'fts' AND position <= {rules.LEXICAL_SEEDS}) AS seed FROM lu GROUP BY 1, 2),
lexical AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seed ASC NULLS LAST, rrf_score DESC, chunk_id)::INT AS position, chunk_id FROM lx QUALIFY position <= 8)"""

ORACLE = {
    "article_metadata": f"WITH {_META} {_RESOLVED}",
    "fetch_result_states": """SELECT paper_key, CASE WHEN fetch_result IS NULL THEN 'missing' WHEN NOT json_valid(fetch_result) THEN 'broken'
        WHEN json_type(fetch_result) <> 'OBJECT' THEN 'not_object'
        WHEN len(list_filter(['$.title', '$.doi', '$.year', '$.source'], lambda f: coalesce(json_type(fetch_result, f), 'NULL') IN ('ARRAY', 'OBJECT', 'BOOLEAN'))) > 0 THEN 'bad_field' ELSE 'ok' END AS state FROM articles""",
    "article_fingerprints": f"SELECT paper_key, {_FINGERPRINT} AS source_hash FROM articles",
    "changed_papers": f"""SELECT a.paper_key, CASE WHEN p.source_hash IS NULL THEN 'new' ELSE 'changed' END AS change
        FROM (SELECT paper_key, {_FINGERPRINT} AS h FROM articles) a LEFT JOIN papers p USING (paper_key) WHERE p.source_hash IS DISTINCT FROM a.h""",
    "upsert_outcomes": f"""WITH {_META}, x AS ({_RESOLVED}), y AS (
        SELECT CASE WHEN p.paper_key IS NULL THEN 'inserted' WHEN x.paper_key IS NULL THEN 'kept'
          WHEN (x.title, x.doi, x.year) IS DISTINCT FROM (p.title, p.doi, p.year) THEN 'updated' ELSE 'unchanged' END AS outcome
        FROM x FULL JOIN papers p USING (paper_key)) SELECT outcome, count(*) AS papers FROM y GROUP BY 1""",
    "source_chunk_rows": f"WITH {_SOURCE} SELECT id, paper_key, author, title, doi, year, chunk_index, section, section_kind, source_hash FROM s",
    "recent_chunks": f"WITH {_SOURCE} SELECT author, row_number() OVER (PARTITION BY author ORDER BY year DESC, title, chunk_index, id)::INT AS position, id FROM s QUALIFY position <= 8",
    "stale_chunk_hashes": f"WITH {_CHUNKS} SELECT id, CASE WHEN chunk_hash IS NULL THEN 'missing' ELSE 'different' END AS state FROM c WHERE chunk_hash IS NULL OR chunk_hash <> sha256(text)",
    "papers_per_author": "SELECT author, count(*) AS papers FROM papers GROUP BY 1",
    "library_status": f"""WITH {_LOGS}, f AS (SELECT paper_key, {_FINGERPRINT} AS h FROM articles)
        SELECT (SELECT count(*) FROM papers) AS papers, (SELECT count(DISTINCT author) FROM papers) AS authors,
          (SELECT count(*) FROM papers WHERE profile_status = 'succeeded') AS analysed, (SELECT count(*) FROM papers WHERE profile_status = 'failed') AS failed,
          (SELECT count(*) FROM f JOIN papers p USING (paper_key) WHERE p.source_hash <> h) AS stale, (SELECT count(DISTINCT id) FROM chunks) AS chunks,
          (SELECT count(*) FROM l) AS questions, (SELECT round(avg(latency_ms), 6) FROM l) AS mean_latency_ms, (SELECT sum(total_tokens)::BIGINT FROM l) AS total_tokens""",
    "redacted_keys": "SELECT paper_key, CASE WHEN length(source_hash) <= 8 THEN '********' ELSE source_hash[:4] || '...' || source_hash[-4:] END AS hidden FROM papers",
    "evidence_errors": f"WITH {_EVIDENCE} SELECT log_id, position, chunk_id, error FROM ee",
    "claim_errors": f"WITH {_ANSWERS}, {_CLAIMS} SELECT log_id, position, error FROM ce",
    "answer_verdicts": f"WITH {_EVIDENCE}, {_CLAIMS}, {_VERDICTS} SELECT v.log_id, CASE WHEN j IS NULL THEN 'unreadable' ELSE coalesce(error, 'valid') END AS verdict FROM v LEFT JOIN ff USING (log_id)",
    "best_chunks": f"""WITH {_SOURCE}, {_QUESTIONS}, {_terms('questions', 'query_id', ', author')}, rt AS (SELECT query_id, author, {_ranked_terms(rules.CHUNK_SYNONYMS)} AS rterms FROM terms), x AS (SELECT *, {_rank("concat_ws(' ', title, section, text)")} AS said2, {_rank("concat_ws(' ', section, text)")} AS said FROM s),
        y AS (SELECT query_id, paper_key, id, chunk_index, {_level(False)} AS level, said2, list_sum(list_transform(rterms, lambda t: {_occ('said2', 't')} * CASE WHEN contains(t, ' ') THEN 4 ELSE 1 END)) AS raw FROM x JOIN rt USING (author)),
        z AS (SELECT *, CASE WHEN {_occ('said2', "'google scholar'")} >= 2 OR {_occ('said2', "'pubmed'")} >= 2 OR {_occ('said2', "'article cas'")} >= 2 THEN raw // 8 ELSE raw END AS score FROM y)
        SELECT query_id, paper_key, id AS chunk_id, score::BIGINT AS score FROM z QUALIFY row_number() OVER (PARTITION BY query_id, paper_key ORDER BY score DESC, level, chunk_index, id) = 1""",
    "profile_retrieval": f"""WITH {_PROFILES}, {_RANKED_QUESTIONS}, {_PROFILE_SCORES}
        SELECT query_id, paper_key, row_number() OVER (PARTITION BY query_id ORDER BY (score > 0) DESC, score DESC, year DESC, title, paper_key)::INT AS position, score FROM py QUALIFY position <= 20""",
    "profile_claim_retrieval": f"""WITH {_PROFILES}, {_RANKED_QUESTIONS}, {_PROFILE_SCORES}
        SELECT query_id, paper_key, row_number() OVER (PARTITION BY query_id ORDER BY (score > 0) DESC, score DESC, year DESC, title, paper_key)::INT AS position, score FROM py QUALIFY position <= 20""",
    "pdf_normalised": r"""WITH e AS (SELECT DISTINCT ON (extract_id) extract_id, text FROM pdf_extracts)
        SELECT extract_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_hash FROM e""",
    "evidence_paths": f"""WITH {_EVIDENCE}, who AS (SELECT DISTINCT ON (id) id AS log_id, author, created_at FROM qa_logs WHERE id IS NOT NULL),
        tr AS (SELECT author, date_trunc('month', created_at) AS month, e.paper_key AS a, lead(e.paper_key) OVER (PARTITION BY author, date_trunc('month', created_at) ORDER BY created_at, log_id, position) AS b FROM er JOIN who USING (log_id) WHERE e.paper_key IS NOT NULL),
        r AS (SELECT DISTINCT * FROM tr WHERE b IS NOT NULL)
        SELECT DISTINCT x.author, x.a AS start, x.b AS via, y.b AS \"end\" FROM r x JOIN r y ON x.author = y.author AND x.month = y.month AND x.b = y.a WHERE x.a <> y.b""",
    "class_states": f"""WITH {_SOURCE}, st AS (SELECT s.id, s.author, min(CASE WHEN k.chunk_id IS NULL THEN 4 WHEN k.classifier_version IS DISTINCT FROM 'chunk-classifier-v1' THEN 3
          WHEN k.source_hash IS DISTINCT FROM s.source_hash THEN 2 WHEN k.chunk_hash IS DISTINCT FROM c.chunk_hash THEN 1 ELSE 0 END) AS level
          FROM s JOIN c USING (id) LEFT JOIN chunk_classifications k ON k.chunk_id = s.id GROUP BY 1, 2)
        SELECT author, (['current', 'other_text', 'other_source', 'other_version', 'missing'])[level + 1] AS state, count(*) AS chunks FROM st GROUP BY ALL""",
    "fact_report": f"WITH {_FACTS} SELECT fact_type, count(*) AS facts, count(DISTINCT paper_key) AS papers, count(DISTINCT author) AS authors FROM facts JOIN papers USING (paper_key) GROUP BY 1",
    "extraction_outcomes": f"WITH {_CLASSES} SELECT chunk_kind, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN usefulness_score < 0.5 THEN 'low_score' ELSE 'eligible' END AS outcome, count(*) AS chunks FROM k GROUP BY ALL",
    "profile_gate": f"""WITH {_PROFILES} SELECT p.author, count(*) AS papers, count(pr.facts) AS profiles, coalesce(sum(pr.facts), 0)::BIGINT AS facts, count(*) FILTER (pr.contributions + pr.limitations > 0) AS citing
        FROM papers p LEFT JOIN pr USING (paper_key) GROUP BY 1""",
    "paper_chunk_counts": f"WITH {_CHUNKS} SELECT p.paper_key, p.author, count(c.id) AS chunks, max(c.chunk_index) AS last_index FROM papers p LEFT JOIN c USING (paper_key) GROUP BY 1, 2",
    "logged_bm25_retrieval": f"WITH {_SOURCE}, questions AS (SELECT DISTINCT ON (id) id AS query_id, author, question FROM qa_logs WHERE id IS NOT NULL), {_terms('questions', 'query_id', ', author')}, {_BM25} SELECT query_id, position, chunk_id, round(route_score, 6) AS route_score FROM fts",
    "vector_coverage": f"""WITH {_SOURCE}, {_ITEMS}, ok AS (SELECT DISTINCT chunk_id, model, model_version FROM it WHERE len(vector) = 128 AND chunk_id IS NOT NULL AND len(list_filter(vector, lambda x: x <> 0)) > 0)
        SELECT author, model, model_version, count(*) AS chunks FROM ok JOIN s ON s.id = ok.chunk_id GROUP BY ALL""",
    "log_modes": f"""WITH {_ANSWERS}, ql AS (SELECT DISTINCT ON (id) id, qa_mode, route_reason FROM qa_logs WHERE id IS NOT NULL)
        SELECT qa_mode, route_reason, count(*) AS answers, count(j) AS readable, count(*) FILTER (json_array_length(j, '$.evidence') > 0) AS citing FROM ql JOIN v ON v.log_id = ql.id GROUP BY ALL""",
    "cleaned_bodies": f"SELECT paper_key, {_clean('raw_body')} AS text FROM articles WHERE raw_body IS NOT NULL",
    "noise_lines": f"""WITH {_CHUNKS}, x AS (SELECT id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM c),
        y AS (SELECT id, line_no, {_normal_line('line')} AS line FROM x) SELECT id, line_no, line FROM y WHERE {_noise('line', ['acs', 'elsevier', 'rsc'])}""",
    "article_sources": """SELECT paper_key, coalesce(metadata['source'], CASE WHEN json_valid(fetch_result) AND json_type(fetch_result, '$.source') = 'VARCHAR' THEN fetch_result ->> '$.source' END, '') AS source FROM articles""",
    "article_chunks": f"""WITH RECURSIVE {_SECTIONS},
        cy AS (SELECT paper_key, line_no, {_strip(r"regexp_replace(replace(replace(translate(line, ' ‐‑–—', ' ----'), '**', ''), '__', ''), '^[-* ]+', '')")} AS p FROM ln),
        cz AS (SELECT paper_key, line_no, p, regexp_matches(p, '{_CAP_EN}') AS en FROM cy),
        cc AS (SELECT paper_key, line_no, CASE WHEN en THEN CASE WHEN lower(regexp_extract(p, '{_CAP_EN}', 1)) = 'table' THEN 'Table ' ELSE 'Figure ' END || regexp_extract(p, '{_CAP_EN}', 2) ELSE regexp_extract(p, '{_CAP_CJK}', 1) || ' ' || regexp_extract(p, '{_CAP_CJK}', 2) END AS label,
          CASE WHEN en THEN regexp_extract(p, '{_CAP_EN}', 3) ELSE regexp_extract(p, '{_CAP_CJK}', 3) END AS caption FROM cz WHERE en OR regexp_matches(p, '{_CAP_CJK}')),
        every AS (SELECT paper_key, 0 AS part, position AS ord, title, content, NULL AS label FROM sections
          UNION ALL SELECT paper_key, CASE WHEN label LIKE 'Table %' OR label LIKE '表 %' THEN 2 ELSE 1 END, line_no, label || ' Caption', {_clean("CASE WHEN caption = '' THEN label ELSE label || ': ' || caption END")}, label FROM cc),
        d AS (SELECT paper_key, part, ord, title, label, {_strip('content')} AS t FROM every),
        w AS (SELECT *, length(t) AS n, 0 AS start FROM d WHERE length(t) > 0),
        cut AS (SELECT paper_key, part, ord, title, label, t, n, start, 0 AS step, CASE WHEN n <= 3200 THEN n ELSE {_cut('start', 3200)} END AS stop FROM w
          UNION ALL SELECT paper_key, part, ord, title, label, t, n, nstart, step + 1, CASE WHEN nstart + 3200 >= n THEN n ELSE {_cut('nstart', 3200)} END
          FROM (SELECT *, greatest(stop - 350, start + 1) AS nstart FROM cut WHERE stop < n)),
        p AS (SELECT paper_key, part, ord, step, title, label, {_strip('t[start + 1:stop]')} AS piece FROM cut)
        SELECT paper_key, (row_number() OVER (PARTITION BY paper_key ORDER BY part, ord, step) - 1)::INT AS chunk_index, title AS section,
          CASE part WHEN 1 THEN 'figure_caption' WHEN 2 THEN 'table_caption' ELSE 'body' END AS section_kind, label AS caption_label,
          CASE part WHEN 1 THEN 'figure' WHEN 2 THEN 'table' END AS object_type, regexp_replace(string_split(label, ' ')[2], '([0-9])[A-Za-z]$', '\\1') AS object_label,
          length(piece)::INT AS characters, sha256(piece) AS chunk_hash FROM p WHERE piece <> ''""",
    "article_sections": f"WITH {_SECTIONS} SELECT * FROM sections",
    "section_facts": f"WITH {_SECTIONS}, x AS (SELECT {_SECTION_FACT} AS kind, content FROM sections) SELECT kind, count(*) AS sections, sum(length(content))::BIGINT AS characters FROM x WHERE kind IS NOT NULL GROUP BY 1",
    "analysis_contexts": f"""WITH {_SECTIONS}, x AS (SELECT paper_key, string_agg(content, chr(10) || chr(10) ORDER BY position) AS whole,
        string_agg('## ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY position) FILTER (lower(title) IN ({_PREFERRED})) AS chosen FROM sections GROUP BY 1)
        SELECT paper_key, left(CASE WHEN chosen IS NULL THEN whole ELSE chosen || chr(10) || chr(10) || '## Tail Context' || chr(10) || right(whole, 5000) END, 12000) AS context FROM x""",
    "hybrid_retrieval": f"WITH {_HYBRID} SELECT * FROM hybrid",
    "retrieval_trace": f"WITH {_HYBRID} SELECT query_id, route, count(*) AS candidates, arg_min(chunk_id, (position, chunk_id)) AS top_chunk FROM allr GROUP BY 1, 2",
    "answer_contexts": f"""WITH {_HYBRID}, np AS (SELECT author, count(*) AS profiles FROM pr GROUP BY 1),
        pl AS (SELECT query_id, coalesce(profiles, 0) > 0 AND NOT {_any("lower(question)", rules.DETAIL_KEYWORDS)} AS first FROM questions LEFT JOIN np USING (author)),
        fi AS (SELECT query_id, position, chunk_id, 'profile' AS origin FROM profile JOIN pl USING (query_id) WHERE first AND position <= 8),
        un AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position, chunk_id) AS n FROM profile WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM hybrid) QUALIFY n <= 2),
        tc AS (SELECT query_id, count(*) AS tails FROM un GROUP BY 1),
        kp AS (SELECT query_id, chunk_id, position, 'hybrid' AS origin FROM hybrid LEFT JOIN tc USING (query_id) WHERE position <= 8 - coalesce(tails, 0) UNION ALL SELECT query_id, chunk_id, n + 1000, 'profile' FROM un),
        tl AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY position, chunk_id)::INT AS position, chunk_id, origin FROM kp),
        fd AS (SELECT * FROM fi UNION ALL SELECT * FROM tl WHERE query_id NOT IN (SELECT query_id FROM fi)),
        rc AS (SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY year DESC, title, chunk_index, id)::INT AS position FROM s QUALIFY position <= 8)
        SELECT * FROM fd UNION ALL SELECT query_id, position, rc.id, 'recent' FROM questions JOIN rc USING (author) WHERE query_id NOT IN (SELECT query_id FROM fd)""",
    "golden_cases": f"WITH {_HYBRID}, {_cases('hybrid', 'ca')} SELECT * FROM ca",
    "golden_summary": f"WITH {_HYBRID}, {_cases('hybrid', 'ca')} SELECT {_SUMMARY} FROM ca",
    "golden_route_rates": f"""WITH {_HYBRID}, rr AS (SELECT route, query_id, count(*) AS n, bool_or(list_contains(must_cite, paper_key) OR len(must_cite) = 0) AS hit
        FROM allr JOIN s ON s.id = chunk_id JOIN golden_items ON item_id = query_id GROUP BY 1, 2)
        SELECT route, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / (SELECT count(*) FROM golden_items), 6) AS hit_rate, round(sum(n) / (SELECT count(*) FROM golden_items), 6) AS mean_candidates FROM rr GROUP BY 1""",
    "golden_comparison": f"""WITH {_HYBRID}, {_LEXICAL}, {_cases('lexical', 'cb')}, {_cases('hybrid', 'ca')}, sb AS (SELECT {_SUMMARY} FROM cb), sa AS (SELECT {_SUMMARY} FROM ca),
        u3 AS (SELECT 'hit_at_k' AS metric, sb.hit_at_k AS before, sa.hit_at_k AS after, 0.0 AS most, 1.0 AS least FROM sb, sa UNION ALL SELECT 'mean_precision', sb.mean_precision, sa.mean_precision, 0.02, 0.4 FROM sb, sa
          UNION ALL SELECT 'coverage', sb.coverage, sa.coverage, 0.0, 1.0 FROM sb, sa)
        SELECT metric, before, after, round(before - after, 6) AS drop, round(before - after, 6) > most OR after < least AS blocked FROM u3""",
    "caption_lines": rf"""WITH {_CHUNKS}, x AS (SELECT id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM c),
        y AS (SELECT id, line_no, {_strip(r"regexp_replace(replace(replace(translate(line, ' ‐‑–—', ' ----'), '**', ''), '__', ''), '^[-* ]+', '')")} AS p FROM x),
        z AS (SELECT id, line_no, p, regexp_matches(p, '{_CAP_EN}') AS en FROM y)
        SELECT id, line_no, CASE WHEN en THEN CASE WHEN lower(regexp_extract(p, '{_CAP_EN}', 1)) = 'table' THEN 'Table ' ELSE 'Figure ' END || regexp_extract(p, '{_CAP_EN}', 2) ELSE regexp_extract(p, '{_CAP_CJK}', 1) || ' ' || regexp_extract(p, '{_CAP_CJK}', 2) END AS label,
          CASE WHEN en THEN regexp_extract(p, '{_CAP_EN}', 3) ELSE regexp_extract(p, '{_CAP_CJK}', 3) END AS caption FROM z WHERE en OR regexp_matches(p, '{_CAP_CJK}')""",
    "caption_values": rf"""WITH {_CHUNKS}, x AS (SELECT id, regexp_extract_all(text, '({_NUMBER}\s?{_UNIT})', 1) AS m, regexp_extract_all(text, '(?i)((?:{_METRICS})(?: (?:of|is|are|was|were|near|reached|showed|gave))* {_NUMBER}\s?{_UNIT})', 1) AS v
          FROM c WHERE section_kind IN ('figure_caption', 'table_caption')) SELECT id, array_to_string({_unique('m').replace("list_filter(m, lambda t", "list_filter(m, lambda t")}, '; ') AS measurements, array_to_string({_unique('v')}, '; ') AS named FROM x""",
    "caption_objects": f"WITH {_OBJECTS} {_OBJECT_ROWS}",
    "local_vector_retrieval": f"WITH {_SOURCE}, {_QUESTIONS}, {_LOCAL} SELECT * FROM local",
    "split_documents": f"""WITH RECURSIVE d AS (SELECT doc_id, {_strip('text')} AS t FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, t, length(t) AS n, 0 AS start FROM d WHERE length(t) > 0),
        cut AS (SELECT doc_id, t, n, start, 0 AS step, CASE WHEN n <= 800 THEN n ELSE {_CUT} END AS stop FROM w
          UNION ALL SELECT doc_id, t, n, nstart, step + 1, CASE WHEN nstart + 800 >= n THEN n ELSE {_CUT.replace('start', 'nstart')} END
          FROM (SELECT *, greatest(stop - 100, start + 1) AS nstart FROM cut WHERE stop < n))
        , p AS (SELECT doc_id, step, {_strip('t[start + 1:stop]')} AS piece FROM cut)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS piece, length(piece)::INT AS characters, sha256(piece) AS chunk_hash FROM p WHERE piece <> ''""",
    "question_terms": f"WITH {_LOGS}, {_terms('l', 'id')} SELECT id, array_to_string(terms, '|') AS terms FROM terms",
    "question_match_strings": f"""WITH {_LOGS}, {_terms('l', 'id')}
        SELECT id, array_to_string(list_transform(terms[:12], lambda t: '"' || replace(t, '"', '""') || '"'), ' OR ') AS match FROM terms""",
    "question_intents": f"""WITH {_LOGS}, {_terms('l', 'id')}, z AS (SELECT id, lower(array_to_string(terms, ' ')) AS low FROM terms),
        y AS (SELECT id, low, regexp_split_to_array(low, '[^a-z0-9_-]+') AS w FROM z) SELECT id, array_to_string({_intents()}, ',') AS intents FROM y""",
    "question_rank_terms": f"WITH {_LOGS}, {_terms('l', 'id')} SELECT id, array_to_string({_RANKED_TERMS}, '|') AS terms FROM terms",
    "question_plans": f"""WITH {_LOGS}, n AS (SELECT author, count(*) AS papers FROM papers GROUP BY 1),
        x AS (SELECT id, question, coalesce(papers, 0) AS papers, {_any('lower(question)', rules.DETAIL_KEYWORDS)} AS detail FROM l LEFT JOIN n USING (author))
        SELECT id, CASE WHEN papers = 0 OR detail THEN 'source_evidence' ELSE 'profile_first' END AS qa_mode,
          CASE WHEN papers = 0 THEN 'profile_missing' WHEN detail THEN 'detail_keyword' ELSE 'broad_profile_context' END AS route_reason,
          CASE WHEN regexp_matches(question, '[㐀-䶿一-鿿豈-﫿]') THEN 'zh-Hans' ELSE 'en' END AS language,
          {_any('lower(question)', rules.EVIDENCE_KEYWORDS)} AS asks_for_evidence FROM x""",
    "chunk_classes": f"WITH {_CLASSES} SELECT chunk_id, chunk_kind, usefulness_score, skip_reason FROM k",
    "chunk_class_report": f"WITH {_CLASSES} SELECT chunk_kind, coalesce(skip_reason, '') AS skip_reason, count(*) AS chunks FROM k GROUP BY ALL",
    "pending_classification": f"""WITH {_CHUNKS} SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM chunk_classifications x WHERE x.chunk_id = c.id AND x.chunk_hash = sha256(c.text))""",
    "class_agreement": f"""WITH {_CLASSES}, u AS (SELECT chunk_id, max({{'a': classified_at, 'b': classifier_version, 's': chunk_kind}}).s AS stored_kind FROM chunk_classifications GROUP BY 1)
        SELECT chunk_kind, stored_kind, count(*) AS chunks FROM k JOIN u USING (chunk_id) GROUP BY 1, 2""",
    "chunk_facts": f"WITH {_FACTS} SELECT claim_uid, chunk_id, fact_type, confidence FROM facts JOIN papers USING (paper_key)",
    "ranked_facts": f"WITH {_FACTS} SELECT paper_key, rank_position, fact_type, claim_uid FROM r JOIN papers USING (paper_key)",
    "paper_profiles": f"""WITH {_PROFILES} SELECT paper_key, facts, one_sentence_summary, contribution_types, array_to_string(topic_keywords, ',') AS topic_keywords, contributions, limitations FROM pr""",
    "profile_faults": f"""WITH {_PROFILES}, z AS (SELECT paper_key, lower(title || ' ' || one_sentence_summary || ' ' || array_to_string(topic_keywords, ' ')) AS said, title, one_sentence_summary AS o, topic_keywords AS tk FROM pr),
        y AS (SELECT paper_key, unnest(list_filter([CASE WHEN trim(title) = '' THEN 'empty_title' END, CASE WHEN trim(o) = '' THEN 'empty_summary' END, CASE WHEN len(tk) = 0 THEN 'no_keywords' END,
          CASE WHEN {_any('said', rules.INSTRUCTION_PHRASES)} THEN 'instruction' END], lambda t: t IS NOT NULL)) AS fault FROM z)
        SELECT coalesce(fault, 'none') AS fault, count(*) AS papers FROM z LEFT JOIN y USING (paper_key) GROUP BY 1""",
    "instructing_texts": f"""WITH {_CHUNKS}, {_LOGS}, u4 AS (SELECT 'chunk' AS origin, coalesce(text, '') AS t FROM c UNION ALL SELECT 'log', coalesce(question, '') FROM l UNION ALL SELECT 'document', coalesce(text, '') FROM documents)
        SELECT origin, {_any('lower(t)', rules.INSTRUCTION_PHRASES)} AS instructs, count(*) AS texts FROM u4 GROUP BY ALL""",
    "author_themes": f"""WITH {_PROFILES}, th AS (SELECT author, {_squash("lower(coalesce(topic_keywords[1], nullif(string_split(contribution_types, ',')[1], ''), 'general research'))")} AS theme, paper_key, year, title FROM pr),
        o2 AS (SELECT *, row_number() OVER (PARTITION BY author, theme ORDER BY year DESC, title, paper_key) AS n FROM th)
        SELECT author, theme, count(*) AS papers, coalesce(min(nullif(year, '')), 'unknown') AS first_year, coalesce(max(nullif(year, '')), 'unknown') AS last_year,
          string_agg(paper_key, ',' ORDER BY n) FILTER (n <= 12) AS works FROM o2 GROUP BY 1, 2""",
    "keyword_overview": f"WITH {_PROFILES} SELECT keyword, count(*) AS papers FROM (SELECT unnest(topic_keywords) AS keyword FROM pr) GROUP BY 1 ORDER BY papers DESC, keyword LIMIT 20",
    "profile_changes": f"""WITH {_META}, x AS ({_RESOLVED}) SELECT CASE WHEN x.paper_key IS NULL THEN 'only_before' WHEN p.paper_key IS NULL THEN 'only_after'
        WHEN (x.title, x.doi, x.year) IS NOT DISTINCT FROM (p.title, p.doi, p.year) THEN 'same' ELSE 'changed' END AS change, count(*) AS papers
        FROM x FULL JOIN papers p USING (paper_key) GROUP BY 1""",
    "like_retrieval": f"WITH {_SOURCE}, {_LIKE} SELECT * FROM liked",
    "bm25_retrieval": f"WITH {_SOURCE}, {_QUESTIONS}, {_terms('questions', 'query_id', ', author')}, {_BM25} SELECT query_id, position, chunk_id, round(route_score, 6) AS route_score FROM fts",
    "fused_lexical": f"""WITH {_SOURCE}, {_LIKE}, {_BM25}, u AS (SELECT * FROM fts UNION ALL SELECT * FROM liked),
        x AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / ({rules.RRF_OFFSET} + position)), 12) AS rrf_score, min(position) FILTER (route = 'fts' AND position <= {rules.LEXICAL_SEEDS}) AS seed FROM u GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seed ASC NULLS LAST, rrf_score DESC, chunk_id)::INT AS position, chunk_id, rrf_score, seed FROM x QUALIFY position <= 8""",
    "fact_retrieval": f"""WITH {_FACTS}, s AS (SELECT c.id, p.author, concat_ws(' ', p.title, coalesce(p.doi, ''), c.section, c.text) AS body FROM c JOIN papers p USING (paper_key)),
        {_QUESTIONS}, {_terms('questions', 'query_id', ', author')}, z AS (SELECT query_id, author, terms, lower(array_to_string(terms, ' ')) AS low FROM terms),
        y AS (SELECT query_id, author, terms, low, regexp_split_to_array(low, '[^a-z0-9_-]+') AS w FROM z), ti AS (SELECT query_id, author, terms, {_intents()} AS intents FROM y),
        fb AS (SELECT s.id, s.author, fact_type, lower(concat_ws(' ', fact_type, claim, body)) AS t FROM facts JOIN s ON s.id = facts.chunk_id),
        sc AS (SELECT query_id, fb.id, fact_type, list_sum(list_transform(terms, lambda x: {_occ('t', 'lower(x)')})) + CASE WHEN list_contains(intents, fact_type) THEN 3 ELSE 0 END AS score
          FROM fb JOIN ti USING (author) WHERE len(intents) = 0 OR list_contains(intents, fact_type))
        SELECT query_id, 'fact' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id, fact_type)::INT AS position, id AS chunk_id, score::DOUBLE AS route_score
        FROM sc WHERE score > 0 QUALIFY position <= {rules.ROUTE_LIMIT}""",
    "dense_retrieval": """WITH q AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
        x AS (SELECT query_id, e.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(q, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
          FROM q JOIN embeddings e USING (label) WHERE len(q) = len(embedding))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS position, chunk_id, round(score, 5) AS route_score FROM x WHERE score > 0 QUALIFY position <= 10""",
    "representative_chunks": f"""WITH {_SOURCE}, x AS (SELECT *, {_rank("concat_ws(' ', section, text)")} AS said FROM s), y AS (SELECT paper_key, id, chunk_index, {_level(True)} AS level FROM x)
        SELECT paper_key, id AS chunk_id, level::INT AS level FROM y QUALIFY row_number() OVER (PARTITION BY paper_key ORDER BY level, chunk_index, id) = 1""",
    "response_items": f"WITH {_ITEMS} SELECT response_id, position, chunk_id, model, model_version, len(vector)::INT AS numbers FROM it WHERE chunk_id IS NOT NULL",
    "latest_vectors": f"""WITH {_ITEMS} SELECT model, model_version, count(DISTINCT chunk_id) AS chunks FROM it WHERE chunk_id IS NOT NULL AND len(vector) = 128
        AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1, 2""",
    "pending_embeddings": f"""WITH {_ITEMS}, h AS (SELECT DISTINCT chunk_id FROM it WHERE chunk_id IS NOT NULL AND model = 'pe-wide' AND model_version = 'v2' AND len(vector) = 128
        AND len(list_filter(vector, lambda x: x <> 0)) > 0) SELECT DISTINCT id FROM chunks WHERE id NOT IN (SELECT chunk_id FROM h)""",
    "vector_norms": "SELECT vec_id, round(CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 THEN 1.0 ELSE 0.0 END, 4) AS norm2 FROM embeddings",
    "vector_codec": "SELECT true AS equal, count(*) AS vectors FROM embeddings",
    "parsed_answers": f"""WITH {_ANSWERS} SELECT log_id, j IS NOT NULL AS readable, coalesce(json_array_length(j, '$.evidence'), -1)::INT AS evidence,
        coalesce(json_array_length(j, '$.claims'), -1)::INT AS claims FROM v""",
    "log_totals": f"WITH {_LOGS} SELECT {_TOTALS} FROM l",
    "log_totals_by_author": f"WITH {_LOGS} SELECT author, {_TOTALS} FROM l GROUP BY 1",
    "log_trend": f"""WITH {_LOGS} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS questions, count(*) FILTER (coalesce(error_code, '') <> '') AS errors,
        count(*) FILTER (delivery_mode = 'streaming') AS streamed, count(*) FILTER (delivery_mode = 'streaming' AND NOT coalesce(streaming_finalized, false)) AS unfinished,
        round(avg(latency_ms), 6) AS mean_latency_ms, sum(total_tokens)::BIGINT AS total_tokens FROM l GROUP BY 1 ORDER BY day DESC LIMIT 30""",
    "log_errors": f"WITH {_LOGS} SELECT error_code, count(*) AS questions FROM l WHERE coalesce(error_code, '') <> '' GROUP BY 1",
    "latest_logs": f"WITH {_LOGS} SELECT author, id, question FROM l QUALIFY row_number() OVER (PARTITION BY author ORDER BY id DESC) = 1",
    "log_rollup": f"WITH {_LOGS} SELECT qa_mode, delivery_mode, count(*) AS questions, grouping_id(qa_mode, delivery_mode)::BIGINT AS levels FROM l GROUP BY ROLLUP (qa_mode, delivery_mode)",
    "log_latencies": f"""WITH {_LOGS} SELECT qa_mode, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM l WHERE latency_ms IS NOT NULL GROUP BY 1""",
    "log_sessions": f"""WITH {_LOGS}, x AS (SELECT author, id, created_at, epoch(created_at)::BIGINT - epoch(lag(created_at) OVER (PARTITION BY author ORDER BY created_at, id))::BIGINT AS gap FROM l),
        y AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY author ORDER BY created_at, id) AS session FROM x)
        SELECT author, session::BIGINT AS session, min(created_at) AS started, count(*) AS questions FROM y GROUP BY 1, 2""",
    "log_windows": f"""WITH {_LOGS} SELECT date_trunc('day', created_at)::TIMESTAMP AS start, qa_mode, count(*) AS questions, (count(*) FILTER (coalesce(error_code, '') <> ''))::BIGINT AS errors,
        sum(total_tokens)::BIGINT AS total_tokens FROM l GROUP BY 1, 2""",
}
ORACLE = {name: sql for name, sql in ORACLE.items() if sql is not None}
