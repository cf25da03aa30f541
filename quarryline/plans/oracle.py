"""SQL that states what the registered queries return, for DuckDB."""

from __future__ import annotations

from quarryline.operators.ignore import DENIED_DIRS, DENIED_EXTENSIONS
from quarryline.operators.prose import SECRETS
from quarryline.plans import codebase_oracle
from quarryline.plans.queries import NOW, PHRASE, WINDOW

#: Windows of lines of every document as chunks.
CHUNKS = rf"""
docs AS (
    SELECT doc_id, source, lang, source || '/' || doc_id || '.txt' AS path, text, string_split(text, E'\n') AS lines FROM documents
), windows AS (
    SELECT path, source, lines, unnest(range(0, (len(lines) - 1) // {WINDOW} + 1)) AS ord FROM docs
), all_chunks AS (
    SELECT path, ord::INTEGER AS ord, (ord * {WINDOW} + 1)::INTEGER AS start_line, least((ord + 1) * {WINDOW}, len(lines))::INTEGER AS end_line,
           array_to_string(lines[ord * {WINDOW} + 1:(ord + 1) * {WINDOW}], E'\n') AS body,
           'file: ' || path || E'\nmodule: ' || source || E'\nlang: text' AS header
    FROM windows
), chunks AS (
    SELECT *, substr(sha256(header || E'\n---\n' || body), 1, 32) AS content_hash, ceil(length(body) / 4.0)::INTEGER AS n_tokens
    FROM all_chunks WHERE regexp_matches(body, '\S')
)"""


def forms(raw: str) -> str:
    """All token forms of a raw token, as a list expression."""
    parts = rf"[p for p in regexp_split_to_array({raw}, '[_\-./]+') if p <> '']"
    cased = r"regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    words = f"flatten([[lower(w) for w in string_split({cased}, ' ')] for p in {parts}])"
    return f"list_distinct([lower({raw})] || [lower(p) for p in {parts}] || {words} || CASE WHEN len({words}) > 1 THEN [array_to_string({words}, '')] ELSE [] END)"


def ordered_forms(raw: str) -> str:
    """The same forms in the order that they are made, repeats included."""
    parts = rf"[p for p in regexp_split_to_array({raw}, '[_\-./]+') if p <> '']"
    cased = r"string_split(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ')"
    words = f"flatten([[lower(w) for w in {cased}] for p in {parts}])"
    return f"[lower({raw})] || flatten([[lower(p)] || [lower(w) for w in {cased}] for p in {parts}]) || CASE WHEN len({words}) > 1 THEN [array_to_string({words}, '')] ELSE [] END"


RAWS = "[r for r in regexp_split_to_array({0}, '[^A-Za-z0-9_.$/-]+') if r <> '']"
FTS = r"[w for w in regexp_split_to_array(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}]+') if w <> '']"
IDENTS = r"list_distinct([lower(r) for r in regexp_split_to_array({0}, '[^A-Za-z0-9_.$/-]+') if length(r) BETWEEN 4 AND 80 AND (regexp_matches(r, '[a-z][A-Z]') OR contains(r, '_') OR contains(r, '.') OR regexp_matches(r, '^[A-Z0-9_]+$'))])"


def _occurrences(column: str, phrase: list[str]) -> str:
    more = "".join(f" AND {column}[i + {k}] = '{w}'" for k, w in enumerate(phrase[1:], 1))
    return f"coalesce(len([w for w, i in {column} if w = '{phrase[0]}'{more}]), 0)"


def fts_rows(chunks: str = CHUNKS) -> str:
    """CTEs up to ``fts`` (content_hash, body_w, header_w, token_w)."""
    return rf"""{chunks}, raws AS (
    SELECT content_hash, unnest(raws) AS raw, generate_subscripts(raws, 1) AS nth FROM (SELECT content_hash, {RAWS.format("header || E'" + chr(92) + "n' || body")} AS raws FROM chunks)
), vocabulary AS (
    SELECT raw, {ordered_forms("raw")} AS forms FROM (SELECT DISTINCT raw FROM raws)
), tokens AS (
    SELECT content_hash, form, min((nth, pos)) AS first FROM (SELECT content_hash, nth, unnest(forms) AS form, generate_subscripts(forms, 1) AS pos FROM raws JOIN vocabulary USING (raw)) GROUP BY content_hash, form
), token_words AS (
    SELECT content_hash, flatten(list({FTS.format("form")} ORDER BY first)) AS token_w FROM tokens GROUP BY content_hash
), fts AS (
    SELECT c.content_hash, {FTS.format("c.body")} AS body_w, {FTS.format("c.header")} AS header_w, t.token_w
    FROM (SELECT DISTINCT content_hash, header, body FROM chunks) c LEFT JOIN token_words t USING (content_hash)
)"""


def bm25(terms: list[list[str]], where: str = "true", chunks: str = CHUNKS) -> str:
    """CTEs up to ``hits`` (content_hash, score) for phrases of words."""
    counts = ", ".join(f"{_occurrences('body_w', t)} + 2.0 * {_occurrences('header_w', t)} + 1.5 * {_occurrences('token_w', t)} AS f{i}" for i, t in enumerate(terms))
    totals = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(terms)))
    return rf"""{fts_rows(chunks)}, counted AS (
    SELECT content_hash, len(body_w) + len(header_w) + coalesce(len(token_w), 0) AS length, {counts} FROM fts
), totals AS (
    SELECT count(*)::DOUBLE AS n, avg(length) AS mean, {totals} FROM counted
), hits AS (
    SELECT content_hash, {score} AS score FROM counted, totals WHERE {" OR ".join(f"f{i} > 0" for i in range(len(terms)))}
), bm25 AS (
    SELECT c.path, c.start_line, c.end_line, c.content_hash, round(h.score, 6) AS score FROM hits h JOIN chunks c USING (content_hash) WHERE {where}
)"""


#: ``fused``: ranks of every query by configuration, for queries of single plain words.
BATCH = rf"""{fts_rows()}, asked AS (
    SELECT doc_id AS query_id, source || '/' || doc_id || '.txt' AS own, list_distinct_in_order[1:CASE WHEN doc_id % 200 = 0 THEN 1 ELSE 2 END] AS terms
    FROM (SELECT doc_id, source, [x for x, i in w if list_position(w, x) = i] AS list_distinct_in_order FROM (SELECT doc_id, source, [x for x in string_split(text, ' ') if regexp_full_match(x, '[a-z]{{6,}}')] AS w FROM documents WHERE doc_id % 100 = 0))
    WHERE len(list_distinct_in_order) > 1
), lengths AS (
    SELECT *, len(body_w) + len(header_w) + coalesce(len(token_w), 0) AS length FROM fts
), totals AS (
    SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM lengths
), f AS (
    SELECT query_id, term, content_hash, length, len([w for w in body_w if w = term]) + 2.0 * len([w for w in header_w if w = term]) + 1.5 * coalesce(len([w for w in token_w if w = term]), 0) AS f
    FROM lengths, (SELECT query_id, unnest(terms) AS term FROM asked)
), idf AS (
    SELECT query_id, term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM f, totals WHERE f > 0 GROUP BY query_id, term, n
), scored AS (
    SELECT query_id, content_hash, sum(CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM f JOIN idf USING (query_id, term), totals WHERE f > 0 GROUP BY query_id, content_hash
), arms AS (
    SELECT query_id, path, start_line, end_line, 0 AS arm, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, start_line) AS rank FROM scored JOIN chunks USING (content_hash) QUALIFY rank <= 30
    UNION ALL
    SELECT query_id, path, start_line, end_line, 1, row_number() OVER (PARTITION BY query_id ORDER BY path, start_line) AS rank
    FROM (SELECT *, {IDENTS.format("body")} AS idents FROM chunks) JOIN asked ON len(terms) = 1 AND contains(array_to_string(idents, ' '), terms[1]) QUALIFY rank <= 30
), fused AS (
    SELECT config, query_id, path, start_line, end_line, round(sum(([1.0, 0.7]::DOUBLE[])[arm + 1] / (60 + rank)), 9) AS score, string_agg(['bm25', 'trigram'][arm + 1], '+' ORDER BY arm) AS matched, min((arm, rank)) AS first
    FROM arms, (SELECT unnest([['all', '2'], ['without bm25', '0'], ['without trigram', '1']]) AS c), LATERAL (SELECT c[1] AS config) WHERE arm <> c[2]::INTEGER GROUP BY config, query_id, path, start_line, end_line
), best AS (
    SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, first, path, start_line, end_line)::INTEGER AS rank FROM fused QUALIFY rank <= 10
)"""

_TERMS = [[w] for w in PHRASE.lower().split()]
_SPAN_ID = "'sp_' || substr(sha256(content_hash || ':' || path || ':' || start_line || ':' || end_line), 1, 12)"

EVENTS = """
events_ AS (
    SELECT 'u' || user_id AS path, event_type AS kind, CASE WHEN event_id % 11 <> 0 THEN (event_id % 7 * 5)::INTEGER END AS priority,
           epoch_us(ts) // 1000 AS enqueued_at, CASE WHEN event_id % 4 <> 0 THEN props END AS payload, event_id AS seq
    FROM events
), jobs AS (
    SELECT seq AS id, path, kind, coalesce(priority, 5) AS priority, ['pending', 'running', 'running', 'dead'][(seq % 4 + 1)::INTEGER] AS state, enqueued_at,
           CASE WHEN seq % 4 IN (1, 2) THEN enqueued_at + 30000 END AS lease_until, CASE WHEN seq % 4 IN (1, 2) THEN 'w1' END AS worker,
           (seq % 6)::INTEGER AS attempts, payload
    FROM events_
)"""

LINKS = r"""
p AS (
    SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://([^/?#]*)', 1) || '/' || regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) AS source, html FROM pages
), nodes AS (
    SELECT source AS id, count(*) AS weight FROM p GROUP BY 1
), pairs AS (
    SELECT source, host || '/' || href AS target FROM (SELECT source, host, unnest(regexp_extract_all(html, 'href="/([^"/?#]*)', 1)) AS href FROM p) WHERE host || '/' || href IN (SELECT id FROM nodes)
), links AS (
    SELECT source, target, count(*) AS weight FROM pairs WHERE source <> target GROUP BY 1, 2
), ends AS (
    SELECT source AS id FROM links UNION SELECT target FROM links
)"""

_PATHS = "['src/a.ts', 'node_modules/x.js', 'app.min.js', 'notes.tmp', '.#lock', 'a/b/dist/c.py', 'logo.PNG', 'x~', 'docs/readme.md', '4913', 'src/.cache', '']"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _redact() -> str:
    text = "text"
    for kind, pattern in SECRETS:
        text = "regexp_replace({}, '{}', '[redacted:{}]', 'g')".format(text, pattern.replace("'", "''"), kind)
    return text


#: The phrases of ``LANTERN_3``: as a whole, its parts, its parts joined.
_NAME_PHRASES = [["lantern", "3"], ["lantern"], ["3"], ["lantern3"]]
CODE_SEARCH = rf"""
WITH {bm25(_NAME_PHRASES, chunks=codebase_oracle.CODE_CHUNKS)}, b AS (
    SELECT path, start_line, end_line, content_hash, 0 AS arm, row_number() OVER (ORDER BY score DESC, path, start_line) AS rank FROM bm25 QUALIFY rank <= 30
), t AS (
    SELECT path, start_line, end_line, content_hash, 1 AS arm, row_number() OVER (ORDER BY path, start_line) AS rank FROM chunks
    WHERE contains(array_to_string({IDENTS.format("body")}, ' '), 'lantern_3') QUALIFY rank <= 30
), s AS (
    SELECT path, start_line, end_line, NULL AS content_hash, 2 AS arm, row_number() OVER (ORDER BY lower(name) = 'lantern_3' DESC, exported DESC, length(name), path, start_line) AS rank FROM symbols
    WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') IN ('lantern3', 'lantern') QUALIFY rank <= 30
), fused AS (
    SELECT path, start_line, end_line, round(sum(([1.0, 0.7, 1.3]::DOUBLE[])[arm + 1] / (60 + rank)), 9) AS score,
           string_agg(['bm25', 'trigram', 'symbol'][arm + 1], '+' ORDER BY arm, rank) AS matched, min((arm, rank)) AS first
    FROM (SELECT * FROM b UNION ALL SELECT * FROM t UNION ALL SELECT * FROM s) GROUP BY path, start_line, end_line
)
SELECT row_number() OVER (ORDER BY score DESC, first, path, start_line, end_line)::INTEGER AS rank, path, start_line, end_line, matched, round(score, 6) AS score
FROM fused QUALIFY rank <= 10"""

#: Tokens of ``PHRASES`` as phrases: each as a whole, its parts, its parts joined.
_PHRASES = [["public", "license"], ["public"], ["license"], ["publiclicense"], ["foundation", "software"], ["foundation"], ["software"], ["foundationsoftware"]]
PHRASE_HITS = f"WITH {bm25(_PHRASES)} SELECT path, start_line, score FROM bm25 ORDER BY score DESC, path, start_line LIMIT 30"

PACKED = """
spans AS (
    SELECT conv_id, (turn + 1)::INTEGER AS rank, role || (turn % 4) AS path, ceil(length(text) / 4.0)::INTEGER + 32 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations
), fold AS (
    SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS tokens, []::VARCHAR[] AS paths, []::STRUCT(rank INTEGER, path VARCHAR, cost INTEGER)[] AS kept FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT f.conv_id, s.n, CASE WHEN take THEN f.tokens + s.cost ELSE f.tokens END, CASE WHEN take THEN list_distinct(f.paths || [s.path]) ELSE f.paths END,
           CASE WHEN take THEN f.kept || [{'rank': s.rank, 'path': s.path, 'cost': s.cost}] ELSE f.kept END
    FROM fold f JOIN spans s ON s.conv_id = f.conv_id AND s.n = f.n + 1,
         LATERAL (SELECT NOT (f.tokens + s.cost > 400 OR (list_contains(f.paths, s.path) AND len(f.paths) < 3)) AS take)
), sizes AS (SELECT conv_id, count(*) AS n FROM spans GROUP BY conv_id
), packed AS (
    SELECT f.conv_id, f.kept, f.tokens::INTEGER AS tokens, len(f.kept) < f.n AS truncated FROM fold f JOIN sizes z ON z.conv_id = f.conv_id AND z.n = f.n
)"""

SQL: dict[str, str] = {
    **codebase_oracle.SQL,
    "code_search": CODE_SEARCH,
    "tokenize_docs": f"""
WITH raws AS (SELECT DISTINCT doc_id, unnest({RAWS.format("text")}) AS raw FROM documents),
vocabulary AS (SELECT raw, {forms("raw")} AS forms FROM (SELECT DISTINCT raw FROM raws)),
tokens AS (SELECT DISTINCT doc_id, unnest(forms) AS t FROM raws JOIN vocabulary USING (raw)),
lists AS (SELECT doc_id, list(t ORDER BY t) AS ts FROM tokens GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ts), 0) AS n_tokens, md5(coalesce(array_to_string(ts, ' '), '')) AS tokens_md5 FROM documents d LEFT JOIN lists USING (doc_id)""",
    "identifiers_per_doc": f"""
WITH x AS (SELECT doc_id, list_sort({IDENTS.format("text")}) AS ids FROM documents)
SELECT doc_id, len(ids) AS n_identifiers, md5(array_to_string(ids, ' ')) AS identifiers_md5 FROM x""",
    "normalized_names": "SELECT p_partkey, regexp_replace(lower(p_brand || '_' || p_name), '[^a-z0-9]', '', 'g') AS name_norm FROM part",
    "detect_languages": "SELECT doc_id, ['typescript', 'tsx', 'python', 'go', 'rust', NULL, 'typescript', NULL][(doc_id % 8 + 1)::INTEGER] AS detected FROM documents",
    "fts_words": f"WITH x AS (SELECT doc_id, {FTS.format('text')} AS w FROM documents) SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM x",
    "content_skip_rules": r"""
SELECT doc_id, CASE WHEN strlen(text) > 1048576 THEN 'too-large' WHEN contains(substr(text, 1, 8192), chr(0)) THEN 'binary'
    WHEN regexp_matches(substr(text, 1, 4096), '@generated|Code generated by|(?i:DO NOT EDIT)|(?i:auto-generated)') THEN 'generated'
    WHEN length(text)::DOUBLE / len(string_split(text, E'\n')) > 500 THEN 'minified' END AS reason
FROM documents""",
    "path_skip_rules": rf"""
WITH x AS (SELECT doc_id, {_PATHS}[(doc_id % 12 + 1)::INTEGER] AS path FROM documents), y AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM x)
SELECT doc_id, path, CASE WHEN path = '' OR len(list_intersect(parts, {_LIST(DENIED_DIRS)})) > 0 THEN 'denied-directory'
    WHEN regexp_matches(name, '\.tmp$|~$|\.swp$|\.swx$|^\.#|^#.*#$|^4913$|\.goutputstream-|^\.~lock|\.crswap$') THEN 'temp-file'
    WHEN len([e for e in {_LIST(DENIED_EXTENSIONS)} if ends_with(lower(name), e)]) > 0 THEN 'denied-extension' END AS reason
FROM y""",
    "ignore_file_rules": r"""
SELECT doc_id, CASE WHEN source = 'src11' THEN 'gitignored' WHEN source = 'src1' AND starts_with(doc_id::VARCHAR, '7') AND length(doc_id::VARCHAR) <> 2 THEN 'gitignored'
    WHEN source = 'src2' AND length(doc_id::VARCHAR) = 2 AND starts_with(doc_id::VARCHAR, '9') THEN 'gitignored' END AS reason
FROM documents""",
    "line_chunks": f"WITH {CHUNKS} SELECT path, ord, start_line, end_line, length(body)::INTEGER AS n_chars, md5(body) AS body_md5 FROM chunks",
    "chunk_addresses": f"WITH {CHUNKS} SELECT path, ord, content_hash, n_tokens, {_SPAN_ID} AS span_id FROM chunks",
    "content_hash_dedupe": f"""
WITH {CHUNKS} SELECT substr(sha256('lang: text' || E'\\n---\\n' || body), 1, 32) AS content_hash, 'lang: text' AS header, md5(body) AS body_md5, 'block' AS kind, 'text' AS lang, n_tokens FROM (SELECT DISTINCT body, n_tokens FROM chunks)""",
    "gc_dead_chunks": f"""
WITH {CHUNKS}, gone AS (SELECT d.path FROM docs d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
SELECT content_hash, n_tokens FROM chunks WHERE content_hash NOT IN (SELECT content_hash FROM chunks WHERE path NOT IN (SELECT path FROM gone))""",
    "heading_chunks": rf"""
WITH {CHUNKS}, marked AS (SELECT path, string_split(regexp_replace(text, '(?m)^([A-Z][a-z]{{2,6}}\.)$', '# \1', 'g'), E'\n') AS lines FROM docs),
rows AS (SELECT path, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM marked),
parts AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+\S') AS head FROM rows),
cut AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY path ORDER BY pos) AS ord FROM parts),
joined AS (SELECT path, ord, arg_min(CASE WHEN head THEN regexp_replace(line, '^#+\s+|\s+$', '', 'g') ELSE '' END, pos) AS heading, string_agg(line, E'\n' ORDER BY pos) AS body FROM cut GROUP BY path, ord)
SELECT path, ord::BIGINT AS ord, nullif(heading, '') AS heading, md5(body) AS body_md5 FROM joined WHERE regexp_matches(body, '\S')""",
    "overlapping_windows": rf"""
WITH {CHUNKS}, w AS (SELECT path, lines, unnest(range(0, greatest(ceil((len(lines) - 20) / 17.0), 0)::BIGINT + 1)) AS ord FROM docs)
SELECT path, ord::INTEGER AS ord, (ord * 17 + 1)::INTEGER AS start_line, least(ord * 17 + 20, len(lines))::INTEGER AS end_line, md5(array_to_string(lines[ord * 17 + 1:ord * 17 + 20], E'\n')) AS body_md5 FROM w""",
    "bm25_topk": f"WITH {bm25(_TERMS)} SELECT path, start_line, score FROM bm25 ORDER BY score DESC, path, start_line LIMIT 30",
    "bm25_scoped": f"WITH {bm25(_TERMS, chr(39).join(['starts_with(c.path, ', 'src1', ')']))} SELECT path, start_line, score FROM bm25 ORDER BY score DESC, path, start_line LIMIT 30",
    "bm25_phrases": PHRASE_HITS,
    "bm25_without_index": PHRASE_HITS,
    "trigram_search": f"""
WITH {CHUNKS}, hits AS (SELECT path, start_line, end_line FROM chunks WHERE contains(array_to_string({IDENTS.format("body")}, ' '), 'ention.') ORDER BY path, start_line LIMIT 30)
SELECT path, start_line, end_line, row_number() OVER (ORDER BY path, start_line)::INTEGER AS rank FROM hits""",
    "rrf_search": rf"""
WITH {bm25([["ention"], ["ention"]])}, b AS (
    SELECT path, start_line, end_line, content_hash, 0 AS arm, row_number() OVER (ORDER BY score DESC, path, start_line) AS rank FROM bm25 QUALIFY rank <= 60
), t AS (
    SELECT path, start_line, end_line, content_hash, 1 AS arm, row_number() OVER (ORDER BY path, start_line) AS rank FROM chunks
    WHERE contains(array_to_string({IDENTS.format("body")}, ' '), 'ention.') QUALIFY rank <= 60
), fused AS (
    SELECT path, start_line, end_line, content_hash, round(sum(CASE WHEN arm = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END / (60 + rank)), 9) AS score,
           string_agg(CASE WHEN arm = 0 THEN 'bm25' ELSE 'trigram' END, '+' ORDER BY arm) AS matched, min(arm) AS first_arm, arg_min(rank, arm) AS first_rank
    FROM (SELECT * FROM b UNION ALL SELECT * FROM t) GROUP BY path, start_line, end_line, content_hash
)
SELECT row_number() OVER (ORDER BY score DESC, first_arm, first_rank, path, start_line)::INTEGER AS rank, path, start_line, end_line, matched, round(score, 6) AS score, {_SPAN_ID} AS id
FROM fused QUALIFY rank <= 20""",
    "symbol_lookup": r"""
WITH s AS (SELECT p_name AS name, p_brand AS kind, p_brand || '/' || p_partkey AS path, p_size AS start_line, p_retailprice > 1000 AS exported FROM part)
(SELECT * FROM s WHERE name = 'Red_widget' OR name ILIKE '%Red_widget%' ORDER BY name = 'Red_widget' DESC, exported DESC, length(name), path, start_line, name LIMIT 20)
UNION ALL
(SELECT * FROM s WHERE name = 'red widget' OR name ILIKE '%red widget%' ORDER BY name = 'red widget' DESC, exported DESC, length(name), path, start_line, name LIMIT 20)""",
    "symbol_arm": r"""
WITH s AS (
    SELECT c_mktsegment AS name, 'n' || c_nationkey AS path, c_custkey::INTEGER AS start_line, c_acctbal > 0 AS exported FROM customer
    UNION ALL SELECT lower(c_name), c_mktsegment, c_custkey::INTEGER, true FROM customer
), q(query, names, most) AS (
    VALUES ('building', ['building'], 40), ('Auto mobile', ['automobile'], 15), ('customer#000000007', ['customer000000007', 'customer', '000000007'], 10)
)
SELECT query, path, start_line, name AS symbol, row_number() OVER (PARTITION BY query ORDER BY lower(name) = lower(query) DESC, exported DESC, length(name), path, start_line)::INTEGER AS rank
FROM q JOIN s ON list_contains(names, regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) QUALIFY rank <= any_value(most) OVER (PARTITION BY query)""",
    "scope_filter": rf"""
WITH {CHUNKS} SELECT doc_id, starts_with(path, 'src1') AS plain, path GLOB 'src[12]/?5*' AS glob, path = 'src2/' OR starts_with(path, 'src2/') AS below, path ILIKE 'SRC_/%9.txt' AS liked FROM docs""",
    "path_fuzzy": rf"WITH {CHUNKS} SELECT path FROM docs WHERE regexp_matches(path, '(?s)s.*?1.*?/.*?7.*?7') ORDER BY length(path), path LIMIT 25",
    "pack_budget": f"WITH RECURSIVE {PACKED} SELECT conv_id, array_to_string([k.rank::VARCHAR for k in kept], ',') AS ranks, tokens, truncated FROM packed",
    "tool_response_json": f"""
WITH RECURSIVE {PACKED}, {EVENTS}, w AS (SELECT count(*) FILTER (state = 'pending') AS n FROM jobs)
SELECT conv_id, json_object('index', {{'fresh': n = 0, 'queue_depth': n, 'vector_coverage': 0, 'precise_coverage': 0}}, 'spans', kept, 'tokens', tokens, 'truncated', truncated)::VARCHAR AS json FROM packed, w""",
    "expand_span": rf"""
WITH {CHUNKS}, s AS (SELECT c.path, c.start_line, c.end_line, greatest(1, c.start_line - 5)::INTEGER AS first_line, least(len(d.lines), c.end_line + 5)::INTEGER AS last_line, d.lines FROM chunks c JOIN docs d USING (path))
SELECT path, start_line, end_line, first_line, last_line, md5(array_to_string(lines[first_line:last_line], E'\n')) AS text_md5 FROM s""",
    "verify_spans": rf"""
WITH {CHUNKS} SELECT path,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'unverified' WHEN doc_id % 2 = 0 THEN 'stale-refreshed' ELSE 'verified' END AS trust,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN md5('new') ELSE md5(lines[1]) END AS text_md5,
    CASE WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 'parse' END AS job
FROM docs""",
    "merge_near_spans": """
WITH s AS (SELECT 'o' || l_orderkey AS path, l_quantity::INTEGER AS start_line, l_quantity::INTEGER + l_linenumber AS end_line, l_discount AS score FROM lineitem),
m AS (SELECT *, max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum((reach IS NULL OR start_line > reach + 5)::INTEGER) OVER (PARTITION BY path ORDER BY start_line, end_line RANGE UNBOUNDED PRECEDING) AS island FROM m)
SELECT path, min(start_line) AS start_line, max(end_line) AS end_line, max(score) AS score FROM i GROUP BY path, island""",
    "outline": """
SELECT p_brand || '/' || p_type AS path, string_agg(p_partkey || ':' || p_name, ';' ORDER BY p_partkey) AS symbols FROM part WHERE p_brand = 'Brand#1' GROUP BY 1""",
    "status_counts": f"""
WITH {CHUNKS}, f AS (
    SELECT quality IS NOT NULL AS indexed, CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 1 THEN 'errors' END AS parse_state, CASE WHEN lang <> 'es' THEN CASE WHEN lang = 'en' THEN 'text' ELSE lang END END AS lang
    FROM documents LEFT JOIN labels USING (doc_id)
)
SELECT count(*) AS files, count(*) FILTER (indexed) AS indexed, count(*) FILTER (parse_state IN ('ok', 'errors')) AS parsed, count(*) FILTER (indexed AND lang IS DISTINCT FROM 'text') AS code_files,
    (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM events WHERE event_type = 'click') AS pending, 0::BIGINT AS running,
    (SELECT count(*) FROM events WHERE event_type = 'error') AS dead, count(*) FILTER (indexed) / count(*) AS coverage, count(*) FILTER (parse_state IN ('ok', 'errors')) / count(*) AS parsed_coverage,
    (SELECT count(*) FROM events WHERE event_type = 'click') = 0 AS fresh
FROM f""",
    "coverage_ratio": "SELECT source AS module, count(*) AS files, count(quality) AS indexed, round(count(quality) / count(*), 9) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "kind_histogram": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "unique_chunks": f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT body) AS unique_chunks, count(DISTINCT path) AS files FROM chunks",
    "hotspots": f"WITH {CHUNKS} SELECT path, count(*) AS symbols FROM chunks GROUP BY path ORDER BY symbols DESC, path LIMIT 15",
    "link_graph_edges": f"WITH {LINKS} SELECT * FROM links",
    "link_graph_nodes": f"WITH {LINKS} SELECT id, weight FROM nodes WHERE id IN (SELECT id FROM ends) ORDER BY weight DESC, id LIMIT 50",
    "isolated_nodes": f"WITH {LINKS} SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM ends)",
    "link_degrees": f"WITH {LINKS} SELECT id, count(*) AS degree, count(*) > 6 AS hub FROM (SELECT source AS id FROM links UNION ALL SELECT target FROM links) GROUP BY id",
    "link_graph_modules": r"""
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1) AS first FROM pages),
r AS (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) || '/' || first || '/' || host || '/' || page_id AS id FROM h),
ring AS (SELECT id AS source, lead(id) OVER (PARTITION BY right(id, 1) ORDER BY id) AS target FROM r),
m AS (SELECT array_to_string(string_split(source, '/')[1:2], '/') AS source, array_to_string(string_split(target, '/')[1:2], '/') AS target FROM ring WHERE target IS NOT NULL)
SELECT source, target, count(*) AS weight FROM m WHERE source <> target GROUP BY 1, 2""",
    "callers": "SELECT 'o' || l_orderkey AS path, l_linenumber AS line, 's' || l_suppkey AS caller FROM lineitem WHERE l_partkey = 7",
    "callees": "SELECT DISTINCT 'p' || l_partkey AS callee FROM lineitem WHERE l_suppkey = 3",
    "call_edges": """
WITH c AS (
    SELECT (l_orderkey % 100)::VARCHAR AS path, 's' || l_suppkey % 5 AS src, ['holdLine', 'map', 'ok', 'tieUp', 'println', 'go'][(l_partkey % 6 + 1)::INTEGER] AS dst, l_orderkey * 10 + l_linenumber AS nth, (l_orderkey % 997 * 10 + l_linenumber)::INTEGER AS line
    FROM lineitem
)
SELECT path, src, dst, 'calls' AS kind, arg_min(line, nth) AS line FROM c WHERE dst IN ('holdLine', 'tieUp') GROUP BY path, src, dst""",
    "symbol_dedupe": """
SELECT 'u' || user_id % 10 AS path, event_type AS name, (event_id % 50)::INTEGER AS start_line, CASE WHEN event_id % 3 = 0 THEN 'constant' ELSE 'function' END AS kind, event_id AS ord
FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 10, event_type, event_id % 50 ORDER BY event_id % 3 = 0, event_id) = 1""",
    "page_rank": """
WITH RECURSIVE links AS (
    SELECT c_nationkey AS source, s_nationkey AS target, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), share AS (
    SELECT source, target, weight::DOUBLE / sum(weight) OVER (PARTITION BY source) AS share FROM links
), ids AS (
    SELECT n_nationkey AS id FROM nation
), r0 AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS rank FROM ids),
g1 AS (SELECT i.id, coalesce(sum(share * rank), 0) AS got FROM ids i LEFT JOIN share s ON s.target = i.id LEFT JOIN r0 r ON r.id = s.source GROUP BY i.id),
r1 AS (SELECT id, 0.15 / count(*) OVER () + 0.85 * (got + (1 - sum(got) OVER ()) / count(*) OVER ()) AS rank FROM g1),
g2 AS (SELECT i.id, coalesce(sum(share * rank), 0) AS got FROM ids i LEFT JOIN share s ON s.target = i.id LEFT JOIN r1 r ON r.id = s.source GROUP BY i.id),
r2 AS (SELECT id, 0.15 / count(*) OVER () + 0.85 * (got + (1 - sum(got) OVER ()) / count(*) OVER ()) AS rank FROM g2),
g3 AS (SELECT i.id, coalesce(sum(share * rank), 0) AS got FROM ids i LEFT JOIN share s ON s.target = i.id LEFT JOIN r2 r ON r.id = s.source GROUP BY i.id)
SELECT id, round(0.15 / count(*) OVER () + 0.85 * (got + (1 - sum(got) OVER ()) / count(*) OVER ()), 9) AS rank FROM g3""",
    "co_changes": """
WITH r AS (SELECT DISTINCT 's' || l_suppkey AS path, l_orderkey AS sha FROM lineitem)
SELECT a.path, b.path AS other, count(*) AS commits FROM r a JOIN r b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2""",
    "job_coalesce": f"""
WITH {EVENTS} SELECT path, kind, min(coalesce(priority, 5)) AS priority, max(enqueued_at) AS enqueued_at, (max((enqueued_at, seq, payload)) FILTER (payload IS NOT NULL))[3] AS payload, count(*) AS events FROM events_ GROUP BY path, kind""",
    "job_enqueue": f"""
WITH {EVENTS}, merged AS (
    SELECT path, kind, min(priority) AS priority, max(enqueued_at) AS enqueued_at FROM (
        SELECT path, kind, priority, enqueued_at FROM jobs WHERE enqueued_at < {NOW} AND state = 'pending' UNION ALL SELECT path, kind, coalesce(priority, 5), enqueued_at FROM events_ WHERE enqueued_at >= {NOW}
    ) GROUP BY path, kind
), now AS (SELECT 'pending' AS state, priority, enqueued_at FROM merged UNION ALL SELECT state, priority, enqueued_at FROM jobs WHERE enqueued_at < {NOW} AND state <> 'pending')
SELECT state, count(*) AS n, sum(priority)::BIGINT AS priorities, max(enqueued_at) AS latest FROM now GROUP BY state""",
    "job_claim_batch": f"""
WITH {EVENTS} SELECT id, path, kind, priority, 'running' AS state, attempts + 1 AS attempts, {NOW + 30_000}::BIGINT AS lease_until FROM jobs WHERE state = 'pending' AND kind IN ('click', 'view') ORDER BY priority, enqueued_at, id LIMIT 25""",
    "job_fail_dead": f"""
WITH {EVENTS}, f AS (SELECT *, state = 'running' AND id % 3 = 0 AS failed FROM jobs)
SELECT id, CASE WHEN failed THEN CASE WHEN attempts >= 5 THEN 'dead' ELSE 'pending' END ELSE state END AS state, coalesce(CASE WHEN NOT failed THEN lease_until END, -1) AS lease_until, CASE WHEN NOT failed THEN worker END AS worker, CASE WHEN failed THEN 2000 WHEN state = 'dead' THEN length('error ' || id) ELSE 0 END AS error_chars FROM f""",
    "job_complete": f"WITH {EVENTS} SELECT state, count(*) AS n FROM jobs WHERE state <> 'running' GROUP BY state",
    "lease_sweep": f"""
WITH {EVENTS}, x AS (
    SELECT *, coalesce(state = 'running' AND lease_until < {NOW}, false) AS expired, bool_or(state = 'pending') OVER (PARTITION BY path, kind) AS waits FROM jobs
), k AS (
    SELECT *, expired AND NOT waits AND row_number() OVER (PARTITION BY path, kind, expired ORDER BY id) = 1 AS moved FROM x
)
SELECT CASE WHEN moved THEN 'pending' ELSE state END AS state, count(*) AS n, sum(id)::BIGINT AS ids, count(CASE WHEN NOT moved THEN lease_until END) AS leases, count(CASE WHEN NOT moved THEN worker END) AS workers FROM k WHERE moved OR NOT expired GROUP BY 1
UNION ALL SELECT 'recovered', count(*), 0, 0, 0 FROM k WHERE moved""",
    "retry_dead": f"""
WITH {EVENTS}, x AS (SELECT *, bool_or(state = 'pending') OVER (PARTITION BY path, kind) AS waits, row_number() OVER (PARTITION BY path, kind, state ORDER BY id) AS n FROM jobs)
SELECT id, path, kind, CASE WHEN state = 'dead' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'dead' THEN 0 ELSE attempts END AS attempts, '' AS last_error
FROM x WHERE state <> 'dead' OR (NOT waits AND n = 1)""",
    "queue_depth": f"WITH {EVENTS} SELECT count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'dead') AS dead FROM jobs",
    "debounce_sessions": """
WITH x AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
y AS (SELECT *, sum((gap IS NULL OR gap >= INTERVAL 2 HOURS)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts) + INTERVAL 2 HOURS) // 1000 AS due_ms, count(*) AS events FROM y GROUP BY user_id, s""",
    "git_suppression": """
WITH e AS (SELECT event_id AS seq, event_type AS kind, epoch_us(ts) // 1000 AS at_ms FROM events)
SELECT a.seq, a.kind FROM e a WHERE a.kind <> 'error' AND NOT EXISTS (SELECT 1 FROM e g WHERE g.kind = 'error' AND a.at_ms >= g.at_ms AND a.at_ms < g.at_ms + 120000)""",
    "skip_decision": """
WITH d AS (SELECT source || '/' || doc_id AS path, doc_id, CASE WHEN doc_id % 13 <> 0 THEN substr(sha256(text), 1, 32) END AS h, doc_id % 3 <> 0 AS known, doc_id % 2 = 0 AND doc_id % 5 * 600 > 1000 AS stat, doc_id % 4 <> 0 AS same FROM documents),
r AS (SELECT path, h, CASE WHEN h IS NULL THEN 'gone' WHEN known AND stat THEN 'stat-unchanged' WHEN known AND same THEN 'hash-unchanged' END AS reason FROM d)
SELECT path, reason IS NULL AS work, reason, CASE WHEN reason IS NULL THEN h END AS hash FROM r""",
    "git_changes": """
WITH d AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
SELECT CASE k WHEN 0 THEN 'src/a' WHEN 1 THEN 'src/b' WHEN 2 THEN 'src/c' WHEN 3 THEN 'new/d' WHEN 4 THEN 'src/e' WHEN 5 THEN 'src/f' WHEN 6 THEN 'src/g' ELSE 'new/h' END || doc_id || CASE WHEN k < 4 THEN '.ts' ELSE '.py' END AS path,
       CASE WHEN k IN (2, 6) THEN 'delete' ELSE 'parse' END AS kind, 10 AS priority FROM d
UNION ALL SELECT CASE k WHEN 3 THEN 'old/d' || doc_id || '.ts' ELSE 'old/h' || doc_id || '.py' END, 'delete', 10 FROM d WHERE k IN (3, 7)""",
    "merkle_changes": """
WITH b AS (
    SELECT doc_id, lang IN ('de', 'fr') AS touched, doc_id % 11 AS k, source || '/' || lang || '/' || doc_id % 7 || '/' || doc_id || '.txt' AS path, md5(text) AS hash FROM documents
), a AS (
    SELECT CASE WHEN touched AND k = 2 THEN 'moved/' || doc_id % 3 || '/' || doc_id ELSE path END AS path, CASE WHEN touched AND k = 1 THEN md5(path) ELSE hash END AS hash FROM b WHERE NOT (touched AND k = 0)
    UNION ALL SELECT 'copies/' || path, hash FROM b WHERE touched AND k = 3
), d AS (
    SELECT coalesce(a.path, b.path) AS path, b.hash AS was_hash, a.hash AS is_hash FROM b FULL JOIN a ON a.path = b.path WHERE a.hash IS DISTINCT FROM b.hash
), gone AS (SELECT path, was_hash AS hash, count(*) OVER (PARTITION BY was_hash) AS n FROM d WHERE is_hash IS NULL),
come AS (SELECT path, is_hash AS hash, count(*) OVER (PARTITION BY is_hash) AS n FROM d WHERE was_hash IS NULL),
moves AS (SELECT c.path, g.path AS was FROM gone g JOIN come c ON g.hash = c.hash AND g.n = 1 AND c.n = 1)
SELECT path, 'moved' AS change, was FROM moves
UNION ALL SELECT path, 'changed', NULL FROM d WHERE was_hash IS NOT NULL AND is_hash IS NOT NULL
UNION ALL SELECT path, 'added', NULL FROM come WHERE path NOT IN (SELECT path FROM moves)
UNION ALL SELECT path, 'removed', NULL FROM gone WHERE path NOT IN (SELECT was FROM moves)""",
    "pack_levels": """
WITH RECURSIVE spans AS (
    SELECT conv_id, (turn + 1)::INTEGER AS rank, role || (turn % 4) AS path, role = 'assistant' AS expanded, ceil(length(text) / 4.0)::INTEGER + 32 AS full_, ceil(length(text) / 16.0)::INTEGER + 20 AS skeleton,
           row_number() OVER (PARTITION BY conv_id ORDER BY role = 'assistant', turn, role) AS n, 12 * (count(*) OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC, role DESC ROWS UNBOUNDED PRECEDING) - 1) AS later
    FROM conversations
), fold AS (
    SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS tokens, []::VARCHAR[] AS paths, []::VARCHAR[] AS kept FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, n, tokens + CASE level WHEN 'full' THEN full_ WHEN 'skeleton' THEN skeleton WHEN 'reference' THEN 12 ELSE 0 END, CASE WHEN level IS NULL THEN paths ELSE list_distinct(paths || [path]) END, CASE WHEN level IS NULL THEN kept ELSE kept || [rank || ':' || level] END
    FROM (
        SELECT *, CASE WHEN whole AND full_ <= room - later THEN 'full' WHEN whole AND skeleton <= room - later THEN 'skeleton' WHEN 12 <= room THEN 'reference' END AS level
        FROM (SELECT f.conv_id, s.n, f.tokens, f.paths, f.kept, s.path, s.rank, s.full_, s.skeleton, s.later, CASE WHEN expanded THEN 240 ELSE 192 END - f.tokens AS room, NOT (list_contains(f.paths, s.path) AND len(f.paths) < 3) AS whole FROM fold f JOIN spans s ON s.conv_id = f.conv_id AND s.n = f.n + 1)
    )
)
SELECT conv_id, array_to_string(kept, ',') AS levels, tokens::INTEGER AS tokens, len(kept) < n AS truncated FROM fold QUALIFY n = max(n) OVER (PARTITION BY conv_id)""",
    "expand_graph": """
WITH RECURSIVE pairs AS (
    SELECT near, far, max(weight) AS weight, min(relation) AS relation FROM (
        SELECT 'o' || l_orderkey AS near, 'p' || l_partkey AS far, CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight, 'callee' AS relation FROM lineitem
        UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey, CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.5 END::DOUBLE, 'caller' FROM lineitem
    ) GROUP BY near, far
), small AS (
    SELECT near AS node FROM pairs GROUP BY near HAVING count(*) <= 40
), links AS (
    SELECT * FROM pairs WHERE near IN (SELECT node FROM small) AND far IN (SELECT node FROM small)
), walk AS (
    SELECT o_orderkey AS answer_id, 'o' || o_orderkey AS node, 0 AS hop, NULL::VARCHAR AS relation, 1.0::DOUBLE AS score FROM orders WHERE o_orderkey % 100 = 0
    UNION ALL
    SELECT answer_id, far, hop + 1, l.relation, score * weight * 0.5::DOUBLE FROM walk JOIN links l ON l.near = walk.node WHERE hop < 2
), reached AS (
    SELECT answer_id, node, hop, min(relation) AS relation, max(score) AS score FROM (SELECT *, min(hop) OVER (PARTITION BY answer_id, node) AS nearest FROM walk) WHERE hop = nearest GROUP BY answer_id, node, hop
), costs AS (
    SELECT 'o' || o_orderkey AS node, o_orderkey % 7 + 10 AS cost FROM orders UNION ALL SELECT 'p' || p_partkey, p_size + 5 FROM part
)
SELECT answer_id, row_number() OVER w::INTEGER AS rank, node, hop, relation, score, (sum(cost) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens
FROM reached JOIN costs USING (node) WHERE hop > 0 WINDOW w AS (PARTITION BY answer_id ORDER BY hop, score DESC, node) QUALIFY tokens <= 320""",
    "batch_search": f"WITH {BATCH} SELECT query_id, rank, path, start_line, end_line, matched, round(score, 6) AS score FROM best WHERE config = 'all'",
    "eval_ablation": f"""
WITH {BATCH}, read AS (
    SELECT b.config, b.query_id, b.rank, path = own AS hit, ceil(length(body) / 4.0)::INTEGER + 32 AS cost FROM best b JOIN chunks USING (path, start_line, end_line) JOIN asked USING (query_id)
), firsts AS (
    SELECT *, min(rank) FILTER (hit) OVER (PARTITION BY config, query_id) AS first FROM read
), per AS (
    SELECT config, query_id, any_value(first) AS first, sum(cost) FILTER (first IS NULL OR rank <= first) AS tokens FROM firsts GROUP BY config, query_id
)
SELECT c.config, count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(coalesce(tokens, 0)::DOUBLE), 6) AS tokens
FROM asked JOIN (SELECT DISTINCT config FROM best) c ON true LEFT JOIN per ON per.config = c.config AND per.query_id = asked.query_id GROUP BY c.config""",
    "vector_topk": """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20""",
    "vector_topk_int8": """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max([abs(x::DOUBLE) for x in embedding]) / 127.0::DOUBLE AS scale FROM embeddings),
c AS (SELECT vec_id, scale, [round(x / scale) for x in e] AS code FROM s),
q AS (SELECT scale AS q_scale, code AS q_code FROM c ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_inner_product(code, q_code) * (scale * q_scale), 6) AS score FROM c, q ORDER BY score DESC, vec_id LIMIT 20""",
    "vector_quantise": """
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max([abs(x::DOUBLE) for x in embedding]) / 127.0::DOUBLE AS scale FROM embeddings)
SELECT vec_id, round(scale, 9) AS scale, list_sum([round(x / scale)::INTEGER for x in e])::INTEGER AS code_sum FROM s""",
    "redact_secrets": f"""
WITH r AS (SELECT doc_id, {_redact()} AS text FROM documents) SELECT doc_id, len(regexp_extract_all(text, '\\[redacted:')) AS secrets, md5(text) AS text_md5 FROM r""",
    "reference_links": r"""
WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT page_id, url FROM pages),
r AS (SELECT doc_id, 'issue' AS kind, unnest(regexp_extract_all(text, '#[0-9]+')) AS ref FROM t
    UNION ALL SELECT doc_id, 'ticket', unnest(regexp_extract_all(text, '\b[A-Z]{2,10}-[0-9]+\b')) FROM t
    UNION ALL SELECT doc_id, 'todo', unnest(regexp_extract_all(text, '\b(?:TODO|FIXME)\b')) FROM t
    UNION ALL SELECT doc_id, 'link', unnest(regexp_extract_all(text, 'https?://[^\s<>"'')\]]+')) FROM t)
SELECT doc_id, kind, ref, count(*) AS n FROM r GROUP BY ALL""",
    "eval_recall_mrr": """
WITH s AS (SELECT a.vec_id AS query_id, a.label AS wanted, b.vec_id AS id, b.label AS label, round(list_inner_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
p AS (SELECT query_id, count(*) FILTER (label = wanted) AS wanted, count(*) FILTER (label = wanted AND rank <= 10) AS found, min(rank) FILTER (label = wanted AND rank <= 10) AS first FROM r GROUP BY query_id HAVING count(*) FILTER (label = wanted) > 0)
SELECT count(*) AS queries, round(avg(found / wanted), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM p""",
}
