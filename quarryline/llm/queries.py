"""The digest queries of this subpackage and their SQL.

Each takes (spark, sf_dir), applies its operator to the whole table and
derives the columns that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import chat_format, exact_dedup, filter_audit, langid, mixing, packing, quality, sentencepiece_codec, simhash, substring_dedup, topk_search, url_filter, vector_codes
from quarryline.llm.common import read


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode(read(spark, sf_dir, "documents"), tokenizer_path()))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP3_SQL = """
WITH v AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY rank <= 20
"""

#: Rules of the query: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


OP4_SQL = """
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT p.page_id, p.host, p.path,
       (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
        WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule_host || rule_path)) FROM rules
        WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)), 'allow') AS verdict
FROM parts p
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = langid.fold() == 2
    profiles = langid.train(docs.filter(~F.coalesce(held_out, F.lit(True))))
    found = langid.identify(docs, profiles)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH docs AS (
    SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)
), marked AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM marked
), gone_lists AS (
    SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
), words AS (
    SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM docs
), kept AS (
    SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.j) AS text, count(*) AS n
    FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.j = gone.j
    WHERE gone.j IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


#: Tools that calls in ``conversations`` may name.
TOOL_SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
    "fetch": {"url": ("string", True), "headers": ("object", False)},
}


def tool_dialogues(conversations: DataFrame) -> DataFrame:
    """Conversations as dialogues with tools.  Each user turn calls a tool,
    in turn one of four (the last is unknown, the third gets a bad argument),
    and refers to the call of the turn at half its number; the assistant turn
    after it is the result.  Other turns stay plain."""
    turn, text = F.col("turn"), F.col("text")
    at = (turn % 4).cast("int")
    name = F.element_at(F.array(*map(F.lit, ("search", "calculate", "fetch", "translate"))), at + 1)
    arguments = F.struct(
        F.when(at == 0, text).alias("query"), F.when(at == 0, turn).alias("limit"), F.when(at == 1, text).alias("expression"), F.when(at == 2, turn).alias("url"), F.when(at == 3, text).alias("text"),
        F.when(turn > 0, F.struct(F.concat(F.lit("t"), F.floor(turn / 2)).alias("$ref"))).alias("after"),
    )
    call = F.struct(F.concat(F.lit("t"), turn).alias("id"), name.alias("name"), arguments.alias("arguments"))
    asks = F.to_json(F.struct(text.alias("content"), F.array(call).alias("tool_calls")))
    answers = F.to_json(F.struct(text.alias("content"), F.concat(F.lit("t"), turn - 1).alias("tool_call_id")))
    return conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "user", asks).when(F.col("role") == "assistant", answers).otherwise(text).alias("text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(tool_dialogues(read(spark, sf_dir, "conversations")), TOOL_SCHEMAS)


OP7_SQL = """
WITH RECURSIVE calls AS (
    SELECT conv_id, turn, text, turn % 4 AS tool, turn // 2 AS parent FROM conversations WHERE role = 'user'
), edges AS (
    SELECT c.conv_id, c.turn, c.parent FROM calls c JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.parent AND c.turn > 0
), levels AS (
    SELECT conv_id, turn, 0 AS level FROM calls WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM edges)
    UNION ALL
    SELECT e.conv_id, e.turn, l.level + 1 FROM edges e JOIN levels l ON l.conv_id = e.conv_id AND l.turn = e.parent
), asked AS (
    SELECT c.*, l.level, EXISTS (SELECT 1 FROM conversations r WHERE r.role = 'assistant' AND r.conv_id = c.conv_id AND r.turn = c.turn + 1) AS answered,
           ['search', 'calculate', 'fetch', 'translate'][tool + 1] AS name,
           CASE WHEN c.turn > 0 THEN '{"after":' || json_object('$ref', 't' || parent)::VARCHAR || ',' ELSE '{' END
           || substr((CASE tool WHEN 0 THEN json_object('limit', c.turn, 'query', text) WHEN 1 THEN json_object('expression', text) WHEN 2 THEN json_object('url', c.turn) ELSE json_object('text', text) END)::VARCHAR, 2) AS arguments
    FROM calls c JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
)
SELECT m.conv_id, m.turn, m.role, m.turn AS order_turn, coalesce(a.level, b.level + 1, CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END)::INTEGER AS level,
       CASE WHEN m.role = 'user' THEN 1 ELSE 0 END AS n_calls, (coalesce(a.answered, false) OR b.turn IS NOT NULL)::BIGINT AS n_linked,
       CASE WHEN m.role = 'user' THEN array_to_string([x FOR x IN [CASE WHEN a.tool = 2 THEN 'bad_arguments' END, CASE WHEN NOT a.answered THEN 'unanswered_call' END, CASE WHEN a.tool = 3 THEN 'unknown_tool' END] IF x IS NOT NULL], ',')
            WHEN m.role = 'assistant' AND b.turn IS NULL THEN 'unknown_call' ELSE '' END AS issues,
       (CASE WHEN m.role = 'user' THEN json_object('content', m.text, 'conv_id', m.conv_id, 'role', m.role, 'tool_calls', [{'arguments': a.arguments, 'id': 't' || m.turn, 'name': a.name}], 'turn', m.turn)
             WHEN m.role = 'assistant' THEN json_object('content', m.text, 'conv_id', m.conv_id, 'role', m.role, 'tool_call_id', 't' || (m.turn - 1), 'turn', m.turn)
             ELSE json_object('content', m.text, 'conv_id', m.conv_id, 'role', m.role, 'turn', m.turn) END)::VARCHAR AS json
FROM conversations m
LEFT JOIN asked a ON m.role = 'user' AND a.conv_id = m.conv_id AND a.turn = m.turn
LEFT JOIN asked b ON m.role = 'assistant' AND b.conv_id = m.conv_id AND b.turn = m.turn - 1
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sizes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH docs AS (
    SELECT doc_id, source, len([x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''])::BIGINT AS size,
           (('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighted AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
           ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight,
           sum(source_size) OVER () * 1.5::DOUBLE AS total
    FROM sources
), levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
           row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
    FROM weighted
    WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size,
           least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level * weight <= cap) * weight, cap)) AS target
    FROM levels
), measured AS (
    SELECT *, floor(sqrt(size::DOUBLE) * 16.0::DOUBLE)::BIGINT AS measure FROM docs
), classes AS (
    SELECT source, measure, sum(size)::BIGINT AS words FROM measured GROUP BY source, measure
), tried AS (
    SELECT c.source, measure, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(words * measure) OVER (down ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
    FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source WHERE measure > 0 AND target < 2.0::DOUBLE * source_size
    WINDOW down AS (PARTITION BY c.source ORDER BY measure DESC)
), rates AS (
    SELECT source, arg_max(rate, measure) AS rate FROM tried WHERE rate * measure <= 2.0::DOUBLE GROUP BY source
), wanted AS (
    SELECT m.*, t.source_size, t.target, CASE WHEN measure > 0 THEN coalesce(least(2.0::DOUBLE, r.rate * measure), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS wanted
    FROM measured m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source LEFT JOIN rates r ON m.source IS NOT DISTINCT FROM r.source
), parts AS (
    SELECT *, floor(wanted)::BIGINT AS whole, wanted - floor(wanted) AS part, target - sum(size * floor(wanted)::BIGINT) OVER (PARTITION BY source) AS open FROM wanted
), ranked AS (
    SELECT *, sum(CASE WHEN part > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS so_far FROM parts
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN part > 0 AND so_far * 2 - size < open * 2 THEN 1 ELSE 0 END) AS taken
FROM ranked
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no url: its ``source`` is where a document comes from,
    and so the host; the language is the section below it."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.classify(docs, labels, levels=[F.col("source"), F.col("lang")])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=3)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH split AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents
), judged AS (
    SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
                  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
           doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
    FROM split
), cells AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY part, fails
), numbers AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
    SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM numbers a, numbers b, numbers c, numbers d, numbers e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
    SELECT array_to_string([substr('ABCDE', x, 1) for x in o], '') AS filter_order, i AS step, o[i] AS f, o[:i - 1] AS before FROM orders, numbers
), counted AS (
    SELECT part, filter_order, step, f,
           sum(CASE WHEN NOT fails[f] AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN fails[f] AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN fails[f] AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN fails[f] AND len([x for x in fails if x]) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN fails[f] AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN fails[f] AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM (SELECT *, len([x for x in before if fails[x]]) > 0 AS earlier FROM cells, steps) GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 4) -> str:
    """The rounds written out, one after the other."""
    nearest = """a{k} AS MATERIALIZED (
    SELECT r.row, r.p, min(len2 + c2 - 2 * list_inner_product(v, c)::BIGINT) AS d, arg_min(e, (len2 + c2 - 2 * list_inner_product(v, c)::BIGINT) * 256 + e) AS e
    FROM parts r JOIN b{k} b ON r.p = b.p GROUP BY r.row, r.p
)"""
    replaced = """s{k} AS (
    SELECT a.p, a.e, list(floor(total / n)::DOUBLE ORDER BY i) AS c FROM (
        SELECT a.p, a.e, i, sum(v[i])::DOUBLE AS total, count(*)::DOUBLE AS n FROM a{k} a JOIN parts r ON r.row = a.row AND r.p = a.p, (SELECT unnest(range(1, max(len(v)) + 1)) AS i FROM parts) GROUP BY a.p, a.e, i
    ) a GROUP BY a.p, a.e
), b{next} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(s.c, b.c) AS c, list_inner_product(coalesce(s.c, b.c), coalesce(s.c, b.c))::BIGINT AS c2 FROM b{k} b LEFT JOIN s{k} s ON s.p = b.p AND s.e = b.e
)"""
    steps = [step.format(k=k, next=k + 1) for k in range(rounds) for step in (nearest, replaced)] + [nearest.format(k=rounds)]
    return """
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
    SELECT row, p, v, list_inner_product(v, v)::BIGINT AS len2
    FROM (SELECT row, p, q[p * (len(q) // 4) + 1:(p + 1) * (len(q) // 4)] AS v FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p))
), b0 AS MATERIALIZED (
    SELECT p, row - 1 AS e, v AS c, len2 AS c2 FROM parts WHERE row <= 256
), """ + ", ".join(steps) + """, coded AS (
    SELECT row, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{n} GROUP BY row
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string([x::BIGINT for x in c], ','), ',' ORDER BY p, e)) FROM b{n}) AS codebooks_sha256
FROM coded c JOIN kept k ON k.row = c.row
""".format(n=rounds)


OP12_SQL = _op12_sql()


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_topk_search": op3_topk_search,
        "op4_url_filter": op4_url_filter,
        "op5_language_id": op5_language_id,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_chat_format": op7_chat_format,
        "op8_mixing": op8_mixing,
        "op9_quality": op9_quality,
        "op10_simhash": op10_simhash,
        "op11_filter_audit": op11_filter_audit,
        "op12_vector_codes": op12_vector_codes,
        "op13_packing": op13_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op3_topk_search": OP3_SQL,
        "op4_url_filter": OP4_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_chat_format": OP7_SQL,
        "op8_mixing": OP8_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
    }
