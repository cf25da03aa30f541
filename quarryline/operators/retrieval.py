"""Ranked retrieval: three arms, reciprocal rank fusion, verification, packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import code_text as T
from quarryline.operators import indexing

# Column weights and constants of the full-text score.
COLUMN_WEIGHTS = {"body": 1.0, "header": 2.0, "tokens": 1.5}
K1, B, COMMON_IDF = 1.2, 0.75, 1e-6
# Weights of the arms and the rank constant of the fusion.
ARM_WEIGHTS = {"bm25": 1.0, "trigram": 0.7, "symbol": 1.3}
ARMS = tuple(ARM_WEIGHTS)
RANK_CONSTANT = 60
# Cost of a span beside its text, files before one may repeat.
SPAN_COST, VARIETY = 32, 3
# Levels of detail, and the share kept for what the graph adds.
LEVELS, RESERVE = ("full", "skeleton", "reference"), 0.2


def _phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often a phrase of consecutive words occurs."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))

    def fits(w: Column, i: Column) -> Column:
        ok = w == phrase[0]
        for k, x in enumerate(phrase[1:], 1):
            ok = ok & (F.get(words, i + k) == x)
        return F.coalesce(ok, F.lit(False))

    return F.size(F.filter(words, fits))


def _phrases(query: str) -> list[list[str]]:
    return [p for p in (T.fts_words_of(t) for t in T.query_terms(query)) if p]


def bm25(fts: DataFrame, query: str, hold: indexing.Hold = lambda df: df) -> DataFrame:
    """``content_hash`` and ``score`` (higher is better) of chunks that hold any
    of the query's phrases.  Statistics cover the whole table.  For chunks
    without an index: every word is read, once if ``hold`` keeps the counts."""
    phrases = _phrases(query)
    if not phrases:
        return fts.select("content_hash", F.lit(0.0).alias("score")).limit(0)
    weight = [sum((F.lit(w) * _phrase_count(F.col(c), p) for c, w in COLUMN_WEIGHTS.items()), F.lit(0.0)) for p in phrases]
    rows = hold(fts.select("content_hash", "length", F.array(*weight).alias("f")))
    stats = rows.agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    return _scored(rows, stats, len(phrases))


def bm25_postings(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """The same from an index: only rows of the query's terms are read."""
    phrases = _phrases(query)
    terms = list(dict.fromkeys(w for p in phrases for w in p))
    if not terms:
        return postings.select("content_hash", F.lit(0.0).alias("score")).limit(0)
    at = lambda t, c: F.col(f"t{terms.index(t)}.{c}")
    places = F.struct(*COLUMN_WEIGHTS)
    rows = postings.filter(indexing.in_buckets("term", terms)).groupBy("content_hash").agg(
        F.max("length").alias("length"), *(F.max_by(places, F.when(F.col("term") == t, 1)).alias(f"t{i}") for i, t in enumerate(terms)),
    )

    def times(phrase: list[str], c: str) -> Column:
        first = at(phrase[0], c)
        if len(phrase) > 1:
            first = F.filter(first, lambda i: reduce(lambda a, b: a & b, (F.array_contains(at(w, c), i + k) for k, w in enumerate(phrase[1:], 1))))
        return F.coalesce(F.size(first), F.lit(0)) if len(phrase) == 1 else F.coalesce(F.when(reduce(lambda a, b: a & b, (at(w, c).isNotNull() for w in phrase)), F.size(first)), F.lit(0))

    weight = [sum((F.lit(w) * F.greatest(times(p, c), F.lit(0)) for c, w in COLUMN_WEIGHTS.items()), F.lit(0.0)) for p in phrases]
    return _scored(rows.select("content_hash", "length", F.array(*weight).alias("f")), stats, len(phrases))


def _scored(rows: DataFrame, stats: DataFrame, phrases: int) -> DataFrame:
    """Scores of rows (content_hash, length, f: weighted counts by phrase)."""
    found = rows.agg(*(F.count(F.when(F.col("f")[i] > 0, 1)).alias(f"n{i}") for i in range(phrases)))
    totals = stats.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean")).join(found)
    rows = rows.filter(F.exists("f", lambda x: x > 0)).join(F.broadcast(totals))  # one row
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    score = F.lit(0.0)
    for i in range(phrases):
        raw = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(raw <= 0, F.lit(COMMON_IDF)).otherwise(raw)
        score = score + idf * F.col("f")[i] * (K1 + 1) / (F.col("f")[i] + norm)
    return rows.select("content_hash", score.alias("score"))


def _located(hits: DataFrame, file_chunks: DataFrame, scope: str | None) -> DataFrame:
    """Hits at each place that their content stands."""
    places = file_chunks.filter(T.in_scope(F.col("path"), scope)).select("content_hash", "path", "start_line", "end_line")
    return hits.join(places, "content_hash")


def _ranked(rows: DataFrame, arm: str, limit: int, *order: Column) -> DataFrame:
    """The best rows of an arm with their ranks; at most ``limit`` rows meet."""
    best = rows.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order))
    symbol = F.col("symbol") if "symbol" in rows.columns else F.lit(None).cast("string")
    return best.select("path", "start_line", "end_line", symbol.alias("symbol"), F.col("content_hash") if "content_hash" in rows.columns else F.lit(None).cast("string").alias("content_hash"), F.lit(arm).alias("arm"), F.lit(ARMS.index(arm)).alias("arm_at"), rank.alias("rank"))


def bm25_arm(index: dict[str, DataFrame], query: str, limit: int, scope: str | None = None) -> DataFrame:
    hits = bm25_postings(index["postings"], index["stats"], query) if "postings" in index else bm25(indexing.fts_table(index["chunks"]), query)
    hits = _located(hits, index["file_chunks"], scope).withColumn("score", F.round("score", 6))
    return _ranked(hits, "bm25", limit, F.desc("score"), F.col("path"), F.col("start_line"))


def trigram_applies(query: str) -> bool:
    """One word of 3 to 64 characters."""
    q = query.strip()
    return 3 <= len(q) <= 64 and not any(c.isspace() for c in q)


def trigram_arm(index: dict[str, DataFrame], query: str, limit: int, scope: str | None = None) -> DataFrame:
    """Chunks whose identifiers hold the query as a substring, any case.

    The query has no white space, so it stands within one identifier.  With an
    index, identifiers that hold all of its three-character parts are verified,
    and only their chunks are read."""
    wanted = query.strip().lower()
    if "grams" in index:
        grams = {wanted[i : i + 3] for i in range(len(wanted) - 2)}
        names = index["grams"].filter(indexing.in_buckets("gram", grams)).groupBy("ident").agg(F.countDistinct("gram").alias("n"))
        names = names.filter((F.col("n") == len(grams)) & F.col("ident").contains(wanted)).select("ident", indexing.bucket(F.col("ident")).alias("bucket"))
        hits = index["idents"].join(names, ["bucket", "ident"]).select("content_hash").distinct()
    else:
        hits = T.with_idents(index["chunks"]).filter(F.col("idents").contains(wanted)).select("content_hash")
    return _ranked(_located(hits, index["file_chunks"], scope), "trigram", limit, F.col("path"), F.col("start_line"))


def symbol_names(query: str) -> list[str]:
    """Normalised names that a query may mean."""
    words = query.split()
    if not words:
        return []
    if len(words) == 1:
        names = [words[0], *(t for t in T.tokenize_text(words[0]) if len(t) >= 3 and t not in T.SYMBOL_STOPWORDS)]
    else:
        names = [query.strip(), "".join(words), "".join(w for w in words if w.lower() not in T.SYMBOL_STOPWORDS)]
    return [n for n in dict.fromkeys(map(T.normalize_text, names)) if n]


def symbol_arm(symbols: DataFrame, query: str, limit: int, scope: str | None = None) -> DataFrame:
    names = symbol_names(query)
    rows = symbols.filter(F.col("name_norm").isin(*names) & T.in_scope(F.col("path"), scope)) if names else symbols.limit(0)
    rows = rows.withColumn("symbol", F.col("name"))
    exact = F.lower("name") == query.strip().lower()
    return _ranked(rows, "symbol", limit, exact.desc(), F.desc("exported"), F.length("name"), F.col("path"), F.col("start_line"))


def fuse(*arms: DataFrame, limit: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion.  A place's score is the sum over its ranks;
    equal scores keep the order of arms, then of ranks."""
    weights = weights or ARM_WEIGHTS
    rows = arms[0]
    for a in arms[1:]:
        rows = rows.unionByName(a)
    weight = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))))
    rows = rows.withColumn("part", weight[F.col("arm")] / (F.lit(float(RANK_CONSTANT)) + F.col("rank")))
    seen = F.array_sort(F.collect_list(F.struct("arm_at", "rank", "arm", "symbol", "content_hash")))
    rows = rows.groupBy("path", "start_line", "end_line").agg(F.round(F.sum("part"), 9).alias("score"), seen.alias("seen"))
    order = [F.desc("score"), F.col("seen")[0]["arm_at"], F.col("seen")[0]["rank"], F.col("path"), F.col("start_line"), F.col("end_line")]
    best = rows.orderBy(*order).limit(limit)
    first = lambda name: F.get(F.filter(F.transform("seen", lambda s: s[name]), lambda v: v.isNotNull()), 0)
    content = F.coalesce(first("content_hash"), F.col("path"))
    return best.select(
        T.span_id(content, F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"), "path", "start_line", "end_line", first("symbol").alias("symbol"),
        F.transform("seen", lambda s: s["arm"]).alias("matched"), "score", F.row_number().over(Window.orderBy(*order)).alias("rank"),
    )


def per_arm(limit: int) -> int:
    return max(3 * limit, 30)


def search(index: dict[str, DataFrame], query: str, *, scope: str | None = None, limit: int = 20, texts: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Fused spans; with ``texts`` (path, text) each also has its live ``text``."""
    n = per_arm(limit)
    arms = [bm25_arm(index, query, n, scope), symbol_arm(index["symbols"], query, n, scope)]
    if trigram_applies(query):  # a plan without the arm, rather than an arm without rows
        arms.insert(1, trigram_arm(index, query, n, scope))
    found = fuse(*arms, limit=limit, weights=weights)
    return found if texts is None else with_text(found, texts)


def with_text(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Text of spans, from the files as they are; missing files give ''."""
    files = texts.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
    rows = spans.join(files, F.col("path") == F.col("_path"), "left")
    return rows.withColumn("text", T.line_slice(F.col("_text"), F.col("start_line"), F.col("end_line"))).drop("_path", "_text")


def lookup_symbol(symbols: DataFrame, name: str, *, limit: int = 20, kind: str | None = None, any_convention: bool = False) -> DataFrame:
    """Symbols by name, exact ones first, then exported, then shorter."""
    fits = (F.col("name") == name) | T.like(F.col("name"), f"%{name}%")
    if any_convention:
        fits = fits | (F.col("name_norm") == T.normalize_text(name))
    rows = symbols.filter(fits)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    order = [(F.col("name") == name).desc(), F.desc("exported"), F.length("name"), F.col("path"), F.col("start_line"), F.col("name")]
    return rows.orderBy(*order).limit(limit)


def verify(spans: DataFrame, disk: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trust of each span, and the jobs that follow.

    ``disk``: path, text (null if it can't be read), for files that exist;
    ``indexed``: path, indexed_hash.  Spans of files that are gone are dropped
    and a delete is due; changed files give their live lines and are due for
    parsing; unreadable ones are ``unverified``.
    """
    now = disk.select(F.col("path").alias("_path"), F.col("text").alias("_text"), T.short_hash(F.col("text")).alias("_hash"))
    then = indexed.select(F.col("path").alias("_ipath"), F.col("indexed_hash").alias("_indexed"))
    rows = spans.join(now, F.col("path") == F.col("_path"), "left").join(then, F.col("path") == F.col("_ipath"), "left")
    live = F.col("_path").isNotNull()
    same = F.col("_hash").eqNullSafe(F.col("_indexed"))
    trust = F.when(F.col("_text").isNull(), F.lit("unverified")).when(same, F.lit("verified")).otherwise(F.lit("stale-refreshed"))
    kept = rows.filter(live).withColumn("trust", trust)
    text = T.line_slice(F.col("_text"), F.col("start_line"), F.col("end_line"))
    if "text" in spans.columns:
        text = F.when(F.col("trust") == "stale-refreshed", text).otherwise(F.col("text"))
    jobs = rows.select("path", F.when(~live, F.lit("delete")).when(F.col("_text").isNotNull() & ~same, F.lit("parse")).alias("kind"), F.lit(0).alias("priority")).filter("kind is not null").distinct()
    return kept.withColumn("text", text).drop("_path", "_text", "_hash", "_ipath", "_indexed"), jobs


def pack(spans: DataFrame, max_tokens: int, *, by: list[str] | None = None, cost: Column | None = None) -> DataFrame:
    """Greedy choice of spans in order of ``rank`` for a token budget.

    One pass: a span over the budget is passed over (a later smaller one may
    fit); while fewer than three files are in, a second span of a file is
    passed over for good.  One row for each group ``by``: spans (array of
    path, rank, cost), tokens, truncated.  A group is one answer, so small.
    """
    by = by or []
    cost = F.ceil(F.length("text") / 4).cast("int") + SPAN_COST if cost is None else cost
    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("path"), cost.cast("int").alias("cost"))
    rows = spans.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("tokens"), F.array().cast("array<struct<rank:int,path:string,cost:int>>").alias("kept"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.array_contains(acc["paths"], x["path"])
        skip = (acc["tokens"] + x["cost"] > max_tokens) | (seen & (F.size(acc["paths"]) < VARIETY))
        return F.when(skip, acc).otherwise(F.struct((acc["tokens"] + x["cost"]).alias("tokens"), F.concat(acc["kept"], F.array(x)).alias("kept"), F.when(seen, acc["paths"]).otherwise(F.concat(acc["paths"], F.array(x["path"]))).alias("paths")))

    rows = rows.withColumn("packed", F.aggregate("items", start, step))
    return rows.select(*by, F.col("packed.kept").alias("spans"), F.col("packed.tokens").alias("tokens"), (F.size("packed.kept") < F.size("items")).alias("truncated"))


def pack_levels(spans: DataFrame, max_tokens: int, *, by: list[str] | None = None, reserve: float = RESERVE) -> DataFrame:
    """Spans at the level of detail that lets most of them in.

    ``spans`` has rank, path, ``expanded`` (reached over the graph) and the costs
    ``full``, ``skeleton`` and ``reference``.  What was found goes first and may use
    all but the reserve; what was reached over the graph gets the rest.  In order of
    rank, a span takes the fullest level that still leaves room for the references of
    those behind it, else a reference if that fits, else it is left out.  While fewer
    than three files are in, a further span of a file is a reference.  One row for
    each group ``by``: spans (array of rank, path, level, cost), tokens, truncated.
    A group is one answer, so small."""
    by = by or []
    kind = "struct<expanded:boolean,rank:int,path:string,full:int,skeleton:int,reference:int>"
    item = F.struct(F.coalesce("expanded", F.lit(False)).alias("expanded"), F.col("rank").cast("int").alias("rank"), "path", *(F.col(c).cast("int").alias(c) for c in LEVELS))
    rows = spans.groupBy(*by).agg(F.array_sort(F.collect_list(item)).cast(f"array<{kind}>").alias("items"))
    behind = lambda flag: F.aggregate("items", F.lit(0), lambda a, x: a + F.when(x["expanded"] == flag, x["reference"]).otherwise(0))
    start = F.struct(
        F.lit(0).alias("tokens"), F.array().cast("array<struct<rank:int,path:string,level:string,cost:int>>").alias("kept"), F.array().cast("array<string>").alias("paths"),
        behind(False).alias("found"), behind(True).alias("reached"),
    )

    def step(acc: Column, x: Column) -> Column:
        room = F.when(x["expanded"], F.lit(max_tokens)).otherwise(F.lit(int(max_tokens * (1 - reserve)))) - acc["tokens"]
        later = F.when(x["expanded"], acc["reached"]).otherwise(acc["found"]) - x["reference"]
        seen = F.array_contains(acc["paths"], x["path"])
        whole = ~(seen & (F.size(acc["paths"]) < VARIETY))
        level = F.when(whole & (x["full"] <= room - later), F.lit("full")).when(whole & (x["skeleton"] <= room - later), F.lit("skeleton")).when(x["reference"] <= room, F.lit("reference"))
        cost = F.when(level == "full", x["full"]).when(level == "skeleton", x["skeleton"]).when(level == "reference", x["reference"]).otherwise(0)
        return F.struct(
            (acc["tokens"] + cost).alias("tokens"),
            F.when(level.isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(F.struct(x["rank"].alias("rank"), x["path"].alias("path"), level.alias("level"), cost.alias("cost"))))).alias("kept"),
            F.when(level.isNull() | seen, acc["paths"]).otherwise(F.concat(acc["paths"], F.array(x["path"]))).alias("paths"),
            (acc["found"] - F.when(x["expanded"], 0).otherwise(x["reference"])).alias("found"), (acc["reached"] - F.when(x["expanded"], x["reference"]).otherwise(0)).alias("reached"),
        )

    rows = rows.withColumn("packed", F.aggregate("items", start, step))
    return rows.select(*by, F.col("packed.kept").alias("spans"), F.col("packed.tokens").alias("tokens"), (F.size("packed.kept") < F.size("items")).alias("truncated"))


def envelope(packed: DataFrame, jobs: DataFrame) -> DataFrame:
    """Packed answers as JSON, each with the state of the index: whether jobs
    wait, and how many.  Other columns of ``packed`` are kept."""
    waits = jobs.agg(F.count_if(F.col("state") == "pending").alias("queue_depth"))  # one row
    rows = packed.join(F.broadcast(waits))
    state = F.struct((F.col("queue_depth") == 0).alias("fresh"), "queue_depth", F.lit(0).alias("vector_coverage"), F.lit(0).alias("precise_coverage"))
    body = F.struct(state.alias("index"), "spans", "tokens", "truncated")
    return rows.select(*(c for c in packed.columns if c not in ("spans", "tokens", "truncated")), F.to_json(body).alias("json"))


def outline(symbols: DataFrame, path: str) -> DataFrame:
    """Symbols of a file or of all files below a directory, one row a file."""
    rows = symbols.filter(T.under(F.col("path"), path))
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("line"), "kind", "name", "signature", "exported"))).alias("symbols"))


def expand(file_chunks: DataFrame, texts: DataFrame, span: str, before: int = 20, after: int = 20) -> DataFrame:
    """The lines around a span, clamped to its file; no row if the id is
    unknown."""
    rows = file_chunks.filter(T.span_id(F.col("content_hash"), F.col("path"), F.col("start_line"), F.col("end_line")) == span)
    rows = expand_all(rows.select("path", "start_line", "end_line").distinct(), texts, before, after)
    return rows.select("path", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), "text")


def place_of(index: dict[str, DataFrame], span: str) -> dict | None:
    """Path and lines of a span id: of a chunk, or of a symbol that no chunk
    was found with."""
    by = lambda content: T.span_id(content, F.col("path"), F.col("start_line"), F.col("end_line")) == span
    rows = index["file_chunks"].filter(by(F.col("content_hash"))).select("path", "start_line", "end_line")
    rows = rows.unionByName(index["symbols"].filter(by(F.col("path"))).select("path", "start_line", "end_line"))
    row = rows.first()
    return row and row.asDict()


def expand_all(places: DataFrame, texts: DataFrame, before: int, after: int) -> DataFrame:
    """Places (path, start_line, end_line) with the lines around them:
    ``first_line``, ``last_line`` and ``text``."""
    rows = places.join(texts.select("path", F.col("text").alias("_text")), "path")
    first, end = F.greatest(F.lit(1), F.col("start_line") - before), F.least(F.size(F.split("_text", "\n")), F.col("end_line") + after)
    return rows.withColumns({"first_line": first, "last_line": end, "text": T.line_slice(F.col("_text"), first, end)}).drop("_text")


def path_fuzzy(paths: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Paths that hold the query's characters in order, shorter ones first."""
    letters = [c if c.isalnum() or c == "_" else "\\" + c for c in query.lower()]
    rows = paths.filter(F.lower("path").rlike("(?s)" + ".*?".join(letters)))
    return rows.orderBy(F.length("path"), "path").limit(limit)


def merge_near(spans: DataFrame, gap: int = 5) -> DataFrame:
    """Spans of a file that overlap or stand within ``gap`` lines, as one."""
    order = Window.partitionBy("path").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", (reach.isNull() | (F.col("start_line") > reach + gap)).cast("int"))
    # By range: equal spans count alike, so their order among themselves changes nothing.
    rows = rows.withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("path", "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("score").alias("score")).drop("_island")
