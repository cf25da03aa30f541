"""Registered queries on the driver's tables.

Documents play the files of a corpus (path ``source/doc_id.txt``), pages the
link graph, events the change feed, labels the state of files, conversations
the spans to pack, embeddings the vector arm.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import code_text as T
from quarryline.operators import batch, changefeed, expansion, graph, ignore, indexing, merkle, prose, retrieval, status, vectors
from quarryline.operators.parse import parse_files
from quarryline.plans import codebase
from quarryline.session import shared_folder, ship, stored
from quarryline.sources import git

WINDOW = 20
PHRASE = "GNU General Public License"
PHRASES = "public-license foundation.software"
WORD = "ention."
NAME = "LANTERN_3"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.text_chunks(corpus(spark, sf_dir), WINDOW)


#: Bytes of text that a task cuts into words.
TASK_BYTES = 12 << 20


def spread_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_rows``, marked where they are the first of equal ones, in tasks of
    bounded size, however the table is stored: a file of one row group is else
    one task's work."""
    docs = corpus(spark, sf_dir)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return indexing.marked_chunks(docs.repartition(tasks, "doc_id"), WINDOW)


_READY: dict[tuple[str, str], tuple[str, indexing.Index]] = {}


def ready_index(spark: SparkSession, sf_dir: str) -> indexing.Index:
    """The stored index of the corpus, made once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _READY:
        # The mapped chunks are one table, of which the index reads its columns; equal chunks of a file are one to it.
        rows = stored(spread_chunks(spark, sf_dir))
        tables = {"chunks": rows.filter("first").select("content_hash", "header", "body", "kind", "lang", "n_tokens"), "file_chunks": rows.select("path", "ord", "start_line", "end_line", "content_hash")}
        symbols = spark.createDataFrame([], "path string, name string, kind string, start_line int, end_line int, exported boolean, name_norm string")
        path = f"{shared_folder(spark)}/quarryline-index/{uuid.uuid4().hex}"
        indexing.save({"symbols": symbols}, path, search=tables["chunks"])
        _READY[key] = path, tables
    path, tables = _READY[key]
    return indexing.load(spark, path) | tables


# Text functions


@query
def tokenize_docs(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("tokens_md5"))


@query
def identifiers_per_doc(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("doc_id", T.identifiers(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_identifiers"), F.md5(F.array_join(F.array_sort("ids"), " ")).alias("identifiers_md5"))


@query
def normalized_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.normalize_name(F.concat("p_brand", F.lit("_"), "p_name")).alias("name_norm"))


@query
def detect_languages(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, (".ts", ".TSX", ".py", ".go", ".rs", ".txt", ".d.mts", ""))), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat("source", F.lit("/f"), "doc_id", ending)
    return read(spark, sf_dir, "documents").select("doc_id", T.detect_lang(path).alias("detected"))


@query
def fts_words(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("doc_id", T.fts_words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))


# Ingestion


@query
def content_skip_rules(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", ignore.content_reason(F.col("text")).alias("reason"))


@query
def path_skip_rules(spark, sf_dir):
    shapes = ("src/a.ts", "node_modules/x.js", "app.min.js", "notes.tmp", ".#lock", "a/b/dist/c.py", "logo.PNG", "x~", "docs/readme.md", "4913", "src/.cache", "")
    path = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("reason", ignore.path_reason(F.col("path")))


@query
def ignore_file_rules(spark, sf_dir):
    files = {".gitignore": "*.log\n/only-root/\nsrc11/\n", "src1/.gitignore": "!keep.log\n7*.txt\n!7?.txt\n", "src2/.gitignore": "**/9?.txt\n"}
    rows = corpus(spark, sf_dir)
    reason = ignore.ignored_reason(files)
    return rows.select("doc_id", reason(F.col("path")).alias("reason"))


@query
def line_chunks(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    return rows.select("path", "ord", "start_line", "end_line", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


@query
def chunk_addresses(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    return rows.select("path", "ord", "content_hash", "n_tokens", T.span_id(F.col("content_hash"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("span_id"))


@query
def content_hash_dedupe(spark, sf_dir):
    """Chunks that say nothing of their place: equal bodies are one."""
    rows = indexing.addressed(chunk_rows(spark, sf_dir).withColumn("header", F.lit("lang: text")))
    rows = indexing.distinct_chunks(rows)
    return rows.select("content_hash", "header", F.md5("body").alias("body_md5"), "kind", "lang", "n_tokens")


@query
def gc_dead_chunks(spark, sf_dir):
    """Chunks of documents labelled toxic lose their mapping."""
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    rows = indexing.text_chunks(corpus(spark, sf_dir), WINDOW)
    gone = corpus(spark, sf_dir).join(toxic, "doc_id").select("path")
    index = {"chunks": rows.select("content_hash", "n_tokens"), "file_chunks": rows.select("path", "content_hash"), "symbols": rows.select("path"), "edges": rows.select("path")}
    return indexing.garbage(indexing.without_paths(index, gone))


@query
def heading_chunks(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("path", F.regexp_replace("text", r"(?m)^([A-Z][a-z]{2,6}\.)$", "# $1").alias("text"))
    return prose.heading_chunks(rows).select("path", "ord", "heading", F.md5("body").alias("body_md5"))


@query
def overlapping_windows(spark, sf_dir):
    return prose.overlapping_windows(corpus(spark, sf_dir), 20, 0.15).select("path", "ord", "start_line", "end_line", F.md5("body").alias("body_md5"))


#: Files that a task parses, some seconds of work.
TASK_FILES = 2048


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code base of one file for each part.  The table is a few bytes a file,
    so its splits hold far more files than a task should parse."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(part.count() / TASK_FILES))
    return codebase.code_files(part.repartition(tasks, "p_partkey"))


@query
def parse_symbols(spark, sf_dir):
    parsed = parse_files(source_files(spark, sf_dir), parts=["symbols"])
    rows = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return rows.select("path", "name", "kind", "parent", "start_line", "end_line", "exported", "signature", "doc")


@query
def code_index_edges(spark, sf_dir):
    return indexing.build(source_files(spark, sf_dir))["edges"]


@query
def code_import_graph(spark, sf_dir):
    files = source_files(spark, sf_dir)
    return graph.import_edges(indexing.build(files)["edges"], files.select("path"))


@query
def code_search(spark, sf_dir):
    index = indexing.build(source_files(spark, sf_dir), hold=stored)
    index["chunks"] = stored(index["chunks"])
    found = retrieval.search(indexing.searchable(index, stored), NAME, limit=10)
    return found.select("rank", "path", "start_line", "end_line", F.array_join("matched", "+").alias("matched"), F.round("score", 6).alias("score"))


# Retrieval


def _bm25(spark, sf_dir, query=PHRASE, scope=None):
    index = ready_index(spark, sf_dir)
    hits = retrieval._located(retrieval.bm25_postings(index["postings"], index["stats"], query), index["file_chunks"], scope)
    hits = hits.select("path", "start_line", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "path", "start_line").limit(30)


@query
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query
def bm25_scoped(spark, sf_dir):
    return _bm25(spark, sf_dir, scope="src1")


@query
def bm25_phrases(spark, sf_dir):
    """Tokens of several words are phrases."""
    return _bm25(spark, sf_dir, PHRASES)


@query
def bm25_without_index(spark, sf_dir):
    """The same hits from the chunks themselves."""
    rows = spread_chunks(spark, sf_dir)
    hits = retrieval.bm25(indexing.fts_table(rows.filter("first")), PHRASES, stored).select("content_hash", F.round("score", 6).alias("score"))
    hits = rows.select("content_hash", "path", "start_line").join(hits, "content_hash").select("path", "start_line", "score")
    return hits.orderBy(F.desc("score"), "path", "start_line").limit(30)


@query
def trigram_search(spark, sf_dir):
    return retrieval.trigram_arm(ready_index(spark, sf_dir), WORD, 30).select("path", "start_line", "end_line", "rank")


@query
def symbol_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.concat("p_brand", F.lit("/"), "p_partkey").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_retailprice") > 1000).alias("exported"))
    return retrieval.lookup_symbol(rows, "Red_widget").unionByName(retrieval.lookup_symbol(rows, "red widget"))


@query
def symbol_arm(spark, sf_dir):
    """Customers as symbols: named by their segment, many share a name."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("path"), F.col("c_custkey").cast("int").alias("start_line"), F.col("c_custkey").cast("int").alias("end_line"), (F.col("c_acctbal") > 0).alias("exported"))
    rows = rows.unionByName(read(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"), F.col("c_mktsegment").alias("path"), F.col("c_custkey").cast("int").alias("start_line"), F.col("c_custkey").cast("int").alias("end_line"), F.lit(True).alias("exported")))
    rows = rows.withColumn("name_norm", T.normalize_name(F.col("name")))
    found = [retrieval.symbol_arm(rows, q, n).withColumn("query", F.lit(q)) for q, n in (("building", 40), ("Auto mobile", 15), ("customer#000000007", 10))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("query", "path", "start_line", "symbol", "rank")


@query
def rrf_search(spark, sf_dir):
    found = retrieval.search(ready_index(spark, sf_dir), WORD, limit=20)
    return found.select("rank", "path", "start_line", "end_line", F.array_join("matched", "+").alias("matched"), F.round("score", 6).alias("score"), "id")


@query
def scope_filter(spark, sf_dir):
    path = F.col("path")
    rows = corpus(spark, sf_dir)
    return rows.select("doc_id", T.in_scope(path, "src1").alias("plain"), T.in_scope(path, "src[12]/?5").alias("glob"), T.under(path, "src2/").alias("below"), T.like(path, "SRC_/%9.txt").alias("liked"))


@query
def path_fuzzy(spark, sf_dir):
    return retrieval.path_fuzzy(corpus(spark, sf_dir).select("path"), "s1/77", 25)


def _packed(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("rank"), F.concat("role", (F.col("turn") % 4).cast("string")).alias("path"), "text")
    return retrieval.pack(rows, 400, by=["conv_id"])


@query
def pack_budget(spark, sf_dir):
    packed = _packed(spark, sf_dir)
    return packed.select("conv_id", F.array_join(F.transform("spans", lambda s: s["rank"].cast("string")), ",").alias("ranks"), "tokens", "truncated")


@query
def pack_levels(spark, sf_dir):
    """Turns as spans, assistants' turns as what the graph adds."""
    size = F.length("text")
    rows = read(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("rank"), F.concat("role", (F.col("turn") % 4).cast("string")).alias("path"), (F.col("role") == "assistant").alias("expanded"), (F.ceil(size / 4) + 32).alias("full"), (F.ceil(size / 16) + 20).alias("skeleton"), F.lit(12).alias("reference"))
    packed = retrieval.pack_levels(rows, 240, by=["conv_id"])
    return packed.select("conv_id", F.array_join(F.transform("spans", lambda s: F.concat(s["rank"].cast("string"), F.lit(":"), s["level"])), ",").alias("levels"), "tokens", "truncated")


@query
def expand_span(spark, sf_dir):
    """Every chunk with five lines around it."""
    places = chunk_rows(spark, sf_dir).select("path", "start_line", "end_line", "content_hash")
    rows = retrieval.expand_all(places, corpus(spark, sf_dir), 5, 5)
    return rows.select("path", "start_line", "end_line", "first_line", "last_line", F.md5("text").alias("text_md5"))


@query
def verify_spans(spark, sf_dir):
    """Half of the documents changed since indexing, some are gone."""
    docs = corpus(spark, sf_dir)
    spans = docs.select("path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), T.line_slice(F.col("text"), F.lit(1), F.lit(1)).alias("text"))
    disk = docs.filter("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 != 0, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new\n"), "text")).otherwise(F.col("text"))).alias("text"))
    kept, jobs = retrieval.verify(spans, disk, docs.select("path", T.short_hash(F.col("text")).alias("indexed_hash")))
    kept = kept.select("path", "trust", F.md5("text").alias("text_md5"))
    return kept.join(jobs.select("path", F.col("kind").alias("job")), "path", "full")


@query
def merge_near_spans(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.col("l_quantity").cast("int").alias("start_line"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("end_line"), F.col("l_discount").alias("score"))
    return retrieval.merge_near(rows, 5)


@query
def outline(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_type").alias("path"), F.col("p_partkey").cast("int").alias("start_line"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("signature"), F.lit(True).alias("exported"))
    found = retrieval.outline(rows, "Brand#1/")
    return found.select("path", F.array_join(F.transform("symbols", lambda s: F.concat(s["line"].cast("string"), F.lit(":"), s["name"])), ";").alias("symbols"))


@query
def tool_response_json(spark, sf_dir):
    """Packed answers in their envelope; events play the jobs."""
    return retrieval.envelope(_packed(spark, sf_dir), _jobs(spark, sf_dir))


# Status and graphs


def _files(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.when(F.col("quality").isNotNull(), F.md5("text")).alias("indexed_hash"), F.when(F.col("quality") == 1, F.lit("ok")).when(F.col("toxic") == 1, F.lit("errors")).alias("parse_state"), F.when(F.col("lang") != "es", F.when(F.col("lang") == "en", F.lit("text")).otherwise(F.col("lang"))).alias("lang"))


@query
def status_counts(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", F.lit("pending")).when(F.col("event_type") == "error", F.lit("dead")).otherwise(F.lit("done")).alias("state"))
    return status.status(_files(spark, sf_dir), read(spark, sf_dir, "part").select("p_partkey"), chunk_rows(spark, sf_dir).select("path"), jobs)


@query
def coverage_ratio(spark, sf_dir):
    rows = _files(spark, sf_dir).groupBy(F.split("path", "/")[0].alias("module")).agg(F.count("*").alias("files"), F.count("indexed_hash").alias("indexed"))
    return rows.select("module", "files", "indexed", F.round(status.ratio(F.col("indexed"), F.col("files")), 9).alias("coverage"))


@query
def kind_histogram(spark, sf_dir):
    return status.histogram(read(spark, sf_dir, "documents"), "lang")


@query
def unique_chunks(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).select("path", T.short_hash(F.col("body")).alias("h"))
    return rows.agg(F.count("*").alias("chunks"), F.countDistinct("h").alias("unique_chunks"), F.countDistinct("path").alias("files"))


@query
def hotspots(spark, sf_dir):
    return status.hotspots(chunk_rows(spark, sf_dir).select("path"))


def _links(spark, sf_dir):
    """Pages by host and first path segment; links name a path of their host."""
    pages = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    rest = F.regexp_extract("url", r"://[^/?#]*/([^/?#]*)", 1)
    own = F.concat(host, F.lit("/"), rest)
    pairs = pages.select(own.alias("source"), host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'href="/([^"/?#]*)'), 1)).alias("href"))
    nodes = pages.select(own.alias("id")).groupBy("id").agg(F.count("*").alias("weight"))
    targets = nodes.select(F.col("id").alias("target"))
    return pairs.select("source", F.concat("host", F.lit("/"), "href").alias("target")).join(targets, "target", "left_semi"), nodes


@query
def link_graph_edges(spark, sf_dir):
    pairs, nodes = _links(spark, sf_dir)
    return graph.link_graph(pairs, nodes, max_nodes=1_000_000)["edges"]


@query
def link_graph_modules(spark, sf_dir):
    """Modules are registered domains; hosts link by shared first labels."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]*/([^/?#]*)", 1).alias("first"))
    base = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    rows = pages.select(F.concat_ws("/", base, "first", "host", F.col("page_id").cast("string")).alias("id"))
    ring = rows.select(F.col("id").alias("source"), F.lead("id").over(Window.partitionBy(F.substring("id", -1, 1)).orderBy("id")).alias("target")).filter("target is not null")
    return graph.link_graph(ring, rows.withColumn("weight", F.lit(1)), depth=2)["edges"]


@query
def link_graph_nodes(spark, sf_dir):
    pairs, nodes = _links(spark, sf_dir)
    return graph.link_graph(pairs, nodes, max_nodes=50)["nodes"]


@query
def isolated_nodes(spark, sf_dir):
    pairs, nodes = _links(spark, sf_dir)
    return graph.link_graph(pairs, nodes)["isolated"]


@query
def link_degrees(spark, sf_dir):
    pairs, _ = _links(spark, sf_dir)
    return graph.degrees(pairs.filter("source <> target").distinct())


def _calls(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("calls").alias("kind"), F.col("l_linenumber").alias("line"))
    return rows


@query
def callers(spark, sf_dir):
    return graph.callers(_calls(spark, sf_dir), "p7")


@query
def callees(spark, sf_dir):
    return graph.callees(_calls(spark, sf_dir), "s3")


@query
def call_edges(spark, sf_dir):
    """Items as calls: orders are files, suppliers call one of six names, of
    which two are too common and two too short."""
    name = F.element_at(F.array(*map(F.lit, ("holdLine", "map", "ok", "tieUp", "println", "go"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).cast("string").alias("path"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("src"), name.alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), (F.col("l_orderkey") % 997 * 10 + F.col("l_linenumber")).cast("int").alias("line"))
    return indexing.call_edges(rows)


@query
def symbol_dedupe(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 10).alias("path"), F.col("event_type").alias("name"), (F.col("event_id") % 50).cast("int").alias("start_line"), F.when(F.col("event_id") % 3 == 0, F.lit("constant")).otherwise(F.lit("function")).alias("kind"), F.col("event_id").alias("ord"))
    return indexing.deduplicated_symbols(rows)


@query
def page_rank(spark, sf_dir):
    """Centrality of nations over customers' and suppliers' trade."""
    li, orders, customers, suppliers = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    trade = li.join(orders, li.l_orderkey == orders.o_orderkey).join(customers, orders.o_custkey == customers.c_custkey).join(suppliers, li.l_suppkey == suppliers.s_suppkey)
    links = trade.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count("*").alias("weight")).filter("source <> target")
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return graph.pagerank(links, nodes, rounds=3).select("id", F.round("rank", 9).alias("rank"))


@query
def co_changes(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("path"), F.col("l_orderkey").alias("sha")).distinct()
    return graph.co_changes(rows).filter("commits >= 2")


# Change feed


def _events(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return rows.select(F.lit("w").alias("workspace"), F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 7 * 5).cast("int")).alias("priority"), ms.alias("enqueued_at"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("payload"), F.col("event_id").alias("seq"))


def _jobs(spark, sf_dir):
    """Every event as a job in some state."""
    rows = _events(spark, sf_dir)
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "running", "dead"))), (F.col("seq") % 4 + 1).cast("int"))
    return rows.select(F.col("seq").alias("id"), "workspace", "path", "kind", F.coalesce("priority", F.lit(5)).alias("priority"), state.alias("state"), "enqueued_at", F.when(state == "running", F.col("enqueued_at") + 30_000).alias("lease_until"), F.when(state == "running", F.lit("w1")).alias("worker"), (F.col("seq") % 6).cast("int").alias("attempts"), F.when(state == "dead", F.concat(F.lit("error "), "seq")).alias("last_error"), "payload")


NOW = 1_705_000_000_000  # within the events' month


@query
def job_coalesce(spark, sf_dir):
    return changefeed.coalesce_events(_events(spark, sf_dir)).drop("workspace")


@query
def job_enqueue(spark, sf_dir):
    """Events before ``NOW`` are jobs in some state, later ones are enqueued."""
    jobs = _jobs(spark, sf_dir).filter(F.col("enqueued_at") < NOW)
    rows = changefeed.enqueue(jobs, _events(spark, sf_dir).filter(F.col("enqueued_at") >= NOW))
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.sum("priority").alias("priorities"), F.max("enqueued_at").alias("latest"))


@query
def job_claim_batch(spark, sf_dir):
    rows = changefeed.claim(_jobs(spark, sf_dir), "w9", NOW, n=25, kinds=("click", "view"))
    return rows.select("id", "path", "kind", "priority", "state", "attempts", "lease_until")


@query
def job_fail_dead(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    errors = jobs.filter("state = 'running' and id % 3 = 0").select("id", F.repeat(F.lit("boom "), 600).alias("error"))
    return changefeed.fail(jobs, errors).select("id", "state", F.coalesce("lease_until", F.lit(-1)).alias("lease_until"), "worker", F.coalesce(F.length("last_error"), F.lit(0)).alias("error_chars"))


@query
def job_complete(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return changefeed.complete(jobs, jobs.filter("state = 'running'")).groupBy("state").agg(F.count("*").alias("n"))


@query
def lease_sweep(spark, sf_dir):
    jobs, recovered = changefeed.sweep(_jobs(spark, sf_dir), NOW)
    counts = jobs.groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.count("lease_until").alias("leases"), F.count("worker").alias("workers"))
    zero = F.lit(0).cast("long")
    return counts.unionByName(recovered.select(F.lit("recovered").alias("state"), F.col("recovered").alias("n"), zero.alias("ids"), zero.alias("leases"), zero.alias("workers")))


@query
def retry_dead(spark, sf_dir):
    jobs = changefeed.retry_dead(_jobs(spark, sf_dir))
    return jobs.select("id", "path", "kind", "state", "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"))


@query
def queue_depth(spark, sf_dir):
    return changefeed.depth(_jobs(spark, sf_dir))


@query
def debounce_sessions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = changefeed.debounce(rows, "user_id", "ts", "2 hours")
    return out.select("user_id", F.unix_millis("first_at").alias("first_ms"), F.unix_millis("due_at").alias("due_ms"), "events")


@query
def git_suppression(spark, sf_dir):
    rows = _events(spark, sf_dir).select("workspace", "kind", "seq", F.col("enqueued_at").alias("at"))
    kept = changefeed.not_after_git(rows.filter("kind <> 'error'"), rows.filter("kind = 'error'"), 120_000)
    return kept.select("seq", "kind")


@query
def skip_decision(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "doc_id")
    snapshot = docs.select(path.alias("path"), (F.col("doc_id") * 10.5).alias("mtime"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"))
    files = docs.filter("doc_id % 3 <> 0").select(path.alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 10.5).otherwise(F.lit(1.0)).alias("disk_mtime"), F.col("n_chars").alias("disk_size"), (F.col("doc_id") * 10.5 + F.col("doc_id") % 5 * 600).alias("read_at"), F.when(F.col("doc_id") % 4 != 0, T.short_hash(F.col("text"))).otherwise(F.lit("old")).alias("indexed_hash"))
    return changefeed.decide_work(snapshot, files)


@query
def git_changes(spark, sf_dir):
    shapes = ("M\tsrc/a{}.ts", "A\tsrc/b{}.ts", "D\tsrc/c{}.ts", "R100\told/d{}.ts\tnew/d{}.ts", " M src/e{}.py", "?? src/f{}.py", " D src/g{}.py", "R  old/h{}.py -> new/h{}.py")
    line = F.element_at(F.array(*map(F.lit, shapes)), (F.col("doc_id") % 8 + 1).cast("int"))
    lines = read(spark, sf_dir, "documents").select(F.replace(line, F.lit("{}"), F.col("doc_id").cast("string")).alias("value"))
    return git.changes(lines)


def _states(spark, sf_dir):
    """Documents in folders, before and after: where the language is German or
    French some are gone, changed, moved or copied."""
    docs = read(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 7).cast("string"))
    before = docs.select("doc_id", "lang", F.concat(folder, F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.md5("text").alias("hash"))
    touched, k = F.col("lang").isin("de", "fr"), F.col("doc_id") % 11
    after = before.filter(~touched | (k != 0)).select("doc_id", F.when(touched & (k == 2), F.concat(F.lit("moved/"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), "doc_id")).otherwise(F.col("path")).alias("path"), F.when(touched & (k == 1), F.md5("path")).otherwise(F.col("hash")).alias("hash"))
    copies = before.filter(touched & (k == 3)).select("doc_id", F.concat(F.lit("copies/"), "path").alias("path"), "hash")
    return before.select("path", "hash"), after.unionByName(copies).select("path", "hash")


@query
def merkle_changes(spark, sf_dir):
    """What changed between two states, found from the hashes of folders."""
    before, after = _states(spark, sf_dir)
    return merkle.compare(merkle.tree(before), merkle.tree(after)).changes


@query
def expand_graph(spark, sf_dir):
    """Two hops from every hundredth order: orders call parts, the first item
    of an order is a precise edge."""
    items = read(spark, sf_dir, "lineitem")
    edges = items.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.when(F.col("l_linenumber") == 1, F.lit("precise")).otherwise(F.lit("heuristic")).alias("precision"))
    orders = read(spark, sf_dir, "orders")
    anchors = orders.filter("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("o"), "o_orderkey").alias("node"))
    costs = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (F.col("o_orderkey") % 7 + 10).alias("cost"))
    costs = costs.unionByName(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_size") + 5).cast("long").alias("cost")))
    found = expansion.within_budget(expansion.expand_each(edges, anchors, hops=2), costs, 800)
    return found.select("answer_id", "rank", "node", "hop", "relation", "score", "tokens")


def _asked(spark, sf_dir):
    """Queries from every hundredth document: its first long word, and for
    every other one of them its second too."""
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{6,}$")))
    rows = corpus(spark, sf_dir).filter("doc_id % 100 = 0").withColumn("words", words).filter(F.size("words") > 1)
    return rows.select(F.col("doc_id").alias("query_id"), "path", F.when(F.col("doc_id") % 200 == 0, F.get("words", F.lit(0))).otherwise(F.array_join(F.slice("words", 1, 2), " ")).alias("query"))


@query
def batch_search(spark, sf_dir):
    found = batch.search_each(ready_index(spark, sf_dir), _asked(spark, sf_dir).select("query_id", "query"), limit=10)
    return found.select("query_id", "rank", "path", "start_line", "end_line", F.array_join("matched", "+").alias("matched"), F.round("score", 6).alias("score"))


@query
def eval_ablation(spark, sf_dir):
    """Does a query find the document it was taken from, and at what cost?"""
    asked = stored(_asked(spark, sf_dir))
    costs = chunk_rows(spark, sf_dir).select("path", "start_line", "end_line", (F.ceil(F.length("body") / 4).cast("int") + retrieval.SPAN_COST).alias("cost"))
    return batch.ablation(ready_index(spark, sf_dir), asked.select("query_id", "query"), asked.select("query_id", "path"), costs, k=10, arms=("bm25", "trigram"))


# Vectors, prose, evaluation


def _first_vector(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").orderBy("vec_id").first().embedding


@query
def vector_topk(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20)


@query
def vector_topk_int8(spark, sf_dir):
    return vectors.top_k(read(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20, int8=True)


@query
def vector_quantise(spark, sf_dir):
    codes, scale = vectors.quantise(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(scale, 9).alias("scale"), F.aggregate(codes, F.lit(0), lambda a, x: a + x.cast("int")).alias("code_sum"))


@query
def redact_secrets(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", prose.redacted(F.col("text")).alias("text"))
    return rows.select("doc_id", (F.regexp_count("text", F.lit(r"\[redacted:"))).cast("long").alias("secrets"), F.md5("text").alias("text_md5"))


@query
def reference_links(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")))
    return prose.references(rows, "doc_id")


@query
def eval_recall_mrr(spark, sf_dir):
    """Vectors near each hundredth vector: do those of its own label rank first?"""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    ranked = vectors.top_k_each(e, e.filter("vec_id % 100 = 0"), 10)
    label = e.select(F.col("vec_id").alias("id"), "label")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    own = ranked.join(label, "id").join(asked, "query_id").filter(F.col("label") == F.col("wanted"))
    sizes = label.groupBy("label").agg(F.count("*").alias("n")).withColumnRenamed("label", "wanted")
    relevant = asked.join(sizes, "wanted").select("query_id", (F.col("n") - 1).alias("wanted"))
    return prose.evaluate_counts(relevant, own.select("query_id", "rank"), 10)
