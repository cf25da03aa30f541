"""Build and maintain the index tables: chunks, mappings, symbols, edges.

Tables (all DataFrames):

* ``file_chunks``: path, ord, start_line, end_line, content_hash
* ``chunks``: content_hash, header, body, kind, lang, n_tokens (one row a hash)
* ``symbols``: path, name, kind, signature, doc, parent, start_line, end_line, exported, name_norm
* ``edges``: path, src, dst, kind, line, precision

A chunk is addressed by the hash of its header and body, so equal content is
stored once.  An update replaces all rows of the paths that it names.

Search reads inverted tables, made by ``searchable`` and kept with the index:

* ``postings``: term, content_hash, length, and the term's places in ``body``,
  ``header`` and ``tokens``
* ``stats``: n chunks and their total length, in rows that add up
* ``idents``: identifier, content_hash
* ``grams``: three characters, identifier (each identifier once)

They are stored by ``bucket``, a hash of the first column, and sorted within, so
a query reads the buckets and row groups of its own terms.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline.functions import code_text as T
from quarryline.operators.parse import parse_files
from quarryline.session import bounded_splits

# Callees that no edge is kept for.
COMMON_CALLEES = (
    "log", "warn", "error", "info", "debug", "trace", "assert", "stringify", "parse", "push", "pop", "shift", "unshift", "slice", "splice", "map",
    "filter", "reduce", "forEach", "find", "some", "every", "join", "split", "concat", "indexOf", "includes", "keys", "values", "entries", "then",
    "catch", "finally", "resolve", "reject", "all", "race", "toString", "valueOf", "test", "exec", "match", "replace", "trim", "startsWith",
    "endsWith", "padStart", "padEnd", "get", "set", "has", "add", "delete", "call", "apply", "bind", "require", "length", "max", "min", "floor",
    "ceil", "round", "abs", "now", "from", "of", "isArray", "describe", "it", "expect", "beforeEach", "afterEach", "beforeAll", "afterAll", "toBe",
    "toEqual", "mock", "spyOn", "print", "len", "str", "int", "float", "list", "dict", "append", "format", "println", "printf", "sprintf", "panic",
    "make", "new", "unwrap", "expect_err", "clone", "into", "to_string", "push_str", "iter", "collect", "ok", "err",
)

Index = dict[str, DataFrame]
Hold = Callable[[DataFrame], DataFrame]


def line_windows(docs: DataFrame, window: int = 120) -> DataFrame:
    """Fixed windows of lines for texts without a parser; blank ones are left
    out.  Columns: path, ord (of the window), start_line, end_line, body."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = lines.groupBy("path", F.floor(F.col("at") / window).cast("int").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.bool_or(F.col("line").rlike(r"\S")).alias("content"),
        F.count("*").alias("n"),
    )
    start = F.col("ord") * window + 1
    return rows.filter("content").select("path", "ord", start.cast("int").alias("start_line"), (start + F.col("n") - 1).cast("int").alias("end_line"), "body")


def line_windows_local(docs: DataFrame, window: int = 120) -> DataFrame:
    """``line_windows`` without a shuffle: windows are sliced out of each
    text's own line array.  For texts whose lines fit a task's memory."""
    lines = F.split("text", "\n")
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / window).cast("int")), lambda i: F.struct(
        i.alias("ord"), (i * window + 1).alias("start_line"), F.least((i + 1) * window, F.size(lines)).alias("end_line"), F.array_join(F.slice(lines, i * window + 1, window), "\n").alias("body"),
    ))
    # Sliced before they are exploded: no row carries its whole text.
    return docs.select("path", F.explode(windows).alias("w")).select("path", "w.*").filter(F.col("body").rlike(r"\S"))


def text_chunks(docs: DataFrame, window: int = 120, lang: str = "text") -> DataFrame:
    """Mapped chunks of plain texts: path, ord, lines, kind, lang, header,
    body, content_hash, n_tokens."""
    rows = line_windows_local(docs, window).withColumns({"lang": F.lit(lang), "kind": F.lit("block")})
    return addressed(rows.withColumn("header", T.header(F.col("path"), F.col("lang"))))


def marked_chunks(docs: DataFrame, window: int = 120, lang: str = "text") -> DataFrame:
    """``text_chunks`` with ``first``: whether no earlier window of its file says
    the same.  Headers name the path, so chunks of other files are never equal,
    and those marked are one row a hash, found without a shuffle."""
    lines = F.split("text", "\n")
    last = F.floor((F.size(lines) - 1) / window).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        F.array_join(F.slice(lines, i * window + 1, window), "\n").alias("body"), i.alias("ord"), (i * window + 1).alias("start_line"), F.least((i + 1) * window, F.size(lines)).alias("end_line"),
    ))
    rows = docs.select("path", F.sort_array(windows).alias("w"))  # equal bodies stand together, the earliest ahead
    before = lambda i: F.get(F.col("w"), i - 1)["body"]
    rows = rows.select("path", F.explode(F.transform("w", lambda w, i: F.struct(w["ord"].alias("ord"), w["start_line"].alias("start_line"), w["end_line"].alias("end_line"), w["body"].alias("body"), (~w["body"].eqNullSafe(before(i))).alias("first")))).alias("w"))
    rows = rows.select("path", "w.*").filter(F.col("body").rlike(r"\S")).withColumns({"lang": F.lit(lang), "kind": F.lit("block")})
    return addressed(rows.withColumn("header", T.header(F.col("path"), F.col("lang"))))


def addressed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"content_hash": T.content_hash(F.col("header"), F.col("body")), "n_tokens": T.token_estimate(F.col("body"))})


def build(files: DataFrame, *, window: int = 120, hold: Hold = lambda df: df) -> Index:
    """Index of files (path, source).  Files without a parser are cut into
    windows of lines.  ``hold`` keeps a table that is read more than once."""
    parsed = hold(parse_files(files).drop("source"))
    symbols = parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    symbols = symbols.withColumn("name_norm", T.normalize_name(F.col("name")))
    # A chunk comes with its text and the symbol that names it, so nothing is joined.
    spans = parsed.select("path", "lang", F.posexplode("chunks").alias("ord", "c")).filter(F.col("c.body").rlike(r"\S"))
    header = T.header(F.col("path"), F.col("lang"), F.col("c.parent"), F.col("c.signature"), F.col("c.doc"))
    code = spans.select("path", "ord", "c.start_line", "c.end_line", "c.body", "lang", F.coalesce("c.kind", F.lit("block")).alias("kind"), header.alias("header"))
    plain = files.filter(T.detect_lang(F.col("path")).isNull()).select("path", F.col("source").alias("text"))
    mapped = addressed(code).unionByName(text_chunks(plain, window))
    return {
        "chunks": distinct_chunks(mapped),
        "file_chunks": mapped.select("path", "ord", "start_line", "end_line", "content_hash"),
        "symbols": symbols,
        "edges": edges(parsed),
    }


def distinct_chunks(mapped: DataFrame) -> DataFrame:
    """One row for each content hash."""
    return mapped.groupBy("content_hash").agg(F.first("header").alias("header"), F.first("body").alias("body"), F.min("kind").alias("kind"), F.first("lang").alias("lang"), F.first("n_tokens").alias("n_tokens"))


def edges(parsed: DataFrame) -> DataFrame:
    """Import edges, and one call edge for each caller and callee of a file.
    Both come from one pass, so that files are parsed once."""
    imports = F.transform("imports", lambda i: F.struct(F.lit("").alias("src"), i["specifier"].alias("dst"), F.lit("imports").alias("kind"), F.lit(0).alias("at"), i["line"].alias("line")))
    calls = F.transform("calls", lambda c, at: F.struct(F.coalesce(c["caller"], F.lit("")).alias("src"), c["name"].alias("dst"), F.lit("calls").alias("kind"), at.alias("at"), c["line"].alias("line")))
    named = F.col("kind") == "imports"
    rows = parsed.select("path", F.explode(F.concat(imports, calls)).alias("e")).select("path", "e.*").filter(named | interesting(F.col("dst")))
    rows = rows.groupBy("path", "src", "dst", "kind").agg(F.min_by("line", "at").alias("first"), F.collect_list(F.when(named, F.col("line"))).alias("lines"))
    lines = F.when(named, F.col("lines")).otherwise(F.array("first"))
    return rows.select("path", "src", "dst", "kind", F.explode(lines).alias("line"), F.lit("heuristic").alias("precision"))


def call_edges(calls: DataFrame) -> DataFrame:
    """One edge for each caller and callee of a file, at the first call (by
    ``at``).  ``calls``: path, src, dst, at, line."""
    rows = calls.filter(interesting(F.col("dst"))).groupBy("path", "src", "dst").agg(F.min_by("line", "at").alias("line"))
    return rows.select("path", "src", "dst", F.lit("calls").alias("kind"), "line")


def interesting(callee):
    return (F.length(callee) > 2) & ~callee.isin(*COMMON_CALLEES)


#: Buckets of the inverted tables.
BUCKETS = 64
_INVERTED = {"postings": "term", "idents": "ident", "grams": "gram"}


def bucket(key: Column) -> Column:
    return (F.crc32(key.cast("binary")) % BUCKETS).cast("int")


def in_buckets(column: str, keys: Iterable[str]) -> Column:
    """Rows of an inverted table with one of some keys, by bucket and key."""
    keys = list(keys)
    return F.col("bucket").isin(sorted({zlib.crc32(k.encode()) % BUCKETS for k in keys})) & F.col(column).isin(keys)


_COLUMNS = ("body", "header", "tokens")


def _places(batches: Iterator) -> Iterator:
    """Chunks with their words by column to one row for each term."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            words, chunk, column, place = [], [], [], []
            for k, name in enumerate(_COLUMNS):
                lists = part.column(name)
                offsets = lists.offsets.to_numpy()
                sizes = np.diff(offsets)
                words.append(lists.flatten())
                chunk.append(np.repeat(np.arange(len(sizes)), sizes))
                column.append(np.full(sizes.sum(), k))
                place.append(np.arange(sizes.sum()) - np.repeat(offsets[:-1] - offsets[0], sizes))
            coded = pa.concat_arrays(words).dictionary_encode()
            chunk, column, place = (np.concatenate(x) for x in (chunk, column, place))
            if not len(chunk):
                continue
            key = chunk * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")  # columns and places ascend already
            key, column, place = key[order], column[order], place[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            row = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            own, term = np.divmod(key[first], len(coded.dictionary))
            arrays = [coded.dictionary.take(pa.array(term)), part.column("content_hash").take(pa.array(own)), part.column("length").take(pa.array(own))]
            for k in range(len(_COLUMNS)):
                mine = column == k
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=len(first)))]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(place[mine])))
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "content_hash", "length", *_COLUMNS])


def _words(batches: Iterator) -> Iterator:
    """Chunks (content_hash, header, body) with their full-text words."""
    import numpy as np
    import pyarrow as pa

    token_words = T.TokenWords()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            heads, bodies = ([x or "" for x in part.column(c).to_pylist()] for c in ("header", "body"))
            found = {"body": map(T.fast_words, bodies), "header": map(T.fast_words, heads), "tokens": (token_words(f"{h}\n{b}") for h, b in zip(heads, bodies, strict=True))}
            arrays, length = {}, np.zeros(part.num_rows, np.int32)
            for name, lists in found.items():
                flat, sizes = [], []
                for words in lists:
                    flat += words
                    sizes.append(len(words))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                arrays[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.string()))
                length += np.diff(ends)
            yield pa.RecordBatch.from_arrays([part.column("content_hash"), *arrays.values(), pa.array(length)], names=["content_hash", *arrays, "length"])


def _postings(batches: Iterator) -> Iterator:
    return _places(_words(batches))


def fts_table(chunks: DataFrame) -> DataFrame:
    """Full-text words of each chunk by column, and their number."""
    return chunks.select("content_hash", "header", "body").mapInArrow(_words, "content_hash string, body array<string>, header array<string>, tokens array<string>, length int")


def inverted(chunks: DataFrame, hold: Hold = lambda df: df) -> Index:
    """The search tables of chunks.  ``hold`` keeps a table that is read more
    than once: cached, stored, or written to its place in an index."""
    bucketed = lambda name, t: t.withColumn("bucket", bucket(F.col(_INVERTED[name])))
    # Words never leave the task that finds them: the first table is that of their places.
    postings = chunks.select("content_hash", "header", "body").mapInArrow(_postings, "term string, content_hash string, length int, body array<int>, header array<int>, tokens array<int>")
    postings = hold(bucketed("postings", postings))
    places = sum((F.size(c) for c in _COLUMNS), F.lit(0))
    stats = chunks.agg(F.count("*").alias("n")).join(F.broadcast(postings.agg(F.coalesce(F.sum(places), F.lit(0)).alias("total"))))  # one row each
    idents = chunks.select(F.explode(T.identifiers_local(F.col("body"))).alias("ident"), "content_hash")
    idents = hold(bucketed("idents", idents))
    names = idents.select("ident").distinct()
    starts = F.sequence(F.lit(1), F.length("ident") - 2)
    grams = names.select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("ident"), i, F.lit(3))))).alias("gram"), "ident")
    return {"stats": stats, "postings": postings, "idents": idents, "grams": bucketed("grams", grams)}


def searchable(index: Index, hold: Hold = lambda df: df) -> Index:
    """The index with its search tables."""
    return index | inverted(index["chunks"], hold)


_BY_PATH = ("file_chunks", "symbols", "edges")


def without_paths(index: Index, paths: DataFrame) -> Index:
    """The index after files are gone; their chunks stay until ``collect_garbage``."""
    gone = paths.select("path").distinct()
    return index | {name: index[name].join(gone, "path", "left_anti") for name in _BY_PATH}


def update(index: Index, files: DataFrame, *, window: int = 120, hold: Hold = lambda df: df) -> Index:
    """The index after files are read anew: rows of their paths are replaced,
    chunks already known by hash are kept."""
    kept, new = without_paths(index, files), build(files, window=window, hold=hold)
    out = {name: kept[name].unionByName(new[name]) for name in _BY_PATH}
    fresh = new["chunks"].join(index["chunks"].select("content_hash"), "content_hash", "left_anti")
    out["chunks"] = index["chunks"].unionByName(fresh)
    if "postings" in index:
        more = inverted(fresh, hold)
        more["grams"] = more["grams"].join(index["grams"], ["bucket", "gram", "ident"], "left_anti")
        out |= {name: index[name].unionByName(more[name]) for name in more}
    return out


def garbage(index: Index) -> DataFrame:
    """Chunks that no file maps to."""
    return index["chunks"].join(index["file_chunks"].select("content_hash").distinct(), "content_hash", "left_anti")


def collect_garbage(index: Index) -> Index:
    used = index["file_chunks"].select("content_hash").distinct()
    out = index | {"chunks": index["chunks"].join(used, "content_hash", "left_semi")}
    if "postings" in index:
        gone = garbage(index).select("content_hash")
        lost = index["postings"].join(gone, "content_hash").groupBy("content_hash").agg(F.first("length").alias("length"))
        lost = lost.agg((-F.count("*")).alias("n"), (-F.coalesce(F.sum("length"), F.lit(0))).alias("total"))
        out |= {name: index[name].join(used, "content_hash", "left_semi") for name in ("postings", "idents")}
        # Grams of identifiers that no chunk holds any more lead nowhere and do no harm.
        out["stats"] = index["stats"].unionByName(lost)
    return out


def deduplicated_symbols(symbols: DataFrame) -> DataFrame:
    """One symbol for each name and first line of a file; a constant gives way
    to anything else, else the earlier one (by ``ord``) stays."""
    order = Window.partitionBy("path", "name", "start_line").orderBy((F.col("kind") == "constant").cast("int"), "ord")
    return symbols.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


SCHEMA_VERSION = 4
_META = "key string, value string"
#: Stored chunks that a task inverts, in bytes: it sorts some two million postings
#: in memory, and their hashes stay few enough for the files' dictionaries.
SPLIT = 12 << 20


def save(index: Index, path: str, *, search: DataFrame | None = None) -> None:
    """Write all tables as Parquet; with ``search`` (chunks) also their search
    tables, each written once, where it stays.  They go to a folder of their
    own, which ``current`` names only once all of them stand, so a write that
    fails leaves the index as it was."""
    spark = next(iter(index.values())).sparkSession
    name = f"v-{uuid.uuid4().hex}"
    written: dict[str, str] = {}

    def write(table: str, rows: DataFrame) -> DataFrame:
        at = f"{path}/{name}/{table}"
        if table in _INVERTED:
            key = _INVERTED[table]
            rest = "content_hash" if table != "grams" else "ident"
            # Each task sorts what it holds, and no row moves: a term in every chunk is in no task alone.
            rows.sortWithinPartitions("bucket", key, rest).write.option("compression", "zstd").partitionBy("bucket").parquet(at)
        else:
            rows.write.option("compression", "zstd").parquet(at)
        written[table] = rows.schema.json()
        return spark.read.schema(rows.schema).parquet(at)

    for table, rows in index.items():
        write(table, rows)
    if search is not None:
        by_key = {key: table for table, key in _INVERTED.items()}

        def hold(t: DataFrame) -> DataFrame:
            with bounded_splits(spark, SPLIT):
                return write(by_key[t.columns[0]], t)

        for table, rows in inverted(search, hold).items():
            if table not in written:
                write(table, rows)
    meta = [("schema_version", str(SCHEMA_VERSION)), ("folder", name), ("tables", ",".join(written)), *((f"schema of {t}", schema) for t, schema in written.items())]
    spark.createDataFrame(meta, _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/current")


def load(spark: SparkSession, path: str) -> Index:
    """Open a saved index; another schema version is an error, never a migration."""
    meta = {r.key: r.value for r in spark.read.schema(_META).parquet(f"{path}/current").collect()}
    found = meta.get("schema_version")
    if found != str(SCHEMA_VERSION):
        raise ValueError(f"index has schema version {found}; this engine reads {SCHEMA_VERSION}")
    schema = lambda name: StructType.fromJson(json.loads(meta[f"schema of {name}"]))  # noqa: E731 - so no file is opened for it
    return {name: spark.read.schema(schema(name)).parquet(f"{path}/{meta['folder']}/{name}") for name in meta["tables"].split(",")}
