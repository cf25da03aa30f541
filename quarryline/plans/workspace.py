"""A workspace: one folder of files, its index, its change feed, and the tools.

``start`` opens the stored index or makes it; ``enqueue`` and ``drain`` keep it
up with the files; ``stop`` stores it.  Files and jobs are tables like the rest
of the index; the jobs that wait at a time are bounded by the feed itself.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import code_text as T
from quarryline.operators import changefeed, graph, ignore, indexing, merkle, retrieval, status
from quarryline.sources import files as source_files

_FILES = "path string, disk_mtime double, disk_size long, read_at double, indexed_hash string, indexed_at long, lang string, parse_state string, skip_reason string"
_JOBS = "id long, workspace string, path string, kind string, priority int, state string, enqueued_at long, lease_until long, worker string, attempts int, last_error string, payload string"
# Priorities of jobs by where they come from, most symbols of an outline.
COLD, EDITED, SEEN_STALE, OUTLINE = 20, changefeed.DEFAULT_PRIORITY, 0, 2000


class Workspace:
    """Tools over an index.  Texts come from the files as they are now."""

    def __init__(self, spark: SparkSession, root: str, *, store: str | None = None, clock=lambda: int(time.time() * 1000)):
        self.spark, self.root, self.store, self.clock = spark, root, store, clock
        self.rules = source_files.ignore_files(root)
        self.index: indexing.Index | None = None
        self.files = spark.createDataFrame([], _FILES)
        self.jobs = spark.createDataFrame([], _JOBS)
        self.seen: DataFrame | None = None  # the hash tree of the last look at the disk

    # Life

    def start(self) -> Workspace:
        """Open the stored index, or read every file."""
        stored = None
        if self.store:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.store}/current")
            if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                stored = indexing.load(self.spark, self.store)
        if stored is None:
            self.cold_index()
        else:
            self.files, self.jobs = stored.pop("files"), self._settled(stored.pop("jobs"))
            self.index = stored
        return self

    def save(self) -> None:
        indexing.save({**self.index, "files": self.files, "jobs": self.jobs}, self.store)

    def stop(self) -> None:
        """Store the index, if there is a place for it, and free what is held."""
        if self.store and self.index is not None:
            self.save()
        for table in [*(self.index or {}).values(), self.files]:
            table.unpersist()
        self.index = None

    def files_to_index(self) -> list[str]:
        """Paths that the rules keep, in order."""
        return [r.path for r in source_files.walk(self.spark, self.root, ignore_files=self.rules).select("path").orderBy("path").collect()]

    def texts(self, paths: Iterable[str] | None = None) -> DataFrame:
        return source_files.read_texts(self.spark, self.root, ignore_files=self.rules, paths=paths)

    def cold_index(self) -> indexing.Index:
        """Read, filter, parse and index every file; record what was skipped."""
        self.index, self.files = None, self.spark.createDataFrame([], _FILES)
        return self._indexed(self.texts(), [])

    def refresh(self, paths: Iterable[str]) -> indexing.Index:
        """Index some files anew; those that are gone leave the index."""
        paths = list(dict.fromkeys(paths))
        return self._indexed(self.texts(paths), paths)

    def _indexed(self, texts: DataFrame, named: list[str]) -> indexing.Index:
        now = self.clock()
        rows = texts.withColumn("reason", ignore.content_reason(F.col("source"), F.col("size"))).cache()
        kept = rows.filter("reason is null and source is not null")
        if self.index is None:
            index = indexing.searchable(indexing.build(kept.select("path", "source"), hold=DataFrame.cache), DataFrame.cache)
        else:
            gone = self.spark.createDataFrame([(p,) for p in named], "path string").join(kept, "path", "left_anti")
            index = indexing.update(indexing.without_paths(self.index, gone), kept.select("path", "source"), hold=DataFrame.cache)
            self.files = self.files.join(gone, "path", "left_anti")
        self.index = {k: v.cache() for k, v in index.items()}
        done = kept.select("path", "mtime", "size", F.lit(float(now)).alias("read_at"), "hash", F.coalesce(T.detect_lang(F.col("path")), F.lit("text")).alias("lang"))
        self.files = changefeed.mark_indexed(self.files, done, now)
        self.files = changefeed.mark_skipped(self.files, rows.filter("reason is not null").select("path", "reason")).cache()
        return self.index

    # Change feed

    def _settled(self, jobs: DataFrame) -> DataFrame:
        """The queue without its history; it holds no more than the feed admits."""
        return self.spark.createDataFrame([tuple(r) for r in jobs.select([c.split()[0] for c in _JOBS.split(", ")]).collect()], _JOBS)

    def enqueue(self, events: Iterable[tuple[str, str, int]]) -> int:
        """Jobs (path, kind, priority); how many were admitted."""
        now = self.clock()
        rows = [(self.root, path, kind, priority, now, None, i) for i, (path, kind, priority) in enumerate(events)]
        frame = self.spark.createDataFrame(rows, "workspace string, path string, kind string, priority int, enqueued_at long, payload string, seq long")
        pending = self.jobs.filter("state = 'pending'").count()
        admitted, _ = changefeed.admit(frame, pending)
        self.jobs = self._settled(changefeed.enqueue(self.jobs, admitted))
        return len(rows) if pending <= changefeed.MAX_DEPTH else 0

    def drain(self, most: int = 1000, worker: str = "drain") -> int:
        """Do the jobs that wait; how many were done.  Files are indexed
        together; if that fails, one by one, and those that fail wait again or
        are dead after their last attempt."""
        done = 0
        while True:
            self.jobs = self._settled(changefeed.sweep(self.jobs, self.clock())[0])
            claimed = changefeed.claim(self.jobs, worker, self.clock(), n=most).select("id", "path", "attempts", "lease_until").collect()
            if not claimed:
                return done
            ids = self.spark.createDataFrame([(r.id, r.attempts, r.lease_until) for r in claimed], "id long, _attempts int, _lease long")
            rows = self.jobs.join(ids, "id", "left")
            mine = F.col("_attempts").isNotNull()
            marks = {"state": F.lit("running"), "worker": F.lit(worker), "attempts": F.col("_attempts"), "lease_until": F.col("_lease")}
            self.jobs = self._settled(rows.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in marks.items()}))
            failed = self._work([r.path for r in claimed])
            errors = [(r.id, failed[r.path]) for r in claimed if r.path in failed]
            finished = [(r.id,) for r in claimed if r.path not in failed]
            jobs = changefeed.complete(self.jobs, self.spark.createDataFrame(finished, "id long"))
            self.jobs = self._settled(changefeed.fail(jobs, self.spark.createDataFrame(errors, "id long, error string")))
            done += len(finished)
            if errors and not finished:
                return done  # they wait for another time

    def _work(self, paths: list[str]) -> dict[str, str]:
        """Index paths; the errors of those that could not be."""
        try:
            self.refresh(paths)
            return {}
        except Exception as together:  # noqa: BLE001 - whatever a file does, the others go on
            if len(set(paths)) == 1:
                return {paths[0]: str(together)}
        paths = list(dict.fromkeys(paths))
        half = len(paths) // 2  # a few bad files cost a few batches, not one each for all
        return self._work(paths[:half]) | self._work(paths[half:])

    def catch_up(self) -> int:
        """Queue what changed on disk while nothing watched; how many jobs were
        admitted.  Hash trees of what is known and of what is there now are
        compared, so only differing folders are looked into.  Edited and new
        files are due for parsing, those that are gone for deletion.  A file that
        was skipped has no known state and is looked at again the first time."""
        stat = F.concat_ws(":", "disk_mtime", "disk_size")
        now = merkle.tree(source_files.walk(self.spark, self.root, ignore_files=self.rules).select("path", stat.alias("hash")))
        known = self.seen if self.seen is not None else merkle.tree(self.files.select("path", F.when(F.col("disk_mtime").isNotNull(), stat).alias("hash")))
        due = merkle.jobs(merkle.compare(known, now).changes, EDITED).orderBy("path").collect()
        admitted = self.enqueue([(r.path, r.kind, r.priority) for r in due]) if due else 0
        if admitted == len(due):
            self.seen = now
        return admitted

    # Tools

    def _envelope(self, **fields) -> str:
        pending = self.jobs.filter("state = 'pending'").count()
        return json.dumps({**fields, "index": {"fresh": pending == 0, "queue_depth": pending, "vector_coverage": 0, "precise_coverage": 0}}, sort_keys=True)

    def search(self, query: str, scope: str | None = None, limit: int = 20) -> list[dict]:
        """Spans with their live text."""
        spans = retrieval.search(self.index, query, scope=scope, limit=limit).orderBy("rank").collect()
        texts = self.texts([r.path for r in spans]).select("path", F.col("source").alias("text"))
        frame = self.spark.createDataFrame([r.asDict() for r in spans], "id string, path string, start_line int, end_line int, symbol string, matched array<string>, score double, rank int")
        return [r.asDict() for r in retrieval.with_text(frame, texts).orderBy("rank").collect()]

    def find(self, query: str, scope: str | None = None, max_tokens: int = 4000, limit: int = 20) -> str:
        """Verified spans within a token budget; files that changed since they
        were indexed, or are gone, are due at once."""
        found = self.search(query, scope, limit)
        schema = "id string, path string, start_line int, end_line int, symbol string, matched array<string>, score double, rank int, text string"
        texts = self.texts([r["path"] for r in found]).select("path", F.col("source").alias("text"))
        spans, jobs = retrieval.verify(self.spark.createDataFrame(found, schema), texts, self.files.select("path", "indexed_hash"))
        spans = self.spark.createDataFrame(spans.collect(), schema + ", trust string")  # ``limit`` spans
        due = [(r.path, r.kind, SEEN_STALE) for r in jobs.collect()]
        if due:
            self.enqueue(due)
        by_rank = {r["rank"]: r.asDict(recursive=True) for r in spans.collect()}
        packed = retrieval.pack(spans, max_tokens).first()
        kept = [by_rank[s["rank"]] for s in packed.spans] if packed else []
        hint = "expand takes a span's id for more lines" if kept else "no match: try fewer or other words"
        return self._envelope(spans=kept, tokens=packed.tokens if packed else 0, truncated=bool(packed and packed.truncated), hint=hint)

    def symbol(self, name: str, kind: str | None = None) -> str:
        rows = retrieval.lookup_symbol(self.index["symbols"], name, kind=kind).collect()
        return self._envelope(symbols=[r.asDict() for r in rows], **({} if rows else {"hint": "no symbol of that name: find takes words"}))

    def outline(self, path: str) -> str:
        """Symbols at or below a path, by file; ``OUTLINE`` symbols at most."""
        symbols = self.index["symbols"].filter(T.under(F.col("path"), path)).orderBy("path", "start_line", "name").limit(OUTLINE + 1)
        rows = retrieval.outline(symbols.limit(OUTLINE), path).orderBy("path").collect()
        cut = symbols.count() > OUTLINE
        return self._envelope(files=[r.asDict(recursive=True) for r in rows], truncated=cut, **({} if rows else {"hint": "nothing is indexed there: status tells what is"}))

    def expand(self, span_id: str, before: int = 20, after: int = 20) -> str:
        place = retrieval.place_of(self.index, span_id)
        if place is None:
            return self._envelope(error=f"unknown span {span_id}")
        texts = self.texts([place["path"]]).select("path", F.col("source").alias("text"))
        frame = self.spark.createDataFrame([tuple(place.values())], "path string, start_line int, end_line int")
        row = retrieval.expand_all(frame, texts, before, after).first()
        if row is None:
            return self._envelope(error=f"the file of span {span_id} is gone")
        return self._envelope(span={"path": row.path, "start_line": row.first_line, "end_line": row.last_line, "text": row.text})

    def status(self) -> str:
        return self._envelope(**status.status(self.files, self.index["symbols"], self.index["file_chunks"], self.jobs).first().asDict())

    # Inspection, as the HTTP routes have it

    def overview(self) -> dict:
        return {"hotspots": [r.asDict() for r in status.hotspots(self.index["symbols"]).collect()], "status": json.loads(self.status())}

    def graph(self, depth: int | None = None, max_nodes: int = 250, scope: str | None = None) -> dict:
        weights = self.index["symbols"].groupBy("path").agg(F.count("*").alias("n"))
        nodes = self.files.filter("indexed_hash is not null").join(weights, "path", "left").select(F.col("path").alias("id"), F.coalesce("n", F.lit(0)).alias("weight"))
        pairs = graph.import_edges(self.index["edges"], self.files.select("path"))
        if scope:
            nodes = nodes.filter(T.in_scope(F.col("id"), scope))
            pairs = pairs.filter(T.in_scope(F.col("source"), scope) & T.in_scope(F.col("target"), scope))
        g = graph.link_graph(pairs, nodes, depth=depth, max_nodes=max_nodes)
        return {"nodes": [r.asDict() for r in g["nodes"].collect()], "edges": [{**r.asDict(), "kind": "imports"} for r in g["edges"].collect()], "isolated": g["isolated"].count(), "truncated": g["connected"].count() > max_nodes}

    def symbol_graph(self, name: str, limit: int = 500) -> dict:
        """Callers, callees (``limit`` of each at most, in order) and definitions."""
        edges = self.index["edges"]
        callers = graph.callers(edges, name).orderBy("path", "line").limit(limit)
        callees = graph.callees(edges, name).orderBy("callee").limit(limit)
        return {"precision": "heuristic", "callers": [r.asDict() for r in callers.collect()], "callees": [r.asDict() for r in callees.collect()], "definitions": [r.asDict() for r in retrieval.lookup_symbol(self.index["symbols"], name, limit=30).collect()]}

    def file(self, path: str) -> dict | None:
        row = graph.file_detail(self.index, self.files, path).first()
        return row and row.asDict(recursive=True)

    def internals(self) -> dict:
        return {k: [r.asDict() for r in v.collect()] for k, v in status.internals(self.index, self.files).items()}

    def list_files(self, prefix: str = "", limit: int = 500) -> list[dict]:
        rows = self.files.filter(T.like(F.col("path"), f"{prefix}%")).select("path", "lang", "parse_state", "skip_reason").orderBy("path").limit(limit)
        return [r.asDict() for r in rows.collect()]
