"""The change feed as tables: coalesce, claim, finish, sweep, skip, debounce.

Times are epoch milliseconds.  A job row has path, kind, priority, state
(pending, running, dead), enqueued_at, lease_until, worker, attempts,
last_error, payload and id.  Each function returns the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Priorities, lease, attempts, error length, limits of the feed.
DEFAULT_PRIORITY, LEASE_MS, MAX_ATTEMPTS, ERROR_CHARS = 5, 30_000, 5, 2000
DEBOUNCE_MS, GIT_QUIET_MS, MAX_DEPTH, MTIME_GUARD_MS = 200, 2000, 10_000, 1000
KEY = ("workspace", "path", "kind")


def coalesce_events(events: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One pending job for each key: most urgent priority, latest time, latest
    payload that is not null.  ``seq`` breaks ties of time."""
    return events.groupBy(*keys).agg(*_coalesced(F.struct("enqueued_at", "seq")), F.count("*").alias("events"))


def _coalesced(order: Column) -> list[Column]:
    return [
        F.min(F.coalesce("priority", F.lit(DEFAULT_PRIORITY))).alias("priority"), F.max("enqueued_at").alias("enqueued_at"),
        F.max_by("payload", F.when(F.col("payload").isNotNull(), order)).alias("payload"),
    ]


def enqueue(jobs: DataFrame, events: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Events join the pending job of their key, which keeps its id, attempts
    and error; running jobs are left alone, so an edit during a run makes a new
    job, whose id is larger than any before."""
    extra = {c: t for c, t in jobs.dtypes if c not in (*keys, "priority", "enqueued_at", "payload", "state")}
    own = ["priority", "enqueued_at", "payload"]
    pending = jobs.filter("state = 'pending'").select(*keys, *own, *extra, F.lit(-1).cast("long").alias("seq"))
    new = events.select(*keys, *own, *(F.lit(None).cast(t).alias(c) for c, t in extra.items()), F.col("seq").cast("long").alias("seq"))
    order = F.struct("enqueued_at", "seq")
    merged = pending.unionByName(new).groupBy(*keys).agg(*_coalesced(order), *(F.max(c).alias(c) for c in extra))  # of a key one pending job at most has them
    merged = merged.withColumn("state", F.lit("pending"))
    if "attempts" in extra:
        merged = merged.withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    if "id" in extra:
        last = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
        merged = merged.join(F.broadcast(last)).withColumn("id", F.coalesce("id", F.col("_last") + 1 + F.monotonically_increasing_id())).drop("_last")
    return jobs.filter("state <> 'pending'").unionByName(merged.select(*jobs.columns))


def claim(jobs: DataFrame, worker: str, now: int, *, n: int = 1, kinds: tuple[str, ...] = ("parse", "delete"), lease_ms: int = LEASE_MS) -> DataFrame:
    """The next jobs as they run: most urgent first, then oldest."""
    order = ["priority", "enqueued_at", *(c for c in ("id", *KEY) if c in jobs.columns)]
    rows = jobs.filter((F.col("state") == "pending") & F.col("kind").isin(*kinds)).orderBy(*order).limit(n)
    return rows.withColumns({"state": F.lit("running"), "worker": F.lit(worker), "attempts": F.col("attempts") + 1, "lease_until": F.lit(now + lease_ms).cast("long")})


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select("id"), "id", "left_anti")


def fail(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """Failed jobs (id, error) wait again, or are dead after five attempts."""
    rows = jobs.join(errors.select("id", F.col("error").alias("_error"), F.lit(True).alias("_failed")), "id", "left")
    failed = F.col("_failed").isNotNull()
    state = F.when(F.col("attempts") >= MAX_ATTEMPTS, F.lit("dead")).otherwise(F.lit("pending"))
    return rows.withColumns({
        "state": F.when(failed, state).otherwise(F.col("state")),
        "lease_until": F.when(~failed, F.col("lease_until")),
        "worker": F.when(~failed, F.col("worker")),
        "last_error": F.when(failed, F.substring("_error", 1, ERROR_CHARS)).otherwise(F.col("last_error")),
    }).drop("_error", "_failed")


def _to_pending(jobs: DataFrame, moved: Column, keys: tuple[str, ...]) -> DataFrame:
    """Rows with ``_move``: true where a job becomes pending, null where it
    goes, false where it is left alone.  A key has one pending job, so a job
    moves only if none waits already, and of several the lowest id."""
    rows = jobs.withColumn("_moved", F.coalesce(moved, F.lit(False)))
    own = Window.partitionBy(*keys)
    waits = F.max(F.col("state") == "pending").over(own)
    first = F.min(F.when(F.col("_moved"), F.col("id"))).over(own)
    move = F.when(~F.col("_moved"), F.lit(False)).when(~waits & (F.col("id") == first), F.lit(True))
    return rows.withColumn("_move", move).drop("_moved")


def sweep(jobs: DataFrame, now: int, keys: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """Jobs after expired leases are resolved, and one row with ``recovered``,
    the number of those that wait again.  An expired job goes if its key has a
    pending one, also one that was recovered just before it (ids ascend)."""
    rows = _to_pending(jobs, (F.col("state") == "running") & (F.col("lease_until") < now), keys)
    kept = rows.filter("_move is not null")
    left = {c: F.when(~F.col("_move"), F.col(c)) for c in ("lease_until", "worker")}
    kept = kept.withColumns({"state": F.when(F.col("_move"), F.lit("pending")).otherwise(F.col("state")), **left})
    return kept.select(*jobs.columns), rows.agg(F.count_if(F.col("_move")).alias("recovered"))


def retry_dead(jobs: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Dead jobs wait again, without attempts and error.  One goes if its key
    has a pending job, also one that was revived just before it (ids ascend)."""
    rows = _to_pending(jobs, F.col("state") == "dead", keys).filter("_move is not null")
    return rows.withColumns({
        "state": F.when(F.col("_move"), F.lit("pending")).otherwise(F.col("state")),
        "attempts": F.when(F.col("_move"), F.lit(0)).otherwise(F.col("attempts")),
        "last_error": F.when(~F.col("_move"), F.col("last_error")),
    }).select(*jobs.columns)


def depth(jobs: DataFrame) -> DataFrame:
    """One row: how many jobs are pending, running and dead."""
    return jobs.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "running", "dead")))


def decide_work(snapshot: DataFrame, files: DataFrame) -> DataFrame:
    """Whether each file needs work.  ``snapshot``: path, mtime, size, text
    (null: gone); ``files``: path, disk_mtime, disk_size, read_at,
    indexed_hash.  A stat that has not changed is trusted only if it was read
    more than a second after the file was written."""
    from quarryline.functions.code_text import short_hash

    known = files.select(F.col("path").alias("_path"), "disk_mtime", "disk_size", "read_at", "indexed_hash")
    rows = snapshot.join(known, F.col("path") == F.col("_path"), "left").drop("_path")
    stat = (F.col("mtime") == F.col("disk_mtime")) & (F.col("size") == F.col("disk_size")) & (F.col("read_at") - F.col("disk_mtime") > MTIME_GUARD_MS)
    gone, unchanged = F.col("text").isNull(), F.coalesce(stat, F.lit(False))
    hashed = F.when(~gone & ~unchanged, short_hash(F.col("text")))  # hashed only where the stat leaves doubt
    rows = rows.withColumn("hash", hashed)
    same = F.coalesce(F.col("hash") == F.col("indexed_hash"), F.lit(False))
    reason = F.when(gone, F.lit("gone")).when(unchanged, F.lit("stat-unchanged")).when(same, F.lit("hash-unchanged"))
    return rows.select("path", reason.isNull().alias("work"), reason.alias("reason"), F.when(reason.isNull(), F.col("hash")).alias("hash"))


def upsert(table: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def mark_indexed(files: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """Records what was read (path, mtime, size, read_at, hash, lang); an
    earlier reason for skipping is cleared."""
    rows = done.select("path", F.col("mtime").alias("disk_mtime"), F.col("size").alias("disk_size"), "read_at", F.col("hash").alias("indexed_hash"), F.lit(now).cast("long").alias("indexed_at"), "lang", F.lit("ok").alias("parse_state"), F.lit(None).cast("string").alias("skip_reason"))
    return upsert(files, rows, ("path",))


def mark_skipped(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Records why files (path, reason) are skipped; they lose their hash."""
    blank = {c: F.lit(None).cast(t) for c, t in files.dtypes if c not in ("path", "skip_reason", "parse_state")}
    rows = skipped.select("path", F.col("reason").alias("skip_reason")).withColumns({**blank, "parse_state": F.lit("skipped")})
    return upsert(files, rows, ("path",))


def debounce(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Bursts of a key whose events follow within ``gap``: batch or stream.
    A burst is due ``gap`` after its last event."""
    window = F.session_window(F.col(ts), gap)
    rows = events.groupBy(window, F.col(key)).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("due_at"), "events")


def not_after_git(events: DataFrame, git: DataFrame, quiet_ms: int = GIT_QUIET_MS) -> DataFrame:
    """Events (at) that no git change (at, same workspace) of the last two
    seconds explains.  Buckets of the quiet time keep this an equi-join."""
    g = git.select(F.col("workspace").alias("_w"), F.col("at").alias("_at"), F.explode(F.array(F.floor(F.col("at") / quiet_ms), F.floor(F.col("at") / quiet_ms) + 1)).alias("_b"))
    on = (F.col("workspace") == F.col("_w")) & (F.floor(F.col("at") / quiet_ms) == F.col("_b")) & (F.col("at") >= F.col("_at")) & (F.col("at") < F.col("_at") + quiet_ms)
    return events.join(g, on, "left_anti")


def admit(events: DataFrame, pending: int, limit: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Events that the queue takes and those it drops when it is too deep."""
    return (events.limit(0), events) if pending > limit else (events, events.limit(0))


class Lease:
    """Leadership as a pure function of one row and the clock."""

    STALE_MS = 15_000

    @staticmethod
    def acquire(row: dict | None, holder: str, now: int) -> tuple[dict, bool]:
        free = row is None or row["holder"] == holder or row["heartbeat"] < now - Lease.STALE_MS
        if not free:
            return row, False
        since = row["acquired_at"] if row and row["holder"] == holder else now
        return {"holder": holder, "acquired_at": since, "heartbeat": now}, True

    @staticmethod
    def still(row: dict | None, holder: str) -> bool:
        return row is not None and row["holder"] == holder

    @staticmethod
    def beat(row: dict | None, holder: str, now: int) -> tuple[dict | None, bool]:
        return ({**row, "heartbeat": now}, True) if Lease.still(row, holder) else (row, False)

    @staticmethod
    def release(row: dict | None, holder: str) -> dict | None:
        return None if Lease.still(row, holder) else row


def age_days(then: Column, now: int) -> Column:
    return F.floor((F.lit(now) - then) / 86_400_000)
