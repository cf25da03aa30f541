import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import changefeed as feed
from quarryline.streaming import feed as streams

JOBS = "id long, workspace string, path string, kind string, priority int, state string, enqueued_at long, lease_until long, worker string, attempts int, last_error string, payload string"


def job(i, path="a", kind="parse", priority=5, state="pending", at=0, lease=None, attempts=0):
    return (i, "w", path, kind, priority, state, at, lease, "w1" if state == "running" else None, attempts, None, None)


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), JOBS)


def events(spark, *rows):
    return spark.createDataFrame([("w", *r) for r in rows], "workspace string, path string, kind string, priority int, enqueued_at long, payload string, seq long")


def test_many_events_are_one_job(spark):
    rows = [("a", "parse", p, 100 + i, None if i % 2 else f"p{i}", i) for i, p in enumerate([20, 1, None, 10])]
    r = feed.coalesce_events(events(spark, *rows)).collect()
    assert [(x.priority, x.enqueued_at, x.payload, x.events) for x in r] == [(1, 103, "p2", 4)]
    assert feed.coalesce_events(events(spark, ("a", "parse", None, 1, None, 0))).first().priority == 5


def test_coalescing_again_changes_nothing(spark):
    once = feed.enqueue(jobs(spark), events(spark, ("a", "parse", 3, 7, "x", 0), ("b", "delete", 0, 8, None, 1)))
    again = feed.enqueue(once, events(spark, ("a", "parse", 9, 7, None, 2)))
    assert {(r.path, r.priority, r.payload) for r in again.collect()} == {("a", 3, "x"), ("b", 0, None)}


def test_an_edit_during_a_run_is_a_new_job(spark):
    out = feed.enqueue(jobs(spark, job(1, state="running", lease=99)), events(spark, ("a", "parse", 1, 5, None, 0)))
    assert sorted(r.state for r in out.collect()) == ["pending", "running"]


class Queue:
    """The rules of the queue, one job after another, as a plain table."""

    def __init__(self, rows):
        self.rows = {r[0]: dict(zip([c.split()[0] for c in JOBS.split(", ")], r, strict=True)) for r in rows}

    def _waits(self, key):
        return any(r["state"] == "pending" and (r["path"], r["kind"]) == key for r in self.rows.values())

    def _revive(self, chosen, **fields):
        n = 0
        for i in sorted(i for i, r in self.rows.items() if chosen(r)):
            if self._waits((self.rows[i]["path"], self.rows[i]["kind"])):
                del self.rows[i]
            else:
                self.rows[i].update(state="pending", **fields)
                n += 1
        return n

    def sweep(self, now):
        return self._revive(lambda r: r["state"] == "running" and r["lease_until"] is not None and r["lease_until"] < now, worker=None, lease_until=None)

    def retry_dead(self):
        return self._revive(lambda r: r["state"] == "dead", attempts=0, last_error=None)

    def claim(self, worker, now, n, kinds):
        order = sorted((r["priority"], r["enqueued_at"], i) for i, r in self.rows.items() if r["state"] == "pending" and r["kind"] in kinds)
        for _, _, i in order[:n]:
            self.rows[i].update(state="running", worker=worker, lease_until=now + 30_000, attempts=self.rows[i]["attempts"] + 1)
        return [i for _, _, i in order[:n]]

    def fail(self, i, error):
        r = self.rows[i]
        r.update(state="dead" if r["attempts"] >= 5 else "pending", last_error=error[:2000], worker=None, lease_until=None)

    def table(self):
        return sorted(tuple(r.values()) for r in self.rows.values())


def random_jobs(seed):
    """Several jobs a key in all states, at most one of them pending."""
    draw, rows, waiting = random.Random(seed), [], set()
    for i in range(40):
        key = (draw.choice("abcdef"), draw.choice(("parse", "delete", "embed")))
        state = draw.choice(("pending", "running", "running", "dead", "dead"))
        if state == "pending" and key in waiting:
            continue
        waiting |= {key} if state == "pending" else set()
        running = state == "running"
        rows.append((i, "w", *key, draw.randint(0, 3), state, draw.randint(0, 50), draw.choice((10, 50, 90, None)) if running else None, "w1" if running else None, draw.randint(0, 6), "e" if state == "dead" else None, None))
    draw.shuffle(rows)
    return rows


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", range(6))
def test_the_feed_keeps_the_rules_of_the_queue(spark, seed):
    rows = random_jobs(seed)
    df = jobs(spark, *rows)
    queue = Queue(rows)
    left, recovered = feed.sweep(df, 60)
    assert recovered.first().recovered == queue.sweep(60)
    assert table(left) == queue.table()
    queue = Queue(rows)
    queue.retry_dead()
    assert table(feed.retry_dead(df)) == queue.table()
    queue = Queue(rows)
    claimed = feed.claim(df, "me", 1000, n=3)
    ids = queue.claim("me", 1000, 3, ("parse", "delete"))
    assert [r.id for r in claimed.collect()] == ids and all(tuple(r) in queue.table() for r in claimed.select(df.columns).collect())
    errors = [(r[0], "x" * (3000 if r[0] % 2 else 3)) for r in rows if r[5] == "running"]
    queue = Queue(rows)
    for e in errors:
        queue.fail(*e)
    assert table(feed.fail(df, spark.createDataFrame(errors, "id long, error string")).select(df.columns)) == queue.table()


def test_complete_and_depth(spark):
    df = jobs(spark, job(1, state="running"), job(2, "b", state="dead"), job(3, "c"), job(4, "d"))
    assert feed.depth(df).first().asDict() == {"pending": 2, "running": 1, "dead": 1}
    assert sorted(r.id for r in feed.complete(df, spark.createDataFrame([(1,), (9,)], "id long")).collect()) == [2, 3, 4]


@pytest.mark.parametrize(("mtime", "size", "text", "want"), [
    (1.0, 3, "abc", (False, "stat-unchanged")), (2.0, 3, "abc", (False, "hash-unchanged")), (1.0, 4, "abcd", (True, None)), (1.0, 3, None, (False, "gone")),
])
def test_skip_rule(spark, mtime, size, text, want):
    snapshot = spark.createDataFrame([("a", mtime, size, text)], "path string, mtime double, size long, text string")
    files = spark.createDataFrame([("a", 1.0, 3, 5000.0)], "path string, disk_mtime double, disk_size long, read_at double").withColumn("indexed_hash", F.substring(F.sha2(F.lit("abc"), 256), 1, 32))
    r = feed.decide_work(snapshot, files).first()
    assert (r.work, r.reason) == want


def test_same_size_edit_within_the_clock_tick_is_seen(spark):
    snapshot = spark.createDataFrame([("a", 1000.5, 3, "xyz")], "path string, mtime double, size long, text string")
    files = spark.createDataFrame([("a", 1000.5, 3, 1500.0, "old")], "path string, disk_mtime double, disk_size long, read_at double, indexed_hash string")
    assert feed.decide_work(snapshot, files).first().work
    assert feed.decide_work(snapshot, files.limit(0)).first().work


def test_marks(spark):
    files = spark.createDataFrame([("a", 1.0, 1, 1.0, "h", 1, "text", "ok", "binary")], "path string, disk_mtime double, disk_size long, read_at double, indexed_hash string, indexed_at long, lang string, parse_state string, skip_reason string")
    done = spark.createDataFrame([("a", 2.0, 2, 2.0, "new", "python")], "path string, mtime double, size long, read_at double, hash string, lang string")
    r = feed.mark_indexed(files, done, 9).first()
    assert (r.indexed_hash, r.skip_reason, r.lang) == ("new", None, "python")
    s = feed.mark_skipped(files, spark.createDataFrame([("a", "minified")], "path string, reason string")).first()
    assert (s.indexed_hash, s.skip_reason) == (None, "minified")


def test_git_quiet_time_and_admission(spark):
    e = spark.createDataFrame([("w", 999), ("w", 1000), ("w", 2999), ("w", 3000), ("v", 1500)], "workspace string, at long")
    git = spark.createDataFrame([("w", 1000)], "workspace string, at long")
    assert sorted(map(tuple, feed.not_after_git(e, git).collect())) == [("v", 1500), ("w", 999), ("w", 3000)]
    assert [x.count() for x in feed.admit(e, 10_000)] == [5, 0]
    assert [x.count() for x in feed.admit(e, 10_001)] == [0, 5]


def test_lease():
    lease, ok = feed.Lease.acquire(None, "a", 0)
    assert ok and feed.Lease.still(lease, "a")
    same, ok = feed.Lease.acquire(lease, "b", 10_000)
    assert not ok and same == lease
    taken, ok = feed.Lease.acquire(lease, "b", 15_001)
    assert ok and not feed.Lease.still(taken, "a")
    assert feed.Lease.beat(taken, "a", 16_000) == (taken, False)
    assert feed.Lease.beat(taken, "b", 16_000)[0]["heartbeat"] == 16_000
    assert feed.Lease.release(taken, "a") == taken and feed.Lease.release(taken, "b") is None


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_debounced_stream_equals_batch_but_for_open_bursts(spark, tmp_path):
    rows = [(1, at(0)), (1, at(1)), (1, at(60)), (2, at(5)), (9, at(100_000))]  # the last one moves the watermark
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.event_stream(spark, f"{tmp_path}/in", "user_id long, ts timestamp")
    streams.run_once(streams.debounced(stream, gap="10 seconds"), f"{tmp_path}/cp", streams.to_table(f"{tmp_path}/out"))
    got = spark.read.parquet(f"{tmp_path}/out").select("user_id", "first_at", "due_at", "events")
    batch = feed.debounce(spark.read.parquet(f"{tmp_path}/in"), "user_id", "ts", "10 seconds")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.filter("user_id < 9").collect()))
    assert got.count() == 3


def test_stateful_coalescing(spark, tmp_path):
    for i, p in enumerate([7, 3]):
        spark.createDataFrame([("a", "parse", p), ("a", "parse", 9)], "path string, kind string, priority int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema("path string, kind string, priority int").parquet(f"{tmp_path}/in*")
    seen = []
    query = streams.coalesced(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max((r.events, -r.priority) for r in seen) == (4, -3)
