"""Registered queries against their SQL on small tables."""

from __future__ import annotations

import math

import __spark_entry__ as entry
import duckdb
import pytest

from quarryline.operators import indexing
from quarryline.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Documents of which some repeat a window of lines."""
    path = str(tmp_path_factory.mktemp("repeated"))
    line = "An ention. of the general public license, free software foundation, harbour lantern\n"
    texts = [(i, line * (45 + i % 50) if i % 7 == 0 else f"mention ention. harbour{'s' * (i % 3)} winter tides {i}\n" * (i % 30) + line * (i % 2)) for i in range(0, 400, 2)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_scoped", "bm25_phrases", "bm25_without_index", "trigram_search", "rrf_search", "batch_search", "eval_ablation"])
def test_repeated_chunks_count_once(spark, repeated, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{repeated}/documents.parquet/*.parquet')")
    got, want = QUERIES[name](spark, repeated), con.sql(SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_tasks_that_invert_chunks_are_bounded(spark, repeated, tmp_path, monkeypatch):
    files = lambda: [p for p in (tmp_path / "index").glob("v-*/postings/bucket=*/*.parquet")]
    monkeypatch.setattr(indexing, "SPLIT", 1 << 20, raising=False)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    chunks = plans.chunk_rows(spark, repeated).repartition(12, "path").select("content_hash", "header", "body")
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert chunks.rdd.getNumPartitions() < 12  # Spark would pack small files into fewer tasks
    indexing.save({"empty": chunks.limit(0)}, str(tmp_path / "index"), search=chunks)
    assert len({p.name.split("-")[1] for p in files()}) == 12
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == split
    assert all(p.name.endswith(".zstd.parquet") for p in files())


def test_merging_sql_does_not_depend_on_the_order_of_equal_spans():
    con = duckdb.connect()
    con.sql("SET threads = 8")
    con.sql("CREATE TABLE lineitem AS SELECT i // 6 AS l_orderkey, (i % 2)::INTEGER AS l_linenumber, (hash(i // 2) % 3 * 20)::DOUBLE AS l_quantity, 0.1 AS l_discount FROM range(1200000) t(i)")
    con.sql("INSERT INTO lineitem SELECT * FROM lineitem")
    wanted = con.sql("SELECT count(*), count(DISTINCT (l_orderkey, l_quantity)) FROM lineitem").fetchall()[0][1]  # spans of one first line are one
    for _ in range(3):
        found = con.sql(f"SELECT count(*), count(DISTINCT (path, start_line)) FROM ({SQL['merge_near_spans']})").fetchall()[0]
        assert found == (wanted, wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
