import random

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(60):
        rows.append([i, " ".join(draw.choice(words) for _ in range(120)), "en", f"s{i % 4}"])
    clean = len(rows)
    for i in range(10):
        rows.append([200 + i, rows[i][1], "en", "s1"])  # exact copies
    for i in range(10, 20):
        w = rows[i][1].split()
        w[60] = "changed"
        rows.append([200 + i, " ".join(w), "en", "s2"])  # near copies
    rows += [[900, None, None, None], [901, "", "en", "s1"], [902, "12 34 !!", "en", "s1"]]
    return [(*r, len(r[1] or "")) for r in rows], clean


def staged(spark, docs, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = stage(spark, docs, "")
    return docs


@pytest.fixture(scope="module")
def tables(spark):
    rows, clean = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return docs, rows, clean


def test_each_stage_decides(spark, tables):
    docs, rows, clean = tables
    one = staged(spark, docs, 1)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r[0] for r in rows if r[0] < 900}
    two = corpus_pipeline.drop_copies(spark, one, "")
    assert {r.doc_id for r in two.collect()} == {r[0] for r in rows if r[0] < 900} - set(range(10))
    three = corpus_pipeline.drop_near_copies(spark, two, "")
    assert three.columns == docs.columns
    assert {r.doc_id for r in three.collect()} == set(range(10, clean)) | set(range(200, 210))
    four = corpus_pipeline.mix_sources(spark, three, "")
    assert four.columns == docs.columns
    assert {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    five = corpus_pipeline.tokenize(spark, four, "")
    assert five.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert five.count() == four.count()
    assert five.filter(F.col("n_tokens") < 3).count() == 0


def test_repeated_rows_and_empty_tables(spark, tables):
    docs, _, clean = tables
    twice = docs.unionByName(docs)
    got = corpus_pipeline.drop_copies(spark, twice, "").filter("doc_id < 900")
    assert got.count() == got.select("doc_id").distinct().count() == clean + 10
    assert staged(spark, docs.limit(0), 5).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100


def shingle_set(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """Ids that stay when all pairs at a similarity of 0.8 are linked."""
    sets, forest = [shingle_set(r[1]) for r in rows], simhash.Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                forest.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        least[forest.root(i)] = min(least.get(forest.root(i), r[0]), r[0])
    return set(least.values())


def test_only_verified_near_copies_are_dropped(spark):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    rows = []
    for k in range(12):
        base = [draw.choice(words) for _ in range(150)]
        for i, changed in enumerate((0, 2, 5, 6, 6)):  # similarity 1, 0.87, 0.7 and 0.66 to the first
            w = list(base)
            for at in range(10, 10 + 20 * changed, 20):
                w[at] = draw.choice(words)
            rows.append((10 * k + i, " ".join(w), "en", "s1", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == kept_by_brute_force(rows)


@pytest.mark.parametrize("set_tile", [3, 1024])
def test_large_groups_are_split_into_tiles(spark, set_tile):
    draw = random.Random(4)
    base = [str(draw.random()) for _ in range(200)]
    rows = [(i, " ".join(base[: 60 + 3 * i]), "en", "s1", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = simhash.near_copies(docs, threshold=(4, 5), shingle=5, words=4, radius=120, bands=[[]], set_tile=set_tile)
    assert {r.doc_id for r in found.filter("kept").collect()} == kept_by_brute_force(rows)


def test_repeated_shingles_count_once():
    draw = random.Random(5)
    texts = [" ".join(["de"] * 130 + [str(draw.random()) for _ in range(100)]).encode() for _ in range(2)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "sha": [b"a", b"b"], "text": [t.decode() for t in texts]})
    a, b = next(simhash._prints(5, 4)(iter([batch]))).column(2).to_pylist()
    assert (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() > 90  # unrelated but for few shingles


def test_recall_against_brute_force(spark):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(5000)]
    rows = []
    for k in range(600):
        base = [draw.choice(words) for _ in range(8 if k % 2 else 120)]
        other = base + [draw.choice(words)] if k % 2 else base + [draw.choice(words) for _ in range(29)]
        rows += [(2 * k, " ".join(base), "en", "s1", 0), (2 * k + 1, " ".join(other), "en", "s1", 0)]  # similarity 0.8 each
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept_by_brute_force(rows) == set(range(0, 1200, 2))
    assert set(range(0, 1200, 2)) <= got
    assert len(got) <= 603  # at most 3 of 600 missed


def test_a_near_copy_takes_no_other_row_of_its_id(spark):
    one, two = (" ".join(str(random.Random(s).random() + i) for i in range(60)) for s in (1, 2))
    rows = [(1, one, "en", "s1", 0), (5, one + " more", "en", "s1", 0), (5, two, "en", "s1", 0)]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, one), (5, two)}


def test_documents_without_any_language(spark):
    rows = [(1, "some words", None, "s1", 0), (2, "12 34", None, "s1", 0)]
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1]


def test_predicted_languages_fill_gaps(spark):
    base = [("the cat and the dog were in the house", "en"), ("der Hund und die Katze waren in dem Haus", "de")]
    rows = [(i, *base[i % 2], "s", 0) for i in range(20)] + [(100, base[0][0], None, "s", 0), (101, base[1][0], None, "s", 0), (102, base[1][0], "en", "s", 0)]
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert (got[100], got[101], got[102]) == ("en", "de", "en") and len(got) == len(rows)


def test_recall_on_the_tables(spark):
    """What the near-duplicate stage drops of sf0.01, against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = corpus_pipeline.drop_copies(spark, corpus_pipeline.language_id(spark, docs, ""), "").cache()
    rows = [tuple(r) for r in docs.collect()]
    want = {r[0] for r in rows} - kept_by_brute_force(rows)
    dropped = {r[0] for r in rows} - {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    print(f"near copies at 0.8: {len(want)}, dropped {len(want & dropped)}, clean ones dropped {len(dropped - want)}")
    assert want and len(want & dropped) >= 0.9 * len(want)
    assert not dropped - want


def test_exact_candidates_miss_nothing(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = []
    for k in range(150):
        base = [draw.choice(words) for _ in range(draw.choice((6, 60, 200)))]
        n = max(1, (len(base) - 4) // 4)
        rows += [(2 * k, " ".join(base), "en", "s1", 0), (2 * k + 1, " ".join(base + [draw.choice(words) for _ in range(n)]), "en", "s1", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = simhash.near_copies(docs, threshold=(4, 5), shingle=5, words=4, radius=0, bands=simhash.sampled_bands(1, 14, 256), exact=True)
    assert {r.doc_id for r in found.filter("kept").collect()} == kept_by_brute_force(rows)


def test_edge_cases_of_every_stage(spark):
    """Nulls in every column, repeated and null ids, ties, a very long text and
    extra columns with names that stages use."""
    long = " ".join(str(i * 7919 % 10007) + "w" for i in range(60_000))
    rows = [
        (None, "words without any id here", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", None, 1), (4, long + " end", None, "s", 1),
        (5, "equal words", "en", "s", 1), (5, "equal words", "en", "s", 1), (6, "equal words", "de", "t", 1), (7, "a", "en", "s", 1), (7, "b", "en", "s", 1), (None, "equal words", "en", "s", 1),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", key long, lang_pred string, sha binary").repartition(3)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = stage(spark, docs, "").cache()
        if n < 5:
            assert docs.columns == corpus_pipeline.COLUMNS
        if n == 1:
            assert docs.count() == 9
        if n == 2:
            assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(None, rows[0][1]), (3, long), (4, long + " end"), (6, "equal words"), (7, "a"), (7, "b")], key=str)
        if n == 3:
            assert {r.doc_id for r in docs.collect()} == {None, 3, 6, 7} and docs.count() == 5
    assert docs.count() > 0
