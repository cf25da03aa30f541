import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarryline.llm import quality
from quarryline.llm.queries import op9_quality


def classify(docs, labels, **options):
    return quality.classify(docs, labels, **({"levels": [F.col("source"), F.col("lang")]} | options))


def make(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        site = "hot" if i % 3 == 0 else f"s{i % 7}"
        bad = i % 5 == 0
        rows.append((i, "!!! $$$ %%% BUY" * 5 if bad else "a calm line of words, and more.\n" * 4, "en" if i % 2 else None, site, "x"))
        if i % 2:
            labels.append((i, int(not bad)))
    rows += [(5000, None, None, None, "x"), (5001, "", "en", "new", "x"), (5002, "word " * 40_000, "en", "hot", "x"), (1, rows[1][1], rows[1][2], rows[1][3], "x")]
    labels += [(1, 1), (None, 1), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"), rows, labels


def brute_features(text):
    """Counts of hashed words and pairs, and the dense features, one by one."""
    raw = (text or "").encode()
    words = [xxhash.xxh64_intdigest(w, 7) for w in raw.lower().split()]
    mask = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    hashes = words + [mix((a * 3 + b) & mask) for a, b in zip(words, words[1:], strict=False)]
    kinds = [bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"\n", b"!$%&*#@|<>{}[]=+_~^/\\", bytes(range(128, 256))]
    n = max(len(raw), 1)
    dense = [5 * sum(raw.count(bytes([c])) for c in kind) / n for kind in kinds] + [math.log1p(len(raw)) / 12, len(raw) / max(len(words), 1) / 12]
    return Counter(h >> 64 - quality.BITS for h in hashes), dense


def brute_logit(text, weights):
    counts, dense = brute_features(text)
    n = max(sum(counts.values()), 1)
    return weights[0] + sum(d * w for d, w in zip(dense, weights[1:], strict=False)) + sum(k * weights[1 + quality.DENSE + f] for f, k in counts.items()) / n


def brute_weights(texts, truth):
    """The regression on these rows, given their features one by one."""
    order = sorted(truth, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    order = [i for i in order if i in texts]
    found = [brute_features(texts[i]) for i in order for _ in range(2 if i == 1 else 1)]  # row 1 stands twice
    y = np.array([truth[i] for i in order for _ in range(2 if i == 1 else 1)])
    index = np.concatenate([np.array(sorted(c), dtype=np.int64) for c, _ in found])
    times = np.concatenate([np.array([c[k] for k in sorted(c)], dtype=float) for c, _ in found])
    starts = np.cumsum([0] + [len(c) for c, _ in found])
    return quality.fit(index, times, starts, np.array([d for _, d in found]), y)


def test_the_fit_is_a_minimum():
    """No weight can be moved to lower the loss, which is written out here."""
    draw = np.random.default_rng(0)
    texts = [" ".join(draw.choice(["a", "b", "C", "dd", "!"], draw.integers(0, 9))).encode() for _ in range(60)]
    y = np.array([float(b"a" in t.split()) if i % 7 else 0.5 for i, t in enumerate(texts)])
    index, starts, dense = quality.features(texts)
    w = quality.fit(index, np.ones(len(index)), starts, dense, y, ridge=1e-3)

    def loss(w):
        z = quality.log_odds(w, index, starts, dense)
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.5e-3 * ((w[1 : 1 + quality.DENSE] ** 2).sum() + 1e-2 * (w[1 + quality.DENSE :] ** 2).sum())

    best = loss(w)
    for k in [*range(1 + quality.DENSE), *(1 + quality.DENSE + np.unique(index))]:
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) > best - 1e-6


def test_scores_against_a_brute_force_version(spark):
    docs, labels, rows, marks = make(spark)
    got = classify(docs, labels).collect()
    assert len(got) == len(rows)
    seen = {}
    for i, y in marks:
        if i is not None and y is not None:
            seen.setdefault(i, []).append(y)
    truth = {i: sum(v) / len(v) for i, v in seen.items()}
    site, host = {}, {}
    for i, _, lang, source, _ in rows:
        for table, key in ((site, (source, lang)), (host, source)):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + (i in truth), s + truth.get(i, 0.0))
    total_n, total_s = (sum(x) for x in zip(*host.values(), strict=True))
    mean = (total_s + 1) / (total_n + 2)

    def strength(groups):
        groups = [(n, s, m) for n, s, m in groups if n]
        n = sum(g[0] for g in groups)
        between = sum(k * (s / k - m) ** 2 for k, s, m in groups)
        within = sum(k * m * (1 - m) for k, s, m in groups) / n
        spread = (between - (len(groups) - 1) * within) / max(n - sum(g[0] ** 2 for g in groups) / n, 1e-9)
        return min(max(within / spread - 1, 1.0), 1e6) if spread > 0 else 1e6

    a = strength([(n, s, mean) for n, s in host.values()])
    prior = {h: (s + a * mean) / (n + a) for h, (n, s) in host.items()}
    b = strength([(n, s, prior[k[0]]) for k, (n, s) in site.items()])
    where = {r[0]: (r[3], r[2]) for r in rows}
    texts = {r[0]: r[1] for r in rows}
    weights = brute_weights(texts, truth)
    for r in got:
        assert r.doc_score == pytest.approx(1 / (1 + np.exp(-brute_logit(texts[r.doc_id], weights))), abs=1e-6)
        source, lang = where[r.doc_id]
        y, has = truth.get(r.doc_id, 0.0), r.doc_id in truth
        upper = (host[source][1] - y + a * mean) / (host[source][0] - has + a)
        rate = (site[source, lang][1] - y + b * upper) / (site[source, lang][0] - has + b)
        assert r.site_rate == pytest.approx(rate)
        logit = np.log(r.doc_score / (1 - r.doc_score)) + np.log(rate / (1 - rate)) - np.log(mean / (1 - mean))
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_ranks_bad_documents_low(spark):
    docs, labels, _, _ = make(spark)
    got = {r.doc_id: r.score for r in classify(docs, labels).collect()}
    assert max(got[i] for i in range(0, 400, 5)) < min(got[i] for i in range(400) if i % 5)


def test_no_labels_and_empty(spark):
    docs, labels, _, _ = make(spark, 20)
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0


def test_held_out_labels(spark):
    """A label counts for its site but never for its own document, so labels
    beyond the regression's sample are held out."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.score for r in rows if r.quality]
    bad = [r.score for r in rows if not r.quality]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    alone = [(r.doc_score, r.quality) for r in rows]
    alone_auc = np.mean([(g > b) + (g == b) / 2 for g, x in alone if x for b, z in alone if not z])
    print(f"held-out AUC {auc:.3f}, of the document's own evidence {alone_auc:.3f}")
    assert auc > 0.9 and alone_auc > 0.9


def test_three_levels_and_ties(spark):
    rows = [(i, "same text", f"h{i % 2}", f"p{i % 4}", f"q{i % 8}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c string")
    labels = spark.createDataFrame([(i, int(i % 8 < 4)) for i in range(0, 80, 3)], "doc_id long, quality int")
    got = {r.doc_id: r for r in classify(docs, labels, levels=[F.col("a"), F.col("b"), F.col("c")]).collect()}
    assert len({r.doc_score for r in got.values()}) == 1  # equal texts
    unlabelled = [r for r in got.values() if r.doc_id % 3]
    high, low = [r.score for r in unlabelled if r.doc_id % 8 < 4], [r.score for r in unlabelled if r.doc_id % 8 >= 4]
    assert min(high) > max(low)
    assert got[1].score == got[17].score  # same site, both without a label


def test_query(spark, sf_dir):
    assert op9_quality(spark, sf_dir).count() == 200
