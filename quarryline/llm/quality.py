"""Operator 9: quality classifier with hierarchical empirical Bayes.

A document's own evidence is a logistic regression on its hashed words and
word pairs (the mean of their weights) and on a few shares of its characters.
It is combined with what is known of its site: labels are summed for each host
and for each path level below it, and their rates shrink towards the level
above: a path towards its host, a host towards the global rate.  The strength
of shrinking comes from the data, level by level, by the method of moments
over grouped sums, so sparse sites stay near their prior.

The final log odds are those of the document plus what its deepest level's
posterior adds to the global rate.  A document's own label never counts in its
own site's posterior.

The regression is fitted on the ``SAMPLE`` labelled rows whose digest of
doc_id is smallest (all, if fewer), which reach the driver as counts of hashed
features, at most ``2 * 2**BITS`` numbers each.  Everything else uses all rows.

Defined results: null texts count as empty, and texts without words are judged
by their characters; null hosts or paths are a site of their own; null labels
teach nothing.  Of labels that repeat a doc_id the mean counts as one.  Equal
digests in the sample order by doc_id; equal scores stay equal.  Without any
label the score is 0.5.  Very long texts are read whole.  Repeated rows give
repeated results; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, mix64, slices, starts_of, text_bytes

#: Most labelled rows that the regression is fitted on.
SAMPLE = 4_000
#: Bits of a hashed feature.
BITS = 16
#: Bytes of text whose features are made at a time.
STRETCH = 1_000_000

#: Kinds of bytes whose shares are features: A-Z, 0-9, punctuation, line ends, markup and signs, beyond ASCII.
_KIND = np.zeros(256, dtype=np.int64)
for _n, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"\n", b"!$%&*#@|<>{}[]=+_~^/\\", bytes(range(128, 256))), 1):
    _KIND[list(_set)] = _n
KINDS = 6
DENSE = KINDS + 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and pairs of neighbouring words of all texts, where each
    text's start, and the dense features (texts, DENSE)."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}
    words, counts = [], []
    for text in texts:
        own = text.lower().split()
        counts.append(len(own))
        for w in own:
            h = known.get(w)
            if h is None:
                h = known[w] = xxh64_intdigest(w, 7)
            words.append(h)
    single = np.array(words, dtype=np.uint64)
    counts = np.array(counts, dtype=np.int64)
    first = starts_of(counts)
    pairs = mix64(single[:-1] * np.uint64(3) + single[1:]) if len(single) else single
    within = np.ones(len(pairs), dtype=bool)
    cuts = first[1:-1] - 1
    within[cuts[(cuts >= 0) & (cuts < len(pairs))]] = False
    doc = np.repeat(np.arange(len(texts)), counts)
    index = np.concatenate([single >> np.uint64(64 - BITS), pairs[within] >> np.uint64(64 - BITS)]).astype(np.int64)
    owner = np.concatenate([doc, doc[:-1][within]]) if len(doc) else doc
    index = index[np.argsort(owner, kind="stable")]
    starts = starts_of(np.bincount(owner, minlength=len(texts)))

    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    kind = np.bincount(np.repeat(np.arange(len(texts)), lengths) * (KINDS + 1) + _KIND[flat], minlength=len(texts) * (KINDS + 1)).reshape(-1, KINDS + 1)[:, 1:]
    n = np.maximum(lengths, 1)
    dense = np.column_stack([5.0 * kind / n[:, None], np.log1p(lengths) / 12.0, lengths / np.maximum(counts, 1) / 12.0])
    return index, starts, dense


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of consecutive stretches; of an empty one 0."""
    n = np.diff(starts)
    sums = np.zeros(len(n))
    if len(values):
        sums[n > 0] = np.add.reduceat(values, starts[:-1][n > 0])
    return sums / np.maximum(n, 1)


def log_odds(weights: np.ndarray, index: np.ndarray, starts: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Weights: intercept, dense features, hashed features."""
    return weights[0] + dense @ weights[1 : 1 + DENSE] + _means(weights[1 + DENSE :][index], starts)


def fit(index: np.ndarray, times: np.ndarray, starts: np.ndarray, dense: np.ndarray, y: np.ndarray, *, ridge: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of a ridge logistic regression by L-BFGS.  Features come as
    distinct ``index`` with how many ``times`` they stand in each text.  The
    mean of hashed weights is small, so their ridge is small too."""
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts))
    share = (times / np.maximum(np.bincount(rows, weights=times, minlength=len(y)), 1)[rows]).astype(np.float32)
    index = index.astype(np.int32)
    del times
    size = 1 + DENSE + (1 << BITS)
    penalty = np.full(size, ridge)
    penalty[0], penalty[1 + DENSE :] = 0.0, ridge * 1e-2

    def loss(w):
        z = w[0] + dense @ w[1 : 1 + DENSE] + np.bincount(rows, weights=share * w[1 + DENSE :][index], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        miss = (p - y) / len(y)
        gradient = np.concatenate([[miss.sum()], dense.T @ miss, np.bincount(index, weights=share * miss[rows], minlength=1 << BITS)])
        value = float(np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (penalty * w * w).sum())
        return value, gradient + penalty * w

    w = np.zeros(size)
    value, gradient = loss(w)
    history: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() < 1e-7:
            break
        step, marks = gradient.copy(), []
        for s, d, r in reversed(history):
            a = r * (s @ step)
            marks.append(a)
            step -= a * d
        step *= (history[-1][0] @ history[-1][1]) / (history[-1][1] @ history[-1][1]) if history else 1.0
        for (s, d, r), a in zip(history, reversed(marks), strict=True):
            step += s * (a - r * (d @ step))
        slope, length = float(gradient @ step), 1.0
        while True:
            new = w - length * step
            new_value, new_gradient = loss(new)
            if new_value <= value - 1e-4 * length * slope or length < 1e-9:
                break
            length /= 2
        s, d = new - w, new_gradient - gradient
        if s @ d > 1e-12:
            history = [*history[-9:], (s, d, 1 / (s @ d))]
        done = abs(value - new_value) < 1e-10
        w, value, gradient = new, new_value, new_gradient
        if done:
            break
    return w


def _in_stretches(batches: Iterator) -> Iterator:
    """Arrow batches in parts of bounded rows and text (last column)."""
    for batch in slices(batches):
        texts = text_bytes(batch.column(batch.num_columns - 1))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STRETCH):
                size += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _counted(batches: Iterator) -> Iterator:
    """Labels and counted features of the sample's rows."""
    import pyarrow as pa

    for batch, texts in _in_stretches(batches):
        index, starts, dense = features(texts)
        found = [np.unique(index[a:b], return_counts=True) for a, b in zip(starts, starts[1:], strict=False)]
        cols = [pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["y", "feature", "times", "dense"])


def _scored(shared, schema_names: list[str]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights = shared.value
        for batch, texts in _in_stretches(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(log_odds(weights, *features(texts)))], names=schema_names)

    return run


def _strength(rates: DataFrame, prior: str) -> float:
    """Prior observations that a level's rates shrink by (method of moments):
    from columns n (labels), s (their sum) and the prior mean."""
    m = F.col(prior)
    row = rates.filter("n > 0").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2)).alias("between"), (F.sum(F.col("n") * m * (1 - m)) / F.sum("n")).alias("within"),
    ).first()
    if not row.k or row.k < 2 or not row.within:
        return 1e6
    spread = (row.between - (row.k - 1) * row.within) / max(row.n - row.nn / row.n, 1e-9)
    return float(min(max(row.within / spread - 1, 1.0), 1e6)) if spread > 0 else 1e6


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (F.lit(1.0) - p))


def classify(docs: DataFrame, labels: DataFrame, *, levels: Sequence[Column], text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: ``doc_id``, ``doc_score`` (the document's own
    evidence), ``site_rate`` (posterior of its deepest level) and ``score``, 0
    to 1.  ``levels``: the host, then path levels below it."""
    spark = docs.sparkSession
    keys = [f"site{i}" for i in range(len(levels))]
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col("doc_id"), *(c.cast("string").alias(k) for c, k in zip(levels, keys, strict=True)), text.alias("text"))
    truth = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("double").alias("y")).filter("_id is not null and y is not null").groupBy("_id").agg(F.avg("y").alias("y"))
    truth = materialise(truth, "quality-labels")

    digest = F.md5(F.col("_id").cast("string"))
    share = (sample + 10 * sample**0.5 + 20) / max(truth.count(), 1)
    chosen = truth
    if share < 1:  # the smallest digests lie below this share of their range, so few more rows than the sample are sorted
        chosen = truth.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(share * (1 << 32)))
    chosen = materialise(chosen.withColumn("digest", digest).orderBy("digest", "_id").limit(sample), "quality-sample")  # labels of at most ``sample`` documents
    taught = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).orderBy("digest", "doc_id").limit(sample).select("y", "text")
    taught = taught.mapInArrow(_counted, "y double, feature binary, times binary, dense binary").collect()
    if not taught:
        return rows.select("doc_id", F.lit(0.5).alias("doc_score"), F.lit(0.5).alias("site_rate"), F.lit(0.5).alias("score"))
    parts = [np.frombuffer(r.feature, np.int32) for r in taught]
    starts = starts_of(np.array([len(x) for x in parts]))
    index, times = np.concatenate(parts), np.concatenate([np.frombuffer(r.times, np.int32) for r in taught])
    dense, y = np.array([np.frombuffer(r.dense) for r in taught]), np.array([r.y for r in taught])
    del taught, parts
    weights = fit(index, times, starts, dense, y)
    del index, times

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = ["doc_id", *keys, "logit"]
    scored = rows.mapInArrow(_scored(spark.sparkContext.broadcast(weights), names), ", ".join([f"doc_id {kinds['doc_id']}", *(f"{k} string" for k in keys), "logit double"]))
    scored = materialise(scored, "quality-rows")
    known = materialise(scored.join(truth, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "quality-known")

    deepest = materialise(known.groupBy(*keys).agg(F.count("y").alias("n"), F.sum("y").alias("s")).fillna(0.0, ["s"]), "quality-sites")
    total = deepest.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (total.s + 1.0) / (total.n + 2.0)
    # From the host down: each level's rate shrinks towards the one above.
    sites, strengths = None, []
    for depth in range(1, len(keys) + 1):
        own = keys[:depth]
        level = deepest.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        if sites is None:
            level = level.withColumn("prior", F.lit(mean)).withColumn("above", F.array().cast("array<struct<n:bigint,s:double>>"))
        else:
            upper = sites.select(*(F.col(k).alias(f"_{k}") for k in own[:-1]), F.col("rate").alias("prior"), F.concat("above", F.array(F.struct("n", "s"))).alias("above"))
            level = _join_keys(level, upper, own[:-1])
        level = materialise(level, "quality-level")
        strengths.append(_strength(level, "prior"))
        sites = level.withColumn("rate", (F.col("s") + strengths[-1] * F.col("prior")) / (F.col("n") + strengths[-1]))
    sites = sites.select(*(F.col(k).alias(f"_{k}") for k in keys), F.concat("above", F.array(F.struct("n", "s"))).alias("counts"))
    out = _join_keys(known, sites, keys)
    own, has = F.coalesce("y", F.lit(0.0)), F.col("y").isNotNull().cast("double")
    rate: Column = F.lit(mean)
    for depth, strength in enumerate(strengths):
        c = F.col("counts")[depth]
        rate = (c["s"] - own + strength * rate) / (c["n"] - has + strength)
    logits = F.col("logit") + _logit(rate) - float(np.log(mean / (1 - mean)))
    return out.select("doc_id", (1 / (1 + F.exp(-F.col("logit")))).alias("doc_score"), rate.alias("site_rate"), (1 / (1 + F.exp(-logits))).alias("score"))


def _join_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on equal or null keys, which ``table`` has with a ``_``."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(table, on, "left").drop(*(f"_{k}" for k in keys))
