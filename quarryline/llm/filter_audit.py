"""Operator 11: interaction audit of filters by incidence matrix products.

Each document gets a mask with one bit for each filter that it fails.  Counts
by part and mask are all that any order of the filters needs: which filter
removes a document, and which come too late, depends on its mask alone.  The
counts of a part (all, labelled good, labelled toxic) are stacked as rows and
multiplied by integer matrices with a row for each mask and a column for each
step of each order (32 by 600 for five filters), one matrix for each outcome.

Masks are made where the texts are read.  Only ids, masks, parts and text
digests move on: the smallest id of each digest is a grouped minimum, combined
before its shuffle, and it meets the documents by digest and id, so a large
group of copies is spread over all tasks.  Parts are counted by grouping with
partial sums, so a part that holds most rows is no heavier than others.

Defined results: a null text counts as empty, a null part as the empty string
(and joins a part of that name).  A document without an id is no copy, nor the
original of one; without a label it is neither good nor toxic.  Rows that repeat an id and a text
are each counted and none is a copy because of the other.  Where labels repeat
an id, one that says good (or toxic) is enough.  Very long texts are judged
whole.  An empty table has no parts and gives no rows.  Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import WORD_REGEX, materialise

#: 6 filters are 64 masks by 4,320 steps; beyond that, orders are too many.
MOST_FILTERS = 6
#: Parts multiplied at once.
PARTS = 64

OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
MEASURES = (*OUTCOMES, "good_lost", "toxic_lost", "shapley")

Failure = Callable[[Column, Column], Column]


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < 50


def repeats_words(text: Column, words: Column) -> Column:
    return F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(65).cast("long")


def capitals(text: Column, words: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(text) * F.lit(5).cast("long")


def symbols(text: Column, words: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Stands for the filter that fails copies of texts with a smaller id.
COPY: Failure = lambda text, words: F.lit(False)

#: Filters of the query by letter.
FILTERS: dict[str, Failure] = {"A": few_words, "B": repeats_words, "C": capitals, "D": symbols, "E": COPY}


def matrices(n: int) -> dict[str, np.ndarray]:
    """For each outcome a matrix of 2^n masks by n! * n steps: 1 where a
    document with that mask has that outcome at that step."""
    masks = np.arange(1 << n)
    out = {name: [] for name in OUTCOMES}
    for order in permutations(range(n)):
        earlier = 0
        for f in order:
            fails, before = masks >> f & 1 == 1, masks & earlier != 0
            out["kept"].append(~fails & ~before)
            out["removed"].append(fails & ~before)
            out["redundant"].append(fails & before)
            out["unique_fails"].append(masks == 1 << f)
            earlier |= 1 << f
    return {name: np.array(columns, dtype=np.int64).T for name, columns in out.items()}


def masked(docs: DataFrame, filters: dict[str, Failure], *, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, digest) for each row, without the bits of ``COPY``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD_REGEX})"), F.lit(1)))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), start=F.lit(0))
    return rows.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def _copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with ``bit`` set where a smaller id has the same text."""
    known = rows.filter("id is not null")
    first = known.groupBy(F.col("digest").alias("_digest")).agg(F.min("id").alias("_id"))
    met = known.join(first, (F.col("digest") == F.col("_digest")) & (F.col("id") == F.col("_id")), "left")
    met = met.withColumn("mask", F.col("mask") + F.when(F.col("_id").isNull(), bit).otherwise(0))
    return met.select("id", "part", "mask").unionByName(rows.filter("id is null").select("id", "part", "mask"))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str, good: Column, toxic: Column) -> DataFrame:
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in (("_good", good), ("_toxic", toxic))))
    marks = marks.filter("_good + _toxic > 0")
    met = rows.filter("id is not null").join(marks, F.col("id") == F.col("_id"), "left").select("part", "mask", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))
    none = rows.filter("id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return met.unionByName(none)


def histograms(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Failure] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask."""
    filters = FILTERS if filters is None else filters
    copy = [i for i, f in enumerate(filters.values()) if f is COPY]
    rows = materialise(masked(docs, filters, id_col=id_col, text_col=text_col, part_col=part_col), "audit-masks")
    if copy:
        rows = _copies(rows, sum(1 << i for i in copy))
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    return _labelled(rows, labels, id_col, good, toxic).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Failure] | None = None, **columns) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included:
    ``part``, ``filter_order``, ``step`` (from 1), ``kept`` after the step,
    ``removed`` in it, ``redundant`` (failing its filter, but removed before),
    ``unique_fails`` (failing its filter only), ``good_lost`` and
    ``toxic_lost`` (removed in it) and ``shapley`` (what its filter removes,
    summed over all orders).

    ``filters`` maps one letter each to a condition on (text, words) that is
    true where a document fails; at most ``MOST_FILTERS``.
    """
    filters = FILTERS if filters is None else filters
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS or any(len(k) != 1 for k in filters):
        raise ValueError(f"from one to {MOST_FILTERS} filters, each named by one letter")
    names = ["".join(o) for o in permutations(filters)]
    which = np.array([f for order in permutations(range(n)) for f in order])
    counts = histograms(docs, labels, filters=filters, **columns)
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        by = matrices(n)
        steps = len(which)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                parts, cells = (c.to_pylist() for c in batch.slice(at, PARTS).columns)
                rows = np.zeros((3, len(parts), 1 << n), dtype=np.int64)
                for p, own in enumerate(cells):
                    for c in own:
                        rows[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
                found = {name: rows[0] @ m for name, m in by.items()}
                found["good_lost"], found["toxic_lost"] = rows[1] @ by["removed"], rows[2] @ by["removed"]
                total = np.stack([found["removed"][:, which == f].sum(axis=1) for f in range(n)], axis=1)
                found["shapley"] = total[:, which]
                head = [
                    pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), steps))),
                    pa.array(names, pa.string()).take(pa.array(np.tile(np.repeat(np.arange(len(names)), n), len(parts)))),
                    pa.array(np.tile(np.arange(steps) % n + 1, len(parts)).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(head + [pa.array(found[c].reshape(-1)) for c in MEASURES], names=["part", "filter_order", "step", *MEASURES])

    return stacked.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in MEASURES))
