"""A training-corpus pipeline over ``documents``.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a table that the next one takes as its ``docs``.  All but
the last return the columns of ``documents``.

1. Language ID: profiles are learnt from the documents that carry a language.
   Documents without any letter are rejected; where a document carries no
   language the predicted one is filled in (none where no document carries one).
2. Exact dedup: of equal texts the largest doc_id stays.
3. SimHash near-dedup: distinct five-word shingles, 256-bit fingerprints.  Texts whose
   shingle sets have a similarity of 0.8 differ in 39 of these bits on
   average (standard deviation under 6), unrelated texts in 128 (8).  Texts
   within 64 bits that share a sampled band of bits are candidates (the bands'
   width follows the number of texts, so buckets keep their size, and their
   number follows from a recall of 0.999 at that width), as are texts of at most 40 shingles that share a shingle of
   their prefixes, in both where their numbers of shingles allow a similarity
   of 0.8.  Candidates are verified: only texts whose shingle sets
   have a Jaccard similarity of 0.8 are linked.
   Of each group the smallest doc_id stays.
4. Mixing: documents are left out or repeated towards the source targets.
5. SentencePiece: token count and digests for each document.

Candidates for longer texts come from sampled bands, so a pair at a similarity
of 0.8 is missed once in some hundreds; the exact way is ``EXACT = True``,
which lets texts of every length meet by the hashes of their prefixes, at the
cost of a row for each fifth shingle.

Defined results, in each stage: null and empty texts hold no letter and go in
the first; further on they would count as empty texts, equal to each other.
Very long texts are handled whole.  Of equal texts and of groups of near copies
one row stays, also where rows repeat a doc_id; rows without a doc_id are
never dropped as near copies, and among copies they are the first to go.  Ties
of the language go to the one that sorts first.  A null source is a source of
its own.  Empty tables give empty tables.  Extra columns, whatever their names,
are left out at the first stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import exact_dedup, langid, mixing, sentencepiece_codec, simhash
from quarryline.llm.common import materialise, read
from quarryline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Stands for a language where none was learnt.
ANY = "any"
SHINGLE, WORDS, RADIUS = 5, 4, 64
EXACT = False
SIMILARITY = (4, 5)


def _without(docs: DataFrame, drop: DataFrame, keys: dict[str, object]) -> DataFrame:
    """Rows of ``docs`` that ``drop`` does not name."""
    drop = drop.select(*(F.col(k).alias(f"_{k}") for k in keys))
    on = [column.eqNullSafe(F.col(f"_{k}")) for k, column in keys.items()]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return docs.join(drop, condition, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    profiles = langid.train(docs) or {ANY: np.array([-1])}  # nothing to learn from: letters alone decide
    found = langid.identify(docs, profiles, keep=tuple(COLUMNS)).filter(F.col("lang_pred") != langid.UNKNOWN)
    known = F.coalesce("lang", F.nullif("lang_pred", F.lit(ANY)))
    return found.withColumn("lang", known).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = materialise(exact_dedup.dedup(docs), "pipeline-copies")
    repeated = found.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    if not repeated.isEmpty():  # one document in several rows
        docs = docs.dropDuplicates(["doc_id", "text"])
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return _without(docs, found.filter("not kept"), {"doc_id": F.col("doc_id"), "text_sha256": sha})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = simhash.near_copies(docs, threshold=SIMILARITY, shingle=SHINGLE, words=WORDS, radius=RADIUS, exact=EXACT)
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return _without(docs, found.filter("not kept"), {"doc_id": F.col("doc_id"), "text_sha256": sha})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL has neither the learnt profiles nor XXH64 fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
