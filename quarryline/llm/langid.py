"""Operator 5: language identification with rank-order n-gram profiles.

A profile lists a language's most frequent n-grams (1 to 3 letters of
lower-cased words, word ends included) by rank.  A document's own most
frequent n-grams are compared with each profile by the out-of-place distance:
the sum over the document's n-grams of how far their rank is from the
profile's, with the profile's length for n-grams that it lacks.  The language
of the least distance wins.

Training counts n-grams over all training texts: combined for each bounded
stretch of text and language, then summed by Spark.  Profiles are
``PROFILE`` n-grams for each language and are refused beyond
``MAX_LANGUAGES`` languages, which bounds what is sent to the driver and back.

Defined results: null texts and texts without a letter are ``und`` with score
0.  ``score`` is 1 minus the distance's share of the largest possible one.
Equal distances go to the language that sorts first.  n-grams of equal count
rank by their letters.  Texts without a language, null texts and null
languages teach nothing; without any training text all documents are
``und``.  Repeated rows count each time.  Texts are read whole.  Extra columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, slices

PROFILE = 400
MAX_LANGUAGES = 1000
#: Characters that are counted at a time in training.
STRETCH = 2_000_000
UNKNOWN = "und"

#: Rank-ordered n-gram codes by language.
Profiles = dict[str, np.ndarray]

_LETTER = np.zeros(0x110000, dtype=np.int8)  # 0: not looked up yet, 1: letter, 2: other


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 characters within words.

    A code packs up to three code points of 21 bits; code point 0 stands for
    a word end and only ever comes first or last.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _LETTER[points]
    if not kinds.all():
        for p in np.unique(points[kinds == 0]).tolist():
            _LETTER[p] = 1 if chr(p).isalpha() else 2
        kinds = _LETTER[points]
    letters = np.where(kinds == 1, points, 0).astype(np.int64)
    edged = np.concatenate([[0], letters, [0]])
    keep = np.ones(len(edged), dtype=bool)
    keep[1:] = (edged[1:] != 0) | (edged[:-1] != 0)  # runs of other characters are one word end
    edged = edged[keep]
    if len(edged) < 3:
        return np.zeros(0, dtype=np.int64)
    a, b = edged[:-1], edged[1:]
    pairs = a << 21 | b | 1 << 62
    middle = b[:-1] != 0
    triples = (a[:-1] << 42 | pairs[1:] & ~(1 << 62))[middle]
    return np.concatenate([edged[edged != 0], pairs, triples | -1 << 63])


def _train(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: dict[str, list[str]] = {}
    size = 0

    def counts():
        for lang, texts in held.items():
            codes, n = np.unique(gram_codes("\n".join(texts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in slices(batches):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > STRETCH:
                yield from counts()
                held, size = {}, 0
    yield from counts()


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> Profiles:
    """Profiles from all rows with a text and a language."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    grams = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = materialise(grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= length), "langid-profiles")
    if top.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():  # at most MAX_LANGUAGES * length rows
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(codes, dtype=np.int64) for lang, codes in profiles.items()}


class Classifier:
    def __init__(self, profiles: Profiles, length: int = PROFILE):
        self.length, self.names = length, sorted(profiles)
        known = [profiles[x] for x in self.names]
        self.codes = np.unique(np.concatenate(known)) if known else np.zeros(0, dtype=np.int64)
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, dtype=np.int64)
        for i, codes in enumerate(known):
            self.ranks[i, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = gram_codes(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        grams, n = np.unique(codes, return_counts=True)
        if len(grams) > self.length:  # grams ascend, so a stable sort breaks ties by letters
            grams = grams[np.argsort(-n, kind="stable")[: self.length]]
        else:
            grams = grams[np.argsort(-n, kind="stable")]
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        ranks = self.ranks[:, np.where(self.codes[at] == grams, at, len(self.codes))]
        out = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(grams))))
        distance = out.sum(axis=1)
        best = int(distance.argmin())
        return self.names[best], max(0.0, 1.0 - float(distance[best]) / (self.length * len(grams)))


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = PROFILE) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(profiles)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        classifier = Classifier(shared.value, length)
        for batch in slices(batches):
            found = [classifier.predict(t) for t in batch.column(at).to_pylist()]
            cols = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, "lang_pred", "score"])

    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    at = len(names)
    if text_col in keep and dict(docs.dtypes)[text_col] == "string":  # the text is there already
        at = keep.index(text_col)
        rows = rows.drop("text")
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in names)
    out = rows.mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double")
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "lang_pred", "score")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
