"""Operator 12: vector codes of integer codebooks (product quantisation).

Each component becomes an integer; a vector is cut into equal consecutive
parts, and each part position has a codebook.  Codebooks are small and are
broadcast.  A task computes the distances of its rows to all entries by norm
expansion, |v|^2 + |c|^2 - 2 v.c, with exact int64 matrix products, and takes
the first least one.  Sums and counts of each entry are added up within a task,
so a task gives out no more rows than the codebooks have entries (cut into
``CHUNK`` components), and these meet in a grouped shuffle each round.  No row
moves, however often a vector or a label repeats.

All arithmetic is exact.  Components so large that int64 would not hold a
distance are computed with Python's integers, their sums are merged in digits
of ``DIGIT`` bits; an error that 64 bits can't hold is an error.

Defined results: vectors that are null, or hold a null or a component that is
not finite, take no part.  Nor do vectors that can't be cut or compared: those
whose length is zero or no multiple of the parts, and those of another length
than the first of the rest by id.  First entries are the vectors of the
smallest ids, ties by components, null ids last; with fewer vectors than
entries, codebooks are shorter.  Repeated rows each count and each get their
code.  Null labels are one label.  An empty table gives an empty result.
Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialise
from quarryline.llm.simhash import hot_join

#: Components that one row of partial sums holds.
CHUNK = 16
#: Bits of a digit where sums are longer than 64 bits.
DIGIT = 40
#: Numbers in all codebooks together: 128 MB are sent to each executor at most.
MOST_NUMBERS = 1 << 24
#: Components that a task turns into integers at once.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Codebooks:
    """``entries`` is (part, entry, position), of int64 or of Python integers."""

    entries: np.ndarray
    scale: int

    def text(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def kept_rows(vectors: DataFrame, *, parts: int, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(id, label, raw, n, peak): usable vectors as packed numbers, with their
    length and the largest magnitude of a component."""
    rows = vectors.select(F.col(id_col).alias("id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).alias("vector"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    narrow = kind["vector"].elementType.simpleString() == "float"
    if not narrow:
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(2)
            if not batch.num_rows:
                continue
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64() if not narrow else pa.float32())
            values = values.fill_null(math.nan).to_numpy(zero_copy_only=False)
            offsets -= offsets[0]
            lengths = np.diff(offsets)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0) & (lengths % parts == 0)
            ok &= column.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            full = np.flatnonzero(lengths)
            peak = np.zeros(len(lengths))
            peak[full] = np.maximum.reduceat(np.abs(values), offsets[full])
            size = values.dtype.itemsize
            raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
            packed = [raw[offsets[i] * size : offsets[i + 1] * size] for i in at.tolist()]
            keep = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(packed, pa.binary()), pa.array(lengths[at]), pa.array(peak[at])], names=["id", "label", "raw", "n", "peak"])

    return rows.mapInArrow(run, f"id {kind['id'].simpleString()}, label {kind['label'].simpleString()}, raw binary, n long, peak double")


def whole(raw: list[bytes], scale: int, size: int, parts: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of packed vectors, as (row, part, position)."""
    x = np.frombuffer(b"".join(raw), dtype=f"<f{size}").astype(np.float64)
    if wide:
        out = np.array([math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.tolist()], dtype=object)
    else:
        out = np.floor(x * scale).astype(np.int64)
    return out.reshape(len(raw), parts, -1)


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one part: the first nearest entry of each row, and its squared
    distance."""
    open_ = (entries * entries).sum(axis=1)[None, :] - 2 * (vectors @ np.ascontiguousarray(entries.T))
    code = np.argmin(open_, axis=1) if open_.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in open_.tolist()])
    return code, (vectors * vectors).sum(axis=1) + open_[np.arange(len(code)), code]


def _parted(batches: Iterator, scale: int, size: int, parts: int, dims: int, wide: bool) -> Iterator:
    for batch in batches:
        step = min(4096, max(1, AT_ONCE // dims))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            raw = part.column(batch.schema.get_field_index("raw")).to_pylist()
            yield part, whole(raw, scale, size, parts, wide)


def digits(sums: np.ndarray, count: int) -> list[np.ndarray]:
    """Python integers as ``count`` digits of ``DIGIT`` bits, the last signed."""
    out = []
    for k in range(count):
        out.append((sums if k == count - 1 else sums & ((1 << DIGIT) - 1)).astype(np.int64))
        sums = sums >> DIGIT
    return out


def _sums(shared, scale: int, size: int, dims: int, wide: int):
    """One row for each part, entry, digit and chunk that the task's rows use."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        books = shared.value
        parts, entries, width = books.shape
        sums = np.zeros(books.shape, dtype=object if wide else np.int64)
        counts = np.zeros((parts, entries), dtype=np.int64)
        for _, rows in _parted(batches, scale, size, parts, dims, bool(wide)):
            for p in range(parts):
                code, _ = nearest(rows[:, p], books[p])
                order = np.argsort(code, kind="stable")
                own, first, n = np.unique(code[order], return_index=True, return_counts=True)
                sums[p, own] += np.add.reduceat(rows[order, p], first, axis=0)
                counts[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(counts)
        if not len(p):
            return
        chunks = -(-width // CHUNK)
        for k, digit in enumerate(digits(sums[p, e], wide) if wide else [sums[p, e]]):
            padded = np.zeros((len(p), chunks * CHUNK), dtype=np.int64)
            padded[:, :width] = digit
            for c in range(chunks):
                own = padded[:, c * CHUNK : (c + 1) * CHUNK]
                columns = [np.full(len(p), k), p, e, np.full(len(p), c)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.astype(np.int32)) for x in columns), pa.array(counts[p, e]), *(pa.array(np.ascontiguousarray(own[:, i])) for i in range(CHUNK))],
                    names=["digit", "part", "entry", "chunk", "n", *(f"s{i}" for i in range(CHUNK))],
                )

    return run


@dataclass(frozen=True)
class Vectors:
    """Usable vectors of one length, as a table, and what is known of them."""

    rows: DataFrame
    dims: int
    size: int
    parts: int
    scale: int
    wide: int

    @staticmethod
    def of(vectors: DataFrame, *, parts: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> Vectors:
        rows = materialise(kept_rows(vectors, parts=parts, id_col=id_col, vector_col=vector_col, label_col=label_col), "codes-rows")
        first = rows.orderBy(F.col("id").asc_nulls_last(), "raw").select("n", "raw").first()
        if first is None:
            return Vectors(rows, 0, 8, parts, scale, 0)
        dims = first["n"]
        rows = rows.filter(F.col("n") == dims)
        peak, total = rows.agg(F.max("peak"), F.count("*")).first()
        bits = math.ceil(math.log2(peak + 1) + math.log2(scale)) + 2
        # a distance takes 2 bits more than a square for each, a sum over rows the bits of their number
        narrow = 2 * bits + 2 + math.ceil(math.log2(dims)) <= 62 and bits + total.bit_length() <= 62
        return Vectors(rows, dims, len(first["raw"]) // dims, parts, scale, 0 if narrow else -(-(bits + total.bit_length()) // DIGIT) + 1)


def train(vectors: Vectors, *, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks after ``rounds`` of assigning every part and replacing every
    entry that is used by the floor of its parts' mean."""
    if not 1 <= entries <= 256:
        raise ValueError("from 1 to 256 entries: a code is one byte")
    if vectors.dims * entries > MOST_NUMBERS:
        raise ValueError(f"codebooks of more than {MOST_NUMBERS} numbers")
    spark = vectors.rows.sparkSession
    first = [r["raw"] for r in vectors.rows.orderBy(F.col("id").asc_nulls_last(), "raw").limit(entries).select("raw").collect()]
    if not first:
        return Codebooks(np.zeros((vectors.parts, 0, 0), dtype=np.int64), vectors.scale)
    books = np.ascontiguousarray(whole([bytes(r) for r in first], vectors.scale, vectors.size, vectors.parts, bool(vectors.wide)).transpose(1, 0, 2))
    names = [f"s{i}" for i in range(CHUNK)]
    schema = "digit int, part int, entry int, chunk int, n long, " + ", ".join(f"{s} long" for s in names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = vectors.rows.select("raw").mapInArrow(_sums(shared, vectors.scale, vectors.size, vectors.dims, vectors.wide), schema)
        merged = sums.groupBy("digit", "part", "entry", "chunk").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect()
        shared.unpersist()
        total = np.zeros((*books.shape[:2], -(-books.shape[2] // CHUNK) * CHUNK), dtype=object if vectors.wide else np.int64)
        count = np.zeros(books.shape[:2], dtype=np.int64)
        for r in merged:
            at = r["chunk"] * CHUNK
            own = np.array([r[s] for s in names], dtype=total.dtype)
            total[r["part"], r["entry"], at : at + CHUNK] += own * (1 << DIGIT * r["digit"]) if vectors.wide else own
            count[r["part"], r["entry"]] = r["n"]
        used = count > 0
        books = books.copy()
        books[used] = total[used][:, : books.shape[2]] // count[used][:, None].astype(total.dtype)
    return Codebooks(books, vectors.scale)


def assign(vectors: Vectors, books: Codebooks) -> DataFrame:
    """(id, label, code, error): ``code`` has one byte for each part, ``error``
    is the squared distance to the entries, summed over the parts."""
    shared = vectors.rows.sparkSession.sparkContext.broadcast(books.entries)
    scale, size, parts, dims, wide = vectors.scale, vectors.size, vectors.parts, vectors.dims, bool(vectors.wide)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        books = shared.value
        for batch, rows in _parted(batches, scale, size, parts, dims, wide):
            codes, error = np.zeros((len(rows), parts), dtype=np.uint8), 0
            for p in range(parts):
                codes[:, p], d = nearest(rows[:, p], books[p])
                error = error + d
            packed = codes.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packed[i : i + parts] for i in range(0, len(packed), parts)], pa.binary()), pa.array(error.tolist(), pa.int64())], names=["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.rows.schema.fields}
    return vectors.rows.select("id", "label", "raw").mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code binary, error long")


def decode(codes: DataFrame, books: Codebooks, *, code_col: str = "code") -> DataFrame:
    """``codes`` with ``decoded``: the entries that the code names, unscaled."""
    table = [[[v / books.scale for v in entry] for entry in part] for part in books.entries.tolist()]
    shared = codes.sparkSession.sparkContext.broadcast(np.array(table, dtype=np.float64))

    @F.pandas_udf("array<double>")
    def decoded(code):
        import pandas as pd

        return pd.Series([None if c is None else np.concatenate([shared.value[p, e] for p, e in enumerate(c)]) for c in code])

    return codes.withColumn("decoded", decoded(F.col(code_col)))


def with_label_error(assigned: DataFrame) -> DataFrame:
    """``assigned`` (a table) with the error summed over equal labels.  Rows of
    labels that many rows share stay where they are."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = assigned.withColumn("_key", key)
    sums = materialise(rows.groupBy(F.col("_key").alias("c")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "codes-labels")
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return hot_join(rows, "_key", sums, total).drop("_key")


def compress(vectors: DataFrame, *, entries: int = 256, rounds: int = 4, **options) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors, (id, label, code, error, label_error), and
    the codebooks that they refer to."""
    usable = Vectors.of(vectors, **options)
    books = train(usable, entries=entries, rounds=rounds)
    found = materialise(assign(usable, books), "codes-assigned")
    return with_label_error(found).withColumnRenamed("id", options.get("id_col", "vec_id")), books
