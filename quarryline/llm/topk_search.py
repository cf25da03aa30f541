"""Operator 3: exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers and cut into blocks.  A block's index holds
one bit plane for each attribute and bit.  For a query, the planes are added
up as the bits of the query's weights say: carry-save adders take three planes
to two, over all rows of the block at once, until the bits of every row's
score stand as planes.  The best rows are then selected from the most
significant plane downward, keeping the rows surely in and the rows still
tied with the k-th; rows tied to the last bit are resolved exactly by id.

A weight is written in signed digits of which few are not zero; a negative one
adds the complement of an attribute.  Values are shifted to be non-negative.
Both only add a constant to all scores of a query, which is taken off again.

A block has as many planes as its own values need, whatever their width, and
vectors of very different magnitude go to different blocks, so an outlier
costs its own block alone.

Work is dealt in pairs of one index block and one group of queries.  Both are
of bounded size, so no task holds more than one of each, and each pair gives
at most k rows a query.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part.  Shorter vectors count as padded with
zeros.  Of rows that repeat a query's id one (the least vector) asks; rows with
the query's id are its own and never candidates; rows that repeat another id
are each a candidate.  Equal scores order by smaller id.  Components of any
finite size are exact; a score in the result that no 64-bit integer holds is an
error, never a wrong number.  A table with fewer candidates than k gives them
all; an empty one gives nothing.  Extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, partitions

#: Rows of an index block, a multiple of 64.
BLOCK_ROWS = 65_536
#: Queries of a group: about as many bytes as a block of the index.
GROUP_QUERIES = 4096
#: Rows times queries that a task adds up together, as they fit a core's cache.
TOGETHER = 16_384
#: Magnitudes of quantised components from which vectors go to other blocks.
CLASSES = (1 << 10, 1 << 31)


def _csa(a, b, c):
    """Three addends to two: sums and carries."""
    t = a ^ b
    return t ^ c, (a & b) | (t & c)


def _reduce(addends: np.ndarray, most: int) -> np.ndarray:
    """Addends (n, queries, planes, words), which are used up, to two; plane p
    weighs 2**p.  Their sum is at most ``most``, so no partial sum needs a plane
    beyond it."""
    planes = max(1, most.bit_length())
    while len(addends) > 2:
        n, queries, own, words = addends.shape
        m, width = n // 3, min(own + 1, planes)
        own = min(width, own)
        a, b, c = addends[:m, :, :own], addends[m : 2 * m, :, :own], addends[2 * m : 3 * m, :, :own]
        out = np.empty((n - m, queries, width, words), dtype=np.uint64)
        t = a ^ b
        a &= b
        np.bitwise_xor(t, c, out=out[:m, :, :own])
        t &= c
        np.bitwise_or(t[:, :, : width - 1], a[:, :, : width - 1], out=out[m : 2 * m, :, 1:])
        out[m : 2 * m, :, 0] = 0
        out[2 * m :, :, :own] = addends[3 * m :, :, :own]
        if width > own:
            out[:m, :, own:] = out[2 * m :, :, own:] = 0
        addends = out
    return addends


def signed_digits(weights: np.ndarray) -> list[np.ndarray]:
    """Digits -1, 0 and 1 of integers, from the lowest: no two neighbours of
    one number are both set, so a third of them is set on average."""
    out = []
    while weights.any():
        digit = np.where(weights & 1, 2 - (weights & 3), 0)
        out.append(digit.astype(np.int8))
        weights = (weights - digit) >> 1
    return out


class Block:
    """Bit planes (attributes, bits, words) of up to ``BLOCK_ROWS`` vectors,
    whose ids ascend."""

    def __init__(self, ids: np.ndarray, planes: np.ndarray, low: int):
        none = np.zeros((1, *planes.shape[1:]), dtype=np.uint64)  # what queries with fewer addends add
        self.ids, self.planes, self.low = ids, np.concatenate([planes, none]), low
        words = planes.shape[2]
        valid = np.zeros(words * 64, dtype=np.uint8)
        valid[: len(ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    @staticmethod
    def pack(values: np.ndarray, low: int, bits: int) -> np.ndarray:
        n, dims = values.shape
        words = -(-n // 64)
        shifted = np.zeros((words * 64, dims), dtype=np.int64 if bits < 63 else object)
        shifted[:n] = values - low
        out = np.empty((dims, bits, words), dtype=np.uint64)
        for b in range(bits):
            out[:, b] = np.packbits(np.ascontiguousarray((shifted >> b & 1).astype(np.uint8).T), axis=1, bitorder="little").view(np.uint64)
        return out

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Planes of all rows' scores, (planes, queries, words), and the
        constant to add to them for each query."""
        n, bits, words = len(queries), *self.planes.shape[1:]
        full, none = (1 << bits) - 1, len(self.planes) - 1
        constants, most = [self.low * sum(q.tolist()) for q in queries], 0
        parts = []
        for b, digits in enumerate(signed_digits(queries)):
            counts = np.count_nonzero(digits, axis=1)
            high = int(counts.max())
            if not high:
                continue
            own, flip = np.full((high, n), none), np.zeros((high, n), dtype=np.uint64)
            for i, row in enumerate(digits):
                at = np.flatnonzero(row)
                own[: len(at), i] = at
                flip[: len(at), i] = np.where(row[at] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
                constants[i] -= full * int((row < 0).sum()) << b
            addends = self.planes[own]
            addends ^= flip[:, :, None, None]
            parts.append((b, _reduce(addends, high * full)))
            most += high * full << b
        limit = max(1, most.bit_length())
        addends = np.zeros((sum(len(p) for _, p in parts), n, limit, words), dtype=np.uint64)
        at = 0
        for b, p in parts:
            width = min(p.shape[2], limit - b)
            addends[at : at + len(p), :, b : b + width] = p[:, :, :width]
            at += len(p)
        two = _reduce(addends, most)
        if len(two) < 2:
            return (two[0].transpose(1, 0, 2) if len(two) else np.zeros((1, n, words), dtype=np.uint64)), constants
        total = np.empty((limit, n, words), dtype=np.uint64)
        carry = np.zeros((n, words), dtype=np.uint64)
        for p in range(limit):
            total[p], carry = _csa(two[0][:, p], two[1][:, p], carry)
        return total, constants

    def top(self, query_ids: list[int], queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and scores of the k best rows that are not its own."""
        planes, constants = self.scores(queries)
        return [self._select(planes[:, i], c, q, k) for i, (q, c) in enumerate(zip(query_ids, constants, strict=True))]

    def _select(self, planes: np.ndarray, constant: int, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        tied = self.valid.copy()
        a, b = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        for i in range(a, b):
            tied[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure = np.zeros_like(tied)
        for p in range(len(planes) - 1, -1, -1):
            more = sure | (tied & planes[p])
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied &= planes[p]
            else:
                sure = more
                tied &= ~planes[p]
                if n == k:
                    tied[:] = 0
                    break
        rows = self._rows(sure)
        rows = np.concatenate([rows, self._rows(tied)[: k - len(rows)]])  # equal scores: ids ascend with rows
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        kind = np.int64 if max(len(planes), constant.bit_length()) < 62 else object
        found = (planes[:, word] >> bit & np.uint64(1)).astype(np.int64).astype(kind)
        scores = np.full(len(rows), constant, dtype=kind)
        for p in range(len(planes)):
            scores = scores + (found[p] << p)
        return self.ids[rows], scores

    @staticmethod
    def _rows(mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id``, ``class`` (of magnitude) and the vector floor(scale * x): as
    integers ``v``, or as doubles ``w`` where they do not fit."""
    x = F.col(vector_col)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda x: x.cast("double")).alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    floor = F.transform("x", lambda x: F.floor(F.lit(scale).cast("double") * x))
    top = F.coalesce(F.array_max(F.transform("x", lambda x: F.abs(F.lit(scale).cast("double") * x))), F.lit(0.0)) + 1
    kind = F.when(top < CLASSES[0], 0).when(top < CLASSES[1], 1).otherwise(2)
    wide = F.transform("x", lambda x: F.lit(scale).cast("double") * x)  # beyond 2**31 Python takes the floor
    return rows.select("id", kind.alias("class"), F.when(kind < 2, F.transform(floor, lambda y: y.cast("int"))).alias("v"), F.when(kind == 2, wide).alias("w"))


def _exact(column) -> list[list[int]]:
    return [[math.floor(x) for x in row] for row in column.to_pylist()]


def _matrix(narrow, wide, dims: int) -> np.ndarray:
    """Vectors of one kind as rows, padded with zeros."""
    if wide.null_count < len(wide):
        out = np.zeros((len(wide), dims), dtype=object)
        for i, row in enumerate(_exact(wide)):
            out[i, : len(row)] = row
        return out
    lengths = np.diff(narrow.offsets.to_numpy())
    flat = narrow.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


_INDEX = "block int, low string, bits int, ids binary, data binary"


def _index(dims: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(block, ids, values):
            ids, values = np.concatenate(ids), np.concatenate(values)
            low, high = min(0, int(values.min(initial=0))), max(0, int(values.max(initial=0)))
            bits = max(1, (high - low).bit_length())
            data = Block.pack(values, low, bits).tobytes()
            types = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, str(low), bits, ids.tobytes(), data), types, strict=True)], names=["block", "low", "bits", "ids", "data"])

        at, ids, values, n = None, [], [], 0
        for batch in batches:
            blocks, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                vectors = _matrix(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), dims) if b > a else None
                first = a
                while a < b:
                    if n and (blocks[a] != at or n == BLOCK_ROWS):
                        yield row(at, ids, values)
                        ids, values, n = [], [], 0
                    at, end = int(blocks[a]), min(b, a + BLOCK_ROWS - n)
                    ids.append(own[a:end])
                    values.append(vectors[a - first : end - first])
                    n += end - a
                    a = end
        if n:
            yield row(at, ids, values)

    return run


def _search(dims: int, k: int):
    """Units sorted by (block, group), index rows before queries."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        unit, blocks, asked = None, [], []

        def answers():
            """Queries of one kind, some at a time, against the unit's blocks."""
            out = []
            asked.sort(key=lambda q: q[1].dtype == object)
            while asked:
                together = max(1, TOGETHER // max([1, *(len(b.ids) for b in blocks)]))
                own = [q for q in asked[:together] if q[1].dtype == asked[0][1].dtype]
                del asked[: len(own)]
                ids = [q for q, _ in own]
                for b in blocks:
                    for q, (found, scores) in zip(ids, b.top(ids, np.array([v for _, v in own]), k), strict=True):
                        out.append((np.full(len(found), q, dtype=np.int64), found, scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for block, group, kind, qid, low, bits, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, group) != unit:
                    yield from answers()
                    unit, blocks = (block, group), []
                if kind == 0:
                    rows = np.frombuffer(ids, dtype=np.int64)
                    blocks.append(Block(rows, np.frombuffer(data, dtype=np.uint64).reshape(dims, bits, -1), int(low)))
                else:
                    asked.append((qid, np.frombuffer(data, dtype=np.int32).astype(np.int64) if bits == 0 else np.array([math.floor(x) for x in np.frombuffer(data, dtype=np.float64).tolist()], dtype=object)))
        yield from answers()

    return run


def _query_rows(dims: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def padded(row, kind):
            out = np.zeros(dims, dtype=kind)
            out[: len(row)] = row
            return out.tobytes()

        for batch in batches:
            narrow, wide = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            data = [padded(v, np.int32) if v is not None else padded(w, np.float64) for v, w in zip(narrow, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(v is None) for v in narrow], pa.int32()), pa.array(data, pa.binary())], names=["id", "bits", "data"])

    return run


def search(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's
    k best rows.  ``is_query`` is a condition on the column ``id``."""
    spark = rows.sparkSession
    vectors = materialise(quantised(rows, id_col, vector_col, scale), "topk-vectors")
    asking = vectors.filter(is_query).groupBy("id").agg(F.min(F.struct(F.coalesce(F.transform("v", lambda x: x.cast("double")), "w"), "v", "w")).alias("q"))
    asking = materialise(asking.select("id", "q.v", "q.w"), "topk-queries")
    shape = vectors.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size(F.coalesce(F.transform("v", lambda x: x.cast("double")), "w"))).alias("dims")).collect()  # three rows at most
    dims = max([1, *(r.dims for r in shape)])
    first, blocks, bounds = {}, 0, []
    for r in sorted(shape, key=lambda r: r["class"]):
        first[r["class"]] = blocks
        bounds.append((r["class"], blocks, math.ceil(r.n / BLOCK_ROWS)))
        blocks += bounds[-1][2]
    blocks = max(1, blocks)
    tasks = 2 * partitions(spark)
    groups = max(1, math.ceil(asking.count() / GROUP_QUERIES), math.ceil(tasks / blocks))

    turn, block = F.monotonically_increasing_id(), F.lit(0)
    for kind, start, n in bounds:
        block = F.when(F.col("class") == kind, F.lit(start) + F.pmod(turn, F.lit(n))).otherwise(block)
    dealt = vectors.select(block.cast("int").alias("block"), "id", "v", "w")
    dealt = dealt.repartition(min(blocks, 8 * partitions(spark)), "block").sortWithinPartitions("block", "id")
    index = materialise(dealt.mapInArrow(_index(dims), _INDEX), "topk-index")
    packed = asking.mapInArrow(_query_rows(dims), "id long, bits int, data binary")
    packed = packed.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    each_group, each_block = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(blocks - 1))
    null = F.lit(None)
    work = index.select("block", F.explode(each_group).alias("group"), F.lit(0).alias("kind"), null.cast("long").alias("qid"), "low", "bits", "ids", "data")
    work = work.unionByName(packed.select(F.explode(each_block).alias("block"), "group", F.lit(1).alias("kind"), F.col("id").alias("qid"), null.cast("string").alias("low"), "bits", null.cast("binary").alias("ids"), "data"))
    work = work.repartition(max(partitions(spark), min(2 * blocks * groups, 4096)), "block", "group").sortWithinPartitions("block", "group", "kind")
    best = work.mapInArrow(_search(dims, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
