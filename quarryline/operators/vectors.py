"""Vector arm: brute-force inner products, in single precision or int8."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantise(vector: Column) -> tuple[Column, Column]:
    """Symmetric int8 codes of a vector and their scale."""
    top = F.array_max(F.transform(vector, F.abs)).cast("double")
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    return F.transform(vector, lambda x: F.round(x.cast("double") / scale).cast("tinyint")), scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", int8: bool = False) -> DataFrame:
    """The k rows of greatest inner product with one query, ties by id.

    Arrow batches go through one matrix product each and give out at most k
    rows; a final ordered limit merges them.  Scores are rounded to six digits
    once, before any row is chosen, so near ties go by id however rows lie in
    batches.
    """
    target = np.asarray(query, dtype=np.float64)
    if int8:
        top = np.abs(target).max(initial=0.0)
        q_scale = top / 127.0 if top > 0 else 1.0
        target = np.rint(target / q_scale)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            data = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            if not data.size:
                continue
            if int8:
                top = np.abs(data).max(axis=1)
                scale = np.where(top > 0, top / 127.0, 1.0)
                ratio = data / scale[:, None]
                score = (np.sign(ratio) * np.floor(np.abs(ratio) + 0.5)) @ target * (scale * q_scale)
            else:
                score = data @ target
            ids = batch.column(0).to_numpy()
            score = score.round(6)
            best = np.lexsort((ids, -score))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(score[best])], names=["id", "score"])

    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector_col)
    rows = rows.mapInArrow(run, "id long, score double")
    return rows.orderBy(F.desc("score"), "id").limit(k).withColumnRenamed("id", id_col)


#: Rows and queries of a unit of ``top_k_each``, and queries of one product.
BLOCK_ROWS, GROUP_QUERIES, STRETCH = 65_536, 1024, 32


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by id: only scores not below the
    k-th greatest are sorted."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    among = among[scores[among] > -np.inf]
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): each query's k best rows but itself, ties by
    id.  Blocks of rows meet groups of queries, both of bounded size, in one
    matrix product each; a unit gives out at most k rows a query."""
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    blocks, groups = max(1, math.ceil(rows.count() / BLOCK_ROWS)), max(1, math.ceil(asked.count() / GROUP_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("group"), "id", "v")
    right = asked.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), "id", "v")

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def best(a, b):
        import pyarrow as pa

        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if a.num_rows and b.num_rows:
            ids, wanted = a["id"].to_numpy(), b["id"].to_numpy()
            rows, asked = matrix(a["v"]).T, matrix(b["v"])
            for at in range(0, len(wanted), STRETCH):
                scores = np.round(asked[at : at + STRETCH] @ rows, 6)
                own = wanted[at : at + STRETCH]
                scores[own[:, None] == ids[None, :]] = -np.inf
                for q, row in zip(own.tolist(), scores, strict=True):
                    found = _best(ids, row, k)
                    for column, values in zip(out, (np.full(len(found), q), ids[found], row[found]), strict=True):
                        column.append(values)
        return pa.table([np.concatenate(c) for c in out], names=["query_id", "id", "score"])

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(best, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
