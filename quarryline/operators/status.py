"""Counts and ratios on the state of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def status(files: DataFrame, symbols: DataFrame, file_chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: counts, queue depths and coverage of an index."""
    code = ~F.col("lang").eqNullSafe(F.lit("text"))
    f = files.agg(
        F.count("*").alias("files"), F.count("indexed_hash").alias("indexed"), F.count_if(F.col("parse_state").isin("ok", "errors")).alias("parsed"),
        F.count_if(F.col("indexed_hash").isNotNull() & code).alias("code_files"),
    )
    q = jobs.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("pending", "running", "dead")))
    out = f
    for part in (symbols.agg(F.count("*").alias("symbols")), file_chunks.agg(F.count("*").alias("chunks")), q):  # one row each
        out = out.join(F.broadcast(part))
    return out.withColumns({"coverage": ratio(F.col("indexed"), F.col("files")), "parsed_coverage": ratio(F.col("parsed"), F.col("files")), "fresh": F.col("pending") == 0})


def histogram(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count("*").alias("n"))


def internals(index: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    totals = files.agg(F.count("*").alias("files"))
    for part in (index["symbols"].agg(F.count("*").alias("symbols")), index["file_chunks"].agg(F.count("*").alias("chunks"), F.countDistinct("content_hash").alias("unique_chunks")), index["edges"].agg(F.count("*").alias("edges"))):
        totals = totals.join(F.broadcast(part))  # one row each
    out = {"totals": totals, "symbol_kinds": histogram(index["symbols"], "kind")}
    if "lang" in files.columns:
        out["langs"] = histogram(files, "lang")
    if "skip_reason" in files.columns:
        out["skipped"] = histogram(files.filter("skip_reason is not null"), "skip_reason")
    return out


def hotspots(symbols: DataFrame, limit: int = 15) -> DataFrame:
    """Files with the most symbols, ties by path."""
    return symbols.groupBy("path").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "path").limit(limit)


def stored_bytes(spark, path: str) -> int:
    """Bytes of the files below a folder, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
