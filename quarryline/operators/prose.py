"""Texts other than code: headings, secrets, references, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Secrets by kind, in the order in which they are replaced.
SECRETS = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws-key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("assigned", r"(?i)\b(?:password|passwd|secret|token|api_key|apikey)\s*[:=]\s*[\"'][^\"'\n]{8,}[\"']"),
)
# References by kind.
REFERENCES = (("issue", r"#[0-9]+"), ("ticket", r"\b[A-Z]{2,10}-[0-9]+\b"), ("todo", r"\b(?:TODO|FIXME)\b"), ("link", r"https?://[^\s<>\"')\]]+"))


def redacted(text: Column) -> Column:
    """Secrets replaced by ``[redacted:kind]``."""
    for kind, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, f"[redacted:{kind}]")
    return text


def references(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, ref, n): what texts refer to, with how often they do."""

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("ref")))

    found = [named(kind, pattern) for kind, pattern in REFERENCES]
    rows = docs.select(F.col(id_col), F.explode(F.concat(*found)).alias("r")).select(id_col, "r.kind", "r.ref")
    return rows.groupBy(id_col, "kind", "ref").agg(F.count("*").alias("n"))


def heading_chunks(docs: DataFrame) -> DataFrame:
    """Prose cut at Markdown headings: path, ord, heading, body."""
    lines = docs.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("head", F.col("line").rlike(r"^#{1,6}\s+\S"))
    part = F.sum(F.col("head").cast("int")).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("ord", part).groupBy("path", "ord").agg(F.array_sort(F.collect_list(F.struct("at", "line", "head"))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    heading = F.when(F.col("x")[0]["head"], F.regexp_replace(F.col("x")[0]["line"], r"^#+\s+|\s+$", ""))
    return rows.select("path", "ord", heading.alias("heading"), body.alias("body")).filter(F.col("body").rlike(r"\S"))


def overlapping_windows(docs: DataFrame, size: int = 120, overlap: float = 0.15) -> DataFrame:
    """Windows of lines of which each repeats the end of the one before."""
    step = max(1, size - int(size * overlap))
    lines = F.split("text", "\n")
    last = F.greatest(F.ceil((F.size(lines) - size) / step), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("ord"), (i * step + 1).alias("start_line"), F.least(i * step + size, F.size(lines)).alias("end_line"), F.array_join(F.slice(lines, i * step + 1, size), "\n").alias("body"),
    ))
    return docs.select("path", F.explode(windows).alias("w")).select("path", "w.*")


def evaluate(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: recall at k and mean reciprocal rank over all queries.
    ``ranked``: query_id, id, rank; ``relevant``: query_id, id."""
    hits = relevant.join(ranked, ["query_id", "id"]).select("query_id", "rank")
    return evaluate_counts(relevant.groupBy("query_id").agg(F.count("*").alias("wanted")), hits, k)


def evaluate_counts(queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The same from how many rows each query wants (query_id, wanted) and the
    ranks of those that it found (query_id, rank)."""
    per = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    per = queries.filter("wanted > 0").join(per, "query_id", "left")
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("found", F.lit(0)) / F.col("wanted")), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def prior(score: Column, *, age_days: Column | None = None, centrality: Column | None = None, is_test: Column | None = None, half_life: float = 90.0) -> Column:
    """Scores with multipliers for recency, centrality and tests."""
    if age_days is not None:
        score = score * (1 + 0.2 * F.exp(-age_days * (0.6931471805599453 / half_life)))
    if centrality is not None:
        score = score * (1 + 0.2 * centrality)
    return score if is_test is None else score * F.when(is_test, F.lit(0.7)).otherwise(F.lit(1.0))
