"""Git output as tables.  The text comes from files or from a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: priority of jobs that follow a change of branch or commit.
BULK_PRIORITY = 10


def changes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, kind) of changed paths from ``--name-status`` or ``--porcelain``
    lines.  A rename deletes its old path and parses its new one."""
    line = F.col(column)
    tabbed = line.contains("\t")
    parts = F.when(tabbed, F.split(line, "\t")).otherwise(F.concat(F.array(F.substring(line, 1, 2)), F.split(F.substring(line, 4, 1 << 20), " -> ")))
    rows = lines.filter(F.trim(line) != "").select(F.trim(parts[0]).alias("code"), F.transform(F.slice(parts, 2, 2), lambda p: F.regexp_replace(p, '^"|"$', "")).alias("paths"))
    moved = (F.size("paths") == 2) & F.col("code").startswith("R")
    last = F.element_at("paths", -1)
    kind = F.when(F.col("code").contains("D") & ~moved, F.lit("delete")).otherwise(F.lit("parse"))
    jobs = F.when(moved, F.array(F.struct(F.col("paths")[0].alias("path"), F.lit("delete").alias("kind")), F.struct(last.alias("path"), F.lit("parse").alias("kind")))).otherwise(F.array(F.struct(last.alias("path"), kind.alias("kind"))))
    return rows.select(F.explode(jobs).alias("j")).select("j.*", F.lit(BULK_PRIORITY).alias("priority")).distinct()


def commits(log: DataFrame, column: str = "value") -> DataFrame:
    """(sha, author, ts, subject, body, pr_ref) from records with fields
    divided by the unit separator: sha, author, epoch seconds, subject, body."""
    parts = F.split(F.col(column), "\x1f")
    pr = F.regexp_extract(parts[3], r"#(\d+)", 1)
    return log.select(parts[0].alias("sha"), parts[1].alias("author"), (parts[2].cast("long") * 1000).alias("ts"), parts[3].alias("subject"), F.get(parts, 4).alias("body"), F.nullif(pr, F.lit("")).alias("pr_ref"))


def file_commits(numstat: DataFrame, sha: str = "sha", column: str = "value") -> DataFrame:
    """(path, sha, churn) from ``--numstat`` lines; binary files churn 0."""
    parts = F.split(F.col(column), "\t")
    count = lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("long"), F.lit(0))
    return numstat.filter(F.size(parts) == 3).select(parts[2].alias("path"), F.col(sha).alias("sha"), (count(parts[0]) + count(parts[1])).alias("churn"))
