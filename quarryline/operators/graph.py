"""Graphs over imports, calls and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.code_text import EXTENSIONS
from quarryline.session import stored


def _resolved_path(path: Column, specifier: Column) -> Column:
    """A relative specifier against the directory of the importing file."""
    parts = F.concat(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.split(specifier, "/"))

    def step(acc: Column, p: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(p.isin("", "."), acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def import_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(source, target) file pairs: each relative specifier as it stands, with
    an extension, or as a directory's index file."""
    rows = edges.filter((F.col("kind") == "imports") & F.col("dst").startswith(".")).select(F.col("path").alias("source"), _resolved_path(F.col("path"), F.col("dst")).alias("base"))
    # Files are few beside the names that a specifier may mean: they give the names that lead to them.
    endings = F.filter(F.array(*map(F.lit, ("", *EXTENSIONS, *(f"/index{e}" for e in (".ts", ".tsx", ".js"))))), lambda e: F.col("target").endswith(e))
    named = files.select(F.col("path").alias("target")).select("target", F.explode(F.transform(endings, lambda e: F.left("target", F.length("target") - F.length(e)))).alias("base"))
    # Both sides grow with the code base, so neither is sent to the driver.
    return rows.join(named.hint("merge"), "base").filter("source <> target").select("source", "target")


def module_of(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def link_graph(pairs: DataFrame, nodes: DataFrame, *, depth: int | None = None, max_nodes: int = 250) -> dict[str, DataFrame]:
    """``nodes`` (id, weight), ``edges`` (source, target, weight) and
    ``isolated`` (id) of a graph given as (source, target) and (id, weight).

    With ``depth`` nodes are path prefixes of that many segments, weigh their
    members, and lose their inner edges.  The ``max_nodes`` heaviest connected
    nodes stay, ties by id.
    """
    if depth is not None:
        pairs = pairs.select(module_of(F.col("source"), depth).alias("source"), module_of(F.col("target"), depth).alias("target"))
        nodes = nodes.select(module_of(F.col("id"), depth).alias("id")).groupBy("id").agg(F.count("*").alias("weight"))
    links = pairs.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("weight"))
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    connected = nodes.join(ends, "id", "left_semi")
    shown = connected.orderBy(F.desc("weight"), "id").limit(max_nodes)
    names = shown.select("id")
    drawn = links.join(names.withColumnRenamed("id", "source"), "source", "left_semi").join(names.withColumnRenamed("id", "target"), "target", "left_semi")
    return {"nodes": shown, "edges": drawn.select("source", "target", "weight"), "isolated": nodes.join(ends, "id", "left_anti").select("id"), "connected": connected}


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter((F.col("kind") == "calls") & (F.col("dst") == name)).select("path", "line", F.col("src").alias("caller"))


def callees(edges: DataFrame, name: str) -> DataFrame:
    return edges.filter((F.col("kind") == "calls") & (F.col("src") == name)).select(F.col("dst").alias("callee")).distinct()


def degrees(links: DataFrame) -> DataFrame:
    """Degree of each node; a hub has more than six links."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).withColumn("hub", F.col("degree") > 6)


def file_detail(index: dict[str, DataFrame], files: DataFrame, path: str) -> DataFrame:
    """One row on a known file, none otherwise."""
    own = lambda t: t.filter(F.col("path") == path)
    symbols = own(index["symbols"]).agg(F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("line"), "kind", "name", "signature", "exported"))).alias("symbols"))
    chunks = own(index["file_chunks"]).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "content_hash"))).alias("chunks"))
    imports = own(index["edges"]).filter("kind = 'imports'").agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    by = import_edges(index["edges"], files).filter(F.col("target") == path).agg(F.array_sort(F.collect_set("source")).alias("imported_by"))
    out = own(files).select("path", *(c for c in ("lang", "parse_state") if c in files.columns))
    for part in (symbols, chunks, imports, by):  # one row each
        out = out.join(F.broadcast(part))
    return out


def pagerank(links: DataFrame, nodes: DataFrame, *, rounds: int = 10, damping: float = 0.85, cut=None) -> DataFrame:
    """Import centrality: (id, rank), ranks summing to one.  ``cut`` takes a
    frame and returns it with its lineage cut; by default the links and every
    fifth round are written to the shared folder."""
    cut = cut or stored
    n = nodes.count()
    out = links.groupBy("source").agg(F.sum("weight").alias("total"))
    share = cut(links.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    ids = nodes.select("id")
    ranks = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        sent = share.join(ranks, F.col("source") == F.col("id")).groupBy("target").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        held = ids.join(sent, F.col("id") == F.col("target"), "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))
        lost = F.broadcast(held.agg((1.0 - F.sum("got")).alias("lost")))  # one row: what nodes without links hold
        ranks = held.join(lost).select("id", ((1 - damping) / n + damping * (F.col("got") + F.col("lost") / n)).alias("rank"))
        if i % 5 == 4:
            ranks = cut(ranks)
    return ranks


def co_changes(file_commits: DataFrame, max_files: int = 50) -> DataFrame:
    """Pairs of files changed by the same commits.  Commits with more than
    ``max_files`` files say nothing about pairs; that is the measure's
    definition, as such a commit links everything to everything."""
    small = file_commits.groupBy("sha").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= max_files))
    rows = file_commits.join(small, "sha").select("sha", "path")
    pairs = rows.join(rows.withColumnRenamed("path", "other"), "sha").filter("path < other")
    return pairs.groupBy("path", "other").agg(F.count("*").alias("commits"))
