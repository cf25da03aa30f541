"""What surrounds a search: what a query means, related code, levels of detail.

These follow the plan of the engine rather than its code, so names and numbers
that the plan leaves open are chosen here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import code_text as T
from quarryline.operators import graph, retrieval

# Intents by what a query says, the first that fits.
INTENTS = (
    ("impact", r"\bwhat breaks\b|\bwho (?:calls|uses)\b|\bwhat depends\b"),
    ("history", r"^\s*why\b|\bwhen did\b|\bwho changed\b"),
    ("explain", r"\bhow (?:does|do|is)\b|\bwhat (?:does|is)\b|\bexplain\b"),
    ("locate", r"\bwhere\b|\bfind\b|\blocate\b"),
)
#: How an intent shifts the weights of arms; none is ever taken out.
SHIFTS = {"locate": {"symbol": 1.5}, "explain": {"bm25": 1.3}, "impact": {"symbol": 1.5}, "history": {}, None: {}}
#: Share of a token budget that related code may take.
RELATED_SHARE = 0.4

_QUOTED = re.compile(r"`([^`]+)`|\"([^\"]+)\"|'([^']{3,})'")
_CODE = re.compile(r"[A-Za-z_$][\w$]*(?:\.[\w$]+)+|[A-Za-z$]*[a-z0-9][A-Z][\w$]*|[A-Za-z$]\w*_\w+")
_PATH = re.compile(r"[\w.@-]+(?:/[\w.@*-]+)+/?|[\w-]+\.(?:" + "|".join(e[1:] for e in T.EXTENSIONS) + r")\b")
_LITERAL = re.compile(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b")


@dataclass
class Understood:
    identifiers: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    literals: list[str] = field(default_factory=list)
    intent: str | None = None
    weights: dict[str, float] = field(default_factory=dict)


def understand(query: str) -> Understood:
    """Names, paths and literals that a query holds, its intent, and the weights
    of the arms that follow."""
    quoted = [next(filter(None, m)) for m in _QUOTED.findall(query)]
    paths = _PATH.findall(query)
    rest = _PATH.sub(" ", query)
    literals = [*quoted, *_LITERAL.findall(rest)]
    names = [x for x in _CODE.findall(rest) if x not in literals]
    intent = next((name for name, pattern in INTENTS if re.search(pattern, query, re.I)), None)
    weights = {arm: w * SHIFTS[intent].get(arm, 1.0) for arm, w in retrieval.ARM_WEIGHTS.items()}
    if names or literals:
        weights["symbol"] *= 1.2
    if literals:
        weights["trigram"] *= 1.5
    return Understood(list(dict.fromkeys(names + quoted)), list(dict.fromkeys(paths)), list(dict.fromkeys(literals)), intent, weights)


def supersede(edges: DataFrame, precise: DataFrame) -> DataFrame:
    """Edges in which a file's precise edges, where there are any, take the
    place of its heuristic ones."""
    known = precise.select("path").distinct()
    return edges.filter("precision <> 'precise'").join(known, "path", "left_anti").unionByName(precise.select(edges.columns))


def references(edges: DataFrame, name: str, relation: str = "callers") -> DataFrame:
    """Callers or callees of a name, each with its precision."""
    if relation not in ("callers", "callees"):
        raise ValueError(f"unknown relation {relation!r}")
    near, far = ("dst", "src") if relation == "callers" else ("src", "dst")
    return edges.filter((F.col("kind") == "calls") & (F.col(near) == name)).select("path", "line", F.col(far).alias("name"), "precision")


def related(index: dict[str, DataFrame], anchors: DataFrame, *, per_anchor: int = 10) -> DataFrame:
    """Code one hop from anchors (path, start_line, end_line, rank): what they
    call, who calls them, exported symbols beside them.

    One row for each place, with its first ``relation`` and the anchor's rank;
    places within an anchor are left out.  An anchor gives at most
    ``per_anchor`` rows of a relation, which is the feature: a name that
    everything calls is no context.
    """
    symbols = index["symbols"].select("path", "name", "start_line", "end_line", "exported")
    a = anchors.select(F.col("path").alias("a_path"), F.col("start_line").alias("a_start"), F.col("end_line").alias("a_end"), F.col("rank").alias("a_rank"))
    own = symbols.join(a, (F.col("path") == F.col("a_path")) & F.col("start_line").between(F.col("a_start"), F.col("a_end")))
    calls = index["edges"].filter("kind = 'calls'").select(F.col("path").alias("e_path"), "src", "dst", "line", "precision")

    out = calls.join(a, (F.col("e_path") == F.col("a_path")) & F.col("line").between(F.col("a_start"), F.col("a_end")))
    callees = symbols.join(out, F.col("name") == F.col("dst")).withColumns({"relation": F.lit("callee"), "at": F.lit(0)})
    into = calls.join(own.select("a_rank", F.col("name").alias("o_name")).distinct(), F.col("dst") == F.col("o_name"))
    callers = symbols.join(into, (F.col("path") == F.col("e_path")) & (F.col("name") == F.col("src"))).withColumns({"relation": F.lit("caller"), "at": F.lit(1)})
    beside = symbols.filter("exported").join(a, F.col("path") == F.col("a_path")).withColumns({"relation": F.lit("sibling"), "at": F.lit(2), "precision": F.lit("precise")})

    columns = ["path", "start_line", "end_line", F.col("name").alias("symbol"), "relation", "at", "a_rank", "precision"]
    rows = callees.select(*columns).unionByName(callers.select(*columns)).unionByName(beside.select(*columns)).distinct()
    inside = (F.col("path") == F.col("a_path")) & F.col("start_line").between(F.col("a_start"), F.col("a_end"))
    rows = rows.join(F.broadcast(a.drop("a_rank")), inside, "left_anti")  # anchors are the spans of one answer
    first = Window.partitionBy("path", "start_line", "end_line").orderBy("at", "a_rank", "symbol")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    turn = Window.partitionBy("a_rank", "relation").orderBy("path", "start_line")
    rows = rows.withColumn("_n", F.row_number().over(turn)).filter(F.col("_n") <= per_anchor)
    order = Window.orderBy("at", "a_rank", "path", "start_line")  # a bounded number of rows by now
    return rows.select("path", "start_line", "end_line", "symbol", "relation", F.col("a_rank").alias("from_rank"), "precision", F.row_number().over(order).alias("rank"))


def pack_related(anchors: DataFrame, more: DataFrame, max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and related spans (both with rank, path and text) packed into one
    budget: related ones get at most their share, anchors what is left."""
    extra = retrieval.pack(more, int(max_tokens * RELATED_SHARE))
    used = extra.first()
    return retrieval.pack(anchors, max_tokens - (used.tokens if used else 0)), extra


def skeletons(index: dict[str, DataFrame]) -> DataFrame:
    """Files with their bodies left out: (path, text) of imports, docs and
    signatures, each with how many lines it stands for."""
    imports = index["edges"].filter("kind = 'imports'").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("line", F.concat(F.lit("import "), "dst").alias("text")))).alias("head"))
    lines = F.col("end_line") - F.col("start_line")
    body = F.when(lines > 0, F.concat(F.lit(" { … "), lines.cast("string"), F.lit(" lines }"))).otherwise(F.lit(""))
    shown = F.concat_ws("\n", F.nullif("doc", F.lit("")), F.concat(F.coalesce("signature", "name"), body))
    own = index["symbols"].groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("line"), shown.alias("text")))).alias("rows"))
    rows = own.join(imports, F.col("path") == F.col("_path"), "full")
    none = F.array().cast("array<struct<line:int,text:string>>")
    text = F.array_join(F.transform(F.concat(F.coalesce("head", none), F.coalesce("rows", none)), lambda r: r["text"]), "\n")
    return rows.select(F.coalesce("path", "_path").alias("path"), text.alias("text"))


def history(commits: DataFrame, file_commits: DataFrame, path: str, *, limit: int = 20) -> dict[str, DataFrame]:
    """The latest commits of a file, and the files that change along with it."""
    own = file_commits.filter(F.col("path") == path).select("sha", "churn")
    shaped = commits.join(own, "sha").orderBy(F.desc("ts"), "sha").limit(limit)
    pairs = graph.co_changes(file_commits.select("sha", "path").join(own.select("sha"), "sha", "left_semi"))
    with_it = pairs.filter((F.col("path") == path) | (F.col("other") == path)).select(F.when(F.col("path") == path, F.col("other")).otherwise(F.col("path")).alias("path"), "commits")
    return {"commits": shaped, "with": with_it.orderBy(F.desc("commits"), "path").limit(limit)}


def visible(spans: DataFrame, readers: DataFrame, reader: str) -> DataFrame:
    """Spans of paths that a reader may see: ``readers`` (prefix, reader) opens
    paths at or below a prefix; paths below no prefix are open to all."""
    rules = readers.select(F.col("prefix").alias("_prefix"), F.col("reader").alias("_reader"))
    below = (F.col("path") == F.col("_prefix")) | F.col("path").startswith(F.concat("_prefix", F.lit("/")))
    # Prefixes of a path are few, so rules meet paths by equality and not by scanning.
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = spans.select("path").distinct().select("path", F.explode(prefixes).alias("_at"))
    ruled = paths.join(rules, F.col("_at") == F.col("_prefix")).filter(below)
    closed = ruled.groupBy("path").agg(F.bool_or(F.col("_reader") == reader).alias("_open")).filter(~F.col("_open"))
    return spans.join(closed.select("path"), "path", "left_anti")


def freshened(score: Column, *, modified: Column | None = None, now: int = 0, centrality: Column | None = None, path: Column | None = None, query: str = "") -> Column:
    """A span's score with its priors: recency, centrality, and a penalty on
    tests unless the query speaks of them."""
    from quarryline.operators.changefeed import age_days
    from quarryline.operators.prose import prior

    tests = None if path is None or re.search(r"\btests?\b", query, re.I) else path.rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.")
    return prior(score, age_days=None if modified is None else age_days(modified, now), centrality=centrality, is_test=tests)
