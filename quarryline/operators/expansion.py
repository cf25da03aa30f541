"""Expansion of many answers over the call graph, breadth first.

Each answer has anchors, which are nodes.  A round follows the links of all
answers' frontiers in one join: out to what a node calls, back to what calls it.
A score falls with each hop and again over a heuristic link.  Nodes with more
neighbours than ``hub`` are neither reached nor followed, since a name that
everything calls is no context; so no key of a join holds more than ``hub``
links, and what an answer can reach is bounded by it.  The nearest and best
nodes are taken until the expansion's share of the tokens is used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import stored

# The expansion's share of a token budget.
SHARE = 0.4
#: Factors of a score for each hop, and for a link that is a guess.
HOP, HEURISTIC = 0.5, 0.5
HUB = 40
RELATIONS = ("callee", "caller")


def links_of(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(near, far, weight, relation) between nodes that are no hubs, in both
    directions, from edges (src, dst, precision).  Of several links of a pair
    the precise one counts, and calling before being called."""
    ends = edges.filter("src is not null and dst is not null and src <> dst")
    weight = F.when(F.col("precision") == "precise", 1.0).otherwise(HEURISTIC)
    out = ends.select(F.col("src").alias("near"), F.col("dst").alias("far"), weight.alias("weight"), F.lit(0).alias("at"))
    back = ends.select(F.col("dst").alias("near"), F.col("src").alias("far"), weight.alias("weight"), F.lit(1).alias("at"))
    pairs = stored(out.unionByName(back).groupBy("near", "far").agg(F.max("weight").alias("weight"), F.min("at").alias("at")))
    small = pairs.groupBy(F.col("near").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") <= hub).select("node")
    kept = pairs.join(small, F.col("near") == F.col("node"), "left_semi").join(small, F.col("far") == F.col("node"), "left_semi")
    return kept.select("near", "far", "weight", F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("at") + 1).alias("relation"))


def expand_each(edges: DataFrame, anchors: DataFrame, *, hops: int = 1, hub: int = HUB, hold: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(answer_id, node, hop, relation, score) of what answers reach from their
    anchors (answer_id, node) in so many hops, anchors left out.  A node counts
    at its nearest hop with its best score there; relation is how it was
    reached, calling before being called."""
    links = hold(links_of(edges, hub))
    reached = hold(anchors.select("answer_id", "node").distinct())
    frontier, out = reached.withColumn("score", F.lit(1.0)), []
    for hop in range(1, hops + 1):
        steps = frontier.join(links, F.col("node") == F.col("near")).groupBy("answer_id", F.col("far").alias("node"))
        found = steps.agg(F.max(F.col("score") * F.col("weight") * HOP).alias("score"), F.min("relation").alias("relation"))
        found = hold(found.join(reached, ["answer_id", "node"], "left_anti"))
        out.append(found.select("answer_id", "node", F.lit(hop).alias("hop"), "relation", "score"))
        frontier = found.select("answer_id", "node", "score")
        reached = reached.unionByName(frontier.drop("score"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def within_budget(rows: DataFrame, costs: DataFrame, max_tokens: int, share: float = SHARE) -> DataFrame:
    """The nearest, best nodes of each answer (rank, tokens so far) while they
    fit into the expansion's share of ``max_tokens``; ``costs``: node, cost."""
    order = Window.partitionBy("answer_id").orderBy("hop", F.desc("score"), "node")
    rows = rows.join(costs.select("node", "cost"), "node")
    so_far = F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"tokens": so_far, "rank": F.row_number().over(order)})
    return rows.filter(F.col("tokens") <= int(max_tokens * share)).select("answer_id", "rank", "node", "hop", "relation", "score", "tokens")


def from_spans(index: dict[str, DataFrame], spans: DataFrame, answer: str = "answer_id") -> DataFrame:
    """Anchors (answer_id, node) of spans: the names of the symbols in them."""
    a = spans.select(F.col(answer).alias("answer_id"), F.col("path").alias("_path"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    s = index["symbols"].select("path", "name", "start_line")
    return s.join(a, (F.col("path") == F.col("_path")) & F.col("start_line").between(F.col("_a"), F.col("_b"))).select("answer_id", F.col("name").alias("node")).distinct()
