import random

import pytest

from quarryline.operators import expansion


def brute(edges, anchors, hops, hub):
    pairs = {}
    for src, dst, precision in edges:
        if src is None or dst is None or src == dst:
            continue
        w = 1.0 if precision == "precise" else 0.5
        for near, far, relation in ((src, dst, "callee"), (dst, src, "caller")):
            old = pairs.get((near, far), (0, "x"))
            pairs[near, far] = max(old[0], w), min(old[1], relation)
    degree = {}
    for near, _ in pairs:
        degree[near] = degree.get(near, 0) + 1
    out = {}
    for answer in {a for a, _ in anchors}:
        seen = {n for a, n in anchors if a == answer}
        frontier = dict.fromkeys(seen, 1.0)
        for hop in range(1, hops + 1):
            found = {}
            for (near, far), (w, relation) in pairs.items():
                if near in frontier and degree[near] <= hub and degree[far] <= hub and far not in seen:
                    old = found.get(far, (0, "x"))
                    found[far] = max(old[0], frontier[near] * w * 0.5), min(old[1], relation)
            for node, (score, relation) in found.items():
                out[answer, node] = (hop, relation, score)
            seen |= set(found)
            frontier = {n: s for n, (s, _) in found.items()}
    return out


@pytest.mark.parametrize(("hops", "hub"), [(1, 40), (2, 6), (3, 4)])
def test_random_graphs(spark, hops, hub):
    draw = random.Random(hops)
    edges = [(f"n{draw.randint(0, 60)}", f"n{draw.randint(0, 60)}", draw.choice(["precise", "heuristic", None])) for _ in range(110)] + [(f"n{i}", "log", "precise") for i in range(50)] + [(None, "n1", "precise"), ("n2", None, None)]
    anchors = [(a, f"n{draw.randint(0, 60)}") for a in range(8) for _ in range(2)] + [(99, "log"), (98, "unknown")]
    frame = spark.createDataFrame(edges, "src string, dst string, precision string").repartition(3)
    got = expansion.expand_each(frame, spark.createDataFrame(anchors, "answer_id long, node string"), hops=hops, hub=hub).collect()
    assert {(r.answer_id, r.node): (r.hop, r.relation, r.score) for r in got} == brute(edges, anchors, hops, hub)
    assert len(got) > 10  # the comparison holds something


def test_budget_is_the_share_of_the_tokens(spark):
    rows = spark.createDataFrame([(1, n, hop, "callee", s) for n, hop, s in [("a", 1, 0.5), ("b", 1, 0.25), ("c", 2, 0.9), ("d", 2, 0.1)]], "answer_id long, node string, hop int, relation string, score double")
    costs = spark.createDataFrame([("a", 30), ("b", 5), ("c", 5), ("d", 1)], "node string, cost int")
    got = expansion.within_budget(rows, costs, 100).orderBy("rank").collect()
    assert [(r.node, r.tokens) for r in got] == [("a", 30), ("b", 35), ("c", 40)]
    assert expansion.within_budget(rows, costs, 10).count() == 0


def test_anchors_are_the_symbols_of_spans(spark):
    symbols = spark.createDataFrame([("x.ts", "f", 3), ("x.ts", "g", 9), ("y.ts", "f", 4)], "path string, name string, start_line int")
    spans = spark.createDataFrame([(7, "x.ts", 1, 5), (7, "x.ts", 2, 4), (8, "z.ts", 1, 5)], "answer_id long, path string, start_line int, end_line int")
    assert [tuple(r) for r in expansion.from_spans({"symbols": symbols}, spans).collect()] == [(7, "f")]
