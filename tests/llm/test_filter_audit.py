import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quarryline.llm import filter_audit

FAILS = {
    "A": lambda t, w: len(w) < 50,
    "B": lambda t, w: 100 * len(set(w)) < 65 * len(w),
    "C": lambda t, w: 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
    "D": lambda t, w: any(c in "#$%&*|" for c in t),
}


def brute(docs, labels):
    """Every order applied to every document, one after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for doc, text, source in docs:
        t = text or ""
        w = [x.decode() for x in t.encode().split()]
        fails = {f for f, rule in FAILS.items() if rule(t, w)}
        if doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, doc in good, doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), 0]
        for f in "ABCDE":
            at = [(part, "".join(o), o.index(f) + 1) for o in permutations("ABCDE")]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k][6] = total
    return out


def corpus():
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcdefg") for _ in range(n))
    docs = []
    for i in range(160):
        n = draw.choice([3, 49, 50, 60, 120])
        few = [word(3) for _ in range(draw.choice([2, 30, 200]))]
        text = " ".join(draw.choice(few) for _ in range(n))
        text = text.upper() if draw.random() < 0.2 else text
        docs.append((i, text + draw.choice(["", "", " 100%", " #x"]), draw.choice(["web", "web", "web", "ç", None, ""])))
    docs += [(200 + i, docs[7][1], "web") for i in range(40)]  # a group of copies
    docs += [(300, None, "void"), (301, "", None), (None, docs[7][1], "web"), (None, "no id", "web"), (7, docs[7][1], "web"), (7, docs[7][1], "other")]
    docs += [(302, "Ünï çödé " * 40, "ç"), (303, "w" * 300_000 + " x" * 40_000, "long"), (304, "nbsp joined " * 60, "web")]
    labels = [(d, draw.choice([0, 1, None]), draw.choice([0, 1])) for d, _, _ in docs if d is not None and draw.random() < 0.6]
    return docs, [*labels, (5, 0, 0), (5, 1, 1), (None, 1, 1), (9999, 1, 1)]


def test_every_order_and_step(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, source string, mask string, n int, toxic int").repartition(5)
    marks = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = filter_audit.audit(frame, marks).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 600 * len({k[0] for k in want})
    for r in got:
        assert [r[c] for c in filter_audit.MEASURES] == want[r.part, r.filter_order, r.step], r


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    got = filter_audit.audit(one, labels).filter("filter_order = 'BADCE'").orderBy("step").collect()
    assert [(r.kept, r.removed) for r in got] == [(1, 0), (0, 1), (0, 0), (0, 0), (0, 0)]


def test_own_filters(spark):
    """Any filters: here two, one of them about copies."""
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    filters = {"x": lambda text, words: F.size(words) > 1, "y": filter_audit.COPY}
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.audit(docs, labels, filters=filters).collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 1, 3), ("xy", 2): (1, 0, 1, 0, 0, 1), ("yx", 1): (2, 1, 0, 0, 1, 1), ("yx", 2): (1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, filters={})
