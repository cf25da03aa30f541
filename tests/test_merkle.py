import random

import pytest

from quarryline.operators import merkle


def tree_of(spark, files):
    return merkle.tree(spark.createDataFrame(sorted(files.items()), "path string, hash string").repartition(3))


def random_files(draw, n):
    names = ["a", "b", "c", "d e", "é"]
    out = {}
    while len(out) < n:
        path = "/".join(draw.choice(names) for _ in range(draw.randint(1, 5))) + f"/{draw.randint(0, 99)}"
        out[path] = str(draw.randint(0, 5 * n))
    return out


def brute(old, new):
    gone = [p for p in old if p not in new]
    come = [p for p in new if p not in old]
    by = lambda files, paths: {h: [p for p in paths if files[p] == h] for h in {files[p] for p in paths}}
    a, b = by(old, gone), by(new, come)
    moves = {b[h][0]: a[h][0] for h in a if len(a[h]) == 1 and len(b.get(h, ())) == 1}
    out = {(p, "moved", w) for p, w in moves.items()}
    out |= {(p, "changed", None) for p in old if p in new and old[p] != new[p]}
    out |= {(p, "added", None) for p in come if p not in moves}
    return out | {(p, "removed", None) for p in gone if p not in moves.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_states(spark, seed):
    draw = random.Random(seed)
    old = random_files(draw, 120)
    new = {p: h if draw.random() < 0.9 else h + "!" for p, h in old.items() if draw.random() < 0.9}
    for p in draw.sample(sorted(new), 8):  # moved, some of them into folders of their own
        new[f"z/{draw.randint(0, 3)}/{p}"] = new.pop(p)
    new |= random_files(draw, 10)
    found = merkle.compare(tree_of(spark, old), tree_of(spark, new))
    assert {tuple(r) for r in found.changes.collect()} == brute(old, new)


def test_equal_subtrees_are_never_expanded(spark):
    old = {f"{top}/{sub}/{i}": f"{top}{sub}{i}" for top in "abcd" for sub in "xyz" for i in range(5)}
    new = dict(old) | {"b/y/3": "other"}
    found = merkle.compare(tree_of(spark, old), tree_of(spark, new))
    assert {(r.path, r.depth) for r in found.expanded.collect()} == {("", 0), ("b", 1), ("b/y", 2)}
    assert [tuple(r) for r in found.changes.collect()] == [("b/y/3", "changed", None)]
    same = merkle.compare(tree_of(spark, old), tree_of(spark, old))
    assert same.changes.count() == 0 and same.expanded.count() == 0


def test_files_that_become_folders_and_empty_states(spark):
    old, new = {"a": "1", "b/c": "2"}, {"a/x": "3", "b": "4"}
    got = {tuple(r) for r in merkle.compare(tree_of(spark, old), tree_of(spark, new)).changes.collect()}
    assert got == {("a", "removed", None), ("a/x", "added", None), ("b/c", "removed", None), ("b", "added", None)}
    got = {tuple(r) for r in merkle.compare(tree_of(spark, {}), tree_of(spark, new)).changes.collect()}
    assert got == {("a/x", "added", None), ("b", "added", None)}


def test_stored_trees_are_read_by_level(spark, tmp_path):
    old = {f"{i % 5}/{i % 3}/{i}": str(i) for i in range(60)}
    new = dict(old) | {"2/1/7": "changed"}
    trees = []
    for name, files in (("old", old), ("new", new)):
        merkle.save(tree_of(spark, files), str(tmp_path / name))
        trees.append(spark.read.parquet(str(tmp_path / name)))
    found = merkle.compare(*trees)
    assert [tuple(r) for r in found.changes.collect()] == [("2/1/7", "changed", None)]
    jobs = merkle.jobs(found.changes).collect()
    assert [(j.path, j.kind, j.priority) for j in jobs] == [("2/1/7", "parse", 10)]
