"""Operator 4: URL filter on a trie of reversed host labels and path segments.

Rules are (verdict, host, path prefix).  The trie's first levels are host
labels from the right (``com``, ``example``, ...); a node where a rule's host
ends carries a second trie of path segments.  A rule fits its host and every
subdomain, if the url's path starts with the rule's path.  Of the rules that
fit, the one with the most host labels wins, then the longest path; of two
entries for the same host and path the block entry wins.  The trie is
broadcast; more than ``MAX_RULES`` rules are refused, which bounds it.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``,
``#`` or the end, with A-Z lower-cased; path is what follows up to ``?``, ``#``
or the end.  A null url, or one without ``://``, has both empty and no rule.
Without a rule the verdict is ``default``.  Very long urls are judged whole, at
a cost in proportion to their length, however many rules there are.  Repeated rows give repeated
results; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from bisect import insort
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000

Rule = tuple[str, str, str]


class _Node:
    __slots__ = ("next", "paths")

    def __init__(self):
        self.next: dict[str, _Node] = {}
        self.paths: _Path | None = None


class _Path:
    __slots__ = ("lengths", "next", "tails")

    def __init__(self):
        self.next: dict[str, _Path] = {}
        self.tails: dict[str, tuple[str, str]] = {}  # unfinished segment to (rule, verdict)
        self.lengths: list[int] = []  # of the tails, longest first


class Trie:
    """Rules by reversed host labels, then path segments."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host = lower_ascii(host)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.next.setdefault(label, _Node())
            node.paths = node.paths or _Path()
            at = node.paths
            *whole, tail = path.split("/")
            for segment in whole:
                at = at.next.setdefault(segment, _Path())
            if at.tails.get(tail, ("", "allow"))[1] == "allow":
                at.tails[tail] = (host + path, verdict)
            if len(tail) not in at.lengths:
                insort(at.lengths, len(tail), key=lambda n: -n)

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._path(node.paths, segments) or best
        return best

    @staticmethod
    def _path(at: _Path, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for n in at.lengths:
                found = at.tails.get(segment[:n]) if n <= len(segment) else None
                if found:
                    best = found
                    break
            at = at.next.get(segment)
            if at is None:
                break
        return best


_TRIES: dict[str, Trie] = {}


def _trie(key: str, rules) -> Trie:
    """The trie of a broadcast list of rules, made once in each worker process."""
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = Trie(rules.value)
    return _TRIES[key]


_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.translate(_LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the module states them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return lower_ascii(host), slash + path


def judge_urls(pages: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule`` (host and path
    of the rule that decided, else null) and ``verdict``."""
    rules = tuple(rules)
    Trie(rules)  # refuses bad rules before any task starts
    shared, key = pages.sparkSession.sparkContext.broadcast(rules), uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        judge = _trie(key, shared).judge
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [judge(h, p) or (None, default) for h, p in parts]
            cols = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
