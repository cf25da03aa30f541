"""Operator 6: substring deduplication with fixed-block anchors.

A window is ``window`` consecutive words of one document.  A word goes if a
window over it has a word sequence that also starts earlier (in a smaller
doc_id, or in the same document at an earlier word).

1. Anchors.  Every document gives the index its non-overlapping blocks of
   ``window // 2`` words, and probes it with every rolling window of that
   length.  Two equal windows always share such a hit: a window holds a whole
   block of its own document, and the other document's rolling window there
   is the same.  Index and probes meet by hash in owner tasks, packed as
   arrays of 32-bit fingerprints within hash ranges.
2. Extension.  A hit is extended to the windows around it, and these meet in
   the same way: only windows whose fingerprint comes twice go on.
3. Comparison.  The words themselves decide.  Windows that go on travel as
   stretches of text, to owners by the least block hash inside of them (so
   neighbours travel together and equal windows meet).  Of each class of equal
   word sequences the earliest window stays and the others are marked; runs of
   marked windows are the maximal exact repeats.  Hashes only propose: no
   collision of any of them can change a result.
4. Removal.  Marked windows go back to their documents.

Each step first combines within a bounded stretch of text (``CHUNK_BYTES``),
and a task remembers what it lately sent: a passage that a third of all
documents share travels once or twice for each task, and no step makes pairs.
Texts move by groups of documents (a hash of doc_id), groups and hash ranges
are made to hold about ``GROUP_BYTES`` of text each, and steps are cut by
tables in the shared folder.

Defined results: null and empty texts have no words and keep nothing (the
empty string).  A null doc_id is taken as the least one, -2**63.  Rows with the
same doc_id are one document: equal windows at equal places in them do not
remove each other, and a removal in one holds for all.  Texts shorter than a
window lose nothing.  Very long texts are read whole.  Extra columns are left
out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, mix64, partition_keys, partitions, slices, starts_of, text_bytes

#: Bytes of text that a task lays out at a time.
CHUNK_BYTES = 1_000_000
#: Bytes of text that a group of documents holds about.
GROUP_BYTES = 32 << 20
#: Stretches of text that a task remembers as sent.
REMEMBERED = 100_000
#: Rows of an Arrow batch that become Python objects at a time.
SLICE = 128
#: Marks or hits that an owner gathers before it passes them on.
FLUSH = 1 << 20
NULL_ID = -(1 << 63)

_PACKED = "g int, kind int, a binary, b binary, c binary"


class Powers:
    """Prefix hashes over bytes: powers of an odd base and a table of bytes."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(draw.integers(0, 1 << 62)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n + 1, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_POWERS: dict[int, Powers] = {}


class Layout:
    """The words of some texts in one buffer."""

    def __init__(self, texts: list[bytes]):
        buffer = b"\n".join([*(b" ".join(t.split()) for t in texts), b""])
        self.bytes = np.frombuffer(buffer, dtype=np.uint8)
        separators = np.flatnonzero((self.bytes == 32) | (self.bytes == 10))
        begins = np.concatenate([[0], separators[:-1] + 1]) if len(separators) else separators
        words = separators > begins
        doc = np.cumsum(np.concatenate([[0], self.bytes[separators[:-1]] == 10])) if len(separators) else separators
        self.begin, self.end, self.doc = begins[words], separators[words], doc[words].astype(np.int64)
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = starts_of(self.counts)  # of each document, in words

    def windows(self, size: int) -> np.ndarray:
        """Indexes of the words where a window of ``size`` words starts."""
        n = len(self.doc)
        if n < size:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])

    def text(self, first: int, last: int) -> bytes:
        """Words first to last of one document, with one space between them."""
        return self.bytes[self.begin[first] : self.end[last]].tobytes()

    def hashes(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        powers = _POWERS.setdefault(seed, Powers(seed))
        powers.reach(len(self.bytes))
        sums = np.zeros(len(self.bytes) + 1, dtype=np.uint64)
        np.cumsum(powers.table[self.bytes] * powers.up[: len(self.bytes)], out=sums[1:], dtype=np.uint64)
        begin = self.begin[at]
        return mix64((sums[self.end[at + size - 1]] - sums[begin]) * powers.down[begin])


def _part(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The key of the hash range that each hash lies in."""
    return keys[((h >> np.uint64(32)) * np.uint64(len(keys)) >> np.uint64(32)).astype(np.int64)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal sorted keys start."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _group_of(docs: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The key at Spark's ``pmod(xxhash64(doc_id), number of keys)``."""
    from xxhash import xxh64_intdigest

    h = np.array([xxh64_intdigest(d.tobytes(), 42) for d in docs], dtype=np.uint64)
    return groups[h.astype(np.int64) % len(groups)]


def _places(docs: np.ndarray, pos: np.ndarray, groups: np.ndarray) -> Iterator[tuple]:
    """Places (document, word) as packed rows by group of documents."""
    if not len(docs):
        return
    order = np.lexsort((pos, docs))
    docs, pos = docs[order].astype(np.int64), pos[order].astype(np.int32)
    at = _groups(docs)
    ends = np.append(at[1:], len(docs))
    group = _group_of(docs[at], groups)
    by = np.argsort(group, kind="stable")
    cuts = np.append(_groups(group[by]), len(by))
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = by[a:b]
        words = np.concatenate([pos[at[i] : ends[i]] for i in own])
        yield int(group[own[0]]), docs[at[own]].tobytes(), (ends[own] - at[own]).astype(np.int32).tobytes(), words.tobytes()


def _unplace(a: bytes, b: bytes, c: bytes) -> Iterator[tuple[int, np.ndarray]]:
    counts = np.frombuffer(b, dtype=np.int32)
    cuts = starts_of(counts)
    pos = np.frombuffer(c, dtype=np.int32)
    for doc, x, y in zip(np.frombuffer(a, dtype=np.int64).tolist(), cuts, cuts[1:], strict=False):
        yield doc, pos[x:y]


class _Out:
    """Packed rows as Arrow batches of bounded size."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, g, kind, a, b, c):
        self.rows.append((g, kind, a, b, c))
        self.size += len(a) + len(b) + len(c)

    def full(self) -> bool:
        return self.size > 8 << 20

    def take(self):
        import pyarrow as pa

        cols = list(zip(*self.rows, strict=True))
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["g", "kind", "a", "b", "c"])


def _table(docs: list[int], layout: Layout) -> bytes:
    return np.array(docs, dtype=np.int64).tobytes() + layout.first[:-1].astype(np.int32).tobytes()


def _resolve(table: bytes, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(table) // 12
    docs, first = np.frombuffer(table[: 8 * n], dtype=np.int64), np.frombuffer(table[8 * n :], dtype=np.int32)
    at = np.searchsorted(first, index, side="right") - 1
    return docs[at], (index - first[at]).astype(np.int32)


def _chunks(batches: Iterator, chunk: int) -> Iterator[tuple[list[int], list[bytes]]]:
    docs: list[int] = []
    texts: list[bytes] = []
    size = 0
    for batch in slices(batches, SLICE):
        for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size > chunk:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


# Steps 1 and 2: fingerprints


class _Recent:
    """Hashes that a task has lately sent twice.  Windows with them are hits
    already, so they need not be sent again; those whose owner may not know of
    an anchor yet are sent all the same."""

    def __init__(self, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.hash, self.state = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint8)

    def known(self, h: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        slot = (h >> self.shift).astype(np.int64)
        state = np.where(self.hash[slot] == h, self.state[slot], 0)
        times, anchored = state & 3, state & 4
        self.hash[slot], self.state[slot] = h, np.minimum(times + 1, 2) | anchored | anchor.astype(np.uint8) << 2
        return (times == 2) & (~anchor | (anchored > 0))


def _send(docs: list[int], layout: Layout, at: np.ndarray, size: int, indexed: np.ndarray, parts: np.ndarray, groups: np.ndarray, recent: _Recent, out: _Out) -> None:
    """Fingerprints of windows to the owners of hash ranges, with a flag on
    anchors; what repeats within this stretch or was sent twice is a hit."""
    h = layout.hashes(at, size, 1)
    order = np.argsort(h, kind="stable")
    starts = _groups(h[order])
    counts = np.diff(np.append(starts, len(order)))
    anchor = np.logical_or.reduceat(indexed[order], starts)
    first = order[starts]
    known = recent.known(h[first], anchor)
    shared = (counts > 1) | known
    hits = at[order[np.repeat(shared, counts)]]
    ids = np.array(docs, dtype=np.int64)
    for g, a, b, c in _places(ids[layout.doc[hits]], hits - layout.first[layout.doc[hits]], groups):
        out.add(-1 - g, 0, a, b, c)
    first, anchor, shared = first[~known], anchor[~known], shared[~known]
    part, index = _part(h[first], parts), at[first]
    by = np.lexsort((index, part))
    part, index, first = part[by], index[by], first[by]
    flags = anchor[by].astype(np.int64) * 2 + ~shared[by]
    prints = (h[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    table = _table(docs, layout)
    cuts = np.append(_groups(part), len(part))
    for a, b in zip(cuts, cuts[1:], strict=False):
        gaps = np.diff(index[a:b], prepend=0) << 2 | flags[a:b]
        gaps = gaps.astype(np.uint16 if gaps.max() < 65_536 else np.uint32)
        out.add(int(part[a]), gaps.itemsize, prints[a:b].tobytes(), gaps.tobytes(), table)


def _probe(block: int, parts: np.ndarray, groups: np.ndarray, chunk: int):
    """All rolling windows of a block's length; blocks of the index are anchors."""

    def run(batches: Iterator) -> Iterator:
        out, recent = _Out(), _Recent()
        for docs, texts in _chunks(batches, chunk):
            layout = Layout(texts)
            at = layout.windows(block)
            if not len(at):
                continue
            _send(docs, layout, at, block, (at - layout.first[layout.doc[at]]) % block == 0, parts, groups, recent, out)
            if out.full():
                yield out.take()
        if out.rows:
            yield out.take()

    return run


def _by_part(batches: Iterator) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each part (they come sorted by part); passed-on rows one by one."""
    part, held = None, []
    for batch in slices(batches, SLICE):
        for g, kind, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if g < 0:
                yield -1 - g, [(0, a, b, c)]
                continue
            if g != part:
                if held:
                    yield part, held
                part, held = g, []
            held.append((kind, a, b, c))
    if held:
        yield part, held


class _Gather:
    """Places found by an owner, passed on in packed rows."""

    def __init__(self, groups: np.ndarray):
        self.groups, self.docs, self.pos, self.n, self.out = groups, [], [], 0, _Out()

    def add(self, docs, pos):
        self.docs.append(docs)
        self.pos.append(pos)
        self.n += len(docs)

    def take(self, last: bool = False) -> Iterator:
        if self.n and (last or self.n > FLUSH):
            for g, a, b, c in _places(np.concatenate(self.docs), np.concatenate(self.pos), self.groups):
                self.out.add(g, 0, a, b, c)
            self.docs, self.pos, self.n = [], [], 0
        if self.out.rows and (last or self.out.full()):
            yield self.out.take()


def _match(groups: np.ndarray):
    """Owner of hash ranges: which windows meet an index block elsewhere."""

    def run(batches: Iterator) -> Iterator:
        found = _Gather(groups)
        for part, rows in _by_part(batches):
            if rows[0][0] == 0:
                found.out.add(part, 0, *rows[0][1:])
            else:
                prints = np.concatenate([np.frombuffer(a, dtype=np.uint32) for _, a, _, _ in rows])
                codes = [np.frombuffer(b, dtype=np.uint16 if kind == 2 else np.uint32).astype(np.int64) for kind, _, b, _ in rows]
                cuts = starts_of(np.array([len(x) for x in codes]))
                flags = np.concatenate(codes) & 3
                order = np.argsort(prints, kind="stable")
                starts = _groups(prints[order])
                counts = np.diff(np.append(starts, len(order)))
                hit = (counts > 1) & np.logical_or.reduceat(flags[order] > 1, starts)
                wanted = np.zeros(len(prints), dtype=bool)
                wanted[order] = np.repeat(hit, counts)
                wanted &= flags & 1 == 1
                for (_, _, _, table), code, a, b in zip(rows, codes, cuts, cuts[1:], strict=False):
                    own = wanted[a:b]
                    if own.any():
                        found.add(*_resolve(table, np.cumsum(code >> 2)[own]))
            yield from found.take()
        yield from found.take(last=True)

    return run


# Steps 2 to 4: places meet their texts


def _with_texts(batches: Iterator) -> Iterator[tuple[int, int, bytes, bool, list[np.ndarray]]]:
    """Group, id, text, whether the id is null, and the places that came for a
    document.  Rows come sorted by group of documents, places first."""
    group, places = None, {}
    for batch in slices(batches, SLICE):
        for g, kind, doc, text, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if g != group:
                group, places = g, {}
            if kind == 0:
                for d, pos in _unplace(a, b, c):
                    places.setdefault(d, []).append(pos)
            else:
                yield g, doc, text, kind == 2, places.get(doc, [])


def _stretches(batches: Iterator, chunk: int) -> Iterator[tuple[int, list[int], Layout, np.ndarray]]:
    """Documents with places, some at a time: group, ids, layout, and a mark on
    each word where a place is."""

    def laid():
        docs = [d for d, _, _ in held]
        layout = Layout([t for _, t, _ in held])
        mark = np.zeros(len(layout.doc), dtype=bool)
        for i, (_, _, places) in enumerate(held):
            for pos in places:
                mark[layout.first[i] + pos[pos < layout.counts[i]]] = True
        return group, docs, layout, mark

    group, held, size = None, [], 0
    for g, doc, text, _, places in _with_texts(batches):
        if held and (g != group or size > chunk):
            yield laid()
            held, size = [], 0
        group = g
        if places:
            held.append((doc, text, places))
            size += len(text)
    if held:
        yield laid()


def _extend(window: int, block: int, parts: np.ndarray, groups: np.ndarray, chunk: int):
    """Windows around hits; each is an anchor, so any two that agree are hits."""

    def run(batches: Iterator) -> Iterator:
        out, recent = _Out(), _Recent()
        for _, docs, layout, mark in _stretches(batches, chunk):
            sums = starts_of(mark)
            at = layout.windows(window)
            at = at[sums[at + window - block + 1] > sums[at]]
            if len(at):
                _send(docs, layout, at, window, np.ones(len(at), dtype=bool), parts, groups, recent, out)
            if out.full():
                yield out.take()
        if out.rows:
            yield out.take()

    return run


# Step 3: comparison


def equal_before(layout: Layout, at: np.ndarray, size: int) -> np.ndarray:
    """For each window (of words ``at``) the first of them with the same words.

    Windows meet by hash; then their bytes are compared, in runs of neighbours
    whose counterparts are neighbours too.  Where a hash lied, its class is
    told apart by the bytes themselves.
    """
    h = layout.hashes(at, size, 2)
    order = np.argsort(h, kind="stable")
    starts = _groups(h[order])
    same = np.arange(len(at))
    same[order] = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    later = np.flatnonzero(same != np.arange(len(at)))
    if not len(later):
        return same
    a, b = at[later], at[same[later]]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])), len(a))
    liars = set()
    for x, y in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist(), strict=True):
        if layout.text(a[x], a[y] + size - 1) != layout.text(b[x], b[y] + size - 1):
            liars.update(same[later[x : y + 1]].tolist())
    if liars:
        told: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(same, list(liars))).tolist():
            same[i] = told.setdefault(layout.text(at[i], at[i] + size - 1), i)
    return same


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _compare_near(window: int, block: int, parts: np.ndarray, groups: np.ndarray, chunk: int):
    """Windows that met their like: mark repeats within a stretch and within
    the task, send the others' text to the owners."""

    def run(batches: Iterator) -> Iterator:
        out, sent, group = _Out(), {}, None
        for g, docs, layout, mark in _stretches(batches, chunk):
            if g != group:  # documents come in order within a group
                group, sent = g, {}
            at = layout.windows(window)
            at = at[mark[at]]
            if not len(at):
                continue
            ids = np.array(docs, dtype=np.int64)
            doc, pos = ids[layout.doc[at]], at - layout.first[layout.doc[at]]
            if len(set(docs)) < len(docs):
                by = np.lexsort((pos, doc))
                at, doc, pos = at[by], doc[by], pos[by]
            same = equal_before(layout, at, window)
            later = (doc != doc[same]) | (pos != pos[same])
            gone_doc, gone_pos = [doc[later]], [pos[later]]
            own = np.flatnonzero(same == np.arange(len(at)))
            at, doc, pos = at[own], doc[own], pos[own]

            every = np.full(len(layout.doc) + window, np.iinfo(np.uint64).max, dtype=np.uint64)
            blocks = layout.windows(block)
            every[blocks] = layout.hashes(blocks, block, 1)
            least = _least(every, window - block + 1)[at]
            new = np.concatenate([[True], (np.diff(at) != 1) | (least[1:] != least[:-1])])
            cuts = np.append(np.flatnonzero(new), len(at))
            part = _part(mix64(least[cuts[:-1]]), parts)
            table = _table(docs, layout)
            rows: dict[int, tuple[list, list]] = {}
            for x, y, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), part.tolist(), strict=True):
                text = layout.text(at[x], at[y - 1] + window - 1)
                place = (int(doc[x]), int(pos[x]))
                before = sent.get(text)
                if before is not None and before < place:
                    gone_doc.append(doc[x:y])
                    gone_pos.append(pos[x:y])
                    continue
                if before is None:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent[text] = place
                entries, texts = rows.setdefault(to, ([], []))
                entries.append((int(at[x]), y - x, int(least[x])))
                texts.append(text)
            for to, (entries, texts) in rows.items():
                first, count, key = zip(*entries, strict=True)
                packed = np.array(key, dtype=np.uint64).tobytes() + np.array(first, dtype=np.uint32).tobytes() + np.array(count, dtype=np.uint32).tobytes()
                out.add(to, 1, packed, b"\n".join(texts), table)
            for place in _places(np.concatenate(gone_doc), np.concatenate(gone_pos), groups):
                out.add(-1 - place[0], 0, *place[1:])
            if out.full():
                yield out.take()
        if out.rows:
            yield out.take()

    return run


def _compare_far(window: int, groups: np.ndarray, chunk: int):
    """Owner of hash ranges: all but the earliest of equal windows.  Equal
    stretches are one from the start; the others are laid out some at a time,
    those with one least block hash together."""

    def distinct(rows, found):
        held: dict[bytes, tuple[int, int, int]] = {}
        gone = []
        for _, a, b, table in rows:
            n = len(a) // 16
            keys, index, counts = np.frombuffer(a, np.uint64, n), np.frombuffer(a, np.uint32, n, 8 * n), np.frombuffer(a, np.uint32, n, 12 * n)
            docs, pos = _resolve(table, index.astype(np.int64))
            for text, doc, p, count, key in zip(b.split(b"\n"), docs.tolist(), pos.tolist(), counts.tolist(), keys.tolist(), strict=True):
                old = held.get(text)
                if old is None or (doc, p) < old[1:]:
                    held[text] = (key, doc, p)
                    if old is None:
                        continue
                    doc, p = old[1:]  # noqa: PLW2901
                if (doc, p) != held[text][1:]:
                    gone.append((doc, p, count))
        if gone:
            doc, p, count = (np.array(x, dtype=np.int64) for x in zip(*gone, strict=True))
            found.add(np.repeat(doc, count), np.repeat(p, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        return sorted((*place, text) for text, place in held.items())

    def compared(stretches, found):
        stretches.sort(key=lambda x: x[1:3])
        layout = Layout([x[3] for x in stretches])
        at = layout.windows(window)
        doc = np.array([x[1] for x in stretches], dtype=np.int64)[layout.doc[at]]
        pos = np.array([x[2] for x in stretches], dtype=np.int64)[layout.doc[at]] + at - layout.first[layout.doc[at]]
        by = np.lexsort((pos, doc))
        at, doc, pos = at[by], doc[by], pos[by]
        same = equal_before(layout, at, window)
        later = (doc != doc[same]) | (pos != pos[same])
        if later.any():
            found.add(doc[later], pos[later])

    def run(batches: Iterator) -> Iterator:
        found = _Gather(groups)
        for part, rows in _by_part(batches):
            if rows[0][0] == 0:
                found.out.add(part, 0, *rows[0][1:])
            else:
                own, size = [], 0
                for stretch in distinct(rows, found):
                    if size > chunk and stretch[0] != own[-1][0]:
                        compared(own, found)
                        own, size = [], 0
                        yield from found.take()
                    own.append(stretch)
                    size += len(stretch[3])
                compared(own, found)
            yield from found.take()
        yield from found.take(last=True)

    return run


# Step 4: removal


def _remove(window: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            arrays[3] = arrays[3].cast(pa.string())
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept", "removed"])

        rows, size = [], 0
        for _, doc, text, unnamed, places in _with_texts(batches):
            words = text.split()
            n, spans, kept = len(words), [], words
            if places:
                edge = np.zeros(n + window + 1, dtype=np.int64)
                pos = np.unique(np.concatenate(places))
                pos = pos[pos < n]
                edge[pos] += 1
                edge[pos + window] -= 1
                gone = np.cumsum(edge)[:n] > 0
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = turns.tolist()
            joined = b" ".join(kept)
            rows.append((None if unnamed else doc, n, n - len(kept), joined, spans))
            size += len(joined) + 100
            if size > 4 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_removed``, ``kept`` (the
    words that stay, joined by one space) and ``removed`` (the maximal removed
    spans as word offsets: begin, end, begin, end, ...)."""
    if window < 2:
        raise ValueError("a window has at least two words")
    spark = docs.sparkSession
    block = window // 2
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.when(F.col(id_col).isNull(), 2).otherwise(1).alias("kind"), text.cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // GROUP_BYTES))
    parts, groups = partition_keys(n, 2), partition_keys(n)
    keys = F.split(F.lit(",".join(map(str, groups))), ",").cast("array<int>")
    texts = rows.select(F.get(keys, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).alias("g"), "kind", "doc_id", "text", *(F.lit(None).cast("binary").alias(x) for x in "abc"))

    def meet(places: DataFrame) -> DataFrame:
        places = places.select("g", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "a", "b", "c")
        return places.unionByName(texts).repartition(n, "g").sortWithinPartitions("g", F.col("kind") > 0, "doc_id")

    def owned(packed: DataFrame) -> DataFrame:
        return packed.repartition(n, "g").sortWithinPartitions("g")

    probes = rows.select("doc_id", "text").mapInArrow(_probe(block, parts, groups, chunk_bytes), _PACKED)
    hits = materialise(owned(probes).mapInArrow(_match(groups), _PACKED), "substring-hits")
    windows = meet(hits).mapInArrow(_extend(window, block, parts, groups, chunk_bytes), _PACKED)
    met = materialise(owned(windows).mapInArrow(_match(groups), _PACKED), "substring-met")
    stretches = meet(met).mapInArrow(_compare_near(window, block, parts, groups, chunk_bytes), _PACKED)
    marks = materialise(owned(stretches).mapInArrow(_compare_far(window, groups, chunk_bytes), _PACKED), "substring-marks")
    out = meet(marks).mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string, removed array<int>")
    return out.withColumnRenamed("doc_id", id_col)
