"""Operator 13: vector bin packing of examples into training sequences.

Each example becomes token ids and an end id.  A sequence has three limits at
once: tokens, segments (pieces of examples in it) and loss-bearing tokens (those
behind an example's prompt).  Every task packs the rows it reads, so texts and
ids never move.  Pieces wait in a bounded pool; a sequence is filled from it by
the dot-product heuristic: of the pieces that fit, the one goes in whose demand
has the largest dot product with what the sequence has left, each dimension
weighed by how much the pool asks of it.  Where none fits, a piece is cut to
what is left.  So sequences are full; where a limit other than tokens, or the
end of a task's rows, leaves one short, it is cut back to a power of two, which
needs no padding either, and the rest goes on to the next.

Ids are those of the tokenizers library.  For a vocabulary whose pieces never
cross white space (``split_words``), texts are cut there and each distinct word
is encoded once a worker, in a bounded cache; each Arrow batch checks a whole
text against the library, and a difference raises.

Sequence numbers carry the partition in their upper bits: unique in one result,
equal when a task runs again.

Defined results: a null or empty text has only the end id.  Very long texts are
encoded in stretches and cut.  Repeated rows are examples of their own.  Ties
between pieces go to the one that waits first in the pool.  A prompt that is null or negative has
no tokens; one longer than its example bears no loss.  Strings of special
tokens in a text are ordinary text.  An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.sentencepiece_codec import pack_ids

#: Cached words in a worker; beyond it the cache starts afresh.
CACHE_ENTRIES = 1_000_000
#: Characters of a text that are cut into words at once.
STRETCH = 1 << 20
#: Pieces in a task's pool; above it sequences are made until half are left.
POOL = 4096
#: Tokens in a task's pool (16 MB of ids).
POOL_TOKENS = 1 << 22
#: Bytes of a tokenizer file that may be sent to the workers.
MAX_FILE = 64 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


class WordEncoder:
    """Ids of whole texts as packed little-endian integers."""

    def __init__(self, definition: str, split_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        self.split_words = split_words
        self.cache: dict[str, bytes] = {}
        upper, lower, stop = self.plain(["Ab Zy", "ab zy", "ab. zy."])
        self.lower = upper == lower
        size, suffix = self.library.get_vocab_size(), json.loads(definition)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(size, dtype=bool) if suffix else None
        for token, i in self.library.get_vocab().items() if suffix else ():
            self.ends[i] = token.endswith(suffix)
        word, dot = self.plain(["ab", "."])
        self.cut_signs = stop == word + dot + self.plain(["zy"])[0] + dot

    def plain(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.split_words or not texts:
            return self.plain(texts)
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            for blank in "\t\n\r":
                if blank in text:
                    text = text.replace(blank, " ")
            if size + len(text) > STRETCH:
                out += self._known(group)
                group, size = [], 0
            if len(text) > STRETCH:
                out.append(b"".join(self._known([part])[0] for part in _stretches(text)))
            else:
                group.append(text)
                size += len(text)
        return out + self._known(group)

    def check(self, text: str, ids: bytes) -> None:
        """The library's ids of a whole text, against ours."""
        if ids != self.plain([text])[0]:
            raise ValueError("this tokenizer's pieces cross white space: use split_words=False")

    def _apart(self, words: list[str]) -> list[bytes]:
        """Ids of single words.  Those of letters alone go through the library
        joined by spaces and are told apart by the tokens that end a word; any
        part whose ends do not match its words goes through one by one."""
        if self.ends is None:
            return self.plain(words)
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        found = dict(zip(rest, self.plain(rest), strict=True))
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            raw = self.plain([" ".join(part)])[0]
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 1)).tolist()
            if len(stops) == len(part) and stops[-1] == len(raw):
                found.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
            else:
                found.update(zip(part, self.plain(part), strict=True))
        return [found[w] for w in words]

    def _known(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, each distinct word being encoded once."""
        cache = self.cache
        split = [text.split(" ") for text in texts]
        words = set().union(*split)
        missing = words.difference(cache)
        if missing:
            if len(cache) + 2 * len(missing) > CACHE_ENTRIES:
                cache.clear()
                missing = words
            self._learn(missing)
        get = cache.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def _learn(self, words: set[str]) -> None:
        """Encode words, those that differ by case or a closing sign once, if
        the tokenizer is found to lower-case and to cut there."""
        cache, whole, cut = self.cache, {}, {}
        for w in words:
            key = w.lower() if self.lower and w.isascii() else w
            if self.cut_signs and key[-1:] in _SIGNS and "a" <= key[-2:-1] <= "z":
                cut[w] = key[:-1], key[-1]
            else:
                whole[w] = key
        new = list({*whole.values(), *(x for own in cut.values() for x in own)}.difference(cache))
        cache.update(zip(new, self._apart(new), strict=True))
        for w, key in whole.items():
            cache[w] = cache[key]
        for w, (stem, sign) in cut.items():
            cache[w] = cache[stem] + cache[sign]


#: Signs that end a word of letters, if the tokenizer cuts there.
_SIGNS = frozenset(".,;:!?")


def _stretches(text: str) -> Iterator[str]:
    """Parts of a text that end before a space."""
    at = 0
    while len(text) - at > STRETCH:
        cut = text.find(" ", at + STRETCH)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@dataclass(frozen=True)
class Example:
    row: object
    ids: bytes
    tokens: int
    prompt: int


@dataclass(frozen=True)
class Piece:
    example: Example
    start: int
    end: int

    def loss(self, n: int) -> int:
        """Loss-bearing tokens of its first ``n``."""
        return max(0, self.start + n - max(self.start, self.example.prompt))


class Packer:
    """A pool of pieces, and sequences made from it."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.pieces: list[Piece] = []
        self.demand = np.zeros((POOL + 64, 3), dtype=np.int64)
        self.total = np.zeros(3, dtype=np.int64)

    def _put(self, piece: Piece) -> None:
        n = len(self.pieces)
        if n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.pieces.append(piece)
        self.demand[n] = piece.end - piece.start, 1, piece.loss(piece.end - piece.start)
        self.total += self.demand[n]

    def _take(self, i: int) -> Piece:
        """Out of the pool; the last one takes its place."""
        piece, last = self.pieces[i], self.pieces.pop()
        self.total -= self.demand[i]
        if i < len(self.pieces):
            self.pieces[i] = last
            self.demand[i] = self.demand[len(self.pieces)]
        return piece

    def add(self, example: Example) -> Iterator[list[Piece]]:
        """Take an example in; gives the sequences that are ready."""
        start, limits = 0, self.limits
        while example.tokens - start >= limits.tokens:
            piece = Piece(example, start, start + limits.tokens)
            if piece.loss(limits.tokens) > limits.loss:
                break
            yield [piece]
            start += limits.tokens
        while start < example.tokens:  # in pieces that one sequence can hold
            end = min(example.tokens, start + limits.tokens, max(start, example.prompt) + limits.loss)
            self._put(Piece(example, start, end))
            start = end
        if len(self.pieces) > POOL or self.total[0] > POOL_TOKENS:
            while len(self.pieces) > POOL // 2 or self.total[0] > POOL_TOKENS // 2:
                yield self.sequence()

    def rest(self) -> Iterator[list[Piece]]:
        while self.pieces:
            yield self.sequence()

    def sequence(self) -> list[Piece]:
        """The next sequence: full, or of a power of two of tokens."""
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.int64)
        weight = self.total / max(1, len(self.pieces)) / self.capacity**3  # demand and rest as shares of the limit, weighed by mean demand
        out: list[Piece] = []
        while left[0] and left[1] and self.pieces:
            demand = self.demand[: len(self.pieces)]
            value = demand @ (weight * left)
            fits = (demand <= left).all(axis=1)
            if fits.any():
                piece = self._take(int(np.argmax(np.where(fits, value, -1.0))))
                n = piece.end - piece.start
            else:
                silent = demand[:, 0] - demand[:, 2]  # tokens before the loss begins
                most = np.minimum(np.minimum(demand[:, 0], left[0]), silent + left[2])
                if not most.any():
                    break
                i = int(np.argmax(np.where(most == most.max(), value, -1.0)))
                n, piece = int(most[i]), self._take(i)
                self._put(Piece(piece.example, piece.start + n, piece.end))
            out.append(Piece(piece.example, piece.start, piece.start + n))
            left -= (n, 1, piece.loss(n))
        return self._cut_back(out)

    def _cut_back(self, pieces: list[Piece]) -> list[Piece]:
        """Down to a power of two, unless full; the rest waits again."""
        n = sum(p.end - p.start for p in pieces)
        over = 0 if n == self.limits.tokens else n - (1 << n.bit_length() - 1)
        while over:
            last = pieces.pop()
            size = last.end - last.start
            gone = min(size, over)
            if gone < size:
                pieces.append(Piece(last.example, last.start, last.end - gone))
            self._put(Piece(last.example, last.end - gone, last.end))
            over -= gone
        return pieces


_ENCODERS: dict[str, WordEncoder] = {}


def pack(docs: DataFrame, tokenizer: str, *, limits: Limits = Limits(), end_id: int | None = 1, prompt_tokens: Column | None = None, split_words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: the id column, ``start`` (ids of the example
    before it), ``length``, ``ids`` (binary: little-endian unsigned 32-bit
    integers), ``loss_tokens``, ``doc_tokens`` (ids of the example, with the
    end id), ``sequence_id`` and ``offset`` (its place there, without gaps).

    ``tokenizer`` is a file of the tokenizers library, read on the driver and
    sent to the workers.  ``prompt_tokens`` says how many ids at the beginning
    of an example bear no loss (none, if not given).
    """
    with open(tokenizer, "rb") as f:
        definition = f.read(MAX_FILE + 1)
    if len(definition) > MAX_FILE:
        raise ValueError(f"a tokenizer file of more than {MAX_FILE} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(definition.decode())
    key = hashlib.sha256(definition).hexdigest() + str(split_words)
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        if key not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(shared.value, split_words)
        encoder, packer = _ENCODERS[key], Packer(limits)
        number = TaskContext.get().partitionId() << 40
        names = ["start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []
        held = 0

        def placed(sequence: list[Piece]) -> None:
            nonlocal number, held
            offset = 0
            for p in sequence:
                n = p.end - p.start
                out.append((p.example.row, p.start, n, p.example.ids[4 * p.start : 4 * p.end], p.loss(n), p.example.tokens, number, offset))
                offset += n
            number += 1
            held += 4 * offset

        def batch_of(rows: list[tuple], kind) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", *names])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            if split_words and batch.num_rows:
                text = batch.column(1)[0].as_py() or ""
                encoder.check(text, encoder.encode([text])[0])
            for at in range(0, batch.num_rows, 256):
                ids, texts, prompts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                for row, prompt, packed in zip(ids, prompts, encoder.encode([t or "" for t in texts]), strict=True):
                    packed += end
                    n = len(packed) // 4
                    for sequence in packer.add(Example(row, packed, n, min(max(prompt or 0, 0), n))):
                        placed(sequence)
                    if held > 1 << 22:
                        yield batch_of(out, kind)
                        out, held = [], 0
        for sequence in packer.rest():
            placed(sequence)
        if out:
            yield batch_of(out, kind)

    prompt = F.lit(0) if prompt_tokens is None else prompt_tokens
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), prompt.cast("long").alias("prompt"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
