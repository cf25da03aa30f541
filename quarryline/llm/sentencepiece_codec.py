"""Operator 1: SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda (a heap) of adjacent symbol pairs ordered by
score, then by position.  It takes the best pair, merges it if both symbols
still stand, and puts the new neighbours on the agenda.  Symbols that are in
no vocabulary entry fall back to byte pieces.

No vocabulary entry holds the space mark after another character, so no merge
crosses from a word into the space before the next one.  Texts are therefore
cut there, and each distinct piece of text goes through the agenda once per
worker; a bounded cache keeps its ids.  Each Arrow batch checks every piece
that is new to the cache, and one whole document, against the sentencepiece
library; a difference raises.  (That cutting never changes the ids follows from
the vocabulary, and a property test holds it against the library.)  Vocabularies that allow merges across words
are encoded as whole texts.

Defined results: a null or empty text has no pieces, only the begin and end
ids where asked for, and decodes to the empty string.  Repeated rows give
repeated results.  Very long texts are encoded whole.  Extra columns are left
out of the result.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Cached pieces of text in a worker; beyond it the cache starts afresh.
CACHE_ENTRIES = 600_000
#: Symbols up to which the agenda is a plain list.
SHORT = 40


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


class PieceEncoder:
    """Agenda encoder over the vocabulary of a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {sp.id_to_piece(i): i for i in range(size) if i not in special}
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused entries are not supported")
        order = sorted(self.ids, key=lambda p: -sp.get_score(self.ids[p]))
        # Entries of equal score share a rank: then the leftmost pair comes first.
        self.rank: dict[str, int] = {}
        last, rank = None, -1
        for p in order:
            score = sp.get_score(self.ids[p])
            rank, last = (rank, last) if score == last else (rank + 1, score)
            self.rank[p] = rank
        self.none = rank + 1
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = all(sp.is_byte(i) for i in self.bytes)
        self.unknown = sp.unk_id()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        if sp.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only the identity normaliser with a dummy prefix is supported")
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        breaks = any("\n" in p for p in self.ids)
        self.whole = inner or breaks or not self.byte_fallback
        self.cut = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall

    def short_agenda(self, text: str) -> list[int]:
        """``agenda`` for few symbols: its entries stand in a list by position,
        where the first of the best ranks is the best score's leftmost pair."""
        symbols = list(text)
        rank, none = self.rank.get, self.none
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        best = min(ranks, default=none)
        while best != none:
            i = ranks.index(best)
            symbols[i] = merged = symbols[i] + symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + merged, none)
            if i < len(ranks):
                ranks[i] = rank(merged + symbols[i + 1], none)
            best = min(ranks, default=none)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return self.to_ids(symbols)

    def agenda(self, text: str) -> list[int]:
        """Ids of normalised text by the agenda."""
        if len(text) <= SHORT:
            return self.short_agenda(text)
        symbols: list[str | None] = list(text)
        n = len(symbols)
        rank = self.rank.get
        heap = []
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append(r << 64 | i << 32 | 2)
        if heap:
            # An entry is one integer: rank, position, length of the merged pair.
            heapq.heapify(heap)
            pop, push = heapq.heappop, heapq.heappush
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                entry = pop(heap)
                i = entry >> 32 & 0xFFFFFFFF
                left, j = symbols[i], after[i]
                if left is None or j >= n:
                    continue
                merged = left + symbols[j]
                length = len(merged)
                if length != entry & 0xFFFFFFFF:
                    continue
                symbols[i], symbols[j] = merged, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank(merged + symbols[k])
                    if r is not None:
                        push(heap, r << 64 | i << 32 | length + len(symbols[k]))
                h = before[i]
                if h >= 0:
                    r = rank(symbols[h] + merged)
                    if r is not None:
                        push(heap, r << 64 | h << 32 | length + len(symbols[h]))
        return self.to_ids([s for s in symbols if s is not None])

    def to_ids(self, symbols: list[str]) -> list[int]:
        """Ids of merged symbols; unknown ones fall back to bytes."""
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in s.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def pieces(self, text: str) -> list[str]:
        """Cut a text where no merge can cross; joined, the pieces are the
        normalised text."""
        text = self.normalise(text)
        if SPACE + SPACE in text or SPACE + "\n" in text or text.endswith(SPACE):
            return self.cut(text)
        # Each space mark now opens a word, so plain splitting does the same.
        out: list[str] = []
        for line in text.split("\n"):
            words = line.replace(SPACE, " " + SPACE).split(" ")
            out += words if words[0] else words[1:]
            out.append("\n")
        out.pop()
        return out

    def check(self, pieces: list[str], ids: list[list[int]]) -> None:
        """Compare pieces of text with the library, many in one call: a line
        break stands alone in every text, so joined by it they stay apart."""
        mine, line = [self.ids[SPACE]], self.bytes[10]
        for x in ids:
            mine.append(line)
            mine += x
        theirs = self.library.encode("\n" + "\n".join(pieces))
        if mine != theirs:
            if len(pieces) == 1:
                raise ValueError(f"the agenda and the library differ on {pieces[0]!r}")
            for p, x in zip(pieces, ids, strict=True):
                self.check([p], [x])
            raise ValueError("the agenda and the library differ")

    def encode_batch(self, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as packed little-endian 32-bit integers."""
        if self.whole:
            out = [self.agenda(self.normalise(t)) for t in texts]
            if out != self.library.encode(texts, num_threads=1):
                raise ValueError("the agenda and the library differ")
            return [pack_ids(x) for x in out]
        packed = []
        new_pieces: list[str] = []
        new_ids: list[list[int]] = []
        for t in texts:
            pieces = self.pieces(t)
            new = [p for p in set(pieces) if p not in cache]
            if new:
                if len(cache) + len(new) > CACHE_ENTRIES:
                    cache.clear()
                    new = list(set(pieces))
                ids = [self.agenda(p) for p in new]
                new_pieces += new
                new_ids += ids
                cache.update(zip(new, map(pack_ids, ids), strict=True))
            packed.append(b"".join(map(cache.__getitem__, pieces)))
        for at in range(0, len(new_pieces), 1000):
            self.check(new_pieces[at : at + 1000], new_ids[at : at + 1000])
        if texts and packed[0] != pack_ids(self.library.encode(texts[0])):
            raise ValueError("the agenda and the library differ on a whole text")
        return packed


#: Bytes of a model file at most; this bounds what is broadcast.
MAX_MODEL = 64 << 20
_ENCODERS: dict[str, tuple[PieceEncoder, dict[str, bytes]]] = {}


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL + 1)
    if len(model) > MAX_MODEL:
        raise ValueError(f"a model file of more than {MAX_MODEL} bytes")
    return model


def _shared(spark, path: str):
    """The model's bytes for the workers, and their digest."""
    model = read_model(path)
    return spark.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()


def _encoder(shared, key: str) -> tuple[PieceEncoder, dict[str, bytes]]:
    """One encoder and cache for each worker process and model."""
    if key not in _ENCODERS:
        _ENCODERS[key] = (PieceEncoder(shared.value), {})
    return _ENCODERS[key]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, decode: bool = True) -> DataFrame:
    """Encode whole texts and, where asked for, decode the ids again.

    Returns the id column, ``ids`` (binary: little-endian unsigned 32-bit
    integers) and ``decoded`` (the library's decoding of these ids, null
    unless ``decode``).  The model is read on the driver and sent to the
    workers.
    """
    shared, key = _shared(docs.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, cache = _encoder(shared, key)
        head = pack_ids([encoder.begin] * begin)
        tail = pack_ids([encoder.end] * end)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = [head + x + tail for x in encoder.encode_batch(texts, cache)]
                decoded = [encoder.library.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in ids] if decode else [None] * len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode packed ids with the library; null ids decode to the empty string."""
    shared, key = _shared(ids.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, _ = _encoder(shared, key)
        for batch in batches:
            texts = [encoder.library.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and digests of ``encode``'s result."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
