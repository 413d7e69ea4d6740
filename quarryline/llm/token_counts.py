"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text is a doubly linked list of byte symbols.  A heap holds the adjacent pairs that
have a merge, lowest rank (then leftmost) first; popping a live pair joins its two nodes and
pushes the two pairs that the join creates.  The number of tokens is the number of bytes less the
number of merges, so no token identifiers are emitted.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import utf8

#: Fixed value: the pattern that byte-level vocabularies of this kind split text with.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces, and runs of pieces without a space, remembered for each Python worker, once more as many
#: of an older generation: what is met again while a generation fills is carried into it.
CACHE_PIECES = 250_000
#: Characters above which a piece's count is not remembered.
CACHE_CHARS = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the other bytes get the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceCounter(dict):
    """piece -> number of tokens, counted on first sight."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, int] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        stand_in = {b: s for s, b in byte_symbols().items()}
        self.of_byte = [vocab[stand_in[b]] for b in range(256)]
        #: left << 32 | right -> rank << 32 | id of the joined symbol
        self.joins = {}
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.joins[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PIECES).findall
        self.after_space = AfterSpace(self)

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = merged_length([self.of_byte[b] for b in piece.encode("utf-8", "replace")], self.joins)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.count_plain, parts))

    def count_plain(self, text: str) -> int:
        """A space between two characters that are not white space always starts a piece, so the
        runs between such spaces can be counted, and remembered, one by one."""
        if WIDE_SPACE.search(text):
            return sum(map(self.__getitem__, self.find(text)))
        first, *rest = text.split(" ")
        return sum(map(self.__getitem__, self.find(first))) + sum(map(self.after_space.__getitem__, rest))


#: A space beside other white space, or at an end of the text.
WIDE_SPACE = regex.compile(r" \s|\s |^ | $")


class AfterSpace(dict):
    """A run of characters without a space -> number of tokens of a space and that run."""

    def __init__(self, pieces: PieceCounter) -> None:
        super().__init__()
        self.pieces = pieces
        self.older: dict[str, int] = {}

    def __missing__(self, run: str) -> int:
        n = self.older.get(run)
        if n is None:
            n = sum(map(self.pieces.__getitem__, self.pieces.find(" " + run)))
        if len(run) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
            self[run] = n
        return n


def merged_length(symbols: list[int], joins: dict[int, int]) -> int:
    """How many symbols are left when every possible merge has been made, lowest rank first."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    join, low = joins.get, (1 << 32) - 1
    # heap entries: rank << 32 | position, so that equal ranks go left to right
    heap = [found & ~low | i for i in range(n - 1) if (found := join(symbols[i] << 32 | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        entry = heapq.heappop(heap)
        i = entry & low
        j = after[i]
        if symbols[i] < 0 or j >= n:
            continue
        found = join(symbols[i] << 32 | symbols[j])
        if found is None or found & ~low != entry - i:
            continue  # one of the two has been joined since
        merges += 1
        symbols[i], symbols[j] = found & low, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := join(symbols[i] << 32 | symbols[k])) is not None:
                heapq.heappush(heap, found & ~low | i)
        h = before[i]
        if h >= 0 and (found := join(symbols[h] << 32 | symbols[i])) is not None:
            heapq.heappush(heap, found & ~low | h)
    return n - merges


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    """One table for each Python worker and vocabulary."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file in the JSON format of the tokenizers
    library, present on every executor.  The count is what that library gives without added
    tokens; the strings of its special tokens inside a text count one each.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are
    counted one by one; further columns of any name are ignored; an empty table gives none.
    The text is read once and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(vocabulary)
        for batch in batches:
            raw = batch.column(1)
            n_tokens = pa.array((counter.count(x.as_py().decode("utf-8", "replace")) for x in raw), pa.int64())
            n_bytes = pa.array((len(x.as_buffer() or b"") for x in raw), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
