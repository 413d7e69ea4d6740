"""Word shingles as 64-bit hashes, many documents at a time.

A word's hash is a polynomial of its bytes, each replaced by a random number, modulo 2**64.  The
sums of all bytes before each place give every word's polynomial by one subtraction, so no word
becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarryline.llm.common import ASCII_LOWER, ASCII_SPACE

#: Bytes of text that are hashed at once; only a single word may take more.
BLOCK = 1 << 18
#: Bytes of documents whose shingles are held at once; only a single document may take more.
SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_BYTES = np.random.default_rng(41).integers(1, 2**63, size=256, dtype=np.uint64)[np.frombuffer(ASCII_LOWER, np.uint8)]
_IS_WORD = np.array([b not in ASCII_SPACE for b in range(256)])
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers 0 to ``size`` of the base and of its inverse."""
    if len(_POWERS[0]) <= size:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            line = np.full(max(size, BLOCK) + 1, x, np.uint64)
            line[0] = 1
            _POWERS[k] = np.cumprod(line)
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def hash_words(text: np.ndarray, starts_of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the rows that follow one another in ``text`` (bytes), and how many
    words each row has.  Words are runs without ASCII white space, ASCII letters lower-cased."""
    word = _IS_WORD[text]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = starts_of_rows[(starts_of_rows > 0) & (starts_of_rows < len(text))]
    first[cut], last[cut - 1] = word[cut], word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        until = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        size = int(ends[until - 1] - low)
        up, down = _powers(size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[text[low : low + size]] * up[:size], out=total[1:])
        s = starts[at:until] - low
        out[at:until] = (total[ends[at:until] - low] - total[s]) * down[s]
        at = until
    return _mixed(out), np.diff(np.searchsorted(starts, np.append(starts_of_rows, len(text))))


def word_hashes(raw: bytes) -> np.ndarray:
    """The hash of each word of a text."""
    return hash_words(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))[0]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; of all words where there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + words[k : len(words) - size + 1 + k]
    return _mixed(out)


def shingles_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each row of a binary column without nulls."""
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        words, counts = hash_words(data[offsets[row] : offsets[until]], offsets[row:until] - offsets[row])
        runs, ends = shingle_hashes(words, size) if len(words) >= size else words, np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            yield runs[end - n : end - size + 1] if n >= size else shingle_hashes(words[end - n : end], size)
        row = until


def shingle_set(raw: bytes, size: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(word_hashes(raw), size))
