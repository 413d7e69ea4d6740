"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

Encoding walks a word from the left.  An Aho-Corasick automaton gives the longest token that
starts at every position; a token is accepted when the pair it forms with the token before it is
compatible, that is, when merging the two tokens' text by rank would leave exactly these two.
Otherwise the next shorter token that is a prefix is tried, and when none is left the position is
marked as a dead end and the walk goes back one token.  Every position is left dead at most once,
so the work is linear in the word, and the result is the one merge order defines.

Decoding copies slices of one flat byte table: the slice of token ``i`` lies between
``offsets[i]`` and ``offsets[i + 1]``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import in_slices, utf8
from quarryline.llm.token_counts import byte_symbols

#: Fixed value: the pattern of the pieces that a vocabulary with word ends keeps.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs without white space remembered for each Python worker, once more as many of an older
#: generation: what is met again while a generation fills is carried into it.
CACHE_RUNS = 120_000
#: Bytes above which a run's tokens are not remembered.
CACHE_BYTES = 64
#: Token pairs whose compatibility is remembered.
CACHE_PAIRS = 200_000
#: Stands for the end of a word inside the automaton; above every byte.
END = "Ā"


class OffsetTable:
    """Byte strings by number, as one flat table and the offset of each."""

    def __init__(self, parts: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.offsets[1:])

    def join(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)].tobytes()


class Codec(dict):
    """Encoder and decoder of one vocabulary file; as a dict: run of text -> its ids as bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, suffix = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        of_symbol = byte_symbols()

        def plain(token: str) -> str:
            body = token.removesuffix(suffix)
            return "".join(chr(of_symbol[c]) for c in body) + END * (body != token)

        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        texts = [""] * size
        self.automaton = ahocorasick.Automaton()
        by_text = {plain(token): i for token, i in vocab.items()}
        for text, i in by_text.items():
            texts[i] = text
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.length = [len(t) for t in texts]
        #: the longest token that is a proper prefix of the token, or -1
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in texts]
        self.left, self.right = list(range(size)), list(range(size))
        #: left << 32 | right -> joined; identifiers rise with the rank of the merge
        self.joined = {}
        last = -1
        for pair in merges:
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            c = by_text[texts[a] + texts[b]]
            if c <= last or c in (a, b):
                raise ValueError("the vocabulary's identifiers do not rise with the merge ranks")
            last = c
            self.left[c], self.right[c] = a, b
            self.joined[a << 32 | b] = c
        self.fits: dict[int, bool] = {}
        strings = [""] * size
        for token, i in [*vocab.items(), *added.items()]:
            strings[i] = token
        self.tokens = OffsetTable([s.encode() + b" " for s in strings])
        self.numbers = OffsetTable([b"%d " % i for i in range(size)])
        self.added = {k: np.int32(v).tobytes() for k, v in added.items()}
        ordered = sorted(added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.find = regex.compile(WORDS).findall

    def compatible(self, a: int, b: int) -> bool:
        """Would merging the text of ``a`` and ``b`` leave a seam between them?

        The merges are undone, latest first.  ``until`` is when the two symbols at the seam
        ceased to be neighbours; a merge of the two with a lower identifier would have come first.
        At equal identifiers the left one is merged first.
        """
        until = len(self.left)
        while True:
            seam = self.joined.get(a << 32 | b)
            if seam is not None and seam < until:
                return False
            undo_left = a > b
            if undo_left and self.right[a] == a or not undo_left and self.left[b] == b:
                undo_left = not undo_left  # a single symbol can't be undone
            if undo_left:
                if self.right[a] == a:
                    return True
                until, a = a, self.right[a]
            else:
                if self.left[b] == b:
                    return True
                until, b = b + 1, self.left[b]

    def encode_word(self, word: bytes) -> list[int]:
        text = word.decode("latin-1") + END
        n = len(text)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(text):
            longest[end - size + 1] = token  # later ends are longer
        alive = bytearray(b"\x01") * (n + 1)
        length, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if alive[end] and (end == n or longest[end] >= 0):
                    if not out:
                        break
                    key = out[-1] << 32 | token
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) >= CACHE_PAIRS:
                            fits.clear()
                        ok = fits[key] = self.compatible(out[-1], token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def __missing__(self, run: str) -> bytes:
        packed = self.older.get(run)
        if packed is None:
            ids: list[int] = []
            for word in self.find(run):
                ids += self.encode_word(word.encode("utf-8", "replace"))
            packed = np.array(ids, np.int32).tobytes()
        if len(run) <= CACHE_BYTES:
            if len(self) >= CACHE_RUNS:
                self.older = dict(self)
                self.clear()
            self[run] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            # each character on its own: no special small sigma at a word's end
            part = part.replace("Σ", "σ").lower()
            out += map(self.__getitem__, regex.split(r"\s+", part) if CONTROL.search(part) else part.split())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by one space: this kind of file names no decoder."""
        return self.tokens.join(ids)[:-1]

    def spell(self, ids: np.ndarray) -> bytes:
        """The decimal identifiers joined by one space."""
        return self.numbers.join(ids)[:-1]


#: Characters that str.split() takes for white space and the vocabulary's pattern does not.
CONTROL = regex.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One set of tables for each Python worker and vocabulary."""
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the whole text of every row as identifiers.

    Null and empty texts have no identifiers; a null id stays null; repeated rows are encoded one
    by one; further columns are ignored; an empty table gives none.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary)
        for batch in batches:
            ids = [tables.encode(x.as_py().decode("utf-8", "replace")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded string) of rows with identifiers, special tokens kept; null gives empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary)
        for batch in batches:
            texts = [tables.decode(np.array(x.as_py() or [], np.int32)).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode every row in one pass.

    The digests are of the identifiers in decimal, joined by one space, and of the decoded text.
    They are taken where the identifiers are, so neither has to leave the task.  Edge cases as in
    :func:`encode`; an empty text gives the digest of no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(vocabulary)
        for batch in in_slices(batches):
            sizes, spelled, decoded = [], [], []
            for x in batch.column(1):
                ids = tables.encode(x.as_py().decode("utf-8", "replace"))
                sizes.append(len(ids))
                spelled.append(hashlib.sha256(tables.spell(ids)).hexdigest())
                decoded.append(hashlib.sha256(tables.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
