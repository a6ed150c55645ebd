"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that can end its encoding. The table of
these last tokens is filled from left to right: of the tokens that are suffixes of the prefix, it is
the one that is compatible with the last token of the prefix before it. Reading the table from its
end gives the encoding. An append only extends the table; an edit rewrites the table from the edit
on, until it agrees with the old one over the length of the longest token.

Documents: a null text counts as empty, an empty text has no ids. Repeated rows are encoded each for
itself; null ids pass through. Any length of text works in memory proportional to that text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import list_array, texts_of

#: Pieces kept with their ids in each Python worker; more only cost their encoding again.
CACHE_PIECES = 250_000
CACHE_PAIRS = 300_000
#: Unicode white space, spelled out because engines differ on the control characters 1C to 1F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def compile_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with white space as in Unicode's White_Space property."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(spelled)


class PrefixEncoder:
    """Encodes byte strings with the merges that ``ranks`` stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._ranks = ranks
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        # An automaton over the bytes, filled as texts need it: a state is the longest suffix of what
        # was read that begins a token.
        self._prefixes = {b""}.union(*({token[:i] for i in range(1, len(token) + 1)} for token in ranks))
        self._states: dict[bytes, int] = {}
        self._names: list[bytes] = []
        self._ends: list[tuple[tuple[int, int], ...]] = []  # (length, token) of the tokens a state ends with, longest first
        self._next: dict[int, int] = {}
        self._state(b"")

    def _state(self, suffix: bytes) -> int:
        while suffix not in self._prefixes:
            suffix = suffix[1:]
        state = self._states.get(suffix)
        if state is None:
            state = self._states[suffix] = len(self._names)
            self._names.append(suffix)
            tokens = ((len(suffix) - i, self._ranks.get(suffix[i:])) for i in range(len(suffix)))
            self._ends.append(tuple((n, t) for n, t in tokens if t is not None and (n == 1 or self.halves(t))))
        return state

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token no merge makes."""
        if token not in self._halves:
            self._halves[token] = self._find_halves(token)
        return self._halves[token]

    def _find_halves(self, token: int) -> tuple[int, int] | None:
        parts = [bytes([b]) for b in self.bytes_of[token]]
        while len(parts) > 2:
            rank, at = min(((self._ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank >= token:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self._ranks[parts[0]], self._ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._is_compatible(left, right)
        return known

    def _is_compatible(self, left: int, right: int) -> bool:
        # Merges are undone from the latest back; before each, the two tokens at the border must not
        # have been merged with one another.
        until = len(self.bytes_of) + 1 << 1
        while True:
            across = self._ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < until:
                return False
            left_made, right_made = self.halves(left), self.halves(right)
            if left_made and (left > right or not right_made):
                until, left = left, left_made[1]
            elif right_made:
                until, right = right + 1, right_made[0]
            else:
                return True

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill the table up to prefix length ``stop``; ``last[i]`` ends the prefix of length i + 1."""
        follow, ends, pairs, compatible = self._next, self._ends, self._pairs, self.compatible
        at = len(last)
        state = self._state(data[max(0, at - self.longest) : at])
        for end in range(at, len(data) if stop is None else stop):
            move = state << 8 | data[end]
            state = follow.get(move, -1)
            if state < 0:
                state = follow[move] = self._state(self._names[move >> 8] + data[end : end + 1])
            for length, token in ends[state]:
                if length > end:
                    break
                left = last[end - length]
                if pairs.get(left << 32 | token) or compatible(left, token):
                    break
            last.append(token)
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return ids[::-1]

    def encode(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The ids of one piece; a piece that is a token as a whole is that token.

        ``last``: a table of one of the piece's prefixes, which is then extended.
        """
        last = [] if last is None else last
        whole = self._ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.extend(piece, last))


class PrefixTable:
    """The last-token table of one growing or edited byte string (one piece)."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``data[start:stop]``; returns how many entries were computed again."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        agree, end = 0, start
        while end < len(self.data):
            end += 1
            self.encoder.extend(self.data, self.last, end)
            before = end - 1 - shift
            agree = agree + 1 if end > start + len(new) and before >= stop and old[before] == self.last[-1] else 0
            if agree >= self.encoder.longest:
                self.last += old[before + 1 :]
                break
        return end - start

    def ids(self) -> list[int]:
        return self.encoder.walk_back(self.last)


class _Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers; emptied when it is full."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def learn(self, pieces: set[str]) -> None:
        """Encode what is new. In byte order neighbours share prefixes, and so parts of their tables."""
        if len(self) > CACHE_PIECES:
            self.clear()
        data, last = b"", []
        for piece in sorted(p.encode("utf-8") for p in pieces if p not in self):
            shared = 0
            for x, y in zip(data, piece, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            data = piece
            self[piece.decode("utf-8")] = array("i", self.encoder.encode(piece, last)).tobytes()

    def encode_groups(self, texts: list[str], split: regex.Pattern) -> Iterator[list[bytes]]:
        """The ids of the texts in their order, a group of about 1 MB of texts after the other."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(split.findall(text))
            size += len(text)
            if size > 1_000_000 or i == len(texts) - 1:
                self.learn(set().union(*group))
                yield [b"".join(map(self.__getitem__, pieces)) for pieces in group]
                group, size = [], 0


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> tuple[_Pieces, regex.Pattern]:
    return _Pieces(PrefixEncoder(load_ranks(path))), compile_pattern(pattern)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def encode_text(text: str, path: str, pattern: str) -> np.ndarray:
    """The ids of a whole text, each match of the pattern encoded separately."""
    pieces, split = _worker(path, pattern)
    return np.frombuffer(next(pieces.encode_groups([text], split))[0], dtype="<i4")


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row; one pass without a shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = _worker(ranks_path, pattern)
        for batch in batches:
            at = 0
            for ids in pieces.encode_groups(texts_of(batch.column(1)), split):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), list_array(ids)], names=[id_col, "ids"])
                at += len(ids)

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(encode, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``ids`` and ``decoded`` (binary); null ids decode to no bytes, an unknown id is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks_path)
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()
            decoded = pa.array((b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(offsets, offsets[1:], strict=False)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=[id_col, "ids", "decoded"])

    rows = encoded.select(F.col(id_col), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(decode, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
