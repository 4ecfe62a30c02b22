"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text exactly one token can be the last of the prefix's encoding: the
one that ends there and whose neighbour, the last token of what precedes it, the merges would keep
apart from it. Storing that token for each prefix is enough: the encoding is read backwards, an
append only computes the new prefixes, and an edit keeps everything before it.

Cases: a null text encodes like an empty one, to no ids; null ids decode to no bytes; a piece of
any length takes time in proportion to it; equal rows give equal results; extra columns pass
through, and a column that has the name of the result is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import arrow_column, vocabulary

#: Fixed value: how text is split before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a Python worker remembers of pieces and of token pairs. Beyond it pairs start anew,
#: and of the pieces those that come again within as many new ones stay.
REMEMBERED = 450_000


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging, lowest rank first, by ranks under ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Tokens with the two halves that each one's last merge joins."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.longest = max(map(len, ranks))
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        self.joins: dict[tuple[int, int], int] = {}
        self.starts: dict[bytes, int] = {}  # a token's rank, or -1 for what only begins tokens
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merged(token, ranks, rank)
                if len(parts) != 2:
                    continue  # the merges never make this token
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[rank] = pair
                self.joins[pair] = rank
            for i in range(1, len(token)):
                self.starts.setdefault(token[:i], -1)
            self.starts[token] = rank
        self.apart: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(_ranks(path))

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens' joined bytes give these two tokens.

        Merging is undone from the latest merge to the earliest along the border. The border holds
        if no pair that faces it at any time would have been merged before one of the two was made.
        """
        key = left * self.size + right
        if len(self.apart) >= REMEMBERED:
            self.apart.clear()
        known = self.apart[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # made: the time at which the one facing the border that was made last came to be. Of equal
        # ranks the left one merges first, so a border pair of that rank comes before the right one.
        until = (self.size, 0)
        while True:
            join = self.joins.get((left, right))
            if join is not None and (join, 0.5) < until:
                return False
            l, r = self.halves[left], self.halves[right]
            if l is None and r is None:
                return True
            if r is None or (l is not None and left > right):
                until = min(until, (left, 0))
                left = l[1]
            else:
                until = min(until, (right, 1))
                right = r[0]


class Prefixes:
    """Encoding of one piece, with the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> Prefixes:
        """Encode ``more`` after what is there; tokens that reach into it are found anew."""
        v, old = self.vocabulary, len(self.piece)
        piece = self.piece = self.piece + more
        n, last, size = len(piece), self.last, v.size
        last.extend([-1] * (n - old))
        starts, apart, find = v.starts.get, v.apart.get, v.stay_apart
        for i in range(max(0, old - v.longest) if old else 0, n):
            before = last[i]
            for end in range(i + 1, n + 1):
                token = starts(piece[i:end])
                if token is None:
                    break
                if token >= 0 and last[end] < 0 and end > old:
                    if i:
                        fits = apart(before * size + token)
                        if not (find(before, token) if fits is None else fits):
                            continue
                    last[end] = token
        return self

    def edit(self, start: int, end: int, put: bytes) -> Prefixes:
        """Replace bytes ``start:end``. Prefixes up to ``start`` are kept as they are.

        After the edit, what follows is encoded until as many last tokens in a row as the longest
        token has bytes are what they were: from there on all of them are.
        """
        tail, was, reach = self.piece[end:], self.last[end:], self.vocabulary.longest
        self.piece = self.piece[:start]
        del self.last[start + 1 :]
        self.append(put)
        done = 0
        while done < len(tail):
            part = tail[done : done + 2 * reach]
            self.append(part)
            done += len(part)
            if done > reach and self.last[-reach:] == was[done + 1 - reach : done + 1]:
                self.piece += tail[done:]
                self.last += was[done + 1 :]
                break
        return self

    def ids(self) -> list[int]:
        out, at, tokens = [], len(self.piece), self.vocabulary.tokens
        while at:
            out.append(self.last[at])
            at -= len(tokens[self.last[at]])
        return out[::-1]


@lru_cache(maxsize=4)
def _loaded(path: str) -> Vocabulary:
    return Vocabulary.load(path)


class _Pieces(dict):
    """Ids of pieces; one that is not there is encoded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.vocabulary.ranks.get(raw)
            ids = np.array([whole] if whole is not None else Prefixes(self.vocabulary, raw).ids(), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids; pieces that come again are looked up."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import regex

        self.vocabulary, self.split = _loaded(path), regex.compile(pattern).findall
        self.known = _Pieces(self.vocabulary)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            full, self.known = self.known, _Pieces(self.vocabulary)
            full.before, self.known.before = {}, full
        return b"".join(map(self.known.__getitem__, self.split(text or "")))


class Decoder:
    """Ids to bytes; it needs the tokens alone."""

    def __init__(self, path: str):
        ranks = _ranks(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """Add ``ids``, the text's token ids as little-endian unsigned 32-bit integers."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    return df.withColumn(ids, arrow_column(lambda: Encoder(path, pattern).encode, pa.binary(), "binary", F.col(text)))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``decoded``, the bytes of the ids."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    return df.withColumn(decoded, arrow_column(lambda: Decoder(path).decode, pa.binary(), "binary", F.col(ids)))


def digest(raw: Column) -> Column:
    return F.lower(F.sha2(raw, 256))
