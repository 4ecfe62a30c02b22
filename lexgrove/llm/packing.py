"""Packing of tokenized documents into windows, planned by non-negative least squares.

A document's full windows stand alone; what is left of it is shorter than a window, so the whole
corpus is described by a histogram of at most ``window - 1`` lengths. On it, combinations of two or
three lengths that fill a window are enumerated, and non-negative least squares says how often each
is to be repeated. The repeats are rounded down to what there is; the rest is laid out as one
stream, longest first, and cut at the window's ends. The stream's last part, shorter than a window,
becomes sequences of powers of two, which need no padding.

Documents of one length are interchangeable, so the plan is a small table of ranks: a document's
place follows from its rank among those of its length, which is its rank within its task plus the
number in earlier tasks. No group of documents is ever brought together.

Cases: a null text is an empty one, which has the closing id alone; a special token's string in a text
is that token, as in the library's default call; a text of any length is tokenized whole, and its full
windows are pieces of their own; documents of equal length are placed in the order of tasks and rows;
repeated rows are documents of their own; an empty table gives no pieces; columns other than the key
and the text are not read.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.llm.common import Tables, bounded_batches, vocabulary

WINDOW = 2048
CLOSING = 1
#: Combinations of three lengths that are tried for each length.
TRIPLES = 4
#: Distinct chunks between blanks that a Python worker remembers; beyond it starts anew.
REMEMBERED = 400_000
BIG_ENDIAN = sys.byteorder != "little"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level model: itself if it prints, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class _Chunks(dict):
    """Ids of what stands between blanks, by its bytes; a chunk that is not there is encoded.

    Only chunks that are all ASCII are made small before the library sees them: the normalizer composes
    letters and marks first, and small letters may compose where capitals do not.

    A word of Latin letters, and one with a full stop or comma after it, is what the normalizer and
    the splitter would make of it, so it goes to the library's model at once; all else takes the
    library's whole way. So does a chunk with a special token's string, which the library gives that
    token's id if its letters are as large as the token's.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.whole, self.model = tokenizer, tokenizer.model.tokenize
        self.special = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special)  # what all of them begin with

    def has_special(self, low: bytes) -> bool:
        """Whether small letters have a special token's string."""
        return self.mark in low and any(s in low for s in self.special)

    def __missing__(self, raw: bytes) -> bytes:
        chunk = raw.decode()
        end = chunk[-1:]
        if self.mark in (small := raw.lower()) and self.has_special(small):
            out = _bytes(self.whole.encode(chunk, add_special_tokens=False).ids)
        elif small != raw and chunk.isascii():
            out = self[small]
        elif (end == "." or end == ",") and chunk[-2:-1].isalpha() and chunk[-2] < "\u0100":
            out = self[raw[:-1]] + self[raw[-1:]]
        else:
            low = None
            if chunk.isalpha():
                if chunk.isascii():
                    low = chunk
                elif max(chunk) < "\u0100":
                    low = chunk.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
            out = _bytes(self.whole.encode(chunk, add_special_tokens=False).ids if low is None else [t.id for t in self.model(low)])
        if len(raw) <= 64:
            self[raw] = out
        return out


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if BIG_ENDIAN else array("I", ids).tobytes()


class Tokens:
    """Ids of whole texts. No token spans a blank or a line end, so chunks between them are encoded once."""

    def __init__(self, path: str, closing: int = CLOSING):
        self.known, self.closing = _Chunks(_tokenizer(path)), _bytes([closing])

    def __call__(self, text: bytes | str | None) -> bytes:
        """Ids of a text, or of its UTF-8 bytes. A text that is all ASCII is made small at once, as the normalizer would."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw = text.encode() if isinstance(text, str) else text or b""
        if raw.isascii() and not self.known.has_special(low := raw.lower()):
            raw = low
        return b"".join(map(self.known.__getitem__, raw.replace(b"\n", b" ").split(b" "))) + self.closing


KIND = pa.struct([("ids", pa.binary()), ("task", pa.int64()), ("rank", pa.int64()), ("full_before", pa.int64())])


def tokenize(df: DataFrame, text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Add a struct: ids, task, rank of the row and number of full windows before it among the task's rows of equal rest.

    The struct depends on which rows share a task; it has to be written before it is used twice.
    """
    path = path or vocabulary("word_bpe_49k.json")
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, task = Tokens(path), TaskContext.get().partitionId()
        seen, full = [0] * window, [0] * window
        for batch in batches:
            out = []
            for x in batch:
                ids = encode(x.as_buffer().to_pybytes() if x.is_valid else None)
                whole, rest = divmod(len(ids) // 4, window)
                out.append({"ids": ids, "task": task, "rank": seen[rest], "full_before": full[rest]})
                seen[rest] += 1
                full[rest] += whole
            yield pa.array(out, KIND)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("_t", F.arrow_udf(run, "struct<ids:binary,task:bigint,rank:bigint,full_before:bigint>").asNondeterministic()(F.col(text)))


def combinations(h: np.ndarray, window: int, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Pairs, and some triples, of lengths that occur and fill a window."""
    n = np.arange(window)
    found = {(a, window - a) for a in range(1, window // 2 + 1) if h[a] and h[window - a] and (a * 2 != window or h[a] > 1)}
    for a in np.flatnonzero(h):
        b = n[1 : max(1, window - a)]
        c = window - a - b
        least = np.minimum(h[b], h[c]) if len(b) else b
        for i in np.argsort(-least, kind="stable")[:triples]:
            if least[i] > 0:
                found.add(tuple(sorted((int(a), int(b[i]), int(c[i])))))
    return sorted(found, key=lambda p: (len(p), p))


def repeats(h: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 25) -> np.ndarray:
    """Non-negative least squares of the patterns' lengths against the histogram, by coordinates."""
    x, left = np.zeros(len(patterns)), h.astype(float).tolist()
    weights = []
    for p in patterns:
        w: dict[int, int] = {}
        for a in p:
            w[a] = w.get(a, 0) + 1
        weights.append((list(w.items()), sum(v * v for v in w.values())))
    for _ in range(rounds):
        moved = 0.0
        for j, (w, norm) in enumerate(weights):
            step = max(-x[j], sum(v * left[a] for a, v in w) / norm)
            if step:
                x[j] += step
                moved += abs(step)
                for a, v in w:
                    left[a] -= v * step
        if moved < 1e-3 * max(1.0, x.sum()):
            break
    return x


@dataclass(frozen=True)
class Plan:
    """A slot (length, first rank, end rank, first sequence, offset) gives each rank its own sequence.

    The stream has, for each length, the first rank in it and that rank's place; it is cut into full
    windows up to ``tail_at`` and then at ``starts``. Its sequences follow those of the slots.
    """

    slots: list[tuple[int, int, int, int, int]]
    stream: dict[int, tuple[int, int]]
    starts: list[int]
    tail_at: int
    n_slots: int
    n_stream: int


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """From the numbers of documents by length of their rest."""
    h = np.zeros(window, np.int64)
    for length, n in counts.items():
        h[length] = n
    h[0] = 0
    used, slots, sequence = np.zeros(window, np.int64), [], 0
    while True:  # what rounding leaves over is solved again, until no combination is left
        left, before = h - used, sequence
        patterns = combinations(left, window)
        x = repeats(left, patterns)
        for j in np.argsort(-x, kind="stable"):
            p = patterns[j]
            n = min([max(1, int(x[j] + 0.5)), *(int(h[a] - used[a]) // p.count(a) for a in set(p))])
            if n <= 0:
                continue
            offset = 0
            for a in p:
                slots.append((a, int(used[a]), int(used[a]) + n, sequence, offset))
                used[a] += n
                offset += a
            sequence += n
        if sequence == before:
            break
    stream, at = {}, 0
    for a in range(window - 1, 0, -1):
        if h[a] > used[a]:
            stream[a] = (int(used[a]), at)
            at += a * int(h[a] - used[a])
    starts, tail_at = [], at - at % window
    place = tail_at
    for bit in range(window.bit_length() - 1, -1, -1):
        if at % window >> bit & 1:
            starts.append(place)
            place += 1 << bit
    return Plan(slots, stream, starts, tail_at, sequence, tail_at // window + len(starts))


def _pieces(ids: Column, spans: Column) -> Column:
    """(start, length, ids, sequence_id, offset) of spans (start, length, sequence_id, offset)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.substring(ids, (s["start"] * 4 + 1).cast("int"), (s["length"] * 4).cast("int")).alias("ids"), s["sequence_id"].alias("sequence_id"), s["offset"].alias("offset")))


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces: the key, start, length, ids (little-endian, unsigned 32 bits), doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    tables = Tables(spark, "packing")
    rows = tokenize(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", window, path)
    rows = rows.select("_key", "_t.*").withColumn("n", F.floor(F.length("ids") / 4))
    rows = tables.keep(rows.withColumns({"rest": F.col("n") % window, "full": F.floor(F.col("n") / window)}), "tokens")

    cells = rows.groupBy("task", "rest").agg(F.count("*").alias("n_rows"), F.sum("full").alias("n_full"))
    earlier = "OVER (PARTITION BY rest ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cells = tables.keep(cells.selectExpr("task", "rest", "n_rows", "n_full", f"coalesce(sum(n_rows) {earlier}, 0) AS rank0", f"coalesce(sum(n_full) {earlier}, 0) AS full0"), "cells")
    totals = cells.groupBy("rest").agg(F.sum("n_rows").alias("n"), F.sum("n_full").alias("f")).collect()  # at most a window's number of rows
    p = plan({r["rest"]: r["n"] for r in totals}, window)
    first_full, bases = p.n_slots + p.n_stream, []
    for r in sorted(totals, key=lambda r: r["rest"]):
        first, at = p.stream.get(r["rest"], (r["n"], 0))
        bases.append((r["rest"], first_full, first, at, [(s[1], s[2], s[3], s[4]) for s in p.slots if s[0] == r["rest"]]))
        first_full += r["f"]
    # one row for each length of a rest: bounded by the window
    schema = "rest bigint, full_base bigint, stream_rank bigint, stream_at bigint, slots array<struct<first:bigint,end:bigint,sequence:bigint,offset:bigint>>"
    table = F.broadcast(spark.createDataFrame(bases, schema))

    # the cells grow with the number of tasks, so they are never broadcast, even where they are few; a
    # partition of them is small, so the rows with their ids need no sort
    placed = rows.join(cells.select("task", "rest", "rank0", "full0").hint("shuffle_hash"), ["task", "rest"]).join(table, "rest")
    rank = F.col("rank") + F.col("rank0")
    start, rest = F.col("full") * window, F.col("rest")
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1), lambda i: _span(i * window, F.lit(window), F.col("full_base") + F.col("full0") + F.col("full_before") + i, F.lit(0)))).otherwise(F.array().cast(SPANS))
    fixed = F.transform(F.filter(F.col("slots"), lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["end"])), lambda s: _span(start, rest, s["sequence"] + F.col("_rank") - s["first"], s["offset"]))
    tail = F.array(*(F.lit(s).cast("bigint") for s in p.starts)) if p.starts else F.array().cast("array<bigint>")
    # the sequences that an item of the stream may lie in: two windows, and the powers of two
    window_at = lambda d: (F.floor(F.col("_at") / window) + d) * window
    begins = F.array_sort(F.array_distinct(F.concat(F.filter(F.array(window_at(0), window_at(1)), lambda b: b < p.tail_at), tail)))
    ends = F.concat(F.slice(begins, 2, 99), F.array(F.lit(2**62).cast("bigint")))
    cut = F.transform(F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e"))), lambda z: (z["b"] < F.col("_at") + rest) & (z["e"] > F.col("_at"))), lambda z: _stream_span(z, start, rest, p, window))
    placed = placed.withColumn("_rank", rank).withColumn("_at", F.col("stream_at") + (F.col("_rank") - F.col("stream_rank")) * rest)
    streamed = F.when((rest > 0) & (F.col("_rank") >= F.col("stream_rank")), cut).otherwise(F.array().cast(SPANS))
    placed = placed.select("_key", "n", "ids", F.concat(whole, fixed, streamed).alias("spans"))
    out = placed.select("_key", "n", F.explode(_pieces(F.col("ids"), F.col("spans"))).alias("p"))
    return out.select(F.col("_key").alias(key), "p.start", "p.length", "p.ids", F.col("n").alias("doc_tokens"), "p.sequence_id", "p.offset")


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "sequence_id", "offset")]))


def _span(start: Column, length: Column, sequence: Column, offset: Column) -> Column:
    return F.struct(*(c.cast("bigint").alias(n) for n, c in (("start", start), ("length", length), ("sequence_id", sequence), ("offset", offset))))


def _stream_span(z: Column, start: Column, rest: Column, p: Plan, window: int) -> Column:
    low, high = F.greatest(z["b"], F.col("_at")), F.least(z["e"], F.col("_at") + rest)
    number = F.floor(z["b"] / window)
    for i, s in enumerate(p.starts):
        number = F.when(z["b"] == s, p.tail_at // window + i).otherwise(number)
    return _span(start + low - F.col("_at"), high - low, p.n_slots + number, low - z["b"])


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences, tokens and padding of what was packed; a length that is a power of two needs none."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    short = F.col("filled").bitwiseAND(F.col("filled") - 1) != 0
    return filled.agg(F.count("*").alias("sequences"), F.sum("filled").alias("tokens"), F.sum(F.when(short, window - F.col("filled")).otherwise(0)).alias("padding"))
