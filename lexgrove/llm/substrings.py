"""Repeated byte strings: every byte covered by a string of ``length`` that also starts earlier.

A distributed suffix sort, cut at ``length`` bytes, by difference covers.

* What can repeat is brought together: in each window of ``length`` bytes the least of its hashed
  ``GRAM``-byte strings is sampled. Equal windows have equal samples at the same place, so they meet
  where their sample goes. Samples whose name is unique leave no work behind.
* Of samples whose windows cover the same bytes, the later ones are settled: their windows have all
  come before. Hashes find them, bytes decide: a task compares those that it finds again, and settles
  them there, so copies do not travel; what meets elsewhere claims bytes of an earlier document, and
  a claim counts once the bytes of both places, fetched in blocks, have been found to be the same.
* The remaining contexts, a sample's windows with differing surroundings, are suffix-sorted in
  parts by the skew algorithm: triples at positions 1 and 2 modulo 3 are sorted and named, the names'
  suffixes sorted by recursion, the suffixes at positions 0 merged into them. Windows that are
  neighbours in this order are compared byte by byte; of equal ones all but the first are removed.

A sample with very many contexts is dealt out by its windows instead, whose bytes are compared as well.
It is known as such from a look at some documents, or when its rows arrive; that decides the way of the
work only, never the result. Where hashes agree and bytes do not, all windows of the samples concerned
are grouped by their bytes.

Cases: a null text is empty; texts shorter than ``length`` have no strings; rows that agree in key
and text are one document and fare alike; texts of one key are in the order of their hashes; rows
without a key come first; a key has to be a whole number, or text of one; a text of any length is
sampled in slices of ``SLICE`` bytes that overlap by a window; an empty table gives none; other columns
pass through, and columns that have the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables, bounded_batches

LENGTH, GRAM = 100, 32
#: Samples that a task holds before it settles the copies among them, and bytes of texts that are sampled at once about.
HELD, CHUNK = 400_000, 100_000
#: Bytes of a long text that are sampled at once, and bytes of a block in which claims are compared.
SLICE, BLOCK = 4_000_000, 4096
#: Of one in so many documents it is seen which samples are hot: those that hold more than one in
#: ``HOT`` of the samples seen, and so at most ``HOT`` in number, and more than ``LEAST_HOT``.
LOOK, HOT, LEAST_HOT = 32, 20_000, 64
#: Samples of one name that are held at most, and bytes of contexts that are sorted together about: few enough for a CPU's cache.
CROWD, TOGETHER = 10_000, 130_000

U = np.uint64
#: Lower bits of a hash that make room for a position.
PLACE = U(2**31 - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> U(29))) * U(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) from each position on."""
    h, size = (raw.astype(U) + U(1)) * U(0x9E3779B97F4A7C15), 1
    while size < gram:
        h = _mix(h[:-size], h[size:])
        size *= 2
    return h


def samples(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, sizes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sampled positions with the first and last start of the windows that have their sample there, name and refined name.

    ``raw`` may hold several texts in a row, whose ``sizes`` are given; windows do not cross them. Of
    hashes that agree in their upper bits the leftmost is sampled.
    """
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.view(U), none.view(U)
    h = gram_hashes(raw, gram)
    least, size = (h & ~PLACE) | np.arange(len(h), dtype=U), 1
    width = length - gram + 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    at = (least & PLACE).view(np.int64)
    new = np.append(True, at[1:] != at[:-1])
    if sizes is not None:
        text = np.repeat(np.arange(len(sizes)), sizes)
        within = text[: len(at)] == text[length - 1 :]
        new |= np.append(True, within[1:] != within[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    if sizes is not None:
        first, last = first[within[first]], last[within[first]]
    a = at[first]
    # all bytes from the first window's start to the last one's end, by strings of ``gram`` bytes
    end = last + length - gram
    fine = _mix(U(1) + (a - first).astype(U), (last - first).astype(U))
    for i in range(0, 2 * length, gram):
        fine = _mix(fine, h[np.minimum(first + i, end)])
    return a, first, last, h[a], fine


#: key: a sample's name, or where a settled or hot one goes; at: position, distances, kind.
SAMPLE = "key bigint, fine bigint, d bigint, h bigint, at bigint"
SAMPLED, SETTLED, WIDE, CLAIMED, PIECE = 0, 1, 2, 3, 4


def _pack(a: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (a << 24) | ((a - first) << 16) | ((a - last) << 8) | kind


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a = at >> 24
    return a, a - (at >> 16 & 255), a - (at >> 8 & 255), at & 255


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``raw`` from ``a`` on are those from ``b`` on."""
    same = size == size_b
    step = np.arange(size.max(initial=0))
    for i in range(0, len(a), 10_000):
        s = slice(i, i + 10_000)
        inside = step < size[s, None]
        x, y = (raw[np.minimum(at[s, None] + step, len(raw) - 1)] for at in (a, b))
        same[s] &= ((x == y) | ~inside).all(axis=1)
    return same


def _sample(hot: np.ndarray, length: int, bits: int = 64, named: bool = False) -> Callable:
    """Documents (d, h, text) to samples; of those whose windows cover the same bytes the task's first travels.

    ``bits``: how many of a name's bits count. ``named``: all samples travel, with their names as ``fine``.
    """
    mask = U(2**64 - 1 if bits >= 64 else 2**bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(8)]
        texts: list[np.ndarray] = []
        n = size_held = 0

        def settle() -> pa.RecordBatch:
            d, h, a, first, last, name, fine, place = (np.concatenate(x) for x in held)
            name, fine = name & mask, fine & mask
            again = np.zeros(len(name), bool)
            if not named:
                # only names that occur twice need an order
                order = np.argsort(name)
                same = name[order][1:] == name[order][:-1]
                twice = order[np.append(False, same) | np.append(same, False)]
                twice = twice[np.lexsort((a[twice], h[twice], d[twice], fine[twice], name[twice]))]
                later, before = twice[1:], twice[:-1]
                like = (name[later] == name[before]) & (fine[later] == fine[before]) & (place[later] != place[before])
                later, before = later[like], before[like]
                size = last - first + length
                again[later] = _same_bytes(np.concatenate(texts), place[later] - (a - first)[later], place[before] - (a - first)[before], size[later], size[before])
            wide = np.isin(name, hot) & ~again
            key = np.where(again, _mix(d.astype(U), a.astype(U)), np.where(wide, _mix(name, fine), name))
            kind = np.where(again, SETTLED, np.where(wide, WIDE, SAMPLED))
            return _batch(["key", "fine", "d", "h", "at"], [key.view(np.int64), (name if named else fine).view(np.int64), d, h, _pack(a, first, last, kind)])

        def add(ds: list[int], hs: list[int], offsets: list[int], raws: list[np.ndarray]) -> int:
            nonlocal size_held
            sizes = np.array([len(raw) for raw in raws])
            together = np.concatenate(raws)
            found = samples(together, length, sizes=sizes)
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, found[0], "right")
            if len(text):
                places = [x - (ends - sizes - np.array(offsets))[text] for x in found[:3]]
                for x, v in zip(held, (np.array(ds)[text], np.array(hs)[text], *places, *found[3:], found[0] + size_held)):
                    x.append(v)
                texts.append(together)
                size_held += len(together)
            return len(text)

        for batch in batches:
            together: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            for d, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if not text.is_valid or len(text.as_buffer()) < length:
                    continue
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                for at in range(0, len(raw) - length + 1, SLICE):
                    for x, v in zip(together, (d, h, at, raw[at : at + SLICE + length - 1])):
                        x.append(v)
                    size += len(together[3][-1])
                    if size >= CHUNK:
                        n += add(*together)
                        together, size = ([], [], [], []), 0
                    if n >= HELD:
                        yield settle()
                        held, texts = [[] for _ in range(8)], []
                        n = size_held = 0
            if size:
                n += add(*together)
        if n:
            yield settle()

    return run


#: d2, h2, at2: the sample whose bytes a claim's are said to be.
FOUND = "kind int, key bigint, d bigint, h bigint, at bigint, d2 bigint, h2 bigint, at2 bigint"


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples sorted by key to settled ones, claims, and those that share their name with another context."""
    names = ["kind", "key", "d", "h", "at", "d2", "h2", "at2"]
    held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(5)]
    crowd: int | None = None  # the name, already passed on in part, of more samples than are held

    def wide(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, _, d, h, at = rows
        kind = np.where((at & 255) == SETTLED, SETTLED, WIDE).astype(np.int32)
        return _batch(names, [kind, key, d, h, at, *[np.zeros(len(key), np.int64)] * 3])

    def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if crowd is not None and len(rows[0]) and rows[0][0] == crowd:
            n = int(np.searchsorted(rows[0], crowd, "right"))
            yield wide([x[:n] for x in rows])
            rows = [x[n:] for x in rows]
        if not len(rows[0]):
            return
        kind = rows[4] & 255
        # kinds share a key only by chance; they are kept apart
        order = np.lexsort((rows[4], rows[3], rows[2], rows[1], kind, rows[0]))
        key, fine, d, h, at = (r[order] for r in rows)
        kind = kind[order]
        same = (key[1:] == key[:-1]) & (kind[1:] == kind[:-1])
        begins = np.append(True, ~(same & (fine[1:] == fine[:-1])))
        # the first sample of a name and a refined name
        least = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
        itself = (d == d[least]) & (h == h[least]) & (at >> 24 == at[least] >> 24)
        claimed = (kind != SETTLED) & ~begins & ~itself
        again = (kind == SETTLED) | claimed
        run = np.cumsum(np.append(0, ~same))
        contexts = np.bincount(run, weights=~again)[run]
        keep = again | (kind == WIDE) | (contexts > 1)
        out = np.where(claimed, CLAIMED, kind)[keep].astype(np.int32)
        yield _batch(names, [out, key[keep], d[keep], h[keep], at[keep], *(np.where(claimed, x[least], 0)[keep] for x in (d, h, at))])

    for batch in batches:
        held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
        if len(held[0]) < CROWD:
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield from done([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if len(held[0]) >= CROWD or held[0][0] == crowd:
            yield wide(held)
            crowd, held = held[0][0], [x[:0] for x in held]
    yield from done(held)


CONTEXT = "kind int, key bigint, d bigint, h bigint, at bigint, bytes binary"


def _contexts(length: int) -> Callable:
    """(d, h, text, found) to the bytes that each sample's windows cover, and to pieces for the claims on (key, h) at ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for d, h, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = (text or "").encode()
                for s in found:
                    if s["kind"] == PIECE:
                        row = (PIECE, s["key"], s["n"], s["h2"], s["at"], raw[s["p"] : s["p"] + s["n"]])
                    else:
                        _, first, last, _ = _unpack(s["at"])
                        row = (s["kind"], s["key"], d, h, s["at"], raw[first : last + length])
                    for x, v in zip(out, row):
                        x.append(v)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["kind", "key", "d", "h", "at", "bytes"])

    return run


SPAN = "d bigint, h bigint, first bigint, end bigint"


def suffix_order(s: np.ndarray, length: int, each: int = 1) -> np.ndarray:
    """Positions in the order of their suffixes, as far as ``length`` bytes decide it.

    ``s`` has numbers from 1 on, each of which stands for ``each`` bytes. Triples at positions 1 and
    2 modulo 3 are named in their order. If names repeat, and triples do not reach over ``length``
    bytes yet, the names' own suffixes are sorted. A suffix at a position 0 modulo 3 is a number and
    a suffix that is sorted by then.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    both = np.concatenate([one, two])
    base = int(t.max()) + 1
    if base**3 >= 2**62:
        raise ValueError("too long a text to be sorted at once")
    triples = (t[both] * base + t[both + 1]) * base + t[np.minimum(both + 2, n + 2)]
    order = np.argsort(triples)
    new = np.append(False, triples[order][1:] != triples[order][:-1])
    names = np.empty(len(both), np.int64)
    names[order] = np.cumsum(new) + 1
    if names.max() < len(both) and 3 * each < length:
        order = suffix_order(names, length, 3 * each)
    sampled = both[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled, m = sampled[sampled < n], len(both) + 1
    zero = np.arange(0, n, 3)
    by_one = t[zero] * m + rank[zero + 1]
    order = np.argsort(by_one)
    zero, by_one = zero[order], by_one[order]
    # a suffix at 0 is compared with one at 1 by a number and a rank, with one at 2 by two and a rank
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    by_two = (t[zero] * base + t[zero + 1]) * m + rank[zero + 2]
    behind = np.searchsorted((t[second] * base + t[second + 1]) * m + rank[second + 2], by_two)
    # suffixes that agree in ``length`` bytes may be in any order among themselves, but in one order
    place = np.arange(len(zero)) + np.searchsorted(t[first] * m + rank[first + 1], by_one) + np.maximum.accumulate(behind)
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[place], free[place] = zero, False
    out[free] = sampled
    return out


def _came_before(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at ``starts``, in order, equal an earlier one of them."""
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    order = suffix_order(text.astype(np.int64) + 1, length)
    order = order[valid[order]]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 50_000):
        a = order[i : i + 50_000]
        same[i : i + len(a)] = (windows[a] == windows[order[i - 1 : i - 1 + len(a)]]).all(axis=1)
    run = np.flatnonzero(~same)
    first = np.repeat(np.minimum.reduceat(order, run), np.diff(np.append(run, len(order))))
    again = np.zeros(len(text), bool)
    again[order] = order != first
    return again[starts]


def _merge(length: int) -> Callable:
    """Contexts sorted by name to spans (d, h, first byte, end) whose windows came before."""

    def classes(rows: dict) -> pa.RecordBatch | None:
        # in the order of documents and positions, in which windows then follow each other in the text
        order = np.lexsort((rows["at"], rows["h"], rows["d"]))
        d, h, at = (rows[k][order] for k in ("d", "h", "at"))
        _, first, last, _ = _unpack(at)
        sizes = last - first + length
        text = np.frombuffer(b"".join(rows["bytes"][i] for i in order), np.uint8)
        begins = np.cumsum(sizes) - sizes
        n = last - first + 1
        row = np.repeat(np.arange(len(d)), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        gone = _came_before(text, begins[row] + inner, length)
        # runs of such windows of one context
        edge = np.append(True, row[1:] != row[:-1])
        on = np.flatnonzero(gone & np.append(True, ~gone[:-1] | edge[1:]))
        off = np.flatnonzero(gone & np.append(~gone[1:] | edge[1:], True))
        if not len(on):
            return None
        r = row[on]
        return _batch(["d", "h", "first", "end"], [d[r], h[r], first[r] + inner[on], first[r] + inner[off] + length])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def cut(rows: dict, s: slice) -> dict:
            return {k: v[s] for k, v in rows.items()}

        for batch in batches:
            rows = {n: batch.column(i).to_numpy() for i, n in enumerate(("key", "d", "h", "at"))} | {"bytes": np.array([*batch.column(4).to_pylist(), None], object)[:-1]}
            held = rows if held is None else {k: np.concatenate([held[k], rows[k]]) for k in rows}
            if sum(map(len, held["bytes"])) >= TOGETHER:
                at = int(np.searchsorted(held["key"], held["key"][-1]))
                if at:
                    out = classes(cut(held, slice(0, at)))
                    held = cut(held, slice(at, None))
                    if out is not None:
                        yield out
        if held is not None and len(held["key"]):
            out = classes(held)
            if out is not None:
                yield out

    return run


WINDOWS = "x bigint, y bigint, d bigint, h bigint, p bigint, bytes binary"


def _windows(length: int, gram: int, bits: int = 64) -> Callable:
    """Contexts of hot samples to their windows, each with two hashes and its bytes."""
    mask = U(2**64 - 1 if bits >= 64 else 2**bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            texts: list[bytes] = []
            for d, h, at, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _, first, last, _ = _unpack(np.int64(at))
                g = gram_hashes(np.frombuffer(raw, np.uint8), gram)
                p = np.arange(last - first + 1)
                parts = [g[np.minimum(p + i, p + length - gram)] for i in range(0, length, gram)]
                x, y = np.full(len(p), 1, U), np.full(len(p), 2, U)
                for v in parts:
                    x, y = _mix(x, v), _mix(v, y ^ (v >> U(17)))
                for o, v in zip(out, ((x & mask).view(np.int64), (y & mask).view(np.int64), np.full(len(p), d), np.full(len(p), h), p + first)):
                    o.append(v)
                texts += [raw[i : i + length] for i in range(len(p))]
            if out[0]:
                columns = [pa.array(np.concatenate(o)) for o in out]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=["x", "y", "d", "h", "p", "bytes"])

    return run


def _later(windows: DataFrame, by: list[str], length: int) -> DataFrame:
    """Spans of the windows (d, h, p) that share ``by`` with an earlier one."""
    first = windows.groupBy(*by).agg(F.min(F.struct("d", "h", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, by).where(F.struct("d", "h", "p") > F.col("first"))
    return later.select("d", "h", F.col("p").alias("first"), (F.col("p") + length).alias("end"))


#: Claims of one document on another, at one distance: they are compared together.
CLAIM = ["d", "h", "d2", "h2", "off"]


def _pieces(claims: DataFrame) -> DataFrame:
    """Blocks of what each document claims: ``n`` bytes from ``p`` on are those of (d2, h2) from ``q`` on."""
    spans = claims.groupBy(*CLAIM).agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("s"))
    spans = spans.select(*CLAIM, F.explode(_merged(F.col("s"))).alias("s")).select(*CLAIM, (F.col("s.first") - F.col("off")).alias("b"), (F.col("s.end") - F.col("off")).alias("e"))
    # blocks end at multiples in the document that is claimed, so that claims share them
    block = F.floor(F.col("b") / BLOCK)
    spans = spans.select("*", F.explode(F.sequence(block, F.floor((F.col("e") - 1) / BLOCK))).alias("i"))
    q, e = F.greatest("b", F.col("i") * BLOCK), F.least("e", (F.col("i") + 1) * BLOCK)
    return spans.select(*CLAIM, q.alias("q"), (e - q).alias("n"), (q + F.col("off")).alias("p"))


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, tables: Tables | None = None, bits: int = 64) -> DataFrame:
    """(d, h, spans): for each document with repeats the merged spans (first, end) to remove.

    ``bits``: how many of a hash's bits tell samples apart; fewer make more work, never other results.
    """
    if not GRAM <= length <= 255 + GRAM:
        raise ValueError(f"length has to be between {GRAM} and {255 + GRAM}")
    bounded_batches(df.sparkSession)
    tables = tables or Tables(df.sparkSession, "substrings")
    docs = _documents(df, key, text)
    look = docs.where(F.pmod(F.xxhash64("d", "h"), F.lit(LOOK)) == 0).mapInArrow(_sample(np.empty(0, U), length, bits), SAMPLE).where(F.col("at").bitwiseAND(F.lit(255)) == SAMPLED)
    seen = tables.keep(look.groupBy("key").agg(F.count("*").alias("n")), "look")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = np.array(sorted(r[0] for r in seen.where(F.col("n") > max(LEAST_HOT, total / HOT)).select("key").collect()), np.int64).view(U)

    sampled = docs.mapInArrow(_sample(hot, length, bits), SAMPLE)
    named = tables.keep(sampled.repartition("key").sortWithinPartitions("key").mapInArrow(_name, FOUND), "named")
    unpacked = [F.shiftright("at", 24).alias("a"), F.shiftright("at", 16).bitwiseAND(F.lit(255)).alias("b"), F.shiftright("at", 8).bitwiseAND(F.lit(255)).alias("e")]
    covered = named.select("kind", "key", "d", "h", *unpacked, "d2", "h2", F.shiftright("at2", 24).alias("a2"))
    covered = covered.selectExpr("kind", "key", "d", "h", "a - b AS first", f"a - e + {length} AS end", "d2", "h2", "a - a2 AS off")
    settled = covered.where(F.col("kind") == SETTLED).select("d", "h", "first", "end")
    claims = covered.where(F.col("kind") == CLAIMED).drop("kind")

    # a document's open samples, and the pieces that it claims or that are claimed of it, are fetched together
    pieces = tables.keep(_pieces(claims), "pieces")
    none = F.lit(0).cast("bigint")
    of_it = [F.lit(PIECE).alias("kind"), F.col("d2").alias("key"), F.col("q").alias("at")]
    wanted = named.where(F.col("kind").isin(SAMPLED, WIDE)).select("d", "h", "kind", "key", "at", none.alias("h2"), none.alias("p"), none.alias("n"))
    wanted = wanted.union(pieces.select("d", "h", *of_it, "h2", "p", "n"))
    wanted = wanted.union(pieces.select("d2", "h2", "q", "n").distinct().select(F.col("d2").alias("d"), F.col("h2").alias("h"), *of_it, "h2", F.col("q").alias("p"), "n"))
    open_ = tables.keep(wanted.groupBy("d", "h").agg(F.collect_list(F.struct("kind", "key", "at", "h2", "p", "n")).alias("found")), "open")

    def fetched(open_: DataFrame, label: str) -> DataFrame:
        # sorted and merged at every size: what is fetched grows with the texts
        return tables.keep(docs.join(open_.hint("merge"), ["d", "h"]).select("d", "h", "text", "found").mapInArrow(_contexts(length), CONTEXT), label)

    contexts = fetched(open_, "contexts")
    merged = contexts.where(F.col("kind") == SAMPLED).select("key", "d", "h", "at", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(_merge(length), SPAN)
    found = settled.union(merged)

    # what is claimed is among the pieces: all of a block are the same if the least and the greatest are
    block = [F.col("key").alias("d2"), F.col("h").alias("h2"), F.col("at").alias("q"), F.col("d").alias("n")]
    compared = contexts.where(F.col("kind") == PIECE).groupBy(*block).agg(F.min("bytes").alias("least"), F.max("bytes").alias("greatest"))
    differ = tables.keep(compared.where("least <> greatest").select("d2", "h2", "q", "n"), "differ")
    if differ.isEmpty():
        found = found.union(claims.select("d", "h", "first", "end"))
    else:
        wrong = tables.keep(pieces.join(differ, ["d2", "h2", "q", "n"]).select(*CLAIM).distinct(), "wrong")
        found = found.union(claims.join(wrong, CLAIM, "left_anti").select("d", "h", "first", "end"))
        # all samples of the names concerned, by the bytes of their windows
        keys = claims.join(wrong, CLAIM, "left_semi").select("key").distinct()
        every = tables.keep(docs.mapInArrow(_sample(hot, length, bits, named=True), SAMPLE), "every")
        names = every.join(keys, "key", "left_semi").select("fine").distinct()
        again = every.join(names, "fine", "left_semi").select("d", "h", F.lit(WIDE).alias("kind"), "key", "at", none.alias("h2"), none.alias("p"), none.alias("n"))
        again = fetched(again.groupBy("d", "h").agg(F.collect_list(F.struct("kind", "key", "at", "h2", "p", "n")).alias("found")), "again")
        found = found.union(_later(again.select("d", "h", "at", "bytes").mapInArrow(_windows(length, GRAM, bits), WINDOWS), ["bytes"], length))

    wide = contexts.where(F.col("kind") == WIDE).select("d", "h", "at", "bytes")
    if not wide.isEmpty():
        # windows of one context follow each other by a byte, so with their bytes they take little room
        by, windows = ["x", "y"], tables.keep(wide.mapInArrow(_windows(length, GRAM, bits), WINDOWS), "windows")
        classes = windows.groupBy(*by).agg(F.min(F.struct("d", "h", "p")).alias("first"), F.min("bytes").alias("least"), F.max("bytes").alias("greatest"), F.count("*").alias("n"))
        first = tables.keep(classes.where("n > 1").selectExpr("x", "y", "first", "least = greatest AS same"), "first")
        later = windows.select(*by, "d", "h", "p").join(first.where("same"), by).where(F.struct("d", "h", "p") > F.col("first"))
        found = found.union(later.select("d", "h", F.col("p").alias("first"), (F.col("p") + length).alias("end")))
        if not first.where("NOT same").isEmpty():
            found = found.union(_later(windows.join(first.where("NOT same").select(*by), by, "left_semi"), ["bytes"], length))
    listed = found.groupBy("d", "h").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("s"))
    return tables.keep(listed.select("d", "h", _merged(F.col("s")).alias("spans")), "spans")


def _merged(s: Column) -> Column:
    """Spans in order, those that touch made one."""
    reach = "aggregate(s, named_struct('done', cast(array() AS array<struct<first:bigint,end:bigint>>), 'first', s[0].first, 'end', s[0].end), (m, x) -> CASE WHEN x.first <= m.end THEN named_struct('done', m.done, 'first', m.first, 'end', greatest(m.end, x.end)) ELSE named_struct('done', concat(m.done, array(named_struct('first', m.first, 'end', m.end))), 'first', x.first, 'end', x.end) END, m -> concat(m.done, array(named_struct('first', m.first, 'end', m.end))))"
    return F.expr(reach)


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(d, h, text); h tells texts of one key apart, and is 0 where each key has one row."""
    rows = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("d"), F.col(text).alias("text"))
    several = not rows.groupBy("d").count().where("count > 1").isEmpty()
    rows = rows.select("d", (F.xxhash64("text") if several else F.lit(0).cast("bigint")).alias("h"), "text")
    return rows.dropDuplicates(["d", "h"]) if several else rows


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, bits: int = 64) -> DataFrame:
    """Add ``n_bytes``, ``spans`` (first, end) removed, and ``kept``, the bytes that remain."""
    tables = Tables(df.sparkSession, "substrings")
    found = spans(df, key, text, length, tables, bits)
    several = not found.where("h <> 0").isEmpty()
    out = df.drop("n_bytes", "spans", "kept").withColumn("_d", F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)).cast("bigint")))
    out = out.withColumn("_h", F.xxhash64(text) if several else F.lit(0).cast("bigint"))
    # merged at every size, as when texts are fetched: spans grow with the texts
    out = out.join(found.withColumnsRenamed({"d": "_d", "h": "_h"}).hint("merge"), ["_d", "_h"], "left").drop("_d", "_h")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = out.withColumn("n_bytes", F.octet_length(raw).cast("bigint")).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<first:bigint,end:bigint>>")))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.col("n_bytes")))
    # each gap is one slice of the bytes; a text without spans is kept as it is
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(F.col("_raw"), (b + 1).cast("int"), (e - b).cast("int")))
    out = out.withColumn("_raw", raw)
    return out.withColumn("kept", F.when(F.size("spans") == 0, F.col("_raw")).otherwise(F.unhex(F.array_join(F.transform(pieces, F.hex), "")))).drop("_raw")
