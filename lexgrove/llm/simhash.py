"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, one for each bit of the XXH64 hashes of a text's word shingles: 1 if it
is set in over half of them. Two fingerprints with at most 3 different bits agree, in one of their
two halves, in all bits but at most one. So each half is indexed once for each of its bits left
out; equal entries are compared in full.

An entry that many fingerprints share is not compared pair by pair. Its members are indexed again
by all but 3 of 16 segments of 4 bits, whichever 3 they are: linked fingerprints agree in one of
those, and no such entry can have more than 4096 members, however large the input.

Equal fingerprints are one node, so copies cost one row each. A link found in several entries is
reported in one of them.

Cases: a null or empty text, or one without words, has fingerprint zero, which is linked like any
other; a text with fewer words than a shingle is one shingle; a long text is hashed whole, in parts; a bit
set in exactly half the hashes is 0; repeated rows are rows of their own
with equal results; a null key never names a component that has another key; an empty table gives
none; columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables, arrow_column, bit_sums, shingle_hashes
from lexgrove.llm.graph import components

#: Words of a shingle, hash seed, and bits that may differ.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of an entry that are compared pair by pair at most.
CROWD = 32
#: Fingerprints whose entries one task makes, about.
DEALT = 1 << 15
HALF = 32
SEGMENTS, SEGMENT = 16, 4
LEFT_OUT = list(combinations(range(SEGMENTS), 3))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit integer."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, shingle, seed):
        n += len(h)
        ones += bit_sums(h[:, None])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed 64-bit integer."""
    return df.withColumn(name, arrow_column(lambda: fingerprint, pa.int64(), "bigint", F.col(text)))


def digits(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _half_entries(fp: Column) -> Column:
    """For each half and bit: (half * 32 + bit) in the upper bits and the half without that bit."""

    def entries(half: int) -> Column:
        value = F.shiftrightunsigned(fp, HALF * half).bitwiseAND(F.lit(2**HALF - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda b: (F.lit(half * HALF) + b).cast("bigint") * F.lit(2**HALF) + value - value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))

    return F.concat(entries(0), entries(1))


def _links_of_halves(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of an entry are links that are reported there."""
    x = a ^ b
    low, high = x & np.uint64(2**HALF - 1), x >> np.uint64(HALF)
    tag = key >> np.int64(HALF)
    # the lower half where it will do; a half without a difference at its bit 0
    in_low = np.bitwise_count(low) <= 1
    part = np.where(in_low, low, high)
    bit = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1)))
    return (np.bitwise_count(x) <= DISTANCE) & (tag == np.where(in_low, 0, HALF) + bit)


EDGES = "a bigint, b bigint"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _compare_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of small entries as (a, b); members of crowds as (a, a)."""
    crowd = None  # key of a crowd whose first part has been passed on
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        large = np.repeat((size > CROWD) | (key[start] == crowd if crowd is not None else False), size)
        if large.any():
            yield _edges(fp[large], fp[large])
        key, fp = key[~large], fp[~large]
        for lag in range(1, CROWD):
            at = np.flatnonzero(key[lag:] == key[:-lag]) if lag < len(key) else ()
            if not len(at):
                break
            at = at[_links_of_halves(key[at], fp[at], fp[at + lag])]
            if len(at):
                yield _edges(fp[at], fp[at + lag])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        yield from done(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
        if len(key) > CROWD:  # the last entry is a crowd, wherever it ends
            yield _edges(fp, fp)
            crowd, key, fp = key[0], key[:0], fp[:0]
    yield from done(key, fp)


def _segment_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each 3 segments left out: (which, what is left) of each fingerprint."""
    masks = np.array([2**64 - 1 - sum(15 << SEGMENT * s for s in out) for out in LEFT_OUT], np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fp), 2048):
            part = fp[i : i + 2048]
            kept = (part[:, None] & masks).ravel()
            which = np.tile(np.arange(len(masks), dtype=np.int64), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(kept.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["which", "kept", "fp"])


def _forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among an entry's members."""
    todo, a, b = np.ones(len(fp), bool), [], []
    for i in range(len(fp)):
        if not todo[i]:
            continue
        todo[i], stack = False, [i]
        while stack:
            j = stack.pop()
            new = np.flatnonzero(todo & (np.bitwise_count(fp ^ fp[j]) <= DISTANCE))
            todo[new] = False
            stack += new.tolist()
            a += [fp[j]] * len(new)
            b += fp[new].tolist()
    return np.array(a, np.uint64), np.array(b, np.uint64)


def _compare_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the entries; an entry has at most 16 ** 3 members."""
    held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]

    def done(which: np.ndarray, kept: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (kept[1:] != kept[:-1])))
        ends = np.append(start[1:], len(fp))
        for s, e in zip(start[ends - start > 1], ends[ends - start > 1]):
            a, b = _forest(fp[s:e])
            if len(a):
                yield _edges(a, b)

    for batch in batches:
        held = [np.concatenate([x, batch.column(i).to_numpy().view(x.dtype)]) for i, x in enumerate(held)]
        if not len(held[0]):
            continue
        other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from done(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield from done(*held)


def links(nodes: DataFrame, tables: Tables, name: str = "fp") -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect whatever links connect."""
    fp = F.col(name)
    # nodes are few bytes, but make 64 rows each: they are dealt out by their number, which no rule about bytes undoes
    dealt = nodes.select(fp.alias("fp")).repartition(max(1, -(-nodes.count() // DEALT)), "fp")
    entries = dealt.select(F.explode(_half_entries(F.col("fp"))).alias("key"), "fp")
    found = tables.keep(entries.repartition("key").sortWithinPartitions("key").mapInArrow(_compare_halves, EDGES), "halves", few=True)
    crowded = tables.keep(found.where("a = b").select("a").distinct(), "crowded")
    finer = crowded.mapInArrow(_segment_entries, "which bigint, kept bigint, fp bigint")
    more = finer.repartition("which", "kept").sortWithinPartitions("which", "kept").mapInArrow(_compare_segments, EDGES)
    return found.where("a <> b").union(more)


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): the least key reachable by links, for every row."""
    tables = Tables(df.sparkSession, "simhash")
    rows = tables.keep(fingerprints(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", "fp").select("_key", "fp"), "fingerprints", few=True)
    nodes = tables.keep(rows.groupBy("fp").agg(F.min("_key").alias("least")), "nodes")
    roots = tables.keep(components(links(nodes, tables), tables), "roots")
    joined = tables.keep(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = tables.keep(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = tables.keep(joined.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select(F.col("_key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """Keep one row of each component: that of the least key; all columns stay.

    Of rows that share that key the one with the least text hash stays. Rows without a key are
    kept, as nothing tells them apart. ``found`` has components of another kind (key, component_id).
    """
    tables = Tables(df.sparkSession, "simhash-kept")
    found = cluster(df, key, text) if found is None else found
    kept = tables.keep(found.where((F.col(key) == F.col("component_id")) | F.col(key).isNull()).groupBy(F.col(key).alias("_kept")).agg(F.count("*").alias("_rows")), "kept")
    # what is kept grows with the corpus, so it is never broadcast, even where it happens to be small
    out = df.join(kept.hint("merge"), F.col(key).eqNullSafe(F.col("_kept"))).drop("_kept")
    if not kept.where("_kept IS NOT NULL AND _rows > 1").isEmpty():
        least = "row_number() OVER (PARTITION BY {} ORDER BY xxhash64({}))".format(f"`{key}`", f"`{text}`")
        out = out.withColumn("_nth", F.expr(least)).where(F.col(key).isNull() | (F.col("_nth") == 1)).drop("_nth")
    return out.drop("_rows")
