"""Near-duplicates by their similarity: SimHash candidates by deletion-variant signatures, each checked exactly.

This is operator 1's method for texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
There about 15 of 100 bits of two SimHash fingerprints differ, so a fingerprint is as wide as it takes:
it is cut into segments, and two texts are candidates if some segment differs by at most one bit.
A segment is indexed by its one-wildcard variants: a variant with its wildcard in one half keeps the other
half whole, so rows meet by that half, and the variants of the rest are made and joined where they met.
Segments have a few bits more than the number of texts has, so that chance brings together a few texts
each at any size; their number follows from the recall wanted at the least similarity. 128 bits outside
the segments tell chance pairs apart, and what is left is checked on the whole sets of shingles.

Texts with equal sets are one node. A variant that more than a few nodes share is not compared pair by
pair: its nodes that are candidates are connected with a leader, and groups are what is so connected. A
node is first compared with few of its leaders, which links a tight group in rows that are linear in it.
A group that this leaves apart is dealt out as pairs of parts of bounded bytes, compared where they meet,
and only a forest of the links comes back. That work grows with the square of the nodes in a group, its
rows with the square of its parts.

Cases: ASCII letters are made small; a text with fewer than five words is one shingle; null, empty and
blank texts have no shingle and are equal to each other; a pair at exactly the least similarity is linked;
a long text is hashed whole, in parts; repeated rows fare alike; a null key links nothing; an empty table
gives none; columns other than the key and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm import simhash
from lexgrove.llm.common import Tables, arrow_column, bit_sums, bounded_batches, shingle_hashes
from lexgrove.llm.graph import components

SHINGLE, SEED = 5, 42
#: Least similarity of a link, as a fraction, and recall of the candidates there.
LEAST, RECALL = (4, 5), 0.999
#: Nodes of a variant that are compared pair by pair at most; leaders that a node of a larger one is compared with first.
CROWD, LEADERS = 4, 4
#: Bits that are compared outside the segments, in two words.
CHECK = 128
#: Shingles of a part of a group.
PART = 100_000
SIGNATURE = pa.struct([("node", pa.int64()), ("segments", pa.list_(pa.int64())), ("check", pa.int64()), ("more", pa.int64())])
SET = pa.struct([("node", pa.int64()), ("shingles", pa.binary())])


@dataclass(frozen=True)
class Design:
    """``segments`` of ``width`` bits (an even number), and different bits of CHECK that a candidate has at most."""

    width: int
    segments: int
    allowed: int

    @classmethod
    def of(cls, n: int, least: float = LEAST[0] / LEAST[1], recall: float = RECALL) -> Design:
        """For ``n`` texts. Sets of one size with Jaccard similarity j have cosine 2j / (1 + j); of others, more."""
        differ = math.acos(2 * least / (1 + least)) / math.pi
        width = 2 * math.ceil((math.log2(max(n, 2**12)) + 2) / 2)
        found = (1 - differ) ** width + width * differ * (1 - differ) ** (width - 1)
        segments = math.ceil(math.log(1 - recall) / math.log(1 - found))
        return cls(width, segments, math.ceil(CHECK * differ + 4.5 * math.sqrt(CHECK * differ * (1 - differ))))

    @property
    def words(self) -> int:
        """64-bit words of a fingerprint: the check, then the segments."""
        return CHECK // 64 + -(-self.width * self.segments // 64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = [np.empty(0, np.uint64), *map(np.unique, shingle_hashes(text, SHINGLE, SEED))]
    return np.unique(np.concatenate(found))


def _node(h: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(h.tobytes(), SEED)
    return x - 2**64 if x >> 63 else x


def fingerprint(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Bits of the SimHash of a set of hashes, 64 for each column of ``times`` (2, words)."""
    ones = np.zeros(64 * times.shape[1], np.int64)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * times[0]
        x ^= x >> np.uint64(32)
        x *= times[1]
        x ^= x >> np.uint64(32)
        ones += bit_sums(x)
    return 2 * ones > len(h)


def _signatures(design: Design):
    def make():
        times = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, design.words), np.uint64) | np.uint64(1)
        place = np.int64(1) << np.arange(design.width, dtype=np.int64)
        numbers = np.arange(design.segments, dtype=np.int64) << design.width

        def one(text: str | None) -> dict:
            h = shingles(text)
            if not len(h):
                return {"node": _node(h), "segments": [], "check": 0, "more": 0}
            bits = fingerprint(h, times)
            check, more = np.packbits(bits[:CHECK], bitorder="little").view("<i8").tolist()
            values = bits[CHECK : CHECK + design.width * design.segments].reshape(design.segments, -1) @ place
            return {"node": _node(h), "segments": (numbers + values).tolist(), "check": check, "more": more}

        return one

    return make


def _sets():
    def one(text: str | None) -> dict:
        h = shingles(text)
        return {"node": _node(h), "shingles": h.tobytes()}

    return one


#: What met: nodes (b) that are candidates with a node (a), that have a leader (a), or are members of a variant (a) that is not held.
PAIR, LED, MEMBER = 0, 1, 2
MET = "kind int, a bigint, b array<bigint>"


def _met(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(b)).astype(np.int32)), pa.array(b))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(start), kind, np.int32)), pa.array(a[start]), lists], names=["kind", "a", "b"])


def _variant_names(variant: np.ndarray, bit: int) -> np.ndarray:
    x = (variant.view(np.uint64) ^ np.uint64(bit + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)).view(np.int64)


def _connected(node: np.ndarray, check: np.ndarray, allowed: int) -> Iterator[np.ndarray]:
    """Edges (leader, node) that connect whatever nodes of a variant are candidates, and only those."""
    while len(node) > 1:
        first = int(node.argmin())
        near = np.bitwise_count(check ^ check[first]).sum(axis=1) <= allowed
        near[first] = False
        yield np.stack([np.full(int(near.sum()), node[first]), node[near]], axis=1)
        left = ~near
        left[first] = False
        mine = np.flatnonzero(near)
        for x in np.flatnonzero(left).tolist() if len(mine) else ():
            also = mine[np.bitwise_count(check[mine] ^ check[x]).sum(axis=1) <= allowed]
            if len(also):
                yield np.array([[node[also].min(), node[x]]])
        node, check = node[left], check[left]


def _spanning(edges: np.ndarray) -> np.ndarray:
    """A spanning forest of edges (leader, node), from the least leaders on."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    names, ends = np.unique(edges, return_inverse=True)
    root, kept = list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (x, y) in enumerate(ends.reshape(-1, 2).tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return edges[kept]


def _meet(design: Design, held_at_most: int):
    """Sorted rows (k, node, check, more) to what met there.

    The upper bits of k are a half that rows share; each bit of the lower half in turn is the wildcard. A half
    with more than ``held_at_most`` rows is never held: its rows are passed on as members of their variants.
    """
    half = design.width // 2

    def members(k: np.ndarray, node: np.ndarray, *_: np.ndarray) -> Iterator[pa.RecordBatch]:
        for bit in range(half):
            yield _met(MEMBER, _variant_names(k & ~np.int64(1 << bit), bit), node)

    def done(k: np.ndarray, node: np.ndarray, check: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        led = [np.empty((0, 2), np.int64)]
        for bit in range(half):
            variant = k & ~np.int64(1 << bit)
            order = np.argsort(variant, kind="stable")
            v, n, c, d = variant[order], node[order], check[order], more[order]
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            size = np.diff(np.append(start, len(v)))
            large = np.repeat(size > CROWD, size)
            if large.any():
                for i, m in zip(start[size > CROWD].tolist(), size[size > CROWD].tolist()):
                    led += _connected(n[i : i + m], np.stack([c[i : i + m], d[i : i + m]], axis=1).view(np.uint64), design.allowed)
                order, v, n, c, d = (x[~large] for x in (order, v, n, c, d))
            for lag in range(1, CROWD):
                at = np.flatnonzero(v[lag:] == v[:-lag]) if lag < len(v) else ()
                if not len(at):
                    break
                # equal halves are met with the first wildcard only
                differ = sum(np.bitwise_count((x[at] ^ x[at + lag]).view(np.uint64)).astype(int) for x in (c, d))
                at = at[(differ <= design.allowed) & ((k[order[at]] != k[order[at + lag]]) | (bit == 0))]
                if len(at):
                    yield _met(PAIR, np.minimum(n[at], n[at + lag]), np.maximum(n[at], n[at + lag]))
        found = _spanning(np.concatenate(led))
        if len(found):
            yield _met(LED, found[:, 0], found[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held = None, [np.empty(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
            if not len(held[0]):
                continue
            shared = held[0] >> half
            if hot is not None:
                n = int(np.searchsorted(shared, hot, "right"))
                yield from members(*(x[:n] for x in held))
                held, shared = [x[n:] for x in held], shared[n:]
                if not len(shared):
                    continue
                hot = None
            cut = int(np.searchsorted(shared, shared[-1]))
            for s in range(0, cut, 65_536):  # halves that one part cuts in two are met again in the next
                begin = int(np.searchsorted(shared, shared[s]))
                yield from done(*(x[begin : int(np.searchsorted(shared, shared[min(cut, s + 65_536) - 1], "right"))] for x in held))
            held = [x[cut:] for x in held]
            if len(held[0]) > held_at_most:
                hot = held[0][0] >> half
                yield from members(*held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from done(*held)

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes, in order, have the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        found = [similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(found, pa.bool_()))


def _sets_of(wanted: DataFrame, source: DataFrame, tables: Tables) -> DataFrame:
    """(node, shingles) of the wanted (node, least)."""
    made = source.join(tables.keep(wanted, "wanted"), F.col("_key") == F.col("least")).select("node", arrow_column(_sets, SET, "struct<node:bigint,shingles:binary>", F.col("_text")).alias("s"))
    # rows may share a key; only a node's own text counts
    made = tables.keep(made.where("node = s.node").select("node", "s.shingles"), "made")
    sets = tables.keep(made.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")
    tables.drop(made)
    return sets


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, tables: Tables) -> DataFrame:
    """The pairs (a, b) of nodes that are similar."""
    pairs = tables.keep(pairs, "pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node"), source, tables)
    of = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"]
    bounded_batches(pairs.sparkSession)
    links = tables.keep(pairs.join(of[0], "a").join(of[1], "b").select("a", "b", "sa", "sb").mapInArrow(_check, "a bigint, b bigint"), "links")
    tables.drop(sets)
    return links


def _forest(part: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]]) -> tuple[list[int], list[int]]:
    """Links (a, b) between two parts, or within one, that connect what was apart. A part: nodes, sets, roots."""
    left, right = part[0], part[-1]
    joined = np.concatenate(right[1])
    sizes = np.array([len(x) for x in right[1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], owner[order]
    names = {r: i for i, r in enumerate(np.unique(np.concatenate([left[2], right[2]])).tolist())}
    mine, theirs = (np.array([names[r] for r in x[2].tolist()]) for x in (left, right))
    label = np.arange(len(names))
    a, b = [], []
    for i, h in enumerate(left[1]):
        low, high = np.searchsorted(joined, h, "left"), np.searchsorted(joined, h, "right")
        n = high - low
        at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        near = np.flatnonzero((LEAST[1] * both >= LEAST[0] * (len(h) + sizes - both)) & (label[theirs] != label[mine[i]]))
        for j in near.tolist():
            x, y = label[mine[i]], label[theirs[j]]
            if x != y:
                a.append(int(left[0][i]))
                b.append(int(right[0][j]))
                label[label == y] = x
    return a, b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, i, j, part, node, root, shingles) to links that connect what was apart."""
    block, rows = None, []

    def done() -> Iterator[pa.RecordBatch]:
        parts = [(np.array([r[1] for r in own]), [r[3] for r in own], np.array([r[2] for r in own])) for p in sorted({r[0] for r in rows}) if (own := [r for r in rows if r[0] == p])]
        if len(parts) == (1 if block[1] == block[2] else 2):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _forest(parts)], names=["a", "b"])

    for batch in batches:
        numbers = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
        for x, s in zip(numbers, batch.column(6)):
            if x[:3] != block:
                if rows:
                    yield from done()
                block, rows = x[:3], []
            rows.append((*x[3:], np.frombuffer(s.as_buffer().to_pybytes(), np.uint64)))
    if rows:
        yield from done()


def _grouped(own: DataFrame, nodes: DataFrame, source: DataFrame, tables: Tables) -> DataFrame:
    """Links within groups (node, group, root) that connect several roots."""
    sets = _sets_of(own.select("node").join(nodes, "node"), source, tables)
    sized = tables.keep(own.join(sets, "node").withColumn("n", F.length("shingles") / 8), "sized")
    parts = tables.keep(sized.groupBy("group").agg(F.ceil(F.sum("n") / PART).alias("k")), "parts")
    dealt = sized.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node"), "k"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    dealt = dealt.select("group", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "node", "root", "shingles")
    found = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "part").mapInArrow(_blocks, "a bigint, b bigint")
    return tables.keep(found, "found")


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id): the least key reachable by links, for every row; null for null keys."""
    spark = df.sparkSession
    tables = Tables(spark, "near")
    source = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    n = df.count()
    design = Design.of(n)
    signed = source.select("_key", arrow_column(_signatures(design), SIGNATURE, "struct<node:bigint,segments:array<bigint>,check:bigint,more:bigint>", F.col("_text")).alias("s"))
    rows = tables.keep(signed.select("_key", "s.node", "s.segments", "s.check", "s.more"), "signatures")
    keyed = rows.where("_key IS NOT NULL")
    nodes = tables.keep(keyed.groupBy("node").agg(F.min("_key").alias("least"), F.any_value("segments").alias("segments"), F.any_value("check").alias("check"), F.any_value("more").alias("more")), "nodes")

    # each segment twice: with its upper half above its lower one, and the other way round
    width, half = design.width, design.width // 2
    low, twice = F.lit(2**half - 1), F.lit(2 ** (width + 1))
    number = lambda s: F.shiftright(s, width)
    value = lambda s: s.bitwiseAND(F.lit(2**width - 1))
    turned = lambda s: F.shiftleft(value(s).bitwiseAND(low), half) + F.shiftright(value(s), half)
    both = F.concat(F.transform("segments", lambda s: number(s) * twice + value(s)), F.transform("segments", lambda s: number(s) * twice + F.lit(2**width) + turned(s)))
    entries = nodes.select(F.explode(both).alias("k"), "node", "check", "more")
    bounded_batches(spark)
    met = entries.repartition(F.shiftright("k", half)).sortWithinPartitions("k").mapInArrow(_meet(design, 16 * (n >> half) + 65_536), MET)
    met = tables.keep(met, "met")
    of = lambda kind, a, b: met.where(F.col("kind") == kind).select(F.col("a").alias(a), F.explode("b").alias(b))
    members = of(MEMBER, "entry", "node")
    leaders = tables.keep(members.groupBy("entry").agg(F.min("node").alias("leader")), "leaders")
    led = of(LED, "a", "b").union(members.join(leaders, "entry").where("node <> leader").select("leader", "node"))
    led = tables.keep(led.distinct(), "led")
    least = nodes.select("node", "least")
    few = led.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("a")), 1, LEADERS).alias("a")).select(F.explode("a").alias("a"), "b")
    links = _verified(of(PAIR, "a", "b").union(few).distinct(), least, source, tables)

    roots = tables.keep(components(links, tables).withColumnRenamed("node", "n"), "roots")
    groups = components(led, tables).withColumnRenamed("root", "group")
    rooted = tables.keep(groups.join(roots, F.col("node") == F.col("n"), "left").select("node", "group", F.coalesce("root", "node").alias("root")), "rooted")
    apart = rooted.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("group")
    left = tables.keep(rooted.join(tables.keep(apart, "apart"), "group"), "left")
    if not left.isEmpty():
        more = _grouped(left, least, source, tables)
        links = roots.select(F.col("n").alias("a"), F.col("root").alias("b")).where("a <> b").union(more)
        roots = tables.keep(components(links, tables).withColumnRenamed("node", "n"), "roots")
    joined = tables.keep(least.join(roots, F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "joined")
    first = tables.keep(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of = tables.keep(joined.join(first, "root").select("node", "component_id"), "components")
    found = keyed.join(of, "node").select(F.col("_key").alias(key), "component_id")
    return found.union(rows.where("_key IS NULL").select("_key", F.lit(None).cast(found.schema["component_id"].dataType)))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep the row of the least key of each component, as ``simhash.deduplicate`` does."""
    return simhash.deduplicate(df, key, text, cluster(df, key, text))
