"""Embedding near-duplicates by collision counting on one-dimensional projections.

A unit vector is projected on many random lines. In each of ``tables`` tables all vectors are sorted by the
grid cells of some projections and, within equal cells (a block), by their place on one more projection. A
pair collides in a table if it shares the block and one's place is within a window centred on the other's.
Each pair's collisions are counted over all tables; pairs with at least ``needed`` of them are verified by
their cosine, in the first table where they collide.

The cells are there because the windows of a bare projection cannot be narrow: places of vectors of
cosine 0.9 differ by 0.45 deviations, those of any two by 1.41, so a window that finds the former holds
a constant share of all vectors, and counting would take time in the square of their number. With cells, a
window holds a bounded number of vectors at any size. Grid and window follow from the least cosine, the
number of cells from the number of vectors, and the tables from the recall wanted: they are as many as give
a pair at the least cosine ``needed`` collisions with that probability.

Equal vectors are one node with a number. A block larger than ``CHUNK`` is dealt out as pairs of
chunks, each a task's unit of work: no pair is emitted, only each vector's number of links and the
edges of a spanning forest.

Cases: a vector that is null or zero, or has a null or non-finite component, links with nothing, as
do vectors of another length; components of any finite size count, as vectors are scaled before their
norm is taken; a pair at exactly the least cosine is linked; a null id is a row of its own that names no component; repeated rows
are vectors of their own; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables, bounded_batches
from lexgrove.llm.graph import components

LEAST = 0.9
#: Recall at the least cosine that the tables are made for, and collisions that a pair needs.
RECALL, NEEDED = 0.97, 2
#: Vectors of a block on average, and cell width and half window in units of a projection's deviation.
OCCUPANCY, CELL, REACH = 64, 1.6, 1.0
CHUNK = 1024
#: Windows are looked up a little wider, so that rounding decides nothing.
SLACK = 1e-4


@dataclass(frozen=True)
class Design:
    """Tables, projections of a block's key, and collisions needed, for vectors of ``dim`` numbers."""

    dim: int
    tables: int
    keys: int
    needed: int
    least: float = LEAST
    seed: int = 7

    @classmethod
    def of(cls, n: int, dim: int, least: float = LEAST, recall: float = RECALL) -> Design:
        normal = NormalDist()
        # of two places on a unit projection: near ones differ by a normal of deviation s, far ones by sqrt(2)
        s = math.sqrt(2 - 2 * least)
        same_near = 1 - s * math.sqrt(2 / math.pi) / CELL
        far = sum(max(0.0, CELL - abs(d)) / CELL * math.exp(-d * d / 4) / math.sqrt(4 * math.pi) * 0.01 for d in np.arange(-CELL, CELL, 0.01))
        keys = max(2, round(math.log(max(2.0, n / OCCUPANCY)) / -math.log(far)))
        near = same_near**keys * (2 * normal.cdf(REACH / s) - 1)
        tables, needed = max(8, math.ceil(math.log(1 - recall) / math.log(1 - near))), NEEDED
        while sum(math.comb(tables, i) * near**i * (1 - near) ** (tables - i) for i in range(needed)) > 1 - recall:
            tables += 1
        return cls(dim, tables, keys, needed, least)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Projections (dim, tables * (keys + 1)) and the offsets of the grids."""
        rng = np.random.default_rng(self.seed)
        m = self.tables * (self.keys + 1)
        return np.rint(rng.standard_normal((self.dim, m)) * 1024), rng.random(m) * CELL

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the blocks and places, both (rows, tables).

        The products are of whole numbers, so that they are exact and do not depend on the batch.
        """
        lines, offsets = self.lines()
        z = (np.rint(unit * 32767) @ lines).reshape(len(unit), self.tables, self.keys + 1) / (32767 * 1024)
        cells = np.floor((z + offsets.reshape(1, self.tables, -1)) / CELL).astype(np.int64)[:, :, : self.keys]
        code = np.zeros(cells.shape[:2], np.uint64)
        for i in range(self.keys):
            code = (code ^ cells[:, :, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code.view(np.int64), z[:, :, self.keys].astype(np.float32)


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors; first scaled by a power of two, which is exact, so that no square is too large or small."""
    unit = raw.astype(np.float64)
    unit = np.ldexp(unit, -np.frexp(np.abs(unit).max(axis=1, initial=0))[1][:, None])
    return unit / np.linalg.norm(unit, axis=1)[:, None]


def _codes(design: Design, number: str):
    """id, many, the vector's bytes, and its code in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.ascontiguousarray(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, design.dim), number)
                codes, _ = design.place(_units(x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * design.tables), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), lists], names=["id", "many", "v", "codes"])

    return run


def _pairs(design: Design, left: dict, right: dict | None, t: int) -> np.ndarray:
    """Which pairs of a block (rows of ``left`` by rows of ``right`` or of itself) are links counted here.

    The block is sorted by its table's places; only pairs within a window are looked at.
    """
    other = right or left
    order = np.argsort(other["places"][:, t], kind="stable")
    sorted_places = other["places"][order, t]
    if right is None:
        rows, low = order, np.arange(len(order)) + 1  # each pair once: the other one lies behind
    else:
        rows = np.arange(len(left["id"]))
        low = np.searchsorted(sorted_places, left["places"][:, t] - np.float32(REACH + SLACK), "left")
    high = np.searchsorted(sorted_places, left["places"][rows, t] + np.float32(REACH + SLACK), "right")
    n = np.maximum(high - low, 0)
    out = [np.empty((2, 0), np.int64)]
    ends = np.cumsum(n)
    for s in range(0, len(rows), 256):
        m = n[s : s + 256]
        a = np.repeat(rows[s : s + 256], m)
        b = order[np.arange(len(a)) - np.repeat(ends[s : s + 256] - m - (ends[s - 1] if s else 0), m) + np.repeat(low[s : s + 256], m)]
        met = (left["codes"][a] == other["codes"][b]) & (np.abs(left["places"][a] - other["places"][b]) <= REACH)
        # enough collisions, the first of them here
        passed = met[:, t] & (met.sum(axis=1) >= design.needed) & ~met[:, :t].any(axis=1)
        a, b = a[passed], b[passed]
        good = np.einsum("ij,ij->i", left["unit"][a], other["unit"][b]) >= design.least
        out.append(np.stack([a[good], b[good]]))
    return np.concatenate(out, axis=1)


FOUND = "id bigint, links bigint, to bigint"


def _scan(design: Design, number: str):
    """Blocks, or pairs of chunks, in sorted order to links of each vector and edges of forests."""

    def load(batch: pa.RecordBatch) -> dict:
        unit = _units(np.frombuffer(b"".join(batch.column(7).to_pylist()), number).reshape(batch.num_rows, -1))
        codes, places = design.place(unit)
        own = {n: batch.column(c).to_numpy() for c, n in enumerate(("t", "code", "i", "j", "chunk", "id", "many"))}
        return own | {"unit": unit, "codes": codes, "places": places}

    def cut(rows: dict, s: slice | np.ndarray) -> dict:
        return {k: v[s] for k, v in rows.items()}

    def block(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        t, i, j = int(rows["t"][0]), rows["i"][0], rows["j"][0]
        if i == j:
            left, right = rows, None
        else:
            left, right = cut(rows, rows["chunk"] == i), cut(rows, rows["chunk"] == j)
            if not len(left["id"]) or not len(right["id"]):
                return
        other = right or left
        a, b = _pairs(design, left, right, t)
        if not len(a):
            return
        n, m = len(left["id"]), len(other["id"])
        links = np.bincount(a, weights=other["many"][b], minlength=n)
        back = np.bincount(b, weights=left["many"][a], minlength=m)
        ids, count = (left["id"], links + back) if right is None else (np.append(left["id"], right["id"]), np.append(links, back))
        # each vector's least neighbour within the block is not enough: a forest of all its links
        base = 0 if right is None else n
        root = np.arange(n + (m if right is not None else 0))
        while True:  # least labels spread along the links and by jumping
            was = root.copy()
            low = np.minimum(root[a], root[b + base])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b + base, low)
            root = root[root]
            if (root == was).all():
                break
        yield ids, count.astype(np.int64), ids[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        empty = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = load(batch)
            held = rows if held is None else {k: np.concatenate([held[k], rows[k]]) for k in rows}
            keys = np.stack([held[k] for k in ("t", "code", "i", "j")])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s > 1:
                    for x in block(cut(held, slice(s, e))):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["id", "links", "to"])
            held, empty = cut(held, slice(starts[-1], None)), False
        if not empty and len(held["id"]) > 1:
            for x in block(held):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["id", "links", "to"])

    return run


def _usable(vector: str):
    x = F.col(vector)
    numbers = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & numbers & F.exists(x, lambda c: c != 0), F.lit(False))


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    spark = df.sparkSession
    bounded_batches(spark)
    tables = Tables(spark, "embeddings")
    kind = "float" if df.schema[vector].dataType.elementType.typeName() == "float" else "double"
    number = "<f4" if kind == "float" else "<f8"
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast(f"array<{kind}>").alias("_v")).withColumn("_good", _usable("_v"))
    # negative zeros are zeros; vectors are equal as texts of their numbers
    rows = rows.withColumn("_v", F.when(F.col("_good"), F.transform("_v", lambda c: c + F.lit(0.0).cast(kind))))
    rows = tables.keep(rows.select("_key", "_v", "_good", F.monotonically_increasing_id().alias("_row")), "rows")
    good = rows.where("_good").withColumn("_dim", F.size("_v"))
    nodes = tables.keep(good.groupBy("_v", "_dim").agg(F.min("_row").alias("id"), F.count("*").alias("many"), F.min("_key").alias("least")), "nodes")

    links, edges = None, None
    for r in nodes.groupBy("_dim").agg(F.count("*").alias("n")).collect():  # one row for each length of vectors
        design = Design.of(r["n"], r["_dim"], least, recall)
        placed = tables.keep(nodes.where(F.col("_dim") == r["_dim"]).select("id", "many", "_v").mapInArrow(_codes(design, number), "id bigint, many bigint, v binary, codes array<bigint>"), "placed")
        entries = placed.select("id", F.posexplode("codes").alias("t", "code"))
        sizes = tables.keep(entries.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        shared = entries.join(sizes, ["t", "code"]).withColumn("k", F.ceil(F.col("n") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("k")))
        # of k chunks, a vector meets each, and its own
        met = shared.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
        dealt = met.join(placed.select("id", "many", "v"), "id").select("t", "code", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "id", "many", "v")
        found = dealt.repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j").mapInArrow(_scan(design, number), FOUND)
        found = tables.keep(found, "found")
        l, e = found.groupBy("id").agg(F.sum("links").alias("links")), found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))
        links, edges = (l, e) if links is None else (links.union(l), edges.union(e))
    nodes = nodes.select("_v", "id", "many", "least")
    if links is None:
        known = nodes.select("_v", F.lit(0).cast("bigint").alias("n_links"), F.col("least").alias("component_id"))
    else:
        roots = tables.keep(components(edges, tables), "roots")
        joined = nodes.join(tables.keep(links, "links"), "id", "left").join(roots, nodes.id == roots.node, "left").withColumn("root", F.coalesce("root", "id"))
        joined = tables.keep(joined.select("_v", "least", "root", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "joined")
        of = tables.keep(joined.groupBy("root").agg(F.min("least").alias("component_id")), "components")
        known = joined.join(of, "root").select("_v", "n_links", "component_id")
    known = tables.keep(known, "known")
    out = rows.where("_good").join(known, "_v").select("_key", "n_links", "component_id")
    out = out.union(rows.where("NOT _good").select("_key", F.lit(0).cast("bigint"), "_key"))
    return out.select(F.col("_key").alias(key), "n_links", "component_id", (F.col("_key") == F.col("component_id")).alias("kept"))
