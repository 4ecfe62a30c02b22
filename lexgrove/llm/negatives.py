"""Hard negatives: for each anchor and each of its positives, the best rows of other labels within a window of scores.

A score is the inner product of whole-number vectors (components floor(256 x)). Rows are coded by product
quantisation and keep the norm of what each part of the code leaves out. An anchor's table of scores with all codebook
entries gives a row's score as a sum of look-ups; what is missing is at most the sum over the parts of
the anchor's norm times the row's residual norm. Only rows whose bounds allow them are scored by their
whole vectors, in whole numbers, so that the bounds decide about work and never about results.

All anchors meet all rows in blocks: a task has ``ANCHORS`` anchors and a slice of the rows, and keeps
the best of each anchor as it goes; the best of the slices are merged by a window that each task cuts down first. A first pass
finds the positives, whose scores set the windows of the second.

Cases: rows with a null key or label, a null vector, or a null or non-finite component take no part; shorter vectors are
followed by zeros; components are held to what lets 100 scores be a long (``limit``; 75,000 and more for up to 1024
components); a key that is there several times is as many rows, and as many anchors; ties go to the smaller key, then in the
order of the rows; an anchor without positives, and a positive without negatives, have no row; a
positive score below zero has an empty window; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.llm import codes
from lexgrove.llm.common import Tables, bounded_batches

POSITIVES, NEGATIVES = 5, 3
#: Anchors of a block, rows of a slice at most, on average, and the cells (anchor, row) whose bounds are held at once.
ANCHORS, SLICE, ROWS, CELLS = 8192, 65536, 2048, 1 << 19
#: Pairs whose vectors are multiplied at once, and the share of a block, as 1 in so many, from which all of it is.
PAIRS, DENSE = 1 << 16, 32


def limit(width: int) -> int:
    """The largest component with which 100 times a score is below 2**63."""
    return math.isqrt((2**63 - 1) // (100 * max(1, codes.PARTS * width)))


def _prepared(books: np.ndarray, width: int):
    """(key, label, row, anchor, v, code, left): vectors with their codes and the norms of what the codes leave out."""
    names = ["key", "label", "row", "anchor", "v", "code", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, codes.TOGETHER):
                part = batch.slice(at, codes.TOGETHER)
                x = codes.whole(part.column(4), width, limit(width))
                index, far = codes.assign(x, books)
                left = np.nextafter(np.sqrt(far.astype(np.float64)).astype(np.float32), np.float32(np.inf))
                own = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x.astype("<i4").reshape(len(x), -1), index.astype(np.uint8), left)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *own], names=names)

    return run


class _Rows:
    """Rows of a block as arrays."""

    def __init__(self, table: pa.Table, width: int):
        take = lambda name, kind, n: np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, n)
        self.key, self.label, self.row = (table.column(n).to_numpy() for n in ("key", "label", "row"))
        self.v = take("v", "<i4", codes.PARTS * width)
        self.code, self.left = take("code", np.uint8, codes.PARTS), take("left", "<f4", codes.PARTS)

    def __len__(self) -> int:
        return len(self.key)


class _Anchors:
    """Anchors with their tables of scores with all entries, and the norms of their parts."""

    def __init__(self, rows: _Rows, at: slice, books: np.ndarray):
        self.key, self.label, self.row, self.v = rows.key[at], rows.label[at], rows.row[at], rows.v[at].astype(np.int64)
        parts = self.v.reshape(len(self.v), codes.PARTS, -1)
        tables = np.ascontiguousarray(np.einsum("apw,pew->pea", parts, books))  # an entry's scores lie together
        self.most = sum(int(np.abs(t).max(initial=0)) for t in tables)
        self.tables = tables.astype(np.int32) if self.most < 2**31 else tables
        self.norms = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=2))

    def bounds(self, rows: _Rows, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest scores (rows, anchors) that the codes allow."""
        code = rows.code[at]
        score = self.tables[0][code[:, 0]]
        for p in range(1, codes.PARTS):
            score += self.tables[p][code[:, p]]
        off = rows.left[at].astype(np.float64) @ self.norms.T
        off += 1 + (self.most + off.max(initial=0)) * 1e-9  # more than any rounding
        return score - off, score + off

    def pairs(self, rows: _Rows, at: slice, able: np.ndarray, least: np.ndarray, most: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the able pairs whose scores are from ``least`` to ``most``.

        The bounds drop the others; what they leave is scored in whole numbers, by one product of
        matrices where that is much of the block.
        """
        low, high = self.bounds(rows, at)
        left = able & (high >= least) & (low <= most)
        r, a = np.nonzero(left)
        if len(r) * DENSE > left.size:
            x, y = rows.v[at], self.v
            fits = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1] < 2**53
            kind = np.float64 if fits else np.int64  # whole numbers either way
            scores = x.astype(kind) @ y.astype(kind).T
            r, a = np.nonzero(left & (scores >= least) & (scores <= most))
            return r + at.start, a, scores[r, a].astype(np.int64)
        r += at.start
        got = np.empty(len(r), np.int64)
        for i in range(0, len(r), PAIRS):
            got[i : i + PAIRS] = np.einsum("ij,ij->i", rows.v[r[i : i + PAIRS]].astype(np.int64), self.v[a[i : i + PAIRS]])
        return r, a, got


class _Best:
    """The best rows of each anchor so far: higher scores first, then smaller keys, then the order of the rows."""

    def __init__(self, anchors: int, most: int):
        self.most = most
        self.a = self.score = self.key = self.row = np.empty(0, np.int64)
        self.least = np.full(anchors, -np.inf)  # what a row's score has to reach

    def add(self, a: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        a, score, key, row = (np.concatenate(x) for x in ((self.a, a), (self.score, score), (self.key, key), (self.row, row)))
        order = np.lexsort((row, key, -score, a))
        a, score, key, row = a[order], score[order], key[order], row[order]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
        nth = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        kept = nth < self.most
        self.a, self.score, self.key, self.row = a[kept], score[kept], key[kept], row[kept]
        full = nth == self.most - 1
        self.least[a[full]] = score[full]


def _positives(anchors: _Anchors, rows: _Rows, most: int) -> Iterator[dict]:
    best = _Best(len(anchors.key), most)
    for at in range(0, len(rows), ROWS):
        part = slice(at, at + ROWS)
        able = (rows.label[part][:, None] == anchors.label) & (rows.row[part][:, None] != anchors.row)
        r, a, got = anchors.pairs(rows, part, able, best.least, np.inf)
        best.add(a, got, rows.key[r], rows.row[r])
    yield {"anchor_id": anchors.key[best.a], "anchor_row": anchors.row[best.a], "other_id": best.key, "other_row": best.row, "score": best.score}


def _negatives(anchors: _Anchors, rows: _Rows, known: dict[str, np.ndarray], most: int) -> Iterator[dict]:
    """``known`` has the positives of each anchor (anchors, n): key, row, score, and whether there is one."""
    score, there = known["score"], known["there"]
    best = [_Best(len(anchors.key), most) for _ in range(there.shape[1])]
    # all windows of an anchor together, a little wider than they are
    slack = 1 + np.abs(score) * 1e-9
    bottom, top = np.where(there, score / 2 - slack, np.inf), np.where(there, 0.95 * score + slack, -np.inf).max(axis=1)
    for at in range(0, len(rows), ROWS):
        part = slice(at, at + ROWS)
        able = rows.label[part][:, None] != anchors.label
        least = np.maximum(bottom, np.stack([b.least for b in best], axis=1)).min(axis=1)
        r, a, got = anchors.pairs(rows, part, able, least, top)
        for j, b in enumerate(best):
            inside = there[a, j] & (got >= b.least[a]) & (2 * got >= score[a, j]) & (20 * got <= 19 * score[a, j])
            b.add(a[inside], got[inside], rows.key[r[inside]], rows.row[r[inside]])
    for j, b in enumerate(best):
        yield {"anchor_id": anchors.key[b.a], "anchor_row": anchors.row[b.a], "other_id": b.key, "other_row": b.row, "score": b.score, "positive_id": known["key"][b.a, j], "positive_row": known["row"][b.a, j], "positive_score": known["score"][b.a, j]}


FOUND = "anchor_id bigint, anchor_row bigint, other_id bigint, other_row bigint, score bigint"
MINED = FOUND + ", positive_id bigint, positive_row bigint, positive_score bigint"


def _met(books: np.ndarray, width: int, most: int, schema: str, known: bool):
    """A block of anchors and a slice of rows to the best rows of each anchor."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rows, held = _Rows(right, width), _Rows(left, width)
            for at in range(0, len(held), CELLS // ROWS):
                part = slice(at, at + CELLS // ROWS)
                anchors = _Anchors(held, part, books)
                if known:
                    lists = left.column("positives").slice(at, CELLS // ROWS).to_pylist()
                    n = max(len(p) for p in lists)
                    table = {k: np.zeros((len(lists), n), np.int64) for k in ("key", "row", "score")} | {"there": np.zeros((len(lists), n), bool)}
                    for i, p in enumerate(lists):
                        for j, one in enumerate(p):
                            table["key"][i, j], table["row"][i, j], table["score"][i, j], table["there"][i, j] = one["key"], one["row"], one["score"], True
                    found = _negatives(anchors, rows, table, most)
                else:
                    found = _positives(anchors, rows, most)
                out += [pa.table([pa.array(f[c], pa.int64()) for c in names], names=names) for f in found]
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()) for _ in names], names=names)

    return run


def _blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, run, schema: str) -> DataFrame:
    """Every block of anchors with every slice of the rows, each once."""
    blocks = max(1, -(-n_anchors // ANCHORS))
    slices = max(-(-n_rows // SLICE), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS)), 1)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n).cast("bigint"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = anchors.withColumn("_block", part("row", blocks)).withColumn("_slice", every(slices))
    right = rows.withColumn("_slice", part("row", slices)).withColumn("_block", every(blocks))
    return left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice")).applyInArrow(run, schema)


def _first(found: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    """The best of each group with their ranks; Spark cuts every task's groups to as many before they are shuffled."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "other_id", "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds."""
    spark = df.sparkSession
    bounded_batches(spark)
    tables = Tables(spark, "negatives")
    good = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & codes.usable(vector))
    good = good.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("bigint").alias("label"), F.monotonically_increasing_id().alias("row"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).alias("x"))
    width = codes.width_of(good, "x")
    books = codes.fit(good, "key", "x", width)
    rows = tables.keep(good.mapInArrow(_prepared(books, width), "key bigint, label bigint, row bigint, anchor boolean, v binary, code binary, left binary"), "rows")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    asked, rows = tables.keep(rows.where("anchor").drop("anchor"), "asked", few=True), rows.drop("anchor")
    found = _blocks(asked, rows, n_anchors, n, _met(books, width, positives, FOUND, False), FOUND)
    best = _first(found, ("anchor_row",), positives).groupBy("anchor_row").agg(F.collect_list(F.struct(F.col("other_id").alias("key"), F.col("other_row").alias("row"), "score")).alias("positives"))
    ready = tables.keep(asked.join(best, asked.row == best.anchor_row).drop("anchor_row"), "anchors")
    mined = _blocks(ready, rows, n_anchors, n, _met(books, width, negatives, MINED, True), MINED)
    out = _first(tables.keep(mined, "mined"), ("anchor_row", "positive_row"), negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
