"""Vector codes: parts of whole-number vectors named by the nearest entry of a codebook.

A component x becomes floor(256 x). A vector is cut into ``PARTS`` equal parts, each position with a codebook of
its own, which begins with the parts of the first vectors by key and is moved to the means of its parts in
``ROUNDS`` passes. A pass assigns in the tasks and adds up (sum, count) of every entry there, so that what is
shuffled is a codebook for each task; the codebooks, ``PARTS`` x ``ENTRIES`` parts of a vector whatever
the number of vectors, come to the driver.

The nearest entry is found by partial distances: a vector's distance to an entry of its own choice is
complete; then dimensions are taken in the order of the codebook's variance, largest first, and an entry is
dropped once what it has so far is strictly above the least complete distance. All is in whole numbers.

Cases: a row with a null vector, or with a null or non-finite component, is left out; a vector shorter than the longest is
followed by zeros, as is one whose length is no multiple of ``PARTS``; vectors without components are coded 0 with error 0;
components are held to what lets an error be a long (``limit``; 92,000 and more for up to 4096 components); of fewer vectors than
``ENTRIES`` all are entries; an entry without parts stays; of equally near entries the first is taken;
repeated rows are vectors of their own, and of equal keys that with the lesser vector is first; a null key comes after all
others; null labels are one label, and a sum of errors beyond a long is null; an empty table gives none; columns that have the
names of results are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables, bounded_batches

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors whose distances are held at once.
TOGETHER = 4096
#: Labels up to which their sums are broadcast; more are joined by label and part of the rows.
FEW, SALTS = 100_000, 16


def usable(vector: str) -> Column:
    """Whether a vector is there and has only finite components."""
    numbers = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(numbers, F.lit(True))


def limit(width: int) -> int:
    """The largest component whose distances, over a whole vector, are below 2**63."""
    return math.isqrt((2**63 - 1) // (4 * max(1, PARTS * width)))


def whole(vectors: pa.Array, width: int, bound: int | None = None) -> np.ndarray:
    """Rows (n, PARTS, width) of floor(256 x), shorter vectors followed by zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = limit(width) if bound is None else bound
    numbers = np.clip(np.floor(flat * SCALE), -bound, bound).astype(np.int64)
    out = np.zeros((len(vectors), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = numbers
    return out.reshape(len(vectors), PARTS, width)


def width_of(df: DataFrame, vector: str) -> int:
    """Components of a part."""
    longest = df.agg(F.max(F.size(vector))).first()[0] or 0
    return -(-longest // PARTS)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest of ``entries`` (k, width) for each of ``x`` (n, width).

    ``at`` and ``entry`` are the (vector, entry) pairs that are still in play, ``so_far`` their distances over the
    dimensions taken. An entry is only dropped when it is strictly above a complete distance, so ties stay to the end.
    """
    n, k = len(x), len(entries)
    if not entries.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-entries.astype(np.float64).var(axis=0), kind="stable")
    first = (x[:, order[0], None] - entries[None, :, order[0]]) ** 2
    guess = first.argmin(axis=1)
    best = ((x - entries[guess]) ** 2).sum(axis=1)
    at, entry = np.nonzero(first <= best[:, None])
    so_far = first[at, entry]
    for step, d in enumerate(order[1:], 1):
        so_far = so_far + (x[at, d] - entries[entry, d]) ** 2
        kept = so_far <= best[at]
        at, entry, so_far = at[kept], entry[kept], so_far[kept]
        if step < len(order) - 1:  # a better complete distance: that of each vector's least so far
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            least = np.repeat(np.minimum.reduceat(so_far, starts), np.diff(np.append(starts, len(at))))
            leads = np.flatnonzero(so_far == least)
            np.minimum.at(best, at[leads], ((x[at[leads]] - entries[entry[leads]]) ** 2).sum(axis=1))
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # every vector has a pair: its nearest
    least = np.minimum.reduceat(so_far, starts)
    tied = np.where(so_far == np.repeat(least, np.diff(np.append(starts, len(at)))), entry, k)
    return np.minimum.reduceat(tied, starts), least


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (n, PARTS) and squared distances (n, PARTS) of vectors (n, PARTS, width)."""
    index, far = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(PARTS):
        for at in range(0, len(x), TOGETHER):
            index[at : at + TOGETHER, p], far[at : at + TOGETHER, p] = nearest(x[at : at + TOGETHER, p], books[p])
    return index, far


def _first(df: DataFrame, key: str, vector: str, width: int) -> np.ndarray:
    """The codebooks to begin with (PARTS, entries, width): of the first vectors by key."""
    order = (F.col("_key").asc_nulls_last(), F.col("_v").asc())
    few = df.select(F.col(key).alias("_key"), F.col(vector).alias("_v")).orderBy(*order).limit(ENTRIES).select("_v").toArrow()
    return np.ascontiguousarray(whole(few.column(0), width).transpose(1, 0, 2))


def _sums(books: np.ndarray, width: int):
    """(part, entry, n, sums) of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                x = whole(batch.column(0).slice(at, TOGETHER), width)
                index, _ = assign(x, books)
                for p in range(PARTS):
                    np.add.at(sums[p], index[:, p], x[:, p])
                    n[p] += np.bincount(index[:, p], minlength=books.shape[1])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part), "entry": pa.array(entry), "n": pa.array(n[part, entry]), "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))})

    return run


def fit(df: DataFrame, key: str, vector: str, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) of the usable vectors; every vector takes part in every round."""
    books = _first(df, key, vector, width)
    if not books.shape[1]:
        return books
    for _ in range(rounds):
        told = df.select(vector).mapInArrow(_sums(books, width), "part bigint, entry bigint, n bigint, sums array<bigint>")
        added = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
        for r in added.collect():  # a row for each entry at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal digits, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _coded(books: np.ndarray, width: int, vector: Column) -> Column:
    """(code, error) of a vector; only the vector travels to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            codes, errors = [], [np.empty(0, np.int64)]
            for at in range(0, len(batch), TOGETHER):
                index, far = assign(whole(batch.slice(at, TOGETHER), width), books)
                codes += [r.tobytes().hex() for r in index.astype(np.uint8)]
                errors.append(far.sum(axis=1))
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], ["code", "error"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<code:string,error:bigint>").asNondeterministic()(vector)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """The usable rows, with ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` instead of the vector."""
    spark = df.sparkSession
    bounded_batches(spark)
    tables = Tables(spark, "codes")
    good = df.where(usable(vector))
    width = width_of(good, vector)
    books = fit(good, key, vector, width, rounds)
    others = [c for c in df.columns if c not in ("code", "error", "label_error", "codebooks_sha256", vector)]
    slim = good.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(label).alias("_label"), _coded(books, width, F.col(vector)).alias("_code"))
    coded = tables.keep(slim.select("_row", "_label", "_code.code", "_code.error"), "coded")
    # a label may have a third of all rows: summed in the tasks first, then met by its sum
    sums = tables.keep(coded.groupBy(F.col("_label").alias("_of")).agg(F.try_sum("error").alias("_sum")), "sums", few=True)
    if sums.limit(FEW + 1).count() <= FEW:
        met = coded.join(F.broadcast(sums), F.col("_label").eqNullSafe(F.col("_of")))
    else:
        dealt = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        salted = coded.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS).cast("bigint")))
        met = salted.join(dealt, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_salt")))
    return met.select(*(F.col(f"_row.`{c}`").alias(c) for c in others), "code", "error", F.col("_sum").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
