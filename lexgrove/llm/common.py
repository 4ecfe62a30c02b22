"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.sources.store import shared_folder


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file: in ``folder``, in LEXGROVE_TOKENIZERS, or where its package has it."""
    folder = folder or os.environ.get("LEXGROVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Size of an Arrow batch: whole texts are large, and a batch is held several times over.
BATCH_BYTES = "2m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session does so itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def arrow_column(make: Callable[[], Callable[[str | None], dict]], kind: pa.DataType, returns: str, source: Column) -> Column:
    """A struct column computed in Arrow batches from one column, row by row.

    ``make`` runs once for each Python task and returns the function of one value. Only ``source``
    travels to Python; all other columns stay in the JVM. The column is marked as
    non-deterministic so that the optimizer never evaluates it twice.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for batch in batches:
            if isinstance(batch, pa.ChunkedArray):
                batch = batch.combine_chunks()
            yield pa.array([one(x.as_py()) for x in batch], kind)

    bounded_batches(SparkSession.active())
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()(source)


#: Characters or bytes of a long text that are turned into objects at once.
PART = 1 << 20
BLANK, BLANK_BYTE = re.compile(r"[\x20\x09-\x0D]"), re.compile(rb"[\x20\x09-\x0D]")


def parts(text, size: int = PART) -> Iterator:
    """A text, or bytes, in parts of about ``size`` that no word spans."""
    blank, at = BLANK if isinstance(text, str) else BLANK_BYTE, 0
    while at < len(text):
        found = blank.search(text, at + size) if at + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles in order, in parts; ASCII letters are made small; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    made = False
    for part in parts((text or "").encode()):
        words = held + part.lower().split()  # only ASCII letters and blanks are meant
        n = len(words) - shingle + 1
        if n < 1:
            held = words
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        begins, stops = [0, *ends[: n - 1].tolist()], (ends[shingle - 1 :] - 1).tolist()
        yield np.array([xxh64_intdigest(joined[b:e], seed) for b, e in zip(begins, stops)], "<u8")
        held, made = words[n:], True
    if held and not made:
        yield np.array([xxh64_intdigest(b" ".join(held), seed)], "<u8")


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows (n, words) of 64-bit words, least bit first."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 255 * 16):
        bits = np.unpackbits(np.ascontiguousarray(hashes[i : i + 255 * 16]).view(np.uint8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return ones


def trigram_counts(raw: np.ndarray, bits: int) -> np.ndarray:
    """Counts of the hashed byte trigrams of ``raw``, in parts."""
    n = np.zeros(1 << bits, np.int64)
    for i in range(0, max(0, len(raw) - 2), PART):
        x = raw[i : i + PART + 2].astype(np.uint32)
        n += np.bincount(((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
    return n


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; a cluster has to name that."""
    base = shared_folder(spark)
    return f"{base.rstrip('/')}/lexgrove-{name}-{uuid.uuid4().hex}"


#: How working tables are written. For each file and folder that it makes Hadoop's local file system starts a process, in which
#: all memory of the JVM counts a second time until the program is loaded; so no files of checksums and no marks of success.
#: Other file systems do not read the options of the local one.
WRITE = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Tables:
    """Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, workspace(spark, name), 0

    def keep(self, df: DataFrame, label: str = "t", few: bool = False) -> DataFrame:
        """Write and read again. ``few``: rows are dealt anew to files by their size, where many tasks have few rows each."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{label}"
        schema = df.schema
        (df.hint("rebalance") if few else df).write.mode("overwrite").options(**WRITE).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._lexgrove_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing will read again."""
        path = getattr(df, "_lexgrove_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
