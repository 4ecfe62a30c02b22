"""Quality classifier: supervised subword embeddings.

A text is the average of its words. A lower-case word has a learned vector, and another one for each run of 3 to 5
characters within it and its two borders, all hashed to a fixed number of rows; its runs weigh together as much as
itself. A word that repeats the one before it has a vector for that. A linear layer and a softmax give
the probability of each class; vectors and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of labelled rows. Since the layer is linear, a text's score is the mean of one number for
each vector, so that tasks have a small model.

Cases: a null text is an empty one, and a text without words has the score of an average of zero; labels that are null
are no labels, of several labels of one document the largest holds, and of several texts that with the
least hash; a label that is not 1 counts as 0; without any label all scores are 0.5; a blank text is learned from like any other; a null key is never learned from and not
held out; a text of any length is read whole, in parts; equal texts have equal scores; an empty table
gives none; extra columns pass through, and columns that have the names of results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import PART, Tables, arrow_column, bounded_batches
from lexgrove.llm.language import held_out
from lexgrove.llm.quality import Words

#: Rows for words and, after them, for runs of characters.
WORD_ROWS = RUN_ROWS = 1 << 16
#: The row of a word that is the one before it again.
AGAIN = WORD_ROWS + RUN_ROWS
SHORTEST, LONGEST = 3, 5
DIMENSIONS, ROUNDS, RATE, SEED = 16, 3, 0.5, 11
#: Steps of the descent at least: small samples are gone through more often.
STEPS = 10_000
#: Labelled documents, and distinct rows of all of them together, that are learned from at most.
MAX_TRAIN, MAX_ROWS = 4000, 8_000_000
#: Score from which a text is predicted to be of class 1.
THRESHOLD = 0.3


def hashed(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a text's words and runs of characters, in parts, with their weights; both weigh as many as there are words."""
    words = Words(text.lower())
    if not words.distinct:
        return
    again = np.append(False, words.ids[1:] == words.ids[:-1])
    often = np.bincount(words.ids[~again], minlength=len(words.distinct)).astype(np.float64)
    yield np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (WORD_ROWS - 1) for w in words.distinct), np.int64, len(words.distinct)), often
    yield np.array([AGAIN]), np.array([2.0 * again.sum()])
    # all distinct words one after the other, each with its borders; the runs of a word share its weight
    sizes = np.fromiter(map(len, words.distinct), np.int64, len(words.distinct)) + 2
    each = often / sum(np.maximum(sizes - n + 1, 0) for n in range(SHORTEST, LONGEST + 1))
    points = np.frombuffer("".join(f"<{w}>" for w in words.distinct).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    for at in range(0, len(points), PART):
        x = points[at : at + PART + LONGEST - 1]
        of = np.searchsorted(ends, np.arange(at, at + len(x)), "right")
        h = np.zeros(len(x), np.uint32)
        for n in range(1, LONGEST + 1):
            m = min(PART, len(x) - n + 1)
            if m < 1:
                break
            h = h[:m] * np.uint32(16777619) ^ (x[n - 1 : n - 1 + m] * np.uint32(2654435761))
            if n >= SHORTEST:
                inside = of[:m] == of[n - 1 : n - 1 + m]
                rows = (h * np.uint32(2246822519)) >> np.uint32(16)
                yield WORD_ROWS + rows[inside].astype(np.int64), each[of[:m][inside]]


@dataclass(frozen=True)
class Model:
    """The learned vectors and layer."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @classmethod
    def blank(cls, seed: int = SEED) -> Model:
        shape = (AGAIN + 1, DIMENSIONS)
        start = (np.random.default_rng(seed).random(shape, np.float32) - np.float32(0.5)) * np.float32(2 / DIMENSIONS)
        return cls(start, np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32))

    def learn(self, texts: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> Model:
        """Gradient descent, a text at a time; the rate falls in a straight line to zero."""
        rounds = max(rounds, -(-STEPS // max(1, len(texts))))
        rng, done, steps = np.random.default_rng(seed), 0, max(1, rounds * len(texts))
        for _ in range(rounds):
            for i in rng.permutation(len(texts)):
                step = np.float32(rate * (1 - done / steps))
                done += 1
                rows, share = texts[i]
                mean = share @ self.vectors[rows]
                out = self.layer @ mean + self.bias
                wrong = np.exp(out - out.max())
                wrong /= wrong.sum()
                wrong[classes[i]] -= 1
                back = wrong @ self.layer
                self.layer[:] -= step * np.outer(wrong, mean)
                self.bias[:] -= step * wrong
                self.vectors[rows] -= step * np.outer(share, back)
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """What each vector adds to the difference of the two outputs, and what is there without any."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def score(text: str | None, folded: tuple[np.ndarray, float]) -> float:
    """Probability of class 1."""
    each, bias = folded
    total, n = 0.0, 0.0
    for rows, weights in hashed(text or ""):
        total += float(each[rows] @ weights)
        n += float(weights.sum())
    return float(1 / (1 + np.exp(-np.clip(total / max(n, 1.0) + bias, -700, 700))))


def _sparse(text: str | None) -> dict:
    """A text as its rows and how often each is there."""
    n = np.zeros(AGAIN + 1)
    for rows, weights in hashed(text or ""):
        n += np.bincount(rows, weights=weights, minlength=len(n))
    at = np.flatnonzero(n)
    return {"size": len(at), "rows": at.astype("<i4").tobytes(), "weights": (n[at] / max(n.sum(), 1.0)).astype("<f4").tobytes()}


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN, max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn from at most ``max_train`` labelled documents that are not held out, those whose keys have the smallest hashes.

    Texts are turned to rows and weights in the tasks; of these, ``max_rows`` at most come to the driver, texts in the
    order of the hashes.
    """
    bounded_batches(documents.sparkSession)
    named = labels.select(F.col(key).alias("_key"), F.col(label).alias("_y")).where("_key IS NOT NULL AND _y IS NOT NULL").where(~held_out(F.col("_key")))
    few = named.groupBy("_key").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64(F.col("_key")), "_key").limit(max_train)
    found = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(few), "_key")  # ``max_train`` rows
    least = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"))).alias("_least")
    one = found.groupBy("_key").agg(F.max("_y").alias("_y"), least)
    kind = pa.struct([("size", pa.int64()), ("rows", pa.binary()), ("weights", pa.binary())])
    sparse = arrow_column(lambda: _sparse, kind, "struct<size:bigint,rows:binary,weights:binary>", F.col("_least.text"))
    kept = Tables(documents.sparkSession, "subwords").keep(one.select(F.xxhash64(F.col("_key")).alias("h"), "_key", "_y", sparse.alias("t")).select("h", "_key", "_y", "t.*"), "sample", few=True)
    last, total = None, 0
    for h, name, size in sorted(kept.select("h", "_key", "size").collect()):  # a row for each text learned from
        total += size
        if total > max_rows:
            break
        last = (h, name)
    if last is None:
        return Model.blank()
    within = (F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("_key") <= F.lit(last[1])))
    got = kept.where(within).toPandas().sort_values(["h", "_key"])
    texts = [(np.frombuffer(r, "<i4"), np.frombuffer(w, "<f4")) for r, w in zip(got["rows"], got["weights"])]
    classes = (got["_y"] == 1).to_numpy().astype(np.int64)
    return Model.blank().learn(texts, classes, rounds)


def assess(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model.folded())
    found: Column = arrow_column(lambda: lambda x, m=shared.value: {"score": score(x, m)}, pa.struct([("score", pa.float64())]), "struct<score:double>", F.col(text))
    out = df.withColumn("_found", found).withColumn("score", F.col("_found.score")).drop("_found")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
