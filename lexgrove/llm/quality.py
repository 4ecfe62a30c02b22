"""Quality rules: a few counts, and a calibrated logistic regression on hashed n-grams.

The classifier sees hashed lower-case words and hashed byte trigrams, each as a unit vector of
logarithmic counts. It is trained on labelled rows, and a two-parameter logistic on rows left out
of the training makes its score a probability. Scoring runs in Arrow batches.

Cases: a null text has no words; labels that are null are no labels; of several labels of one
document the largest holds, and of several texts that with the least hash; with no labels of both
classes the verdict is that of the counts; a probability at the threshold is kept; a text of any length is
read whole, its words and trigrams as numbers, in parts; equal rows give equal results; an empty table
gives none; extra columns pass through, and columns that have the names of results are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import arrow_column, parts, trigram_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
WORD_BITS = CHAR_BITS = 15
#: Labelled rows that the classifier is fitted on at most.
MAX_TRAIN = 4000
#: Probability of good quality from which a document is kept.
THRESHOLD = 0.2
LEAST_WORDS, MOST_REPEATED = 10, 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Words:
    """A text's words as numbers, in order, and its distinct words."""

    def __init__(self, text: str):
        known: dict[str, int] = {}
        found = []
        for part in parts(text):
            words = WORDS.findall(part)
            new = set(words).difference(known)
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
            found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        self.distinct = list(known)
        self.ids = np.concatenate(found) if found else np.empty(0, np.int64)


def counts(text: str | None) -> tuple[tuple[int, ...], Words]:
    """The COUNTS of a text, and its words."""
    text = text or ""
    words = Words(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if x in seen:
            dup += bool(WORDS.search(x))
        seen.add(x)
    chars = int(np.fromiter(map(len, words.distinct), np.int64, len(words.distinct))[words.ids].sum())
    return (len(words.ids), chars, sum(map(text.count, SYMBOLS)), dup, repeated(words.ids)), words


def repeated(ids: np.ndarray) -> int:
    """Words in windows that are found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)  # equal windows have equal sums
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64)
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    names, base = ids[:n], int(ids.max()) + 1
    for i in range(1, WINDOW):  # exact names of ever longer windows
        _, names = np.unique(names * base + ids[i : i + n], return_inverse=True)
    twice = np.flatnonzero(np.bincount(names)[names] > 1)
    if not len(twice):
        return 0
    return int(WINDOW + np.minimum(np.diff(twice), WINDOW).sum())


class Features:
    """Sparse features of a text: indices below 2**15 for words, then as many for trigrams."""

    size = (1 << WORD_BITS) + (1 << CHAR_BITS)

    def __init__(self, remembered: int = 200_000):
        self.buckets, self.remembered = {}, remembered

    def _bucket(self, word: str) -> int:
        b = self.buckets[word] = zlib.crc32(word.lower().encode()) & ((1 << WORD_BITS) - 1)
        return b

    def __call__(self, text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
        if len(self.buckets) > self.remembered:
            self.buckets.clear()
        known = self.buckets
        b = np.array([known[w] if w in known else self._bucket(w) for w in words.distinct], np.int64)
        found = []
        for n, base in ((np.bincount(b[words.ids], minlength=1 << WORD_BITS), 0), (trigram_counts(np.frombuffer(text.lower().encode(), np.uint8), CHAR_BITS), 1 << WORD_BITS)):
            at = np.flatnonzero(n)
            x = np.log1p(n[at])
            found.append((at + base, x / max(np.sqrt(x @ x), 1e-12)))
        return np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])


def _descend(rows: list, y: np.ndarray, size: int, rounds: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient descent on sparse rows."""
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float32)
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    for i in range(1, rounds + 1):
        z = np.bincount(of, weights=value * w[at], minlength=len(rows)) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.append(np.bincount(at, weights=value * r[of], minlength=size) + ridge * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a z + b))), by Newton's method with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, p = np.column_stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (q - t) + 1e-3 * (p - [1, 0])
        p = p - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), g)
    return float(p[0]), float(p[1])


def fit(texts: list[str], quality: np.ndarray) -> dict | None:
    """The model's numbers, or None where one class is missing. Every fourth row calibrates."""
    y = np.asarray(quality, float)
    if len(y) < 8 or y.min() == y.max():
        return None
    features = Features()
    rows = [features(t or "", Words(t or "")) for t in texts]
    held = np.arange(len(y)) % 4 == 3
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held[:] = False
    w, bias = _descend([r for r, h in zip(rows, held) if not h], y[~held], Features.size)
    z = np.array([w[r[0]] @ r[1] + bias for r in rows])
    to = held if held.any() else ~held
    a, b = _calibrated(z[to], y[to])
    return {"w": w.astype(np.float32), "bias": bias, "a": a, "b": b}


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_train: int = MAX_TRAIN) -> dict | None:
    """Fit on at most ``max_train`` labelled documents, those whose keys have the smallest hashes.

    Of the rows that share a key the text with the least hash is learned from; the others never leave their tasks.
    """
    labelled = labels.select(F.col(key).alias("_key"), F.col(label).alias("_y")).where("_key IS NOT NULL AND _y IS NOT NULL").groupBy("_key").agg(F.max("_y").alias("_y"))
    few = labelled.orderBy(F.xxhash64(F.col("_key")), "_key").limit(max_train)
    found = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(few), "_key")
    least = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"))).alias("_least")
    got = found.groupBy("_key").agg(F.max("_y").alias("_y"), least).select("_key", "_y", "_least.text").toPandas()
    got = got.assign(h=[zlib.crc32(str(k).encode()) for k in got._key]).sort_values(["h", "_key"], kind="stable")
    return fit([t if isinstance(t, str) else "" for t in got.text], got._y.to_numpy())


FIELDS = [*((n, pa.int64()) for n in COUNTS), ("base_failed", pa.bool_()), ("probability", pa.float64())]


def assess(df: DataFrame, model: dict | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add the COUNTS, ``base_failed``, ``probability`` (null without a model) and ``kept``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        features, m = Features(), shared.value

        def one(x: str | None) -> dict:
            found, words = counts(x)
            out = dict(zip(COUNTS, found))
            out["base_failed"] = found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED * found[0]
            if m is not None:
                at, value = features(x or "", words)
                z = m["a"] * (float(m["w"][at] @ value) + m["bias"]) + m["b"]
                out["probability"] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            return out

        return one

    kind = pa.struct(FIELDS)
    returns = "struct<" + ",".join(f"{n}:{'bigint' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'double'}" for n, t in FIELDS) + ">"
    out = df.withColumn("_quality", arrow_column(make, kind, returns, F.col(text)))
    out = out.withColumns({n: F.col(f"_quality.{n}") for n, _ in FIELDS}).drop("_quality")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("probability") >= threshold, F.lit(True)))
