"""Language identification by the nearest of several centroids for each language.

A text is the unit vector of its hashed character trigrams, weighted by logarithmic counts and
inverse document frequency. Each language's training texts are clustered by spherical k-means; a
text gets the language of the centroid with the greatest cosine. A text farther from it than nearly
all training texts of about its length is rejected.

Cases: a null text, or one without a letter, is ``und`` and is rejected; rows without a label are
never trained on; texts that come again, under one key, under none or under many, are learned from once;
with no labelled rows at all everything is ``und``; of equal cosines the first language by name holds; a
text of any length is read whole, its trigrams counted in parts; equal rows give equal results; an empty
table gives none; extra columns pass through, and columns that have the names of results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import arrow_column, trigram_counts

BITS = 15
#: Training texts for each language at most.
PER_LANGUAGE = 1000
#: Languages that are learned at most: those with the most texts.
LANGUAGES = 200
CENTROIDS = 4
#: Share of training texts, of about a text's length, that would be rejected; and what is allowed
#: beyond their cosine, for texts unlike those seen.
REJECTED, ALLOWED = 0.001, 0.5
UNDETERMINED = "und"

# ASCII bytes other than letters count as spaces.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-case UTF-8 bytes with their counts."""
    n = trigram_counts(FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)], BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _bucket(n: int) -> int:
    return min(int(n).bit_length(), 15)


class Model:
    """Centroids, inverse document frequencies and the least cosine for each length."""

    def __init__(self, texts: list[str], langs: list[str], centroids: int = CENTROIDS):
        pairs = [(trigrams(t), g) for t, g in zip(texts, langs) if has_letter(t)]
        seen = np.zeros(1 << BITS)
        for (at, _), _ in pairs:
            seen[at] += 1
        self.idf = np.log((1 + len(pairs)) / (1 + seen)) + 1
        rows = [(at, self._weighed(at, n)) for (at, n), _ in pairs]
        self.langs, found = [], []
        for lang in sorted({g for _, g in pairs}):
            own = [r for r, (_, g) in zip(rows, pairs) if g == lang]
            for c in self._cluster(own, centroids):
                self.langs.append(lang)
                found.append(c)
        self.centroids = np.ascontiguousarray(np.array(found, np.float32).reshape(-1, 1 << BITS).T)
        self.least = np.full(16, -1.0)
        if found:
            by: dict[int, list[float]] = {}
            for (at, x), ((_, n), _) in zip(rows, pairs):
                by.setdefault(_bucket(n.sum()), []).append(float((x @ self.centroids[at]).max()))
            worst = {b: float(np.quantile(v, REJECTED)) for b, v in by.items()}
            lowest = np.inf
            for b in range(15, -1, -1):  # shorter texts are never held to more than longer ones
                lowest = min(lowest, worst.get(b, lowest))
                self.least[b] = ALLOWED * lowest if np.isfinite(lowest) else ALLOWED * min(worst.values())

    def _weighed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return (x / np.sqrt(x @ x)).astype(np.float32)

    @staticmethod
    def _cluster(rows: list, k: int, rounds: int = 8) -> list[np.ndarray]:
        """Spherical k-means from evenly spaced rows; empty clusters go."""
        k = min(k, len(rows))
        centres = np.zeros((1 << BITS, k), np.float32)
        for j in range(k):
            at, x = rows[j * len(rows) // k]
            centres[at, j] = x
        for _ in range(rounds):
            sums = np.zeros((k, 1 << BITS), np.float32)
            for at, x in rows:
                sums[int((x @ centres[at]).argmax()), at] += x
            sums = sums[sums.any(axis=1)]
            k = len(sums)
            centres = np.ascontiguousarray((sums / np.linalg.norm(sums, axis=1)[:, None]).T)
        return list(centres.T)

    def predict(self, text: str | None) -> dict:
        if not self.langs or not has_letter(text):
            return {"lang_pred": UNDETERMINED, "score": 0.0, "rejected": True}
        at, n = trigrams(text)
        cosines = self._weighed(at, n) @ self.centroids[at]
        best = int(cosines.argmax())
        score = min(1.0, max(0.0, float(cosines[best])))
        return {"lang_pred": self.langs[best], "score": score, "rejected": bool(score < self.least[_bucket(n.sum())])}


def held_out(key: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learn from labelled documents that are not held out: ``per_language`` texts of each of ``languages`` languages at most.

    Distinct texts are counted by sketches first; then each text's hash decides, so that about a third
    more texts than wanted are left, wherever they lie, and rows of equal text become one before they
    are collected.
    """
    own = documents.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).where(~held_out(F.col("_key")) & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    own = own.select("_lang", "_text", F.xxhash64("_text").alias("_h"))
    sizes = own.groupBy("_lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("_h").alias("n")).orderBy(F.desc("rows"), "_lang").limit(languages).collect()
    share = F.lit(0.0)
    for r in sorted(sizes, key=lambda r: r._lang):
        share = F.when(F.col("_lang") == r._lang, min(1.0, 1.3 * per_language / max(r.n, 1))).otherwise(share)
    unit = F.pmod("_h", F.lit(1_000_003)) / 1_000_003.0
    got = own.where(unit < share).groupBy("_lang", "_h").agg(F.min("_text").alias("_text")).withColumn("_u", unit).toPandas()
    got = got.sort_values(["_u", "_h", "_lang"], kind="stable").groupby("_lang", sort=False).head(per_language)
    return Model(list(got._text), list(got._lang))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    out = df.withColumn("_language", arrow_column(lambda: shared.value.predict, kind, "struct<lang_pred:string,score:double,rejected:boolean>", F.col(text)))
    return out.withColumns({n: F.col(f"_language.{n}") for n in ("lang_pred", "score", "rejected")}).drop("_language")
