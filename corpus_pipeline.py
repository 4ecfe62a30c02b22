"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as
Parquet and gives it to the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm import language, lines, near, packing, secrets
from lexgrove.llm.common import Tables


def _carried(docs: DataFrame) -> DataFrame:
    """Key, text and language, and all other columns in one: no operator's result can take their names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "lang")]
    return docs.select("doc_id", "text", "lang", F.struct(*rest).alias("_rest"))


def _released(out: DataFrame, docs: DataFrame, lang: str = "lang") -> DataFrame:
    """The columns of ``docs`` again, with ``n_chars`` of the text as it is now."""
    now = {"text": F.col("text"), "lang": F.col(lang), "n_chars": F.length("text").cast("bigint")}
    return out.select(*(now.get(c, F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language; those rejected go."""
    found = language.identify(_carried(docs), language.train(docs))
    return _released(found.where(~F.col("rejected")), docs, "lang_pred")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines."""
    return _released(lines.remove_repeated(_carried(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return _released(near.deduplicate(_carried(docs)), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return _released(secrets.redact(_carried(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The first stage's centroids and the shingles of the third are beyond SQL; see the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
