"""Invented file paths for trying out ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import name_tokens


def _below(n: int, seed: int, *salt: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *salt), F.lit(n))


def _path(seed: int) -> Column:
    depth = (_below(4, seed, F.lit("depth")) + 2).cast("int")
    folders = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.lit("folder"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(200)).cast("string")))
    file = F.concat(F.lit("file"), F.col("id").cast("string"), F.lit("_"), (_below(8999, seed, F.lit("file")) + 1000).cast("string"), F.lit(".txt"))
    return name_tokens(F.array_join(F.concat(folders, F.array(file)), "\\"))


def paths(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """(id, search_text): name tokens of 2 to 5 folders and a file, the same for the same seed."""
    return spark.range(count).select("id", _path(seed).alias("search_text"))


def path_stream(spark: SparkSession, rate: int, seed: int = 42) -> DataFrame:
    """The same as an endless stream of ``rate`` rows a second, with ``seq`` and ``arrived``."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("id"), F.col("timestamp").alias("arrived"))
    return source.select("id", _path(seed).alias("search_text"), F.col("id").alias("seq"), "arrived")
