"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables


def _sketch(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(a, b)), 0)")).first())


#: Edges for each file of a table at least: later rounds have few, and a file for each task costs more than what it holds.
ROWS = 250_000


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the least node it is connected to.

    Each round joins a node's edges with its least neighbour; degrees are counted by partial
    aggregation, and the joins read written tables, so that skewed nodes can be split.
    """
    now = tables.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    sketch = _sketch(now)
    few = lambda df: df.coalesce(max(1, math.ceil(sketch[0] / ROWS)))
    while sketch != was and sketch[0]:
        was = sketch
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = tables.keep(few(both.join(tables.keep(few(least), "least"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()), "large")
        least = tables.keep(few(large.groupBy("a").agg(F.min("b").alias("m"))), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        old, now = now, tables.keep(few(small), "edges")
        tables.drop(old)
        tables.drop(large)
        sketch = _sketch(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
