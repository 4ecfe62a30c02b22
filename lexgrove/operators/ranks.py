"""Places in a total order, without bringing the rows into one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.shared import shared_folder


def ranked(found: DataFrame, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``id``, the columns to ``keep`` and the rank, from 1.

    The rows are range-partitioned and sorted; a row's rank is its place in its partition plus the
    rows of the partitions before, of which there is one number each. The places are written down:
    a range partitioning that is worked out again may cut elsewhere.
    """
    spark = found.sparkSession
    placed = found.select(*dict.fromkeys([*order, "id", *keep])).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    path = f"{shared_folder(spark)}/lexgrove-ranks-{uuid.uuid4().hex}"
    placed = placed.select("id", *keep, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_nth"))
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, bases = 0, []
    for part in sorted(sizes):
        bases.append((part, before))
        before += sizes[part]
    table = spark.createDataFrame(bases, T.StructType([T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())]))
    return placed.join(F.broadcast(table), "_part").select("id", *keep, (F.col("_before") + F.col("_nth") + 1).alias("rank"))
