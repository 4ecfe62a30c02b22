"""The natural order of an index, worked out once and kept.

Each row has its place among its segment's rows. Places come from the first ``SHORT`` characters of the natural
keys, made from the beginnings of the texts; only rows that share these get their whole keys. An order table
holds (id, prefix, rank); queries join it and sort by numbers. Where rows of several segments meet, prefixes
decide between them, and whole keys are made for those alone that share a prefix with a row of
another segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.natural_sort import natural_key
from lexgrove.operators.ranks import ranked
from lexgrove.shared import shared_folder

#: Characters of a prefix, and of the beginning of a text that it is made from if that is enough.
SHORT, BEGINNING = 64, 256
TABLE = "id bigint, prefix string, rank bigint"


def key_prefix(text: str) -> Column:
    """The first ``SHORT`` characters of a text's natural key; the whole text is looked at where its beginning gives fewer."""
    # the last part may go on beyond the beginning, so it is left out
    begun = F.regexp_replace(natural_key(F.substring(text, 1, BEGINNING)), r"\|?[^|]*\z", "")
    long = F.length(text) > BEGINNING
    return F.substring(F.when(long & (F.length(begun) >= SHORT), begun).otherwise(natural_key(text)), 1, SHORT)


def order_table(docs: DataFrame) -> DataFrame:
    """(id, prefix, rank) of rows with ``id`` and ``sort_text``, ranks from 1 by natural key and id."""
    keyed = docs.select("id", key_prefix("sort_text").alias("prefix"))
    shared = keyed.where(F.length("prefix") == SHORT).groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix")
    tied = keyed.join(shared, "prefix", "left_semi").select("id")
    whole = docs.join(tied, "id", "left_semi").select("id", natural_key("sort_text").alias("whole"))
    both = keyed.join(whole, "id", "left").withColumn("whole", F.coalesce("whole", F.lit("")))
    return ranked(both, ["prefix", "whole", "id"], keep=["prefix"])


class WholeOrder:
    """The order of an index that is one table."""

    def __init__(self, docs: DataFrame):
        self.docs, self._table = docs, None

    def table(self) -> DataFrame:
        if self._table is None:
            path = f"{shared_folder(self.docs.sparkSession)}/lexgrove-order-{uuid.uuid4().hex}"
            order_table(self.docs.select("id", "sort_text")).write.parquet(path)
            self._table = self.docs.sparkSession.read.schema(TABLE).parquet(path)
        return self._table

    def ordered(self, found: DataFrame) -> tuple[DataFrame, Sequence[str]]:
        """What was found, with the columns to sort it by."""
        return found.select("id").join(self.table().select("id", "rank"), "id"), ("rank",)


class SegmentOrders:
    """The orders of the segments of a stored index; a table is made when first asked for, and kept with its segment."""

    def __init__(self, store, segments: Sequence[str]):
        self.store, self.segments = store, list(segments)

    def _table(self, segment: str) -> DataFrame:
        rows = lambda: order_table(self.store.rows_of(segment).select("id", "sort_text"))
        return self.store.derived("order", segment, rows, TABLE)

    def ordered(self, found: DataFrame) -> tuple[DataFrame, Sequence[str]]:
        if len(self.segments) == 1:
            return found.select("id").join(self._table(self.segments[0]).select("id", "rank"), "id"), ("rank",)
        table = reduce(DataFrame.union, (self._table(s).select("id", F.lit(s).alias("segment"), "prefix", "rank") for s in self.segments))
        placed = found.select("id", "segment").join(table, ["id", "segment"])
        across = placed.groupBy("prefix").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a <> b").select("prefix", F.lit(True).alias("across"))
        placed = placed.join(across, "prefix", "left")
        tied = placed.where(F.col("across") & (F.length("prefix") == SHORT)).select("id")
        whole = found.select("id", "sort_text").join(tied, "id", "left_semi").select("id", natural_key("sort_text").alias("whole"))
        out = placed.join(whole, "id", "left")
        return out.select("id", "prefix", F.coalesce("whole", F.lit("")).alias("whole"), F.when(F.col("across"), F.lit(0).cast("bigint")).otherwise(F.col("rank")).alias("rank")), ("prefix", "whole", "rank", "id")
