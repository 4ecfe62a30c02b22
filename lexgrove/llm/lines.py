"""Line dedup: later copies of repeated runs of lines are deleted. Native only.

The corpus is one sequence of line ids, cut between documents. Prefix doubling names the runs of
1, 2, 4, ... lines that start at each position: a run's name is the least position of its class,
found by grouping the pairs of names of its two halves. Positions whose run is unique are dropped
at once, so later rounds only see what still repeats. Two names, overlapping where need be, then
identify a run of any length, that is, an interval of suffixes with so long a common prefix.

A repeated run counts from ``min_words`` words on. Every such run is the union of the shortest runs
of so many words from each of its lines on, and up to each of its lines; so these shortest runs,
whose length in lines is at most ``min_words``, are all that has to be named. In each class all but
the first (by key, then by position) are deleted.

Cases: a null or empty text has nothing to delete; lines without a word neither count nor go; rows
that agree in key and text are one document and fare alike; texts of one key are in the order of
their hashes; an empty table gives none; other columns pass through, and columns that have the
names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables

#: Words from which a repeated run is deleted: beyond what prose repeats by chance.
MIN_WORDS = 6
WORD = r"[^\x20\x09-\x0D]+"


def _lines(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Lines with a word: their place, two hashes, and the lengths of the shortest runs from and up to them.

    ``at`` numbers the lines so that those of one document follow each other.
    """
    rows = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.split(text, "\n", -1).alias("l")).where("l IS NOT NULL")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("k", "h", "row", F.posexplode("l").alias("pos", "line"))
    rows = rows.withColumn("w", F.regexp_count("line", F.lit(WORD)).cast("bigint")).where("w > 0")
    rows = rows.select("k", "h", "row", "pos", "w", F.monotonically_increasing_id().alias("at"), F.xxhash64("line").alias("x"), F.crc32(F.col("line")).alias("c"))
    doc = "PARTITION BY row"
    rows = rows.selectExpr("*", f"sum(w) OVER ({doc} ORDER BY at ROWS UNBOUNDED PRECEDING) - w AS before", f"sum(w) OVER ({doc}) AS total")
    rows = rows.withColumn("after", F.col("total") - F.col("before") - F.col("w"))
    run = "count(*) OVER ({} ORDER BY {} RANGE BETWEEN CURRENT ROW AND {} FOLLOWING)"
    rows = rows.selectExpr("*", f"CASE WHEN total - before >= {min_words} THEN {run.format(doc, 'before', min_words - 1)} END AS on_from", f"CASE WHEN total - after >= {min_words} THEN {run.format(doc, 'after', min_words - 1)} END AS up_to")
    return rows.select("k", "h", "pos", "at", "x", "c", "on_from", "up_to", "before", "after")


def _classes(named: DataFrame, by: list[str]) -> DataFrame:
    """(at, name) of the rows that share ``by`` with another row."""
    return named.groupBy(*by).agg(F.min("at").alias("name"), F.count("*").alias("members")).where("members > 1").drop("members")


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """The places (k, h, pos) of lines to delete, and all lines with a word."""
    tables = tables or Tables(df.sparkSession, "lines")
    lines = tables.keep(_lines(df, key, text, min_words), "lines")
    runs = lines.select("at", F.col("on_from").alias("m")).union(lines.selectExpr("at - up_to + 1 AS at", "up_to AS m")).where("m IS NOT NULL").distinct()
    runs = tables.keep(runs.join(lines.select("at", "k", "h", "pos"), "at"), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 0

    found, level, span = None, None, 1
    while span <= longest:
        if level is None:
            own = lines.select("at", "x", "c")
            by = ["x", "c"]
        else:
            half = span // 2
            own = level.withColumnRenamed("name", "x").join(level.select((F.col("at") - half).alias("at"), F.col("name").alias("c")), "at")
            # the halves may lie in two documents: runs that count never do, and others are harmless
            by = ["x", "c"]
        classes = tables.keep(_classes(own, by), "classes")
        level = tables.keep(own.join(classes, by).select("at", "name"), "names")
        here = runs.where((F.col("m") >= span) & (F.col("m") < 2 * span)).join(level.withColumnRenamed("name", "n1"), "at")
        if span > 1:
            second = level.select(F.col("at").alias("at2"), F.col("name").alias("n2"))
            here = here.withColumn("at2", F.col("at") + F.col("m") - span).join(second, "at2")
        else:
            here = here.withColumn("n2", F.col("n1"))
        here = tables.keep(here.select("m", "n1", "n2", F.struct("k", "h", "pos").alias("place"), "at"), "named")
        first = tables.keep(here.groupBy("m", "n1", "n2").agg(F.min("place").alias("first"), F.count("*").alias("members")).where("members > 1").drop("members"), "first")
        later = here.join(first, ["m", "n1", "n2"]).where("place > first").select("at", "m")
        found = later if found is None else found.union(later)
        span *= 2
    if found is None:
        return lines.select("k", "h", "pos").limit(0), lines
    at = found.select(F.explode(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1)).alias("at")).distinct()
    return lines.join(at, "at").select("k", "h", "pos"), lines


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """Replace ``text`` by what is left of it, and add the number of lines ``removed``."""
    tables = Tables(df.sparkSession, "lines")
    gone, _ = repeated_lines(df, key, text, min_words, tables)
    # a document's deleted lines as runs (first, last), in order
    gone = tables.keep(gone.distinct(), "gone")
    island = "pos - row_number() OVER (PARTITION BY k, h ORDER BY pos)"
    runs = gone.selectExpr("k", "h", "pos", f"{island} AS island").groupBy("k", "h", "island").agg(F.struct(F.min("pos").alias("first"), F.max("pos").alias("last")).alias("run"))
    runs = runs.groupBy("k", "h").agg(F.array_sort(F.collect_list("run")).alias("_runs"), F.sum(F.col("run.last") - F.col("run.first") + 1).alias("_n"))
    runs = tables.keep(runs.withColumnsRenamed({"k": "_k", "h": "_h"}), "deleted")
    out = df.drop(removed).withColumn("_x", F.xxhash64(text)).join(runs, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_x") == F.col("_h")), "left")
    out = out.withColumn("_lines", F.when(F.col("_n") > 0, F.split(text, "\n", -1)))
    return out.withColumn(text, F.when(F.col("_n") > 0, _without(F.col("_lines"), F.col("_runs"))).otherwise(F.col(text))).withColumn(removed, F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_x", "_k", "_h", "_runs", "_n", "_lines")


def _without(lines: Column, runs: Column) -> Column:
    """The lines between the runs: each gap is one slice, so the work is in proportion to the lines."""
    n = F.size(lines)
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(n))
    return F.array_join(F.flatten(F.transform(F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e"))), lambda g: g["b"] < g["e"]), lambda g: F.slice(lines, g["b"] + 1, g["e"] - g["b"]))), "\n")
