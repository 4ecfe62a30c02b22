"""Versions of an index in a shared folder, and changes that publish new ones.

An index is a list of segments, oldest first. A segment has rows of its own and the ids of older rows that are
gone since it came; rows are never written again but by a merge. A version is a small file
that names the segments, made only if no other writer has made that version: of writers that meet one
succeeds, and the others do their change again on what it left. Readers look for newer versions when
they ask for the current one, and keep what they have asked for.

A change reads keys and places of the rows it may replace, within the range of its own keys, and writes its own
rows. When enough segments of a size have gathered they become one (``merged``), so that a row is
written again as often as the logarithm of the number of rows. Documents keep their place in the snapshot
order when they are updated; one that comes again after a removal is appended. Places come from a counter in
the version.

Versions that are due at once are written together: one segment has the rows that hold after the last of them, with the
publish that each came with, and beside these the rows that were replaced on the way. Their file has the name of the first, and each is read by its number (``at``).
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import random
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrove.functions.text import DEFAULT, Tokenization
from lexgrove.operators.facets import PREFIX
from lexgrove.operators.index import SearchIndex, prepare, ranked
from lexgrove.operators.natural_order import SegmentOrders
from lexgrove.operators.progress import told as progress_told
from lexgrove.shared import shared_folder
from lexgrove.sources.files import Folder

ENTRY = "id bigint, search_text string, sort_text string, facets map<string,bigint>"
ROW = "id bigint, ordinal bigint, search_text string, sort_text string, norm string, tokens array<string>"
GONE = "id bigint, ordinal bigint"
#: Segments of a size that become one, and rows up to which segments are of the least size.
FANOUT, LEAST = 8, 1000
#: Ids of removed rows, up to which they are broadcast to where rows are read.
MOST_SENT = 500_000
#: Versions that are written together at most, as the driver keeps a number for each.
TOGETHER = 10_000
#: Sequence numbers of a change that are far apart become dense ones beyond this range.
SPREAD = 1 << 40
ATTEMPTS = 40


def entries(spark: SparkSession, rows: Mapping[int, object] | Iterable[tuple]) -> DataFrame:
    """Entries from {id: text} or {id: (text, sort text or None, facets or None)}; the last of an id holds."""
    pairs = dict(rows.items() if isinstance(rows, Mapping) else rows)
    full = [(i, e, None, None) if isinstance(e, str) or e is None else (i, *e, *[None] * (3 - len(e))) for i, e in pairs.items()]
    ids, texts, sorts, facets = (list(c) for c in zip(*full)) if full else ([], [], [], [])
    table = {
        "id": pa.array(ids, pa.int64()), "search_text": pa.array(texts, pa.string()), "sort_text": pa.array(sorts, pa.string()),
        "facets": pa.array([None if f is None else list(f.items()) for f in facets], pa.map_(pa.string(), pa.int64())), "seq": pa.array(range(len(full)), pa.int64()),
    }
    return spark.createDataFrame(pa.table(table))  # a part of the plan, for which no Python worker is asked


@dataclass(frozen=True)
class Segment:
    """Rows of one change or merge, the number of older rows that it took away, and the range of its rows' ids."""

    name: str
    rows: int
    gone: int = 0
    facets: tuple[str, ...] = ()
    low: int = 0
    high: int = -1

    @property
    def level(self) -> int:
        return int(math.log(max(self.rows + self.gone, LEAST) / LEAST, FANOUT))


@dataclass(frozen=True)
class Version:
    """What a version's file says. ``next`` is the place of the next new document; ``ledger`` is what feeds have published.

    A file of versions that were written together has the entries of each in ``steps``, and in ``during`` the segments before them and their own.
    """

    number: int = -1
    segments: tuple[Segment, ...] = ()
    entries: int = 0
    next: int = 0
    ledger: dict[str, dict] = field(default_factory=dict)
    steps: tuple[int, ...] = ()
    during: tuple[Segment, ...] = ()

    @property
    def first(self) -> int:
        """The first of the versions that were written together, which names their file."""
        return self.number - max(len(self.steps), 1) + 1

    @property
    def facets(self) -> list[str]:
        return sorted({f for s in self.segments for f in s.facets})

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Version:
        said = json.loads(text)
        held = {k: tuple(Segment(**s | {"facets": tuple(s["facets"])}) for s in said.get(k, ())) for k in ("segments", "during")}
        return cls(**said | held | {"steps": tuple(said.get("steps", ()))})


def due_for_merge(segments: tuple[Segment, ...]) -> int | None:
    """The first of the newest segments that are to become one: those of a level, and smaller ones after them."""
    for level in sorted({s.level for s in segments}):
        at = len(segments)
        while at and segments[at - 1].level <= level:
            at -= 1
        if sum(s.level == level for s in segments[at:]) >= FANOUT:
            return at
    return None


class WordCounts:
    """Numbers of documents by word, added up from those of the segments; what is gone is counted by itself and taken off."""

    TABLE = "word string, documents bigint"

    def __init__(self, store: IndexStore, segments: tuple[Segment, ...]):
        self.store, self.segments = store, segments

    @staticmethod
    def _counted(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("documents"))

    def words(self) -> DataFrame:
        """(word, length, documents), as ``postings.vocabulary`` has them."""
        parts, later = [], []
        for s in reversed(self.segments):
            if s.rows:
                rows = self.store.rows_of(s.name)
                parts.append(self.store.derived("words", s.name, lambda rows=rows: self._counted(rows), self.TABLE))
                if later:
                    gone = self._counted(rows.join(self.store.gone_of(later).select("id").distinct(), "id", "left_semi"))
                    parts.append(gone.select("word", (-F.col("documents")).alias("documents")))
            if s.gone:
                later.append(s.name)
        if not parts:
            return self.store.spark.createDataFrame([], "word string, length bigint, documents bigint")
        out = functools.reduce(DataFrame.union, parts)
        if len(parts) > 1:
            out = out.groupBy("word").agg(F.sum("documents").alias("documents")).where("documents > 0")
        return out.select("word", F.length("word").cast("bigint").alias("length"), "documents")


class IndexStore(Folder):
    """An index that can be changed; ``current`` is the published version."""

    def __init__(self, spark: SparkSession, path: str | None = None, preset: Tokenization = DEFAULT):
        super().__init__(spark, path or f"{shared_folder(spark)}/lexgrove-index-{uuid.uuid4().hex}")
        self.preset = preset
        self._lock, self._writing, self._written = threading.RLock(), threading.RLock(), []
        self._version, self._current = Version(), None
        self.refresh()

    # -- versions ----------------------------------------------------------------------------------
    def refresh(self) -> Version:
        """Look for newer versions."""
        with self._lock:
            newest, at = self._version, None
            if newest.number < 0 or not self.exists(f"v={newest.first}"):  # the first time, or where versions have been removed
                at = max((n for n in self.numbers("", "v=") if n > newest.number), default=None)
            elif self.exists(f"v={newest.number + 1}"):
                at = newest.number + 1
            while at is not None:
                newest = Version.of(self.read(f"v={at}"))
                at = newest.number + 1 if self.exists(f"v={newest.number + 1}") else None
            self._adopt(newest)
            return self._version

    def _adopt(self, version: Version) -> None:
        with self._lock:
            if version.number > self._version.number:
                self._version, self._current = version, None

    @property
    def version(self) -> int:
        return self.refresh().number

    @property
    def current(self) -> SearchIndex:
        """The published version. It stays readable when newer ones come."""
        with self._lock:
            version = self.refresh()
            if self._current is None:
                held = [s.name for s in version.segments if s.rows]
                self._current = SearchIndex(self._docs(version.segments), self.preset, SegmentOrders(self, held) if held else None, WordCounts(self, version.segments))
            return self._current

    def at(self, number: int) -> SearchIndex:
        """A version by its number, one that was written together with later ones too. A facet that only a later one of these brought is 0 in it."""
        first = max((n for n in self.numbers("", "v=") if n <= number), default=None)
        version = None if first is None else Version.of(self.read(f"v={first}"))
        if version is None or version.number < number:
            raise ValueError(f"{self.path}: there is no version {number}")
        if version.number == number or not version.during:
            return SearchIndex(self._docs(version.segments), self.preset)
        return SearchIndex(self._docs_during(version.during[:-1], version.during[-1], number - first), self.preset)

    def _change(self, make: Callable[[Version], Version | None]) -> Version | None:
        """Publish what ``make`` makes of the newest version; again, if another writer came before."""
        with self._writing:
            for attempt in range(ATTEMPTS):
                self._written, old = [], self.refresh()
                new, kept = make(replace(old, steps=(), during=())), set()
                try:
                    if new is None:
                        return None
                    new = replace(new, number=old.number + max(len(new.steps), 1))
                    if self.claim(f"v={new.first}", new.text()):
                        self._adopt(new)
                        kept = {s.name for s in (*new.segments, *new.during)}
                        return new
                finally:
                    for name in set(self._written) - kept:  # of an attempt that lost, or merged at once
                        self.delete(f"segments/{name}")
                time.sleep(random.random() * min(2.0, 0.02 * 2**attempt))
            raise RuntimeError(f"{self.path}: other writers came before {ATTEMPTS} times")

    def expire(self, keep: int = 2) -> None:
        """Remove all but the last versions, and segments that only they had; readers of removed ones fail."""
        newest = self.refresh().number
        numbers = self.numbers("", "v=")
        known = {n: Version.of(self.read(f"v={n}")) for n in numbers}
        held = {s.name for v in known.values() if v.number > newest - keep for s in (*v.segments, *v.during)}
        for n, v in known.items():
            if v.number <= newest - keep:
                self.delete(f"v={n}")
                for name in {s.name for s in (*v.segments, *v.during)} - held:
                    self.delete(f"segments/{name}")

    # -- segments ----------------------------------------------------------------------------------
    def _where(self, name: str, what: str = "rows") -> str:
        return f"{self.path}/segments/{name}/{what}"

    def rows_of(self, name: str) -> DataFrame:
        """The rows of a segment as they were written, without facets."""
        return self.spark.read.schema(ROW).parquet(self._where(name))

    def gone_of(self, names: Iterable[str]) -> DataFrame:
        """(id, ordinal) of the rows that segments took away."""
        return self.spark.read.schema(GONE).parquet(*(self._where(n, "gone") for n in names))

    def derived(self, kind: str, name: str, make: Callable[[], DataFrame], schema: str) -> DataFrame:
        """A table made of a segment's rows when first asked for, and kept with it; the first driver's holds."""
        said = f"segments/{name}/{kind}.json"
        if not self.exists(said):
            own = f"{kind}-{uuid.uuid4().hex}"
            make().write.parquet(self._where(name, own))
            if not self.claim(said, own):
                self.delete(f"segments/{name}/{own}")
        return self.spark.read.schema(schema).parquet(self._where(name, self.read(said)))

    def _docs(self, segments: tuple[Segment, ...]) -> DataFrame:
        """The rows that are there: those of each segment without what later ones took away."""
        facets = sorted({f for s in segments for f in s.facets})
        shape = T.StructType([*T.StructType.fromDDL(ROW).fields, *(T.StructField(PREFIX + f, T.LongType()) for f in facets)])
        groups: list[tuple[list[Segment], list[Segment]]] = []  # segments, and those that took rows of them away
        later: list[Segment] = []
        for s in reversed(segments):
            if s.rows:
                if not groups or len(groups[-1][1]) != len(later):
                    groups.append(([], list(later)))
                groups[-1][0].append(s)
            if s.gone:
                later.append(s)
        out = None
        for held, takers in groups:
            rows = self.spark.read.schema(shape).parquet(*(self._where(s.name) for s in held))
            name = F.lit(held[0].name) if len(held) == 1 else F.regexp_extract("_metadata.file_path", "/segments/([0-9a-f]+)/rows/", 1)
            rows = rows.withColumn("segment", name)
            lacking = [f for f in facets if any(f not in s.facets for s in held)]
            rows = rows.withColumns({PREFIX + f: F.coalesce(F.col(f"`{PREFIX}{f}`"), F.lit(0).cast("bigint")) for f in lacking})
            if takers:
                gone = self.gone_of(s.name for s in takers).select("id")
                few = sum(s.gone for s in takers) <= MOST_SENT
                rows = rows.join(F.broadcast(gone) if few else gone, "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], T.StructType([*shape.fields, T.StructField("segment", T.StringType())])) if out is None else out

    def _docs_during(self, base: tuple[Segment, ...], own: Segment, step: int) -> DataFrame:
        """The rows that were there after a publish of those that wrote the segment ``own`` together, from 0."""
        docs = self._docs(base)
        if own.gone:
            gone = self.spark.read.schema(GONE + ", _step bigint").parquet(self._where(own.name, "gone")).where(F.col("_step") <= step)
            docs = docs.join(gone.select("id"), "id", "left_anti")
        facets = [PREFIX + f for f in own.facets]
        shape = T.StructType([*T.StructType.fromDDL(ROW).fields, *(T.StructField(f, T.LongType()) for f in facets), *T.StructType.fromDDL("_step bigint, _until bigint").fields])
        for what in ("rows", "past"):
            rows = self.spark.read.schema(shape).parquet(self._where(own.name, what))
            came = (F.col("_step") <= step) & (F.col("_until").isNull() | (F.col("_until") > step))
            docs = docs.unionByName(rows.where(came).drop("_step", "_until").withColumn("segment", F.lit(own.name)), allowMissingColumns=True)
        return docs.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0).cast("bigint")) for c in docs.columns if c.startswith(PREFIX)})

    def _write(self, df: DataFrame, name: str, what: str) -> int:
        """Write a table of a segment; its rows."""
        self._written.append(name)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(self._where(name, what))
        return seen.get.get("rows", 0)

    def _merged(self, segments: tuple[Segment, ...]) -> tuple[Segment, ...]:
        """The segments, the newest of them as one if it is time."""
        first = due_for_merge(segments)
        if first is None:
            return segments
        newest, name = segments[first:], uuid.uuid4().hex
        rows = self._docs(newest).drop("segment").sortWithinPartitions("id")
        n = self._write(rows, name, "rows") if any(s.rows for s in newest) else 0
        takers, gone = [s for s in newest if s.gone], 0
        if takers and first:  # without older segments nothing is left to take away
            gone = self._write(self.gone_of(s.name for s in takers).dropDuplicates(["id"]), name, "gone")
        facets, held = tuple(sorted({f for s in newest for f in s.facets})), [s for s in newest if s.rows]
        low, high = min((s.low for s in held), default=0), max((s.high for s in held), default=-1)
        return self._merged((*segments[:first], Segment(name, n, gone, facets, low, high)) if n or gone else segments[:first])

    # -- changes -----------------------------------------------------------------------------------
    @staticmethod
    def _entries(new: DataFrame) -> DataFrame:
        seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(0).cast("bigint")) if "seq" in new.columns else F.monotonically_increasing_id()
        new = new.withColumn("seq", seq)
        for name, kind in (("sort_text", "string"), ("facets", "map<string,bigint>")):
            if name not in new.columns:
                new = new.withColumn(name, F.lit(None).cast(kind))
        return new

    @staticmethod
    def _told(new: DataFrame):
        """Range of ids and sequence numbers, and the names of facets, of which there are few by nature."""
        names = F.array_distinct(F.flatten(F.collect_set(F.map_keys("facets"))))
        return new.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("seq").alias("first"), F.max("seq").alias("last"), names.alias("facets")).first()

    def _dense(self, new: DataFrame) -> DataFrame:
        """Entries with dense sequence numbers in the same order."""
        order = new.groupBy("id").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
        places = ranked(order.select("id", "_first"), ["_first", "id"])
        last = new.join(order, "id").where(F.col("seq").eqNullSafe(F.col("_last")))
        return last.join(places, "id").withColumn("seq", F.col("rank")).drop("_first", "_last", "rank")

    def _append(self, old: Version, new: DataFrame, told, base: tuple[Segment, ...], entries: int, next: int) -> Version:
        """A version with a segment of the entries after ``base``."""
        name, names = uuid.uuid4().hex, tuple(sorted(told.facets))
        held = [c for c in new.columns if c != "id"]
        last = new.groupBy("id").agg(F.max_by(F.struct(*held), "seq").alias("e"), F.min("seq").alias("first")).select("id", "e.*", F.col("first"))
        last, gone = last.withColumn("place", F.col("first") - F.lit(told.first) + F.lit(next)), 0
        if any(s.rows and s.low <= told.high and s.high >= told.low for s in base):
            there = self._docs(base).where(F.col("id").between(told.low, told.high)).select("id", "ordinal")
            gone = self._write(there.join(new.select("id").distinct(), "id", "left_semi"), name, "gone")
            if gone:
                places = self.gone_of([name]).withColumnRenamed("ordinal", "_old")
                last = last.join(places, "id", "left").withColumn("place", F.coalesce("_old", "place"))
        rows = prepare(last, sort="sort_text", facets="facets", ordinal="place", preset=self.preset, names=names)
        n = self._write(rows.sortWithinPartitions("id"), name, "rows")
        segments = self._merged((*base, Segment(name, n, gone, names, told.low, told.high)))
        return replace(old, segments=segments, entries=entries + n - gone, next=next + told.last - told.first + 1)

    def _append_steps(self, old: Version, new: DataFrame, told, n: int) -> Version:
        """Versions after ``old``, one for each of ``n`` values of ``_step``, by one segment of all their entries."""
        name, names = uuid.uuid4().hex, tuple(sorted(told.facets))
        own = Window.partitionBy("id")
        held = [c for c in new.columns if c not in ("id", "_step")]
        each = new.groupBy("id", "_step").agg(F.max_by(F.struct(*held), "seq").alias("e"), F.min("seq").alias("first")).select("id", "_step", "e.*", F.col("first"))
        place = F.min("first").over(own) - F.lit(told.first) + F.lit(old.next)
        each, gone = each.withColumns({"_until": F.lead("_step").over(own.orderBy("_step")), "_came": F.min("_step").over(own), "place": place}), 0
        if any(s.rows and s.low <= told.high and s.high >= told.low for s in old.segments):
            there = self._docs(old.segments).where(F.col("id").between(told.low, told.high)).select("id", "ordinal")
            gone = self._write(there.join(new.groupBy("id").agg(F.min("_step").alias("_step")), "id"), name, "gone")
            if gone:
                places = self.gone_of([name]).withColumnRenamed("ordinal", "_old")
                each = each.join(places, "id", "left").withColumn("place", F.coalesce("_old", "place"))
        rows = prepare(each, sort="sort_text", facets="facets", ordinal="place", preset=self.preset, names=names, keep=("_step", "_until", "_came"))
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            count = self._write(rows.where("_until IS NULL").sortWithinPartitions("id"), name, "rows")
            self._write(rows.where("_until IS NOT NULL"), name, "past")
        finally:
            rows.unpersist()
        added = dict.fromkeys(range(n), 0)
        for what, column, sign in (("rows", "_came", 1), *([("gone", "_step", -1)] if gone else [])):
            counted = self.spark.read.schema(f"{column} bigint").parquet(self._where(name, what)).groupBy(column).agg(F.count("*").alias("n"))
            for r in counted.collect():  # a row for each publish
                added[r[column]] += sign * r["n"]
        steps = tuple(itertools.accumulate(added.values(), initial=old.entries))[1:]
        during = (*old.segments, Segment(name, count, gone, names, told.low, told.high))
        return replace(old, segments=self._merged(during), entries=steps[-1], next=old.next + told.last - told.first + 1, steps=steps, during=during)

    def rebuild(self, new: DataFrame, progress: Callable[[float], None] | None = None) -> SearchIndex:
        """Replace everything by the entries (id, search_text[, sort_text, facets, seq]); ``progress`` hears how far it is."""
        with progress_told(self.spark, progress):
            new, told = self._ready(new)

            def make(old: Version) -> Version:
                if told.low is None:
                    return replace(old, segments=(), entries=0, next=0)
                return self._append(old, new, told, (), 0, 0)

            self._change(make)
        return self.current

    def _ready(self, new: DataFrame):
        new = self._entries(new.where("id IS NOT NULL"))
        told = self._told(new)
        if told.low is not None and told.last - told.first >= SPREAD:
            new = self._dense(new)
            told = self._told(new)
        return new, told

    def rebuild_from_stream(self, stream: DataFrame) -> SearchIndex:
        """Drain what a streaming source has, and rebuild once from it; the last entry of an id holds."""
        landed = f"{self.path}/landed-{uuid.uuid4().hex}"

        def land(batch: DataFrame, number: int) -> None:
            batch.withColumn("seq", F.coalesce(F.col("seq"), F.lit(0)) if "seq" in batch.columns else F.lit(number).cast("bigint") * 2**40 + F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{landed}/batch={number}")

        stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{landed}-checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.rebuild(self.spark.read.parquet(landed).drop("batch"))

    def upsert(self, new: DataFrame) -> SearchIndex:
        """Add or replace entries; one publish."""
        self.publish(new)
        return self.current

    def publish(self, new: DataFrame, note: tuple[str, dict] | None = None, each: int | None = None, versions: int = 1) -> list[int]:
        """The same; ``note`` is what a feed has published with it, by the feed's name. The entries of each new version.

        With ``each``, several ``versions`` are written together: the first has the entries whose ``seq`` is below ``each``, the next those below
        twice as much, and so on. ``seq`` counts the entries from 0.
        """
        if versions > 1:
            new = new.withColumn("_step", F.least(F.floor(F.col("seq") / each), F.lit(versions - 1)).cast("bigint"))
        new, told = self._ready(new)

        def make(old: Version) -> Version:
            if told.low is None:
                out = old if versions == 1 else replace(old, steps=(old.entries,) * versions)
            elif versions == 1:
                out = self._append(old, new, told, old.segments, old.entries, old.next)
            else:
                out = self._append_steps(old, new, told, versions)
            return replace(out, ledger=old.ledger | {note[0]: note[1]}) if note else out

        made = self._change(make)
        return list(made.steps) or [made.entries]

    def remove(self, ids: Iterable[int] | DataFrame) -> int:
        """Delete entries; the number that there were. Nothing is published for none."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id bigint")
        gone, took = gone.select(F.col("id").cast("bigint").alias("id")).distinct(), [0]

        def make(old: Version) -> Version | None:
            took[0] = 0
            if not old.segments:
                return None
            name = uuid.uuid4().hex
            took[0] = self._write(self._docs(old.segments).select("id", "ordinal").join(gone, "id", "left_semi"), name, "gone")
            if not took[0]:
                return None
            return replace(old, segments=self._merged((*old.segments, Segment(name, 0, took[0]))), entries=old.entries - took[0])

        self._change(make)
        return took[0]

    def clear(self) -> SearchIndex:
        self._change(lambda old: replace(old, segments=(), entries=0, next=0))
        return self.current

    # -- single entries ----------------------------------------------------------------------------
    def rebuild_from(self, rows: Mapping[int, object]) -> SearchIndex:
        return self.rebuild(entries(self.spark, rows))

    def add_entry(self, id: int, entry: object) -> SearchIndex:
        return self.upsert(entries(self.spark, {id: entry}))

    def add_or_update_entries(self, rows: Mapping[int, object] | Iterable[tuple]) -> SearchIndex:
        return self.upsert(entries(self.spark, rows))

    def refresh_entry(self, id: int, entry: object) -> bool:
        """Add or replace an entry; whether it was there."""
        with self._writing:
            was = self.contains(id)
            self.add_entry(id, entry)
            return was

    def remove_entry(self, id: int) -> bool:
        return self.remove([id]) > 0

    def remove_entries(self, ids: Iterable[int]) -> int:
        return self.remove(ids)

    def entry_count(self) -> int:
        return self.refresh().entries

    def contains(self, id: int) -> bool:
        return not self.current.docs.where(F.col("id") == id).select("id").isEmpty()


class Registry:
    """Independent indexes by name. With a folder names are kept there: another driver opens an index by its name."""

    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base, self._stores, self._lock = spark, base, {}, threading.Lock()
        self._names = Folder(spark, f"{base}/.names") if base else None

    @staticmethod
    def _file(name: str) -> str:
        return "index-" + name.encode().hex()

    def _path(self, name: str) -> str | None:
        plain = name or "default"
        return f"{self.base}/{plain if re.fullmatch('[A-Za-z0-9_-][A-Za-z0-9_.-]*', plain) else self._file(name)}" if self.base else None

    def register(self, name: str = "", preset: Tokenization = DEFAULT, initial: Mapping[int, object] | None = None) -> IndexStore:
        """A new index under a name; later changes start from the initial entries."""
        with self._lock:
            taken = name in self._stores
            if self._names and not taken:
                said = {"name": name, "index": preset.index, "query": preset.query, "path": self._path(name)}
                taken = not self._names.claim(self._file(name), json.dumps(said))
            if taken:
                raise ValueError(f"there is an index {name!r}")
            store = self._stores[name] = IndexStore(self.spark, self._path(name), preset)
        if initial:
            store.rebuild_from(initial)
        return store

    def __getitem__(self, name: str) -> IndexStore:
        with self._lock:
            if name not in self._stores:
                if not self._names or not self._names.exists(self._file(name)):
                    raise KeyError(name)
                said = json.loads(self._names.read(self._file(name)))
                self._stores[name] = IndexStore(self.spark, said["path"], Tokenization(said["index"], said["query"]))
            return self._stores[name]

    def names(self) -> list[str]:
        kept = [bytes.fromhex(n.removeprefix("index-")).decode() for n in self._names.names() if n.startswith("index-")] if self._names else []
        return sorted({*self._stores, *kept})

    def transient(self, preset: Tokenization = DEFAULT) -> IndexStore:
        """An index that no one else sees."""
        return IndexStore(self.spark, None, preset)


__all__ = ["ENTRY", "IndexStore", "Registry", "Segment", "Version", "due_for_merge", "entries", "shared_folder"]
