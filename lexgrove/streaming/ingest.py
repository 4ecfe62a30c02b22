"""Progressive publishing of a live feed: when to make what has arrived searchable.

A streaming query lands each micro-batch as a table in arrival order; a controller says when pending
entries become a new version of the index, by number or by time. A timer asks it also when nothing
arrives. Pending entries that a batch bound splits are published in arrival order: a landed row has its
place, so a slice is a filter. The source's own limits bound what is pending.

Where more is pending than a publish takes, and what the next ones take is known, several are written together, first one, then four times as many
each time: each is a version of its own, with its own entries, but the jobs that write them grow only with the logarithm of their number.

What has been published of a feed is said in the version that has it, by the id of the streaming query and the number of
the micro-batch. A run that starts again on the same store and checkpoint goes on from there: landed entries are pending
again, and a micro-batch that comes again is known by its number. Another feed, or another
checkpoint, is another query. Entries wait from when they came: a feed may say so in a column ``arrived``; otherwise it is
when they landed.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgrove.sources.store import TOGETHER, IndexStore


class Policy(Enum):
    PER_ENTRY = "per-entry"
    FIXED_BATCH = "fixed-batch"
    TIME_DEBOUNCE = "time-debounce"
    ADAPTIVE = "adaptive"


@dataclass(frozen=True)
class Options:
    """Times are in seconds. ``capacity`` is for sources that take a limit per trigger; ``feed.Feed`` holds producers back."""

    policy: Policy = Policy.ADAPTIVE
    batch_size: int = 2_000
    min_interval: float = 0.1
    rebuild_factor: float = 2.0
    capacity: int = 10_000
    flush_on_stop: bool = True
    max_staleness: float = 1.0
    min_timer_batch: int = 200
    growing_cap: bool = True

    def __post_init__(self):
        for name, good in (("batch_size", self.batch_size >= 1), ("min_interval", self.min_interval >= 0), ("rebuild_factor", self.rebuild_factor > 0), ("capacity", self.capacity >= 1), ("max_staleness", self.max_staleness > 0), ("min_timer_batch", self.min_timer_batch >= 1)):
            if not good:
                raise ValueError(f"{name} is out of range: {getattr(self, name)}")

    @property
    def source_limits(self) -> dict[str, str]:
        """Options for a rate source."""
        return {"rowsPerSecond": str(self.capacity)}


@dataclass(frozen=True)
class Published:
    """One new version. ``sequence`` counts from 0."""

    entries: int
    indexed: int
    rebuild_seconds: float
    sequence: int


@dataclass(frozen=True)
class Progress:
    accepted: int
    published: int
    publishes: int
    pending: int


@dataclass(frozen=True)
class Result:
    accepted: int
    published: int
    publishes: int
    indexed: int
    rebuild_seconds: float
    worst_staleness: float
    stopped: bool


class Controller:
    """Decides when to publish; the clock is a parameter."""

    def __init__(self, options: Options, now: Callable[[], float] = time.monotonic):
        self.options, self.now = options, now
        self.cap, self.last_publish, self.last_rebuild = options.batch_size, now(), 0.0

    def bound(self) -> int | None:
        """Pending entries from which to publish, whatever the time."""
        return {Policy.PER_ENTRY: 1, Policy.FIXED_BATCH: self.options.batch_size, Policy.TIME_DEBOUNCE: None, Policy.ADAPTIVE: self.cap}[self.options.policy]

    @property
    def steady(self) -> bool:
        """Whether a publish leaves the bound as it is."""
        return self.options.policy is not Policy.ADAPTIVE or not self.options.growing_cap

    def interval(self) -> float:
        if self.options.policy is Policy.TIME_DEBOUNCE:
            return self.options.min_interval
        if self.options.policy is Policy.ADAPTIVE:
            return max(self.options.min_interval, self.options.rebuild_factor * self.last_rebuild)
        return 0.0

    def delay(self, pending: int) -> float:
        """Seconds until the timer is to be asked again."""
        if not pending or self.options.policy in (Policy.PER_ENTRY, Policy.FIXED_BATCH):
            return math.inf
        return max(0.0, self.interval() - (self.now() - self.last_publish))

    def wait(self, pending: int, oldest: float | None) -> float:
        """Seconds until time may say to publish what is pending since ``oldest``, if nothing else arrives."""
        if not pending or oldest is None:
            return math.inf
        left = self.options.max_staleness - (self.now() - oldest)
        if self.options.policy is Policy.TIME_DEBOUNCE or (self.options.policy is Policy.ADAPTIVE and pending >= self.options.min_timer_batch):
            left = min(left, self.delay(pending))
        return max(0.0, left)

    def due(self, pending: int, oldest: float | None) -> bool:
        """Whether time says to publish what is pending since ``oldest``."""
        if not pending or oldest is None:
            return False
        if self.now() - oldest >= self.options.max_staleness:
            return True
        if self.now() - self.last_publish < self.interval():
            return False
        return self.options.policy is Policy.TIME_DEBOUNCE or (self.options.policy is Policy.ADAPTIVE and pending >= self.options.min_timer_batch)

    def done(self, rebuild: float, indexed: int) -> None:
        self.last_publish, self.last_rebuild = self.now(), rebuild
        if self.options.policy is Policy.ADAPTIVE and self.options.growing_cap:
            self.cap = max(self.options.batch_size, indexed)


@dataclass
class _Part:
    """Rows ``first`` to ``size`` of a landed micro-batch, ``rows``, are pending. ``tasks`` has the number of each task that wrote it, the rows of those before, and when its oldest entry came."""

    number: int
    first: int
    size: int
    tasks: list[tuple[int, int, float]]
    rows: DataFrame

    @property
    def at(self) -> float:
        """When the oldest of its pending entries came, to the task."""
        return min(at for (_, _, at), (_, end, _) in zip(self.tasks, [*self.tasks[1:], (0, self.size, 0.0)]) if end > self.first)


class Ingestion:
    """Feeds a stream (id, search_text[, sort_text, facets, arrived]) into a store; one run at a time.

    The landed tables and the checkpoint lie in the store's folder, by the id that the checkpoint gives the
    query, and what has been published of each query is in the store's versions. So a new object on the same store goes on where
    a run has ended, in whatever way, and another feed, or the same one read from its beginning under another
    checkpoint, has its own numbers.
    """

    def __init__(self, store: IndexStore, options: Options | None = None, on_published: Callable[[Published], None] | None = None, on_progress: Callable[[Progress], None] | None = None, now: Callable[[], float] = time.monotonic):
        self.store, self.options, self.now = store, options or Options(), now
        self.on_published, self.on_progress = on_published, on_progress
        self._query: StreamingQuery | None = None
        self._lock = threading.RLock()
        self._changed = threading.Condition(self._lock)
        self._ready = threading.Event()
        self._started = self._closed = False
        self._failure: BaseException | None = None

    def start(self, stream: DataFrame, checkpoint: str | None = None, available_now: bool = False, trigger: str | None = None, source: str = "default") -> StreamingQuery:
        """Begin; by default micro-batches follow each other as fast as they can.

        Without a checkpoint of its own a feed has one in the store by the name of the ``source``.
        """
        with self._lock:
            if self._started:
                raise RuntimeError("this ingestion has run or is running")
            self._started = True
        self.controller = Controller(self.options, self.now)
        self.accepted = self.published = self.publishes = self.pending = 0
        self.rebuild_seconds = self.worst = 0.0
        self._parts: list[_Part] = []
        self._last = -1  # number of the last micro-batch that has landed
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint or f"{self.store.path}/feeds/{source}")
        if available_now:
            writer = writer.trigger(availableNow=True)
        elif trigger:
            writer = writer.trigger(processingTime=trigger)
        self._query = writer.start()
        try:
            self._id = str(self._query.id)
            self._recover()
        except BaseException as e:
            self._failure = e
            raise
        finally:
            self._ready.set()  # micro-batches have waited for this
        self._timer = threading.Thread(target=self._watch, name="lexgrove-ingestion-timer", daemon=True)
        self._timer.start()
        return self._query

    # -- what has landed ---------------------------------------------------------------------------
    def _name(self, number: int) -> str:
        return f"pending/{self._id}/batch={number}"

    def _path(self, number: int) -> str:
        return f"{self.store.path}/{self._name(number)}"

    def _recover(self) -> None:
        """Pending entries of earlier runs of this query: what has landed and is not in the published version."""
        done = {"batch": 0, "row": 0, "published": 0, "publishes": 0} | self.store.refresh().ledger.get(self._id, {})
        self.published, self.publishes = done["published"], done["publishes"]
        for number in sorted(n for n in self.store.numbers(f"pending/{self._id}", "batch=") if self.store.exists(f"{self._name(n)}/_SUCCESS")):
            self._last = max(self._last, number)
            if number < done["batch"]:
                self.store.delete(self._name(number))  # published, and then the run was lost
                continue
            part = self._landed(number, done["row"] if number == done["batch"] else 0)
            if part.size > part.first:
                self._parts.append(part)
                self.pending += part.size - part.first
        self._last = max(self._last, done["batch"] - 1)
        self.accepted = self.published + self.pending

    def _landed(self, number: int, first: int = 0) -> _Part:
        """A landed table as what is pending."""
        tasks, total, wall = [], 0, time.time()
        rows = self.store.spark.read.parquet(self._path(number))
        for r in rows.groupBy("_task").agg(F.count("*").alias("n"), F.min("_arrived").alias("at")).orderBy("_task").collect():  # a row for each task
            tasks.append((r["_task"], total, self.now() - max(0.0, wall - r["at"])))
            total += r["n"]
        return _Part(number, first, total, tasks, rows)

    def _land(self, batch: DataFrame, number: int) -> _Part:
        """Write a micro-batch in arrival order; a row's place is its task and its place there."""
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        came = F.lit(time.time())
        batch = batch.withColumn("_arrived", F.coalesce(F.unix_micros(F.col("arrived").cast("timestamp")) / 1e6, came) if "arrived" in batch.columns else came).drop("arrived")
        placed = batch.repartitionByRange("seq", "id").sortWithinPartitions("seq", "id").withColumn("_at", F.monotonically_increasing_id())
        placed.withColumns({"_task": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit(2**33 - 1))}).drop("_at").write.mode("overwrite").parquet(self._path(number))
        return self._landed(number)

    def _slice(self, part: _Part, end: int, before: int) -> DataFrame:
        """Rows from the part's first one to ``end``, with ``seq`` counting them after ``before`` others.

        What is asked for is a range within a task, or of tasks, so that a scan reads no more than that.
        """
        spans = []  # task, its first and last wanted rows, and what its rows are counted from
        for (task, base, _), (_, stop, _) in zip(part.tasks, [*part.tasks[1:], (0, part.size, 0.0)]):
            low, high = max(part.first, base), min(end, stop)
            if low < high:
                spans.append((task, low - base, high - 1 - base, base - part.first + before))
        (t1, low, high1, _), (t2, _, high, _) = spans[0], spans[-1]
        task, nth = F.col("_task"), F.col("_nth")
        if len(spans) == 1:
            wanted = (task == t1) & nth.between(low, high1)
        else:
            wanted = ((task == t1) & (nth >= low)) | ((task > t1) & (task < t2)) | ((task == t2) & (nth <= high))
        rows = part.rows.where(wanted)
        if len(spans) == 1:
            counted = rows.withColumn("_from", F.lit(spans[0][3]).cast("bigint"))
        else:
            table = self.store.spark.createDataFrame([(s[0], s[3]) for s in spans], "_task bigint, _from bigint")
            counted = rows.join(F.broadcast(table), "_task")  # a row for each task
        return counted.withColumn("seq", F.col("_from") + nth).drop("_task", "_nth", "_from", "_arrived")

    # -- when to publish ---------------------------------------------------------------------------
    def _oldest(self) -> float | None:
        return min((p.at for p in self._parts), default=None)

    def _batch(self, batch: DataFrame, number: int) -> None:
        self._ready.wait()
        with self._lock:
            if self._failure:
                raise self._failure
            if number > self._last:
                part = self._land(batch, number)
                self._last = number
                self.accepted += part.size
                if part.size:
                    self._parts.append(part)
                    self.pending += part.size
            bound, most = self.controller.bound(), 1
            while bound is not None and self.pending >= bound:
                self._publish(bound, min(most, self.pending // bound) if self.controller.steady else 1)
                bound, most = self.controller.bound(), min(4 * most, TOGETHER)
            if self.controller.due(self.pending, self._oldest()):
                self._publish(self.pending)
            self._changed.notify_all()
            if self.on_progress:
                self.on_progress(Progress(self.accepted, self.published, self.publishes, self.pending))

    def _watch(self) -> None:
        """Publish what time makes due while nothing arrives."""
        with self._lock:
            while not self._closed:
                left = self.controller.wait(self.pending, self._oldest())
                # the clock may be another than the machine's, so it is asked again from time to time
                self._changed.wait(None if left == math.inf else min(left, 0.5))
                try:
                    if not self._closed and self.controller.due(self.pending, self._oldest()):
                        self._publish(self.pending)
                except Exception as e:
                    self._failure = e  # the next micro-batch, or the end, raises it
                    return

    def _publish(self, each: int, versions: int = 1) -> None:
        """Make the first ``each`` pending entries searchable, and as many more in each further version."""
        n = each * versions
        began, rest, slices, taken = self.now(), n, [], list(self._parts)
        while rest:
            part = taken[0]
            m = min(rest, part.size - part.first)
            slices.append(self._slice(part, part.first + m, n - rest))
            self.worst = max(self.worst, began - part.at)
            rest -= m
            taken[0] = replace(part, first=part.first + m)
            if taken[0].first == part.size:
                del taken[0]
        at = (taken[0].number, taken[0].first) if taken else (self._last + 1, 0)
        said = {"batch": at[0], "row": at[1], "published": self.published + n, "publishes": self.publishes + versions}
        out = slices[0]
        for s in slices[1:]:
            out = out.unionByName(s)
        indexed = self.store.publish(out, (self._id, said), each, versions)
        for old in {p.number for p in self._parts} - {p.number for p in taken}:
            self.store.delete(self._name(old))
        self._parts = taken
        took = self.now() - began
        self.pending -= n
        self.published += n
        self.rebuild_seconds += took
        self.controller.done(took, indexed[-1])
        for entries in indexed:
            event = Published(each, entries, took / versions, self.publishes)
            self.publishes += 1
            if self.on_published:
                self.on_published(event)

    # -- the end -----------------------------------------------------------------------------------
    def finish(self, timeout: float | None = None) -> Result:
        """Wait for the end of a bounded stream, publish the rest, and report."""
        self._query.awaitTermination(timeout)
        return self._close(False, True)

    def stop(self) -> Result:
        """Stop a running stream; what is pending is published or left out, as the options say."""
        self._query.stop()
        return self._close(True, self.options.flush_on_stop)

    def _close(self, stopped: bool, flush: bool) -> Result:
        with self._lock:
            self._closed = True
            self._changed.notify_all()
            if self._failure:
                raise self._failure
            if flush and self.pending:
                self._publish(self.pending)
            return Result(self.accepted, self.published, self.publishes, self.store.entry_count(), self.rebuild_seconds, self.worst, stopped)


def publish_plan(arrivals: Column, policy: Policy, batch_size: int = 2_000, growing_cap: bool = True) -> Column:
    """In which publish (from 0) the n-th entry (from 1) of an instant feed into an empty index lands.

    Each fixed batch has its number of entries. With a growing cap the second publish waits for as
    many entries as the first had, and each later one doubles what is indexed.
    """
    n = arrivals
    if policy is Policy.PER_ENTRY:
        return (n - 1).cast("bigint")
    if policy is Policy.FIXED_BATCH or (policy is Policy.ADAPTIVE and not growing_cap):
        return F.floor((n - 1) / batch_size)
    if policy is Policy.ADAPTIVE:
        # the least k with n <= batch_size * 2 ** k, from the length of a number in binary
        blocks = F.floor((n - 1) / batch_size)
        return F.when(blocks < 1, F.lit(0)).otherwise(F.length(F.bin(blocks))).cast("bigint")
    return F.lit(0).cast("bigint")
