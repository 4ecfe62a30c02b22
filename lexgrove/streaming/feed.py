"""A feed that makes its producers wait: at most ``capacity`` entries are there that no version has yet.

Producers put chunks of entries into a folder of the store, with the time at which they came; a file stream reads
it. A chunk is written aside, then numbered with its rows, by a file that only one producer can make, and only then moved to
where the stream looks. What has been put is the sum of these numbers, and what has been published is in the
store's ledger, so that producers in other processes, or after a restart, keep to the same bound. A producer that is lost
between its number and the move leaves room for its chunk taken.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgrove.sources.store import ENTRY, IndexStore, entries
from lexgrove.streaming.ingest import Ingestion

SHAPE = ENTRY + ", seq bigint, arrived timestamp"
COLUMNS = ("id", "search_text", "sort_text", "facets")


class Feed:
    """Entries on their way into a store, by the name of the feed."""

    def __init__(self, store: IndexStore, name: str = "feed", capacity: int = 10_000):
        if capacity < 1:
            raise ValueError(f"capacity is out of range: {capacity}")
        self.store, self.name, self.capacity = store, name, capacity
        self._base = f"feeds-put/{name}"
        self._next, self._put = 0, 0

    @property
    def checkpoint(self) -> str:
        return f"{self.store.path}/feeds/{self.name}"

    def stream(self, chunks: int = 64) -> DataFrame:
        """What has been put, as a stream of ``chunks`` files at most in a micro-batch."""
        spark = self.store.spark
        fs, place = self.store._fs(f"{self._base}/chunks")
        fs.mkdirs(place)
        return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", chunks).option("recursiveFileLookup", "true").parquet(f"{self.store.path}/{self._base}/chunks")

    def start(self, ingestion: Ingestion, **how) -> StreamingQuery:
        """Let an ingestion publish what is put."""
        return ingestion.start(self.stream(), self.checkpoint, **how)

    # -- how much is there ---------------------------------------------------------------------------
    def put_so_far(self) -> int:
        """Entries that were put, by all producers."""
        while self.store.exists(f"{self._base}/n={self._next}"):
            self._put += int(self.store.read(f"{self._base}/n={self._next}"))
            self._next += 1
        return self._put

    def published(self) -> int:
        said = f"feeds/{self.name}/metadata"
        if not self.store.exists(said):
            return 0
        return self.store.refresh().ledger.get(json.loads(self.store.read(said))["id"], {}).get("published", 0)

    def pending(self) -> int:
        """Entries that were put and are in no version yet."""
        published = self.published()  # first, so that it is never ahead
        return self.put_so_far() - published

    # -- producers -----------------------------------------------------------------------------------
    def put(self, rows: DataFrame | Mapping[int, object] | Iterable[tuple], timeout: float | None = None) -> int:
        """Put entries when there is room for all of them; their number. ``TimeoutError`` if there is none in time."""
        came = time.time()
        df = rows if isinstance(rows, DataFrame) else entries(self.store.spark, rows)
        for name, kind in (("sort_text", "string"), ("facets", "map<string,bigint>")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        own, seen = f"{self._base}/aside-{uuid.uuid4().hex}", Observation()
        seq = F.col("seq").cast("bigint") if "seq" in df.columns else F.monotonically_increasing_id()
        shaped = df.select(*COLUMNS, seq.alias("seq"), F.timestamp_micros(F.lit(int(came * 1e6))).alias("arrived"))
        shaped.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.store.path}/{own}")
        n = seen.get.get("rows", 0)
        try:
            if n > self.capacity:
                raise ValueError(f"{n} entries at once are more than the capacity of {self.capacity}")
            if n:
                self._enter(own, n, None if timeout is None else came + timeout)
        finally:
            self.store.delete(own)
        return n

    def _enter(self, own: str, n: int, until: float | None) -> None:
        while True:
            if self.pending() + n <= self.capacity:
                if self.store.claim(f"{self._base}/n={self._next}", str(n)):
                    fs, aside = self.store._fs(own)
                    _, place = self.store._fs(f"{self._base}/chunks/{self._next:012d}")
                    fs.mkdirs(place.getParent())
                    if not fs.rename(aside, place):
                        raise OSError(f"cannot move {aside} to {place}")
                    return
                continue  # another producer was first, so count again
            if until is not None and time.time() >= until:
                raise TimeoutError(f"no room for {n} entries")
            time.sleep(0.05)
