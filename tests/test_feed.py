"""A feed that holds its producers back, and what it keeps over restarts."""

import threading
import time

import pytest

from lexgrove.sources.store import IndexStore
from lexgrove.streaming.feed import Feed
from lexgrove.streaming.ingest import Ingestion, Options, Policy


def test_a_fast_producer_waits_for_slow_publishes(spark, tmp_path, monkeypatch):
    store, held, errors = IndexStore(spark, str(tmp_path / "index")), [], []
    publish = IndexStore.publish
    monkeypatch.setattr(IndexStore, "publish", lambda self, *a, **k: (held.append(feed.pending()), time.sleep(0.5), publish(self, *a, **k))[2])
    feed = Feed(store, capacity=20)
    ingestion = Ingestion(store, Options(Policy.FIXED_BATCH, batch_size=10, max_staleness=1.0))
    feed.start(ingestion)

    def produce(first):
        try:
            own = Feed(IndexStore(spark, store.path), capacity=20)  # as another process would
            for i in range(first, first + 30, 6):
                own.put({k: f"word{k}" for k in range(i, i + 6)}, timeout=120)
                held.append(own.pending())
        except Exception as e:
            errors.append(e)

    producers = [threading.Thread(target=produce, args=(at,)) for at in (0, 100)]
    for t in producers:
        t.start()
    for t in producers:
        t.join()
    end = time.time() + 60
    while ingestion.published < 60 and time.time() < end:
        time.sleep(0.1)
    result = ingestion.stop()
    assert not errors and result.accepted == result.published == 60 == store.entry_count()
    assert max(held) <= 20 and max(held) > 10 and feed.pending() == 0
    assert {r.id for r in store.current.docs.select("id").collect()} == {*range(30), *range(100, 130)}


def test_room_and_restarts(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    feed = Feed(store, "a", capacity=5)
    assert feed.put({1: "one", 2: ("two", "sort", {"f": 7})}) == 2 and feed.pending() == 2
    with pytest.raises(TimeoutError):
        feed.put({i: "x" for i in range(4)}, timeout=0.3)
    with pytest.raises(ValueError):
        feed.put({i: "x" for i in range(6)})
    assert feed.put({}) == 0 and Feed(store, "a", capacity=5).pending() == 2 and Feed(store, "b").pending() == 0
    time.sleep(1)
    first = Ingestion(store, Options(Policy.FIXED_BATCH, batch_size=100, max_staleness=1000))
    feed.start(first, available_now=True)
    result = first.finish()
    assert result.published == 2 and result.worst_staleness >= 1  # time before landing counts
    assert feed.pending() == 0 and feed.put({3: "three", 1: "again"}) == 2 and Feed(IndexStore(spark, store.path), "a", 5).pending() == 2
    second = Ingestion(store, Options(Policy.FIXED_BATCH, batch_size=100, max_staleness=1000))
    feed.start(second, available_now=True)
    assert second.finish().published == 4 and store.entry_count() == 3 and store.current.count("again") == 1 and feed.pending() == 0
    assert not [n for n in store.names("feeds-put/a") if n.startswith("aside")]
    with pytest.raises(ValueError):
        Feed(store, capacity=0)
