import math
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexgrove.operators.facets import Range
from lexgrove.sources.store import IndexStore
from lexgrove.streaming.ingest import Controller, Ingestion, Options, Policy, publish_plan


def feed(spark, folder, n, files=4):
    df = spark.range(n).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("search_text"), F.create_map(F.lit("size"), F.col("id") * 100).alias("facets"), F.col("id").alias("seq"))
    df.repartitionByRange(files, "id").write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, tmp_path, options, n, **more):
    store, events = IndexStore(spark, str(tmp_path / "index")), []
    ingestion = Ingestion(store, options, on_published=events.append, **more)
    ingestion.start(feed(spark, tmp_path / "feed", n), available_now=True)
    return store, ingestion, events, ingestion.finish()


def test_adaptive(spark, tmp_path):
    progress = []
    store, ingestion, events, result = run(spark, tmp_path, Options(batch_size=50), 500, on_progress=progress.append)
    assert result.accepted == result.published == result.indexed == 500 and not result.stopped
    assert [e.sequence for e in events] == list(range(result.publishes)) and sum(e.entries for e in events) == 500
    assert store.current.count(None, facets=Range("size", 25_000, 10**9)) == 250 and progress[-1].accepted == 500
    with pytest.raises(RuntimeError):
        ingestion.start(None)


def test_fixed_batches_are_exact(spark, tmp_path):
    _, _, events, result = run(spark, tmp_path, Options(Policy.FIXED_BATCH, batch_size=40, max_staleness=1000), 130)
    assert [e.entries for e in events] == [40, 40, 40, 10] and result.publishes == 4


def test_per_entry(spark, tmp_path):
    _, _, events, _ = run(spark, tmp_path, Options(Policy.PER_ENTRY), 4)
    assert [e.entries for e in events] == [1, 1, 1, 1] and [e.indexed for e in events] == [1, 2, 3, 4]


@pytest.mark.parametrize("flush", [True, False])
def test_stop(spark, tmp_path, flush):
    store = IndexStore(spark, str(tmp_path / "index"))
    ingestion = Ingestion(store, Options(Policy.TIME_DEBOUNCE, min_interval=1000, max_staleness=1000, flush_on_stop=flush))
    query = ingestion.start(feed(spark, tmp_path / "feed", 30))
    end = time.time() + 60
    while ingestion.accepted < 30 and time.time() < end:
        time.sleep(0.1)
    assert query.isActive
    result = ingestion.stop()
    assert result.stopped and result.accepted == 30 and result.published == (30 if flush else 0) and store.entry_count() == result.published


def test_later_entry_of_an_id_holds(spark, tmp_path):
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "id bigint, search_text string, seq bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    store = IndexStore(spark, str(tmp_path / "index"))
    store.rebuild_from_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed")))
    assert store.current.count("new") == 1 and store.current.count("old") == 0


def test_controller():
    now = [0.0]
    c = Controller(Options(batch_size=10, min_interval=1.0, rebuild_factor=2.0, max_staleness=30.0, min_timer_batch=5), lambda: now[0])
    assert c.bound() == 10 and not c.due(4, 0.0) and c.delay(4) == 1.0 and c.delay(0) == math.inf
    now[0] = 1.5
    assert not c.due(4, 0.0) and c.due(5, 0.0)
    c.done(3.0, 25)
    assert c.bound() == 25 and c.interval() == 6.0
    now[0] = 40.0
    assert c.due(1, 9.0) and not c.due(0, None)
    d = Controller(Options(Policy.TIME_DEBOUNCE, min_interval=1.0), lambda: now[0])
    now[0] += 0.5
    assert d.bound() is None and not d.due(1, now[0])
    now[0] += 0.6
    assert d.due(1, now[0]) and Controller(Options(Policy.PER_ENTRY)).delay(1) == math.inf


@pytest.mark.parametrize("bad", [{"batch_size": 0}, {"min_interval": -1}, {"rebuild_factor": 0}, {"capacity": 0}, {"max_staleness": 0}, {"min_timer_batch": 0}])
def test_options(bad):
    with pytest.raises(ValueError):
        Options(**bad)


@pytest.mark.parametrize("n,batch,publishes", [(20_000, 2_000, 5), (100_000, 2_000, 7)])
def test_growing_cap_plan(spark, n, batch, publishes):
    seq = spark.range(1, n + 1).select(publish_plan(F.col("id"), Policy.ADAPTIVE, batch).alias("s"))
    assert seq.agg(F.count_distinct("s")).first()[0] == publishes
    fixed = spark.range(1, n + 1).select(publish_plan(F.col("id"), Policy.ADAPTIVE, batch, False).alias("s"))
    assert fixed.agg(F.count_distinct("s")).first()[0] == n // batch


def waiting(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    return condition()


@pytest.mark.parametrize("options", [Options(Policy.TIME_DEBOUNCE, min_interval=2.0, max_staleness=1000), Options(Policy.ADAPTIVE, batch_size=1000, max_staleness=2.0), Options(Policy.FIXED_BATCH, batch_size=1000, max_staleness=2.0), Options(Policy.ADAPTIVE, batch_size=1000, min_interval=2.0, min_timer_batch=5, max_staleness=1000)])
def test_a_quiet_feed_is_published_by_time(spark, tmp_path, options):
    store = IndexStore(spark, str(tmp_path / "index"))
    ingestion = Ingestion(store, options)
    ingestion.start(feed(spark, tmp_path / "feed", 20, files=1))
    assert waiting(lambda: ingestion.accepted == 20) and waiting(lambda: ingestion.published == 20, 30)
    assert store.entry_count() == 20  # no more entries came, and nobody stopped it
    assert ingestion.stop().published == 20


def test_few_entries_wait_for_staleness(spark, tmp_path):
    ingestion = Ingestion(IndexStore(spark, str(tmp_path / "index")), Options(Policy.ADAPTIVE, batch_size=1000, min_interval=0.1, min_timer_batch=200, max_staleness=1000))
    ingestion.start(feed(spark, tmp_path / "feed", 20, files=1))
    assert waiting(lambda: ingestion.accepted == 20)
    time.sleep(2)
    assert ingestion.published == 0 and ingestion.stop().published == 20


def test_a_run_goes_on_where_one_was_lost(spark, tmp_path):
    """Landed entries that were not published are pending again; nothing is lost or counted twice."""
    store = IndexStore(spark, str(tmp_path / "index"))
    first = Ingestion(store, Options(Policy.FIXED_BATCH, batch_size=12, max_staleness=1000, flush_on_stop=False))
    stream = feed(spark, tmp_path / "feed", 30, files=1)
    first.start(stream)
    assert waiting(lambda: first.accepted == 30) and waiting(lambda: first.published == 24)
    first.stop()  # six are left out, and the checkpoint has moved on

    again = IndexStore(spark, str(tmp_path / "index"))
    assert again.entry_count() == 24
    spark.createDataFrame([(100 + i, f"late{i}", {"size": i}, 100 + i) for i in range(5)], "id bigint, search_text string, facets map<string,bigint>, seq bigint").write.mode("append").parquet(str(tmp_path / "feed"))
    events = []
    second = Ingestion(again, Options(Policy.FIXED_BATCH, batch_size=12, max_staleness=1000), on_published=events.append)
    second.start(stream, available_now=True)
    result = second.finish()
    assert result.accepted == result.published == 35 == again.entry_count()
    assert sum(e.entries for e in events) == 11 and events[0].sequence == 2
    assert {r.id for r in again.current.docs.select("id").collect()} == {*range(30), *range(100, 105)}


def test_a_repeated_batch_is_taken_once(spark, tmp_path):
    ingestion = Ingestion(IndexStore(spark, str(tmp_path / "index")), Options(Policy.FIXED_BATCH, batch_size=1000, max_staleness=1000))
    ingestion.start(feed(spark, tmp_path / "feed", 10, files=1), available_now=True)
    ingestion._query.awaitTermination()
    batch = spark.createDataFrame([(1, "a", {"size": 1}, 1)], "id bigint, search_text string, facets map<string,bigint>, seq bigint")
    ingestion._batch(batch, 0)
    assert ingestion.accepted == ingestion.pending == 10
    assert ingestion.finish().published == 10


def test_versions_expire(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    for i in range(4):
        store.add_entry(i, f"word{i}")
    store.expire(2)
    assert sorted(store.numbers("", "v=")) == [2, 3] and store.entry_count() == 4 and IndexStore(spark, store.path).entry_count() == 4


def rows_in(spark, folder, rows):
    df = spark.createDataFrame([(i, f"word{i}", i) for i in rows], "id bigint, search_text string, seq bigint")
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def test_another_feed_and_another_checkpoint(spark, tmp_path):
    """Each checkpoint has numbers of its own: what a second feed brings is no repeat of the first one's."""
    store, results = IndexStore(spark, str(tmp_path / "index")), []
    options = Options(Policy.FIXED_BATCH, batch_size=4, max_staleness=1000)
    for name, rows in (("a", range(10)), ("b", range(10, 20))):
        ingestion = Ingestion(IndexStore(spark, store.path), options)
        ingestion.start(rows_in(spark, tmp_path / name, rows), str(tmp_path / f"checkpoint-{name}"), available_now=True)
        results.append(ingestion.finish())
    assert [(r.accepted, r.published, r.publishes) for r in results] == [(10, 10, 3)] * 2 and results[1].indexed == 20
    again = Ingestion(store, options)  # the first feed from its beginning, under a new checkpoint: its entries come again and replace
    again.start(rows_in(spark, tmp_path / "a", [77]), available_now=True, source="again")
    assert again.finish().accepted == 11 and store.entry_count() == 21
    assert len(store.refresh().ledger) == 3
    more = Ingestion(store, options)  # and the second one where it ended
    more.start(rows_in(spark, tmp_path / "b", [88]), str(tmp_path / "checkpoint-b"), available_now=True)
    result = more.finish()
    assert (result.accepted, result.published, result.indexed) == (11, 11, 22)


def test_two_feeds_at_once(spark, tmp_path):
    path, out = str(tmp_path / "index"), []
    both = [Ingestion(IndexStore(spark, path), Options(Policy.FIXED_BATCH, batch_size=3, max_staleness=1000)) for _ in range(2)]
    for i, x in enumerate(both):
        x.start(rows_in(spark, tmp_path / f"feed{i}", range(i * 100, i * 100 + 7)), available_now=True, source=f"feed{i}")
    for x in both:
        out.append(x.finish())
    assert [(r.accepted, r.published) for r in out] == [(7, 7)] * 2 and IndexStore(spark, path).entry_count() == 14


def test_places_do_not_grow_with_the_number_of_the_batch(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    ingestion = Ingestion(store, Options(Policy.FIXED_BATCH, batch_size=5, max_staleness=1000))
    ingestion.start(rows_in(spark, tmp_path / "feed", range(10)), available_now=True)
    ingestion._query.awaitTermination()
    for number in (5_000, 2**40):
        ingestion._batch(spark.createDataFrame([(number + i, "late", i) for i in range(5)], "id bigint, search_text string, seq bigint"), number)
    assert ingestion.finish().published == 20 and store.refresh().next == 20
    assert sorted(x.ordinal for x in store.current.docs.select("ordinal").collect()) == list(range(20))


def test_staleness_counts_from_when_an_entry_came(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i}", i) for i in range(6)], "id bigint, search_text string, seq bigint")
    df = df.withColumn("arrived", F.current_timestamp() - F.expr("make_interval(0, 0, 0, 0, 0, 100 - id, 0)"))
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream, store = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed")), IndexStore(spark, str(tmp_path / "index"))
    options = Options(Policy.FIXED_BATCH, batch_size=4, max_staleness=10**6, flush_on_stop=False)
    first = Ingestion(store, options)
    first.start(stream, str(tmp_path / "checkpoint"))
    assert waiting(lambda: first.published == 4)
    result = first.stop()
    assert 100 * 60 <= result.worst_staleness < 102 * 60 and result.published == 4
    second = Ingestion(store, options)
    second.start(stream, str(tmp_path / "checkpoint"), available_now=True)
    result = second.finish()
    assert 95 * 60 <= result.worst_staleness < 103 * 60 and result.published == 6 and store.entry_count() == 6


def test_a_slice_reads_its_own_rows(spark, tmp_path):
    ingestion = Ingestion(IndexStore(spark, str(tmp_path / "index")), Options(Policy.TIME_DEBOUNCE, min_interval=1000, max_staleness=1000))
    ingestion.start(rows_in(spark, tmp_path / "feed", range(40)), available_now=True)
    ingestion._query.awaitTermination()
    part = ingestion._parts[0]
    for first, end in ((0, 40), (0, 1), (7, 33), (39, 40)):
        rows = ingestion._slice(replace(part, first=first), end, 100)
        assert sorted((r.id, r.seq) for r in rows.collect()) == [(i, 100 + i - first) for i in range(first, end)]
    assert ingestion.finish().published == 40


@pytest.mark.parametrize("options", [Options(Policy.FIXED_BATCH, batch_size=3, max_staleness=1000), Options(Policy.ADAPTIVE, batch_size=3, growing_cap=False, min_interval=1000, max_staleness=1000), Options(Policy.PER_ENTRY, max_staleness=1000)])
def test_many_due_publishes_take_few_jobs_and_are_versions_of_their_own(spark, tmp_path, options, monkeypatch):
    each, n = 1 if options.policy is Policy.PER_ENTRY else 3, 32
    store, events, calls, publish = IndexStore(spark, str(tmp_path / "index")), [], [], IndexStore.publish
    monkeypatch.setattr(IndexStore, "publish", lambda self, *a, **k: calls.append(1) or publish(self, *a, **k))
    ingestion = Ingestion(store, options, on_published=events.append)
    ingestion.start(rows_in(spark, tmp_path / "feed", range(n)), available_now=True)
    result = ingestion.finish()
    sizes = [each] * (n // each) + [n % each] * (n % each > 0)
    assert [e.entries for e in events] == sizes and [e.indexed for e in events] == [sum(sizes[: i + 1]) for i in range(len(sizes))]
    assert result.publishes == len(sizes) == store.version + 1 and len(calls) <= 5  # one for each publish before
    for number in (0, 1, 4, 6, store.version):
        assert sorted(x.id for x in store.at(number).docs.select("id").collect()) == list(range(sum(sizes[: number + 1])))
    assert IndexStore(spark, store.path).refresh().ledger == store.refresh().ledger and store.refresh().ledger[ingestion._id]["publishes"] == len(sizes)
