"""Segments, merges, writers that meet, and readers that follow."""

import random
import threading

import pytest
from helpers import ids
from pyspark.sql import functions as F

from lexgrove.functions.text import FILE_MASK, Tokenization
from lexgrove.operators.facets import Range
from lexgrove.operators.index import NATURAL, SearchIndex
from lexgrove.operators.matching import WITHIN
from lexgrove.operators.postings import vocabulary
from lexgrove.sources import store as stored
from lexgrove.sources.store import IndexStore, Registry, Segment, due_for_merge, entries


def segments(store):
    return store.refresh().segments


def test_a_change_writes_its_own_rows_only(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.rebuild(spark.range(20_000).select("id", F.concat(F.lit("word"), F.col("id").cast("string")).alias("search_text"), F.col("id").alias("seq")))
    base = segments(store)
    changed = spark.range(19_950, 20_050).select("id", F.lit("changed").alias("search_text"), F.col("id").alias("seq"))
    store.upsert(changed)
    now = segments(store)
    assert now[0] == base[0] and [(s.rows, s.gone) for s in now[1:]] == [(100, 50)] and store.entry_count() == 20_050
    assert spark.read.parquet(f"{store.path}/segments/{now[1].name}/rows").count() == 100
    assert store.current.count("changed") == 100 and store.current.count("word19960") == 0 and store.current.document_count() == 20_050
    assert ids(store.current.find("changed")) == [*range(19_950, 20_050)]
    assert store.remove(range(100)) == 100 and store.remove(range(100)) == 0 and store.entry_count() == 19_950
    assert segments(store)[0] == base[0] and store.current.document_count() == 19_950 and not store.contains(99) and store.contains(100)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_are_those_of_a_dictionary(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(stored, "FANOUT", 3)
    monkeypatch.setattr(stored, "LEAST", 4)
    if seed == 2:
        monkeypatch.setattr(stored, "MOST_SENT", 0)  # no ids are broadcast
    r, store, want = random.Random(seed), IndexStore(spark, str(tmp_path / "index")), {}
    for step in range(14):
        how = r.random()
        if how < 0.6:
            new = {r.randrange(12): (f"w{r.randrange(5)} s{step}", f"n{r.randrange(3)} {'x' * 80} {r.randrange(3)}", {r.choice("ab"): step + 1}) for _ in range(r.randint(1, 5))}
            store.add_or_update_entries(new)
            want = {k: new.get(k, v) for k, v in want.items()} | new
        elif how < 0.9:
            gone = {r.randrange(12) for _ in range(3)}
            assert store.remove_entries(gone) == len(gone & want.keys())
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            store.rebuild_from(dict(list(want.items())[:4]))
            want = dict(list(want.items())[:4])
        assert store.entry_count() == store.current.document_count() == len(want)
    index = store.current
    assert {(x.id, x.search_text) for x in index.docs.select("id", "search_text").collect()} == {(k, v[0]) for k, v in want.items()}
    assert ids(index.find("*")) == list(want)  # the order of first arrival
    for name in index.facets:
        assert set(ids(index.find(None, facets=Range(name, 1, 100)))) == {k for k, v in want.items() if v[2].get(name)}
    pad = lambda t: "|".join(f"0:{p:0>12}" if p.isdigit() else f"1:{p}" for p in t.replace("n", "n ").split())
    assert ids(index.find("*", sort=NATURAL)) == sorted(want, key=lambda k: (pad(want[k][1]), k))
    assert len(segments(store)) <= 3 * 4
    counted = {(x.word, x.length, x.documents) for x in vocabulary(SearchIndex(index.docs)).collect()}
    assert {tuple(x) for x in index.counts.words().select("word", "length", "documents").collect()} == counted
    assert index.unique_word_count() == len(counted)


def test_merges_keep_few_segments_and_expiry_only_what_is_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "FANOUT", 3)
    store = IndexStore(spark, str(tmp_path / "index"))
    for i in range(7):
        store.add_entry(i % 5, f"word{i}")
    assert len(segments(store)) <= 3 and store.entry_count() == 5
    assert {x.search_text for x in store.current.docs.collect()} == {"word5", "word6", "word2", "word3", "word4"}
    list(store.current.find("*", sort=NATURAL).collect())
    store.expire(1)
    assert set(store.names("segments")) == {s.name for s in segments(store)} and store.numbers("", "v=") == [6]
    assert sorted(ids(IndexStore(spark, store.path).current.find("word*"))) == [0, 1, 2, 3, 4]


def test_levels():
    of = lambda *n: tuple(Segment(str(i), x) for i, x in enumerate(n))
    assert due_for_merge(of(*[10] * 7)) is None and due_for_merge(of(*[10] * 8)) == 0
    assert due_for_merge(of(10**6, *[10] * 8)) == 1 and due_for_merge(of(10**6, 10**6, *[10] * 7)) is None
    assert due_for_merge(of(*[9000] * 7, *[10] * 8)) == 7 and due_for_merge(of(*[9000] * 8, 10)) == 0 and due_for_merge(()) is None


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    first = IndexStore(spark, str(tmp_path / "index"))
    second = IndexStore(spark, str(tmp_path / "index"))
    first.add_entry(1, "one")
    second.add_entry(2, "two")
    assert first.entry_count() == second.entry_count() == 2 and second.version == 1

    errors = []

    def write(store, at):
        try:
            for i in range(3):
                store.add_entry(at + i, "many")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(IndexStore(spark, first.path), at)) for at in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and set(ids(first.current.find("*"))) == {1, 2, 10, 11, 12, 20, 21, 22} and first.version == 7
    ordinals = [x.ordinal for x in first.current.docs.select("ordinal").collect()]
    assert len(set(ordinals)) == 8


def test_a_change_is_done_again_on_what_another_left(spark, tmp_path, monkeypatch):
    store, other = IndexStore(spark, str(tmp_path / "index")), IndexStore(spark, str(tmp_path / "index"))
    store.rebuild_from({1: "old", 2: "old"})
    claim, calls = IndexStore.claim, []

    def late(self, name, text):
        if self is store and not calls:
            calls.append(name)
            other.add_entry(3, "between")  # takes the version's number
            other.remove_entry(1)
        return claim(self, name, text)

    monkeypatch.setattr(IndexStore, "claim", late)
    store.add_or_update_entries({1: "new", 3: "new"})
    assert calls == ["v=1"] and store.version == 3 and store.entry_count() == 3
    assert {(x.id, x.search_text) for x in store.current.docs.collect()} == {(1, "new"), (2, "old"), (3, "new")}
    assert ids(store.current.find("*")) == [2, 3, 1]  # removed in between, so it came last
    assert set(store.names("segments")) == {s.name for n in range(4) for s in stored.Version.of(store.read(f"v={n}")).segments}


def test_readers_follow_and_keep_what_they_have(spark, tmp_path):
    writer, reader = IndexStore(spark, str(tmp_path / "index")), IndexStore(spark, str(tmp_path / "index"))
    assert reader.entry_count() == 0
    writer.rebuild_from({1: "one"})
    held = reader.current
    assert held.document_count() == 1
    for i in range(2, 6):
        writer.add_entry(i, "more")
    assert reader.current.document_count() == 5 and reader.version == 4 and held.document_count() == 1
    assert reader.current is reader.current
    writer.expire(1)
    assert reader.version == 4 and reader.current.document_count() == 5


def test_empty_changes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    none = spark.createDataFrame([], stored.ENTRY)
    store.rebuild(none)
    store.upsert(none)
    assert store.entry_count() == store.current.document_count() == 0 and store.remove([1]) == 0
    store.upsert(spark.createDataFrame([(None, "x", 1), (1, None, 2), (1, "late", None)], "id bigint, search_text string, seq int"))
    assert store.entry_count() == 1 and store.current.docs.first().search_text == ""
    store.clear()
    assert store.entry_count() == 0 and ids(store.current.find("*")) == []


def test_numbers_far_apart_become_dense(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    for step in range(3):
        rows = [(step * 10 + i, "w", (i - 1) * 2**61) for i in range(3)] + [(step * 10, "last", 2**61)]
        store.upsert(spark.createDataFrame(rows, "id bigint, search_text string, seq bigint"))
    assert store.refresh().next < 100 and ids(store.current.find("*")) == [0, 1, 2, 10, 11, 12, 20, 21, 22]
    assert ids(store.current.find("last")) == [0, 10, 20]


def test_facets_of_any_name_come_and_go(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.rebuild_from({1: ("a", None, {"first one": 5})})
    store.add_entry(2, ("b", None, {"second": 7}))
    index = store.current
    assert index.facets == ["first one", "second"]
    assert ids(index.find(None, facets=Range("second", 0, 0))) == [1] and ids(index.find(None, facets=Range("first one", 5, 5))) == [1]


def test_names_are_kept(spark, tmp_path):
    base = str(tmp_path / "base")
    Registry(spark, base).register("häuser/alle", Tokenization.create("/", " "), {1: "a b/c"})
    Registry(spark, base).register("", FILE_MASK)
    again = Registry(spark, base)
    assert again.names() == ["", "häuser/alle"] and again["häuser/alle"].current.count("a b", WITHIN) == 1
    assert again[""].preset == FILE_MASK
    with pytest.raises(ValueError):
        again.register("häuser/alle")
    with pytest.raises(KeyError):
        again["none"]


def test_places_of_one_claim(spark, tmp_path):
    store, won = IndexStore(spark, str(tmp_path / "index")), []
    threads = [threading.Thread(target=lambda n=n: won.append((n, store.claim("v=0", stored.Version(0, entries=n).text())))) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [n for n, ok in won if ok] == [stored.Version.of(store.read("v=0")).entries] and len(won) == 8
    assert store.names() == ["v=0"] and entries(spark, {}).count() == 0


def test_words_are_counted_once_for_each_segment(spark, tmp_path, monkeypatch):
    store, counted, count = IndexStore(spark, str(tmp_path / "index")), [], stored.WordCounts._counted
    store.rebuild_from({i: f"common word{i}" for i in range(20)})
    monkeypatch.setattr(stored.WordCounts, "_counted", staticmethod(lambda rows: counted.append(1) or count(rows)))
    assert store.current.unique_word_count() == store.current.unique_word_count() == 21 and len(counted) == 1
    store.add_entry(20, "common new")
    assert IndexStore(spark, store.path).current.unique_word_count() == 22 and len(counted) == 2
    plan = store.current.counts.words()._jdf.queryExecution().executedPlan().toString()
    assert "tokens" not in plan  # no texts are taken apart


def test_a_build_tells_how_far_it_is(spark, tmp_path):
    slow = spark.range(0, 64, 1, 16).select("id", F.concat(F.lit("w"), F.expr("CAST(aggregate(sequence(1, 60000), 0L, (a, x) -> a + (x * id) % 7) AS STRING)")).alias("search_text"))
    heard = []
    SearchIndex.build(slow, id="id", text="search_text").written(str(tmp_path / "built"), heard.append)
    assert heard[0] == 0.0 and heard[-1] == 1.0 and heard == sorted(heard) and any(0 < x < 1 for x in heard)
    told = []
    assert IndexStore(spark, str(tmp_path / "index")).rebuild(slow, told.append).document_count() == 64
    assert told[0] == 0.0 and told[-1] == 1.0 and told == sorted(told) and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


@pytest.mark.parametrize("start", [0, 9])
def test_versions_written_together_are_those_written_one_by_one(spark, tmp_path, start):
    """Entries, rows, places and facets of each version, with ids that come again within it, in a later one, and from before."""
    r, both = random.Random(start), [IndexStore(spark, str(tmp_path / n)) for n in ("one", "together")]
    rows = [(r.randrange(25), f"text{i}", None, {"size": i} if i % 3 else None, i) for i in range(60)]
    shape = "id bigint, search_text string, sort_text string, facets map<string,bigint>, seq bigint"
    for store in both:
        if start:
            store.rebuild_from({i: f"old{i}" for i in range(start)})
    one, together = both
    told = [one.publish(spark.createDataFrame(rows[i : i + 6], shape))[0] for i in range(0, 60, 6)]
    assert together.publish(spark.createDataFrame(rows, shape), each=6, versions=10) == told
    assert together.version == one.version and len(together.numbers("", "v=")) == bool(start) + 1
    size = stored.PREFIX + "size"
    for number in range(together.version + 1):
        want, got = one.at(number), together.at(number)
        assert {(x.id, x.search_text, x[size] if size in want.docs.columns else 0) for x in want.docs.collect()} == {(x.id, x.search_text, x[size] if size in got.docs.columns else 0) for x in got.docs.collect()}
        assert ids(got.find("*")) == ids(want.find("*"))
    for store in both:
        store.add_entry(1, "later")
        store.remove_entry(2)
    assert together.version == one.version and {x.search_text for x in together.current.docs.collect()} == {x.search_text for x in one.current.docs.collect()}
    follower = IndexStore(spark, together.path)
    assert follower.version == one.version and follower.entry_count() == one.entry_count()
    with pytest.raises(ValueError):
        together.at(together.version + 1)
    together.expire(1)
    assert set(together.names("segments")) == {s.name for s in segments(together)} and IndexStore(spark, together.path).entry_count() == one.entry_count()
