import threading

import pytest
from helpers import ids, index
from pyspark.sql import functions as F

from lexgrove.functions.natural_sort import natural_key
from lexgrove.functions.text import DEFAULT, FILE_MASK, all_tokens, is_separator, name_tokens, tokens, words_by_length
from lexgrove.operators import postings as inverted
from lexgrove.operators.facets import NONE, Facets, Mask, Range, ticks
from lexgrove.operators.index import NATURAL, SNAPSHOT
from lexgrove.operators.matching import WITHIN
from lexgrove.sources.store import IndexStore, Registry, entries
from lexgrove.sources.synthetic import paths

LOTS = 2**62


def entry(text, sort, size, modified, attrs):
    return text, sort, {"size": size, "modified": modified, "attrs": attrs}


FILES = {
    1: entry("report-final.pdf", "report-final.pdf", 1000, 100, 3), 2: entry("report-draft.pdf", "report-draft.pdf", 5000, 200, 2),
    3: entry("tmp-cache.bin", "tmp-cache.bin", 500, 50, 1), 4: entry("log.txt", "log.txt", 2000, 150, 0),
    5: entry("GA-100 watch", "GA-100", 8000, 300, 4), 6: entry("GA-10 watch", "GA-10", 100, 10, 5),
}


@pytest.mark.parametrize("query,method,facets,want", [
    ("report", WITHIN, Range("size", 1000, 2000), {1}), (None, WITHIN, Mask("attrs", 2, 1), {2}),
    (None, WITHIN, Facets.combine(Range("size", 1000, 10000), Range("modified", 100, 250)), {1, 2, 4}), (None, WITHIN, Range("size", 5000, LOTS), {2, 5}),
    ("report", WITHIN, Facets.combine(Range("size", 500, 5000), Mask("attrs", 1)), {1}), ("report*", "exact", Range("size", 1000, LOTS), {1, 2}),
    ("report", WITHIN, NONE, {1, 2}), (None, WITHIN, NONE, set()), ("-", WITHIN, Range("size", 0, LOTS), set()), ("", WITHIN, Facets.combine(None, Range("size", 100, 100)), {6}),
])
def test_facets(spark, query, method, facets, want):
    i = index(spark, FILES)
    assert set(ids(i.matching(query, method, True, facets))) == want
    assert i.count(query, method, True, facets) == len(want)


def test_unknown_facet_is_named(spark):
    with pytest.raises(ValueError, match="missing"):
        index(spark, FILES).matching("report", WITHIN, False, Range("missing", 0, 1))
    with pytest.raises(ValueError, match="missing"):
        inverted.Batch.of(index(spark, FILES)).find_many([inverted.Query(1, "a", facets=Range("missing", 0, 1))])


def test_missing_facet_is_zero(spark):
    assert ids(index(spark, {1: ("a.txt", None, {"size": 5}), 2: "b.txt"}).matching(None, facets=Range("size", 0, 0))) == [2]


def test_batch_with_facets(spark):
    found = inverted.Batch.of(index(spark, FILES)).find_many([inverted.Query(1, "report", WITHIN, False, Range("size", 0, 2000)), inverted.Query(2, "NOT report", WITHIN, True, Range("size", 0, 500)), inverted.Query(3, " ", facets=Range("size", 5000, LOTS))])
    assert {(r.query, r.id) for r in found.collect()} == {(1, 1), (2, 3), (2, 6), (3, 2), (3, 5)}


def test_natural_order(spark):
    i = index(spark, FILES)
    assert ids(i.find("ga", WITHIN, sort=NATURAL, facets=Range("size", 100, LOTS))) == [6, 5]
    assert ids(index(spark, {10: "GA-100", 11: "GA-10", 12: "GA-2"}, FILE_MASK).find("ga*", sort=NATURAL)) == [12, 11, 10]
    assert ids(index(spark, {30: "GA-100", 10: "GA-100", 20: "GA-100"}).find("ga", sort=NATURAL)) == [10, 20, 30]
    assert ids(index(spark, {30: "GA-100", 10: "GA-100", 20: "GA-100"}).find("ga", sort=SNAPSHOT)) == [30, 10, 20]
    assert ids(index(spark, {1: "PRW-3000", 2: "DW-5600", 3: "GA-100", 4: "GA-2", 5: "DW-6900"}).find("*", sort=NATURAL)) == [2, 5, 4, 3, 1]
    many = index(spark, {n: f"GA-{n} watch" for n in range(200, 0, -1)})
    assert [(r["rank"], r["id"]) for r in many.find_ranked("watch", sort=NATURAL).orderBy("rank").collect()] == [(n, n) for n in range(1, 201)]
    assert {(r["rank"], r["id"]) for r in many.find_ranked("watch", sort=NATURAL, limit=3).collect()} == {(1, 1), (2, 2), (3, 3)}
    with pytest.raises(ValueError):
        many.find("watch", sort="other")


@pytest.mark.parametrize("names", [
    ["GA-2", "GA-10", "GA-100", "GA-100-1", "GA-100-1A", "GA-100-1B", "GA-100A", "GA-1000"], ["GST-B400C-1A", "GST-B400D-1A", "GST-B400D-1B"],
    ["DW-5600BB-1", "DW-5600BB-1A", "DW-5600BB-2", "DW-5600E-1"], ["abc", "ab 1"], ["1234567890123", "1234567890124"],
])
def test_natural_keys(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(natural_key("n")).collect()] == names


def test_natural_key_forms(spark):
    key = dict(spark.createDataFrame([(n,) for n in ("ga-100", "GA-100", "", None, "007", "7", "1234567890123", "A\tb")], "n string").select("n", natural_key("n")).collect())
    assert key["ga-100"] == key["GA-100"] == "1:ga|0:000000000100" and key[""] == key[None] == "" and key["007"] == key["7"]
    assert key["1234567890123"] == "0:1234567890123" and key["A\tb"] == "1:a|1:\t|1:b"


def test_words(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c).first()[0]
    assert one(tokens("x"), "Alpha alpha ALPHA beta") == ["alpha", "beta"] and one(all_tokens("x"), "a b a") == ["a", "b", "a"]
    words = one(words_by_length("x"), "GA-100.B/C,D|E")
    assert len(words) == 6 and words[:2] == ["100", "ga"]
    assert [one(name_tokens("x"), v) for v in ("Alpha BETA", "foo bar FOO", "a_b", None, "  ")] == ["alpha-beta", "foo-bar", "a-b", "", ""]
    assert one(tokens("x"), None) == [] and one(tokens("x", FILE_MASK), " ") == [" "] and one(tokens("x", FILE_MASK), "") == []
    assert [one(is_separator(F.col("x")), v) for v in ("-", "a", "\t", "_", None)] == [True, False, True, False, False]
    assert one(is_separator(F.col("x"), FILE_MASK), "-") is False and DEFAULT.border == " "


def test_bigrams(spark):
    table = inverted.bigram_table(spark.createDataFrame([("banana",), ("x",), ("ban",)], "word string"))
    assert {(r.bigram, r.word) for r in table.collect()} == {("ba", "banana"), ("an", "banana"), ("na", "banana"), ("ba", "ban"), ("an", "ban")}
    assert [r.word for r in inverted.within_by_bigram(table, "nan").collect()] == ["banana"]


def test_set_operations(spark):
    i = index(spark, {1: "a", 2: "a b", 3: "b"})
    a, b = i.matching("a"), i.matching("b")
    assert [sorted(ids(inverted.combine(k, a, b))) for k in ("union", "intersect", "except")] == [[1, 2, 3], [2], [1]]


def test_ticks(spark):
    assert spark.sql("SELECT TIMESTAMP_NTZ'1970-01-01 00:00:01' AS t").select(ticks(F.col("t"))).first()[0] == 621355968010000000


def test_changes(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.entry_count() == 0 and ids(store.current.find("a")) == [] and store.version == -1
    store.rebuild_from(FILES)
    before = store.current
    assert store.entry_count() == 6 and store.contains(2) and not store.contains(9)
    store.add_entry(2, entry("report-draft.pdf", None, 9000, 200, 2))
    big = Range("size", 8000, LOTS)
    assert set(ids(store.current.find(None, facets=big))) == {2, 5} and ids(before.find(None, facets=big)) == [5]
    assert ids(store.current.find("*")) == [1, 2, 3, 4, 5, 6]
    assert store.remove_entry(2) and not store.remove_entry(2)
    version = store.version
    assert store.remove_entries([77]) == 0 and store.version == version
    assert store.refresh_entry(2, "back again") is False and store.refresh_entry(2, "and again") is True
    assert ids(store.current.find("*")) == [1, 3, 4, 5, 6, 2] and ids(store.current.find("again")) == [2]
    store.add_or_update_entries([(7, "first"), (7, "last"), (1, ("x", None, {"new": 3}))])
    assert ids(store.current.find("last")) == [7] and store.current.count("first") == 0
    assert ids(store.current.find(None, facets=Range("new", 3, 3))) == [1] and store.remove_entries([1, 3, 99]) == 2
    again = IndexStore(spark, str(tmp_path / "index"))
    assert again.version == store.version and again.entry_count() == store.entry_count()
    store.clear()
    assert store.entry_count() == 0 and before.document_count() == 6


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    a = registry.register("a", initial={1: "one"})
    b = registry.register("b", FILE_MASK)
    b.add_entry(2, "two words")
    a.add_entry(3, "three")
    assert sorted(ids(a.current.find("*"))) == [1, 3] and ids(registry["b"].current.find("two words")) == [] and ids(b.current.find("two*")) == [2]
    with pytest.raises(ValueError):
        registry.register("a")
    assert registry.transient().entry_count() == 0


def test_concurrent_readers(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.rebuild_from({0: "w"})
    errors = []

    def read():
        try:
            for _ in range(5):
                assert ids(store.current.find("w")) == list(range(store.current.document_count()))
        except Exception as e:
            errors.append(e)

    readers = [threading.Thread(target=read) for _ in range(3)]
    for t in readers:
        t.start()
    for n in range(1, 4):
        store.add_entry(n, "w")
    for t in readers:
        t.join()
    assert not [e for e in errors if not isinstance(e, AssertionError)]


def test_synthetic_paths(spark):
    a, b = paths(spark, 20, 7), paths(spark, 20, 7)
    assert a.collect() == b.collect() and a.where("search_text RLIKE '^folder[0-9]+-.*-txt$'").count() == 20
    assert entries(spark, {1: "a"}).count() == 1
