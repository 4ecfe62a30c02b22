"""Single queries by postings, vocabulary or scan; regular expressions that end; natural order that is kept."""

import itertools
import random
import re
import time

import pytest
from helpers import ids, index
from pyspark.sql import functions as F

from lexgrove.functions.text import FILE_MASK
from lexgrove.operators import natural_order, patterns
from lexgrove.operators import postings as inverted
from lexgrove.operators.facets import Range
from lexgrove.operators.index import NATURAL, SearchIndex
from lexgrove.operators.matching import EXACT, REGEX, WITHIN


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rows = {i: (f"word{i} common {'even' if i % 2 == 0 else 'odd'} item{i % 10}", f"name {100 - i}", {"size": i}) for i in range(200)}
    path = str(tmp_path_factory.mktemp("saved"))
    return inverted.Batch.of(index(spark, rows)).save(path)


QUERIES = [("word7", EXACT, False), ("common", EXACT, False), ("ord1?5", EXACT, False), ("*rd19*", EXACT, False), ("d15", WITHIN, False), ("nothing", EXACT, False), ("item3 AND NOT odd", EXACT, True), ("NOT odd", EXACT, True), ("word3 OR word4 OR item9", EXACT, True), ("*", EXACT, False), ("^word1.5$", REGEX, False), ("(a|e)(v|x)en", REGEX, False), ("(?=ev)even", REGEX, False), ("(", REGEX, False), ("  ", EXACT, False), ("NOT AND", EXACT, True)]


@pytest.mark.parametrize("text,method,operators", QUERIES)
def test_planned_queries_find_what_a_scan_finds(saved, text, method, operators):
    want = set(ids(saved.index.matching(text, method, operators)))
    assert set(ids(saved.matching(text, method, operators))) == want
    assert ids(saved.find(text, method, operators)) == ids(saved.index.find(text, method, operators))
    part = Range("size", 10, 150)
    assert set(ids(saved.matching(text, method, operators, part))) == set(ids(saved.index.matching(text, method, operators, part)))
    assert ids(saved.find(text, method, operators, NATURAL)) == ids(saved.index.find(text, method, operators, NATURAL))


def test_plans(saved):
    assert saved.plan("word7") == inverted.Plan("postings") and saved.plan("common") == inverted.Plan("postings")
    assert saved.plan("d15", WITHIN) == inverted.Plan("postings", 11) and saved.plan("word7 AND NOT odd", operators=True).how == "postings"
    assert saved.plan("o", WITHIN).how == "scan" and saved.plan("NOT word7", operators=True).how == "scan" and saved.plan("*").how == "scan"
    assert saved.plan("^word1.5$", REGEX) == inverted.Plan("postings", 10) and saved.plan("zz", WITHIN) == inverted.Plan("postings", 0)
    with pytest.raises(ValueError):
        saved.matching("word7", facets=Range("none", 0, 1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_exact_word_reads_its_own_postings_only(saved):
    plan = plan_of(saved.matching("word7"))
    assert plan.count("FileScan") == 1 and "postings" in plan and "EqualTo(word,word7)" in plan and "search_text" not in plan


def test_a_regular_expression_reads_no_texts(saved):
    plan = plan_of(saved.matching("^word1.5$", REGEX))
    assert "norm" not in plan and "search_text" not in plan and "bigrams" in plan and "EqualTo(bigram,wo)" in plan
    assert "search_text" not in plan_of(saved.find_many([inverted.Query(1, "(a|e)+ven", REGEX)]))


def test_regular_expressions_of_any_shape_end(spark):
    rows = {1: "a" * 200, 2: "b" * 30, 3: "a" * 28 + " x", 4: "aab"}
    i = index(spark, rows)
    i.docs.count()
    for query, want in (("a*a*a*a*b", {2, 4}), ("^(a?){28}a{28}$", {3}), ("^" + "a?" * 28 + "a" * 28 + "$", {3}), ("(a|aa)+$", {1, 3}), ("(a|a)*c", set())):
        assert not patterns.quick(query)
        began = time.time()
        assert set(ids(i.matching(query, REGEX))) == want
        assert time.time() - began < 10  # the job's overhead; a backtracking engine takes minutes


def test_required_text_is_in_every_match():
    assert [patterns.required(q) for q in ("^word1.5$", "abc*de", "ab+cd", "a|b", "(abc)", "[abc]de", "x{12}yz", r"\dab\.cd", "(?i)ab", r"\Qab\E", "ab?", "", "mask", "(?:ab)cd", "ab{2,3}cdf")] == ["word1", "ab", "ab", "", "", "de", "yz", "ab", "", "", "a", "", "ma", "cd", "cdf"]
    r = random.Random(4)
    words = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("abc1", repeat=n)]
    for _ in range(300):
        query = "".join(r.choice(["a", "b", "c", "1", ".", "[ab]", "(a)", "(bc)?", "a*", "b+", "c?", "a{1,2}"]) for _ in range(r.randint(1, 4)))
        assert all(patterns.required(query) in w for w in words if re.search(query, w, re.I))
    assert [patterns.quick(q) for q in ("abc", "a*b", "^th.*ing$", r"\*\+a?", "[*+]+", "(ab)?", "a+b+", "(a)+", "(?=a)b*")] == [True, True, True, True, True, False, False, False, True]


def long_names(seed, n):
    r = random.Random(seed)
    parts = ["file", "12", "7", "007", "-", "_", "é", "|", ".", " ", "x" * 70, "1" * 40, "b" * 300]
    return {i: "".join(r.choice(parts) for _ in range(r.randint(0, 9))) for i in range(n)}


def plain_key(text):
    found = re.findall(r"\d+|[^\W\d_]+|[^\- _/]", text)
    return "|".join("0:" + t.rjust(12, "0") if t[0].isdigit() else "1:" + t.lower() for t in found)


@pytest.mark.parametrize("seed", [1, 2])
def test_natural_order_of_long_names(spark, seed):
    names = long_names(seed, 300)
    df = spark.createDataFrame(list(names.items()), "id bigint, sort_text string")
    short = {x.id: x.p for x in df.select("id", natural_order.key_prefix("sort_text").alias("p")).collect()}
    assert short == {i: plain_key(t)[: natural_order.SHORT] for i, t in names.items()}
    got = [(x.id, x.rank) for x in natural_order.order_table(df).orderBy("rank").collect()]
    assert got == [(i, n) for n, i in enumerate(sorted(names, key=lambda i: (plain_key(names[i]), i)), 1)]


def test_natural_order_is_worked_out_once(spark, monkeypatch):
    calls, made = [], natural_order.order_table
    monkeypatch.setattr(natural_order, "order_table", lambda docs: calls.append(1) or made(docs))
    i = SearchIndex.build(spark.createDataFrame([(1, "b 10"), (2, "b 9"), (3, None), (4, "a")], "id bigint, t string"), id="id", text="t")
    for _ in range(2):
        assert ids(i.find("*", sort=NATURAL)) == [3, 4, 2, 1] and ids(i.find("b", sort=NATURAL)) == [2, 1]
    assert [(x.id, x["rank"]) for x in i.find_ranked("b", sort=NATURAL).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert calls == [1] and i.docs.select(F.count("*")).first()[0] == 4


def test_planned_queries_on_whole_names(spark, tmp_path):
    batch = inverted.Batch.of(index(spark, {1: "report-final.pdf", 2: "System", 3: "my-system.zip", 4: None}, FILE_MASK)).save(str(tmp_path / "names"))
    for text, method in (("system", EXACT), ("*system*", EXACT), ("system", WITHIN), (r"\.(pdf|zip)$", REGEX), ("report-final.pd?", EXACT)):
        assert set(ids(batch.matching(text, method))) == set(ids(batch.index.matching(text, method)))


def counted_rows(spark, n):
    """An index of ``n`` documents, and a number that grows by one whenever a text is read."""
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return None if i == 3 else f"word{i} common {'even' if i % 2 == 0 else 'odd'} item{i % 10}"

    rows = spark.range(0, n, 1, 3).select("id", F.udf(text, "string")("id").alias("t"))
    return SearchIndex.build(rows, id="id", text="t", facets={"size": F.col("id")}), seen


def test_texts_are_read_once_to_save_tables(spark, tmp_path):
    index, seen = counted_rows(spark, 50)
    saved = inverted.Batch.of(index).save(str(tmp_path / "saved"))
    assert seen.value == 50  # 396 before
    for table, want in (("postings", inverted.postings(index)), ("vocabulary", inverted.vocabulary(index)), ("bigrams", inverted.bigram_table(inverted.vocabulary(index)))):
        got = getattr(saved, table)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tables_that_are_not_kept_are_not_made_for_each_part_of_a_batch(spark):
    index, seen = counted_rows(spark, 50)
    each = [("word7", EXACT, False, None), ("ord1", WITHIN, False, None), ("*4 OR even", EXACT, True, None), ("common AND NOT odd", EXACT, True, None), ("NOT (even OR item3)", EXACT, True, None), ("even", EXACT, False, Range("size", 10, 30)), ("^word.*9$", REGEX, False, None), ("(o|e)+dd", REGEX, False, None), ("*", EXACT, False, None), ("(", REGEX, False, None), (" ", EXACT, False, None)]
    got = inverted.Batch.of(index).find_many([inverted.Query(n, *q) for n, q in enumerate(each)]).collect()
    assert seen.value == 50  # 792 before
    assert sorted((r.query, r.id) for r in got) == sorted((n, i) for n, q in enumerate(each) for i in ids(index.matching(*q)))


def test_pairs_of_words_are_their_bigrams(spark):
    words = ["", "a", "ab", "aaaa", "abab", "banana", "é", "éé", "ßaß", "𝒳𝒴𝒳𝒴", "a𝒳", "日本日本", "x" * 300, "%_%_"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = df.select(F.explode(inverted.bigrams(F.col("word"))).alias("bigram"), "word")
    assert sorted(map(tuple, inverted.bigram_table(df).collect())) == sorted(map(tuple, want.collect())) != []


def test_a_few_words_are_sent_to_the_postings(spark, saved):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(saved.matching("*rd19*"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "postings" in plan and "EqualTo(bigram,rd)" in plan
