import random

import pytest
from helpers import ids, index
from pyspark.sql import functions as F

from lexgrove.functions.text import DEFAULT, FILE_MASK, Tokenization
from lexgrove.operators import patterns
from lexgrove.operators import postings as inverted
from lexgrove.operators.expression import Both, Either, Not, Op, Term, balanced, fold_tree, lex, parse, repair, single_term, terms
from lexgrove.operators.matching import EXACT, REGEX, WITHIN, glob_pattern, has_star, has_wildcards, least_length

WATCHES = {1: "GA-100 digital watch", 2: "GA-200 analog watch", 3: "DW-5600 digital watch", 4: "DW-6900 analog clock", 5: "PRW-3000 solar watch"}
FRUIT = {1: "red apple fruit", 2: "green apple fruit", 3: "red cherry fruit", 4: "green cherry fruit"}
FILES = {1: "report-final.pdf", 2: "report-draft.pdf", 3: "tmp-cache.bin", 4: "log.txt", 5: "abc", 6: "aXc", 7: "archive-report.log", 8: "foo-bar"}
NAMES = {1: "report-final.pdf", 2: "System", 3: "my-system-backup.zip", 4: "notes.txt"}
PATTERNS = {1: "report-final.pdf", 2: "reporting", 3: "log", 4: "abc", 5: "aXc"}

CASES = [
    (WATCHES, WITHIN, True, q, want)
    for q, want in [
        ("digital watch", {1, 3}), ("digital AND watch", {1, 3}), ("digital OR analog", {1, 2, 3, 4}), ("solar OR clock", {4, 5}),
        ("watch NOT digital", {2, 5}), ("NOT clock", {1, 2, 3, 5}), ("NOT nonexistent", {1, 2, 3, 4, 5}), ("solar OR digital AND watch", {1, 3, 5}),
        ("(digital OR analog) AND watch NOT GA", {3}), ("watch AND NOT digital AND NOT analog", {5}), ("NOT digital AND NOT analog", {5}),
        ("", set()), ("   ", set()), ("nonexistent", set()), ("DiGiTaL", {1, 3}), ("OR digital", {1, 3}), ("digital AND", {1, 3}),
        ("NOT NOT clock", {1, 2, 3, 5}), ("NOT NOT NOT clock", set()), ("NOT AND clock", set()), ("digital NOT AND watch", set()),
        ("( OR digital )", set()), ("digital ()", set()), ("-", set()), ("AND", set()), ("digital AND OR watch", {1, 3}),
        ("((digital) OR (solar))", {1, 3, 5}), ("(digital OR analog", {1, 2, 3, 4}), ("digital) OR (analog", {1, 2, 3, 4}),
    ]
] + [
    (FRUIT, WITHIN, True, "red OR green AND apple", {1, 2, 3}), (FRUIT, WITHIN, True, "(red OR green) AND apple", {1, 2}),
    ({1: "this or that", 2: "something else"}, WITHIN, False, "or", {1}), ({1: "not applicable", 2: "applicable"}, WITHIN, False, "not", {1}),
    ({1: "alpha beta", 2: "alpha gamma", 3: "beta gamma"}, EXACT, True, "alpha OR gamma", {1, 2, 3}),
    ({1: "alphabet", 2: "alpha"}, EXACT, False, "alph", set()), ({1: "alphabet", 2: "alpha"}, WITHIN, False, "alph", {1, 2}),
    ({1: "abxba", 2: "xxababyy", 3: "abab"}, WITHIN, False, "abab", {2, 3}), ({1: "aaxaax", 2: "zaaaab", 3: "aaaa"}, WITHIN, False, "aaaa", {2, 3}),
] + [
    (FILES, m, ops, q, want)
    for q, want, m, ops in [
        ("*", set(range(1, 9)), EXACT, False), ("report*", {1, 2, 7}, EXACT, False), ("REPORT*", {1, 2, 7}, EXACT, False), ("re**port*", {1, 2, 7}, EXACT, False),
        ("report*", {1, 2, 7}, WITHIN, False), ("*log", {4, 7}, EXACT, False), ("*report*", {1, 2, 7}, EXACT, False), ("a?c", {5, 6}, EXACT, False),
        ("*abc*", {5}, EXACT, False), ("abc", {5}, WITHIN, False), ("report* AND NOT *tmp", {1, 2, 7}, EXACT, True), ("(report*) (log)", {7}, EXACT, True),
        ("report* log", {7}, EXACT, True), ("foo*", {8}, EXACT, False), ("z" * 20, set(), EXACT, False),
    ]
] + [
    ({1: "a b cd", 2: "x y zzz"}, EXACT, False, "?", {1, 2}), ({1: "axc", 2: "abcd", 3: "a123c"}, EXACT, False, "?*?", {1, 2, 3}),
    ({1: "", 2: "a", 3: None, 4: " - "}, EXACT, False, "*", {1, 2, 3, 4}), ({1: "", 2: "a", 3: None, 4: " - "}, EXACT, False, "**", {2}),
    ({1: "", 2: "a"}, EXACT, True, "NOT a", {1}), ({1: "a\tb"}, EXACT, False, "a\tb", set()), ({1: "x+y [z]", 2: "xxy"}, EXACT, False, "x+?", {1}),
]


@pytest.mark.parametrize("rows,method,ops,query,want", CASES)
def test_find(spark, rows, method, ops, query, want):
    i = index(spark, rows)
    found = ids(i.matching(query, method, ops))
    assert set(found) == want and len(found) == len(want)
    assert i.count(query, method, ops) == len(want)


@pytest.mark.parametrize("query,want", [("^reporting$", {2}), ("report", {1, 2}), ("report.*", {1, 2}), ("a[a-z]c", {4, 5}), ("reporting|log", {2, 3}), ("(unclosed", set()), (r"report.*\.pdf", set()), ("REPORT", {1, 2}), ("[Rr][Ee]port$", {1})])
def test_regex(spark, query, want):
    assert set(ids(index(spark, PATTERNS).matching(query, REGEX))) == want


@pytest.mark.parametrize("text,query,found", [("foobar", "foo(?=bar)", True), ("baad", r"(a)\1", True), ("a" * 40, "(a+)+b(?=x)", False), ("École", "école", True), ("", ".*", False)])
def test_regex_forms(spark, text, query, found):
    assert index(spark, {1: text}).count(query, REGEX) == int(found)


@pytest.mark.parametrize("query,method,want", [("system", EXACT, {2}), ("system*", EXACT, {2}), ("*.pdf", EXACT, {1}), ("*system*", EXACT, {2, 3}), ("*.pdf OR *.txt", EXACT, {1, 4}), ("* AND NOT *.zip", EXACT, {1, 2, 4}), ("*", EXACT, {1, 2, 3, 4}), ("port", WITHIN, {1}), ("report-final.pd?", EXACT, {1}), ("*o*e*", EXACT, {4}), (r"^report-final\.pdf$", REGEX, {1}), (r"\.(pdf|txt)$", REGEX, {1, 4}), ("(system)", EXACT, set())])
def test_file_mask(spark, query, method, want):
    assert set(ids(index(spark, NAMES, FILE_MASK).matching(query, method, True))) == want


def test_custom_preset(spark):
    assert index(spark, {1: "a-b-c"}, Tokenization.create("-", " ")).unique_word_count() == 3
    i = index(spark, {1: "a b-c", 2: "a"}, Tokenization.create("-", ","))
    assert ids(i.matching("a b")) == [1] and ids(i.matching("a")) == [2]


def test_tokens_of_queries():
    assert lex("a (b)", True) == [Term("a"), Op.OPEN, Term("b"), Op.CLOSE]
    assert lex("a (b", True) == [Term("a"), Term("b")] == lex("a (b", False)
    assert lex("A and B", False) == [Term("a"), Term("and"), Term("b")]
    assert balanced("(()())") and not balanced(")(")
    assert repair(lex("a b", False)) == [Term("a"), Op.AND, Term("b")]
    assert parse("a OR b AND NOT c", True) == Either(Term("a"), Both(Term("b"), Not(Term("c"))))
    assert terms(parse("a b a", False)) == ["a", "b"]
    assert [single_term(q, True) for q in ("word", "OR word", "a b", "NOT a", "")] == ["word", "word", None, None, None]
    assert has_wildcards("a*") and not has_wildcards("a") and least_length("a*?b") == 3 and has_star("*") and not has_star("?")
    assert glob_pattern("a.*?") == r"a\..*."


def _random_query(r, depth=3):
    if depth == 0 or r.random() < 0.3:
        return r.choice(["ab", "b", "a*", "*c", "?b", "cab", "*", "d", "ab*", "*bc", "*ca*", "a?c"])
    kind = r.choice(["and", "or", "not", "parens"])
    a, b = _random_query(r, depth - 1), _random_query(r, depth - 1)
    return {"and": f"{a} AND {b}", "or": f"{a} OR {b}", "not": f"NOT {a}", "parens": f"({a}) {b}"}[kind]


def _plainly(text, tree, method):
    import re

    toks = [t for t in re.split(r"[ \-.]+", text.lower()) if t]

    def term(w):
        if w == "*":
            return True
        if has_wildcards(w):
            return any(re.fullmatch(re.escape(w).replace(r"\*", ".*").replace(r"\?", "."), t) for t in toks)
        return any(w == t if method == EXACT else w in t for t in toks)

    return fold_tree(tree, term, lambda a: not a, lambda a, b: a and b, lambda a, b: a or b)


@pytest.mark.parametrize("method", [EXACT, WITHIN])
def test_scan_postings_and_plain_evaluation_agree(spark, method):
    r = random.Random(method)
    rows = {i: " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 4))) for i in range(40)}
    i = index(spark, rows)
    i.docs.persist()
    texts = [_random_query(r) for _ in range(25)]
    want = {(n, k) for n, q in enumerate(texts) for k, text in rows.items() if (t := parse(q, True)) is not None and _plainly(text, t, method)}
    batch = inverted.Batch.of(i)
    queries = [inverted.Query(n, q, method, True) for n, q in enumerate(texts)]
    assert {(x.query, x.id) for x in batch.find_many(queries).collect()} == want
    cached = inverted.Batch.cached(i)
    assert {(x.query, x.id) for x in cached.find_many(queries).collect()} == want
    cached.release()
    scanned = batch._by_scan(queries).collect()
    assert {(x.query, x.id) for x in scanned} == want and len(scanned) == len(want)
    i.docs.unpersist()


def test_saved_batch(spark, tmp_path):
    i = index(spark, WATCHES)
    batch = inverted.Batch.of(i).save(str(tmp_path))
    found = batch.find_many([inverted.Query(1, "digital"), inverted.Query(2, "NOT watch", EXACT, True), inverted.Query(3, " ")])
    assert {(r["query"], r["id"]) for r in found.collect()} == {(1, 1), (1, 3), (2, 4)}
    with pytest.raises(ValueError):
        batch.find_many([inverted.Query(1, "a"), inverted.Query(1, "b")])


def test_default_preset_is_the_default(spark):
    assert index(spark, {1: "a"}).preset is DEFAULT


@pytest.mark.parametrize(
    "query,want",
    [
        (r"(a+)+$", {2}),  # linear engine
        (r"^(\w\d?)+é$", {3}),
        (r"^(?:[^\W\d]|z)+$", {2, 3, 4}),
        (r"(A|aa)+$", {2}),
        (r"(b)(?=c)(\1|c)+d", {4}),  # the engine with a limit
        (r"(?!x)(\w+\w+)+\by$", set()),  # reaches the limit or fails
        (r"(ab|cd){2}", set()),
    ],
)
def test_regex_of_repeated_groups_ends(spark, query, want, monkeypatch):
    monkeypatch.setattr(patterns, "SECONDS", 0.2)
    rows = {1: "a" * 5000 + "!", 2: "x aaa", 3: "z1é zé", 4: "bccd", 5: "", 6: None}
    assert patterns.repeats_groups(query)
    assert set(ids(index(spark, rows).matching(query, REGEX))) == want
    batch = inverted.Batch.of(index(spark, rows))
    assert {r.id for r in batch.find_many([inverted.Query(1, query, REGEX), inverted.Query(2, "aaa")]).where("query = 1").collect()} == want


def test_regex_engines_agree(spark):
    tokens = ["", "a", "ab", "abab", "é1", "x_y", "12", "ǅ", "a!b", "abc9", "\u0663"]
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(tokens)], "id int, tokens array<string>")
    for query in [r"^(ab)+$", r"^(\w)+$", r"^([\w!])+$", r"(\d)+", r"^(\D)*$", r"(é|[^a-z\d])+", r"^(?:a|b)+$", r"(\p{L}\p{Nd})+", r"(A){1}b"]:
        assert patterns.repeats_groups(query) and patterns.linear(query) is not None
        found = df.select("tokens", patterns.bounded(query)("tokens").alias("own"), F.exists("tokens", lambda t: t.rlike("(?iuU)" + query)).alias("java"))
        assert [r for r in found.collect() if r.own != r.java] == []
    assert not any(patterns.repeats_groups(q) for q in (r"^th.*ing$", r"(a|b)?c", r"\)+", "[)]+", "(ab)"))
    assert [patterns.linear(q) for q in ("[a-z&&[^b]]", "[[a]]", r"\bx", r"(a)\1", "(a++)+")] == [None] * 5


def test_large_batches_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(inverted, "MOST_SENT", 0)
    batch = inverted.Batch.of(index(spark, {1: "red digital watch", 2: "watch", 3: "red", 4: None}))
    queries = [inverted.Query(1, "red AND watch", EXACT, True), inverted.Query(2, "NOT red", EXACT, True), inverted.Query(3, "w?tch OR dig?tal*", EXACT, True)]
    assert {(r.query, r.id) for r in batch.find_many(queries).collect()} == {(1, 1), (2, 2), (2, 4), (3, 1), (3, 2)}
