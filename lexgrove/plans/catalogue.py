"""The registered queries over the tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.natural_sort import natural_key
from lexgrove.functions.text import DEFAULT, FILE_MASK, Tokenization, all_tokens, is_separator, name_tokens, tokens, words_by_length
from lexgrove.operators import facets as fc
from lexgrove.operators import postings as inverted
from lexgrove.operators.index import NATURAL, SNAPSHOT, SearchIndex
from lexgrove.operators.matching import EXACT, REGEX, WITHIN
from lexgrove.operators.ranks import ranked
from lexgrove.shared import shared_folder
from lexgrove.sources.store import IndexStore, Registry
from lexgrove.streaming.feed import Feed
from lexgrove.streaming.ingest import Ingestion, Options, Policy, publish_plan

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = " ".join(sql.split())


# -- the same terms in SQL -------------------------------------------------------------------------
SEPARATORS = r"[ .,;:/\\\r\n\t|\-#\[\]{}()~£$€]+"
def sql_tokens(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '{SEPARATORS}'), lambda t: t <> '')"


def sql_term(column: str, how: str, word: str) -> str:
    """exact, within, or an anchored pattern, on some token."""
    test = {"exact": f"t = '{word}'", "within": f"contains(t, '{word}')", "glob": f"regexp_full_match(t, '{word}')", "regex": f"regexp_matches(t, '{word}', 'i')"}[how]
    return f"(len(list_filter({sql_tokens(column)}, lambda t: {test})) > 0)"


# -- indexes over the tables -----------------------------------------------------------------------
def documents(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return SearchIndex.build(_table(spark, sf_dir, "documents"), id="doc_id", text="text", facets={"n_chars": F.col("n_chars")})


def labelled(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """Documents with the facets of their labels; those without labels read as 0."""
    both = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return SearchIndex.build(both, id="doc_id", text="text", facets={n: F.col(n) for n in ("quality", "toxic")})


def parts(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return SearchIndex.build(_table(spark, sf_dir, "part"), id="p_partkey", text="p_name", sort="p_brand", facets={"size": F.col("p_size"), "cents": F.round(F.col("p_retailprice") * 100)})


def masks(table: str, id: str, text: str) -> Callable[[SparkSession, str], SearchIndex]:
    return lambda spark, sf_dir: SearchIndex.build(_table(spark, sf_dir, table), id=id, text=text, preset=FILE_MASK)


def lines(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """Line items: flags and dates as facets."""
    t = _table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return SearchIndex.build(t, id="line", text="l_returnflag", facets={"partkey": F.col("l_partkey"), "shipped": fc.micros(F.col("l_shipdate"))})


def orders(spark: SparkSession, sf_dir: str) -> SearchIndex:
    return SearchIndex.build(_table(spark, sf_dir, "orders"), id="o_orderkey", text="o_orderpriority", facets={"day": fc.micros(F.col("o_orderdate"))})


def _finds(name: str, index, expr: str | None, where: str, table: str = "documents", id: str = "doc_id", method: str = EXACT, operators: bool = True, facets=None) -> None:
    _add(name, lambda s, d: index(s, d).matching(expr, method, operators, facets).select("id"), f"SELECT {id} AS id FROM {table} WHERE {where}")


def _x(word: str) -> str:
    return sql_term("text", "exact", word)


def _w(word: str) -> str:
    return sql_term("text", "within", word)


# -- scalar functions and tables -------------------------------------------------------------------
_add("tokens_default", lambda s, d: _table(s, d, "documents").select("doc_id", F.explode(tokens("text")).alias("word")), f"SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS word FROM documents")
_add("token_counts", lambda s, d: _table(s, d, "documents").select("doc_id", F.size(all_tokens("text")).cast("bigint").alias("n_tokens"), F.size(tokens("text")).cast("bigint").alias("n_distinct")), f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len(list_distinct({sql_tokens('text')})) AS n_distinct FROM documents")
_add("tokens_file_mask", lambda s, d: _table(s, d, "pages").select("page_id", F.explode(tokens("url", FILE_MASK)).alias("word")), "SELECT page_id, lower(url) AS word FROM pages WHERE url <> ''")
_add("tokens_custom", lambda s, d: _table(s, d, "pages").select("page_id", F.explode(tokens("url", Tokenization.create("/.", " "))).alias("word")), "SELECT DISTINCT page_id, unnest(list_filter(string_split_regex(lower(coalesce(url, '')), '[/.]+'), lambda t: t <> '')) AS word FROM pages")
_add("words_by_length", lambda s, d: _table(s, d, "part").select("p_partkey", F.array_join(words_by_length("p_name"), " ").alias("words")), f"SELECT p_partkey, coalesce(string_agg(w, ' ' ORDER BY length(w) DESC, w), '') AS words FROM (SELECT DISTINCT p_partkey, unnest({sql_tokens('p_name')}) AS w FROM part) GROUP BY p_partkey UNION ALL SELECT p_partkey, '' FROM part WHERE len({sql_tokens('p_name')}) = 0")
_add("name_tokens", lambda s, d: _table(s, d, "pages").select("page_id", F.explode(F.filter(F.split(name_tokens("url"), "-"), lambda t: t != "")).alias("word")), r"SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(coalesce(url, '')), '([\p{L}\p{Nd}]+)', 1)) AS word FROM pages")
NATURAL_SQL = r"array_to_string(list_transform(regexp_extract_all(coalesce({0}, ''), '(\p{{Nd}}+|\p{{L}}+|[^\- _/])', 1), lambda t: CASE WHEN regexp_matches(t, '^\p{{Nd}}') THEN '0:' || CASE WHEN length(t) < 12 THEN lpad(t, 12, '0') ELSE t END ELSE '1:' || lower(t) END), '|')"
_add("natural_key", lambda s, d: _table(s, d, "part").select("p_partkey", natural_key("p_brand").alias("brand_key"), natural_key("p_name").alias("name_key")), f"SELECT p_partkey, {NATURAL_SQL.format('p_brand')} AS brand_key, {NATURAL_SQL.format('p_name')} AS name_key FROM part")
_add("postings", lambda s, d: inverted.postings(documents(s, d)), f"SELECT DISTINCT unnest({sql_tokens('text')}) AS word, doc_id AS id FROM documents")
_add("vocabulary", lambda s, d: inverted.vocabulary(documents(s, d)), f"SELECT word, length(word) AS length, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS word FROM documents) GROUP BY word")
_add("bigrams", lambda s, d: inverted.bigram_table(inverted.vocabulary(parts(s, d))), f"SELECT DISTINCT substr(word, i, 2) AS bigram, word FROM (SELECT word, unnest(range(1, length(word))) AS i FROM (SELECT DISTINCT unnest({sql_tokens('p_name')}) AS word FROM part))")
_add("within_by_bigram", lambda s, d: inverted.within_by_bigram(inverted.bigram_table(inverted.vocabulary(documents(s, d))), "tion"), f"SELECT DISTINCT word FROM (SELECT unnest({sql_tokens('text')}) AS word FROM documents) WHERE contains(word, 'tion')")
_add("document_count", lambda s, d: documents(s, d).docs.agg(F.count("*").alias("documents")), "SELECT count(*) AS documents FROM documents")
_add("unique_words", lambda s, d: inverted.postings(documents(s, d)).agg(F.count_distinct("word").alias("words")), f"SELECT count(DISTINCT w) AS words FROM (SELECT unnest({sql_tokens('text')}) AS w FROM documents)")

# -- terms -----------------------------------------------------------------------------------------
_finds("find_exact", documents, "the", _x("the"))
_finds("find_within", documents, "tion", _w("tion"), method=WITHIN)
_finds("find_glob", documents, "th?n*", sql_term("text", "glob", "th.n.*"))
_finds("find_glob_prefix", documents, "ver*", sql_term("text", "glob", "ver.*"))
_finds("find_glob_suffix", documents, "*ment", sql_term("text", "glob", ".*ment"))
_finds("find_glob_inner", documents, "*shwh*", sql_term("text", "glob", ".*shwh.*"))
_finds("find_glob_single", documents, "???", sql_term("text", "glob", "..."))
_finds("find_star", documents, "*", "true")
_finds("find_double_star", documents, "**", f"len({sql_tokens('text')}) > 0")
_finds("find_regex", documents, "^th.*ing$", sql_term("text", "regex", "^th.*ing$"), method=REGEX)
_finds("find_regex_class", documents, "[éè]tre", sql_term("text", "regex", "[éè]tre"), method=REGEX)
_finds("find_regex_invalid", documents, "(unclosed", "false", method=REGEX)
_finds("find_blank", documents, "   ", "false")
_finds("find_none", documents, "zzzzzzzzzzzzzzzzzzzz", "false")

# -- boolean language ------------------------------------------------------------------------------
_finds("bool_and", documents, "the AND ing", f"{_w('the')} AND {_w('ing')}", method=WITHIN)
_finds("bool_or", documents, "und OR avec", f"{_x('und')} OR {_x('avec')}")
_finds("bool_not", documents, "NOT the", f"NOT {_x('the')}")
_finds("bool_parens", documents, "(the OR der) AND NOT tion*", f"({_x('the')} OR {_x('der')}) AND NOT {sql_term('text', 'glob', 'tion.*')}")
_finds("bool_precedence", documents, "und OR the AND NOT that", f"{_x('und')} OR ({_x('the')} AND NOT {_x('that')})")
_finds("bool_nested", documents, "((the OR les) AND (of OR pour)) NOT (was OR sur)", f"({_x('the')} OR {_x('les')}) AND ({_x('of')} OR {_x('pour')}) AND NOT ({_x('was')} OR {_x('sur')})")
_finds("implicit_and", documents, "the of that", f"{_x('the')} AND {_x('of')} AND {_x('that')}", operators=False)
_finds("operators_off", documents, "the or and", f"{_w('the')} AND {_w('or')} AND {_w('and')}", method=WITHIN, operators=False)
_finds("repair_double_not", documents, "NOT NOT the", f"NOT {_x('the')}")
_finds("repair_leading_trailing", documents, "OR the AND NOT", _x("the"))
_finds("repair_operator_run", documents, "the AND OR that", f"{_x('the')} AND {_x('that')}")
_finds("repair_hopeless", documents, "the NOT AND that", "false")
_finds("unbalanced_parens", documents, "(the OR der", f"{_x('the')} OR {_x('der')}")
_finds("conversations_bool", lambda s, d: SearchIndex.build(_table(s, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), id="id", text="text"), "the AND NOT of", f"{_x('the')} AND NOT {_x('of')}", table="conversations", id="conv_id * 1000 + turn")

# -- whole-name masks ------------------------------------------------------------------------------
CUSTOMERS, SUPPLIERS, PAGES = masks("customer", "c_custkey", "c_name"), masks("supplier", "s_suppkey", "s_name"), masks("pages", "page_id", "url")
_finds("mask_exact", CUSTOMERS, "Customer#000000007", "lower(c_name) = 'customer#000000007'", "customer", "c_custkey")
_finds("mask_single", CUSTOMERS, "customer#00000000?", "regexp_full_match(lower(c_name), 'customer#00000000.')", "customer", "c_custkey")
_finds("mask_prefix", SUPPLIERS, "supplier#0000000*", "starts_with(lower(s_name), 'supplier#0000000')", "supplier", "s_suppkey")
_finds("mask_suffix", PAGES, "*.html", "ends_with(lower(url), '.html')", "pages", "page_id")
_finds("mask_within", PAGES, "example.org", "contains(lower(url), 'example.org')", "pages", "page_id", method=WITHIN)
_finds("mask_bool", PAGES, "*example.net* AND NOT *.html OR *#top", "(contains(lower(url), 'example.net') AND NOT ends_with(lower(url), '.html')) OR ends_with(lower(url), '#top')", "pages", "page_id")
_finds("mask_regex", PAGES, r"^https?://m\.", r"regexp_matches(lower(url), '^https?://m\.', 'i')", "pages", "page_id", method=REGEX)

# -- facets ----------------------------------------------------------------------------------------
_finds("facet_range", documents, None, "n_chars BETWEEN 500 AND 2000", facets=fc.Range("n_chars", 500, 2000))
_finds("facet_mask", parts, None, "p_size & 5 = 5 AND p_size & 8 = 0", "part", "p_partkey", facets=fc.Mask("size", 5, 8))
_finds("facet_combine", parts, None, "p_size BETWEEN 10 AND 40 AND p_size & 1 = 1 AND CAST(round(p_retailprice * 100) AS BIGINT) BETWEEN 0 AND 150000", "part", "p_partkey", facets=fc.Facets.combine(fc.Range("size", 10, 40), fc.Mask("size", 1), fc.Range("cents", 0, 150000)))
_finds("facet_none", parts, None, "false", "part", "p_partkey", facets=fc.NONE)
_finds("facet_missing_zero", labelled, None, "coalesce(quality, 0) = 0", "documents d LEFT JOIN labels l USING (doc_id)", facets=fc.Range("quality", 0, 0))
_finds("text_plus_facet", documents, "the AND NOT that", f"{_x('the')} AND NOT {_x('that')} AND n_chars BETWEEN 0 AND 3000", facets=fc.Range("n_chars", 0, 3000))
_finds("exact_plus_facet", documents, "und", f"{_x('und')} AND n_chars >= 1000", facets=fc.Range("n_chars", 1000, 2**62))
_finds("facet_lines", lines, None, "l_partkey & 3 = 1 AND epoch_us(l_shipdate) BETWEEN 820454400000000 AND 883612800000000", "lineitem", "l_orderkey * 10 + l_linenumber", facets=fc.Facets.combine(fc.Mask("partkey", 1, 2), fc.Range("shipped", 820454400000000, 883612800000000)))
_finds("facet_dates", orders, "urgent", "contains(lower(o_orderpriority), 'urgent') AND epoch_us(o_orderdate) >= 852076800000000", "orders", "o_orderkey", method=WITHIN, facets=fc.Range("day", 852076800000000, 2**62))
_add("date_ticks", lambda s, d: _table(s, d, "orders").select("o_orderkey", fc.ticks(F.col("o_orderdate")).alias("ticks")), "SELECT o_orderkey, epoch_us(o_orderdate) * 10 + 621355968000000000 AS ticks FROM orders")
_add("facet_count", lambda s, d: documents(s, d).count_df(None, facets=fc.Range("n_chars", 500, 2000)), "SELECT count(*) AS matches FROM documents WHERE n_chars BETWEEN 500 AND 2000")

# -- counts, orders, set operations ----------------------------------------------------------------
_add("count_matches", lambda s, d: documents(s, d).count_df("the AND NOT that", operators=True), f"SELECT count(*) AS matches FROM documents WHERE {_x('the')} AND NOT {_x('that')}")
_add("count_with_facet", lambda s, d: documents(s, d).count_df("the", facets=fc.Range("n_chars", 0, 3000)), f"SELECT count(*) AS matches FROM documents WHERE {_x('the')} AND n_chars BETWEEN 0 AND 3000")
_add("natural_sort_rank", lambda s, d: parts(s, d).find_ranked("*", sort=NATURAL), f"SELECT p_partkey AS id, row_number() OVER (ORDER BY {NATURAL_SQL.format('p_brand')}, p_partkey) AS rank FROM part")
_add("natural_sort_customers", lambda s, d: CUSTOMERS(s, d).find_ranked("*9*", sort=NATURAL), f"SELECT c_custkey AS id, row_number() OVER (ORDER BY {NATURAL_SQL.format('c_name')}, c_custkey) AS rank FROM customer WHERE contains(c_name, '9')")
_add("snapshot_order_rank", lambda s, d: documents(s, d).find_ranked("the", sort=SNAPSHOT), f"SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE {_x('the')}")
_add("natural_top", lambda s, d: parts(s, d).find_ranked("*", sort=NATURAL, limit=20), f"SELECT * FROM (SELECT p_partkey AS id, row_number() OVER (ORDER BY {NATURAL_SQL.format('p_brand')}, p_partkey) AS rank FROM part) WHERE rank <= 20")
for _kind, _op in (("union", "OR"), ("intersect", "AND"), ("except", "AND NOT")):
    _add(f"set_{_kind}", lambda s, d, k=_kind: inverted.combine(k, documents(s, d).matching("the"), documents(s, d).matching("that")), f"SELECT doc_id AS id FROM documents WHERE {_x('the')} {_op} {_x('that')}")

# -- many queries in one job -----------------------------------------------------------------------
BATCH = [
    inverted.Query(1, "the"),
    inverted.Query(2, "tion", WITHIN),
    inverted.Query(3, "ver* OR *ment", EXACT, True),
    inverted.Query(4, "the AND NOT that", EXACT, True),
    inverted.Query(5, "NOT (the OR der OR les)", EXACT, True),
    inverted.Query(6, "und", EXACT, False, fc.Range("n_chars", 1000, 2**62)),
    inverted.Query(7, "^th.*ing$", REGEX),
    inverted.Query(8, "*"),
]
_BATCH_SQL = [_x("the"), _w("tion"), f"{sql_term('text', 'glob', 'ver.*')} OR {sql_term('text', 'glob', '.*ment')}", f"{_x('the')} AND NOT {_x('that')}", f"NOT ({_x('the')} OR {_x('der')} OR {_x('les')})", f"{_x('und')} AND n_chars >= 1000", sql_term("text", "regex", "^th.*ing$"), "true"]
_add("find_many", lambda s, d: inverted.Batch.of(documents(s, d)).find_many(BATCH), " UNION ALL ".join(f"SELECT CAST({q.number} AS BIGINT) AS query, doc_id AS id FROM documents WHERE {w}" for q, w in zip(BATCH, _BATCH_SQL)))


def _saved(name: str, expr: str, where: str, method: str = EXACT, operators: bool = True) -> None:
    """One query by its plan on the saved tables of an index."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/lexgrove-saved-{uuid.uuid4().hex}"
        return inverted.Batch.of(documents(spark, sf_dir)).save(path).matching(expr, method, operators)

    _add(name, query, f"SELECT doc_id AS id FROM documents WHERE {where}")


_saved("saved_exact", "the", _x("the"))
_saved("saved_glob", "*shwh*", sql_term("text", "glob", ".*shwh.*"))
_saved("saved_bool", "(und OR avec) AND NOT tion*", f"({_x('und')} OR {_x('avec')}) AND NOT {sql_term('text', 'glob', 'tion.*')}")
_saved("saved_regex", "^th.*ing$", sql_term("text", "regex", "^th.*ing$"), REGEX)
_saved("saved_regex_repeated", "^(th|sh)+e?$", sql_term("text", "regex", "^(th|sh)+e?$"), REGEX)


# -- changes and publishing ------------------------------------------------------------------------
def _entries(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").alias("id"), F.col("text").alias("search_text"), F.create_map(F.lit("n_chars"), F.col("n_chars")).alias("facets"), F.col("doc_id").alias("seq"))


def upsert_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are indexed and the odd ones removed; then every third is added or replaced by another text."""
    docs, store = _table(spark, sf_dir, "documents"), IndexStore(spark)
    store.rebuild(_entries(docs))
    store.remove(docs.where("doc_id % 2 <> 0").select(F.col("doc_id").alias("id")))
    store.upsert(_entries(docs.where("doc_id % 3 = 0")).withColumn("search_text", F.lit("replaced Entry")))
    return store.current.matching("replaced OR the", operators=True).select("id", F.array_contains("tokens", "replaced").alias("is_new"))


def remove_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, store = _table(spark, sf_dir, "documents"), IndexStore(spark)
    store.rebuild(_entries(docs))
    store.remove(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id")))
    return store.current.matching("the").select("id")


_add("upsert_find", upsert_find, f"SELECT doc_id AS id, doc_id % 3 = 0 AS is_new FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 2 = 0 AND {_x('the')})")
_add("remove_find", remove_find, f"SELECT doc_id AS id FROM documents WHERE doc_id % 5 <> 0 AND {_x('the')}")


def ingest_stream_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a file stream into an index; then a query on what was published."""
    store = IndexStore(spark)
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    store.rebuild_from_stream(stream.select(F.col("event_id").alias("id"), F.col("event_type").alias("search_text"), F.col("event_id").alias("seq")))
    return store.current.matching("*click* OR *view*", operators=True).select("id")


_add("ingest_stream_final", ingest_stream_final, "SELECT event_id AS id FROM events WHERE regexp_matches(lower(event_type), 'click|view')")


_N = "(SELECT row_number() OVER (ORDER BY event_id) AS n FROM events)"


def ingest_plan_per_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which publish each event would land if each had its own; ``ingest_run_per_entry`` publishes so."""
    numbered = ranked(_table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), ["id"])
    return numbered.select(publish_plan(F.col("rank"), Policy.PER_ENTRY, 1).alias("sequence")).groupBy("sequence").agg(F.count("*").alias("entries"))


_add("ingest_plan_per_entry", ingest_plan_per_entry, f"SELECT n - 1 AS sequence, CAST(1 AS BIGINT) AS entries FROM {_N}")


def _run(table: str, id: str, text: str, options: Options, timed: bool = False) -> Query:
    """The engine itself over a table as a stream: each publish with its entries and what is then indexed.

    ``timed``: the stream stays open until its timer has published what came; nothing is published at the end.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
        store, events = IndexStore(spark), []
        ingestion = Ingestion(store, options, on_published=events.append)
        running = ingestion.start(stream.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("search_text"), F.col(id).cast("bigint").alias("seq")), available_now=not timed)
        if timed:
            n = rows.count()
            while ingestion.published < n and running.isActive:
                time.sleep(0.05)
            ingestion.stop()
        else:
            ingestion.finish()
        said = spark.createDataFrame([(e.sequence, e.entries, e.indexed) for e in events], "sequence bigint, entries bigint, indexed bigint")
        # what is found is read from the published version
        return said.crossJoin(store.current.docs.agg(F.count("*").alias("found"), F.min("id").alias("first"), F.max("id").alias("last")))  # a row for each publish, and one

    return query


def _run_sql(table: str, id: str, sequence: str) -> str:
    return f"""WITH n AS (SELECT row_number() OVER (ORDER BY {id}) AS n FROM {table}), p AS (SELECT {sequence} AS sequence, count(*) AS entries FROM n GROUP BY 1)
    SELECT sequence, entries, CAST(sum(entries) OVER (ORDER BY sequence) AS BIGINT) AS indexed, (SELECT count(*) FROM {table}) AS found, (SELECT min({id}) FROM {table}) AS first, (SELECT max({id}) FROM {table}) AS last FROM p"""


def _published(options: Options) -> Query:
    """All events through the engine: the entries of each publish."""
    run = _run("events", "event_id", "event_type", options)
    return lambda spark, sf_dir: run(spark, sf_dir).select("sequence", "entries")


_LATE = {"max_staleness": 1e6}
_add("ingest_plan_fixed", _published(Options(Policy.FIXED_BATCH, batch_size=400, **_LATE)), f"SELECT (n - 1) // 400 AS sequence, count(*) AS entries FROM {_N} GROUP BY 1")
_add("ingest_plan_adaptive_growth", _published(Options(batch_size=200, min_interval=1e6, **_LATE)), f"SELECT CAST(CASE WHEN n <= 200 THEN 0 ELSE ceil(log2(n / 200.0)) END AS BIGINT) AS sequence, count(*) AS entries FROM {_N} GROUP BY 1")
_add("ingest_plan_adaptive_fixed", _published(Options(batch_size=400, growing_cap=False, min_interval=1e6, **_LATE)), f"SELECT (n - 1) // 400 AS sequence, count(*) AS entries FROM {_N} GROUP BY 1")
for _name, _of, _how, _sequence in (
    ("per_entry", ("region", "r_regionkey", "r_name"), Options(Policy.PER_ENTRY, **_LATE), "n - 1"),
    ("fixed", ("supplier", "s_suppkey", "s_name"), Options(Policy.FIXED_BATCH, batch_size=30, **_LATE), "(n - 1) // 30"),
    ("adaptive_growth", ("supplier", "s_suppkey", "s_name"), Options(batch_size=5, min_interval=1e6, **_LATE), "CAST(CASE WHEN n <= 5 THEN 0 ELSE ceil(log2(n / 5.0)) END AS BIGINT)"),
    ("adaptive_fixed", ("supplier", "s_suppkey", "s_name"), Options(batch_size=30, growing_cap=False, min_interval=1e6, **_LATE), "(n - 1) // 30"),
    ("time_debounce", ("events", "event_id", "event_type"), Options(Policy.TIME_DEBOUNCE, min_interval=1.0, flush_on_stop=False, **_LATE), "0"),
    ("adaptive_timer", ("events", "event_id", "event_type"), Options(batch_size=10**9, min_interval=1.0, min_timer_batch=100, flush_on_stop=False, **_LATE), "0"),
    ("staleness", ("events", "event_id", "event_type"), Options(Policy.FIXED_BATCH, batch_size=10**9, max_staleness=1.0, flush_on_stop=False), "0"),
):
    _add(f"ingest_run_{_name}", _run(*_of, _how, timed=not _how.flush_on_stop), _run_sql(_of[0], _of[1], _sequence))


def _nations(spark: SparkSession, sf_dir: str) -> IndexStore:
    store = IndexStore(spark)
    store.rebuild(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("search_text"), F.col("n_nationkey").cast("bigint").alias("seq")))
    return store


def entry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single entries added, replaced and removed."""
    store = _nations(spark, sf_dir)
    store.add_entry(100, "ADDED LAND")
    said = [store.refresh_entry(3, "OTHER LAND"), store.refresh_entry(101, "NEW LAND"), store.remove_entry(5), store.remove_entry(500), store.contains(3), store.contains(5)]
    return store.current.docs.select("id", "search_text").withColumns({n: F.lit(x) for n, x in zip(("replaced", "refreshed_new", "removed", "removed_none", "holds_3", "holds_5"), said)})


_add("entry_changes", entry_changes, """SELECT *, true AS replaced, false AS refreshed_new, true AS removed, false AS removed_none, true AS holds_3, false AS holds_5
    FROM (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'OTHER LAND' ELSE n_name END AS search_text FROM nation WHERE n_nationkey <> 5 UNION ALL VALUES (100, 'ADDED LAND'), (101, 'NEW LAND'))""")


def clear_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries before and after everything is removed, and of a transient index beside it."""
    store = _nations(spark, sf_dir)
    before, found = store.entry_count(), store.current.count("united", WITHIN)
    store.clear()
    return spark.createDataFrame([(before, found, store.entry_count(), store.current.count("*"))], "entries bigint, found bigint, cleared bigint, left_over bigint")


_add("clear_and_count", clear_and_count, "SELECT count(*) AS entries, count(*) FILTER (WHERE contains(lower(n_name), 'united')) AS found, CAST(0 AS BIGINT) AS cleared, CAST(0 AS BIGINT) AS left_over FROM nation")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named indexes, one of them with initial entries, and a transient one: changes of one are not seen in the others."""
    known = Registry(spark)
    first, second, third = known.register("first"), known.register("second", initial={1: "one", 2: "two"}), known.transient()
    first.upsert(_nations(spark, sf_dir).current.docs.select("id", "search_text"))
    second.remove_entry(1)
    third.add_entry(7, "seven")
    rows = [(n, known[n].entry_count()) for n in ("first", "second")] + [("transient", third.entry_count())]
    return spark.createDataFrame(rows, "name string, entries bigint")


_add("registry", registry, "SELECT 'first' AS name, count(*) AS entries FROM nation UNION ALL VALUES ('second', 1), ('transient', 1)")


def vocabulary_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by documents after removals and an upsert, from the counts of the segments."""
    docs, store = _table(spark, sf_dir, "documents"), IndexStore(spark)
    store.rebuild(_entries(docs))
    store.remove(docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id")))
    store.upsert(_entries(docs.where("doc_id % 7 = 0")).withColumn("search_text", F.lit("replaced Entry")))
    return store.current.counts.words()


_add("vocabulary_after_changes", vocabulary_after_changes, f"""SELECT word, length(word) AS length, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest({sql_tokens('t')}) AS word
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'replaced Entry' ELSE text END AS t FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0)) GROUP BY word""")


def natural_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural order over several segments: parts by name, every third of them by brand instead, some gone."""
    parts, store = _table(spark, sf_dir, "part"), IndexStore(spark)
    rows = parts.select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("search_text"), F.col("p_partkey").cast("bigint").alias("seq"))
    store.rebuild(rows)
    store.upsert(parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_brand").alias("search_text")))
    store.remove(rows.where("id % 10 = 1").select("id"))
    return store.current.find_ranked("*", sort=NATURAL)


_add("natural_after_changes", natural_after_changes, f"SELECT p_partkey AS id, row_number() OVER (ORDER BY {NATURAL_SQL.format('t')}, p_partkey) AS rank FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS t FROM part WHERE p_partkey % 10 <> 1)")


def two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that take turns on one index, and a reader that follows."""
    first = IndexStore(spark)
    second, reader = IndexStore(spark, first.path), IndexStore(spark, first.path)
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_orderpriority").alias("search_text"), F.col("o_orderkey").cast("bigint").alias("seq"))
    seen = []
    for writer, part in ((first, 0), (second, 1), (first, 2)):
        writer.upsert(orders.where(F.col("id") % 3 == part))
        seen.append(reader.version)
    return reader.current.matching("urgent", WITHIN).select("id", F.lit(seen == [0, 1, 2]).alias("followed"))


_add("two_writers", two_writers, "SELECT o_orderkey AS id, true AS followed FROM orders WHERE contains(lower(o_orderpriority), 'urgent')")


def ingest_run_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a customer under its key, in three publishes: the last one holds."""
    orders = _table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    store = IndexStore(spark)
    ingestion = Ingestion(store, Options(Policy.FIXED_BATCH, batch_size=orders.count() // 3 + 1, max_staleness=1e6))
    ingestion.start(stream.select(F.col("o_custkey").cast("bigint").alias("id"), F.col("o_orderpriority").alias("search_text"), F.col("o_orderkey").cast("bigint").alias("seq")), available_now=True)
    result = ingestion.finish()
    told = {"publishes": result.publishes, "accepted": result.accepted, "indexed": result.indexed}
    return store.current.docs.select("id", F.col("search_text").alias("priority"), *(F.lit(v).cast("bigint").alias(k) for k, v in told.items()))


_add("ingest_run_duplicates", ingest_run_duplicates, "SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS priority, CAST(3 AS BIGINT) AS publishes, (SELECT count(*) FROM orders) AS accepted, (SELECT count(DISTINCT o_custkey) FROM orders) AS indexed FROM orders GROUP BY o_custkey")


def ingest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put in four chunks into a feed with room for three: the last one has to wait until some are published."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_mktsegment").alias("search_text"))
    sizes = [r["n"] for r in rows.groupBy((F.col("id") % 4).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]
    store = IndexStore(spark)
    feed, options = Feed(store, capacity=sum(sizes) - min(sizes)), Options(Policy.FIXED_BATCH, batch_size=max(sizes), max_staleness=1.0)
    held = []
    for part in range(3):
        feed.put(rows.where(F.col("id") % 4 == part))
        held.append(feed.pending())
    try:
        feed.put(rows.where("id % 4 = 3"), timeout=0)
        waited = feed.pending() <= feed.capacity and sizes[3] <= min(sizes)
    except TimeoutError:
        waited = True
    ingestion = Ingestion(store, options)
    feed.start(ingestion)
    if feed.put_so_far() < sum(sizes):
        feed.put(rows.where("id % 4 = 3"), timeout=600)
    while ingestion.published < sum(sizes):
        time.sleep(0.05)
    ingestion.stop()
    return store.current.matching("building").select("id", F.lit(waited and max(held) <= feed.capacity and feed.pending() == 0).alias("bounded"))


_add("ingest_feed", ingest_feed, "SELECT c_custkey AS id, true AS bounded FROM customer WHERE lower(c_mktsegment) = 'building'")


def registry_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made by one registry, opened by name and changed by another."""
    base = f"{shared_folder(spark)}/lexgrove-registry-{uuid.uuid4().hex}"
    Registry(spark, base).register("customers", FILE_MASK).upsert(_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("search_text")))
    again = Registry(spark, base)
    again["customers"].remove(_table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")))
    return Registry(spark, base)["customers"].current.matching("customer#00000000?").select("id")


_add("registry_reopened", registry_reopened, "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 <> 0 AND regexp_full_match(lower(c_name), 'customer#00000000.')")


def build_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written build of the documents, and whether what it told rose from 0 to 1."""
    heard: list[float] = []
    index = documents(spark, sf_dir).written(f"{shared_folder(spark)}/lexgrove-built-{uuid.uuid4().hex}", heard.append)
    return index.docs.agg(F.count("*").alias("documents"), F.sum(F.size("tokens")).cast("bigint").alias("words")).withColumn("rose", F.lit(heard[0] == 0.0 and heard[-1] == 1.0 and heard == sorted(heard)))


_add("build_progress", build_progress, f"SELECT count(*) AS documents, CAST(sum(len(list_distinct({sql_tokens('text')}))) AS BIGINT) AS words, true AS rose FROM documents")


def facet_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found by facets that the index has, and how many that it does not have are refused."""
    index, refused = parts(spark, sf_dir), 0
    for name in ("size", "weight", "Size"):
        try:
            index.condition(None, facets=fc.Range(name, 1, 5))
        except ValueError:
            refused += 1
    return index.matching(None, facets=fc.Range("size", 1, 5)).select("id", F.lit(refused).alias("refused"))


_add("facet_unknown", facet_unknown, "SELECT p_partkey AS id, 2 AS refused FROM part WHERE p_size BETWEEN 1 AND 5")
_add("separators", lambda s, d: _table(s, d, "part").select("p_partkey", F.explode(F.split("p_name", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n")).withColumns({"by_default": is_separator(F.col("letter")), "in_masks": is_separator(F.col("letter"), FILE_MASK)}), f"SELECT letter, count(*) AS n, regexp_full_match(letter, '{SEPARATORS}') AS by_default, false AS in_masks FROM (SELECT unnest(string_split(p_name, '')) AS letter FROM part) GROUP BY letter")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["BATCH", "DEFAULT", "documents", "labelled", "lines", "oracle_sql", "orders", "parts", "queries"]
