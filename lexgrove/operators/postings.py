"""Inverted tables, and many queries in one job.

``postings`` has a row for each document and distinct token, ``vocabulary`` one for each token.
A batch of queries tests its distinct terms on the vocabulary only, joins what matches with the
postings, and gathers for each query and document which of the query's terms it has, as bits. For
each query, the combinations of bits for which it holds are worked out beforehand.

A single query on saved tables is planned by the vocabulary: it takes the postings of the words that match if
they are fewer than the documents, and a scan of the documents otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import bigrams, normal_text
from lexgrove.operators.expression import Term, fold_tree, parse, terms
from lexgrove.operators.facets import Facets, Mask, Range
from lexgrove.operators.index import SNAPSHOT, SearchIndex
from lexgrove.operators.matching import EXACT, REGEX, has_wildcards, least_length, pattern_matches, term_matches, term_shape, valid_pattern
from lexgrove.operators.patterns import required

#: Terms of a query up to which all combinations are worked out.
MOST_TERMS = 10
#: Predicates evaluated in one projection.
TOGETHER = 50
#: Bytes, about, of what a batch of queries says that are sent to all executors.
MOST_SENT = 8 << 20


def _asked(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of what the queries ask for: broadcast up to ``MOST_SENT``; how a larger one is joined is left to Spark.

    It is made from columns, so that it is a part of the plan and no Python worker is asked for it.
    """
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    columns = zip(*rows) if rows else [()] * len(fields)
    table = spark.createDataFrame(pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)}))
    size = sum(len(x) * 4 if isinstance(x, str) else 8 for r in rows for x in r)
    return F.broadcast(table) if size <= MOST_SENT else table


def postings(index: SearchIndex) -> DataFrame:
    """(word, id): each token of each document once."""
    return _rows(index.docs, F.col("tokens"), "word", "id")


def _rows(docs: DataFrame, array: Column, name: str, *others: str) -> DataFrame:
    """A row for each element of an array without nulls. For a plain ``explode`` Spark works the array out a second time, to leave out empty ones."""
    return docs.select(F.explode_outer(array).alias(name), *others).where(F.col(name).isNotNull())


def vocabulary(index: SearchIndex) -> DataFrame:
    """(word, length, documents) of each distinct token."""
    return _counted(postings(index))


def _counted(table: DataFrame) -> DataFrame:
    return table.groupBy("word").agg(F.count("*").alias("documents")).select("word", F.length("word").cast("bigint").alias("length"), "documents")


def bigram_table(words: DataFrame) -> DataFrame:
    """(bigram, word): each word once for each of its bigrams."""
    return _pairs(words.select("word").distinct())


def _pairs(words: DataFrame) -> DataFrame:
    """What ``bigrams`` says, in generated code: the pair at each place of a word, unless it has come before in it."""
    at = words.where(F.length("word") > 1).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("_at"))
    pairs = at.select(F.substring("word", F.col("_at"), F.lit(2)).alias("bigram"), "word", "_at")
    return pairs.where(F.position(F.col("bigram"), F.col("word")) == F.col("_at")).select("bigram", "word")


def within_by_bigram(table: DataFrame, part: str) -> DataFrame:
    """Words that contain ``part`` (two characters at least), found by its first bigram."""
    return table.where((F.col("bigram") == part[:2]) & F.col("word").contains(part)).select("word").distinct()


@dataclass(frozen=True)
class Query:
    """One of a batch."""

    number: int
    text: str
    method: str = EXACT
    operators: bool = False
    facets: Facets | Range | Mask | None = None


@dataclass(frozen=True)
class Plan:
    """``postings`` or ``scan``, and the postings that the words which match have, where they were counted; whether these words are ``few`` enough to be sent."""

    how: str
    rows: int | None = None
    few: bool = field(default=False, compare=False)


@dataclass
class Batch:
    """The inverted tables of an index, written or persisted by the caller, and queries on them.

    With a table of bigrams, words that contain, start or end with a literal of two characters or
    more are looked up by its first bigram; without one, each is tested on the whole vocabulary.
    Tables that are not ``kept`` would be made again wherever they are read, so up to ``TOGETHER`` queries go through the documents once instead.
    """

    index: SearchIndex
    postings: DataFrame
    vocabulary: DataFrame
    bigrams: DataFrame | None = None
    kept: bool = True

    _count: int | None = field(default=None, repr=False)

    @classmethod
    def of(cls, index: SearchIndex) -> Batch:
        return cls(index, postings(index), vocabulary(index), kept=False)

    @classmethod
    def cached(cls, index: SearchIndex) -> Batch:
        """In memory, with the postings partitioned by word: only the words that match are moved to them."""
        words = vocabulary(index).persist()
        return cls(index, postings(index).repartition("word").persist(), words, bigram_table(words).persist())

    def release(self) -> None:
        for df in (self.bigrams, self.postings, self.vocabulary):
            if df is not None:
                df.unpersist()

    def save(self, path: str) -> Batch:
        """Write the tables sorted, so that a scan for few words, or for long enough ones, reads few pages.

        The texts are read once, for the postings: words are counted in the postings as written, and bigrams made of the vocabulary as written.
        Rows are dealt out by hash, as a range would have to be found by a reading of its own.
        """
        read = self.index.docs.sparkSession.read
        self.postings.repartition("word").sortWithinPartitions("word", "id").write.mode("overwrite").parquet(f"{path}/postings")
        words = _counted(read.schema(self.postings.schema).parquet(f"{path}/postings"))
        words.sortWithinPartitions("length", "word").write.mode("overwrite").parquet(f"{path}/vocabulary")
        pairs = _pairs(read.schema(words.schema).parquet(f"{path}/vocabulary"))
        pairs.repartition("bigram").sortWithinPartitions("bigram", "word").write.mode("overwrite").parquet(f"{path}/bigrams")
        return Batch.load(self.index, path)

    @classmethod
    def load(cls, index: SearchIndex, path: str) -> Batch:
        spark = index.docs.sparkSession
        return cls(index, *(spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocabulary", "bigrams")))

    def find_many(self, queries: Sequence[Query], few: bool = False) -> DataFrame:
        """(query, id) of all that the queries find; ``few`` says that the words which match are known to be few enough to be sent to all executors."""
        spark = self.index.docs.sparkSession
        if len({q.number for q in queries}) != len(queries):
            raise ValueError("queries share a number")
        for q in queries:
            Facets.combine(q.facets).column(self.index.facets)  # unknown facets are refused first
        if not self.kept and 0 < len(queries) <= TOGETHER:
            return self._by_scan(queries)
        by_terms, by_scan = [], []
        for q in queries:
            tree = self._tree(q)
            if not q.text.strip() or (tree is not None and (len(terms(tree)) > MOST_TERMS or (q.method != REGEX and "*" in terms(tree)))):
                by_scan.append(q)
            elif tree is not None:
                by_terms.append((q, tree))
        words = [(q, tree.word) for q, tree in by_terms if isinstance(tree, Term) and q.method != REGEX and term_shape(tree.word, q.method)[0] == "equal"]
        by_word = {q.number for q, _ in words}
        by_terms = [(q, tree) for q, tree in by_terms if q.number not in by_word]
        parts = [self._by_words(words)] if words else []
        parts += [self._by_terms(by_terms, few)] if by_terms else []
        parts += [self._by_scan(by_scan[i : i + TOGETHER]) for i in range(0, len(by_scan), TOGETHER)]
        return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query bigint, id bigint")

    def _tree(self, q: Query):
        """What a query says, or None if it finds nothing. A regular expression is one term, whatever is in it."""
        if q.method == REGEX:
            return Term(q.text) if q.text.strip() and valid_pattern(self.index.docs.sparkSession, q.text) else None
        return parse(q.text, q.operators, self.index.preset) if q.text.strip() else None

    # -- one query ---------------------------------------------------------------------------------
    def plan(self, text: str, method: str = EXACT, operators: bool = False) -> Plan:
        """How to find one query: by postings, or by a scan of the documents, and what of the vocabulary says so."""
        query = Query(0, text, method, operators)
        tree = self._tree(query)
        own = terms(tree) if tree is not None else []
        if not text.strip() or tree is None or len(own) > MOST_TERMS or (method != REGEX and "*" in own):
            return Plan("scan")
        if fold_tree(tree, lambda w: False, lambda a: not a, lambda a, b: a and b, lambda a, b: a or b):
            return Plan("scan")  # holds for documents without any of its terms
        leaves = {leaf: n for n, leaf in enumerate(self._leaf(query, w) for w in own)}
        if len(leaves) == 1 and method != REGEX and term_shape(*next(iter(leaves)))[0] == "equal":
            return Plan("postings")  # its postings are what it finds
        words, literals = self._words(leaves)
        if literals:
            exact = self.vocabulary.where(F.col("word").isin([w for _, w in literals]) & F.col("length").isin(sorted({len(w) for _, w in literals}))).select("word")
            words.append(exact.select(F.lit(-1).cast("bigint").alias("leaf"), "word"))
        if not words:
            return Plan("postings", 0)
        sizes = F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0))
        rows, size = reduce(DataFrame.union, words).join(self.vocabulary, "word").agg(*sizes).first()
        return Plan("postings" if rows <= self.documents() else "scan", rows, size <= MOST_SENT)

    def documents(self) -> int:
        if self._count is None:
            self._count = self.index.document_count()
        return self._count

    def matching(self, text: str, method: str = EXACT, operators: bool = False, facets: Facets | Range | Mask | None = None) -> DataFrame:
        """(id) of the documents that one query finds, by its plan."""
        wanted = Facets.combine(facets)
        wanted.column(self.index.facets)
        plan = self.plan(text, method, operators)
        if plan.how == "scan":
            return self.index.matching(text, method, operators, facets).select("id")
        tree = self._tree(Query(0, text, method, operators))
        if method == EXACT and isinstance(tree, Term) and term_shape(tree.word, EXACT)[0] == "equal" and wanted.is_empty:
            none = any(c in self.index.preset.index for c in tree.word)
            return self.postings.where(F.lit(False) if none else F.col("word") == tree.word).select("id")
        return self.find_many([Query(0, text, method, operators, facets)], plan.few).select("id")

    def find(self, text: str, method: str = EXACT, operators: bool = False, sort: str = SNAPSHOT, facets: Facets | Range | Mask | None = None) -> DataFrame:
        """Ids in an order; of the documents only keys and places are read where postings say which they are."""
        if self.plan(text, method, operators).how == "scan":
            return self.index.find(text, method, operators, sort, facets)
        found = self.index.docs.join(self.matching(text, method, operators, facets), "id", "left_semi")
        return self.index.in_order(found, sort)

    # -- many --------------------------------------------------------------------------------------
    def _by_scan(self, queries: Sequence[Query]) -> DataFrame:
        """One pass over the documents that tests each query."""
        each = [F.when(self.index.condition(q.text, q.method, q.operators, q.facets), F.lit(q.number).cast("bigint")) for q in queries]
        return _rows(self.index.docs, F.array_compact(F.array(*each)), "query", "id")

    @staticmethod
    def _leaf(q: Query, term: str) -> tuple[str, str]:
        return term, q.method if q.method == REGEX else EXACT if has_wildcards(term) else q.method

    def _words(self, leaves: dict[tuple[str, str], int]) -> tuple[list[DataFrame], list[tuple[int, str]]]:
        """Tables of (leaf, word) of the words that match, and the terms that are words themselves."""
        spark, literals, looked_up, others, words = self.index.docs.sparkSession, [], [], [], []
        for (term, method), n in leaves.items():
            if method == REGEX:
                words.append(self._pattern_words(term).select(F.lit(n).cast("bigint").alias("leaf"), "word"))
                continue
            kind, text = term_shape(term, method)
            if any(c in self.index.preset.index for c in term):
                continue  # no token has such a character
            if kind == "equal":
                literals.append((n, text))
            elif kind != "glob" and len(text) > 1 and self.bigrams is not None:
                looked_up.append((n, kind, text, text[:2]))
            else:
                others.append((n, term, method))
        if looked_up:
            word, text = F.col("word"), F.col("text")
            test = F.when(F.col("kind") == "contains", F.contains(word, text)).when(F.col("kind") == "starts", F.startswith(word, text)).otherwise(F.endswith(word, text))
            asked = _asked(spark, looked_up, "leaf bigint, kind string, text string, bigram string")
            firsts = sorted({x[3] for x in looked_up})
            able = self.bigrams.where(F.col("bigram").isin(firsts)) if len(firsts) <= TOGETHER else self.bigrams  # few are looked up in the pages that have them
            words.append(able.join(asked, "bigram").where(test).select("leaf", "word"))
        others.sort(key=lambda x: least_length(x[1]))  # terms that short words cannot match are tested together
        for i in range(0, len(others), TOGETHER):
            group = others[i : i + TOGETHER]
            vocabulary = self.vocabulary.where(F.col("length") >= least_length(group[0][1])).select("word", "length", normal_text("word", self.index.preset).alias("norm"))
            tests = [F.when((F.col("length") >= least_length(w)) & term_matches(w, m, self.index.preset), F.lit(n).cast("bigint")) for n, w, m in group]
            words.append(vocabulary.select(F.explode(F.array_compact(F.array(*tests))).alias("leaf"), "word"))
        return words, literals

    def _pattern_words(self, pattern: str) -> DataFrame:
        """Words in which a regular expression is found: of those with its required text, looked up if there are bigrams."""
        text = required(pattern)
        if len(text) > 1 and self.bigrams is not None:
            able = self.bigrams.where((F.col("bigram") == text[:2]) & F.col("word").contains(text)).select("word")
        else:
            able = self.vocabulary.where(F.col("word").contains(text)).select("word") if text else self.vocabulary.select("word")
        return able.withColumn("_tokens", F.array("word")).where(pattern_matches(pattern, "_tokens")).select("word")

    def _hits(self, leaves: dict[tuple[str, str], int], few: bool = False) -> DataFrame:
        """(leaf, id) for the distinct terms of a batch: a document for each of its words that matches."""
        spark, hits = self.index.docs.sparkSession, []
        words, literals = self._words(leaves)
        if literals:
            hits.append(self.postings.join(_asked(spark, literals, "leaf bigint, word string"), "word").select("leaf", "id"))
        if words:
            wanted = reduce(DataFrame.union, words)
            hits.append(self.postings.join(F.broadcast(wanted) if few else wanted, "word").select("leaf", "id"))
        return reduce(DataFrame.union, hits) if hits else spark.createDataFrame([], "leaf bigint, id bigint")

    def _by_words(self, queries: Sequence[tuple[Query, str]]) -> DataFrame:
        """Queries that are a word: its postings, which name each document once, so that nothing is gathered."""
        asked = [(q.number, w) for q, w in queries if not any(c in self.index.preset.index for c in w)]
        found = self.postings.join(_asked(self.index.docs.sparkSession, asked, "query bigint, word string"), "word").select("query", "id")
        return self._allowed(found, [q for q, _ in queries])

    def _allowed(self, found: DataFrame, queries: Sequence[Query]) -> DataFrame:
        """What was found, where queries have facets only the documents that these allow."""
        limited = [q for q in queries if not Facets.combine(q.facets).is_empty]
        if not limited:
            return found
        allowed = [F.when(Facets.combine(q.facets).column(self.index.facets), F.lit(q.number).cast("bigint")) for q in limited]
        able = self.index.docs.select(F.explode(F.array_compact(F.array(*allowed))).alias("query"), "id")
        ids = [q.number for q in limited]
        kept = found.where(F.col("query").isin(ids)).join(able, ["query", "id"], "left_semi")
        return kept if len(limited) == len(queries) else found.where(~F.col("query").isin(ids)).union(kept)

    def _by_terms(self, queries: Sequence[tuple[Query, object]], few: bool = False) -> DataFrame:
        spark = self.index.docs.sparkSession
        leaves: dict[tuple[str, str], int] = {}
        uses, holds, inverse = [], [], []
        for q, tree in queries:
            own = terms(tree)
            for bit, w in enumerate(own):
                leaf = leaves.setdefault(self._leaf(q, w), len(leaves))
                uses.append((leaf, q.number, 1 << bit))
            true = [m for m in range(1 << len(own)) if fold_tree(tree, lambda w: bool(m >> own.index(w) & 1), lambda a: not a, lambda a, b: a and b, lambda a, b: a or b)]
            if 0 in true:  # holds without any term: all documents but those whose bits say no
                inverse.append(q)
                true = sorted(set(range(1 << len(own))) - set(true))
            holds += [(q.number, m) for m in true]
        has = self._hits(leaves, few).join(_asked(spark, uses, "leaf bigint, query bigint, bit bigint"), "leaf").groupBy("query", "id").agg(F.bit_or("bit").alias("bits"))
        kept = has.join(_asked(spark, holds, "query bigint, bits bigint"), ["query", "bits"]).select("query", "id")
        numbers = [q.number for q in inverse]
        out = kept.where(~F.col("query").isin(numbers)) if numbers else kept
        if numbers:
            everything = self.index.docs.select(F.explode(F.array(*(F.lit(n).cast("bigint") for n in numbers))).alias("query"), "id")
            out = out.union(everything.join(kept, ["query", "id"], "left_anti"))
        return self._allowed(out, [q for q, _ in queries])


def combine(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Set operations on results: ids in either, in both, or in the first alone."""
    if kind == "union":
        return left.select("id").union(right.select("id")).distinct()
    if kind not in ("intersect", "except"):
        raise ValueError(f"unknown set operation {kind!r}")
    return left.select("id").distinct().join(right.select("id"), "id", "left_semi" if kind == "intersect" else "left_anti")
