"""An index: one row for each document, with what queries and orders need computed beforehand."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import DEFAULT, Tokenization, normal_text, tokens
from lexgrove.operators.facets import NONE, PREFIX, Facets, Mask, Range
from lexgrove.operators.matching import EXACT, matches
from lexgrove.operators.natural_order import WholeOrder
from lexgrove.operators.progress import told
from lexgrove.operators.ranks import ranked

SNAPSHOT, NATURAL = "snapshot", "natural"


def facet_names(df: DataFrame, facets: str) -> list[str]:
    """Names in a map column, in order. The set of names is small by nature: each becomes a column."""
    return sorted(r[0] for r in df.select(F.explode(F.map_keys(facets))).distinct().collect())


def prepare(df: DataFrame, id: str = "id", text: str = "search_text", sort: str | None = None, facets: str | dict[str, Column] | None = None, ordinal: str | None = None, preset: Tokenization = DEFAULT, names: Iterable[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of an index from rows of a table.

    ``sort`` is the text of the natural order, by default the indexed text. ``facets`` is a map
    column, or a column for each name; what is missing is 0. ``ordinal`` is the snapshot order, by
    default that of the ids. Columns to ``keep`` stay as they are.
    """
    source = F.col(text)
    if isinstance(facets, str):
        columns = {n: F.try_element_at(F.col(facets), F.lit(n)) for n in (facet_names(df, facets) if names is None else names)}
    else:
        columns = facets or {}
    sorted_by = F.coalesce(F.col(sort), source) if sort else source
    return df.select(
        F.col(id).cast("bigint").alias("id"),
        F.col(ordinal or id).cast("bigint").alias("ordinal"),
        F.coalesce(source, F.lit("")).alias("search_text"),
        F.coalesce(sorted_by, F.lit("")).alias("sort_text"),
        normal_text(source, preset).alias("norm"),
        tokens(source, preset).alias("tokens"),
        *(F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(PREFIX + n) for n, c in sorted(columns.items())),
        *keep,
    )


@dataclass(frozen=True)
class SearchIndex:
    """Immutable; queries are lazy DataFrames over ``docs``."""

    docs: DataFrame
    preset: Tokenization = DEFAULT
    natural: object = None  # who has the natural order; by default it is worked out when first asked for
    counts: object = None  # who has the numbers of documents by word; by default they are counted
    _known: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def build(cls, df: DataFrame, *, preset: Tokenization = DEFAULT, progress: Callable[[float], None] | None = None, **columns) -> SearchIndex:
        """Index a table; see ``prepare`` for the columns. Nothing runs yet: ``written`` tells how a build goes on."""
        if progress:
            progress(0.0)
        out = cls(prepare(df, preset=preset, **columns), preset)
        if progress:
            progress(1.0)
        return out

    def written(self, path: str, progress: Callable[[float], None] | None = None) -> SearchIndex:
        """The index as a table of its own, read again; ``progress`` hears how far the build is, from 0.0 to 1.0."""
        with told(self.docs.sparkSession, progress):
            self.docs.write.mode("overwrite").parquet(path)
        return SearchIndex(self.docs.sparkSession.read.schema(self.docs.schema).parquet(path), self.preset)

    @property
    def facets(self) -> list[str]:
        return [c.removeprefix(PREFIX) for c in self.docs.columns if c.startswith(PREFIX)]

    def condition(self, text: str | None, method: str = EXACT, operators: bool = False, facets: Facets | Range | Mask | None = None) -> Column:
        """The query as one column. Facets come first, as plain columns that scans can prune by."""
        wanted = Facets.combine(facets)
        allowed = wanted.column(self.facets)
        if not text or not text.strip():
            return F.lit(False) if wanted.is_empty else allowed
        found = matches(self.docs.sparkSession, text, method, operators, self.preset)
        return found if wanted.is_empty else allowed & found

    def matching(self, text: str | None, method: str = EXACT, operators: bool = False, facets: Facets | Range | Mask | None = None) -> DataFrame:
        """The documents found, in no order."""
        return self.docs.where(self.condition(text, method, operators, facets))

    def find(self, text: str | None, method: str = EXACT, operators: bool = False, sort: str = SNAPSHOT, facets: Facets | Range | Mask | None = None) -> DataFrame:
        """Ids of the documents found, in snapshot order or in natural order with ties by id."""
        return self.in_order(self.matching(text, method, operators, facets), sort)

    def in_order(self, found: DataFrame, sort: str = SNAPSHOT) -> DataFrame:
        """Ids of rows of the index, in an order."""
        found, order = self._ordered(found, sort)
        return found.orderBy(*order).select("id")

    def find_ranked(self, text: str | None, method: str = EXACT, operators: bool = False, sort: str = SNAPSHOT, facets: Facets | Range | Mask | None = None, limit: int | None = None) -> DataFrame:
        """Ids with their place in the order, from 1. With a limit only the first are sorted out."""
        found, order = self._ordered(self.matching(text, method, operators, facets), sort)
        if limit is not None:
            found = found.orderBy(*order).limit(limit)
        return ranked(found, order)

    def _ordered(self, found: DataFrame, sort: str) -> tuple[DataFrame, Sequence[str]]:
        """What was found with the columns of an order."""
        if sort == SNAPSHOT:
            return found, ("ordinal", "id")
        if sort != NATURAL:
            raise ValueError(f"unknown order {sort!r}")
        order = self.natural or self._known.setdefault("natural", WholeOrder(self.docs))
        return order.ordered(found)

    def count_df(self, text: str | None, method: str = EXACT, operators: bool = False, facets: Facets | Range | Mask | None = None) -> DataFrame:
        return self.matching(text, method, operators, facets).agg(F.count("*").alias("matches"))

    def count(self, text: str | None, method: str = EXACT, operators: bool = False, facets: Facets | Range | Mask | None = None) -> int:
        return self.count_df(text, method, operators, facets).first()[0]

    def document_count(self) -> int:
        return self.docs.count()

    def unique_word_count(self) -> int:
        if self.counts is not None:
            return self.counts.words().count()
        return self.docs.select(F.explode("tokens").alias("word")).agg(F.count_distinct("word")).first()[0]


__all__ = ["NATURAL", "NONE", "SNAPSHOT", "SearchIndex", "facet_names", "prepare", "ranked"]
