"""Filters on numeric facets: ranges and bit masks, all of which must hold."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "facet_"


@dataclass(frozen=True)
class Range:
    name: str
    low: int
    high: int

    def column(self) -> Column:
        return F.col(PREFIX + self.name).between(self.low, self.high)


@dataclass(frozen=True)
class Mask:
    """All bits of ``must`` and none of ``must_not``."""

    name: str
    must: int
    must_not: int = 0

    def column(self) -> Column:
        value = F.col(PREFIX + self.name)
        bits = lambda n: F.lit(n).cast("bigint")
        return (value.bitwiseAND(bits(self.must)) == bits(self.must)) & (value.bitwiseAND(bits(self.must_not)) == bits(0))


@dataclass(frozen=True)
class Facets:
    """A conjunction; without parts it holds for all."""

    parts: tuple[Range | Mask, ...] = ()

    @classmethod
    def combine(cls, *filters: Facets | Range | Mask | None) -> Facets:
        return cls(tuple(p for f in filters if f is not None for p in (f.parts if isinstance(f, Facets) else (f,))))

    @property
    def is_empty(self) -> bool:
        return not self.parts

    def column(self, known: Iterable[str]) -> Column:
        """The filter as a column; a facet that the index does not have is an error."""
        known = set(known)
        for p in self.parts:
            if p.name not in known:
                raise ValueError(f"unknown facet {p.name!r}; there are {sorted(known)}")
        return reduce(lambda a, b: a & b, (p.column() for p in self.parts), F.lit(True))


NONE = Facets()


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, as a facet."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def ticks(time: Column) -> Column:
    """Tenths of microseconds since the year 1."""
    return micros(time) * 10 + F.lit(621355968000000000)
