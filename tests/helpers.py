"""Small indexes from literals."""

from lexgrove.functions.text import DEFAULT
from lexgrove.operators.index import SearchIndex
from lexgrove.sources.store import entries


def index(spark, rows, preset=DEFAULT):
    return SearchIndex.build(entries(spark, rows), sort="sort_text", facets="facets", ordinal="seq", preset=preset)


def ids(found):
    return [r.id for r in found.select("id").collect()]
