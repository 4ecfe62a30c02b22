"""Text presets and scalar text functions, as column expressions.

A text is the set of its lower-cased tokens: the maximal runs of characters that are no separators.
Null texts are empty ones throughout, so that no predicate on a text is ever null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators of the presets.
DEFAULT_INDEX = " .,;:/\\\r\n\t|-#[]{}()~£$€"
DEFAULT_QUERY = " .,;:/\\\r\n|-#[]{}()~£$€"
MASK_QUERY = " \r\n"


@dataclass(frozen=True)
class Tokenization:
    """Separators of indexed texts and of queries. Without index separators a text is one token."""

    index: str = DEFAULT_INDEX
    query: str = DEFAULT_QUERY

    @classmethod
    def create(cls, index: str | None, query: str | None) -> Tokenization:
        return cls(index or "", query or "")

    @property
    def whole(self) -> bool:
        return not self.index

    @property
    def border(self) -> str:
        """The character that stands between tokens, and at both ends, of normal text."""
        return self.index[:1]


DEFAULT = Tokenization()
FILE_MASK = Tokenization("", MASK_QUERY)


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if re.match(r"[^\w\s]", c) and ord(c) < 128 else c for c in chars) + "]"


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold(word: str) -> str:
    """Lower case, character by character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in word)


def normal_text(text: Column | str, preset: Tokenization = DEFAULT) -> Column:
    """Lower-case text with one border between tokens and at both ends."""
    low = F.lower(_text(text))
    if preset.whole:
        return low
    edge = F.lit(preset.border)
    return F.regexp_replace(F.concat(edge, low, edge), _class(preset.index) + "+", preset.border.replace("\\", "\\\\").replace("$", "\\$"))


def all_tokens(text: Column | str, preset: Tokenization = DEFAULT) -> Column:
    """Tokens in order, repeats included."""
    low = F.lower(_text(text))
    if preset.whole:
        return F.when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))
    return F.array_remove(F.split(low, _class(preset.index) + "+"), "")


def tokens(text: Column | str, preset: Tokenization = DEFAULT) -> Column:
    """Distinct tokens, in the order of their first occurrence."""
    return F.array_distinct(all_tokens(text, preset))


def words_by_length(text: Column | str, preset: Tokenization = DEFAULT) -> Column:
    """Distinct tokens, longest first; words of one length in their natural order."""
    sized = F.transform(tokens(text, preset), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(sized), lambda s: s["t"])


def is_separator(char: Column, preset: Tokenization = DEFAULT) -> Column:
    return F.lit(False) if preset.whole else F.coalesce(char.rlike("^" + _class(preset.index) + "\\z"), F.lit(False))


def normal_word(word: Column | str) -> Column:
    return F.lower(_text(word))


def name_tokens(name: Column | str, joiner: str = "-") -> Column:
    """Distinct lower-case runs of letters and digits in their first order, joined."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.lower(_text(name)), F.lit(r"([\p{L}\p{Nd}]+)"), 1)), joiner)


def bigrams(word: Column) -> Column:
    """Distinct pairs of neighbouring characters of a word."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
    return F.when(F.length(word) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))
