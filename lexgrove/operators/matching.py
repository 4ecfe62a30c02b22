"""From terms and trees to one column: whether a document matches.

Documents have ``norm`` (see ``normal_text``) and, for regular expressions, ``tokens``. Terms are
tested on ``norm`` with plain string functions, which stay inside generated code: a token is what
stands between two borders. No predicate is ever null, so NOT is the complement.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import DEFAULT, Tokenization
from lexgrove.operators.expression import fold_tree, parse
from lexgrove.operators.patterns import bounded, quick

EXACT, WITHIN, REGEX = "exact", "within", "regex"


def has_wildcards(term: str) -> bool:
    return "*" in term or "?" in term


def least_length(term: str) -> int:
    """Characters that a token matching a glob has at least."""
    return len(term) - term.count("*")


def has_star(term: str) -> bool:
    return "*" in term


def glob_pattern(term: str, inner: str = ".") -> str:
    """A glob as a regular expression: ``*`` any number of ``inner``, ``?`` one."""
    parts = re.findall(r"\*+|\?|[^*?]+", term)
    return "".join(f"{inner}*" if p[0] == "*" else inner if p == "?" else _quoted(p) for p in parts)


def _quoted(literal: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|#&~" else c for c in literal)


def term_matches(term: str, method: str, preset: Tokenization = DEFAULT, norm: str = "norm") -> Column:
    """Whether some token equals the term, contains it, or matches it as a glob."""
    text = F.col(norm)
    if term == "*":
        return F.lit(True)  # every document, even one without a token
    if any(c in preset.index for c in term):
        return F.lit(False)  # no token has such a character
    d = preset.border
    if not has_wildcards(term):
        if method == WITHIN:
            return text.contains(term)
        return text == term if preset.whole else text.contains(d + term + d)
    core = term.strip("*")
    if not core:
        return text != d  # there is a token
    if has_wildcards(core):
        if preset.whole:
            return (text != "") & text.rlike("(?s)\\A" + glob_pattern(term) + "\\z")
        return text.rlike(_quoted(d) + glob_pattern(term, f"[^{_quoted(d)}]") + _quoted(d))
    before, after = not term.startswith("*"), not term.endswith("*")
    if preset.whole:
        return text.startswith(core) if before else text.endswith(core) if after else text.contains(core)
    return text.contains((d if before else "") + core + (d if after else ""))


def term_shape(term: str, method: str) -> tuple[str, str]:
    """How a token is tested for a term: equal, starts, ends or contains a literal; or else a glob."""
    if not has_wildcards(term):
        return ("contains" if method == WITHIN else "equal"), term
    core = term.strip("*")
    if not core or has_wildcards(core):
        return "glob", term
    before, after = not term.startswith("*"), not term.endswith("*")
    return ("starts" if before else "ends" if after else "contains"), core


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine can compile a regular expression."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?iuU)" + pattern)
    except IllegalArgumentException:  # what the engine's syntax error is
        return False
    return True


def pattern_matches(pattern: str, tokens: str = "tokens") -> Column:
    """Whether a regular expression is found in some token, whatever the case; see ``patterns`` for who looks."""
    test = None if quick(pattern) else bounded(pattern)
    if test is not None:
        return test(tokens)
    return F.exists(F.col(tokens), lambda t: t.rlike("(?iuU)" + pattern))


def tree_matches(tree: Any, method: str, preset: Tokenization = DEFAULT, norm: str = "norm") -> Column:
    if tree is None:
        return F.lit(False)
    return fold_tree(tree, lambda w: term_matches(w, method, preset, norm), lambda a: ~a, lambda a, b: a & b, lambda a, b: a | b)


def matches(spark: SparkSession, text: str, method: str = EXACT, operators: bool = False, preset: Tokenization = DEFAULT) -> Column:
    """Whether a document matches a query; blank queries and invalid patterns match nothing."""
    if method not in (EXACT, WITHIN, REGEX):
        raise ValueError(f"unknown method {method!r}")
    if not text or not text.strip():
        return F.lit(False)
    if method == REGEX:
        return pattern_matches(text) if valid_pattern(spark, text) else F.lit(False)
    return tree_matches(parse(text, operators, preset), method, preset)
