"""Regular expressions that a backtracking engine may never finish.

Java's engine stays inside generated code and takes the patterns that repeat one character or class at
most (``quick``): their steps are at most the square of a token's length. All others, such as ``(a+)+$`` or
``a*a*a*b``, go to a linear engine, in Arrow batches of tokens. What that cannot express (lookaround,
back references, word borders) goes to a backtracking engine with a limit of ``SECONDS`` for each
token; a token at which the limit is reached does not match. Patterns that only Java's engine has stay there.

``required`` is a piece of text that all matches contain, by which words are left out before any engine sees them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = 1.0
#: The classes that stand for Unicode ones, as the linear engine writes them within brackets.
UNICODE = {"w": r"\p{L}\p{M}\p{Nd}\p{Pc}", "d": r"\p{Nd}", "s": r"\s\x{85}\p{Z}"}
PART = re.compile(r"\\[pPx]\{[^}]*\}|\\.|.", re.DOTALL)


def repeats_groups(pattern: str) -> bool:
    """Whether a group is repeated without a small bound on how often."""
    plain = re.sub(r"\\.", "x", pattern, flags=re.DOTALL)
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "x", plain)
    return re.search(r"\)[*+{]", plain) is not None


def quick(pattern: str) -> bool:
    """Whether a pattern has one repetition at most, and that of a single character or class."""
    plain = re.sub(r"\\.", "x", pattern, flags=re.DOTALL)
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "x", plain)
    plain = re.sub(r"\(\?", "(", plain)  # the mark of a special group repeats nothing
    repeated = re.findall(r"(.)(?:[*+?]|\{\d*,?\d*\})[?+]?", plain, re.DOTALL)
    return not repeated or (len(repeated) == 1 and repeated[0] != ")")


#: Characters that no others match, whatever the case: of these a required piece is made.
PLAIN = set("0123456789abcdefghjlmnopqrtuvwxyz")


def required(pattern: str) -> str:
    """The longest piece of lower-case text that each match has for certain; empty if none is known."""
    if "|" in pattern or "\\Q" in pattern or re.search(r"\(\?[a-zA-Z-]", pattern):
        return ""
    parts, best, run, depth, until = PART.findall(pattern), "", "", 0, ""
    for part, after in zip(parts, [*parts[1:], ""]):
        if until:  # within a class or a number of times
            until, run = "" if part == until else until, ""
        elif part in "[{":
            until, run = {"[": "]", "{": "}"}[part], ""
        elif part.lower() in PLAIN and depth == 0:
            if after in ("*", "?", "{"):
                run = ""
            else:
                run += part.lower()
                best = max(best, run, key=len)
        else:
            run, depth = "", depth + (part == "(") - (part == ")")
    return best


def linear(pattern: str) -> str | None:
    """The pattern as the linear engine has it, or None where it has no such pattern."""
    out, inside = [], False
    for part in PART.findall(pattern):
        if part == "[":
            if inside:
                return None  # a class within a class
            inside = True
        elif part == "]" and out[-1] not in ("[", "^"):
            inside = False
        elif part == "&" and inside:
            return None
        elif len(part) == 2 and part[0] == "\\" and part[1].isalnum():
            if part[1] in UNICODE:
                part = UNICODE[part[1]] if inside else f"[{UNICODE[part[1]]}]"
            elif part[1] in "WDS" and not inside:
                part = f"[^{UNICODE[part[1].lower()]}]"
            elif part[1] not in "tnrf":
                return None
        out.append(part)
    made = "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), pattern=made, ignore_case=True)
    except pa.ArrowInvalid:
        return None
    return made


def _limited(pattern: str) -> Callable[[pa.Array], np.ndarray] | None:
    """A test of tokens with a limit of time for each; None where this engine has no such pattern."""
    import regex

    try:
        compiled = regex.compile(pattern, regex.IGNORECASE | regex.UNICODE)
    except regex.error:
        return None

    def one(token: str) -> bool:
        try:
            return compiled.search(token, timeout=SECONDS) is not None
        except TimeoutError:
            return False

    return lambda tokens: np.fromiter((one(t) for t in tokens.to_pylist()), bool, len(tokens))


def bounded(pattern: str) -> Callable[[str], Column] | None:
    """Whether the pattern is found in some token of an array column; None where only Java's engine has it."""
    own = linear(pattern)
    if own is None and _limited(pattern) is None:
        return None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = _limited(pattern) if own is None else lambda t: pc.match_substring_regex(t, pattern=own, ignore_case=True).to_numpy(zero_copy_only=False)
        for rows in batches:
            if isinstance(rows, pa.ChunkedArray):
                rows = rows.combine_chunks()
            each = pc.list_value_length(rows).fill_null(0).to_numpy()
            # a token that many rows share is tested once in a batch
            tokens = pc.dictionary_encode(rows.flatten().cast(pa.string()))
            hits = test(tokens.dictionary)[tokens.indices.to_numpy()] if len(tokens) else np.empty(0, bool)
            upto = np.append(0, np.cumsum(hits))
            ends = np.cumsum(each)
            yield pa.array(upto[ends] > upto[ends - each])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lambda tokens: F.arrow_udf(run, "boolean")(F.col(tokens))
