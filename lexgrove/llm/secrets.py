"""Secret scans: fixed patterns, and random strings found by how badly they tokenize.

A vocabulary learned from text needs few tokens for words and many for random characters. A run of
token characters that costs more than one token for each ``ratio`` characters is reported, or the pieces
between its '=', '/', '_' and '-' that do, unless it is a known digest (hex of a usual length, UUID) or an
identifier (part of an address, a number, a run of few distinct characters). The fixed patterns' spans are
always reported.

Cases: a null or empty text has no spans; a text of any length is scanned whole, in one pass over its
spans, runs and address marks (characters are tokenized in slices of SLICE, so a run of any length takes
time in proportion); spans are code points, end exclusive; of spans that start together the kinds are in
the order of KINDS; a run that touches a fixed pattern's span is not reported again; equal rows give equal
results; an empty table gives none; a column that has the name of the result is replaced, others pass
through.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.bpe import PATTERN
from lexgrove.llm.common import arrow_column, vocabulary

# The patterns, with the fewest characters of the whole match or of group 2.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
UUID_INSIDE = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9+]+")
# What ends an address, or its host or login; and what makes one of what comes before.
DELIMITER = re.compile(r"""[\s"'`,;{}\[\]()<>|?#/@]""")
MARK = re.compile(DELIMITER.pattern + r"|www\.")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
#: Characters a token, below which a run counts as random.
RATIO = 2.0
#: Characters of a run, and of one part at least that is random by itself in a piece of a run.
LEAST, PART_LEAST = 20, 8
#: Distinct characters that a random run of 20 and more has at least.
DISTINCT = 8
#: Characters that are tokenized at once.
SLICE = 4096


class _Addresses:
    """Whether what starts at a place belongs to a host or path of an address; asked in the order of places."""

    def __init__(self, text: str):
        self.text, self.marks = text, MARK.finditer(text)
        self.mark = next(self.marks, None)
        self.inside, self.last, self.next = False, -1, -1

    def __call__(self, at: int, end: int) -> bool:
        """``at`` to ``end``: a run without the slashes before it. The part of a login before its '@' does not belong."""
        text = self.text
        while self.mark and self.mark.end() <= at:
            found, place = self.mark[0], self.mark.start()
            if found == "www." or found == "@":
                self.inside = True
            elif found == "/":
                self.inside = self.inside or self._scheme(place)
            else:
                self.inside = False
            if found != "www.":
                self.last = place
            self.mark = next(self.marks, None)
        if not self.inside or not self._scheme(self.last):
            return self.inside
        if self.next < end:
            m = DELIMITER.search(text, end)
            self.next = m.start() if m else len(text)
        return text[self.next : self.next + 1] != "@"

    def _scheme(self, slash: int) -> bool:
        return slash >= 2 and self.text[slash - 2 : slash + 1] == "://"


class Scanner:
    def __init__(self, path: str, ratio: float = RATIO):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.ratio, self.tokens = ratio, tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """Leftmost non-overlapping matches of each kind, without the short ones."""
        found, low = [], text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        # greedy runs of one class: the runs of enough characters are the long ones of all runs
        return found + [(m.start(), m.end(), "hex") for m in HEX_RUN.finditer(text)]

    def is_random(self, run: str) -> bool:
        if len(set(run)) < DISTINCT or run.isdigit() or DIGEST.match(run) or UUID.match(run):
            return False
        return self.is_dense(run)

    def is_dense(self, run: str) -> bool:
        return len(run) < self.ratio * sum(len(self.tokens(run[i : i + SLICE])) for i in range(0, len(run), SLICE))

    def pieces(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """Random pieces of a run: from each part on, as many parts as make LEAST characters, and the dense parts that adjoin."""
        known = [m.span() for m in UUID_INSIDE.finditer(text, start, end)]
        parts = [m.span() for m in PART.finditer(text, start, end)]
        parts = [(s, e, self.is_dense(text[s:e])) for s, e in parts if not DIGEST.match(text, s, e)]

        def is_known(s: int, e: int) -> bool:
            i = bisect_left(known, (e,)) - 1  # the last one that starts before e; they do not overlap
            return i >= 0 and known[i][1] > s

        found: list[tuple[int, int]] = []
        j = 0
        for i, (s, _, _) in enumerate(parts):
            j = max(i, j)
            while j < len(parts) and parts[j][1] - s < LEAST:
                j += 1
            if j == len(parts):
                break
            e = parts[j][1]
            if found and e <= found[-1][1]:
                continue
            if not any(d and b - a >= PART_LEAST and not text[a:b].isdigit() for a, b, d in parts[i : j + 1]) or is_known(s, e) or not self.is_random(text[s:e]):
                continue
            k = j + 1
            while k < len(parts) and parts[k][2] and not is_known(s, parts[k][1]):
                e, k = parts[k][1], k + 1
            if found and s < found[-1][1]:
                found[-1] = (found[-1][0], e)
            else:
                found.append((s, e))
        return found

    def spans(self, text: str | None) -> list[dict]:
        text = text or ""
        found = sorted(self.base(text), key=lambda x: (x[0], KINDS.index(x[2])))
        in_address, more, i, reached = _Addresses(text), [], 0, 0
        for m in RUN.finditer(text):
            start, end = m.span()
            while i < len(found) and found[i][0] < end:
                reached, i = max(reached, found[i][1]), i + 1
            if reached > start:
                continue
            whole = text[start:end]
            if in_address(end - len(whole.lstrip("/")), end):
                continue
            if self.is_random(whole):
                more.append((start, end, "random"))
            elif not UUID.match(whole) and not whole.isalnum():
                more += [(s, e, "random") for s, e in self.pieces(text, start, end)]
        found = sorted(found + more, key=lambda x: (x[0], KINDS.index(x[2])))
        return [{"kind": k, "start": s, "end": e} for s, e, k in found]


def scan(df: DataFrame, text: str = "text", spans: str = "spans", ratio: float = RATIO, path: str | None = None) -> DataFrame:
    """Add ``spans``, an array of (kind, start, end) by start and then kind."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    return df.withColumn(spans, arrow_column(lambda: Scanner(path, ratio).spans, SPANS, "array<struct<kind:string,start:bigint,end:bigint>>", F.col(text)))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end``, comma-joined."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", ratio: float = RATIO, path: str | None = None) -> DataFrame:
    """Replace the secrets in ``text``; overlapping spans become one mark. Nulls stay null."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")

    def make():
        find = Scanner(path, ratio).spans

        def one(x: str | None) -> str | None:
            spans = find(x)
            if not spans:
                return x
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [x[at : s["start"]], mark]
                at = max(at, s["end"])
            return "".join([*out, x[at:]])

        return one

    return df.withColumn(text, arrow_column(make, pa.string(), "string", F.col(text)))
