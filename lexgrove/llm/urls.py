"""URL filters: rules, and character language models for what no rule decides. Native only.

Two variable-order Markov models over characters are counted, one on the urls that the rules allow
and one on those they block. A character's probability is taken from the longest context of up to
four characters that was seen often enough in either class, smoothed by that of the next shorter
context, and so on. The mean over a url's characters of the difference of log-likelihoods is compared
with a threshold, calibrated on labelled urls that the counts leave out.

Characters are taken as they are. The counts are a table of strings of five characters, which grows with
the labelled urls; scores are sums over a join with it. Equal urls are one row with a weight until their
verdict is known, so a url that many pages share is no hot key of the counts; a string that most urls
have is split by the join.

Cases: a null url, or one without ``://``, has an empty host and path; a null url is scored as an empty one
and never learned from; a url of any length is read whole; a mean at exactly the threshold is allowed;
without labelled urls of both classes everything undecided is allowed; equal rows give equal results; an
empty table gives none; extra columns pass through, and columns that have the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import Tables

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The border of a url, and characters of a string: a context and what follows it.
BORDER, ORDER = "\x01", 5
#: Characters that are thought possible where nothing is known.
SYMBOLS = 256
#: Labelled characters after a context from which the context is used.
SEEN = 4
#: Weight of the shorter context's distribution, in characters.
PRIOR = 4.0
#: Differences of log-likelihoods are whole numbers of this part, so that sums are exact; and the
#: width of the steps, in such parts, in which a threshold is looked for.
PARTS, BIN = 10_000, 200


@dataclass(frozen=True)
class Rule:
    """What to do with urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def apply_rules(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, and ``rule`` and ``verdict`` of the longest rule that fits, or nulls."""
    out = df.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    out = out.drop("host", "path", "rule", "verdict").withColumnsRenamed({"_host": "host", "_path": "path"})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "verdict": verdict})


def grams(url: Column) -> Column:
    """For each character of a url, and its end: the four before and itself.

    The characters are split once and laid side by side, so that the time is in proportion to the url; a substring
    would be looked for from the beginning each time.
    """
    text = F.coalesce(url, F.lit(""))
    chars = F.split(F.concat(F.lit(BORDER * (ORDER - 1)), text, F.lit(BORDER)), "")
    beside = F.arrays_zip(*(F.slice(chars, k + 1, F.length(text) + 1) for k in range(ORDER)))
    return F.transform(beside, lambda z: F.concat(*(z[str(k)] for k in range(ORDER))))


@dataclass(frozen=True)
class Model:
    """Characters counted by class (gram, a, r), or none without both; and the least mean that is allowed, in PARTS."""

    counts: DataFrame | None
    threshold: int


def _values(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, v): the difference of log-likelihoods of each wanted string's last character, in PARTS."""
    both = [F.sum(c).cast("double").alias(c) for c in "ar"]
    total = counts.agg(*both).first()
    out, p = wanted, {}
    for k in range(1, ORDER + 1):
        whole, before = F.substring("gram", ORDER + 1 - k, k), F.substring("gram", ORDER + 1 - k, k - 1)
        of = counts.groupBy(whole.alias(f"w{k}")).agg(*both).withColumnsRenamed({c: f"{c}{k}" for c in "ar"})
        out = out.withColumn(f"w{k}", whole).join(of, f"w{k}", "left").drop(f"w{k}")
        if k > 1:
            after = counts.groupBy(before.alias(f"b{k}")).agg(*both).withColumnsRenamed({c: f"{c}n{k}" for c in "ar"})
            out = out.withColumn(f"b{k}", before).join(after, f"b{k}", "left").drop(f"b{k}")
    out = out.na.fill(0.0)
    for c in "ar":
        p[c] = (F.col(f"{c}1") + 1) / (total[c] + SYMBOLS)
        for k in range(2, ORDER + 1):
            seen = F.col(f"an{k}") + F.col(f"rn{k}") >= SEEN
            p[c] = F.when(seen, (F.col(f"{c}{k}") + PRIOR * p[c]) / (F.col(f"{c}n{k}") + PRIOR)).otherwise(p[c])
    return out.select("gram", F.round(PARTS * (F.log(p["a"]) - F.log(p["r"]))).cast("bigint").alias("v"))


def _scores(distinct: DataFrame, counts: DataFrame, tables: Tables) -> DataFrame:
    """(u, total, n) of urls (u, url): sum of the differences, and characters."""
    places = distinct.select("u", F.explode(grams(F.col("url"))).alias("gram"))
    values = tables.keep(_values(tables.keep(places.select("gram").distinct(), "grams"), counts), "values")
    return tables.keep(places.join(values, "gram").groupBy("u").agg(F.sum("v").alias("total"), F.count("*").alias("n")), "scores")


def _distinct(df: DataFrame, url: str, tables: Tables) -> DataFrame:
    """Urls with a number, the rows that have each, and their verdict, which is the same for all of them."""
    found = df.groupBy(F.col(f"`{url}`").alias("url")).agg(F.count("*").alias("m"), F.min("verdict").alias("given"))
    return tables.keep(found.withColumn("u", F.monotonically_increasing_id()), "urls")


def _left_out(url: Column) -> Column:
    """One url of five, by its digest."""
    return F.conv(F.substring(F.md5(url.cast("binary")), 1, 4), 16, 10).cast("bigint") % 5 == 0


def _train(distinct: DataFrame, tables: Tables) -> tuple[Model, DataFrame | None]:
    """The model, and the scores of all urls by it."""
    own = distinct.where(F.col("given").isin("allow", "block") & F.col("url").isNotNull()).withColumn("out", _left_out(F.col("url")))
    if own.select("given").distinct().count() < 2:
        return Model(None, 0), None
    seen = own.where("NOT out").select("m", "given", F.explode(grams(F.col("url"))).alias("gram"))
    counts = tables.keep(seen.groupBy("gram").agg(*(F.sum(F.when(F.col("given") == v, F.col("m")).otherwise(0)).alias(c) for c, v in (("a", "allow"), ("r", "block")))), "counts")
    if counts.isEmpty():
        return Model(None, 0), None
    scores = _scores(distinct, counts, tables)
    bins = own.where("out").join(scores, "u").withColumn("bin", F.floor(F.col("total") / (F.col("n") * BIN)))
    bins = bins.groupBy("bin").agg(*(F.sum(F.when(F.col("given") == v, F.col("m")).otherwise(0)).alias(c) for c, v in (("a", "allow"), ("r", "block"))))
    below = "coalesce(sum({0}) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / nullif(sum({0}) OVER (), 0)"
    apart = bins.selectExpr("bin", f"{below.format('r')} - {below.format('a')} AS apart")
    best = apart.where("apart IS NOT NULL").orderBy(F.desc("apart"), "bin").select("bin").first()
    return Model(counts, best["bin"] * BIN if best else 0), scores


def train(labelled: DataFrame, url: str = "url", verdict: str = "verdict") -> Model:
    """Models and threshold from urls whose verdict is allow or block; every fifth one calibrates.

    A url's part is decided by its hash. The threshold is the one at which the shares of accepted
    and of rejected urls above it lie farthest apart, to the nearest ``BIN``.
    """
    tables = Tables(labelled.sparkSession, "urls")
    own = labelled.select(F.col(f"`{url}`").alias("url"), F.col(f"`{verdict}`").alias("verdict"))
    return _train(_distinct(own, "url", tables), tables)[0]


def judge(df: DataFrame, rules: list[Rule], url: str = "url", model: Model | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block)."""
    tables = Tables(df.sparkSession, "urls")
    out = apply_rules(df, rules, url)
    distinct = _distinct(out.select(F.col(f"`{url}`").alias("url"), "verdict"), "url", tables)
    if model is None:
        model, scores = _train(distinct, tables)
    else:
        scores = _scores(distinct, model.counts, tables) if model.counts is not None else None
    if scores is None:
        decided = distinct.select(F.col("url").alias("_url"), F.lit(0.0).alias("score"), F.lit(True).alias("_allowed"))
    else:
        decided = distinct.join(scores, "u").select(F.col("url").alias("_url"), (F.col("total") / F.col("n") / PARTS).alias("score"), (F.col("total") >= F.col("n") * model.threshold).alias("_allowed"))
    out = out.drop("score").join(decided, F.col(f"`{url}`").eqNullSafe(F.col("_url"))).drop("_url")
    return out.withColumn("verdict", F.coalesce(F.col("verdict"), F.when(F.col("_allowed"), "allow").otherwise("block"))).drop("_allowed")
