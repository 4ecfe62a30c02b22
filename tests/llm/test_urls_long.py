"""Urls of any length and of any characters, and what each is cut into."""

import time

from llm_helpers import rows_of
from pyspark.sql import functions as F

from lexgrove.llm import urls


def plain_grams(url):
    padded = "\x01" * 4 + (url or "") + "\x01"
    return [padded[i : i + 5] for i in range(len(url or "") + 1)]


def test_strings_are_those_of_the_plain_version(spark):
    texts = ["http://a.org/x", "", None, "a", "é𝒳\U0001f600b\x00\x01", "ab" * 200, "://[]{}()\\^$.|?*+"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, url string")
    got = {r["i"]: r["g"] for r in rows_of(df.select("i", urls.grams(F.col("url")).alias("g")))}
    assert got == {i: plain_grams(t) for i, t in enumerate(texts)}


def test_time_is_in_proportion_to_a_url(spark):
    def took(n):
        df = spark.range(1).select(F.concat(F.lit("http://a.org/"), F.expr(f"repeat('abcdefghij', {n // 10})")).alias("url"))
        began = time.perf_counter()
        assert df.select(F.size(urls.grams(F.col("url"))).alias("n"), F.explode(urls.grams(F.col("url"))).alias("g")).agg(F.count("*")).first()[0] == n // 10 * 10 + 14
        return time.perf_counter() - began

    took(1000)
    short, long = took(50_000), took(1_000_000)
    assert long < 20 * max(short, 0.5)  # 400 times where each string is looked for from the beginning


def test_a_long_url_is_judged(spark):
    rows = [(i, f"http://www.ok.org/en/page{i}") for i in range(40)] + [(100 + i, f"http://www.no.net/de/x{i}") for i in range(40)] + [(200, "http://any.xyz/" + "page" * 100_000), (201, None)]
    rules = [urls.Rule("allow", "org"), urls.Rule("block", "net")]
    out = {r["page_id"]: r for r in rows_of(urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules))}
    assert len(out) == 82 and out[200]["verdict"] in ("allow", "block") and len(out[200]["path"]) == 400_001 and out[201]["host"] == ""
