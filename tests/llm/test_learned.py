"""Verdicts of the learned operators against plain versions of their models, and what their training collects."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_helpers import rows_of

from lexgrove.llm import language, near, quality, simhash
from lexgrove.llm.queries import op7_language_id, op9_quality


def prose(r, letters, n):
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))


def plain_trigrams(text, bits=15):
    n = {}
    for i in range(len(text) - 2):
        h = ((text[i] << 16 | text[i + 1] << 8 | text[i + 2]) * 2654435761 % 2**32) >> (32 - bits)
        n[h] = n.get(h, 0) + 1
    return n


def unit(n, weight):
    x = {k: math.log1p(v) * weight(k) for k, v in n.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / norm for k, v in x.items()} if norm else {}


def folded(text):
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode())


def plain_language(model, text):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = unit(plain_trigrams(folded(text)), lambda k: model.idf[k])
    cosines = [sum(v * float(model.centroids[k, c]) for k, v in x.items()) for c in range(len(model.langs))]
    best = max(range(len(cosines)), key=lambda c: cosines[c])
    return model.langs[best], min(1.0, max(0.0, cosines[best]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(3), str(tmp_path_factory.mktemp("learned"))
    docs = []
    for i in range(300):
        lang, letters = r.choice([("aa", "abcdefgh"), ("bb", "ghijklmn"), ("cc", "nopqéßst")])
        docs.append((i, prose(r, letters, r.choice([3, 12, 40])) + r.choice(["", "\n# $\n# $", "."]), lang))
    docs += [(300, None, "aa"), (301, "", "bb"), (302, "12 34 5", "cc"), (7, "again under a key", "aa")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(lang != "cc"), 0) for i, _, lang in docs if i % 3 and i < 300]
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_languages_are_those_of_the_plain_model(spark, tables):
    folder, docs = tables
    model = language.train(spark.read.parquet(f"{folder}/documents.parquet"))
    # what it has learned from: distinct texts with a letter that are not held out
    learned = {(t, g) for k, t, g in docs if t is not None and zlib.crc32(str(k).encode()) % 5}
    seen = np.zeros(1 << 15)
    texts = [t for t, _ in learned if any(c.isalpha() for c in t)]
    for t in texts:
        seen[list(plain_trigrams(folded(t)))] += 1
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + seen)) + 1)
    want = sorted((k, *plain_language(model, t)) for k, t, _ in docs)
    got = sorted((x["doc_id"], x["lang_pred"], x["score"]) for x in rows_of(op7_language_id(spark, folder)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-4)


@pytest.mark.parametrize("key", ["NULL", "7", "id"])
def test_languages_learn_from_a_bounded_number_of_texts(spark, key, monkeypatch):
    taken = []
    monkeypatch.setattr(language, "Model", lambda texts, langs: taken.append((texts, langs)))
    df = spark.range(20_000).selectExpr(f"CAST({key} AS BIGINT) AS doc_id", "concat('text ', IF(id % 2 = 0, 1, id)) AS text", "IF(id % 100 = 0, 'bb', 'aa') AS lang")
    language.train(df, per_language=50)
    texts, langs = taken[0]
    assert langs.count("aa") == 50 and langs.count("bb") == 1 and len(set(zip(texts, langs))) == 51
    language.train(df, per_language=50, languages=1)
    assert set(taken[1][1]) == {"aa"}


def plain_quality(model, text):
    text = text or ""
    words = {}
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        b = zlib.crc32(w.lower().encode()) % 2**15
        words[b] = words.get(b, 0) + 1
    w = model["w"].astype(float)
    z = sum(v * w[k] for k, v in unit(words, lambda k: 1).items()) + sum(v * w[2**15 + k] for k, v in unit(plain_trigrams(text.lower().encode()), lambda k: 1).items()) + model["bias"]
    return 1 / (1 + math.exp(-(model["a"] * z + model["b"])))


def test_quality_is_that_of_the_plain_model(spark, tables):
    folder, docs = tables
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = sorted((k, plain_quality(model, t)) for k, t, _ in docs)
    out = rows_of(op9_quality(spark, folder))
    assert np.allclose([x["probability"] for x in sorted(out, key=lambda x: (x["doc_id"], x["probability"]))], [p for _, p in want], atol=1e-5)
    for x in out:
        failed = x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]
        assert x["base_failed"] == failed and x["kept"] == (not failed and x["probability"] >= 0.2)
    assert {x["kept"] for x in out if not x["base_failed"]} == {True, False}


def test_quality_learns_from_one_text_of_a_key(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda texts, y: taken.append((texts, list(y))))
    df = spark.range(20_000).selectExpr("id % 20 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(100).selectExpr("id % 25 AS doc_id", "id % 2 AS quality")
    for n in (1, 7):
        quality.train(df.repartition(n), labels)
    assert len(taken[0][0]) == 20 and taken[0] == taken[1]


def test_long_texts_are_read_whole():
    r = random.Random(9)
    text = prose(r, "abcdefghij", 400_000)
    words = text.split()
    assert len(text) > 2 * 2**20
    got, own = quality.counts(text)
    n = {}
    for w in zip(*(words[i:] for i in range(5))):
        n[w] = n.get(w, 0) + 1
    assert got[:2] == (len(words), sum(map(len, words))) and got[4] == 0 == sum(v > 1 for v in n.values())
    assert quality.counts(text + " " + " ".join(words[:9]))[0][4] == 18
    assert [own.distinct[i] for i in own.ids[-1000:]] == words[-1000:]
    assert quality.counts("x" * 3 * 2**20)[0][:2] == (1, 3 * 2**20)
    grams = plain_trigrams(folded(text))
    at, n = language.trigrams(text)
    assert dict(zip(at.tolist(), n.tolist())) == grams
    assert len(near.shingles(text)) == len({*zip(*(words[i:] for i in range(5)))})
    assert simhash.fingerprint(text) != simhash.fingerprint(text[: 2**20])
