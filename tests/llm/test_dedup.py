import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from lexgrove.llm import embeddings, lines, simhash, substrings
from lexgrove.llm.common import Tables
from lexgrove.llm.graph import components


def plain_components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(7)
    n = 60
    pairs = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(45)], "none": [(3, 3)]}[shape]
    got = {x["node"]: x["root"] for x in rows_of(components(spark.createDataFrame(pairs * 2, "a bigint, b bigint"), Tables(spark, "t")))}
    want = plain_components(n, pairs)
    assert all(got.get(i, i) == want[i] for i in range(n))


# -- simhash ---------------------------------------------------------------------------------------
def plain_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    r = random.Random(8)
    for t in ["", None, "A", "a B", "a b c", "É É \x85 É  x\n", *(" ".join(r.choices(["the", "Of", "and", "Ä"], k=r.randint(0, 30))) for _ in range(300))]:
        assert simhash.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t)


def test_working_tables_of_few_rows_have_few_files(spark):
    import glob
    import os

    base = spark.conf.get("spark.checkpoint.dir")
    rows = spark.range(0, 400, 1, 16).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "id", F.hex(F.xxhash64("id")), F.lit("of one")).alias("text"))
    before = set(glob.glob(f"{base}/lexgrove-simhash-*"))
    assert {r["doc_id"]: int(r["fingerprint"]) & (2**64 - 1) for r in rows_of(simhash.cluster(rows))} == {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows_of(rows)}
    (folder,) = set(glob.glob(f"{base}/lexgrove-simhash-*")) - before
    for label in ("fingerprints", "halves"):
        (table,) = glob.glob(f"{folder}/*-{label}")
        assert len(os.listdir(table)) == 1  # no checksums, no mark of success, not a file for each task


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("crowd", [False, True])
def test_links_connect_what_is_within_three_bits(spark, crowd):
    r = random.Random(9)
    found = {0, 2**64 - 1}
    for _ in range(4):
        base, weak = r.getrandbits(64), r.sample(range(64), 9)
        for _ in range(150 if crowd else 12):
            x = base
            for b in weak:
                x ^= (r.random() < 0.4) << b
            for b in r.sample(range(64), r.choice([0, 0, 1, 2, 3])):
                x ^= 1 << b
            found.add(x)
    found |= {r.getrandbits(64) for _ in range(200)}
    fp = sorted(found)
    a = np.array(fp, np.uint64)
    pairs = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)]
    want = plain_components(len(fp), pairs)
    tables = Tables(spark, "t")
    nodes = tables.keep(spark.createDataFrame([(signed(x),) for x in fp], "fp bigint"))
    edges = simhash.links(nodes, tables)
    at = {signed(x): i for i, x in enumerate(fp)}
    got = rows_of(edges)
    assert all(bin(fp[at[e["a"]]] ^ fp[at[e["b"]]]).count("1") <= 3 for e in got)
    assert plain_components(len(fp), [(at[e["a"]], at[e["b"]]) for e in got]) == want


def test_cluster_and_deduplicate(spark):
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    rows = [(5, text, 1), (3, text + " more", 1), (3, text + " more", 1), (9, text.upper(), 2), (7, "other words altogether here", 1), (8, None, 1), (2, " \n", 1), (None, "alone", 1), (None, None, 1), (11, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint int")
    out = rows_of(simhash.cluster(df))
    assert len(out) == len(rows)
    for r in out:
        assert (r["fingerprint"] & (2**64 - 1)) in {plain_fingerprint(t) for i, t, _ in rows if i == r["doc_id"]}
    of = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert of == {5: 3, 3: 3, 9: 3, 7: 7, 8: 2, 2: 2, 11: 11}
    kept = rows_of(simhash.deduplicate(df))
    assert collections.Counter(r["doc_id"] for r in kept) == {3: 1, 7: 1, 2: 1, 11: 1, None: 2} and set(kept[0]) == {"doc_id", "text", "fingerprint"}
    assert simhash.cluster(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0


# -- lines -----------------------------------------------------------------------------------------
def plain_lines(texts, least):
    """Delete each line in a run of ``least`` words or more that was seen before, run by run."""
    split = {k: (t or "").split("\n") for k, t in sorted(texts.items())}
    worded = {k: [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(v) if re.search(r"[^\x20\x09-\x0D]", x)] for k, v in split.items()}
    seen, gone = set(), {k: set() for k in texts}
    for k, own in worded.items():
        for i in range(len(own)):
            for j in range(i, len(own)):
                run = tuple(x for _, x, _ in own[i : j + 1])
                if sum(w for _, _, w in own[i : j + 1]) >= least:
                    if run in seen:
                        gone[k] |= {p for p, _, _ in own[i : j + 1]}
                    seen.add(run)
    return {k: (None if texts[k] is None else "\n".join(x for i, x in enumerate(split[k]) if i not in gone[k]), len(gone[k])) for k in texts}


@pytest.mark.parametrize("least", [1, 3, 6, 11])
def test_lines(spark, least):
    r = random.Random(least)
    pool = ["a", "b c", "", " ", "d e f", "g h i j k l m", "a b", "é\t1 2"]
    texts = {i: "\n".join(r.choices(pool, k=r.randint(0, 9))) for i in range(40)} | {100: None, 101: "", 102: "\n", 103: "x y z a b c"}
    texts |= {104: texts[5], 105: "\n".join([texts[5], texts[6]]), 106: "long line " * 2000 + "\n" + "long line " * 2000}
    df = spark.createDataFrame([(k, t, "kept", 1) for k, t in texts.items()], "doc_id bigint, text string, source string, n_removed int").repartition(3)
    got = {x["doc_id"]: (x["text"], x["n_removed"], x["source"]) for x in rows_of(lines.remove_repeated(df, min_words=least))}
    assert got == {k: (*v, "kept") for k, v in plain_lines(texts, least).items()}


def test_lines_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f\nx"), (1, "a b c d e f\nx"), (None, "a b c d e f")], "doc_id bigint, text string")
    got = rows_of(lines.remove_repeated(df))
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in got) == [("1", "x", 1), ("1", "x", 1), ("None", "a b c d e f", 0)]
    assert lines.remove_repeated(df.limit(0)).count() == 0


# -- substrings ------------------------------------------------------------------------------------
def plain_substrings(texts, length):
    seen, out = set(), {}
    for k, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        starts = np.flatnonzero(np.diff(np.append(0, gone.astype(int))) == 1)
        out[k] = (len(raw), int(gone.sum()), len(starts), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("length", [40, 100])
def test_substrings(spark, length, hot, monkeypatch):
    if hot:  # everything that is seen twice is dealt out by its windows
        monkeypatch.setattr(substrings, "LOOK", 1)
        monkeypatch.setattr(substrings, "LEAST_HOT", 1)
        monkeypatch.setattr(substrings, "HOT", 10**9)
    r = random.Random(length)
    passage = ["".join(r.choices("abcdé ", k=r.randint(20, 260))) for _ in range(6)]
    texts = {i: "".join(r.choice([r.choice(passage), "".join(r.choices("xyz ", k=r.randint(0, 90)))]) for _ in range(r.randint(0, 6))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "ab" * 200, 103: "ab" * 200, 104: "a" * 333, 105: passage[0][1:] + passage[0][:-1], 106: texts[3], 107: "日本語" * 60}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id bigint, text string, spans string").repartition(3)
    got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["first"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in rows_of(substrings.remove(df, length=length))}
    assert got == plain_substrings(texts, length)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("bits", [1, 4, 8])
def test_substrings_whose_names_collide(spark, bits, hot, monkeypatch):
    """Names of few bits agree where bytes do not: in a task, in claims on other documents, and in windows of hot samples."""
    if hot:
        monkeypatch.setattr(substrings, "LOOK", 1)
        monkeypatch.setattr(substrings, "LEAST_HOT", 1)
        monkeypatch.setattr(substrings, "HOT", 10**9)
    r = random.Random(bits)
    passage = ["".join(r.choices("abcdé ", k=r.randint(60, 400))) for _ in range(5)]
    texts = {i: "".join(r.choice([r.choice(passage), "".join(r.choices("xyz ", k=r.randint(0, 120)))]) for _ in range(r.randint(1, 6))) for i in range(50)}
    texts |= {50: texts[7] * 2, 51: texts[7], 52: "ab" * 300, 53: "ab" * 300, 54: None}
    keep, labels = Tables.keep, []
    monkeypatch.setattr(Tables, "keep", lambda self, df, label="t", few=False: labels.append(label) or keep(self, df, label, few))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5, "doc_id")
    got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["first"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in rows_of(substrings.remove(df, bits=bits))}
    assert got == plain_substrings(texts, 100)
    assert "windows" in labels if hot else bits == 8 or "every" in labels  # what hashes had wrong was gone through by bytes


def test_claims_on_long_texts_are_compared_in_blocks(spark):
    """Copies of a text of many blocks, one of them within a longer text, and one that differs in a byte."""
    r = random.Random(21)
    t = "".join(r.choices("abcdefgh ", k=30_000))
    texts = {1: t, 2: "x" + t[5_000:], 3: t, 4: t[:20_000] + "#" + t[20_001:], 5: t[100:9_000] + t[:3_000]}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5, "doc_id")
    got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["first"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in rows_of(substrings.remove(df))}
    assert got == plain_substrings(texts, 100)


def test_long_texts_are_sampled_in_slices(monkeypatch):
    import pyarrow as pa

    r = random.Random(22)
    text = "".join(r.choices("ab ", k=5_000)) + "a" * 700 + "".join(r.choices("ab ", k=400))
    for size in (150, 1_000, 10**7):
        monkeypatch.setattr(substrings, "SLICE", size)
        batch = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([0]), pa.array([text])], names=["d", "h", "text"])
        out = [x for b in substrings._sample(np.empty(0, np.uint64), 100)(iter([batch])) for x in b.column(4).to_pylist()]
        starts = sorted(s for at in out for s in range(substrings._unpack(at)[1], substrings._unpack(at)[2] + 1))
        assert starts == list(range(len(text) - 99))  # each window once
        where = {s: substrings._unpack(at)[0] for at in out for s in range(substrings._unpack(at)[1], substrings._unpack(at)[2] + 1)}
        if size == 150:
            least = where
        assert where == least  # and its sample where it lies, however the text is cut


def test_suffix_order():
    r = random.Random(11)
    for _ in range(2000):
        text = [r.randint(1, r.choice([1, 2, 3, 256])) for _ in range(r.randint(0, 50))]
        length = r.choice([1, 2, 4, 10, 100])
        order = substrings.suffix_order(np.array(text, np.int64), length).tolist()
        heads = [text[i : i + length] for i in order]
        assert sorted(order) == list(range(len(text))) and heads == sorted(heads)
    text = np.tile(np.frombuffer(b"the same hundred bytes again and again, so that no name is unique for long", np.uint8), 400)
    order = substrings.suffix_order(text.astype(np.int64) + 1, 100)
    heads = [bytes(text[i : i + 100]) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and heads == sorted(heads)


def test_crowds_of_samples_are_dealt_out_by_windows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "CROWD", 8)
    r = random.Random(12)
    rows = sorted((r.choice([1, 1, 1, 2, 3, 4, 5]), r.randint(0, 3), r.randint(0, 9), 0, r.randint(0, 99) << 24 | r.choice([0, 0, 0, 1])) for _ in range(200))
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in columns], names=["key", "fine", "d", "h", "at"]) for i in range(0, 200, 7)]
    out = [dict(zip(("kind", "key", "d", "h", "at"), x)) for b in substrings._name(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
    wide = {x["key"] for x in out if x["kind"] == substrings.WIDE}
    assert 1 in wide
    for key in range(1, 6):
        own = [x for x in rows if x[0] == key]
        got = [x for x in out if x["key"] == key]
        if key in wide:
            assert len(got) == len(own)
        else:
            sampled = [x for x in own if not x[4] & 255]
            assert sum(x["kind"] == substrings.SAMPLED for x in got) in (0, len({x[1] for x in sampled}))


def test_texts_are_sampled_together():
    import time

    r = random.Random(13)
    texts = ["".join(r.choices("abcd ", k=r.choice([0, 99, 100, 101, 300, 3000]))).encode() for _ in range(200)] + [b"a" * 500, b"ab" * 200]
    raws = [np.frombuffer(t, np.uint8) for t in texts]
    begins = np.cumsum([0, *map(len, raws)])
    want = [np.concatenate(x) for x in zip(*((a + b, first + b, last + b, name, fine) for b, (a, first, last, name, fine) in zip(begins, map(substrings.samples, raws))))]
    got = substrings.samples(np.concatenate(raws), sizes=np.diff(begins))
    assert all(np.array_equal(x, y) for x, y in zip(got, want))
    # each window has its sample, the same wherever the window stands
    starts = np.sort(np.concatenate([np.arange(f, e + 1) for f, e in zip(got[1], got[2])]))
    assert np.array_equal(starts, np.concatenate([b + np.arange(max(0, len(t) - 99)) for b, t in zip(begins, texts)]))
    # 2 MB of short texts: a pass for each text took several times as long as one for many
    raws = [np.frombuffer(r.randbytes(1000), np.uint8) for _ in range(2000)]
    t = time.process_time()
    for raw in raws:
        substrings.samples(raw)
    each, t = time.process_time() - t, time.process_time()
    for i in range(0, len(raws), 100):
        substrings.samples(np.concatenate(raws[i : i + 100]), sizes=np.full(100, 1000))
    assert 1.5 * (time.process_time() - t) < each


def test_substrings_of_repeated_rows(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (1, "q" + t), (None, t), (2, t[:50])], "doc_id bigint, text string")
    got = rows_of(substrings.remove(df))
    assert len(got) == 5 and [len(r["kept"]) for r in got if r["doc_id"] is None] == [len(t)]
    assert all(len(r["kept"]) == 0 for r in got if r["text"] == t and r["doc_id"] == 1) and [bytes(r["kept"]) for r in got if r["text"][0] == "q"] == [b"q"]
    assert substrings.remove(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.spans(df, length=10)


# -- embeddings ------------------------------------------------------------------------------------
def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)  # so that blocks are split
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 32))
    x = [centre[i % 6] + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.3, 2.0]) for i in range(400)]
    x = [v.astype(np.float32) for v in x]
    x += [x[0], x[0] * np.float32(3), -x[0], x[1]]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] + [1.0] * 31, 0), (1003, [float("inf")] + [1.0] * 31, 0), (1004, [None] + [1.0] * 31, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, n_links int").repartition(3)
    got = {r["vec_id"]: r for r in rows_of(embeddings.cluster(df))}
    unit = np.array(x, np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert len(got) == len(rows) + len(odd)
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    true = near.sum(axis=1) - 1
    assert (links <= true).all() and links.sum() >= 0.9 * true.sum()
    want = plain_components(len(x), [(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(near[i])])
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(x))]) > 0.97
    for i in range(1000, 1006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[1007]["component_id"] == 1006 and not got[1007]["kept"] and got[1006]["n_links"] == 1
    assert embeddings.cluster(df.limit(0)).count() == 0


def test_embedding_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in rows_of(embeddings.cluster(df, least=0.4))}
    rows = df.collect()
    unit = np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    true = (unit @ unit.T >= 0.4).sum(axis=1) - 1
    assert true.sum() > 1000 and sum(got.values()) >= 0.9 * true.sum() and all(got[r.vec_id] <= t for r, t in zip(rows, true))


def test_double_vectors(spark):
    near = 0.9 + 1e-12
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [near, (1 - near**2) ** 0.5]), (3, [0.9 - 1e-12, (1 - (0.9 - 1e-12) ** 2) ** 0.5 * -1])], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in rows_of(embeddings.cluster(df, recall=0.999999))}
    assert got == {1: 1, 2: 1, 3: 0}


def test_embedding_recall_of_planted_pairs(spark):
    """Pairs at the least cosine are the hardest ones; no two others are near."""
    rng = np.random.default_rng(17)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.92, 4000)[:, None]
    vectors = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]) * rng.uniform(0.1, 9, (8000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r for r in rows_of(embeddings.cluster(df))}
    assert len(got) == 8000 and all(r["n_links"] <= 1 for r in got.values())
    found = sum(got[i + 4000]["component_id"] == i for i in range(4000))
    assert found >= 0.94 * 4000, found


def test_vectors_of_any_size(spark):
    tiny = 5e-324
    rows = [[1e200, 1e200], [2e200, 2e200], [1.0, 1.0], [tiny, tiny], [1e-200, 0.0], [3e-200, 0.0], [1.7e308, 1.0], [-1e-200, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows_of(embeddings.cluster(df))}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7)}


def test_design_follows_the_numbers():
    a, b = embeddings.Design.of(10**4, 64), embeddings.Design.of(10**7, 64)
    assert a.keys < b.keys and a.tables < b.tables and 0 < a.needed <= a.tables


# -- the pipeline ----------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline
    from test_near import plain_kept

    from lexgrove.llm.language import train

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs)
    kept = [r.asDict() for r in docs.collect()]
    tables = Tables(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = tables.keep(stage(spark, docs, ""), name)
        assert df.columns == docs.columns
        got = {r["doc_id"]: r for r in rows_of(df)}
        if name == "language_id":
            want = {r["doc_id"] for r in kept if not model.predict(r["text"])["rejected"]}
        elif name == "line_dedup":
            want = {r["doc_id"] for r in kept}
            plain = plain_lines({r["doc_id"]: r["text"] for r in kept if len((r["text"] or "").split("\n")) < 400}, lines.MIN_WORDS)
            assert all(got[k]["text"] == v[0] for k, v in plain.items())
        elif name == "near_dedup":
            want = plain_kept({r["doc_id"]: r["text"] for r in kept})
        else:
            want = {r["doc_id"] for r in kept}
            assert not any(re.search(r"token = \"[0-9a-f]{24}", r["text"]) for r in got.values())
        assert set(got) == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
        docs, kept = df, list(got.values())
    pieces = rows_of(corpus_pipeline.STAGES[-1][1](spark, docs, ""))
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in kept}


def test_stages_with_odd_tables(spark):
    import corpus_pipeline

    text = "the thing that was over there and the other thing with them all"
    rows = [(i, f"{text} {i} {chr(97 + i % 26) * 3}", "en", "s", 1, 0.5) for i in range(1, 30)]
    rows += [(None, None, None, None, None, None), (None, text, None, None, None, None), (5, None, None, "x", 0, 1.0), (3, rows[2][1], "en", "s", 1, 0.5), (3, "another the text of that id", "en", "s", 1, 0.5), (40, "", "en", "s", 0, 0.5), (41, "long the text " * 20_000, "en", "s", 0, 0.5)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").withColumns({c: F.lit("own") for c in ("rejected", "n_removed", "lang_pred", "spans", "component_id", "fingerprint", "_runs", "k", "h", "ids", "task")})
    tables = Tables(spark, "odd")
    for docs in (odd, odd.limit(0)):
        docs = tables.keep(docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = tables.keep(stage(spark, docs, ""), name)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.where("rejected <> 'own' OR n_removed <> 'own' OR _runs <> 'own' OR n_chars <> length(text)").count() == 0
            docs = out
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0) == (docs.count() > 0)


def test_registered_queries_agree_with_brute_force(spark):
    from lexgrove.llm.queries import op1_simhash, op5_substring_dedup

    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    fp = {k: plain_fingerprint(t) for k, t in texts.items()}
    for r in op1_simhash(spark, small).collect():
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id <= r.doc_id
    want = plain_substrings(texts, 100)
    for r in op5_substring_dedup(spark, small).collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
