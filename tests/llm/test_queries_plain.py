"""Registered queries on small tables against plain versions made here."""

import base64
import hashlib
import random
import re

import numpy as np
import tiktoken
import xxhash
from llm_helpers import rows_of
from public_tokenizers import PATTERN, path

from lexgrove.llm.queries import op1_simhash, op10_byte_bpe


def plain_fingerprint(text):
    small = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", small)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_is_that_of_all_pairs(spark, tmp_path):
    r = random.Random(8)
    pool, texts = [f"w{i}" for i in range(400)] + ["É", "Ab"], [None, "", " \n", "one", "One two", "one TWO"]
    for _ in range(25):
        base = r.choices(pool, k=r.choice([4, 60, 300]))
        for changed in (0, 0, 1, 1, 2, 3, 5):
            own = list(base)
            for i in r.sample(range(len(own)), min(changed, len(own))):
                own[i] = r.choice(pool)
            texts.append(" ".join(own))
    keys = r.sample(range(10**6), len(texts))
    spark.createDataFrame(list(zip(keys, texts)), "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_fingerprint(t) for t in texts]
    component = list(keys)
    while True:
        was = list(component)
        for i, a in enumerate(prints):
            component[i] = min(component[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3)
        if component == was:
            break
    want = {k: (f"{p:016x}", c) for k, p, c in zip(keys, prints, component)}
    assert len(set(component)) < len(set(prints)) < len(texts)
    assert {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in rows_of(op1_simhash(spark, str(tmp_path)))} == want


def test_byte_bpe_is_the_librarys(spark, tmp_path):
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    library = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    parts = ["the ", "Words", " of", "\n\n", "  ", "'ll", "é", "日本", "🙂", "12345", "<|endoftext|>", "\x00", "aaaaaaaa", "_-_", "́"]
    texts = [None, "", "x" * 5000, *("".join(r.choices(parts, k=r.randint(1, 60))) for _ in range(200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in rows_of(op10_byte_bpe(spark, str(tmp_path))):
        text = texts[x["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
