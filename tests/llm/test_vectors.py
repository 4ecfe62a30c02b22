"""Vector codes and hard negatives against plain versions in whole Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from llm_helpers import rows_of
from pyspark.sql import functions as F

from lexgrove.llm import codes, negatives
from lexgrove.llm.queries import op11_vector_codes, op13_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(r, n, dim, spread=1.0):
    return [[float(np.float32(r.gauss(0, spread))) for _ in range(dim)] for _ in range(n)]


def table(n=260, dim=32, seed=1):
    """A third of the rows are copies of one vector; with rows that take no part."""
    r = random.Random(seed)
    found = vectors(r, n, dim)
    hot = found[0]
    rows = [(i, hot if i % 3 == 0 else v, None if i % 17 == 0 else r.randrange(10)) for i, v in enumerate(found)]
    bad = [None, [None] * dim, [*hot[:-1], NAN], [*hot[:-1], INF], [None, *hot[1:]]]
    return rows + [(1000 + 50 * i, v, 1) for i, v in enumerate(bad)] + [(150, found[7], 3), (7, found[8], 3)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, width, bound):
    x = [max(-bound, min(bound, math.floor(256 * c))) for c in v]
    return x + [0] * (16 * width - len(x))


def plain_codes(rows):
    kept = sorted((r for r in rows if usable(r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in kept), default=0) // 16)
    bound = codes.limit(width)
    x = [whole(r[1], width, bound) for r in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    books = [[part(v, p) for v in x[:64]] for p in range(16)]
    near = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        sums = [[[] for _ in b] for b in books]
        for v in x:
            for p in range(16):
                sums[p][near(v, p)[1]].append(part(v, p))
        books = [[[sum(c) // len(c) for c in zip(*s)] if s else e for s, e in zip(sums[p], books[p])] for p in range(16)]
    found = [[near(v, p) for p in range(16)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0] if r[0] is not None else -1, "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, errors))


def coded(rows):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows)


@pytest.mark.parametrize("rows", [table(), table(40, 16, 2), table(90, 21, 3), table(90, 70, 4)[:-2] + [(None, [1.0, 2.0], 4), (5, [], 2)], [(1, [1.5] * 3, None)], [(1, [], 1), (2, [], 1)]], ids=["usual", "few", "odd_length", "ragged", "one", "no_components"])
def test_codes_are_those_of_the_plain_version(spark, rows):
    got = rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert coded(got) == plain_codes(rows)


def test_codes_of_extreme_components(spark):
    big = 3.0e38
    rows = [(i, [s * big] * 32, 1) for i, s in enumerate((1, -1, 1, 0))] + [(9, [1e6] * 32, 1)]
    got = rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == 5 and all(r["error"] == 0 for r in got)
    far = codes.limit(2)
    x = np.array([[[far, far], [-far, far]]])
    index, error = codes.nearest(x[0], np.array([[-far, -far]]))
    assert list(error) == [8 * far * far, 4 * far * far] and 16 * 8 * far * far < 2**63


def test_ties_go_to_the_lower_entry():
    entries = np.array([[5, 0], [0, 3], [0, 3], [3, 0], [0, -3]])
    index, far = codes.nearest(np.array([[0, 0], [9, 0], [3, 3]]), entries)
    assert index.tolist() == [1, 0, 1] and far.tolist() == [9, 16, 9]


def test_codes_of_an_empty_table_and_of_clashing_columns(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    df = spark.createDataFrame(table(70), SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "vec_id AS _row", "label AS _label", "2 AS _of", "'a.b' AS `c.d`")
    got = codes.compress(df)
    assert set(got.columns) == {"vec_id", "label", "code", "error", "label_error", "codebooks_sha256", "_row", "_label", "_of", "c.d"}
    assert coded(rows_of(got)) == plain_codes(table(70)) and all(r["_row"] == r["vec_id"] and r["c.d"] == "a.b" for r in rows_of(got))


def test_many_labels_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW", 2)
    rows = table(100)
    assert coded(rows_of(codes.compress(spark.createDataFrame(rows, SCHEMA)))) == plain_codes(rows)


def plain_negatives(rows, is_anchor, positives=5, most=3):
    kept = [(n, *r) for n, r in enumerate(rows) if r[0] is not None and r[2] is not None and usable(r[1])]
    width = -(-max((len(r[2]) for r in kept), default=0) // 16)
    bound = negatives.limit(width)
    kept = [(n, k, whole(v, width, bound), g) for n, k, v, g in kept]
    out = []
    for n, k, v, g in kept:
        if not is_anchor(k):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), other, m, h) for m, other, w, h in kept if m != n]
        for s, other, _, _ in sorted(x for x in scores if x[3] == g)[:positives]:
            fit = sorted((t, o, m) for t, o, m, h in scores if h != g and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(k, other, i, o, -s, -t) for i, (t, o, _) in enumerate(fit[:most], 1)]
    return sorted(out)


def mined(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows_of(df))


@pytest.mark.parametrize("rows", [table(400, 32, 5), table(200, 21, 6) + [(50, [1.0, 2.0], 4), (300, [], 4), (None, [1.0] * 21, 4)], [(0, [1.0], 1), (50, [1.0], 1)]], ids=["usual", "ragged", "no_negatives"])
def test_negatives_are_those_of_the_plain_version(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "CELLS", 64 * 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_negatives(rows, lambda k: k % 10 == 0)
    assert mined(negatives.mine(df.coalesce(1), df.vec_id % 10 == 0)) == want and (want or len(rows) == 2)


def test_negatives_in_several_blocks_and_slices(spark, monkeypatch):
    for name, size in (("ANCHORS", 16), ("SLICE", 50), ("ROWS", 32), ("CELLS", 32 * 4)):
        monkeypatch.setattr(negatives, name, size)
    rows = table(400, 32, 8)
    assert mined(negatives.mine(spark.createDataFrame(rows, SCHEMA).coalesce(1), F.expr("vec_id % 5 = 0"))) == plain_negatives(rows, lambda k: k % 5 == 0)


def test_bounds_hold_for_every_pair():
    r = np.random.default_rng(3)
    x = r.integers(-300, 300, (500, 16, 4))
    books = r.integers(-300, 300, (16, 64, 4))
    index, far = codes.assign(x, books)
    rows = negatives._Rows.__new__(negatives._Rows)
    rows.key = rows.label = rows.row = np.arange(500)
    rows.v, rows.code = x.reshape(500, -1).astype(np.int32), index.astype(np.uint8)
    rows.left = np.nextafter(np.sqrt(far.astype(float)).astype(np.float32), np.float32(np.inf))
    low, high = negatives._Anchors(rows, slice(0, 40), books).bounds(rows, slice(0, 500))
    exact = rows.v.astype(np.int64) @ rows.v[:40].astype(np.int64).T
    assert (low <= exact).all() and (exact <= high).all()


def test_negatives_of_empty_tables_and_extreme_components(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0], 1)]):
        assert rows_of(negatives.mine(spark.createDataFrame(rows, SCHEMA), F.lit(True))) == []
    big = 3.0e38
    rows = [(50 * i, [big * s] * 40, i % 2) for i, s in enumerate((1, 1, -1, 1, 0.0, 1e-35, 1))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(negatives.mine(df, df.vec_id % 50 == 0)) == plain_negatives(rows, lambda k: k % 50 == 0)


def test_registered_vector_queries(spark, tmp_path):
    rows = table(300, 32, 9)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert coded(rows_of(op11_vector_codes(spark, str(tmp_path)))) == plain_codes(rows)
    moved = [(k, v, (g + 1) % 10 if k % 7 == 0 and g is not None else g) for k, v, g in rows]
    assert mined(op13_hard_negatives(spark, str(tmp_path))) == plain_negatives(moved, lambda k: k % 50 == 0)
