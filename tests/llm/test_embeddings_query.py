"""The registered query of embedding near-duplicates on a table with planted pairs, against brute force."""

import random

import numpy as np
from llm_helpers import rows_of

from lexgrove.llm.queries import op3_embedding_dedup


def planted(r, n, dim):
    """Vectors apart, and for some of them others at cosines on both sides of 0.9."""
    g = np.random.default_rng(r.randrange(10**6))
    own = g.standard_normal((n, dim))
    own /= np.linalg.norm(own, axis=1)[:, None]
    out = list(own)
    for i in range(0, n, 4):
        c = r.choice([0.85, 0.89, 0.91, 0.93, 0.97])
        other = g.standard_normal(dim)
        other -= (other @ own[i]) * own[i]
        out.append(c * own[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other))
    return [np.float32(v).tolist() for v in out]


def test_planted_pairs(spark, tmp_path):
    r = random.Random(6)
    vectors = planted(r, 600, 64)
    rows = [(i, v, i % 10) for i, v in enumerate(vectors)] + [(10_000 + i, vectors[3], None) for i in range(200)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, [float("nan")] * 64, 1), (20_003, [*vectors[0][:-1], None], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["vec_id"]: x for x in rows_of(op3_embedding_dedup(spark, str(tmp_path)))}
    assert len(got) == len(rows)
    ids = [k for k, v, _ in rows if k < 20_000]
    x = np.array([v for k, v, _ in rows if k < 20_000], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    found, true = [got[k]["n_links"] for k in ids], linked.sum(axis=1)
    assert all(f <= t for f, t in zip(found, true)) and sum(found) >= 0.94 * true.sum()  # none is invented, and few are missed
    single = [i for i, k in enumerate(ids) if k < 10_000 and k != 3]
    assert sum(found[i] for i in single) >= 0.94 * true[single].sum() > 100
    assert got[10_000]["n_links"] == 200 and got[10_000]["component_id"] == got[3]["component_id"] == 3 and not got[10_000]["kept"]
    for i, k in enumerate(ids):
        if found[i]:
            near = {ids[j] for j in np.flatnonzero(linked[i])}
            assert got[k]["component_id"] <= k and (got[k]["component_id"] == k or near)
        else:
            assert got[k]["component_id"] == k and got[k]["kept"]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(20_000, 20_004))
