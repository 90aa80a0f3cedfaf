import random

import numpy as np
import pyarrow as pa
import pytest

from hirelake.llm.topk import exact_topk, search_block


def brute(rows, k, every):
    """(id, vector) rows by the definition, in Python's integers."""
    fine = [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(np.float64(x) * 256)))) if abs(x) * 256 < 1e300 else (2**63 - 1) * (1 if x > 0 else -1) for x in v]) for i, v in rows if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        query = min(v for i, v in fine if i == q)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(query, v)))), i) for i, v in fine if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_equals_brute_force(spark, block):
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 3) if rng.random() < 0.6 else 0.0 for _ in range(rng.choice([6, 6, 6, 9]))]) for i in range(-40, 120)]
    rows += [(10, [0.5] * 6), (10, [0.5] * 6), (20, []), (21, [0.25] * 6), (None, [1.0] * 6), (30, None), (40, [float("nan")] * 6), (41, [None, 1.0]), (50, [float("inf")])]
    rows += [(200 + i, [0.5, -0.5, 0.5, 0.0, 0.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame([(i, v, "x", 0.0) for i, v in rows], "vec_id long, embedding array<double>, id string, terms double")
    got = sorted(map(tuple, exact_topk(df, every=10, block=block).collect()))
    assert got == brute(rows, 5, 10)


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 0.25]), (2, [2.0**40, 0.5]), (50, [1e300, -1e300]), (3, [1e300, -1e300]), (4, [-1e300, 1e300]), (5, [2.0**55, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_topk(df).collect())) == brute(rows, 5, 50)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk(df).collect()] == [(0, 1, 1, 65536)]
    assert exact_topk(df.limit(0)).count() == 0
    assert exact_topk(df.where("vec_id = 0")).count() == 0


def test_an_empty_block_finds_nothing():
    none = pa.table({"id": pa.array([], pa.int64()), "terms": pa.array([], pa.list_(pa.int64()))})
    assert search_block(none, none, 5).num_rows == 0
