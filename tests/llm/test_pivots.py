import numpy as np

from hirelake.llm.pivots import near_links, shared_counts
from hirelake.llm.queries import op3_embeddings
from tests.llm.test_simhash import components


def brute(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, True)
    i, j = np.nonzero(near)
    return {(ids[a], ids[b]) for a, b in zip(i, j, strict=True)}


def test_recall_and_precision(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    rows = [v + rng.normal(size=32) * s for v in base for s in (0.0, 0.1, 0.2, 0.25)] + [base[0]] * 30
    rows = [(k, [float(y) for y in np.float32(v)]) for k, v in enumerate(rows)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: r for r in op3_embeddings(spark, str(tmp_path)).collect()}
    pairs = brute(rows)
    want = {i: sum(1 for a, b in pairs if a == i and b != i) for i, _ in rows}
    assert len(found) == len(rows) and all(found[i].n_links <= want[i] for i in want)
    assert sum(r.n_links for r in found.values()) >= 0.9 * sum(want.values())
    least = components(pairs)
    assert all(found[i].component_id >= least[i] and found[i].kept == (found[i].component_id == i) for i in found)
    assert np.mean([found[i].component_id == least[i] for i in found]) > 0.95


def test_recall_of_copies_planted_in_the_given_table(spark, tmp_path):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng, rows, dim = np.random.default_rng(7), list(given), len(given[0][1])
    for k, (i, v) in enumerate(given):
        # Copies at cosines from the threshold up.
        v = np.array(v, np.float64) / np.linalg.norm(v)
        for j, cos in enumerate((0.9501, 0.96, 0.98, 0.999)[: k % 5]):
            side = rng.normal(size=dim)
            side -= side @ v * v
            rows.append((1_000_000 + 10 * i + j, (v * cos + side / np.linalg.norm(side) * np.sqrt(1 - cos * cos)).tolist()))
    spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    pairs = brute(rows)
    found = {r.vec_id: r.n_links for r in op3_embeddings(spark, str(tmp_path)).collect()}
    want = {i: sum(1 for a, b in pairs if a == i and b != i) for i, _ in rows}
    assert all(found[i] <= want[i] for i in want)
    recall = sum(found.values()) / sum(want.values())
    print(f"recall {recall:.4f} of {sum(want.values()) // 2} links")
    assert recall >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.999e200]), (3, [1e-200, 1e-200]), (4, [1.0, 0.2]), (5, [1e-300, 0.2e-300])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_shared_counts():
    rng = np.random.default_rng(1)
    a, b = (np.array([rng.permutation(20)[:8] for _ in range(n)]) for n in (5, 7))
    assert (shared_counts(a, b) == [[len(set(x) & set(y)) for y in b.tolist()] for x in a.tolist()]).all()


def test_hot_lists_are_whole(spark, monkeypatch):
    monkeypatch.setattr("hirelake.llm.pivots.CHUNK", 16)
    rng = np.random.default_rng(4)
    rows = [(k, (np.ones(16) + rng.normal(size=16) * 0.02).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = near_links(df).collect()
    assert all(r.component_id == 0 for r in found) and np.mean([r.n_links for r in found]) > 0.95 * 149


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, nan]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, cid int")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_links(df).collect())
    assert found == [(0, 0, None, False), (1, 2, 1, True), *[(i, 0, i, True) for i in range(2, 8)], (8, 2, 1, False), (8, 2, 1, False), (9, 0, 9, True)]
    assert near_links(df.limit(0)).count() == 0
