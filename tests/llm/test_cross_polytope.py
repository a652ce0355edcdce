"""Cross-polytope search: transform, recall against brute force, ties, edges."""

import numpy as np

from crease.llm import cross_polytope as c


def exact(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def run(spark, rows, queries, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(q,) for q in queries], "query_id long")
    got = {}
    for r in c.neighbours(df, asked, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_hadamard_is_orthonormal():
    h = c.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)
    r = c.rotated(np.eye(32), 3)
    assert np.allclose(r @ r.T, np.eye(32))


def test_axes_are_ranked():
    x = np.random.default_rng(0).normal(size=(5, 16))
    axes = c.nearest_axes(x, 0, 6)
    both = np.concatenate([c.rotated(x, 0), -c.rotated(x, 0)], 1)
    assert (axes == np.argsort(-both, 1)[:, :6]).all()


def test_cells_are_probed_in_order_of_distance():
    x = np.random.default_rng(0).normal(size=(5, 8))
    for joined in (1, 2, 3):
        got = c.probed(x, 3, joined, 40)
        assert (got[:, 0] == c.cells(x, 3, joined)).all()
        far = np.zeros((5, 1))
        for f in range(joined):
            r = c.rotated(x, 3 * c.MOST_FOLDS + f)
            both = np.concatenate([r, -r], 1)
            far = (far[:, :, None] + ((both.max(1, keepdims=True) - both) ** 2)[:, None, :]).reshape(5, -1)
        n = min(40, 16 ** joined)
        assert got.shape == (5, n) and np.allclose(np.take_along_axis(far, got, 1), np.sort(far, 1)[:, :n])


def test_rotations_by_one_product_are_the_fast_transform():
    x = np.random.default_rng(1).normal(size=(4, 64))
    assert np.allclose(c.turned(x, 5), c.rotated(x, 5), atol=1e-12)


def clustered(rng, n, dim):
    """Unit vectors around n / 40 centres, and their float rows."""
    centres = rng.normal(size=(n // 40, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_few_pairs_are_compared_where_neighbours_are_near(spark):
    x = clustered(np.random.default_rng(5), 8000, 32).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    _, entries = c._entries(df.select("vec_id", c.F.col("embedding").alias("vector")), 20)
    queries = entries.where("entry % 20 = 0")
    size = c._Size.of(entries)
    assert size.n == 8000 and size.lift is None
    probes = c.fitted_probes(entries, queries, size)
    asked = list(range(0, 8000, 20))
    want, shares = exact(np.arange(8000), x.astype(float), asked), []
    for part in (1 << 17, 500):                                    # one range a table, and several with hot ones
        got = c.answers(entries, queries, size, 21, c.TABLES, probes, part).toPandas()
        found = got.groupby("query").names.agg(lambda n: set(np.frombuffer(b"".join(n), "<i8")))
        recall = np.mean([v in found[q] for q in asked for v, _ in want[q]])
        shares.append(got.compared.sum() / (len(asked) * 8000))
        assert recall >= 0.9, (probes, recall)
    assert shares[0] == shares[1] and shares[0] < 0.1, (probes, shares)


def test_recall_on_the_test_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    queries = [int(i) for i in ids if i % 20 == 0]
    want = exact(ids, x, queries)
    got = c.query(spark, "/root/testdata/sf0.1").collect()
    hits = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert len(got) == 20 * len(queries) and hits >= 0.9 * len(got)


def test_copies_ties_and_parts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 8)).astype(np.float32)
    x[5:17] = x[5]
    x = np.concatenate([x, np.repeat(x[20:21], 40, 0), 3 * x[:5]])
    ids = np.random.default_rng(1).permutation(len(x)) * 2
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    queries = [int(ids[k]) for k in (0, 5, 9, 20, 35, 72)]
    want = exact(ids, x.astype(float), queries, k=6)
    for part in (1 << 17, 7):
        got = run(spark, rows, queries, k=6, tables=8, probes=16, part=part)
        for q in queries:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_a_hot_cell_is_split(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=8) + 1e-3 * rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    x = np.array([v for _, v in rows])
    want = exact(np.arange(300), x, [0, 7, 290], k=5)
    for probes in (4, None):
        got = run(spark, rows, [0, 7, 290], k=5, part=20, probes=probes)
        for q in want:
            assert len({v for v, _ in got[q]} & {v for v, _ in want[q]}) >= 4


def test_few_candidates_all_come_back_and_unusable_vectors_do_not(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [1.0, inf]), (8, [None, 1.0]), (9, []), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    got = run(spark, rows, [1, 4, 5, 10, 11])
    assert got == {1: [(3, 0.0), (2, -1.0)]}
    assert run(spark, [(1, [1.0])], [1]) == {}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert c.neighbours(empty, spark.createDataFrame([(1,)], "query_id long")).count() == 0
