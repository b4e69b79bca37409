"""Sparse rows, tiles, tiled pairs, blocks of features, both-sided SVD and many seeds, against dense numpy and the single forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltry.operators import admm, graph, kernels, krr, krylov, matrix, pairs, regression, sketch, sparse, svd, tiles
from basaltry.sources import text_formats


def coords_of(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double")


def dense(coords, shape):
    out = np.zeros(shape)
    for i, j, v in coords.select("i", "j", "v").collect():
        out[i, j] += v
    return out


def thin(rng, m, n, share=0.3):
    return rng.standard_normal((m, n)) * (rng.random((m, n)) < share)


# -- sparse rows -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def both(spark):
    """The same rows dense and sparse, some of them empty, indices out of order, and a target."""
    rng = np.random.default_rng(0)
    d, t = thin(rng, 120, 12), rng.standard_normal(120)
    d[5] = 0
    rows = matrix.from_numpy(spark, d).join(spark.createDataFrame([(i, float(z)) for i, z in enumerate(t)], "row_id long, t double"), "row_id").cache()
    turned = sparse.from_dense(rows).withColumn("indices", F.reverse("indices")).withColumn("values", F.reverse("values"))
    return d, t, rows, turned


def test_compressed_blocks():
    rng = np.random.default_rng(1)
    d = thin(rng, 30, 9)
    d[[0, 7, 29]] = 0
    starts = np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))])
    x = sparse.CSR(starts, np.nonzero(d)[1], d[d != 0], 9)
    b, y = rng.standard_normal((9, 4)), rng.standard_normal((30, 3))
    assert np.allclose(x @ b, d @ b) and np.allclose(x.T @ y, d.T @ y) and np.allclose(x.T @ x, d.T @ d) and np.allclose(x.dense(), d)
    for entries in (1, 7, 1000):
        assert np.allclose(np.concatenate([p.dense() for _, p in x.parts(entries)]), d)
    used, small = x.columns()
    assert np.allclose(small.dense(), d[:, used])
    none = sparse.CSR(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), 9)
    assert (none @ b).shape == (0, 4) and not (none.T @ np.zeros((0, 2))).any()
    twice = sparse.CSR(np.array([0, 2]), np.array([3, 3]), np.array([1.0, 2.0]), 9)
    assert (twice @ np.eye(9))[0, 3] == 3


def test_sparse_rows_in_sketches_and_maps(both, monkeypatch):
    _, _, rows, turned = both
    bare, thin_rows = rows.select("row_id", "features"), turned.drop("t")
    maps = [sketch.JLT(12, 5, 1), sketch.CT(12, 5, 1), sketch.SJLT(12, 6, 1), sketch.CWT(12, 5, 1), sketch.FJLT(12, 5, 1), sketch.RFUT(12, 12, 1), sketch.GaussianRFT(12, 6, 2), sketch.LaplacianRFT(12, 6, 2), sketch.MaternRFT(12, 6, 2, nu=1.5), sketch.GaussianQRFT(12, 6, 2), sketch.FastGaussianRFT(12, 24, 2), sketch.PPT(12, 8, 1), sketch.UST(12, 4, 1)]
    for t in maps:
        assert np.allclose(matrix.to_numpy(t.apply(bare, "rowwise")), matrix.to_numpy(t.apply(thin_rows, "rowwise"))), t
    for t in (sketch.JLT(120, 5, 1), sketch.CWT(120, 5, 1), sketch.FJLT(120, 5, 1)):
        want = matrix.to_numpy(t.apply(bare, "columnwise"))
        assert np.allclose(want, matrix.to_numpy(t.apply(thin_rows, "columnwise"))) and np.allclose(want, dense(t.columnwise_coords(thin_rows), want.shape))
    x = sparse.CSR(np.array([0, 2, 2, 3]), np.array([11, 0, 4]), np.array([1.0, 2.0, 3.0]), 12)
    for t in maps[:3] + maps[6:9]:
        whole = t.map_block(x)
        monkeypatch.setattr(sketch, "SQUARE", 1)
        monkeypatch.setattr(sketch, "SOME", 12)  # only the columns that have entries are made, two at a time
        assert np.allclose(t.map_block(x), whole)
        monkeypatch.undo()


@pytest.mark.parametrize("method", ["normal_equations", "exact_qr", "exact_svd", "iterative", "blendenpik"])
def test_sparse_least_squares(both, method):
    d, t, _, turned = both
    got = getattr(regression, method)(turned, "t")
    assert np.allclose(got[:, 0], np.linalg.lstsq(d, t, rcond=None)[0], atol=1e-8)


def test_sparse_ridge_gram_and_svd(both):
    d, t, rows, turned = both
    assert np.allclose(matrix.gram(turned), d.T @ d) and np.allclose(matrix.gram(turned, "t"), (d.T @ t)[:, None])
    want = np.linalg.solve(d.T @ d + 2 * np.eye(12), d.T @ t)
    assert np.allclose(regression.ridge(turned, "t", 2.0)[:, 0], want) and np.allclose(regression.ridge(rows, "t", 2.0)[:, 0], want)
    a, b = (krr.approximate_kernel_ridge(x, "t", kernels.Gaussian(12, 1.0), 0.1, 8) for x in (rows, turned))
    assert np.allclose(a.weights[0], b.weights[0])
    assert np.allclose(*[[r.prediction for r in m.predict(x).orderBy("row_id").collect()] for m, x in ((a, rows), (b, turned))])
    s = svd.approximate_svd(turned, 3, svd.SVDParams(num_iterations=12))[1]
    assert np.allclose(s, np.linalg.svd(d)[1][:3], rtol=1e-3)
    assert np.allclose(dense(matrix.to_coords(turned), d.shape), d)


def test_a_million_sparse_columns(spark):
    """Neither a pass nor a map makes such rows dense (1,000 of them would be 8 GB)."""
    n = 10**6
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(n).alias("size"), F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(n)).cast("int")).alias("indices"), F.array_repeat(F.lit(1.0), 50).alias("values"), (F.col("id") % 7).cast("double").alias("t"))
    x = krylov.lsqr(rows, "t", krylov.Params(1e-10, 4)).x
    assert regression.residual(rows, "t", x) < 0.05 * np.sqrt(13.0 * 1000)
    z = matrix.to_numpy(sketch.GaussianRFT(n, 64, 3, sigma=5.0).apply(rows.limit(40), "rowwise"))
    assert z.shape == (40, 64) and np.abs(z).max() <= np.sqrt(2 / 64)


def test_one_column_and_one_row(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1:2.5\n-1 1:3\n")
    rows = text_formats.read_libsvm(spark, str(tmp_path / "a.txt")).orderBy("row_id").collect()
    assert [r.features for r in rows] == [[2.5], [3.0]]
    assert text_formats.read_libsvm(spark, str(tmp_path / "a.txt"), sparse=True).first()["size"] == 1
    (tmp_path / "b.txt").write_text("1\n2\n")
    assert [r.features for r in text_formats.read_libsvm(spark, str(tmp_path / "b.txt")).collect()] == [[], []]
    assert matrix.height(coords_of(spark, np.ones((1, 3)))) == 1 and matrix.height(coords_of(spark, np.zeros((2, 2)))) == 0


@pytest.mark.parametrize("a", [np.ones((6, 1)) * 3, np.eye(4), 2 * np.eye(5)])
def test_perfectly_conditioned(spark, a):
    c = svd.condest(matrix.from_numpy(spark, a))
    assert c.cond == pytest.approx(1) and c.sigma_min == pytest.approx(c.sigma_max)


# -- tiles ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [None, (1, 1, 1), (2, 3, 2), (5, 1, 7)])
@pytest.mark.parametrize("narrow", [4, 256])
def test_tiled_products(spark, monkeypatch, shape, narrow):
    monkeypatch.setattr(tiles, "NARROW", narrow)  # the right side as sparse panels, or as dense ones
    rng = np.random.default_rng(2)
    a, b = thin(rng, 37, 50), thin(rng, 50, 29)
    a[:8, :8], b[:16] = rng.standard_normal((8, 8)), rng.standard_normal((16, 29))  # tiles stored whole
    assert np.allclose(dense(tiles.gemm(coords_of(spark, a), coords_of(spark, b), side=8, shape=shape), (37, 29)), a @ b)


def test_tiled_gemm_adds_and_turns(spark):
    rng = np.random.default_rng(3)
    a, b, c = thin(rng, 21, 30), thin(rng, 30, 17), thin(rng, 21, 17)
    got = tiles.gemm(coords_of(spark, a.T), coords_of(spark, b.T), 2.0, 0.5, coords_of(spark, c), True, True, side=8)
    assert np.allclose(dense(got, c.shape), 2 * a @ b + 0.5 * c)
    again = tiles.gemm(coords_of(spark, a), coords_of(spark, a), trans_b=True, side=8)
    assert np.allclose(dense(again, (21, 21)), a @ a.T)
    x = tiles.from_coords(coords_of(spark, a), 21, 30, 8)
    assert np.allclose(dense(x.T.coords(), (30, 21)), a.T)
    assert np.allclose(dense(tiles.add(x, x, 2.0, -1.0).coords(), a.shape), a)
    rows = tiles.from_rows(matrix.from_numpy(spark, a), 21, 30, 8).rows()
    assert np.allclose(matrix.to_numpy(rows), a)


def test_grid_by_shape():
    assert tiles.grid(1e6, 1e6, 1e6, (1, 1, 1), 8) == (1, 1, 1)
    pi, pj, pk = tiles.grid(8e9, 8e6, 8e6, (1000, 1, 100), 200)
    assert pj == 1 and pi * pk >= 100  # a tall matrix is cut, its small partner copied
    sizes = tiles.grid(1e9, 1e9, 1e9, (98, 98, 98), 200)
    assert 1e9 / (sizes[0] * sizes[2]) + 1e9 / (sizes[1] * sizes[2]) + 1e9 / (sizes[0] * sizes[1]) <= tiles.CELL


def test_both_sided_svd(spark):
    a, at = np.zeros((60, 45)), [0, 0]
    for m, n in ((20, 15), (15, 12), (12, 10), (8, 5)):
        a[at[0] : at[0] + m, at[1] : at[1] + n] = 1
        at = [at[0] + m, at[1] + n]
    u, s, v = svd.sparse_svd(coords_of(spark, a), 60, 45, 2, svd.SVDParams(2, 2, 3), side=8)
    assert np.allclose(s, np.sqrt([300, 180]))
    u, v = dense(matrix.to_coords(u, True), (60, 2)), dense(matrix.to_coords(v, True), (45, 2))
    assert np.allclose(u.T @ u, np.eye(2)) and np.allclose(v.T @ v, np.eye(2)) and np.allclose(a @ v, u * s)
    with pytest.raises(ValueError, match="rank"):
        svd.sparse_svd(coords_of(spark, a), 60, 45, 46)


# -- tiled pairs ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [None, 800])
def test_tiled_pairs(spark, tile):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((70, 5)), rng.standard_normal((50, 5))
    a, b, fn = matrix.from_numpy(spark, x), matrix.from_numpy(spark, y), kernels.Gaussian(5, 1.0).block
    for right, want in ((b, fn(x, y)), (None, fn(x, x))):
        got = {r.i: (r.total, r.largest) for r in pairs.summary(a, right, fn, tile).collect()}
        assert np.allclose([got[i] for i in range(70)], np.stack([want.sum(axis=1), want.max(axis=1)], axis=1))
    k = fn(x, x)
    assert np.allclose(dense(pairs.values(a, None, fn, tile), k.shape), np.tril(k))
    near = pairs.values(a, b, fn, tile, keep=lambda v: v > 0.2).collect()
    assert len(near) == (fn(x, y) > 0.2).sum()
    np.fill_diagonal(k, -1)
    for r in pairs.largest(a, None, fn, 3, True, tile).collect():
        assert r.v == pytest.approx(np.sort(k[r.i])[-r["rank"]])
    beside = a.withColumn("w", F.slice("features", 1, 2))
    assert np.allclose(matrix.to_numpy(pairs.product(beside, None, fn, "w", tile)), fn(x, x) @ x[:, :2])


def test_pairs_without_cross_joins(spark):
    x = matrix.from_numpy(spark, np.random.default_rng(5).standard_normal((40, 3)))
    for df in (kernels.distance_matrix(x, x), kernels.Gaussian(3).gram(x, x), kernels.Gaussian(3).symmetric_gram(x), pairs.summary(x, x, kernels.Linear(3).block)):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_large_right_sides_are_tiled(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((30, 3))
    rows, want = matrix.from_numpy(spark, x), kernels.distance_block("l1", x, x)
    for most in (kernels.BROADCAST, 100):
        monkeypatch.setattr(kernels, "BROADCAST", most)
        got = {r.i: (r.total, r.largest) for r in kernels.row_summary(rows, rows, "l1").collect()}
        assert np.allclose([got[i] for i in range(30)], np.stack([want.sum(axis=1), want.max(axis=1)], axis=1))


@pytest.mark.parametrize("s", [0, 40])
def test_kernel_rows_that_stay_distributed(spark, s):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((60, 4)), rng.standard_normal((60, 2))
    rows = matrix.from_numpy(spark, x).join(matrix.from_numpy(spark, y).withColumnRenamed("features", "t"), "row_id")
    kernel = kernels.Gaussian(4, 1.5)
    model = krr.kernel_ridge_rows(rows, "t", kernel, 0.5, s)
    a = np.linalg.solve(kernel.block(x, x) + 0.5 * np.eye(60), y)
    got = {r.row_id: r.coefficients for r in model.support.collect()}
    assert np.allclose([got[i] for i in range(60)], a, atol=1e-7)
    new = rng.standard_normal((9, 4))
    assert np.allclose(matrix.to_numpy(model.scores(matrix.from_numpy(spark, new))), kernel.block(new, x) @ a, atol=1e-6)


# -- blocks of features --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("blocks", "squares", "kind"), [(1, 1 << 23, "dense"), (3, 1 << 23, "sparse"), (3, 60, "dense")])
def test_feature_blocks_reach_the_ridge_solution(both, monkeypatch, blocks, squares, kind):
    """Also where the inverses stay on executors and are made in several passes, and from written states."""
    d, t, rows, turned = both
    monkeypatch.setattr(admm, "SQUARES", squares)
    monkeypatch.setattr(admm, "EPOCH", 20)
    model, history = admm.train(rows if kind == "dense" else turned, "t", None, 0, admm.ADMMParams(lam=0.5, iterations=50, feature_blocks=blocks))
    want = np.linalg.solve(d.T @ d + 0.5 * np.eye(12), d.T @ t)
    assert np.abs(model.weights[0][:, 0] - want).max() < 1e-3
    best = 0.5 * ((d @ want - t) ** 2).sum() + 0.25 * (want**2).sum()
    assert history[-1] == pytest.approx(best, rel=1e-5)


def test_feature_blocks_of_a_map(both):
    """Hinge loss on random features in three blocks comes within 1 per cent of a long run on one."""
    rows = both[2].withColumn("y", F.signum("t")).drop("t").coalesce(2)
    run = lambda n, blocks: admm.train(rows, "y", kernels.Gaussian(12, 2.0), 30, admm.ADMMParams("hinge", lam=0.05, iterations=n, feature_blocks=blocks), [-1, 1])
    model, history = run(120, 3)
    assert len(model.maps) == 3
    # the same maps as one block: their seeds are those of the blocks, so the objectives are those of one problem
    z = np.concatenate([model.features(j, both[0]) for j in range(3)], axis=1)
    y = np.sign(both[1])
    w = np.concatenate(model.weights)
    value = lambda w: np.maximum(0, 1 - (z @ w)[:, 0] * y).sum() + 0.025 * (w**2).sum()
    low, step = value(w), 0.02
    v = w.copy()
    for k in range(4000):  # a long subgradient run from there
        g = -z.T @ (((z @ v)[:, 0] * y < 1) * y)[:, None] + 0.05 * v
        v = v - step / (1 + k / 50) * g / max(1.0, np.linalg.norm(g))
        low = min(low, value(v))
    assert value(w) <= 1.01 * low + 1e-9


# -- many seeds -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("recursive", [False, True])
def test_many_seeds_are_the_single_ones(spark, monkeypatch, recursive):
    rng, e = np.random.default_rng(0), set()
    for c in range(4):
        for a, b in rng.integers(0, 9, (40, 2)) + 9 * c:
            e |= {(int(a), int(b)), (int(b), int(a))} if a != b else set()
    for a, b in rng.integers(0, 36, (8, 2)):
        e |= {(int(a), int(b)), (int(b), int(a))} if a != b else set()
    edges = spark.createDataFrame(sorted(e), "src long, dst long")
    p = graph.PPRParams(gamma=2.0, epsilon=1e-4, times=2)
    want = {r.seed: (r.cluster, r.conductance) for r in graph.communities(edges, [0, 13, 30], p, recursive).collect()}
    monkeypatch.setattr(graph, "HELD_EDGES", 1)
    monkeypatch.setattr(graph, "FRONTIER", 2)
    got = {r.seed: (r.cluster, r.conductance) for r in graph.communities(edges, [0, 13, 30, 999], p, recursive).collect()}
    assert got.keys() == want.keys()
    for s, (cluster, value) in want.items():
        assert got[s][0] == cluster and got[s][1] == pytest.approx(value)
