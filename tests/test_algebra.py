"""Matrix operations, solvers, decompositions, kernels, models and losses against numpy."""

import numpy as np
import pytest

from basaltry.operators import admm, coding, kernels, krr, krylov, losses, models, regression, svd
from basaltry.operators import matrix as M


@pytest.fixture(scope="module")
def tall(spark):
    rng = np.random.default_rng(0)
    a, x = rng.standard_normal((200, 8)), rng.standard_normal((8, 2))
    b = a @ x + 0.01 * rng.standard_normal((200, 2))
    rows = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(200)], "row_id long, features array<double>, t array<double>").repartition(3).cache()
    return a, b, rows


def coords(spark, a):
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if a[i, j]], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for i, j, v in df.select("i", "j", "v").collect():
        out[i, j] += v
    return out


def test_products(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (9, 6)) * (rng.random((9, 6)) < 0.4), rng.integers(-3, 4, (6, 5)) * 1.0
    ca, cb = coords(spark, a), coords(spark, b)
    assert np.array_equal(dense(M.gemm(ca, cb), (9, 5)), a @ b)
    c = np.ones((9, 5))
    assert np.allclose(dense(M.gemm(ca, cb, -1.0, 1.5, coords(spark, c)), (9, 5)), -a @ b + 1.5 * c)
    assert np.array_equal(dense(M.gemm(ca, ca, trans_a=True), (6, 6)), a.T @ a)
    s = np.tril(rng.integers(1, 5, (6, 6))) * 1.0
    assert np.array_equal(dense(M.symm(coords(spark, s), cb), (6, 5)), (s + np.tril(s, -1).T) @ b)
    x = spark.createDataFrame([(j, float(j + 1)) for j in range(6)], "i long, v double")
    y = np.zeros(9)
    for i, v in M.gemv(ca, x).collect():
        y[i] = v
    assert np.array_equal(y, a @ np.arange(1, 7))
    assert M.same_matrix(M.transpose(M.transpose(ca)), ca) and not M.same_matrix(ca, cb)


def test_reductions_and_views(tall):
    a, b, rows = tall
    assert np.allclose(M.gram(rows.select("features")), a.T @ a) and np.allclose(M.gram(rows, "t"), a.T @ b)
    assert np.allclose(M.to_numpy(M.times(rows.select("row_id", "features"), np.eye(8)[:, :3])), a[:, :3])
    assert np.allclose(M.to_numpy(M.column_view(M.row_view(rows, 5, 4), 2, 3)), a[5:9, 2:5])
    q, r = M.tsqr(rows.select("row_id", "features"))
    q = M.to_numpy(q)
    assert np.allclose(q.T @ q, np.eye(8)) and np.allclose(q @ r, a) and (np.diag(r) > 0).all()
    assert np.allclose(M.trsm(r, r @ np.ones(8)), 1)


@pytest.mark.parametrize("method", [m for m in regression.SOLVERS if m != "sketch"])
def test_least_squares(tall, method):
    a, b, rows = tall
    got = regression.solve(regression.Problem(rows, "t"), method)
    assert np.allclose(got, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-8)


def test_approximate_least_squares(tall):
    a, b, rows = tall
    exact = np.linalg.norm(a @ np.linalg.lstsq(a, b, rcond=None)[0] - b)
    assert np.linalg.norm(a @ regression.approximate_least_squares(rows, "t") - b) < 3 * exact
    with pytest.raises(NotImplementedError):
        regression.Problem(rows, "t", penalty="l1")


def test_krylov(tall):
    a, b, rows = tall
    g, rhs = a.T @ a, a.T @ b
    x = np.linalg.solve(g, rhs)
    p = krylov.Params(1e-12)
    assert np.allclose(krylov.cg(krylov.NormalOperator(rows), rhs, p).x, x)
    assert np.allclose(krylov.flexible_cg(lambda v: g @ v, rhs, p).x, x)
    assert np.allclose(krylov.async_fcg(g, rhs, p).x, x)
    s = np.linalg.svd(a)[1]
    assert np.allclose(krylov.chebyshev_ls(rows, "t", s[-1], s[0], 1e-12).x, x)
    gs = krylov.block_gauss_seidel(g, rhs, 200, tolerance=1e-8)
    assert gs.code == -1 and np.allclose(gs.x, x, atol=1e-5)
    with pytest.raises(ValueError):
        krylov.block_gauss_seidel(np.triu(g), rhs)


def test_svd(tall, spark):
    a, _, rows = tall
    u, s, v = svd.approximate_svd(rows.select("row_id", "features"), 8, svd.SVDParams(num_iterations=1))
    assert np.allclose(s, np.linalg.svd(a)[1]) and np.allclose(M.to_numpy(u) * s @ v.T, a)
    with pytest.raises(ValueError):
        svd.approximate_svd(rows, 9)
    g = np.diag([9.0, -7.0, 4.0, 1.0, 0.5, -0.1]) + 0.01
    v, e = svd.approximate_symmetric_svd(coords(spark, np.tril(g)), 6, 3, svd.SVDParams(num_iterations=30))
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(g))[::-1][:3], atol=1e-6) or e[0] == pytest.approx(np.linalg.eigvalsh(g).max())
    c = svd.condest(rows)
    assert 0.8 < c.cond / np.linalg.cond(a) <= 1.01
    x = svd.chebyshev_points(14, 0, 5)
    assert np.allclose(svd.chebyshev_diff(14, 0, 5) @ np.sin(x), np.cos(x), atol=1e-6)


def test_distances_and_kernels(spark):
    x, y = M.from_numpy(spark, np.array([[1.0, 2], [3, 4]])), M.from_numpy(spark, np.array([[5.0, 6], [7, 8]]))
    assert np.array_equal(dense(kernels.distance_matrix(x, y), (2, 2)), [[32, 72], [8, 32]])
    a, b = np.random.default_rng(0).random((5, 3)), np.random.default_rng(1).random((4, 3))
    xa, xb = M.from_numpy(spark, a), M.from_numpy(spark, b)
    for kind in kernels.DISTANCES:
        assert np.allclose(dense(kernels.distance_matrix(xa, xb, kind), (5, 4)), kernels.distance_block(kind, a, b))
    for k in (kernels.Linear(3), kernels.Gaussian(3, 2.0), kernels.Polynomial(3, 3, 1.0, 0.5), kernels.Laplacian(3, 2.0), kernels.ExpSemigroup(3, 0.5), kernels.Matern(3, 2.5, 1.0)):
        assert np.allclose(dense(k.gram(xa, xb), (5, 4)), k.block(a, b))
        assert kernels.from_json(k.to_json()) == k
    with pytest.raises(ValueError):
        kernels.ExpSemigroup(3).symmetric_gram(xa)


@pytest.mark.parametrize("name", list(losses.LOSSES))
@pytest.mark.parametrize("k", [1, 3])
def test_prox_minimises(name, k):
    rng = np.random.default_rng(2)
    loss, x, lam = losses.LOSSES[name](), rng.standard_normal((6, k)) * 2, 0.7
    y = rng.integers(0, 3, 6) if k > 1 else rng.choice([-1.0, 1.0], 6)
    o = loss.prox(x, lam, y)
    value = lambda v: lam * loss.evaluate(v, y) + 0.5 * ((v - x) ** 2).sum()
    for _ in range(50):
        assert value(o) <= value(o + rng.standard_normal(o.shape) * 0.05) + 1e-9


def test_regularizers():
    w, mu = np.array([[2.0], [-0.5]]), np.array([[0.5], [0.1]])
    assert np.allclose(losses.L1().prox(w, 1.0, mu), [[0.5], [0.0]]) and losses.L1().evaluate(w) == 2.5
    assert np.allclose(losses.L2().prox(w, 1.0, mu), [[0.75], [-0.3]]) and losses.L2().evaluate(w) == 2.125
    assert np.array_equal(losses.Regularizer().prox(w, 1.0, mu), w - mu)


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(0)
    c = rng.standard_normal((3, 6)) * 2
    y = rng.integers(0, 3, 150)
    x = c[y] + rng.standard_normal((150, 6)) * 0.7
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(150)], "row_id long, features array<double>, label int").repartition(2).cache()


def hits(model, rows):
    return coding.accuracy(model.predict(rows), "prediction", "label").first()[1]


@pytest.mark.parametrize(("method", "kw"), [("exact", {}), ("approximate", {"s": 80}), ("approximate", {"s": 40, "params": krr.KRRParams(sketch_rows=True)}), ("sketched", {"s": 30}), ("faster", {"s": 80}), ("large", {"s": 36, "params": krr.KRRParams(1e-1, 3)})])
def test_classification(classes, method, kw):
    model = krr.rlsc(classes, "label", kernels.Gaussian(6, 3.0), 0.1, method, **kw)
    assert hits(model, classes) > 90
    assert hits(models.from_json(models.HEADER + model.to_json()), classes) == hits(model, classes)


def test_nystrom_and_pcr(classes):
    assert hits(krr.nystrom_rls(classes, "label", 3.0, s=40, probabilities="leverage"), classes) > 90
    assert hits(krr.sketch_pcr(classes, "label", 30, 3.0, 80), classes) > 90


def test_admm(classes, tmp_path):
    model, history = admm.train(classes, "label", kernels.Gaussian(6, 3.0), 60, admm.ADMMParams("hinge", iterations=6, feature_blocks=2), [0, 1, 2], classes)
    assert history[-1][0] < 0.5 * history[0][0] and history[-1][1] > 90 and hits(model, classes) > 90
    models.save(model, str(tmp_path / "m.json"))
    assert hits(models.load(str(tmp_path / "m.json")), classes) == hits(model, classes)


@pytest.mark.parametrize(("loss", "iterations"), [("squared", 12), ("lad", 30), ("hinge", 35), ("logistic", 40)])
def test_admm_nears_the_smallest_objective(classes, loss, iterations):
    """No step from the end lowers the objective by much; the penalty makes it steep."""
    rows = classes.selectExpr("row_id", "features", "case when label = 1 then 1.0 else -1.0 end as y").coalesce(1)
    model, history = admm.train(rows, "y", None, 0, admm.ADMMParams(loss, "l2", 5.0, 1.0, iterations), [-1, 1])
    got = rows.orderBy("row_id").collect()
    x, y, w = np.array([r.features for r in got]), np.array([r.y for r in got]), model.weights[0]
    value = lambda v: losses.LOSSES[loss]().evaluate(x @ v, y) + 5.0 * losses.L2().evaluate(v)
    assert history[-1] == pytest.approx(value(w), rel=0.03) and history[-1] < history[0]
    rng = np.random.default_rng(0)
    assert all(value(w) <= 1.06 * value(w + s * rng.standard_normal(w.shape)) for s in (0.02, 0.1, 0.5) for _ in range(60))


def test_admm_goes_on_from_written_sums(classes, monkeypatch):
    p = admm.ADMMParams("lad", "l1", 0.5, iterations=9)
    rows = classes.selectExpr("row_id", "features", "cast(label as double) as y")
    whole, first = admm.train(rows, "y", None, 0, p)
    monkeypatch.setattr(admm, "EPOCH", 2)
    parts, second = admm.train(rows, "y", None, 0, p)
    assert np.allclose(whole.weights[0], parts.weights[0]) and np.allclose(first, second)


def _conditioned(spark, cond, m=300, n=6):
    rng = np.random.default_rng(3)
    u, v = np.linalg.qr(rng.standard_normal((m, n)))[0], np.linalg.qr(rng.standard_normal((n, n)))[0]
    a = u * np.geomspace(1, 1 / cond, n) @ v.T
    x = rng.standard_normal(n)
    return a, x, spark.createDataFrame([(i, a[i].tolist(), float(a[i] @ x)) for i in range(m)], "row_id long, features array<double>, y double").repartition(3)


def test_condition_of_ill_conditioned_rows(spark):
    for cond in (1e3, 1e10):
        a, _, rows = _conditioned(spark, cond)
        c = svd.condest(rows)
        assert 0.9 < c.cond / cond <= 1.1 and c.lower <= c.sigma_min * 1.01
        assert np.linalg.norm(a @ c.v_min) == pytest.approx(c.sigma_min, rel=0.05) and np.linalg.norm(a @ c.v_max) == pytest.approx(c.sigma_max, rel=1e-3)
    zero = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(5)], "row_id long, features array<double>")
    assert svd.condest(zero).cond == np.inf


def test_lsqr_keeps_its_digits(spark):
    a, x, rows = _conditioned(spark, 1e6)
    _, r = np.linalg.qr(a)
    got = krylov.lsqr(rows, "y", krylov.Params(1e-15, 12), np.linalg.inv(r * (1 + 1e-3)))
    assert np.linalg.norm(got.x[:, 0] - x) < 1e-6
    flat = krylov.lsqr(rows, "y", krylov.Params(1e-15, 200))
    assert np.linalg.norm(a @ flat.x[:, 0] - a @ x) < 1e-9


def test_power_steps_from_both_sides(tall):
    a, b, rows = tall
    v = np.ones((8, 2))
    assert np.allclose(svd.power_iteration(rows, v, 2, False), a.T @ a @ a.T @ a @ v)
    left = M.to_numpy(svd.power_iteration(rows, "t", 1, False, "left", "left"))
    assert np.allclose(left, a @ (a.T @ a) @ a.T @ b)
    q = np.linalg.qr(svd.power_iteration(rows, v, 30, True))[0]
    top = np.linalg.svd(a)[2][:1].T
    assert np.abs(q[:, :1].T @ top).max() > 0.99 or np.linalg.norm(q.T @ top) > 0.99


def test_wide_svd(spark):
    a = np.random.default_rng(5).standard_normal((7, 30))
    u, s, v = svd.approximate_svd(M.from_numpy(spark, a), 7, svd.SVDParams(num_iterations=1))
    assert np.allclose(M.to_numpy(u) * s @ v.T, a) and np.allclose(s, np.linalg.svd(a)[1])


def test_symmetric_svd_as_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    g = rng.standard_normal((12, 12))
    g = g + g.T + np.diag(np.arange(12) * 6.0)
    triangle, p = coords(spark, np.tril(g)), svd.SVDParams(num_iterations=12)
    held, values = svd.symmetric_svd_rows(triangle, 12, 3, p)
    monkeypatch.setattr(svd, "HELD", 1)
    apart, others = svd.symmetric_svd_rows(triangle, 12, 3, p)
    assert np.allclose(values, others, atol=1e-4) and np.allclose(values, np.linalg.eigvalsh(g)[::-1][:3], atol=1e-3)
    a, b = M.to_numpy(held), M.to_numpy(apart)
    assert np.allclose(np.abs((a * b).sum(axis=0)), 1, atol=1e-3)


def test_sums_by_slices(tall, monkeypatch):
    a, _, rows = tall
    monkeypatch.setattr(M, "TO_DRIVER", 1)
    assert np.allclose(M.gram(rows.select("features")), a.T @ a)


@pytest.mark.parametrize("solver", [krr.kernel_ridge, lambda *x: krr.faster_kernel_ridge(*x, 40, krr.KRRParams(1e-12))])
def test_kernel_ridge_without_its_gram_matrix(classes, monkeypatch, solver):
    rows = classes.withColumn("y", classes.label.cast("double"))
    whole = solver(rows, "y", kernels.Gaussian(6, 3.0), 0.1)
    for name, size in (("GRAM_ROWS", 10), ("TALL", 32), ("WIDE", 50)):
        monkeypatch.setattr(krr, name, size)
    apart = solver(rows, "y", kernels.Gaussian(6, 3.0), 0.1)
    assert np.allclose(whole.coefficients, apart.coefficients, atol=1e-6)
    monkeypatch.setattr(krr, "SUPPORT", 100)
    with pytest.raises(ValueError, match="feature-map"):
        solver(rows, "y", kernels.Gaussian(6, 3.0), 0.1)


def test_adapters(spark):
    a = np.array([[0.0, 2.0, 0.0], [0.0, 0.0, 0.0], [1.0, 0.0, 3.0]])
    data, indices, indptr = M.to_csr(coords(spark, a), 3)
    assert data.tolist() == [2, 1, 3] and indices.tolist() == [1, 0, 2] and indptr.tolist() == [0, 1, 1, 3]
    assert np.array_equal(dense(M.from_csr(spark, data, indices, indptr), (3, 3)), a)
    made = M.to_numpy(M.from_function(spark, 4, 3, lambda i, j: i * 10 + j))
    assert np.array_equal(made, np.arange(4)[:, None] * 10.0 + np.arange(3))
    y = spark.createDataFrame([(0, 1.0), (5, 2.0)], "i long, v double")
    x = spark.createDataFrame([(j, 1.0) for j in range(3)], "i long, v double")
    assert {r.i: r.v for r in M.gemv(coords(spark, a), x, 2.0, beta=-1.0, y=y).collect()} == {0: 3.0, 2: 8.0, 5: -2.0}


def test_coding(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "b")], "o int, y string")
    assert coding.label_order(df, "y", "o") == ["a", "b"]
    assert [r[0] for r in df.orderBy("o").select(coding.dummy_coding("y", ["a", "b"])).collect()] == [[1, -1], [-1, 1], [-1, 1]]
    tie = spark.createDataFrame([([1.0, 1.0],)], "s array<double>")
    assert tie.select(coding.dummy_decode("s", ["a", "b"])).first()[0] == "a"
    assert coding.num_targets(spark.createDataFrame([(-1,), (1,)], "y int"), "y") == 1 and coding.num_targets(spark.createDataFrame([(0,), (4,)], "y int"), "y") == 5


def test_streaming_scores_equal_batch(spark, classes, tmp_path):
    from basaltry.streaming import scoring

    model = krr.rlsc(classes, "label", kernels.Gaussian(6, 3.0), 0.1, "approximate", s=40)
    classes.write.parquet(str(tmp_path / "in"))
    stream = scoring.score_stream(spark.readStream.schema(classes.schema).parquet(str(tmp_path / "in")), model)
    scoring.to_memory(stream, "scores")
    assert sorted(map(tuple, spark.table("scores").select("row_id", "prediction").collect())) == sorted(map(tuple, model.predict(classes).select("row_id", "prediction").collect()))
