"""What the third round's findings named."""

import numpy as np
import pytest

from basaltry.operators import graph, kernels, krr, krylov, matrix, models, pairs, sketch, sparse, svd, tiles
from basaltry.sources import text_formats


def coords_of(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double")


def dense(coords, shape):
    out = np.zeros(shape)
    for i, j, v in coords.select("i", "j", "v").collect():
        out[i, j] += v
    return out


def test_models_in_folders_that_are_not_there(spark, tmp_path):
    model = models.FeatureModel([], [np.array([[0.5], [-2.0]])])
    for uri, session in ((str(tmp_path / "a" / "b" / "m.json"), None), (f"file://{tmp_path}/c/d/m", spark)):
        models.save(model, uri, session)
        assert np.array_equal(models.load(uri, session).weights[0], model.weights[0])


def test_svd_of_a_product_that_is_not_made(spark):
    rng = np.random.default_rng(3)
    b, c = (rng.standard_normal((n, 4)) * (rng.random((n, 4)) < 0.6) for n in (40, 23))
    u, s, v = svd.sparse_svd((coords_of(spark, b), coords_of(spark, c)), 40, 23, 3, svd.SVDParams(2, 0, 2), side=8)
    made = (b @ c.T, *(dense(matrix.to_coords(x, True), (n, 3)) for x, n in ((u, 40), (v, 23))))
    assert np.allclose(s, np.linalg.svd(made[0], compute_uv=False)[:3]) and np.allclose(made[0] @ made[2], made[1] * s)


@pytest.mark.parametrize("block", [4, 16])
def test_eigenpairs_of_a_matrix_of_low_rank(spark, block):
    rng = np.random.default_rng(4)
    half = rng.standard_normal((30, 3)) * (rng.random((30, 3)) < 0.5)
    a = half @ np.diag([1.0, -2.0, 3.0]) @ half.T
    v, values = svd.symmetric_eigenpairs(coords_of(spark, np.tril(a)), 30, block, side=8)
    x = dense(matrix.to_coords(v, True), (30, 3))
    assert len(values) == 3 and np.allclose(x * values @ x.T, a) and np.allclose(x.T @ x, np.eye(3))


def test_small_tiles_do_not_move_rows_more_often_than_tasks_need(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 3)))
    rows = matrix.from_numpy(spark, x)
    assert pairs.tiles_of(rows, 24) == 3  # of 4 shuffle partitions; 300 tiles before
    d = kernels.distance_block("l1", x, x)
    got = {(r.i, r.rank): (r.j, -r.v) for r in pairs.largest(rows, None, lambda a, b: -kernels.distance_block("l1", a, b), 4, True, 24).collect()}
    for i in range(300):
        order = sorted((d[i, j], j) for j in range(300) if j != i)[:4]
        assert [got[i, k + 1][0] for k in range(4)] == [j for _, j in order]


@pytest.mark.parametrize("kind", ["l1", "expsemigroup"])
def test_distances_in_blocks_that_do_not_divide(kind):
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((70, 5)), rng.standard_normal((300, 5))
    terms = np.abs(x[:, None] - y) if kind == "l1" else np.sqrt(np.abs(x[:, None] + y))
    assert np.allclose(kernels.distance_block(kind, x, y), terms.sum(axis=2))


def test_kernel_models_never_hold_all_values_of_a_block(monkeypatch):
    rng = np.random.default_rng(7)
    x, y, v = rng.standard_normal((50, 3)), rng.standard_normal((70, 3)), rng.standard_normal((70, 2))
    monkeypatch.setattr(pairs, "SIDE", 16)
    whole = kernels.Gaussian.block
    monkeypatch.setattr(kernels.Gaussian, "block", lambda k, a, b: whole(k, a, b) if len(a) * len(b) <= 256 else pytest.fail("a block of all values"))
    for k in (kernels.Gaussian(3, 2.0), kernels.Linear(3)):
        model = models.KernelModel(k, y, v)
        want = np.exp(-((x[:, None] - y) ** 2).sum(axis=2) / 8) @ v if isinstance(k, kernels.Gaussian) else x @ y.T @ v
        assert np.allclose(model.decision(x), want) and np.allclose(model.shared().decision(x), want)


@pytest.mark.parametrize("method", ["exact", "faster"])
def test_linear_ridge_makes_no_gram_matrix(spark, monkeypatch, method):
    rng = np.random.default_rng(8)
    x, t = rng.standard_normal((60, 3)), rng.standard_normal(60)
    rows = matrix.from_numpy(spark, x).join(spark.createDataFrame(list(enumerate(t.tolist())), "row_id long, t double"), "row_id")
    monkeypatch.setattr(kernels.Linear, "block", lambda *_: pytest.fail("a Gram matrix"))
    model = krr.SOLVERS[method](rows, "t", kernels.Linear(3), 0.1, **({} if method == "exact" else {"s": 8, "params": krr.KRRParams(1e-13)}))
    assert np.allclose(model.coefficients[:, 0], np.linalg.solve(x @ x.T + 0.1 * np.eye(60), t))


def test_tiles_of_a_thin_matrix_are_larger(spark, monkeypatch):
    assert tiles.side_for([(36_000_000, 9_000_000, 1_200_000)]) == 1 << 15 and tiles.side_for([(10**6, 10**4, 10**4)]) == tiles.SIDE
    rng = np.random.default_rng(9)
    a, b = (rng.standard_normal(s) * (rng.random(s) < 0.2) for s in ((50, 40), (40, 60)))
    seen = []
    choose = tiles.grid
    monkeypatch.setattr(tiles, "grid", lambda *x: seen.append(choose(*x)) or seen[-1])
    monkeypatch.setattr(tiles, "CELL", 1000)
    got = tiles.gemm(coords_of(spark, a), coords_of(spark, b), side=16, shape=(1, 1, 1))
    assert np.allclose(dense(got, (50, 60)), a @ b) and seen


def test_whole_parts_that_the_diffusion_does_not_reach(spark):
    path = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 201)]
    edges = spark.createDataFrame([e for a, b in path for e in ((a, b), (b, a))], "src long, dst long")
    assert {(r.vertex, r.part) for r in graph.parts(edges).collect()} == {(v, 0) for v in range(31)} | {(v, 100) for v in (100, 101, 102)} | {(v, 200) for v in (200, 201)}
    seeds = spark.createDataFrame([(0,), (101,)], "seed long")
    found = graph.clusters_of(edges, seeds, graph.PPRParams(epsilon=1e-3, times=2), whole=True).collect()
    assert sorted((r.seed, r.vertex) for r in found) == [(0, v) for v in range(31)] + [(101, v) for v in (100, 101, 102)]
    assert all(r.conductance == 0 for r in found)


def test_ridge_on_rows_takes_few_products(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x, t = rng.standard_normal((320, 2)), rng.standard_normal(320)
    rows = matrix.from_numpy(spark, x).join(spark.createDataFrame(list(enumerate(t.tolist())), "row_id long, t double"), "row_id")
    whole, made = pairs.product, []
    monkeypatch.setattr(pairs, "product", lambda *a, **kw: made.append(a[1]) or whole(*a, **kw))
    model = krr.kernel_ridge_rows(rows, "t", kernels.Gaussian(2, 2.0), 0.1, 0, krr.KRRParams(1e-9))
    assert len(made) <= 12  # 32 before
    k = np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / 8)
    got = {r.row_id: r.coefficients[0] for r in model.support.collect()}
    want = np.linalg.solve(k + 0.1 * np.eye(320), t)
    assert np.allclose([got[i] for i in range(320)], want, atol=1e-5)
    scores = {r.row_id: r.features[0] for r in model.scores(model.support).collect()}
    assert made[-1] is None and np.allclose([scores[i] for i in range(320)], k @ want, atol=1e-6)


def test_quality_fit_holds_its_counts_once():
    import tracemalloc

    from basaltry.llm import quality

    rng = np.random.default_rng(11)
    counts = (rng.poisson(0.2, (1200, quality.TERMS)) * (1 + np.arange(1200)[:, None] % 7)).astype(np.float32)
    tracemalloc.start()
    try:
        quality.fit(counts, np.arange(1200) % 2, {0: 600, 1: 600})
        assert tracemalloc.get_traced_memory()[1] < 1.5 * counts.nbytes  # 2.0 times before
    finally:
        tracemalloc.stop()


def test_leading_eigenpairs_without_the_others():
    from basaltry.llm import quality

    rng = np.random.default_rng(12)
    half = rng.standard_normal((300, 300)) * 0.9 ** np.arange(300)
    half[:, :9] = np.linalg.qr(half[:, :9])[0] * 20  # equal ones
    a = half @ half.T
    values, vectors = quality.leading(a, 12)
    want = np.linalg.eigvalsh(a)[-12:]
    assert len(values) < 300 and np.allclose(values[-12:], want) and np.allclose(a @ vectors[:, -12:], vectors[:, -12:] * want, atol=1e-3 * want[-1])


def test_diffusion_has_no_row_for_a_place_of_an_edge(spark, monkeypatch):
    arcs = [(i, (i + d) % 12) for i in range(12) for d in (1, 5)]
    edges = spark.createDataFrame(sorted({e for a, b in arcs for e in ((a, b), (b, a))}), "src long, dst long")
    p = graph.PPRParams(epsilon=1e-4, times=2)
    many = {r.vertex: r.y for r in graph.diffuse_many(edges, spark.createDataFrame([(0, 3, 1.0)], "seed long, vertex long, mass double"), p).collect()}
    monkeypatch.setattr(graph.F, "posexplode", lambda *_: pytest.fail("a row for each place"))
    one = {r.vertex: r.y for r in graph.time_dependent_ppr(edges, {3: 1.0, 99: 1.0}, p).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[v], many[v]) for v in one)


def test_compared_rows_are_made_once(spark):
    from basaltry.operators import regression

    made = spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(13)
    x = rng.standard_normal((40, 3))

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = matrix.from_numpy(spark, x).selectExpr("row_id", "features", "features[0] + row_id AS y")
    rows = rows.mapInArrow(count, rows.schema)
    out = regression.compare(rows, "y", ["normal", "qr", "lsqr"])
    best = np.linalg.norm(x[:, 0] + np.arange(40) - x @ np.linalg.lstsq(x, x[:, 0] + np.arange(40), rcond=None)[0])
    assert made.value == 40 and np.allclose([v for _, _, v in out], best)  # once for each pass before


def test_lines_are_numbered_in_place(spark, tmp_path):
    for k, n in enumerate((5, 0, 7)):
        (tmp_path / f"{k}.txt").write_text("".join(f"{100 * k + i} {i + 1}:2.5 \t{k + 9}:1\n" + ("\n# none\n" if i == 2 else "") for i in range(n)))
    rows = text_formats.read_libsvm(spark, str(tmp_path), sparse=True)
    got = sorted((r.row_id, int(r.labels[0]), r.size, r.indices, list(r["values"])) for r in rows.collect())
    assert [x[1:] for x in got] == [(100 * k + i, 11, [i, k + 8], [2.5, 1.0]) for k, n in enumerate((5, 0, 7)) for i in range(n)]
    assert [x[0] for x in got] == [0, 1, 2, 5, 6, 7, 8, 9, 12, 13, 14, 15]  # lines that are skipped count
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rightHint=(strategy=broadcast)" in plan  # before, each line went through a window's sort
    twice = text_formats.read_libsvm(spark, [str(tmp_path / "0.txt")] * 2, sparse=True)
    assert sorted(r.row_id for r in twice.collect()) == [0, 1, 2, 5, 6, 7, 8, 9, 12, 13]
    few = text_formats.read_libsvm(spark, str(tmp_path), sparse=True, max_n=2)
    assert sorted(r.row_id for r in few.collect()) == [0, 1] and few.first().size == 9


@pytest.mark.parametrize("some", [1 << 22, 64])
def test_a_sketch_adds_up_its_batches_before_rows_go_on(spark, monkeypatch, some):
    monkeypatch.setattr(sketch, "SOME", some)
    monkeypatch.setattr(sketch, "SQUARE", 256)  # 8 rows at a time
    rng = np.random.default_rng(13)
    a = np.round(rng.standard_normal((200, 30)) * (rng.random((200, 30)) < 0.2), 2)
    rows = sparse.from_coords(coords_of(spark, a), 30).coalesce(1)
    transform = sketch.JLT(200, 4, 5, stream="portable")
    made = transform.columnwise_coords(rows)
    assert np.allclose(dense(made, (4, 30)), transform.matrix() @ a)
    assert made.count() == 4 * np.count_nonzero(a.any(axis=0))
    sent = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, schema: sent.append(run) or df.selectExpr("0L i", "0L j", "0D v"))
    transform.columnwise_coords(rows)
    batches = rows.select("row_id", *sparse.COLUMNS).toArrow().to_batches()
    n = sum(b.num_rows for b in sent[0](iter(batches)))
    assert n == 4 * 30 if some > 64 else n > 4 * 30  # before, all parts' columns, 8 rows each, went on by themselves


def test_least_squares_of_sparse_rows_pass_over_packed_blocks(spark, monkeypatch):
    monkeypatch.setattr(sparse, "PACKED", 50)
    rng = np.random.default_rng(14)
    a = np.round(rng.standard_normal((120, 9)) * (rng.random((120, 9)) < 0.4), 2)
    a[7] = 0  # a row without entries
    b = rng.standard_normal((120, 2))
    at = [np.flatnonzero(x).tolist() for x in a]
    rows = spark.createDataFrame([(i, 9, at[i], a[i, at[i]].tolist(), b[i].tolist()) for i in range(120)], "row_id long, size int, indices array<int>, values array<double>, y array<double>").repartition(3)
    tall = krylov.Tall(rows, "y")
    assert tall.frame.count() < 20 and tall.frame.columns == ["size", "starts", "indices", "values", "beside"]  # 120 rows before
    assert np.allclose(krylov.lsqr(rows, "y", krylov.Params(1e-12, 60)).x, np.linalg.lstsq(a, b, rcond=None)[0])
