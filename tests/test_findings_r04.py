"""What the fourth round's findings named."""

import numpy as np
import pytest

from basaltry.operators import kernels, matrix, pairs, tiles


def coords_of(spark, a):
    i, j = np.nonzero(a)
    return spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double")


def dense(coords, shape):
    out = np.zeros(shape)
    for i, j, v in coords.select("i", "j", "v").collect():
        out[i, j] += v
    return out


def test_pairs_go_on_in_the_order_of_their_values(spark):
    x = np.random.default_rng(1).standard_normal((90, 3))
    got = pairs.values(matrix.from_numpy(spark, x), None, kernels.Gaussian(3, 1.5).block).collect()
    want = np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / 4.5)
    assert sorted((r.i, r.j) for r in got) == [(i, j) for i in range(90) for j in range(i + 1)]
    assert np.allclose([r.v for r in got], [want[r.i, r.j] for r in got])
    assert (np.diff([r.v for r in got]) > -1e-6).all()  # row by row before, whose files were 1.6 times as large


def test_a_thin_product_is_cut_inside():
    a, c = 2.6e9, 20.7e9  # parts by parts through the orders of 6 GB; c: all scalar products
    pi, pj, pk = tiles.grid(a, a, c, (220, 220, 1650), 32, load=tiles.Load(a, a, c, c))
    assert (pi, pj) == (1, 1) and (2 * a + c) / pk <= tiles.CELL  # 16, 16 and 1 before: A and B moved 16 times each


@pytest.mark.parametrize("shape", [(1, 1, 1), (2, 3, 2), (4, 1, 4)])
def test_products_and_c_are_added_by_tiles(spark, monkeypatch, shape):
    rng = np.random.default_rng(2)
    a, b, c = (rng.standard_normal(s) * (rng.random(s) < 0.2) for s in ((40, 50), (50, 30), (45, 35)))
    a[10:, 10:] = 0  # an arrow: most tiles are absent
    monkeypatch.setattr(tiles, "coo_sum", lambda *_: pytest.fail("scalars of the result move"), raising=False)
    want = np.zeros((45, 35))
    want[:40, :30] = 2 * a @ b
    twice = coords_of(spark, c)
    got = tiles.gemm(coords_of(spark, a), coords_of(spark, b), 2.0, -0.25, twice.unionByName(twice), side=8, shape=shape)
    assert np.allclose(dense(got, (45, 35)), want - 0.5 * c)
    assert got.groupBy("i", "j").count().where("count > 1").isEmpty()


def test_tiles_go_only_where_the_other_side_has_some(spark):
    n = 400
    arrow = np.arange(n)
    load = tiles.Load(1e9, 1.5e9, 1.5e9, panel=4e6, bi=np.concatenate([arrow, 0 * arrow]), bj=np.concatenate([0 * arrow, arrow]))
    assert load.spread(32) < 1.2 and load.met(32, 32) == 63 and load.made(32, n) < 2e9
    pi, pj, pk = tiles.grid(1e9, 1.5e9, 1.5e9, (n, 1, n), 32, load=load)
    moved = 1e9 * pj + 1.5e9 * load.spread(pi) + load.made(pk, n)
    assert moved < 5e9 < min(1e9 + 1.5e9 * i + 1.5e9 * k for i in (8, 16, 32, 64, 128) for k in (8, 16, 32, 64, 128))  # each copy of all before


@pytest.mark.parametrize("kind", ["l1", "expsemigroup"])
@pytest.mark.parametrize("shift", [0.0, 1e9, np.inf])
def test_distances_add_their_terms_several_at_a_time(kind, shift):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((70, 11)), rng.standard_normal((300, 11))
    if np.isinf(shift):
        x[3, 2] = shift
    else:
        x, y = x + shift, y + shift
    want = (np.abs(x[:, None] - y) if kind == "l1" else np.sqrt(np.abs(x[:, None] + y))).sum(axis=2)
    assert np.allclose(kernels.distance_block(kind, x, y), want, rtol=1e-13, atol=1e-13)
    assert kernels.DEEP > 1 and kernels._spread_out(x, y) == (shift == 0)  # one at a time before


def test_a_matrix_with_itself_is_made_once(spark, monkeypatch):
    rows, seen = matrix.from_numpy(spark, np.random.default_rng(4).standard_normal((40, 3))), []
    made = pairs.tile_pairs
    monkeypatch.setattr(pairs, "tile_pairs", lambda x, y, *a, **kw: seen.append(y) or made(x, y, *a, **kw))
    x = matrix.to_numpy(rows)
    got = {r.i: (r.total, r.largest) for r in pairs.summary(rows, rows, kernels.ExpSemigroup(3, 0.5).block, 64).collect()}
    k = np.exp(-0.5 * np.sqrt(np.abs(x[:, None] + x)).sum(axis=2))
    assert seen == [None] and np.allclose([got[i] for i in range(40)], np.stack([k.sum(axis=1), k.max(axis=1)], axis=1))  # in both orders before


def test_rows_with_themselves_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(kernels, "BROADCAST", 8 * 8 * 3 * 30)
    rows, called = matrix.from_numpy(spark, np.random.default_rng(5).standard_normal((40, 3))), []
    made = pairs.summary
    monkeypatch.setattr(pairs, "summary", lambda *a, **kw: called.append(1) or made(*a, **kw))
    x = matrix.to_numpy(rows)
    got = {r.i: r.total for r in kernels.row_summary(rows, rows, "l1").collect()}
    assert called and np.allclose([got[i] for i in range(40)], np.abs(x[:, None] - x).sum(axis=(1, 2)))  # by the input's partitions before
