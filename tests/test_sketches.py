"""Sketches against explicit matrices in both directions, partition invariance, statistics, JSON."""

import math

import numpy as np
import pytest

from basaltry.functions import rng
from basaltry.operators import matrix as M
from basaltry.operators import sketch as S


@pytest.fixture(scope="module")
def counter(spark):
    a = np.arange(50, dtype=float).reshape(10, 5) + 1
    return a, M.from_numpy(spark, a)


def test_threefry_is_a_function_of_seed_and_place():
    c = rng.Context(3)
    assert np.array_equal(c.words(0, np.arange(5, 9)), c.words(5, np.arange(4)))
    assert not np.array_equal(c.words(0, np.arange(9)), rng.Context(4).words(0, np.arange(9)))
    x = c.sample("normal", 0, np.arange(100_000))
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02
    assert abs(c.chi_square(3, 0, np.arange(20_000)).mean() - 3) < 0.1
    assert sorted(rng.Context(1).permutation(50)) == list(range(50))


def test_normal_quantile():
    from statistics import NormalDist

    u = np.array([1e-9, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-7])
    assert np.allclose(rng.quantile("normal", u), [NormalDist().inv_cdf(x) for x in u], atol=1e-10)


def test_halton():
    h = rng.halton(np.arange(4), 2, leap=1)
    assert np.allclose(h[:, 0], [0.5, 0.25, 0.75, 0.125]) and np.allclose(h[:, 1], [1 / 3, 2 / 3, 1 / 9, 4 / 9])


@pytest.mark.parametrize("kind", ["CWT", "MMT", "WZT"])
@pytest.mark.parametrize("parts", [1, 7])
def test_hash_sketches_equal_explicit_products(spark, counter, kind, parts):
    a, rows = counter
    rows = rows.repartition(parts)
    t = S.create(kind, 10, 6, seed=5)
    got = np.zeros((6, 5))
    for k, f in t.apply(rows, "columnwise").collect():
        got[k] = f
    assert np.allclose(got, t.matrix() @ a)
    t = S.create(kind, 5, 3, seed=5)
    assert np.allclose(M.to_numpy(t.apply(rows, "rowwise")), a @ t.matrix().T)


@pytest.mark.parametrize("kind", ["JLT", "CT", "SJLT", "FJLT"])
def test_dense_sketches_equal_explicit_products(spark, counter, kind):
    a, rows = counter
    for parts in (1, 3):
        t = S.create(kind, 10, 4, seed=2)
        assert np.allclose(M.to_numpy(t * rows.repartition(parts)), t.matrix() @ a)
        t = S.create(kind, 5, 4, seed=2)
        assert np.allclose(M.to_numpy(t.apply(rows.repartition(parts), "rowwise")), a @ t.matrix().T)


@pytest.mark.parametrize("replace", [True, False])
def test_sampling(spark, counter, replace):
    a, rows = counter
    t = S.UST(10, 4, 3, replace=replace)
    assert np.array_equal(M.to_numpy(t.apply(rows, "columnwise")), a[t.samples()])
    assert replace or len(set(t.samples())) == 4
    n = S.NURST(5, 1000, 3, probabilities=[0.0, 1.0, 0.0, 3.0, 0.0])
    assert set(n.samples()) == {1, 3} and 650 < (n.samples() == 3).sum() < 850


def test_json_round_trip(counter):
    for kind, params in {"CWT": {}, "WZT": {"p": 1.5}, "JLT": {}, "GaussianRFT": {"sigma": 2.0}, "PPT": {"q": 3}, "FastMaternRFT": {"nu": 1.5}, "ExpSemigroupQRLT": {"beta": 0.5}}.items():
        t = S.create(kind, 5, 4, seed=9, counter=3, **params)
        assert S.from_json(t.to_json()) == t
    with pytest.raises(ValueError):
        S.WZT(5, 4, p=3)


def test_unitary_transforms():
    x = np.random.default_rng(0).standard_normal((3, 12))
    m = np.array([[math.sqrt((1 if k == 0 else 2) / 12) * math.cos(math.pi * (2 * j + 1) * k / 24) for j in range(12)] for k in range(12)])
    assert np.allclose(S.dct(x), x @ m.T) and np.allclose(S.dct(S.dct(x), inverse=True), x)
    assert np.allclose(S.dht(S.dht(x)), x)
    assert np.allclose(S.wht(S.wht(x))[:, :12], x)
    r = S.RFUT(12, 12, 4)
    assert np.allclose(r.inverse_block(r.map_block(x)), x)


def test_columnwise_mixing_needs_whole_columns(spark, counter):
    a, rows = counter
    r = S.RFUT(10, 10, 4)
    assert np.allclose(M.to_numpy(r.apply(rows, "columnwise")), r.map_block(a.T).T)


@pytest.mark.parametrize(
    ("kind", "params", "kernel"),
    [
        ("GaussianRFT", {"sigma": 2.0}, lambda d2, d1, x: np.exp(-d2 / 8)),
        ("GaussianQRFT", {"sigma": 2.0}, lambda d2, d1, x: np.exp(-d2 / 8)),
        ("FastGaussianRFT", {"sigma": 2.0}, lambda d2, d1, x: np.exp(-d2 / 8)),
        ("LaplacianRFT", {"sigma": 3.0}, lambda d2, d1, x: np.exp(-d1 / 3)),
        ("MaternRFT", {"nu": 1.5, "l": 2.0}, lambda d2, d1, x: (1 + np.sqrt(3 * d2) / 2) * np.exp(-np.sqrt(3 * d2) / 2)),
        ("FastMaternRFT", {"nu": 1.5, "l": 2.0}, lambda d2, d1, x: (1 + np.sqrt(3 * d2) / 2) * np.exp(-np.sqrt(3 * d2) / 2)),
        ("PPT", {"q": 2, "gamma": 0.5, "c": 1.0}, lambda d2, d1, x: (0.5 * x @ x.T + 1) ** 2),
    ],
)
def test_feature_maps_approach_their_kernels(kind, params, kernel):
    x = np.random.default_rng(1).standard_normal((6, 10)) * 0.5
    z = S.create(kind, 10, 8192, seed=1, **params).map_block(x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    d1 = np.abs(x[:, None] - x[None]).sum(-1)
    assert np.abs(z @ z.T - kernel(d2, d1, x)).max() < 0.06


def test_laplace_features():
    x = np.abs(np.random.default_rng(1).standard_normal((6, 10)))
    z = S.ExpSemigroupRLT(10, 8192, 1, beta=0.3).map_block(x)
    assert np.abs(z @ z.T - np.exp(-0.3 * np.sqrt(x[:, None] + x[None]).sum(-1))).max() < 0.05


@pytest.mark.parametrize("kind", ["JLT", "CWT"])
def test_singular_values_survive(spark, kind):
    a = np.random.default_rng(0).random((1500, 12))
    rows = M.from_numpy(spark, a).repartition(4)
    t = S.create(kind, 1500, 400, seed=1)
    got = np.linalg.svd(np.array([r[1] for r in t.apply(rows, "columnwise").collect()]))[1]
    want = np.linalg.svd(a)[1]
    assert (np.abs(got / want - 1) < 0.5).all()
