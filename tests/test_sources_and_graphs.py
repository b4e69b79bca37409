"""Readers, writers, graphs, and the registered queries."""

import warnings

import pytest

from basaltry.operators import graph
from basaltry.operators import matrix as M
from basaltry.sources import text_formats as T

TRIANGLES = [("A1", "A2"), ("A2", "A3"), ("A1", "A3"), ("B1", "B2"), ("B2", "B3"), ("B1", "B3"), ("A1", "B1")]


@pytest.fixture(scope="module")
def edges(spark):
    return T.simple_graph(spark.createDataFrame([*TRIANGLES, ("A1", "A1"), ("A2", "A1")], "src string, dst string")).cache()


def test_libsvm(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("0 1:0.2 4:0.5 10:0.3\n5 6:0.1 3:0.3\n\n# note\n1 2 2:1 2:2\n7\n")
    rows = T.read_libsvm(spark, str(f)).orderBy("row_id").collect()
    assert [r.labels for r in rows] == [[0], [5], [1, 2], [7]] and all(len(r.features) == 10 for r in rows)
    assert rows[1].features[2] == 0.3 and rows[1].features[5] == 0.1 and rows[2].features[1] == 3.0 and not any(rows[3].features)
    assert T.read_libsvm(spark, str(f), strict_stop=True).count() == 2
    assert T.read_libsvm(spark, str(f), min_d=12, max_n=1).first().features[9:] == [0.3, 0, 0]
    assert T.libsvm_coords(T.read(spark, str(f), "libsvm_sparse")).where("i = 0").count() == 3
    with pytest.raises(ValueError):
        T.read(spark, str(f), "hdf5_dense")


def test_libsvm_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0, [0.5, 0.0, 2.0]), (1, -1.0, [0.0, 1.25, 0.0])], "row_id long, y double, features array<double>")
    T.write_libsvm(rows.coalesce(1), "y", str(tmp_path / "out"))
    back = T.read_libsvm(spark, str(tmp_path / "out"), min_d=3)
    assert sorted((r.labels[0], r.features) for r in back.collect()) == [(-1.0, [0.0, 1.25, 0.0]), (1.0, [0.5, 0.0, 2.0])]
    T.convert_libsvm(spark, str(tmp_path / "out"), str(tmp_path / "p"))
    assert T.read(spark, str(tmp_path / "p"), "parquet_dense").count() == 2


def test_arc_list_and_index(spark):
    lines = spark.createDataFrame([("# c",), ("1 2 4",), ("2\t1",), ("3  3",), ("",)], "value string")
    assert sorted(map(tuple, T.read_arc_list(spark, lines).collect())) == [(1, 2, 4.0), (2, 1, 1.0), (3, 3, 1.0)]
    assert sorted(map(tuple, T.read_arc_list(spark, lines, True).collect())) == [(1, 2, 2.5), (2, 1, 2.5), (3, 3, 1.0)]
    assert T.read_graph(spark, lines, numeric=True).count() == 2
    assert T.read_index(spark, spark.createDataFrame([("a 3",)], "value string")).first()[:] == ("a", 3)


def test_random_matrix_does_not_depend_on_partitions(spark):
    a = M.to_numpy(T.random_matrix(spark, 20, 3, "uniform", 5))
    assert (a == M.to_numpy(T.random_matrix(spark, 20, 3, "uniform", 5).repartition(7))).all() and 0 < a.min() < a.max() < 1


def test_two_triangles(edges):
    assert graph.num_edges(edges) == 14 and {r.vertex: r.degree for r in graph.degrees(edges).collect()}["A1"] == 3
    cluster, conductance = graph.local_cluster(edges, ["A1"])
    assert set(cluster) == {"A1", "A2", "A3"} and conductance == pytest.approx(1 / 7)


def _ring_of_cliques(spark, cliques=4, size=6):
    rows = [(c * size + i, c * size + j) for c in range(cliques) for i in range(size) for j in range(i)]
    rows += [(c * size, (c + 1) % cliques * size + 1) for c in range(cliques)]
    return T.simple_graph(spark.createDataFrame(rows, "src long, dst long"))


def test_clusters_of_all_vertices(spark, edges):
    got = {r.seed: (r.cluster, r.conductance) for r in graph.communities(edges).collect()}
    assert len(got) == 6 and got["B2"][0] == ["B1", "B2", "B3"] and got["A1"][1] == pytest.approx(1 / 7)
    ring = _ring_of_cliques(spark)
    for recursive in (False, True):
        some = {r.seed: (r.cluster, r.conductance) for r in graph.communities(ring, [2, 9, 999], None, recursive).collect()}
        assert set(some) == {2, 9}
        for seed, (cluster, value) in some.items():
            apart, other = graph.local_cluster(ring, [seed], None, recursive)
            assert sorted(apart) == cluster and other == pytest.approx(value)
    assert some[9][0] == list(range(6, 12))


def test_large_graphs_go_seed_by_seed(spark, edges, monkeypatch):
    monkeypatch.setattr(graph, "HELD_EDGES", 1)
    assert sorted(graph.communities(edges, ["A2"]).first().cluster) == ["A1", "A2", "A3"]


def test_diffusion_solves_its_equation(spark):
    """Against the exponential of the dense matrix."""
    import numpy as np

    ring = _ring_of_cliques(spark)
    a = np.zeros((24, 24))
    for r in ring.collect():
        a[r.src, r.dst] = 1
    step = -(np.eye(24) - 0.85 * (a / a.sum(axis=1, keepdims=True)).T)
    exact, term = np.eye(24), np.eye(24)
    for k in range(1, 80):
        term = term @ step * 5.0 / k
        exact = exact + term
    y = {r.vertex: r.y[0] for r in graph.time_dependent_ppr(ring, {3: 1.0}, graph.PPRParams(epsilon=1e-9)).collect()}
    assert max(abs(y.get(i, 0.0) - exact[i, 3]) for i in range(24)) < 1e-7
    with pytest.raises(RuntimeError):
        graph.time_dependent_ppr(ring, {3: 1.0}, graph.PPRParams(epsilon=1e-9, rounds=2))


def test_vertex_numbers_follow_their_order(spark):
    ring = _ring_of_cliques(spark).repartition(5)
    assert sorted(map(tuple, graph.vertex_index(ring).collect())) == [(i, i) for i in range(24)]


def test_sweep_of_everything_is_guarded(spark, edges):
    y = graph.degrees(edges).selectExpr("vertex", "1.0 as y")
    last = graph.sweep(edges, y).orderBy("position").collect()[-1]
    assert last.volume == 14 and last.cut == 0 and last.conductance == 1.0


def test_spectral_embedding(edges):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        x, values = graph.spectral_embedding(edges, 2, 20)
    rows = {r.vertex: r.x for r in x.collect()}
    assert values[0] == pytest.approx(2.41421356, abs=1e-4)
    assert sum(a * b for a, b in zip(rows["A1"], rows["A2"], strict=True)) == pytest.approx(1.0, abs=0.5)


def test_collocation_size():
    assert graph.collocation_size(graph.PPRParams()) % 4 == 0
    assert graph.bessel_i(0, 1.0) == pytest.approx(1.2660658777520084) and graph.bessel_i(3, 5.0) == pytest.approx(10.331150169151138)


def test_parquet_twins_of_matrix_files(spark, tmp_path):
    """Dense X with Y, and sparse X, written and read again."""
    rows = spark.createDataFrame([(0, 1.0, [0.5, 0.0, 2.0]), (1, -1.0, [0.0, 1.25, 0.0]), (2, 3.0, [0.0, 0.0, 0.0])], "row_id long, label double, features array<double>")
    T.write_matrix(rows, str(tmp_path / "d"))
    assert sorted(map(tuple, T.read(spark, str(tmp_path / "d"), "parquet_dense").collect())) == sorted(map(tuple, rows.collect()))
    T.write_matrix(M.to_coords(rows), str(tmp_path / "s"))
    back = T.read(spark, str(tmp_path / "s"), "parquet_sparse")
    assert M.same_matrix(back, M.to_coords(rows)) and back.count() == 3


def test_every_twin_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["bucket", "j", "v"]
