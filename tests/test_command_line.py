import json

import numpy as np

from basaltry.__main__ import main


def _data(path, n=60):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    x = rng.standard_normal((n, 4)) + 3 * y[:, None]
    path.write_text("".join(f"{k} " + " ".join(f"{j + 1}:{v:.4f}" for j, v in enumerate(r)) + "\n" for k, r in zip(y, x, strict=True)))
    return x, y


def test_svd_linear_and_learners(spark, tmp_path, capsys):
    f = tmp_path / "d.txt"
    x, y = _data(f)
    main(["svd", str(f), "--rank", "4", "--prefix", str(tmp_path / "s")], spark)
    assert np.allclose(np.loadtxt(tmp_path / "s.S"), np.linalg.svd(x)[1], atol=1e-2)
    main(["svd", str(f), "--rank", "4", "--format", "libsvm_sparse", "--prefix", str(tmp_path / "t")], spark)
    assert np.allclose(np.loadtxt(tmp_path / "t.S"), np.linalg.svd(x)[1], atol=1e-2)
    assert spark.read.parquet(str(tmp_path / "t.V")).count() == x.shape[1]
    main(["linear", str(f), "-p", "--prefix", str(tmp_path / "l")], spark)
    assert np.allclose(np.loadtxt(tmp_path / "l.x").ravel(), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-3)
    main(["krr", str(f), "--model", str(tmp_path / "m"), "-g", "3", "-f", "40", "--test", str(f)], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["accuracy"] > 90
    main(["predict", str(f), "--model", str(tmp_path / "m"), "--output", str(tmp_path / "p")], spark)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 60
    main(["convert", str(f), str(tmp_path / "c")], spark)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 60


def test_options_of_learners(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    f = tmp_path / "d.txt"
    _data(f)
    main(["krr", str(f), "--model", str(tmp_path / "m"), "--algorithm", "approximate", "-g", "3", "-f", "40", "--sketch-rows", "--partial", "50", "--test", str(f)], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["accuracy"] > 80
    main(["admm", str(f), "--model", str(tmp_path / "a"), "--loss", "hinge", "--regularizer", "l2", "-g", "3", "-f", "40", "--iterations", "8", "--validation", str(f)], spark)
    out = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out["objective"][-1] < out["objective"][0] and out["validation"][-1] > 85
    monkeypatch.setattr(sys, "stdin", io.StringIO("0 1:3 2:3 3:3 4:3\n0 1:0.1\n"))
    main(["predict", "-", "--model", str(tmp_path / "a")], spark)
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()[-2:]] == [1, 0]
    main(["compare", str(f)], spark)
    residuals = [json.loads(x)["residual"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(residuals) == 8 and min(residuals) > 0


def test_all_communities_and_lines_of_seeds(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    f = tmp_path / "g.txt"
    f.write_text("0 1\n1 2\n0 2\n3 4\n4 5\n3 5\n0 3\n")
    main(["community", str(f), "--all", "--numeric"], spark)
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(found) == 6 and all(x["cluster"] in ([0, 1, 2], [3, 4, 5]) for x in found)
    monkeypatch.setattr(sys, "stdin", io.StringIO("4\n\n1 2\n"))
    main(["community", str(f), "--interactive", "--numeric"], spark)
    assert [json.loads(x)["cluster"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == [[3, 4, 5], [0, 1, 2]]


def test_community(spark, tmp_path, capsys):
    f = tmp_path / "g.txt"
    f.write_text("# two triangles\n0 1\n1 2\n0 2\n3 4\n4 5\n3 5\n0 3\n")
    main(["community", str(f), "--seeds", "1", "--numeric"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["cluster"] == [0, 1, 2]
