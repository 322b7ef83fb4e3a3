"""A study by its commands, from an experiment file to tables of Kolmogorov-Smirnov statistics."""

import json
import os

import numpy as np
import pytest
import yaml

from tidemark.commands import main
from tidemark.sources import files

CONFIG = {
    "base_output_dir": "out", "rng_seed": 7, "defaults": {"M_values": [4], "T_values": [60], "instances": [0, 1, 2]},
    "mts_classes": [{"name": "VAR(1)", "generator": "varma", "base_params": {"phi": 0.5}}, {"name": "Noise", "generator": "gaussian_noise"}],
}
PROFILE = {
    ".statistics.basic": {"Covariance": {"labels": ["undirected"], "configs": [{"estimator": "EmpiricalCovariance"}]}},
    ".statistics.distance": {"PairwiseDistance": {"labels": ["undirected"], "configs": [{"metric": "euclidean"}]}},
    ".statistics.causal": {"InformationGeometricConditionalIndependence": {"labels": ["directed"]}},
}


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    base = tmp_path_factory.mktemp("commands")
    (base / "x.yaml").write_text(yaml.safe_dump(CONFIG))
    (base / "p.yaml").write_text(yaml.safe_dump(PROFILE, sort_keys=False))
    return base, ["run", "--experiment-config", str(base / "x.yaml"), "--profile", str(base / "p.yaml"), "--base", str(base)]


def test_a_study_by_commands(spark, study, tmp_path):
    base, run = study
    assert main([*run, "--count-only"], spark) == ["6"]
    listed = main([*run, "--list"], spark)
    assert len(listed) == 6 and [x.split("\t")[0] for x in listed] == list("123456")
    assert not (base / "out").exists()
    with pytest.raises(IndexError):
        main([*run, "--job-index", "7"], spark)
    with pytest.raises(ValueError, match="profile"):
        main(run[:3] + run[5:], spark)
    one = main([*run, "--job-index", "2"], spark)
    folder = one[0].split("\t")[-1]
    assert len(one) == 1 and set(os.listdir(folder)) == set(files.PARTS)
    with open(os.path.join(folder, "meta.json")) as f:
        meta = json.load(f)
    assert meta["M"] == 4 and [s["directed"] for s in meta["pyspi"]["spis"] if s["name"] == "igci"] == [True]
    before = os.path.getmtime(os.path.join(folder, "meta.json"))
    assert len(main([*run, "--skip-existing"], spark)) == 5 and os.path.getmtime(os.path.join(folder, "meta.json")) == before
    assert main([*run, "--skip-existing"], spark) == []
    with np.load(os.path.join(folder, "spi_mpis.npz")) as z:
        assert np.allclose(z["pdist_euclidean"], z["pdist_euclidean"].T) and not np.allclose(z["igci"], z["igci"].T)

    out = str(base / "out")
    path = main(["features", "--base", out, "--output", str(tmp_path / "f.npz")], spark)[0]
    with np.load(path) as z:
        x, pairs, classes = z["X"], [tuple(p) for p in z["pairs"]], z["mts_class"].tolist()
    # cov, distance, igci__ij and igci__ji give six pairs
    assert x.shape == (6, 6) and sorted(classes) == ["Noise"] * 3 + ["VAR(1)"] * 3 and ("igci__ij", "igci__ji") in pairs
    stamp = os.path.getmtime(path)
    assert main(["features", "--base", out, "--output", str(tmp_path / "f.npz")], spark) == [path] and os.path.getmtime(path) == stamp

    (tmp_path / "two.txt").write_text("# kept\npdist_euclidean\ncov_EmpiricalCovariance\n")
    raw = main(["features", "--base", out, "--output", str(tmp_path / "f.npz"), "--space", "spi"], spark)[0]
    with np.load(raw) as z:
        assert raw.endswith("f_spi.npz") and z["X"].shape[0] == len(z["mts_class"]) and abs(float(z["X"].mean())) < 1e-6
        assert [k for s, k in z["pairs"] if s == z["pairs"][0][0]][:3] == ["000000", "000001", "000002"]
    short = main(["features", "--base", out, "--output", str(tmp_path / "f.npz"), "--spi-subset", str(tmp_path / "two.txt")], spark)[0]
    assert short.endswith("f_split_two.npz") and np.load(short)["X"].shape == (6, 1)

    assert main(["ks", "--features", path, "--output-dir", str(tmp_path / "ks")], spark) == ["Noise and VAR(1)"]
    got = {r.feature: r.ks for r in files.read_ks(spark, str(tmp_path / "ks")).collect()}
    for k, (a, b) in enumerate(pairs):
        u, v = (np.sort(x[[c == name for c in classes], k]) for name in ("Noise", "VAR(1)"))
        at = np.concatenate([u, v])
        assert got[f"{a}|{b}"] == pytest.approx(np.abs(np.searchsorted(u, at, "right") / 3 - np.searchsorted(v, at, "right") / 3).max())
    main(["ks", "--features", path, "--output-dir", str(tmp_path / "kde"), "--kde", "--kde-bandwidth", "0.1,0.5"], spark)
    assert {(r.bw, r.class_pair) for r in files.read_ks(spark, str(tmp_path / "kde")).collect()} == {(0.1, "Noise_vs_VAR(1)"), (0.5, "Noise_vs_VAR(1)")}
    with pytest.raises(ValueError, match="Nothing"):
        main(["ks", "--features", path, "--output-dir", str(tmp_path / "no"), "--mts-classes", "Noise,Nothing"], spark)
    chosen = main(["select", "--features", path, "--output", str(tmp_path / "s.txt"), "--target-dim", "2", "--cv-splits", "3"], spark)
    kept = [(r.spi_a, r.spi_b) for r in files.read_selection(spark, str(tmp_path / "s.txt")).collect()]
    assert [tuple(c.split("\t")[0].split("|")) for c in chosen] == kept and len(kept) == 2


def test_series_alone(spark, study):
    base, run = study
    lines = main([*run[:3], "--base", str(base / "alone"), "--mts-only", "--job-index", "1"], spark)
    assert np.load(os.path.join(lines[0].split("\t")[-1], "timeseries.npy")).shape == (60, 4)
