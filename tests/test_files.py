"""From an experiment file to a table of Kolmogorov-Smirnov statistics by files, and the parts on the way."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import edges as E
from tidemark.operators import spi_sql
from tidemark.plans import grid
from tidemark.sources import files, generators

CONFIG = """
base_output_dir: out
rng_seed: 7
defaults: {M_values: [4], T_values: [60], instances: [0, 1, 2]}
mts_classes:
  - {name: "VAR(1)", generator: varma, labels: [linear], base_params: {phi: 0.5, ma_phi: 0.0}}
  - {name: CML, generator: cml_logistic, base_params: {alpha: 1.75, eps: 0.3, respect_transients: true}}
"""


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("study")
    (base / "x.yaml").write_text(CONFIG)
    specs = grid.expand(spark, grid.read_config(str(base / "x.yaml")))
    mts = generators.of_grid(specs)
    e = spi_sql.covariance(mts).unionByName(spi_sql.distance(mts, "euclidean"))
    meta = specs.select(F.col("slug").alias("dataset_id"), F.regexp_extract("dataset_dir", "([^/]+)/[^/]+$", 1).alias("class_dir"), "dataset_slug", F.to_json(F.struct("mts_class", F.col("instance").alias("instance_index"), "labels")).alias("meta"))
    out = files.write_datasets(mts, e, meta, str(base / "out")).collect()
    return base / "out", specs, out


def test_folders_are_complete(spark, study):
    base, specs, out = study
    assert len(out) == specs.count() == 6 and files.finished(spark, str(base)).count() == 6
    index = files.index_of(spark, str(base)).collect()
    assert [r.class_dir for r in index] == ["CML"] * 3 + ["VAR_1"] * 3 and {r.M for r in index} == {4} and {r.T for r in index} == {60}
    assert index[0].dataset_slug == "M4_T60_I0_alpha1p75-eps0p3"
    x = np.load(base / "VAR_1" / "M4_T60_I0" / "timeseries.npy")
    assert x.dtype == np.float32 and x.shape == (60, 4)
    with np.load(base / "VAR_1" / "M4_T60_I0" / "spi_mpis.npz") as z:
        a = z["cov_EmpiricalCovariance"] if "cov_EmpiricalCovariance" in z else z[z.files[0]]
        assert np.allclose(a, a.T) and not a.diagonal().any()
    left = specs.join(files.finished(spark, str(base)), "dataset_slug", "left_anti")
    assert left.count() == 0


def test_subsets_and_limits(spark, study):
    base, _, _ = study
    every = [s.name for s in files.index_of(spark, str(base)).first().spis]
    assert [s.name for s in files.index_of(spark, str(base), subset=every[::-1]).first().spis] == every[::-1]
    with pytest.raises(Exception, match="nothing"):
        files.index_of(spark, str(base), subset=["nothing"]).collect()
    assert files.index_of(spark, str(base), subset=["nothing"], silent=True).count() == 0
    assert files.index_of(spark, str(base), subset=[every[0], "nothing"], silent=True).count() == 6
    assert files.index_of(spark, str(base), limit=2).count() == 2 and files.index_of(spark, str(base), limit=0).count() == 6
    assert files.index_of(spark, str(base), classes=["CML"]).count() == 3
    last = base / "VAR_1" / "M4_T60_I2" / "spi_mpis.npz"
    whole = last.read_bytes()
    last.write_bytes(b"no archive")  # beyond the limit: it is never opened
    assert files.samples(spark, str(base), limit=2)[1].select("dataset_id").distinct().count() == 2
    with pytest.raises(Exception, match="npz|archive|pickle|zip"):
        files.samples(spark, str(base))[1].collect()
    last.write_bytes(whole)
    with pytest.raises(RuntimeError):
        files.samples(spark, str(base), classes=["none"])
    with pytest.raises(ValueError, match="several"):
        files.only_dataset(spark, f"{base}/CML")
    assert files.only_dataset(spark, f"{base}/CML/*_I0_*").endswith("CML/M4_T60_I0_alpha1p75-eps0p3")


def test_from_files_to_the_ks_table(spark, study, tmp_path):
    base, _, _ = study
    _, e = files.samples(spark, str(base))
    sizes = e.groupBy("dataset_id").agg((F.max("i") + 1).alias("m"))
    f = E.spi_features(E.edge_vectors(e.filter("i <> j").select("dataset_id", "spi", "i", "j", "value"), sizes, []))
    labels = e.select("dataset_id", "mts_class").distinct()
    files.write_features(f.join(labels, "dataset_id"), str(tmp_path / "f.npz"))
    assert files.read_features(spark, str(tmp_path / "f.npz"), recompute=True) is None
    back = files.read_features(spark, str(tmp_path / "f.npz"))
    assert back.count() == f.count() == 6
    ks = E.ks_between(back, ["CML", "VAR(1)"])
    files.write_ks(ks, str(tmp_path / "ks"))
    got = files.read_ks(spark, str(tmp_path / "ks")).collect()
    assert [(r.class_pair, r.n_a, r.n_b) for r in got] == [("CML_vs_VAR(1)", 3, 3)] and got[0].ks == ks.first().ks
    files.write_selection([("a|b", 0.5), ("c|d", 0.7)], str(tmp_path / "s.txt"), estimator="rf", mode="split", target=2, folds=5)
    assert [tuple(r) for r in files.read_selection(spark, str(tmp_path / "s.txt")).collect()] == [(0, "a", "b"), (1, "c", "d")]
    np.savez(tmp_path / "plain.npz", X=np.eye(2), y=np.array(["u", "v"]))
    assert {r.feature for r in files.read_features(spark, str(tmp_path / "plain.npz")).collect()} == {"f0", "f1"}
    np.savez(tmp_path / "bad.npz", X=np.eye(2))
    with pytest.raises(KeyError):
        files.read_features(spark, str(tmp_path / "bad.npz"))


def test_matrices_that_are_not_square(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    np.savez(tmp_path / "c" / "d" / "spi_mpis.npz", ok=np.eye(2), bad=np.ones((2, 3)))
    assert {r.spi for r in files.read_matrices(spark, str(tmp_path), square="skip").collect()} == {"ok"}
    with pytest.raises(Exception, match="square"):
        files.read_matrices(spark, str(tmp_path)).collect()


def test_archive_and_market(spark):
    rows = [(s, "a" if s < 3 else "b", t, p, float(s + t * p) if t else float("nan")) for s in range(5) for t in range(4) for p in range(2)]
    archive = spark.createDataFrame(rows, "sample int, class_label string, t int, proc int, x double")
    ids = [0, 1, 2]
    pick = ids[int(np.random.default_rng(files.sample_seed("D", "a", 1, 7)).choice(3))]
    got = files.archive_sample(archive, "D", "a", 1, 7).collect()
    assert {(r.t, r.proc): r.x for r in got} == {(t, p): float(pick + t * p) if t else 0.0 for t in range(4) for p in range(2)}
    assert all(np.isfinite(r.x) for r in files.archive_sample(archive, "D", "a", 1, 7, True).collect())
    with pytest.raises(ValueError):
        files.archive_sample(archive, "D", "c")
    markets = spark.createDataFrame([("S&P 500", "aa"), ("S&P 500", "bb"), ("dow", "zz")], "market string, ticker string")
    assert files.universe(spark, ["cc", "AA"], "sandp-500", markets) == ["AA", "BB", "CC"]
    prices = spark.createDataFrame([(d, k, None if (d, k) == (2, "aa") else float(d)) for d in range(5) for k in ("aa", "bb", "cc")], "day int, ticker string, close double")
    got = files.market_sample(prices, ["AA", "BB", "CC"], 3).collect()
    assert len(got) == 12 and {r.t for r in got} == set(range(4)) and {r.x for r in got} == {0.0, 1.0, 3.0, 4.0}
    with pytest.raises(ValueError):
        files.universe(spark, [], "nowhere", markets)


def test_names(spark):
    row = spark.range(1).select(names.comma_list(F.lit(" a, b,,c ")), names.market_key(F.lit("S&P_500 x-y")), names.subset_label(F.lit("/p/q/my.set.txt")), names.subset_label(F.lit(None).cast("string")), names.direction(F.lit("cov__ij")), names.direction(F.lit("cov")), names.feature_parts(F.lit("a|b|c")), names.class_pair(F.lit("z"), F.lit("b"))).first()
    assert list(row) == [["a", "b", "c"], "sandp500xy", "my.set", "all", ("cov", "ij"), ("cov", None), ("a", "b|c"), "b_vs_z"]
    assert grid.variant_suffix({"b": 0.5, "a": 3, "c": 1234567.0}) == "a3-b0p5-c1p23e-06" and grid.variant_suffix({}) == ""
    df = spark.createDataFrame([(1, 2, 3, 4)], "`proc-10` int, `proc-9` int, x int, `proc-?` int")
    assert files.in_process_order(df).columns == ["x", "proc-?", "proc-9", "proc-10"]


def test_config_files(spark, tmp_path):
    config = {"rng_seed": 3, "defaults": {"M_values": [4, 64], "T_values": [10], "instances": 2, "single_instance_M_values": [64], "single_instance_T_values": [20, 30], "single_instance_instances": [5]}, "mts_classes": [{"name": "A", "generator": "gaussian_noise", "variants": [{"params": {"zscore": False}}]}, {"name": "Y", "package": "yfinance", "tickers": ["a", "b"]}]}
    grid.write_config(config, str(tmp_path / "c.yaml"))
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert grid.read_config(str(tmp_path / "c.yaml")) == grid.read_config(str(tmp_path / "c.json")) == config
    specs = grid.expand(spark, config).collect()
    a = [(r.m, r.t, r.instance, r.variant) for r in specs if r.mts_class == "A"]
    assert a == [(m, t, i, v) for m, t, i in [(4, 10, 0), (4, 10, 1), (64, 20, 5), (64, 30, 5)] for v in (None, "zscorefalse")]
    assert specs[0].seed == grid.dataset_seed("3", "data", "A", "M4_T10_I0", "", "M4", "T10", "I0")
    assert {r.m for r in specs if r.mts_class == "Y"} == {2}
