"""Profiles: files that choose statistics by class and parameters.

A profile is a mapping of module to class to {labels, configs}. Each config of a class becomes one statistic of
the catalogue; a class or parameter that the catalogue lacks is an error that names it, never left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dominance, spi, spi_sql
from ..operators.kernels import KERNELS

Config = Mapping[str, Any]
Plan = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Statistic:
    """A chosen statistic; plan is its DataFrame form where it is a closed expression, else it is a kernel of that name."""

    name: str
    labels: tuple[str, ...]
    plan: Plan | None = None

    @property
    def directed(self) -> bool:
        return any(x.lower() == "directed" for x in self.labels)


def _band(c: Config) -> str:
    lo, hi = c.get("fmin", 0), c.get("fmax", 0.5)
    return "" if (lo, hi) == (0, 0.5) else f"_fmin-{lo:g}_fmax-{hi:g}"


def _neighbours(c: Config) -> str:
    """How a mutual information is estimated."""
    if c.get("estimator") == "kraskov":
        return f"kraskov_NN-{c.get('prop_k', 4)}{'_DCE' * ('dyn_corr_excl' in c)}"
    return f"kernel_W-{c.get('kernel_width', 0.25):g}" if c.get("estimator") == "kernel" else c.get("estimator", "gaussian")


def _transfer(c: Config) -> str:
    how, k, l = c.get("estimator", "gaussian"), c.get("k_history", 1), c.get("l_history", 1)  # noqa: E741
    kept = "_auto" if "auto_embed_method" in c else f"_k{k}" if how in ("kernel", "symbolic") else f"_k{k}_l{l}"
    return f"te_{how}{kept}{'_DCE' * ('dyn_corr_excl' in c)}"


def _granger(c: Config) -> str:
    how = c.get("method", "nonparametric")
    order = f"_order-{c['order'] if c.get('order') else 'BIC'}" if how == "parametric" else ""
    return f"sgc_{how}{order}_{c.get('statistic', 'mean')}{_band(c)}"


def _cointegration(c: Config) -> str:
    if c.get("method", "johansen") == "johansen":
        return f"coint_johansen_{c.get('statistic', 'trace_stat')}_order-{c.get('det_order', 1)}_ardiff-{c.get('k_ar_diff', 1)}"
    if c.get("autolag"):
        return f"coint_aeg_{c.get('statistic', 'tstat')}_trend-{c.get('trend', 'c')}_autolag-{c['autolag']}_maxlag-{c.get('maxlag', 10)}"
    return "coint_aeg_trend" if c.get("trend", "c") == "ct" else f"coint_aeg_lags-{c.get('maxlag', 10)}"


def _by_estimator(short: str) -> Callable[[Config], str]:
    return lambda c: f"{short}_{c.get('estimator', 'gaussian')}"


def _by_flag(short: str, flag: str) -> Callable[[Config], str]:
    return lambda c: short + f"_{flag}" * bool(c.get(flag))


def _by_constraint(short: str) -> Callable[[Config], str]:
    return lambda c: "_".join(filter(None, [short, c.get("global_constraint")]))


def _by_band(short: str) -> Callable[[Config], str]:
    return lambda c: f"{short}_{c.get('statistic', 'mean')}{_band(c)}"


#: Class to the name of a kernel; those with a module are told apart by it.
KERNEL_OF: dict[str, Callable[[Config], str]] = {
    "Covariance": lambda c: f"cov_{c.get('estimator', 'EmpiricalCovariance')}{'_sq' * bool(c.get('squared'))}",
    "Precision": lambda c: f"prec_{c.get('estimator', 'EmpiricalCovariance')}{'_sq' * bool(c.get('squared'))}",
    "DistanceCorrelation": _by_flag("dcorr", "biased"),
    "HilbertSchmidtIndependenceCriterion": _by_flag("hsic", "biased"),
    "MultiscaleGraphCorrelation": lambda c: "mgc",
    "HellerHellerGorfine": lambda c: "hhg",
    "CrossDistanceCorrelation": lambda c: f"dcorrx_maxlag-{c.get('max_lag', 1)}",
    "CrossMultiscaleGraphCorrelation": lambda c: f"mgcx_maxlag-{c.get('max_lag', 1)}",
    "DynamicTimeWarping": _by_constraint("dtw"),
    "SoftDynamicTimeWarping": _by_constraint("softdtw"),
    "LongestCommonSubsequence": _by_constraint("lcss"),
    "Barycenter": lambda c: f"bary{'_sq' * bool(c.get('squared'))}_{c.get('mode', 'euclidean')}_{c.get('statistic', 'mean')}",
    "GromovWasserstainTau": lambda c: "gwtau",
    "AdditiveNoiseModel": lambda c: "anm",
    "ConditionalDistributionSimilarity": lambda c: "cds",
    "RegressionErrorCausalInference": lambda c: "reci",
    "InformationGeometricConditionalIndependence": lambda c: "igci",
    "ConvergentCrossMapping": lambda c: "_".join(filter(None, ["ccm", c.get("statistic", "mean"), f"E-{c['embedding_dimension']}" if c.get("embedding_dimension") else None])),
    "JointEntropy": _by_estimator("je"),
    "ConditionalEntropy": _by_estimator("ce"),
    "CausalEntropy": _by_estimator("cce"),
    "DirectedInfo": _by_estimator("di"),
    "StochasticInteraction": _by_estimator("si"),
    "CrossmapEntropy": lambda c: f"xme_{c.get('estimator', 'gaussian')}_k{c.get('history_length', 10)}",
    "MutualInfo": lambda c: f"mi_{_neighbours(c)}",
    "TimeLaggedMutualInfo": lambda c: f"tlmi_{_neighbours(c)}",
    "TransferEntropy": _transfer,
    "IntegratedInformation": lambda c: f"phi_{c.get('phitype', 'star')}{'_norm-1' * bool(c.get('normalization'))}",
    "CoherencePhase": _by_band("phase"),
    "CoherenceMagnitude": _by_band("cohmag"),
    "ImaginaryCoherence": _by_band("icoh"),
    "PhaseLockingValue": _by_band("plv"),
    "PhaseLagIndex": _by_band("pli"),
    "WeightedPhaseLagIndex": _by_band("wpli"),
    "DebiasedSquaredPhaseLagIndex": _by_band("dspli"),
    "DebiasedSquaredWeightedPhaseLagIndex": _by_band("dswpli"),
    "PairwisePhaseConsistency": _by_band("ppc"),
    "DirectedTransferFunction": _by_band("dtf"),
    "DirectedCoherence": _by_band("dcoh"),
    "PartialDirectedCoherence": _by_band("pdc"),
    "GeneralizedPartialDirectedCoherence": _by_band("gpdc"),
    "DirectDirectedTransferFunction": _by_band("ddtf"),
    "spectral.PhaseSlopeIndex": lambda c: f"psi{_band(c)}",
    "wavelet.PhaseSlopeIndex": _by_band("wpsi"),
    "GroupDelay": lambda c: f"gd{_band(c)}",
    "SpectralGrangerCausality": _granger,
    "LinearModel": lambda c: f"lmfit_{c.get('model', 'Ridge')}",
    "GPModel": lambda c: f"gpfit_{c.get('kernel', 'RBF')}",
    "Cointegration": _cointegration,
    "PowerEnvelopeCorrelation": lambda c: "pec" + "".join(s for s, p in (("_orth", "orth"), ("_log", "log"), ("_abs", "absolute")) if c.get(p)),
}


def _closed(cls: str, c: Config) -> tuple[str, Plan] | None:
    """Name and DataFrame form of the classes that are closed expressions."""
    sq = bool(c.get("squared"))
    if cls == "SpearmanR":
        return f"spearmanr{'-sq' * sq}", partial(spi_sql.spearman, squared=sq)
    if cls == "KendallTau":
        return f"kendalltau{'-sq' * sq}", partial(dominance.kendall, squared=sq)
    if cls == "CrossCorrelation":
        stat, sig = c.get("statistic", "max"), c.get("sigonly", True)
        return f"xcorr{'-sq' * sq}_{stat}_sig-{sig}", partial(spi_sql.cross_correlation, statistic=stat, squared=sq, sig_only=sig)
    if cls == "PairwiseDistance":
        metric = c.get("metric", "euclidean")
        if metric not in spi_sql.DISTANCES:
            raise KeyError(f"no distance {metric}")
        return f"pdist_{metric}", partial(spi_sql.distance, metric=metric)
    return None


def statistic(module: str, cls: str, config: Config | None = None, labels: Iterable[str] = ()) -> Statistic:
    """The statistic of one config. Classes of a variant suite have the same meaning under its suffix."""
    c, base = dict(config or {}), cls.removesuffix("Sonnet")
    if found := _closed(base, c):
        return Statistic(found[0], tuple(labels), found[1])
    rule = KERNEL_OF.get(base) or KERNEL_OF.get(f"{module.rsplit('.', 1)[-1]}.{base}")
    name = rule(c) if rule else None
    if name not in KERNELS:
        raise KeyError(f"the catalogue has no {module}.{cls} with {c}")
    return Statistic(name, tuple(labels))


def read_profile(profile: str | Mapping[str, Any]) -> list[Statistic]:
    """The statistics of a YAML file (or its mapping) in order, each once; labels of one given twice are the first's."""
    if isinstance(profile, str):
        import yaml

        with open(profile) as f:
            profile = yaml.safe_load(f)
    out: dict[str, Statistic] = {}
    for module, group in (profile or {}).items():
        for cls, entry in (group or {}).items():
            entry = entry or {}
            for config in entry.get("configs") or [None]:
                s = statistic(module.lstrip("."), cls, config, entry.get("labels") or ())
                out.setdefault(s.name, s)
    return list(out.values())


def labels_of(spark: SparkSession, chosen: list[Statistic]) -> DataFrame:
    """spi, directed, labels of a profile."""
    return spark.createDataFrame([(s.name, s.directed, list(s.labels)) for s in chosen], "spi string, directed boolean, labels array<string>")


def compute_profile(mts: DataFrame, chosen: list[Statistic], normalise: bool = False) -> DataFrame:
    """edges(dataset_id, spi, i, j, value): all i <> j of statistics labelled directed, i < j of others.

    Where the label is not directed but the measure is, both ways are averaged; where only the label is, the value
    stands for both. Kernels take one pass over the datasets together.
    """
    if not chosen:
        raise ValueError("the profile has no statistics")
    x = spi_sql._z(mts).drop("n") if normalise else mts
    parts = [s.plan(x).withColumn("spi", F.lit(s.name)) for s in chosen if s.plan]
    if kernels := [s.name for s in chosen if not s.plan]:
        parts.append(spi.compute(x, kernels))
    edges = reduce(DataFrame.unionByName, [p.select("dataset_id", "spi", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "value") for p in parts])
    fold = [s.name for s in chosen if not s.directed and not s.plan and KERNELS[s.name][0]]
    both = [s.name for s in chosen if s.directed and (s.plan or not KERNELS[s.name][0])]
    if fold:
        folded = edges.filter(F.col("spi").isin(fold)).groupBy("dataset_id", "spi", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("value").alias("value"))
        edges = edges.filter(~F.col("spi").isin(fold)).unionByName(folded)
    if both:
        # One pass: each such row is given twice, the second time the other way round.
        ways = F.when(F.col("spi").isin(both), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
        edges = edges.select("dataset_id", "spi", F.explode(ways).alias("w"), "value").select("dataset_id", "spi", "w.i", "w.j", "value")
    return edges
