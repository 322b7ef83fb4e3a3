"""Which statistics of the catalogue have a DataFrame plan, and these plans for a list of names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import alignment, dominance, fourier, moments, regression

_BAND = r"(_fmin-[0-9.]+_fmax-[0-9.]+)?"


def _spectral(f: Callable[[DataFrame, list[str]], DataFrame]) -> Callable[[DataFrame, list[str]], DataFrame]:
    return lambda mts, names: f(fourier.spectra(mts), names)


def _aligned(f: Callable[[DataFrame, str | None], DataFrame]) -> Callable[[DataFrame, list[str]], DataFrame]:
    return _each(lambda mts, name: f(mts, name.partition("_")[2] or None))


def _each(f: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, list[str]], DataFrame]:
    def run(mts: DataFrame, names: list[str]) -> DataFrame:
        out = f(mts, names[0])
        for n in names[1:]:
            out = out.unionByName(f(mts, n))
        return out

    return run


def _models(mts: DataFrame, names: list[str]) -> DataFrame:
    return regression.linear_models(mts, [n.partition("_")[2] for n in names])


#: Pattern of names to the plan that computes all names that match it.
PLANS: list[tuple[str, Callable[[DataFrame, list[str]], DataFrame]]] = [
    (rf"({'|'.join(fourier.MEASURES)})_(mean|max){_BAND}", _spectral(fourier.measures)),
    (rf"psi{_BAND}", _spectral(fourier.phase_slopes)),
    (rf"gd{_BAND}", _spectral(fourier.group_delays)),
    (r"dcorr(_biased)?|dcorrx_maxlag-[0-9]+", dominance.distance_statistics),
    (r"(cce|di|si)_gaussian|xme_gaussian_k[0-9]+|te_gaussian_k[0-9]+_l[0-9]+", moments.gaussian_information),
    (r"prec_(EmpiricalCovariance|ShrunkCovariance|OAS|LedoitWolf)", lambda mts, names: moments.precision(mts, [n[5:] for n in names])),
    (r"reci", _each(lambda mts, _: regression.regression_error(mts))),
    (r"igci", _each(lambda mts, _: regression.value_slopes(mts))),
    (r"cds", _each(lambda mts, _: regression.conditional_distributions(mts))),
    (r"lmfit_(Ridge|Lasso|ElasticNet|BayesianRidge)", _models),
    (r"lmfit_SGDRegressor", lambda mts, _: regression.stochastic_descent(mts)),
    (r"coint_aeg.*", regression.cointegration),
    (r"dtw(_.*)?", _aligned(alignment.dynamic_time_warping)),
    (r"softdtw(_.*)?", _aligned(alignment.soft_dynamic_time_warping)),
    (r"lcss(_.*)?", _aligned(alignment.common_subsequence)),
]


def has_plan(name: str) -> bool:
    return any(re.fullmatch(p, name) for p, _ in PLANS)


def planned(mts: DataFrame, names: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The edges of the names that have plans (None if none has), and the other names."""
    out, left = None, list(names)
    for pattern, plan in PLANS:
        mine = [n for n in left if re.fullmatch(pattern, n)]
        if mine:
            left = [n for n in left if n not in mine]
            edges = plan(mts, mine).select("dataset_id", "spi", "i", "j", "value")
            out = edges if out is None else out.unionByName(edges)
    return out, left
