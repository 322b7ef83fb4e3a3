"""Synthetic multivariate series: generator name and parameters to a (times, processes) array, and to mts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A seed for specs without one.
DEFAULT_SEED = 123456789


def standardised(x: np.ndarray, on: bool = True) -> np.ndarray:
    """Channels to mean 0 and deviation 1; a constant one becomes a tiny pair of impulses."""
    if not on:
        return x
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd < 1e-12, 1, sd)
    flat = np.zeros(len(x))
    flat[:2] = [1e-6, -1e-6][: len(flat)]
    return np.where(sd < 1e-12, flat[:, None], z)


#: Other names of the couplings; fixed values that experiment files use.
CONNECTIVITY = {
    "all-to-all": "all-to-all", "alltoall": "all-to-all", "fully-connected": "all-to-all", "full": "all-to-all",
    "bidirectional-list": "ring-symmetric", "list": "ring-symmetric", "ring": "ring-symmetric", "ring-symmetric": "ring-symmetric", "symmetric": "ring-symmetric",
    "grid-four": "grid-four", "grid-4": "grid-four", "grid": "grid-four",
    "ring-unidirectional": "ring-unidirectional", "unidirectional": "ring-unidirectional", "directed-ring": "ring-unidirectional", "splay": "ring-unidirectional",
}


def connectivity_of(name: str) -> str:
    key = re.sub(r"[ _]", "-", name.strip().lower())
    if key not in CONNECTIVITY:
        raise ValueError(f"unknown connectivity {name}")
    return CONNECTIVITY[key]


def neighbours(m: int, topology: str, reach: int = 1) -> np.ndarray:
    """Coupling matrix: row i receives from column j; on symmetric rings from `reach` places either way."""
    a, i = np.zeros((m, m)), np.arange(m)
    if topology == "ring-symmetric":
        for d in range(1, reach + 1):
            a[i, (i + d) % m] = a[i, (i - d) % m] = 1
        if reach % m:
            np.fill_diagonal(a, 0)
    elif topology == "ring-unidirectional":
        a[i, (i - 1) % m] = 1
    elif topology == "all-to-all":
        a[:] = 1
        np.fill_diagonal(a, 0)
    elif topology == "grid-four":
        side = math.isqrt(m)
        if side * side != m:
            raise ValueError("a grid needs a square number of processes")
        r, c = divmod(i, side)
        for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            a[i, (r + dr) % side * side + (c + dc) % side] = 1
    else:
        raise ValueError(f"unknown topology {topology}")
    return a


def varma(m: int, t: int, rng, phi: float = 0.6, coupling: float = 0.4, ma_phi: float = 0.2, ma_coupling: float = 0.1, noise_std: float = 0.1, transients: int = 100, target_rho: float = 0.99, topology: str = "ring-symmetric", zscore: bool = True, shuffle: bool = False) -> np.ndarray:
    """x = A x(-1) + e + B e(-1) on a ring; A is scaled down to the spectral radius target_rho if it is above."""
    if topology == "ring-unidirectional":
        ring = np.eye(m)[:, (np.arange(m) + 1) % m]  # row i receives from i + 1
    elif topology == "ring-symmetric":
        ring = np.eye(m)[:, (np.arange(m) + 1) % m] + np.eye(m)[:, (np.arange(m) - 1) % m]
    elif topology == "all-to-all":
        ring = neighbours(m, topology)
    else:
        raise ValueError(f"unknown topology {topology}")
    ar, ma = phi * np.eye(m) + coupling * ring, ma_phi * np.eye(m) + ma_coupling * ring
    ar *= min(1.0, target_rho / max(np.abs(np.linalg.eigvals(ar)).max(), 1e-300))
    e = rng.normal(0.0, noise_std, (transients + t, m))
    push = e.copy()
    push[1:] += e[:-1] @ ma.T
    x, state = np.zeros_like(e), np.zeros(m)
    for k in range(1, len(e)):
        state = x[k] = ar @ state + push[k]
    x = x[transients:]
    if shuffle:
        for c in range(m):
            rng.shuffle(x[:, c])
    return standardised(x, zscore)


def noise(m: int, t: int, rng, kind: str = "gaussian", zscore: bool | None = None) -> np.ndarray:
    """Independent draws; only Gaussian ones are standardised unless said otherwise."""
    draw = {"gaussian": rng.standard_normal, "cauchy": rng.standard_cauchy, "exponential": rng.standard_exponential}[kind]
    return standardised(draw((t, m)), kind == "gaussian" if zscore is None else zscore)


def coupled_map(m: int, t: int, rng, alpha: float = 1.7522, eps: float = 0.00115, delta: int | str = 12, transients: int = 100, respect_transients: bool = False, zscore: bool = True) -> np.ndarray:
    """Lattice of logistic maps 1 - alpha x^2 with diffusive neighbours; the middle m of 20 or more sites.

    The first t states, the start included; after `transients` only if they are to be respected. delta is a view's stride.
    """
    skip, size = transients if respect_transients and transients > 0 else 0, max(m, 20)
    x, out = rng.random(size), np.empty((skip + t, size))
    for k in range(skip + t):
        out[k] = x
        y = 1 - alpha * x * x
        x = y + eps * ((np.roll(y, 1) + np.roll(y, -1)) / 2 - y)
    lo = (size - m) // 2
    return standardised(out[skip:, lo : lo + m], zscore)


def wave(m: int, t: int, rng, c: float = 10.0, dims: int = 1, zscore: bool = True) -> np.ndarray:
    """Leap-frog wave equation on a ring, or a torus of sqrt(m) by sqrt(m), from a Gaussian bump (deviation m / 20) at rest; no randomness.

    The time step is a fifth of what stability allows, so the speed c cancels out of the grid's equation.
    """
    side = m if dims == 1 else math.isqrt(m)
    if side**dims != m:
        raise ValueError("a 2-D wave needs a square number of processes")
    at = np.stack(np.meshgrid(*[np.arange(side) - side / 2] * dims, indexing="ij"))
    u = np.exp(-(at * at).sum(0) / (2 * (m / 20) ** 2))
    u /= np.abs(u).max()
    lap = lambda v: sum(np.roll(v, s, d) for d in range(dims) for s in (1, -1)) - 2 * dims * v
    step = (c * (0.2 / side / c) * side) ** 2
    out, before = np.empty((t, m)), u
    for k in range(t):
        out[k] = u.ravel()
        u, before = (u + 0.5 * step * lap(u) if k == 0 else 2 * u - before + step * lap(u)), u
    return standardised(out, zscore)


def kuramoto(m: int, t: int, rng, dt: float = 0.002, K: float = 1.5, k_ring: int = 1, omega_mean: float = 0.2 * math.pi, omega_std: float = 0.01, noise_std: float | None = None, eta: float = 0.0, transients: int = 2000, output: str = "sin", coupling_scheme: str = "bidirectional_list", connectivity: str | None = None, topology: str | None = None, k: float | None = None, zscore: bool = True) -> np.ndarray:  # noqa: N803
    """Phase oscillators by Euler-Maruyama steps, each pulled by the mean of its neighbours; k stands before K, noise_std before eta."""
    a = neighbours(m, connectivity_of(connectivity or topology or coupling_scheme), k_ring)
    degree = np.maximum(a.sum(1), 1)
    theta, omega = rng.uniform(0, 2 * math.pi, m), rng.normal(omega_mean, omega_std, m)
    strength, sd = float(K if k is None else k), math.sqrt(dt) * float(eta if noise_std is None else noise_std)
    see = {"sin": np.sin, "cos": np.cos}.get(output, lambda v: v)
    out = np.empty((t, m))
    for s in range(transients + t):
        if s >= transients:
            out[s - transients] = see(theta)
        sin, cos = np.sin(theta), np.cos(theta)
        pull = (cos * (a @ sin) - sin * (a @ cos)) / degree  # sum of sin(theta_j - theta_i)
        theta = (theta + dt * (omega + strength * pull) + sd * rng.standard_normal(m)) % (2 * math.pi)
    return standardised(out, zscore)


def mackey_glass(m: int, t: int, rng, tau: float = 17.0, beta: float = 0.2, gamma: float = 0.1, n: float = 10, coupling: float = 0.05, transients: int = 1000, dt: float = 0.1, topology: str = "ring-unidirectional", zscore: bool = True) -> np.ndarray:
    """Delay equation by Euler steps, every step kept; neighbours coupled by diffusion, an unknown topology leaves them uncoupled."""
    lag = round(tau / dt)
    if lag < 1:
        raise ValueError(f"tau {tau} is under a step of {dt}")
    a = neighbours(m, topology) if topology in ("ring-unidirectional", "ring-symmetric") else np.zeros((m, m))
    if topology == "ring-symmetric" and m == 2:
        a *= 2  # the one neighbour is on both sides
    degree = a.sum(1)
    x = np.empty((lag + 1 + transients + t, m))
    x[: lag + 1] = rng.uniform(0.5, 1.5, (lag + 1, m))
    for k in range(lag, len(x) - 1):
        late, now = x[k - lag], x[k]
        x[k + 1] = now + dt * (beta * late / (1 + late**n) - gamma * now + coupling * (a @ now - degree * now))
    out = x[lag + transients : lag + transients + t]
    if not zscore:
        return out
    sd = out.std(0)
    return (out - out.mean(0)) / np.where(sd < 1e-6, 1, sd)


def _fixed(f: Callable, **kw) -> Callable:
    return lambda m, t, rng, **p: f(m, t, rng, **(p | kw))


GENERATORS: dict[str, Callable] = {
    "varma": varma, "var": varma, "varma_shuffled": _fixed(varma, shuffle=True),
    "gaussian_noise": _fixed(noise, kind="gaussian"), "cauchy_noise": _fixed(noise, kind="cauchy"), "exponential_noise": _fixed(noise, kind="exponential"),
    "cml_logistic": coupled_map, "wave_1d": _fixed(wave, dims=1), "wave_2d": _fixed(wave, dims=2), "kuramoto": kuramoto,
    "kuramoto_all_to_all": _fixed(kuramoto, connectivity="all-to-all"), "kuramoto_bidirectional_list": _fixed(kuramoto, connectivity="bidirectional-list"), "kuramoto_grid_four": _fixed(kuramoto, connectivity="grid-four"),
    "mackey_glass": mackey_glass,
}


def generate(name: str, m: int, t: int, seed: int | None = None, **params) -> np.ndarray:
    if name not in GENERATORS:
        raise KeyError(f"unknown generator {name}")
    return GENERATORS[name](m, t, np.random.default_rng(DEFAULT_SEED if seed is None else seed), **params)


def _value(v):
    """A parameter as it was before it became text."""
    if not isinstance(v, str):
        return v
    try:
        return json.loads(v)
    except ValueError:
        return v


def of_grid(specs: DataFrame) -> DataFrame:
    """The generated series of an expanded grid; specs of archives and markets are left out."""
    return series(specs.filter(F.col("generator").isin(list(GENERATORS))).select("slug", "mts_class", "instance", "generator", "m", "t", "seed", F.to_json("params").alias("params")))


def series(specs: DataFrame) -> DataFrame:
    """mts of specs(slug, mts_class, instance, generator, m, t, seed, params json): one task row each, in parallel."""

    def run(batches):
        for b in batches:
            for slug, cls, inst, gen, m, t, seed, params in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                x = generate(gen, m, t, seed, **{k: _value(v) for k, v in json.loads(params or "{}").items()})
                n = x.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slug] * n), pa.array([cls] * n), pa.array([inst] * n, pa.int32()), pa.array(np.repeat(np.arange(t), m), pa.int32()), pa.array(np.tile(np.arange(m), t), pa.int32()), pa.array(x.ravel())],
                    names=["dataset_id", "mts_class", "instance", "t", "proc", "x"],
                )

    cols = specs.select(F.col("slug"), "mts_class", F.col("instance").cast("int"), "generator", F.col("m").cast("int"), F.col("t").cast("int"), F.col("seed").cast("long"), "params")
    return cols.repartition("slug").mapInArrow(run, "dataset_id string, mts_class string, instance int, t int, proc int, x double")
