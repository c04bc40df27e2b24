"""Kernels on symmetric positive matrices, over batches of flat arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _by_size(*columns: pd.Series):
    """Row positions and stacked square matrices of rows whose matrices have one size."""
    sizes = np.array([-1 if a is None else len(a) for a in columns[0]])
    for c in columns[1:]:
        sizes = np.where([a is None for a in c], -1, sizes)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        side = int(round(size**0.5))
        yield at, [np.stack([c.iat[i] for i in at]).reshape(len(at), side, side) for c in columns]


def _spectral(m: np.ndarray, f) -> np.ndarray:
    """f of the eigenvalues of each symmetric matrix; not a number where f fails."""
    values, vectors = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (vectors * f(values)[:, None, :]) @ vectors.transpose(0, 2, 1)


def _filled(size: int, blocks) -> pd.Series:
    out: list = [None] * size
    for at, result in blocks:
        flat = result.reshape(len(at), -1)
        for i, row in zip(at, flat, strict=True):
            out[i] = row if np.isfinite(row).all() else None
    return pd.Series(out)


def log_batch(cov: pd.Series) -> pd.Series:
    return _filled(len(cov), ((at, _spectral(c, np.log)) for at, (c,) in _by_size(cov)))


def exp_batch(log: pd.Series) -> pd.Series:
    return _filled(len(log), ((at, _spectral(m, np.exp)) for at, (m,) in _by_size(log)))


def log_map_batch(cov: pd.Series, mean: pd.Series) -> pd.Series:
    def run(c, m):
        root = _spectral(m, lambda v: 1 / np.sqrt(v))
        return _spectral(root @ c @ root, np.log)

    return _filled(len(cov), ((at, run(c, m)) for at, (c, m) in _by_size(cov, mean)))


def exp_step_batch(mean: pd.Series, step: pd.Series) -> pd.Series:
    def run(m, s):
        root = _spectral(m, np.sqrt)
        return root @ _spectral(s, np.exp) @ root

    return _filled(len(mean), ((at, run(m, s)) for at, (m, s) in _by_size(mean, step)))


def shrunk_batch(cov: pd.Series, width: pd.Series, oas: bool) -> pd.Series:
    """Covariance over its samples; with ``oas`` shrunk towards the mean variance.

    For p channels and n samples the oracle approximating weight is
    ((1 - 2/p) tr(S^2) + tr(S)^2) / ((n + 1 - 2/p) (tr(S^2) - tr(S)^2 / p)), at most one.
    Matrices with an eigenvalue of zero or less become null.
    """
    def run(at, c):
        n = width.to_numpy()[at].astype(float)
        s = c / n[:, None, None]
        p = s.shape[1]
        if oas:
            trace = np.trace(s, axis1=1, axis2=2)
            squares = (s * s).sum(axis=(1, 2))
            over = (1 - 2 / p) * squares + trace**2
            under = (n + 1 - 2 / p) * (squares - trace**2 / p)
            weight = np.where(under > 0, np.minimum(1.0, over / np.where(under > 0, under, 1.0)), 1.0)
            s = (1 - weight)[:, None, None] * s + (weight * trace / p)[:, None, None] * np.eye(p)
        least = np.linalg.eigvalsh(s)[:, 0]
        return np.where((least > 0)[:, None, None], s, np.nan)

    return _filled(len(cov), ((at, run(at, c)) for at, (c,) in _by_size(cov)))


def whiten_batch(cov: pd.Series, mean: pd.Series) -> pd.Series:
    """M^-1/2 C M^-1/2."""
    def run(c, m):
        root = _spectral(m, lambda v: 1 / np.sqrt(v))
        return root @ c @ root

    return _filled(len(cov), ((at, run(c, m)) for at, (c, m) in _by_size(cov, mean)))
