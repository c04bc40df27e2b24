"""Small numeric kernels over Arrow batches.

Each takes the arrays of one batch and returns arrays of the same length; Spark
partitions, shuffles and sums everything around them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

FLOOR = 1e-12


def segment_length(samples: int, sfreq: float) -> int:
    return min(samples, max(64, int(round(sfreq))))


@lru_cache(maxsize=64)
def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch_density(data: np.ndarray, sfreq: float) -> np.ndarray:
    """One-sided power density of each row: periodic Hann, half overlap, mean of segments."""
    data = data - data.mean(axis=1, keepdims=True)
    n = segment_length(data.shape[1], sfreq)
    step = n - n // 2
    starts = range(0, data.shape[1] - n + 1, step)
    window = _hann(n)
    total = 0.0
    for s in starts:
        seg = data[:, s : s + n]
        seg = (seg - seg.mean(axis=1, keepdims=True)) * window
        total = total + np.abs(np.fft.rfft(seg, axis=1)) ** 2
    density = total / len(starts) / (sfreq * (window**2).sum())
    last = density.shape[1] - 1 if n % 2 == 0 else density.shape[1]
    density[:, 1:last] *= 2
    return density


def _blocks(*columns: pd.Series):
    """Row positions of a batch that share the same shape parameters."""
    frame = pd.DataFrame({str(i): c.to_numpy() for i, c in enumerate(columns)})
    for key, at in frame.groupby(list(frame.columns), sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), at


def welch_batch(samples: pd.Series, sfreq: pd.Series) -> pd.Series:
    out: list = [None] * len(samples)
    for (_, rate), at in _blocks(samples.map(len), sfreq):
        data = np.stack([samples.iat[i] for i in at])
        for i, row in zip(at, welch_density(data, float(rate)), strict=True):
            # Spectra of rows with non-finite samples are refused, not guessed.
            out[i] = row if np.isfinite(row).all() else None
    return pd.Series(out)


# --- zero-phase band-pass -------------------------------------------------------

ORDER = 4


@lru_cache(maxsize=64)
def butterworth_sections(sfreq: float, low: float, high: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of an order-4 Butterworth band-pass."""
    edges = 4.0 * np.tan(np.pi * np.array([low, high]) / sfreq)
    width, center2 = edges[1] - edges[0], edges[0] * edges[1]
    k = np.arange(ORDER)
    proto = np.exp(1j * np.pi * (2 * k + ORDER + 1) / (2 * ORDER)) * width / 2
    root = np.sqrt(proto**2 - center2 + 0j)
    analog = np.concatenate([proto + root, proto - root])
    digital = (4 + analog) / (4 - analog)
    # Zeros at 0 and infinity become +1 and -1: one pair per section.
    gain = (width**ORDER * 4.0**ORDER / np.prod(4 - analog)).real
    upper = digital[digital.imag > 0]
    sections = np.array([[1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    sections[0, :3] *= gain
    return sections


def _cascade(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter along axis 0, started as if the first sample had lasted forever."""
    y = x.copy()
    level = x[0].copy()
    for b0, b1, b2, a1, a2 in sections:
        rest = level * (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2 = rest - b0 * level, b2 * level - a2 * rest
        for t in range(len(y)):
            v = y[t]
            out = b0 * v + z1
            z1 = b1 * v - a1 * out + z2
            z2 = b2 * v - a2 * out
            y[t] = out
        level = rest
    return y


PAD = 3 * (2 * ORDER + 1)


@lru_cache(maxsize=64)
def zero_phase_matrix(n: int, sfreq: float, low: float, high: float) -> np.ndarray:
    """The forward-backward filter with odd extension, as one n x n matrix.

    The whole operation is linear in the samples, so filtering a batch is a single
    matrix product; the recursion runs once per (length, rate, band).
    """
    eye = np.eye(n)
    head = 2 * eye[0] - eye[PAD:0:-1]
    tail = 2 * eye[-1] - eye[-2 : -PAD - 2 : -1]
    extended = np.concatenate([head, eye, tail])
    sections = butterworth_sections(sfreq, low, high)
    forward = _cascade(sections, extended)
    return _cascade(sections, forward[::-1])[::-1][PAD:-PAD].copy()


# Up to so many samples the filter is one cached matrix (at most 8 MB); longer signals are run
# through the sections, all rows at once.
MATRIX_SAMPLES = 1024


def zero_phase(data: np.ndarray, sfreq: float, low: float, high: float) -> np.ndarray:
    """Forward-backward band-pass along the last axis, in memory linear in the samples."""
    n = data.shape[-1]
    if n <= MATRIX_SAMPLES:
        return data @ zero_phase_matrix(n, sfreq, low, high).T
    x = data.reshape(-1, n).T
    extended = np.concatenate([2 * x[0] - x[PAD:0:-1], x, 2 * x[-1] - x[-2 : -PAD - 2 : -1]])
    sections = butterworth_sections(sfreq, low, high)
    back = _cascade(sections, _cascade(sections, extended)[::-1])
    return back[::-1][PAD:-PAD].T.reshape(data.shape)


def filterable(n: int, sfreq: float, low: float, high: float) -> bool:
    return n > PAD and 0 < low < high < sfreq / 2


def bandpass_batch(samples: pd.Series, sfreq: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    out: list = [None] * len(samples)
    for (n, rate, lo, hi), at in _blocks(samples.map(len), sfreq, low, high):
        if not filterable(int(n), rate, lo, hi):
            continue
        data = np.stack([samples.iat[i] for i in at])
        good = np.isfinite(data).all(axis=1)
        done = zero_phase(np.where(good[:, None], data, 0.0), rate, lo, hi)
        for i, row, ok in zip(at, done, good, strict=True):
            out[i] = row if ok else None
    return pd.Series(out)


def covariance_batch(samples: pd.Series, channels: pd.Series, sfreq: pd.Series, bands) -> pd.Series:
    """Per trial and band: flat channel covariance of the filtered, centred signal.

    Every later number of the decoding jobs (variances, spatial filters, projected
    variances) follows from these few values, so raw samples cross to Python once.  A band
    without edges (None, None) is the unfiltered signal.
    """
    out: list = [None] * len(samples)
    for (size, width, rate), at in _blocks(samples.map(len), channels, sfreq):
        c = int(width)
        n = int(size) // c
        cube = np.stack([samples.iat[i] for i in at]).reshape(len(at), c, n)
        good = np.isfinite(cube).all(axis=(1, 2))
        cube = np.where(good[:, None, None], cube, 0.0)
        per_band = []
        for low, high in bands:
            if low is None:
                f = cube
            elif filterable(n, rate, low, high):
                f = zero_phase(cube, rate, low, high)
            else:
                per_band.append(None)
                continue
            f = f - f.mean(axis=2, keepdims=True)
            per_band.append((f @ f.transpose(0, 2, 1)).reshape(len(at), c * c))
        for j, i in enumerate(at):
            if good[j]:
                out[i] = [None if b is None else b[j] for b in per_band]
    return pd.Series(out)


# --- spatial filters and classifier ---------------------------------------------


def spatial_filters(left: np.ndarray, right: np.ndarray, components: int) -> np.ndarray:
    """Generalised eigenvectors of ``left`` against ``left + right``, ends of the spectrum."""
    ridge = np.eye(len(left)) * 1e-8
    chol = np.linalg.cholesky(left + right + ridge)
    half = np.linalg.solve(chol, left + ridge)
    white = np.linalg.solve(chol, half.T)
    _, vectors = np.linalg.eigh((white + white.T) / 2)
    vectors = np.linalg.solve(chol.T, vectors)
    k = components // 2
    keep = np.concatenate([vectors[:, :k], vectors[:, vectors.shape[1] - k :]], axis=1)
    return keep.T


def training_sides(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2 classes, folds, values) sums to what each fold trains on: the total less its
    own part.  With a single fold there is nothing to hold out."""
    if counts.shape[1] == 1:
        return sums, counts
    return sums.sum(axis=1, keepdims=True) - sums, counts.sum(axis=1, keepdims=True) - counts


def spatial_filters_batch(sums: pd.Series, counts: pd.Series, components: pd.Series) -> pd.Series:
    """Flat filters per fold from per-fold covariance sums of two classes."""
    out = []
    for flat, n, k in zip(sums, counts, components, strict=True):
        n = np.reshape(n, (2, -1)).astype(float)
        total = np.reshape(flat, (2, n.shape[1], -1))
        c = int(round(total.shape[2] ** 0.5))
        if k > c:
            out.append(None)
            continue
        total, n = training_sides(total, n)
        mean = (total / n[:, :, None]).reshape(2, -1, c, c)
        out.append([spatial_filters(a, b, int(k)).ravel() for a, b in zip(*mean, strict=True)])
    return pd.Series(out)


def projected_shares_batch(cov: pd.Series, filters: pd.Series) -> pd.Series:
    """log of each projected variance's share of their sum."""
    out: list = [None] * len(cov)
    for (size, flat), at in _blocks(cov.map(len), filters.map(len)):
        c = int(round(int(size) ** 0.5))
        m = np.stack([cov.iat[i] for i in at]).reshape(len(at), c, c)
        w = np.stack([filters.iat[i] for i in at]).reshape(len(at), int(flat) // c, c)
        power = np.einsum("tkc,tkc->tk", w @ m, w)
        share = np.log(power / power.sum(axis=1, keepdims=True) + FLOOR)
        for i, row in zip(at, share, strict=True):
            out[i] = row
    return pd.Series(out)


def class_statistics(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float):
    """Scaling, class means, shrunk pooled covariance and priors from training moments.

    ``counts`` (2), ``sums`` (2 x F), ``squares`` (2 x F x F); means and covariance are of
    features standardised by the training mean and deviation.
    """
    n = counts.sum()
    center = sums.sum(axis=0) / n
    within_sq = squares - np.einsum("ki,kj->kij", sums, sums) / counts[:, None, None]
    spread = squares.sum(axis=0).diagonal() / n - center**2
    scale = np.sqrt(np.maximum(spread, 0.0))
    scale = np.where(scale <= FLOOR, 1.0, scale)
    means = (sums / counts[:, None] - center) / scale
    cov = within_sq.sum(axis=0) / np.outer(scale, scale) / max(1, n - 2)
    size = len(center)
    cov = (1 - shrinkage) * cov + shrinkage * np.eye(size) * np.trace(cov) / size
    return center, scale, means, cov, counts / n


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float):
    """Linear scores on raw features from training moments of two classes; the
    standardisation is folded into the weights."""
    center, scale, means, cov, priors = class_statistics(counts, sums, squares, shrinkage)
    precision = np.linalg.pinv(cov, hermitian=True)
    toward = means @ precision
    weights = toward / scale
    bias = np.log(np.maximum(priors, FLOOR)) - 0.5 * (toward * means).sum(axis=1) - weights @ center
    return center, scale, means, precision, weights, bias


def discriminant_batch(sums: pd.Series, counts: pd.Series, holdout: bool, shrinkage: pd.Series) -> pd.Series:
    """Models per fold from per-fold moment sums (1, features, products) of two classes."""
    names = ("center", "scale", "means", "precision", "weights", "bias")
    return _per_fold(sums, counts, holdout, shrinkage, names, discriminant)


def statistics_batch(sums: pd.Series, counts: pd.Series, holdout: bool, shrinkage: pd.Series) -> pd.Series:
    """What the models of :func:`discriminant_batch` are made from, per fold."""
    names = ("center", "scale", "means", "covariance", "priors")
    return _per_fold(sums, counts, holdout, shrinkage, names, class_statistics)


def _per_fold(sums, counts, holdout, shrinkage, names, fit) -> pd.Series:
    out = []
    for flat, n, ridge in zip(sums, counts, shrinkage, strict=True):
        folds = len(n) // 2
        total = np.reshape(flat, (2, folds, -1))
        if holdout:
            total, _ = training_sides(total, np.reshape(n, (2, folds)))
        f = int(np.sqrt(total.shape[2] - 1))
        models = []
        for fold in range(folds):
            m = total[:, fold]
            done = fit(m[:, 0], m[:, 1 : f + 1], m[:, f + 1 :].reshape(2, f, f), float(ridge))
            models.append({name: np.ravel(value).tolist() for name, value in zip(names, done, strict=True)})
        out.append(models)
    return pd.Series(out)
