"""Numeric kernels against first principles."""

import numpy as np
import pandas as pd
import pytest

from trialweave.functions import kernels


def response(sections, hz, sfreq):
    z = np.exp(2j * np.pi * hz / sfreq)
    total = 1.0
    for b0, b1, b2, a1, a2 in sections:
        total = total * (b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)
    return abs(total)


@pytest.mark.parametrize("band", [(4.0, 40.0), (8.0, 13.0), (8.0, 30.0), (13.0, 30.0)])
def test_butterworth_response(band):
    sections = kernels.butterworth_sections(128.0, *band)
    # Half power at both edges, one at the (warped) centre, nothing at the ends.
    for edge in band:
        assert response(sections, edge, 128.0) == pytest.approx(np.sqrt(0.5), rel=1e-9)
    warped = np.tan(np.pi * np.array(band) / 128)
    centre = np.arctan(np.sqrt(warped.prod())) * 128 / np.pi
    assert response(sections, centre, 128.0) == pytest.approx(1.0, rel=1e-9)
    assert response(sections, 0.0, 128.0) < 1e-12
    assert response(sections, 63.99, 128.0) < 1e-6
    # Order four: far below the band the gain falls by 24 dB per octave.
    low = band[0] / 16
    assert response(sections, low, 128.0) / response(sections, low / 2, 128.0) == pytest.approx(16, rel=0.05)


def test_zero_phase_matrix_keeps_a_wave_in_place():
    n, sfreq = 512, 128.0
    t = np.arange(n) / sfreq
    wave = np.sin(2 * np.pi * 15.0 * t)
    out = kernels.zero_phase_matrix(n, sfreq, 8.0, 30.0) @ (wave + 3.0 + 0.5 * np.sin(2 * np.pi * 55 * t))
    middle = slice(100, 400)
    gain = response(kernels.butterworth_sections(sfreq, 8.0, 30.0), 15.0, sfreq) ** 2
    assert np.allclose(out[middle], gain * wave[middle], atol=5e-3)


def test_bandpass_batch_refuses():
    good = np.random.default_rng(0).normal(size=64)
    bad = good.copy()
    bad[5] = np.nan
    out = kernels.bandpass_batch(
        pd.Series([good, bad, good, good[:20]]),
        pd.Series([128.0, 128.0, 40.0, 128.0]),
        pd.Series([8.0] * 4),
        pd.Series([30.0] * 4),
    )
    assert out[0] is not None and len(out[0]) == 64
    assert out[1] is None and out[2] is None and out[3] is None


def naive_density(x, sfreq):
    x = x - x.mean()
    n = min(len(x), max(64, round(sfreq)))
    step = n - n // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    found = []
    for s in range(0, len(x) - n + 1, step):
        seg = x[s : s + n]
        seg = (seg - seg.mean()) * window
        k = np.arange(n // 2 + 1)[:, None]
        f = (seg * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum(axis=1)
        p = np.abs(f) ** 2 / (sfreq * (window**2).sum())
        p[1 : -1 if n % 2 == 0 else None] *= 2
        found.append(p)
    return np.mean(found, axis=0)


@pytest.mark.parametrize("n,sfreq", [(256, 128.0), (300, 100.0), (64, 64.0), (97, 65.0), (16, 64.0)])
def test_welch_segments(n, sfreq):
    x = np.random.default_rng(n).normal(size=(3, n))
    got = kernels.welch_density(x, sfreq)
    for row, p in zip(x, got, strict=True):
        assert np.allclose(p, naive_density(row, sfreq), rtol=1e-9)


def test_welch_power_of_a_sine():
    sfreq, n = 128.0, 1280
    wave = 1.5 * np.sin(2 * np.pi * 10.0 * np.arange(n) / sfreq)
    density = kernels.welch_density(wave[None, :], sfreq)[0]
    assert density.sum() * sfreq / 128 == pytest.approx(1.5**2 / 2, rel=1e-6)
    assert density.argmax() == 10


def test_spatial_filters_solve_the_pencil():
    rng = np.random.default_rng(2)
    a, b = (m @ m.T for m in rng.normal(size=(2, 6, 20)))
    a, b = a / np.trace(a), b / np.trace(b)
    w = kernels.spatial_filters(a, b, 4)
    ridge = 1e-8 * np.eye(6)
    values = np.linalg.eigvals(np.linalg.solve(a + b + ridge, a + ridge)).real
    values.sort()
    ratio = np.einsum("kc,cd,kd->k", w, a + ridge, w) / np.einsum("kc,cd,kd->k", w, a + b + ridge, w)
    assert np.allclose(ratio, [values[0], values[1], values[-2], values[-1]])


def test_discriminant_equals_direct_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [3, -7, 1]
    y = (rng.random(60) < 0.4).astype(int)
    x[y == 1] += [0.5, 2, 0.1]
    parts = [x[y == k] for k in (0, 1)]
    counts = np.array([len(p) for p in parts], dtype=float)
    sums = np.stack([p.sum(axis=0) for p in parts])
    squares = np.stack([p.T @ p for p in parts])
    *_, weights, bias = kernels.discriminant(counts, sums, squares, 0.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    means = np.stack([z[y == k].mean(axis=0) for k in (0, 1)])
    resid = np.concatenate([z[y == k] - means[k] for k in (0, 1)])
    cov = resid.T @ resid / (len(x) - 2)
    cov = 0.9 * cov + 0.1 * np.eye(3) * np.trace(cov) / 3
    inv = np.linalg.inv(cov)
    want = np.stack([z @ inv @ m - 0.5 * m @ inv @ m + np.log((y == k).mean()) for k, m in enumerate(means)], axis=1)
    got = x @ weights.T + bias
    # Scores may differ by a term common to both classes; differences decide.
    assert np.allclose(got[:, 1] - got[:, 0], want[:, 1] - want[:, 0])


def test_long_signals_need_no_matrix():
    """20,000 samples: equal to the recursion by its definition, and to the matrix form."""
    rng = np.random.default_rng(12)
    n, rate, low, high = 20_000, 250.0, 8.0, 30.0
    t = np.arange(n) / rate
    inside, outside = np.sin(2 * np.pi * 15 * t), np.sin(2 * np.pi * 60 * t)
    data = np.stack([inside, outside, inside + outside, rng.normal(size=n)])
    got = kernels.zero_phase(data, rate, low, high)
    core = slice(500, -500)
    assert np.allclose(got[0, core], inside[core], atol=0.02)
    assert np.abs(got[1, core]).max() < 0.02
    assert np.allclose(got[2], got[0] + got[1], atol=1e-9)
    short = rng.normal(size=(3, 2, 1024))
    by_matrix = kernels.zero_phase(short, rate, low, high)
    longer = kernels.MATRIX_SAMPLES
    try:
        kernels.MATRIX_SAMPLES = 100
        assert np.allclose(kernels.zero_phase(short, rate, low, high), by_matrix, atol=1e-9)
    finally:
        kernels.MATRIX_SAMPLES = longer
