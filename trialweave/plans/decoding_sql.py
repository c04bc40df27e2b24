"""SQL of the decoding jobs for two channels, to check them by value.

With two channels the spatial filters and the classifier have closed forms, so one
chain of common table expressions states the whole evaluation.  The filter enters as
its matrix, formed by the kernel whose response the tests check on its own.
"""

from __future__ import annotations

from trialweave.functions import kernels

SAMPLES, SFREQ = 32, 128.0
# Balance of two-class scores and metrics over (subject, pipeline, fold).
FLOOR = "1e-12"


def _matrix(low: float, high: float) -> str:
    m = kernels.zero_phase_matrix(SAMPLES, SFREQ, low, high)
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row.tolist()) + "]" for row in m) + "]"


def bands_cte(bands) -> str:
    rows = ", ".join(f"('{int(lo)}-{int(hi)}', {_matrix(lo, hi)})" for lo, hi in bands)
    return f"fm(band, mat) AS (VALUES {rows})"


def predictions_ctes(source: str, pairs: str, p: str = "") -> str:
    """CTEs up to ``{p}pr``: subject_id, family, band, held, trial_id, label, said.

    ``source`` names trials (trial_id, subject_id, label, x0, x1); ``pairs`` names
    (trial_id, held, is_train).
    """
    shape = "subject_id, band, family, held"
    return f"""
    {p}fl AS (SELECT trial_id, subject_id, label, band, list_transform(mat, lambda w: list_dot_product(w, x0)) AS y0, list_transform(mat, lambda w: list_dot_product(w, x1)) AS y1 FROM {source}, fm),
    {p}cv AS (SELECT trial_id, subject_id, label, band, list_var_pop(y0) * {SAMPLES} AS c00, list_var_pop(y1) * {SAMPLES} AS c11, list_dot_product(y0, y1) - {SAMPLES} * list_avg(y0) * list_avg(y1) AS c01 FROM {p}fl),
    {p}tv AS (SELECT c.*, held, is_train FROM {p}cv c JOIN {pairs} USING (trial_id)),
    {p}cm AS (SELECT subject_id, band, held, label, avg(c00 / greatest(c00 + c11, 2.220446049250313e-16)) AS m00, avg(c01 / greatest(c00 + c11, 2.220446049250313e-16)) AS m01, avg(c11 / greatest(c00 + c11, 2.220446049250313e-16)) AS m11 FROM {p}tv WHERE is_train GROUP BY ALL),
    {p}pq AS (SELECT a.subject_id, a.band, a.held, a.m00 + 1e-8 AS q00, a.m01 AS q01, a.m11 + 1e-8 AS q11, a.m00 + b.m00 + 1e-8 AS p00, a.m01 + b.m01 AS p01, a.m11 + b.m11 + 1e-8 AS p11 FROM {p}cm a JOIN {p}cm b ON a.subject_id = b.subject_id AND a.band = b.band AND a.held = b.held AND a.label = 'a' AND b.label = 'b'),
    {p}qd AS (SELECT *, p00 * p11 - p01 * p01 AS ka, -(q00 * p11 + q11 * p00 - 2 * q01 * p01) AS kb, q00 * q11 - q01 * q01 AS kc FROM {p}pq),
    {p}lm AS (SELECT *, (-kb - sqrt(kb * kb - 4 * ka * kc)) / (2 * ka) AS l0, (-kb + sqrt(kb * kb - 4 * ka * kc)) / (2 * ka) AS l1 FROM {p}qd),
    {p}ev AS (SELECT subject_id, band, held, p00, p01, p11, -(q01 - l0 * p01) AS u0, q00 - l0 * p00 AS u1, -(q01 - l1 * p01) AS v0, q00 - l1 * p00 AS v1 FROM {p}lm),
    {p}en AS (SELECT *, u0 * u0 * p00 + 2 * u0 * u1 * p01 + u1 * u1 * p11 AS un, v0 * v0 * p00 + 2 * v0 * v1 * p01 + v1 * v1 * p11 AS vn FROM {p}ev),
    {p}sp AS (SELECT t.*, (u0 * u0 * c00 + 2 * u0 * u1 * c01 + u1 * u1 * c11) / un AS s0, (v0 * v0 * c00 + 2 * v0 * v1 * c01 + v1 * v1 * c11) / vn AS s1 FROM {p}tv t JOIN {p}en e ON t.subject_id = e.subject_id AND t.band = e.band AND t.held = e.held),
    {p}fe AS (SELECT trial_id, subject_id, label, band, held, is_train, 'bandpower_lda' AS family, ln(c00 / {SAMPLES} + {FLOOR}) AS f0, ln(c11 / {SAMPLES} + {FLOOR}) AS f1 FROM {p}tv
      UNION ALL SELECT trial_id, subject_id, label, band, held, is_train, 'csp_lda', ln(s0 / (s0 + s1) + {FLOOR}), ln(s1 / (s0 + s1) + {FLOOR}) FROM {p}sp),
    {p}st AS (SELECT {shape}, avg(f0) AS g0, avg(f1) AS g1, stddev_pop(f0) AS d0, stddev_pop(f1) AS d1, count(*) AS n FROM {p}fe WHERE is_train GROUP BY ALL),
    {p}z AS (SELECT f.*, n, (f0 - g0) / CASE WHEN d0 <= {FLOOR} THEN 1 ELSE d0 END AS z0, (f1 - g1) / CASE WHEN d1 <= {FLOOR} THEN 1 ELSE d1 END AS z1 FROM {p}fe f JOIN {p}st s ON f.subject_id = s.subject_id AND f.band = s.band AND f.family = s.family AND f.held = s.held),
    {p}mu AS (SELECT {shape}, label, avg(z0) AS m0, avg(z1) AS m1, count(*) / max(n) AS prior FROM {p}z WHERE is_train GROUP BY ALL),
    {p}rs AS (SELECT z.subject_id, z.band, z.family, z.held, max(n) AS n, sum((z0 - m0) ** 2) AS r00, sum((z0 - m0) * (z1 - m1)) AS r01, sum((z1 - m1) ** 2) AS r11 FROM {p}z z JOIN {p}mu m ON z.subject_id = m.subject_id AND z.band = m.band AND z.family = m.family AND z.held = m.held AND z.label = m.label WHERE is_train GROUP BY ALL),
    {p}sc AS (SELECT {shape}, (0.9 * r00 + 0.05 * (r00 + r11)) / (n - 2) AS k00, 0.9 * r01 / (n - 2) AS k01, (0.9 * r11 + 0.05 * (r00 + r11)) / (n - 2) AS k11 FROM {p}rs),
    {p}iv AS (SELECT {shape}, k11 / (k00 * k11 - k01 * k01) AS i00, -k01 / (k00 * k11 - k01 * k01) AS i01, k00 / (k00 * k11 - k01 * k01) AS i11 FROM {p}sc),
    {p}ws AS (SELECT m.subject_id, m.band, m.family, m.held, m.label AS cls, i00 * m0 + i01 * m1 AS w0, i01 * m0 + i11 * m1 AS w1, -0.5 * (m0 * (i00 * m0 + i01 * m1) + m1 * (i01 * m0 + i11 * m1)) + ln(greatest(prior, {FLOOR})) AS b FROM {p}mu m JOIN {p}iv i ON m.subject_id = i.subject_id AND m.band = i.band AND m.family = i.family AND m.held = i.held),
    {p}pr AS (SELECT z.subject_id, z.family, z.band, z.held, z.trial_id, z.label, CASE WHEN z0 * y.w0 + z1 * y.w1 + y.b > z0 * x.w0 + z1 * x.w1 + x.b THEN 'b' ELSE 'a' END AS said FROM {p}z z
      JOIN {p}ws x ON z.subject_id = x.subject_id AND z.band = x.band AND z.family = x.family AND z.held = x.held AND x.cls = 'a'
      JOIN {p}ws y ON z.subject_id = y.subject_id AND z.band = y.band AND z.family = y.family AND z.held = y.held AND y.cls = 'b' WHERE NOT is_train)"""


def metrics_sql(source: str, keys: str) -> str:
    """Metrics per key of rows with label and said (two labels)."""
    return f"""
    SELECT {keys}, count(*)::BIGINT AS trials, round(avg((label = said)::INT), 9) AS accuracy,
      round((coalesce(avg(CASE WHEN label = 'a' THEN (said = 'a')::INT END), 0) + coalesce(avg(CASE WHEN label = 'b' THEN (said = 'b')::INT END), 0)) / ((count(*) FILTER (label = 'a') > 0)::INT + (count(*) FILTER (label = 'b') > 0)::INT), 9) AS balanced_accuracy,
      round((avg((label = said)::INT) - (avg((label = 'a')::INT) * avg((said = 'a')::INT) + avg((label = 'b')::INT) * avg((said = 'b')::INT))) / (1 - (avg((label = 'a')::INT) * avg((said = 'a')::INT) + avg((label = 'b')::INT) * avg((said = 'b')::INT))), 9) AS kappa
    FROM {source} GROUP BY ALL"""
