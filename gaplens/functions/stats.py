"""Statistics over small tables and summaries that Spark has aggregated."""

from __future__ import annotations

import math

import numpy as np

from .tails import chi2_sf, t_quantile, t_two_sided

ALPHA = 0.05


def chi2_independence(table: list[list[float]]) -> dict | None:
    """Chi-squared test of independence, with Yates' correction at one degree of freedom; None below 2 x 2."""
    t = np.array(table, float)
    if t.ndim == 2:
        t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    if t.ndim != 2 or min(t.shape) < 2:
        return None
    expected = t.sum(axis=1, keepdims=True) * t.sum(axis=0, keepdims=True) / t.sum()
    df = (t.shape[0] - 1) * (t.shape[1] - 1)
    gap = np.abs(t - expected)
    if df == 1:
        gap = gap - np.minimum(0.5, gap)
    stat = float((gap**2 / expected).sum())
    return {"statistic": stat, "df": df, "p_value": chi2_sf(stat, df)}


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation over n pairs."""
    if n <= 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def pool_rubin(estimates: list[float], variances: list[float], alpha: float = ALPHA) -> dict:
    """Rubin's rules over m completed analyses."""
    m = len(estimates)
    if m == 0 or m != len(variances):
        raise ValueError("as many estimates as variances are needed, and at least one")
    q, u = float(np.mean(estimates)), float(np.mean(variances))
    b = float(np.var(estimates, ddof=1)) if m > 1 else 0.0
    total = u + (1 + 1 / m) * b
    r = (1 + 1 / m) * b / u if u > 0 else (math.inf if b > 0 else 0.0)
    df, fmi = math.inf, 0.0
    if m > 1 and 0 < r < math.inf:
        df = (m - 1) * (1 + 1 / r) ** 2
        fmi = (r + 2 / (df + 3)) / (r + 1)
    se = math.sqrt(total)
    width = (1.96 if df >= 1000 else t_quantile(1 - alpha / 2, df)) * se
    finite = lambda x: None if math.isinf(x) else x
    return {
        "m": m, "pooled_estimate": q, "within_variance": u, "between_variance": b, "total_variance": total, "std_error": se,
        "df": finite(df), "relative_increase_variance": finite(r), "fraction_missing_information": fmi, "ci_95": [q - width, q + width],
    }


def em_normal(patterns: list[tuple[tuple[bool, ...], int, np.ndarray, np.ndarray]], rounds: int = 100, tol: float = 1e-5, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a normal with missing values, by EM over missingness patterns.

    A pattern is (observed flags, rows, sums of the observed columns, their cross-products).
    Rows without an observed value add only their count.
    """
    p = len(patterns[0][0])
    n = sum(k for _, k, _, _ in patterns)
    count, total = np.zeros(p), np.zeros(p)
    for obs, k, s, _ in patterns:
        o = np.array(obs)
        count[o] += k
        total[o] += s
    mu = np.divide(total, count, out=np.zeros(p), where=count > 0)
    # start: covariance of the mean-filled rows
    sigma = np.zeros((p, p))
    for obs, k, s, c in patterns:
        o = np.flatnonzero(obs)
        d = c - np.outer(mu[o], s) - np.outer(s, mu[o]) + k * np.outer(mu[o], mu[o])
        sigma[np.ix_(o, o)] += d
    sigma = sigma / max(1, n - 1) + ridge * np.eye(p)
    for _ in range(rounds):
        t1, t2 = np.zeros(p), np.zeros((p, p))
        for obs, k, s, c in patterns:
            o, h = np.flatnonzero(obs), np.flatnonzero(~np.array(obs))
            b = sigma[np.ix_(h, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)]) if len(o) else np.zeros((len(h), 0))
            shift = mu[h] - b @ mu[o]  # E[hidden | observed] = shift + b x
            t1[o] += s
            t1[h] += k * shift + b @ s
            cross = np.outer(s, shift) + c @ b.T
            t2[np.ix_(o, o)] += c
            t2[np.ix_(o, h)] += cross
            t2[np.ix_(h, o)] += cross.T
            rest = sigma[np.ix_(h, h)] - b @ sigma[np.ix_(o, h)]
            bs = b @ s
            t2[np.ix_(h, h)] += k * (rest + np.outer(shift, shift)) + np.outer(shift, bs) + np.outer(bs, shift) + b @ c @ b.T
        new = t1 / n
        sigma = t2 / n - np.outer(new, new) + ridge * np.eye(p)
        moved = np.abs(new - mu).max()
        mu = new
        if moved < tol:
            break
    return mu, sigma


def little_mcar(patterns: list[tuple[tuple[bool, ...], int, np.ndarray, np.ndarray]]) -> dict:
    """Little's test of MCAR over missingness patterns."""
    p = len(patterns[0][0]) if patterns else 0
    n = sum(k for _, k, _, _ in patterns)
    if p < 2 or n < 20 or all(all(obs) for obs, *_ in patterns):
        return {"applicable": False, "reason": "needs two numeric columns, a missing value and 20 rows"}
    mu, sigma = em_normal(patterns)
    stat, df = 0.0, -p
    for obs, k, s, _ in patterns:
        o = np.flatnonzero(obs)
        if not len(o):
            continue
        gap = s / k - mu[o]
        stat += k * float(gap @ np.linalg.pinv(sigma[np.ix_(o, o)]) @ gap)
        df += len(o)
    if df <= 0:
        return {"applicable": False, "reason": "no degrees of freedom"}
    pv = chi2_sf(stat, df)
    return {"applicable": True, "statistic": stat, "df": df, "p_value": pv, "n_numeric_cols": p, "n_patterns": len(patterns), "interpretation": "MCAR is rejected" if pv < ALPHA else "no evidence against MCAR"}


def bayesian_ridge(gram: np.ndarray, xty: np.ndarray, yty: float, n: float, x_mean: np.ndarray, y_mean: float, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6):
    """Evidence maximisation from centred sums: (coefficients, intercept, noise precision, covariance of the coefficients)."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values = np.clip(values, 0, None)
    turned = vectors.T @ xty
    alpha, lam = 1 / (yty / max(n, 1) + 1e-12), 1.0
    coef = old = np.zeros(len(xty))
    for k in range(rounds):
        coef = vectors @ (turned / (values + lam / alpha))
        rss = max(yty - 2 * coef @ xty + coef @ gram @ coef, 0.0)
        gamma = float((alpha * values / (lam + alpha * values)).sum())
        lam = (gamma + 2 * prior) / (coef @ coef + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (rss + 2 * prior)
        if k and np.abs(coef - old).sum() < tol:
            break
        old = coef
    coef = vectors @ (turned / (values + lam / alpha))
    cov = vectors @ np.diag(1 / (lam + alpha * values)) @ vectors.T
    return coef, y_mean - float(x_mean @ coef), alpha, cov
