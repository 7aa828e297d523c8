"""Tail probabilities for a handful of test statistics, as plain numbers."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) for chi-square, by the series or continued fraction of the gamma."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    scale = exp(a * log(z) - z - lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * scale)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d)
            c = 1 + step / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(X > f) for the F distribution."""
    return 1.0 if f <= 0 else beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


# MacKinnon (1994) response surface for the Dickey-Fuller tau
# with a constant, one variable.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALL = [2.1659, 1.4412, 0.038269]
TAU_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]


def dickey_fuller_p(tau: float) -> float:
    """Approximate p-value of an augmented Dickey-Fuller statistic."""
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    terms = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    z = sum(c * tau**i for i, c in enumerate(terms))
    return erfc(-z / sqrt(2)) / 2
