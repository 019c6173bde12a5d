"""Null-model penalties that follow from the number of observations. All are numbers, made once on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

_NORMAL = NormalDist()


def _gamma_share(a: float, x: float) -> tuple[float, float]:
    """The regularised lower and upper incomplete gamma functions: by their series, or by the continued fraction."""
    if x <= 0:
        return 0.0, 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * front, 1 - total * front
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h, front * h


def chi_square_critical(alpha: float, df: int = 1) -> float:
    """The value that a chi-square of ``df`` degrees of freedom exceeds with probability ``alpha``."""
    if df == 1:
        return _NORMAL.inv_cdf(1 - alpha / 2) ** 2 if alpha > 1e-12 else _NORMAL.inv_cdf(alpha / 2) ** 2
    return _bisect(lambda x: alpha - _gamma_share(df / 2, x / 2)[1], 0.0, df + 100.0 + 20 * math.sqrt(df) - 4 * math.log(alpha))


def power_of(n: float, w: float, alpha: float, df: int = 1) -> float:
    """The probability that a non-central chi-square (n w^2, ``df`` degrees of freedom) exceeds the critical value."""
    if df == 1:
        k, shift = math.sqrt(chi_square_critical(alpha)), math.sqrt(n) * w
        return 1 - (_NORMAL.cdf(k - shift) - _NORMAL.cdf(-k - shift))
    # a mixture of central ones, weighed by Poisson probabilities
    half, critical = n * w * w / 2, chi_square_critical(alpha, df)
    spread = int(12 * math.sqrt(half) + 40)
    terms = range(max(0, int(half) - spread), int(half) + spread)
    return math.fsum(math.exp(j * math.log(half) - half - math.lgamma(j + 1) if half else (0.0 if j == 0 else -math.inf)) * _gamma_share(df / 2 + j, critical / 2)[1] for j in terms)


def _bisect(f, low: float, high: float, steps: int = 200) -> float:
    if f(low) * f(high) > 0:
        raise ValueError("no root in the interval")
    rising = f(low) < f(high)
    for _ in range(steps):
        mid = (low + high) / 2
        if (f(mid) < 0) == rising:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def solve_alpha(n: float, w: float, power: float, df: int = 1) -> float:
    """The significance level at which effect ``w`` is found with ``power`` among ``n``."""
    return math.exp(_bisect(lambda a: power_of(n, w, math.exp(a), df) - power, math.log(1e-10), math.log(1 - 1e-10)))


def solve_w(n: float, alpha: float, power: float, df: int = 1) -> float:
    """The effect that is found with ``power`` at level ``alpha`` among ``n``."""
    return _bisect(lambda w: power_of(n, w, alpha, df) - power, 0.0, 10.0)


def chi_penalty(n: float, alpha: float = 0.05, df: int = 1) -> float:
    return chi_square_critical(alpha, df) / n


def fisher_penalty(n: float) -> float:
    return math.tanh(1.96 / math.sqrt(n - 3)) ** 2


def power_penalty(n: float, w: float, power: float, df: int = 1) -> float:
    return chi_square_critical(solve_alpha(n, w, power, df), df) / n


def theta(individuals: int, kind: str = "single") -> float:
    """The mutation parameter: 1 / (2N + 1), or with ``harmonic`` the sum of 1/i up to 2N - 1 in the place of 1."""
    haplotypes = 2 * individuals
    total = sum(1 / i for i in range(1, haplotypes)) if kind == "harmonic" else 1.0
    return (1 / total) / (haplotypes + 1 / total)
