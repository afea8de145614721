"""Theory that needs sums, special functions or searches over numbers, in numpy."""

from __future__ import annotations

import cmath
import math

import numpy as np

#: Coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(z: complex) -> complex:
    """The gamma function of a complex number."""
    if z.real < 0.5:
        return cmath.pi / (cmath.sin(cmath.pi * z) * gamma(1 - z))
    z -= 1
    total = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return cmath.sqrt(2 * cmath.pi) * cmath.exp((z + 0.5) * cmath.log(t) - t) * total


def _coefficients(b: float, r: float) -> list[complex]:
    """gamma(r - 2 pi i l / ln b) for l = 1, 2, ... until it no longer counts."""
    found, l = [], 1
    while True:
        value = gamma(complex(r, -2 * math.pi * l / math.log(b)))
        if abs(value) < 1e-18:
            return found or [value]
        found.append(value)
        l += 1


def xi_squared_error(x: np.ndarray, b: float, r: float) -> np.ndarray:
    """Squared periodic part of the xi function, by its Fourier series."""
    total = sum((g * np.exp(2j * np.pi * l * np.asarray(x)) for l, g in enumerate(_coefficients(b, r), 1)), np.zeros(np.shape(x), complex))
    return (2 / math.gamma(r) * total.real) ** 2


def zeta_squared_error(x1: np.ndarray, x2: np.ndarray, b: float) -> np.ndarray:
    """Squared relative periodic part of the zeta function."""
    x1, x2 = np.asarray(x1, float), np.asarray(x2, float)
    total = np.zeros(np.broadcast(x1, x2).shape, complex)
    for l, g in enumerate(_coefficients(b, 1.0), 1):
        total += g * np.exp(1j * np.pi * l * (x1 + x2)) * np.sinc(l * (x1 - x2))
    return total.real**2


def max_amplitude_xi(b: float, r: float, points: int = 4001) -> float:
    return math.sqrt(float(xi_squared_error(np.linspace(0, 1, points), b, r).max()))


def max_amplitude_zeta(b: float, points: int = 301) -> float:
    x = np.linspace(0, 1, points)
    return math.sqrt(float(zeta_squared_error(x[:, None], x[None, :], b).max()))


def upper_bound_mse(j: float, m: int, b: float) -> float:
    """Mean squared error of the upper Jaccard bound, summed over binomial counts of equal registers."""
    p = math.log1p(j * (b - 1) + (1 - j) ** 2 * (b - 1) ** 2 / (4 * b)) / math.log(b)
    total = 0.0
    for c in range(m + 1):
        log_pmf = math.lgamma(m + 1) - math.lgamma(c + 1) - math.lgamma(m - c + 1)
        log_pmf += (c * math.log(p) if c else 0.0) + ((m - c) * math.log1p(-p) if m - c else 0.0)
        total += math.exp(log_pmf) * ((b ** (c / m) - 1) / (b - 1) - j) ** 2
    return total
