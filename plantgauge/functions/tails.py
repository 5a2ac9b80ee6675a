"""Tail probabilities, evaluated on already aggregated rows (Spark has no erf).

The bodies are closures, so executors need no copy of this package.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def _incomplete_beta():
    def fraction(a, b, x):
        # continued fraction of the incomplete beta function
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400 + int(5 * (a + b) ** 0.5)):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    def regular(a, b, x):
        """The share of the beta function of a and b below x."""
        import math

        if x >= 1.0:
            return 1.0
        if x <= 0.0:
            return 0.0
        front = math.exp(
            math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        )
        if x < (a + 1.0) / (a + b + 2.0):
            return min(1.0, front * fraction(a, b, x) / a)
        return min(1.0, max(0.0, 1.0 - front * fraction(b, a, 1.0 - x) / b))

    return regular


def _t_tail():
    beta = _incomplete_beta()

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        import math

        def two_sided(t, nu):
            if t is None or nu is None or t != t or nu != nu or nu <= 0:
                return 1.0
            if math.isinf(t):
                return 0.0
            return beta(nu / 2.0, 0.5, nu / (nu + t * t))

        return pd.Series([two_sided(a, b) for a, b in zip(t, df)], dtype="float64")

    return tail


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t; an infinite t gives 0, a null one 1."""
    return _t_tail()(t, df.cast("double"))


def _f_tail():
    beta = _incomplete_beta()

    @F.pandas_udf("double")
    def tail(f: pd.Series, above: pd.Series, below: pd.Series) -> pd.Series:
        import math

        def upper(f, p, q):
            if f != f or p != p or q != q or p <= 0 or q <= 0 or f <= 0:
                return 1.0
            return 0.0 if math.isinf(f) else beta(q / 2.0, p / 2.0, q / (q + p * f))

        return pd.Series([upper(*r) for r in zip(f, above, below)], dtype="float64")

    return tail


def f_upper(f: Column, above: Column, below: Column) -> Column:
    """P(F >= f) with (above, below) degrees of freedom; 1 where f or a degree is missing."""
    return _f_tail()(*[c.cast("double") for c in (f, above, below)])


def _gamma_tail():
    @F.pandas_udf("double")
    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        import math

        def upper(x, dof):
            """The share of the gamma function of dof / 2 above x / 2: a series below its
            mean, else a continued fraction."""
            if x != x or dof != dof or dof <= 0 or x <= 0:
                return 1.0
            if math.isinf(x):
                return 0.0
            a, z = dof / 2.0, x / 2.0
            front = math.exp(a * math.log(z) - z - math.lgamma(a))
            steps = 400 + int(20 * a**0.5)
            if z < a + 1.0:
                term = total = 1.0 / a
                for m in range(1, steps):
                    term *= z / (a + m)
                    total += term
                    if term < total * 1e-16:
                        break
                return min(1.0, max(0.0, 1.0 - front * total))
            tiny = 1e-300
            b = z + 1.0 - a
            c, d = 1.0 / tiny, 1.0 / b
            h = d
            for m in range(1, steps):
                num = -m * (m - a)
                b += 2.0
                d = num * d + b
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = b + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
                if abs(d * c - 1.0) < 1e-15:
                    break
            return min(1.0, front * h)

        return pd.Series([upper(*r) for r in zip(x, dof)], dtype="float64")

    return tail


def chi2_upper(x: Column, dof: Column) -> Column:
    """P(chi-square >= x); 1 where x or the degrees of freedom are missing or 0."""
    return _gamma_tail()(x.cast("double"), dof.cast("double"))


def kolmogorov_upper(gap: Column, n_a: Column, n_b: Column, terms: int = 60) -> Column:
    """Asymptotic P(D >= gap) for two samples of these sizes, with the usual correction for
    small ones. Both forms of the series are added up in the engine: the alternating one
    converges fast above lambda = 1.18, the other one below."""
    n = F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    lam = (n + 0.12 + 0.11 / n) * gap
    steps = F.sequence(F.lit(1), F.lit(terms))

    def series(term):
        return F.aggregate(F.transform(steps, term), F.lit(0.0), lambda a, b: a + b)

    far = series(lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * lam * lam * j * j))
    odd = series(lambda j: F.exp(-((2 * j - 1) * (2 * j - 1)) * (math.pi**2 / 8.0) / (lam * lam)))
    near = 1.0 - math.sqrt(2.0 * math.pi) / lam * odd
    p = F.when(lam <= 0, 1.0).when(lam < 1.18, near).otherwise(far)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def _u_tail():
    @F.pandas_udf("double")
    def tail(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        import math

        import numpy as np

        def exact(u, n1, n2):
            # the chance of each U: a product of (1-q^(n+i))/(1-q^i) over the smaller side,
            # each step scaled by the number of its cases, so that sums stay near one
            m, n = min(n1, n2), max(n1, n2)
            share = np.zeros(m * n + 1)
            share[0] = 1.0
            for i in range(1, m + 1):
                step = n + i
                if step <= m * n:
                    share[step:] = share[step:] - share[:-step].copy()
                for r in range(i):
                    share[r::i] = np.cumsum(share[r::i])
                share *= i / (n + i)
            upper = share[int(math.ceil(u)):].sum()
            return min(1.0, max(0.0, 2.0 * upper))

        def two_sided(u, n1, n2, ties):
            if u != u or n1 < 2 or n2 < 2:
                return 1.0
            n1, n2 = int(n1), int(n2)
            high = max(u, n1 * n2 - u)
            if ties == 0 and min(n1, n2) <= 8:
                return exact(high, n1, n2)
            n = n1 + n2
            var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
            if var <= 0:
                return 1.0
            z = (high - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
            return min(1.0, math.erfc(z / math.sqrt(2.0)))

        return pd.Series([two_sided(*r) for r in zip(u, n1, n2, ties)], dtype="float64")

    return tail


def u_two_sided(u: Column, n1: Column, n2: Column, tie_term: Column) -> Column:
    """Two-sided Mann-Whitney p: exact for a small untied side, else the normal
    approximation with tie and continuity correction. ``tie_term`` = sum(t^3-t)."""
    return _u_tail()(*[c.cast("double") for c in (u, n1, n2, tie_term)])
