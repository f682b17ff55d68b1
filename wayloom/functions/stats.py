"""Small numeric helpers applied to one summary row per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided_p(t: float, df: float) -> float | None:
    if t is None or df is None or np.isnan(t) or np.isnan(df) or df <= 0:
        return None
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return pd.Series([two_sided_p(a, b) for a, b in zip(t, df)], dtype="float64")


def pooled_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> tuple[Column, Column, Column]:
    """(t, degrees of freedom, pooled deviation) of the difference of the first mean from the second."""
    df = n1 + n2 - 2
    sd = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(df, F.lit(0)))
    return (m1 - m2) / F.nullif(sd * F.sqrt(F.lit(1.0) / n1 + F.lit(1.0) / n2), F.lit(0.0)), df, sd


@F.pandas_udf(ArrayType(DoubleType()))
def partial_autocorrelation(acf: pd.Series) -> pd.Series:
    """Durbin-Levinson recursion over the autocorrelations of lags 0..k."""
    def one(r):
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            num = r[k] - (phi @ r[k - 1 : 0 : -1] if k > 1 else 0.0)
            den = 1.0 - (phi @ r[1:k] if k > 1 else 0.0)
            last = num / den if den else 0.0
            phi = np.append(phi - last * phi[::-1], last)
            out.append(float(last))
        return out

    return pd.Series([one(np.asarray(a, dtype=float)) for a in acf])


@F.pandas_udf(StructType().add("coefficient", DoubleType()).add("std_error", DoubleType()))
def regression_term(gram: pd.Series, cross: pd.Series, yy: pd.Series, n: pd.Series, index: pd.Series) -> pd.DataFrame:
    """One coefficient and its standard error from the sums X'X (row-major), X'y and y'y."""
    rows = []
    for g, c, s, m, i in zip(gram, cross, yy, n, index):
        c = np.asarray(c, dtype=float)
        k = len(c)
        try:
            inverse = np.linalg.inv(np.asarray(g, dtype=float).reshape(k, k))
        except np.linalg.LinAlgError:
            rows.append((None, None))
            continue
        beta = inverse @ c
        sigma2 = (s - beta @ c) / (m - k) if m > k else np.nan
        rows.append((beta[i], math.sqrt(max(sigma2 * inverse[i, i], 0.0))))
    return pd.DataFrame(rows, columns=["coefficient", "std_error"])


def replicate_draw(seed: int, replicate: Column, draw: Column, size: Column) -> Column:
    """0-based index of one draw of one bootstrap replicate: a hash, the same on every run and machine."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), draw.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), size)
