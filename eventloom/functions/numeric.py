"""Guarded arithmetic and statistics as columns. NaN is mapped to NULL on ingest, so
aggregates skip it; divisions by zero give NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def known(x) -> Column:
    """NaN and infinities as NULL."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < math.inf), x)


def corr_pop(x, y) -> Column:
    """Pearson correlation, NULL without variance (the built-in raises)."""
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def fisher_z(r, edge: float = 1e-6) -> Column:
    """atanh of a correlation kept inside (-1, 1)."""
    r = F.col(r) if isinstance(r, str) else r
    return F.atanh(F.greatest(F.least(r, F.lit(1 - edge)), F.lit(edge - 1)))


def median(x) -> Column:
    return F.percentile(x, F.lit(0.5))


def choose2(n) -> Column:
    """Number of pairs among n."""
    n = F.col(n) if isinstance(n, str) else n
    return n * (n - 1) / 2.0


def gaussian_nll(x, mu, var) -> Column:
    return 0.5 * ((x - mu) * (x - mu) / var + F.log(var))


def log_comb(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def epoch_ms(ts) -> Column:
    """Milliseconds from 2024-01-01 of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts})") / F.lit(1000.0)
