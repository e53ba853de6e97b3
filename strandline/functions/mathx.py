"""Log-space and Phred arithmetic as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG10_THIRD = -math.log10(3.0)
LOG10_2 = math.log10(2.0)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def phred_to_prob(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def prob_to_phred(p: Column) -> Column:
    return F.lit(-10.0) * F.log10(p)


def log10_error(q: Column) -> Column:
    return q.cast("double") / F.lit(-10.0)


def log10_correct(q: Column) -> Column:
    """log10(1 - 10^(-q/10)); minus infinity at q = 0."""
    return F.when(q <= 0, F.lit(float("-inf"))).otherwise(F.log10(F.lit(1.0) - phred_to_prob(q)))


def log10_one_minus_pow10(x: Column) -> Column:
    """log10(1 - 10^x) for x <= 0."""
    return F.when(x >= 0, F.lit(float("-inf"))).otherwise(F.log10(F.lit(1.0) - F.pow(F.lit(10.0), x)))


def log10_sum(values: Column) -> Column:
    """log10 of a sum of powers over an array, shifted by its maximum; minus infinity when empty."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top))
    return (
        F.when(F.size(values) == 0, F.lit(float("-inf")))
        .when(top == float("-inf"), top)
        .otherwise(top + F.log10(total))
    )


def log10_sum_pair(a: Column, b: Column) -> Column:
    """log10(10^a + 10^b) on a 0.0001 grid of the difference; past 8 the larger one stands."""
    big, small = F.greatest(a, b), F.least(a, b)
    diff = big - small
    grid = F.floor(diff * 10000.0 + 0.5) / 10000.0
    near = big + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), -grid))
    return F.when(small == float("-inf"), big).when(diff < 8.0, near).otherwise(big)


def normal_density(x: Column, mean: float, sd: float) -> Column:
    z = x - mean
    return F.exp(-(z * z) / (2.0 * sd * sd)) / (sd * math.sqrt(2.0 * math.pi))


def log_factorials(n: int) -> list[float]:
    return [math.lgamma(i + 1) for i in range(n + 1)]


def log_factorial_array(n: int) -> Column:
    return F.array(*[F.lit(x) for x in log_factorials(n)])


def binomial_coefficient(n: Column, k: Column) -> Column:
    """Exact BIGINT product while it fits; n up to about 60."""
    m = F.least(k, n - k)
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(
        F.when(m == 0, F.lit(1).cast("long")).otherwise(
            F.aggregate(
                F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long")),
                F.lit(1).cast("long"),
                lambda a, i: F.floor(a * (n - m + i) / i).cast("long"),
            )
        )
    )


def kahan_free_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.try_element_at(s, mid + 1).cast("double")).otherwise(
        (F.try_element_at(s, F.greatest(mid, F.lit(1))) + F.try_element_at(s, mid + 1)) / 2.0
    )


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ln_gamma(x: Column) -> Column:
    """Stirling series at x + 10, brought back by the recurrence; near 1e-14 relative for x > 0.

    The shift is fixed, so the expression stays linear in size.
    """
    x = x.cast("double")
    y = x + 10.0
    z = F.lit(1.0) / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z * (1.0 / 1680 - z / 1188)))) / y
    product = x
    for i in range(1, 10):
        product = product * (x + float(i))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def ln_binomial(n: Column, k: Column) -> Column:
    return ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)


def digamma(x: Column) -> Column:
    """Asymptotic series at x + 6, brought back by the recurrence; about 1e-9 for x > 0."""
    x = x.cast("double")
    y = x + 6.0
    z = F.lit(1.0) / (y * y)
    back = F.lit(1.0) / x
    for i in range(1, 6):
        back = back + F.lit(1.0) / (x + float(i))
    return F.ln(y) - 0.5 / y - z * (1.0 / 12 - z * (1.0 / 120 - z * (1.0 / 252 - z * (1.0 / 240 - z / 132)))) - back
