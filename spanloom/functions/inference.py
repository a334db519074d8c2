"""Distribution tails and quantiles as column expressions.

Spark has no incomplete beta, normal quantile or error function. All are written
as expressions here, with series and continued fractions folded by ``aggregate``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Wichura's algorithm AS 241 (1988) for the normal quantile,
# numerator and denominator per region, constant term first.
CENTRAL = (
    (
        3.3871328727963666080,
        133.14166789178437745,
        1971.5909503065514427,
        13731.693765509461125,
        45921.953931549871457,
        67265.770927008700853,
        33430.575583588128105,
        2509.0809287301226727,
    ),
    (
        1.0,
        42.313330701600911252,
        687.18700749205790830,
        5394.1960214247511077,
        21213.794301586595867,
        39307.895800092710610,
        28729.085735721942674,
        5226.4952788528545610,
    ),
)
MIDDLE = (
    (
        1.42343711074968357734,
        4.63033784615654529590,
        5.76949722146069140550,
        3.64784832476320460504,
        1.27045825245236838258,
        0.241780725177450611770,
        0.0227238449892691845833,
        0.000774545014278341407640,
    ),
    (
        1.0,
        2.05319162663775882187,
        1.67638483018380384940,
        0.689767334985100004550,
        0.148103976427480074590,
        0.0151986665636164571966,
        0.000547593808499534494600,
        1.05075007164441684324e-9,
    ),
)
FAR = (
    (
        6.65790464350110377720,
        5.46378491116411436990,
        1.78482653991729133580,
        0.296560571828504891230,
        0.0265321895265761230930,
        0.00124266094738807843860,
        2.71155556874348757815e-5,
        2.01033439929228813265e-7,
    ),
    (
        1.0,
        0.599832206555887937690,
        0.136929880922735805310,
        0.0148753612908506148525,
        0.000786869131145613259100,
        1.84631831751005468180e-5,
        1.42151175831644588870e-7,
        2.04426310338993978564e-15,
    ),
)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner form, constant term first."""
    total = F.lit(coefficients[-1])
    for coefficient in reversed(coefficients[:-1]):
        total = total * x + F.lit(coefficient)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function, 0 < p < 1."""
    q = p - F.lit(0.5)
    inner = F.lit(0.180625) - q * q
    central = q * polynomial(inner, CENTRAL[0]) / polynomial(inner, CENTRAL[1])
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    middle = polynomial(r - 1.6, MIDDLE[0]) / polynomial(r - 1.6, MIDDLE[1])
    far = polynomial(r - 5.0, FAR[0]) / polynomial(r - 5.0, FAR[1])
    tail = F.when(r <= 5.0, middle).otherwise(far)
    return F.when(F.abs(q) <= 0.425, central).otherwise(F.signum(q) * tail)


#: Steps of the recurrence before Stirling's series is used.
SHIFTED = 20


def _log_gamma_step(a: Column) -> Column:
    """``ln(gamma(a + 1/2) / gamma(a))`` for a > 0.

    Stirling's series at ``a + SHIFTED``, brought down by the recurrence.
    """

    def stirling(z: Column) -> Column:
        z2 = z * z
        series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / z2) / z2) / z2) / z
        return (z - 0.5) * F.log(z) - z + series

    factors = F.sequence(F.lit(0), F.lit(SHIFTED - 1))
    down = F.aggregate(factors, F.lit(0.0), lambda acc, k: acc + F.log1p(F.lit(0.5) / (a + k)))
    top = a + F.lit(float(SHIFTED))
    return stirling(top + 0.5) - stirling(top) - down


def half_beta(a: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function of ``a > 0`` and 1/2 at ``0 < x < 1``.

    ``rest`` is ``1 - x``, given apart so that it keeps its digits. The continued
    fraction is evaluated by Lentz's method on the side where it converges fast;
    the number of terms follows the square root of ``a``.
    """
    half = F.lit(0.5)
    direct = x < (a + 1) / (a + 2.5)
    first, second = F.when(direct, a).otherwise(half), F.when(direct, half).otherwise(a)
    at = F.when(direct, x).otherwise(rest)

    def lentz(acc: Column, j: Column) -> Column:
        p, q, y, m = acc["p"], acc["q"], acc["y"], F.floor(j / 2)
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        term = F.when(j % 2 == 0, even).otherwise(odd)
        c, d = 1 + term / acc["c"], 1 / (1 + term * acc["d"])
        value = acc["value"] * c * d
        return F.struct(p.alias("p"), q.alias("q"), y.alias("y"), c.alias("c"), d.alias("d"), value.alias("value"))

    begin = 1 / (1 - (first + second) * at / (first + 1))
    start = F.struct(
        first.alias("p"), second.alias("q"), at.alias("y"), F.lit(1.0).alias("c"), begin.alias("d"), begin.alias("value")
    )
    terms = F.sequence(F.lit(2), (F.lit(200) + 8 * F.sqrt(a)).cast("int"))
    fraction = F.aggregate(terms, start, lentz)["value"]
    # 1 / beta(a, 1/2) = gamma(a + 1/2) / gamma(a) / sqrt(pi)
    log_front = a * F.log(x) + 0.5 * F.log(rest) + _log_gamma_step(a) - F.lit(0.5 * math.log(math.pi))
    value = F.exp(log_front) * fraction / first
    return F.when(direct, value).otherwise(1 - value)


def correlation_tail(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs, by Student's t."""
    square = r * r
    inside = half_beta((n - 2) / 2, 1 - square, square)
    return (
        F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(None).cast("double"))
        .when(F.abs(r) >= 1, F.lit(0.0))
        .when(r == 0, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))
    )


#: Beyond this many standard deviations the tail is a continued fraction, before it a series.
NEAR = 2.5


def normal_upper_tail(z: Column) -> Column:
    """P(Z >= z) for a standard normal, to nearly all digits in either tail."""
    far = F.abs(z)
    density = F.exp(-far * far / 2) / F.lit(math.sqrt(2 * math.pi))

    def series(acc: Column, k: Column) -> Column:
        term = acc["term"] * acc["x2"] / (2 * k + 1)
        return F.struct(acc["x2"].alias("x2"), term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct((far * far).alias("x2"), far.alias("term"), far.alias("sum"))
    near = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, series)["sum"]
    fraction = F.aggregate(
        F.sequence(F.lit(120), F.lit(1), F.lit(-1)),
        F.struct(far.alias("x"), far.alias("value")),
        lambda acc, k: F.struct(acc["x"].alias("x"), (acc["x"] + k / acc["value"]).alias("value")),
    )["value"]
    tail = F.when(far < NEAR, near).otherwise(density / fraction)
    return F.when(z >= 0, tail).otherwise(1 - tail)
