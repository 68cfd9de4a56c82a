"""Statistics that Spark lacks: normal and chi-square quantiles, average ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The coefficients of the public algorithm AS 241 (PPND16), highest power first, numerator and denominator.
_CENTRAL = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
_NEAR = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.136929880922735805310, 0.59983220655588793769, 1.0),
)


def _ratio(parts: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    above, below = (reduce(lambda sum_, c: sum_ * x + F.lit(c), rest, F.lit(first)) for first, *rest in parts)
    return above / below


def norm_inv(p: Column | str) -> Column:
    """Quantile of the standard normal distribution, by rational approximations (16 digits); null outside (0, 1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - F.lit(0.5)
    square, tail = F.lit(0.180625) - q * q, F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    outer = F.when(tail <= 5, _ratio(_NEAR, tail - F.lit(1.6))).otherwise(_ratio(_FAR, tail - F.lit(5.0)))
    value = F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRAL, square)).otherwise(F.when(q < 0, -outer).otherwise(outer))
    return F.when((p > 0) & (p < 1), value)


def chi2_inv_1(p: Column) -> Column:
    """Quantile of chi-square with one degree of freedom at 1 - p."""
    z = norm_inv(p / 2)
    return z * z


def average_rank(df: DataFrame, value: str, keys: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 within keys, ties sharing the mean; null values have none.

    Values are counted first, so the running window sorts distinct values, not rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    below = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, below + (F.col("_k") + 1) / F.lit(2).cast("double")).drop("_k")
    return df.join(ranks, [*keys, value], "left")
