"""Log-space arithmetic over groups, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def log_sum_exp(x: Column, group: WindowSpec) -> Column:
    """ln of the sum of exp(x) of a group, shifted by its maximum. NaN and infinities raise an error."""
    top = F.max(sound(x)).over(group)
    return top + F.log(F.sum(F.exp(x - top)).over(group))


def posterior(x: Column, group: WindowSpec) -> Column:
    """Softmax of log scores within a group."""
    return F.exp(x - log_sum_exp(x, group))


def log_diff_exp(a: Column, b: Column) -> Column:
    """ln(exp(a) - exp(b)); null where they are equal."""
    return F.when(a != b, a + F.log(1 - F.exp(b - a)))


def sound(x: Column) -> Column:
    """``x``, or an error if it is NaN or infinite; nulls pass."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a feature is NaN or infinite")).cast("double")).otherwise(x)
