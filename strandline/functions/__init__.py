"""Scalar building blocks: every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for a row.

    An expression that stands in a lambda is evaluated for every element, and the
    optimizer moves projections into lambdas; a bound variable isn't moved.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keep(df, value: Column, name: str, condition: Callable[[Column], Column] | None = None):
    """``df`` with ``value`` as column ``name``, only where ``condition`` of it holds.

    A generator: filters above aren't pushed below it, which would work out the value
    again for each of them.
    """
    one = F.array(value)
    return df.select("*", F.explode(F.filter(one, condition) if condition else one).alias(name))
