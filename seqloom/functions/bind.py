"""Naming a value inside an expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once. Spark computes an expression that a lambda mentions anew
    for every element, which makes a linear function quadratic; a lambda variable is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)
