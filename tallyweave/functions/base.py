"""Binding of intermediate values in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Without this a value that is used twice at each of several steps is written, compiled and run as
    often as there are paths to it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
