"""Name an expression inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` evaluated once per row. Without it, an expression used inside a higher-order
    function would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
