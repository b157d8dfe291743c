"""Column helpers where the library's contract differs from the built-in function."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def isin(column: Column, *values: Any) -> Column:
    """``column`` equals one of the values; lists, tuples and sets among them are flattened."""
    flat: list[Any] = []
    for v in values:
        flat.extend(v) if isinstance(v, list | tuple | set) else flat.append(v)
    return column.isin(*flat)


def consecutive_id(*order: str | Column, partition: Iterable[str | Column] = ()) -> Column:
    """1, 2, 3 and so on by an explicit order, within ``partition``: without one, a single task numbers all rows."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.when(b != 0, a / b)
