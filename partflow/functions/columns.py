"""Row-local expressions over groups of sparse columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str
PATTERN_BITS = 63  # columns that one presence number holds


def as_column(c: ColumnLike) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def least_of(cols: Sequence[ColumnLike]) -> Column:
    """Smallest non-null value; null when every input is null. Spark's least needs two arguments."""
    cols = [as_column(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.least(*cols)


def greatest_of(cols: Sequence[ColumnLike]) -> Column:
    cols = [as_column(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def spread(cols: Sequence[ColumnLike]) -> Column:
    return greatest_of(cols) - least_of(cols)


def present_count(cols: Iterable[ColumnLike]) -> Column:
    flags = [as_column(c).isNotNull().cast("int") for c in cols]
    return reduce(lambda a, b: a + b, flags)


def normalised_spread(cols: Sequence[ColumnLike]) -> Column:
    """(max - min) / number of present values; null when nothing is present."""
    return F.try_divide(spread(cols), present_count(cols))


def transition_gap(previous: Sequence[ColumnLike], following: Sequence[ColumnLike]) -> Column:
    """First time at the following station minus last time at the previous one."""
    return least_of(following) - greatest_of(previous)


def presence_pattern(cols: Sequence[ColumnLike]) -> Column:
    """An array of numbers, each for the next 63 columns: bit i is set when the i-th of them is present."""
    words = []
    for at in range(0, len(cols), PATTERN_BITS):
        bits = [as_column(c).isNotNull().cast("long") * F.lit(1 << i) for i, c in enumerate(cols[at : at + PATTERN_BITS])]
        words.append(reduce(lambda a, b: a + b, bits))
    return F.array(*words)


def first_present(cols: Sequence[str]) -> Column:
    """Name of the first present column, null when none is."""
    return F.coalesce(*[F.when(as_column(c).isNotNull(), F.lit(c)) for c in cols])


# Fixed pattern of a category value such as T48576: one letter, then a whole number.
CATEGORY_VALUE = r"^[A-Za-z]-?[0-9]{1,19}$"


def category_code(c: ColumnLike) -> Column:
    """The number after the leading letter; null for anything that is not letter plus whole number of 64 bits."""
    value = as_column(c)
    return F.when(value.rlike(CATEGORY_VALUE), F.substring(value, 2, 20).try_cast("bigint"))


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Column names matched anywhere by a regular expression, in table order."""
    compiled = re.compile(pattern)
    found = [c for c in df.columns if compiled.search(c)]
    if not found:
        raise ValueError(f"no column matches {pattern!r}")
    return found


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop the label or the part id before features are exposed."""
    return df.drop(*names)
