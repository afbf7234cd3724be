"""Null rules and windows that every operator shares.

Missing values are NULL, never NaN. Comparisons with NULL are false (``flag``), divisions by
zero are NULL (``safe_div``), and rolling aggregates are NULL below their minimum of non-null
values (``gate``). All windows of a contract use one partitioning and order, so that any
number of them costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def whole() -> WindowSpec:
    return Window.partitionBy("contract_id")


def ties(df: DataFrame) -> tuple[str, ...]:
    """What orders rows of one time: the event id, where there is one. Without it their order is open."""
    return ("event_id",) if "event_id" in df.columns else ()


def by_time(more: tuple[str, ...] = ()) -> WindowSpec:
    return whole().orderBy("ts", *more)


def so_far(more: tuple[str, ...] = ()) -> WindowSpec:
    return by_time(more).rowsBetween(Window.unboundedPreceding, 0)


def backwards(more: tuple[str, ...] = ()) -> WindowSpec:
    """From the contract's end down to this row: a running frame, where a frame up to the end is worked out anew for each row."""
    return whole().orderBy(F.desc("ts"), *[F.desc(c) for c in more]).rowsBetween(Window.unboundedPreceding, 0)


def rows(k: int, more: tuple[str, ...] = ()) -> WindowSpec:
    """The last ``k`` rows, this one included."""
    return by_time(more).rowsBetween(-(k - 1), 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a), col(b))


def gate(c: Column | str, agg: Callable[[Column], Column], k: int, least: int = 1, more: tuple[str, ...] = ()) -> Column:
    """A rolling aggregate over ``k`` rows, NULL with fewer than ``least`` non-null values."""
    w = rows(k, more)
    return F.when(F.count(col(c)).over(w) >= least, agg(col(c)).over(w))


def flag(condition: Column) -> Column:
    """A mask: NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of ``names`` that is a column."""
    return next((n for n in names if n in df.columns), None)


def quantile(c: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation, NULLs left out."""
    return F.percentile(col(c), F.lit(q))


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL (greatest and least would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def seconds(c: Column | str) -> Column:
    """Seconds since the epoch as a double, with fractions."""
    return F.unix_micros(col(c)) / F.lit(1_000_000.0)


def hours(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(3_600_000_000.0)


def minutes(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(60_000_000.0)
