"""Time splits and rolling-origin folds, as intervals joined to rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratiospark.operators.positions import with_position

FOLD_SCHEMA = "fold_id long, train_start_pos long, train_end_pos long, val_end_pos long"
DATE_FOLD_SCHEMA = "fold_id long, train_start date, val_start date, val_end date"


def valid_sales(df: DataFrame, flags: Sequence[str], null_flag: str = "drop") -> DataFrame:
    """Rows on which no flag is set; a NULL flag drops the row, or keeps it with "keep"."""
    for f in flags:
        df = df.where(~F.coalesce(F.col(f), F.lit(null_flag == "drop")))
    return df


def time_holdout(df: DataFrame, date: str, key: Sequence[str], fraction: float = 0.9) -> DataFrame:
    """Adds ``is_train``: the int(fraction * n) oldest rows, ties on the date broken by the key."""
    placed = with_position(df, [date, *key])
    return placed.withColumn("is_train", F.col("pos") <= int(fraction * df.count()))


def add_months(day: dt.date, months: int) -> dt.date:
    """The same day of a later month, or the month's last."""
    month = day.month - 1 + months
    year, month = day.year + month // 12, month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month, min(day.day, last))


def mode_a_folds(n: int, initial: int, fraction: float, sliding: bool = False, min_val: int = 1, min_train: int = 1) -> list[tuple[int, int, int, int]]:
    """Folds by position; validation blocks of floor(n * fraction) rows, full blocks only.

    Rows (fold_id, train_start, train_end, val_end), ends exclusive, positions
    from 0.  A sliding window keeps the initial length (R3b).  Folds under the
    minimum sizes are left out (P20).
    """
    if not 0 < fraction < 1:
        raise ValueError("the validation fraction must be in (0, 1)")
    size, end, out = max(int(n * fraction), 1), initial, []
    while end + size <= n:
        start = max(0, end - initial) if sliding else 0
        if size >= min_val and end - start >= min_train:
            out.append((len(out), start, end, end + size))
        end += size
    return out


def mode_b_folds(first: dt.date, last: dt.date, initial: int, val: int, step: int, window: int | None = None) -> list[tuple[int, dt.date, dt.date, dt.date]]:
    """Folds by date: (fold_id, train_start, val_start, val_end), lengths in months; stops where a window would end after the last day."""
    out, start = [], add_months(first, initial)
    while (end := add_months(start, val)) <= last + dt.timedelta(days=1):
        begin = first if window is None else max(first, add_months(start, -window))
        out.append((len(out), begin, start, end))
        start = add_months(start, step)
    return out


def rolling_origins(first: dt.date, last: dt.date, every: int = 9, lead_days: int = 270) -> list[dt.date]:
    """Month starts, ``every`` months apart, from the first one not before first + lead_days."""
    at = first + dt.timedelta(days=lead_days)
    at = at if at.day == 1 else add_months(at.replace(day=1), 1)
    out = []
    while at <= last:
        out.append(at)
        at = add_months(at, every)
    return out


def sliding_starts(first: dt.date, origins: Sequence[dt.date], years: int = 3) -> list[tuple[dt.date, dt.date]]:
    """R2: (window_start, origin): the start is the ``years``-th year start before the origin."""
    return [(dt.date(o.year - years + (0 if (o.month, o.day) == (1, 1) else 1), 1, 1), o) for o in origins]


def position_membership(placed: DataFrame, folds: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per fold and row, with ``role`` train or val; ``pos`` counts from 1, folds are few and broadcast."""
    p = F.col(pos) - 1
    inside = (p >= F.col("train_start_pos")) & (p < F.col("val_end_pos"))
    return placed.join(F.broadcast(folds), inside).withColumn("role", F.when(p < F.col("train_end_pos"), "train").otherwise("val"))


def date_membership(df: DataFrame, folds: DataFrame, date: str) -> DataFrame:
    """Train in [train_start, val_start), val in [val_start, val_end)."""
    d = F.to_date(date)
    return df.join(F.broadcast(folds), (d >= F.col("train_start")) & (d < F.col("val_end"))).withColumn("role", F.when(d < F.col("val_start"), "train").otherwise("val"))


def origin_membership(df: DataFrame, origins: DataFrame, date: str) -> DataFrame:
    """Train up to the origin, after ``window_start`` where there is one."""
    d = F.to_date(date)
    return df.join(F.broadcast(origins), (d <= F.col("origin")) & (F.col("window_start").isNull() | (d > F.col("window_start"))))


def initial_rows(df: DataFrame, date: str, months: int, least: int) -> tuple[int, int]:
    """(n, rows before the first date plus ``months``, at least ``least``)."""
    first = df.agg(F.min(date).alias("first"))
    n, rows = df.crossJoin(F.broadcast(first)).agg(F.count("*"), F.sum((F.to_date(date) < F.add_months(F.to_date("first"), months)).cast("long"))).first()
    return n, max(rows or 0, least)


def year_split(df: DataFrame, date: str, year: int) -> tuple[DataFrame, DataFrame]:
    """P5: rows before the year and rows of it, as date ranges that reach the scan."""
    start, end = F.lit(dt.date(year, 1, 1)), F.lit(dt.date(year + 1, 1, 1))
    return df.where(F.col(date) < start), df.where((F.col(date) >= start) & (F.col(date) < end))


def period(date: str, unit: str) -> Column:
    """Calendar block of a date: its month, week or quarter start."""
    return F.date_trunc(unit, date)
