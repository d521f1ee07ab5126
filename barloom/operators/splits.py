"""Time-ordered splits with purge and embargo, as date-index intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """Inclusive intervals of date indexes."""

    name: str
    train: tuple[int, int]
    valid: tuple[int, int]


def date_index(df: DataFrame) -> DataFrame:
    """timestamp, date_idx (from 0) of the distinct dates: one row per date, however large the panel."""
    dates = df.select("timestamp").where("timestamp is not null").distinct()
    return dates.withColumn("date_idx", F.row_number().over(Window.orderBy("timestamp")).cast("long") - 1)


def holdout(n_dates: int, cut: int | None, purge: int = 0, embargo: int = 0) -> Fold:
    """Train on dates up to ``cut`` - purge, validate from ``cut`` + 1 + embargo; no cut: all train."""
    if cut is None:
        return Fold("holdout", (0, n_dates - 1), (0, -1))
    return Fold("holdout", (0, cut - purge), (cut + 1 + embargo, n_dates - 1))


def walk_forward(n_dates: int, train_size: int, valid_size: int, step: int | None = None, purge: int = 0, embargo: int = 0, expanding: bool = True) -> list[Fold]:
    """Folds whose training window ends ``purge`` dates early and whose validation starts ``embargo`` dates late."""
    if min(train_size, valid_size) < 1 or (step is not None and step < 1):
        raise ValueError("train, validation and step sizes must be at least 1")
    if n_dates < train_size + purge + embargo + valid_size:
        raise ValueError("not enough dates for walk-forward validation")
    folds, end = [], train_size
    while end + embargo + valid_size <= n_dates:
        first = 0 if expanding else end - train_size
        last = end - 1 - purge
        begin = end + embargo
        if last >= first:
            folds.append(Fold(f"fold_{len(folds) + 1}", (first, last), (begin, begin + valid_size - 1)))
        end += step or valid_size
    if not folds:
        raise ValueError("walk-forward settings give no fold")
    return folds


def members(df: DataFrame, folds: list[Fold], part: str = "valid") -> DataFrame:
    """``df`` with a fold column, one copy of a row for each fold that holds its date.

    The date dimension and the intervals are driver-made and tiny beside the panel; the
    panel meets them in a broadcast equi-join on the timestamp.
    """
    dates = date_index(df)
    inside = [F.when(F.col("date_idx").between(*getattr(f, part)), F.lit(f.name)) for f in folds]
    tagged = dates.select("timestamp", "date_idx", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("fold"))
    return df.join(tagged, "timestamp")


def check_windows(train_end: str, test_start: str, valid_end: str | None = None, tuned: bool = False) -> None:
    """The test must begin after training ends; with tuning, validation ends where training does."""
    if test_start <= train_end:
        raise ValueError("signal test must start after the training window ends")
    if tuned and valid_end is not None and valid_end != train_end:
        raise ValueError("with tuning the validation window must end with the training window")


def tuning_split(n_dates: int, cut: int, purge: int = 0) -> tuple[tuple[int, int], tuple[int, int]]:
    """Outer train and selection intervals; no purge by default."""
    train, selection = (0, cut - purge), (cut + 1, n_dates - 1)
    if train[1] < train[0] or selection[1] < selection[0]:
        raise ValueError("tuning split leaves an empty side")
    return train, selection
