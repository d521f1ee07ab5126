"""Training and inference datasets: padded load, factors, normalization, label, trim."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.cross_section import normalize, with_label
from barloom.operators.factors import REGISTRY
from barloom.operators.panel import factor_frame


def business_days_before(day: date | str, n: int) -> date:
    """``n`` weekdays (Monday to Friday) before ``day``."""
    at = date.fromisoformat(day) if isinstance(day, str) else day
    if n and at.weekday() > 4:  # a weekend counts back to Friday as the first step
        at -= timedelta(days=at.weekday() - 4)
        n -= 1
    at -= timedelta(days=7 * (n // 5))
    for _ in range(n % 5):
        at -= timedelta(days=3 if at.weekday() == 0 else 1)
    return at


def sessions_before(dates: DataFrame, day: str, n: int) -> date | None:
    """The ``n``-th earlier date of the panel's own calendar (one column, timestamp)."""
    rows = dates.select(F.col("timestamp").cast("date").alias("d")).where(F.col("d") < F.lit(day).cast("date")).distinct().orderBy(F.desc("d")).limit(max(n, 1)).agg(F.min("d")).first()
    return rows[0]


@dataclass(frozen=True)
class Spec:
    """What a dataset holds; equal specs over one bar table share one prepared dataset."""

    features: tuple[str, ...]
    horizon: int = 5
    target: str = "return"
    normalization: str = "none"
    start: str | None = None
    end: str | None = None
    symbols: tuple[str, ...] | None = None
    lookback: int | None = None

    @property
    def label(self) -> str:
        return f"future_return_{'rank_' if self.target == 'rank' else ''}{self.horizon}d"


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every feature (and label) present."""
    return df.dropna("any", subset=columns)


def trim(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive dates, applied after the windows."""
    day = F.to_date("timestamp")
    if start:
        df = df.where(day >= F.lit(start).cast("date"))
    return df.where(day <= F.lit(end).cast("date")) if end else df


def inference_dataset(bars: DataFrame, spec: Spec, **references: DataFrame | None) -> DataFrame:
    """symbol, timestamp, close and the normalized features, incomplete rows included.

    The padded range is filtered below the windows, where it reaches the scan; the exact
    range above them.
    """
    days = F.to_date("timestamp")
    if spec.start:
        n = REGISTRY.lookback(spec.features) if spec.lookback is None else spec.lookback
        bars = bars.where(days >= F.lit(business_days_before(spec.start, n).isoformat()).cast("date"))
    if spec.end:
        bars = bars.where(days <= F.lit(spec.end).cast("date"))
    if spec.symbols is not None:
        bars = bars.where(F.col("symbol").isin(list(spec.symbols)))
    frame = factor_frame(bars, list(spec.features), keep=["symbol", "timestamp", "close"], **references)
    return normalize(frame, list(spec.features), spec.normalization)


def training_dataset(bars: DataFrame, spec: Spec, **references: DataFrame | None) -> DataFrame:
    """Features, then normalization, then the label, then complete rows of the asked range."""
    if spec.target not in ("return", "rank"):
        raise ValueError(f"Unknown target: {spec.target}")
    frame = with_label(inference_dataset(bars, spec, **references), spec.horizon, spec.target == "rank")
    return trim(drop_incomplete(frame, [*spec.features, spec.label]), spec.start, spec.end)


@dataclass
class Prepared:
    """Prepared datasets of one bar table by spec; a spec asked again is not built again."""

    bars: DataFrame
    references: dict[str, DataFrame | None] = field(default_factory=dict)
    _held: dict[Spec, DataFrame] = field(default_factory=dict)

    def get(self, spec: Spec) -> DataFrame:
        if spec not in self._held:
            self._held[spec] = training_dataset(self.bars, spec, **self.references).persist()
        return self._held[spec]

    def clear(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()


def as_day(x: datetime | date | str) -> str:
    return x if isinstance(x, str) else x.strftime("%Y-%m-%d")
