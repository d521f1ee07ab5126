"""Schemas of the panel tables and the rules every operator relies on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares in one trading lot; volumes are counted in lots.
LOT_SIZE = 100

_D, _S = T.DoubleType(), T.StringType()
BARS = T.StructType(
    [T.StructField("symbol", _S), T.StructField("market", _S), T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume", "amount", "open_interest")]
)
REQUIRED_BARS = ("timestamp", "symbol", "open", "high", "low", "close", "volume")
#: Other names of bar columns that readers accept.
BAR_ALIASES = {"date": "timestamp", "trade_date": "timestamp", "datetime": "timestamp", "vol": "volume", "turnover": "amount"}

REQUIRED_FUNDAMENTALS = (
    "total_assets", "total_parent_equity", "share_capital", "total_operate_income_ttm", "operate_cost_ttm", "operate_profit_ttm",
    "parent_netprofit_ttm", "netcash_operate_ttm", "asset_growth", "investment_to_assets", "accruals",
)
OPTIONAL_FUNDAMENTALS = (
    "total_liabilities", "inventory", "accounts_rece", "note_rece", "fixed_asset", "intangible_asset", "monetary_funds", "capex_ttm",
    "inventory_growth", "receivables_growth", "capex_growth",
)


def require(df: DataFrame, columns: Iterable[str], what: str = "data") -> DataFrame:
    """``df``, or ValueError naming what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def canonical(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing numbers are null, never NaN or infinite, in every double column."""
    own = set(df.columns if columns is None else columns)
    return df.select([finite(F.col(f.name)).alias(f.name) if f.name in own and isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def number(x: Column) -> Column:
    """A double, or null where the value is no number."""
    return finite(x.try_cast("double"))
