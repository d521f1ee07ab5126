"""Normalizer of downloaded daily bars; the download itself is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import BARS, require
from barloom.sources.bars import normalize_bars

#: Column names of the vendors' daily tables (fixed values).
COLUMNS = {"日期": "timestamp", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount", "date": "timestamp"}


def normalize_daily(raw: DataFrame, symbol: str, asset_type: str = "stock", market: str = "ashare") -> DataFrame:
    """Canonical bars of one symbol.

    One vendor's stock table (with ``date`` and ``amount``) counts lots under ``amount``:
    they become the volume and the amount is null.  An empty table gives an empty frame.
    """
    lots = asset_type == "stock" and {"date", "amount"} <= set(raw.columns)
    if lots:
        raw = raw.drop("volume").withColumnRenamed("amount", "volume")
    named = raw.withColumnsRenamed({a: b for a, b in COLUMNS.items() if a in raw.columns and b not in raw.columns})
    require(named, ["timestamp", "open", "high", "low", "close", "volume"], "downloaded bars")
    return normalize_bars(named.withColumn("symbol", F.lit(symbol)).drop("open_interest"), market).select([f.name for f in BARS.fields])
