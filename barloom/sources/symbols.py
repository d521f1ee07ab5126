"""Symbols and what kind of security they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of funds and shares (fixed values).
ETF_PREFIXES = ("15", "50", "51", "52", "56", "58")
LOF_PREFIXES = ("16",)
STOCK_PREFIXES = ("000", "001", "002", "003", "300", "301", "600", "601", "603", "605", "688")


def normalize(symbol: Column) -> Column:
    """Trimmed; all-digit symbols padded to six places, longer ones left whole."""
    s = F.trim(symbol.cast("string"))
    return F.when(s.rlike("^[0-9]+$") & (F.length(s) < 6), F.lpad(s, 6, "0")).otherwise(s)


def asset_type(symbol: Column, strict: bool = False) -> Column:
    """etf, lof or stock, by prefix; any other symbol is null, or an error if ``strict``."""
    s = normalize(symbol)
    known = F.when(F.substring(s, 1, 2).isin(*LOF_PREFIXES), "lof").when(F.substring(s, 1, 2).isin(*ETF_PREFIXES), "etf").when(F.substring(s, 1, 3).isin(*STOCK_PREFIXES), "stock")
    return known.otherwise(F.raise_error(F.concat(F.lit("Cannot infer asset type for symbol "), s))) if strict else known


def route(df: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """``df`` with asset_type: the security master's, or the prefix rule's where it is silent."""
    if master is None:
        return df.withColumn("asset_type", asset_type(F.col("symbol")))
    known = master.select(normalize(F.col("symbol")).alias("symbol"), F.lower("asset_type").alias("_type")).where("symbol is not null and _type is not null").groupBy("symbol").agg(F.max("_type").alias("_type"))
    return df.join(known, "symbol", "left").withColumn("asset_type", F.coalesce("_type", asset_type(F.col("symbol")))).drop("_type")


def exchange_symbol(symbol: Column) -> Column:
    """SH before symbols that begin with 5, 6 or 9, SZ before all others."""
    s = F.trim(symbol.cast("string"))
    return F.concat(F.when(F.substring(s, 1, 1).isin("5", "6", "9"), "SH").otherwise("SZ"), s)
