"""Drivers that bring bars and reference tables up to date from a caller's downloads.

A download is a function given by the caller (or named ``module:function`` on the command
line): there is no vendor's library here.  Downloads run in a few driver threads, since
they wait for the network; everything after them is one Spark job per table.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import ingest
from barloom.sources import bars as sources
from barloom.sources.control import Tracker, is_fresh, retry, scopes_of, sync_plan, workers, write_sync
from barloom.sources.remote import normalize_daily

#: A table as pandas frame, list of dictionaries or DataFrame.
Rows = Any
#: (symbol, first day, last day) to the raw daily table, and (scope, symbol) to a raw reference table.
FetchBars = Callable[[str, date, date], Rows]
FetchTable = Callable[[str, str], Rows]


def named(reference: str) -> Callable[..., Any]:
    """The function ``module:function``."""
    module, _, function = reference.partition(":")
    if not function:
        raise ValueError(f"{reference} is not module:function")
    return getattr(importlib.import_module(module), function)


def _frame(spark: SparkSession, rows: Rows) -> DataFrame | None:
    """As a DataFrame; nothing, or no rows, gives None."""
    if rows is None or isinstance(rows, DataFrame):
        return rows
    if len(rows) == 0:
        return None
    return spark.createDataFrame(rows)


def _each(items: list, call: Callable[[Any], Any], asked: int | None, attempts: int, wait: float, timeout: float | None) -> list[tuple[Any, Any, Exception | None]]:
    def one(item: Any) -> tuple[Any, Any, Exception | None]:
        try:
            return item, retry(lambda: call(item), attempts, wait, timeout), None
        except Exception as error:  # noqa: BLE001 - recorded by the caller
            return item, None, error

    with ThreadPoolExecutor(workers(max(1, len(items)), asked)) as pool:
        return list(pool.map(one, items))


def sync_bars(spark: SparkSession, symbols: Iterable[str], fetch: FetchBars, target: str, start: date, end: date, adjust: str = "qfq", asset_type: str = "stock", market: str = "ashare", lookback_days: int = 7, asked_workers: int | None = None, attempts: int = 3, wait: float = 1.0, timeout: float | None = 60.0, allow_partial: bool = True, overwrite: bool = False) -> dict[str, int]:
    """Bring daily bars of ``symbols`` up to ``end``: the tracker's summary.

    Where a symbol stands comes from the table itself, in one aggregate.  Symbols that
    reach ``end`` are skipped; others load from ``lookback_days`` before their latest day,
    and new rows win over known ones.  All downloads are merged in one write.
    """
    names = list(dict.fromkeys(symbols))
    tracker = Tracker(f"{target.rstrip('/')}.sync", "daily_sync", names)
    known = sources.load(spark, target) if sources.exists(spark, target) else None
    latest: dict[str, date] = {}
    if known is not None and not overwrite:
        latest = {r.symbol: r.d for r in known.where(F.col("symbol").isin(names)).groupBy("symbol").agg(F.to_date(F.max("timestamp")).alias("d")).collect()}
    begin = {s: ingest.incremental_start(start, latest.get(s), end, lookback_days) for s in names}
    for s in names:
        if begin[s] is None:
            tracker.record(s, "skipped")
    todo = [s for s in names if begin[s] is not None]
    fresh, done = None, []
    for s, rows, error in _each(todo, lambda s: fetch(s, begin[s], end), asked_workers, attempts, wait, timeout):
        table = _frame(spark, rows) if error is None else None
        if table is None:
            tracker.record(s, "failed", error=repr(error) if error else "no rows")
            continue
        part = normalize_daily(table, s, asset_type, market)
        fresh = part if fresh is None else fresh.unionByName(part)
        done.append(s)
    if fresh is not None:
        merged = fresh if known is None or overwrite else ingest.upsert(known.where(F.col("symbol").isin(done)).select(fresh.columns), fresh)
        sources.write(ingest.keep_last(merged, ["symbol", "timestamp"], [c for c in merged.columns if c not in ("symbol", "timestamp")]), target, "1d", adjust)
        for s in done:
            tracker.record(s, "succeeded")
    out = tracker.summary()
    if out["failed"] and not allow_partial:
        raise RuntimeError(f"{out['failed']} symbols failed; see {tracker.path('failures')}")
    return out


def sync_references(spark: SparkSession, symbols: Iterable[str], fetch: FetchTable, root: str, end: date, scope: str = "all", benchmark_symbol: str = "sh000300", names: dict[str, dict[str, str]] | None = None, asked_workers: int | None = None, attempts: int = 3, wait: float = 1.0, timeout: float | None = 60.0) -> dict[str, int]:
    """Bring benchmark, fundamentals, industry and dividends below ``root`` up to ``end``.

    ``fetch`` gives the raw table of a scope and symbol; for fundamentals a dictionary of
    the balance, profit and cash tables.  ``names`` maps the raw column names of industry
    and dividends.  Symbols whose scopes are all fresh by their metadata are skipped.
    """
    root, names = root.rstrip("/"), names or {}
    scopes = scopes_of(scope)
    meta = lambda s, x: f"{root}/sync/{x}/{s}.json"
    fresh = lambda s, x: is_fresh(meta(s, x), end, lambda: None)
    skipped, pending = sync_plan(list(dict.fromkeys(symbols)), [x for x in scopes if x != "benchmark"], fresh)
    if "benchmark" in scopes and not fresh(benchmark_symbol, "benchmark"):
        pending = [(benchmark_symbol, "benchmark"), *pending]
    tracker = Tracker(f"{root}/sync", "reference_sync", [f"{x}:{s}" for s, x in pending] + skipped)
    for s in skipped:
        tracker.record(s, "skipped")
    tables: dict[str, DataFrame] = {}
    done: list[tuple[str, str]] = []
    for (s, x), rows, error in _each(pending, lambda t: fetch(t[1], t[0]), asked_workers, attempts, wait, timeout):
        try:
            if error is not None:
                raise error
            part = _standard(spark, x, s, rows, names.get(x, {}))
        except Exception as problem:  # noqa: BLE001 - one table must not stop the others
            tracker.record(f"{x}:{s}", "failed", error=repr(problem))
            continue
        tables[x] = part if x not in tables else tables[x].unionByName(part)
        done.append((s, x))
    for x, table in tables.items():
        path = f"{root}/{x}"
        if sources.exists(spark, path):
            # Whole tables of the symbols at hand are replaced; references are small beside bars.
            kept = spark.read.parquet(path)
            table = table if x == "benchmark" else table.unionByName(kept.join(F.broadcast(table.select("symbol").distinct()), "symbol", "left_anti"), allowMissingColumns=True)
        table.write.mode("overwrite").parquet(f"{path}.new")
        sources.replace(spark, f"{path}.new", path)
    for s, x in done:
        write_sync(meta(s, x), end, "timestamp" if x == "benchmark" else "available_date")
        tracker.record(f"{x}:{s}", "succeeded")
    return tracker.summary()


def _standard(spark: SparkSession, scope: str, symbol: str, rows: Rows, names: dict[str, str]) -> DataFrame:
    def table(x: Rows) -> DataFrame:
        df = _frame(spark, x)
        if df is None:
            raise ValueError(f"no rows for {scope} of {symbol}")
        return df if "symbol" in df.columns or scope == "benchmark" else df.withColumn("symbol", F.lit(symbol))

    if scope == "benchmark":
        return ingest.benchmark(table(rows))
    if scope == "fundamentals":
        return ingest.fundamentals(*(table(rows[k]) for k in ("balance", "profit", "cash")))
    return ingest.industries(table(rows), names) if scope == "industry" else ingest.dividends(table(rows), names)


def sync_universe(spark: SparkSession, fetch: Callable[[str], Rows], index: str, output: str, root: str, names: dict[str, str], market: str = "ashare") -> str:
    """The constituents of an index as a universe file; its path."""
    raw = _frame(spark, fetch(index))
    if raw is None or raw.isEmpty():
        raise ValueError(f"no constituents for index {index}")
    path = f"{root.rstrip('/')}/{market}/{output}.csv"
    sources.write_universe(sources.constituents(raw, names), path)
    return path
