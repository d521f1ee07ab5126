"""Readers and writers of bars, universes and index constituents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import BAR_ALIASES, BARS, number, require
from barloom.sources.symbols import normalize

Reader = Callable[[SparkSession, str], DataFrame]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; ``normalize_bars`` gives the types."""
    return spark.read.option("recursiveFileLookup", "true").csv(path, header=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sql(spark: SparkSession, path: str) -> DataFrame:
    """In order of time where there is one; the optimizer drops the order where nothing shows it."""
    df = spark.sql("select * from parquet.`" + path.replace("`", "") + "`")
    return df.orderBy("timestamp") if "timestamp" in df.columns else df


PROVIDERS: dict[str, Reader] = {"csv": read_csv, "parquet": read_parquet, "duckdb": read_sql, "sql": read_sql}


def provider(name: str | Reader) -> Reader:
    """A reader by name, or one of the caller's own."""
    if callable(name):
        return name
    if name.lower() not in PROVIDERS:
        raise ValueError(f"Unsupported data provider: {name}. Available providers: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name.lower()]


def normalize_bars(df: DataFrame, market: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The canonical columns and types, then those to ``keep``; aliases are renamed where the canonical name is absent."""
    names = {a: b for a, b in BAR_ALIASES.items() if a in df.columns and b not in df.columns}
    chosen: dict[str, str] = {}
    for a, b in names.items():
        if b not in chosen.values():
            chosen[a] = b
    df = require(df.withColumnsRenamed(chosen), [c for c in ("timestamp", "symbol", "open", "high", "low", "close", "volume")], "bars")
    kind = F.lit(market) if market else F.col("market").cast("string") if "market" in df.columns else F.lit(None).cast("string")
    time = F.col("timestamp") if df.schema["timestamp"].dataType.typeName().startswith("timestamp") else F.col("timestamp").cast("string").try_cast("timestamp")
    values = [(number(F.col(f.name)) if f.name in df.columns else F.lit(None).cast("double")).alias(f.name) for f in BARS.fields[3:]]
    return df.select(normalize(F.col("symbol")).alias("symbol"), kind.alias("market"), time.cast("timestamp_ntz").alias("timestamp"), *values, *keep).where("timestamp is not null")


def between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Inclusive days; stated on the column itself, so it reaches the scan."""
    if start:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    return df.where(F.col("timestamp") < F.expr(f"timestamp_ntz '{end}' + interval 1 day")) if end else df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put the table at ``new`` in the place of the one at ``old``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(new).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(path(old), True)
    if not store.rename(path(new), path(old)):
        raise OSError(f"could not move {new} to {old}")


def load(spark: SparkSession, root: str, symbols: Iterable[str] | DataFrame | None = None, start: str | None = None, end: str | None = None, kind: str | Reader = "parquet", market: str | None = None, missing_ok: bool = True) -> DataFrame:
    """All bars below ``root`` in one scan, for some symbols and an inclusive range.

    A missing root gives an empty frame, or FileNotFoundError if not ``missing_ok``.  A
    long list of symbols comes as a DataFrame and meets the scan in a semi-join.
    """
    if not exists(spark, root):
        if missing_ok:
            return empty(spark)
        raise FileNotFoundError(root)
    df = between(normalize_bars(provider(kind)(spark, root), market), start, end)
    if symbols is None:
        return df
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select(normalize(F.col("symbol")).alias("symbol")).distinct(), "symbol", "left_semi")
    wanted = sorted({s.strip().zfill(6) if s.strip().isdigit() else s.strip() for s in symbols})
    return df.where(F.col("symbol").isin(wanted))


def load_batch(spark: SparkSession, root: str, wanted: Iterable[str], start: str | None = None, end: str | None = None, kind: str = "parquet", market: str | None = None) -> DataFrame:
    """``load`` that fails as a whole (ValueError) when any symbol has no bar in the range."""
    names = {s.strip().zfill(6) if s.strip().isdigit() else s.strip() for s in wanted}
    df = load(spark, root, names, start, end, kind, market, missing_ok=False)
    missing = sorted(names - {r.symbol for r in df.select("symbol").distinct().collect()})
    if missing:
        raise ValueError(f"no bars for {', '.join(missing)}")
    return df


#: Symbols share so many folders of a table; a write replaces the folders of its symbols only.
FOLDERS = 64


def write(df: DataFrame, path: str, timeframe: str = "daily", adjust: str = "raw") -> None:
    """Parquet by market, timeframe, adjustment and a folder of symbols.

    The symbols of ``df`` are replaced; others of the same folders are read and written
    again, and all other folders stay as they are.
    """
    spark = df.sparkSession
    folder = F.pmod(F.xxhash64("symbol"), F.lit(FOLDERS)).cast("int").alias("folder")
    keys = ("market", F.lit("daily" if timeframe == "1d" else timeframe).alias("timeframe"), F.lit(adjust or "raw").alias("adjust"), folder)
    own = [c for c in df.columns if c not in ("market", "timeframe", "adjust", "folder")]
    out = df.select(*own, *keys)
    if exists(spark, path):
        parts = ["market", "timeframe", "adjust", "folder"]
        touched, named = out.select(*parts).distinct(), out.select(*parts[:3], "symbol").distinct()
        old = spark.read.parquet(path)
        if set(parts) <= set(old.columns):
            # A list of at most FOLDERS entries for each market; it prunes the scan.
            old = old.join(F.broadcast(touched), parts, "left_semi").join(named, [*parts[:3], "symbol"], "left_anti")
            out = out.unionByName(old.select(*out.columns))
    out.repartition(*[F.col(c) for c in ("market", "folder")]).sortWithinPartitions("market", "folder", "symbol", "timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "timeframe", "adjust", "folder").parquet(path)


def build_parquet(spark: SparkSession, source: str, target: str, kind: str = "csv", overwrite: bool = False, symbols: Iterable[str] | None = None, adjust: str = "raw", report: str | None = None, allow_partial: bool = True) -> dict[str, int]:
    """Convert a tree of bar files symbol by symbol, in one job: how many were built, skipped and failed.

    A symbol is skipped when the run that built it saw no older files than now; one that
    is asked for and has no bars fails.  Manifest, summary and failures are JSON files
    below ``report`` (default: beside the target).  Without ``allow_partial`` a failure
    raises after the others are written.
    """
    from barloom.sources.control import Tracker

    wanted = None if symbols is None else sorted({s.strip().zfill(6) if s.strip().isdigit() else s.strip() for s in symbols})
    times: dict[str, float] = {}
    if exists(spark, source):
        raw = provider(kind)(spark, source)
        stamped = raw.select("*", F.unix_micros("_metadata.file_modification_time").alias("_written"))
        bars = normalize_bars(stamped, keep=("_written",))
        times = {r.symbol: r.t / 1e6 for r in bars.groupBy("symbol").agg(F.max("_written").alias("t")).collect()}
    items = sorted(times) if wanted is None else wanted
    tracker = Tracker(report or f"{target.rstrip('/')}.build", "build", items or [source])
    failed = [x for x in items if x not in times] or ([] if items else [source])
    for x in failed:
        tracker.record(x, "failed", error="no bars in the source")
    there = exists(spark, target)
    known = lambda x: tracker.state.get(x, {}).get("source_time", -1.0)
    skipped = [x for x in items if x in times and there and not overwrite and known(x) >= times[x]]
    todo = sorted(set(items) & set(times) - set(skipped))
    if todo:
        chosen = bars.where(F.col("symbol").isin(todo)) if len(todo) < len(times) else bars
        write(chosen.drop("_written").withColumn("market", F.coalesce("market", F.lit("unknown"))), target, adjust=adjust)
        for x in todo:
            tracker.record(x, "succeeded", source_time=times[x])
    for x in skipped:
        tracker.record(x, "skipped", source_time=times[x])
    if failed and not allow_partial:
        raise ValueError(f"no bars for {', '.join(failed)}")
    return {"built": len(todo), "skipped": len(skipped), "failed": len(failed)}


def universe(df: DataFrame) -> DataFrame:
    """symbol, in order of first appearance (column seq): the symbol, code or first column, normalized."""
    name = next((c for c in ("symbol", "code") if c in df.columns), df.columns[0])
    rows = df.select(normalize(F.col(f"`{name}`")).alias("symbol"), F.monotonically_increasing_id().alias("seq")).where("symbol is not null and symbol <> ''")
    return rows.groupBy("symbol").agg(F.min("seq").alias("seq"))


def symbols_of(bars: DataFrame) -> DataFrame:
    """The distinct symbols of a bar table."""
    return bars.select("symbol").distinct().orderBy("symbol")


def universe_path(root: str, name: str) -> str:
    """A name with folders or an absolute path is used as it is."""
    return name if "/" in name else f"{root.rstrip('/')}/universe/{name if name.endswith('.csv') else name + '.csv'}"


def constituents(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """symbol, name, index_code, index_name, as_of_date, exchange of an index; one row per symbol."""
    has = lambda c: F.col(f"`{names[c]}`").cast("string") if names.get(c) in raw.columns else F.lit(None).cast("string")
    rows = raw.select(normalize(has("symbol")).alias("symbol"), *(has(c).alias(c) for c in ("name", "index_code", "index_name", "as_of_date", "exchange"))).where("symbol is not null")
    return rows.groupBy("symbol").agg(*(F.max(c).alias(c) for c in ("name", "index_code", "index_name", "as_of_date", "exchange")))


def write_universe(df: DataFrame, path: str) -> None:
    """An index's constituents as one CSV file of a folder, with its header; one row per symbol, so it is small."""
    df.orderBy("symbol").coalesce(1).write.mode("overwrite").csv(path, header=True)
