import json
import os
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.__main__ import main
from barloom.operators import factors, models, ridge
from barloom.operators.registry import FAMILIES
from barloom.plans import experiment, sync
from barloom.sources import bars as sources
from barloom.sources import control
from barloom.streaming import upserts


def daily(first, last, close):
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    return [{"date": d.isoformat(), "open": 1.0, "high": 2.0, "low": 0.5, "close": close, "volume": 10.0} for d in days]


def bars(spark, symbols, close=1.0, days=3):
    rows = [(s, "m", datetime(2024, 1, 1 + i), 1.0, 2.0, 0.5, close, 10.0, None, None) for s in symbols for i in range(days)]
    return spark.createDataFrame(rows, sources.BARS)


def test_write_keeps_other_symbols_of_its_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "FOLDERS", 2)
    path = str(tmp_path / "lake")
    names = [f"{i:06d}" for i in range(8)]
    sources.write(bars(spark, names), path)
    sources.write(bars(spark, names[:2], close=5.0, days=1), path)
    got = {(r.symbol, r.close): r.n for r in sources.load(spark, path).groupBy("symbol", "close").agg(F.count("*").alias("n")).collect()}
    assert got == {**{(s, 1.0): 3 for s in names[2:]}, **{(s, 5.0): 1 for s in names[:2]}}
    with pytest.raises(ValueError, match="000099"):
        sources.load_batch(spark, path, ["1", "99"])
    assert sources.load_batch(spark, path, ["2", "3"]).count() == 6


def test_build_by_symbol(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    for s, close in (("000001", 1.5), ("000002", 2.5)):
        (tmp_path / "csv" / f"{s}.csv").write_text(f"date,symbol,open,high,low,close,vol\n2024-01-02,{s},1,3,0.5,{close},10\n")
    source, target = str(tmp_path / "csv"), str(tmp_path / "lake")
    assert sources.build_parquet(spark, source, target, symbols=["1", "2", "3"]) == {"built": 2, "skipped": 0, "failed": 1}
    assert list(json.load(open(target + ".build/build.failures.json"))) == ["000003"]
    later = time.time() + 60
    (tmp_path / "csv" / "000002.csv").write_text("date,symbol,open,high,low,close,vol\n2024-01-02,000002,1,9,0.5,8.5,10\n")
    os.utime(tmp_path / "csv" / "000002.csv", (later, later))
    assert sources.build_parquet(spark, source, target) == {"built": 1, "skipped": 1, "failed": 0}
    assert {r.symbol: r.close for r in sources.load(spark, target).collect()} == {"000001": 1.5, "000002": 8.5}
    with pytest.raises(ValueError, match="000009"):
        sources.build_parquet(spark, source, target, symbols=["9"], allow_partial=False)


def test_sync_bars(spark, tmp_path):
    target, asked = str(tmp_path / "lake"), []

    def fetch(symbol, first, last):
        asked.append((symbol, first))
        if symbol == "000003":
            raise OSError("gone")
        return daily(first, last, 1.0 if last < date(2026, 4, 24) else 20.0)

    names = ["000001", "000002", "000003"]
    out = sync.sync_bars(spark, names, fetch, target, date(2026, 4, 20), date(2026, 4, 22), wait=0, attempts=1)
    assert (out["succeeded"], out["failed"]) == (2, 1)
    asked.clear()
    out = sync.sync_bars(spark, names[:2], fetch, target, date(2026, 4, 20), date(2026, 4, 24), lookback_days=2, wait=0)  # X15
    assert sorted(asked) == [("000001", date(2026, 4, 20)), ("000002", date(2026, 4, 20))] and out["succeeded"] == 2
    got = sources.load(spark, target).where("symbol = '000001'").orderBy("timestamp").collect()
    assert [r.close for r in got] == [20.0] * 5
    assert sync.sync_bars(spark, names[:2], fetch, target, date(2026, 4, 20), date(2026, 4, 24), wait=0)["skipped"] == 2
    with pytest.raises(RuntimeError):
        sync.sync_bars(spark, ["000003"], fetch, target, date(2026, 4, 20), date(2026, 4, 24), wait=0, attempts=1, allow_partial=False)


def test_sync_references_and_universe(spark, tmp_path):
    root = str(tmp_path / "ref")
    quarters = [f"{y}-{m}" for y in (2023, 2024) for m in ("03-31", "06-30", "09-30", "12-31")]

    def fetch(scope, symbol):
        if scope == "benchmark":
            return [{"date": "2024-01-02", "close": "10"}]
        if scope == "industry":
            return [{"change": "2020-01-01", "sector": "s"}]
        if scope == "dividends":
            return [{"ex": "2024-03-11", "ten": "12"}] if symbol == "000001" else []
        return {
            "balance": [{"REPORT_DATE": q, "NOTICE_DATE": q, "TOTAL_ASSETS": 100.0} for q in quarters],
            "profit": [{"REPORT_DATE": q, "NOTICE_DATE": q, "OPERATE_COST": 1.0} for q in quarters],
            "cash": [{"REPORT_DATE": q, "NOTICE_DATE": q, "NETCASH_OPERATE": 1.0} for q in quarters],
        }

    names = {"industry": {"change_date": "change"}, "dividends": {"ex_date": "ex", "cash_per_ten": "ten"}}
    out = sync.sync_references(spark, ["000001", "000002"], fetch, root, date(2024, 6, 30), names=names, wait=0, attempts=1)
    assert (out["succeeded"], out["failed"]) == (6, 1)
    assert spark.read.parquet(f"{root}/fundamentals").count() == 16 and spark.read.parquet(f"{root}/benchmark").first().close == 10.0
    assert spark.read.parquet(f"{root}/dividends").first().cash_dividend_per_share == 1.2
    again = sync.sync_references(spark, ["000001", "000002"], fetch, root, date(2024, 6, 30), names=names, wait=0, attempts=1)
    assert (again["skipped"], again["failed"]) == (1, 1)
    path = sync.sync_universe(spark, lambda index: [{"c": "1", "n": "a"}, {"c": "000001", "n": "a"}, {"c": "600000", "n": "b"}], "000300", "hs300", root, {"symbol": "c", "name": "n"})
    assert [r.symbol for r in sources.universe(spark.read.csv(path, header=True)).orderBy("seq").collect()] == ["000001", "600000"]
    with pytest.raises(ValueError):
        sync.sync_universe(spark, lambda index: [], "000300", "hs300", root, {})
    with pytest.raises(ValueError):
        sync.named("os.path")
    assert sync.named("os.path:join") is os.path.join


def test_hung_call_times_out():
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        control.retry(lambda: time.sleep(30), attempts=2, wait=0, timeout=0.2)
    assert time.monotonic() - began < 5
    assert control.retry(lambda: 7, timeout=5.0) == 7


def test_stream_touches_only_its_folders(spark, tmp_path):
    root = str(tmp_path / "table")
    table = bars(spark, [f"{i:06d}" for i in range(40)])
    stamps = lambda: {f: os.path.getmtime(os.path.join(root, f)) for f in os.listdir(root) if f.startswith("folder=")}
    for i, part in enumerate((table, bars(spark, ["000003"], close=9.0, days=1))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    run = lambda i: upserts.stream_upserts(spark.readStream.schema(table.schema).parquet(str(tmp_path / f"in{i}")), root, str(tmp_path / f"check{i}"), folders=8).awaitTermination()
    run(0)
    before = stamps()
    run(1)
    after = stamps()
    assert sum(before[f] != after[f] for f in before) == 1
    got = spark.read.parquet(root)
    assert got.count() == 120 and got.where("close = 9").count() == 1


def test_parameters_and_folds(spark):
    assert models.spark_parameters(models.parameters("xgboost")) == {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}
    import random

    for model in models.SPACES:
        for seed in range(20):
            drawn = models.draw(model, random.Random(seed), {"learning_rate": 0.5})
            assert drawn["learning_rate"] == 0.5
            assert all(low <= drawn[n] <= high for n, (_, low, high, *_) in models.SPACES[model].items() if n != "learning_rate")
    # The gap of each fold is filled with its own median, whatever the other holds.
    rows = [("a", float(i), 2.0 * i) for i in range(9)] + [("a", None, 8.0)] + [("b", 100.0 + i, 0.0) for i in range(9)]
    fitted = ridge.fit_groups(spark.createDataFrame(rows, "fold string, x double, y double"), ["x"], "y", "fold", 0.0)
    assert fitted["a"].medians == [4.0] and fitted["a"].weights[0] / fitted["a"].scales[0] == pytest.approx(2.0) and fitted["b"].weights[0] == pytest.approx(0.0)
    assert set(FAMILIES) == {f.family for f in factors.REGISTRY.listed()} and "beta" in factors.REGISTRY.described("market")


def test_profiles_and_groups(tmp_path):
    import yaml

    (tmp_path / "ashare").mkdir()
    (tmp_path / "ashare" / "p.yaml").write_text(yaml.safe_dump({"market_cap_bucket_count": 3}))
    own = {"features": ["return_5"], "train": {"start": "2024-01-01", "end": "2024-02-01"}, "signal_test": {"start": "2024-03-01", "end": "2024-04-01"}, "research_profile": "p"}
    (tmp_path / "one.yaml").write_text(yaml.safe_dump(own))
    (tmp_path / "two.yaml").write_text(yaml.safe_dump(own | {"market_cap_bucket_count": 7}))
    (tmp_path / "group.yaml").write_text(yaml.safe_dump({"name": "g", "experiments": ["one.yaml", "two.yaml"]}))
    found = experiment.load_group(str(tmp_path / "group.yaml"), str(tmp_path))
    assert [(e.name, e.group, e.cap_buckets, e.profile) for e in found] == [("one", "g", 3, "p"), ("two", "g", 7, "p")]
    assert found[0].industry_standard == experiment.PROFILE["industry_standard"]
    with pytest.raises(FileNotFoundError):
        experiment.load_profile("none", str(tmp_path))


def test_training_and_tree_prediction_commands(spark, tmp_path, capsys):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(s, "m", datetime(2024, 1, 1) + timedelta(days=i), x, x + 0.2, x - 0.2, x, 100.0, None, None) for s in ("000001", "000002", "000003") for i, x in enumerate((10 + rng.normal(0, 0.1, 70).cumsum()).tolist())]
    sources.write(spark.createDataFrame(rows, sources.BARS), str(tmp_path / "bars"))
    where = ["--bars", str(tmp_path / "bars")]
    assert main(["train", "--list-features", "--feature-family", "market"]) == 0 and "beta_20_hs300" in capsys.readouterr().out
    path = str(tmp_path / "trees")
    options = ["--model", "xgboost", "--model-param", "n_estimators=2", "--model-param", "max_depth=2", "--feature", "return_5", "--symbol", "1", "--symbol", "2", "--symbol", "3"]
    assert main(["train", *where, "--artifact-path", path, "--start-date", "2024-01-10", "--end-date", "2024-02-20", *options]) == 0
    assert json.loads(capsys.readouterr().out)["model_params"]["n_estimators"] == 2
    assert main(["predict", "--symbol", "000002", "--date", "2024-03-01", "--artifact", path, "--json", *where]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["context_size"] == 3
    spec = {"name": "trees", "model": "xgboost", "features": ["return_5"], "train": {"start": "2024-01-10", "end": "2024-02-20"}, "signal_test": {"start": "2024-02-25", "end": "2024-03-10"}, "validation": {"train_size": 20, "valid_size": 8}}
    import yaml

    (tmp_path / "t.yaml").write_text(yaml.safe_dump(spec))
    assert main(["experiment", str(tmp_path / "t.yaml"), "--out", str(tmp_path), "--backfill", *where]) == 0
    assert json.loads(capsys.readouterr().out)[0]["in_sample"] is True
