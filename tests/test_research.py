"""Labels, splits, metrics, models, diagnostics, ingestion, sources and experiments."""

import dataclasses
import json
import os
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cross_section as X
from barloom.operators import dataset, diagnostics, ingest, metrics, models, predict, ridge, splits
from barloom.plans import experiment
from barloom.sources import bars as sources
from barloom.sources import control, symbols
from barloom.streaming.upserts import stream_upserts

D0 = datetime(2024, 1, 1)


def scored(spark, rows):
    return spark.createDataFrame([(D0 + timedelta(days=d), s, None if p is None else float(p), None if y is None else float(y)) for d, s, p, y in rows], "timestamp timestamp_ntz, symbol string, prediction double, label double")


def test_information_coefficients(spark):  # X9, X12
    rows = [(0, s, p, y) for s, p, y in zip("abc", (1, 2, 3), (1, 2, 3))] + [(1, s, p, y) for s, p, y in zip("abc", (3, 2, 1), (1, 2, 3))]
    got = metrics.evaluate(scored(spark, rows)).first()
    assert (got.ic, got.rank_ic, got.ic_std, got.rank_icir) == (pytest.approx(0), pytest.approx(0), pytest.approx(1), pytest.approx(0))
    got = metrics.evaluate(scored(spark, [(0, "a", 0.9, 1), (0, "b", 0.1, 0), (1, "a", 0.8, 1), (1, "b", 0.2, 0), (2, "a", 1, 1), (3, "a", None, 1)])).first()
    assert got.rank_ic == pytest.approx(1) and got.rank_icir == 0 and got.ndcg_at_10 == pytest.approx(1)
    nothing = metrics.evaluate(scored(spark, [])).first()
    assert set(nothing.asDict().values()) == {0.0}


def test_cross_section(spark):  # X10, E6, E17
    df = scored(spark, [(0, "a", 1, 0), (0, "b", 3, 0), (1, "a", 2, 0), (1, "b", 4, 0)]).withColumn("f", F.col("prediction"))
    assert [r.f for r in X.normalize(df, ["f"], "rank").orderBy("timestamp", "symbol").collect()] == [0.5, 1, 0.5, 1]
    z = [r.f for r in X.normalize(df, ["f"], "zscore").orderBy("timestamp", "symbol").collect()]
    assert z[0] < 0 < z[1] and z[2] < 0 < z[3]
    with pytest.raises(ValueError):
        X.normalize(df, ["f"], "other")
    tied = scored(spark, [(0, s, p, 0) for s, p in zip("abcd", (1, 2, 2, None))]).withColumn("r", X.rank_pct("prediction"))
    assert [r.r for r in tied.orderBy("symbol").collect()] == [pytest.approx(1 / 3), pytest.approx(5 / 6), pytest.approx(5 / 6), None]
    cut = X.buckets(scored(spark, [(0, s, i, 0) for i, s in enumerate("abcdefg")]), "prediction", 3, "b")
    assert [r.b for r in cut.orderBy("symbol").collect()] == ["cap_q1_smallest"] * 2 + ["cap_q2"] * 2 + ["cap_q3_largest"] * 3


def test_labels(spark):  # X11
    df = spark.createDataFrame([], "timestamp timestamp_ntz, symbol string, close double")
    assert {"future_return_3d", "future_return_rank_3d"} <= set(X.with_label(df, 3, True).columns)
    with pytest.raises(ValueError):
        X.future_return(0)


def test_splits(spark):  # E15, E16
    folds = splits.walk_forward(12, 5, 2, 2, 1, 1)
    assert [(f.train, f.valid) for f in folds] == [((0, 3), (6, 7)), ((0, 5), (8, 9)), ((0, 7), (10, 11))]
    assert splits.walk_forward(12, 5, 2, 2, 1, 1, expanding=False)[1].train == (2, 5)
    h = splits.holdout(10, 5, 2, 1)
    assert h.train == (0, 3) and h.valid == (7, 9) and splits.holdout(10, None).valid == (0, -1)
    for bad in ((3, 5, 2), (12, 0, 2)):
        with pytest.raises(ValueError):
            splits.walk_forward(*bad)
    with pytest.raises(ValueError):
        splits.check_windows("2024-01-31", "2024-01-31")
    assert splits.tuning_split(10, 6, 2) == ((0, 4), (7, 9))
    df = scored(spark, [(d, s, 1, 1) for d in range(12) for s in "ab"])
    assert {r.fold: r["count"] for r in splits.members(df, folds).groupBy("fold").count().collect()} == {"fold_1": 4, "fold_2": 4, "fold_3": 4}


def test_padding_and_trim(spark):  # X18, FLT3
    assert dataset.business_days_before("2025-01-01", 252) == date(2024, 1, 15)
    assert dataset.business_days_before("2024-03-16", 1) == date(2024, 3, 15)
    rows = [("a", datetime(2024, 12, 20) + timedelta(days=i), *[10.0 + i] * 4, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double")
    spec = dataset.Spec(("return_5",), 2, start="2025-01-01", end="2025-01-10")
    out = dataset.training_dataset(df, spec).orderBy("timestamp").collect()
    assert out[0].timestamp == datetime(2025, 1, 1) and out[-1].timestamp == datetime(2025, 1, 8)
    prepared = dataset.Prepared(df)
    assert prepared.get(spec) is prepared.get(dataset.Spec(("return_5",), 2, start="2025-01-01", end="2025-01-10"))
    prepared.clear()
    assert dataset.sessions_before(df, "2025-01-01", 3) == date(2024, 12, 29)


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(5, [1, 10, 0.1], (200, 3)), None
    y = x @ [0.5, -0.1, 3] + rng.normal(0, 0.3, 200)
    df = spark.createDataFrame([(*map(float, r), float(t), "ab"[i % 2]) for i, (r, t) in enumerate(zip(x, y))], "a double, b double, c double, y double, g string")
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 25 * np.eye(3), z.T @ (y - y.mean()))
    model = ridge.fit(df, ["a", "b", "c"], "y", 25.0)
    assert model.weights == pytest.approx(w.tolist(), abs=1e-8)
    got = [r.prediction for r in ridge.score(df, ridge.Ridge.from_json(model.to_json())).collect()]
    assert got == pytest.approx((z @ w + y.mean()).tolist(), abs=1e-8)
    both = ridge.fit_groups(df, ["a", "b", "c"], "y", "g", 25.0)
    assert both["a"].weights == pytest.approx(ridge.fit(df.where("g = 'a'"), ["a", "b", "c"], "y", 25.0).weights, abs=1e-7)
    gap = df.withColumn("a", F.when(F.col("a") > 4, F.col("a")))
    scores = ridge.score(gap, ridge.fit(gap, ["a", "b", "c"], "y"))
    assert scores.where("(prediction is null) <> (a is null)").count() == 0


def test_overfitting():  # E18
    assert diagnostics.overfit_probability([[1, 1], [0, 0]])["pbo"] == 1.0
    assert diagnostics.overfit_probability([[1, 1], [0, 0]])["selected_oos_rank_pct"] == pytest.approx(1 / 3)
    assert diagnostics.overfit_probability([[1, 1], [0, 0]], orientation="paper")["pbo"] == 0.0
    assert diagnostics.overfit_probability([[1, 1]])["pbo"] is None


def test_deflated_sharpe(spark):
    r = np.random.default_rng(3).normal(0.001, 0.01, 50)
    df = spark.createDataFrame([(float(x),) for x in r], "r double")
    got = diagnostics.deflated_sharpe(df, "r", 1)
    import pandas as pd

    s = pd.Series(r)
    sharpe = s.mean() / s.std(ddof=0) * 252**0.5
    spread = 1 - s.skew() * sharpe + (s.kurtosis() + 2) / 4 * sharpe**2
    from statistics import NormalDist

    assert got["dsr"] == pytest.approx(NormalDist().cdf(sharpe * 49**0.5 / spread**0.5))
    assert diagnostics.deflated_sharpe(df, "r", 20)["dsr"] < got["dsr"]


def test_statements(spark):  # X13, X14
    ends = ["2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31", "2024-03-31"]
    balance = spark.createDataFrame([("a", d, d, 1000.0 + i, 500.0, 700.0, 100.0, 95.0 + i * 8.75, 45.0 + i * 6.25) for i, d in enumerate(ends)], "symbol string, REPORT_DATE string, NOTICE_DATE string, TOTAL_ASSETS double, TOTAL_LIABILITIES double, TOTAL_EQUITY double, SHARE_CAPITAL double, INVENTORY double, ACCOUNTS_RECE double")
    profit = spark.createDataFrame([("a", d, x) for d, x in zip(ends, (10.0, 30.0, 60.0, 100.0, 20.0))], "symbol string, REPORT_DATE string, PARENT_NETPROFIT double")
    cash = spark.createDataFrame([("a", d, 1.0) for d in ends[1:]], "symbol string, REPORT_DATE string, NETCASH_OPERATE double")
    rows = ingest.fundamentals(balance, profit, cash).orderBy("report_date").collect()
    assert len(rows) == 5 and rows[-1].total_liabilities == 500 and rows[-1].total_parent_equity == 700
    assert rows[-1].inventory_growth == pytest.approx(130 / 95 - 1) and rows[-1].receivables_growth == pytest.approx(70 / 45 - 1)
    assert [r.parent_netprofit_ttm for r in rows] == [None, None, None, 100, 110]
    raw = spark.createDataFrame([("a", "2024-03-11", 12.0), ("a", "2024-03-11", 8.0), ("a", None, 1.0)], "symbol string, ex string, cash double")
    out = ingest.dividends(raw, {"ex_date": "ex", "cash_per_ten": "cash"}).orderBy("cash_dividend_per_share").collect()
    assert [r.cash_dividend_per_share for r in out] == pytest.approx([0.8, 1.2]) and out[0].event_date == date(2024, 3, 11)


def test_upsert(spark, tmp_path):  # X15
    day = lambda n: datetime(2026, 4, n)
    kind = "symbol string, timestamp timestamp_ntz, close double"
    old = spark.createDataFrame([("a", day(21), 1.0), ("a", day(22), 2.0)], kind)
    new = spark.createDataFrame([("a", day(22), 20.0), ("a", day(23), 3.0), ("a", day(24), 4.0), ("a", None, 9.0)], kind)
    assert [r.close for r in ingest.upsert(old, new).orderBy("timestamp").collect()] == [1, 20, 3, 4]
    assert ingest.incremental_start(date(2026, 1, 1), date(2026, 4, 22), date(2026, 4, 24), 2) == date(2026, 4, 20)
    assert ingest.incremental_start(date(2026, 1, 1), date(2026, 4, 24), date(2026, 4, 24), 2) is None
    assert ingest.latest_day(new, ["timestamp", "date"]) == date(2026, 4, 24)
    for i, df in enumerate((old, new)):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(old.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_upserts(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    last = max(os.listdir(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / last)).count() == 4


def test_sources(spark, tmp_path):
    raw = "code_,trade_date,symbol,open,high,low,close,vol\nx,2024-01-02,1,1,2,0.5,1.5,10\nx,2024-01-03,1,1,2,0.5,bad,10\nx,nope,1,1,1,1,1,1\n"
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "000001.csv").write_text(raw)
    df = sources.load(spark, str(tmp_path / "csv"), ["1"], "2024-01-01", "2024-01-03", kind="csv", market="m")
    rows = df.orderBy("timestamp").collect()
    assert [r.close for r in rows] == [1.5, None] and rows[0].symbol == "000001" and df.columns[:3] == ["symbol", "market", "timestamp"]
    assert sources.load(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        sources.load(spark, str(tmp_path / "none"), missing_ok=False)
    with pytest.raises(ValueError):
        sources.provider("xml")
    target = str(tmp_path / "lake")
    assert sources.build_parquet(spark, str(tmp_path / "csv"), target)["built"] == 1
    assert sources.build_parquet(spark, str(tmp_path / "csv"), target)["skipped"] == 1  # X17
    assert sources.build_parquet(spark, str(tmp_path / "none"), target)["failed"] == 1
    assert sources.load(spark, target).count() == 2 and sources.read_sql(spark, target).count() == 2
    u = sources.universe(spark.createDataFrame([("2", ), ("000001",), ("1",), (None,)], "code string")).orderBy("seq").collect()
    assert [r.symbol for r in u] == ["000002", "000001"]
    kinds = spark.createDataFrame([("600000",), ("510300",), ("161725",), ("999999",)], "symbol string")
    master = spark.createDataFrame([("999999", "ETF")], "symbol string, asset_type string")
    assert {r.symbol: r.asset_type for r in symbols.route(kinds, master).collect()} == {"600000": "stock", "510300": "etf", "161725": "lof", "999999": "etf"}


def test_control(tmp_path):
    path = str(tmp_path / "s.json")
    assert not control.is_fresh(path, date(2024, 1, 5), lambda: date(2024, 1, 4))
    assert control.is_fresh(path, date(2024, 1, 5), lambda: date(2024, 1, 6)) and json.load(open(path))["synced_end_date"] == "2024-01-06"
    assert control.is_fresh(path, date(2024, 1, 5), lambda: None)
    skipped, pending = control.sync_plan(["a", "b"], control.scopes_of("all"), lambda s, x: s == "a" or x == "industry")
    assert skipped == ["a"] and pending == [("b", x) for x in ("benchmark", "fundamentals", "dividends")]
    with pytest.raises(ValueError):
        control.scopes_of("some")
    calls = []
    assert control.retry(lambda: calls.append(1) or (1 / (len(calls) - 1)), wait=0) == 1.0
    t = control.Tracker(str(tmp_path), "run", "abc")
    t.record("a", "succeeded")
    t.record("b", "failed", error="x")
    assert t.summary() == {"total": 3, "succeeded": 1, "failed": 1, "skipped": 0, "pending": 1}
    assert control.Tracker(str(tmp_path), "run", "abc").pending() == ["b", "c"]


def panel(spark, n=90):
    rng = np.random.default_rng(5)
    rows = [(s, D0 + timedelta(days=i), x, x + 0.2, x - 0.2, x, 100.0 + i) for s in "abcdef" for i, x in enumerate((10 + rng.normal(0, 0.1, n).cumsum()).tolist())]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double")


def test_experiment_group(spark, tmp_path):
    raw = {"model": "ridge", "features": ["return_5", "close_to_sma_5"], "train": {"start": "2024-01-10", "end": "2024-02-20"}, "signal_test": {"start": "2024-02-25", "end": "2024-03-20"}, "label_horizon": 3, "validation": {"train_size": 20, "valid_size": 8}}
    with pytest.raises(ValueError, match="signal_test"):
        experiment.parse({k: v for k, v in raw.items() if k != "signal_test"})
    one = experiment.parse(raw | {"name": "one"})
    two = experiment.parse(raw | {"name": "two", "tuning": {"enabled": True, "trials": 2, "top": 2}, "feature_normalization": "rank"})
    prepared = dataset.Prepared(panel(spark).persist())
    out = experiment.run_group(spark, [one, two], prepared, str(tmp_path))
    assert [s["name"] for s in out] == ["one", "two"] and len(out[0]["ic_decay"]) == 4 and out[1]["research_diagnostics"]["trial_count"] == 2
    again = experiment.run_group(spark, [one, two], prepared, str(tmp_path))
    assert again[0]["validation_metrics"] == pytest.approx(out[0]["validation_metrics"])
    frame = experiment.compare(spark, out)
    assert len(frame.columns) == 29 and frame.count() == 2
    back = experiment.backfill(prepared, one, str(tmp_path / "one"))
    assert back["in_sample"] and -1 <= back["rank_ic"] <= 1
    assert experiment.rerank([{"validation_metrics": {"rank_ic": 0.1}}, {}, {"validation_metrics": {"rank_ic": 0.3}}], top=1)[0]["validation_metrics"]["rank_ic"] == 0.3
    assert [experiment.coerce(x) for x in ("true", "none", "3", "0.5", "x")] == [True, None, 3, 0.5, "x"]
    prepared.clear()


def test_selection_window_chooses_the_parameters(spark, tmp_path, monkeypatch):
    raw = {"model": "ridge", "features": ["return_5", "close_to_sma_5"], "train": {"start": "2024-01-10", "end": "2024-02-20"}, "signal_test": {"start": "2024-02-25", "end": "2024-03-20"}, "label_horizon": 3, "validation": {"start": "2024-02-10", "train_size": 12, "valid_size": 6}}
    e = experiment.parse(raw | {"name": "tuned", "tuning": {"enabled": True, "trials": 2}, "candidate_selection": {"metric": "mae", "direction": "maximize"}})
    bars = panel(spark).persist()
    index = bars.where("symbol = 'a'").select("timestamp", "close")
    industry = spark.createDataFrame([(s, "2023-01-01", "x" if s < "d" else "y") for s in "abcdef"], "symbol string, change_date string, industry_level_1 string")
    given = [{"trial": i, "params": {"alpha": a}, "score": -i, "fold_scores": [0.1, 0.2]} for i, a in enumerate((1e9, 1e-6))]
    seen = []
    monkeypatch.setattr(experiment.models, "tune", lambda df, *a, **b: seen.append(df.agg({"timestamp": "max"}).first()[0]) or given)
    prepared = dataset.Prepared(bars, {"benchmark": index, "industry": industry})
    out = experiment.run(spark, e, prepared, str(tmp_path))
    chosen = out["candidate_selection"]
    scores = {c["candidate_index"]: c["selection_signal_metrics"]["mae"] for c in chosen["candidates"]}
    best = max(scores, key=scores.get)
    assert len(set(scores.values())) == 2 and chosen["selected_candidate_index"] == best
    assert out["training_metadata"]["model_params"]["alpha"] == given[best - 1]["params"]["alpha"]
    flipped = experiment.select_candidate(prepared.get(e.spec(*e.train)), prepared.get(e.spec("2024-01-10", "2024-02-09")), dataclasses.replace(e, selection={"metric": "mae", "direction": "minimize"}), given, "2024-02-10")
    assert flipped["selected_candidate_index"] == 3 - best
    assert str(seen[0].date()) < "2024-02-10"
    row = experiment.compare(spark, [out]).first()
    assert row.tuned and row.candidate_metric == "mae" and row.target_mode == "return" and (row.validation_mode, row.selection_validation_mode) == ("walk_forward", "holdout")
    assert {r["bucket"] for r in out["slices"]["industry_level_1"]} == {"x", "y"} and out["slices"]["market_regime"] and out["years"]
    prepared.clear()


def test_trees_and_context(spark):
    data = dataset.training_dataset(panel(spark, 60), dataset.Spec(("return_5", "close_to_sma_5"), 3))
    score = models.fit(data, "xgboost", ["return_5", "close_to_sma_5"], "future_return_3d", {"maxIter": 2, "maxDepth": 2})
    rows = score(data.unionByName(data.limit(1).withColumn("return_5", F.lit(None).cast("double"))))
    assert rows.where("prediction is null").count() == 1
    with pytest.raises(ValueError):
        models.tune(data, "ridge", ["return_5"], "future_return_3d", [], metric="spearman_ic")
    df = scored(spark, [(0, s, p, 0) for s, p in zip("abcd", (4, 3, 2, 1))])
    got = predict.context(df, "2024-01-01", "b", ["a", "c"]).first()
    assert (got.score_rank, got.score_percentile, got.context_size, got.top_score, got.median_score, got.bottom_score) == (2, pytest.approx(2 / 3), 3, 4, 3, 2)
    assert predict.padding(10) == 40 and predict.padding(50) == 100
    assert predict.latest_row(df.withColumn("f", F.col("prediction")), ["f"], "2024-01-05", "a").count() == 1
