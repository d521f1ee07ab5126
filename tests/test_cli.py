import json
from datetime import datetime, timedelta

import numpy as np
import yaml

from barloom.__main__ import main
from barloom.sources import bars as sources
from barloom.sources.remote import normalize_daily


def test_commands(spark, tmp_path, capsys):
    assert main(["features", "--family", "market"]) == 0
    assert "beta_120_hs300" in capsys.readouterr().out
    rng = np.random.default_rng(1)
    rows = [(s, "m", datetime(2024, 1, 1) + timedelta(days=i), x, x + 0.2, x - 0.2, x, 100.0, None, None) for s in ("000001", "000002", "000003") for i, x in enumerate((10 + rng.normal(0, 0.1, 90).cumsum()).tolist())]
    sources.write(spark.createDataFrame(rows, sources.BARS), str(tmp_path / "bars"))
    spec = {"name": "one", "features": ["return_5"], "train": {"start": "2024-01-10", "end": "2024-02-20"}, "signal_test": {"start": "2024-02-25", "end": "2024-03-10"}, "validation": {"train_size": 20, "valid_size": 8}}
    (tmp_path / "one.yaml").write_text(yaml.safe_dump(spec))
    where = ["--bars", str(tmp_path / "bars")]
    assert main(["experiment", str(tmp_path / "one.yaml"), "--out", str(tmp_path / "out"), *where]) == 0
    capsys.readouterr()
    assert main(["compare", str(tmp_path / "out")]) == 0 and "one" in capsys.readouterr().out
    assert main(["predict", "--symbol", "000002", "--date", "2024-03-20", "--artifact", str(tmp_path / "out" / "one"), "--json", *where]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["symbol"] == "000002" and got["context_size"] == 3 and 1 <= got["score_rank"] <= 3


def test_downloaded_bars(spark):
    lots = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 0.5, 1.5, 77.0)], "date string, open double, high double, low double, close double, amount double")
    row = normalize_daily(lots, "000001").first()
    assert (row.volume, row.amount, row.market) == (77.0, None, "ashare")
    plain = spark.createDataFrame([("2024-01-02", "1", "2", "0.5", "1.5", "10", "99")], "`日期` string, `开盘` string, `最高` string, `最低` string, `收盘` string, `成交量` string, `成交额` string")
    row = normalize_daily(plain, "510300", "etf").first()
    assert (row.close, row.volume, row.amount) == (1.5, 10.0, 99.0)
