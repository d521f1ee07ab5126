"""Command line: ``python -m barloom <command>``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from barloom.operators.factors import REGISTRY
from barloom.session import session


def _features(a: argparse.Namespace) -> None:
    for f in REGISTRY.listed(a.family, a.tag):
        print(f"{f.name}\t{f.family}\t{f.kind}\t{f.lookback}\t{','.join(f.tags)}")


def _references(spark, root: str | None) -> dict:
    names = ("benchmark", "fundamentals", "industry", "dividends")
    return {n: spark.read.parquet(os.path.join(root, n)) for n in names if root and os.path.isdir(os.path.join(root, n))}


def _experiment(a: argparse.Namespace) -> None:
    from barloom.operators.dataset import Prepared
    from barloom.plans import experiment
    from barloom.sources.bars import load

    if bool(a.spec) == bool(a.group):
        raise SystemExit("give experiment files or one --group file")
    spark = session("experiment")
    specs = experiment.load_group(a.group, a.profiles) if a.group else [experiment.load(p, root=a.profiles) for p in a.spec]
    prepared = Prepared(load(spark, a.bars, kind=a.provider), _references(spark, a.references))
    if a.backfill:
        out = [experiment.backfill(prepared, e, os.path.join(a.out, e.name)) for e in specs]
    else:
        out = experiment.run_group(spark, specs, prepared, a.out, a.parallel, a.resume, a.continue_on_error)
    print(json.dumps(out, default=str, indent=2))


def _train(a: argparse.Namespace) -> None:
    from barloom.operators.dataset import Prepared
    from barloom.plans import experiment
    from barloom.sources import bars as sources

    if a.list_features:
        for f in REGISTRY.listed():
            if not a.feature_family or f.family in a.feature_family:
                print(f"{f.name}\t{f.family}\t{f.kind}\t{f.lookback}\t{','.join(f.tags)}")
        return
    if not a.feature or not a.artifact_path or not a.bars:
        raise SystemExit("training needs --feature, --artifact-path and --bars")
    spark = session("train")
    parameters = {k: experiment.coerce(v) for k, _, v in (x.partition("=") for x in a.model_param)}
    symbols = a.symbols or ([r.symbol for r in sources.universe(spark.read.csv(a.universe, header=True)).collect()] if a.universe else None)
    bars = sources.load_batch(spark, a.bars, symbols, kind=a.provider) if symbols else sources.load(spark, a.bars, kind=a.provider)
    validation = {"mode": a.validation_mode, "purge": a.purge_size, "embargo": a.embargo_size, "expanding": a.wf_expanding} | {k: v for k, v in (("train_size", a.wf_train_size), ("valid_size", a.wf_valid_size), ("step", a.wf_step_size), ("start", a.valid_start_date), ("end", a.valid_end_date), ("train_end", a.train_end_date)) if v is not None}
    tuning = {"enabled": True, "trials": a.trials, "metric": a.tune_metric, "top": a.keep_top_trials} if a.trials else {}
    target = {"future_return": "return", "cross_sectional_rank": "rank"}[a.target_mode]
    e = experiment.Experiment(os.path.basename(a.artifact_path.rstrip("/")), a.model, tuple(a.feature), (a.start_date, a.end_date), ("", ""), parameters=parameters, horizon=a.label_horizon, target=target, normalization=a.normalization, validation=validation, tuning=tuning)
    meta, _ = experiment.train(e, Prepared(bars, _references(spark, a.references)), a.artifact_path)
    print(json.dumps(meta, default=str, indent=2))


def _sync_bars(a: argparse.Namespace) -> int:
    from datetime import date

    from barloom.plans import sync
    from barloom.sources.bars import universe

    spark = session("sync-bars")
    names = a.symbols or [r.symbol for r in universe(spark.read.csv(a.universe, header=True)).orderBy("seq").collect()]
    out = sync.sync_bars(spark, names, sync.named(a.fetch), a.target, date.fromisoformat(a.start_date), date.fromisoformat(a.end_date), a.adjust, lookback_days=a.lookback_days, asked_workers=a.workers, timeout=a.timeout, overwrite=a.overwrite)
    print(json.dumps(out))
    return int(out["failed"] > 0 and a.fail_on_error)


def _sync_references(a: argparse.Namespace) -> int:
    from datetime import date

    from barloom.plans import sync
    from barloom.sources.bars import universe

    spark = session("sync-references")
    names = a.symbols or [r.symbol for r in universe(spark.read.csv(a.universe, header=True)).orderBy("seq").collect()]
    out = sync.sync_references(spark, names, sync.named(a.fetch), a.target, date.fromisoformat(a.end_date), a.scope, asked_workers=a.workers, timeout=a.timeout, names=json.loads(a.names))
    print(json.dumps(out))
    return int(out["failed"] > 0 and a.fail_on_error)


def _sync_universe(a: argparse.Namespace) -> None:
    from barloom.plans import sync

    print(sync.sync_universe(session("sync-universe"), sync.named(a.fetch), a.index_symbol, a.output_name, a.root, json.loads(a.names)))


def _compare(a: argparse.Namespace) -> None:
    from barloom.plans import experiment

    spark = session("compare")
    summaries = []
    for name in sorted(os.listdir(a.root)):
        path = os.path.join(a.root, name, "summary.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                summaries.append(json.load(f))
    frame = experiment.compare(spark, summaries)
    if a.output_csv:
        frame.coalesce(1).write.mode("overwrite").csv(a.output_csv, header=True)
    frame.select("name", "model", "feature_count", "rank_ic", "test_ic", "test_rank_ic", "test_rank_icir", "pbo").show(1000, truncate=False)


def _predict(a: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from barloom.operators import models, predict
    from barloom.operators.dataset import Spec, business_days_before, inference_dataset
    from barloom.sources.bars import load, universe
    from barloom.sources.control import load_artifact

    spark = session("predict")
    model, known = load_artifact(a.artifact)
    features = known["features"]
    context = [r.symbol for r in universe(spark.read.csv(a.universe, header=True)).orderBy("seq").collect()] if a.universe else None
    symbols = None if context is None else [*context, a.symbol]
    rows = predict.padding(REGISTRY.lookback(features))
    start = business_days_before(a.date, rows).isoformat()
    bars = load(spark, a.bars, symbols if a.universe else [a.symbol] if a.no_context else None, start, a.date, a.provider)
    frame = inference_dataset(bars, Spec(tuple(features), normalization=a.normalization), **_references(spark, a.references))
    own = predict.latest_row(frame, features, a.date, a.symbol).select(F.to_date("timestamp").cast("string").alias("d")).first()
    if own is None:
        raise ValueError(f"no complete row for {a.symbol} on or before {a.date}")
    found = predict.context(models.scorer(model, features)(frame), own.d, a.symbol, context).first().asDict()
    print(json.dumps(found, default=str) if a.json else "\n".join(f"{k}: {v}" for k, v in found.items()))


def _build(a: argparse.Namespace) -> int:
    from barloom.sources.bars import build_parquet, universe

    spark = session("build")
    symbols = a.symbols or ([r.symbol for r in universe(spark.read.csv(a.universe, header=True)).collect()] if a.universe else None)
    out = build_parquet(spark, a.source, a.target, a.provider, a.overwrite, symbols, a.adjust)
    print(json.dumps(out))
    return int(bool(out["failed"]) and a.fail_on_error)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="barloom")
    sub = top.add_subparsers(required=True)

    def command(name, run, *options, bars=False):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if bars:
            options = (("--bars", {"required": True}), ("--provider", {"default": "parquet"}), ("--references", {}), *options)
        for flag, kind in options:
            p.add_argument(flag, **kind)

    yes = {"action": "store_true"}
    command("features", _features, ("--family", {}), ("--tag", {}))
    command("experiment", _experiment, ("spec", {"nargs": "*"}), ("--group", {}), ("--profiles", {"default": "configs/profiles"}), ("--out", {"required": True}), ("--parallel", {"type": int, "default": 1}), ("--resume", yes), ("--continue-on-error", yes), ("--backfill", yes), bars=True)
    command("compare", _compare, ("root", {}), ("--output-csv", {}))
    command("predict", _predict, ("--symbol", {"required": True}), ("--date", {"required": True}), ("--artifact", {"required": True}), ("--universe", {}), ("--no-context", yes), ("--normalization", {"default": "none"}), ("--json", yes), bars=True)
    many, whole, seconds = {"action": "append", "default": []}, {"type": int}, {"type": float, "default": 60.0}
    members = (("--symbol", {"dest": "symbols", "action": "append"}), ("--universe", {}))
    command(
        "train", _train, ("--bars", {}), ("--provider", {"default": "parquet"}), ("--references", {}), *members, ("--start-date", {}), ("--end-date", {}), ("--train-end-date", {}), ("--valid-start-date", {}), ("--valid-end-date", {}),
        ("--artifact-path", {}), ("--model", {"default": "ridge", "choices": ("ridge", "xgboost", "catboost")}), ("--model-param", many), ("--label-horizon", {"type": int, "default": 5}), ("--target-mode", {"default": "future_return", "choices": ("future_return", "cross_sectional_rank")}),
        ("--feature", many), ("--feature-family", many), ("--list-features", yes), ("--normalization", {"default": "none"}), ("--validation-mode", {"default": "holdout", "choices": ("holdout", "walk_forward")}), ("--wf-train-size", whole), ("--wf-valid-size", whole), ("--wf-step-size", whole),
        ("--wf-expanding", yes), ("--purge-size", {"type": int, "default": 0}), ("--embargo-size", {"type": int, "default": 0}), ("--trials", whole), ("--tune-metric", {"default": "rank_ic"}), ("--keep-top-trials", {"type": int, "default": 5}),
    )
    command("build-parquet", _build, ("source", {}), ("target", {}), ("--provider", {"default": "csv"}), *members, ("--adjust", {"default": "raw"}), ("--overwrite", yes), ("--fail-on-error", yes))
    loading = (("--fetch", {"required": True, "help": "module:function that downloads"}), ("--target", {"required": True}), *members, ("--workers", whole), ("--timeout", seconds), ("--fail-on-error", yes))
    command("sync-bars", _sync_bars, *loading, ("--start-date", {"required": True}), ("--end-date", {"required": True}), ("--adjust", {"default": "qfq"}), ("--lookback-days", {"type": int, "default": 7}), ("--overwrite", yes))
    command("sync-references", _sync_references, *loading, ("--end-date", {"required": True}), ("--scope", {"default": "all"}), ("--names", {"default": "{}"}))
    command("sync-universe", _sync_universe, ("--fetch", {"required": True}), ("--index-symbol", {"required": True}), ("--output-name", {"required": True}), ("--root", {"required": True}), ("--names", {"default": "{}"}))
    a = top.parse_args(argv)
    return a.run(a) or 0


if __name__ == "__main__":
    sys.exit(main())
