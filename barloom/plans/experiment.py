"""Experiments from YAML: prepare, validate, fit, test out of sample, compare and back-fill."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import diagnostics, metrics, models, ridge, splits
from barloom.operators.dataset import Prepared, Spec, inference_dataset, trim
from barloom.operators.cross_section import with_label
from barloom.operators.references import with_industry
from barloom.sources.control import Tracker, load_artifact, save_artifact

COMPARED = ("ic", "ic_std", "icir", "rank_ic", "rank_ic_std", "rank_icir")


@dataclass(frozen=True)
class Experiment:
    name: str
    model: str
    features: tuple[str, ...]
    train: tuple[str, str]
    test: tuple[str, str]
    group: str = ""
    parameters: dict[str, Any] = field(default_factory=dict, hash=False)
    horizon: int = 5
    target: str = "return"
    normalization: str = "none"
    validation: dict[str, Any] = field(default_factory=dict, hash=False)
    tuning: dict[str, Any] = field(default_factory=dict, hash=False)
    windows: tuple[tuple[str, str, str], ...] = ()
    decay: tuple[int, ...] = (1, 3, 5, 10)
    selection: dict[str, Any] = field(default_factory=dict, hash=False)
    profile: str | None = None
    industry_standard: str | None = None
    cap_buckets: int = 5

    def spec(self, start: str, end: str) -> Spec:
        return Spec(self.features, self.horizon, self.target, self.normalization, start, end)


#: What a research profile gives an experiment that says nothing of it (fixed values).
PROFILE = {
    "market": "ashare", "provider": "parquet", "data_root": "data/lake", "universe_root": "data/universe", "reference_root": "data/reference", "timeframe": "1d", "adjust": "qfq",
    "universe": None, "benchmark_symbol": "sh000300", "industry_standard": "申银万国行业分类标准", "market_cap_bucket_count": 5,
}


def _yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_profile(name: str, root: str = "configs/profiles") -> dict[str, Any]:
    """A research profile by path, or by name below ``root`` or its ashare folder, with the defaults under it."""
    places = [name, *(os.path.join(root, sub, name + end) for sub in ("", "ashare") for end in (".yaml", ".yml"))]
    path = next((p for p in places if os.path.isfile(p)), None)
    if path is None:
        raise FileNotFoundError(f"Research profile not found: {name}. Looked for: {', '.join(places)}")
    raw = _yaml(path)
    return PROFILE | {k: v for k, v in raw.items() if v is not None} | {"research_profile": raw.get("name") or os.path.splitext(os.path.basename(path))[0]}


def with_profile(raw: dict[str, Any], profile: dict[str, Any]) -> dict[str, Any]:
    """``raw`` over the profile; what is missing, null or blank comes from the profile."""
    return {k: v for k, v in profile.items() if k != "name"} | {k: v for k, v in raw.items() if v not in (None, "")}


def load(path: str, profile: dict[str, Any] | None = None, root: str = "configs/profiles") -> Experiment:
    """A YAML file over ``profile`` or the one that it names; signal_test must be given."""
    raw = _yaml(path)
    if profile is None and raw.get("research_profile"):
        profile = load_profile(str(raw["research_profile"]), root)
    return parse(with_profile(raw, profile) if profile else raw, os.path.splitext(os.path.basename(path))[0])


def load_group(path: str, root: str = "configs/profiles") -> list[Experiment]:
    """The experiments of a group file: its ``experiments`` are paths beside it, or specs, over the group's own values."""
    raw = _yaml(path)
    shared = {k: v for k, v in raw.items() if k not in ("name", "experiments", "description")} | {"group": raw.get("name") or os.path.splitext(os.path.basename(path))[0]}
    found = []
    for item in raw.get("experiments", []):
        own = item if isinstance(item, dict) else _yaml(os.path.join(os.path.dirname(path), item))
        name = own.get("name") or (os.path.splitext(os.path.basename(item))[0] if isinstance(item, str) else "experiment")
        own = shared | {k: v for k, v in own.items() if v not in (None, "")} | {"name": name}
        found.append(parse(with_profile(own, load_profile(str(own["research_profile"]), root)) if own.get("research_profile") else own, name))
    if len({e.name for e in found}) < len(found):
        raise ValueError("experiments of a group need names of their own")
    return found


def parse(raw: dict[str, Any], name: str = "experiment") -> Experiment:
    if "signal_test" not in raw:
        raise ValueError("experiment needs a signal_test window")
    train, test = raw["train"], raw["signal_test"]
    out = Experiment(
        raw.get("name", name), raw.get("model", "ridge"), tuple(raw["features"]), (str(train["start"]), str(train["end"])), (str(test["start"]), str(test["end"])), raw.get("group", ""),
        raw.get("model_params", {}), int(raw.get("label_horizon", 5)), raw.get("target", "return"), raw.get("feature_normalization", "none"), raw.get("validation", {}), raw.get("tuning", {}),
        tuple((str(w["name"]), str(w["start"]), str(w["end"])) for w in raw.get("signal_windows", [])), tuple(raw.get("ic_decay_horizons", (1, 3, 5, 10))),
        selection=raw.get("candidate_selection") or {}, profile=raw.get("research_profile"), industry_standard=raw.get("industry_standard"), cap_buckets=int(raw.get("market_cap_bucket_count", 5)),
    )
    splits.check_windows(out.train[1], out.test[0], raw.get("validation", {}).get("end"), bool(out.tuning.get("enabled")))
    return out


def coerce(text: str) -> Any:
    """A command-line value as bool, None, int, float or text."""
    words = {"true": True, "false": False, "none": None, "null": None}
    if text.lower() in words:
        return words[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _folds(data: DataFrame, options: dict[str, Any]) -> list[splits.Fold]:
    n = splits.date_index(data).count()
    if options.get("mode", "walk_forward") == "holdout":
        cut = int(n * float(options.get("train_fraction", 0.8))) - 1
        if options.get("train_end"):
            cut = splits.date_index(data).where(F.to_date("timestamp") <= F.lit(str(options["train_end"])).cast("date")).count() - 1
        return [splits.holdout(n, cut, int(options.get("purge", 0)), int(options.get("embargo", 0)))]
    sizes = {k: int(options[k]) for k in ("train_size", "valid_size") if k in options} or {"train_size": n // 2, "valid_size": max(1, n // 6)}
    return splits.walk_forward(n, **sizes, step=options.get("step"), purge=int(options.get("purge", 0)), embargo=int(options.get("embargo", 0)), expanding=bool(options.get("expanding", True)))


def validate(data: DataFrame, model: str, features: list[str], label: str, folds: list[splits.Fold], parameters: dict[str, Any] | None = None) -> DataFrame:
    """fold and its metrics.  All ridge folds are fitted from the same two passes and scored in one plan."""
    if model == "ridge":
        fitted = ridge.fit_groups(splits.members(data, folds, "train"), features, label, "fold", models.parameters(model, parameters)["alpha"])
        return metrics.evaluate(ridge.score_groups(splits.members(data, folds), fitted, "fold"), label=label, by=["fold"])
    parts = [models.fit(splits.members(data, [f], "train"), model, features, label, parameters)(splits.members(data, [f])) for f in folds]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return metrics.evaluate(whole, label=label, by=["fold"])


def _scored(prepared: Prepared, e: Experiment, scorer: Callable[[DataFrame], DataFrame], start: str, end: str) -> DataFrame:
    spec = e.spec(start, end)
    frame = with_label(inference_dataset(prepared.bars, Spec(spec.features, spec.horizon, spec.target, spec.normalization, start, None), **prepared.references), e.horizon, e.target == "rank")
    return trim(scorer(frame).withColumn("label", F.col(spec.label)), start, end)


def selection_start(data: DataFrame, e: Experiment) -> str:
    """First day of the selection window: the validation start, else the last fifth of the training dates."""
    if e.validation.get("start"):
        return str(e.validation["start"])
    dates = splits.date_index(data)
    cut = int(dates.count() * float(e.validation.get("train_fraction", 0.8)))
    return str(dates.where(F.col("date_idx") == cut).first()["timestamp"].date())


def select_candidate(data: DataFrame, before: DataFrame, e: Experiment, trials: list[dict[str, Any]], start: str) -> dict[str, Any]:
    """The kept trials, each refitted on ``before`` and scored on the window of ``data`` from ``start``, best first."""
    label, features = e.spec(*e.train).label, list(e.features)
    window = trim(data, start, e.train[1]).persist()
    rows, found = window.count(), []
    for number, t in enumerate(trials, 1):
        scored = models.fit(before, e.model, features, label, models.parameters(e.model, e.parameters) | t["params"])(window)
        values = metrics.evaluate(scored, label=label).first().asDict()
        found.append({"candidate_index": number, "trial_number": t["trial"], "tuning_score": t["score"], "model_params": t["params"], "validation_metrics": values, "selection_rows": rows})
    window.unpersist()
    metric, direction, top = e.selection.get("metric", "rank_ic"), e.selection.get("direction", "maximize"), int(e.selection.get("top_k", 5))
    ranked = [{("selection_signal_metrics" if k == "validation_metrics" else k): v for k, v in c.items()} for c in rerank(found, metric, direction == "minimize", max(1, top))]
    return {"enabled": True, "config": {"top_k": top, "metric": metric, "direction": direction}, "window": [start, e.train[1]], "candidates": ranked, "selected_candidate_index": ranked[0]["candidate_index"], "selected_metric": metric}


def sliced(scored: DataFrame, e: Experiment, prepared: Prepared) -> dict[str, list[dict[str, Any]]]:
    """Test metrics by year and, where their references are given, by regime, industry and market-cap bucket."""
    given, keys = {k: v for k, v in prepared.references.items() if v is not None}, ["year_window"]
    frame = diagnostics.with_year(scored)
    if "benchmark" in given:
        frame, keys = diagnostics.with_regime(frame, given["benchmark"]), [*keys, "market_regime"]
    if "industry" in given:
        frame, keys = with_industry(frame, given["industry"], e.industry_standard), [*keys, "industry_level_1"]
    if "fundamentals" in given:
        caps = inference_dataset(prepared.bars, Spec(("log_total_mkt_cap",), e.horizon, e.target, "none", *e.test), **given)
        frame, keys = diagnostics.with_cap_buckets(diagnostics.with_caps(frame, trim(caps, *e.test)), e.cap_buckets), [*keys, "market_cap_bucket"]
    out: dict[str, list[dict[str, Any]]] = {k: [] for k in keys}
    for r in diagnostics.in_order(diagnostics.slices(frame, keys)).collect():
        out[r["slice"]].append(r.asDict())
    return out


def train(e: Experiment, prepared: Prepared, home: str) -> tuple[dict[str, Any], Callable[[DataFrame], DataFrame]]:
    """Validate and fit one experiment and store its artifact: the training metadata and the scorer.

    With tuning, trials are drawn and refitted on the days before the selection window,
    the one that does best on the window gives the parameters, and the final model is
    fitted on the whole training range.
    """
    data, features, spec = prepared.get(e.spec(*e.train)), list(e.features), e.spec(*e.train)
    mode = e.validation.get("mode", "walk_forward")
    trials, parameters = [], models.parameters(e.model, e.parameters)
    selection: dict[str, Any] = {"enabled": False, "candidates": [], "selected_metric": e.selection.get("metric", "rank_ic")}
    meta = {"feature_columns": features, "feature_normalization": e.normalization, "label_horizon": e.horizon, "target_mode": e.target, "validation_mode": mode, "selection_validation_mode": mode, "research_profile": e.profile, "tuning": {"enabled": False}}
    if e.tuning.get("enabled"):
        start = selection_start(data, e)
        before = prepared.get(e.spec(e.train[0], (date.fromisoformat(start) - timedelta(days=1)).isoformat()))
        trials = models.tune(before, e.model, features, spec.label, _folds(before, e.validation), int(e.tuning.get("trials", 10)), e.tuning.get("metric", "rank_ic"), int(e.tuning.get("top", 5)), fixed=e.parameters)
        selection = select_candidate(data, before, e, trials, start)
        parameters |= selection["candidates"][0]["model_params"]
        meta |= {"selection_validation_mode": "holdout", "tuning": {"enabled": True, "validation_mode": mode, "metric": e.tuning.get("metric", "rank_ic"), "trial_records": trials}}
        n = splits.date_index(data).count()
        cut = splits.date_index(data).where(F.to_date("timestamp") < F.lit(start).cast("date")).count() - 1
        folds = [splits.holdout(n, cut, int(e.validation.get("purge", 0)), int(e.validation.get("embargo", 0)))]
    else:
        folds = _folds(data, e.validation)
    validation = metrics.mean_of_folds(validate(data, e.model, features, spec.label, folds, parameters)).first().asDict()
    meta |= {"model_params": parameters, "candidate_selection": selection, "validation_metrics": validation}
    scorer = models.fit(data, e.model, features, spec.label, parameters)
    save_artifact(home, scorer.artifact, {"name": e.name, "model": e.model, "features": features, "label": spec.label, "parameters": parameters})
    return meta, scorer


def run(spark: SparkSession, e: Experiment, prepared: Prepared, root: str) -> dict[str, Any]:
    """Train, validate and test one experiment; the summary is also written below ``root``."""
    home, features = os.path.join(root, e.name), list(e.features)
    meta, scorer = train(e, prepared, home)
    selection, trials = meta["candidate_selection"], meta["tuning"].get("trial_records", [])
    summary = {"name": e.name, "group": e.group, "model": e.model, "features": features, "validation_metrics": meta["validation_metrics"], "artifact_path": home, "report_dir": home, "research_profile": e.profile, "feature_normalization": e.normalization, "training_metadata": meta, "candidate_selection": selection}
    scored = _scored(prepared, e, scorer, *e.test).select("symbol", "timestamp", "close", "prediction", "label").persist()
    found = {r["window"]: {m: r[m] for m in metrics.METRICS} for r in by_windows(scored, e.windows).collect()}
    summary["signal_test_metrics"] = found.pop("test", dict.fromkeys(metrics.METRICS, 0.0))
    summary["signal_windows"] = found
    summary["ic_decay"] = [r.asDict() for r in diagnostics.ic_decay(scored, list(e.decay)).collect()]
    summary["slices"] = sliced(scored, e, prepared)
    summary["years"] = summary["slices"]["year_window"]
    summary["research_diagnostics"] = diagnostics.overfit_probability([t["fold_scores"] for t in trials])
    scored.unpersist()
    with open(os.path.join(home, "summary.json"), "w", encoding="utf-8") as f:
        json.dump(summary, f, default=str, indent=2)
    return summary


def by_windows(scored: DataFrame, windows: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """window and its metrics: ``test`` for all rows and each (name, first day, last day), which may overlap."""
    inside = [F.when(F.to_date("timestamp").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in windows]
    tagged = scored.withColumn("window", F.explode(F.filter(F.array(F.lit("test"), *inside), lambda x: x.isNotNull())))
    return metrics.evaluate(tagged, by=["window"])


def rerank(candidates: list[dict[str, Any]], metric: str = "rank_ic", minimize: bool = False, top: int | None = None) -> list[dict[str, Any]]:
    """Candidates by a validation metric, a missing one counting as 0; ties keep their order."""
    value = lambda c: float(c.get("validation_metrics", {}).get(metric) or 0.0)
    return sorted(candidates, key=lambda c: value(c) if minimize else -value(c))[:top]


def run_group(spark: SparkSession, experiments: list[Experiment], prepared: Prepared, root: str, parallel: int = 1, resume: bool = True, keep_going: bool = False) -> list[dict[str, Any]]:
    """All experiments in order; finished ones are read back when resuming, failures recorded."""
    tracker = Tracker(root, "group", [e.name for e in experiments])
    todo = set(tracker.pending()) if resume else {e.name for e in experiments}

    def one(e: Experiment) -> dict[str, Any] | None:
        if e.name not in todo:
            with open(os.path.join(root, e.name, "summary.json"), encoding="utf-8") as f:
                return json.load(f)
        try:
            out = run(spark, e, prepared, root)
            tracker.record(e.name, "succeeded", path=os.path.join(root, e.name))
            return out
        except Exception as error:
            tracker.record(e.name, "failed", error=repr(error))
            if not keep_going:
                raise
            return None

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return [x for x in pool.map(one, experiments) if x is not None]


def compare(spark: SparkSession, summaries: list[dict[str, Any]]) -> DataFrame:
    """One row per experiment, best first by test rank IC, its ratio, validation rank IC and IC."""
    number = lambda d, k: float(d.get(k) or 0.0)
    rows = []
    for s in summaries:
        v, t, d = s.get("validation_metrics", {}), s.get("signal_test_metrics", {}), s.get("research_diagnostics", {})
        meta = s.get("training_metadata", {})
        tuned = meta.get("tuning", {})
        rows.append((
            s.get("name"), s.get("group"), s.get("research_profile") or meta.get("research_profile"), s.get("model"), s.get("feature_normalization", meta.get("feature_normalization")), len(s.get("features") or meta.get("feature_columns", [])),
            tuned.get("validation_mode") or meta.get("validation_mode"), meta.get("selection_validation_mode") or meta.get("validation_mode"), meta.get("target_mode"), bool(tuned.get("enabled")),
            *(number(v, k) for k in COMPARED), *(number(t, k) for k in COMPARED), number(v, "mae"), number(v, "r2"), number(d, "pbo"), number(d, "dsr"), s.get("candidate_selection", {}).get("selected_metric"), s.get("report_dir"), s.get("artifact_path"),
        ))
    text, doubles = " string, ", " double, "
    schema = (
        text.join(("name", "group", "research_profile", "model", "feature_normalization")) + " string, feature_count int, " + text.join(("validation_mode", "selection_validation_mode", "target_mode")) + " string, tuned boolean, "
        + doubles.join((*COMPARED, *(f"test_{k}" for k in COMPARED), "mae", "r2", "pbo", "dsr")) + " double, " + text.join(("candidate_metric", "report_dir", "artifact_path")) + " string"
    )
    return spark.createDataFrame(rows, schema).orderBy(*(F.desc(c) for c in ("test_rank_ic", "test_rank_icir", "rank_ic", "ic")))


def backfill(prepared: Prepared, e: Experiment, path: str) -> dict[str, Any]:
    """Metrics of a stored model of any kind on its own folds; in_sample says that it saw them in training."""
    model, metadata = load_artifact(path)
    data = prepared.get(e.spec(*e.train))
    scored = models.scorer(model, metadata["features"])(splits.members(data, _folds(data, e.validation)))
    row = metrics.mean_of_folds(metrics.evaluate(scored, label=metadata["label"], by=["fold"])).first()
    return row.asDict() | {"in_sample": True}
