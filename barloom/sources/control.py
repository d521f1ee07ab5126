"""Small driver-side state: sync metadata, run manifests, artifacts, sync plans and retries."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable, Iterable
from datetime import date
from typing import Any, TypeVar

SCOPES = ("benchmark", "fundamentals", "industry", "dividends")
V = TypeVar("V")


def _write(path: str, value: Any) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
    os.replace(path + ".tmp", path)


def _read(path: str) -> Any:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_sync(path: str, end: date, column: str) -> None:
    _write(path, {"synced_end_date": end.isoformat(), "date_column": column})


def is_fresh(path: str, end: date, infer: Callable[[], date | None], column: str = "timestamp") -> bool:
    """Whether data reach ``end``: by the metadata, or else by the data, which then writes the metadata."""
    if os.path.exists(path) and date.fromisoformat(_read(path)["synced_end_date"]) >= end:
        return True
    latest = infer()
    if latest is None or latest < end:
        return False
    write_sync(path, latest, column)
    return True


def scopes_of(name: str) -> tuple[str, ...]:
    """all, or one scope as ``<scope>-only``."""
    known = {"all": SCOPES} | {f"{s}-only": (s,) for s in SCOPES}
    if name not in known:
        raise ValueError(f"Unknown sync scope: {name}. Available scopes: {', '.join(known)}")
    return known[name]


def sync_plan(symbols: Iterable[str], scopes: Iterable[str], fresh: Callable[[str, str], bool]) -> tuple[list[str], list[tuple[str, str]]]:
    """Symbols to skip (every scope is fresh) and the pending (symbol, scope) tasks."""
    skipped, pending = [], []
    for s in symbols:
        stale = [x for x in scopes if not fresh(s, x)]
        pending += [(s, x) for x in stale]
        if not stale:
            skipped.append(s)
    return skipped, pending


def retry(call: Callable[[], V], attempts: int = 3, wait: float = 1.0, timeout: float | None = None) -> V:
    """``call`` with a growing pause between attempts.

    With ``timeout`` a call that hangs is left behind in its daemon thread after so many
    seconds and counts as a failure.
    """
    for n in range(1, attempts + 1):
        try:
            return call() if timeout is None else _within(call, timeout)
        except Exception:
            if n == attempts:
                raise
            time.sleep(wait * n)
    raise ValueError("attempts must be at least 1")


def _within(call: Callable[[], V], seconds: float) -> V:
    done: list[tuple[bool, Any]] = []

    def run() -> None:
        try:
            done.append((True, call()))
        except BaseException as error:  # noqa: BLE001 - raised again in the caller's thread
            done.append((False, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise TimeoutError(f"took longer than {seconds} s")
    good, value = done[0]
    if not good:
        raise value
    return value


def workers(tasks: int, asked: int | None, most: int = 8) -> int:
    return max(1, min(tasks, asked or most, most))


class Tracker:
    """Manifest, summary and failures of a run, rewritten at every event so that it can resume."""

    def __init__(self, root: str, name: str, items: Iterable[str]):
        self.root, self.name, self.items = root, name, list(items)
        self.state: dict[str, dict[str, Any]] = {}
        if os.path.exists(self.path("manifest")):
            before = _read(self.path("manifest"))["items"]
            self.state = {k: v for k, v in before.items() if k in self.items and v["status"] in ("succeeded", "skipped")}
        self._save()

    def path(self, what: str) -> str:
        return os.path.join(self.root, f"{self.name}.{what}.json")

    def record(self, item: str, status: str, **details: Any) -> None:
        if status not in ("succeeded", "failed", "skipped"):
            raise ValueError(f"unknown status {status}")
        self.state[item] = {"status": status, **details}
        self._save()

    def pending(self) -> list[str]:
        return [i for i in self.items if self.state.get(i, {}).get("status") not in ("succeeded", "skipped")]

    def summary(self) -> dict[str, int]:
        count = lambda s: sum(x["status"] == s for x in self.state.values())
        return {"total": len(self.items), "succeeded": count("succeeded"), "failed": count("failed"), "skipped": count("skipped"), "pending": len(set(self.items) - set(self.state))}

    def _save(self) -> None:
        _write(self.path("manifest"), {"name": self.name, "items": self.state})
        _write(self.path("summary"), self.summary())
        _write(self.path("failures"), {k: v for k, v in self.state.items() if v["status"] == "failed"})


def save_artifact(path: str, model: Any, metadata: dict[str, Any]) -> None:
    """metadata.json beside the model: JSON for ridge, Spark ML's own folder for trees; nothing is pickled."""
    os.makedirs(path, exist_ok=True)
    if hasattr(model, "to_json"):
        with open(os.path.join(path, "model.json"), "w", encoding="utf-8") as f:
            f.write(model.to_json())
    else:
        model.write().overwrite().save(os.path.join(path, "model"))
    _write(os.path.join(path, "metadata.json"), metadata)


def load_artifact(path: str) -> tuple[Any, dict[str, Any]]:
    metadata = _read(os.path.join(path, "metadata.json"))
    if os.path.exists(os.path.join(path, "model.json")):
        from barloom.operators.ridge import Ridge

        with open(os.path.join(path, "model.json"), encoding="utf-8") as f:
            return Ridge.from_json(f.read()), metadata
    from pyspark.ml.regression import GBTRegressionModel

    return GBTRegressionModel.load(os.path.join(path, "model")), metadata
