"""Around a fit: schedules, gradient control, callbacks, evaluation, random search, augmentations, and recovery of calls."""

from __future__ import annotations

import json
import logging
import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import require

log = logging.getLogger(__name__)
Grads = dict[str, np.ndarray]


def cosine_rate(base: float, epoch: int, span: int, least: float = 0.0) -> float:
    return least + (base - least) * (1 + math.cos(math.pi * epoch / span)) / 2


def clip_value(grads: Grads, most: float) -> Grads:
    return {k: np.clip(g, -most, most) for k, g in grads.items()}


def clip_percentile(grads: Grads, share: float = 90.0) -> Grads:
    """Clipped at a percentile of all absolute values."""
    every = np.concatenate([np.abs(g).ravel() for g in grads.values()]) if grads else np.zeros(0)
    return clip_value(grads, float(np.percentile(every, share))) if len(every) else grads


def check_gradients(weights: Grads, grads: Grads) -> None:
    """Same names and shapes, all finite."""
    require(weights.keys() == grads.keys(), "weights and gradients differ in their names")
    for k, g in grads.items():
        require(np.shape(weights[k]) == np.shape(g), f"{k}: shapes differ")
        require(bool(np.isfinite(g).all()), f"{k}: a gradient is not finite")


@dataclass
class Accumulator:
    """Mean of the gradients of ``steps`` small batches; ``add`` gives it when it is full, else None."""

    steps: int
    _held: list[Grads] = field(default_factory=list)

    def add(self, grads: Grads) -> Grads | None:
        self._held.append(grads)
        if len(self._held) < self.steps:
            return None
        out = {k: sum(g[k] for g in self._held) / self.steps for k in grads}
        self._held = []
        return out


@dataclass
class LossScaler:
    """Halved at a gradient that is not finite (the step is then skipped), doubled after ``every`` good steps."""

    scale: float = 2.0**16
    every: int = 2000
    good: int = 0

    def unscaled(self, grads: Grads) -> Grads | None:
        if not all(np.isfinite(g).all() for g in grads.values()):
            self.scale, self.good = self.scale / 2, 0
            return None
        out = {k: g / self.scale for k, g in grads.items()}
        self.good += 1
        if self.good == self.every:
            self.scale, self.good = self.scale * 2, 0
        return out


class Callback:
    """Hooks of a fit; each may be overridden.  ``epoch_end`` gives True to stop."""

    def train_begin(self) -> None: ...
    def train_end(self) -> None: ...
    def epoch_begin(self, epoch: int) -> None: ...
    def epoch_end(self, epoch: int, logs: dict[str, float]) -> bool | None: ...
    def batch_begin(self, batch: int) -> None: ...
    def batch_end(self, batch: int, logs: dict[str, float]) -> None: ...


@dataclass
class Stopping(Callback):
    """Stops once ``monitor`` has not improved by more than ``least`` for ``patience`` epochs; a missing value is an error."""

    monitor: str = "loss"
    mode: str = "min"
    least: float = 0.0
    patience: int = 5
    best: float | None = None
    waited: int = 0

    def epoch_end(self, epoch: int, logs: dict[str, float]) -> bool:
        require(self.monitor in logs, f"{self.monitor!r} is not among {sorted(logs)}")
        sign = 1 if self.mode == "min" else -1
        value = sign * logs[self.monitor]
        if self.best is None or value < sign * self.best - self.least:
            self.best, self.waited = logs[self.monitor], 0
        else:
            self.waited += 1
        return self.waited >= self.patience


@dataclass
class History(Callback):
    rows: list[dict] = field(default_factory=list)

    def epoch_end(self, epoch: int, logs: dict[str, float]) -> None:
        self.rows.append({"epoch": epoch, **logs})

    def table(self, spark: SparkSession) -> DataFrame:
        """(epoch, metric, value), a row for each metric of each epoch."""
        rows = [(r["epoch"], k, float(v)) for r in self.rows for k, v in r.items() if k != "epoch"]
        return spark.createDataFrame(rows, "epoch int, metric string, value double")


@dataclass
class Progress(Callback):
    """Logs each epoch with the time that is left."""

    epochs: int
    began: float = 0.0

    def train_begin(self) -> None:
        self.began = time.monotonic()

    def epoch_end(self, epoch: int, logs: dict[str, float]) -> None:
        left = (time.monotonic() - self.began) / (epoch + 1) * (self.epochs - epoch - 1)
        log.info("epoch %d of %d, %s, %.0f s left", epoch + 1, self.epochs, ", ".join(f"{k} {v:.4f}" for k, v in logs.items()), left)


@dataclass
class Checkpoint(Callback):
    """Saves by ``save(path)`` each epoch, or only when ``monitor`` is the best so far."""

    save: Callable[[str], None]
    path: str
    monitor: str = "loss"
    mode: str = "min"
    best_only: bool = True
    best: float | None = None

    def epoch_end(self, epoch: int, logs: dict[str, float]) -> None:
        value = logs[self.monitor]
        better = self.best is None or (value < self.best if self.mode == "min" else value > self.best)
        if better:
            self.best = value
        if better or not self.best_only:
            self.save(self.path if self.best_only else f"{self.path}/epoch-{epoch}")


def train(step: Callable[[int], dict[str, float]], epochs: int, callbacks: Iterable[Callback] = ()) -> int:
    """Calls ``step(epoch)``, which gives the metrics, until a callback stops it; the number of epochs done."""
    own, done = list(callbacks), 0
    for c in own:
        c.train_begin()
    for epoch in range(epochs):
        for c in own:
            c.epoch_begin(epoch)
        logs, done = step(epoch), epoch + 1
        if any([c.epoch_end(epoch, logs) for c in own]):
            break
    for c in own:
        c.train_end()
    return done


def evaluate(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy (of rounded predictions), mse, rmse, mae in one aggregate; 0 for no row."""
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    names = ("accuracy", "mse", "rmse", "mae")
    values = (F.avg((F.floor(p + 0.5) == y).cast("double")), F.avg((p - y) ** 2), F.sqrt(F.avg((p - y) ** 2)), F.avg(F.abs(p - y)))
    return df.agg(*(F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(names, values, strict=True)))


def model_summary(spark: SparkSession, weights: Grads) -> DataFrame:
    """(name, shape, parameters) of each weight."""
    return spark.createDataFrame([(k, "x".join(map(str, np.shape(w))), int(np.size(w))) for k, w in weights.items()], "name string, shape string, parameters long")


def random_search(space: dict[str, list], trials: int, score: Callable[[dict], float], best: str = "max", seed: int = 42) -> tuple[dict, float, list[tuple[dict, float]]]:
    """(best choice, its score, all trials): independent draws, one value a list; the first of equal scores wins."""
    require(trials > 0 and best in ("max", "min") and all(space.values()), "a search has trials, a direction and values")
    rng = np.random.default_rng(seed)
    tried = []
    for _ in range(trials):
        choice = {k: v[int(rng.integers(len(v)))] for k, v in space.items()}
        tried.append((choice, float(score(choice))))
    pick = (max if best == "max" else min)(tried, key=lambda x: x[1])
    return pick[0], pick[1], tried


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that seed and key fix, the same after a lost task is run again."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), key)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def noise(std: float, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Normal noise on each value (Box-Muller over two uniform numbers of the cell)."""

    def f(a: DataFrame) -> DataFrame:
        def one(v: Column, j: Column) -> Column:
            cell = F.concat_ws("-", F.col("row_id"), j)
            return v + std * F.sqrt(-2 * F.log(1 - uniform(cell, seed))) * F.cos(2 * math.pi * uniform(cell, seed + 1))

        return a.withColumn("values", F.transform("values", one))

    return f


def flip(width: int, share: float = 0.5, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Mirrors a ``share`` of the rows, images of ``width`` columns kept row by row."""

    def f(a: DataFrame) -> DataFrame:
        turned = F.transform("values", lambda v, j: F.get("values", F.floor(j / width).cast("int") * width + (width - 1) - j % width))
        return a.withColumn("values", F.when(uniform(F.col("row_id"), seed) < share, turned).otherwise(F.col("values")))

    return f


def rotate(height: int, width: int, degrees: float, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Turns each image by up to ``degrees`` either way, nearest cell, 0 outside."""

    def f(a: DataFrame) -> DataFrame:
        turn = (2 * uniform(F.col("row_id"), seed) - 1) * math.radians(degrees)
        with_turn = a.withColumn("_c", F.cos(turn)).withColumn("_s", F.sin(turn))
        cy, cx = (height - 1) / 2, (width - 1) / 2

        def one(v: Column, j: Column) -> Column:
            y, x = F.floor(j / width) - cy, j % width - cx
            sy, sx = F.round(F.col("_c") * y - F.col("_s") * x + cy).cast("int"), F.round(F.col("_s") * y + F.col("_c") * x + cx).cast("int")
            inside = (sy >= 0) & (sy < height) & (sx >= 0) & (sx < width)
            return F.when(inside, F.get("values", sy * width + sx)).otherwise(F.lit(0.0))

        return with_turn.withColumn("values", F.transform("values", one)).drop("_c", "_s")

    return f


class EngineError(Exception):
    """An error of a ``kind`` with a tip and the values it is about."""

    def __init__(self, kind: str, message: str, tip: str = "", **context):
        super().__init__(f"{kind}: {message}" + (f" ({tip})" if tip else ""))
        self.kind, self.tip, self.context = kind, tip, context

    def as_json(self) -> str:
        return json.dumps({"kind": self.kind, "message": str(self), "tip": self.tip, "context": {k: str(v) for k, v in self.context.items()}})


def retried(call: Callable[[], object], retries: int = 3, wait: float = 0.1, factor: float = 2.0, fatal: tuple[type[Exception], ...] = (ValueError, TypeError)):
    """``call()``, again after waits that grow by ``factor``; ``fatal`` errors are raised at once."""
    for k in range(retries + 1):
        try:
            return call()
        except fatal:
            raise
        except Exception:
            if k == retries:
                raise
            time.sleep(wait * factor**k)


@dataclass
class Breaker:
    """Refuses calls once over ``share`` of at least ``least`` calls have failed."""

    share: float = 0.1
    least: int = 10
    calls: int = 0
    failed: int = 0

    def __call__(self, call: Callable[[], object]):
        if self.calls >= self.least and self.failed > self.share * self.calls:
            raise EngineError("open", f"{self.failed} of {self.calls} calls failed")
        self.calls += 1
        try:
            return call()
        except Exception:
            self.failed += 1
            raise


@dataclass
class Profiler:
    """Count and seconds (total, least, most) of each name."""

    seen: dict[str, list[float]] = field(default_factory=dict)

    def run(self, name: str, call: Callable[[], object]):
        began = time.perf_counter()
        try:
            return call()
        finally:
            s = time.perf_counter() - began
            n, total, low, high = self.seen.get(name, (0, 0.0, math.inf, 0.0))
            self.seen[name] = [n + 1, total + s, min(low, s), max(high, s)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, int(v[0]), *map(float, v[1:])) for k, v in self.seen.items()], "name string, calls long, total double, least double, most double")
