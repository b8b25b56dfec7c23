"""Interval-censored linear regression, many models at once: gradients are summed where the rows are.

A model has, for each drug, an intercept, a weight for every column and a log sigma. A round is one pass over the examples:
each task adds up the loss and gradient of every model on its Arrow batches, and sends one row for each (model, drug, place).
The optimiser (L-BFGS, a ring of ten steps) holds nothing but such vectors; MOST_NUMBERS bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from susceptra.functions.normal import interval_nll

#: models * drugs * (columns + 2) numbers are held by the driver and by every task.
MOST_NUMBERS = 20_000_000


@dataclass
class Problem:
    """One model: which fold it may not see (None: it sees all), and which weights it may use (drugs x columns)."""

    held: int | None
    allowed: np.ndarray
    weights: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weights = np.zeros((self.allowed.shape[0], self.allowed.shape[1] + 2))


class Lbfgs:
    """Ask for a point, tell its value and gradient; a step that does not lower the value enough is halved."""

    def __init__(self, start: np.ndarray, memory: int = 10):
        self.x, self.f, self.g, self.pairs, self.memory = start, None, None, [], memory
        self.point, self.step, self.done = start, 1.0, False

    def tell(self, f: float, g: np.ndarray, enough: float) -> bool:
        """True if the point was taken; done once the gradient or what a step gains is below `enough`."""
        if self.f is not None and not f <= self.f + 1e-4 * self.step * float(self.g @ self.direction):
            self.step /= 2
            self.done = self.step < 1e-10
            self.point = self.x + self.step * self.direction
            return False
        gained = np.inf if self.f is None else self.f - f
        if self.f is not None and float((self.point - self.x) @ (g - self.g)) > 1e-12:
            self.pairs = [*self.pairs, (self.point - self.x, g - self.g)][-self.memory :]
        self.x, self.f, self.g = self.point, f, g
        self.done = float(np.abs(g).max(initial=0.0)) < enough or 0 <= gained < enough * 1e-2
        q, back = g.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            back.append(a)
            q -= a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(back), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        self.direction = -q if float(q @ g) > 0 else -g
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(1e-12, float(np.abs(g).sum())))
        self.point = self.x + self.step * self.direction
        return True


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    index = b.column("index")
    size = np.diff(index.offsets.to_numpy())
    return tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("drug", "fold", "lower", "upper")) + (np.repeat(np.arange(b.num_rows), size), index.flatten().to_numpy(), b.column("value").flatten().to_numpy())


def batch_sums(b: pa.RecordBatch, points: list[np.ndarray], held: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each model: its gradient (drugs x columns, intercept, log sigma) over rows it may see, and (loss, rows) by drug, seen and held out."""
    drug, fold, lower, upper, row, index, value = _entries(b)
    out, columns = [], points[0].shape[1] - 2
    cell = (drug[row] * (columns + 2) + index).astype(np.int64)  # where an entry's weight lies, in every model
    for w, h in zip(points, held, strict=True):
        mu = w[drug, columns] + np.bincount(row, weights=w.ravel()[cell] * value, minlength=len(drug))
        nll, by_mu, by_sigma = interval_nll(mu, w[drug, columns + 1], lower, upper)
        seen = np.ones(len(drug), bool) if h is None else fold != h
        g = np.bincount(cell, weights=(by_mu * seen)[row] * value, minlength=w.size).reshape(w.shape)
        g[:, columns] += np.bincount(drug, weights=by_mu * seen, minlength=len(w))
        g[:, columns + 1] += np.bincount(drug, weights=by_sigma * seen, minlength=len(w))
        totals = np.stack([np.bincount(drug, weights=x, minlength=len(w)) for x in (nll * seen, 1.0 * seen, nll * ~seen, 1.0 * ~seen)], 1)
        out.append((g, totals))
    return out


def evaluate(examples: DataFrame, points: list[np.ndarray], held: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """batch_sums over all rows: one row for each (model, drug, place) that is not zero leaves a task, and comes to the driver once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(w), w.shape[1] + 4)) for w in points]
        for b in batches:
            for t, (g, sums) in zip(total, batch_sums(b, points, held), strict=True):
                t += np.concatenate((g, sums), 1)
        found = [np.nonzero(t) for t in total]
        model = np.concatenate([np.full(len(f[0]), m) for m, f in enumerate(found)])
        drug, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (model, drug, place)] + [pa.array(np.concatenate([t[f] for t, f in zip(total, found, strict=True)]))], ["model", "drug", "place", "v"])

    rows = examples.mapInArrow(run, "model int, drug int, place int, v double").groupBy("model", "drug", "place").agg(F.sum("v").alias("v")).toArrow()
    model, drug, place, v = (rows.column(c).to_numpy() for c in ("model", "drug", "place", "v"))
    out = []
    for m, w in enumerate(points):
        t, own = np.zeros((len(w), w.shape[1] + 4)), model == m
        t[drug[own], place[own]] = v[own]
        out.append((t[:, :-4], t[:, -4:]))
    return out


def objective(w: np.ndarray, g: np.ndarray, sums: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """ML1, drug-balanced: the mean over drugs with rows of their mean loss, plus decay / 2 times the squared weights of columns."""
    n = sums[:, 1]
    share = np.where(n > 0, 1 / np.maximum(n, 1), 0) / max(1, int((n > 0).sum()))
    plain = w.copy()
    plain[:, -2:] = 0
    return float((sums[:, 0] * share).sum() + 0.5 * decay * (plain**2).sum()), g * share[:, None] + decay * plain


def held_loss(sums: np.ndarray) -> float:
    n = sums[:, 3]
    return float((sums[n > 0, 2] / n[n > 0]).mean()) if (n > 0).any() else np.inf


def fit(examples: DataFrame, problems: list[Problem], decay: float = 1e-3, rounds: int = 200, enough: float = 1e-7, patience: int | None = None) -> list[dict]:
    """ML2, ML3: fits the problems' weights in lockstep -> history rows (model, held, round, train_loss, val_loss).

    examples (drug, fold int; index array<int>, value array<double>; lower, upper double) should be a written table: it is
    read once a round. With patience, a model stops when its held fold's loss has not fallen by 1e-5 for so many accepted
    steps, and keeps its best weights; otherwise it stops when a step gains nothing. No rows: weights stay zero.
    """
    size = sum(p.weights.size for p in problems)
    if size > MOST_NUMBERS:
        raise ValueError(f"{size} weights; at most {MOST_NUMBERS} are held at once")
    free = [np.concatenate((p.allowed, np.ones((len(p.allowed), 2), bool)), 1) for p in problems]
    solvers, history, best = [Lbfgs(p.weights[f]) for p, f in zip(problems, free, strict=True)], [], [(np.inf, 0, None)] * len(problems)
    for number in range(1, rounds + 1):
        open_ = [i for i, s in enumerate(solvers) if not s.done]
        if not open_:
            break
        points = []
        for i in open_:
            w = np.zeros_like(problems[i].weights)
            w[free[i]] = solvers[i].point
            points.append(w)
        for i, w, (g, sums) in zip(open_, points, evaluate(examples, points, [problems[i].held for i in open_]), strict=True):
            f, gradient = objective(w, g, sums, decay)
            if not solvers[i].tell(f, gradient[free[i]], enough):
                continue
            val = held_loss(sums)
            history.append({"model": i, "held": problems[i].held, "round": number, "train_loss": f, "val_loss": val if np.isfinite(val) else None})
            steps = sum(h["model"] == i for h in history)
            if patience is None or val < best[i][0] - 1e-5:
                best[i] = (val, steps, w)
            elif steps - best[i][1] >= patience:
                solvers[i].done = True
    for p, (_, _, w) in zip(problems, best, strict=True):
        if w is not None:
            p.weights = w
    return history


def predicted(rows: DataFrame, models: dict[int, np.ndarray], keep: list[str]) -> DataFrame:
    """rows (keep, drug, fold, index, value) -> keep plus mu, by the model of the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = b.column("index")
            row = np.repeat(np.arange(b.num_rows), np.diff(index.offsets.to_numpy()))
            drug, fold = (b.column(c).to_numpy() for c in ("drug", "fold"))
            index, value, mu = index.flatten().to_numpy(), b.column("value").flatten().to_numpy(), np.full(b.num_rows, np.nan)
            for f, w in models.items():
                own = fold == f
                part = np.bincount(row, weights=w[drug[row], index] * value, minlength=b.num_rows)
                mu[own] = (w[drug, -2] + part)[own]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(mu)], [*keep, "mu"])

    return rows.select(*dict.fromkeys([*keep, "drug", "fold", "index", "value"])).mapInArrow(run, rows.select(*keep).schema.add("mu", "double"))
