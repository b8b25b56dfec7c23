"""Calibration and likelihood kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from susceptra.functions.normal import interval_nll
from susceptra.operators.relational import interpolate, thresholds


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit at the sorted, distinct x."""
    level, weight, size = [], [], []
    for value, own in zip(y, w, strict=True):
        level.append(value)
        weight.append(own)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / total
            weight[-2] = total
            size[-2] += size[-1]
            del level[-1], weight[-1], size[-1]
    return np.repeat(level, size)


def isotonic_by_pair(rows: DataFrame, keys: str | list[str], x: str, y: str, min_class: int = 20, cells: int = 256) -> DataFrame:
    """AG20: (keys, x, fitted) at both ends of each level, for keys with min_class rows of either label (y is 0 or 1).

    Pooling is exact in parts: blocks pooled inside a cell of x (a share 1 / cells of the unit) are pooled further over the
    whole key, so a task holds one cell's distinct values or one key's blocks, never a key's rows. Null x or y is not fitted.
    """
    keys = [keys] if isinstance(keys, str) else keys
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    exact = known.groupBy(*keys, F.col(x).cast("double").alias("low")).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    blocks = exact.withColumn("cell", F.floor(F.col("low") * cells)).withColumn("high", F.col("low"))

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low", ignore_index=True)
        level = pool_adjacent(pdf.low.to_numpy(), (pdf.s / pdf.w).to_numpy(), pdf.w.to_numpy())
        start = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
        end = np.concatenate((start[1:], [len(level)])) - 1
        own = {k: [pdf[k].iloc[0]] * len(start) for k in keys}
        return pd.DataFrame(own | {"low": pdf.low.to_numpy()[start], "high": pdf.high.to_numpy()[end], "s": np.add.reduceat(pdf.s.to_numpy(), start), "w": np.add.reduceat(pdf.w.to_numpy(), start)})

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pooled(pdf)
        if min(done.s.sum(), done.w.sum() - done.s.sum()) < min_class:
            done = done.iloc[:0]
        ends = pd.concat([done.assign(x=done.low), done[done.high > done.low].assign(x=done.high)])
        return ends.assign(fitted=ends.s / ends.w)[[*keys, "x", "fitted"]]

    schema = known.select(*keys).schema
    half = StructType(list(schema.fields))
    for name in ("low", "high", "s", "w"):
        half = half.add(name, "double")
    parts = blocks.groupBy(*keys, "cell").applyInPandas(pooled, half)
    return parts.groupBy(*keys).applyInPandas(curve, StructType(list(schema.fields)).add("x", "double").add("fitted", "double"))


def calibrated(rows: DataFrame, curves: DataFrame, keys: list[str], p: str, to: str) -> DataFrame:
    """AG21: rows plus the curve's value at p; keys without a curve keep p itself."""
    knots = curves.withColumnsRenamed({"x": "cx", "fitted": "cy"})
    return interpolate(rows, knots, keys, p).withColumn(to, F.coalesce("y", F.col(p))).drop("y")


def loo_calls(rows: DataFrame, keys: list[str], fold: str, p: str, resistant: str, min_class: int = 20, vme: float = 0.01, me: float = 0.03) -> DataFrame:
    """AG25: each fold's rows called by curves (AG20) and thresholds (AG22) that were fitted on all other folds.

    -> rows plus p_active and call (likely_active, likely_inactive, uncertain); rows of keys without thresholds are left
    out, as they cannot be scored. A row goes to every fit but its own fold's, so all folds are fitted in one pass.
    """
    folds = rows.groupBy().agg(F.collect_set(fold).alias("__folds"))  # one row
    fitted_on = rows.select(*keys, fold, F.col(p).alias("p_raw"), F.col(resistant).alias("resistant")).join(folds).withColumn("held", F.explode(F.array_except("__folds", F.array(fold)))).drop("__folds")
    curves = isotonic_by_pair(fitted_on.withColumn("active", (~F.col("resistant")).cast("double")), ["held", *keys], "p_raw", "active", min_class)
    again = calibrated(fitted_on, curves, ["held", *keys], "p_raw", "p_active")
    limits = thresholds(again, ["held", *keys], "p_active", "resistant", vme, me, min_class).select("held", *keys, "active_min", "inactive_max")
    scored = calibrated(rows.withColumn("held", F.col(fold)), curves, ["held", *keys], p, "p_active").join(limits, ["held", *keys])
    # where both hold, the later rule wins, as in the reference's order of assignment
    call = F.when(F.col("p_active") <= F.col("inactive_max"), "likely_inactive").when(F.col("p_active") >= F.col("active_min"), "likely_active").otherwise("uncertain")
    return scored.withColumn("call", call).drop("held", "active_min", "inactive_max")


def calls_report(rows: DataFrame, keys: list[str], resistant: str) -> DataFrame:
    """AG23: error rates and commitment of called rows."""
    r, active, inactive = F.col(resistant), F.col("call") == "likely_active", F.col("call") == "likely_inactive"
    committed = F.count_if(active | inactive)
    rate = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    return rows.groupBy(*keys).agg(
        rate(F.count_if(active & r), F.count_if(r)).alias("vme_rate"), rate(F.count_if(inactive & ~r), F.count_if(~r)).alias("me_rate"), (committed / F.count(F.lit(1))).alias("committed_share"),
        rate(F.count_if(active & ~r | inactive & r), committed).alias("correct_when_committed"), F.count(F.lit(1)).alias("n"), F.count_if(r).alias("n_lab_r"), F.count_if(~r).alias("n_lab_s"))


def censored_nll(rows: DataFrame, key: str) -> DataFrame:
    """ML1: rows (key, mu, sigma, lower, upper) in log2 -> (key, n, mean_nll); partial sums per Arrow batch, then one aggregate.

    Rows with a null or nan bound are masked: they count in no mean.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nll, _, _ = interval_nll(b.mu.to_numpy(float), np.log(b.sigma.to_numpy(float)), b.lower.to_numpy(float), b.upper.to_numpy(float))
            yield b.assign(nll=nll).groupby(key, as_index=False).agg(n=("nll", "size"), s=("nll", "sum"))[[key, "n", "s"]]

    present = F.col("lower").isNotNull() & F.col("upper").isNotNull() & ~F.isnan("lower") & ~F.isnan("upper")
    part = rows.filter(present).select(key, "mu", "sigma", "lower", "upper").mapInPandas(run, f"{key} string, n long, s double")
    return part.groupBy(key).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean_nll"))


def balanced_nll(by_drug: DataFrame) -> DataFrame:
    """ML1, drug-balanced: the mean over drugs of their mean loss, whatever their rows."""
    return by_drug.filter("n > 0").agg(F.avg("mean_nll").alias("balanced_nll"))
