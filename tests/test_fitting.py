"""The fitting half against numpy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from susceptra.functions import normal
from susceptra.ml import calibration, crossval, linear
from susceptra.plans import catalogue, fitting


def loss(w, rows, decay):
    """Drug-balanced censored loss, row by row with math.erfc."""
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    by = {}
    for drug, _, index, value, lower, upper in rows:
        mu = w[drug][-2] + sum(w[drug][i] * v for i, v in zip(index, value, strict=True))
        zl, zu = ((x - mu) / math.exp(w[drug][-1]) for x in (lower, upper))
        p = phi(-zl) - phi(-zu) if zl + zu > 0 else phi(zu) - phi(zl)
        by.setdefault(drug, []).append(-math.log(p) if p > 0 else 1e6)
    return sum(sum(x) / len(x) for x in by.values()) / len(by) + decay / 2 * sum(x * x for d in w for x in d[:-2])


def newton(rows, drugs, columns, decay):
    """A fit of its own: Newton steps on differences of the plain loss."""
    shape = (drugs, columns + 2)
    x, f = np.zeros(drugs * (columns + 2)), lambda x: loss(x.reshape(shape), rows, decay)
    n, e = len(x), 1e-4
    for _ in range(25):
        unit = np.eye(n) * e
        g = np.array([(f(x + u) - f(x - u)) / (2 * e) for u in unit])
        h = np.array([[(f(x + u + v) - f(x + u - v) - f(x - u + v) + f(x - u - v)) / (4 * e * e) for v in unit] for u in unit])
        step = np.linalg.solve(h + np.eye(n) * 1e-9, g) if (np.linalg.eigvalsh(h) > 0).all() else g
        t = 1.0
        while f(x - t * step) > f(x) and t > 1e-9:
            t /= 2
        x = x - t * step
        if np.abs(g).max() < 1e-8:
            break
    return f(x)


def made_rows(seed=4, n=160):
    rng, rows = random.Random(seed), []
    for i in range(n):
        index = [j for j in range(2) if rng.random() < 0.5]
        y = math.floor(2 * (0 in index) - 1.5 * (1 in index) * (i % 2) + rng.gauss(0, 1))
        lower, upper = (-math.inf, -1.0) if y <= -1 else (2.0, math.inf) if y > 2 else (y - 1.0, float(y))
        rows.append((i % 2, i % 3, index, [1.0 + 0.5 * j for j in index], lower, upper))
    return rows


EXAMPLES = "drug int, fold int, index array<int>, value array<double>, lower double, upper double"


def test_normal_in_both_tails():
    z = np.array([-38.0, -8.0, -3.0, -2.999, -0.5, 0.0, 1.5, 3.0, 8.0, math.inf, -math.inf, math.nan])
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in z[:-1]]
    assert normal.cdf(z)[:-1] == pytest.approx(want, rel=1e-12) and math.isnan(normal.cdf(z)[-1])
    assert np.exp(normal.log_cdf(z[:9])) == pytest.approx(want[:9], rel=1e-11)


def test_fit_reaches_the_least_loss(spark):
    rows = made_rows()
    one = linear.Problem(None, np.ones((2, 2), bool))
    history = linear.fit(spark.createDataFrame(rows, EXAMPLES).repartition(3), [one], decay=0.01)
    assert abs(loss(one.weights.tolist(), rows, 0.01) - newton(rows, 2, 2, 0.01)) < 1e-6
    falls = [h["train_loss"] for h in history]
    assert falls == sorted(falls, reverse=True)


def test_folds_are_fitted_apart_and_stop_early(spark):
    rows, allowed = made_rows(), np.array([[True, False], [True, True]])
    problems = [linear.Problem(f, allowed) for f in range(3)]
    linear.fit(spark.createDataFrame(rows, EXAMPLES), problems, decay=0.01)
    for p in problems:
        alone = linear.Problem(None, allowed)
        linear.fit(spark.createDataFrame([r for r in rows if r[1] != p.held], EXAMPLES), [alone], decay=0.01)
        assert np.abs(alone.weights - p.weights).max() < 1e-3 and p.weights[0, 1] == 0
    history = linear.fit(spark.createDataFrame(rows, EXAMPLES), [linear.Problem(0, allowed)], decay=0.01, patience=2)
    held = [h["val_loss"] for h in history]
    assert len(held) - 1 - held.index(min(held)) <= 2
    empty = linear.Problem(None, allowed)
    linear.fit(spark.createDataFrame([], EXAMPLES), [empty])
    assert not empty.weights.any()
    with pytest.raises(ValueError, match="at most"):
        linear.fit(spark.createDataFrame([], EXAMPLES), [linear.Problem(None, np.ones((2, linear.MOST_NUMBERS), bool))])


@pytest.fixture(scope="module")
def fitted(spark):
    return crossval.cross_validate(fitting.inputs(spark, "/root/testdata/sf0.01"), fitting.OPTIONS)


def test_out_of_fold_beats_a_constant_and_bands_cover(fitted):
    rows, bands = crossval.out_of_fold(fitted, fitting.OPTIONS)
    got = rows.toPandas()
    exact = got[np.isfinite(got.lower) & np.isfinite(got.upper)]
    off, constant = (exact.mu - exact.upper).abs(), (exact.upper.median() - exact.upper).abs()
    assert off.mean() < 0.8 * constant.mean()
    low, high = np.log2(got.band_low), np.log2(got.band_high)
    assert 0.85 <= ((high > got.lower) & (low <= got.upper)).mean() <= 1
    assert (got.band_low <= got.pred_mic).all() and (got.pred_mic <= got.band_high).all()
    assert bands.count() == 15


def test_predictions_are_those_of_numpy(spark, fitted):
    """Every row again, from collected weights and columns; then the same genomes through the model table."""
    rows, bands = crossval.out_of_fold(fitted, fitting.OPTIONS)
    at = {d: i for i, d in enumerate(fitted.drugs)}
    want = {}
    for r in fitted.examples.collect():
        w = fitted.models[r.fold]
        want[r.genome, fitted.drugs[r.drug]] = w[r.drug, -2] + sum(w[r.drug, i] * v for i, v in zip(r["index"], r["value"], strict=True))
    got = {(r.genome, r.drug): r.mu for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    data = fitting.inputs(spark, "/root/testdata/sf0.01")
    asked = data.genomes.select("species").distinct().join(spark.createDataFrame([("A",), ("R",)], "drug string"))
    final = {(r.genome, r.drug): r.mu for r in crossval.predict(crossval.model_table(fitted), bands, asked, data.genomes, data.known, data.wide).collect()}
    assert len(final) == 2 * data.genomes.count()
    w = fitted.models[crossval.FINAL]
    for r in fitted.examples.limit(200).collect():
        drug = fitted.drugs[r.drug]
        if drug != "N":
            assert abs(final[r.genome, drug] - w[at[drug], -2] - sum(w[at[drug], i] * v for i, v in zip(r["index"], r["value"], strict=True))) < 1e-9


def plain_curve(rows, least):
    """Pooled adjacent violators on sorted distinct values, then interpolation; None where a label is too rare."""
    ones = sum(y for _, y in rows)
    if min(ones, len(rows) - ones) < least:
        return None
    x, blocks = sorted({p for p, _ in rows}), []
    for v in x:
        own = [y for p, y in rows if p == v]
        blocks.append([sum(own), len(own), v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    ends = sorted({(v, s / n) for s, n, a, b in blocks for v in (a, b)})
    return lambda p: float(np.interp(p, [e[0] for e in ends], [e[1] for e in ends]))


def test_refit_scores_each_fold_by_the_others(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        p = rng.random() ** 2
        rows.append((i, "ab"[i % 10 == 0], i % 5, p, rng.random() > p))
    df = spark.createDataFrame(rows, "id int, pair string, fold int, p double, resistant boolean")
    got = {r.id: (r.p_active, r.call) for r in calibration.loo_calls(df, ["pair"], "fold", "p", "resistant", vme=0.1, me=0.1).collect()}
    want = {}
    for pair in "ab":
        for fold in range(5):
            fit = [(p, r) for _, k, f, p, r in rows if k == pair and f != fold]
            curve = plain_curve([(p, not r) for p, r in fit], 20) or (lambda p: p)
            again = [(curve(p), r) for p, r in fit]
            n_r, n_s = sum(r for _, r in again), sum(not r for _, r in again)
            if min(n_r, n_s) < 20:
                continue
            grid = [i / 200 for i in range(201)]
            a = min((x for x in grid if sum(r and p >= x - 1e-9 for p, r in again) <= 0.1 * n_r), default=1.01)
            b = max((x for x in grid if sum(not r and p <= x + 1e-9 for p, r in again) <= 0.1 * n_s), default=-0.01)
            if b >= a:
                a, b = (a + b) / 2, (a + b) / 2 - 1e-9
            for i, k, f, p, _ in rows:
                if k == pair and f == fold:
                    q = curve(p)
                    want[i] = (q, "likely_inactive" if q <= b else "likely_active" if q >= a else "uncertain")
    assert got.keys() == want.keys() and len(got) > 700
    assert all(abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1] for i in want)
    report = calibration.calls_report(df.filter("pair = 'a'").withColumn("call", F.lit("likely_active")), ["pair"], "resistant").first()
    assert report.vme_rate == 1 and report.me_rate == 0 and report.committed_share == 1 and abs(report.correct_when_committed - report.n_lab_s / report.n) < 1e-12


@pytest.mark.parametrize("name", ["known_columns_by_fold", "correlated_columns_by_fold"])
def test_sums_by_fold_are_made_once(spark, sf_dir, name):
    """Totals and what each fold takes off are read from the written sums, not summed from the lines again."""
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_long_relations_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    genomes = spark.createDataFrame([(g, "s", g % 2) for g in range(40)], "genome long, species string, fold int")
    labels = spark.createDataFrame([(g, "A", float(g % 3), float(g % 3) + 1) for g in range(40)], "genome long, drug string, lower double, upper double")
    known = spark.createDataFrame([(g, "gene", 1) for g in range(40)], "genome long, column string, n long")
    wide = spark.createDataFrame([(g, f"w{g % 3}") for g in range(40)], "genome long, column string").mapInPandas(counted, "genome long, column string")
    found = crossval.cross_validate(crossval.Inputs(genomes, labels, known, wide), crossval.Options(known_min_count=1, rounds=2, patience=None))
    assert made.value == 40 and found.examples.count() == 40
