"""Annulus search against all distances, on whole and odd tables."""

import hashlib
import math
import random

import numpy as np

from susceptra.llm import clusters

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=8, rounds=10):
    """Plain integers, every distance."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    means = [e for _, e in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(e, m), c) for c, m in enumerate(means)) for _, e in kept]
    for _ in range(rounds):
        own = [[e for (_, e), (_, c) in zip(kept, found, strict=True) if c == j] for found in [assign()] for j in range(len(means))]
        means = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else m for o, m in zip(own, means, strict=True)]
    found = assign()
    fits = lambda x: x if x < 2**63 else None
    digest = lambda m: hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()
    return sorted((repr((i, c, fits(d), fits(sum(x for x, y in found if y == c)), fits(sum(x for x, _ in found)), digest(means[c]))) for (i, _), (d, c) in zip(kept, found, strict=True)))


def checked(spark, rows, **more):
    got = clusters.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", *[f"{v} as {k}" for k, v in more.items()]))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows)


def test_odd_vectors(spark):
    rng = random.Random(5)
    v = lambda n=64, s=1.0: [rng.gauss(0, s) for _ in range(n)]
    rows = [(i, v()) for i in range(150)] + [(None, v()), (None, v()), (900, None), (901, []), (902, v(63)), (903, v(65)), (904, [None, *v(63)]), (905, [math.nan, *v(63)]), (906, [math.inf, *v(63)])]
    rows += rows[:20] + [(907, [0.0] * 64), (908, [-0.0] * 64)]
    checked(spark, rows, id="1", vector="2", cluster="3", distance="'x'")


def test_ties_and_equal_vectors(spark):
    checked(spark, [(i, [float(i % 3)] * 64) for i in range(60)])
    checked(spark, [(i, [1.5] * 64) for i in range(20)])


def test_numbers_beyond_a_long(spark):
    checked(spark, [(i, [float(i)] * 63 + [(-1.0) ** i * 10.0 ** (i % 30)]) for i in range(40)])


def test_few_vectors_and_none(spark):
    checked(spark, [(i, [float(i)] * 64) for i in range(3)])
    assert clusters.cluster(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    assert clusters.cluster(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_annulus_has_all_nearest():
    rng = np.random.default_rng(1)
    means = [tuple(map(int, x)) for x in rng.integers(-6, 6, (40, 3))]
    vectors = rng.integers(-8, 8, (500, 3))
    who, best = clusters.Annulus(means).nearest(vectors)
    every = ((vectors[:, None, :] - np.array(means)[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (who == every.argmin(1)).all()
