"""Bins on a circle and probe chains against plain Python."""

import random

import duckdb
import pytest

from susceptra.operators import candidates
from susceptra.plans import catalogue, placing  # noqa: F401 (registers its queries)


@pytest.mark.parametrize(("n", "within"), [(1000, 37), (100, 60), (7, 3), (5000, 1), (90, 30)])
def test_band_join_on_a_circle(spark, n, within):
    rng = random.Random(n)
    points = [(i % 3, i, rng.randrange(-n, 3 * n)) for i in range(60)] + [(0, 100, 0), (0, 101, n - 1)]
    others = [(i % 3, i, rng.randrange(n)) for i in range(80)] + [(0, 200, 0), (0, 201, n - 1)]
    one = spark.createDataFrame(points, "k int, a int, x long").selectExpr("*", f"{n}L AS n", f"{within}L AS w")
    two = spark.createDataFrame(others, "k int, b int, y long").selectExpr("*", f"{n}L AS n", f"{within}L AS w")
    got = [(r.a, r.b) for r in candidates.band_join_on_circle(one, two, ["k"], "x", "y", "n", "w").collect()]
    want = [(a, b) for k, a, x in points for j, b, y in others if k == j and min((y - x) % n, (x - y) % n) <= within]
    assert sorted(got) == sorted(want)
    assert (100, 201) in got and (101, 200) in got


def test_probe_chain_wraps_round(spark):
    """A donor that is the sequence rotated past its origin, on either strand; a short and a clipped chain are refused."""
    n, length, width = 1500, 1000, 100
    rows = []
    for ref, strand in ((0, "+"), (1, "-")):
        for probe, at in enumerate((0, 300, 600, 900)):
            t = 1200 + at  # on the chain's own strand, beyond the origin
            ts, te = (t, t + width) if strand == "+" else (n - t - width, n - t)
            rows += [(1, probe, ref, strand, width, 0, width, ts, te, 90 - probe, 100), (1, probe, ref, strand, width, 0, width, ts + 7, te + 7, 60, 100)]
    rows += [(1, p, 2, "+", width, 0, width, 100 + 300 * p, 200 + 300 * p, 99, 100) for p in (0, 1, 2)]
    rows += [(1, p, 3, "+", width, 30, width, 130 + 300 * p, 200 + 300 * p, 99, 100) for p in range(4)]
    hits = spark.createDataFrame(rows, "query int, probe int, ref int, strand string, qlen int, qs int, qe int, ts int, te int, matches int, block int")
    references = spark.createDataFrame([(r, f"d{r}", n) for r in range(4)], "ref int, donor string, n int")
    got = candidates.probe_placements(hits, references, spark.createDataFrame([(1, length)], "query int, length int"), 4, width).collect()
    assert sorted((r.donor, r.strand, r.start % n, r.end % n, r.missing) for r in got) == [("d0", "+", 1200, 700, 500), ("d1", "-", 1200, 700, 500)]
    assert all(abs(r.score - (0.9 + 0.89 + 0.88 + 0.87) / 4) < 1e-9 and r.strand_share == 1 for r in got)


def test_equal_scores_go_to_the_smaller_reference(spark):
    """Both references have the same mean, of numbers whose sums differ in the last digit in whatever order they are added."""
    matches = {0: (110, 68, 76, 91), 1: (93, 88, 67, 97)}
    rows = [(1, p, ref, "+", 100, 0, 100, 300 * p, 300 * p + 100, m, 110) for ref, ms in matches.items() for p, m in enumerate(ms)]
    hits = spark.createDataFrame(rows, "query int, probe int, ref int, strand string, qlen int, qs int, qe int, ts int, te int, matches int, block int")
    references = spark.createDataFrame([(r, "d", 1500) for r in matches], "ref int, donor string, n int")
    got = candidates.probe_placements(hits, references, spark.createDataFrame([(1, 1000)], "query int, length int"), 4, 100).collect()
    assert [r.ref for r in got] == [0]


def test_scores_compared_as_they_are_are_those_of_sums_by_probe(spark):
    """Two probes have one sum in either order, so SQL that compares means takes the second reference, whose last digit is larger."""
    matches = {0: (60, 62), 1: (61, 61)}
    assert (60 / 110 + 62 / 110) / 2 < (61 / 110 + 61 / 110) / 2
    rows = [(1, p, ref, "+", 100, 0, 100, 900 * p, 900 * p + 100, m, 110) for ref, ms in matches.items() for p, m in enumerate(ms)]
    hits = spark.createDataFrame(rows, "query int, probe int, ref int, strand string, qlen int, qs int, qe int, ts int, te int, matches int, block int")
    references = spark.createDataFrame([(r, "d", 1500) for r in matches], "ref int, donor string, n int")
    queries = spark.createDataFrame([(1, 1000)], "query int, length int")
    chosen = {d: [r.ref for r in candidates.probe_placements(hits, references, queries, 2, 100, decimals=d).collect()] for d in (None, 12)}
    assert chosen == {None: [1], 12: [0]}


def test_customers_that_only_orders_name_are_placed(spark, tmp_path, sf_dir):
    """As in the SQL, which reads no customers."""
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 2 = 0").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.queries()["probe_candidates"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == set(con.execute(catalogue.oracle_sql()["probe_candidates"]).fetchall())


@pytest.mark.parametrize("most", [0, 6])
def test_packed_groups_are_anchored_as_rows_are(spark, monkeypatch, most):
    """Groups of up to PACKED hits are arrays, larger ones rows; what is found must not depend on which."""
    rng, rows = random.Random(4), []
    for query in range(12):
        for _ in range(rng.randrange(1, 40)):
            qs = rng.randrange(2500)
            qe = qs + rng.randrange(200, 500)
            ts = rng.randrange(5000) if rng.random() < 0.3 else (query * 131 + qs + rng.randrange(60)) % 5000
            rows.append((query, "d", rng.choice("+-"), rng.choice(("left", "right", "full")), qs, qe, ts, ts + qe - qs + rng.randrange(3), None if rng.random() < 0.05 else rng.randrange(80, 99) / 100))
    hits = spark.createDataFrame(rows, "query int, donor string, strand string, part string, qs long, qe long, ts long, te long, identity double")
    panel = spark.createDataFrame([(q, "d", 5000, 0.5) for q in range(12)], "query int, donor string, n long, containment double")
    queries = spark.createDataFrame([(q, 3000, 60) for q in range(12)], "query int, length long, percent int")
    run = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in candidates.anchored(hits, panel, queries, least_clip=300, drift=120).collect())
    packed = run()
    monkeypatch.setattr(candidates, "PACKED", most)
    assert run() == packed and len(packed) > 20 and any("anchored" in r for r in packed)


def test_hits_are_made_and_shuffled_once(spark, sf_dir):
    """The plan that is left reads groups, not the tables that hits are made of, once for each of its branches."""
    plan = catalogue.queries()["anchored_candidates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "bin__" not in plan
