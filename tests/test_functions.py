import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from susceptra.functions import mic, normal, sequence
from susceptra.ml import calibration
from susceptra.operators import relational as R
from susceptra.operators.splits import folds, greedy_fill


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_first_number(spark):
    assert column(spark, ["8/4", " 1.5", ".5", "<=8", "1e3", None, ""], mic.first_number) == [8.0, 1.5, 0.5, None, 1.0, None, None]


def test_snap(spark):
    assert column(spark, [0.06, 1.5, 4.0, 0.0, None], mic.snap, "double") == [0.0625, None, 4.0, None, None]


def test_signs_and_units(spark):
    assert column(spark, ["==", None, "≤", "=>", "~"], mic.normal_sign) == ["=", "=", "<=", ">=", None]
    assert column(spark, [" MG/L ", "µg/mL", "mg"], mic.known_unit) == [True, True, False]


@pytest.mark.parametrize("sign,expected", [("=", (2.0, 4.0)), ("<=", (0.0, 4.0)), ("<", (0.0, 4.0)), (">", (4.0, math.inf)), (">=", (2.0, math.inf)), ("~", None)])
def test_from_mic(spark, sign, expected):
    got = column(spark, [sign], lambda x: mic.from_mic(x, F.lit(4.0)))[0]
    assert (tuple(got) if got else None) == expected


def test_from_sir(spark):
    got = column(spark, ["S", "I", "R", None], lambda x: mic.from_sir(x, F.lit(1.0), F.lit(4.0)))
    assert [tuple(g) if g else None for g in got] == [(0.0, 1.0), (1.0, 4.0), (4.0, math.inf), None]


def test_text(spark):
    assert column(spark, ["Broth microdilution", "Disk diffusion", "E-test", "x", None], lambda x: mic.first_keyword(x, mic.METHOD_KEYWORDS)) == ["dilution", "disk", "gradient", None, None]
    assert column(spark, [" Unknown ", "a", None], mic.clean_text) == [None, "a", None]
    assert column(spark, ["Piperacillin/ tazobactam"], mic.alias_key) == ["piperacillin-tazobactam"]
    assert column(spark, ["2018-03", "18", "3000"], mic.year_of) == [2018, None, None]
    assert column(spark, ["blaKPC-2", "aac(6')-Ib-cr"], lambda x: mic.column_name("gene_", x)) == ["gene_blakpc_2", "gene_aac_6_ib_cr"]
    assert column(spark, ["blaSHV-11", "sul1-2"], mic.family) == ["blaSHV", "sul1-2"]
    assert [[tuple(t) for t in x] for x in column(spark, ["gyrA_S83I=POINT,sul1,x=MISTRANSLATION,", None], mic.genotype_tokens)] == [[("gyrA_S83I", "point"), ("sul1", "gene")], []]


def test_levels(spark):
    assert column(spark, [0.0, 0.02, 0.5, 0.98, None], mic.confidence_level, "double") == ["very_likely_inactive", "probably_inactive", "unclear", "very_likely_active", None]
    with pytest.raises(Exception, match="probability"):
        column(spark, [1.5], mic.confidence_level, "double")


def test_normal_cdf(spark):
    got = column(spark, [0.0, 1.959963984540054, -40.0], mic.normal_cdf, "double")
    assert got[0] == 0.5 and abs(got[1] - 0.975) < 1e-9 and 0 <= got[2] < 1e-300
    assert abs(normal.log_cdf(np.array([-40.0]))[0] - -804.6084420137538) < 1e-9


def test_sequence(spark):
    assert column(spark, ["ACGTN", "AAC"], sequence.reverse_complement) == ["NACGT", "GTT"]
    assert column(spark, ["ACGT"], lambda x: sequence.circular_slice(x, F.lit(3), F.lit(3))) == ["TAC"]
    assert column(spark, ["GGCCAATT", "NN"], sequence.gc_percent) == [50.0, 0.0]
    assert column(spark, ["A" * 161], sequence.wrap)[0].split("\n") == ["A" * 80, "A" * 80, "A"]


def test_resolve_duplicates(spark):
    inf = math.inf
    rows = [("a", 1, 0.0, 0.5, "S", "<=0.5"), ("a", 2, 0.25, 0.5, "S", "=0.5"), ("b", 1, 2.0, 4.0, "S", "=4"), ("b", 2, 4.0, 8.0, "I", "=8"), ("c", 1, 16.0, 32.0, "R", "=32"), ("c", 2, 32.0, inf, "R", ">32"), ("d", 1, 2.0, 4.0, "I", "=4"), ("d", 2, 8.0, 16.0, "R", "=16"), ("e", 1, 0.0, 0.25, None, "a"), ("e", 2, 0.5, 1.0, None, "b"), ("f", 1, 1.0, 2.0, "S", "=2"), ("f", 2, 1.0, 2.0, "R", "=2")]
    got = {r.k: r for r in R.resolve_duplicates(spark.createDataFrame(rows, "k string, ord int, lower double, upper double, sir string, raw string"), ["k"]).collect()}
    assert (got["a"].lower, got["a"].upper, got["a"].raw) == (0.25, 0.5, "<=0.5|=0.5")
    assert (got["b"].lower, got["b"].upper, got["b"].sir) == (4.0, 8.0, "I")
    assert (got["c"].lower, got["c"].upper, got["c"].reason) == (32.0, inf, None)
    assert [got[k].reason for k in "def"] == ["conflict_gt_1_step", "conflict_gt_1_step", "conflict_s_vs_r"]


def test_agreement(spark):
    rows = [(1.0, 0.5, 2.0, 0.5, 1.0, "S", "S"), (8.0, 4.0, 16.0, 8.0, 16.0, "R", "R"), (0.5, 0.25, 1.0, 0.0, 0.25, "S", "R"), (16.0, 8.0, 32.0, 2.0, 4.0, "R", "S"), (2.0, 1.0, 4.0, 1.0, 2.0, "I", "S")]
    m = R.agreement(spark.createDataFrame(rows, "pred double, low double, high double, lab_lower double, lab_upper double, pred_sir string, lab_sir string"), []).first()
    assert (m.vme, round(m.me, 6), m.mine, m.categorical, m.n_exact, m.essential, m.exact, m.coverage, m.width) == (0.5, round(1 / 3, 6), 0.2, 0.4, 4, 0.75, 0.5, 0.8, 2.0)


def test_interval_coverage(spark):
    h = spark.createDataFrame([("k", 0, 100, 0.9), ("k", 50, 150, 1.0)], "k string, a long, b long, w double")
    r = R.interval_coverage(h, "k", "a", "b", "w").first()
    assert r.covered == 150 and abs(r.weighted - 145) < 1e-9


def test_splits():
    names, sizes = [f"c{i}" for i in range(60)], [i % 7 + 1 for i in range(60)]
    test = greedy_fill(names, sizes, 3)
    share = sum(s for n, s in zip(names, sizes, strict=True) if n in test) / sum(sizes)
    assert 0.15 <= share <= 0.20
    f = folds(names, sizes, 5)
    load = [sum(s for n, s in zip(names, sizes, strict=True) if f[n] == j) for j in range(5)]
    assert max(load) - min(load) <= max(sizes)


def test_pool_adjacent():
    assert calibration.pool_adjacent(np.arange(4), np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    zero = np.zeros(1)
    assert abs(normal.interval_nll(zero, zero, zero - math.inf, zero)[0][0] - math.log(2)) < 1e-12
