import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricloom.functions import metrics as M
from metricloom.functions import sequences as S
from metricloom.functions import transforms as X

floats = st.floats(0, 10, allow_nan=False)


@given(floats, floats, st.floats(0, 5), st.sampled_from([-4.0, -2.0, -0.5, 0.5, 1.0, 2.0]))
def test_power_interval_covers_the_ball(d, move, r, rho):
    move = min(move, r)
    lo, hi = X.power_interval(*X.ball(np.array([d]), np.array([r])), rho)
    for x in (max(0.0, d - move), d + move):
        y = max(x, X.EPS) ** rho if rho < 0 else x**rho
        assert lo[0] * (1 - 1e-9) <= y <= hi[0] * (1 + 1e-9) + 1e-12


@given(floats, st.floats(0, 5))
def test_log_interval_covers_the_ball(d, r):
    lo, hi = X.log_interval(*X.ball(np.array([d]), np.array([r])))
    for x in (max(0.0, d - r), d, d + r):
        assert lo[0] <= math.log(max(x, X.EPS)) + 1e-9 and math.log(max(x, X.EPS)) <= hi[0] + 1e-9


def test_linear_interval_signs_and_infinities():
    lo, hi = X.linear_interval(np.array([[1.0, 2.0]]), np.array([[3.0, 5.0]]), [1.0, -1.0])
    assert (lo[0], hi[0]) == (-4.0, 1.0)
    lo, hi = X.linear_interval(np.array([[np.inf, np.inf]]), np.array([[np.inf, np.inf]]), [1.0, -1.0])
    assert (lo[0], hi[0]) == (-np.inf, np.inf)


def test_column_transforms(spark):
    row = spark.range(1).select(X.power(F.lit(0.0), -1.0).alias("p"), X.log(F.lit(0.0)).alias("l"), X.linear([F.lit(2.0), F.lit(3.0)], [1.0, -1.0]).alias("s"), X.intersects(*map(F.lit, (0, 1, 1, 2))).alias("i"), X.contains(*map(F.lit, (0, 1, 2))).alias("c")).first()
    assert row["p"] == pytest.approx(1e12) and row["l"] == pytest.approx(math.log(1e-12)) and row["s"] == -1 and row["i"] and not row["c"]
    with pytest.raises(ValueError):
        X.power(F.lit(1.0), 0)


@pytest.mark.parametrize("metric", [M.L1, M.L2, M.LINF, M.lp_metric(3), M.PEARSON, M.IMAGE], ids=lambda m: m.name)
def test_column_equals_value(spark, metric):
    rng = np.random.default_rng(1)
    rows = [(rng.normal(size=66).tolist(), rng.normal(size=66).tolist()) for _ in range(20)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(metric.column(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r["d"] for r in got] == pytest.approx([metric.value(a, b) for a, b in rows])


@pytest.mark.parametrize("metric", [M.l1, M.l2, M.linf, M.lp(3)])
def test_null_and_unequal_vectors(spark, metric):
    df = spark.createDataFrame([(None, [1.0]), ([1.0], [1.0, 2.0]), ([], []), ([None], [1.0])], "a array<double>, b array<double>")
    got = [r["d"] for r in df.select(metric(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [None, None, 0.0, None]


@pytest.mark.parametrize("kind", ["l1", "l2", "linf"])
@pytest.mark.parametrize("dim", [1, 3, 64])
def test_fixed_lengths(spark, kind, dim):
    rng = np.random.default_rng(dim)
    rows = [(rng.normal(size=dim).tolist(), rng.normal(size=dim).tolist()) for _ in range(5)]
    m = M.fixed_metric(kind, dim)
    got = spark.createDataFrame([*rows, (None, [1.0]), ([1.0] * (dim + 1), [1.0] * dim), ([None] * dim, [1.0] * dim)], "a array<double>, b array<double>").select(m.column(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got[:5]] == pytest.approx([m.value(a, b) for a, b in rows]) and [r[0] for r in got[5:7]] == [None, None]


def test_edit_and_hamming(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "abc"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(M.edit(F.col("a"), F.col("b"))).collect()] == [3.0, 3.0, None]
    assert M.edit_value("kitten", "sitting") == 3
    df = spark.createDataFrame([("ACGT", "ACGA"), ("AN", "CC"), ("acgt", "ACGT"), ("AC", "A"), ("", ""), ("Z", "A")], "a string, b string")
    assert [r[0] for r in df.select(M.hamming(S.DNA_MATRIX)(F.col("a"), F.col("b"))).collect()] == [1.0, 1.5, 0.0, None, 0.0, 1.0]
    assert M.hamming_metric(S.DNA_MATRIX).value("AN", "CC") == 1.5


def test_weight_matrices():
    w = S.DNA_MATRIX.weight
    assert [w("A", s) for s in S.DNA_SYMBOLS] == [0, 1, 1, 1, 0.5, 1, 0.5, 1, 0.5, 1, 1, 0.5, 0.5, 0.5, 0.5]
    assert w("R", "Y") == 1 and w("M", "K") == 1 and w("W", "S") == 1 and w("N", "B") == 0.5
    p = S.PEPTIDE_MATRIX.weight
    assert (p("A", "R"), p("W", "C"), p("V", "L"), p("Y", "F"), p("I", "L"), p("A", "B"), p("K", "K")) == (2, 7, 1, 1, 1, 7, 0)
    assert all(p(a, b) == p(b, a) for a in S.PEPTIDE_SYMBOLS for b in S.PEPTIDE_SYMBOLS)
    assert S.DNA_WEIGHTED.weight("A", "C") == 0.6667 and S.RNA_MATRIX.weight("A", "U") == 1


def test_fragments_and_codes(spark):
    df = spark.createDataFrame([(1, "ACGTA"), (2, "AC"), (3, None), (4, "ACG")], "id int, seq string").withColumn("offset", F.lit("mine"))
    got = [(r["seq_id"], r["offset"], r["frag"]) for r in S.fragments(df, "id", "seq", 3).orderBy("seq_id", "offset").collect()]
    assert got == [(1, 0, "ACG"), (1, 1, "CGT")]
    assert S.fragments(df, "id", "seq", 3, include_last=True).count() == 4
    assert spark.range(1).select(S.symbol_codes(F.lit("acX"), S.DNA_SYMBOLS)).first()[0] == [0, 1, 15]


@given(st.lists(st.floats(0, 20), min_size=1, max_size=8), st.lists(st.floats(0, 20), min_size=1, max_size=8))
def test_spectra_are_symmetric_and_bounded(a, b):
    a, b = sorted(a), sorted(b)
    d = M.ms_value(a, b)
    assert d == M.ms_value(b, a) and 0 <= d <= math.pi / 2 + 1e-9 and M.ms_value(a, a) == 0


def test_spectra_columns(spark):
    df = spark.createDataFrame([(((100.0, [1.0, 2.0])), (101.0, [2.1, 1.1])), ((100.0, [1.0]), (110.0, [9.0])), ((1.0, []), (1.0, [2.0])), (None, (1.0, [2.0]))], "a struct<precursor:double,peaks:array<double>>, b struct<precursor:double,peaks:array<double>>")
    got = [r[0] for r in df.select(M.msms(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == pytest.approx([0.0, math.pi / 2 + 10]) and got[2:] == [None, None]


def test_mixed_and_partial(spark):
    df = spark.createDataFrame([([0.0, 3.0, 1.0, 2.0], [4.0, 0.0, 1.0, 5.0])], "a array<double>, b array<double>")
    assert df.select(M.euclid_hamming(2)(F.col("a"), F.col("b"))).first()[0] == 6.0
    assert df.select(M.partial_l2(1, 2)(F.col("a"), F.col("b"))).first()[0] == 3.0
