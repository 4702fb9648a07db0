"""Every index family finds what a linear scan finds."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from metricloom.functions import metrics as M
from metricloom.operators import index as I
from metricloom.operators import learn, pivots
from metricloom.operators.table import MetricTable, collapse, expand

RADII = (0.0, 0.15, 0.35, 0.75)
QUERIES = [(1000, [-1.0, 0.0]), (1001, [0.0, 0.0]), (1002, [1.2, 0.1]), (1003, [-0.3, 0.8])]


def uniform(n, seed):
    rng = np.random.default_rng(seed)
    rest = rng.uniform([-2, -1.5], [2, 1.5], (n - 2, 2))
    return [(i, v) for i, v in enumerate([[-1.0, 0.0], [1.0, 0.0], *rest.tolist()])]


FIXTURES = {
    "uniform": uniform(80, 7),
    "duplicates": [*uniform(82, 11), (90, [0.25, -0.25]), (91, [0.25, -0.25])],
    "degenerate": [(0, [-1.0, 0.0]), (1, [1.0, 0.0]), *[(i, [0.0, 0.0]) for i in range(2, 60)]],
    "clusters": [(i, [0.01 * (i % 20) + 10 * (i // 20), 0.0]) for i in range(40)],
}
LEVELS = {
    "vp": lambda x: [I.vp(range(2), 3)], "gh": lambda x: [I.gh()], "cght": lambda x: [I.cght()], "gnat": lambda x: [I.gnat(range(3))], "rgh": lambda x: [I.rgh(), I.rgh(1, 2)],
    "at": lambda x: [I.apollonian()], "iat": lambda x: [I.iat(learn.iat_cuts(x))], "iat_quantile": lambda x: [I.iat(learn.iat_cuts(x, mode="quantile"))], "cp": lambda x: [learn.complete_linear(x, 0.35)],
    "cp_sphere": lambda x: [learn.complete_linear(x, 0.35, kind="sphere")], "pct": lambda x: [I.pct(learn.pct_centres(x, 4))], "pct_pam": lambda x: [I.pct(learn.pct_centres(x, 4, "pam"))],
    "power": lambda x: [I.power(2.0, parts=4)], "power_negative": lambda x: [I.power(-2.0, (1.0, 0.5))], "log": lambda x: [I.log(parts=4)], "learned_power": lambda x: [learn.learned_power(x, x[:20], 0.35)],
    "learned_log": lambda x: [learn.learned_log(x, x[:20], 0.35)], "projection": lambda x: [learn.projection(x, "max_gap", x[:5])], "valley": lambda x: [learn.density_valley(x)],
    "envelope": lambda x: [learn.density_envelope(x)], "exclusion": lambda x: [learn.expected_exclusion(x, 0.35)], "pivot_wise": lambda x: [learn.pivot_wise(x, 0.15, 3)], "clustered": lambda x: [learn.clustered_vp(x, 3)],
}


def make(spark, rows):
    return MetricTable(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", M.L2)


def brute(rows, r):
    return {(q, i) for q, a in QUERIES for i, v in rows if np.sqrt(((np.array(a) - np.array(v)) ** 2).sum()) <= r}


@pytest.mark.parametrize("fixture", sorted(FIXTURES))
@pytest.mark.parametrize("family", sorted(LEVELS))
def test_range(spark, fixture, family):
    rows = FIXTURES[fixture]
    t = make(spark, rows)
    p = pivots.fixed(t, [0, 1, 2])
    ix = I.build_index(t, p, LEVELS[family](learn.coordinates(t, p)))
    assert sum(ix.counts) == len(rows)
    asked = spark.createDataFrame([(q, v, r) for q, v in QUERIES for r in RADII], "query_id int, v array<double>, r double").withColumn("query_id", F.struct("query_id", "r"))
    got = {(x["query_id"]["query_id"], x["query_id"]["r"], x["id"]): x["distance"] for x in ix.range_join(asked, F.col("r")).collect()}
    assert set(got) == {(q, r, i) for r in RADII for q, i in brute(rows, r)}
    at = dict(QUERIES)
    for (q, _, i), d in got.items():
        assert d == pytest.approx(np.linalg.norm(np.array(at[q]) - np.array(dict(rows)[i])), abs=1e-12)
    ix.members.unpersist()


def test_bounds_cover_members(spark):
    t = make(spark, FIXTURES["uniform"])
    ix = I.build_index(t, pivots.fixed(t, [0, 1]), [I.cght(0, 1, 3)])
    for r in ix.members.collect():
        c = ix.cells.index(r["cell"])
        f = [r["pd0"] + r["pd1"], r["pd0"] - r["pd1"], r["pd0"], r["pd1"]]
        assert all(a <= x <= b for a, x, b in zip(ix.low[c], f, ix.high[c], strict=True))


def test_stats_match_what_is_computed(spark):
    rows = FIXTURES["uniform"]
    t = make(spark, rows)
    ix = I.build_index(t, pivots.fixed(t, [0, 1]), [I.vp(range(2), 4)])
    asked = spark.createDataFrame(QUERIES, "query_id int, v array<double>")
    s = {r["query_id"]: r for r in ix.stats(asked, 0.35).collect()}
    assert len(s) == 4
    want = brute(rows, 0.35)
    for q, _ in QUERIES:
        assert s[q]["results"] == sum(a == q for a, _ in want)
        assert s[q]["results"] <= s[q]["distance_count"] - 2 <= len(rows)
        assert 0 <= s[q]["prune_rate"] <= 1
        assert s[q]["exclusion_rate"] == pytest.approx(1 - (s[q]["distance_count"] - 2) / len(rows))
    assert ix.root_neighbourhood(10.0) == len(rows)
    counter = Observation()
    ix.range_join(asked, 0.35, counted=counter).collect()
    assert counter.get["distance_count"] == sum(r["distance_count"] - 2 for r in s.values())


@pytest.mark.parametrize("k", [1, 3, 100])
def test_knn(spark, k):
    rows = FIXTURES["duplicates"]
    t = make(spark, rows)
    ix = I.build(t, "vp", 2, 3)
    asked = spark.createDataFrame(QUERIES, "query_id int, v array<double>")
    got = {}
    for r in ix.knn_join(asked, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q, a in QUERIES:
        want = sorted((np.sqrt(((np.array(a) - np.array(v)) ** 2).sum()), i) for i, v in rows)[:k]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    one = I.knn(t, pivots.Pivot(0, QUERIES[0][1]), k).collect()
    assert len(one) == min(k, len(rows))
    assert ix.knn_join(asked, 3, within=0.0).count() == sum(1 for _ in brute(rows, 0.0))


def test_nulls_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 9.0), (2, None, 1.0), (None, [1.0, 1.0], 2.0), (3, [0.1, 0.0], 3.0)], "key int, value array<double>, distance double").withColumn("cell", F.lit(5)).withColumn("pd0", F.lit("x"))
    t = MetricTable(df, "key", "value", M.L2)
    ix = I.build(t, "gh", 2)
    asked = spark.createDataFrame([(7, [0.0, 0.0]), (8, None)], "query_id int, v array<double>")
    assert sorted(r["id"] for r in ix.range_join(asked, 0.5).collect()) == [1, 3]
    assert ix.range_join(asked, -1.0).count() == 0
    assert ix.range_join(asked.limit(0), 1.0).count() == 0
    empty = MetricTable(df.limit(0), "key", "value", M.L2)
    none = I.build_index(empty, pivots.fixed(t, [1, 3]), [I.vp(range(2), 2)])
    assert none.range_join(asked, 1.0).count() == 0 and none.knn_join(asked, 2).count() == 0
    assert I.with_hits(asked, ix.range_join(asked, 0.5), hit=False).collect()[0]["query_id"] == 8


def test_limits(spark):
    t = make(spark, FIXTURES["uniform"])
    with pytest.raises(ValueError):
        I.build_index(t, pivots.fixed(t, [0, 1, 2]), [I.vp(range(3), 50)])
    with pytest.raises(ValueError):
        I.build_index(MetricTable(t.df, "id", "v", M.PEARSON), pivots.fixed(t, [0]), [I.vp()])
    with pytest.raises(ValueError):
        I.linear_scan(t, pivots.fixed(t, [0])[0], -1)


def test_collapse_and_expand(spark):
    t = make(spark, FIXTURES["degenerate"])
    small = collapse(t.rows())
    assert small.count() == 3 and small.agg(F.sum("n")).first()[0] == 60
    assert expand(small).count() == 60


def test_no_cross_join_in_the_plan(spark):
    t = make(spark, FIXTURES["uniform"])
    ix = I.build(t, "vp", 2, 3)
    plan = ix.range_join(spark.createDataFrame(QUERIES, "query_id int, v array<double>"), 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and ("HashJoin" in plan or "SortMergeJoin" in plan)


@pytest.mark.parametrize("depth", [1, 2])
@pytest.mark.parametrize("family", ["vp", "gh", "gnat", "rgh", "at", "power"])
def test_by_name_and_depth(spark, family, depth):
    rows = FIXTURES["uniform"]
    ix = I.build(make(spark, rows), family, 2, 2, depth=depth)
    got = {(r["query_id"], r["id"]) for r in ix.range_join(spark.createDataFrame(QUERIES, "query_id int, v array<double>"), 0.5).collect()}
    assert got == brute(rows, 0.5)


def test_local_mode_and_scan(spark):
    rows = FIXTURES["duplicates"]
    t = make(spark, rows)
    asked = spark.createDataFrame(QUERIES, "query_id int, v array<double>")
    for r in (0.0, 0.35):
        assert {(x["query_id"], x["id"]) for x in I.build_local(t, "vp", 2, 2).range_join(asked, r).collect()} == brute(rows, r)
        assert {(x["query_id"], x["id"]) for x in I.scan_join(t, asked, r).collect()} == brute(rows, r)
    assert I.scan_join(t, asked.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("fixture", sorted(FIXTURES))
def test_diameter(spark, fixture):
    x = np.array([v for _, v in FIXTURES[fixture]])
    assert I.diameter(make(spark, FIXTURES[fixture])) == pytest.approx(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).max())


def test_experiment(spark):
    from metricloom.plans.experiment import compare

    got = compare(make(spark, FIXTURES["uniform"]), spark.createDataFrame(QUERIES, "query_id int, v array<double>"), 0.35, verify=True).collect()
    assert len(got) == 16 and all(r["correct"] for r in got)


@pytest.mark.parametrize(("name", "family"), [("uniform", "vp"), ("uniform", "gh"), ("degenerate", "rgh")])
def test_leaf_size_and_saved_indexes(spark, tmp_path, name, family):
    t = make(spark, FIXTURES[name])
    asked = t.rows().where("id % 3 = 0").withColumnRenamed("id", "query_id")
    want = {(r["query_id"], r["id"]) for r in I.scan_join(t, asked, 0.4).collect()}
    ix = I.build(t, family, 2, 2, depth=2, leaf_size=12)
    assert {(r["query_id"], r["id"]) for r in ix.range_join(asked, 0.4).collect()} == want
    assert {(r["query_id"], r["id"]) for r in ix.range_ids(asked, 0.4).collect()} == want
    if (name, family) == ("uniform", "vp"):
        assert max(ix.counts) <= 12 < sum(ix.counts)
    I.save_index(ix, str(tmp_path / "ix"))
    back = I.open_index(spark, str(tmp_path / "ix"), t.metric)
    assert sorted(back.counts) == sorted(ix.counts)
    assert {(r["query_id"], r["id"]) for r in back.range_join(asked, 0.4).collect()} == want
    with pytest.raises(ValueError):
        I.open_index(spark, str(tmp_path / "ix"), M.L1)


def test_accept_all(spark):
    t = make(spark, FIXTURES["uniform"])
    asked = t.rows().withColumnRenamed("id", "query_id")
    ix = I.build(t, "vp", 2, 4)
    for r in (0.0, 0.5, 100.0):
        want = {(x["query_id"], x["id"]) for x in I.scan_join(t, asked, r).collect()}
        assert {(x["query_id"], x["id"]) for x in ix.range_ids(asked, r).collect()} == want
    assert ix.accepted(ix._queries(asked, "query_id", "v", 100.0)).where("distance is not null").count() == 0
    got = ix.actions(asked, 100.0).first()
    assert (got["pruned"], got["accepted"], got["opened"]) == (0, len(ix.cells), 0)


COPIED = [(i, v) for i, (_, v) in enumerate(uniform(40, 3) * 5)]
ASKED = [(1000 + i, v) for i, (_, v) in enumerate(QUERIES * 3)]


@pytest.fixture
def by_value(monkeypatch):
    """Copies are looked for in small tables, and pairs of values are counted."""
    monkeypatch.setattr(I, "COPIES_FROM", 0)


@pytest.mark.parametrize("family", ["vp", "pct", "envelope"])
@pytest.mark.parametrize("few", [True, False])
def test_values_with_copies_are_compared_once(spark, monkeypatch, by_value, family, few):
    if not few:
        monkeypatch.setattr(I, "BROADCAST", 0)
    t = make(spark, COPIED)
    p = pivots.fixed(t, [0, 1, 2])
    ix = I.build_index(t, p, LEVELS[family](learn.coordinates(t, p)))
    assert ix.copies > 4
    asked = spark.createDataFrame(ASKED, "query_id int, v array<double>")
    at, have = dict(ASKED), dict(COPIED)
    want = {(q, i): round(float(np.linalg.norm(np.array(a) - np.array(v))), 6) for q, a in at.items() for i, v in have.items() if np.linalg.norm(np.array(a) - np.array(v)) <= 0.75}
    got = ix.range_join(asked, 0.75, digits=6).collect()
    assert len(got) == len(want) and {(r["query_id"], r["id"]): r["distance"] for r in got} == pytest.approx(want)
    pairs = ix._pairs(ix._gathered_queries(ix._queries(asked, "query_id", "v", 0.75)), "query_ids")
    assert pairs.count() * 15 == ix.candidates(ix._queries(asked, "query_id", "v", 0.75)).count()
    ix.members.unpersist()


@pytest.mark.parametrize("radius", [0.0, 0.75, 3.0])
def test_counts_over_copies(spark, monkeypatch, radius):
    t, asked = make(spark, COPIED), spark.createDataFrame([*ASKED, (1, None)], "query_id int, v array<double>")
    ix = I.build_index(t, pivots.fixed(t, [0, 1]), [I.vp(range(2), 3)])
    want = [sorted(map(tuple, x.collect())) for x in (ix.stats(asked, radius), ix.unseen(asked, radius), ix.range_ids(asked, radius))]
    monkeypatch.setattr(I, "COPIES_FROM", 0)
    ix = I.build_index(t, pivots.fixed(t, [0, 1]), [I.vp(range(2), 3)])
    assert ix.copies > 4
    got = [sorted(map(tuple, x.collect())) for x in (ix.stats(asked, radius), ix.unseen(asked, radius), ix.range_ids(asked, radius))]
    assert got == want
    counter = Observation()
    ix.range_join(asked, radius, counted=counter).collect()
    assert counter.get["distance_count"] == sum(r[2] - 2 for r in want[0])


def test_many_ids_of_a_value_stand_in_several_rows(spark, monkeypatch, by_value):
    monkeypatch.setattr(I, "CHUNK", 2)
    t = make(spark, COPIED)
    ix = I.build_index(t, pivots.fixed(t, [0, 1]), [I.vp(range(2), 3)])
    asked = spark.createDataFrame(ASKED, "query_id int, v array<double>")
    got = [(r["query_id"], r["id"]) for r in ix.range_join(asked, 0.75).collect()]
    assert len(got) == len(set(got)) and len(got) == I.scan_join(t, asked, 0.75).count()
    ix.members.unpersist()


@pytest.mark.parametrize("few", [True, False])
def test_scan_of_more_queries_than_stand_in_a_plan(spark, monkeypatch, few):
    words = [(i, w) for i, w in enumerate(["red bolt", "red ring", "old plate", "", "cold plate"] * 4)]
    t = MetricTable(spark.createDataFrame(words, "id int, v string"), "id", "v", M.EDIT)
    asked = spark.createDataFrame([*words, (99, None)], "query_id int, v string")
    want = sorted(map(tuple, I.scan_join(t, asked, 4).collect()))
    monkeypatch.setattr(I, "MOST_LITERAL", 3)
    if not few:
        monkeypatch.setattr(I, "BROADCAST", 0)
    assert sorted(map(tuple, I.scan_join(t, asked, 4, digits=6).collect())) == want and len(want) > 20


@pytest.mark.parametrize("family", ["vp", "gh"])
def test_leaves_over_copies(spark, tmp_path, by_value, family):
    t, asked = make(spark, COPIED), spark.createDataFrame(ASKED, "query_id int, v array<double>")
    want = {(r["query_id"], r["id"]) for r in I.scan_join(t, asked, 0.75).collect()}
    ix = I.build(t, family, 2, 2, depth=2, leaf_size=3)
    assert len(ix.levels) == 2 and ix.low.shape[1] == sum(x.n_features for x in ix.levels) + 4  # each level's features once
    if family == "vp":
        assert ix.counts == [5] * 40  # cut down to equal rows
    got = [(r["query_id"], r["id"]) for r in ix.range_join(asked, 0.75).collect()]
    assert len(got) == len(want) and set(got) == want
    I.save_index(ix, str(tmp_path / "ix"))
    back = I.open_index(spark, str(tmp_path / "ix"), t.metric)
    assert {(r["query_id"], r["id"]) for r in back.range_join(asked, 0.75).collect()} == want
    ix.members.unpersist()


def test_lists_are_spread_in_stages_of_their_own(spark):
    import re

    pairs = spark.createDataFrame([([1, 2], [3, 4], 0.5)], "query_ids array<int>, ids array<int>, distance double")
    out = I.spread(pairs, "distance")
    assert sorted(map(tuple, out.collect())) == [(1, 3, 0.5), (1, 4, 0.5), (2, 3, 0.5), (2, 4, 0.5)]
    stages = re.findall(r"\*\((\d+)\) Generate", out._jdf.queryExecution().executedPlan().toString())
    assert len(stages) == 2 == len(set(stages))


def test_lists_of_a_hot_value_are_cut(spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 3, raising=False)
    rows = spark.createDataFrame([*[(i, "hot") for i in range(10)], (10, "rare")], "id int, v string")
    got = I.gathered(rows, ["v"], [], "id", 5.5, 11, 2).collect()
    assert max(len(r["ids"]) for r in got) == 3 and sorted(i for r in got for i in r["ids"]) == list(range(11))
    assert {i for r in got if r["v"] == "hot" for i in r["ids"]} == set(range(10))
