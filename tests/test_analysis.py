"""Pivots, clustering, classification, outliers and statistics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import metrics as M
from metricloom.operators import classify, cluster, index, learn, outlier, pivots, stats
from metricloom.operators.table import MetricTable

RNG = np.random.default_rng(19)
POINTS = np.concatenate([RNG.normal([-1, 0], 0.2, (40, 2)), RNG.normal([1, 0.5], 0.2, (40, 2)), [[5.0, 5.0]]])


@pytest.fixture(scope="module")
def table(spark):
    return MetricTable(spark.createDataFrame([(i, v) for i, v in enumerate(POINTS.tolist())], "id int, v array<double>"), "id", "v", M.L2)


@pytest.fixture(scope="module")
def ix(table):
    return index.build(table, "vp", 2, 3)


@pytest.mark.parametrize("method", sorted(pivots.METHODS))
def test_pivots(table, method):
    k = 2 if method in ("at_right_up", "power_medoid", "log_medoid") else 3
    got = pivots.select_pivots(table, k, method)
    assert len(got) == k and len({p.id for p in got}) == k
    assert all(np.allclose(p.value, POINTS[p.id]) for p in got)
    assert pivots.select_pivots(table, k, method) == got


def test_farthest_first_is_exact(table):
    want = [0]
    while len(want) < 4:
        want.append(int(np.sqrt(((POINTS[:, None] - POINTS[None, want]) ** 2).sum(2)).min(1).argmax()))
    assert [p.id for p in pivots.farthest_first(table, 4)] == want


def test_pivots_of_equal_and_no_rows(spark):
    same = MetricTable(spark.createDataFrame([(i, [1.0]) for i in range(5)], "id int, v array<double>"), "id", "v", M.L2)
    assert len(pivots.farthest_first(same, 3)) == 1 and len(pivots.random_pivots(same, 3)) == 1
    empty = MetricTable(same.df.limit(0), "id", "v", M.L2)
    assert pivots.farthest_first(empty, 3) == [] and pivots.random_pivots(empty, 2) == []


def test_medoid_pair_lies_in_both_clusters(spark):
    rows = [(i, [0.01 * (i % 20) + 10 * (i // 20), 0.0]) for i in range(40)]
    got = pivots.medoid_pair(MetricTable(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", M.L2))
    assert {p.id // 20 for p in got} == {0, 1}


def test_kmeans(table):
    got, centres = cluster.kmeans(table.rows(), 3)
    x, c = POINTS, np.array([POINTS[0], POINTS[1], POINTS[2]])
    for _ in range(300):
        into = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[into == j].mean(0) if (into == j).any() else c[j] for j in range(3)])
        moved = np.abs(new - c).max()
        c = new
        if moved <= 1e-4:
            break
    assert np.allclose(centres, c, atol=1e-3)
    assert [r["cluster"] for r in got.orderBy("id").collect()] == into.tolist()
    none, c = cluster.kmeans(table.rows().limit(0), 3)
    assert none.count() == 0 and c == []


def test_dbscan(ix):
    eps, m = 0.25, 3
    d = np.sqrt(((POINTS[:, None] - POINTS[None]) ** 2).sum(2))
    near = (d <= eps) & ~np.eye(len(POINTS), dtype=bool)
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(POINTS)), -1)
    for _ in range(len(POINTS)):
        for i in np.flatnonzero(core):
            label[i] = min([label[i], *label[near[i] & core]])
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    assert [r["cluster"] for r in cluster.dbscan(ix, eps, m).orderBy("id").collect()] == label.tolist()
    assert cluster.dbscan(ix, 1e-9, 1).where("cluster <> -1").count() == 0


def test_dbscan_does_not_return_unfinished_labels(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "id int, v array<double>")  # a chain
    chain = index.build(MetricTable(df, "id", "v", M.fixed_metric("l2", 2)), "vp", 1, 2)
    assert {r["cluster"] for r in cluster.dbscan(chain, 1.0, 1).collect()} == {0}
    with pytest.raises(RuntimeError):
        cluster.dbscan(chain, 1.0, 1, rounds=1)


def test_birch_finds_separate_clusters(table):
    got, centres = cluster.birch(table.rows(), 3, threshold=0.3, branching=5)
    by = {}
    for r in got.collect():
        by.setdefault(r["cluster"], set()).add(r["id"])
    assert len(centres) == 3 and sorted(by.values(), key=min) == [set(range(40)), set(range(40, 80)), {80}]


def test_feature_tree_keeps_counts():
    tree = cluster.FeatureTree(0.1, 4)
    x = RNG.normal(1e6, 1, (500, 2))
    for v in x:
        tree.insert((1, v, 0.0))
    leaves = tree.leaves()
    assert sum(f[0] for f in leaves) == 500
    assert np.allclose(sum(f[0] * f[1] for f in leaves) / 500, x.mean(0))
    assert all(np.sqrt(f[2] / f[0]) <= 0.1 + 1e-9 for f in leaves)


def test_davies_bouldin_variants(table):
    rows = table.rows().withColumn("cluster", F.when(F.col("id") < 40, 0).when(F.col("id") < 80, 1).otherwise(2))
    standard, reference = (cluster.davies_bouldin(rows, variant=v).first()[0] for v in ("standard", "reference"))
    assert 0 < reference < standard
    assert cluster.davies_bouldin(rows.where("cluster = 0")).first()[0] is None


@pytest.mark.parametrize("method,options", [("kmeans", {}), ("birch", {}), ("dbscan", {"eps": 0.3, "min_samples": 3})])
def test_cluster_pipeline(table, method, options):
    got = cluster.cluster_pipeline(table, pivots.farthest_first(table, 3), method, 3, **options)
    assert got.count() == 81 and len({r["cluster"] for r in got.where("id < 40").collect()} - {-1}) >= 1


def test_classify(spark, table, ix):
    labels = table.df.withColumn("y", F.when(F.col("id") < 40, "a").otherwise("b"))
    asked = spark.createDataFrame([(1, [-1.0, 0.0]), (2, [1.0, 0.5])], "query_id int, v array<double>")
    assert {r["query_id"]: r["prediction"] for r in classify.classify(ix, labels, "id", "y", asked, 5).collect()} == {1: "a", 2: "b"}
    assert classify.accuracy(MetricTable(labels, "id", "v", M.L2), "y", 3, runs=1) > 0.9


def weights(k, skip=0, kind="sum"):
    d = np.sort(np.sqrt(((POINTS[:, None] - POINTS[None]) ** 2).sum(2)), 1)[:, 1 + skip : 1 + skip + k]
    return d.sum(1) if kind == "sum" else d.max(1)


@pytest.mark.parametrize("algorithm,w", [("orca", weights(4)), ("iorca", weights(4)), ("eorca", weights(4)), ("kth", weights(4, kind="kth")), ("pfod", weights(4, 2))])
def test_outliers(ix, algorithm, w):
    got = outlier.detect(ix, algorithm, 5, 4, 2)
    want = sorted(range(len(w)), key=lambda i: (-w[i], i))[:5]
    assert [r["id"] for r in got.collect()] == want
    assert [r["weight"] for r in got.collect()] == pytest.approx([w[i] for i in want])


def test_hidden_outliers(ix):
    n, k = 4, 3
    d = np.sqrt(((POINTS[:, None] - POINTS[None]) ** 2).sum(2))
    gone, want = [], []
    for _ in range(n):
        left = [i for i in range(len(POINTS)) if i not in gone]
        w = {i: np.sort(d[i, [j for j in left if j != i]])[:k].sum() for i in left}
        best = min(w, key=lambda i: (-round(w[i], 12), i))
        want.append((best, w[best]))
        gone.append(best)
    got = outlier.detect(ix, "hod", n, k).collect()
    assert [r["id"] for r in got] == [i for i, _ in want] and [r["weight"] for r in got] == pytest.approx([w for _, w in want])


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 10, 11]] + [(None,), (float("nan"),)], "x double")
    assert stats.max_gap(df, "x") == (6.5, 7.0)
    assert stats.otsu(df, "x") == 6.5
    assert stats.max_gap(df.limit(0), "x") is None and stats.otsu(df.limit(0), "x") is None
    assert {r["bin"]: r["n"] for r in stats.histogram(df, "x", 0, 2).collect()} == {0: 1, 1: 3, 5: 2}
    ok = df.where("x is not null and not isnan(x)")
    assert [r["value"] for r in stats.quantiles(ok, [], "x", [0.0, 0.5, 1.0]).orderBy("p").collect()] == [1, 3, 11]
    assert stats.quantiles(ok, [], "x", [0.5], exact=False).count() == 1
    with pytest.raises(ValueError):
        stats.histogram(df, "x", 0, 0)


def test_curves(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.7, False), (None, True), (0.1, False)], "s double, y boolean")
    assert stats.auc(df, "s", "y").first()[0] == pytest.approx((3 + 1.5) / 6)
    assert [(r["score"], r["tpr"], r["fpr"]) for r in stats.roc(df, "s", "y").orderBy(F.desc("score")).collect()] == [(0.9, 0.5, 0), (0.8, 0.5, pytest.approx(1 / 3)), (0.7, 1, pytest.approx(2 / 3)), (0.1, 1, 1)]
    assert stats.auc(df.where("y"), "s", "y").first()[0] is None


def test_running_sums(spark):
    df = spark.range(1, 101).repartition(7).withColumn("x", F.col("id").cast("double"))
    assert {r["id"]: r["x_before"] for r in stats.running(df, "id", ["x"]).collect()} == {i: i * (i - 1) / 2 for i in range(1, 101)}


def test_covariance(spark):
    x = RNG.normal(size=(50, 3)) * [1, 2, 3]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    values, axes = stats.principal_axes(df, ["a", "b", "c"], 3)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]) and np.allclose(axes.T @ axes, np.eye(3))


def test_learners():
    xs = np.abs(RNG.normal(size=(200, 2)))
    assert learn.median_cut(np.array([3.0, 1, 2])) == 2 and learn.gap_cut(np.array([1.0, 2, 9])) == 5.5 and learn.otsu_cut(np.array([0.0, 0.1, 5, 5.1])) == pytest.approx(2.55)
    two = np.concatenate([RNG.normal(0, 0.1, 50), RNG.normal(5, 0.1, 50)])
    assert 0.5 < learn.expected_exclusion_cut(two, 0.2) < 5.2 and 1 < learn.kmeans_cuts(two)[0] < 4 and learn.kmeans_cuts(np.ones(5)) == ()
    assert max(e for _, e in learn.exclusion_curve(two, 0.2)) > 0.3
    assert learn.excluded(two, 2.5, np.full(100, 0.1)) == pytest.approx(0.5)
    assert len(learn.directions(3, "cgh")) == 6 and len(learn.best_directions(xs, 0.1, 2)) == 2


def test_streams(spark, data):
    from metricloom.streaming import match

    stream = match.read_stream(spark, data, "query_points")
    assert match.run_available(stream).count() == spark.read.parquet(f"{data}/query_points.parquet").count()


def test_exclusion_curve_of_all_rows(spark):
    x = np.random.default_rng(4).normal(size=3000).round(2)  # more rows than a sample holds, many of them equal
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "s double")
    got = [tuple(r) for r in stats.exclusion_curve(df, "s", 0.2).collect()]
    cuts = np.sort(x)[[(k * 2999 + 10) // 20 for k in range(1, 20)]]
    assert got == [(c, pytest.approx(learn.excluded(x, c, np.full(len(x), 0.2)))) for c in cuts]
    assert stats.exclusion_curve(df.limit(0), "s", 0.2).count() == 0


def test_hidden_outliers_by_passes(spark):
    rng = np.random.default_rng(3)
    t = MetricTable(spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(60, 2)).tolist())], "id int, v array<double>"), "id", "v", M.L2)
    ix = index.build(t, "vp", 2, 3)
    plain = [tuple(r) for r in outlier.hidden_outliers(ix, 4, 3).collect()]
    assert [(a, b, pytest.approx(c)) for a, b, c in plain] == [tuple(r) for r in outlier.hidden_outliers(ix, 4, 3, candidates=1).collect()]


def test_trees_of_many_tasks_are_merged(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id int, v array<double>").repartition(20)
    got, centres = cluster.birch(rows, 3, threshold=0.5)
    assert len(centres) == 3
    assert sorted(r["n"] for r in got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()) == [40, 40, 40]
