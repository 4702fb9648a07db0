"""Percentiles, subsets, clusters and neighbours against brute force."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricloom.llm import p1_percentiles as P1
from metricloom.llm import p3_subset as P3
from metricloom.llm import p4_clusters as P4
from metricloom.llm import p4_spectral as PS
from metricloom.llm import p5_neighbours as P5

RNG = np.random.default_rng(5)


# -- percentiles


def test_keys_keep_order_and_round_trip(spark):
    x = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0, math.nextafter(1, 2), -1.0, 1.7976931348623157e308, float("inf"), float("-inf")]
    x += [2.0**e for e in range(-1074, 1024, 37)] + [struct.unpack("<d", struct.pack("<q", int(b)))[0] for b in RNG.integers(0, 0x7FE << 52, 200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(-1, None), (-2, float("nan"))], "id int, v double")
    keys = P1.order_keys(df, ["id"], ["v"], ["v"])
    got = {r["id"]: (r["v"], r["back"]) for r in keys.withColumn("back", P1.key_value(F.col("v"))).collect()}
    assert got[-1] == (None, None) and got[-2] == (None, None)
    for i, v in enumerate(x):
        assert got[i][1] == v
    order = sorted(range(len(x)), key=lambda i: x[i])
    assert all((got[a][0] < got[b][0]) == (x[a] < x[b]) for a, b in zip(order, order[1:], strict=False))
    unsigned = P1.order_keys(df, ["id"], ["v"]).where("v is not null")
    assert unsigned.count() == sum(v >= 0 for v in x)


def rank(x, p):
    return sorted(x)[max(0, math.ceil(p * len(x) - 1e-9) - 1)]


def sample(spark):
    rows = [(g, float(v), float(w)) for g, n in (("a", 500), ("b", 7), (None, 3)) for v, w in zip(RNG.lognormal(0, 3, n), -RNG.lognormal(0, 2, n), strict=True)]
    rows += [("a", None, float("nan")), ("c", None, None), ("b", -1.0, 2.0), ("t", 4.0, 4.0), ("t", 4.0, 4.0)]
    return rows, spark.createDataFrame(rows, "g string, v double, w double").withColumn("_k", F.lit(1)).withColumn("n", F.lit(2))


@pytest.mark.parametrize("digits", [(16, 16, 16, 16), (8, 24, 32), (64,)])
def test_radix_is_exact(spark, digits):
    rows, df = sample(spark)
    got = {(r["g"], r["metric_name"], r["p"]): (r["value"], r["n"]) for r in P1.radix_percentiles(P1.order_keys(df, ["g"], ["v", "w"], ["w"]), ["g"], ["v", "w"], (0.1, 0.5, 0.9, 1.0), digits).collect()}
    for g in {r[0] for r in rows}:
        for m, x in (("v", [r[1] for r in rows if r[0] == g and r[1] is not None and r[1] >= 0]), ("w", [r[2] for r in rows if r[0] == g and r[2] is not None and r[2] == r[2]])):
            for p in (0.1, 0.5, 0.9, 1.0):
                assert got.pop((g, m, p), None) == ((rank(x, p), len(x)) if x else None)
    assert not got


def test_short_digits_and_sketches_keep_their_bound(spark):
    rows, df = sample(spark)
    keys = P1.order_keys(df, ["g"], ["v", "w"], ["w"])
    for r in P1.radix_percentiles(keys, ["g"], ["v", "w"], (0.5,), (16, 8)).collect():
        x = [a[1 if r["metric_name"] == "v" else 2] for a in rows if a[0] == r["g"]]
        true = rank([v for v in x if v is not None and v == v and (v >= 0 or r["metric_name"] == "w")], 0.5)
        assert abs(r["value"] - true) <= r["rel_error"] * abs(true)
    days = keys.withColumn("day", F.pmod(F.hash("v", "w"), F.lit(3)))
    whole = P1.sketch(keys, ["g"], ["v", "w"], 8)
    parts = P1.merge_sketches(P1.sketch(days, ["g", "day"], ["v", "w"], 8), ["g"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(*whole.columns).collect()))
    for r in P1.sketch_percentiles(parts, ["g"], (0.25, 0.75), 8).collect():
        x = [a[1 if r["metric_name"] == "v" else 2] for a in rows if a[0] == r["g"]]
        true = rank([v for v in x if v is not None and v == v and (v >= 0 or r["metric_name"] == "w")], r["p"])
        assert r["low"] <= true <= r["high"] and abs(r["estimate"] - true) <= r["rel_error"] * abs(true)


def test_percentiles_of_nothing_and_bad_arguments(spark):
    _, df = sample(spark)
    keys = P1.order_keys(df.limit(0), ["g"], ["v"])
    assert P1.radix_percentiles(keys, ["g"], ["v"], (0.5,)).count() == 0 and P1.sketch_percentiles(P1.sketch(keys, ["g"], ["v"]), ["g"], (0.5,)).count() == 0
    for bad in ((0.0,), (), (1.1,)):
        with pytest.raises(ValueError):
            P1.radix_percentiles(keys, ["g"], ["v"], bad)
    assert P1.once(spark.createDataFrame([(1, 2), (1, 2), (2, None)], "id int, v int"), "id").count() == 2


# -- vectors


def clusters(dim, offset=0.0, seed=0):
    """Cliques within radius 1 of well-separated centres, one with a third of the rows; singles; copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 30, (12, dim)) + offset
    sizes = [80, 30, 20, 12, 8, 5, 3, 2, 2, 1, 1, 1]
    step = lambda n: (lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) * rng.uniform(0, 0.4, (n, 1)))(rng.normal(size=(n, dim)))
    x = np.concatenate([c + step(n) for c, n in zip(centres, sizes, strict=True)])
    x[1] = x[0]
    ids = rng.permutation(1000)[: len(x)]
    label = np.repeat(np.arange(12), sizes)
    return ids, x, label


def frame(spark, groups, extra=True):
    rows = [(int(g), int(i), v.tolist(), 1.0) for g, (ids, x, _) in groups.items() for i, v in zip(ids, x, strict=True)]
    rows += rows[:7]  # loaded twice
    df = spark.createDataFrame(rows, "m int, row int, e array<double>, r double").repartition(5)
    return df.withColumn("id", F.lit("x")).withColumn("grp", F.lit(9)).withColumn("vec", F.lit(0)) if extra else df


GROUPS = {1: clusters(2), 2: clusters(16, 1e5, 1), 3: clusters(5, seed=2)}


def shifted(groups):
    return {g: (ids + 1000 * g, x, label) for g, (ids, x, label) in groups.items()}


@pytest.mark.parametrize(("chunk", "most"), [(4096, 20_000), (16, 20_000), (16, 6)])
def test_similarity_clusters(spark, chunk, most):
    groups = shifted(GROUPS)
    got = {r["id"]: (r["first_id"], r["size"]) for r in P4.similarity_clusters(frame(spark, groups), "m", "row", "e", "r", chunk=chunk, most=most).collect()}
    want = {}
    for ids, _, label in groups.values():
        for c in set(label):
            mine = ids[label == c]
            want |= {int(i): (int(mine.min()), len(mine)) for i in mine}
    assert got == want


def across_cells(spark):
    """Cliques on a line and in space, each across a border of the grid's cells."""
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.uniform(-0.25, 0.25, (12, 3)) for c in rng.uniform(-200, 200, (150, 3))])
    return x, spark.createDataFrame([(1, i, v, 1.0) for i, v in enumerate(x.tolist())], "m int, row int, e array<double>, r double").repartition(3)


def test_iteration_joins_the_anchors_of_a_cluster(spark, monkeypatch):
    x, df = across_cells(spark)
    want = {i: (i // 12 * 12, 12) for i in range(len(x))}
    result = lambda **more: {r["id"]: (r["first_id"], r["size"]) for r in P4.similarity_clusters(df, "m", "row", "e", "r", **more).collect()}
    assert result() == want
    assert result(rounds=0) != want  # without the power iteration clusters fall apart into their anchors


def test_few_vectors_and_chains(spark):
    chain = spark.createDataFrame([(1, i, [i * 0.8], 1.0) for i in range(12)], "m int, row int, e array<double>, r double").repartition(3)
    assert {r["first_id"] for r in P4.similarity_clusters(chain, "m", "row", "e", "r", chunk=2, rounds=5).collect()} <= {*range(12)}


def test_clusters_of_odd_input(spark):
    schema = "m int, row int, e array<double>, r double"
    df = spark.createDataFrame([(1, 1, [0.0], 1.0), (1, 2, None, 1.0), (None, 3, [0.0], 1.0), (1, None, [0.0], 1.0), (1, 4, [0.0], None), (1, 5, [0.0], 0.0), (1, 6, [0.0], 1.0)], schema)
    assert {(r["id"], r["first_id"], r["size"]) for r in P4.similarity_clusters(df, "m", "row", "e", "r").collect()} == {(1, 1, 2), (6, 1, 2)}
    assert P4.similarity_clusters(df.limit(0), "m", "row", "e", "r").count() == 0


def test_close_calls_far_from_the_origin():
    x = np.array([[1e8, 0.0], [1e8 + 1.0, 0.0], [1e8 + 1.0000001, 0.0], [-1e8, 0.0]])
    assert P4.near_mask(x, x, 1.0)[0].tolist() == [True, True, False, False]


def test_typical_members(spark):
    groups = shifted(GROUPS)
    df = frame(spark, groups, extra=False)
    found = P4.similarity_clusters(df, "m", "row", "e", "r")
    top = P4.typical_members(df, found, "row", "e", "r", 2).collect()
    for ids, x, label in groups.values():
        for c in set(label):
            mine = label == c
            d = ((x[mine][:, None] - x[mine][None]) ** 2).sum(2)
            affinity = (1 - d / 2).mean(1)
            want = [(int(i), pytest.approx(a, abs=2e-6)) for a, i in sorted(zip(affinity.round(9), ids[mine], strict=True), key=lambda p: (-p[0], p[1]))][:2]
            assert [(r["id"], r["affinity"]) for r in sorted(top, key=lambda r: r["rank"]) if r["first_id"] == ids[mine].min()] == want


def test_spectral_clusters_separate_groups(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ([0, 0], [20, 0], [0, 20])])
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())], "m int, row int, e array<double>")
    by = {}
    for r in PS.spectral_clusters(df.unionByName(df), "m", "row", "e", 3, leaves=40).collect():
        by.setdefault(r["cluster"], set()).add(r["id"] // 60)
    assert sorted(map(sorted, by.values())) == [[0], [1], [2]]
    assert PS.spectral_clusters(df.limit(0), "m", "row", "e", 3).count() == 0


def neighbours(ids, x, k):
    out = {}
    for i, v in zip(ids, x, strict=True):
        d = np.sqrt(((x - v) ** 2).sum(1))
        out[int(i)] = [(pytest.approx(a, abs=1e-9), int(j)) for a, j in sorted(zip(d, ids, strict=True)) if j != i][:k]
    return out


def test_nearest_is_exact_in_a_block(spark):
    groups = shifted(GROUPS)
    got = {r["id"]: [(n["d"], n["id"]) for n in r["near"]] for r in P5.nearest(frame(spark, groups), "m", "row", "e", 5, candidates=16).collect()}
    want = {}
    for ids, x, _ in groups.values():
        want |= neighbours(ids, x, 5)
    assert got == want


def vectors(spark, x):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())], "m int, row int, e array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_nearest_over_many_blocks(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "gaussian":
        x, within = rng.normal(size=(1200, 3)), None
    else:
        x, within = rng.normal(0, 20, (40, 8))[rng.integers(0, 40, 1200)] + rng.normal(0, 0.5, (1200, 8)), {1: 1.0}
    df = vectors(spark, x)
    assert P5.fit_forest(df.selectExpr("m grp", "cast(row as bigint) id", "e vec", "xxhash64(e) h"), 25, 11)[1] >= 40
    got = P5.nearest(df, "m", "row", "e", 5, cap=25, candidates=8, within=within).collect()
    want, most = neighbours(np.arange(len(x)), x, 5), within[1] if within else np.inf
    assert {r["id"]: [n["id"] for n in r["near"] if n["d"] <= most] for r in got} == {i: [j for d, j in v if d.expected <= most] for i, v in want.items()}


def test_nearest_leaves_its_block(spark):
    x = np.random.default_rng(1).normal(size=(1500, 4))
    df = vectors(spark, x)
    want = neighbours(np.arange(1500), x, 5)
    for trees in (1, 2):
        got = {r["id"]: [(n["d"], n["id"]) for n in r["near"]] for r in P5.nearest(df, "m", "row", "e", 5, trees=trees, cap=300, candidates=64).collect()}
        assert got == want
    got = {r["id"]: [(n["d"], n["id"]) for n in r["near"] if n["d"] <= 0.3] for r in P5.nearest(df, "m", "row", "e", 5, cap=300, within={1: 0.3}).collect()}
    assert got == {i: [n for n in v if n[0].expected <= 0.3] for i, v in want.items()}


def test_blocks_above_the_cap_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(P5, "SAMPLE", 64)
    x = np.concatenate([np.random.default_rng(2).normal(size=(1500, 3)), np.ones((500, 3))])
    df = vectors(spark, x)
    forest, blocks = P5.fit_forest(df.selectExpr("m grp", "cast(row as bigint) id", "e vec", "xxhash64(e) h"), 100, 11)
    sizes = np.bincount(P5.prefixes(forest[1], x[:1500]))
    assert sizes.max() <= 140 and (sizes > 0).sum() == forest[1].n_blocks <= blocks
    got = {r["id"]: [n["id"] for n in r["near"]] for r in P5.nearest(df, "m", "row", "e", 5, cap=100, candidates=32).collect()}
    assert got == {i: [j for _, j in v] for i, v in neighbours(np.arange(len(x)), x, 5).items()}


def test_recall_over_several_blocks_with_the_registered_parameters(spark):
    rng = np.random.default_rng(3)
    df = vectors(spark, np.concatenate([rng.normal(size=(30_000, 8)), rng.normal(3, 0.1, (15_000, 8))]))
    assert P5.recall(df, "m", "row", "e", P5.nearest(df, "m", "row", "e"), 0.02) == 1.0


def test_intervals_share_leading_bits():
    x = RNG.normal(size=(200, 3))
    t = P5.sort_strings(x, np.random.default_rng(0), 16)
    assert sorted(t.order) == list(range(200)) and (t.size[0] == 200).all() and (np.diff(t.size, axis=0) <= 0).all()
    rank = np.argsort(t.order)
    assert ((t.start <= rank) & (rank < t.start + t.size)).all()


def test_nearest_with_many_copies(spark):
    rows = [(1, i, [1.0, 2.0] if i % 3 == 0 else [float(i), 0.0 if i % 2 else -0.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "m int, row int, e array<double>")
    ids, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = {i: [j for _, j in n] for i, n in neighbours(ids, x, 3).items()}
    for cap in (1000, 16):
        got = {r["id"]: [n["id"] for n in r["near"]] for r in P5.nearest(df.repartition(4), "m", "row", "e", 3, cap=cap).collect()}
        assert got == want


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (1, 2, [1.0]), (2, 3, [5.0]), (None, 4, [1.0]), (1, 5, None)], "m int, row int, e array<double>")
    got = {r["id"]: [n["id"] for n in r["near"]] for r in P5.nearest(df, "m", "row", "e").collect()}
    assert got == {1: [2], 2: [1], 3: []}
    assert P5.nearest(df.limit(0), "m", "row", "e").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 6), st.integers(0, 99))
def test_block_search(n, dim, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, dim)).astype(float)
    ids = rng.permutation(500)[:n]
    r, c, d = P5.nearest_in_block(ids, x, k, candidates=7)
    got = {}
    for a, b in zip(r, c, strict=True):
        got.setdefault(int(ids[a]), []).append(int(ids[b]))
    assert got == {i: [j for _, j in v] for i, v in neighbours(ids, x, k).items() if v}


# -- subsets


@pytest.mark.parametrize("branches", [4, 64])
def test_features_add_up_far_from_the_origin(branches):
    x = RNG.normal(1e6, 1, (2000, 3))
    tree = P3.FeatureTree(branches=branches)
    for a in range(0, 2000, 300):
        part = x[a : a + 300]
        tree.insert((np.ones(len(part)), part, np.zeros(len(part))))
        tree = P3.condense(tree, 50)
    n, mean, dev = P3.entries(tree)
    assert 10 <= len(n) <= 50 and n.sum() == 2000 and max(len(f[0]) for f in tree.leaf_nodes()) <= branches
    total = dev.sum() + (n * ((mean - x.mean(0)) ** 2).sum(1)).sum()
    assert total == pytest.approx(((x - x.mean(0)) ** 2).sum(), rel=1e-6)


def test_quotas():
    assert P3._quotas(10, np.array([1.0, 1.0, 2.0]), np.array([9, 1, 9])).tolist() == [3, 1, 6]
    assert P3._quotas(5, np.array([1.0, 1.0]), np.array([1, 2])).tolist() == [1, 2]


def test_ward_cut_finds_separate_groups():
    x = np.concatenate([RNG.normal(c, 0.1, (20, 2)) for c in ((0, 0), (9, 0), (0, 9))])
    got = P3.ward_cut((np.ones(60), x, np.zeros(60)), 3)
    assert len(set(got)) == 3 and all(len(set(got[i : i + 20])) == 1 for i in (0, 20, 40))
    assert len(set(P3.ward_cut((np.ones(60), x, np.zeros(60)), 100))) == 60


def test_subset_covers_clusters_and_counts(spark):
    groups = shifted(GROUPS)
    df = frame(spark, groups)
    asked = spark.createDataFrame([(1, 1, 12), (2, 2, 12), (3, 3, 12), (4, 1, 10_000), (5, 1, 1), (6, 77, 5), (7, 1, 0), (None, 1, 5)], "request int, grp int, size int")
    got = {}
    for r in P3.varied_subset(df, "m", "row", "e", asked).collect():
        got.setdefault(r["request"], []).append(r["id"])
    assert {r: len(v) for r, v in got.items()} == {1: 12, 2: 12, 3: 12, 4: 165, 5: 1} and all(len(set(v)) == len(v) for v in got.values())
    for request in (1, 2, 3):
        ids, _, label = groups[request]
        assert {label[ids == i][0] for i in got[request]} == set(range(12))


@pytest.mark.parametrize("one", [4, 30])
def test_large_requests_are_divided(spark, one):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 50, (60, 3))
    x = np.concatenate([centres[i] + rng.normal(0, 0.2, (300 if i == 0 else 10, 3)) for i in range(60)])
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())] + [(2, 10_000 + i, [1.0, 1.0]) for i in range(50)], "m int, row int, e array<double>").repartition(3)
    df = df.unionByName(df.limit(20))
    asked = spark.createDataFrame([(1, 1, 120), (2, 1, 60), (3, 2, 40), (4, 1, 3)], "request int, grp int, size int")
    got = {}
    for r in P3.varied_subset(df, "m", "row", "e", asked, one=one).collect():
        got.setdefault(r["request"], set()).add(r["id"])
    assert {r: len(v) for r, v in got.items()} == {1: 120, 2: 60, 3: 40, 4: 3}
    label = np.repeat(np.arange(60), [300] + [10] * 59)
    assert len({label[i] for i in got[1]}) >= 54 and sum(label[i] == 0 for i in got[1]) <= 40


def test_subset_of_equal_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(1, i, [1.0, 1.0]) for i in range(9)] + [(1, None, [1.0, 1.0]), (1, 10, None)], "m int, row int, e array<double>")
    asked = spark.createDataFrame([(1, 1, 4)], "request int, grp int, size int")
    assert P3.varied_subset(df, "m", "row", "e", asked).select("id").distinct().count() == 4
    assert P3.varied_subset(df.limit(0), "m", "row", "e", asked).count() == 0
    assert P3.varied_subset(df, "m", "row", "e", asked.limit(0)).count() == 0
