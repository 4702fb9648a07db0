"""Registered queries of the core library, and the same in SQL where SQL can say it.

Every query runs over whole tables. Batch searches ask for every row whose id is divisible by 20 against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions import metrics as M
from metricloom.functions import sequences as S
from metricloom.operators import classify, cluster, index, learn, outlier, pivots, stats, table
from metricloom.operators.table import MetricTable
from metricloom.plans import experiment
from metricloom.streaming import match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- tables -----------------------------------------------------------------------------------------------------------


def emb(spark: SparkSession, d: str) -> MetricTable:
    df = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    return MetricTable(df, "vec_id", "v", M.L2)


def points(spark: SparkSession, d: str) -> MetricTable:
    return MetricTable(spark.read.parquet(f"{d}/query_points.parquet"), "query_id", "qv", M.fixed_metric("l2", 2))


def parts(spark: SparkSession, d: str) -> MetricTable:
    df = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v"), "p_brand")
    return MetricTable(df, "p_partkey", "v", M.fixed_metric("l2", 2))


def names(spark: SparkSession, d: str) -> MetricTable:
    return MetricTable(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), "p_partkey", "p_name", M.EDIT)


def asked(t: MetricTable) -> DataFrame:
    return t.rows().where("id % 20 = 0").withColumnRenamed("id", "query_id")


EMB = "x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
POINTS = "x AS MATERIALIZED (SELECT query_id AS id, qv AS v FROM query_points WHERE qv IS NOT NULL)"
PARTS = "x AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice / 100] AS v FROM part)"
NAMES = "x AS (SELECT p_partkey AS id, p_name AS v FROM part WHERE p_name IS NOT NULL)"
L2 = "list_distance(q.v, x.v)"


def _lp(p: float) -> str:
    return f"pow(list_sum(list_transform(list_zip(q.v, x.v), lambda t: pow(abs(t[1] - t[2]), {p}))), 1.0 / {p})"


LINF = "list_max(list_transform(list_zip(q.v, x.v), lambda t: abs(t[1] - t[2])))"


def range_sql(src: str, dist: str, r: float) -> str:
    return f"WITH {src} SELECT q.id AS query_id, x.id, round({dist}, 6) AS distance FROM x q JOIN x ON {dist} <= {r} WHERE q.id % 20 = 0"


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 6))


# -- distances --------------------------------------------------------------------------------------------------------


def _pairs(t: MetricTable) -> tuple[DataFrame, Column, Column]:
    """Each row with the row of the next id."""
    a, b = t.rows(), t.rows().select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return a.join(b, "id"), F.col("v"), F.col("w")


_ZIP = "list_transform(list_zip(q.v, x.v), lambda t: {})"


@query(
    "metrics_vector",
    f"""WITH {EMB} SELECT q.id, round(list_sum({_ZIP.format('abs(t[1] - t[2])')}), 6) AS l1, round(list_distance(q.v, x.v), 6) AS l2,
  round(list_max({_ZIP.format('abs(t[1] - t[2])')}), 6) AS linf, round(pow(list_sum({_ZIP.format('pow(abs(t[1] - t[2]), 3)')}), 1.0 / 3), 6) AS l3,
  round(list_distance(q.v[5:12], x.v[5:12]), 6) AS partial,
  round((list_distance(q.v[1:3], x.v[1:3]) + list_distance(q.v[4:51], x.v[4:51]) / 60 + list_distance(q.v[52:64], x.v[52:64])) * 0.333333, 6) AS image,
  round(1 - (64 * list_inner_product(q.v, x.v) - list_sum(q.v) * list_sum(x.v)) / sqrt((64 * list_inner_product(q.v, q.v) - list_sum(q.v) ** 2) * (64 * list_inner_product(x.v, x.v) - list_sum(x.v) ** 2)), 6) AS pearson,
  round(list_distance(q.v[1:34], x.v[1:34]) + list_sum(list_transform(list_zip(q.v[35:], x.v[35:]), lambda t: CASE WHEN t[1] = t[2] THEN 0 ELSE 1 END)), 6) AS mixed
FROM x q JOIN x ON x.id = q.id + 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    df, a, b = _pairs(emb(spark, d))
    cols = {"l1": M.l1(a, b), "l2": M.l2(a, b), "linf": M.linf(a, b), "l3": M.lp(3)(a, b), "partial": M.partial_l2(4, 12)(a, b), "image": M.image(a, b), "pearson": M.pearson(a, b), "mixed": M.euclid_hamming(34)(a, b)}
    return df.select("id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("metrics_edit", f"WITH {NAMES} SELECT q.id, levenshtein(q.v, x.v)::DOUBLE AS edit FROM x q JOIN x ON x.id = q.id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    df, a, b = _pairs(names(spark, d))
    return df.select("id", M.edit(a, b).alias("edit"))


FRAGMENT = 12
_SEQS = "SELECT DISTINCT seq_id, upper(seq) AS seq FROM labelled_dna WHERE seq IS NOT NULL"


def _seqs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labelled_dna.parquet").where("seq is not null").select("seq_id", F.upper("seq").alias("seq")).distinct()


@query("fragments", f"SELECT seq_id, o::INT AS \"offset\", substr(seq, o + 1, {FRAGMENT}) AS frag FROM (SELECT seq_id, seq, unnest(range(length(seq) - {FRAGMENT})) AS o FROM ({_SEQS}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.fragments(_seqs(spark, d), "seq_id", "seq", FRAGMENT)


_WEIGHTS = ", ".join(f"('{p[0]}', '{p[1]}', {w})" for p, w in S.DNA_MATRIX.weights)


@query(
    "range_hamming_fragment",
    f"""WITH w(a, b, weight) AS (VALUES {_WEIGHTS}), q AS (SELECT substr(seq, 1, {FRAGMENT}) AS s FROM ({_SEQS}) WHERE length(seq) > {FRAGMENT} ORDER BY seq_id LIMIT 1),
f AS (SELECT seq_id, o, substr(seq, o + 1, {FRAGMENT}) AS frag FROM (SELECT seq_id, seq, unnest(range(length(seq) - {FRAGMENT})) AS o FROM ({_SEQS}))),
u AS (SELECT DISTINCT frag FROM f),
s AS (SELECT frag, sum(CASE WHEN substr(frag, i, 1) = substr(q.s, i, 1) THEN 0 ELSE coalesce(weight, 1) END) AS d FROM u, q, range(1, {FRAGMENT + 1}) r(i) LEFT JOIN w ON a = substr(q.s, i, 1) AND b = substr(frag, i, 1) GROUP BY frag)
SELECT seq_id, o::INT AS "offset", round(d::DOUBLE, 6) AS distance FROM f JOIN s USING (frag) WHERE d <= 5""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    seqs = _seqs(spark, d)
    frags = S.fragments(seqs, "seq_id", "seq", FRAGMENT)
    first = seqs.where(F.length("seq") > FRAGMENT).orderBy("seq_id").limit(1).collect()
    target = F.lit(first[0]["seq"][:FRAGMENT] if first else "")
    return frags.select("seq_id", "offset", F.round(M.hamming(S.DNA_MATRIX)(target, F.col("frag")), 6).alias("distance")).where("distance <= 5")


@query("metrics_spectra")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy cosine of peak lists made from the matrix rows: the absolute values of a row as masses."""
    rows = spark.read.parquet(f"{d}/matrix_rows.parquet").where("elements is not null and size(elements) > 1").dropDuplicates(["row_id"])
    peaks = F.array_sort(F.filter(F.transform("elements", F.abs), lambda x: x.isNotNull() & ~F.isnan(x) & (x < float("inf"))))
    t = MetricTable(rows.select("row_id", F.struct(F.element_at("elements", 1).alias("precursor"), peaks.alias("peaks")).alias("s")), "row_id", "s", M.MSMS)
    df, a, b = _pairs(t)
    return df.select("id", F.round(M.ms(a["peaks"], b["peaks"]), 6).alias("ms"), F.round(M.msms(a, b), 6).alias("msms"))


# -- linear scans -----------------------------------------------------------------------------------------------------


def _scan(name: str, metric: M.Metric, dist: str, r: float) -> None:
    sql = f"WITH {EMB}, q AS (SELECT * FROM x WHERE id = 0) SELECT x.id, round({dist}, 6) AS distance FROM q, x WHERE {dist} <= {r}"

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = emb(spark, d)
        t = MetricTable(t.df, t.id_col, t.value_col, metric)
        return _rounded(index.linear_scan(t, pivots.fixed(t, [0])[0], r))


_scan("range_l1", M.L1, _lp(1), 8.5)
_scan("range_l2", M.L2, L2, 1.3)
_scan("range_linf", M.LINF, LINF, 0.4)
_scan("range_lp3", M.lp_metric(3), _lp(3), 0.75)


@query("range_edit", f"WITH {NAMES}, q AS (SELECT * FROM x WHERE id = 1) SELECT x.id, levenshtein(q.v, x.v)::DOUBLE AS distance FROM q, x WHERE levenshtein(q.v, x.v) <= 8")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = names(spark, d)
    return index.linear_scan(t, pivots.fixed(t, [1])[0], 8)


@query("knn", f"WITH {EMB} SELECT x.id, round({L2}, 6) AS distance FROM x q, x WHERE q.id = 7 ORDER BY {L2}, x.id LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = emb(spark, d)
    return _rounded(index.knn(t, pivots.fixed(t, [7])[0], 10))


@query("dedup_runs", "SELECT min(query_id) AS id, count(*) AS n FROM query_points WHERE qv IS NOT NULL GROUP BY qv")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table.collapse(points(spark, d).rows()).select("id", "n")


@query("expand_runs", "SELECT query_id AS id FROM query_points WHERE qv IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table.expand(table.collapse(points(spark, d).rows())).select("id")


# -- pivots and pivot space -------------------------------------------------------------------------------------------

PIVOTS = (1, 2, 3, 4)
_PD = "d AS (SELECT x.id, x.v, " + ", ".join(f"list_distance(x.v, p{i}.v) AS pd{i}" for i in range(4)) + " FROM x" + "".join(f" JOIN x p{i} ON p{i}.id = {k}" for i, k in enumerate(PIVOTS)) + ")"


def _embedded(t: MetricTable) -> DataFrame:
    return pivots.embed(t, pivots.fixed(t, list(PIVOTS)))


@query("pivot_embed", f"WITH {EMB}, {_PD} SELECT id, round(pd0, 6) AS pd0, round(pd1, 6) AS pd1, round(pd2, 6) AS pd2, round(pd3, 6) AS pd3 FROM d")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(emb(spark, d)).select("id", *[F.round(f"pd{i}", 6).alias(f"pd{i}") for i in range(4)])


@query("pivot_filter", f"WITH {PARTS}, {_PD} SELECT count(*) AS n FROM d q JOIN d x ON " + " AND ".join(f"abs(q.pd{i} - x.pd{i}) <= 1.5" for i in range(4)) + " WHERE q.id % 20 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d)
    ix = index.build_index(t, pivots.fixed(t, list(PIVOTS)), [index.vp(range(2), 4)])
    return ix.candidates(ix._queries(asked(t), "query_id", "v", 1.5)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pivots_fft",
    f"""WITH {PARTS}, a AS (SELECT * FROM x ORDER BY id LIMIT 1),
b AS (SELECT x.* FROM x, a ORDER BY list_distance(x.v, a.v) DESC, x.id LIMIT 1),
c AS (SELECT x.* FROM x, a, b ORDER BY least(list_distance(x.v, a.v), list_distance(x.v, b.v)) DESC, x.id LIMIT 1),
e AS (SELECT x.* FROM x, a, b, c ORDER BY least(list_distance(x.v, a.v), list_distance(x.v, b.v), list_distance(x.v, c.v)) DESC, x.id LIMIT 1)
SELECT 0 AS no, id::VARCHAR AS id FROM a UNION ALL SELECT 1, id::VARCHAR FROM b UNION ALL SELECT 2, id::VARCHAR FROM c UNION ALL SELECT 3, id::VARCHAR FROM e""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pivots.pivot_rows(spark, pivots.select_pivots(parts(spark, d), 4, "fft")).drop("value")


@query("pivots_all_methods")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three pivots by every method."""
    t = parts(spark, d)
    rows = [(m, i, str(p.id)) for m in sorted(pivots.METHODS) for i, p in enumerate(pivots.select_pivots(t, 3, m))]
    return spark.createDataFrame(rows, "method string, no int, id string")


@query("power_scores", f"WITH {EMB}, {_PD} SELECT id, round(pow(pd0, 2) - pow(pd1, 2), 6) AS plus, round(pow(CASE WHEN pd0 = 0 THEN 1e-12 ELSE pd0 END, -0.5) - pow(CASE WHEN pd1 = 0 THEN 1e-12 ELSE pd1 END, -0.5), 6) AS minus FROM d WHERE pd0 > 0 AND pd1 > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col("pd0"), F.col("pd1")]
    up, down = index.power(2.0).features(cols)[0], index.power(-0.5).features(cols)[0]
    return _embedded(emb(spark, d)).where("pd0 > 0 and pd1 > 0").select("id", F.round(up, 6).alias("plus"), F.round(down, 6).alias("minus"))


@query("log_scores", f"WITH {EMB}, {_PD} SELECT id, round(ln(greatest(pd0, 1e-12)) - ln(greatest(pd1, 1e-12)), 6) AS score FROM d")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(emb(spark, d)).select("id", F.round(index.log().features([F.col("pd0"), F.col("pd1")])[0], 6).alias("score"))


# -- partitions -------------------------------------------------------------------------------------------------------


def _cut(f: str, p: str) -> str:
    return f"(SELECT f FROM (SELECT {f} AS f, row_number() OVER (ORDER BY {f}) AS r, count(*) OVER () AS n FROM d) WHERE r = ceil(n * ({p})))"


_RATIO = "CASE WHEN pd1 = 0 THEN 1.7976931348623157e308 ELSE pd0 / pd1 END"
_CODES = {
    "gh_partition": (lambda: [index.gh()], "CASE WHEN pd0 - pd1 >= 0 THEN 1 ELSE 0 END"),
    "vp_partition": (lambda: [index.vp(range(2), 3)], " + ".join(f"{w} * ((pd{i} >= {_cut(f'pd{i}', '1.0 / 3')})::INT + (pd{i} >= {_cut(f'pd{i}', '2.0 / 3')})::INT)" for i, w in ((0, 3), (1, 1)))),
    "gnat_partition": (lambda: [index.gnat(range(4))], "list_position([pd0, pd1, pd2, pd3], least(pd0, pd1, pd2, pd3)) - 1"),
    "rgh_partition": (lambda: [index.rgh()], f"({_RATIO} >= {_cut(_RATIO, '0.5')})::INT"),
    "at_partition": (lambda: [index.apollonian()], f"({_RATIO} >= {_cut(_RATIO, '1.0 / 3')})::INT + ({_RATIO} >= {_cut(_RATIO, '2.0 / 3')})::INT"),
    "cght_partition": (lambda: [index.cght()], f"2 * (pd0 + pd1 >= {_cut('pd0 + pd1', '0.5')})::INT + (pd0 - pd1 >= {_cut('pd0 - pd1', '0.5')})::INT"),
    "cp_partition": (lambda: [index.linear([[0.6, -0.8, 0.0, 0.2]], 3)], " + ".join(f"(pd0 * 0.6 + pd1 * -0.8 + pd3 * 0.2 >= {_cut('pd0 * 0.6 + pd1 * -0.8 + pd3 * 0.2', p)})::INT" for p in ("1.0 / 3", "2.0 / 3"))),
    "slab_grid": (lambda: [index.linear([[1.0, 1.0], [1.0, -1.0]], thresholds=((2.7, 2.8), (0.0,)))], "2 * ((pd0 + pd1 >= 2.7)::INT + (pd0 + pd1 >= 2.8)::INT) + (pd0 - pd1 >= 0)::INT"),
}


def _partition(name: str) -> None:
    levels, code = _CODES[name]

    @query(name, f"WITH {EMB}, {_PD} SELECT id, ({code})::INT AS cell FROM d")
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _embedded(emb(spark, d))
        return index.assign_cells(rows, [f"pd{i}" for i in range(4)], levels()).select("id", F.col("cell").cast("int").alias("cell"))


for _name in _CODES:
    _partition(_name)


@query(
    "cell_stats",
    f"WITH {EMB}, {_PD}, c AS (SELECT *, ({_CODES['gnat_partition'][1]})::INT AS cell FROM d) SELECT cell, count(*) AS n, "
    + ", ".join(f"round(min(pd{i}), 6) AS lo{i}, round(max(pd{i}), 6) AS hi{i}" for i in range(4))
    + " FROM c GROUP BY cell",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = emb(spark, d)
    cells = index.build_index(t, pivots.fixed(t, list(PIVOTS)), [index.gnat(range(4))]).cell_rows()
    return cells.select("cell", "n", *[F.round(F.col(b)[4 + i], 6).alias(f"{b}{i}") for i in range(4) for b in ("lo", "hi")])


# -- indexed searches -------------------------------------------------------------------------------------------------


def _coordinates(t: MetricTable, p: list[pivots.Pivot]) -> object:
    return learn.coordinates(t, p)


def _searches() -> dict[str, tuple[Callable[[SparkSession, str], MetricTable], str, str, float, Callable[[MetricTable, list[pivots.Pivot]], list[index.Level]]]]:
    two = range(2)
    pts = (points, POINTS, L2, 0.2)
    prt = (parts, PARTS, L2, 1.5)
    return {
        "range_join": (emb, EMB, L2, 1.25, lambda t, p: [index.vp(two, 3)]),
        "range_join_edit": (names, NAMES, "levenshtein(q.v, x.v)", 5, lambda t, p: [index.vp(two, 3)]),
        "vp_range": (*pts, lambda t, p: [index.vp(two, 8)]),
        "vp_two_level_range": (*pts, lambda t, p: [index.vp([0], 4), index.vp([1], 4)]),
        "gh_range": (*pts, lambda t, p: [index.gh(0, 1), index.gh(2, 3)]),
        "cght_range": (*pts, lambda t, p: [index.cght(0, 1, 4)]),
        "gnat_range": (*pts, lambda t, p: [index.gnat(range(4))]),
        "rgh_range": (*pts, lambda t, p: [index.rgh(0, 1), index.rgh(2, 3)]),
        "at_range": (*pts, lambda t, p: [index.apollonian(0, 1), index.apollonian(2, 3)]),
        "iat_range": (*pts, lambda t, p: [index.iat(learn.iat_cuts(_coordinates(t, p)))]),
        "cp_range": (*prt, lambda t, p: [learn.complete_linear(_coordinates(t, p), 1.5, 3, 4)]),
        "pct_range": (*prt, lambda t, p: [index.pct(learn.pct_centres(_coordinates(t, p), 8))]),
        "power_range": (*prt, lambda t, p: [index.power(2.0, parts=6)]),
        "power_negative_range": (*prt, lambda t, p: [index.power(-2.0, parts=6)]),
        "log_range": (*prt, lambda t, p: [index.log(parts=6)]),
        "learned_power_range": (*pts, lambda t, p: [learn.learned_power(x := _coordinates(t, p), x[:200], 0.2)]),
        "learned_log_range": (*pts, lambda t, p: [learn.learned_log(x := _coordinates(t, p), x[:200], 0.2)]),
        "projection_range": (*pts, lambda t, p: [learn.projection(_coordinates(t, p), "otsu")]),
        "density_valley_range": (*prt, lambda t, p: [learn.density_valley(_coordinates(t, p))]),
        "density_envelope_range": (*prt, lambda t, p: [learn.density_envelope(_coordinates(t, p)[:400])]),
        "expected_exclusion_range": (*prt, lambda t, p: [learn.expected_exclusion(_coordinates(t, p), 1.5)]),
        "pivot_wise_range": (*prt, lambda t, p: [learn.pivot_wise(_coordinates(t, p), 1.5, 3)]),
        "clustered_vp_range": (*prt, lambda t, p: [learn.clustered_vp(_coordinates(t, p), 3)]),
    }


def _search(name: str) -> None:
    source, src, dist, r, levels = _searches()[name]

    @query(name, range_sql(src, dist, r))
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = source(spark, d)
        p = pivots.select_pivots(t, 4, "fft")
        return index.build_index(t, p, levels(t, p)).range_join(asked(t), r, digits=6)


for _name in _searches():
    _search(_name)


@query("knn_join", f"WITH {EMB}, r AS (SELECT q.id AS query_id, x.id, {L2} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, x.id) AS rank FROM x q, x WHERE q.id % 20 = 0) SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = emb(spark, d)
    return _rounded(index.build(t, "vp", 2, 3).knn_join(asked(t), 5))


@query("knn_within", f"WITH {POINTS}, r AS (SELECT q.id AS query_id, x.id, {L2} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, x.id) AS rank FROM x q, x WHERE q.id % 20 = 0 AND {L2} <= 0.05) SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d)
    return _rounded(index.build(t, "vp", 2, 8).knn_join(asked(t), 5, within=0.05))


@query("queries_without_hits", f"WITH {POINTS} SELECT q.id AS query_id FROM x q WHERE q.id % 20 = 0 AND NOT EXISTS (SELECT 1 FROM x WHERE x.id <> q.id AND {L2} <= 0.02)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d)
    found = index.build(t, "vp", 2, 8).range_join(asked(t), 0.02).where("id <> query_id")
    return index.with_hits(asked(t), found, hit=False).select("query_id")


@query(
    "search_stats",
    f"""WITH {PARTS}, {_PD}, c AS (SELECT *, (pd0 - pd1 >= 0)::INT AS cell FROM d),
b AS (SELECT cell, count(*) AS n, min(pd0 - pd1) AS l, max(pd0 - pd1) AS h, {", ".join(f"min(pd{i}) AS l{i}, max(pd{i}) AS h{i}" for i in range(4))} FROM c GROUP BY cell),
v AS (SELECT q.id, b.cell FROM c q JOIN b ON q.id % 20 = 0 AND l <= q.pd0 - q.pd1 + 3 AND h >= q.pd0 - q.pd1 - 3 AND {" AND ".join(f"l{i} <= q.pd{i} + 1.5 AND h{i} >= q.pd{i} - 1.5" for i in range(4))}),
w AS (SELECT id, count(*) AS cells_visited FROM v GROUP BY id),
e AS (SELECT v.id, count(*) AS n, count(*) FILTER (list_distance(q.v, c.v) <= 1.5) AS results FROM v JOIN c q ON q.id = v.id JOIN c ON c.cell = v.cell AND {" AND ".join(f"abs(q.pd{i} - c.pd{i}) <= 1.5" for i in range(4))} GROUP BY v.id)
SELECT w.id AS query_id, cells_visited::INT AS cells_visited, e.n + 4 AS distance_count, results, 1 - cells_visited / (SELECT count(*) FROM b)::DOUBLE AS prune_rate, 1 - e.n / (SELECT count(*) FROM c)::DOUBLE AS exclusion_rate FROM w JOIN e USING (id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d)
    return index.build_index(t, pivots.fixed(t, list(PIVOTS)), [index.gh(0, 1)]).stats(asked(t), 1.5)


@query("local_mode_range", range_sql(POINTS, L2, 0.2))
def _(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d)
    return _rounded(index.build_local(t, "gh", 2).range_join(asked(t), 0.2))


@query("scan_join", range_sql(NAMES, "levenshtein(q.v, x.v)", 5))
def _(spark: SparkSession, d: str) -> DataFrame:
    t = names(spark, d)
    return index.scan_join(t, asked(t), 5, digits=6)


@query("range_linear_scan", range_sql(POINTS, L2, 0.2))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same searches as `vp_range` and its kin, without an index."""
    t = points(spark, d)
    return _rounded(index.scan_join(t, asked(t), 0.2))


@query("pairwise_distances", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::DOUBLE AS distance FROM nation a, nation b")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = MetricTable(spark.read.parquet(f"{d}/nation.parquet"), "n_name", "n_name", M.EDIT)
    return index.scan_join(t, t.rows().withColumnRenamed("id", "query_id"), 1e9).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")


@query("diameter", f"WITH {PARTS} SELECT round(max(list_distance(q.v, x.v)), 6) AS diameter FROM x q, x")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(index.diameter(parts(spark, d)), 6),)], "diameter double")


@query("family_experiment")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d)
    return experiment.compare(t, asked(t), 1.5)


@query(
    "root_neighbourhood",
    f"""WITH {PARTS}, a AS (SELECT * FROM x ORDER BY id LIMIT 1), b AS (SELECT x.* FROM x, a ORDER BY list_distance(x.v, a.v) DESC, x.id LIMIT 1),
p AS (SELECT x.id, list_distance(x.v, a.v) AS p, list_distance(x.v, b.v) AS q FROM x, a, b), f AS (SELECT *, CASE WHEN q = 0 THEN 1.7976931348623157e308 ELSE p / q END AS f FROM p),
m AS (SELECT f AS cut FROM (SELECT f, row_number() OVER (ORDER BY f) AS i, count(*) OVER () AS n FROM f) WHERE i = ceil(n * 0.5)),
c AS (SELECT f >= cut AS cell, min(f) AS fl, max(f) AS fh, min(p) AS pl, max(p) AS ph, min(q) AS ql, max(q) AS qh FROM f, m GROUP BY 1),
k AS (SELECT r, f.id, count(*) AS cells FROM f, c, (VALUES (0.5::DOUBLE), (1.5), (5.0)) t(r)
  WHERE pl <= p + r AND ph >= p - r AND ql <= q + r AND qh >= q - r AND fh >= greatest(p - r, 0) / (q + r) AND (q <= r OR fl <= (p + r) / (q - r)) GROUP BY ALL)
SELECT r AS radius, count(*) FILTER (cells > 1) AS n FROM k GROUP BY r""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    ix = index.build(parts(spark, d), "rgh", 2)
    return spark.createDataFrame([(r, ix.root_neighbourhood(r)) for r in (0.5, 1.5, 5.0)], "radius double, n bigint")


@query(
    "exclusion_curve",
    f"""WITH {PARTS}, s AS (SELECT list_distance(v, (SELECT v FROM x WHERE id = 1)) AS s FROM x), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM s WHERE s IS NOT NULL),
c AS (SELECT o.s AS cut FROM range(1, 20) k(k) JOIN o ON o.r = (k * (n - 1) + 10) // 20),
e AS (SELECT cut, avg((s < cut)::INT) AS low, avg((s + 1.5 < cut)::INT) AS left_of, avg((s - 1.5 >= cut)::INT) AS right_of FROM (SELECT row_number() OVER () AS i, cut FROM c), o GROUP BY i, cut)
SELECT round(cut, 9) AS cut, round(left_of * (1 - low) + right_of * low, 9) AS excluded FROM e""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d)
    got = stats.exclusion_curve(pivots.embed(t, pivots.fixed(t, [1])), "pd0", 1.5)
    return got.select(F.round("cut", 9).alias("cut"), F.round("excluded", 9).alias("excluded"))


# -- clustering -------------------------------------------------------------------------------------------------------

CENTRES = [[10.0, 10.0], [25.0, 15.0], [40.0, 12.0]]
_ASSIGN = "a AS (SELECT id, v, list_transform([" + ", ".join(str(c) for c in CENTRES) + "], lambda c: list_distance(v, c)) AS ds FROM x), k AS (SELECT id, v, (list_position(ds, list_min(ds)) - 1)::INT AS cluster FROM a)"


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).rows().withColumn("cluster", cluster.nearest_centre("v", CENTRES)["i"])


@query("kmeans_assign_step", f"WITH {PARTS}, {_ASSIGN} SELECT id, cluster FROM k")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("id", "cluster")


@query("kmeans_update_step", f"WITH {PARTS}, {_ASSIGN} SELECT cluster, count(*) AS n, [round(avg(v[1]), 6), round(avg(v[2]), 6)] AS centre FROM k GROUP BY cluster")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.centroids(_assigned(spark, d)).withColumn("centre", F.transform("centre", lambda x: F.round(x, 6)))


@query("davies_bouldin", f"""WITH {PARTS}, {_ASSIGN}, m AS (SELECT cluster, [avg(v[1]), avg(v[2])] AS c FROM k GROUP BY cluster),
s AS (SELECT cluster, any_value(c) AS c, avg(list_distance(v, c)) AS s FROM k JOIN m USING (cluster) GROUP BY cluster),
w AS (SELECT a.cluster, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY a.cluster)
SELECT round(avg(w), 6) AS davies_bouldin FROM w""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.davies_bouldin(_assigned(spark, d)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("kmeans")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(parts(spark, d).rows(), 4)[0].select("id", "cluster")


@query("birch")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.birch(parts(spark, d).rows(), 4, threshold=1.0)[0].select("id", "cluster")


@query("cluster_pipeline")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = emb(spark, d)
    return cluster.cluster_pipeline(t, pivots.select_pivots(t, 3), "kmeans", 5).select("id", "cluster")


EPS, MIN_SAMPLES = 0.03, 4
_NEAR = f"n AS (SELECT q.id AS a, x.id AS b FROM x q JOIN x ON q.id <> x.id AND {L2} <= {EPS}), core AS (SELECT a AS id, count(*) AS n FROM n GROUP BY a HAVING count(*) >= {MIN_SAMPLES})"


@query("eps_neighbors", f"WITH {POINTS}, {_NEAR} SELECT a AS id, count(*) AS n FROM n GROUP BY a")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.core_points(index.build(points(spark, d), "vp", 2, 16), EPS, 1)


@query("dbscan_core_points", f"WITH {POINTS}, {_NEAR} SELECT id, n FROM core")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.core_points(index.build(points(spark, d), "vp", 2, 16), EPS, MIN_SAMPLES)


@query(
    "dbscan",
    f"""WITH RECURSIVE {POINTS}, {_NEAR}, e AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, label) AS (SELECT id, id FROM core UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.id AND reach.label < e.b),
lab AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
border AS (SELECT n.a AS id, min(label) AS label FROM n JOIN lab ON lab.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a)
SELECT x.id, coalesce(lab.label, border.label, -1)::INT AS cluster FROM x LEFT JOIN lab USING (id) LEFT JOIN border USING (id)""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return cluster.dbscan(index.build(points(spark, d), "vp", 2, 16), EPS, MIN_SAMPLES)


@query("cf_triples", "SELECT label, count(*) AS n, round(sum(v[1]), 6) AS ls1, round(sum(v[2]), 6) AS ls2, round(sum(v[1] ** 2 + v[2] ** 2), 6) AS ss FROM (SELECT label, embedding::DOUBLE[] AS v FROM embeddings) GROUP BY label")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = emb(spark, d).df.select("label", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    got = stats.cluster_features(rows, ["label"], ["a", "b"])
    return got.select("label", "n", F.round(F.col("ls")[0], 6).alias("ls1"), F.round(F.col("ls")[1], 6).alias("ls2"), F.round("ss", 6).alias("ss"))


# -- classification and outliers --------------------------------------------------------------------------------------


@query(
    "knn_classify",
    f"""WITH {EMB}, r AS (SELECT q.id AS query_id, x.label, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, x.id) AS k FROM x q JOIN x ON x.id % 20 <> 0 WHERE q.id % 20 = 0),
c AS (SELECT query_id, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL)
SELECT query_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS o FROM c) WHERE o = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = emb(spark, d)
    train = t.df.where("vec_id % 20 <> 0")
    ix = index.build(MetricTable(train, t.id_col, t.value_col, t.metric), "vp", 2, 3)
    return classify.classify(ix, train, "vec_id", "label", asked(t), 5)


@query("knn_accuracy")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(classify.accuracy(emb(spark, d), "label", 3, runs=2),)], "accuracy double")


_WEIGH = f"r AS (SELECT q.id, {L2} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, x.id) AS k FROM x q JOIN x ON x.id <> q.id), w AS (SELECT id, {{}} AS weight FROM r WHERE {{}} GROUP BY id) SELECT id, round(weight, 6) AS weight FROM w ORDER BY weight DESC, id LIMIT 10"


def _outliers(name: str, algorithm: str, agg: str, cond: str, m: int = 0) -> None:
    @query(name, f"WITH {POINTS}, " + _WEIGH.format(agg, cond))
    def run(spark: SparkSession, d: str) -> DataFrame:
        got = outlier.detect(index.build(points(spark, d), "vp", 2, 8), algorithm, 10, 5, m)
        return got.withColumn("weight", F.round("weight", 6))


_outliers("outlier_knn_sum", "orca", "sum(d)", "k <= 5")
_outliers("outlier_kth", "kth", "max(d)", "k <= 5")
_outliers("outlier_pfod", "pfod", "sum(d)", "k > 2 AND k <= 7", 2)


@query(
    "outlier_hod",
    f"""WITH RECURSIVE {POINTS}, n AS (SELECT q.id, list({{'d': {L2}, 'id': x.id}} ORDER BY {L2}, x.id)[1:9] AS near FROM x q JOIN x ON x.id <> q.id GROUP BY q.id),
g AS (SELECT 0 AS rank, []::INT[] AS gone, NULL::INT AS id, NULL::DOUBLE AS weight UNION ALL
  SELECT rank + 1, list_append(any_value(gone), arg_min(nid, (-w, nid))), arg_min(nid, (-w, nid)), max(w) FROM
    (SELECT g.rank, g.gone, n.id AS nid, list_sum(list_transform(list_filter(n.near, lambda t: NOT list_contains(g.gone, t.id))[1:5], lambda t: t.d)) AS w FROM g, n WHERE g.rank < 5 AND NOT list_contains(g.gone, n.id)) GROUP BY rank)
SELECT rank, id, round(weight, 6) AS weight FROM g WHERE rank > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return outlier.hidden_outliers(index.build(points(spark, d), "vp", 2, 8), 5, 5).withColumn("weight", F.round("weight", 6))


_SCORES = "s AS (SELECT is_normal = false AS positive, length(seq)::DOUBLE AS score FROM (SELECT DISTINCT seq_id, seq, is_normal FROM labelled_dna) WHERE is_normal IS NOT NULL AND seq IS NOT NULL)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/labelled_dna.parquet").select("seq_id", "seq", "is_normal").distinct()
    return rows.select((~F.col("is_normal")).alias("positive"), F.length("seq").cast("double").alias("score"))


@query("auc", f"WITH {_SCORES} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 9) AS auc FROM s p JOIN s n ON p.positive AND NOT n.positive")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.auc(_scores(spark, d), "score", "positive").select(F.round("auc", 9).alias("auc"))


@query("roc", f"WITH {_SCORES}, g AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM s GROUP BY score) SELECT score, round(sum(p) OVER w / (sum(p) OVER ())::DOUBLE, 9) AS tpr, round(sum(q) OVER w / (sum(q) OVER ())::DOUBLE, 9) AS fpr FROM g WINDOW w AS (ORDER BY score DESC)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.roc(_scores(spark, d), "score", "positive").select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


# -- statistics -------------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


@query("hist_1d", "SELECT floor(l_extendedprice / 1000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_lines(spark, d), "l_extendedprice", 0.0, 1000.0)


@query("hist_2d", "SELECT floor((l_quantity - 1) / 5)::BIGINT AS bin_x, floor(l_extendedprice / 10000)::BIGINT AS bin_y, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram_2d(_lines(spark, d), ("l_quantity", "l_extendedprice"), (1.0, 0.0), (5.0, 10000.0))


@query("pivot_hist", f"WITH {EMB}, {_PD} SELECT floor(pd0 / 0.05)::BIGINT AS pd0, floor(pd1 / 0.05)::BIGINT AS pd1, count(*) AS n FROM d GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.pivot_histogram(_embedded(emb(spark, d)), ["pd0", "pd1"], 0.05)


@query("pivot_hist_summary", f"WITH {EMB}, {_PD}, h AS (SELECT count(*) AS n FROM d GROUP BY floor(pd0 / 0.05), floor(pd1 / 0.05)) SELECT count(*) AS bins, sum(n)::BIGINT AS total, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM h")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = stats.histogram_summary(stats.pivot_histogram(_embedded(emb(spark, d)), ["pd0", "pd1"], 0.05))
    return got.select("bins", "total", "most", *[F.round(c, 6).alias(c) for c in ("mean", "std", "entropy")])


@query("quantiles", """WITH r AS (SELECT l_returnflag, l_quantity::DOUBLE AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_quantity IS NOT NULL),
ps AS (SELECT unnest([0.25, 0.5, 0.9])::DOUBLE AS p) SELECT l_returnflag, p, v AS value FROM r, ps WHERE r = floor(p * (n - 1) + 0.5)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantiles(_lines(spark, d).withColumn("l_quantity", F.col("l_quantity").cast("double")), ["l_returnflag"], "l_quantity", [0.25, 0.5, 0.9])


@query("covariance", "SELECT 'l_quantity' AS i, 'l_quantity' AS j, round(var_pop(l_quantity), 6) AS cov FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(covar_pop(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_discount', round(var_pop(l_discount), 6) FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return stats.covariance(_lines(spark, d), ["l_quantity", "l_discount"]).withColumn("cov", F.round("cov", 6))


@query("principal_axes")
def _(spark: SparkSession, d: str) -> DataFrame:
    values, axes = stats.principal_axes(_lines(spark, d), ["l_quantity", "l_discount", "l_tax"], 3)
    return spark.createDataFrame([(i, float(v), axes[:, i].tolist()) for i, v in enumerate(values)], "no int, variance double, axis array<double>")


@query("max_gap_threshold", "WITH g AS (SELECT c_acctbal AS a, lead(c_acctbal) OVER (ORDER BY c_acctbal) AS b FROM (SELECT DISTINCT c_acctbal FROM customer WHERE c_acctbal IS NOT NULL)) SELECT round((a + b) / 2, 6) AS threshold, round(b - a, 6) AS gap FROM g WHERE b IS NOT NULL ORDER BY b - a DESC, a LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = stats.max_gap(spark.read.parquet(f"{d}/customer.parquet"), "c_acctbal")
    return spark.createDataFrame([got] if got else [], "threshold double, gap double").select(F.round("threshold", 6).alias("threshold"), F.round("gap", 6).alias("gap"))


@query("otsu_threshold", """WITH v AS (SELECT p_retailprice::DOUBLE AS x, count(*) AS c FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1),
s AS (SELECT x, lead(x) OVER (ORDER BY x) AS y, sum(c) OVER (ORDER BY x) AS n1, sum(c * x) OVER (ORDER BY x) AS s1, sum(c) OVER () AS n, sum(c * x) OVER () AS s FROM v)
SELECT round((x + y) / 2, 6) AS threshold FROM s WHERE y IS NOT NULL ORDER BY round(n1 * (n - n1) * (s1 / n1 - (s - s1) / (n - n1)) ** 2, 3) DESC, x LIMIT 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = stats.otsu(spark.read.parquet(f"{d}/part.parquet"), "p_retailprice")
    return spark.createDataFrame([(got,)] if got is not None else [], "threshold double").select(F.round("threshold", 6).alias("threshold"))


@query("experiment_summary", """WITH r AS (SELECT DISTINCT run_id, dataset_id, rho, result_count, linear_result_count, index_distance_count, linear_distance_count FROM query_runs WHERE rho IS NOT NULL AND NOT isnan(rho))
SELECT dataset_id, rho, count(*) AS runs, round(avg(index_distance_count) FILTER (index_distance_count >= 0), 6) AS mean_distances, count(*) FILTER (result_count = linear_result_count) AS agreeing FROM r GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Batch experiment: runs, mean distance computations, and runs whose result agrees with the linear scan."""
    rows = spark.read.parquet(f"{d}/query_runs.parquet").where("rho is not null and not isnan(rho)").select("run_id", "dataset_id", "rho", "result_count", "linear_result_count", "index_distance_count", "linear_distance_count").distinct()
    mean = F.avg(F.when(F.col("index_distance_count") >= 0, F.col("index_distance_count")))
    return rows.groupBy("dataset_id", "rho").agg(F.count(F.lit(1)).alias("runs"), F.round(mean, 6).alias("mean_distances"), F.count_if(F.col("result_count") == F.col("linear_result_count")).alias("agreeing"))


# -- streams ----------------------------------------------------------------------------------------------------------


@query("stream_range_match", range_sql(POINTS, L2, 0.05))
def _(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d)
    stream = match.read_stream(spark, d, "query_points").where("query_id % 20 = 0")
    return _rounded(match.run_available(match.range_match_stream(index.build(t, "vp", 2, 8), stream, 0.05, "query_id", "qv")))


@query("stream_event_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return match.run_available(match.windowed_counts(match.read_stream(spark, d, "events"), "ts", ["event_type"]), "complete")
