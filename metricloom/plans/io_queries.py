"""Registered queries of sources and sinks: each writes whole test tables in a text format and reads them back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions import metrics as M
from metricloom.operators import cluster, index, pivots
from metricloom.operators.durable import shared_folder
from metricloom.operators.table import MetricTable
from metricloom.plans.queries import EMB, PARTS, POINTS, emb, parts, points, query
from metricloom.sources import sinks, text


def place(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{shared_folder(spark)}/{uuid4().hex}"


def written(lines: DataFrame, header: str | None = None) -> str:
    """Folder of a text file with these lines (column `line`); each part has the header."""
    path = place(lines.sparkSession)
    if header is None:
        lines.select("line").write.text(path)
    else:  # lines as they are: no quotes, and a separator that none of them has
        lines.select(F.col("line").alias(header)).write.option("header", True).option("quote", "").option("sep", "\x01").option("emptyValue", "").csv(path)
    return path


def _spaced(v: str | Column, by: str = " ") -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), by)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- sources ----------------------------------------------------------------------------------------------------------


@query("source_vector", "SELECT qv AS v, k AS kind FROM query_points, (VALUES ('vector'), ('matrix'), ('mapped')) t(k) WHERE qv IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = written(points(spark, d).rows().select(_spaced("v").alias("line")), "2 3000")
    out = [text.load(spark, k, path).select("v", F.lit(k).alias("kind")) for k in ("vector", "matrix", "mapped")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("source_vector_dims", "SELECT embedding[1:5]::DOUBLE[] AS v FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = written(emb(spark, d).rows().select(_spaced("v").alias("line")), "64 500")
    return text.read_vectors(spark, path, dims=5).select("v")


@query("source_dimacs", "SELECT embedding::DOUBLE[] AS v FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return text.load(spark, "dimacs", written(emb(spark, d).rows().select(_spaced("v", ",").alias("line")), "500 0 64")).select("v")


@query("source_string", "SELECT trim(p_name) AS s FROM part WHERE trim(p_name) <> ''")
def _(spark: SparkSession, d: str) -> DataFrame:
    return text.load(spark, "string", written(_table(spark, d, "part").where("p_name is not null").select(F.col("p_name").alias("line")))).select("s")


def _fasta(spark: SparkSession, d: str) -> str:
    rows = _table(spark, d, "labelled_dna").where("seq is not null").select("seq_id", "seq").distinct()
    return written(rows.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), F.substring("seq", 1, 70), F.lit("\n"), F.substring("seq", F.lit(71), F.length("seq"))).alias("line")))


@query("source_fasta", r"SELECT DISTINCT seq_id::VARCHAR AS ident, regexp_replace(seq, '\s', '', 'g') AS seq FROM labelled_dna WHERE seq IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return text.load(spark, "fasta", _fasta(spark, d)).select("ident", "seq")


@query(
    "source_fragments",
    r"""WITH s AS (SELECT DISTINCT seq_id, regexp_replace(seq, '\s', '', 'g') AS seq FROM labelled_dna WHERE seq IS NOT NULL), k(kind, n) AS (VALUES ('dna', 9), ('rna', 8), ('peptide', 7)),
f AS (SELECT kind, substr(seq, o + 1, n) AS frag FROM (SELECT kind, n, seq, unnest(range(length(seq) - n)) AS o FROM s, k))
SELECT kind, frag, count(*) AS n FROM f GROUP BY ALL""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    path, out = _fasta(spark, d), None
    for kind, n in (("dna", 9), ("rna", 8), ("peptide", 7)):
        part = text.load(spark, kind, path, length=n).groupBy("frag").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "frag", "n")
        out = part if out is None else out.unionByName(part)
    return out


_MASSES = "m AS (SELECT DISTINCT row_id, list_transform(list_filter(elements, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)), lambda x: abs(x)) AS p FROM matrix_rows WHERE elements IS NOT NULL)"


def _masses(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "matrix_rows").where("elements is not null").select("row_id", "elements").dropDuplicates(["row_id"])
    return rows.select("row_id", F.transform(F.filter("elements", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.abs).alias("p"))


@query("source_ms", f"WITH {_MASSES} SELECT row_id AS id, list_sort(p) AS peaks FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    return text.load(spark, "ms", written(_masses(spark, d).select(F.concat_ws(" ", "row_id", _spaced("p")).alias("line")), "count"))


@query("source_msms", f"WITH {_MASSES} SELECT row_id AS id, 321.5 AS precursor, list_sort(p) AS peaks FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    got = text.load(spark, "msms", written(_masses(spark, d).select(F.concat_ws(" ", "row_id", F.lit("321.5"), _spaced("p")).alias("line")), "count"))
    return got.select("id", "spectrum.precursor", "spectrum.peaks")


@query("source_image", "SELECT 'i' || vec_id || '.jpg' AS name, list_concat(embedding::DOUBLE[], [0.5::DOUBLE, label::DOUBLE]) AS f FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = emb(spark, d).df.select(F.concat(F.lit("i"), "vec_id", F.lit(".jpg ")).alias("n"), F.concat("v", F.array(F.lit(0.5), F.col("label").cast("double"))).alias("f"))
    return text.load(spark, "image", written(rows.select(F.concat("n", _spaced("f")).alias("line")))).select("name", "f")


@query("source_image_maxima", "SELECT unnest([1, 2, 3])::INT AS no, unnest([max(x.embedding[1]), max(x.embedding[2]), max(x.embedding[3])])::DOUBLE AS longest FROM embeddings x")
def _(spark: SparkSession, d: str) -> DataFrame:
    most = emb(spark, d).df.agg(F.array(*[F.max(F.col("v")[i]) for i in range(3)]).alias("m")).select(F.explode("m").alias("x")).select(F.col("x").cast("string").alias("line"))
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(text.read_image_maxima(spark, written(most.coalesce(1))))], "no int, longest double")


_FLAGS = (6, 11, 20, 21)  # Fixed values: columns of coded flags among the 41 features.


@query(
    "source_kddcup",
    """WITH l AS (SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY (l_partkey % 50)::VARCHAR) - 1 AS a, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS b, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS c, l_quantity::DOUBLE AS q FROM lineitem)
SELECT list_concat([l_orderkey::DOUBLE, l_linenumber::DOUBLE], list_transform(range(32), lambda i: q)) AS num, [a, b, c, 1, 1, 1, 1]::INT[] AS cat, q < 40 AS is_normal FROM l""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).cast("string").alias("mode"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("q"))
    cells = []
    for i in range(41):
        named = {0: "l_orderkey", 1: "mode", 2: "l_returnflag", 3: "l_linestatus", 4: "l_linenumber"}
        cells.append(F.col(named[i]).cast("string") if i in named else F.lit("1") if i in _FLAGS else F.col("q").cast("string"))
    line = F.concat_ws(",", *cells, F.when(F.col("q") < 40, "normal.").otherwise("smurf."))
    return text.load(spark, "kddcup", written(rows.select(line.alias("line")), "41 60000")).select("num", "cat", "is_normal")


@query("source_stock", "SELECT c_custkey::INT AS id, 'n' || c_custkey AS name, [20240101, 20240102]::INT[] AS dates, [c_acctbal::DOUBLE, c_nationkey::DOUBLE] AS prices FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    line = F.concat_ws(" ", "c_custkey", F.concat(F.lit("n"), "c_custkey"), "a", "b")
    path = place(spark)
    # one file: the second of its two lines of header has the dates
    rows.select(line.alias("line"), F.col("c_custkey").alias("o")).unionByName(spark.createDataFrame([("2 9", -2), ("20240101 20240102", -1)], "line string, o bigint")).coalesce(1).sortWithinPartitions("o").select("line").write.text(path)
    return text.load(spark, "stock", path)


@query("source_labelled_vector", "SELECT embedding::DOUBLE[] AS v, label = 1 AS is_normal FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", _spaced("v"), F.when(F.col("label") == 1, "1").otherwise("0"))
    return text.load(spark, "labelled_vector", written(emb(spark, d).df.select(line.alias("line")), "64 500")).select("v", "is_normal")


@query("source_labelled_dna", r"SELECT seq, is_normal FROM labelled_dna WHERE regexp_matches(seq, '^\S+$') AND is_normal IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "labelled_dna").where(F.col("seq").rlike(r"^\S+$") & F.col("is_normal").isNotNull())
    return text.load(spark, "labelled_dna", written(rows.select(F.concat_ws(" ", "seq", F.col("is_normal").cast("int")).alias("line")), "0 0")).select("seq", "is_normal")


@query("source_sonar", "SELECT embedding[1:60]::DOUBLE[] AS features, (label % 2)::INT AS label FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", _spaced(F.slice("v", 1, 60), ","), F.when(F.col("label") % 2 == 0, "R").otherwise("M"))
    return text.load(spark, "sonar", written(emb(spark, d).df.select(line.alias("line")))).select("features", "label")


@query("source_parquet", "SELECT n_nationkey, n_name FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return text.load(spark, "parquet", f"{d}/nation.parquet").select("n_nationkey", "n_name")


# -- indexes that are written and opened again ------------------------------------------------------------------------

_NEAR = "SELECT q.id AS query_id, x.id, round(list_distance(q.v, x.v), 6) AS distance FROM x q JOIN x ON list_distance(q.v, x.v) <= {r} WHERE q.id % 20 = 0"


def _asked(t: MetricTable) -> DataFrame:
    return t.rows().where("id % 20 = 0").withColumnRenamed("id", "query_id")


@query("saved_index_range", f"WITH {PARTS} {_NEAR.format(r=1.5)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    t, path = parts(spark, d), place(spark)
    index.save_index(index.build(t, "vp", 2, 8), path)
    return index.open_index(spark, path, t.metric).range_join(_asked(t), 1.5).withColumn("distance", F.round("distance", 6))


@query("leaf_size_range", f"WITH {PARTS} {_NEAR.format(r=1.5)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Cells cut until they have 64 rows at most, or equal ones."""
    t = parts(spark, d)
    return index.build(t, "vp", 2, 2, depth=2, leaf_size=64).range_join(_asked(t), 1.5, digits=6)


@query("accept_all_range", f"WITH {POINTS} SELECT q.id AS query_id, x.id FROM x q JOIN x ON list_distance(q.v, x.v) <= 0.6 WHERE q.id % 20 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d)
    return index.build(t, "vp", 2, 8).range_ids(_asked(t), 0.6)


@query(
    "accepted_unseen",
    f"""WITH {PARTS}, d AS (SELECT x.id, list_distance(x.v, a.v) AS pd0, list_distance(x.v, b.v) AS pd1 FROM x JOIN x a ON a.id = 1 JOIN x b ON b.id = 2)
SELECT q.id AS query_id, count(*) AS n FROM d q JOIN d ON least(q.pd0 + d.pd0, q.pd1 + d.pd1) * (1 + 1e-9) <= 9 WHERE q.id % 20 = 0 GROUP BY q.id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each query that its pivot distances accept without an exact distance."""
    t = parts(spark, d)
    ix = index.build_index(t, pivots.fixed(t, [1, 2]), [index.vp(range(2), 4)])
    return ix.unseen(_asked(t), 9.0)


@query(
    "search_actions",
    f"""WITH {PARTS}, d AS (SELECT x.id, list_distance(x.v, a.v) AS pd0, list_distance(x.v, b.v) AS pd1 FROM x JOIN x a ON a.id = 1 JOIN x b ON b.id = 2),
c AS (SELECT *, CASE WHEN pd0 - pd1 >= 0 THEN 1 ELSE 0 END AS cell FROM d), b AS (SELECT cell, min(pd0 - pd1) AS l, max(pd0 - pd1) AS h, min(pd0) AS l0, max(pd0) AS h0, min(pd1) AS l1, max(pd1) AS h1 FROM c GROUP BY cell),
m AS (SELECT q.id, l <= q.pd0 - q.pd1 + 18 AND h >= q.pd0 - q.pd1 - 18 AND l0 <= q.pd0 + 9 AND h0 >= q.pd0 - 9 AND l1 <= q.pd1 + 9 AND h1 >= q.pd1 - 9 AS meets, least(q.pd0 + h0, q.pd1 + h1) <= 9 AS whole FROM c q, b WHERE q.id % 20 = 0)
SELECT id AS query_id, count(*) FILTER (NOT meets)::INT AS pruned, count(*) FILTER (meets AND whole)::INT AS accepted, count(*) FILTER (meets AND NOT whole)::INT AS opened FROM m GROUP BY id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d)
    return index.build_index(t, pivots.fixed(t, [1, 2]), [index.gh(0, 1)]).actions(_asked(t), 9.0)


# -- sinks ------------------------------------------------------------------------------------------------------------


@query("sink_index", "SELECT p_partkey AS id FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    path, ix = place(spark), index.build(parts(spark, d), "gh", 2)
    sinks.write_tree(ix.members, ix.cell_rows(), path)
    return spark.read.json(f"{path}/members").select("id")


@query("sink_clusters", f"WITH {PARTS} SELECT v, (CASE WHEN v[1] < 25 THEN 0 ELSE 1 END)::INT AS cluster FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    sinks.write_clusters(parts(spark, d).rows().withColumn("cluster", F.when(F.col("v")[0] < 25, 0).otherwise(1)), path)
    n = text._numbers(F.col("value"))
    return spark.read.text(f"{path}/rows").select(F.slice(n, 1, 2).alias("v"), F.element_at(n, 3).cast("int").alias("cluster"))


_AXES = f"{EMB}, e AS (SELECT x.id, [round(list_distance(x.v, a.v), 6), round(list_distance(x.v, b.v), 6)] AS pd FROM x JOIN x a ON a.id = 1 JOIN x b ON b.id = 2)"


@query("sink_coordinates", f"WITH {_AXES} SELECT pd, kind FROM e, (VALUES ('text'), ('parquet'), ('double')) k(kind)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = emb(spark, d)
    rows = pivots.embed(t, pivots.fixed(t, [1, 2]), scalar=False).select("id", "pd")
    path = {kind: place(spark) for kind in ("text", "parquet", "double")}
    for kind, p in path.items():
        sinks.write_coordinates(rows, p, kind)
    from struct import unpack

    double = F.udf(lambda b: [*unpack("<2d", b)], "array<double>")  # a check of the written bytes
    got = {
        "text": spark.read.text(path["text"]).select(text._numbers(F.col("value")).alias("pd")), "parquet": spark.read.parquet(path["parquet"]).select("pd"),
        "double": spark.read.parquet(path["double"]).select(double("bytes").alias("pd")),
    }
    out = None
    for kind, df in got.items():
        part = df.select(F.transform("pd", lambda x: F.round(x, 6)).alias("pd"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("sink_pivots", "SELECT no::BIGINT AS no, id FROM (VALUES (0, '1'), (1, '2'), (2, '3')) t(no, id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    sinks.write_pivots(pivots.pivot_rows(spark, pivots.fixed(parts(spark, d), [1, 2, 3])), path)
    return spark.read.json(path).select("no", "id")


@query("sink_statistics", f"WITH {PARTS} SELECT id AS query_id FROM x WHERE id % 20 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    t, path = parts(spark, d), place(spark)
    sinks.write_statistics(index.build(t, "gh", 2).actions(_asked(t), 1.5), path)
    return spark.read.json(path).select("query_id")


@query("sink_experiment", "SELECT DISTINCT run_id, dataset_id FROM query_runs")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    sinks.write_experiment(_table(spark, d, "query_runs").select("run_id", "dataset_id").distinct(), path)
    return spark.read.option("header", True).schema("run_id bigint, dataset_id int").csv(path)


@query("sink_bucketed", f"WITH {PARTS} SELECT id FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = f"bucketed_{uuid4().hex}"
    members = index.build(parts(spark, d), "gh", 2).members
    spark.sql(f"CREATE DATABASE IF NOT EXISTS metricloom LOCATION '{place(spark)}'")
    sinks.write_bucketed(members.select("id", "cell"), f"metricloom.{name}", 4)
    return spark.table(f"metricloom.{name}").select("id")


# -- embedding, classification, clusters ------------------------------------------------------------------------------


@query(
    "knn_classify_pivot_space",
    f"""WITH {EMB}, d AS (SELECT x.id, x.label, [{", ".join(f"list_distance(x.v, p{i}.v)" for i in range(4))}] AS v FROM x {" ".join(f"JOIN x p{i} ON p{i}.id = {i + 1}" for i in range(4))}),
r AS (SELECT q.id AS query_id, x.label, row_number() OVER (PARTITION BY q.id ORDER BY list_max(list_transform(list_zip(q.v, x.v), lambda t: abs(t[1] - t[2]))), x.id) AS k FROM d q JOIN d x ON x.id % 20 <> 0 WHERE q.id % 20 = 0),
c AS (SELECT query_id, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL)
SELECT query_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS o FROM c) WHERE o = 1""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    from metricloom.operators import classify

    t = emb(spark, d)
    train = t.df.where("vec_id % 20 <> 0")
    return classify.classify_in_pivot_space(MetricTable(train, t.id_col, t.value_col, M.L2), train, "vec_id", "label", _asked(t), pivots.fixed(t, [1, 2, 3, 4]), 5)


@query("kmeans_labels", f"""WITH RECURSIVE {PARTS}, s AS (SELECT v, row_number() OVER (ORDER BY o) AS c FROM (SELECT v, min(id) AS o FROM x GROUP BY v ORDER BY o LIMIT 4)),
it(i, c, a, b) AS (SELECT 0, c, v[1], v[2] FROM s UNION ALL
  SELECT i, c, avg(p), avg(q) FROM (SELECT it.i + 1 AS i, arg_min(it.c, (sqrt((x.v[1] - it.a) ** 2 + (x.v[2] - it.b) ** 2), it.c)) AS c, x.v[1] AS p, x.v[2] AS q FROM x, it WHERE it.i < 12 GROUP BY it.i, x.id, x.v) GROUP BY i, c)
SELECT x.id, (arg_min(it.c, (sqrt((x.v[1] - it.a) ** 2 + (x.v[2] - it.b) ** 2), it.c)) - 1)::INT AS cluster FROM x, it WHERE it.i = 12 GROUP BY x.id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Twelve rounds of k-means."""
    return cluster.kmeans(parts(spark, d).rows(), 4, rounds=12, tol=-1.0)[0].select("id", "cluster")


_NATIONS = "x AS (SELECT n_nationkey AS id, n_name AS v FROM nation), d AS (SELECT a.id AS a, b.id AS b, levenshtein(a.v, b.v)::DOUBLE AS d FROM x a, x b)"


def _nations(spark: SparkSession, d: str) -> MetricTable:
    return MetricTable(_table(spark, d, "nation"), "n_nationkey", "n_name", M.EDIT)


@query(
    "pivots_density_peak_farthest",
    f"""WITH {_NATIONS}, f AS (SELECT a AS id FROM d WHERE d <= 0.4 * (SELECT max(d) FROM d) GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
g AS (SELECT b AS id FROM d JOIN f ON a = id ORDER BY d DESC, b LIMIT 1),
h AS (SELECT b AS id FROM d WHERE a IN (SELECT id FROM f UNION ALL SELECT id FROM g) GROUP BY b ORDER BY min(d) DESC, b LIMIT 1)
SELECT 0 AS no, id::VARCHAR AS id FROM f UNION ALL SELECT 1, id::VARCHAR FROM g UNION ALL SELECT 2, id::VARCHAR FROM h""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pivots.pivot_rows(spark, pivots.select_pivots(_nations(spark, d), 3, "density_peak_farthest")).drop("value")


@query(
    "pivots_right_up",
    f"""WITH {_NATIONS}, r AS (SELECT p.a, p.b, p.d AS apart, x.d AS x, y.d AS y, ln((x.d + 1e-12) / (y.d + 1e-12)) AS r FROM d p JOIN d x ON x.a = p.a JOIN d y ON y.a = p.b AND y.b = x.b WHERE p.d > 0),
s AS (SELECT a, b, list(r ORDER BY r) AS s, count(*)::INT AS n, quantile_cont(r, 0.9) - quantile_cont(r, 0.1) AS spread, avg(least(x, y)) AS near, (avg(x) + avg(y)) / 2 + 1e-12 AS mean FROM r GROUP BY ALL),
c AS (SELECT *, s[n // 3 + 1] AS low, s[2 * n // 3 + 1] AS high,
  s[least(n // 3 + 2, n - 1) + 1] - s[greatest(n // 3 - 2, 0) + 1] + s[least(2 * n // 3 + 2, n - 1) + 1] - s[greatest(2 * n // 3 - 2, 0) + 1] AS gaps FROM s),
m AS (SELECT a, b, apart, any_value(gaps) / (any_value(spread) + 1e-12) AS gaps, any_value(spread) AS spread, any_value(near) / any_value(mean) AS near, any_value(mean) AS mean,
  1 - abs(avg((r < low)::INT) - 1 / 3) - abs(avg((r > high)::INT) - 1 / 3) - abs(avg((r BETWEEN low AND high)::INT) - 1 / 3) AS even,
  (coalesce(max(x) FILTER (r < low), 0) + coalesce(max(y) FILTER (r > high), 0) + coalesce(max(least(x, y)) FILTER (r BETWEEN low AND high), 0)) / 3 / any_value(mean) AS cover
  FROM r JOIN c USING (a, b) WHERE high > low + 1e-12 GROUP BY a, b, apart),
best AS (SELECT max(1.8 * gaps + 2 * even + 0.7 * near + 0.2 * least(spread, 4) - 1.6 * cover - 0.5 * abs(apart / mean - 1)) AS best FROM m WHERE a < b OR a > b)
SELECT round(best, 6) AS best FROM best""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """The score of the best pair."""
    t = _nations(spark, d)
    a, b = pivots.select_pivots(t, 2, "at_right_up")
    every = pivots.sample(t, 25)
    x, y = (pivots.distance_matrix(t.metric, [p], every)[0] for p in (a, b))
    return spark.createDataFrame([(round(pivots.pair_score(x, y, t.metric.value(a.value, b.value)), 6),)], "best double")


# -- a search over a table that grows ---------------------------------------------------------------------------------


@query(
    "lineitem_range",
    """WITH x AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem)
SELECT a.id AS query_id, x.id, round(abs(a.p - x.p) / 1000, 6) AS distance FROM x a JOIN x ON x.q = a.q AND abs(a.p - x.p) <= 20.003 WHERE a.id % 20 = 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Quantity and price, so near that the quantity is the same."""
    rows = _table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double") / 1000).alias("v"))
    t = MetricTable(rows, "id", "v", M.fixed_metric("l2", 2))
    return index.build(t, "vp", 2, 32).range_join(_asked(t), 0.020003).withColumn("distance", F.round("distance", 6))
