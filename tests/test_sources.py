import pytest
from pyspark.sql import functions as F

from metricloom import cli
from metricloom.functions import metrics as M
from metricloom.operators import index, pivots
from metricloom.operators.table import Catalog, MetricTable
from metricloom.sources import sinks, text


def put(tmp_path, content, name="f.txt"):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_vectors(spark, tmp_path):
    p = put(tmp_path, "2 4\n1 2\n3.5  4\nbad x\n5,6")
    assert [(r["id"], r["v"]) for r in text.load(spark, "vector", p).orderBy("id").collect()] == [(0, [1, 2]), (1, [3.5, 4]), (3, [5, 6])]
    assert [r["v"] for r in text.load(spark, "vector", p, limit=2, dims=1).orderBy("id").collect()] == [[1], [3.5]]
    assert text.load(spark, "vector", put(tmp_path, "", "e")).count() == 0
    d = put(tmp_path, "9 1 2\n1,2\n3,4\n5 6\n", "d")
    assert [(r["id"], r["v"]) for r in text.load(spark, "dimacs", d, skip=1).orderBy("id").collect()] == [(0, [3, 4]), (1, [5, 6])]
    with pytest.raises(ValueError):
        text.load(spark, "nothing", p)


def test_strings(spark, tmp_path):
    p = put(tmp_path, " one \n\ntwo\nthree\n")
    assert [(r["id"], r["s"]) for r in text.load(spark, "string", p).orderBy("id").collect()] == [(0, "one"), (2, "two"), (3, "three")]
    assert text.load(spark, "string", p, limit=2).count() == 2


def test_fasta(spark, tmp_path):
    p = put(tmp_path, ">a one\nACG\nT\n>b\n\n>c\nGG TT\n")
    got = [(r["seq_id"], r["ident"], r["seq"]) for r in text.read_fasta(spark, p).orderBy("seq_id").collect()]
    assert got == [(0, "a one", "ACGT"), (1, "b", ""), (2, "c", "GGTT")]
    assert [r["seq"] for r in text.read_fasta(spark, p, max_symbols=6).orderBy("seq_id").collect()][-1] == "GG"
    frags = text.load(spark, "rna", p, length=2, include_last=True)
    assert sorted(r["frag"] for r in frags.collect()) == sorted(["AC", "CG", "GT", "GG", "GT", "TT"])


def test_spectra(spark, tmp_path):
    p = put(tmp_path, "2\n7 300.5 100.1\n8 50\n")
    assert [(r["id"], r["peaks"]) for r in text.load(spark, "ms", p).orderBy("id").collect()] == [(7, [100.1, 300.5]), (8, [50.0])]
    got = text.load(spark, "msms", put(tmp_path, "1\n7 500 3 1 2\n", "m")).first()
    assert got["spectrum"]["precursor"] == 500 and got["spectrum"]["peaks"] == [1, 2, 3]


def test_images(spark, tmp_path):
    row = " ".join(str(i) for i in range(66))
    p = put(tmp_path, f"a.jpg {row}\nshort 1 2\nb.jpg {row}\n")
    got = text.load(spark, "image", p).collect()
    assert [r["name"] for r in got] == ["a.jpg", "b.jpg"] and len(got[0]["f"]) == 66
    assert text.read_image_maxima(spark, put(tmp_path, "1 60\n1\n", "max")) == [1, 60, 1]


def test_kddcup(spark, tmp_path):
    def line(proto, label):
        cells = ["0.5"] * 41
        cells[1], cells[2], cells[3] = proto, "http", "SF"
        for i in (6, 11, 20, 21):
            cells[i] = "1"
        return ",".join([*cells, label])

    p = put(tmp_path, "\n".join(["41 4", line("tcp", "normal."), line("udp", "smurf."), line("tcp", "normal."), "broken,1"]))
    got = text.load(spark, "kddcup", p).orderBy("id").collect()
    assert [r["is_normal"] for r in got] == [True, False, True]
    assert len(got[0]["num"]) == 34 and got[0]["cat"] == [0, 0, 0, 1, 1, 1, 1] and got[1]["cat"][0] == 1
    assert text.load(spark, "kddcup", p, inliers=1, outliers=5).count() == 2


def test_labelled_and_stock(spark, tmp_path):
    p = put(tmp_path, "2 3\n1 2 1\n3 4 0\n5 6 1\n")
    got = text.load(spark, "labelled_vector", p).orderBy("id").collect()
    assert [(r["v"], r["is_normal"]) for r in got] == [([1, 2], True), ([3, 4], False), ([5, 6], True)]
    assert text.load(spark, "labelled_vector", p, inliers=1).count() == 2
    got = text.load(spark, "labelled_dna", put(tmp_path, "1 2\nACGT 1\nAC 0\n", "l")).orderBy("id").collect()
    assert [(r["seq"], r["is_normal"]) for r in got] == [("ACGT", True), ("AC", False)]
    got = text.load(spark, "stock", put(tmp_path, "3 1\n20200101 20200102\n4 ABC 1.5 2.5\n", "s")).first()
    assert (got["id"], got["name"], got["dates"], got["prices"]) == (4, "ABC", [20200101, 20200102], [1.5, 2.5])
    sonar = ",".join(["0.1"] * 60)
    assert [r["label"] for r in text.load(spark, "sonar", put(tmp_path, f"{sonar},R\n{sonar},M\n{sonar}\n", "o")).orderBy("id").collect()] == [0, 1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "id int, v array<double>")
    t = MetricTable(df, "id", "v", M.L2)
    ix = index.build(t, "vp", 2, 2)
    sinks.write_index(ix.members, ix.cell_rows(), str(tmp_path / "ix"))
    back = spark.read.parquet(str(tmp_path / "ix/members"))
    assert back.count() == 30 and spark.read.parquet(str(tmp_path / "ix/cells")).count() == len(ix.cells)
    one = back.where(F.col("cell") == ix.cells[0])
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().executedPlan().toString()
    sinks.write_bucketed(ix.members, "bucketed_members", 4)
    assert spark.table("bucketed_members").count() == 30
    sinks.write_tree(ix.members, ix.cell_rows(), str(tmp_path / "tree"))
    assert spark.read.json(str(tmp_path / "tree/members")).count() == 30
    e = pivots.embed(t, ix.pivots, scalar=False)
    for kind in ("text", "double", "float", "parquet"):
        sinks.write_coordinates(e, str(tmp_path / kind), kind)
    assert len(spark.read.parquet(str(tmp_path / "float")).first()["bytes"]) == 8
    with pytest.raises(ValueError):
        sinks.write_coordinates(e, str(tmp_path / "x"), "xml")
    sinks.write_clusters(df.withColumn("cluster", F.lit(0)), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c/header")).first()[0] == "2\t30\t1"
    sinks.write_experiment(df.select("id"), str(tmp_path / "csv"))
    sinks.write_statistics(df.select("id"), str(tmp_path / "json"))


def test_catalog(spark):
    c = Catalog(spark)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    c.put("words", MetricTable(df, "id", "s", M.EDIT))
    got = c.get("words")
    assert got.metric is M.EDIT and got.rows().count() == 2 and "words" in c.names()
    c.drop("words")
    with pytest.raises(KeyError):
        c.get("words")


def test_user_metric(spark):
    zero = M.register(M.Metric("length_gap", lambda a, b: F.abs(F.length(a) - F.length(b)).cast("double"), lambda a, b: float(abs(len(a) - len(b)))))
    t = MetricTable(spark.createDataFrame([(1, "a"), (2, "bb"), (3, "cccc")], "id int, s string"), "id", "s", zero)
    assert {r["id"] for r in index.linear_scan(t, pivots.Pivot(0, "xx"), 1).collect()} == {1, 2}


@pytest.mark.parametrize("argv", [
    ["build", "--index", "gh", "--pivots", "4"], ["query", "--radius", "0.5", "--number", "3"], ["map", "--pivots", "3"], ["cluster", "--k", "2"],
    ["cluster", "--method", "dbscan", "--eps", "0.5", "--min-samples", "2"], ["cluster", "--method", "birch"], ["outliers", "--n", "3", "--k", "2"],
], ids=lambda a: "-".join(a[:3]))
def test_command_line(spark, tmp_path, argv):
    f = put(tmp_path, "2 40\n" + "\n".join(f"{i % 7} {i * 0.37 % 5}" for i in range(40)))
    got = cli.run(spark, [argv[0], "--file", f, "--out", str(tmp_path / "out"), *argv[1:]])
    assert got.count() > 0


def test_command_line_without_triangle(spark, tmp_path):
    f = put(tmp_path, "3\n1 10 20\n2 10.1 30\n3 99\n")
    got = cli.run(spark, ["query", "--type", "ms", "--file", f, "--radius", "1.2", "--out", str(tmp_path / "out")])
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


@pytest.mark.parametrize("few", [True, False])
def test_kddcup_lines_with_blanks_and_without(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(text, "MOST_CODES", 0)
    flags, kinds = (6, 11, 20, 21), ["tcp", "udp", "icmp"]

    def line(i, by, end):
        return by.join(kinds[i % 3] if c in (1, 2, 3) else "1" if c in flags else str(i + 0.5) for c in range(41)) + by + end

    lines = ["41 9", line(0, ",", "normal."), line(1, " , ", "smurf."), line(2, ",", "normal"), line(0, ",", "smurf. "), line(1, ",", "x.y"), line(1, ",", "normal.") + ",7", line(2, ",", "normal.").replace("2.5", "no", 1), "1,2"]
    (tmp_path / "k").write_text("\n".join(lines))
    got = {r["id"]: (r["num"], r["cat"], r["is_normal"]) for r in text.load(spark, "kddcup", str(tmp_path / "k")).collect()}
    code = [1, 2, 0]
    assert got == {n: ([i + 0.5] * 34, [code[i]] * 3 + [1] * 4, ok) for n, i, ok in ((0, 0, True), (1, 1, False), (2, 2, True), (3, 0, False), (4, 1, False))}


def test_kddcup_joins_no_lines_by_a_shuffle(spark, tmp_path):
    (tmp_path / "k").write_text("41 1\n" + ",".join(["1"] * 41) + ",normal.\n")
    plan = text.load(spark, "kddcup", str(tmp_path / "k"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
