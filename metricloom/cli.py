"""Command line: build an index, query it, cluster, map to pivot space, detect outliers.

    python -m metricloom.cli build  --type vector --file f.txt --index vp --pivots 2 --parts 3 --out DIR
    python -m metricloom.cli query  --type vector --file f.txt --queries q.txt --radius 0.2 [--number N] [--saved DIR] --index vp --out DIR
    python -m metricloom.cli cluster --type vector --file f.txt --method kmeans --k 3 --out DIR
    python -m metricloom.cli map    --type vector --file f.txt --pivots 3 --out DIR
    python -m metricloom.cli outliers --type vector --file f.txt --algorithm orca --n 10 --k 5 --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from metricloom.functions import metrics as M
from metricloom.functions import sequences as S
from metricloom.operators import cluster, index, outlier, pivots
from metricloom.operators.table import MetricTable
from metricloom.sources import sinks, text

#: Value column and default metric of each object type.
TYPES: dict[str, tuple[str, M.Metric]] = {
    "vector": ("v", M.L2), "dimacs": ("v", M.L2), "string": ("s", M.EDIT), "dna": ("frag", M.hamming_metric(S.DNA_MATRIX)), "rna": ("frag", M.hamming_metric(S.RNA_MATRIX)),
    "peptide": ("frag", M.hamming_metric(S.PEPTIDE_MATRIX)), "ms": ("peaks", M.MS), "msms": ("spectrum", M.MSMS), "image": ("f", M.IMAGE), "labelled_vector": ("v", M.L2), "sonar": ("features", M.L2),
}


def open_table(spark: SparkSession, kind: str, path: str, metric: str | None = None, **options: object) -> MetricTable:
    value, default = TYPES[kind]
    return MetricTable(text.load(spark, kind, path, **options), "id", value, M.METRICS[metric] if metric else default)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="metricloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "query", "cluster", "map", "outliers"):
        c = sub.add_parser(name)
        c.add_argument("--type", choices=sorted(TYPES), default="vector")
        c.add_argument("--file", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--limit", type=int)
        c.add_argument("--dims", type=int)
        c.add_argument("--fragment", type=int, default=6)
        c.add_argument("--metric", choices=sorted(M.METRICS))
        c.add_argument("--index", choices=sorted(index.FAMILIES), default="vp")
        c.add_argument("--selection", choices=sorted(pivots.METHODS), default="fft")
        c.add_argument("--pivots", type=int, default=2)
        c.add_argument("--parts", type=int, default=3)
        c.add_argument("--depth", type=int, default=1)
        c.add_argument("--queries")
        c.add_argument("--saved", help="folder that `build` wrote; query searches it instead of building")
        c.add_argument("--number", type=int)
        c.add_argument("--radius", type=float, default=0.0)
        c.add_argument("--method", choices=("kmeans", "dbscan", "birch"), default="kmeans")
        c.add_argument("--eps", type=float, default=0.5)
        c.add_argument("--min-samples", type=int, default=5)
        c.add_argument("--k", type=int, default=3)
        c.add_argument("--n", type=int, default=10)
        c.add_argument("--algorithm", choices=sorted([*outlier.ALGORITHMS, "pfod", "hod", "ihod"]), default="orca")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = parser().parse_args(argv)
    options: dict = {}
    if a.type in ("vector", "dimacs"):
        options = {"limit": a.limit, "dims": a.dims}
    elif a.type in ("dna", "rna", "peptide"):
        options = {"length": a.fragment, "max_symbols": a.limit}
    elif a.type in ("string", "ms", "msms", "image"):
        options = {"limit": a.limit}
    table = open_table(spark, a.type, a.file, a.metric, **options)
    if a.command == "build":
        ix = index.build(table, a.index, a.pivots, a.parts, a.selection, a.depth)
        index.save_index(ix, a.out)
        sinks.write_pivots(pivots.pivot_rows(spark, ix.pivots), f"{a.out}/pivots")
        return ix.cell_rows()
    if a.command == "query":
        q = open_table(spark, a.type, a.queries or a.file, a.metric, **options).rows().withColumnRenamed("id", "query_id")
        q = q.orderBy("query_id").limit(a.number) if a.number else q
        if not table.metric.triangle:
            found = index.scan_join(table, q, a.radius)
            found.write.mode("overwrite").parquet(f"{a.out}/results")
            return found
        ix = index.open_index(spark, a.saved, table.metric) if a.saved else index.build(table, a.index, a.pivots, a.parts, a.selection, a.depth)
        found = ix.range_join(q, a.radius)
        found.write.mode("overwrite").parquet(f"{a.out}/results")
        sinks.write_statistics(ix.stats(q, a.radius), f"{a.out}/statistics")
        return found
    p = pivots.select_pivots(table, a.pivots, a.selection)
    if a.command == "map":
        got = pivots.embed(table, p, scalar=False)
        sinks.write_coordinates(got, a.out)
        return got
    if a.command == "cluster":
        more = {"eps": a.eps, "min_samples": a.min_samples} if a.method == "dbscan" else {}
        got = cluster.cluster_pipeline(table, p, a.method, a.k, **more)
        sinks.write_clusters(got, a.out)
        return got
    got = outlier.detect(index.build(table, a.index, a.pivots, a.parts, a.selection), a.algorithm, a.n, a.k)
    got.write.mode("overwrite").json(a.out)
    return got


def main(argv: list[str] | None = None) -> int:
    import sys

    run(SparkSession.builder.appName("metricloom").getOrCreate(), argv if argv is not None else sys.argv[1:])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
