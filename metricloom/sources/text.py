"""Readers of the text formats and of Parquet: each gives a DataFrame with a fixed schema.

Files are read by Spark's own text reader and stay distributed. Where a format's order matters (headers, row limits), lines are
numbered by `numbered_lines`. A path may be a folder, each file of it with its own header; its files follow one another by
name. Lines that don't parse are left out; an empty file gives an empty DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.operators.durable import stored

LOADERS: dict[str, Callable[..., DataFrame]] = {}
#: Category codes that are broadcast at most; more are joined by shuffles.
MOST_CODES = 1 << 16


def loader(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Adds a reader to the registry of object types."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LOADERS[name] = f
        return f

    return add


def load(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    """Reads by the name of an object type."""
    if kind not in LOADERS:
        raise ValueError(f"unknown type {kind}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, path, **options)


def _numbered(spark: SparkSession, path: str, header: int, **options: str) -> DataFrame:
    """(no, line, place, file, block): lines numbered from 0 in the order of the files, headers not counted (theirs is null).
    place: number in the own file. The lines of each block of a file are counted first; there is a row for each block."""
    raw = spark.read.options(**options).text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m")
    )
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("_first"))
    order = Window.orderBy("file", "block")
    blocks = blocks.withColumn("_before", F.sum("n").over(order) - F.col("n")).withColumn("_files", F.dense_rank().over(Window.orderBy("file")))
    blocks = blocks.withColumn("_start", F.min("_before").over(Window.partitionBy("file"))).drop("n")
    out = raw.join(F.broadcast(blocks), ["file", "block"]).withColumn("_at", F.col("_before") + F.col("_m") - F.col("_first"))  # blocks: one for each split that is read
    place = F.col("_at") - F.col("_start")
    return out.select(F.when(place >= header, F.col("_at") - header * F.col("_files")).alias("no"), "line", place.alias("place"), "file", "block")


def numbered_lines(spark: SparkSession, path: str, header: int = 0) -> DataFrame:
    """(no, line), numbered from 0 in the order of the files, without the first `header` lines of each."""
    return _numbered(spark, path, header).where("no is not null").select("no", "line")


def _numbers(text: Column, split: str = r"[\s,]+") -> Column:
    return F.transform(F.filter(F.split(F.trim(text), split), lambda x: x != ""), lambda x: x.try_cast("double"))


def _first(df: DataFrame, limit: int | None, by: str = "id") -> DataFrame:
    """The first lines in file order; numbers are dense, so this is a filter and no sort."""
    return df if limit is None else df.where(F.col(by) < limit)


def _complete(v: Column) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())


@loader("vector")
def read_vectors(spark: SparkSession, path: str, limit: int | None = None, dims: int | None = None) -> DataFrame:
    """(id, v): header `dim n`, then a row of numbers for each vector; the first `dims` values count."""
    rows = numbered_lines(spark, path, 1).select(F.col("no").alias("id"), _numbers(F.col("line")).alias("v"))
    rows = _first(rows, limit).where(_complete(F.col("v")))
    return rows.withColumn("v", F.slice("v", 1, dims)) if dims else rows


@loader("matrix")
def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a matrix file, all columns."""
    return read_vectors(spark, path)


@loader("dimacs")
def read_dimacs(spark: SparkSession, path: str, limit: int | None = None, skip: int = 0, dims: int | None = None) -> DataFrame:
    """(id, v): header `base query dim`; `skip` rows are passed over first. ids count from the first row kept."""
    rows = numbered_lines(spark, path, 1).where(F.col("no") >= skip).select((F.col("no") - skip).alias("id"), _numbers(F.col("line")).alias("v"))
    rows = _first(rows, limit).where(_complete(F.col("v")))
    return rows.withColumn("v", F.slice("v", 1, dims)) if dims else rows


@loader("string")
def read_strings(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, s): trimmed lines that are not empty; id is the line number from 0. limit counts strings, not lines."""
    rows = numbered_lines(spark, path).select(F.col("no").alias("id"), F.trim("line").alias("s")).where("s <> ''")
    return rows if limit is None else rows.orderBy("id").limit(limit)


@loader("fasta")
def read_fasta(spark: SparkSession, path: str, max_symbols: int | None = None) -> DataFrame:
    """(seq_id, ident, seq): records open with `>`; their lines are joined without blanks. Records beyond the first
    max_symbols symbols are left out, the one that crosses is cut."""
    raw = _numbered(spark, path, 0, lineSep="\n>").select(F.col("no").alias("seq_id"), F.col("line").alias("raw"), "file", "block")
    clean = F.regexp_replace(F.regexp_replace("raw", "^>", ""), "\r", "")
    body = F.when(F.instr(clean, "\n") > 0, F.regexp_replace(F.substring(clean, F.instr(clean, "\n") + 1, F.length(clean)), r"\s+", "")).otherwise("")
    recs = raw.select("seq_id", F.trim(F.substring_index(clean, "\n", 1)).alias("ident"), body.alias("seq"), "file", "block").where("ident <> '' or seq <> ''")
    if max_symbols is None:
        return recs.drop("file", "block")
    # symbols before a record: of earlier blocks (a row each), and of earlier records of its block
    blocks = recs.groupBy("file", "block").agg(F.sum(F.length("seq")).alias("n"))
    blocks = blocks.withColumn("_earlier", F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).drop("n")
    inside = F.sum(F.length("seq")).over(Window.partitionBy("file", "block").orderBy("seq_id")) - F.length("seq")
    cut = recs.join(F.broadcast(blocks), ["file", "block"]).withColumn("_b", F.col("_earlier") + inside).where(F.col("_b") < max_symbols)  # blocks: one for each split that is read
    return cut.select("seq_id", "ident", F.substring("seq", F.lit(1), (F.lit(max_symbols) - F.col("_b")).cast("int")).alias("seq"))


def _fragments_of(kind: str) -> None:
    @loader(kind)
    def read(spark: SparkSession, path: str, length: int = 6, max_symbols: int | None = None, include_last: bool = False) -> DataFrame:
        from metricloom.functions.sequences import fragments

        out = fragments(read_fasta(spark, path, max_symbols), "seq_id", "seq", length, include_last)
        return out.withColumn("id", F.xxhash64("seq_id", "offset"))


for _k in ("dna", "rna", "peptide"):
    _fragments_of(_k)


@loader("ms")
def read_ms(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, peaks): line 1 the count, then `id peak peak ...`; peaks ascending."""
    rows = _first(numbered_lines(spark, path, 1).select("no", _numbers(F.col("line")).alias("n")).where(_complete(F.col("n"))), limit, "no")
    return rows.select(F.element_at("n", 1).cast("bigint").alias("id"), F.array_sort(F.slice("n", F.lit(2), F.size("n"))).alias("peaks"))


@loader("msms")
def read_msms(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, spectrum (precursor, peaks)): line 1 the count, then `id precursor peak ...`."""
    rows = _first(numbered_lines(spark, path, 1).select("no", _numbers(F.col("line")).alias("n")).where(_complete(F.col("n")) & (F.size("n") >= 2)), limit, "no")
    peaks = F.array_sort(F.slice("n", F.lit(3), F.size("n")))
    return rows.select(F.element_at("n", 1).cast("bigint").alias("id"), F.struct(F.element_at("n", 2).alias("precursor"), peaks.alias("peaks")).alias("spectrum"))


@loader("image")
def read_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, name, f): a name and 66 features on each line."""
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    rows = numbered_lines(spark, path).select(F.col("no").alias("id"), parts.alias("p")).where("size(p) = 67")
    f = F.transform(F.slice("p", 2, 66), lambda x: x.try_cast("double"))
    return _first(rows.select("id", F.element_at("p", 1).alias("name"), f.alias("f")).where(_complete(F.col("f"))), limit)


def read_image_maxima(spark: SparkSession, path: str) -> list[float]:
    """The three largest block distances of a `maxinfo` file."""
    got = spark.read.text(path).select(F.explode(_numbers(F.col("value"))).alias("x")).where("x is not null").limit(3).collect()
    return [r["x"] for r in got]


def image_maxima(images: DataFrame) -> list[float]:
    """The largest distance between two images in each of the three feature blocks."""
    from metricloom.functions.metrics import IMAGE_BLOCKS, L2
    from metricloom.operators.index import diameter
    from metricloom.operators.table import MetricTable

    return [diameter(MetricTable(images.select("id", F.slice("f", start, n).alias("v")), "id", "v", L2)) for start, n in IMAGE_BLOCKS]


@loader("kddcup")
def read_kddcup(spark: SparkSession, path: str, inliers: int | None = None, outliers: int | None = None) -> DataFrame:
    """(id, num (34), cat (7), is_normal): header, then 41 comma-separated features and a label. Text categories get codes in
    alphabetical order; of each class the first rows up to its quota are kept."""
    where_text = (1, 2, 3)  # Fixed values: columns of text categories (from 0), then of coded flags.
    flags = (6, 11, 20, 21)
    lines = numbered_lines(spark, path, 1).where(F.length("line") - F.length(F.replace("line", F.lit(","), F.lit(""))) == 41)
    # a line without blanks is cut at its commas alone, which takes far less time than a pattern does
    blank, dotted = F.col("line").rlike(r"[\s\x85\u2028\u2029]"), F.split(F.regexp_replace(F.trim("line"), r"\.$", ""), r"\s*,\s*")
    bare = F.when(F.endswith("line", F.lit(".")), F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    head = F.when(blank, dotted).otherwise(F.split(F.substring_index("line", ",", max(where_text) + 1), ","))
    texts = lines.select(F.explode(F.array(head)).alias("p")).select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.element_at("p", i + 1).alias("c")) for i in where_text])).alias("x"))
    codes = texts.select("x.i", "x.c").distinct().withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("c")) - 1)  # a row for each category
    codes = stored(codes)
    few = codes.limit(MOST_CODES + 1).count() <= MOST_CODES
    # out of generators: a condition on plain columns would be moved ahead of them, and lines cut and read twice
    rows = lines.select(F.col("no").alias("id"), F.explode(F.array(F.when(blank, dotted).otherwise(F.split(bare, ",")))).alias("p"))
    for i in where_text:
        mine = codes.where(F.col("i") == i).select(F.col("c").alias(f"_c{i}"), F.col("k").alias(f"_k{i}"))
        rows = rows.withColumn(f"_c{i}", F.element_at("p", i + 1)).join(F.broadcast(mine) if few else mine, f"_c{i}").drop(f"_c{i}")  # MOST_CODES rows at most
    cat = [F.col(f"_k{i}") for i in where_text]
    cat += [F.element_at("p", i + 1).try_cast("int") for i in flags]
    num = [F.element_at("p", i + 1).try_cast("double") for i in range(41) if i not in where_text + flags]
    whole = F.col("num")[0]
    for i in range(1, len(num)):
        whole = whole + F.col("num")[i]  # null if one of them is
    out = rows.select("id", F.explode(F.array(F.array(*num))).alias("num"), F.array(*cat).alias("cat"), (F.element_at("p", 42) == "normal").alias("is_normal")).where(whole.isNotNull())
    return quota(out, "is_normal", {True: inliers, False: outliers})


def quota(df: DataFrame, label: str, most: dict[bool, int | None], order: str = "id") -> DataFrame:
    """The first rows of each class up to its number; None keeps all."""
    out = None
    for value, n in most.items():
        part = df.where(F.col(label) == value)
        part = part if n is None else part.orderBy(order).limit(n)  # each task passes on n rows at most
        out = part if out is None else out.unionByName(part)
    return df if all(n is None for n in most.values()) or out is None else out


@loader("stock")
def read_stock(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, name, dates, prices): header, a row of dates, then `id name price ...`."""
    lines = _numbered(spark, path, 2)
    dates = lines.where("place = 1").select("file", F.transform(_numbers(F.col("line")), lambda x: x.cast("int")).alias("dates"))  # a row for each file
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.where("no is not null").select("file", F.col("no").alias("_no"), parts.alias("p")).where("size(p) > 2")
    prices = F.transform(F.slice("p", F.lit(3), F.size("p")), lambda x: x.try_cast("double"))
    rows = _first(rows, limit, "_no").select("file", F.element_at("p", 1).try_cast("int").alias("id"), F.element_at("p", 2).alias("name"), prices.alias("prices")).where(_complete(F.col("prices")))
    return rows.join(dates, "file", "left").select("id", "name", F.coalesce("dates", F.array().cast("array<int>")).alias("dates"), "prices")


@loader("labelled_vector")
def read_labelled_vectors(spark: SparkSession, path: str, inliers: int | None = None, outliers: int | None = None) -> DataFrame:
    """(id, v, is_normal): header, then the values and a tag, 1 for normal."""
    rows = numbered_lines(spark, path, 1).select(F.col("no").alias("id"), _numbers(F.col("line")).alias("n")).where(_complete(F.col("n")) & (F.size("n") > 1))
    out = rows.select("id", F.slice("n", F.lit(1), F.size("n") - 1).alias("v"), (F.element_at("n", -1) == 1).alias("is_normal"))
    return quota(out, "is_normal", {True: inliers, False: outliers})


@loader("labelled_dna")
def read_labelled_dna(spark: SparkSession, path: str, inliers: int | None = None, outliers: int | None = None) -> DataFrame:
    """(id, seq, is_normal): header, then a sequence and its flag."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = numbered_lines(spark, path, 1).select(F.col("no").alias("id"), parts.alias("p")).where("size(p) = 2")
    out = rows.select("id", F.element_at("p", 1).alias("seq"), (F.element_at("p", 2) == "1").alias("is_normal"))
    return quota(out, "is_normal", {True: inliers, False: outliers})


@loader("sonar")
def read_sonar(spark: SparkSession, path: str) -> DataFrame:
    """(id, features (60), label): comma-separated, R is 0 and M is 1."""
    parts = F.split(F.trim("line"), r"\s*,\s*")
    rows = numbered_lines(spark, path).select(F.col("no").alias("id"), parts.alias("p")).where("size(p) = 61")
    features = F.transform(F.slice("p", 1, 60), lambda x: x.try_cast("double"))
    return rows.select("id", features.alias("features"), F.when(F.element_at("p", 61) == "R", 0).when(F.element_at("p", 61) == "M", 1).alias("label")).where(_complete(F.col("features")))


@loader("mapped")
def read_mapped(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a pivot-space text file with a header line."""
    return read_vectors(spark, path)


@loader("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
