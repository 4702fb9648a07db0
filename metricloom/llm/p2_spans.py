"""Exact spans of at least a given length that several records share.

A sentence of the named method is a symbol here.  Every run of `length` consecutive symbols is hashed (128 bits, so that equal
hashes mean equal runs for any corpus) and the hashes are joined globally by aggregation: a run is shared if its smallest and
largest record id differ. No pairs of records are built, and a run that stands in a third of all records costs one
aggregation row for each map task.  What a run covers that also stands in a record of smaller id can be removed.

Hashing all runs would shuffle some 20 bytes for each symbol. So a first round sends only anchors: of each run the shorter
run inside it whose hash is smallest, one for some twenty symbols. Equal runs have equal anchors, hence a run whose anchor
stands in one record only cannot be shared. The anchors that several records have go into a bit map of bounded size, and the
second round hashes just the runs whose anchor is in it; what the map lets through by mistake falls out in the global join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.llm.shared import cut, small
from metricloom.operators.durable import stored

LENGTH = 64
#: A hash with more than one in HOT_SHARE of the shared rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 4096
#: Symbols that are hashed at once.
BLOCK = 1 << 20
#: Bits of the map for each shared anchor, and of the whole map at most (as a power of 2). A fuller map lets more through.
EACH, MOST_BITS = 256, 30

_U = np.uint64
_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(k | 1)
    return x ^ (x >> _U(29))


def run_hashes(codes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of each run of `length` symbols, by doubling: two runs of L give one of 2 L; an odd rest overlaps."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, _U)
    h, size = _mix(codes.astype(_U) + _U(seed & 0xFFFF) + _U(1), seed), 1
    while size < length:
        step = min(size, length - size)
        h = _mix(h[:-step] * _U(seed | 1) + _mix(h[step:], seed >> 7), seed >> 3)
        size += step
    return h[:n]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (the first, of equals in the leading bits) in each window, by doubling."""
    low = _U((1 << max(1, len(h).bit_length())) - 1)
    least, size = (h & ~low) | np.arange(len(h), dtype=_U), 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (least & low).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Texts joined to blocks of some BLOCK symbols: (codes, rid, start, offset, size), all but the first for each piece. A
    piece is a text, or a part of a long one that begins at `start` and overlaps the next by length - 1. Texts are at least
    `length` long."""
    held, n = [], 0

    def joined() -> tuple:
        size = np.array([len(x[2]) for x in held])
        return np.concatenate([x[2] for x in held]), np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.cumsum(size) - size, size

    for batch in batches:
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = _codes(text)
            for start in range(0, len(codes) - length + 1, BLOCK):
                held.append((rid, start, codes[start : start + BLOCK + length - 1]))
                n += len(held[-1][2])
                if n >= BLOCK:
                    yield joined()
                    held, n = [], 0
    if held:
        yield joined()


def _windows(offset: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Position in the block and piece of every run that lies within a piece."""
    count = size - length + 1
    piece = np.repeat(np.arange(len(size)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offset[piece], piece


def _anchor_hashes(codes: np.ndarray, length: int, k: int, pos: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs at which the anchor changes, and the hashes (48 bits) of these anchors."""
    a = run_hashes(codes, k, _SEEDS[0])
    at = window_argmin(a, length - k + 1)[pos]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])
    return first, a[at[first]] >> _U(16)


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, rid, _, offset, size in _blocks(batches, length):
            pos, piece = _windows(offset, size, length)
            first, h = _anchor_hashes(codes, length, k, pos, piece)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rid[piece[first]])], ["h", "rid"])

    return run


def _runs(length: int, k: int, sent):
    """(h1, h2, rid, pos) of the runs whose anchor is in the bit map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(sent.value, np.int64)
        top = _U(len(words) * 64 - 1)
        for codes, rid, start, offset, size in _blocks(batches, length):
            pos, piece = _windows(offset, size, length)
            first, h = _anchor_hashes(codes, length, k, pos, piece)
            bit = (h & top).astype(np.int64)
            hit = (words[bit >> 6] >> (bit & 63)) & 1 == 1
            keep = np.repeat(hit, np.diff(np.r_[first, len(pos)]))
            pos, piece = pos[keep], piece[keep]
            if len(pos):
                some = np.zeros(len(size), bool)
                some[piece] = True
                part = codes[np.repeat(some, size)]  # of pieces with such runs
                now = np.cumsum(size * some) - size * some
                at = pos - offset[piece]
                h1, h2 = (run_hashes(part, length, s)[at + now[piece]].view(np.int64) for s in _SEEDS)
                cols = (h1, h2, rid[piece], at + start[piece])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "rid", "pos"])

    return run


def _bit_map(hashes: DataFrame, each: int = EACH) -> bytes:
    """A bit for each hash, as 64-bit words: `each` times as many bits as hashes, up to 2 ** MOST_BITS."""
    hashes = cut(hashes)
    bits = 1 << min(MOST_BITS, max(6, (each * max(1, hashes.count()) - 1).bit_length()))
    bit = F.col("h").bitwiseAND(bits - 1)
    words = hashes.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toPandas()  # 2 ** (MOST_BITS - 6) rows at most
    out = np.zeros(bits >> 6, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.tobytes()


def _shared(rows: DataFrame) -> DataFrame:
    """(h1, h2, first, n) of the hashes that stand in more than one record; `first`: the smallest record id."""
    seen = rows.groupBy("h1", "h2").agg(F.min("rid").alias("first"), F.max("rid").alias("_last"), F.count(F.lit(1)).alias("n"))
    return seen.where("first < _last").drop("_last")


def _keep_shared(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows of shared hashes, with `first`. Hot hashes are joined by broadcast (fewer than HOT_SHARE by construction), so no
    task gets more than its share of the rows of one hash."""
    shared = cut(shared)
    total = shared.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(shared.where(is_hot).select("h1", "h2", F.col("first").alias("_first"), F.lit(True).alias("hot")))
    cold = shared.where(~is_hot).select("h1", "h2", "first")
    split = rows.join(hot, ["h1", "h2"], "left")
    by_hot = split.where("hot").drop("hot").withColumnRenamed("_first", "first")
    by_hash = split.where("hot is null").drop("hot", "_first").join(cold, ["h1", "h2"])
    return by_hot.unionByName(by_hash)


def _records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, txt): rows with an id, as they stand; if copies of an id differ, those of one text, the one of smallest hash."""
    recs = df.select(F.col(id_col).cast("bigint").alias("rid"), F.col(text_col).alias("txt")).where("rid is not null")
    h = F.xxhash64("txt")
    odd, hint = small(recs.where("txt is not null").groupBy("rid").agg(F.min(h).alias("_h"), F.max(h).alias("_last")).where("_h < _last").select("rid", "_h"))
    return recs.join(hint(odd), "rid", "left").where(F.col("_h").isNull() | (F.col("_h") == h)).select("rid", "txt")


def shared_runs(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, anchor: int | None = None) -> DataFrame:
    """(rid, pos, later): where the runs of `length` symbols begin that also stand in another record; later: in one of smaller
    id. Copies of an id give their runs once each. anchor: length of the runs sent first, at most `length`."""
    k = min(anchor or max(1, 3 * length // 8), length)
    recs = _records(df, id_col, text_col).where(F.length("txt") >= length)
    several = recs.mapInArrow(_anchors(length, k), "h bigint, rid bigint").groupBy("h").agg(F.min("rid").alias("a"), F.max("rid").alias("b")).where("a < b")
    sent = df.sparkSession.sparkContext.broadcast(_bit_map(several.select("h")))  # 2 ** MOST_BITS bits at most
    runs = stored(recs.mapInArrow(_runs(length, k, sent), "h1 bigint, h2 bigint, rid bigint, pos bigint"))
    return _keep_shared(runs, _shared(runs)).select("rid", "pos", (F.col("first") < F.col("rid")).alias("later"))


def merged(hits: DataFrame, length: int) -> DataFrame:
    """(rid, span_start, span_end): the longest runs of consecutive positions that the runs of (rid, pos) cover."""
    w = Window.partitionBy("rid").orderBy("pos")
    new = F.col("pos") - F.lag("pos").over(w) > length
    spans = hits.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_no", F.sum("_new").over(w))
    return spans.groupBy("rid", "_no").agg(F.min("pos").cast("int").alias("span_start"), (F.max("pos") + length).cast("int").alias("span_end")).drop("_no")


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, anchor: int | None = None) -> DataFrame:
    """(rid, span_start, span_end): the longest runs of consecutive shared positions of each record.

    A position is shared if it lies in a run of at least `length` symbols (Unicode code points, compared as stored) that
    also stands in another record. span_start counts from 0, span_end is exclusive.
    Records with null text, null id or fewer than `length` symbols have no span. Copies of an id count once; if their texts
    differ, one of them counts, the same in every run. anchor: length of the runs sent first, at most `length`.
    """
    return merged(shared_runs(df, id_col, text_col, length, anchor), length)


def _dna(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labelled_dna.parquet").select("seq_id", "seq")


def q_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(_dna(spark, d), "seq_id", "seq").select(F.col("rid").alias("seq_id"), "span_start", "span_end")


def shared_shares(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(rid, n_symbols, n_shared, share, n_later): for each record the symbols that are shared, and those that runs cover which
    also stand in a record of smaller id, and which a cleaned corpus can do without. share is null for an empty text, as is
    all for null."""
    hits = shared_runs(df, id_col, text_col, length)
    covered = lambda w: F.least(F.coalesce(F.lead("pos").over(w) - F.col("pos"), F.lit(length)), F.lit(length))
    hits = hits.withColumn("_all", covered(Window.partitionBy("rid").orderBy("pos"))).withColumn("_same", covered(Window.partitionBy("rid", "later").orderBy("pos")))
    per = hits.groupBy("rid").agg(F.sum("_all").alias("n_shared"), F.sum(F.when(F.col("later"), F.col("_same"))).alias("n_later"))
    sizes = _records(df, id_col, text_col).groupBy("rid").agg(F.max(F.length("txt")).alias("n_symbols"))
    out = sizes.join(per, "rid", "left")
    zero = lambda c: F.when(F.col("n_symbols").isNotNull(), F.coalesce(F.col(c), F.lit(0)))
    return out.select("rid", "n_symbols", zero("n_shared").alias("n_shared"), (zero("n_shared") / F.nullif(F.col("n_symbols"), F.lit(0))).alias("share"), zero("n_later").alias("n_later"))


def cleaned(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(rid, txt, n_removed): each record once, without the symbols that runs cover which also stand in a record of smaller id.
    Null texts stay null; the first record of a run keeps it."""
    later = merged(shared_runs(df, id_col, text_col, length).where("later"), length)
    spans = later.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("spans"))  # fewer than a record's symbols
    recs = _records(df, id_col, text_col).groupBy("rid").agg(F.max("txt").alias("txt"))
    out = recs.join(spans, "rid", "left")
    n = F.size("spans")
    begin = lambda i: F.when(i > 0, F.get("spans", i - 1)["span_end"]).otherwise(0)
    piece = lambda i: F.substring("txt", begin(i) + 1, F.when(i < n, F.get("spans", i)["span_start"]).otherwise(F.length("txt")) - begin(i))
    text = F.when(F.col("spans").isNull(), F.col("txt")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n), piece), ""))
    gone = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<span_start:int,span_end:int>>")), F.lit(0), lambda a, x: a + x["span_end"] - x["span_start"])
    return out.select("rid", text.alias("txt"), F.when(F.col("txt").isNotNull(), gone).alias("n_removed"))


def q_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_shares(_dna(spark, d), "seq_id", "seq").withColumnRenamed("rid", "seq_id").withColumn("share", F.round("share", 9))


def q_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return cleaned(_dna(spark, d), "seq_id", "seq").select(F.col("rid").alias("seq_id"), F.col("txt").alias("seq"), "n_removed")


_SPANS = f"""recs AS (SELECT seq_id, min(seq) AS seq FROM labelled_dna WHERE length(seq) >= {LENGTH} GROUP BY seq_id),
runs AS (SELECT seq_id, pos, substr(seq, pos + 1, {LENGTH}) AS run FROM (SELECT seq_id, seq, unnest(range(length(seq) - {LENGTH - 1})) AS pos FROM recs)),
shared AS (SELECT run, min(seq_id) AS first FROM runs GROUP BY run HAVING min(seq_id) < max(seq_id)),
later AS (SELECT DISTINCT seq_id, pos + i AS place FROM (SELECT seq_id, pos FROM runs JOIN shared USING (run) WHERE first < seq_id), range({LENGTH}) t(i)),
hits AS (SELECT seq_id, pos, coalesce(pos - lag(pos) OVER w > {LENGTH}, true) AS new FROM runs SEMI JOIN shared USING (run) WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
numbered AS (SELECT seq_id, pos, sum(new::INT) OVER (PARTITION BY seq_id ORDER BY pos) AS no FROM hits),
spans AS (SELECT seq_id, min(pos)::INT AS span_start, (max(pos) + {LENGTH})::INT AS span_end FROM numbered GROUP BY seq_id, no)"""

QUERIES = {"p2_found": q_found, "p2_shares": q_shares, "p2_cleaned": q_cleaned}
ORACLES = {
    "p2_found": f"WITH {_SPANS} SELECT seq_id, span_start, span_end FROM spans",
    "p2_cleaned": f"""WITH {_SPANS},
one AS (SELECT seq_id, min(seq) AS seq FROM labelled_dna GROUP BY seq_id),
symbols AS (SELECT seq_id, unnest(range(length(seq))) AS place, seq FROM one),
kept AS (SELECT seq_id, string_agg(substr(seq, place + 1, 1), '' ORDER BY place) AS seq FROM symbols ANTI JOIN later USING (seq_id, place) GROUP BY seq_id)
SELECT one.seq_id, CASE WHEN one.seq IS NOT NULL THEN coalesce(kept.seq, '') END AS seq, (length(one.seq) - length(coalesce(kept.seq, '')))::INT AS n_removed FROM one LEFT JOIN kept USING (seq_id)""",
    "p2_shares": f"""WITH {_SPANS},
sizes AS (SELECT seq_id, length(min(seq)) AS n_symbols FROM labelled_dna GROUP BY seq_id),
per AS (SELECT seq_id, sum(span_end - span_start) AS n FROM spans GROUP BY seq_id),
removed AS (SELECT seq_id, count(*) AS n_later FROM later GROUP BY seq_id)
SELECT seq_id, n_symbols::INT AS n_symbols, CASE WHEN n_symbols IS NOT NULL THEN coalesce(n, 0)::BIGINT END AS n_shared,
  CASE WHEN n_symbols IS NOT NULL THEN round(coalesce(n, 0)::DOUBLE / nullif(n_symbols, 0), 9) END AS share,
  CASE WHEN n_symbols IS NOT NULL THEN coalesce(n_later, 0)::BIGINT END AS n_later
FROM sizes LEFT JOIN per USING (seq_id) LEFT JOIN removed USING (seq_id)""",
}
