"""Mixes of sources by target shares of tokens.

Documents are counted by source and exact token length.  A source gives whole passes while its budget holds them; of the
rest each length gives its proportional number of documents, rounded by largest remainders (equal ones in the order of a
seeded hash), so that the documents added are as long as the source's.  A bounded-knapsack dynamic program over the lengths
left fits the last tokens.  If no choice of them does, it starts from all documents of the source and keeps what comes nearer.
Which documents of a length are taken is settled by a seeded hash.  Only the counts by length of the sources in the mixes
reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metricloom.llm.p6_tokens import token_counts
from metricloom.llm.shared import cut, small

#: Tokens that the dynamic program fits at first; it goes beyond them only where no documents give the exact number.
BUDGET = 1 << 15
SEED = 17
#: Hash buckets in which documents of one source and length are ranked apart.
BUCKETS = 256


def _fit(rest: int, lengths: dict[int, int], budget: int) -> dict[int, int]:
    """As `fit_counts`, exactly so only if rest <= budget; above it the longest are taken first until it is."""
    taken: dict[int, int] = {}
    have = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    for n in sorted(have, reverse=True):
        if rest <= budget:
            break
        if c := min(have[n], (rest - budget + n - 1) // n, rest // n):
            taken[n] = c
            have[n] -= c
            rest -= c * n
    goal = min(rest, budget)
    if goal <= 0:
        return taken
    full = (1 << (goal + 1)) - 1
    reach, steps = 1, []
    first = np.zeros(goal + 1, np.int32)  # the step that reached a sum first
    for n in sorted(have):
        c = min(have[n], goal // n)
        size = 1
        while c > 0 and not reach >> goal & 1:
            part = min(size, c)
            grown = reach | (reach << (n * part)) & full
            if new := grown ^ reach:
                bits = np.frombuffer(new.to_bytes((goal >> 3) + 1, "little"), np.uint8)
                first[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                steps.append((n, part))
                reach = grown
            c -= part
            size *= 2
        if reach >> goal & 1:
            break
    at = reach.bit_length() - 1
    while at:
        n, part = steps[first[at]]
        taken[n] = taken.get(n, 0) + part
        at -= n * part
    return taken


def fit_counts(rest: int, lengths: dict[int, int], budget: int = BUDGET) -> dict[int, int]:
    """Numbers of documents by length, within the numbers at hand, whose tokens come as near to `rest` as can be without
    exceeding it. The longest are taken first until the dynamic program fits the last `budget` tokens; if that leaves a gap, it
    fits ever more, all of `rest` in the end."""
    have = {n: c for n, c in lengths.items() if 0 < n <= rest and c > 0}
    unit = math.gcd(*have)
    if not unit:
        return {}
    goal, have = rest // unit, {n // unit: c for n, c in have.items()}
    best: dict[int, int] = {}
    while True:
        got = _fit(goal, have, budget)
        best = max(best, got, key=lambda x: sum(n * c for n, c in x.items()))
        if budget >= goal or sum(n * c for n, c in best.items()) == goal:
            return {n * unit: c for n, c in best.items()}
        budget *= 4


def mix_plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """For each row of the targets what its source has and is asked for: tokens, target_tokens, passes, rest."""
    per = {r["source"]: r["tokens"] for r in sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens")).join(targets.select("source").distinct(), "source").collect()}  # a row for each target source
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    plan = []
    for r in targets.where("mix_id is not null and source is not null").collect():
        have = per.get(r["source"], 0)
        want = r["target_share"] * r["size_ratio"] * total
        passes = min(r["max_uses"], int(want // have)) if have else 0
        rest = int(want - passes * have) if have and passes < r["max_uses"] else 0
        plan.append(r.asDict() | {"tokens": have, "target_tokens": want, "passes": passes, "rest": rest})
    return plan


def _sized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    more = {"vocabulary": vocabulary} if vocabulary else {}
    return cut(token_counts(docs, ["doc_id", "source"], "text", **more))


def _by_remainder(rest: int, n_tokens: np.ndarray, f: np.ndarray, h: np.ndarray, reserve: int) -> np.ndarray:
    """Positions of the lengths that give one document more, by descending remainder, until all but `reserve` of the rest is
    filled or the next doesn't fit."""
    o = np.lexsort((h, -f))
    o = o[f[o] > 0]
    return o[: int(np.searchsorted(np.cumsum(n_tokens[o]), rest - reserve, "right"))]


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED, budget: int = BUDGET) -> tuple[DataFrame, list[dict]]:
    """(mix_id, doc_id, source, n_tokens, uses) of the documents used, and the plan: for each row of the targets its columns,
    the source's tokens, target_tokens, the tokens given, and whether the source is short, i.e. gives every document max_uses
    times and yet less than its target.

    sized: doc_id, source, n_tokens. A document is used at most max_uses times, in whole passes and at most one partial pass;
    the tokens given never exceed the target. A source that is short gives all it may. Documents of 0 tokens, and those
    without a source, go into no mix. A source without documents, and an empty table, give none.
    """
    spark = sized.sparkSession
    plan = mix_plan(sized, targets)
    schema = "mix_id int, source string, passes int, rest bigint, tokens bigint"
    rows = spark.createDataFrame([(p["mix_id"], p["source"], p["passes"], p["rest"], p["tokens"]) for p in plan], schema)
    docs = sized.where("n_tokens > 0 and source is not null")
    lens = cut(docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    part = F.col("n") * (F.col("rest") / F.col("tokens"))
    base = lens.join(F.broadcast(rows), "source").withColumns({"take": F.least(F.floor(part), "n"), "f": part - F.floor(part), "h": F.xxhash64("n_tokens", F.lit(seed))})  # rows: one for each target
    # at most sqrt(2 * tokens) lengths for each target
    counts = base.where("rest > 0").select("mix_id", "source", "n_tokens", "n", "take", "f", "h").toPandas()
    extra, limits = [], []
    asked = {(p["mix_id"], p["source"]): p["rest"] for p in plan}
    for (mix_id, source), group in counts.groupby(["mix_id", "source"]):
        key = (int(mix_id), source)
        size, n, take, f, h = (group[c].to_numpy() for c in ("n_tokens", "n", "take", "f", "h"))
        rest = asked[key] - int((take * size).sum())
        more = _by_remainder(rest, size, f, h, budget // 16)
        if len(more):
            limits.append((*key, float(f[more[-1]]), int(h[more[-1]])))
            take = take.copy()
            take[more] += 1
            rest -= int(size[more].sum())
        if rest <= 0:
            continue
        taken, left = dict(zip(size.tolist(), take.tolist(), strict=True)), dict(zip(size.tolist(), (n - take).tolist(), strict=True))
        fill = fit_counts(rest, left, budget)
        if gap := rest - sum(k * c for k, c in fill.items()):
            given = int((take * size).sum())
            anew = fit_counts(rest + given, {k: left[k] + taken[k] for k in taken}, budget)
            if sum(k * c for k, c in anew.items()) > rest + given - gap:
                fill = {k: anew.get(k, 0) - t for k, t in taken.items()}
        extra += [(*key, k, c) for k, c in fill.items() if c]
    extra_df = spark.createDataFrame(extra, "mix_id int, source string, n_tokens bigint, extra bigint")
    limit_df = spark.createDataFrame(limits, "mix_id int, source string, _f double, _h bigint")
    rounded = F.coalesce((F.col("f") > 0) & ((F.col("f") > F.col("_f")) | (F.col("f") == F.col("_f")) & (F.col("h") <= F.col("_h"))), F.lit(False)).cast("int")
    takes = base.join(F.broadcast(limit_df), ["mix_id", "source"], "left").join(extra_df, ["mix_id", "source", "n_tokens"], "left")  # limit_df: one row for each target
    takes = takes.select("mix_id", "source", "n_tokens", "n", "passes", (F.col("take") + rounded + F.coalesce("extra", F.lit(0))).alias("take")).where("passes > 0 or take > 0")
    takes, hint = small(takes)
    given = {(r["mix_id"], r["source"]): r["given"] for r in takes.groupBy("mix_id", "source").agg(F.sum((F.col("passes") * F.col("n") + F.col("take")) * F.col("n_tokens")).alias("given")).collect()}  # a row for each target
    for p in plan:
        p["given"] = given.get((p["mix_id"], p["source"]), 0)
        p["short"] = p["given"] < p["target_tokens"] and p["given"] == p["max_uses"] * p["tokens"]
    takes = takes.drop("n")

    h = F.xxhash64("doc_id", F.lit(seed))
    ranked = docs.select("doc_id", "source", "n_tokens", h.alias("h"), F.pmod(F.shiftright(h, 40), F.lit(BUCKETS)).alias("b"))
    before = ranked.groupBy("source", "n_tokens", "b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("source", "n_tokens").orderBy("b")  # BUCKETS rows at most
    before = before.withColumn("before", F.sum("c").over(w) - F.col("c")).drop("c")
    inner = Window.partitionBy("source", "n_tokens", "b").orderBy("h", "doc_id")
    ranked = ranked.withColumn("r", F.row_number().over(inner)).join(before, ["source", "n_tokens", "b"])
    ranked = ranked.select("doc_id", "source", "n_tokens", (F.col("r") + F.col("before")).alias("r"))
    used = ranked.join(hint(takes), ["source", "n_tokens"]).withColumn("uses", F.col("passes") + (F.col("r") <= F.col("take")).cast("int"))
    return used.where("uses > 0").select("mix_id", "doc_id", "source", "n_tokens", "uses"), plan


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")
    return _sized(docs), spark.read.parquet(f"{d}/mix_targets.parquet")


def q_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(*_inputs(spark, d))[0]


def _plan_rows(spark: SparkSession, plan: list[dict]) -> DataFrame:
    return spark.createDataFrame(
        [(p["mix_id"], p["source"], p["target_share"], p["target_tokens"], p["short"]) for p in plan], "mix_id int, source string, target_share double, target_tokens double, short boolean"
    )


def q_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source really gives to each mix."""
    used, plan = mix(*_inputs(spark, d))
    given = used.groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"))
    out = _plan_rows(spark, plan).join(F.broadcast(given), ["mix_id", "source"], "left").na.fill(0, ["tokens", "n_docs", "most_uses"])  # a row for each target
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_id")), F.lit(0))
    return out.select("mix_id", "source", "target_share", share.alias("share"), "target_tokens", "tokens", "n_docs", "most_uses", "short")


def q_found(spark: SparkSession, d: str) -> DataFrame:
    """The mixes are fitted by their lengths; which documents are taken is left out."""
    _, plan = mix(*_inputs(spark, d))
    return _plan_rows(spark, plan).where("short").select("mix_id", "source")


QUERIES = {"p7_found": q_found, "p7_shares": q_shares, "p7_mix": q_mix}
ORACLES: dict = {}
