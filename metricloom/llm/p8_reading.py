"""Reading level of what each sender wrote, by a Rasch-style model.

Mails have a level theta.  An item, a word or a class of word and sentence length, stands in a mail of n words with the log odds
beta + lambda (theta - 3) + ln(n / 100): beta says how common it is, lambda how fast it becomes likelier with the level, and
the length of the mail shifts all items alike.  Items that are absent count as those that are there.  Levels of rated mails
and parameters of the items are maximised in turn over the penalised likelihood, by distributed aggregations over (mail,
item), until the levels stop moving; the ratings hold the scale.  Levels lie on a grid, so the absent items of all mails are
summed once for each level and length, and a mail costs only the items that it has.  All mails are then placed by the same
likelihood, without ratings.

The model is fitted on at most RATED rated mails; mails and corpus are otherwise treated whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.mail import WORD, own_text
from metricloom.llm.shared import cut

#: Rated mails on which the model is fitted, at most (which bounds its items, too); mails that an item must stand in.
RATED, SEEN = 20_000, 3
#: Mean move of the levels at which the fit ends, and rounds after which it raises.
MOVE, ROUNDS = 0.02, 60
#: Own words below which a mail has no level.
WORDS = 30
#: Precision of a rating and of a level without one, prior variance of lambda, and of beta for each mail fitted on (the fewer,
#: the less can be told of how common an item is), prior mean of beta. Chosen by held-out ratings.
HOLD, LOOSE, STEEP, COMMON, RARE = 200.0, 0.05, 0.5, 1e-3, -5.0
#: Levels of the grid; lengths are classed by half powers of 2.
GRID = np.round(np.arange(0.0, 6.01, 0.05), 2)
LENGTHS = 41

# Frequent function words that few other of these languages share.
_ENGLISH = set("the of and to is was that it for with as be by this have from they we you are at not but had or which an were been their has would there what will can if she he his her our your".split())
_FOREIGN = set(
    "le la les une est et pour que nous vous dans pas avec sur qui ce cette au aux du "
    "el los las un por para con del se lo su como pero más está esta "
    "der das und ist nicht ein eine wir ich sie mit auf für von dem den zu noch uns bitte "
    "os uma não com mais você il di che per non sono una het een van niet".split()
)
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")


def items_of(text: str) -> tuple[list[str], int]:
    """The distinct items of a text, and the number of its words."""
    words = [w.lower() for w in WORD.findall(text)]
    if not words:
        return [], 0
    out = set(words)
    mean = sum(map(len, words)) / len(words)
    sentences = max(1, len(_SENTENCE.findall(text)))
    out |= {f"#letters {round(mean * 2)}", f"#sentence {min(20, len(words) // sentences // 3)}", f"#long {round(10 * sum(len(w) > 8 for w in words) / len(words))}"}
    return sorted(out), len(words)


def is_english(text: str, known: float) -> bool:
    """By function words, or, where there are hardly any, by the share `known` of words that the rated English mails have."""
    words = [w.lower() for w in WORD.findall(text)]
    latin = sum(w.isascii() for w in words)
    if not words or latin < 0.7 * len(words):
        return False
    ours, theirs = sum(w in _ENGLISH for w in words), sum(w in _FOREIGN for w in words)
    if ours > 1.5 * theirs and ours >= 0.08 * len(words):
        return True
    return known >= 0.4 and theirs <= max(ours, 0.05 * len(words))


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, rating): the mean over raters of a mail; a rater's repeated ratings, however the name is spelt, count once by
    their mean. Null ratings and those outside 1..5 don't count."""
    ok = labels.where("doc_id is not null and reading_level between 1 and 5")
    who = F.regexp_replace(F.lower(F.coalesce("rater", F.lit(""))), "[^a-z0-9]", "")
    once = ok.groupBy("doc_id", who.alias("who")).agg(F.avg("reading_level").alias("level"))
    return once.groupBy("doc_id").agg(F.avg("level").alias("rating"))


def length_class(n: int) -> int:
    return min(LENGTHS - 1, round(2 * math.log2(max(1, n))))


def _shift() -> np.ndarray:
    """ln(n / 100) of each class of lengths."""
    return np.log(2.0 ** (np.arange(LENGTHS) / 2) / 100)


def _rated_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, marks, lengths, items = [], [], [], []
        for i, rating, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, auto = own_text(text)
            found, n = items_of(own)
            if not auto and n >= WORDS:
                ids += [i] * len(found)
                marks += [rating] * len(found)
                lengths += [length_class(n)] * len(found)
                items += found
        cols = [pa.array(ids, pa.int64()), pa.array(marks, pa.float64()), pa.array(lengths, pa.int32()), pa.array(items, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rating", "length", "item"])


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit_items(n: np.ndarray, total: np.ndarray, mails: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """beta and lambda of items that stand in n mails whose levels less 3 add up to `total`, by Newton steps. mails: how many
    there are at each (level of GRID, class of lengths)."""
    at = np.argwhere(mails > 0)
    m, x, shift = mails[at[:, 0], at[:, 1]], GRID[at[:, 0]] - 3, _shift()[at[:, 1]]
    beta, slope, common = np.full(len(n), RARE), np.zeros(len(n)), COMMON * m.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(beta[:, None] + slope[:, None] * x + shift)))
        w = m * p * (1 - p)
        g0, g1 = n - p @ m - (beta - RARE) / common, total - p @ (m * x) - slope / STEEP
        h00, h01, h11 = w.sum(1) + 1 / common, w @ x, w @ (x * x) + 1 / STEEP
        det = h00 * h11 - h01 * h01
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        beta, slope = beta + np.clip(d0, -2, 2), slope + np.clip(d1, -1, 1)
        if max(np.abs(d0).max(initial=0.0), np.abs(d1).max(initial=0.0)) < 1e-4:
            break
    return beta, slope


def absent(beta: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """For each level and class of lengths the sum of -ln(1 - P) over the items."""
    out = np.zeros((len(GRID), LENGTHS))
    for j, shift in enumerate(_shift()):
        for a in range(0, len(beta), 4096):
            b, s = beta[a : a + 4096, None], slope[a : a + 4096, None]
            out[:, j] += _softplus(b + s * (GRID - 3) + shift).sum(0)
    return out


def best_level(pull: np.ndarray, length: np.ndarray, none: np.ndarray, rating: np.ndarray | None = None) -> np.ndarray:
    """Levels of greatest penalised likelihood, between the grid's by a parabola. pull: sum of lambda over a mail's items."""
    value = pull[:, None] * (GRID - 3) - none.T[length]
    value -= (HOLD * (GRID - rating[:, None]) ** 2 if rating is not None else LOOSE * (GRID - 3) ** 2) / 2
    i = np.clip(value.argmax(1), 1, len(GRID) - 2)
    a, b, c = (value[np.arange(len(i)), i + k] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    return GRID[i] + np.clip(np.where(bend < 0, (a - c) / (2 * np.where(bend < 0, bend, 1)), 0), -0.5, 0.5) * (GRID[1] - GRID[0])


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, rated: int = RATED) -> dict:
    """Parameters of the items, sums of the absent ones, and the cuts between levels. Without usable ratings there is no model
    ({}). Raises if the levels still move after `rounds`."""
    spark = docs.sparkSession
    marks = ratings(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rated)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id")  # at most `rated` rows
    pairs = cut(texts.select("doc_id", "rating", "text").mapInArrow(_rated_items, "doc_id bigint, rating double, length int, item string"))
    kept = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN).select("item", F.xxhash64("item").alias("key"))
    pairs = cut(pairs.join(kept, "item").select("doc_id", "rating", "length", "key"))
    kept = cut(kept)
    theta = pairs.groupBy("doc_id").agg(F.first("rating").alias("rating"), F.first("length").alias("length"), F.first("rating").alias("theta"))
    step = float(GRID[1] - GRID[0])
    for i in range(rounds + 1):
        theta = cut(theta)
        level = F.round(F.col("theta") / step).cast("int").alias("level")
        counted = theta.groupBy(level, "length").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each level of the grid and class of lengths
        if not counted:
            return {}
        mails = np.zeros((len(GRID), LENGTHS))
        for r in counted:
            mails[r["level"], r["length"]] = r["n"]
        at = pairs.select("doc_id", "key").join(F.broadcast(theta.select("doc_id", level)), "doc_id")  # at most `rated` rows
        sums = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.sum("level") * step - 3 * F.count(F.lit(1))).alias("total"))
        items = cut(sums.mapInArrow(_fitted(mails), "key bigint, beta double, slope double"))
        none = sum((np.frombuffer(bytes(r["none"])) for r in items.select("beta", "slope").mapInArrow(_absent_sums, "none binary").collect()), np.zeros(len(GRID) * LENGTHS)).reshape(len(GRID), LENGTHS)  # a row for each task
        pull = pairs.join(items.select("key", "slope"), "key").groupBy("doc_id").agg(F.first("rating").alias("rating"), F.first("length").alias("length"), F.sum("slope").alias("pull"))
        new = cut(pull.mapInArrow(_placed(none), "doc_id bigint, rating double, length int, theta double, free double"))
        moved = new.join(theta.select("doc_id", F.col("theta").alias("_was")), "doc_id").agg(F.avg(F.abs(F.col("theta") - F.col("_was")))).first()[0]
        theta = new.drop("free")
        if moved <= MOVE:
            break
        if i == rounds:
            raise RuntimeError(f"levels still move by {moved} after {rounds} rounds")
    done = new.select("rating", "free").toPandas()  # at most `rated` rows
    slopes = {r["item"]: r["slope"] for r in kept.join(items, "key").select("item", "slope").collect()}  # items of at most `rated` mails
    return {"items": slopes, "none": none, "cuts": [_cut_at(done["free"].to_numpy(), done["rating"].to_numpy(), c) for c in (1.5, 2.5, 3.5, 4.5)]}


def _fitted(mails: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                beta, slope = fit_items(part.column(1).to_numpy(), part.column(2).to_numpy(), mails)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(beta), pa.array(slope)], ["key", "beta", "slope"])

    return run


def _absent_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(GRID), LENGTHS))
    for batch in batches:
        total += absent(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["none"])


def _placed(none: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rating, length, pull = (batch.column(i).to_numpy() for i in (1, 2, 3))
            theta, free = best_level(pull, length, none, rating), best_level(pull, length, none)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(theta), pa.array(free)], ["doc_id", "rating", "length", "theta", "free"])

    return run


def _cut_at(free: np.ndarray, rating: np.ndarray, limit: float) -> float:
    """The estimate above which ratings are mostly over the limit: of the values with fewest errors the middle one."""
    o = np.argsort(free, kind="stable")
    x, over = free[o], rating[o] > limit
    wrong = np.r_[0, np.cumsum(over)] + np.r_[np.cumsum(~over[::-1])[::-1], 0]
    best = np.flatnonzero(wrong == wrong.min())
    i = int(best[len(best) // 2])
    if i == 0:
        return float(x[0] - 1e-9) if len(x) else limit
    return float(x[-1] + 1e-9) if i == len(x) else float((x[i - 1] + x[i]) / 2)


def place(text: str, model: dict) -> tuple[float | None, int | None, int, bool]:
    """(theta, level, words, english) of an own text. Fewer than WORDS words, or no known item: no level."""
    items, n = items_of(text)
    known = model.get("items", {})
    hits = [known[i] for i in items if i in known]
    words = [i for i in items if i[0] != "#"]
    english = is_english(text, sum(i in known for i in words) / max(1, len(words)))
    if n < WORDS or not english or not hits:
        return None, None, n, english
    theta = float(best_level(np.array([sum(hits)]), np.array([length_class(n)]), model["none"])[0])
    return theta, 1 + sum(theta > c for c in model["cuts"]), n, english


def reading_levels(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, source if there is one, theta, level, n_words, english, automatic) of each mail. theta and level are null for mails without a level:
    automatic reports, fewer than WORDS own words, other languages, null and empty texts."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # the items of at most RATED mails

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = cloudpickle.loads(sent.value)
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                own, auto = own_text(text)
                theta, level, n, english = place(own, own_model)
                rows.append((None, None, n, english, auto) if auto else (theta, level, n, english, auto))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*batch.schema.names[:-1], "theta", "level", "n_words", "english", "automatic"])

    keep = [c for c in ("doc_id", "source") if c in docs.columns]
    kinds_of = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds_of}, theta double, level int, n_words int, english boolean, automatic boolean")


def q_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return reading_levels(docs, fit(docs, spark.read.parquet(f"{d}/reading_labels.parquet")))


def q_found(spark: SparkSession, d: str) -> DataFrame:
    return q_levels(spark, d).where("level >= 4").select("doc_id")


def q_profile(spark: SparkSession, d: str) -> DataFrame:
    """Mails of each archive by level."""
    return q_levels(spark, d).groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))


QUERIES = {"p8_found": q_found, "p8_levels": q_levels, "p8_profile": q_profile}
ORACLES: dict = {}
