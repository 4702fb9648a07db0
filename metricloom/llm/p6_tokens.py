"""Token ids of a whole corpus under a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays instead of a regular expression.  Each code point gets a class (letter, number, white
space, other, end of text).  The splitting pattern is an automaton over these classes whose transition functions compose
associatively; as its state depends on the place in the current class run only, the scan comes down to run starts and
shifted comparisons over the array.  Slices between boundaries are grouped by a rolling hash (equality is then verified
symbol by symbol), each distinct slice is merged once, and merges are cached for the worker's life.

`token_offsets` gives the place of every token in its text, so that ids can be cut and decoded again.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of byte_bpe_50k as ranks: a line for each token, base64 and id. A parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Code points that are encoded at once, unless one text is longer.
BLOCK = 1 << 20
#: Merged slices that a worker keeps; beyond this the cache starts anew.
CACHE = 400_000

_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 4, 0
_SENTINEL = 0x110000
_BASE = 0xB5AD4ECEDA1CE2A9


def class_table() -> np.ndarray:
    """Class of every code point by general category; white space is the Unicode property White_Space."""
    from unicodedata import category

    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.full(_SENTINEL + 1, _OTHER, np.int8)
    for c in range(_SENTINEL):
        if (k := kinds.get(category(chr(c))[0])) is not None:
            table[c] = k
    for a, b in ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = _SPACE
    table[_SENTINEL] = _END
    return table


def slice_starts(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Boolean array of the positions where a slice starts. Every text in `codes` ends with the sentinel, itself a slice."""
    kind = table[codes]
    starts = np.empty(len(codes), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    runs = starts.copy()
    blank = codes == 32
    space = kind == _SPACE
    # a run after a plain blank begins with that blank
    joined = np.zeros(len(codes), bool)
    joined[1:] = runs[1:] & blank[:-1] & ~space[1:] & (kind[1:] != _END)
    starts &= ~joined
    # of white space before something else, the last symbol stands apart
    starts[:-1] |= space[:-1] & ~space[1:] & (kind[1:] != _END)
    # 's 't 'm 'd 're 've 'll where a slice starts with the apostrophe
    at = np.flatnonzero((codes == 39) & starts)
    if len(at):
        padded = np.concatenate([codes, np.full(3, _SENTINEL, codes.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        size = np.where(one, 2, np.where(two, 3, 0))
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        after = at + size
        inside = table[padded[after]] == _LETTER
        starts[after[inside]] = True
    return starts


def merge_slice(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a slice: of all neighbouring parts the pair of lowest rank is joined, the leftmost of equals first."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 40
    pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for long slices, with a heap over a linked list."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        end[i], after[i], alive[j] = e, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heappush(heap, (r, i, end[after[i]]))
        if (b := before[i]) >= 0 and (r := ranks.get(piece[b:e])) is not None:
            heappush(heap, (r, b, e))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Encoder:
    """Encodes blocks of texts; one for each worker and vocabulary."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}
        self.table = class_table()
        self.cache: dict[str, tuple[int, ...]] = {}
        rng = np.random.default_rng(7)
        self.value = rng.integers(0, 1 << 63, _SENTINEL + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            steps = np.full(n, _BASE, np.uint64)
            steps[0] = 1
            self.power = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.inverse = np.multiply.accumulate(steps)

    def slices(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The texts joined, their code points, the slices' starts (and the end), the slice at which each text starts."""
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = _SENTINEL
        starts = np.append(np.flatnonzero(slice_starts(codes, self.table)), len(codes))
        return joined, codes, starts, np.searchsorted(starts, np.r_[0, ends[:-1] + 1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin (one more than texts), and the number of ids of each slice."""
        joined, codes, starts, first = self.slices(texts)
        at, size = starts[:-1], np.diff(starts)
        self._powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.value[codes] * self.power[: len(codes)], out=sums[1:])
        hashed = (sums[starts[1:]] - sums[at]) * self.inverse[at]
        _, index, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        shift = np.repeat(at[index][inverse] - at, size)
        if (size[index][inverse] != size).any() or (codes[np.arange(len(codes)) + shift] != codes).any():
            index, inverse = np.arange(len(at)), np.arange(len(at))  # two slices with one hash: each on its own
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = []
        for a, b in zip(at[index].tolist(), starts[index + 1].tolist(), strict=True):
            piece = joined[a:b]
            ids = self.cache.get(piece)
            if ids is None:
                ids = self.cache[piece] = merge_slice(piece.encode("utf-8", "surrogatepass"), self.ranks)
            found.append(ids)
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
        ends = np.append(first[1:], len(at)) - 1  # the sentinels' slices
        count = n[inverse]
        count[ends] = 0
        total = np.cumsum(count)
        source = (np.cumsum(n) - n)[inverse]
        ids = flat[np.arange(total[-1]) + np.repeat(source - (total - count), count)]
        return ids, np.r_[0, total[ends]], count


def encoder(raw: bytes) -> Encoder:
    kept = sys.__dict__.setdefault("_metricloom_encoders", {})
    key = hash(raw)
    if key not in kept:
        kept[key] = Encoder(raw)
    return kept[key]


def blocks(texts: list[str | None], most: int = BLOCK) -> Iterator[list[str]]:
    """Null counts as empty."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1]) + 1
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _ids(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids, offsets, _ = enc.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), lists], ["id", "ids"])
                done += len(texts)

    return run


def _counts(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            n = [np.diff(enc.encode(texts)[1]) for texts in blocks(batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(n) if n else [], pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB


def token_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the ids of each text, without special tokens; their strings are ordinary text. An empty and a null text
    both have an empty list; ids may repeat or be null, each row gives one row. No shuffle."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).mapInArrow(_ids(_vocabulary(df.sparkSession, vocabulary)), f"id {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`keep` and n_tokens of each row; null and empty texts have 0."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).alias("_txt")).mapInArrow(_counts(_vocabulary(df.sparkSession, vocabulary)), f"{fields}, n_tokens bigint")


def token_offsets(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids, starts, n_bytes): the ids, at which byte of the text (in UTF-8) each token starts, and the bytes of the text.
    Ids a to b - 1 decode to the bytes from starts[a] up to starts[b]. Null and empty texts have empty lists."""
    raw = _vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        size = np.zeros(max(enc.ranks.values()) + 1, np.int64)
        size[list(enc.ranks.values())] = [len(w) for w in enc.ranks]
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(1).to_pylist()):
                ids, offsets, _ = enc.encode(texts)
                total = np.r_[0, np.cumsum(size[ids])]
                starts = total[:-1] - np.repeat(total[offsets[:-1]], np.diff(offsets))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, starts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), *lists, pa.array(np.diff(total[offsets]))], ["id", "ids", "starts", "n_bytes"])
                done += len(texts)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, n_bytes bigint")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the bytes of the ids, joined. Null and empty lists give an empty text; bytes that are no UTF-8, as when a
    list was cut inside a character, give U+FFFD."""
    raw = _vocabulary(df.sparkSession, vocabulary)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = {v: k for k, v in encoder(raw.value).ranks.items()}
        for batch in batches:
            texts = [b"".join(map(word.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def q_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def q_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Of each document whether its tokens start in order from its first byte, and the bytes that they cover."""
    at = token_offsets(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    rising = F.aggregate("starts", F.lit(-1), lambda a, x: F.when((a >= -1) & (x > a), x).otherwise(-2)) >= -1
    return at.select(F.col("id").alias("doc_id"), (rising & (F.coalesce(F.get("starts", F.lit(0)), F.lit(0)) == 0)).alias("in_order"), "n_bytes")


def q_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The decoded ids of each document against its text."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    ids = token_ids(docs, "doc_id", "text")
    back = decode_ids(ids, "id", "ids").withColumnRenamed("text", "decoded")
    return back.join(docs, back["id"] == docs["doc_id"]).select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


QUERIES = {"p6_ids": q_ids, "p6_roundtrip": q_roundtrip, "p6_offsets": q_offsets}
ORACLES = {
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p6_offsets": "SELECT doc_id, true AS in_order, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents",
}
