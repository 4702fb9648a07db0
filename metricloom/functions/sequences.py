"""Sequences over biological alphabets: symbol codes, substitution weights, fragments."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nucleotide symbols in the order of their codes, each with the bases it may stand for.
NUCLEOTIDES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "W": "AT", "S": "CG",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
DNA_SYMBOLS = "".join(NUCLEOTIDES)
RNA_SYMBOLS = DNA_SYMBOLS.replace("T", "U")
# Amino acids in the order of their codes; any other symbol has the next code.
PEPTIDE_SYMBOLS = "ARNDCQEGHILKMFPSTWYV"
# Weights of an amino acid (R, N, D, ... V) against each before it (A, R, N, ...); 7 against any other symbol.
PEPTIDE_WEIGHTS = (
    (2,),  # R
    (2, 2),  # N
    (2, 2, 2),  # D
    (3, 4, 4, 4),  # C
    (2, 2, 2, 2, 4),  # Q
    (2, 2, 2, 2, 4, 2),  # E
    (2, 2, 2, 2, 3, 2, 2),  # G
    (2, 2, 2, 2, 4, 2, 2, 2),  # H
    (2, 3, 3, 3, 3, 3, 3, 2, 3),  # I
    (2, 3, 3, 3, 4, 3, 3, 3, 3, 1),  # L
    (2, 2, 2, 2, 4, 2, 2, 2, 2, 3, 3),  # K
    (2, 2, 2, 3, 4, 2, 3, 2, 3, 2, 1, 2),  # M
    (3, 4, 4, 4, 4, 4, 4, 4, 3, 2, 2, 4, 2),  # F
    (2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 3, 2, 2, 4),  # P
    (2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 3, 2, 2, 3, 2),  # S
    (2, 2, 2, 2, 3, 2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 2),  # T
    (5, 4, 5, 6, 7, 5, 6, 6, 5, 5, 4, 4, 4, 3, 5, 5, 5),  # W
    (4, 4, 4, 4, 3, 4, 4, 4, 3, 3, 2, 4, 3, 1, 4, 4, 3, 4),  # Y
    (2, 3, 2, 2, 3, 3, 2, 2, 3, 2, 1, 3, 2, 2, 2, 2, 2, 5, 3),  # V
)
PEPTIDE_OTHER = 7.0


@dataclass(frozen=True)
class WeightMatrix:
    """Weights of pairs of symbols; equal symbols weigh 0, pairs that are not listed `other`."""

    name: str
    weights: tuple[tuple[str, float], ...]
    other: float = 1.0

    def weight(self, a: str, b: str) -> float:
        return 0.0 if a == b else dict(self.weights).get(a + b, self.other)

    def column(self) -> Column:
        """Map literal from two symbols to their weight."""
        return F.create_map(*[F.lit(x) for x in chain.from_iterable(self.weights)]) if self.weights else F.create_map(F.lit(""), F.lit(0.0))


def _nucleotide_weights(symbols: str, thymine: str) -> tuple[tuple[str, float], ...]:
    bases = {s: set(NUCLEOTIDES["T" if s == thymine else s]) for s in symbols}
    return tuple((a + b, 0.5 if bases[a] & bases[b] else 1.0) for a, b in product(symbols, symbols) if a != b)


def _peptide_weights() -> tuple[tuple[str, float], ...]:
    rows = PEPTIDE_WEIGHTS
    half = {(PEPTIDE_SYMBOLS[i], PEPTIDE_SYMBOLS[j]): float(w) for i, row in enumerate(rows, 1) for j, w in enumerate(row)}
    return tuple((a + b, w) for (x, y), w in half.items() for a, b in ((x, y), (y, x)))


#: Symbols that may stand for a common base weigh a half, others 1.
DNA_MATRIX = WeightMatrix("dna", _nucleotide_weights(DNA_SYMBOLS, "T"))
DNA_SIMPLE = WeightMatrix("dna_simple", tuple((a + b, 1.0) for a, b in product("ACGT", "ACGT") if a != b))
#: Transitions between the first pairs weigh two thirds.
DNA_WEIGHTED = WeightMatrix("dna_weighted", tuple((a + b, 1.0 if {a, b} == {"G", "T"} else 0.6667) for a, b in product("ACGT", "ACGT") if a != b))
RNA_MATRIX = WeightMatrix("rna", tuple((a + b, 1.0) for a, b in product("ACGU", "ACGU") if a != b))
PEPTIDE_MATRIX = WeightMatrix("peptide", _peptide_weights(), PEPTIDE_OTHER)


def symbol_codes(seq: Column, symbols: str) -> Column:
    """Array of symbol codes; a symbol outside the alphabet has the code len(symbols)."""
    code = F.create_map(*[F.lit(x) for x in chain.from_iterable((s, i) for i, s in enumerate(symbols))])
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda s: s != ""), lambda s: F.coalesce(F.element_at(code, s), F.lit(len(symbols))))


def fragments(df: DataFrame, id_col: str, seq_col: str, length: int, include_last: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., seq_id, offset, frag): every window of `length` symbols, step 1. Without include_last the last window is left
    out. Null sequences and those that are too short have none."""
    if length < 1:
        raise ValueError("length must be positive")
    last = F.length(seq_col) - length - (0 if include_last else 1)
    at = df.where(last >= 0).select(*keep, F.col(id_col).alias("seq_id"), F.col(seq_col).alias("_seq"), F.explode(F.sequence(F.lit(0), last)).alias("offset"))
    return at.select(*keep, "seq_id", "offset", F.substring("_seq", F.col("offset") + 1, F.lit(length)).alias("frag"))
