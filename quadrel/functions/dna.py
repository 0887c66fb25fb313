"""Two-bit codes of DNA strings as native columns (at most 31 letters in a long)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"


def dna_to_twobit(dna: Column) -> Column:
    """A0 C1 G2 T3, most significant letter first; any other letter counts as A."""
    code = lambda c: F.greatest(F.instr(F.lit(LETTERS), c) - 1, F.lit(0))
    letters = F.filter(F.split(dna, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: acc * 4 + code(c))


def twobit_to_dna(code: Column, size: int) -> Column:
    """The string of ``size`` letters that a code stands for."""
    letter = lambda i: F.element_at(F.array(*[F.lit(x) for x in LETTERS]), (F.shiftright(code, 2 * i).bitwiseAND(3) + 1).cast("int"))
    return F.concat(*[letter(i) for i in reversed(range(size))])


def twobit_neighbours(code: Column, size: int) -> Column:
    """The 3 * size codes in which one letter differs: by place from the left, then letter."""
    out = []
    for i in reversed(range(size)):
        cleared = code.bitwiseAND(F.lit(~(3 << (2 * i))).cast("long"))
        out += [cleared.bitwiseOR(F.lit(x << (2 * i)).cast("long")) for x in range(4)]
    return F.filter(F.array(*out), lambda c: c != code)


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))
