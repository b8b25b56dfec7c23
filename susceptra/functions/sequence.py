"""Column functions on nucleotide text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """PR40."""
    return F.reverse(F.translate(s, "ACGTN", "TGCAN"))


def circular_slice(s: Column, start: Column, length: Column) -> Column:
    """PR41: length code points from start on, around the end; longer than the text raises."""
    n = F.length(s)
    fits = F.assert_true(length <= n, "a slice longer than its circle").isNull()
    return F.when(fits, F.substring(F.concat(s, s), F.pmod(start, n) + 1, length))


def count_of(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def gc_percent(s: Column) -> Column:
    """PR39: over A, C, G, T only; 0 where there are none."""
    gc = count_of(s, "G") + count_of(s, "C")
    every = gc + count_of(s, "A") + count_of(s, "T")
    return F.when(every > 0, 100.0 * gc / every).otherwise(0.0)


def wrap(s: Column, width: int = 80) -> Column:
    """SK4: a line feed after each full width but the last."""
    return F.regexp_replace(s, "(.{%d})(?=.)" % width, "$1\n")
