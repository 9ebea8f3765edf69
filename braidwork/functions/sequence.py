"""Sequences and other strings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements; other letters stay as they are.
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(sequence: Column | str) -> Column:
    """Reverse complement."""
    return F.reverse(F.translate(column(sequence), BASES, COMPLEMENTS))


def oriented(sequence: Column | str, rev: Column | str) -> Column:
    """The sequence of a handle: forward or reverse."""
    return F.when(column(rev), revcomp(sequence)).otherwise(column(sequence))


def subsequence(sequence: Column | str, start: Column | str, size: Column | str) -> Column:
    """`size` bases from the 0-based `start` on."""
    return F.substring(column(sequence), (column(start) + 1).cast("int"), column(size).cast("int"))


def _counted(n: int) -> None:
    if n < 1:
        raise ValueError("instances are counted from 1")


def find_nth(text: Column | str, char: str, n: int) -> Column:
    """0-based place of the n-th `char`, or -1."""
    _counted(n)
    head = F.substring_index(column(text), char, n)
    return F.when(F.length(head) < F.length(column(text)), F.length(head)).otherwise(-1).cast("int")


def find_nth_from_back(text: Column | str, char: str, n: int) -> Column:
    """0-based place of the n-th `char` from the end, or -1."""
    _counted(n)
    text = column(text)
    tail = F.substring_index(text, char, -n)
    return F.when(F.length(tail) < F.length(text), F.length(text) - F.length(tail) - 1).otherwise(-1).cast("int")


def trim_to_nth(text: Column | str, char: str, n: int) -> Column:
    """What stands up to and including the n-th `char`; null where there is none."""
    at = find_nth(text, char, n)
    return F.when(at >= 0, F.left(column(text), at + 1))


def trim_to_nth_from_back(text: Column | str, char: str, n: int) -> Column:
    """What stands up to and including the n-th `char` from the end; null where there is none."""
    at = find_nth_from_back(text, char, n)
    return F.when(at >= 0, F.left(column(text), at + 1))


def parent_path(path: Column | str, levels: int = 1) -> Column:
    """A path without its last `levels` parts."""
    return F.regexp_replace(column(path), f"(/[^/]*){{{levels}}}$", "")


def join_paths(*parts: Column | str) -> Column:
    """Parts joined by single slashes."""
    joined = F.concat_ws("/", *map(column, parts))
    return F.regexp_replace(joined, "/{2,}", "/")


def find_pattern(pattern: Column | str, text: Column | str) -> Column:
    """0-based place of the first occurrence, or -1."""
    return (F.call_function("locate", column(pattern), column(text)) - 1).cast("int")


def trimmed(sequence: Column | str, flank: int = 26, filler: str = "GGGGGGGG") -> Column:
    """Sequences over twice the flank, cut to both flanks around a filler."""
    s = column(sequence)
    return F.when(F.length(s) > 2 * flank, F.concat(F.left(s, F.lit(flank)), F.lit(filler), F.right(s, F.lit(flank)))).otherwise(s)
