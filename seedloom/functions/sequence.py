"""Scalar functions over sequences, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: str) -> Column:
    return F.reverse(F.translate(F.col(seq), "ACGTN", "TGCAN"))


def normalised(text: str) -> Column:
    """Upper case, and N for every other character than a base."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", "N"))


def padded_slice(seq: str, offset: Column, n: int) -> Column:
    """``n`` bases from a 0-based offset, padded with N on the right; empty when the offset is beyond the end."""
    cut = F.rpad(F.substring(F.col(seq), offset + 1, F.lit(n)), n, "N")
    return F.when(offset >= F.length(seq), F.lit("")).otherwise(cut)


def prefix_distance(a: str, b: str) -> Column:
    """Edit distance anchored at the start, with free gaps at the end of either string."""
    of_b = f"array_min(transform(sequence(0, length({b})), j -> levenshtein({a}, substring({b}, 1, j))))"
    of_a = f"array_min(transform(sequence(0, length({a})), i -> levenshtein(substring({a}, 1, i), {b})))"
    return F.expr(f"least({of_b}, {of_a})")


def fitting_distance(seed: str, window: str) -> Column:
    """Least edit distance of the whole seed and any infix of the window."""
    ends = f"transform(sequence(0, length({window}) - i), n -> levenshtein({seed}, substring({window}, i + 1, n)))"
    return F.expr(f"array_min(transform(sequence(0, length({window})), i -> array_min({ends})))")


def banded_fitting_distance(seed: str, window: str, errors: int) -> Column:
    """As fitting_distance() where that is at most ``errors``, else ``errors`` + 1.

    Only infixes can come so near that have the seed's length, give or take ``errors``.
    """
    size = f"greatest(length({seed}) + d, 0)"
    begins = f"filter(sequence(0, length({window})), i -> i + {size} <= length({window}))"
    near = f"transform(sequence(-{errors}, {errors}), d -> transform({begins}, i -> levenshtein({seed}, substring({window}, i + 1, {size}), {errors})))"
    return F.expr(f"coalesce(array_min(filter(flatten({near}), x -> x >= 0)), {errors + 1})")


def chebyshev(a: str, b: str) -> Column:
    return F.expr(f"array_max(zip_with({a}, {b}, (x, y) -> abs(x - y)))")


def pure_shift(a: str, b: str, score: str) -> Column:
    """Whether one string is the other moved by ``score`` places."""
    return F.expr(
        f"startswith({a}, substring({b}, {score} + 1)) or startswith({b}, substring({a}, {score} + 1))"
    )


#: The bits of a relation of two labels (fixed values of the flag format).
LEFT_SUB, RIGHT_SUB, LEFT_SUP, RIGHT_SUP, BOTH_SUB, BOTH_SUP, LEFT_OVERLAP, RIGHT_OVERLAP = 1, 2, 4, 8, 16, 32, 64, 128


def _meets(a: str, b: str, threshold: int) -> str:
    """Whether a proper prefix of ``a`` ends ``b``, with ``a`` cut down to it base by base below the threshold."""
    cut = lambda n: f"left({a}, length({a}) - {n})"
    close = f"forall(sequence(1, k), j -> {cut('j')} != {b} and levenshtein({cut('j')}, {b}) < {threshold})"
    return f"{b} != '' and length({a}) > 1 and exists(sequence(1, length({a}) - 1), k -> endswith({b}, {cut('k')}) and {close})"


def relation_flags(v: str, u: str, threshold: int) -> Column:
    """How ``u`` is a trimmed, extended or shifted copy of ``v``; 0 for a neighbour that is none of these.

    For pairs at an edit distance below ``threshold``. An overlap counts only if every step of its shift stays below it.
    """
    rules = {
        LEFT_SUB: f"endswith({v}, {u})",
        RIGHT_SUB: f"startswith({v}, {u})",
        LEFT_SUP: f"endswith({u}, {v})",
        RIGHT_SUP: f"startswith({u}, {v})",
        BOTH_SUB: f"{u} != '' and contains(substring({v}, 2, length({v}) - 2), {u})",
        BOTH_SUP: f"{v} != '' and contains(substring({u}, 2, length({u}) - 2), {v})",
        LEFT_OVERLAP: _meets(v, u, threshold),
        RIGHT_OVERLAP: _meets(u, v, threshold),
    }
    return F.expr(" + ".join(f"if({rule}, {bit}, 0)" for bit, rule in rules.items()))


def flag_bit(units: Column, errors: Column) -> Column:
    """Place of a bit of the flag word: (units - 1) * units / 2 + errors, so the bits of each number of units lie together."""
    return ((units - 1) * units / 2).cast("int") + errors


def flag_word(units: str, repeated: str, first_fail: str) -> Column:
    """Aggregate of a position's rows, one for each number of units: whether it repeats, and its first failing errors.

    A repeat sets the first bit of its units; errors below the number of units set the bit that far from it.
    """
    n, e = F.col(units), F.col(first_fail)
    bit = lambda at: F.expr("1").cast("int") * F.pow(F.lit(2), at).cast("int")
    return F.bit_or(F.when(F.col(repeated), bit(flag_bit(n, F.lit(0))).bitwiseOR(F.when(e < n, bit(flag_bit(n, e))).otherwise(0))).otherwise(0))


def flag_errors(word: str, units: Column) -> Column:
    """First failing errors that a flag word holds for so many units: the lowest bit set beyond the first, else units."""
    bits = F.transform(F.sequence(F.lit(1), F.greatest(units - 1, F.lit(1))), lambda e: F.when((e < units) & (F.getbit(F.col(word), flag_bit(units, e)) == 1), e))
    return F.coalesce(F.array_min(bits), units)
