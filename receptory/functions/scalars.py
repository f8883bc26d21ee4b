"""Scalar functions over sequences, counts and labels, as built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The amino acids; a residue's bit is its place in this order.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: For each residue the bits of those with a BLOSUM62 score of 0 or more (fixed values, in the order above).
COMPATIBLE = [229411, 3, 43020, 59724, 788112, 34849, 550984, 132752, 59656, 132752, 140944, 125292, 4096, 60748, 26952, 108845, 231425, 198273, 786448, 786512]


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\f\r"))


def normalize_cdr3(x: Column) -> Column:
    """Trimmed and upper-cased; null unless made of amino acids only. Without patterns, as plans may repeat it for every test on the result."""
    clean = F.upper(trimmed(x))
    return F.when((clean != "") & (F.translate(clean, AMINO_ACIDS, "") == ""), clean)


def present(x: Column) -> Column:
    """Null for empty fields and NA."""
    clean = trimmed(x)
    return F.when((clean != "") & (clean != "NA"), clean)


def count_value(x: Column) -> Column:
    """Counts of 1 or more truncated to whole ones; anything else is 1."""
    number = trimmed(x).try_cast("double")
    return F.coalesce(F.when((number >= 1) & ~F.isnan(number), F.least(F.floor(number), F.lit(4294967295)).cast("long")), F.lit(1).cast("long"))


def is_working(cdr3: Column, least_length: int, require_cf: bool = True) -> Column:
    test = F.length(cdr3) >= least_length
    return test & cdr3.rlike("^C.*F$") if require_cf else test


def interior(cdr3: str, boundary: int) -> Column:
    return F.expr(f"substr({cdr3}, {boundary + 1}, length({cdr3}) - {2 * boundary})")


def condition(subject: Column) -> Column:
    """What follows the last colon; empty without one."""
    return F.when(F.instr(subject, ":") > 0, F.substring_index(subject, ":", -1)).otherwise("")


def residue_bit(residue: str) -> Column:
    return F.expr(f"shiftleft(1, instr('{AMINO_ACIDS}', {residue}) - 1)")


def residues_of(bits: str) -> Column:
    """The residues of a bit set, in order."""
    return F.expr(f"array_join(filter(transform(sequence(0, 19), i -> if(getbit({bits}, i) = 1, substr('{AMINO_ACIDS}', i + 1, 1), '')), x -> x <> ''), '')")


def residue_component(bit: str, bits: str) -> Column:
    """The set of residues of bits that bit reaches by steps between compatible residues."""
    table = f"array({', '.join(map(str, COMPATIBLE))})"
    step = f"aggregate(sequence(0, 19), c, (d, b) -> if(getbit(c, b) = 1, d | (element_at({table}, b + 1) & {bits}), d))"
    return F.expr(f"aggregate(sequence(1, 19), {bit}, (c, z) -> {step})")


def order_key(motif: str) -> Column:
    """Sorts motifs by length, then alphabet with the gap last."""
    return F.struct(F.length(motif), F.translate(F.col(motif), "%", "~"))


def masked_distance(a: str, b: str) -> Column:
    """Mismatches of two sequences of one length; null otherwise."""
    return F.expr(f"if(length({a}) = length({b}), aggregate(sequence(1, length({a})), 0, (n, i) -> n + if(substr({a}, i, 1) = substr({b}, i, 1), 0, 1)), null)")


@F.pandas_udf(DoubleType())
def round_2sig(p: pd.Series) -> pd.Series:
    """Two significant figures, exactly half-even; 0, NaN and infinities pass."""
    return p.map(lambda x: float("%.1e" % x) if x == x and x not in (0.0, float("inf"), float("-inf")) else x)


def round_1dp(x: Column) -> Column:
    """One decimal place, half away from zero."""
    return F.floor(F.abs(x) * 10 + 0.5) / 10 * F.signum(x)
