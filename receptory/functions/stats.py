"""Exact tests and multiple-testing corrections as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from receptory.functions.scalars import round_2sig


def ln_factorial(n: str) -> str:
    """ln n! as SQL: exact up to 20, then Stirling's series."""
    x = f"cast({n} as double)"
    return f"(case when {n} < 0 then cast('NaN' as double) when {n} <= 20 then ln(cast(factorial(cast(least({n}, 20) as int)) as double)) else {x} * ln({x}) - {x} + 0.5 * ln(2 * pi() * {x}) + 1 / (12 * {x}) - 1 / (360 * {x} * {x} * {x}) + 1 / (1260 * pow({x}, 5)) end)"


def ln_choose(n: str, k: str) -> str:
    return f"({ln_factorial(n)} - {ln_factorial(k)} - {ln_factorial(f'({n} - {k})')})"


def hypergeom_upper(x: str, m: str, n: str, k: str) -> Column:
    """P(X >= x) of k draws from m marked and n others, for long expressions.

    Sums terms by their ratios, from x up, or below the mean one less the sum
    from x - 1 down; twelve standard deviations and 64 terms bound the sums.
    """
    mean = f"(cast({k} as double) * {m} / ({m} + {n}))"
    sd = f"sqrt({mean} * {n} / greatest({m} + {n}, 1) * ({m} + {n} - {k}) / greatest({m} + {n} - 1, 1))"
    cap = f"cast(ceil(12 * {sd}) + 64 as bigint)"
    point = lambda i: f"exp({ln_choose(m, i)} + {ln_choose(n, f'({k} - {i})')} - {ln_choose(f'({m} + {n})', k)})"
    up = f"aggregate(sequence({x}, least({k}, {m}, {x} + {cap})), named_struct('s', 0D, 't', {point(x)}), (_acc, _i) -> named_struct('s', _acc.s + _acc.t, 't', _acc.t * ({m} - _i) * ({k} - _i) / ((_i + 1D) * ({n} - {k} + _i + 1))), _acc -> _acc.s)"
    low = f"greatest(0, {k} - {n}, {x} - 1 - {cap})"
    down = f"aggregate(sequence({x} - 1, {low}, -1), named_struct('s', 0D, 't', {point(f'({x} - 1)')}), (_acc, _i) -> named_struct('s', _acc.s + _acc.t, 't', _acc.t * _i * ({n} - {k} + _i) / (({m} - _i + 1D) * ({k} - _i + 1D))), _acc -> 1 - _acc.s)"
    return F.expr(
        f"case when {m} < 0 or {n} < 0 or {k} < 0 then cast('NaN' as double) when {x} <= 0 then 1D when {k} > {m} + {n} or {x} > least({k}, {m}) then 0D "
        f"when {x} <= greatest(0, {k} - {n}) then 1D when {x} > {mean} then least(1D, {up}) else greatest(0D, least(1D, {down})) end"
    )


def fisher_greater(a: str, b: str, c: str, d: str) -> Column:
    """One-sided exact test of a 2x2 table for a greater a."""
    return hypergeom_upper(a, f"({a} + {c})", f"({b} + {d})", f"({a} + {b})")


def with_upper_tail(rows: DataFrame, name: str, x: str, m: str, n: str, k: str, rounded: bool = False) -> DataFrame:
    """rows with the tail of columns x, m, n, k, to two figures if asked; it is worked out once for each combination that occurs."""
    keys = rows.select(F.expr(x).cast("long").alias("_x"), F.expr(m).cast("long").alias("_m"), F.expr(n).cast("long").alias("_n"), F.expr(k).cast("long").alias("_k")).distinct()
    tails = keys.withColumn(name, hypergeom_upper("_x", "_m", "_n", "_k"))
    if rounded:
        tails = tails.withColumn(name, round_2sig(name))
    on = (F.expr(x) == F.col("_x")) & (F.expr(m) == F.col("_m")) & (F.expr(n) == F.col("_n")) & (F.expr(k) == F.col("_k"))
    return rows.join(tails, on, "left").drop("_x", "_m", "_n", "_k")


def benjamini_hochberg(rows: DataFrame, p: str, q: str, by: list[str] | None = None) -> DataFrame:
    """rows with q-values of column p within groups of by; null p are not tested and have none.

    Equal p have equal q, so ranks are taken over the distinct p with their counts.
    Both sums and least values run from the largest p down: a window up to the
    last row would be gone through anew for every row.
    """
    if not by:
        return benjamini_hochberg(rows.withColumn("_all", F.lit(1)), p, q, ["_all"]).drop("_all")
    each = rows.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_c"))
    total = each.groupBy(*by).agg(F.sum("_c").alias("_total"))
    w = Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("_from", F.sum("_c").over(w))
    each = each.join(total, by).withColumn("_rank", F.col("_total") - F.col("_from") + F.col("_c"))
    each = each.withColumn("_value", F.col(p) * F.col("_total") / F.col("_rank"))
    each = each.withColumn(q, F.least(F.lit(1.0), F.min("_value").over(w))).select(*by, p, q)
    return rows.join(each, [*by, p], "left")


def poisson_upper(k: str, rate: str) -> Column:
    """P(X >= k) for a Poisson rate, as one less the sum of the terms below k, so what is under 1e-16 may be 0.

    The terms are taken relative to that of k, up and down by their ratios: the
    first one, exp(-rate), is 0 in floats from a rate of 746 on. Terms beyond
    twelve standard deviations and 64 of k and the mean do not count in floats,
    and no tail differs from 0 or 1 at forty and 400.
    """
    sd = f"sqrt({rate})"
    up = f"aggregate(sequence(cast({k} as bigint), cast(greatest({k}, {rate} + 12 * {sd} + 64) as bigint) + cast(12 * {sd} + 64 as bigint)), named_struct('s', 0D, 't', 1D), (_acc, _i) -> named_struct('s', _acc.s + _acc.t, 't', _acc.t * {rate} / (_i + 1)), _acc -> _acc.s)"
    low = f"cast(greatest(0, least({k}, {rate}) - 12 * {sd} - 64) as bigint)"
    down = f"aggregate(sequence(cast({k} - 1 as bigint), least({low}, cast({k} - 1 as bigint)), -1), named_struct('s', 0D, 't', {k} / {rate}), (_acc, _i) -> named_struct('s', _acc.s + _acc.t, 't', _acc.t * _i / {rate}), _acc -> _acc.s)"
    return F.expr(f"case when {k} <= 0 then 1D when {rate} <= 0 or {k} > {rate} + 40 * {sd} + 400 then 0D when {k} < {rate} - 40 * {sd} - 400 then 1D else 1 - 1 / (1 + {up} / {down}) end")


def odds_ratio(a: str, b: str, c: str, d: str) -> Column:
    """With 0.5 added to every cell."""
    return F.expr(f"(({a} + 0.5D) * ({d} + 0.5D)) / (({b} + 0.5D) * ({c} + 0.5D))")
