"""Bitmaps of bounded size, kept as small tables and joined by broadcast, for filters made of built-in functions only.

A bitmap of 2**BITS bits says of a value "surely not in the set" or "perhaps".
It only spares rows a shuffle; an exact join always follows.  However many
values there are, it has at most 2**BITS / 64 rows of two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receptory.llm.common import stored

BITS = 24


def _place(column: str) -> str:
    return f"shiftrightunsigned(xxhash64({column}), {64 - BITS})"


def bitmap(values: DataFrame, column: str) -> DataFrame:
    """(word, bits) of a column of long values."""
    bits = values.selectExpr(f"cast(shiftright({_place(column)}, 6) as int) as word", f"shiftleft(1L, cast({_place(column)} & 63 as int)) as bit")
    return stored(bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), "bitmap")


def marked(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """rows with a column perhaps: whether the bitmap has the value's bit."""
    held = F.broadcast(bits.withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits"))
    found = rows.join(held, F.expr(f"cast(shiftright({_place(column)}, 6) as int)") == F.col("_word"), "left")
    return found.withColumn("perhaps", F.expr(f"coalesce(getbit(_bits, cast({_place(column)} & 63 as int)) = 1, false)")).drop("_word", "_bits")


def within(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """The rows whose value may be in the set."""
    return marked(rows, column, bits).where("perhaps").drop("perhaps")
