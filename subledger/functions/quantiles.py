"""Exact quantiles of a column of doubles too large for one aggregation buffer.

The built-in ``percentile`` keeps one map of all distinct values in a single
reducer.  Spend totals are nearly all distinct, so that map grows with the number
of customers.  Here the wanted ranks are narrowed down by levels of sixteen bits of an
integer that sorts as the doubles do: every level counts the values within the slices that
hold a wanted rank, by their next bits, so a level yields at most 2**16 counts per slice,
whatever the amounts.  Four levels cover all 64 bits.  The first starts at the bits in which
the least and the greatest value differ, and a slice of few values is settled at once, so
amounts of ordinary size need two.

NaN and NULL are no values: they take no part.
"""

import struct
from collections.abc import Sequence
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVEL_BITS = 16
FEW = 1 << LEVEL_BITS  # values of a slice that are all told apart at the next level
MAGNITUDE = (1 << 63) - 1


def order_keys(df: DataFrame, column: str) -> DataFrame:
    """``v``: for each value an integer that sorts as the doubles do; -0.0 counts as 0.0."""
    number = F.col(column).cast("double") + F.lit(0.0)
    known = df.select(number.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    as_bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("x"))
    bits = F.col("bits")
    # bit patterns of negative numbers grow with their magnitude: turned round
    key = F.when(bits < 0, bits.bitwiseXOR(F.lit(MAGNITUDE))).otherwise(bits)
    return known.select(as_bits.cast("bigint").alias("bits")).select(key.alias("v"))


def value_of(key: int) -> float:
    bits = key ^ MAGNITUDE if key < 0 else key
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """One row ``q1, q2, …``: linearly interpolated quantiles; NULL when there is no value.

    ``df`` is scanned once per level and once for the range, so hand in a written table
    rather than a long lineage.
    """
    keys = order_keys(df, column)
    low, high, total = keys.agg(F.min("v"), F.max("v"), F.count("v")).first()
    places = [(total - 1) * p for p in probabilities]
    at = _keys_at(keys, low, high, total, {f(x) for x in places for f in (floor, ceil)}) if total else {}
    row = []
    for place in places:
        if not total:
            row.append(None)
            continue
        below, above = (value_of(at[f(place)]) for f in (floor, ceil))
        row.append(below if below == above else below + (above - below) * (place - floor(place)))
    constants = [F.lit(value).cast("double").alias(f"q{i}") for i, value in enumerate(row, start=1)]
    return df.sparkSession.range(1).select(*constants)


def _keys_at(keys: DataFrame, low: int, high: int, total: int, ranks: set[int]) -> dict[int, int]:
    """The key at each rank, counted from 0; one row per rank and level comes back.

    A prefix is a key without its last ``bits`` bits; of each open prefix it is known how many
    keys come before it and how many it has.
    """
    bits = 63 if low < 0 <= high else (low ^ high).bit_length()
    found = {rank: (low >> bits, 0, total) for rank in ranks}
    if low < 0 <= high:  # the sign comes first
        negative = keys.filter("v < 0").count()
        found = {r: (-1, 0, negative) if r < negative else (0, negative, total - negative) for r in ranks}
    while bits:
        step = bits if all(n <= FEW for _, _, n in found.values()) else min(LEVEL_BITS, bits)
        prefixes = sorted({prefix for prefix, _, _ in found.values()})
        inside = keys.filter(F.shiftright("v", bits).isin(prefixes))
        bits -= step
        counts = inside.groupBy(F.shiftright("v", bits).alias("part")).agg(F.count("*").alias("n"))
        # at most 2**16 counts in a window
        through = F.sum("n").over(W.partitionBy("prefix").orderBy("part"))
        counts = counts.withColumn("prefix", F.shiftright("part", step)).withColumn("through", through)
        wanted = [
            (F.col("prefix") == prefix)
            & (F.col("through") > rank - before)
            & (F.col("through") - F.col("n") <= rank - before)
            for rank, (prefix, before, _) in found.items()
        ]
        hits = counts.filter(reduce(or_, wanted)).select("prefix", "part", "n", "through").collect()
        found = {
            rank: next(
                (hit.part, before + hit.through - hit.n, hit.n)
                for hit in hits
                if hit.prefix == prefix and hit.through - hit.n <= rank - before < hit.through
            )
            for rank, (prefix, before, _) in found.items()
        }
    return {rank: prefix for rank, (prefix, _, _) in found.items()}
