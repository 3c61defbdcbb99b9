"""Distinct counts of subscriptions that add up over batches.

Every subscription has a number, given once, without gaps.  Which subscriptions are active in a
cycle is then a bit each, 32,768 to a bitmap, and a count over any batches is that of their
bitmaps laid over each other.  Numbers follow the shuffle by subscription, so a task's rows
fall into neighbouring bitmaps, and only bitmaps go through the last shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subledger.operators.marts import rates_of
from subledger.sources.shared_folder import staged

ID = "subscription_id"
WITHIN = (1 << 33) - 1  # the part of a monotonically increasing id that counts rows of a partition


def numbered(cycles: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """subscription_id, number, cohort_month: known subscriptions as they are, new ones after them.

    The month is that of the first bill when a subscription is first seen.  Rows without a
    subscription id count for nothing.
    """
    first_month = F.trunc(F.min("billing_date"), "MM").alias("cohort_month")
    found = cycles.filter(F.col(ID).isNotNull()).groupBy(ID).agg(first_month)
    start = F.lit(0).cast("bigint")
    if known is not None:
        found = found.join(known, ID, "left_anti")
        start = known.select(F.coalesce(F.max("number"), F.lit(0))).scalar()
    # written, as the place of a row is fixed only then
    found = staged(found.withColumn("place", F.monotonically_increasing_id()), "new_subscriptions")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit(WITHIN))
    sizes = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row a partition
    earlier = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    new = found.withColumn("part", part).join(sizes, "part").select(
        ID, (start + F.col("earlier") + within + 1).alias("number"), "cohort_month"
    )
    return new if known is None else known.select(*new.columns).unionByName(new)


def active_bits(cycles: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """key, cycle_number, bucket, bits: a bit for each subscription active in that cycle.

    ``key`` is a column of the cycles or of the numbers.  Cycles that nobody is active in keep
    a row, with no bit set.
    """
    rows = cycles.select(*{ID, "cycle_number", "renewed", *({key} & set(cycles.columns))})
    known = numbers.select(*{ID, "number", *({key} - set(cycles.columns))})
    active = F.when(F.col("renewed") == 1, F.bitmap_bit_position("number"))
    return (
        rows.join(known, ID)
        .filter(F.col(key).isNotNull())
        .groupBy(key, "cycle_number", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(F.bitmap_construct_agg(active).alias("bits"))
    )


def laid_over(*states: DataFrame) -> DataFrame:
    """The bits that are set in any of the states."""
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    keys = [c for c in rows.columns if c != "bits"]
    return rows.groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))


def retention_of_bits(state: DataFrame, key: str) -> DataFrame:
    """The retention mart over ``key``, from bits alone."""
    counted = F.sum(F.bitmap_count("bits")).alias("retained_subscribers")
    return rates_of(state.groupBy(key, "cycle_number").agg(counted), key)
