"""Features and retention kept up to date by batches, without reading earlier ones again."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from subledger.operators import bitmaps
from subledger.operators import customers as person
from subledger.operators.orders import delivered_orders, orders_customers, orders_payments_left
from subledger.sources.shared_folder import replaced


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What all batches so far have left; None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_features(
    spark: SparkSession,
    path: str,
    orders: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    elapsed: bool = False,
) -> DataFrame:
    """Add a batch of orders to the person-days kept under ``path``; all features from them.

    A batch brings whole orders: all rows of an order id and all its payments.  It may bring
    them late, for days and people that are there already.  ``elapsed`` must be the same in
    every batch.  The days are swapped in once they are written, so a batch that failed can be
    given again.
    """
    paid = orders_payments_left(orders_customers(delivered_orders(orders), customers), payments)
    days, before = person.customer_days(paid, elapsed), stored(spark, path)
    if before is not None:
        days = person.merged_days(before, days)
    return person.features_of_days(replaced(days, path), elapsed)


def update_retention(
    spark: SparkSession, root: str, cycles: DataFrame, keys: tuple[str, ...] = ("value_segment", "cohort_month")
) -> dict[str, DataFrame]:
    """Add a batch of billing cycles to the bitmaps kept under ``root``; the retention marts by key.

    Batches may repeat and overlap, and a subscription may go on over several.  Its cohort is
    the month of the first bill of the batch that first has it.  Numbers are written before
    the bits that use them, so a batch that failed can be given again.
    """
    numbers = f"{root}/numbers"
    known = replaced(bitmaps.numbered(cycles, stored(spark, numbers)), numbers)
    marts = {}
    for key in keys:
        path = f"{root}/active_by_{key}"
        bits, before = bitmaps.active_bits(cycles, known, key), stored(spark, path)
        if before is not None:
            bits = bitmaps.laid_over(before, bits)
        marts[key] = bitmaps.retention_of_bits(replaced(bits, path), key)
    return marts
