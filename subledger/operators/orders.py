"""Order grain: joins, pre-aggregated facts and gaps between a person's orders."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.money import exact_parts, exact_sum
from subledger.sources.shared_folder import staged

DAY_IN_MICROS = 86_400_000_000
COPY_CHUNK = 1 << 16


def delivered_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with a known purchase time."""
    return orders.filter(
        (F.col("order_status") == m.DELIVERED) & F.col("order_purchase_timestamp").isNotNull()
    )


def payments_by_order(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(exact_sum("payment_value").alias("payment_value"))


def items_by_order(order_items: DataFrame) -> DataFrame:
    return order_items.groupBy("order_id").agg(
        F.count("*").alias("item_count"),
        exact_sum("price").alias("item_revenue"),
        exact_sum("freight_value").alias("freight_value"),
    )


def orders_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the person and state behind their customer id.

    One customer id may hold a large share of all orders.  The result is never
    grouped by ``customer_id``, so adaptive execution is free to split such a
    partition and replicate the single matching customer row.
    """
    known = customers.select("customer_id", "customer_unique_id", "customer_state")
    return orders.join(known, "customer_id", "inner")


def orders_payments_left(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments are summed per order first, so no order is repeated; none paid counts as 0."""
    return orders.join(payments_by_order(payments), "order_id", "left").withColumn(
        "payment_value", F.coalesce("payment_value", F.lit(0.0))
    )


def orders_items_left(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    return orders.join(items_by_order(order_items), "order_id", "left").withColumns(
        {
            "item_count": F.coalesce("item_count", F.lit(0)),
            "item_revenue": F.coalesce("item_revenue", F.lit(0.0)),
            "freight_value": F.coalesce("freight_value", F.lit(0.0)),
        }
    )


def order_rows(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, order_items: DataFrame
) -> DataFrame:
    """Every order with its person, payments and items, and with its own columns.

    The customer join comes first: both later joins then share one shuffle of the
    orders on ``order_id``, which also serves distinct counts of orders downstream.
    """
    return orders_items_left(
        orders_payments_left(orders_customers(orders, customers), payments), order_items
    )


def int_order_facts(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, order_items: DataFrame
) -> DataFrame:
    """One row per order with its person, payments and items."""
    return facts_of_rows(order_rows(orders, customers, payments, order_items))


def facts_of_rows(rows: DataFrame) -> DataFrame:
    """The published columns of ``order_rows``."""
    return rows.select(
        "order_id",
        "customer_unique_id",
        "customer_state",
        "order_status",
        "order_purchase_timestamp",
        F.trunc("order_purchase_timestamp", "MM").alias("order_month"),
        "payment_value",
        "item_count",
        "item_revenue",
        "freight_value",
    )


def folded_orders(rows: DataFrame, *grain: Column | str, delay: Column | None = None) -> DataFrame:
    """Orders at ``grain`` with their times, number of rows, amounts and delay.

    ``orders`` counts distinct order ids: its sum at any coarser grain is exact.  To
    that end the rows are first folded per order id too, which also takes in copies
    of an order before they meet, and one row per (person, order id) is marked.  Rows
    out of the ``order_id`` joins already lie together, so neither step shuffles.
    """
    keys = [F.col(g) if isinstance(g, str) else g for g in grain]
    sums = {
        "rows": F.count("payment_value"),
        **exact_parts("payment_value"),
        "delay": F.sum(delay if delay is not None else F.lit(0)),
    }
    per_order = rows.groupBy("customer_unique_id", "order_id", *keys).agg(
        F.min("order_purchase_timestamp").alias("opening"),
        F.max("order_purchase_timestamp").alias("closing"),
        *[total.alias(name) for name, total in sums.items()],
    )
    repeats = W.partitionBy("order_id", "customer_unique_id").orderBy("opening")
    first = (F.row_number().over(repeats) == 1) & F.col("order_id").isNotNull()
    names = [c for c in per_order.columns if c not in {"order_id", "opening", "closing", *sums}]
    return (
        per_order.withColumn("counts_order", first.cast("bigint"))
        .groupBy(*names)
        .agg(
            F.min("opening").alias("opening"),
            F.max("closing").alias("closing"),
            F.sum("counts_order").alias("orders"),
            *[F.sum(name).alias(name) for name in sums],
        )
    )


def whole_days_between(earlier: Column, later: Column, elapsed: bool) -> Column:
    """Midnights crossed, or whole 24-hour units when ``elapsed``."""
    if not elapsed:
        return F.datediff(later, earlier)
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(DAY_IN_MICROS)).cast("int")


def order_gaps(
    rows: DataFrame,
    person: str = "customer_unique_id",
    order_id: str = "order_id",
    bought: str = "order_purchase_timestamp",
    elapsed: bool = False,
) -> DataFrame:
    """``gap_days`` since the person's previous order row; NULL on the first one.

    As a look-back over all rows of a person by time and order id gives it: a copy of an
    order follows 0 days after it, rows without a person are one person's, and a row
    without a time has no gap.

    Copies are counted first.  What is left is sorted over all tasks by person, time and id, so
    a person with very many orders, even at one moment, is spread over tasks.  Each task looks
    back inside its own stretch; only the first row of a stretch looks at the last row of the
    stretch before it, of which there is one a task.
    """
    copies = rows.groupBy(person, order_id, bought).agg(F.count("*").alias("copies"))
    stretches = sorted_stretches(copies, person, bought, order_id)
    before = look_back(stretches, [person, bought], [person, bought, order_id])
    same = F.col(f"before.{person}").eqNullSafe(F.col(person)) & F.col("before").isNotNull()
    gap = F.when(same, whole_days_between(F.col(f"before.{bought}"), F.col(bought), elapsed))
    first_gap = before.select(person, order_id, bought, "copies", gap.alias("first_gap"))
    # Copies come back in chunks, so that very many of one order are no large array.
    last_chunk = F.floor((F.col("copies") - 1) / F.lit(COPY_CHUNK))
    chunks = first_gap.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    size = F.least(F.lit(COPY_CHUNK), F.col("copies") - F.col("chunk") * COPY_CHUNK)
    each = chunks.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
    gap = F.when((F.col("chunk") == 0) & (F.col("copy") == 1), F.col("first_gap")).otherwise(0)
    return each.select(
        person, order_id, bought, F.when(F.col(bought).isNotNull(), gap).cast("int").alias("gap_days")
    )


def sorted_stretches(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with the number of their stretch of the order, written; stretches ascend.

    Rows equal in all of ``order`` lie in one stretch, so no two of them should be.
    """
    ranged = rows.repartitionByRange(*order).withColumn("stretch", F.spark_partition_id())
    return staged(ranged, "sorted_stretches")


def look_back(stretches: DataFrame, wanted: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``before``: the wanted columns of the row before in ``order``; NULL on the first of all."""
    within = W.partitionBy("stretch").orderBy(*order)
    ends = stretches.groupBy("stretch").agg(F.max(F.struct(*order)).alias("last"))
    # one row a stretch
    previous = F.lag("last").over(W.orderBy("stretch"))
    ends = ends.select("stretch", previous.alias("end_before"))
    inside = stretches.withColumn("before", F.lag(F.struct(*wanted)).over(within))
    opens = F.row_number().over(within) == 1
    joined = inside.withColumn("opens", opens).join(ends, "stretch", "left")
    from_end = F.when(F.col("end_before").isNotNull(), F.struct(*[F.col(f"end_before.{c}").alias(c) for c in wanted]))
    chosen = F.when(F.col("opens"), from_end).otherwise(F.col("before"))
    return joined.withColumn("before", chosen).drop("opens", "end_before", "stretch")
