"""Person grain: purchase features over delivered orders."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.money import added_parts, amount_in
from subledger.operators.orders import (
    DAY_IN_MICROS,
    delivered_orders,
    folded_orders,
    orders_customers,
    orders_payments_left,
    whole_days_between,
)

DAY_KEY = ("customer_unique_id", "customer_state", "day")


def _delay(elapsed: bool) -> tuple[Column, float]:
    """Late delivery of one order as a whole number, and how many of those make a day."""
    due = F.col("order_estimated_delivery_date").cast("timestamp")
    arrived = F.col("order_delivered_customer_date").cast("timestamp")
    late = F.unix_micros(arrived) - F.unix_micros(due) if elapsed else F.datediff(arrived, due)
    return F.greatest(F.coalesce(late, F.lit(0)), F.lit(0)).cast("bigint"), (
        float(DAY_IN_MICROS) if elapsed else 1.0
    )


def customer_features(
    orders: DataFrame, customers: DataFrame, payments: DataFrame, elapsed: bool = False
) -> DataFrame:
    """Purchase features of every person with a delivered order.

    ``elapsed`` counts gaps in whole 24-hour units and delays in fractions of a day
    instead of midnights crossed.
    """
    paid = orders_payments_left(orders_customers(delivered_orders(orders), customers), payments)
    return features_of_days(customer_days(paid, elapsed), elapsed)


def customer_days(paid: DataFrame, elapsed: bool = False) -> DataFrame:
    """Delivered orders folded to one row per person, state and active day.

    That fold starts before the shuffle and uses fixed-width buffers only, so a person with a
    third of all orders arrives as at most one row per state and day.  Its rows add up again,
    see ``merged_days``.  Of the orders only delivered ones count.
    """
    day = F.to_date("order_purchase_timestamp").alias("day")
    return folded_orders(delivered_orders(paid), "customer_state", day, delay=_delay(elapsed)[0])


def merged_days(*states: DataFrame) -> DataFrame:
    """The days of all orders from those of parts of them, however the orders were parted.

    Every row of an order id must be in the same part, as ids are counted there.
    """
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    sums = [c for c in rows.columns if c not in {*DAY_KEY, "opening", "closing"}]
    return rows.groupBy(*DAY_KEY).agg(
        F.min("opening").alias("opening"),
        F.max("closing").alias("closing"),
        *[F.sum(c).alias(c) for c in sums],
    )


def features_of_days(days: DataFrame, elapsed: bool = False) -> DataFrame:
    """The look-back and the median run over a person's active days, sorted, after one shuffle.

    A positive gap can only open a day, hence nothing is lost.  The state is that of the
    earliest order with one.
    """
    delay_units_per_day = _delay(elapsed)[1]
    before = W.partitionBy("customer_unique_id").orderBy("opening").rowsBetween(
        W.unboundedPreceding, -1
    )
    gap = whole_days_between(F.max("closing").over(before), F.col("opening"), elapsed)
    return (
        _with_home_state(days)
        .withColumn("gap_days", gap)
        .transform(_with_middle_gap)
        .groupBy("customer_unique_id", "home")
        .agg(
            F.to_date(F.min("opening")).alias("first_order_date"),
            F.sum("orders").alias("order_count"),
            F.sum("rows").alias("rows"),
            *[total.alias(part) for part, total in added_parts().items()],
            F.sum("delay").alias("delay"),
            F.avg("middle_gap").alias("observed_cadence_days"),
        )
        .select(
            "customer_unique_id",
            F.col("home").alias("customer_state"),
            "first_order_date",
            "order_count",
            (amount_in() / F.col("rows")).alias("avg_order_value"),
            amount_in().alias("total_spend"),
            (F.col("delay") / F.lit(delay_units_per_day) / F.col("rows")).alias(
                "avg_delivery_delay_days"
            ),
            "observed_cadence_days",
        )
    )


def _with_home_state(rows: DataFrame) -> DataFrame:
    """``home``: the state of the person's earliest row that has one."""
    history = W.partitionBy("customer_unique_id").orderBy("opening", "customer_state")
    whole = history.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("home", F.first("customer_state", ignorenulls=True).over(whole))


def _with_middle_gap(rows: DataFrame) -> DataFrame:
    """``middle_gap`` holds a person's one or two middle positive gaps; their mean is the median.

    Ranking sorts rows that already lie together, where a median aggregate would keep
    a value map per person.
    """
    person = W.partitionBy("customer_unique_id")
    positive = F.when(F.col("gap_days") > 0, F.col("gap_days"))
    return (
        rows.withColumn("positive", positive)
        .withColumn("rank", F.row_number().over(person.orderBy(F.asc_nulls_last("positive"))))
        .withColumn("gaps", F.count("positive").over(person))
        .withColumn(
            "middle_gap",
            F.when(F.expr("rank in ((gaps + 1) div 2, (gaps + 2) div 2)"), F.col("positive")),
        )
    )


def int_customer_features(order_facts: DataFrame) -> DataFrame:
    """Order count, revenue and state per person, from the order facts."""
    delivered = order_facts.filter(F.col("order_status") == m.DELIVERED)
    return (
        _with_home_state(folded_orders(delivered, "customer_state"))
        .groupBy("customer_unique_id", "home")
        .agg(
            F.to_date(F.min("opening")).alias("first_order_date"),
            F.sum("orders").alias("order_count"),
            F.sum("rows").alias("rows"),
            *[total.alias(part) for part, total in added_parts().items()],
        )
        .select(
            "customer_unique_id",
            F.col("home").alias("customer_state"),
            "first_order_date",
            "order_count",
            amount_in().alias("observed_revenue"),
            (amount_in() / F.col("rows")).alias("avg_order_value"),
        )
    )
