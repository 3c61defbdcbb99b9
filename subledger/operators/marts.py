"""Marts over the billing cycles and over observed revenue and spend."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.money import exact_parts, exact_sum, exact_sum_of_parts, known


def active_subscription() -> Column:
    """The subscription id on rows of an active cycle, else NULL."""
    return F.when(F.col("renewed") == 1, F.col("subscription_id"))


def by_subscription(cycles: DataFrame) -> DataFrame:
    """One row per subscription; the input of every recurring-revenue figure."""
    return cycles.groupBy("subscription_id").agg(
        F.count("*").alias("cycle_rows"),
        F.max("cycle_number").alias("cycles_observed"),
        *[total.alias(part) for part, total in exact_parts("billing_amount", "ltv").items()],
        F.max("churned_this_cycle").alias("churned"),
    )


def average_ltv() -> Column:
    """The mean over subscriptions that were billed; aggregates rows of ``by_subscription``."""
    return exact_sum_of_parts("ltv") / F.count_if(known("ltv"))


def mart_subscription_kpis(cycles: DataFrame) -> DataFrame:
    subscriptions = F.count("*")
    return by_subscription(cycles).agg(
        subscriptions.alias("synthetic_subscribers"),
        F.count_if(F.col("churned") == 0).alias("active_subscriptions"),
        F.round(F.avg("churned"), 4).alias("churn_rate"),
        F.round(average_ltv(), 2).alias("avg_ltv_brl"),
        F.round(exact_sum_of_parts("ltv"), 2).alias("synthetic_recurring_revenue_brl"),
        F.round(F.avg("cycles_observed"), 2).alias("avg_cycles_observed"),
    )


def mart_customer_ltv(cycles: DataFrame) -> DataFrame:
    """Lifetime value per subscription; its segment is the smallest label it carries."""
    return cycles.groupBy("subscription_id", "customer_unique_id").agg(
        F.min("value_segment").alias("value_segment"),
        exact_sum("billing_amount").alias("synthetic_ltv_brl"),
        F.sum("renewed").alias("active_cycles"),
        F.max("churned_this_cycle").alias("churned"),
    )


def with_cohort_month(cycles: DataFrame) -> DataFrame:
    """Every cycle row with the month of its subscription's first bill."""
    first_bill = F.min("billing_date").over(W.partitionBy("subscription_id"))
    return cycles.withColumn("cohort_month", F.trunc(first_bill, "MM"))


def by_cycle(cycles: DataFrame) -> DataFrame:
    """One row per subscription and cycle, however many copies there are."""
    return cycles.groupBy("subscription_id", "cycle_number").agg(
        F.min("billing_date").alias("billing_date"), F.max("renewed").alias("renewed")
    )


def cohort_sizes(cycles: DataFrame, key: str) -> DataFrame:
    """Subscriptions active in cycle 1, per cohort key."""
    return (
        cycles.filter((F.col("cycle_number") == 1) & (F.col("renewed") == 1))
        .groupBy(key)
        .agg(F.count_distinct("subscription_id").alias("cohort_size"))
    )


def cycles_cohort_inner(cycles: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Every cycle row with the size of its cohort.

    ``sizes`` should be a written table: its file size then decides between
    broadcasting it and a shuffled join.
    """
    return cycles.join(sizes, key, "inner")


def retention(cycles: DataFrame, key: str) -> DataFrame:
    """Retained subscriptions per cohort key and cycle, against the cohort's size.

    The cohort size is the retained count of cycle 1, so it is read off the
    aggregated rows instead of scanning and joining the cycles a second time.
    Keys without an active first cycle have no cohort and drop out.
    """
    per_cycle = (
        cycles.filter(F.col(key).isNotNull())
        .groupBy(key, "cycle_number")
        .agg(F.count_distinct(active_subscription()).alias("retained_subscribers"))
    )
    return rates_of(per_cycle, key)


def rates_of(per_cycle: DataFrame, key: str) -> DataFrame:
    """Counts per cohort key and cycle against those of cycle 1."""
    first_cycle = F.when(F.col("cycle_number") == 1, F.col("retained_subscribers"))
    size = F.max(first_cycle).over(W.partitionBy(key))
    return (
        per_cycle.withColumn("cohort_size", size)
        .filter("cohort_size > 0")
        .select(
            key,
            "cycle_number",
            "cohort_size",
            "retained_subscribers",
            F.round(F.col("retained_subscribers") / F.col("cohort_size"), 4).alias("retention_rate"),
        )
    )


def mart_segment_retention(cycles: DataFrame) -> DataFrame:
    return retention(cycles, "value_segment")


def mart_cohort_retention(cycles: DataFrame) -> DataFrame:
    return retention(with_cohort_month(by_cycle(cycles)), "cohort_month")


def revenue_by_month_state(order_facts: DataFrame) -> DataFrame:
    return (
        order_facts.filter(F.col("order_status") == m.DELIVERED)
        .groupBy(F.col("order_month").alias("month"), "customer_state")
        .agg(
            exact_sum("payment_value").alias("observed_revenue_brl"),
            F.count_distinct("order_id").alias("orders"),
        )
    )


def spend_by_month_state(spend: DataFrame) -> DataFrame:
    return spend.groupBy("month", "customer_state").agg(
        exact_sum("spend_brl").alias("marketing_spend_brl")
    )


def revenue_spend_full_outer(revenue: DataFrame, spend: DataFrame) -> DataFrame:
    """Both sides kept, the missing one as zero; both are already aggregated."""
    return revenue.join(spend, ["month", "customer_state"], "full").select(
        "month",
        "customer_state",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("observed_revenue_brl", F.lit(0.0)).alias("observed_revenue_brl"),
        F.coalesce("marketing_spend_brl", F.lit(0.0)).alias("marketing_spend_brl"),
    )


def mart_marketing_efficiency(order_facts: DataFrame, spend: DataFrame) -> DataFrame:
    """Revenue against spend; the return is NULL where nothing was spent."""
    revenue, cost = F.col("observed_revenue_brl"), F.col("marketing_spend_brl")
    return revenue_spend_full_outer(
        revenue_by_month_state(order_facts), spend_by_month_state(spend)
    ).select(
        "month",
        "customer_state",
        "orders",
        F.round(revenue, 2).alias("observed_revenue_brl"),
        F.round(cost, 2).alias("marketing_spend_brl"),
        F.round(F.try_divide(revenue, cost), 3).alias("modeled_roas"),
    )
