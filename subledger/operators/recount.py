"""The metric record once more, by sorting, to check the first way by.

Nothing here is shared with ``operators.metrics``: subscriptions are told apart by looking at
the row before in sorted order instead of by distinct counts, amounts are added as decimals
instead of as pairs of longs, and the best and the worst segment are the ends of a sorted list.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subledger.functions import model_values as m


def _opens(*columns: str) -> Column:
    """1 on the first of equal rows in sorted order, else 0."""
    place = W.partitionBy(*columns).orderBy(*columns)
    return F.when(F.row_number().over(place) == 1, 1).otherwise(0)


def subscription_totals(cycles: DataFrame) -> DataFrame:
    """One row: subscriptions, rows, how many churned, and what they paid."""
    by_time = W.partitionBy("subscription_id").orderBy("cycle_number", "billing_date")
    through = by_time.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    amount = F.col("billing_amount")
    ordinary = F.when(F.abs(amount) < 1e17, amount).cast("decimal(28,10)")
    last = F.lead(F.lit(1)).over(by_time).isNull()
    ends = (
        cycles.select("subscription_id", "cycle_number", "billing_date", "churned_this_cycle", amount)
        .withColumns(
            {
                "ltv": F.sum(ordinary).over(through),
                "odd": F.sum(F.when(~(F.abs(amount) < 1e17), amount)).over(through),
                "lapsed": F.last(F.when(F.col("churned_this_cycle") == 1, 1), ignorenulls=True).over(through),
                "seen": F.row_number().over(by_time),
                "last": last,
            }
        )
        .filter("last")
    )
    paid = F.sum("ltv").cast("double")
    total = F.when(F.max("odd").isNull(), paid).otherwise(F.coalesce(paid, F.lit(0.0)) + F.sum("odd"))
    billed = F.sum(F.when(F.col("ltv").isNotNull() | F.col("odd").isNotNull(), 1))
    ids = F.sum(F.when(F.col("subscription_id").isNotNull(), 1).otherwise(0))
    return ends.agg(
        F.coalesce(ids, F.lit(0)).alias("subscribers"),
        F.coalesce(F.sum("seen"), F.lit(0)).cast("bigint").alias("rows"),
        (F.sum(F.coalesce("lapsed", F.lit(0))) / F.sum(F.lit(1))).alias("churn"),
        (total / billed).alias("ltv"),
    )


def segment_rates(cycles: DataFrame, target_cycle: int = m.RETENTION_CYCLE) -> DataFrame:
    """value_segment, cohort_size, retention_rate: subscriptions told apart in sorted order."""
    key = ("value_segment", "cycle_number", "subscription_id")
    active = cycles.filter("renewed = 1 and subscription_id is not null").select(*key)
    active = active.filter(F.col("cycle_number").isin(1, target_cycle)).withColumn("opens", _opens(*key))

    def met(k: int) -> Column:
        return F.sum(F.when(F.col("cycle_number") == k, F.col("opens")).otherwise(0))

    found = active.groupBy("value_segment").agg(met(1).alias("cohort_size"), met(target_cycle).alias("kept"))
    rate = (F.col("kept") / F.col("cohort_size")).alias("retention_rate")
    return found.filter("cohort_size > 0").select("value_segment", "cohort_size", rate)


def recounted_metrics(
    raw: Mapping[str, DataFrame],
    cycles: DataFrame,
    min_cohort: int = m.MIN_COHORT_SIZE,
    target_cycle: int = m.RETENTION_CYCLE,
) -> DataFrame:
    """The same fourteen fields as ``metrics.summary_metrics``."""
    rates = segment_rates(cycles, target_cycle).filter(F.col("cohort_size") >= min_cohort)
    # as many rows as there are segments
    best_first = F.sort_array(F.collect_list(F.struct((-F.col("retention_rate")).alias("r"), "value_segment")))
    worst_first = F.sort_array(F.collect_list(F.struct(F.col("retention_rate").alias("r"), "value_segment")))
    ends = rates.agg(best_first.alias("best"), worst_first.alias("worst"))
    best, worst = -F.expr("get(s.best, 0).r"), F.expr("get(s.worst, 0).r")
    too_few = F.raise_error(F.lit("fewer than two eligible segments")).cast("bigint")
    segments = F.size("s.best").cast("bigint")

    def rows_of(name: str) -> Column:
        return raw[name].agg(F.coalesce(F.sum(F.lit(1)), F.lit(0)).cast("bigint")).scalar()

    def percent(value: Column) -> Column:
        return F.bround(value * 100, 1)

    totals = subscription_totals(cycles).withColumn("s", ends.select(F.struct("*")).scalar())
    return totals.select(
        rows_of("orders").alias("real_orders"),
        rows_of("payments").alias("real_payment_records"),
        rows_of("order_items").alias("real_order_items"),
        F.col("subscribers").alias("synthetic_subscribers"),
        F.col("rows").alias("synthetic_billing_cycles"),
        F.when(segments >= 2, segments).otherwise(too_few).alias("customer_segments"),
        F.lit(target_cycle).alias("retention_cycle"),
        percent(best - worst).alias("retention_variance_pct_points"),
        F.expr("get(s.best, 0).value_segment").alias("best_segment"),
        percent(best).alias("best_segment_retention_pct"),
        F.expr("get(s.worst, 0).value_segment").alias("worst_segment"),
        percent(worst).alias("worst_segment_retention_pct"),
        percent(F.col("churn")).alias("synthetic_churn_rate_pct"),
        F.bround("ltv", 2).alias("synthetic_avg_ltv_brl"),
    )
