"""Headline metrics and the analyst and dashboard queries over the marts."""

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.money import exact_sum
from subledger.operators.marts import active_subscription, average_ltv, by_subscription


def _first_of_one_row(df: DataFrame) -> Column:
    return df.select(F.struct("*")).scalar()


def source_counts(
    orders: DataFrame, payments: DataFrame, order_items: DataFrame, cycles: DataFrame
) -> DataFrame:
    """(metric, value) rows; each table is counted on its own."""
    counted = {
        "real_orders": orders.agg(F.count("*").alias("value")),
        "real_payment_records": payments.agg(F.count("*").alias("value")),
        "real_order_items": order_items.agg(F.count("*").alias("value")),
        "synthetic_subscribers": cycles.agg(F.count_distinct("subscription_id").alias("value")),
        "synthetic_billing_cycles": cycles.agg(F.count("*").alias("value")),
    }
    parts = [df.select(F.lit(name).alias("metric"), "value") for name, df in counted.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def cohort_retained_left(cycles: DataFrame, target_cycle: int = m.RETENTION_CYCLE) -> DataFrame:
    """Cohort size per segment and how many of them are active in the target cycle.

    One pass: both counts come out of the same distinct count per segment and
    cycle.  A segment nobody of which lasted keeps a row with 0.
    """
    active = (
        cycles.filter(F.col("cycle_number").isin(1, target_cycle) & (F.col("renewed") == 1))
        .groupBy("value_segment", "cycle_number")
        .agg(F.count_distinct(active_subscription()).alias("active"))
    )

    def in_cycle(k: int) -> Column:
        return F.max(F.when(F.col("cycle_number") == k, F.col("active")))

    return (
        active.groupBy("value_segment")
        .agg(
            in_cycle(1).alias("cohort_size"),
            F.coalesce(in_cycle(target_cycle), F.lit(0)).alias("retained_subscribers"),
        )
        .filter("cohort_size > 0")
    )


def segment_retention_at(cycles: DataFrame, target_cycle: int = m.RETENTION_CYCLE) -> DataFrame:
    """Unrounded retention per segment at the target cycle."""
    return cohort_retained_left(cycles, target_cycle).withColumn(
        "retention_rate", F.col("retained_subscribers") / F.col("cohort_size")
    )


def eligible_segments(segments: DataFrame, min_cohort: int = m.MIN_COHORT_SIZE) -> DataFrame:
    """Segments large enough to compare."""
    return segments.filter(F.col("cohort_size") >= min_cohort)


def retention_spread(segments: DataFrame) -> DataFrame:
    """Best and worst segment and their distance in percentage points.

    Fewer than two segments cannot be compared and fail the query.  Among equal
    rates the segment that sorts first wins, at both ends.
    """
    rate, segment = F.col("retention_rate"), F.col("value_segment")
    found = segments.agg(
        F.count("*").alias("segments"),
        F.min(F.struct((-rate).alias("minus_rate"), segment)).alias("best"),
        F.min(F.struct(rate, segment)).alias("worst"),
    )
    too_few = F.raise_error(F.lit("fewer than two eligible segments")).cast("bigint")
    best, worst = -F.col("best.minus_rate"), F.col("worst.retention_rate")
    return found.select(
        F.when(F.col("segments") >= 2, F.col("segments")).otherwise(too_few).alias("customer_segments"),
        F.bround((best - worst) * 100, 1).alias("retention_variance_pct_points"),
        F.col("best.value_segment").alias("best_segment"),
        F.bround(best * 100, 1).alias("best_segment_retention_pct"),
        F.col("worst.value_segment").alias("worst_segment"),
        F.bround(worst * 100, 1).alias("worst_segment_retention_pct"),
    )


def retention_spread_of_mart(
    segment_mart: DataFrame, target_cycle: int = m.RETENTION_CYCLE
) -> DataFrame:
    """The analyst's version: over the rounded rates of the mart."""
    rate = F.col("retention_rate")
    return cycle_segments(segment_mart, target_cycle).agg(
        F.max(rate).alias("highest_retention"),
        F.min(rate).alias("lowest_retention"),
        ((F.max(rate) - F.min(rate)) * 100).alias("spread_percentage_points"),
    )


def churn_rate(cycles: DataFrame) -> DataFrame:
    return by_subscription(cycles).agg(F.avg("churned").alias("churn_rate"))


def avg_ltv(cycles: DataFrame) -> DataFrame:
    return by_subscription(cycles).agg(average_ltv().alias("avg_ltv_brl"))


def summary_metrics(
    raw: Mapping[str, DataFrame],
    cycles: DataFrame,
    min_cohort: int = m.MIN_COHORT_SIZE,
    target_cycle: int = m.RETENTION_CYCLE,
) -> DataFrame:
    """The fourteen-field metric record as one row.

    ``cycles`` is read twice, so pass a written table.
    """
    subscriptions = by_subscription(cycles).agg(
        F.count("subscription_id").alias("synthetic_subscribers"),
        F.coalesce(F.sum("cycle_rows"), F.lit(0)).alias("synthetic_billing_cycles"),
        F.avg("churned").alias("churn"),
        average_ltv().alias("ltv"),
    )
    spread = retention_spread(
        eligible_segments(segment_retention_at(cycles, target_cycle), min_cohort)
    )

    def rows_of(name: str) -> Column:
        return raw[name].agg(F.count("*")).scalar()

    return subscriptions.withColumn("s", _first_of_one_row(spread)).select(
        rows_of("orders").alias("real_orders"),
        rows_of("payments").alias("real_payment_records"),
        rows_of("order_items").alias("real_order_items"),
        "synthetic_subscribers",
        "synthetic_billing_cycles",
        "s.customer_segments",
        F.lit(target_cycle).alias("retention_cycle"),
        "s.retention_variance_pct_points",
        "s.best_segment",
        "s.best_segment_retention_pct",
        "s.worst_segment",
        "s.worst_segment_retention_pct",
        F.bround(F.col("churn") * 100, 1).alias("synthetic_churn_rate_pct"),
        F.bround("ltv", 2).alias("synthetic_avg_ltv_brl"),
    )


def cycle_segments(segment_mart: DataFrame, target_cycle: int = m.RETENTION_CYCLE) -> DataFrame:
    return segment_mart.filter(F.col("cycle_number") == target_cycle).select(
        "value_segment", "retention_rate"
    )


def segment_curve(segment_mart: DataFrame) -> DataFrame:
    return segment_mart.select(
        "value_segment", "cycle_number", "cohort_size", "retained_subscribers", "retention_rate"
    ).orderBy("value_segment", "cycle_number")


def cohort_curve_all(cohort_mart: DataFrame) -> DataFrame:
    return cohort_mart.select(
        "cohort_month", "cycle_number", "cohort_size", "retained_subscribers", "retention_rate"
    ).orderBy("cohort_month", "cycle_number")


def cohort_months(cohort_mart: DataFrame) -> DataFrame:
    """Cohorts to choose from, latest first."""
    return cohort_mart.select("cohort_month").distinct().orderBy(F.desc("cohort_month"))


def cohort_curve(cohort_mart: DataFrame, month: date | None = None) -> DataFrame:
    """One cohort's retention by cycle; the latest cohort unless a month is given."""
    chosen = F.lit(month) if month else cohort_mart.agg(F.max("cohort_month")).scalar()
    return (
        cohort_mart.filter(F.col("cohort_month") == chosen)
        .select("cycle_number", "retention_rate")
        .orderBy("cycle_number")
    )


def kpi_snapshot(kpi_mart: DataFrame) -> DataFrame:
    return kpi_mart.select("*")


def segment_retention_pivot(
    segment_mart: DataFrame, segments: Sequence[str] = tuple(m.VALUE_SEGMENTS)
) -> DataFrame:
    """Cycles down, segments across: the named ones, then any others there are, by name.

    A segment without a name is none.  ``segment_mart`` is read twice, so pass a written table.
    """
    label = F.col("value_segment")
    others = segment_mart.filter(label.isNotNull() & ~label.isin(*segments)).select(label).distinct()
    # one row a segment, of which there are few: each becomes a column
    columns = [*segments, *sorted(r.value_segment for r in others.collect())]
    return (
        segment_mart.groupBy("cycle_number").pivot("value_segment", columns).agg(F.max("retention_rate"))
    )


def monthly_revenue_vs_spend(efficiency_mart: DataFrame) -> DataFrame:
    return (
        efficiency_mart.groupBy("month")
        .agg(
            exact_sum("observed_revenue_brl").alias("observed_revenue_brl"),
            exact_sum("marketing_spend_brl").alias("mock_marketing_spend_brl"),
        )
        .orderBy("month")
    )


def metrics_long(metrics: DataFrame, prefix: str) -> DataFrame:
    """(metric, <prefix>_value, <prefix>_label) rows of a one-row metric record."""
    numbers = [c for c, t in metrics.dtypes if t != "string"]
    labels = [c for c, t in metrics.dtypes if t == "string"]
    pairs = [
        F.struct(
            F.lit(c).alias("metric"),
            (F.col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("value"),
            (F.col(c) if c in labels else F.lit(None).cast("string")).alias("label"),
        )
        for c in metrics.columns
    ]
    return metrics.select(F.explode(F.array(*pairs)).alias("p")).select(
        "p.metric",
        F.col("p.value").alias(f"{prefix}_value"),
        F.col("p.label").alias(f"{prefix}_label"),
    )


def metrics_crosscheck(pipeline: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Two metric records side by side, with the difference and whether they agree (0/1)."""
    ours, theirs = metrics_long(pipeline, "pipeline"), metrics_long(recomputed, "crosscheck")
    same = F.col("pipeline_value").eqNullSafe(F.col("crosscheck_value")) & F.col(
        "pipeline_label"
    ).eqNullSafe(F.col("crosscheck_label"))
    return ours.join(theirs, "metric", "full").select(
        "*",
        (F.col("crosscheck_value") - F.col("pipeline_value")).alias("difference"),
        same.cast("int").alias("agrees"),
    )
