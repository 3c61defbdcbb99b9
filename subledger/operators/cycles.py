"""Modelled billing cycles of enrolled customers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.hashing import unit_interval
from subledger.functions.scores import billing_amount, renewal_score
from subledger.operators.profiles import PERSON, enrolled_customers, with_renewal_base


def _lapses(cycle: int) -> Column:
    draw = unit_interval(F.col(PERSON), F.lit(m.TAG_RENEW), F.lit(cycle))
    return F.when(~(draw < renewal_score(F.col("renewal_base"), F.lit(cycle))), F.lit(cycle))


def billing_cycles(profiles: DataFrame, max_cycles: int = m.MAX_CYCLES) -> DataFrame:
    """One row per subscription and cycle, up to and including the cycle that lapses.

    The lapsing cycle is the first one whose draw misses the renewal score; it is
    looked for in cycle order and the search stops there.  Each profile row turns
    into its cycles on the spot: no shuffle, and no Python beyond building the plan.
    """
    no_lapse = F.lit(None).cast("int")
    lapse = F.coalesce(*[_lapses(k) for k in range(2, max_cycles + 1)], no_lapse)
    cycle = F.col("cycle_number")
    renewed = F.col("lapse").isNull() | (cycle < F.col("lapse"))
    return (
        with_renewal_base(enrolled_customers(profiles))
        .select("*", lapse.alias("lapse"))
        .withColumn(
            "cycle_number",
            F.explode(F.sequence(F.lit(1), F.coalesce("lapse", F.lit(max_cycles)))),
        )
        .select(
            F.concat(F.lit(m.SUBSCRIPTION_PREFIX), F.col(PERSON)).alias("subscription_id"),
            "customer_unique_id",
            "cycle_number",
            F.date_add("first_order_date", F.col("cadence_days") * (cycle - 1)).alias("billing_date"),
            F.when(renewed, billing_amount(F.col("avg_order_value")))
            .otherwise(0.0)
            .alias("billing_amount"),
            renewed.cast("int").alias("renewed"),
            (~renewed).cast("int").alias("churned_this_cycle"),
            "customer_state",
            "value_segment",
            "cadence_days",
        )
    )


def cycle_anchor(cycles: DataFrame, cycle_number: int = 1) -> DataFrame:
    """Subscriptions active in the given cycle."""
    return cycles.filter((F.col("cycle_number") == cycle_number) & (F.col("renewed") == 1))
