"""Model-derived sources: marketing spend per month, state and channel; catalog attributes.

Both are ordinary tables downstream, so real spend or catalog data of the same
layout can take their place.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.hashing import unit_interval


def month_state_channel_spine(
    states: DataFrame, first_month: Column, last_month: Column, channels: Mapping[str, int]
) -> DataFrame:
    """Every month from first to last × state × channel, with the channel's base spend.

    ``states`` has one ``customer_state`` row per state.  Months and channels are
    expanded from arrays inside each row, so nothing is shuffled.
    """
    base = F.create_map(*[F.lit(x) for item in channels.items() for x in item])
    months = F.sequence(
        F.trunc(first_month, "MM"), F.trunc(last_month, "MM"), F.expr("interval 1 month")
    )
    return states.select("customer_state", F.explode(months).alias("month")).select(
        "month", "customer_state", F.explode(base).alias("channel", "base_spend")
    )


def standard_spine(spark: SparkSession) -> DataFrame:
    """The spine over the model's own months, states and channels."""
    states = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in m.SPEND_STATES])).alias("customer_state")
    )
    return month_state_channel_spine(
        states,
        F.to_date(F.lit(m.SPEND_FIRST_MONTH)),
        F.to_date(F.lit(m.SPEND_LAST_MONTH)),
        m.CHANNEL_BASE_SPEND,
    )


def marketing_spend(spine: DataFrame) -> DataFrame:
    """Spend, impressions and clicks, fixed by the hash of month, state and channel."""
    u = F.col("u")
    share = F.lit(m.SPEND_FLOOR_SHARE) + F.lit(m.SPEND_RANDOM_SHARE) * u
    draw = unit_interval(F.col("month"), F.col("customer_state"), F.col("channel"))
    return spine.withColumn("u", draw).select(
        "month",
        "customer_state",
        "channel",
        F.bround(F.col("base_spend") * share, 2).alias("spend_brl"),
        (m.IMPRESSIONS_FLOOR + m.IMPRESSIONS_RANDOM * u).cast("bigint").alias("impressions"),
        (m.CLICKS_FLOOR + m.CLICKS_RANDOM * u).cast("bigint").alias("clicks"),
    )


def catalog_tiers(products: DataFrame) -> DataFrame:
    """Tier, subscription eligibility and margin band per product."""
    u = F.col("u")
    tier = (
        F.when(u > m.TIER_PREMIUM_ABOVE, "premium")
        .when(u > m.TIER_STANDARD_ABOVE, "standard")
        .otherwise("value")
    )
    margin = (
        F.when(u > m.MARGIN_HIGH_ABOVE, "high").when(u > m.MARGIN_MID_ABOVE, "mid").otherwise("low")
    )
    return products.select(
        "product_id", unit_interval(F.col("product_id"), F.lit(m.TAG_CATALOG)).alias("u")
    ).select(
        "product_id",
        tier.alias("catalog_tier"),
        (u > m.ELIGIBLE_ABOVE).cast("int").alias("subscription_eligible"),
        margin.alias("margin_band"),
    )
