"""Customer profiles: features plus the global thresholds they are compared with."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.functions.hashing import unit_interval
from subledger.functions.quantiles import exact_quantiles
from subledger.functions.scores import (
    bounded_cadence,
    enrollment_score,
    renewal_base,
    renewal_score,
    spend_signal,
)

PERSON = "customer_unique_id"


def stable_hash_split(df: DataFrame, *columns: str, out: str = "u") -> DataFrame:
    """Assign every row a fixed place in [0, 1) from the named columns."""
    return df.withColumn(out, unit_interval(*[F.col(c) for c in columns]))


def spend_quartiles(features: DataFrame) -> DataFrame:
    """One row q1, q2, q3 of total spend, exact."""
    return exact_quantiles(features, "total_spend", m.QUARTILES)


def fallback_cadence(features: DataFrame) -> DataFrame:
    """One row: the typical cadence, for people who have none of their own.

    Cadences are multiples of half a day, so the median's value map stays as small
    as the calendar, however many people there are.
    """
    observed = F.when(F.col("observed_cadence_days") > 0, F.col("observed_cadence_days"))
    typical = F.coalesce(F.bround(F.median(observed), 0), F.lit(float(m.CADENCE_DEFAULT_DAYS)))
    return features.agg(bounded_cadence(typical).alias("fallback_cadence_days"))


def _one_row(df: DataFrame) -> Column:
    """A one-row table as a struct value: evaluated once, shipped as a constant."""
    return df.select(F.struct("*")).scalar()


def with_cadence(features: DataFrame) -> DataFrame:
    fallback = fallback_cadence(features).scalar()
    return features.withColumn(
        "cadence_days",
        F.coalesce(bounded_cadence(F.col("observed_cadence_days")), fallback),
    )


def with_value_segment(features: DataFrame) -> DataFrame:
    """Spend quartile label; a spend equal to a threshold stays in the lower segment.

    No spend and NaN are below no threshold and belong to the highest segment.
    """
    spend = F.col("total_spend")
    lowest, lower, higher, highest = m.VALUE_SEGMENTS
    return (
        features.withColumn("_q", _one_row(spend_quartiles(features)))
        .withColumn(
            "value_segment",
            F.when(F.isnan(spend), highest)
            .when(spend <= F.col("_q.q1"), lowest)
            .when(spend <= F.col("_q.q2"), lower)
            .when(spend <= F.col("_q.q3"), higher)
            .otherwise(highest),
        )
        .drop("_q")
    )


def customer_profiles(features: DataFrame) -> DataFrame:
    """The nine-field profile per person.

    ``features`` is read by the thresholds and by the profiles themselves, so pass a
    written table.
    """
    return with_value_segment(with_cadence(features)).select(
        "customer_unique_id",
        "first_order_date",
        F.col("order_count").cast("int").alias("order_count"),
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
        F.coalesce("total_spend", F.lit(0.0)).alias("total_spend"),
        F.coalesce("avg_delivery_delay_days", F.lit(0.0)).alias("avg_delivery_delay_days"),
        F.coalesce(F.nullif("customer_state", F.lit("")), F.lit(m.UNKNOWN_STATE)).alias(
            "customer_state"
        ),
        "cadence_days",
        "value_segment",
    )


def with_spend_signal(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("spend_signal", spend_signal(F.col("total_spend")))


def enrollment_probability() -> Column:
    return enrollment_score(
        F.col("order_count"), F.col("avg_delivery_delay_days"), F.col("total_spend")
    )


def with_renewal_base(profiles: DataFrame) -> DataFrame:
    """Adds ``renewal_base``, worked out once per person and not once per cycle."""
    base = renewal_base(
        F.col("order_count"),
        F.col("avg_delivery_delay_days"),
        F.col("total_spend"),
        F.col("cadence_days"),
    )
    return profiles.withColumn("renewal_base", base)


def enrolled_customers(profiles: DataFrame) -> DataFrame:
    """People whose fixed draw lies below their enrolment score."""
    return profiles.filter(unit_interval(F.col(PERSON), F.lit(m.TAG_ENROLL)) < enrollment_probability())


def renewal_scores(profiles: DataFrame, max_cycles: int = m.MAX_CYCLES) -> DataFrame:
    """One row per person and cycle from the second on, with its renewal score."""
    later_cycles = F.array(*[F.lit(k) for k in range(2, max_cycles + 1)])
    return (
        with_renewal_base(profiles)
        .withColumn("cycle_number", F.explode(later_cycles))
        .withColumn("renewal_score", renewal_score(F.col("renewal_base"), F.col("cycle_number")))
        .drop("renewal_base")
    )
