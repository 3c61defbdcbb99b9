"""Enrolment, renewal, cadence and billing expressions over one profile row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from subledger.functions import model_values as m


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def spend_signal(total_spend: Column) -> Column:
    """Logarithmic spend in [0, 1]."""
    return F.least(F.log1p(F.greatest(total_spend, F.lit(0.0))) / m.SPEND_LOG_SCALE, F.lit(1.0))


def enrollment_score(order_count: Column, delay_days: Column, total_spend: Column) -> Column:
    repeat = F.least(order_count - 1, F.lit(m.ENROLL_REPEAT_ORDERS_COUNTED))
    return clamp(
        F.lit(m.ENROLL_BASE)
        + repeat * m.ENROLL_PER_REPEAT_ORDER
        - F.greatest(delay_days, F.lit(0.0)) * m.ENROLL_PER_DELAY_DAY
        + spend_signal(total_spend) * m.ENROLL_SPEND_WEIGHT,
        m.ENROLL_MIN,
        m.ENROLL_MAX,
    )


def renewal_base(
    order_count: Column, delay_days: Column, total_spend: Column, cadence_days: Column
) -> Column:
    """The part of the renewal score that is the same in every cycle."""
    repeat = F.least(order_count - 1, F.lit(m.RENEW_REPEAT_ORDERS_COUNTED))
    cadence_signal = (F.lit(m.CADENCE_MAX_DAYS) - cadence_days) / F.lit(m.RENEW_CADENCE_SPAN_DAYS)
    return (
        F.lit(m.RENEW_BASE)
        + repeat * m.RENEW_PER_REPEAT_ORDER
        - F.greatest(delay_days, F.lit(0.0)) * m.RENEW_PER_DELAY_DAY
        + spend_signal(total_spend) * m.RENEW_SPEND_WEIGHT
        + cadence_signal * m.RENEW_CADENCE_WEIGHT
    )


def renewal_score(base: Column, cycle_number: Column) -> Column:
    late_cycles = F.greatest(cycle_number - m.RENEW_FREE_CYCLES, F.lit(0))
    return clamp(base - late_cycles * m.RENEW_PER_LATE_CYCLE, m.RENEW_MIN, m.RENEW_MAX)


def bounded_cadence(days: Column) -> Column:
    """Whole days (half to even) inside the modelled cadence range; NULL stays NULL.

    ``least`` and ``greatest`` skip NULLs, so an unknown cadence must not reach them.
    """
    bounded = clamp(F.bround(days, 0), m.CADENCE_MIN_DAYS, m.CADENCE_MAX_DAYS)
    return F.when(days.isNotNull(), bounded.cast("int"))


def billing_amount(avg_order_value: Column) -> Column:
    """Average order value, but at least the least bill, to the cent, half up; NaN stays NaN."""
    amount = F.greatest(avg_order_value, F.lit(float(m.MIN_BILLING_AMOUNT)))
    return F.when(F.isnan(amount), amount).otherwise(F.floor(amount * 100 + 0.5) / F.lit(100.0))
