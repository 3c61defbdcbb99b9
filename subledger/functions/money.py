"""Exact money sums.

Adding doubles gives a result that depends on the order in which tasks finish.
An amount is therefore split into two whole numbers, steps of 1/1024 and what is left in
1e-10, both of which generated code adds up as longs.  The split is exact, as 1/1024 has
ten digits after the point: 0.0009765625.  The double they stand for is worked out once per
group, at the end.

Amounts from 10^12 on, infinities and NaN are summed apart, as doubles.  A group may hold
9 * 10^11 rows and 9 * 10^15 units of money; beyond that the job stops instead of going wrong.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 1024
REST = 10**10
REST_PER_STEP = REST // STEPS  # 9,765,625 without remainder
LIMIT = 1e12
#: Up to here a total in 1e-10 is below 2^53, so that one division gives the nearest double.
FEW_STEPS, FEW_REST = 4 * 10**8, 4 * 10**15


def part_names(name: str) -> list[str]:
    return [f"{name}_steps", f"{name}_rest", f"{name}_odd"]


def exact_parts(amount: str, name: str = "amount") -> dict[str, Column]:
    """Three aggregates that add up again at any coarser grain; ``amount_of`` joins them."""
    column = F.col(amount)
    held = F.abs(column) < F.lit(LIMIT)  # false for NaN, which counts as larger
    steps = F.floor(column * F.lit(float(STEPS)))
    rest = F.rint((column - steps / F.lit(float(STEPS))) * F.lit(float(REST))).cast("bigint")
    parts = F.when(held, steps), F.when(held, rest), F.when(~held, column)
    return {part: F.sum(value) for part, value in zip(part_names(name), parts, strict=True)}


def added_parts(name: str = "amount") -> dict[str, Column]:
    """The same three aggregates over rows that hold such sums."""
    return {part: F.sum(part) for part in part_names(name)}


def amount_of(steps: Column, rest: Column, odd: Column) -> Column:
    """The double nearest to the parts' total; NULL when nothing was summed."""
    few = (F.abs(steps) < FEW_STEPS) & (rest < FEW_REST)
    near = (steps * REST_PER_STEP + rest).cast("double") / F.lit(float(REST))
    total = steps.cast("decimal(19,0)") * F.lit(Decimal(REST_PER_STEP)) + rest.cast("decimal(19,0)")
    far = (total.cast("decimal(27,0)") * F.lit(Decimal(1) / REST)).cast("double")
    exact = F.when(steps.isNull(), F.lit(None).cast("double")).when(few, near).otherwise(far)
    return F.when(odd.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + odd)


def amount_in(name: str = "amount") -> Column:
    """The double that the three columns of ``name`` stand for."""
    return amount_of(*[F.col(part) for part in part_names(name)])


def exact_sum(amount: str) -> Column:
    """Order-independent sum of an amount column; NULL when nothing was summed."""
    return amount_of(*exact_parts(amount).values())


def exact_sum_of_parts(name: str = "amount") -> Column:
    """The same over rows that hold partial sums."""
    return amount_of(*added_parts(name).values())


def known(name: str = "amount") -> Column:
    """Whether anything was summed into the parts."""
    steps, _, odd = part_names(name)
    return F.col(steps).isNotNull() | F.col(odd).isNotNull()
