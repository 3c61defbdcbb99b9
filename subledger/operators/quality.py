"""Data-quality checks: the violating rows, and one status row per check."""

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.functions import model_values as m


def status(check: str, violating: DataFrame) -> DataFrame:
    """(check, violations, passed) for a table of violating rows."""
    return violating.agg(F.count("*").alias("violations")).select(
        F.lit(check).alias("check"),
        "violations",
        (F.col("violations") == 0).cast("int").alias("passed"),
    )


def all_of(*reports: DataFrame) -> DataFrame:
    combined = reports[0]
    for report in reports[1:]:
        combined = combined.unionByName(report)
    return combined


class QualityFailure(ValueError):
    """At least one check did not pass."""


def require_passed(report: DataFrame) -> None:
    """Stop on failed checks; ``report`` holds one status row per check."""
    failed = [r["check"] for r in report.filter("passed = 0").collect()]
    if failed:
        raise QualityFailure("failed checks: " + "; ".join(sorted(failed)))


def require_agreement(crosscheck: DataFrame) -> None:
    """Stop where two ways to the same metric differ."""
    apart = [r.metric for r in crosscheck.filter("agrees = 0").select("metric").collect()]
    if apart:
        raise QualityFailure("metrics differ when counted again: " + ", ".join(sorted(apart)))


@dataclass(frozen=True)
class Check:
    """A check of one table: ``violations`` is an aggregate over its rows."""

    table: str
    name: str
    violations: Column

    @property
    def title(self) -> str:
        return f"{self.table}.{self.name}"


def not_null(table: str, column: str) -> Check:
    return Check(table, f"{column} not null", F.count_if(F.col(column).isNull()))


def non_negative(table: str, column: str) -> Check:
    return Check(table, f"{column} non-negative", F.count_if(F.col(column) < 0))


def between_zero_and_one(table: str, column: str) -> Check:
    return Check(table, f"{column} in [0, 1]", F.count_if((F.col(column) < 0) | (F.col(column) > 1)))


def accepted(table: str, column: str, values: Sequence[str]) -> Check:
    """Violations are distinct values outside the list; NULL is none."""
    outside = F.when(~F.col(column).isin(*values), F.col(column))
    return Check(table, f"{column} accepted", F.count_distinct(outside))


def fused(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """One status row per check; all checks of a table come out of one pass over it.

    Checks of one key's uniqueness need a shuffle of their own and are none of these.
    """
    reports = []
    for table, own in groupby(sorted(checks, key=lambda c: c.table), key=lambda c: c.table):
        own = list(own)
        counts = tables[table].agg(*[c.violations.alias(f"v{i}") for i, c in enumerate(own)])
        rows = [
            F.struct(
                F.lit(c.title).alias("check"),
                F.col(f"v{i}").alias("violations"),
                (F.col(f"v{i}") == 0).cast("int").alias("passed"),
            )
            for i, c in enumerate(own)
        ]
        reports.append(counts.select(F.inline(F.array(*rows))))
    return all_of(*reports)


def not_null_status(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """One status row per column, all from a single pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{table}.{c} not null").alias("check"),
                F.col(c).alias("violations"),
                (F.col(c) == 0).cast("int").alias("passed"),
            )
            for c in columns
        ]
    )
    return counts.select(F.inline(rows))


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Keys that occur more than once; counted before the shuffle, so a hot key is no burden."""
    known = df
    for c in columns:
        known = known.filter(F.col(c).isNotNull())
    return known.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def unexpected_values(df: DataFrame, column: str, accepted: Sequence[str]) -> DataFrame:
    """Values outside the accepted list with their row counts; NULL is no violation."""
    return (
        df.filter(~F.col(column).isin(*accepted)).groupBy(column).agg(F.count("*").alias("n"))
    )


def negative_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def rates_out_of_bounds(df: DataFrame, column: str = "retention_rate") -> DataFrame:
    return df.filter((F.col(column) < 0) | (F.col(column) > 1))


def duplicate_cycles(cycles: DataFrame) -> DataFrame:
    return (
        cycles.groupBy("subscription_id", "cycle_number").agg(F.count("*").alias("n")).filter("n > 1")
    )


def metric_gates(metrics: DataFrame, min_order_rows: int = m.MIN_ORDER_ROWS) -> DataFrame:
    """(check, passed) for the end-state thresholds over the one-row metric record."""

    def gate(name: str, condition: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), condition.cast("int").alias("passed"))

    return metrics.select(
        F.inline(
            F.array(
                gate("enough orders", F.col("real_orders") > min_order_rows),
                gate("two or more segments", F.col("customer_segments") >= 2),
                gate("any subscribers", F.col("synthetic_subscribers") > 0),
            )
        )
    )
