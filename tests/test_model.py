"""Golden vectors and invariants of the subscription model."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from subledger.functions import scores
from subledger.functions.hashing import unit_interval
from subledger.operators import profiles as p
from subledger.operators.cycles import billing_cycles
from subledger.sources.modelled import catalog_tiers, marketing_spend, month_state_channel_spine
from tests.brute import unit

PROFILE = (
    "customer_unique_id string, first_order_date date, order_count int, avg_order_value double, "
    "total_spend double, avg_delivery_delay_days double, customer_state string, cadence_days int, "
    "value_segment string"
)


def profile(who="known-customer", **changes):
    row = {
        "customer_unique_id": who,
        "first_order_date": date(2018, 1, 1),
        "order_count": 3,
        "avg_order_value": 125.0,
        "total_spend": 375.0,
        "avg_delivery_delay_days": 0.0,
        "customer_state": "SP",
        "cadence_days": 45,
        "value_segment": "value_2",
    }
    return tuple({**row, **changes}.values())


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        (("abc", 1), 0.13064592170145323),
        (("customer-1", "renew", 3), 0.8540229038135971),
        (("a", None, "b"), 0.1375432957408207),
        (("2016-09-01", "SP", "paid_search"), 0.1613505829280518),
        (("sample_product_001", "catalog"), 0.08704121891839091),
    ],
)
def test_unit_interval_golden(spark, parts, expected):
    columns = [F.lit(x).cast("string") if x is None else F.lit(x) for x in parts]
    assert spark.range(1).select(unit_interval(*columns)).first()[0] == expected


def test_unit_interval_is_bit_equal_to_the_definition_and_in_range(spark):
    rows = spark.range(5000).select("id", unit_interval(F.col("id"), F.lit("x")).alias("u")).collect()
    assert all(r.u == unit(r.id, "x") and 0 <= r.u < 1 for r in rows)


def test_scores_golden(spark):
    df = spark.createDataFrame([profile()], PROFILE)
    assert df.select(p.enrollment_probability()).first()[0] == pytest.approx(0.3296479457169495, abs=1e-12)
    renewals = [r.renewal_score for r in p.renewal_scores(df).orderBy("cycle_number").collect()]
    assert renewals == pytest.approx([0.83025845, 0.80525845, 0.78025845, 0.75525845, 0.73025845], abs=1e-7)


def test_more_spend_means_a_higher_renewal_score(spark):
    df = spark.createDataFrame([profile("hi", total_spend=900.0), profile("lo", total_spend=90.0)], PROFILE)
    second = {
        r.customer_unique_id: r.renewal_score
        for r in p.renewal_scores(df).filter("cycle_number = 2").collect()
    }
    assert second == pytest.approx({"hi": 0.8477367718, "lo": 0.8018838568}, abs=1e-9)


@pytest.mark.parametrize(
    ("who", "renewed"),
    [
        ("cust-7", [1, 1, 1, 1, 1, 1]),
        ("cust-39", [1, 1, 1, 1, 1, 0]),
        ("cust-3", [1, 1, 1, 1, 0]),
        ("cust-4", [1, 1, 1, 0]),
        ("cust-5", [1, 1, 0]),
        ("cust-15", [1, 0]),
        ("known-customer", []),
    ],
)
def test_cycles_golden(spark, who, renewed):
    df = billing_cycles(spark.createDataFrame([profile(who)], PROFILE)).orderBy("cycle_number")
    rows = df.collect()
    assert [r.renewed for r in rows] == renewed
    assert [r.cycle_number for r in rows] == list(range(1, len(rows) + 1))
    assert [r.billing_amount for r in rows] == [125.0 * k for k in renewed]
    assert [r.churned_this_cycle for r in rows] == [1 - k for k in renewed]
    assert all(r.billing_date.toordinal() == date(2018, 1, 1).toordinal() + 45 * (r.cycle_number - 1) for r in rows)
    assert all(r.subscription_id == f"sub_{who}" for r in rows)


def test_a_single_cycle_never_lapses(spark):
    df = spark.createDataFrame([profile(f"cust-{i}") for i in range(40)], PROFILE)
    assert {r.cycle_number for r in billing_cycles(df, max_cycles=1).collect()} == {1}
    assert p.renewal_scores(df, max_cycles=1).count() == 0


def test_amounts_have_a_floor_and_round_half_up(spark):
    averages = [(2.675,), (0.0,), (80.125,), (20.0 / 3,), (125.0,), (None,), (float("nan"),)]
    df = spark.createDataFrame(averages, "average double")
    got = [r[0] for r in df.select(scores.billing_amount(F.col("average"))).collect()]
    assert got[:-1] == [5.0, 5.0, 80.13, 6.67, 125.0, 5.0] and got[-1] != got[-1]


def test_cadence_rounds_half_to_even_inside_its_range(spark):
    df = spark.createDataFrame([(60.5,), (61.5,), (3.0,), (400.0,), (None,)], "d double")
    assert [r[0] for r in df.select(scores.bounded_cadence(F.col("d"))).collect()] == [60, 62, 30, 120, None]


def test_no_observed_cadence_falls_back(spark):
    schema = "customer_unique_id string, observed_cadence_days double"
    none = spark.createDataFrame([("a", None)], schema)
    assert p.fallback_cadence(none).first()[0] == 60
    some = spark.createDataFrame([("a", 40.0), ("b", 75.0), ("c", None)], schema)
    assert {r.customer_unique_id: r.cadence_days for r in p.with_cadence(some).collect()} == {
        "a": 40, "b": 75, "c": 58,
    }


def test_equal_spends_all_fall_in_the_lowest_segment(spark):
    df = spark.createDataFrame([(str(i), 10.0) for i in range(9)], "customer_unique_id string, total_spend double")
    assert {r.value_segment for r in p.with_value_segment(df).collect()} == {"value_1"}


def test_spend_and_catalog_golden(spark):
    states = spark.createDataFrame([("SP",)], "customer_state string")
    spine = month_state_channel_spine(
        states, F.to_date(F.lit("2016-09-01")), F.to_date(F.lit("2018-10-15")), {"paid_search": 8000}
    )
    spend = marketing_spend(spine).orderBy("month").collect()
    assert len(spend) == 26
    first = spend[0]
    assert (first.spend_brl, first.impressions, first.clicks) == (6645.40, 74202, 2452)
    product = spark.createDataFrame([("sample_product_001",)], "product_id string")
    tier = catalog_tiers(product).first()
    assert (tier.catalog_tier, tier.subscription_eligible, tier.margin_band) == ("value", 0, "low")
