"""Marts, metrics and checks on small hand-built tables."""

import random
from datetime import date, timedelta

import pytest
from pyspark.errors import PySparkException

from subledger.operators import marts, metrics, quality
from subledger.schemas import CYCLES_SCHEMA


def cycle(sub, k, renewed=1, churned=0, segment="value_1", amount=10.0, start=date(2020, 1, 15)):
    return (
        f"sub_{sub}", sub, k, start + timedelta(days=30 * (k - 1)), amount * renewed, renewed,
        churned, "SP", segment, 30,
    )


def table(spark, rows):
    return spark.createDataFrame(rows, CYCLES_SCHEMA)


def generated(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = date(2020, 1, 1) + timedelta(days=rng.randrange(90))
        lapse = rng.choice([None, 2, 3, 4])
        segment = "value_1" if i % 3 == 0 else f"value_{rng.randrange(2, 5)}"
        for k in range(1, (lapse or 6) + 1):
            rows.append(cycle(f"p{i}", k, int(k != lapse), int(k == lapse), segment, 5.0 + i % 7, start))
    return rows


def test_retention_matches_two_plain_loops(spark):
    rows = generated(300)
    got = {
        (r.value_segment, r.cycle_number): (r.cohort_size, r.retained_subscribers)
        for r in marts.mart_segment_retention(table(spark, rows)).collect()
    }
    expected = {}
    for segment in {r[8] for r in rows}:
        cohort = {r[0] for r in rows if r[8] == segment and r[2] == 1 and r[5] == 1}
        for k in {r[2] for r in rows if r[8] == segment}:
            active = {r[0] for r in rows if r[8] == segment and r[2] == k and r[5] == 1}
            expected[segment, k] = (len(cohort), len(active))
    assert got == expected


def test_retention_invariants(spark):
    cycles = table(spark, generated(200))
    rows = marts.mart_segment_retention(cycles).orderBy("value_segment", "cycle_number").collect()
    by_segment = {}
    for r in rows:
        by_segment.setdefault(r.value_segment, []).append(r.retention_rate)
    assert all(rates[0] == 1.0 and rates == sorted(rates, reverse=True) for rates in by_segment.values())
    assert sum(r.cohort_size for r in rows if r.cycle_number == 1) == 200


def test_keys_without_a_first_cycle_have_no_cohort(spark):
    rows = [cycle("a", 1), cycle("a", 2), cycle("b", 2, segment="value_2"), cycle("c", 1, 0, segment="value_3")]
    assert {r.value_segment for r in marts.mart_segment_retention(table(spark, rows)).collect()} == {"value_1"}


def test_repeated_cycle_rows_count_once(spark):
    rows = [cycle("a", 1)] * 50 + [cycle("a", 2), cycle("b", 1), cycle("b", 2, 0, 1)]
    for mart, key in ((marts.mart_segment_retention, "value_segment"), (marts.mart_cohort_retention, "cohort_month")):
        got = {r.cycle_number: (r.cohort_size, r.retained_subscribers) for r in mart(table(spark, rows)).collect()}
        assert got == {1: (2, 2), 2: (2, 1)}, key


def test_cohort_month_is_that_of_the_first_bill(spark):
    rows = [cycle("a", k, start=date(2020, 1, 31)) for k in (1, 2, 3)]
    assert {r.cohort_month for r in marts.with_cohort_month(table(spark, rows)).collect()} == {date(2020, 1, 1)}


def test_kpis_and_ltv(spark):
    rows = [cycle("a", 1), cycle("a", 2), cycle("b", 1, amount=7.5), cycle("b", 2, 0, 1, amount=7.5)]
    kpi = marts.mart_subscription_kpis(table(spark, rows)).first()
    assert tuple(kpi) == (2, 1, 0.5, 13.75, 27.5, 2.0)
    ltv = {r.subscription_id: (r.synthetic_ltv_brl, r.active_cycles, r.churned)
           for r in marts.mart_customer_ltv(table(spark, rows)).collect()}
    assert ltv == {"sub_a": (20.0, 2, 0), "sub_b": (7.5, 1, 1)}


def test_bills_below_a_cent_and_unknown_ones(spark):
    rows = [cycle("a", 1, amount=0.004), cycle("a", 2, amount=0.004), cycle("b", 1, amount=0.01)]
    cycles = table(spark, rows)
    assert marts.mart_subscription_kpis(cycles).first()[3:5] == (0.01, 0.02)
    assert metrics.avg_ltv(cycles).first()[0] == 0.009
    assert {r.synthetic_ltv_brl for r in marts.mart_customer_ltv(cycles).collect()} == {0.008, 0.01}
    with_nan = table(spark, [*rows, cycle("c", 1, amount=float("nan"))])
    kpi = marts.mart_subscription_kpis(with_nan).first()
    assert kpi.synthetic_subscribers == 3 and kpi.avg_ltv_brl != kpi.avg_ltv_brl
    raw = {name: cycles for name in ("orders", "payments", "order_items")}
    two = table(spark, [*rows, cycle("c", 1, segment="value_2", amount=float("nan"))])
    record = metrics.summary_metrics(raw, two, min_cohort=1).first()
    assert (record.customer_segments, record.synthetic_subscribers) == (2, 3)
    assert record.synthetic_avg_ltv_brl != record.synthetic_avg_ltv_brl


def test_full_outer_join_keeps_both_sides(spark):
    m1, m2 = date(2020, 1, 1), date(2020, 2, 1)
    revenue = spark.createDataFrame(
        [(m1, "SP", 100.0, 3), (m1, "RJ", 50.0, 1), (m2, "MG", 8.0, 1)],
        "month date, customer_state string, observed_revenue_brl double, orders bigint",
    )
    spend = spark.createDataFrame(
        [(m1, "SP", 40.0), (m2, "SP", 10.0), (m2, "MG", 0.0)],
        "month date, customer_state string, marketing_spend_brl double",
    )
    got = {(r.month, r.customer_state): tuple(r)[2:] for r in marts.revenue_spend_full_outer(revenue, spend).collect()}
    assert got == {
        (m1, "SP"): (3, 100.0, 40.0), (m1, "RJ"): (1, 50.0, 0.0),
        (m2, "SP"): (0, 0.0, 10.0), (m2, "MG"): (1, 8.0, 0.0),
    }


def facts(spark, rows):
    return spark.createDataFrame(
        rows,
        "order_id string, customer_unique_id string, customer_state string, order_status string, "
        "order_month date, payment_value double",
    )


def test_return_is_null_without_spend(spark):
    m1 = date(2020, 1, 1)
    order_facts = facts(spark, [("o1", "p", "SP", "delivered", m1, 100.0), ("o2", "p", "RJ", "delivered", m1, 5.0),
                                ("o3", "p", "MG", "delivered", m1, 5.0), ("o4", "p", "SP", "shipped", m1, 9.0)])
    spend = spark.createDataFrame(
        [(m1, "SP", "a", 30.0), (m1, "SP", "b", 10.0), (m1, "MG", "a", 0.0)],
        "month date, customer_state string, channel string, spend_brl double",
    )
    got = {r.customer_state: (r.orders, r.modeled_roas) for r in marts.mart_marketing_efficiency(order_facts, spend).collect()}
    assert got == {"SP": (1, 2.5), "RJ": (1, None), "MG": (1, None)}


def segments(spark, rows):
    return spark.createDataFrame(rows, "value_segment string, cohort_size bigint, retention_rate double")


def test_cohorts_below_fifty_are_not_compared(spark):
    df = segments(spark, [("value_1", 49, 0.1), ("value_2", 50, 0.2), ("value_3", 99, 0.3)])
    assert {r.value_segment for r in metrics.eligible_segments(df).collect()} == {"value_2", "value_3"}


def test_ties_go_to_the_first_segment(spark):
    df = segments(spark, [("value_3", 60, 0.5), ("value_1", 60, 0.5), ("value_4", 60, 0.2), ("value_2", 60, 0.2)])
    spread = metrics.retention_spread(df).first()
    assert (spread.best_segment, spread.worst_segment) == ("value_1", "value_2")
    assert (spread.customer_segments, spread.retention_variance_pct_points) == (4, 30.0)


def test_one_segment_cannot_be_compared(spark):
    with pytest.raises(PySparkException, match="fewer than two eligible segments"):
        metrics.retention_spread(segments(spark, [("value_1", 60, 0.5)])).collect()


def test_a_segment_nobody_of_which_lasted_counts_zero(spark):
    rows = [cycle("a", 1), cycle("a", 2, 0, 1), cycle("b", 1, segment="value_2"), cycle("b", 3, segment="value_2")]
    got = {r.value_segment: (r.cohort_size, r.retained_subscribers)
           for r in metrics.cohort_retained_left(table(spark, rows)).collect()}
    assert got == {"value_1": (1, 0), "value_2": (1, 1)}


def test_cohort_curve_of_a_given_month(spark):
    rows = [cycle("a", 1), cycle("b", 1, start=date(2020, 3, 2)), cycle("b", 2, start=date(2020, 3, 2))]
    mart = marts.mart_cohort_retention(table(spark, rows))
    assert [tuple(r) for r in metrics.cohort_curve(mart, date(2020, 1, 1)).collect()] == [(1, 1.0)]
    assert [tuple(r) for r in metrics.cohort_curve(mart).collect()] == [(1, 1.0), (2, 1.0)]
    assert [r[0] for r in metrics.cohort_months(mart).collect()] == [date(2020, 3, 1), date(2020, 1, 1)]


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame(
        [("a", "delivered", -1.0, 0.5), ("a", "lost", 2.0, 1.5), (None, None, None, -0.1), ("b", "lost", 0.0, None)],
        "k string, s string, v double, retention_rate double",
    )
    nulls = {r.check: (r.violations, r.passed) for r in quality.not_null_status(df, "t", ["k", "v"]).collect()}
    assert nulls == {"t.k not null": (1, 0), "t.v not null": (1, 0)}
    assert [tuple(r) for r in quality.duplicate_keys(df, "k").collect()] == [("a", 2)]
    assert [tuple(r) for r in quality.unexpected_values(df, "s", ["delivered"]).collect()] == [("lost", 2)]
    assert quality.negative_values(df, "v").count() == 1
    assert quality.rates_out_of_bounds(df).count() == 2
    rows = table(spark, [cycle("a", 1), cycle("a", 1), cycle("a", 2)])
    assert [tuple(r) for r in quality.duplicate_cycles(rows).collect()] == [("sub_a", 1, 2)]
    assert tuple(quality.status("c", quality.duplicate_cycles(rows)).first()) == ("c", 1, 0)


def test_metric_gates_threshold(spark):
    record = spark.createDataFrame([(100, 2, 5)], "real_orders bigint, customer_segments bigint, synthetic_subscribers bigint")
    assert [r.passed for r in quality.metric_gates(record).collect()] == [0, 1, 1]
    assert [r.passed for r in quality.metric_gates(record, 99).collect()] == [1, 1, 1]


def test_unlisted_segments_get_columns_of_their_own(spark):
    mart = spark.createDataFrame([(1, "value_1", 1.0), (1, "gold", 0.5)], "cycle_number int, value_segment string, retention_rate double")
    pivot = metrics.segment_retention_pivot(mart)
    assert pivot.columns == ["cycle_number", "value_1", "value_2", "value_3", "value_4", "gold"]
    assert tuple(pivot.first()) == (1, 1.0, None, None, None, 0.5)
    row = metrics.segment_retention_pivot(mart, ["gold", "value_1"]).first()
    assert (row.gold, row.value_1) == (0.5, 1.0)


def test_cohort_month_keeps_every_row(spark):
    rows = [("s", 1, date(2020, 1, 31), 1)] * 2 + [("s", 2, date(2020, 3, 1), 0)]
    df = spark.createDataFrame(rows, "subscription_id string, cycle_number int, billing_date date, renewed int")
    got = marts.with_cohort_month(df).collect()
    assert len(got) == 3 and {r.cohort_month for r in got} == {date(2020, 1, 1)}
    assert marts.mart_cohort_retention(df).count() == 2
