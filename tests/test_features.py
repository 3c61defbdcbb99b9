"""Customer features, quantiles and gaps against brute force, edge cases and hot keys included."""

import random
import re
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from subledger.functions import quantiles
from subledger.functions.money import exact_parts, exact_sum, exact_sum_of_parts
from subledger.functions.quantiles import exact_quantiles
from subledger.operators.customers import customer_features, int_customer_features
from subledger.operators.orders import (
    int_order_facts,
    order_gaps,
    orders_customers,
    payments_by_order,
    sorted_stretches,
)
from subledger.operators.profiles import spend_quartiles, with_value_segment
from subledger.schemas import RAW_SCHEMAS
from tests import brute
from tests.test_plans import physical

START = datetime(2020, 1, 1)


def order(oid, cid, when, status="delivered", got=None, due=None):
    return {
        "order_id": oid, "customer_id": cid, "order_status": status,
        "order_purchase_timestamp": when, "order_approved_at": when,
        "order_delivered_carrier_date": got, "order_delivered_customer_date": got,
        "order_estimated_delivery_date": due,
    }


def customer(cid, who, state):
    return {
        "customer_id": cid, "customer_unique_id": who, "customer_zip_code_prefix": 1,
        "customer_city": "c", "customer_state": state,
    }


def payment(oid, value):
    return {
        "order_id": oid, "payment_sequential": 1, "payment_type": "t",
        "payment_installments": 1, "payment_value": value,
    }


def frames(spark, orders, customers, payments):
    def frame(name, rows):
        columns = [f.split(" ")[0] for f in RAW_SCHEMAS[name].split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], RAW_SCHEMAS[name])

    return frame("orders", orders), frame("customers", customers), frame("payments", payments)


def check(spark, orders, customers, payments, elapsed):
    got = customer_features(*frames(spark, orders, customers, payments), elapsed=elapsed)
    ours = {r[0]: tuple(r)[1:] for r in got.collect()}
    expected = brute.features(orders, customers, payments, elapsed)
    assert set(ours) == set(expected)
    for who, row in expected.items():
        assert ours[who][:3] == row[:3], who
        assert ours[who][3:6] == pytest.approx(row[3:6], rel=1e-12), who
        assert ours[who][6] == row[6], who


@pytest.mark.parametrize("elapsed", [False, True])
def test_edge_cases(spark, elapsed):
    day = timedelta(days=1)
    customers = [
        customer("c1", "one-order", "SP"), customer("c2", "same-instant", "RJ"),
        customer("c3", "unpaid", "MG"), customer("c4", "early", "RS"),
        customer("c5", "moved", "PR"), customer("c6", "moved", "SC"),
        customer("c7", "stateless", None), customer("c8", "late-state", None),
        customer("c9", "late-state", "BA"), customer("c10", "near-midnight", "DF"),
        customer("c11", "never-delivered", "SP"), customer("c12", "twice", "SP"),
    ]
    near = START + timedelta(hours=23, minutes=50)
    orders = [
        order("o1", "c1", START, got=START + 9 * day, due=START + 5 * day),
        order("o2", "c2", START), order("o3", "c2", START), order("o4", "c2", START + 10 * day),
        order("o5", "c3", START),
        order("o6", "c4", START, got=START + 2 * day, due=START + 5 * day),
        order("o7", "c5", START + 40 * day), order("o8", "c6", START), order("o9", "c5", START + 41 * day),
        order("o10", "c7", START), order("o11", "c8", START), order("o12", "c9", START + 3 * day),
        order("o13", "c10", near), order("o14", "c10", near + timedelta(minutes=20)),
        order("o15", "c10", near + timedelta(hours=20)), order("o16", "c10", near + timedelta(hours=50)),
        order("o17", "c11", START, status="shipped"), order("o18", "c11", None),
        order("o19", "c12", START), order("o19", "c12", START + 7 * day), order("o20", "nobody", START),
        order("o21", "c1", START, status=None),
    ]
    payments = [payment("o1", 10.01), payment("o1", 5.0), payment("o2", 1.1), payment("o4", 2.2)]
    payments += [payment(f"o{i}", i + 0.25) for i in range(6, 21)] + [payment("no-order", 9.0)]
    check(spark, orders, customers, payments, elapsed)


@pytest.mark.parametrize("elapsed", [False, True])
def test_a_third_of_the_orders_from_one_person(spark, elapsed):
    rng = random.Random(7)
    customers = [customer(f"c{i}", f"p{i // 2}", f"S{i % 5}") for i in range(60)]
    orders, payments = [], []
    for i in range(3000):
        cid = "c0" if i % 3 == 0 else f"c{rng.randrange(60)}"
        when = START + timedelta(seconds=rng.randrange(700 * 86400))
        got = when + timedelta(seconds=rng.randrange(40 * 86400)) if rng.random() < 0.9 else None
        orders.append(order(f"o{i}", cid, when, got=got, due=when + timedelta(days=20)))
        payments += [payment(f"o{i}", rng.randrange(1, 50000) / 100) for _ in range(rng.randrange(3))]
    check(spark, orders, customers, payments, elapsed)


def test_a_third_of_the_orders_copies_of_one(spark):
    rng = random.Random(5)
    customers = [customer(f"c{i}", f"p{i // 2}", f"S{i % 5}") for i in range(20)]
    orders = [
        order(f"o{i}", f"c{rng.randrange(20)}", START + timedelta(hours=rng.randrange(9000)))
        for i in range(600)
    ]
    orders += [order("o1", "c3", START + timedelta(days=rng.randrange(2))) for _ in range(300)]
    check(spark, orders, customers, [payment(f"o{i}", 3.5) for i in range(500)], elapsed=False)


def test_int_customer_features_agree_with_features(spark):
    rng = random.Random(3)
    customers = [customer(f"c{i}", f"p{i % 7}", f"S{i}") for i in range(20)]
    orders = [
        order(f"o{i}", f"c{rng.randrange(20)}", START + timedelta(hours=rng.randrange(9000)))
        for i in range(300)
    ]
    payments = [payment(f"o{i}", rng.randrange(9999) / 100) for i in range(250)]
    o, c, p = frames(spark, orders, customers, payments)
    items = spark.createDataFrame([], RAW_SCHEMAS["order_items"])
    got = int_customer_features(int_order_facts(o, c, p, items)).collect()
    expected = brute.features(orders, customers, payments)
    for r in got:
        state, first, count, average, total, _, _ = expected[r.customer_unique_id]
        assert (r.customer_state, r.first_order_date, r.order_count) == (state, first, count)
        assert (r.avg_order_value, r.observed_revenue) == pytest.approx((average, total))
    assert len(got) == len(expected)


@pytest.mark.parametrize("elapsed", [False, True])
def test_order_gaps_row_by_row(spark, elapsed):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        who = "hot" if i % 3 == 0 else f"p{rng.randrange(30)}"
        rows.append((who, f"o{i:04d}", START + timedelta(minutes=rng.randrange(90 * 24) * 30)))
    df = spark.createDataFrame(rows, "customer_unique_id string, order_id string, order_purchase_timestamp timestamp")
    got = {r.order_id: r.gap_days for r in order_gaps(df, elapsed=elapsed).collect()}
    expected, last = {}, {}
    for who, oid, when in sorted(rows, key=lambda r: (r[2], r[1])):
        before = last.get(who)
        if before is None:
            expected[oid] = None
        else:
            expected[oid] = (when - before) // timedelta(days=1) if elapsed else (when.date() - before.date()).days
        last[who] = when
    assert got == expected


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [1.0, 2.0], [3.0] * 10, [0.01 * i for i in range(1, 102)],
        [float(i * i) for i in range(200)], [1e9, 2e9, 3.33, 4.44], [-5.0, -2.5, 0.0, 7.25, 9.99],
        [7.77] * 400 + [float(i) for i in range(800)],
        [0.004] * 4, [0.1 + 0.2, 0.3, 0.1, 1 / 3], [-0.0, 0.0, -1e-300, 5e-324], [-1e308, 1e308, 1e-308, -1e-308, 0.0],
        [-3.5, -2.25, -1.125], [-1.0, 1.0], [2.0 ** k for k in range(-300, 300)], [0.004, 7.0, float("inf"), 1.5, 2.5],
    ],
)
@pytest.mark.parametrize("few", [1, 1 << 16])
def test_quantiles(spark, values, few, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", few)
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None, float("nan")]], "x double")
    got = exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    assert list(got) == [brute.quantile(values, p) for p in (0.25, 0.5, 0.75)]


def test_segments_of_small_and_unknown_spends(spark):
    spends = [0.004, 0.004, 0.004, 0.004, float("nan"), None]
    df = spark.createDataFrame(list(enumerate(spends)), "i int, total_spend double")
    assert list(spend_quartiles(df).first()) == [0.004] * 3
    got = {r.i: r.value_segment for r in with_value_segment(df).collect()}
    assert got == {0: "value_1", 1: "value_1", 2: "value_1", 3: "value_1", 4: "value_4", 5: "value_4"}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert list(exact_quantiles(df, "x", [0.25, 0.5]).first()) == [None, None]


def test_quantiles_across_slices(spark):
    df = spark.range(200_000).select(((F.col("id") * 7919) % 1_000_003 * 1.37).alias("x"))
    exact = df.select(F.percentile("x", F.lit(0.9))).first()[0]
    assert exact_quantiles(df, "x", [0.9]).first()[0] == pytest.approx(exact, rel=1e-15)


def test_orders_without_a_customer_drop_out(spark):
    o, c, _ = frames(spark, [order("o1", "c1", START), order("o2", "x", START)], [customer("c1", "p", "SP")], [])
    assert [r.order_id for r in orders_customers(o, c).collect()] == ["o1"]
    assert date(2020, 1, 1) == START.date()


@pytest.mark.parametrize("elapsed", [False, True])
def test_order_gaps_of_copies_and_nulls(spark, elapsed):
    at = lambda day, hour=0: START + timedelta(days=day, hours=hour)
    rows = [
        ("a", "1", at(0)), ("a", "1", at(0)), ("a", "2", at(10)), ("a", "2", at(10)), ("a", "2", at(10, 5)),
        ("a", "3", at(10)), ("a", None, at(14)), ("a", "4", None), ("a", "4", None),
        (None, "5", at(1)), (None, "6", at(5)), (None, None, at(8)), (None, None, at(8)), ("b", None, at(3)),
    ]
    df = spark.createDataFrame(rows, "customer_unique_id string, order_id string, order_purchase_timestamp timestamp")
    got = sorted(map(str, ([r.customer_unique_id, r.order_id, r.gap_days] for r in order_gaps(df, elapsed=elapsed).collect())))
    expected = [
        ["a", "1", None], ["a", "1", 0], ["a", "2", 10], ["a", "2", 0], ["a", "2", 0], ["a", "3", 0],
        ["a", None, 3 if elapsed else 4], ["a", "4", None], ["a", "4", None],
        [None, "5", None], [None, "6", 4], [None, None, 3], [None, None, 0], ["b", None, None],
    ]
    assert got == sorted(map(str, expected))


def test_amounts_below_a_cent_and_odd_ones(spark):
    rows = [("a", 0.004)] * 5 + [("b", float("nan")), ("b", 1.0), ("c", None), ("d", float("inf")), ("d", 2.0), ("e", 1e18)]
    df = spark.createDataFrame(rows, "order_id string, payment_value double")
    got = {r.order_id: r.payment_value for r in payments_by_order(df).collect()}
    assert got["a"] == 0.02 and got["b"] != got["b"] and got["c"] is None
    assert got["d"] == float("inf") and got["e"] == 1e18


def test_exact_sums_of_random_amounts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), rng.choice([round(rng.uniform(-1e5, 1e5), 2), rng.random() / 1e6, float(rng.randrange(10**9))])) for _ in range(3000)]
    rows += [("big", 999_999_999_999.25)] * 9 + [("big", -0.125), ("even", 5.0), ("even", -5.0), ("small", 1e-10)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r.x for r in df.groupBy("k").agg(exact_sum("x").alias("x")).collect()}
    parts = df.groupBy("k", F.col("x") > 0).agg(*[c.alias(n) for n, c in exact_parts("x").items()])
    again = {r.k: r.x for r in parts.groupBy("k").agg(exact_sum_of_parts().alias("x")).collect()}
    for key in got:
        units = sum(round(Decimal(x) * 10**10) for k, x in rows if k == key)
        assert got[key] == again[key] == float(Decimal(units).scaleb(-10)), key


@pytest.mark.parametrize("elapsed", [False, True])
def test_order_gaps_over_many_stretches(spark, elapsed):
    rng = random.Random(21)
    rows = [("hot", f"h{i:05d}", START) for i in range(3000)]  # a third, at one moment
    rows += [("hot", f"l{i}", START + timedelta(hours=30 * i)) for i in range(50)]
    for i in range(6000):
        when = None if i % 40 == 0 else START + timedelta(hours=rng.randrange(3000))
        rows.append((rng.choice([None, "a", "b", *(f"p{k}" for k in range(200))]), f"o{i % 5900:05d}", when))
    df = spark.createDataFrame(rows, "customer_unique_id string, order_id string, order_purchase_timestamp timestamp")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = df.distinct()
        order_by = ["customer_unique_id", "order_purchase_timestamp", "order_id"]
        sizes = [r["count"] for r in sorted_stretches(copies, *order_by).groupBy("stretch").count().collect()]
        assert len(sizes) == 8 and max(sizes) < copies.count() / 4
        found = order_gaps(df, elapsed=elapsed)
        assert "order_purchase_timestamp" not in " ".join(re.findall(r"Join .*", physical(found)))
        got = sorted(map(str, (list(r) for r in found.collect())))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    expected, last = [], {}
    for who, oid, when in sorted(rows, key=lambda r: (r[2] or START, r[1])):
        gap = None
        if when is not None:
            if who in last:
                past = when - last[who]
                gap = past.days if elapsed else (when.date() - last[who].date()).days
            last[who] = when
        expected.append([who, oid, when, gap])
    assert got == sorted(map(str, expected))
