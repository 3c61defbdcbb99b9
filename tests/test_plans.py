"""What the physical plans must and must not contain."""

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from subledger.operators.customers import customer_features
from subledger.operators.marts import mart_segment_retention
from subledger.operators.orders import (
    delivered_orders,
    int_order_facts,
    orders_customers,
    orders_items_left,
    orders_payments_left,
)
from subledger.plans.registry import queries
from subledger.session import ship
from subledger.sources import star_schema
from subledger.sources.bucketed import by_key, laid_out
from subledger.sources.shared_folder import staged

SF = "/root/testdata/sf0.001"
def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bronze(spark):
    raw = star_schema.raw_tables(spark, SF)
    return {name: staged(raw[name], name) for name in ("orders", "customers", "payments", "order_items")}


def test_filter_and_columns_reach_the_scan(bronze):
    plan = physical(delivered_orders(bronze["orders"]).select("order_id"))
    assert "EqualTo(order_status,delivered)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"order_id", "order_status", "order_purchase_timestamp"}


def test_features_shuffle_orders_once_per_join_key(without_broadcast, bronze):
    plan = physical(customer_features(bronze["orders"], bronze["customers"], bronze["payments"]))
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    names = sorted(re.sub(r"#\d+L?", "", k) for k in keys)
    assert names == [
        "customer_id",  # orders
        "customer_id",  # customers
        "customer_unique_id",  # one row per person, state and day
        "customer_unique_id, customer_state, day",  # the same, folded before
        "order_id",  # orders
        "order_id",  # payments, folded before
    ]


def test_facts_share_one_shuffle_for_payments_and_items(without_broadcast, bronze):
    facts = int_order_facts(
        bronze["orders"], bronze["customers"], bronze["payments"], bronze["order_items"]
    )
    plan = physical(facts)
    assert len(re.findall(r"Exchange hashpartitioning\(order_id", plan)) == 3


def test_unused_items_join_is_removed(without_broadcast, bronze):
    facts = int_order_facts(
        bronze["orders"], bronze["customers"], bronze["payments"], bronze["order_items"]
    )
    assert "freight_value" not in physical(facts.select("order_id", "payment_value"))


def test_retention_scans_the_cycles_once(spark):
    cycles = staged(queries()["billing_cycles"](spark, SF), "cycles")
    assert physical(mart_segment_retention(cycles)).count("FileScan") == 1


def test_a_hot_customer_id_is_split(without_broadcast):
    spark = without_broadcast
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 90_000, 1, 16)
        hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("string")
        orders = staged(rows.select(F.col("id").cast("string").alias("order_id"), hot.alias("customer_id")), "o")
        people = staged(
            rows.select(
                F.col("id").cast("string").alias("customer_id"),
                F.col("id").cast("string").alias("customer_unique_id"),
                F.lit("SP").alias("customer_state"),
            ),
            "c",
        )
        joined = orders_customers(orders, people)
        assert len(joined.collect()) == 90_000
        assert "skew=true" in physical(joined)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_joins_of_laid_out_tables_need_no_shuffle(without_broadcast, bronze, tmp_path):
    tables = laid_out({n: bronze[n] for n in ("orders", "payments", "order_items")}, "order_id", 8, str(tmp_path))
    cold = orders_items_left(orders_payments_left(tables["orders"].cold, tables["payments"].cold), tables["order_items"].cold)
    assert "Exchange" not in physical(cold)
    assert cold.count() == bronze["orders"].count() and tables["orders"].hot.count() == 0


def test_hot_and_missing_keys_lie_apart(without_broadcast, tmp_path):
    spark = without_broadcast
    rows = spark.range(0, 30_000, 1, 8)
    order_id = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string"))
    payments = staged(rows.select(order_id.alias("order_id"), (F.col("id") % 1000 / 8).alias("payment_value")), "p")
    orders = staged(payments.select("order_id").distinct().withColumn("n", F.lit(1)), "o")
    tables = laid_out({"orders": orders, "payments": payments}, "order_id", 8, str(tmp_path))
    largest = tables["payments"].cold.groupBy("order_id").count().agg(F.max("count")).first()[0]
    assert largest == 1 and tables["payments"].hot.filter("order_id = 'hot'").count() == 10_000
    assert len(list((tmp_path / "payments").glob("*.parquet"))) == 8
    found = by_key(orders_payments_left, tables["orders"], tables["payments"])
    assert sorted(map(str, found.collect())) == sorted(map(str, orders_payments_left(orders, payments).select(*found.columns).collect()))
    assert not re.search("Exchange", physical(orders_payments_left(tables["orders"].cold, tables["payments"].cold)))


def test_the_package_is_sent_whole(spark):
    with zipfile.ZipFile(ship(spark)) as archive:
        names = set(archive.namelist())
    assert {"subledger/__init__.py", "subledger/operators/marts.py", "subledger/plans/models.py"} <= names
