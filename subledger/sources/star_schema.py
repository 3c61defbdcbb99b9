"""The star-schema test tables in the layout of the raw commerce sources.

``raw_tables`` reads customer, orders, lineitem, part, events, nation and region;
``event_shop_tables`` takes the purchase events, the only input with times of day,
as orders.
"""

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.sources.modelled import catalog_tiers, marketing_spend, month_state_channel_spine

# Layout of the test tables, declared so that no job runs to look it up.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}

ESTIMATED_DAYS = 30
LONGEST_DELIVERY_DAYS = 45
MONTHS_BEYOND_LAST_ORDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str, alias: str):
    return F.col(name).cast("string").alias(alias)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth person owns two customer ids."""
    key = F.col("c_custkey")
    person = F.when(key % 10 == 1, key - 1).otherwise(key)
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _text("c_custkey", "customer_id"),
            person.cast("string").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_name").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery follows the last shipment, folded into 0..44 days after the order."""
    shipped = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    )
    ordered = F.col("o_orderdate").cast("timestamp")
    days = F.pmod(F.datediff("last_ship", "o_orderdate"), F.lit(LONGEST_DELIVERY_DAYS))
    status = (
        F.when(F.col("o_orderstatus") == "F", m.DELIVERED)
        .when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("processing")
    )
    delivered = F.timestamp_add("DAY", days, ordered)
    return (
        table(spark, sf_dir, "orders")
        .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            _text("o_orderkey", "order_id"),
            _text("o_custkey", "customer_id"),
            status.alias("order_status"),
            ordered.alias("order_purchase_timestamp"),
            ordered.alias("order_approved_at"),
            delivered.alias("order_delivered_carrier_date"),
            delivered.alias("order_delivered_customer_date"),
            F.timestamp_add("DAY", F.lit(ESTIMATED_DAYS), ordered).alias("order_estimated_delivery_date"),
        )
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / 100
    return table(spark, sf_dir, "lineitem").select(
        _text("l_orderkey", "order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
        (F.floor(value * 100 + 0.5) / F.lit(100.0)).alias("payment_value"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _text("l_orderkey", "order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        _text("l_partkey", "product_id"),
        _text("l_suppkey", "seller_id"),
        F.col("l_shipdate").cast("timestamp").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _text("p_partkey", "product_id"),
        F.col("p_type").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_brand").alias("product_description_lenght"),
        F.col("p_size").alias("product_photos_qty"),
        F.col("p_retailprice").alias("product_weight_g"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        _text("event_id", "review_id"),
        _text("user_id", "order_id"),
        (1 + F.col("value").cast("int") % 5).alias("review_score"),
        written.alias("review_creation_date"),
        written.alias("review_answer_timestamp"),
    )


def category_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name")


def spend_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order months, two beyond the last, for every nation."""
    bought = table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("first"),
        F.add_months(F.to_date(F.max("o_orderdate")), MONTHS_BEYOND_LAST_ORDER).alias("last"),
    )
    states = table(spark, sf_dir, "nation").select(F.col("n_name").alias("customer_state"))
    return month_state_channel_spine(
        states, bought.select("first").scalar(), bought.select("last").scalar(), m.CHANNEL_BASE_SPEND
    )


class SourceTables(Mapping[str, DataFrame]):
    """Sources by name, each planned when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[SparkSession, str], DataFrame]], spark, sf_dir):
        self._builders, self._args, self._built = builders, (spark, sf_dir), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](*self._args)
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def raw_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """All nine raw sources by name."""
    return SourceTables(
        {
            "customers": customers,
            "orders": orders,
            "order_items": order_items,
            "payments": payments,
            "products": products,
            "reviews": reviews,
            "category_translation": category_translation,
            "marketing_spend": lambda s, d: marketing_spend(spend_spine(s, d)),
            "catalog_overrides": lambda s, d: catalog_tiers(products(s, d)),
        },
        spark,
        sf_dir,
    )


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as delivered orders; value hours to delivery, two days estimated."""
    bought = F.col("ts").cast("timestamp")
    delivered = F.timestamp_add("SECOND", F.floor(F.col("value") * 3600).cast("int"), bought)
    return table(spark, sf_dir, "events").select(
        _text("event_id", "order_id"),
        _text("user_id", "customer_id"),
        F.when(F.col("event_type") == "purchase", m.DELIVERED).otherwise("processing").alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        bought.alias("order_approved_at"),
        delivered.alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(2), bought).alias("order_estimated_delivery_date"),
    )


def event_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _text("event_id", "order_id"),
        F.lit(1).alias("payment_sequential"),
        F.col("event_type").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        F.col("value").alias("payment_value"),
    )


def event_shop_tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    """The same customers and items with the events as orders and payments."""
    return SourceTables(
        {
            "customers": customers,
            "orders": event_orders,
            "payments": event_payments,
            "order_items": order_items,
        },
        spark,
        sf_dir,
    )
