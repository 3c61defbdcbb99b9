"""Declared table layouts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names and types of the raw sources and of the staged models.
RAW_SCHEMAS: dict[str, str] = {
    "customers": (
        "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
        "customer_city string, customer_state string"
    ),
    "orders": (
        "order_id string, customer_id string, order_status string, "
        "order_purchase_timestamp timestamp, order_approved_at timestamp, "
        "order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, "
        "order_estimated_delivery_date timestamp"
    ),
    "order_items": (
        "order_id string, order_item_id int, product_id string, seller_id string, "
        "shipping_limit_date timestamp, price double, freight_value double"
    ),
    "payments": (
        "order_id string, payment_sequential int, payment_type string, "
        "payment_installments int, payment_value double"
    ),
    "products": (
        "product_id string, product_category_name string, product_name_lenght int, "
        "product_description_lenght int, product_photos_qty int, product_weight_g double"
    ),
    "reviews": (
        "review_id string, order_id string, review_score int, "
        "review_creation_date timestamp, review_answer_timestamp timestamp"
    ),
    "category_translation": "",
    "marketing_spend": (
        "month date, customer_state string, channel string, spend_brl double, "
        "impressions bigint, clicks bigint"
    ),
    "catalog_overrides": (
        "product_id string, catalog_tier string, subscription_eligible int, margin_band string"
    ),
}

CYCLES_SCHEMA = (
    "subscription_id string, customer_unique_id string, cycle_number int, billing_date date, "
    "billing_amount double, renewed int, churned_this_cycle int, customer_state string, "
    "value_segment string, cadence_days int"
)

# Columns that arrive as text in the raw files and hold points in time.
TIMESTAMP_COLUMNS: dict[str, list[str]] = {
    "orders": [
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ],
    "order_items": ["shipping_limit_date"],
    "reviews": ["review_creation_date", "review_answer_timestamp"],
}


def fields(schema: str) -> list[tuple[str, str]]:
    """``"a int, b string"`` → ``[("a", "int"), ("b", "string")]``."""
    pairs = [part.strip().split(" ") for part in schema.split(",") if part.strip()]
    return [(name, kind) for name, kind in pairs]


def typed_columns(schema: str, renames: dict[str, str] | None = None) -> list[Column]:
    """Cast every declared column, dropping the others, under its published name."""
    published = renames or {}
    return [F.col(n).cast(t).alias(published.get(n, n)) for n, t in fields(schema)]
