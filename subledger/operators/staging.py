"""Typed, renamed staging models: one narrow projection per raw source."""

from collections.abc import Mapping

from pyspark.sql import DataFrame

from subledger.schemas import CYCLES_SCHEMA, RAW_SCHEMAS, typed_columns

# The raw product columns are misspelled, the staged ones are not.
PRODUCT_RENAMES = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
}

STAGED_SOURCES = [
    "customers",
    "orders",
    "order_items",
    "payments",
    "products",
    "reviews",
    "marketing_spend",
    "catalog_overrides",
]


def stage_source(name: str, raw: DataFrame) -> DataFrame:
    """The declared columns of one raw source, cast; anything else is dropped."""
    return raw.select(*typed_columns(RAW_SCHEMAS[name], PRODUCT_RENAMES))


def stg_subscription_cycles(cycles: DataFrame) -> DataFrame:
    return cycles.select(*typed_columns(CYCLES_SCHEMA))


def staging_models(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``stg_<source>`` for every staged source present in ``raw``."""
    return {f"stg_{name}": stage_source(name, raw[name]) for name in STAGED_SOURCES if name in raw}
