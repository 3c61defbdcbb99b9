"""Raw sources → staging → features → profiles → cycles → marts → metrics and checks."""

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.functions import model_values as m
from subledger.operators import customers as person
from subledger.operators import marts, metrics, orders, quality
from subledger.operators.cycles import billing_cycles
from subledger.operators.profiles import customer_profiles
from subledger.operators.recount import recounted_metrics
from subledger.operators.staging import STAGED_SOURCES, stage_source, stg_subscription_cycles
from subledger.plans.models import TABLE, Model, in_order, materialised, needed
from subledger.schemas import CYCLES_SCHEMA, RAW_SCHEMAS, typed_columns
from subledger.sources.contract import require_files, require_sources
from subledger.sources.files import (
    RawFile,
    csv_scan,
    csv_sink,
    dedupe_rows,
    ingest_audit,
    ingest_rejects,
    json_sink,
    parquet_scan,
)
from subledger.sources.modelled import catalog_tiers, marketing_spend, standard_spine
from subledger.sources.shared_folder import staged


def declared(elapsed: bool = False) -> list[Model]:
    """All models over the eight staged sources, and what each is built from.

    Orders are joined with people, payments and items once, in ``order_rows``.
    """

    def mart(name: str, *needs: str) -> Model:
        return Model(name, needs, getattr(marts, name), TABLE, "marts")

    cycles = "stg_subscription_cycles"
    return [
        *[Model(f"stg_{name}", (name,), partial(stage_source, name)) for name in STAGED_SOURCES],
        Model(
            "order_rows",
            ("stg_orders", "stg_customers", "stg_payments", "stg_order_items"),
            orders.order_rows,
            TABLE,
        ),
        Model("int_order_facts", ("order_rows",), orders.facts_of_rows),
        Model("customer_days", ("order_rows",), partial(person.customer_days, elapsed=elapsed), TABLE),
        Model("customer_features", ("customer_days",), partial(person.features_of_days, elapsed=elapsed), TABLE),
        Model("int_customer_features", ("int_order_facts",), person.int_customer_features),
        Model("customer_profiles", ("customer_features",), customer_profiles),
        Model("subscription_cycles", ("customer_profiles",), _published_cycles, TABLE),
        Model(cycles, ("subscription_cycles",), stg_subscription_cycles),
        mart("mart_subscription_kpis", cycles),
        mart("mart_customer_ltv", cycles),
        mart("mart_cohort_retention", cycles),
        mart("mart_segment_retention", cycles),
        mart("mart_marketing_efficiency", "int_order_facts", "stg_marketing_spend"),
        Model("segment_retention_cycle3", (cycles,), metrics.segment_retention_at, TABLE, "marts"),
    ]


def _published_cycles(profiles: DataFrame) -> DataFrame:
    return billing_cycles(profiles).select(*typed_columns(CYCLES_SCHEMA))


def features(raw: Mapping[str, DataFrame], elapsed: bool = False) -> DataFrame:
    """Customer features as a written table: thresholds and profiles both read it."""
    lazy = person.customer_features(raw["orders"], raw["customers"], raw["payments"], elapsed)
    return staged(lazy, "customer_features")


def profiles(raw: Mapping[str, DataFrame], elapsed: bool = False) -> DataFrame:
    return customer_profiles(features(raw, elapsed))


def cycles(raw: Mapping[str, DataFrame], elapsed: bool = False) -> DataFrame:
    return billing_cycles(profiles(raw, elapsed))


def staged_cycles(raw: Mapping[str, DataFrame], elapsed: bool = False) -> DataFrame:
    """The billing cycles as a written table, for whoever reads them more than once."""
    return staged(cycles(raw, elapsed), "billing_cycles")


def order_facts(raw: Mapping[str, DataFrame]) -> DataFrame:
    return orders.int_order_facts(raw["orders"], raw["customers"], raw["payments"], raw["order_items"])


def models(raw: Mapping[str, DataFrame], cycle_table: DataFrame) -> dict[str, DataFrame]:
    """All staging, intermediate and mart models by name, over cycles at hand; nothing runs yet."""
    built = {**{name: raw[name] for name in STAGED_SOURCES}, "subscription_cycles": cycle_table}
    lazy = [model for model in declared() if model.name not in built]
    wanted = [m.name for m in lazy if m.name.startswith(("stg_", "int_", "mart_"))]
    for model in in_order(needed(lazy, wanted), built):
        built[model.name] = model.build(*[built[name] for name in model.needs])
    return {name: built[name] for name in wanted}


def model_materialize(raw: Mapping[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """Build every declared model once, in order, the tables among them under ``root``."""
    sources = {name: raw[name] for name in STAGED_SOURCES}
    return materialised(raw["orders"].sparkSession, declared(), sources, root)


def table_checks() -> list[quality.Check]:
    """The checks that one pass over their table settles."""
    return [
        quality.not_null("stg_customers", "customer_id"),
        quality.not_null("stg_customers", "customer_unique_id"),
        quality.not_null("stg_orders", "order_id"),
        quality.accepted("stg_orders", "order_status", m.ORDER_STATUSES),
        quality.not_null("stg_payments", "payment_value"),
        quality.non_negative("stg_payments", "payment_value"),
        quality.not_null("stg_subscription_cycles", "subscription_id"),
        quality.not_null("stg_subscription_cycles", "cycle_number"),
        quality.not_null("stg_subscription_cycles", "billing_amount"),
        quality.non_negative("stg_subscription_cycles", "billing_amount"),
        quality.not_null("mart_cohort_retention", "retention_rate"),
        quality.not_null("mart_segment_retention", "retention_rate"),
        quality.between_zero_and_one("mart_segment_retention", "retention_rate"),
    ]


def quality_report(built: Mapping[str, DataFrame]) -> DataFrame:
    """Status rows of all sixteen table checks: one pass per table, one shuffle per unique key."""
    return quality.all_of(
        quality.fused(built, table_checks()), unique_report(built), unique_cycle_report(built)
    )


def not_null_report(built: Mapping[str, DataFrame]) -> DataFrame:
    checked = {
        "stg_customers": ["customer_id", "customer_unique_id"],
        "stg_orders": ["order_id"],
        "stg_payments": ["payment_value"],
        "stg_subscription_cycles": ["subscription_id", "cycle_number", "billing_amount"],
        "mart_cohort_retention": ["retention_rate"],
        "mart_segment_retention": ["retention_rate"],
    }
    return quality.all_of(
        *[quality.not_null_status(built[t], t, columns) for t, columns in checked.items()]
    )


def unique_report(built: Mapping[str, DataFrame]) -> DataFrame:
    keys = {"stg_customers": "customer_id", "stg_orders": "order_id"}
    return quality.all_of(
        *[
            quality.status(f"{t}.{key} unique", quality.duplicate_keys(built[t], key))
            for t, key in keys.items()
        ]
    )


def accepted_values_report(built: Mapping[str, DataFrame]) -> DataFrame:
    unexpected = quality.unexpected_values(built["stg_orders"], "order_status", m.ORDER_STATUSES)
    return quality.status("stg_orders.order_status accepted", unexpected)


def non_negative_report(built: Mapping[str, DataFrame]) -> DataFrame:
    return quality.all_of(
        *[
            quality.status(f"{t}.{c} non-negative", quality.negative_values(built[t], c))
            for t, c in {
                "stg_subscription_cycles": "billing_amount",
                "stg_payments": "payment_value",
            }.items()
        ]
    )


def rate_bounds_report(built: Mapping[str, DataFrame]) -> DataFrame:
    return quality.status(
        "mart_segment_retention.retention_rate in [0, 1]",
        quality.rates_out_of_bounds(built["mart_segment_retention"]),
    )


def unique_cycle_report(built: Mapping[str, DataFrame]) -> DataFrame:
    return quality.status(
        "stg_subscription_cycles (subscription_id, cycle_number) unique",
        quality.duplicate_cycles(built["stg_subscription_cycles"]),
    )


def with_modelled_files(
    spark: SparkSession, files: Mapping[str, RawFile], root: str
) -> dict[str, RawFile]:
    """Add marketing spend and catalog attributes, written as CSV, where no file is given."""
    complete = dict(files)
    products = files["products"]
    modelled = {
        "marketing_spend": lambda: marketing_spend(standard_spine(spark)),
        "catalog_overrides": lambda: catalog_tiers(
            dedupe_rows(csv_scan(spark, products.path, products.schema).select("product_id"))
        ),
    }
    for name, build in modelled.items():
        if name not in files:
            path = f"{root}/{name}.csv"
            csv_sink(build(), path)
            complete[name] = RawFile(path, schema=RAW_SCHEMAS[name])
    return complete


def run(
    spark: SparkSession,
    files: Mapping[str, RawFile],
    root: str,
    min_cohort: int = m.MIN_COHORT_SIZE,
    min_order_rows: int = m.MIN_ORDER_ROWS,
) -> dict[str, DataFrame]:
    """Everything once: CSV files in, bronze, cycles, marts, audit and metrics under ``root``.

    Marketing spend and catalog attributes are modelled when ``files`` has none.  Stops
    at a missing source or column before any work, at a failed table check, at a
    metric gate, and where the metrics come out otherwise when counted once more by sorting.
    Records that are not in order lie under ``root/rejects``.  The session must run in UTC, as days and months are those of UTC.
    """
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the session's time zone is {zone}; set spark.sql.session.timeZone to UTC")
    require_files(spark, files)
    files = with_modelled_files(spark, files, f"{root}/modelled")
    audit = ingest_audit(spark, files, f"{root}/bronze", f"{root}/rejects")
    json_sink(audit, f"{root}/ingest_audit")
    raw = parquet_scan(spark, f"{root}/bronze", files)
    require_sources(raw)
    tables = model_materialize(raw, root)
    cycle_table = tables["subscription_cycles"]
    tables["ingest_audit"] = audit
    tables["ingest_rejects"] = ingest_rejects(spark, files, f"{root}/rejects")
    tables["quality_report"] = _kept(quality_report(tables), f"{root}/quality_report")
    quality.require_passed(tables["quality_report"])
    record = metrics.summary_metrics(raw, cycle_table, min_cohort)
    tables["summary_metrics"] = _kept(record, f"{root}/summary_metrics")
    tables["metric_gates"] = quality.metric_gates(tables["summary_metrics"], min_order_rows)
    quality.require_passed(tables["metric_gates"])
    check = metrics.metrics_crosscheck(tables["summary_metrics"], recounted_metrics(raw, cycle_table, min_cohort))
    tables["metrics_crosscheck"] = _kept(check, f"{root}/metrics_crosscheck")
    quality.require_agreement(tables["metrics_crosscheck"])
    csv_sink(cycle3_rates(tables["segment_retention_cycle3"]), f"{root}/segment_retention")
    return tables


def cycle3_rates(segments: DataFrame) -> DataFrame:
    """The published table of one rate per segment."""
    return segments.select("value_segment", F.col("retention_rate").alias("cycle3_retention_rate"))


def _kept(report: DataFrame, path: str) -> DataFrame:
    """A small report, written as JSON and read back."""
    json_sink(report, path)
    return report.sparkSession.read.schema(report.schema).json(path)
