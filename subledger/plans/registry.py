"""Registered queries: one callable (spark, sf_dir) → DataFrame per operator."""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.operators import customers, marts, metrics, profiles, quality
from subledger.operators.cycles import cycle_anchor
from subledger.operators.orders import (
    delivered_orders,
    items_by_order,
    order_gaps,
    orders_customers,
    orders_items_left,
    orders_payments_left,
    payments_by_order,
)
from subledger.operators.staging import (
    STAGED_SOURCES,
    stage_source,
    staging_models,
    stg_subscription_cycles,
)
from subledger.operators.recount import recounted_metrics
from subledger.plans import incremental, pipeline
from subledger.plans.models import TABLE
from subledger.schemas import RAW_SCHEMAS, TIMESTAMP_COLUMNS
from subledger.sources import files, star_schema
from subledger.sources.bucketed import Bucketed, by_key, laid_out
from subledger.sources.contract import source_contract
from subledger.sources.files import RawFile
from subledger.sources.modelled import catalog_tiers, marketing_spend
from subledger.sources.shared_folder import new_path, staged

Query = Callable[[SparkSession, str], DataFrame]
raw_tables = star_schema.raw_tables


# --- files -------------------------------------------------------------------


def _as_csv(df: DataFrame, name: str) -> str:
    path = new_path(df.sparkSession, name)
    files.csv_sink(df, path)
    return path


def _raw_files(spark: SparkSession, sf_dir: str) -> dict[str, RawFile]:
    """Every raw source written out as CSV, the layout declared where it is known.

    The reviews hold comments of several lines, copies, and scores that are no numbers.
    """
    raw = raw_tables(spark, sf_dir)
    paths = {
        name: _shuffled_csv(_spoiled_reviews(table), name) if name == "reviews" else _as_csv(table, name)
        for name, table in raw.items()
    }
    return {
        name: RawFile(path, TIMESTAMP_COLUMNS.get(name, ()), RAW_SCHEMAS[name] or None)
        for name, path in paths.items()
    }


def _spoiled_reviews(reviews: DataFrame) -> DataFrame:
    """Every 89th score written out as a word, every 31st review there twice."""
    number = F.col("review_id").cast("bigint")
    score = F.when(number % 89 == 0, F.lit("five")).otherwise(F.col("review_score").cast("string"))
    return reviews.union(reviews.filter(number % 31 == 0)).withColumn("review_score", score)


def _shuffled_csv(df: DataFrame, name: str) -> str:
    """Written with its columns backwards and a comment among them: names decide, not places.

    The comment has two lines, quotes and a comma.
    """
    columns = [F.col(c) for c in reversed(df.columns)]
    comment = F.concat(F.lit('said "'), columns[-1].cast("string"), F.lit('",\nthen "left"'))
    return _as_csv(df.select(columns[0], comment.alias("comment"), *columns[1:]), name)


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shuffled_csv(star_schema.order_items(spark, sf_dir), "order_items")
    return files.dedupe_rows(files.csv_scan(spark, path, RAW_SCHEMAS["order_items"])).drop("comment")


def parse_ts_if_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.col("ts").cast("string")
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("?"), written)).otherwise(written)
    events = star_schema.table(spark, sf_dir, "events").select("event_id", text.alias("ts"))
    return files.parse_ts_if_present(events, ["ts", "no_such_column"])


def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = star_schema.table(spark, sf_dir, "lineitem")
    return files.dedupe_rows(lines.unionByName(lines))


def bronze_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "payments")
    files.bronze_write(star_schema.payments(spark, sf_dir), path)
    return spark.read.schema(RAW_SCHEMAS["payments"]).parquet(path)


def bronze_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shuffled_csv(star_schema.orders(spark, sf_dir), "orders")
    source = RawFile(path, TIMESTAMP_COLUMNS["orders"], RAW_SCHEMAS["orders"])
    target, rejects = new_path(spark, "bronze_orders"), new_path(spark, "bronze_rejects")
    done = files.bronze_ingest(spark, "orders", source, target, rejects)
    return spark.createDataFrame(
        [("orders", *done)], "name string, rows bigint, duplicates bigint, rejects bigint, columns int"
    )


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ingest_audit(spark, _raw_files(spark, sf_dir), new_path(spark, "bronze"))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews' rejects: why, and the record as it stood in the file, read once more."""
    path = _shuffled_csv(_spoiled_reviews(star_schema.reviews(spark, sf_dir)), "reviews")
    source = RawFile(path, TIMESTAMP_COLUMNS["reviews"], RAW_SCHEMAS["reviews"])
    rejects = new_path(spark, "rejects")
    files.bronze_ingest(spark, "reviews", source, new_path(spark, "bronze_reviews"), f"{rejects}/reviews")
    layout = "answered string, comment string, created string, score string, order_id string, review_id string"
    record = F.from_csv("_corrupt_record", F.lit(layout), {"escape": '"', "multiLine": "true"}).alias("r")
    return files.ingest_rejects(spark, ["reviews"], rejects).select("source", "reason", record).select(
        "source", "reason", "r.comment", "r.score", "r.order_id", "r.review_id"
    )


def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "raw")
    tables = raw_tables(spark, sf_dir)
    for name, table in tables.items():
        files.bronze_write(table, f"{root}/{name}")
    return files.row_counts(files.parquet_scan(spark, root, tables))


def cycle_table_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.cycle_table_write(
        pipeline.cycles(raw_tables(spark, sf_dir)), new_path(spark, "subscription_cycles")
    )


def metrics_json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    record, path = summary_metrics(spark, sf_dir), new_path(spark, "summary_metrics")
    files.json_sink(record, path)
    return spark.read.schema(record.schema).json(path)


def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _as_csv(pipeline.cycle3_rates(segment_retention_cycle3(spark, sf_dir)), "segment_retention")
    return files.csv_scan(spark, path, "value_segment string, cycle3_retention_rate double")


def model_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = pipeline.model_materialize(raw_tables(spark, sf_dir), new_path(spark, "warehouse"))
    counts = files.row_counts(tables)
    written = [model.name for model in pipeline.declared() if model.kept == TABLE]
    kind = F.when(F.col("name").isin(written), "table").otherwise("view")
    return counts.select(F.col("name").alias("model"), kind.alias("materialization"), "rows")


# --- staging -----------------------------------------------------------------


def _staging(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_source(name, raw_tables(spark, sf_dir)[name])


def _staged_models(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return staging_models(raw_tables(spark, sf_dir))


# --- shared inputs -----------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.features(raw_tables(spark, sf_dir))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.profiles(raw_tables(spark, sf_dir))


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.cycles(raw_tables(spark, sf_dir))


def _staged_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.staged_cycles(raw_tables(spark, sf_dir))


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.order_facts(raw_tables(spark, sf_dir))


def _models(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = raw_tables(spark, sf_dir)
    return pipeline.models(raw, pipeline.staged_cycles(raw))


def _over(build: Callable[..., DataFrame], source: Query, *args) -> Query:
    """A query that applies ``build`` to one prepared table."""
    return lambda spark, sf_dir: build(source(spark, sf_dir), *args)


def _bucketed(spark: SparkSession, sf_dir: str) -> dict[str, Bucketed]:
    raw = raw_tables(spark, sf_dir)
    tables = {name: raw[name] for name in ("orders", "payments", "order_items")}
    return laid_out(tables, "order_id", 16, new_path(spark, "by_order"))


def orders_payments_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _bucketed(spark, sf_dir)
    return by_key(orders_payments_left, tables["orders"], tables["payments"])


def orders_items_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _bucketed(spark, sf_dir)
    return by_key(orders_items_left, tables["orders"], tables["order_items"])


# --- joins and aggregations ----------------------------------------------------


def cycles_cohort_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = _staged_cycles(spark, sf_dir)
    sizes = staged(marts.cohort_sizes(cycles, "value_segment"), "cohort_sizes")
    return marts.cycles_cohort_inner(cycles, sizes, "value_segment")


def _efficiency_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spend = marketing_spend(star_schema.spend_spine(spark, sf_dir))
    return (
        marts.revenue_by_month_state(_order_facts(spark, sf_dir)),
        marts.spend_by_month_state(spend),
    )


def _efficiency_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tables(spark, sf_dir)
    return marts.mart_marketing_efficiency(pipeline.order_facts(raw), raw["marketing_spend"])


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tables(spark, sf_dir)
    return customers.customer_features(raw["orders"], raw["customers"], raw["payments"])


def customer_features_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = star_schema.event_shop_tables(spark, sf_dir)
    return customers.customer_features(
        shop["orders"], shop["customers"], shop["payments"], elapsed=True
    )


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tables(spark, sf_dir)
    cycles = pipeline.staged_cycles(raw)
    return metrics.source_counts(raw["orders"], raw["payments"], raw["order_items"], cycles)


def segment_retention_cycle3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.segment_retention_at(_cycles(spark, sf_dir))


def retention_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retention_spread(
        metrics.eligible_segments(segment_retention_cycle3(spark, sf_dir))
    )


def summary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tables(spark, sf_dir)
    return metrics.summary_metrics(raw, pipeline.staged_cycles(raw))


def metrics_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both day semantics over the event shop, where they differ.

    The least cohort is 1, as the shop of the test tables is too small for the usual one.
    """
    shop = star_schema.event_shop_tables(spark, sf_dir)
    records = [
        metrics.summary_metrics(shop, pipeline.staged_cycles(shop, elapsed), min_cohort=1)
        for elapsed in (False, True)
    ]
    return metrics.metrics_crosscheck(*records)


def metrics_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric record and its recount by sorting, over the same cycles."""
    raw = raw_tables(spark, sf_dir)
    cycles = pipeline.staged_cycles(raw)
    return metrics.metrics_crosscheck(
        metrics.summary_metrics(raw, cycles, min_cohort=1), recounted_metrics(raw, cycles, min_cohort=1)
    )


def customer_features_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features after two batches of orders, of which the second also holds earlier days."""
    raw, state = raw_tables(spark, sf_dir), new_path(spark, "customer_days")
    number = F.col("order_id").cast("bigint")
    for batch in (0, 1):
        some = raw["orders"].filter(F.pmod(number, F.lit(2)) == batch)
        found = incremental.update_features(spark, state, some, raw["customers"], raw["payments"])
    return found


def retention_incremental(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retention mart after three batches: early cycles, late ones, and all once more."""
    cycles, root = _staged_cycles(spark, sf_dir), new_path(spark, "retention")
    for batch in (cycles.filter("cycle_number <= 2"), cycles.filter("cycle_number > 2"), cycles):
        found = incremental.update_retention(spark, root, batch, (key,))[key]
    return found


# --- windows -----------------------------------------------------------------


def order_gaps_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_tables(spark, sf_dir)
    return order_gaps(orders_customers(delivered_orders(raw["orders"]), raw["customers"]))


def order_gaps_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = star_schema.table(spark, sf_dir, "events")
    return order_gaps(events, "user_id", "event_id", "ts", elapsed=True)


# --- model -------------------------------------------------------------------


def stable_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = star_schema.table(spark, sf_dir, "events")
    return profiles.stable_hash_split(events, "user_id", "event_type", "event_id").select(
        "event_id", "user_id", "u"
    )


SCORE_INPUTS = ["customer_unique_id", "order_count", "avg_delivery_delay_days", "total_spend"]


def spend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.with_spend_signal(_profiles(spark, sf_dir)).select(
        "customer_unique_id", "total_spend", F.round("spend_signal", 9).alias("spend_signal")
    )


def enrollment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(profiles.enrollment_probability(), 9).alias("enrollment_score")
    return _profiles(spark, sf_dir).select(*SCORE_INPUTS, score)


def renewal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.renewal_scores(_profiles(spark, sf_dir)).select(
        *SCORE_INPUTS,
        "cadence_days",
        "cycle_number",
        F.round("renewal_score", 9).alias("renewal_score"),
    )


# --- the list ------------------------------------------------------------------


def queries() -> dict[str, Query]:
    segment_mart = _over(marts.mart_segment_retention, _cycles)
    cohort_mart = _over(marts.mart_cohort_retention, _cycles)
    kpi_mart = _over(marts.mart_subscription_kpis, _cycles)
    return {
        # files
        "csv_scan": csv_scan,
        "parse_ts_if_present": parse_ts_if_present,
        "dedupe_rows": dedupe_rows,
        "bronze_write": bronze_write,
        "bronze_ingest": bronze_ingest,
        "ingest_audit": ingest_audit,
        "ingest_rejects": ingest_rejects,
        "parquet_scan": parquet_scan,
        "cycle_table_write": cycle_table_write,
        "source_contract": _over(source_contract, raw_tables),
        "metrics_json_sink": metrics_json_sink,
        "csv_sink": csv_sink,
        "model_materialize": model_materialize,
        # staging
        **{f"stg_{name}": partial(_staging, name) for name in STAGED_SOURCES},
        "stg_subscription_cycles": _over(stg_subscription_cycles, _cycles),
        # filters
        "delivered_orders": _over(delivered_orders, star_schema.orders),
        "cycle_anchor": _over(cycle_anchor, _cycles, 3),
        "eligible_segments": _over(metrics.eligible_segments, segment_retention_cycle3),
        "cycle3_segments": _over(metrics.cycle_segments, segment_mart),
        # joins
        "orders_customers": lambda s, d: orders_customers(
            star_schema.orders(s, d), star_schema.customers(s, d)
        ),
        "orders_payments_left": lambda s, d: orders_payments_left(
            star_schema.orders(s, d), star_schema.payments(s, d)
        ),
        "orders_items_left": lambda s, d: orders_items_left(
            star_schema.orders(s, d), star_schema.order_items(s, d)
        ),
        "orders_payments_bucketed": orders_payments_bucketed,
        "orders_items_bucketed": orders_items_bucketed,
        "revenue_spend_full_outer": lambda s, d: marts.revenue_spend_full_outer(
            *_efficiency_sides(s, d)
        ),
        "cycles_cohort_inner": cycles_cohort_inner,
        "cohort_retained_left": _over(metrics.cohort_retained_left, _cycles),
        "month_state_channel_spine": star_schema.spend_spine,
        # aggregations
        "payments_by_order": _over(payments_by_order, star_schema.payments),
        "items_by_order": _over(items_by_order, star_schema.order_items),
        "int_order_facts": _order_facts,
        "customer_features": customer_features,
        "customer_features_incremental": customer_features_incremental,
        "customer_features_elapsed": customer_features_elapsed,
        "int_customer_features": _over(customers.int_customer_features, _order_facts),
        "spend_quartiles": _over(profiles.spend_quartiles, _features),
        "fallback_cadence": _over(profiles.fallback_cadence, customer_features),
        "mart_subscription_kpis": kpi_mart,
        "mart_customer_ltv": _over(marts.mart_customer_ltv, _cycles),
        "cohort_sizes": _over(
            marts.cohort_sizes, _over(marts.with_cohort_month, _cycles), "cohort_month"
        ),
        "mart_segment_retention": segment_mart,
        "mart_cohort_retention": cohort_mart,
        "segment_retention_incremental": partial(retention_incremental, "value_segment"),
        "cohort_retention_incremental": partial(retention_incremental, "cohort_month"),
        "mart_marketing_efficiency": _efficiency_mart,
        "revenue_by_month_state": _over(marts.revenue_by_month_state, _order_facts),
        "spend_by_month_state": _over(
            marts.spend_by_month_state, _over(marketing_spend, star_schema.spend_spine)
        ),
        "source_counts": source_counts,
        "segment_retention_cycle3": segment_retention_cycle3,
        "retention_spread": retention_spread,
        "retention_spread_sql": _over(metrics.retention_spread_of_mart, segment_mart),
        "churn_rate": _over(metrics.churn_rate, _cycles),
        "avg_ltv": _over(metrics.avg_ltv, _cycles),
        "summary_metrics": summary_metrics,
        "monthly_revenue_vs_spend": _over(metrics.monthly_revenue_vs_spend, _efficiency_mart),
        "segment_retention_pivot": lambda s, d: metrics.segment_retention_pivot(
            staged(segment_mart(s, d), "segment_mart")
        ),
        "cohort_curve": _over(
            metrics.cohort_curve, _over(marts.mart_cohort_retention, _staged_cycles)
        ),
        "cohort_months": _over(metrics.cohort_months, cohort_mart),
        # windows
        "order_gaps": order_gaps_by_day,
        "cohort_month": lambda s, d: marts.with_cohort_month(_cycles(s, d)).select(
            "subscription_id", "cycle_number", "renewed", "cohort_month"
        ),
        "order_gaps_elapsed": order_gaps_elapsed,
        # analyst queries
        "segment_curve": _over(metrics.segment_curve, segment_mart),
        "cohort_curve_all": _over(metrics.cohort_curve_all, cohort_mart),
        "kpi_snapshot": _over(metrics.kpi_snapshot, kpi_mart),
        # model
        "stable_hash_split": stable_hash_split,
        "spend_signal": spend_signal,
        "enrollment_score": enrollment_score,
        "renewal_score": renewal_score,
        "enrolled_customers": _over(profiles.enrolled_customers, _profiles),
        "cadence_days": lambda s, d: profiles.with_cadence(_features(s, d)).select(
            "customer_unique_id", "cadence_days"
        ),
        "value_segment": lambda s, d: profiles.with_value_segment(_features(s, d)).select(
            "customer_unique_id", "total_spend", "value_segment"
        ),
        "customer_profiles": _profiles,
        "billing_cycles": _cycles,
        "marketing_spend": _over(marketing_spend, star_schema.spend_spine),
        "catalog_tiers": _over(catalog_tiers, star_schema.products),
        # quality
        "dq_not_null": _over(pipeline.not_null_report, _models),
        "dq_unique": _over(pipeline.unique_report, _staged_models),
        "dq_accepted_values": _over(pipeline.accepted_values_report, _staged_models),
        "dq_non_negative": _over(pipeline.non_negative_report, _models),
        "dq_rate_bounds": _over(pipeline.rate_bounds_report, _models),
        "dq_unique_cycle": _over(pipeline.unique_cycle_report, _models),
        "dq_metric_gates": _over(quality.metric_gates, summary_metrics),
        "metrics_crosscheck": metrics_crosscheck,
        "metrics_recount": metrics_recount,
        "quality_report": _over(pipeline.quality_report, _models),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["mart_segment_retention"](spark, sf_dir)
