"""The registry of models, scratch space, features by batches, fused checks and the recount."""

import random
import re
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from subledger.operators import bitmaps, marts, metrics, orders, quality
from subledger.operators.customers import customer_days, customer_features, features_of_days, merged_days
from subledger.operators.orders import orders_customers, orders_payments_left
from subledger.operators.recount import recounted_metrics
from subledger.plans import incremental, models, pipeline
from subledger.plans.models import TABLE, BadModels, Model
from subledger.sources import shared_folder, star_schema
from tests.test_features import START, customer, frames, order
from tests.test_marts import cycle, table
from tests.test_plans import physical

SF = "/root/testdata/sf0.001"


def model(name, *needs, kept=models.VIEW):
    return Model(name, needs, lambda *tables: tables[0], kept)


def test_models_come_after_what_they_need():
    found = models.in_order([model("c", "b", "a"), model("b", "a"), model("d", "source"), model("a", "source")], {"source"})
    assert [m.name for m in found] == ["a", "b", "c", "d"]
    assert [m.name for m in models.needed(found, ["b"])] == ["a", "b"]
    with pytest.raises(BadModels, match="b needs c needs b"):
        models.in_order([model("a", "b"), model("b", "c"), model("c", "b")], ())
    with pytest.raises(BadModels, match="a needs nothing_such"):
        models.in_order([model("a", "nothing_such")], ())
    with pytest.raises(BadModels, match="twice"):
        models.in_order([model("a"), model("a")], ())
    with pytest.raises(BadModels, match="twice"):
        models.in_order([model("a")], {"a"})


def test_tables_are_swapped_in_and_scratch_goes(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "subledger"
    before = set(shared.glob("*"))
    built = []

    def build(source):
        built.append(shared_folder.staged(source, "on_the_way"))
        return built[-1].selectExpr("id * 2 as id")

    made = [Model("twice", ("source",), build, TABLE), Model("again", ("twice",), lambda t: t.where("id > 2"))]
    for n in (3, 5):
        tables = models.materialised(spark, made, {"source": spark.range(n)}, str(tmp_path / "w"))
        assert tables["twice"].count() == n and spark.table("again").count() == n - 2
    assert len(built) == 2 and set(shared.glob("*")) == before
    assert [p.name for p in (tmp_path / "w/models").iterdir()] == ["twice"]


def test_a_failed_build_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    shared_folder.replaced(spark.range(3), path)
    with pytest.raises(Exception, match="no more"):
        shared_folder.replaced(spark.range(3).select(F.raise_error(F.lit("no more")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    grown = shared_folder.replaced(spark.read.parquet(path).union(spark.range(4)), path)  # reads what it replaces
    assert grown.count() == 7 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_orders_meet_payments_once(spark, tmp_path, monkeypatch):
    calls = []
    whole = orders.orders_payments_left
    monkeypatch.setattr(orders, "orders_payments_left", lambda *a: calls.append(1) or whole(*a))
    tables = pipeline.model_materialize(star_schema.raw_tables(spark, SF), str(tmp_path))
    assert len(calls) == 1
    for name in ("int_customer_features", "customer_features", "mart_marketing_efficiency", "int_order_facts"):
        plan = physical(tables[name])
        assert "payment_sequential" not in plan and "Join" not in plan
    written = {m.name for m in pipeline.declared() if m.kept == TABLE}
    assert {p.name for f in tmp_path.iterdir() for p in f.iterdir()} == written


def test_checks_of_a_table_share_one_pass(spark, tmp_path):
    tables = pipeline.model_materialize(star_schema.raw_tables(spark, SF), str(tmp_path))
    kept = {name: shared_folder.staged(t, name) for name, t in tables.items()}
    checked = {c.table for c in pipeline.table_checks()}
    assert physical(quality.fused(kept, pipeline.table_checks())).count("FileScan") == len(checked) == 6
    assert physical(pipeline.quality_report(kept)).count("FileScan") == 9


def test_fused_checks_count_as_the_single_ones(spark):
    rows = [("a", 1.0, "x"), (None, -1.0, "y"), ("b", None, "z"), (None, 2.0, "z"), ("c", float("nan"), None)]
    df = spark.createDataFrame(rows, "k string, v double, s string")
    checks = [quality.not_null("t", "k"), quality.non_negative("t", "v"), quality.accepted("t", "s", ["x"]),
              quality.between_zero_and_one("t", "v"), quality.not_null("t", "s")]
    got = {r["check"]: (r.violations, r.passed) for r in quality.fused({"t": df}, checks).collect()}
    assert got == {
        "t.k not null": (2, 0), "t.v non-negative": (quality.negative_values(df, "v").count(), 0),
        "t.s accepted": (quality.unexpected_values(df, "s", ["x"]).count(), 0),
        "t.v in [0, 1]": (quality.rates_out_of_bounds(df, "v").count(), 0), "t.s not null": (1, 0),
    }


def shop(spark):
    rng = random.Random(9)
    people = [customer(f"c{i}", f"p{i % 17}", rng.choice(["SP", "RJ", None])) for i in range(25)]
    bought = []
    for i in range(400):
        when = START + timedelta(days=rng.randrange(60), hours=rng.randrange(24))
        got = when + timedelta(hours=rng.randrange(900))
        bought.append(order(f"o{i}", f"c{0 if i % 3 == 0 else rng.randrange(25)}", when, got=got, due=when + timedelta(days=10)))
    paid = [
        {"order_id": f"o{rng.randrange(420)}", "payment_sequential": 1, "payment_type": "x", "payment_installments": 1,
         "payment_value": rng.choice([rng.random() / 100, round(rng.uniform(0, 900), 2), rng.uniform(0, 1e6)])}
        for _ in range(900)
    ]
    return frames(spark, bought, people, paid)


@pytest.mark.parametrize("elapsed", [False, True])
def test_features_of_batches_equal_those_of_all(spark, tmp_path, elapsed):
    o, c, p = shop(spark)
    whole = sorted(map(str, customer_features(o, c, p, elapsed).collect()))
    number = F.crc32(F.col("order_id").cast("binary")) % 3
    state = str(tmp_path / "days")
    for batch in (2, 0, 1):  # late days and earlier ones in every batch
        found = incremental.update_features(spark, state, o.filter(number == batch), c, p, elapsed)
    assert sorted(map(str, found.collect())) == whole
    assert "order_status" not in physical(found)
    parts = [customer_days(orders_payments_left(orders_customers(o.filter(number == b), c), p), elapsed) for b in range(3)]
    merged = features_of_days(merged_days(merged_days(parts[1], parts[2]), parts[0]), elapsed)
    assert sorted(map(str, merged.collect())) == whole
    (tmp_path / "broken").mkdir()
    with pytest.raises(AnalysisException):  # no table, but something: not taken for a first batch
        incremental.update_features(spark, str(tmp_path / "broken"), o, c, p, elapsed)
    same = incremental.update_features(spark, state, o.limit(0), c, p, elapsed)  # nothing new
    assert sorted(map(str, same.collect())) == whole


def cycle_rows():
    rng = random.Random(10)
    rows = []
    for i in range(300):
        last = rng.randrange(1, 7)
        segment = f"value_{1 + i % 4}"
        rows += [cycle(f"{i}", k, 1, 0, segment, rng.choice([39.9, 0.004, rng.uniform(1, 500)])) for k in range(1, last + 1)]
        if last < 6:
            rows.append(cycle(f"{i}", last + 1, 0, 1, segment))
    return rows + rng.sample(rows, 50)  # copies


def test_the_recount_agrees_and_tells_planted_errors(spark):
    cycles = table(spark, cycle_rows())
    raw = {name: cycles.limit(n) for n, name in enumerate(("orders", "payments", "order_items"), 7)}
    record = metrics.summary_metrics(raw, cycles, min_cohort=1)

    def apart(other):
        check = metrics.metrics_crosscheck(record, recounted_metrics(raw, other, min_cohort=1))
        return {r.metric for r in check.collect() if not r.agrees}

    assert apart(cycles) == set()
    assert "synthetic_billing_cycles" in apart(cycles.filter("not (subscription_id = 'sub_0' and cycle_number = 1)"))
    assert apart(cycles.withColumn("billing_amount", F.col("billing_amount") + 1)) == {"synthetic_avg_ltv_brl"}
    assert "synthetic_churn_rate_pct" in apart(cycles.withColumn("churned_this_cycle", F.lit(0)))
    swapped = F.regexp_replace("value_segment", "value_1", "value_2")
    assert "customer_segments" in apart(cycles.withColumn("value_segment", swapped))
    check = metrics.metrics_crosscheck(record, recounted_metrics(raw, cycles.limit(100), min_cohort=1))
    with pytest.raises(quality.QualityFailure, match="synthetic_subscribers"):
        quality.require_agreement(check)
    assert not re.search("metrics|money|marts", Path(recounted_metrics.__code__.co_filename).read_text().split("from collections")[1].split("def ")[0])


def test_bitmaps_count_as_distinct_counts_do(spark, tmp_path, without_broadcast):
    rows = spark.range(0, 70_000, 1, 8).selectExpr(
        "concat('sub_', id) as subscription_id", "cast(1 + id % 6 as int) as last", "if(id % 50 = 0, 'b', 'a') as value_segment"
    )
    cycles = shared_folder.staged(
        rows.withColumn("cycle_number", F.explode(F.sequence(F.lit(1), F.least(F.lit(6), F.col("last") + 1))))
        .withColumn("renewed", (F.col("cycle_number") <= F.col("last")).cast("int"))
        .withColumn("billing_date", F.expr("date_add(date'2020-01-31', 30 * (cycle_number - 1))")),
        "hot_cohort",
    )
    whole = sorted(map(tuple, marts.mart_segment_retention(cycles).collect()))
    root = str(tmp_path / "state")
    for number, batch in enumerate((cycles.filter("cycle_number < 3"), cycles.filter("cycle_number > 2"), cycles.limit(500))):
        found = incremental.update_retention(spark, root, batch)
        numbers = spark.read.parquet(f"{root}/numbers")
        if number == 0:
            first = {r.subscription_id: r.number for r in numbers.collect()}
            assert sorted(first.values()) == list(range(1, 70_001))
    assert sorted(map(tuple, found["value_segment"].collect())) == whole
    assert {r.subscription_id: r.number for r in numbers.collect()} == first
    cohort = sorted(map(tuple, marts.retention(marts.with_cohort_month(cycles), "cohort_month").collect()))
    assert sorted(map(tuple, found["cohort_month"].collect())) == cohort
    plan = physical(bitmaps.active_bits(cycles, numbers, "value_segment"))
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]
    assert sorted(keys)[:2] == ["subscription_id", "subscription_id"] and len(keys) == 3


def test_new_subscriptions_follow_the_known_ones(spark, tmp_path):
    root = str(tmp_path / "state")
    batches = [[cycle("a", 1), cycle("b", 1), cycle("a", 2, 0, 1)], [cycle("c", 1), cycle("b", 2), cycle("b", 2)], []]
    rows = []
    for batch in batches:
        rows += batch
        found = incremental.update_retention(spark, root, table(spark, batch), ("value_segment",))["value_segment"]
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, marts.mart_segment_retention(table(spark, rows)).collect()))
    numbers = {r.subscription_id: r.number for r in spark.read.parquet(f"{root}/numbers").collect()}
    assert sorted(numbers.values()) == [1, 2, 3] and numbers["sub_c"] == 3
