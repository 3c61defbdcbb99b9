"""Files, contracts, the shared folder and the whole pipeline from CSV."""

import json
from datetime import datetime

import pytest

from subledger.operators.quality import QualityFailure
from subledger.plans import pipeline
from subledger.schemas import RAW_SCHEMAS, TIMESTAMP_COLUMNS, fields
from subledger.sources import contract, files, shared_folder, star_schema
from subledger.sources.files import RawFile

SF = "/root/testdata/sf0.01"


def test_inference_turns_prefixes_into_numbers(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("id,zip,month,bought\na,01037,2016-09-01,2017-10-02 10:56:33\n")
    types = dict(files.csv_scan(spark, str(path)).dtypes)
    assert (types["id"], types["zip"], types["bought"]) == ("string", "int", "timestamp")


def test_bad_timestamps_become_null_and_absent_columns_are_ignored(spark):
    df = spark.createDataFrame([("2017-10-02 10:56:33",), ("yesterday",), ("",), (None,)], "t string")
    got = [r.t for r in files.parse_ts_if_present(df, ["t", "u"]).collect()]
    assert got == [datetime(2017, 10, 2, 10, 56, 33), None, None, None]


def test_duplicates_go_nulls_included(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "a"), (1, "a")], "a int, b string")
    assert files.dedupe_rows(df).count() == 3


def test_ingest_counts_rows_after_deduplication(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text("order_id,shipping_limit_date\n1,2020-01-01 00:00:00\n1,2020-01-01 00:00:00\n2,oops\n")
    source = RawFile(str(path), ["shipping_limit_date"], "order_id string, shipping_limit_date string")
    audit = files.ingest_audit(spark, {"items": source}, str(tmp_path / "bronze")).collect()
    assert [tuple(r) for r in audit] == [("items", 3, 2, 1, 0, 2, "o.csv")]
    assert spark.read.parquet(str(tmp_path / "bronze/items")).count() == 2


def test_partitioned_bronze(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    files.bronze_write(df, str(tmp_path / "t"), ["k"])
    assert (tmp_path / "t" / "k=a").is_dir()


LAYOUT = "order_id string, n int, value double, day date, at timestamp"


def csv_of(tmp_path, text):
    path = tmp_path / "given.csv"
    path.write_text(text)
    return str(path)


def test_columns_are_known_by_name(spark, tmp_path):
    path = csv_of(tmp_path, "value,note,day,at,order_id,n\n10.5,hi,2020-01-02,2020-01-02 03:04:05,a,3.0\n,,,oops,,\n")
    df = files.csv_scan(spark, path, LAYOUT)
    assert df.columns == ["value", "note", "day", "at", "order_id", "n"]
    first, second = df.collect()
    assert (first.order_id, first.n, first.value, first.note) == ("a", 3, 10.5, "hi")
    assert (first.day, first["at"]) == (datetime(2020, 1, 2).date(), datetime(2020, 1, 2, 3, 4, 5))
    assert list(second) == [None] * 6


REVIEWS = RAW_SCHEMAS["reviews"]
AWKWARD_REVIEWS = (
    "review_score,review_id,comment,order_id,review_creation_date,review_answer_timestamp\n"
    '5,a,"two\nlines, ""quoted""",o1,2018-01-01 00:00:00,\n'
    '5,a,"two\nlines, ""quoted""",o1,2018-01-01 00:00:00,\n'
    'five,b,"bad\n\nscore",o2,2018-01-01 00:00:00,\n'
    "4,c,plain \"marks\" inside,o3,no day,2018-01-02 00:00:00\n"
    "3,d,short\n"
    "3,e,long,o5,2018-01-01 00:00:00,,,\n"
    ",,,,,\n"
    '2,f,"never closed,o6,2018-01-01 00:00:00,\n'
)


def test_records_across_lines_and_rejects(spark, tmp_path):
    files_in = {"reviews": RawFile(csv_of(tmp_path, AWKWARD_REVIEWS), TIMESTAMP_COLUMNS["reviews"], REVIEWS)}
    audit = files.ingest_audit(spark, files_in, str(tmp_path / "bronze")).collect()
    assert [tuple(r) for r in audit] == [("reviews", 8, 3, 1, 4, 6, "given.csv")]
    rows = {r.review_id: r for r in spark.read.parquet(str(tmp_path / "bronze/reviews")).collect()}
    assert set(rows) == {"a", "c", None}
    assert (rows["a"].comment, rows["a"].review_score) == ('two\nlines, "quoted"', 5)
    assert (rows["c"].comment, rows["c"].review_creation_date) == ('plain "marks" inside', None)
    assert rows["c"].review_answer_timestamp == datetime(2018, 1, 2)
    bad = files.ingest_rejects(spark, ["reviews"], str(tmp_path / "bronze_rejects"))
    assert bad.schema.simpleString().startswith("struct<source:string,file:string,reason:string,_corrupt_record:string")
    bad = sorted(bad.collect(), key=lambda r: r._corrupt_record)
    assert [r._corrupt_record.split(",")[1] for r in bad] == ["f", "d", "e", "b"]
    assert {r.reason for r in bad} == {"fields do not fit the header", "column review_score: no int: five"}
    assert 'bad\n\nscore' in bad[3]._corrupt_record
    assert all(r.file.endswith("/given.csv") and r.source == "reviews" for r in bad)


def test_clean_and_empty_files_have_an_empty_reject_table(spark, tmp_path):
    for text, rows in (("id,_corrupt_record,copies\n1,x,2\n1,x,2\n", 1), ("id,_reason\n", 0)):
        audit = files.ingest_audit(spark, {"t": RawFile(csv_of(tmp_path, text))}, str(tmp_path / "b"))
        assert audit.select("rows", "rejects").collect() == [(rows, 0)]
        assert files.ingest_rejects(spark, ["t"], str(tmp_path / "b_rejects")).count() == 0
    some = csv_of(tmp_path, "id,n\n1,2\n2,3,4\n3\n")
    audit = files.ingest_audit(spark, {"t": RawFile(some, line_breaks=False)}, str(tmp_path / "b")).first()
    assert (audit.records, audit.rows, audit.rejects) == (3, 1, 2)


def test_missing_columns_and_bad_numbers_stop_the_scan(spark, tmp_path):
    with pytest.raises(contract.MissingSources, match="order_id"):
        files.csv_scan(spark, csv_of(tmp_path, "id,n,value,day,at\n"), LAYOUT)
    for row in ("a,1,\"1.234,50\",,", "a,1.5,1,,", "a,x,1,,", "a,1,1,02.01.2020,"):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|no (int|double|date)"):
            files.csv_scan(spark, csv_of(tmp_path, f"order_id,n,value,day,at\n{row}\n"), LAYOUT).collect()


def test_nothing_is_written_when_a_source_is_missing(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(contract.MissingSources, match="products"):
        pipeline.run(spark, {}, str(out))
    given = {}
    for name, layout in RAW_SCHEMAS.items():
        header = ",".join(column for column, _ in fields(layout)) or "a"
        path = tmp_path / f"{name}.csv"
        path.write_text(header.replace("customer_unique_id,", "") + "\n")
        given[name] = RawFile(str(path), (), layout or None)
    with pytest.raises(contract.MissingSources, match="customers: customer_unique_id$"):
        pipeline.run(spark, given, str(out))
    given["reviews"] = RawFile(str(tmp_path / "nowhere.csv"))
    with pytest.raises(contract.MissingSources, match="reviews: \\*"):
        pipeline.run(spark, given, str(out))
    assert not out.exists()


def test_other_time_zones_are_refused(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="Berlin"):
            pipeline.run(spark, {}, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_contract_names_what_is_missing(spark):
    raw = dict(star_schema.raw_tables(spark, SF))
    contract.require_sources(raw)
    assert contract.contract_violations(spark, raw).count() == 0
    del raw["reviews"]
    raw["orders"] = raw["orders"].drop("order_status")
    found = {tuple(r) for r in contract.contract_violations(spark, raw).collect()}
    assert found == {("reviews", "*"), ("orders", "order_status")}
    with pytest.raises(contract.MissingSources, match="reviews"):
        contract.require_sources(raw)


def test_staged_tables_lie_in_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder.new_path(spark, "x").startswith(f"{folder}/subledger/")
    df = shared_folder.staged(spark.range(5), "five")
    assert df.count() == 5 and folder in df.inputFiles()[0]


def test_a_failed_check_stops_the_run(spark, tmp_path):
    sources = {}
    for name, table in star_schema.raw_tables(spark, SF.replace("0.01", "0.001")).items():
        if name == "payments":
            table = table.withColumn("payment_value", -table.payment_value)
        path = str(tmp_path / f"{name}.csv")
        files.csv_sink(table, path)
        sources[name] = RawFile(path, TIMESTAMP_COLUMNS.get(name, ()), RAW_SCHEMAS[name] or None)
    with pytest.raises(QualityFailure, match="payment_value non-negative"):
        pipeline.run(spark, sources, str(tmp_path / "out"), min_cohort=1)


def test_missing_modelled_files_are_written(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_id,x\nsample_product_001,1\nb,2\nb,2\n")
    given = {"products": RawFile(str(tmp_path / "p.csv"))}
    complete = pipeline.with_modelled_files(spark, given, str(tmp_path / "modelled"))
    assert set(complete) == {"products", "marketing_spend", "catalog_overrides"}
    audit = {r.name: r.rows for r in files.ingest_audit(spark, complete, str(tmp_path / "bronze")).collect()}
    assert audit == {"products": 2, "marketing_spend": 832, "catalog_overrides": 2}
    spend = spark.read.parquet(str(tmp_path / "bronze/marketing_spend"))
    assert spend.dtypes == [
        ("month", "date"), ("customer_state", "string"), ("channel", "string"),
        ("spend_brl", "double"), ("impressions", "bigint"), ("clicks", "bigint"),
    ]
    first = spend.filter("month = '2016-09-01' and customer_state = 'SP' and channel = 'paid_search'").first()
    assert first.spend_brl == 6645.40


def test_whole_pipeline_from_csv(spark, tmp_path):
    sources = {}
    for name, table in star_schema.raw_tables(spark, SF).items():
        path = str(tmp_path / "csv" / f"{name}.csv")
        files.csv_sink(table, path)
        if name == "reviews":
            (tmp_path / "csv/reviews.csv/more.csv").write_text(
                "review_id,order_id,review_score,review_creation_date,review_answer_timestamp\n"
                'x,"two\n""lines""",5,2018-01-01 00:00:00,\nx,bad,five,2018-01-01 00:00:00,\n'
            )
        sources[name] = RawFile(path, TIMESTAMP_COLUMNS.get(name, ()), RAW_SCHEMAS[name] or None)
    root = str(tmp_path / "out")
    with pytest.raises(QualityFailure, match="enough orders"):
        pipeline.run(spark, sources, root)
    tables = pipeline.run(spark, sources, root, min_order_rows=10_000)
    record = tables["summary_metrics"].first()
    # exact duplicate lines do not exist in the test tables, so nothing is lost on the way
    assert (record.real_orders, record.synthetic_subscribers, record.synthetic_billing_cycles) == (15000, 445, 1955)
    assert (record.best_segment, record.worst_segment) == ("value_4", "value_1")
    assert tables["mart_cohort_retention"].count() == 352
    assert tables["mart_marketing_efficiency"].count() == 2050
    report = tables["quality_report"].collect()
    assert len(report) == 16 and all(r.passed for r in report)
    assert [r.passed for r in tables["metric_gates"].collect()] == [1, 1, 1]
    assert spark.table("mart_segment_retention").count() == 24
    audit = [json.loads(line) for part in (tmp_path / "out/ingest_audit").glob("*.json") for line in part.read_text().splitlines()]
    assert {a["name"]: a["rows"] for a in audit}["orders"] == 15000
    assert {a["source"] for a in audit} == {f"{name}.csv" for name in sources}
    assert all(a["records"] == a["rows"] + a["duplicates"] + a["rejects"] for a in audit)
    assert {a["name"] for a in audit if a["rejects"]} == {"reviews"}
    assert [(r.source, r.reason) for r in tables["ingest_rejects"].collect()] == [("reviews", "column review_score: no int: five")]
