"""Raw files in, columnar tables and small reports out."""

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from subledger.schemas import CYCLES_SCHEMA, fields, typed_columns

AUDIT_SCHEMA = (
    "name string, records bigint, rows bigint, duplicates bigint, rejects bigint, columns int, source string"
)
REJECT_SCHEMA = "source string, file string, reason string, _corrupt_record string"


class MissingSources(ValueError):
    """A required source or column is absent."""


@dataclass(frozen=True)
class RawFile:
    """One raw input: where it lies, which columns are timestamps, its layout if known.

    Quoted values may hold line breaks, so a file is one task's work and a large source
    should come as many files.  Where no value does, ``line_breaks=False`` lets Spark split
    files as well.
    """

    path: str
    date_columns: Sequence[str] = field(default_factory=tuple)
    schema: str | None = None
    line_breaks: bool = True


class Ingested(NamedTuple):
    """What became of a file's records: ``rows`` distinct ones, their copies, and rejects."""

    rows: int
    duplicates: int
    rejects: int
    columns: int


def csv_reader(spark: SparkSession, line_breaks: bool = True) -> DataFrameReader:
    """Headered CSV; within quotes a doubled quote is a quote and a line break is text."""
    return spark.read.options(header=True, escape='"', multiLine=line_breaks, enforceSchema=False)


def csv_scan(
    spark: SparkSession, path: str, schema: str | None = None, line_breaks: bool = True
) -> DataFrame:
    """Headered CSV; columns are known by their names in the header, in its order.

    Declared columns must be there and are cast strictly: text that is no such number or
    date ends the job, except that timestamps which cannot be read become NULL.  Columns
    beyond the declared ones stay, as text.  Without a declared schema Spark reads the file
    twice to infer one.
    """
    if not schema:
        return csv_reader(spark, line_breaks).option("inferSchema", True).csv(path)
    text, declared = header_columns(spark, path, line_breaks), dict(fields(schema))
    _require_columns(path, text.columns, declared)
    return text.select(
        *[strict(name, declared[name]) if name in declared else F.col(f"`{name}`") for name in text.columns]
    )


def header_columns(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A CSV file as text under the names of its header; only the header is read at first."""
    return csv_reader(spark, line_breaks).csv(path)


def _require_columns(path: str, present: Sequence[str], declared: Iterable[str]) -> None:
    missing = [name for name in declared if name not in present]
    if missing:
        raise MissingSources(f"{path}: no column {', '.join(missing)}")


def _read_as(name: str, kind: str) -> tuple[Column, Column]:
    """A text column as ``kind``, and what is wrong with it where it is no such value.

    Whole numbers may be written with a zero fraction.
    """
    text = F.col(f"`{name}`")
    nothing_wrong = F.lit(None).cast("string")
    if kind == "string":
        return text, nothing_wrong
    if kind == "timestamp":
        return F.try_to_timestamp(text), nothing_wrong
    value = text.try_cast(kind)
    if kind in ("int", "bigint"):
        number = text.try_cast("double")
        value = F.coalesce(value, F.when(number == F.rint(number), number.try_cast(kind)))
    wrong = F.concat(F.lit(f"column {name}: no {kind}: "), text)
    return value, F.when(text.isNotNull() & value.isNull(), wrong)


def strict(name: str, kind: str) -> Column:
    """A text column as ``kind``; a value that is none ends the job."""
    value, wrong = _read_as(name, kind)
    return F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(value).alias(name)


@dataclass(frozen=True)
class Records:
    """All records of a file, typed, with the names of their own columns.

    ``reason`` names the column that is NULL for records in order and else says what is
    wrong; ``raw`` names the record as it stood in the file.
    """

    table: DataFrame
    columns: list[str]
    reason: str
    raw: str

    def accepted(self) -> DataFrame:
        return self.table.filter(F.col(self.reason).isNull()).select(*[F.col(f"`{c}`") for c in self.columns])

    def rejected(self, source: str) -> DataFrame:
        """One row per record that is not in order, as ``REJECT_SCHEMA`` has it."""
        bad = self.table.filter(F.col(self.reason).isNotNull())
        return bad.select(
            F.lit(source).alias("source"),
            F.col("_metadata.file_path").alias("file"),
            F.col(self.reason).alias("reason"),
            F.col(self.raw).alias("_corrupt_record"),
        )


def csv_records(spark: SparkSession, source: RawFile) -> Records:
    """Every record of a source, in order or not; nothing in the data ends the job.

    A record is not in order if it has too few or too many fields, or text where its column
    is declared as a number or date.  Without a declared layout the types are inferred.
    """
    reader = csv_reader(spark, source.line_breaks)
    if source.schema:
        text = header_columns(spark, source.path, source.line_breaks)
        _require_columns(source.path, text.columns, dict(fields(source.schema)))
    else:
        text = reader.option("inferSchema", True).csv(source.path)
    columns = text.columns
    raw, reason = (_free(name, columns) for name in ("_corrupt_record", "_reason"))
    layout = StructType([*text.schema.fields, StructField(raw, StringType())])
    records = reader.option("columnNameOfCorruptRecord", raw).schema(layout).csv(source.path)
    declared = dict(fields(source.schema or ""))
    read = {name: _read_as(name, declared.get(name, "string")) for name in columns}
    misshapen = F.when(F.col(raw).isNotNull(), F.lit("fields do not fit the header"))
    wrong = F.coalesce(misshapen, F.nullif(F.concat_ws("; ", *[w for _, w in read.values()]), F.lit("")))
    as_it_was = F.coalesce(raw, F.to_csv(F.struct(*[F.col(f"`{c}`").cast("string") for c in columns]), {"escape": '"'}))
    typed = records.select(
        *[value.alias(name) for name, (value, _) in read.items()],
        wrong.alias(reason),
        F.when(wrong.isNotNull(), as_it_was).alias(raw),
        "_metadata",
    )
    return Records(typed, columns, reason, raw)


def _free(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it as long as a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def parse_ts_if_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Parse the named columns that exist; text that is no timestamp becomes NULL."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in present})


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column, NULL counting as equal to NULL."""
    return df.dropDuplicates()


def bronze_write(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def bronze_ingest(spark: SparkSession, name: str, source: RawFile, target: str, rejects: str) -> Ingested:
    """CSV → typed, de-duplicated Parquet under ``target``; what is not in order under ``rejects``.

    Rows are counted by the jobs that write them, after the last shuffle, so that a task which
    runs again counts once.  The file is read a second time only if it has rejects.
    """
    records = csv_records(spark, source)
    columns, rows, copies_too, some_rejects = records.columns, 0, 0, True
    if not records.accepted().take(1):  # the planner would drop the counts with the empty plan
        bronze_write(parse_ts_if_present(records.accepted(), source.date_columns).limit(0), target)
    else:
        met, written = Observation(), Observation()
        seen = replace(records, table=records.table.observe(met, F.count(records.reason).alias("rejects")))
        typed = parse_ts_if_present(seen.accepted(), source.date_columns)
        copies = _free("copies", columns)
        table = typed.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias(copies))
        counts = (F.count(F.lit(1)).alias("rows"), F.sum(copies).alias("copies"))
        bronze_write(table.observe(written, *counts).drop(copies), target)
        rows, copies_too, some_rejects = written.get["rows"], written.get["copies"], met.get["rejects"] > 0
    return Ingested(rows, copies_too - rows, _write_rejects(records, name, rejects, some_rejects), len(columns))


def _write_rejects(records: Records, name: str, path: str, some: bool) -> int:
    """Write the rejects and count them; an empty table if it is known that there are none."""
    if not some:
        bronze_write(records.table.sparkSession.createDataFrame([], REJECT_SCHEMA), path)
        return 0
    thrown = Observation()
    bronze_write(records.rejected(name).observe(thrown, F.count(F.lit(1)).alias("rejects")), path)
    return thrown.get["rejects"]


def ingest_audit(
    spark: SparkSession, files: Mapping[str, RawFile], root: str, rejects: str | None = None
) -> DataFrame:
    """Ingest each file under ``root``; one audit record per file.

    ``records`` is all that the file held: distinct rows, duplicates of them, and rejects,
    which lie under ``rejects`` (by default beside ``root``).
    """
    audit = []
    for name, source in files.items():
        done = bronze_ingest(spark, name, source, f"{root}/{name}", f"{rejects or f'{root}_rejects'}/{name}")
        records = done.rows + done.duplicates + done.rejects
        place = source.path.rstrip("/").rsplit("/", 1)[-1]
        audit.append((name, records, done.rows, done.duplicates, done.rejects, done.columns, place))
    return spark.createDataFrame(audit, AUDIT_SCHEMA)


def ingest_rejects(spark: SparkSession, names: Iterable[str], rejects: str) -> DataFrame:
    """The rejects of the named sources as one table."""
    return spark.read.schema(REJECT_SCHEMA).parquet(*[f"{rejects}/{name}" for name in names])


def parquet_scan(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Load each Parquet directory under ``root`` and name it as a temporary view."""
    tables = {name: spark.read.parquet(f"{root}/{name}") for name in names}
    for name, table in tables.items():
        table.createOrReplaceTempView(f"raw_{name}")
    return tables


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows) per table; Parquet answers this from its footers."""
    parts = [
        table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        for name, table in tables.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def cycle_table_write(cycles: DataFrame, path: str) -> DataFrame:
    """Replace the typed ten-column cycle table; the write runs in parallel."""
    cycles.select(*typed_columns(CYCLES_SCHEMA)).write.mode("overwrite").parquet(path)
    return cycles.sparkSession.read.schema(CYCLES_SCHEMA).parquet(path)


def json_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_sink(df: DataFrame, path: str) -> None:
    """Headered CSV as ``csv_reader`` takes it: a quote within quotes is doubled."""
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
