"""Required sources and columns, checked before any work starts."""

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subledger.schemas import RAW_SCHEMAS, fields
from subledger.sources.files import MissingSources, RawFile, header_columns, row_counts

VIOLATION_SCHEMA = "source string, missing_column string"
MODELLED = ("marketing_spend", "catalog_overrides")

def missing_columns(tables: Mapping[str, DataFrame], name: str) -> list[str]:
    if name not in tables:
        return ["*"]
    present = set(tables[name].columns)
    return [column for column, _ in fields(RAW_SCHEMAS[name]) if column not in present]


def contract_violations(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per missing column; ``*`` when the whole source is missing."""
    rows = [(name, column) for name in RAW_SCHEMAS for column in missing_columns(tables, name)]
    return spark.createDataFrame(rows, VIOLATION_SCHEMA)


def require_sources(tables: Mapping[str, DataFrame]) -> None:
    problems = [
        f"{name}: {', '.join(missing)}"
        for name in RAW_SCHEMAS
        if (missing := missing_columns(tables, name))
    ]
    if problems:
        raise MissingSources("missing inputs: " + "; ".join(problems))


def require_files(spark: SparkSession, files: Mapping[str, RawFile]) -> None:
    """Paths and headers of all sources, before anything is parsed or written.

    Sources that can be modelled may be absent altogether.
    """
    headers = {}
    for name, source in files.items():
        try:
            headers[name] = header_columns(spark, source.path, source.line_breaks)
        except AnalysisException:  # no such path, or an empty file
            continue
    wanted = [name for name in RAW_SCHEMAS if name in files or name not in MODELLED]
    problems = {name: missing_columns(headers, name) for name in wanted}
    told = [f"{name}: {', '.join(missing)}" for name, missing in problems.items() if missing]
    if told:
        raise MissingSources("missing inputs: " + "; ".join(told))


def source_contract(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One status row per source at hand: rows, missing columns, passed (0/1)."""
    counts = row_counts(tables)
    missing = F.create_map(
        *[F.lit(x) for name in tables for x in (name, len(missing_columns(tables, name)))]
    )
    return counts.select(
        F.col("name").alias("source"),
        "rows",
        F.element_at(missing, F.col("name")).alias("missing_columns"),
        (F.element_at(missing, F.col("name")) == 0).cast("int").alias("passed"),
    )
