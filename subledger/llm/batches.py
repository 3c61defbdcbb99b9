"""Row-wise Arrow functions that keep a table's own columns, whatever their names."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_column(
    df: DataFrame, inputs: list[str], make: Callable[[list[pa.Array]], pa.Array], name: str, kind: str,
    replace: bool = False,
) -> DataFrame:
    """``df`` and a column that ``make`` derives from the input columns of each batch.

    A column of the same name (compared as Spark does, without case) makes way if ``replace``
    is set; otherwise the new one is called ``name`` with underscores before it.
    """
    own = df.columns
    if not replace:
        while name.lower() in {c.lower() for c in own}:
            name = f"_{name}"
    at = [own.index(c) for c in inputs]
    renamed = df.toDF(*(f"c{i}" for i in range(len(own))))
    names = [*renamed.columns, "made"]

    def run(batches):
        for batch in batches:
            made = make([batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema]
    out = renamed.mapInArrow(run, ", ".join([*fields, f"made {kind}"]))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(own) if not replace or c.lower() != name.lower()]
    order = kept if not replace else [
        F.col("made" if c.lower() == name.lower() else f"c{i}").alias(c) for i, c in enumerate(own)
    ]
    return out.select(*order) if replace else out.select(*kept, F.col("made").alias(name))


def added(before: DataFrame, after: DataFrame) -> str:
    """The name of the column that ``with_column`` added."""
    return after.columns[len(before.columns)]
