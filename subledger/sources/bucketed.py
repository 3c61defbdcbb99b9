"""Tables laid out by key once, so that later joins and sums on that key need no shuffle.

Each bucket is one file, written by one task and read by one.  A key with very many rows would
make one of them very large, so the rows of hot keys lie in a second table of their own, in no
order, and take the usual way of partial sums and joins that are split at run time.  So do
rows without a key.
"""

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.sources.shared_folder import staged

#: A key is hot if it has more than this many buckets' share of a table's rows.
HOT_BUCKETS = 0.25


@dataclass(frozen=True)
class Bucketed:
    """``cold`` is laid out by key and holds no hot key, ``hot`` holds the other rows."""

    cold: DataFrame
    hot: DataFrame


def hot_keys(tables: Sequence[DataFrame], key: str, buckets: int) -> DataFrame:
    """Keys that are hot in any of the tables: at most ``buckets / HOT_BUCKETS`` for each."""
    found = None
    for table in tables:
        counts = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        total = table.agg(F.count("*")).scalar()
        hot = counts.filter(F.col("n") > F.greatest(total * F.lit(HOT_BUCKETS) / buckets, F.lit(1))).select(key)
        found = hot if found is None else found.union(hot)
    return staged(found.distinct(), "hot_keys")


def laid_out(tables: dict[str, DataFrame], key: str, buckets: int, root: str) -> dict[str, Bucketed]:
    """Write the tables under ``root`` in ``buckets`` buckets by ``key``; the same keys are hot in all."""
    hot = hot_keys(list(tables.values()), key, buckets)
    out = {}
    for name, table in tables.items():
        spark = table.sparkSession
        # bounded by the number of buckets, see hot_keys
        is_hot = table.join(F.broadcast(hot.withColumnRenamed(key, "hot_key")), F.col(key) == F.col("hot_key"), "left")
        apart = F.col("hot_key").isNotNull() | F.col(key).isNull()
        cold = is_hot.filter(~apart).drop("hot_key").repartition(buckets, key)
        catalog_name = f"{name}_{uuid.uuid4().hex}"
        layout = cold.write.bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}")
        layout.format("parquet").saveAsTable(catalog_name)
        is_hot.filter(apart).drop("hot_key").write.parquet(f"{root}/{name}_hot")
        out[name] = Bucketed(
            spark.table(catalog_name), spark.read.schema(table.schema).parquet(f"{root}/{name}_hot")
        )
    return out


def by_key(build: Callable[..., DataFrame], *tables: Bucketed) -> DataFrame:
    """``build`` over tables of one layout, where its rows depend only on rows of the same key."""
    cold = build(*[table.cold for table in tables])
    return cold.unionByName(build(*[table.hot for table in tables]))
