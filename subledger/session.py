"""Session settings the operators are planned for."""

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Calendar days and months are those of UTC.  Partition counts start high and are
# merged at run time by size; skewed join partitions are split at run time, also
# where that costs one more shuffle.  A shuffled join hashes its smaller side instead
# of sorting both when every partition of that side was measured to be small.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app_name: str, initial_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session on whatever master the launcher names; its workers get this package.

    ``initial_partitions``: about the largest shuffle in bytes / 128 MB; at 100 TB of
    input tens of thousands.  Further settings are passed through.
    """
    chosen = {**SETTINGS, **settings}
    if initial_partitions:
        chosen["spark.sql.shuffle.partitions"] = str(initial_partitions)
    builder = SparkSession.builder.appName(app_name)
    for key, value in chosen.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> str:
    """Send this package to the workers, which import functions that run there by name."""
    folder = tempfile.mkdtemp(prefix="subledger-")  # served from here as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive
