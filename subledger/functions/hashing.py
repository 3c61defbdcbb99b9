"""Deterministic assignment of keys to the unit interval."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_interval(*parts: Column) -> Column:
    """First eight bytes of SHA-256 over the pipe-joined parts, as a double in [0, 1).

    A NULL part counts as empty text: ``concat_ws`` alone would drop it together
    with its separator.
    """
    payload = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    leading = F.conv(F.substring(F.sha2(payload, 256), 1, 16), 16, 10)
    return leading.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))
