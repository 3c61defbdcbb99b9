"""Connected components of a table of links, by star contraction in a few rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subledger.sources.shared_folder import staged


def components(links: DataFrame) -> DataFrame:
    """node, label for each end of a link (a, b): the least node of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, under the least
    node near it, so paths halve. Neighbours are only ever summed up to a minimum, so a node
    with very many links is no burden. Rounds are written out; the last one changes nothing.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = staged(large.distinct(), "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = hung.union(least.select("a", F.col("low").alias("b"))).distinct()
        edges = staged(edges, "small_star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
