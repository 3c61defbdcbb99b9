"""Token counts of documents in flat token files, found by their separators.

A flat file is the ids of its documents one after another, each document ended by one
separator id, with no index. It is stored as blocks of equal size that take no heed of
documents, and beside them the documents' keys in order. Counting searches each block for
separators; a running sum over the blocks' totals says which document each separator ends
and where that document began, also in earlier blocks.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subledger.llm.library_ids import library_cache, with_end
from subledger.llm.text import documents, rows_a_batch, rows_a_read, slices
from subledger.sources.shared_folder import new_path, staged

BLOCK_IDS = 1 << 15  # 128 KB: the JVM gives a larger array regions of its own and lets its heap grow for them
WIDTH = np.dtype("<u4")
KEYS_A_ROW = 4096
TEXT_BYTES = 1 << 20  # encoded at once
BLOCKS_AT_ONCE = 4  # read from a file, sent to a worker
#: A page is a few blocks, not the hundred rows that are written before its size is first looked at.
LAYOUT = {
    "compression": "zstd",
    "parquet.page.size": str(1 << 18),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size": str(8 << 20),
}
STORED = "file int, block int, data binary, keys array<{kind}>"


def write_flat(df: DataFrame, path: str, tokenizer_path: str, end_id: int, key="doc_id", text="text") -> None:
    """Flat token files of ``text`` (null: no ids), one for each partition, in its order.

    Rows with ``data`` are blocks, rows with ``keys`` name the documents of the file in order.
    Nothing is shuffled: a reader tells documents by their place in a file, not by their keys.
    """

    def run(batches):
        file, block, held, size, keys, rows = TaskContext.get().partitionId(), 0, [], 0, [], 0

        def blocks(last: bool) -> Iterator[tuple]:
            nonlocal block, held, size
            while size >= BLOCK_IDS or last and size:
                flat = np.concatenate(held)
                yield file, block, flat[:BLOCK_IDS].astype(WIDTH).tobytes(), None
                held, block = [flat[BLOCK_IDS:]], block + 1
                size = len(held[0])

        def named(last: bool) -> Iterator[tuple]:
            nonlocal keys, rows
            while len(keys) >= KEYS_A_ROW or last and keys:
                yield file, rows, None, keys[:KEYS_A_ROW]
                keys, rows = keys[KEYS_A_ROW:], rows + 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = (pa.int32(), pa.int32(), pa.binary(), pa.list_(key_type))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["file", "block", "data", "keys"],
            )

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            for texts in slices(batch.column(1), TEXT_BYTES):
                # an added token's string is text here: its id may be the separator
                ids, _ = with_end(*library_cache(tokenizer_path, special=False).encoded(texts), end_id)
                held.append(ids)
                size += len(ids)
                if out := list(blocks(False)):
                    yield batch_of(out)
            keys += batch.column(0).to_pylist()
            if out := list(named(False)):
                yield batch_of(out)
        if out := [*blocks(True), *named(True)]:
            yield batch_of(out)

    kind = df.schema[key].dataType.simpleString()
    stored = df.select(df[key], df[text]).mapInArrow(run, STORED.format(kind=kind))
    stored.write.options(**LAYOUT).parquet(path)


def blocks_of_files(spark: SparkSession, path: str, id_bytes: int = 4, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (file, block, data) of raw token files of up to 2 GB each, in name order."""
    size = id_bytes * block_ids
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("all"))
    last = F.floor(F.greatest(F.length("all") - 1, F.lit(0)) / size).cast("int")
    cut = files.select("path", "all", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return cut.select(
        F.col("path").alias("file"),
        "block",
        F.substring("all", F.col("block") * size + 1, F.lit(size)).alias("data"),
    )


def separators(blocks: DataFrame, end_id: int, width: str = "<u4") -> DataFrame:
    """Per block its number of ids and the places of the separator in it."""

    def run(batches):
        for batch in batches:
            sizes, places = [], []
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), dtype=width)
                sizes.append(len(ids))
                places.append(np.flatnonzero(ids == end_id))
            bounds = np.cumsum([0, *map(len, places)])
            flat = np.concatenate(places) if places else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists],
                ["file", "block", "n_ids", "places"],
            )

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "data").mapInArrow(
        run, f"file {kind}, block int, n_ids long, places array<long>"
    )


def counted(found: DataFrame) -> DataFrame:
    """Documents as (file, place in the file, start, n_tokens): starts count ids over all files.

    ``n_tokens`` leaves the separator out. Ids after a file's last separator end no document.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("places")
    totals = found.withColumns(
        {
            "ids_before": F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)),
            "ends_before": F.coalesce(F.sum(n).over(earlier), F.lit(0)),
        }
    )
    totals = totals.withColumn(
        "last_end", F.when(n > 0, F.col("ids_before") + F.element_at("places", -1))
    )
    totals = totals.withColumn("open_since", F.coalesce(F.max("last_end").over(earlier) + 1, F.lit(0)))
    files = found.groupBy("file").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start"))
    ends = totals.where(n > 0).join(files, "file").select(
        "file", "ids_before", "ends_before", "open_since", "file_start", "places",
        F.posexplode("places").alias("at", "place"),
    )
    start = F.when(F.col("at") == 0, F.col("open_since")).otherwise(
        F.col("ids_before") + F.element_at("places", F.greatest(F.col("at"), F.lit(1))) + 1
    )
    return ends.select(
        "file",
        (F.col("ends_before") + F.col("at")).alias("nth"),
        (F.col("file_start") + start).alias("start"),
        (F.col("ids_before") + F.col("place") - start).alias("n_tokens"),
    )


def token_counts(spark: SparkSession, path: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Each document of files that ``write_flat`` wrote: key, start, n_tokens.

    Starts count the ids, separators too, of all files in order of their numbers.
    """
    stored = spark.read.parquet(path)
    with rows_a_batch(spark, BLOCKS_AT_ONCE), rows_a_read(spark, BLOCKS_AT_ONCE):
        found = staged(separators(stored.where(F.col("data").isNotNull()), end_id), "separators")
    names = stored.where(F.col("keys").isNotNull()).select(
        "file", "block", F.posexplode("keys").alias("at", key)
    )
    names = names.select("file", (F.col("block") * KEYS_A_ROW + F.col("at")).cast("long").alias("nth"), key)
    # A row a document on both sides: the sizes of the files, where lists are packed, do not tell.
    return names.join(counted(found).hint("merge"), ["file", "nth"]).select(key, "start", "n_tokens")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    end_id, path = 50256, new_path(spark, "flat_tokens")
    write_flat(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return token_counts(spark, path, end_id)
