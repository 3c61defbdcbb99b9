"""The k highest inner products of each query over all vectors, exactly, block by block.

A bounded sample of the vectors serves twice. Some of its members are pivots: the vectors are
sorted by the pivot they are most like, so that neighbours are alike, and cut into blocks. And
each query's k-th score within the sample is where its search starts from in every task: what
scores less cannot be among the k best.

A block keeps the largest and least value of each component; with a query's values they bound
every score in it. Each query takes the blocks in falling order of that bound, scores a block
through its own rows, and stops at the first bound below its k-th score so far. A bound equal to
it is still scored, as a smaller id wins ties. How much that spares depends on the vectors:
blocks of vectors without any groups have bounds above all scores.

Queries come in batches of bounded size, each sent to all tasks, many batches a job; the
tasks' best are merged per query.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subledger.sources.shared_folder import new_path, staged

K = 5
BLOCK = 512  # vectors
PART = 1 << 15  # vectors whose blocks are ordered together
QUERY_BATCH = 4096
SAMPLE, PIVOTS = 8192, 64  # vectors: bounds of the sample and of the pivots in it
BATCHES_A_JOB = 32


def quantised(batch: pa.RecordBatch, width: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and floor(factor * x) of each vector as a row; shorter ones end in zeros.

    Left out: ids or vectors that are null, and vectors with a component that is null or
    not finite.
    """
    ids, lists = batch.column(0), batch.column(1)
    keep = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
    ids, lists = ids.filter(keep), lists.filter(keep)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # null becomes NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = np.zeros((len(lengths), width))
    whole[row, at] = values
    good = np.isfinite(whole).all(axis=1)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64)[good], np.floor(whole[good] * factor)


def best_of_part(queries, own_rows, starts, ids, rows, vectors, k: int, block_rows: int):
    """For each query the k best of these vectors: query, id, score; and how many blocks were scored.

    Scores below a query's start do not count.
    """
    firsts = np.arange(0, len(ids), block_rows)
    high = np.maximum.reduceat(vectors, firsts, axis=0)
    low = np.minimum.reduceat(vectors, firsts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    top, worst = np.full((n, k), -np.inf), starts.copy()  # the k-th score so far, or the start
    scored = 0
    top_ids = np.full((n, k), np.iinfo(np.int64).max)
    going = np.arange(n)
    for turn in range(len(firsts)):
        block = order[going, turn]
        open_ = bounds[going, block] >= worst[going]
        going, block = going[open_], block[open_]
        if not len(going):
            break
        scored += len(going)
        for b in np.unique(block):
            asking = going[block == b]
            part = slice(firsts[b], firsts[b] + block_rows)
            scores = queries[asking] @ vectors[part].T
            scores[own_rows[asking][:, None] == rows[part][None, :]] = -np.inf
            q, c = np.nonzero((scores >= worst[asking][:, None]) & (scores > -np.inf))
            if not len(q):
                continue
            touched = asking[np.unique(q)]
            all_q = np.concatenate([asking[q], np.repeat(touched, k)])
            all_s = np.concatenate([scores[q, c], top[touched].ravel()])
            all_i = np.concatenate([ids[part][c], top_ids[touched].ravel()])
            by = np.lexsort((all_i, -all_s, all_q))
            all_q, all_s, all_i = all_q[by], all_s[by], all_i[by]
            place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
            kept = place < k
            top[all_q[kept], place[kept]] = all_s[kept]
            top_ids[all_q[kept], place[kept]] = all_i[kept]
            worst[touched] = np.maximum(top[touched, -1], starts[touched])
    q, place = np.nonzero(top > -np.inf)
    return q, top_ids[q, place], top[q, place], scored


def sample_of(items: DataFrame, width: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of at most ``SAMPLE`` vectors, spread over the table by a hash."""
    some = items.orderBy(F.xxhash64("row")).limit(SAMPLE).select("row", "vector").toArrow()
    if not len(some):
        return np.empty(0, np.int64), np.empty((0, width))
    return quantised(some.combine_chunks().to_batches()[0], width, factor)


def alike(items: DataFrame, pivots: np.ndarray, width: int, factor: int) -> DataFrame:
    """The vectors sorted by the pivot they are most like, and by how much; those that count."""

    def run(batches):
        for batch in batches:
            rows, values = quantised(batch, width, factor)
            scores = values @ pivots.T if len(pivots) else np.zeros((len(rows), 1))
            near = scores.argmax(axis=1)
            kept = np.isin(batch.column(0).to_numpy(), rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.filter(pa.array(kept)) for c in batch.columns],
                    pa.array(near.astype(np.int32)), pa.array(scores[np.arange(len(rows)), near]),
                ],
                ["row", "vector", "id", "pivot", "closeness"],
            )

    kind = items.schema["vector"].dataType.simpleString()
    placed = items.select("row", "vector", "id").mapInArrow(run, f"row long, vector {kind}, id long, pivot int, closeness double")
    order = ["pivot", "closeness", "row"]
    return staged(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "vector", "id"), "alike")


def started(asked: DataFrame, sample: tuple[np.ndarray, np.ndarray], width: int, factor: int, k: int) -> DataFrame:
    """The queries that count, with the k-th score each reaches within the sample."""
    rows, values = sample

    def run(batches):
        for batch in batches:
            own, queries = quantised(batch, width, factor)
            kept = np.isin(batch.column(0).to_numpy(), own)
            scores = queries @ values.T
            scores[own[:, None] == rows[None, :]] = -np.inf
            if scores.shape[1] >= k:
                starts = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            else:
                starts = np.full(len(own), -np.inf)
            yield pa.RecordBatch.from_arrays(
                [*[c.filter(pa.array(kept)) for c in batch.columns], pa.array(starts)], ["row", "vector", "id", "start"]
            )

    kind = asked.schema["vector"].dataType.simpleString()
    return asked.select("row", "vector", "id").mapInArrow(run, f"row long, vector {kind}, id long, start double")


def scanned(
    vectors: DataFrame, is_query: Column, k: int, key: str, vector: str, factor: int, batch: int, block: int
) -> tuple[DataFrame, DataFrame]:
    """The best of each task for each query (query, query_id, vec_id, score), and per task and
    batch of queries the pairs of query and block there are and those that were scored."""
    spark = vectors.sparkSession
    items = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("vector"), is_query.alias("asks"))
    items = staged(items.where("id is not null").withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = items.agg(F.max(F.size("vector"))).first()[0] or 0
    sample = sample_of(items, width, factor)
    ranges = alike(items, sample[1][:PIVOTS], width, factor)
    asked = staged(started(items.where("asks"), sample, width, factor, k), "queries")
    n_batches = -(-asked.count() // (batch // 2))  # half full on average: hashing is uneven

    def search(b: int) -> DataFrame | None:
        found = asked.where(F.pmod(F.xxhash64("row"), F.lit(n_batches)) == b).toArrow()
        if not len(found):
            return None
        one = found.combine_chunks().to_batches()[0]
        own_rows, values = quantised(one, width, factor)
        own_ids, starts = one.column(2).to_numpy(), one.column(3).to_numpy()

        def run(batches):
            held: list[tuple] = []
            for own in (*batches, None):
                if own is not None:
                    rows, part = quantised(own, width, factor)
                    held.append((own.column(2).to_numpy(), rows, part))
                if held and (own is None or sum(len(x) for x, _, _ in held) >= PART):
                    ids, rows, part = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    q, i, s, scored = best_of_part(values, own_rows, starts, ids, rows, part, k, block)
                    pairs = len(values) * -(-len(ids) // block)
                    n = len(q) + 1  # the last row tells how many blocks were scored
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([*own_rows[q].tolist(), None], pa.int64()), pa.array([*own_ids[q].tolist(), None], pa.int64()),
                            pa.array([*i.tolist(), None], pa.int64()), pa.array([*s.astype(np.int64).tolist(), None], pa.int64()),
                            pa.array([None] * (n - 1) + [pairs], pa.int64()), pa.array([None] * (n - 1) + [scored], pa.int64()),
                        ],
                        ["query", "query_id", "vec_id", "score", "pairs", "scored"],
                    )

        return ranges.mapInArrow(run, FOUND)

    paths = []
    for first in range(0, n_batches, BATCHES_A_JOB):
        jobs = [job for b in range(first, min(first + BATCHES_A_JOB, n_batches)) if (job := search(b)) is not None]
        if jobs:
            paths.append(new_path(spark, "best"))
            reduce(DataFrame.union, jobs).write.parquet(paths[-1])
    every = spark.read.schema(FOUND).parquet(*paths) if paths else spark.createDataFrame([], FOUND)
    best = every.where("query is not null").drop("pairs", "scored")
    return best, every.where("query is null").select("pairs", "scored")


FOUND = "query long, query_id long, vec_id long, score long, pairs long, scored long"


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding",
    factor: int = 256, batch: int = QUERY_BATCH, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, the id and the score of each query's k best rows other than its own row.

    ``is_query`` says which of the rows are queries. Another row with the query's id is a
    candidate like any other, and each of several query rows with one id is answered. Shorter
    vectors are taken as if they ended in zeros. Scores are sums of whole numbers below 2^53, so
    doubles hold them exactly. A query that meets fewer than k rows gets those.
    """
    best, _ = scanned(vectors, is_query, k, key, vector, factor, batch, block)
    kind = vectors.schema[key].dataType.simpleString()
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    out = best.withColumn("rank", ranked).where(F.col("rank") <= k)
    return out.select(
        F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score"
    )


def scored_share(
    vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding",
    factor: int = 256, batch: int = QUERY_BATCH, block: int = BLOCK,
) -> float:
    """Of all pairs of a query and a block, the share whose block had to be scored."""
    _, counts = scanned(vectors, is_query, k, key, vector, factor, batch, block)
    return counts.agg(F.sum("scored") / F.sum("pairs")).first()[0] or 0.0


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP9_SQL = """
with quantised as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from quantised q join quantised c on q.vec_id <> c.vec_id
    where q.vec_id % 50 = 0
)
select query_id, rank::integer as rank, vec_id, score
from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
    from scored
)
where rank <= 5
"""
