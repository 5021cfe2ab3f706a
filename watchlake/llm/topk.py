"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are sorted by length (norm) into buckets of alike length, each small enough
for one task's memory. A query has a threshold, the k-th best product known so far.
In a bucket whose longest vector has norm L, a partner must have a cosine of at least
threshold / (|q| L): the bucket's local threshold.

* Above 1 no vector of the bucket can do: the pair is pruned.
* High thresholds take coordinate pruning: with |q_i| large in a few focus
  coordinates, a unit vector p of cosine c with q has q_i p_i + r |p'| >= c, with r
  the rest of q and p' the rest of p; one bound over focus coordinates tests that.
* Low thresholds take length pruning: within the bucket only vectors of norm at
  least threshold / |q|, a prefix of the sorted bucket, are left.

What is left is verified by whole inner products. A first pass over the bucket of the
longest vectors gives every query a threshold; a second one joins query blocks with
the buckets that may improve them. Blocks, not pairs of rows, are joined.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchlake.llm.common import saved

K = 20
SCALE = 64
BUCKET_ROWS = 4_096
QUERY_ROWS = 1_024
FOCUS = 8
# Local cosine thresholds from here on take coordinate pruning.
COORDINATE_FROM = 0.6
_EXACT = 2.0**52


def quantized(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null for null vectors and null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers as doubles, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    return out


def _same_width(a: np.ndarray, b: np.ndarray):
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as whole numbers; those beyond a long are held at its ends."""
    norms = np.sqrt((queries**2).sum(axis=1)).max(initial=0) * np.sqrt((vectors**2).sum(axis=1)).max(initial=0)
    if norms < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(queries).dot(whole(vectors).T) if vectors.shape[1] else np.zeros((len(queries), len(vectors)), object)
    ends = np.iinfo(np.int64)
    return np.clip(exact, ends.min, ends.max).astype(np.int64)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_bucket(query_ids, queries, thresholds, limits, ids, vectors, k: int = K, counts: dict | None = None):
    """Yields (query row, ids, scores): partners in a bucket of at least each query's threshold.

    ``vectors`` are by falling norm. ``thresholds`` may be minus infinity; a partner that
    just reaches one must have an id below the query's limit, since the k-th best
    known so far wins ties with later ids. ``counts``, if given, adds up how many
    pairs pruning left.
    """
    queries, vectors = _same_width(queries, vectors)
    lengths, norms = np.sqrt((queries**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
    # Rounding in norms must never prune a true partner.
    slack = 1 + 1e-9
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    open_rows, whole = [], []
    for row in range(len(queries)):
        theta, length = thresholds[row], lengths[row]
        if not len(vectors):
            continue
        if theta <= 0 or length == 0:
            if theta <= 0:
                whole.append(row)
            continue
        local = theta / (length * norms[0]) if norms[0] else np.inf
        if local > slack:
            continue
        if local < COORDINATE_FROM:
            # Length pruning: a prefix of the bucket.
            n = int(np.searchsorted(-norms, -theta / length / slack, "right"))
            open_rows.append((row, np.arange(n)))
            continue
        # Coordinate pruning on the query's largest coordinates.
        q = queries[row] / length
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        part = unit[:, focus] @ q[focus]
        rest = np.sqrt(max(0.0, 1 - (q[focus] ** 2).sum()))
        others = np.sqrt(np.maximum(0, 1 - (unit[:, focus] ** 2).sum(axis=1)))
        bound = (part + rest * others) * norms * length
        open_rows.append((row, np.flatnonzero(bound * slack + 1e-6 >= theta)))
    if counts is not None:
        counts["pairs"] = counts.get("pairs", 0) + len(queries) * len(vectors)
        counts["left"] = counts.get("left", 0) + len(whole) * len(vectors) + sum(len(r) for _, r in open_rows)
    for at in range(0, len(whole), 256):
        rows = whole[at : at + 256]
        for row, score in zip(rows, _products(queries[rows], vectors)):
            yield row, *_partners(query_ids[row], ids, score, thresholds[row], limits[row], k)
    # Rows with much left go together through one matrix product; few left go alone.
    dense = [(row, left) for row, left in open_rows if 4 * len(left) > len(vectors)]
    for at in range(0, len(dense), 256):
        rows = [row for row, _ in dense[at : at + 256]]
        for row, score in zip(rows, _products(queries[rows], vectors)):
            yield row, *_partners(query_ids[row], ids, score, thresholds[row], limits[row], k)
    for row, left in open_rows:
        if 4 * len(left) <= len(vectors) and len(left):
            score = _products(queries[row : row + 1], vectors[left])[0]
            yield row, *_partners(query_ids[row], ids[left], score, thresholds[row], limits[row], k)


def _partners(query_id, ids, scores, threshold, limit, k):
    fit = ((scores > threshold) | (scores == threshold) & (ids < limit)) & (ids != query_id)
    return best_of(ids[fit], scores[fit], k)


_FOUND = "query_id long, vec_id long, score long"


def _blocks(rows: DataFrame, number: str, side: str) -> DataFrame:
    """Rows (vec_id, v, norm, theta, limit) of each block number as one row of arrays, by falling norm."""
    fields = F.struct((-F.col("norm")).alias("fall"), "vec_id", "v", "theta", "limit")
    packed = F.sort_array(F.collect_list(fields)).alias("rows")
    names = {"vec_id": "ids", "v": "vectors", "theta": "thresholds", "limit": "limits"}
    return rows.groupBy(number).agg(packed, F.max("norm").alias("longest"), F.min("least_norm").alias("least_norm")).select(
        number, "longest", "least_norm", *[F.col(f"rows.{n}").alias(f"{side}_{out}") for n, out in names.items()]
    )


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Partners found in joined pairs of a query block and a bucket."""
    names = ["query_ids", "query_vectors", "query_thresholds", "bucket_ids", "bucket_vectors", "query_limits"]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = [batch.column(i).slice(at, 1).flatten() for i in range(len(names))]
                query_ids, thresholds, ids, limits = (row[i].to_numpy(zero_copy_only=False) for i in (0, 2, 3, 5))
                found = [
                    (np.full(len(i), query_ids[q]), i, s)
                    for q, i, s in search_bucket(query_ids, _matrix(row[1]), thresholds, limits, ids, _matrix(row[4]), k)
                ]
                columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return pairs.select(*names).mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with ranks; tasks keep k a query before anything is shuffled."""
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    bucket_rows: int = BUCKET_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of each row where ``is_query`` (over vec_id) holds.

    Scores are integer inner products of ``floor(64 x)``; ties go to smaller ids; a row
    is no partner of itself. Vectors that are null or hold null or non-finite
    components, or have no id, take no part. Shorter vectors count as filled with
    zeros. Rows that repeat an id count once, as the smallest of their vectors.
    Fewer than k partners are all returned. Products beyond a long are held at its ends.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = saved(
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantized(F.col(vector_column)).alias("v"))
        .where("vec_id is not null and v is not null")
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
        .select("vec_id", "v", F.sqrt(squares).alias("norm"), F.coalesce(is_query, F.lit(False)).alias("asks")),
        "topk-vectors",
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    # The buckets are range partitions by norm; equal norms are parted by the id.
    nothing = {"theta": F.lit(float("-inf")), "least_norm": F.lit(float("-inf")), "limit": F.lit(0).cast("long")}
    numbered = saved(
        rows.repartitionByRange(max(1, -(-size.n // bucket_rows)), F.desc("norm"), "vec_id")
        .withColumn("bucket", F.spark_partition_id())
        .withColumns(nothing),
        "topk-numbered",
    )
    buckets = saved(_blocks(numbered, "bucket", "bucket"), "topk-buckets")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-size.q // query_rows)))).alias("block")
    queries = numbered.where("asks").select("vec_id", "v", "norm", block)

    def search(asking: DataFrame, chosen: Column) -> DataFrame:
        """Query blocks against the chosen buckets that may hold a partner for one of their queries."""
        asked = saved(_blocks(asking, "block", "query"), "topk-asked")
        # Only numbers of blocks are paired freely; their rows follow by equal keys.
        reach = F.col("longest") * (1 + 1e-9) >= F.col("least")
        numbers = asked.select("block", F.col("least_norm").alias("least")).join(
            buckets.where(chosen).select("bucket", "longest"), reach
        )
        pairs = numbers.select("block", "bucket").join(asked.drop("longest", "least_norm"), "block")
        return _search(pairs.join(buckets.drop("longest", "least_norm"), "bucket"), k)

    # The longest vectors give each query a threshold to search the others with.
    first = numbered.agg(F.min("bucket")).first()[0]
    first = F.col("bucket") == F.lit(0 if first is None else first)
    found = saved(search(queries.withColumns(nothing), first), "topk-first")
    known = _ranked(found, k).where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("theta"), F.col("vec_id").alias("limit")
    )
    theta = F.coalesce("theta", F.lit(float("-inf")))
    least = F.when(F.col("theta") > 0, F.col("theta") / F.col("norm")).otherwise(F.lit(float("-inf")))
    # Beyond what doubles tell apart, ties with the threshold stay in.
    limit = F.when(F.abs("theta") < _EXACT, F.coalesce("limit", F.lit(0))).otherwise(F.lit(2**63 - 1)).cast("long")
    knowing = queries.join(known, "vec_id", "left").withColumn("theta", theta).withColumns({"least_norm": least, "limit": limit})
    both = found.unionByName(search(knowing, ~first))
    return _ranked(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
