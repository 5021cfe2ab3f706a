"""Broker-to-ingest lag as counts that can be added up over any range of batches.

A sketch counts lags by the leading eight bits of their microseconds, so a percentile read from it lies
below the exact one by less than 1/128 of it, and by the bound of ``LAG_BOUNDS`` they fall under, which
keeps the histogram exact. It has at most some ten thousand rows, whatever it counts.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from watchlake.operators.quality import LAG_BOUNDS

# Leading bits of a lag that are kept.
LEADING_BITS = 8

SKETCH_COLUMNS = "bucket bigint, bound int, n bigint"


def lag_micros() -> Column:
    return F.unix_micros("ingest_ts") - F.unix_micros("kafka_timestamp")


def bucket_of(micros: Column) -> Column:
    """The number with all but its leading bits zeroed; the sign stays."""
    size = F.abs(micros)
    dropped = F.greatest(F.length(F.bin(size)) - LEADING_BITS, F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", size, dropped), dropped)
    return F.when(micros < 0, -kept).otherwise(kept)


def _bound_of(micros: Column) -> Column:
    """How many of the bounds a lag exceeds."""
    return sum((micros / F.lit(1e6) > F.lit(bound)).cast("int") for bound in LAG_BOUNDS)


def lag_sketch(bronze: DataFrame) -> DataFrame:
    """Rows of ``bucket``, ``bound``, ``n``; rows without either time are not counted."""
    lag = bronze.select(lag_micros().alias("lag")).where("lag IS NOT NULL")
    return lag.groupBy(bucket_of(F.col("lag")).alias("bucket"), _bound_of(F.col("lag")).alias("bound")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(sketches: DataFrame) -> DataFrame:
    """One sketch of all that several sketches counted."""
    return sketches.groupBy("bucket", "bound").agg(F.sum("n").alias("n"))


def sketch_histogram(sketches: DataFrame) -> DataFrame:
    """Cumulative histogram, exact: ``le``, ``n``; ``+Inf`` counts all."""
    counts = [F.coalesce(F.sum(F.when(F.col("bound") <= i, F.col("n"))), F.lit(0)) for i in range(len(LAG_BOUNDS) + 1)]
    names = [*map(str, LAG_BOUNDS), "+Inf"]
    pairs = [F.struct(F.lit(name).alias("le"), F.col(f"_{i}").alias("n")) for i, name in enumerate(names)]
    return sketches.agg(*[c.alias(f"_{i}") for i, c in enumerate(counts)]).select(F.inline(F.array(*pairs)))


def sketch_percentiles(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``share`` and ``lag_sec``, the lower end of the bucket that holds the percentile; no rows of no lags."""
    # As few rows as a sketch has.
    one_task = Window.orderBy("bucket")
    buckets = sketches.groupBy("bucket").agg(F.sum("n").alias("n"))
    ranked = buckets.withColumns(
        {"upto": F.sum("n").over(one_task), "everything": F.sum("n").over(Window.partitionBy(F.lit(0)))}
    )
    wanted = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    reached = wanted.where(F.col("upto") >= F.greatest(F.ceil(F.col("share") * F.col("everything")), F.lit(1)))
    return reached.groupBy("share").agg((F.min("bucket") / F.lit(1e6)).alias("lag_sec"))


class LagHistory:
    """The sketches of a stream's batches, a folder each; a batch that comes again replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def record(self, bronze: DataFrame, batch_id: int) -> None:
        lag_sketch(bronze).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def between(self, first: int, last: int) -> DataFrame:
        """The merged sketch of a range of batches, both ends in it."""
        stored = self.spark.read.schema(f"{SKETCH_COLUMNS}, batch bigint").parquet(self.path)
        return merged(stored.where(F.col("batch").between(first, last)))


def lag_writer(history: LagHistory) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on Bronze rows."""

    def write(rows: DataFrame, batch_id: int) -> None:
        history.record(rows, batch_id)

    return write
