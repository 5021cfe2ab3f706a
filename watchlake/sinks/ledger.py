"""Counters of a stream, each micro-batch counted once however often it is delivered."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from watchlake.sinks import versions


class CounterLedger:
    """Running sums of one query's counters, committed with the number of the batch they came from.

    A folder a query. It holds one number a counter, whatever the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.spark = spark
        self.path = f"{path}/{query}"
        self.query = query

    def record(self, batch_id: int, counts: dict[str, int]) -> bool:
        """Adds a batch's counts, unless its number or a later one is in; whether they were added."""
        manifest = versions.load(self.spark, self.path)
        if manifest.has_batch(self.query, batch_id):
            return False
        following = manifest.after(self.query, batch_id)
        for outcome, n in counts.items():
            following.settings[outcome] = following.settings.get(outcome, 0) + (n or 0)
        versions.commit(self.spark, self.path, following)
        versions.vacuum(self.spark, self.path, (), keep=2)
        return True

    def totals(self) -> DataFrame:
        """One row per counter: ``outcome``, ``n``."""
        sums = versions.load(self.spark, self.path).settings
        return self.spark.createDataFrame(sorted(sums.items()), "outcome string, n long")


def counted(
    ledger: CounterLedger, counts: dict[str, Column], write: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``write``, whose own pass over the rows also fills the counters.

    ``write`` must run over all rows each time and give the same table when a batch comes again. Its
    success comes first, the counts after it, so a failure between the two repeats both.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        watch = Observation()
        write(rows.observe(watch, *[column.alias(name) for name, column in counts.items()]), batch_id)
        ledger.record(batch_id, watch.get)

    return run
