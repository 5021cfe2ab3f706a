"""Undelivered records, sent again in order until each one is acknowledged.

Records get positions as they come in: by time, then digest. They are sent in rounds of a stated
number of records, wherever those lie in the files. What a receiver acknowledged is kept by position, in
the same manifest as the end of the round, so a round cut short goes on with
the records that are left and no acknowledged record is sent twice. A task lost between a
sending and its commit sends its part of the round once more: every sending carries the record's
digest and position, by which a receiver can tell.

    <path>/records/v=<token>/part=<n>     positions: those of the parts before, plus ``at``
    <path>/acks/v=<token>                 of the round in progress only

One sender at a time; records may be added meanwhile only by the same process.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from watchlake.schemas import SPOOL_SCHEMA
from watchlake.sinks import versions
from watchlake.sinks.versions import Manifest

# Rows of a round and the number of its first position, to rows of (position, error or NULL).
Deliver = Callable[[DataFrame, int], DataFrame]
# What one task sends with: topic, key, value, digest, position. Raising means "not acknowledged".
Send = Callable[[str | None, str | None, str | None, str, int], object]

_STORED = StructType(
    [
        *SPOOL_SCHEMA.fields,
        StructField("digest", StringType()),
        StructField("at", LongType()),
        StructField("v", StringType()),
        StructField("part", IntegerType()),
    ]
)
_ACKS = StructType([StructField("position", LongType()), StructField("error", StringType())])
_SENT = ["position", "topic", "key", "value", "digest"]


def record_digest() -> Column:
    """SHA-256 of topic, key and value, each led by its length; NULL differs from empty."""
    sized = [F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("topic", "key", "value")]
    return F.sha2(F.concat(*sized), 256)


def each_record(connect: Callable[[], Send], tasks: int) -> Deliver:
    """One acknowledgement a record; ``connect`` is called once in each task that has records.

    A key's records stay in order in one task. The first failure ends its task's sending, so
    nothing overtakes the failed record; other tasks go on.
    """

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send, failed = None, False
        for batch in batches:
            outcome = []
            for row in batch.itertuples(index=False) if not failed else ():
                try:
                    send = send or connect()
                    send(row.topic, row.key, row.value, row.digest, row.position)
                except Exception as error:  # whatever a client raises, the record is not acknowledged
                    outcome.append((row.position, f"{type(error).__name__}: {error}"))
                    failed = True
                    break
                outcome.append((row.position, None))
            yield pd.DataFrame(outcome, columns=["position", "error"]).astype({"position": "int64", "error": object})

    def deliver(rows: DataFrame, first: int) -> DataFrame:
        return rows.repartition(tasks, "key").sortWithinPartitions("position").mapInPandas(attempt, _ACKS)

    return deliver


def whole_round(write: Callable[[DataFrame, int], None]) -> Deliver:
    """One Spark write a round, acknowledged as a whole once it has ended well.

    ``write`` gets the rows and the round's first position, which is the same when the round is tried again.
    """

    def deliver(rows: DataFrame, first: int) -> DataFrame:
        write(rows, first)
        return rows.select("position", F.lit(None).cast("string").alias("error"))

    return deliver


class Outbox:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def _manifest(self) -> Manifest:
        return versions.load(self.spark, self.path)

    def add(self, spool: DataFrame, query: str | None = None, batch_id: int | None = None) -> int:
        """Takes in spool records; how many. A batch number seen before adds nothing.

        Equal records are records of their own. Columns beyond the spool's are left out.
        """
        manifest = self._manifest()
        if manifest.has_batch(query, batch_id):
            return 0
        token = versions.new_token()
        # The last key tells copies apart, so that a record of very many is spread as well.
        order = ["timestamp", "digest", "_copy"]
        (
            spool.select(*SPOOL_SCHEMA.names, record_digest().alias("digest"), F.monotonically_increasing_id().alias("_copy"))
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select(
                *SPOOL_SCHEMA.names,
                "digest",
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
                F.spark_partition_id().alias("part"),
            )
            .write.partitionBy("part")
            .parquet(f"{self.path}/records/v={token}")
        )
        following = manifest.after(query, batch_id)
        stored = following.parts.setdefault("records", {})
        before = first = manifest.settings.get("added", 0)
        if versions.partitions_written(self.spark, self.path, "records", token):
            written = self.spark.read.schema(StructType([*_STORED.fields[:-2], _STORED["part"]])).parquet(f"{self.path}/records/v={token}")
            # One row a written partition, not a record.
            for part, rows in written.groupBy("part").count().orderBy("part").collect():
                stored[f"part={part}/v={token}"] = {"tokens": [token], "part": part, "first": first, "rows": rows}
                first += rows
        following.settings["added"] = first
        versions.commit(self.spark, self.path, following)
        return first - before

    def _between(self, manifest: Manifest, low: int, high: int) -> DataFrame:
        """Records of positions from ``low`` up to, not including, ``high``; other folders are not opened."""
        chosen = [
            p for p in manifest.parts.get("records", {}).values() if p["first"] < high and p["first"] + p["rows"] > low
        ]
        parts = [self._part(p, max(low - p["first"], 0), min(high - p["first"], p["rows"])) for p in chosen]
        schema = StructType([StructField("position", LongType()), *_STORED.fields[:6]])
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/records").parquet(*[folder for folder, _, _, _ in parts])
        starts = self.spark.createDataFrame(
            [(token, p["part"], p["first"]) for (_, token, _, _), p in zip(parts, chosen)], "v string, part int, first long"
        )
        # Only the first and the last part can be cut.
        for _, token, (start, end), (part, size) in parts:
            if (start, end) != (0, size):
                inside = (F.col("at") >= start) & (F.col("at") < end)
                rows = rows.where((F.col("v") != token) | (F.col("part") != part) | inside)
        # As many rows as there are chosen parts.
        placed = rows.join(F.broadcast(starts), ["v", "part"])
        return placed.select((F.col("first") + F.col("at")).alias("position"), *schema.names[1:])

    def _part(self, part: dict, start: int, end: int) -> tuple[str, str, tuple[int, int], tuple[int, int]]:
        token = part["tokens"][0]
        return f"{self.path}/records/v={token}/part={part['part']}", token, (start, end), (part["part"], part["rows"])

    def _acks(self, manifest: Manifest) -> DataFrame:
        tokens = [token for own in manifest.parts.get("acks", {}).values() for token in own["tokens"]]
        if not tokens:
            return self.spark.createDataFrame([], _ACKS)
        return self.spark.read.schema(_ACKS).parquet(*[f"{self.path}/acks/v={token}" for token in tokens])

    def _left(self, manifest: Manifest, low: int, high: int) -> DataFrame:
        rows = self._between(manifest, low, high)
        if not manifest.settings.get("acked", 0):
            return rows
        return rows.join(self._acks(manifest).where("error IS NULL").select("position"), "position", "left_anti")

    def send(self, deliver: Deliver, records: int, rounds: int = 1) -> int:
        """Sends what is not acknowledged, ``records`` at a time; how many were acknowledged now.

        ``rounds`` such rounds, at most, go to ``deliver`` together, so that a long backlog takes no jobs
        of its own for each round; they are acknowledged, or tried again, like one round of their size.
        Stops after the first round with a failure; what ``deliver`` itself raises is passed on, with
        nothing of that round acknowledged. The next call goes on from there.
        """
        if records < 1 or rounds < 1:
            raise ValueError("a round holds at least one record")
        sent = 0
        while True:
            manifest = self._manifest()
            low, added = manifest.settings.get("done", 0), manifest.settings.get("added", 0)
            if low >= added:
                return sent
            high = manifest.settings.get("round_end", 0) or min(low + records * rounds, added)
            token = versions.new_token()
            deliver(self._left(manifest, low, high).select(*_SENT), low).write.parquet(f"{self.path}/acks/v={token}")
            outcome = self.spark.read.schema(_ACKS).parquet(f"{self.path}/acks/v={token}")
            acknowledged = outcome.where("error IS NULL").count()
            total = manifest.settings.get("acked", 0) + acknowledged
            sent += acknowledged
            following = manifest.after()
            whole = total == high - low
            if whole:
                following.settings |= {"done": high, "round_end": 0, "acked": 0}
                following.parts["acks"] = {}
            else:
                following.settings |= {"round_end": high, "acked": total}
                following.parts["acks"] = following.parts.get("acks", {}) | {token: {"tokens": [token]}}
            versions.commit(self.spark, self.path, following)
            if not whole:
                return sent

    def pending(self) -> DataFrame:
        """Records not acknowledged yet, with their positions."""
        manifest = self._manifest()
        return self._left(manifest, manifest.settings.get("done", 0), manifest.settings.get("added", 0))

    def failures(self) -> DataFrame:
        """``position`` and ``error`` of the failed sendings of the round in progress."""
        return self._acks(self._manifest()).where("error IS NOT NULL")

    def counts(self) -> DataFrame:
        """``spooled`` and ``replayed``, as taken in and acknowledged: ``outcome``, ``n``."""
        own = self._manifest().settings
        rows = [("spooled", own.get("added", 0)), ("replayed", own.get("done", 0) + own.get("acked", 0))]
        return self.spark.createDataFrame(rows, "outcome string, n long")

    def clear(self) -> int:
        """Lets go of records whose whole folder is acknowledged; how many folders were deleted."""
        manifest = self._manifest().after()
        done = manifest.settings.get("done", 0)
        manifest.parts["records"] = {
            name: part for name, part in manifest.parts.get("records", {}).items() if part["first"] + part["rows"] > done
        }
        versions.commit(self.spark, self.path, manifest)
        return versions.vacuum(self.spark, self.path, ("records", "acks"), keep=1)


def outbox_writer(outbox: Outbox, query: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is taken in once, by its number."""

    def write(rows: DataFrame, batch_id: int) -> None:
        outbox.add(rows, query, batch_id)

    return write
