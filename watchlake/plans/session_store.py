"""The accumulated table as a store that a micro-batch changes only from its first change on.

Three tables share one manifest (``sinks.versions``), so they change together:

``events``  accumulated rows with counted history, by event date and session bucket
``tails``   the last row of each session in each of these partitions, narrow
``index``   where each event id is stored, in hash parts to which commits append

A refresh finds stored versions of the batch's ids through the parts of the index that
they hash to. Of every session it touches, the earliest changed place in the order is
the point from which its rows are folded again; what comes before enters as
the state of the last row before that point, from a tail where the partition is not read.
Partitions whose event times all lie before the point are neither read nor written.

The table equals a full recompute, however the input is cut into batches, in whatever
order they come and whichever come twice. A batch whose number its query has committed
already starts no job.
"""

from collections.abc import Callable
from contextlib import ExitStack

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from watchlake.functions.ordering import RECENCY
from watchlake.operators.accumulate import STATE_COLUMNS, accumulate_state
from watchlake.operators.dedup import latest_events
from watchlake.operators.sizing import broadcast_if_known_small
from watchlake.schemas import SILVER_SCHEMA, accumulated_schema
from watchlake.sinks import versions

_COUNT = "control_event_count"
_CARRIED = [*STATE_COLUMNS, _COUNT]
_SEEN = ["user_id", "content_id", "event_time"]
_INPUT = [*SILVER_SCHEMA.names, "event_date"]
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"
#: Folders of an index part; one with more of them is written anew as one.
MAX_DELTAS = 8

EVENTS_SCHEMA = accumulated_schema("count").add("bucket", "integer")
_INDEX_SCHEMA = (
    StructType().add("event_id", "string").add("session_id", "string").add("event_date", "date").add("bucket", "integer").add("seq", "long").add("part", "integer")
)


def place_in_order() -> Column:
    """A struct that sorts like the rows of a session: oldest first, nulls last, ids at the end."""
    return F.struct(*[c for k in [*RECENCY, "event_id"] for c in (F.col(k).isNull().alias(f"no_{k}"), F.col(k).alias(k))])


def _group() -> Column:
    """Never null, and equal for rows of a session; a row without one stands alone."""
    return F.when(F.col("session_id").isNull(), F.concat(F.lit("e:"), "event_id")).otherwise(F.concat(F.lit("s:"), "session_id"))


def _partition(day, bucket: int) -> str:
    return f"event_date={_NO_DATE if day is None else day}/bucket={bucket}"


def _bucket_of(partition: str) -> int:
    return int(partition.rpartition("=")[2])


def _tails(events: DataFrame) -> DataFrame:
    """Per session and partition the row that the fold goes on from, and the newest one.

    The fold puts rows without a time last; the newest row of a session has one, if any has.
    A plain struct sorts nulls first, so its maximum is the newest.
    """
    rows = events.where("session_id is not null").select(
        "event_date",
        "bucket",
        "session_id",
        place_in_order().alias("last"),
        F.struct(*_CARRIED).alias("state"),
        F.struct(*RECENCY, "event_id").alias("newest"),
        F.struct(*_CARRIED, *_SEEN).alias("seen"),
    )
    return rows.groupBy("session_id", "event_date", "bucket").agg(
        F.max_by("state", "last").alias("state"), F.max("last").alias("last"), F.max_by("seen", "newest").alias("seen"), F.max("newest").alias("newest")
    )


class SessionStore:
    """``buckets`` and ``index_parts`` are settings of a new store; an old one keeps its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1, index_parts: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self._settings = {"buckets": buckets, "index_parts": index_parts}
        self._tails_schema = _tails(spark.createDataFrame([], EVENTS_SCHEMA)).schema

    # --- reading ------------------------------------------------------------

    def manifest(self, version: int | None = None) -> versions.Manifest:
        found = versions.load(self.spark, self.path, version)
        found.settings = found.settings or self._settings
        return found

    def _read(self, manifest: versions.Manifest, table: str, partitions=None) -> DataFrame:
        schema = {"events": EVENTS_SCHEMA, "tails": self._tails_schema, "index": _INDEX_SCHEMA}[table]
        own = manifest.parts.get(table, {})
        return versions.read_parts(self.spark, self.path, manifest, table, schema, own if partitions is None else partitions)

    def read(self, version: int | None = None) -> DataFrame:
        """All accumulated rows of one version, the newest by default."""
        return self._read(self.manifest(version), "events").drop("bucket")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The latest state of every session, from the tails alone: no event row is read."""
        state = F.max_by("seen", "newest").alias("s")
        return self._read(self.manifest(version), "tails").groupBy("session_id").agg(state).select(
            "session_id",
            F.col("s.user_id").alias("user_id"),
            F.col("s.content_id").alias("content_id"),
            F.col("s.session_state").alias("current_state"),
            F.coalesce("s.current_playback_position", F.lit(0)).alias("playback_position_sec"),
            F.try_to_timestamp("s.event_time").alias("updated_at"),
        )

    # --- writing ------------------------------------------------------------

    def refresh(self, silver: DataFrame, query: str | None = None, batch_id: int | None = None, hot_rows: int | None = None) -> int | None:
        """Folds Silver rows in; the new version's number, or None where there was nothing to change.

        Rows of a flagged table that are not ``valid`` are left out. With ``query`` and
        ``batch_id``, a batch that the store holds already is passed over unread.
        """
        before = self.manifest()
        if before.has_batch(query, batch_id):
            return None
        if "valid" in silver.columns:
            silver = silver.where("valid")
        after = before.after(query, batch_id)
        with ExitStack() as held:

            def hold(df: DataFrame) -> DataFrame:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                held.callback(df.unpersist)
                return df

            changed = self._fold(before, after, silver, hold, hot_rows)
        if not changed and query is None:
            return None
        versions.commit(self.spark, self.path, after)
        return after.version

    def _bucket(self, manifest: versions.Manifest) -> Column:
        return F.pmod(F.xxhash64(F.coalesce("session_id", "event_id")), manifest.settings["buckets"]).cast("int")

    def _part(self, manifest: versions.Manifest) -> Column:
        return F.pmod(F.xxhash64("event_id"), manifest.settings["index_parts"]).cast("int")

    def _fold(self, before: versions.Manifest, after: versions.Manifest, silver: DataFrame, hold, hot_rows: int | None) -> bool:
        batch = hold(latest_events(silver.select(*SILVER_SCHEMA.names)).withColumn("bucket", self._bucket(before)))
        changed, removed = self._changes(before, batch, hold)

        # The earliest place in each touched session where a row comes, goes or changes.
        moved = changed.select(_group().alias("_group"), "bucket", place_in_order().alias("_place")).unionByName(
            removed.select(_group().alias("_group"), "bucket", place_in_order().alias("_place"))
        )
        points = hold(moved.groupBy("_group", "bucket").agg(F.min("_place").alias("_point")))
        first = F.struct(F.col("_point.no_event_time"), F.coalesce("_point.event_time", F.lit("")))
        size = F.sum(F.octet_length("_group") + 100).alias("size")
        found = points.groupBy("bucket").agg(F.min(first).alias("low"), size).collect()
        if not found:
            return False

        low = {r.bucket: tuple(r.low) for r in found}
        points = broadcast_if_known_small(points.drop("bucket"), sum(r.size for r in found))
        final = hold(self._refolded(before, changed, points, low, hold, hot_rows))
        places = final.select("event_date", "bucket").unionByName(removed.select("event_date", "bucket")).distinct()
        touched = {_partition(*row) for row in places.collect()}
        self._write(before, after, final, changed, touched)
        return True

    def _changes(self, before: versions.Manifest, batch: DataFrame, hold) -> tuple[DataFrame, DataFrame]:
        """The batch's rows that the store lacks, and the stored rows that they replace."""
        size = F.sum(F.coalesce(F.octet_length("event_id"), F.lit(0)) + 20).alias("size")
        seen = batch.agg(F.collect_set(self._part(before)).alias("parts"), size).first()
        parts = {f"part={r}" for r in seen.parts} & set(before.parts.get("index", {}))
        ids = broadcast_if_known_small(batch.select("event_id"), seen.size)
        place = F.max_by(F.struct("event_date", "bucket"), "seq").alias("place")
        located = self._read(before, "index", sorted(parts)).join(ids, "event_id", "left_semi").groupBy("event_id").agg(place)
        places = located.select("place.*").distinct().collect() if parts else []
        stored = hold(self._read(before, "events", sorted({_partition(*p) for p in places})).join(ids, "event_id", "left_semi"))
        rows = batch.select(*_INPUT, "bucket")
        both = stored.select(*rows.columns).withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        # Of versions alike in everything the stored one stays: it is no change.
        newest = latest_events(both, None, F.asc("_new"))
        changed = hold(newest.where("_new = 1").select(*rows.columns))
        return changed, stored.join(changed.select("event_id"), "event_id", "left_semi")

    def _refolded(self, before, changed: DataFrame, points: DataFrame, low: dict, hold, hot_rows: int | None) -> DataFrame:
        """All rows of the touched sessions from their points on, folded from the state before."""
        own = before.parts.get("events", {})
        of_buckets = [p for p in own if _bucket_of(p) in low]
        # A partition is read only if it may hold a row at or behind a point of its bucket.
        read = [p for p in of_buckets if (own[p]["no_time"], "" if own[p]["no_time"] else own[p]["last_time"]) >= low[_bucket_of(p)]]
        # Partitions without any session have no tail.
        passed = sorted((set(of_buckets) - set(read)) & set(before.parts.get("tails", {})))
        stored = self._read(before, "events", read).withColumn("_group", _group()).withColumn("_place", place_in_order())
        near = hold(stored.join(points, "_group"))
        earlier = near.where("_place < _point").select("_group", "_place", F.struct(*_CARRIED).alias("_state"))
        tails = self._read(before, "tails", passed).select(
            F.concat(F.lit("s:"), "session_id").alias("_group"), F.col("last").alias("_place"), F.struct(*[f"state.{c}" for c in _CARRIED]).alias("_state")
        )
        carried = tails.join(points, "_group").where("_place < _point").select("_group", "_place", "_state").unionByName(earlier)
        carry = carried.groupBy("_group").agg(F.max_by("_state", "_place").alias("_carry"))
        later = near.where("_place >= _point").select(*_INPUT).join(changed.select("event_id"), "event_id", "left_anti")
        working = hold(later.unionByName(changed.select(*_INPUT)))
        folded = accumulate_state(working, history="count", null_sessions="own", hot_rows=hot_rows, largest=working.count())
        joined = folded.withColumn("_group", _group()).join(carry, "_group", "left")
        return joined.withColumns(
            {name: F.coalesce(name, f"_carry.{name}") for name in STATE_COLUMNS} | {_COUNT: F.col(_COUNT) + F.coalesce(f"_carry.{_COUNT}", F.lit(0))}
        ).withColumn("bucket", self._bucket(before)).select(*EVENTS_SCHEMA.names)

    def _write(self, before, after, final: DataFrame, changed: DataFrame, touched: set[str]) -> None:
        token = versions.new_token()
        own = before.parts.get("events", {})
        kept = self._read(before, "events", sorted(touched & set(own))).join(final.select("event_id"), "event_id", "left_anti")
        rows = kept.unionByName(final)
        rows.hint("rebalance", "event_date", "bucket").write.partitionBy("event_date", "bucket").parquet(f"{self.path}/events/v={token}")
        here = self._new(before, "events", token)
        _tails(here).write.partitionBy("event_date", "bucket").parquet(f"{self.path}/tails/v={token}")
        facts = here.groupBy("event_date", "bucket").agg(
            F.coalesce(F.max("event_time"), F.lit("")).alias("last_time"), F.bool_or(F.col("event_time").isNull()).alias("no_time"), F.count(F.lit(1)).alias("rows")
        )
        events, tails = after.parts.setdefault("events", {}), after.parts.setdefault("tails", {})
        for part in touched:
            events.pop(part, None)
            tails.pop(part, None)
        for r in facts.collect():
            events[_partition(r.event_date, r.bucket)] = {"tokens": [token], "last_time": r.last_time, "no_time": r.no_time, "rows": r.rows}
        for part in versions.partitions_written(self.spark, self.path, "tails", token):
            tails[part] = {"tokens": [token]}
        entries = changed.select("event_id", "session_id", "event_date", "bucket", F.lit(after.version).cast("long").alias("seq"), self._part(before).alias("part"))
        self._append_index(after, entries, token)
        after.settings = before.settings

    def _new(self, manifest, table: str, token: str) -> DataFrame:
        parts = versions.partitions_written(self.spark, self.path, table, token)
        written = versions.Manifest(parts={table: {p: {"tokens": [token]} for p in parts}})
        return self._read(written, table)

    def _append_index(self, after: versions.Manifest, entries: DataFrame, token: str) -> None:
        entries.write.partitionBy("part").parquet(f"{self.path}/index/v={token}")
        index = after.parts.setdefault("index", {})
        for part in versions.partitions_written(self.spark, self.path, "index", token):
            index[part] = {"tokens": [*index.get(part, {"tokens": []})["tokens"], token]}
        long = [part for part, known in index.items() if len(known["tokens"]) > MAX_DELTAS]
        if long:
            # The last entry of an id is the one that counts.
            whole = versions.new_token()
            latest = F.max_by(F.struct("session_id", "event_date", "bucket", "seq"), "seq").alias("e")
            rows = self._read(after, "index", long).groupBy("part", "event_id").agg(latest).select("event_id", "e.*", "part")
            rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/index/v={whole}")
            for part in long:
                index[part] = {"tokens": [whole]}

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what none of the last ``keep`` versions needs; not while a refresh runs."""
        return versions.vacuum(self.spark, self.path, ("events", "tails", "index"), keep)


def store_writer(store: SessionStore, query: str, hot_rows: int | None = None) -> Callable[[DataFrame, int], None]:
    """``SessionStore.refresh`` as a ``foreachBatch`` function; a batch that comes again starts no write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.refresh(batch, query, batch_id, hot_rows)

    return write
