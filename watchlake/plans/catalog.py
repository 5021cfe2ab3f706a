"""Registered queries over the given tables, each with its SQL counterpart.

Results are flat: dates, times and arrays are returned as text. Two queries have
no counterpart column for what is random or a clock reading; it is left out.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchlake.functions.contract import CONTRACT
from watchlake.functions.ordering import event_instant
from watchlake.functions.playback import history_text, time_ordered, without_nulls
from watchlake.operators import envelopes, lag_sketch, lookback, quality
from watchlake.operators.accumulate import STATE_COLUMNS, accumulate_state
from watchlake.operators.contract import validate_contract
from watchlake.operators.dedup import latest_events
from watchlake.operators.history import attach_history, control_events, with_history_text
from watchlake.operators.landing import land_records
from watchlake.operators.parsing import flag_events, parse_events
from watchlake.operators.snapshot import latest_rows, session_snapshot
from watchlake.plans import medallion, sample
from watchlake.plans.incremental import EXACT, PARITY, RefreshMode, refresh_table
from watchlake.plans.session_store import SessionStore
from watchlake.schemas import (
    BRONZE_SCHEMA,
    BROKER_SCHEMA,
    CARRIED_FIELDS,
    DEAD_LETTER_SCHEMA,
    DEAD_LETTER_TOPIC,
    EVENT_FIELDS,
    EVENT_TOPIC,
    FLAGGED_SCHEMA,
    REASON_OF_EVENT,
    REPLAYED_SCHEMA,
    SILVER_SCHEMA,
    STATE_OF_EVENT,
    accumulated_schema,
)
from watchlake.session import in_bounded_tasks, new_work_folder
from watchlake.sources.tables import read_table, stream_table
from watchlake.sinks.append import RUN_ONCE
from watchlake.sinks.ledger import CounterLedger, counted
from watchlake.sinks.outbox import Outbox, whole_round
from watchlake.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

_IDENTITY = ["event_id", "session_id", "event_version", "event_header_reemission"]
_SECONDS = "yyyy-MM-dd HH:mm:ss"


# Events of a task, at most on average. An event becomes messages of many times its stored size.
_TASK_EVENTS = 100_000


def _event_tasks(spark: SparkSession, folder: str, *_) -> int:
    """Tasks that the events are dealt to, and shuffles of what becomes of them, at least."""
    # The count is read from the footers.
    return -(-spark.read.parquet(f"{folder}/events.parquet").count() // _TASK_EVENTS)


def _in_bounded_tasks(query: Callable) -> Callable:
    return in_bounded_tasks(query, _event_tasks)


# A shuffle into more parts than these keeps what a task sends in memory; up to them, rows go straight to a file a part.
_PLAIN_PARTS = 200


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` spread evenly over ``parts`` tasks, however many of them a row group holds.

    They go by the hash of a number that follows from their place in the file. Dealing them in turn would sort all that
    a task reads first, in memory, and a row group is read by one task.
    """
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    if parts > _PLAIN_PARTS:
        # Another hash on the way keeps this step apart from the next one.
        rows = rows.repartition(_PLAIN_PARTS, "_number").withColumn("_number", F.xxhash64("_number"))
    return rows.repartition(parts, "_number").drop("_number")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table, spread over the cores and over tasks of bounded rows, however it is stored."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    # Splits say nothing of rows: a row group lies in one of them, whatever its size.
    return _dealt(events, max(spark.sparkContext.defaultParallelism, _event_tasks(spark, folder)))


def _silver(spark: SparkSession, folder: str) -> DataFrame:
    return sample.watch_events(_events(spark, folder))


def _bronze(spark: SparkSession, folder: str) -> DataFrame:
    records = sample.broker_records(_events(spark, folder))
    return land_records(records, ingest_ts=F.col("landed_at"))


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _state_view(accumulated: DataFrame, *also: Column) -> DataFrame:
    return accumulated.select(*_IDENTITY, _text("event_date"), *STATE_COLUMNS, *also)


def _history_text() -> Column:
    return history_text("control_event_history").alias("history")


# --- landing and parsing ----------------------------------------------------


def bronze_project(spark: SparkSession, folder: str) -> DataFrame:
    return _bronze_view(_bronze(spark, folder))


def _bronze_view(bronze: DataFrame, *also: Column) -> DataFrame:
    return bronze.select(
        "topic",
        "partition",
        "offset",
        F.date_format("kafka_timestamp", _SECONDS).alias("kafka_time"),
        "timestampType",
        "event_key",
        "raw_value",
        _text("date"),
        *also,
    )


def _silver_view(rows: DataFrame, *also: str) -> DataFrame:
    return rows.select(*EVENT_FIELDS, "event_key", "raw_value", *also)


def silver_valid(spark: SparkSession, folder: str) -> DataFrame:
    return _silver_view(medallion.silver(_bronze(spark, folder))[0])


def silver_invalid(spark: SparkSession, folder: str) -> DataFrame:
    return _silver_view(medallion.silver(_bronze(spark, folder))[1])


# --- streams over files -----------------------------------------------------


def _write_broker_files(spark: SparkSession, folder: str, path: str) -> None:
    records = sample.broker_records(_events(spark, folder))
    records.select(*BROKER_SCHEMA.names).write.parquet(path)


def _write_bronze_files(spark: SparkSession, folder: str, path: str) -> None:
    _bronze(spark, folder).write.partitionBy("date").parquet(path)


@_in_bounded_tasks
def bronze_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Broker records through the landing stream."""
    work = new_work_folder(spark, "bronze")
    _write_broker_files(spark, folder, f"{work}/broker")
    jobs.start_bronze(
        stream_table(spark, f"{work}/broker", BROKER_SCHEMA),
        f"{work}/bronze",
        f"{work}/checkpoint",
        trigger=RUN_ONCE,
    ).awaitTermination()
    # The date of landing is today's; the sample's own landing date is compared
    # by ``bronze_project``.
    return _bronze_view(read_table(spark, f"{work}/bronze", BRONZE_SCHEMA)).drop("date")


# When the rows of ``bronze_clock_stream`` landed.
_LANDED = "2024-05-06 07:08:09"


@_in_bounded_tasks
def bronze_clock_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The landing stream on its own clock, ended once its source is drained; the landing time is passed in."""
    work = new_work_folder(spark, "bronze-clock")
    _write_broker_files(spark, folder, f"{work}/broker")
    query = jobs.start_bronze(
        stream_table(spark, f"{work}/broker", BROKER_SCHEMA),
        f"{work}/bronze",
        f"{work}/checkpoint",
        ingest_ts=F.to_timestamp(F.lit(_LANDED)),
    )
    jobs.stop_when_drained([query])
    landed = F.date_format("ingest_ts", _SECONDS).alias("landed")
    return _bronze_view(read_table(spark, f"{work}/bronze", BRONZE_SCHEMA), landed)


@_in_bounded_tasks
def silver_clock_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The Silver stream with the default trigger, batch upon batch, ended once its source is drained."""
    work = new_work_folder(spark, "silver-clock")
    _write_bronze_files(spark, folder, f"{work}/bronze")
    query = jobs.start_silver(
        stream_table(spark, f"{work}/bronze", BRONZE_SCHEMA), f"{work}/silver", f"{work}/checkpoint"
    )
    jobs.stop_when_drained([query])
    return _silver_view(
        read_table(spark, f"{work}/silver", FLAGGED_SCHEMA).withColumn("is_valid", F.col("valid").cast("int")),
        "is_valid",
    )


@_in_bounded_tasks
def silver_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze through the single-pass Silver stream."""
    work = new_work_folder(spark, "silver")
    _write_bronze_files(spark, folder, f"{work}/bronze")
    jobs.start_silver(
        stream_table(spark, f"{work}/bronze", BRONZE_SCHEMA),
        f"{work}/silver",
        f"{work}/checkpoint",
        trigger=RUN_ONCE,
    ).awaitTermination()
    return _silver_view(
        read_table(spark, f"{work}/silver", FLAGGED_SCHEMA).withColumn("is_valid", F.col("valid").cast("int")),
        "is_valid",
    )


@_in_bounded_tasks
def silver_pair_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze through the two concurrent Silver streams."""
    work = new_work_folder(spark, "silver-pair")
    _write_bronze_files(spark, folder, f"{work}/bronze")
    started = jobs.start_silver_pair(
        stream_table(spark, f"{work}/bronze", BRONZE_SCHEMA),
        f"{work}/valid",
        f"{work}/invalid",
        f"{work}/checkpoint-valid",
        f"{work}/checkpoint-invalid",
        trigger=RUN_ONCE,
    )
    jobs.await_all(spark, started)
    halves = [
        read_table(spark, f"{work}/{half}", SILVER_SCHEMA).withColumn("is_valid", F.lit(flag))
        for half, flag in (("valid", 1), ("invalid", 0))
    ]
    return _silver_view(halves[0].unionByName(halves[1]), "is_valid")


@_in_bounded_tasks
def accumulated_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Silver rows by arrival week through the accumulated stream, one run per week."""
    work = new_work_folder(spark, "accumulated")
    rows = _silver(spark, folder)
    edges = ["0001-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "9999-01-01"]
    for low, high in zip(edges, edges[1:]):
        inside = (F.col("ingest_ts") >= low) & (F.col("ingest_ts") < high)
        week = rows.where(inside | F.col("ingest_ts").isNull() if low == edges[0] else inside)
        week.write.mode("append").parquet(f"{work}/silver")
        jobs.start_accumulated(
            stream_table(spark, f"{work}/silver", SILVER_SCHEMA),
            f"{work}/accumulated",
            f"{work}/checkpoint",
        ).awaitTermination()
    return _state_view(
        read_table(spark, f"{work}/accumulated", accumulated_schema()), _history_text()
    )


@_in_bounded_tasks
def pipeline_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The broken broker sample through landing, parsing and folding, one run per part.

    The second part is delivered twice, and every job resumes from its checkpoint.
    Landing times are the broker's, so that every run lands the same rows. One session, that of the
    empty text, holds a share of all rows: histories are stored as counts, and written out a row at a time.
    """
    work = new_work_folder(spark, "pipeline")
    records = sample.broker_records(_events(spark, folder))
    early = F.coalesce(F.col("timestamp") < sample.CUTOFF, F.lit(False))
    for part in (early, ~early, ~early):
        records.where(part).select(*BROKER_SCHEMA.names).write.mode("append").parquet(f"{work}/broker")
        jobs.start_bronze(
            stream_table(spark, f"{work}/broker", BROKER_SCHEMA),
            f"{work}/bronze",
            f"{work}/checkpoint-bronze",
            trigger=RUN_ONCE,
            ingest_ts=F.col("timestamp"),
        ).awaitTermination()
        jobs.start_silver(
            stream_table(spark, f"{work}/bronze", BRONZE_SCHEMA),
            f"{work}/silver",
            f"{work}/checkpoint-silver",
            trigger=RUN_ONCE,
        ).awaitTermination()
        jobs.start_accumulated(
            stream_table(spark, f"{work}/silver", FLAGGED_SCHEMA),
            f"{work}/accumulated",
            f"{work}/checkpoint-accumulated",
            history="count",
        ).awaitTermination()
    rows = read_table(spark, f"{work}/accumulated", accumulated_schema("count"))
    return _state_view(with_history_text(rows, "history"), F.col("history"))


# --- dedup, lookback, sessions ----------------------------------------------


def dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_events(_silver(spark, folder)).select(
        *_IDENTITY, "event_type", "event_time", "playback_position", _text("event_date")
    )


def impacted_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return lookback.impacted_sessions(_silver(spark, folder))


def batch_date_range(spark: SparkSession, folder: str) -> DataFrame:
    bounds = lookback.date_bounds(latest_events(_silver(spark, folder)), 1)
    return bounds.select(_text("min_date"), _text("max_date"))


def _two_batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _silver(spark, folder)
    early = F.coalesce(F.col("ingest_ts") < sample.CUTOFF, F.lit(False))
    return rows.where(early), rows.where(~early)


def _looked_back(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    first, second = _two_batches(spark, folder)
    batch = latest_events(second)
    target = medallion.accumulated(first, history="count")
    found = lookback.target_lookback(
        target, lookback.impacted_sessions(batch), *lookback.batch_date_range(batch, 1)
    )
    return lookback.without_ids(found, lookback.event_ids(batch)), batch


def target_lookback(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = _looked_back(spark, folder)
    return rows.select(*_IDENTITY, _text("event_date"), "session_state")


def working_union(spark: SparkSession, folder: str) -> DataFrame:
    return lookback.working_set(*_looked_back(spark, folder)).select(
        *_IDENTITY, _text("event_date"), "session_state"
    )


def filter_upserts(spark: SparkSession, folder: str) -> DataFrame:
    rows, batch = _looked_back(spark, folder)
    folded = accumulate_state(lookback.working_set(rows, batch), history="count")
    return _state_view(lookback.upserts_of_batch(folded, batch), F.col("control_event_count"))


def accumulated_state(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: dedup, then fold every session, history included."""
    return _state_view(medallion.accumulated(_silver(spark, folder)), _history_text())


def accumulated_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """The fold with two fifths of all rows in one session, which is split."""
    rows = sample.one_large_session(_silver(spark, folder))
    folded = medallion.accumulated(rows, history="count", hot_rows=2_000)
    return _state_view(folded, F.col("control_event_count"))


def accumulated_by_instant(spark: SparkSession, folder: str) -> DataFrame:
    """The fold in the order of instants, a third of the times being written at +05:00.

    Such a time's text sorts later than it is; its instant does not.
    """
    shifted = F.expr(f"concat(date_format(to_timestamp(event_time) + interval 5 hours, \"{sample.TEXT}\"), '+05:00')")
    moved = F.expr("cast(event_id as bigint) % 3 = 0")
    rows = _silver(spark, folder).withColumn("event_time", F.when(moved, shifted).otherwise(F.concat("event_time", F.lit("Z"))))
    folded = medallion.accumulated(
        rows.withColumn("event_ts", event_instant()), history="count", time_column="event_ts"
    )
    return folded.select("event_id", *STATE_COLUMNS, "control_event_count")


def control_history(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.accumulated(_silver(spark, folder)).select(
        "event_id", F.size("control_event_history").alias("n_control"), _history_text()
    )


def control_event_rows(spark: SparkSession, folder: str) -> DataFrame:
    return control_events(medallion.accumulated(_silver(spark, folder), history="count"))


# --- upsert -----------------------------------------------------------------


@_in_bounded_tasks
def _merged(spark: SparkSession, folder: str, mode: RefreshMode) -> DataFrame:
    path = new_work_folder(spark, "merged")
    for batch in _two_batches(spark, folder):
        refresh_table(batch, path, mode)
    return _state_view(read_table(spark, path, accumulated_schema()), _history_text())


def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, EXACT)


def merge_upsert_parity(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, PARITY)


# --- the session store ------------------------------------------------------


@_in_bounded_tasks
def _stored(spark: SparkSession, folder: str) -> SessionStore:
    """The later batch first, the earlier one then, and the later one again under its old number."""
    store = SessionStore(spark, new_work_folder(spark, "store"))
    early, late = _two_batches(spark, folder)
    for number, batch in ((0, late), (1, early), (1, early)):
        store.refresh(batch, "batches", number)
    return store


def store_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _state_view(_stored(spark, folder).read(), F.col("control_event_count"))


def store_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot that the store keeps up to date, from its tails."""
    return _stored(spark, folder).snapshot().withColumn("updated_at", F.date_format("updated_at", _SECONDS))


def store_history(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's whole history, from the store's counted form."""
    rows = _stored(spark, folder).read()
    return attach_history(latest_rows(rows), control_events(rows)).select("session_id", "event_id", _history_text())


@_in_bounded_tasks
def store_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The broken broker sample, parsed and streamed into a store by parts, one delivered twice."""
    work = new_work_folder(spark, "store-stream")
    store = SessionStore(spark, f"{work}/store")
    bronze = _bronze(spark, folder)
    early = F.coalesce(F.col("kafka_timestamp") < sample.CUTOFF, F.lit(False))
    for part in (early, ~early, ~early):
        rows = bronze.where(part).withColumn("ingest_ts", F.col("kafka_timestamp"))
        flag_events(parse_events(rows)).write.mode("append").parquet(f"{work}/silver")
        jobs.start_session_store(
            stream_table(spark, f"{work}/silver", FLAGGED_SCHEMA), store, f"{work}/checkpoint"
        ).awaitTermination()
    return _state_view(store.read(), F.col("control_event_count"))


# --- snapshots --------------------------------------------------------------


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    rows = session_snapshot(medallion.accumulated(_silver(spark, folder), history="count"))
    return rows.withColumn("updated_at", F.date_format("updated_at", _SECONDS))


def snapshot_history(spark: SparkSession, folder: str) -> DataFrame:
    folded = medallion.accumulated(_silver(spark, folder), history="count")
    rows = attach_history(latest_rows(folded), control_events(folded))
    return rows.select("session_id", "event_id", _history_text())


def history_ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Each session's history, turned round and full of gaps, put in order of time again."""
    rows = latest_rows(medallion.accumulated(_silver(spark, folder)))
    gaps = F.flatten(F.transform(F.reverse("control_event_history"), lambda entry: F.array(entry, F.lit(None))))
    return rows.select("session_id", history_text(time_ordered(without_nulls(gaps))).alias("history"))


# --- contract, dead letters, replay, publishing, metrics --------------------


def _violations(spark: SparkSession, folder: str, rules: str) -> DataFrame:
    checked = validate_contract(_bronze(spark, folder), rules)
    return checked.select(
        "partition", "offset", F.array_join("violations", ";").alias("violations")
    )


def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    return _violations(spark, folder, "full")


def contract_violations_json_schema(spark: SparkSession, folder: str) -> DataFrame:
    return _violations(spark, folder, "json_schema")


def dead_letter(spark: SparkSession, folder: str) -> DataFrame:
    return medallion.dead_letters(_bronze(spark, folder)).drop("timestamp")


def dead_letter_messages(spark: SparkSession, folder: str) -> DataFrame:
    letters = medallion.dead_letters(_bronze(spark, folder))
    sent = envelopes.dead_letter_messages(letters)
    return sent.select(
        "topic",
        "key",
        F.get_json_object("value", "$.original_topic").alias("original_topic"),
        F.get_json_object("value", "$.error").alias("error"),
        F.get_json_object("value", "$.payload.user_id").alias("payload_user"),
        F.get_json_object("value", "$.payload_text").alias("payload_text"),
    )


@_in_bounded_tasks
def dead_letter_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Bronze through the contract stream."""
    work = new_work_folder(spark, "dead-letters")
    _write_bronze_files(spark, folder, f"{work}/bronze")
    jobs.start_dead_letters(
        stream_table(spark, f"{work}/bronze", BRONZE_SCHEMA),
        f"{work}/letters",
        f"{work}/checkpoint",
        at=F.col("kafka_timestamp"),
        trigger=RUN_ONCE,
    ).awaitTermination()
    return read_table(spark, f"{work}/letters", DEAD_LETTER_SCHEMA)


def dead_letter_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Dead letters as messages and back, one kind of damage repaired, checked again."""
    letters = medallion.dead_letters(_bronze(spark, folder), at=F.col("kafka_timestamp"))
    back = envelopes.dead_letters_of(envelopes.dead_letter_messages(letters))
    rows = envelopes.dead_letters_as_bronze(back)
    checked = validate_contract(rows.withColumn("raw_value", F.replace("raw_value", F.lit(_DAMAGED), F.lit(_REPAIRED))))
    return checked.select("event_key", "raw_value", F.array_join("violations", ";").alias("violations"))


_DAMAGED, _REPAIRED = '"playback_position":"invalid"', '"playback_position":null'


def publish_records(spark: SparkSession, folder: str) -> DataFrame:
    sent = envelopes.to_broker_records(latest_events(_silver(spark, folder)))
    return sent.select("topic", "key", "value", F.size("headers").alias("n_headers"))


def publish_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Published events, landed, checked and parsed again."""
    sent = envelopes.to_broker_records(latest_events(_silver(spark, folder)))
    no_place = {"partition": F.lit(0), "offset": F.lit(0).cast("long"), "timestampType": F.lit(0)}
    landed = land_records(sent.withColumns(no_place).withColumn("timestamp", F.current_timestamp()))
    parsed = parse_events(validate_contract(landed))
    return parsed.select("json.*", "event_key", F.array_join("violations", ";").alias("violations"))


# Lines of a spool hold each document twice, as text and nested.
_SPOOL_FORM = "gzip"


@_in_bounded_tasks
def replay(spark: SparkSession, folder: str) -> DataFrame:
    """All broker messages spooled as JSON lines, then replayed as a stream."""
    work = new_work_folder(spark, "replay")
    spool = _spooled(spark, folder)
    envelopes.spool_lines(spool).write.text(f"{work}/spool", compression=_SPOOL_FORM)
    jobs.start_replay(
        jobs.stream_spool(spark, f"{work}/spool"), f"{work}/replayed", f"{work}/checkpoint"
    ).awaitTermination()
    return read_table(spark, f"{work}/replayed", REPLAYED_SCHEMA).select(
        *EVENT_FIELDS,
        "event_key",
        "raw_value",
        F.date_format("kafka_timestamp", _SECONDS).alias("spooled_at"),
        "violations",
        F.col("valid").cast("int").alias("is_valid"),
    )


# Records of a round in ``replay_resend``, and rounds that one write takes while a backlog is worked off.
_ROUND, _BACKLOG = 2_000, 500


@_in_bounded_tasks
def replay_resend(spark: SparkSession, folder: str) -> DataFrame:
    """All broker messages spooled, taken into an outbox, and sent in rounds; the sink is down once on the way.

    It goes down at the second round. What is left by then is a backlog, of which a write takes many rounds.
    """
    work = new_work_folder(spark, "resend")
    envelopes.spool_lines(_spooled(spark, folder)).write.text(f"{work}/spool", compression=_SPOOL_FORM)
    outbox = Outbox(spark, f"{work}/outbox")
    jobs.start_outbox(jobs.stream_spool(spark, f"{work}/spool", None), outbox, f"{work}/checkpoint").awaitTermination()
    down = [True]

    def write(rows: DataFrame, first: int) -> None:
        if first and down:
            down.clear()
            raise ConnectionError("the sink is down")
        rows.withColumn("round", F.expr(f"cast(position div {_ROUND} as int)")).write.mode("append").parquet(f"{work}/sent")

    try:
        outbox.send(whole_round(write), _ROUND)
    except ConnectionError:
        pass
    outbox.send(whole_round(write), _ROUND, _BACKLOG)
    # Appended, not overwritten: a record sent twice would show.
    return spark.read.parquet(f"{work}/sent").select("topic", F.col("key").alias("event_key"), "value", "digest", "position", "round")


def _spooled(spark: SparkSession, folder: str) -> DataFrame:
    """All broker messages as spool records of the time they were sent."""
    sent = _bronze(spark, folder).selectExpr("topic", "event_key AS key", "raw_value AS value", "kafka_timestamp")
    return envelopes.to_spool(sent, "broker_unavailable", at=F.col("kafka_timestamp"))


def quality_counts(spark: SparkSession, folder: str) -> DataFrame:
    checked = validate_contract(_bronze(spark, folder))
    replayed = flag_events(parse_events(envelopes.spool_as_bronze(_spooled(spark, folder))))
    counted = quality.quality_counts(parse_events(checked), "violations")
    return counted.unionByName(quality.recovery_counts(replayed))


@_in_bounded_tasks
def quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Counters as a stream, an outbox and its sending ran them; the stream's batches are delivered twice."""
    work = new_work_folder(spark, "ledger")
    _write_bronze_files(spark, folder, f"{work}/bronze")
    ledger = CounterLedger(spark, f"{work}/ledger", "contract")
    write = lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{work}/checked/batch={batch_id}")
    for run in (1, 2):
        rows = parse_events(validate_contract(stream_table(spark, f"{work}/bronze", BRONZE_SCHEMA)))
        stream = rows.writeStream.foreachBatch(counted(ledger, quality.outcome_counts("violations"), write))
        stream.option("checkpointLocation", f"{work}/checkpoint-{run}").trigger(**RUN_ONCE).start().awaitTermination()
    outbox = Outbox(spark, f"{work}/outbox")
    for _ in range(2):
        outbox.add(_spooled(spark, folder), "spool", 0)
    outbox.send(whole_round(lambda rows, first: rows.write.parquet(f"{work}/sent/round={first}")), 1_000_000)
    return ledger.totals().unionByName(outbox.counts())


# Batches of ``lag_by_batches``, and those of the range it reports.
_LAG_BATCHES, _LAG_RANGE = 10, (2, 7)


def lag_by_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Lag of a range of batches, from stored sketches; one batch is recorded twice."""
    bronze = _bronze(spark, folder)
    history = lag_sketch.LagHistory(spark, new_work_folder(spark, "lags"))
    for number in [*range(_LAG_BATCHES), _LAG_RANGE[0]]:
        history.record(bronze.where(F.col("offset") % _LAG_BATCHES == number), number)
    sketch = history.between(*_LAG_RANGE)
    histogram = lag_sketch.sketch_histogram(sketch).select(F.concat(F.lit("le "), "le").alias("metric"), F.col("n").cast("double").alias("value"))
    percentiles = lag_sketch.sketch_percentiles(sketch)
    return histogram.unionByName(
        percentiles.select(F.concat(F.lit("p "), F.col("share").cast("string")).alias("metric"), F.col("lag_sec").alias("value"))
    )


def ingest_lag(spark: SparkSession, folder: str) -> DataFrame:
    return quality.ingest_lag(_bronze(spark, folder))


def lag_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return quality.lag_percentiles(_bronze(spark, folder))


QUERIES: dict[str, Query] = {
    "bronze_project": bronze_project,
    "silver_valid": silver_valid,
    "silver_invalid": silver_invalid,
    "bronze_stream": bronze_stream,
    "bronze_clock_stream": bronze_clock_stream,
    "silver_clock_stream": silver_clock_stream,
    "silver_stream": silver_stream,
    "silver_pair_stream": silver_pair_stream,
    "dedup_latest": dedup_latest,
    "impacted_sessions": impacted_sessions,
    "batch_date_range": batch_date_range,
    "target_lookback": target_lookback,
    "working_union": working_union,
    "accumulate_state": accumulated_state,
    "accumulate_skewed": accumulated_skewed,
    "control_history": control_history,
    "control_event_rows": control_event_rows,
    "filter_upserts": filter_upserts,
    "merge_upsert": merge_upsert,
    "merge_upsert_parity": merge_upsert_parity,
    "accumulated_stream": accumulated_stream,
    "pipeline_stream": pipeline_stream,
    "store_upsert": store_upsert,
    "store_snapshot": store_snapshot,
    "store_history": store_history,
    "store_stream": store_stream,
    "accumulate_by_instant": accumulated_by_instant,
    "session_snapshot": snapshot,
    "snapshot_history": snapshot_history,
    "history_ordered": history_ordered,
    "contract_violations": contract_violations,
    "contract_violations_json_schema": contract_violations_json_schema,
    "dead_letter": dead_letter,
    "dead_letter_messages": dead_letter_messages,
    "dead_letter_stream": dead_letter_stream,
    "dead_letter_replay": dead_letter_replay,
    "replay": replay,
    "replay_resend": replay_resend,
    "publish_records": publish_records,
    "publish_roundtrip": publish_roundtrip,
    "quality_counts": quality_counts,
    "quality_ledger": quality_ledger,
    "lag_by_batches": lag_by_batches,
    "ingest_lag": ingest_lag,
    "lag_percentiles": lag_percentiles,
}


# --- SQL counterparts -------------------------------------------------------

_ORDER = ["event_time", "event_version", "event_header_reemission", "ingest_ts"]


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _latest(name: str, source: str) -> str:
    order = ", ".join(f"{key} desc nulls last" for key in _ORDER)
    return f"""{name} as (
  select * exclude (rn), try_cast(left(event_time, 10) as date) as event_date
  from (select *, row_number() over (partition by event_id order by {order}) as rn from {source})
  where rn = 1
)"""


def _folded(name: str, source: str, history: bool = True, alone: bool = False) -> str:
    order = ", ".join(f"{key} asc nulls last" for key in [*_ORDER, "event_id"])
    state = " ".join(f"when '{kind}' then '{value}'" for kind, value in STATE_OF_EVENT.items())
    reason = " ".join(f"when '{kind}' then {column}" for kind, column in REASON_OF_EVENT.items())
    kinds = ", ".join(f"'{kind}'" for kind in REASON_OF_EVENT)
    carried = "\n".join(
        f"    last_value({field} ignore nulls) over w as current_{field}," for field in CARRIED_FIELDS
    )
    entry = f"event_time || '|' || event_type || '|' || coalesce(case event_type {reason} end, '-')"
    texts = (
        f"coalesce(array_to_string(list({entry}) "
        f"filter (where event_type in ({kinds})) over w, ';'), '') as history"
    )
    # Rows without a session are folded together, or each by itself.
    alone_key = ", case when session_id is null then event_id end" if alone else ""
    return f"""{name} as (
  select {", ".join(SILVER_SCHEMA.names)}, event_date,
    last_value(case event_type {state} end ignore nulls) over w as session_state,
{carried}
    count(*) filter (where event_type in ({kinds})) over w as control_event_count
    {", " + texts if history else ""}
  from {source}
  window w as (partition by session_id{alone_key} order by {order}
               rows between unbounded preceding and current row)
)"""


def _state_list(*also: str) -> str:
    return ", ".join(
        [*_IDENTITY, "cast(event_date as varchar) as event_date", *STATE_COLUMNS, *also]
    )


_FOLDED_SAMPLE = (
    sample.sql_watch_events(),
    _latest("latest", "watch"),
    _folded("folded", "latest"),
)

# The first batch folded into the target, the second batch and its lookback.
_TWO_BATCHES = (
    sample.sql_watch_events(),
    f"first as (select * from watch where ingest_ts < timestamp '{sample.CUTOFF}')",
    f"second as (select * from watch where ingest_ts >= timestamp '{sample.CUTOFF}')",
    _latest("first_latest", "first"),
    _folded("target", "first_latest"),
    _latest("batch", "second"),
    """found as (
  select * from target
  where event_date between (select min(event_date) - 1 from batch)
                       and (select max(event_date) + 1 from batch)
    and session_id in (select session_id from batch where session_id is not null)
    and event_id not in (select event_id from batch)
)""",
    """working as (
  select * from found union all by name select * from batch
)""",
    f"""working_input as (
  select {", ".join(SILVER_SCHEMA.names)}, event_date from working
)""",
    _folded("refolded", "working_input"),
    "upserts as (select * from refolded where event_id in (select event_id from batch))",
)

_SILVER_LIST = ", ".join([*EVENT_FIELDS, "event_key", "raw_value"])
_BRONZE_LIST = (
    'topic, "partition", "offset", '
    "strftime(kafka_timestamp, '%Y-%m-%d %H:%M:%S') as kafka_time, "
    '"timestampType", event_key, raw_value'
)
_VIEW_LIST = ", ".join([*_IDENTITY, "cast(event_date as varchar) as event_date", "session_state"])


def _contract(rules: str, source: str = "bronze") -> str:
    """``checked``: the source with ``codes``, one CASE per rule in contract order."""
    full = rules == "full"
    cases = ["case when doc is null then 'malformed' end"]

    def rule(code: str, broken: str) -> None:
        cases.append(f"case when {broken} then '{code}' end")

    def at(name: str) -> tuple[str, str, str]:
        value = f"json_extract(doc, '$.{name}')"
        kind = f"json_type({value})"
        return (
            kind,
            f"json_extract_string(doc, '$.{name}')",
            f"case when {kind} in ('BIGINT', 'UBIGINT', 'DOUBLE') then cast({value} as double) end",
        )

    for name, field in CONTRACT.items():
        kind, text, number = at(name)
        present = f"{kind} is not null" + ("" if field.required else f" and {kind} <> 'NULL'")
        if field.required:
            rule(f"missing:{name}", f"doc is not null and {kind} is null")
        if field.kind == "string":
            rule(f"type:{name}", f"{present} and {kind} <> 'VARCHAR'")
        else:
            rule(f"type:{name}", f"{present} and coalesce({number} <> floor({number}), true)")
        if field.const is not None:
            same = f"{text} = '{field.const}'" if field.kind == "string" else f"{number} = {field.const}"
            rule(f"const:{name}", f"{present} and not coalesce({same}, false)")
        if field.enum:
            options = ", ".join(f"'{option}'" for option in field.enum)
            rule(f"enum:{name}", f"{present} and not coalesce({text} in ({options}), false)")
        if field.minimum is not None:
            over = f" or {number} > {field.maximum}" if field.maximum is not None else ""
            rule(f"range:{name}", f"{number} < {field.minimum}{over}")
        if full and field.non_blank:
            rule(f"blank:{name}", f"{kind} = 'VARCHAR' and {text} = ''")
    allowed = ", ".join(f"'{name}'" for name in CONTRACT)
    unknown = f"list_sort(list_filter(json_keys(doc), lambda n: n not in ({allowed})))"
    cases.append(
        f"case when len({unknown}) > 0 then 'unknown:' || array_to_string({unknown}, ',') end"
    )
    if full:
        event_type, (time_kind, time_text, _) = at("event_type")[1], at("event_time")
        rule(
            "format:event_time",
            f"{time_kind} = 'VARCHAR' and try_cast({time_text} as timestamp) is null",
        )
        for kind, reason in REASON_OF_EVENT.items():
            absent = f"coalesce({at(reason)[0]}, 'NULL') = 'NULL'"
            rule(f"requires:{reason}", f"{event_type} = '{kind}' and {absent}")
        percent_kind, _, percent = at("completion_percent")
        rule(
            "requires:completion_percent",
            f"{event_type} = 'completed' and coalesce({percent_kind}, 'NULL') = 'NULL'",
        )
        rule("incomplete:completion_percent", f"{event_type} = 'completed' and {percent} <> 100")
    codes = ",\n    ".join(cases)
    return f"""objects as (
  select *, case when json_valid(raw_value) and json_type(raw_value) = 'OBJECT'
                 then raw_value end as doc
  from {source}
),
checked as (
  select *, list_filter([{codes}], lambda c: c is not null) as codes from objects
)"""


def _codes(rules: str) -> str:
    return _with(sample.sql_bronze(), _contract(rules)) + (
        'select "partition", "offset", array_to_string(codes, \';\') as violations from checked'
    )


def _quality(replayed: str | None = None) -> str:
    again = "try_cast(json_extract(doc, '$.event_header_reemission') as integer) > 0"
    usable = " and ".join(
        f"json_extract_string(doc, '$.{name}') is not null"
        for name in ("event_id", "user_id", "event_type")
    )
    counts = {
        "accepted": "true",
        "delivered": f"coalesce({usable}, false)",
        "failed": f"not coalesce({usable}, false)",
        "reemitted": again,
        "dead_lettered": "len(codes) > 0",
        "spooled": "true",
        "replayed": replayed or f"coalesce({usable}, false)",
    }
    rows = "\nunion all\n".join(
        f"select '{name}' as outcome, count(*) filter (where {test}) as n from checked"
        for name, test in counts.items()
    )
    return _with(sample.sql_bronze(), _contract("full")) + rows


def _lag() -> str:
    lag = "(epoch_us(ingest_ts) - epoch_us(kafka_timestamp)) / 1e6"
    rows = [
        f"select '{bound}' as le, count(*) filter (where lag <= {bound}) as n from lags"
        for bound in quality.LAG_BOUNDS
    ]
    rows.append("select '+Inf' as le, count(*) as n from lags")
    return _with(sample.sql_bronze(), f"lags as (select {lag} as lag from bronze)") + (
        "\nunion all\n".join(rows)
    )


def _lag_of_range() -> str:
    low, high = _LAG_RANGE
    size = f"greatest(length(bin(abs(lag))) - {lag_sketch.LEADING_BITS}, 0)"
    rows = [
        f"select 'le {bound}' as metric, cast(count(*) filter (where lag / 1e6 <= {bound}) as double) as value from lags"
        for bound in quality.LAG_BOUNDS
    ]
    rows.append("select 'le +Inf', cast(count(*) as double) from lags")
    rows += [f"select 'p {share}', quantile_disc(bucket, {share}) / 1e6 from buckets" for share in (0.5, 0.95, 0.99)]
    return _with(
        sample.sql_bronze(),
        "lags as (select epoch_us(ingest_ts) - epoch_us(kafka_timestamp) as lag from bronze "
        f"where \"offset\" % {_LAG_BATCHES} between {low} and {high} and ingest_ts is not null and kafka_timestamp is not null)",
        f"buckets as (select sign(lag) * ((abs(lag) >> {size}) << {size}) as bucket from lags)",
    ) + "\nunion all\n".join(rows)


def _percentiles() -> str:
    lag = "(epoch_us(ingest_ts) - epoch_us(kafka_timestamp)) / 1e6"
    rows = "\nunion all\n".join(
        f"select cast({share} as double) as share, quantile_disc(lag, {share}) as lag_sec from lags"
        for share in (0.5, 0.95, 0.99)
    )
    return _with(sample.sql_bronze(), f"lags as (select {lag} as lag from bronze)") + rows


_VIOLATIONS = "array_to_string(codes, ';') as violations"
_EXACT_STATE = _with(*_FOLDED_SAMPLE) + f"select {_state_list('history')} from folded"
_BOTH_HALVES = (
    _with(sample.sql_silver())
    + f"select {_SILVER_LIST}, cast(valid as integer) as is_valid from parsed"
)
_SNAPSHOT_ORDER = ", ".join(
    [*(f"{key} desc nulls last" for key in _ORDER), "event_id desc"]
)
_LAST_OF_SESSION = f"""last_rows as (
  select * from (select *, row_number() over (partition by session_id order by {_SNAPSHOT_ORDER}) as rn
                 from folded where session_id is not null)
  where rn = 1
)"""

_SNAPSHOT = (
    _with(*_FOLDED_SAMPLE, _LAST_OF_SESSION)
    + "select session_id, user_id, content_id, session_state as current_state, "
    "coalesce(current_playback_position, 0) as playback_position_sec, "
    "strftime(cast(event_time as timestamp), '%Y-%m-%d %H:%M:%S') as updated_at from last_rows"
)
_SNAPSHOT_HISTORY = (
    _with(*_FOLDED_SAMPLE, _LAST_OF_SESSION) + "select session_id, event_id, history from last_rows"
)
_STREAMED = _with(
    sample.sql_silver(),
    "usable as (select * replace (kafka_timestamp as ingest_ts) from parsed where valid)",
    _latest("latest", "usable"),
    _folded("folded", "latest", alone=True),
)

ORACLES: dict[str, str] = {
    "bronze_project": _with(sample.sql_bronze())
    + f"select {_BRONZE_LIST}, cast(date as varchar) as date from bronze",
    "silver_valid": _with(sample.sql_silver()) + f"select {_SILVER_LIST} from parsed where valid",
    "silver_invalid": _with(sample.sql_silver())
    + f"select {_SILVER_LIST} from parsed where not valid",
    "bronze_stream": _with(sample.sql_bronze()) + f"select {_BRONZE_LIST} from bronze",
    "bronze_clock_stream": _with(sample.sql_bronze())
    + f"select {_BRONZE_LIST}, '{_LANDED[:10]}' as date, '{_LANDED}' as landed from bronze",
    "silver_clock_stream": _BOTH_HALVES,
    "silver_stream": _BOTH_HALVES,
    "silver_pair_stream": _BOTH_HALVES,
    "dedup_latest": _with(sample.sql_watch_events(), _latest("latest", "watch"))
    + f"select {', '.join(_IDENTITY)}, event_type, event_time, playback_position, "
    "cast(event_date as varchar) as event_date from latest",
    "impacted_sessions": _with(sample.sql_watch_events())
    + "select distinct session_id from watch where session_id is not null",
    "batch_date_range": _with(sample.sql_watch_events(), _latest("latest", "watch"))
    + "select cast(min(event_date) - 1 as varchar) as min_date, "
    "cast(max(event_date) + 1 as varchar) as max_date from latest",
    "target_lookback": _with(*_TWO_BATCHES) + f"select {_VIEW_LIST} from found",
    "working_union": _with(*_TWO_BATCHES) + f"select {_VIEW_LIST} from working",
    "accumulate_state": _EXACT_STATE,
    "accumulate_skewed": _with(
        sample.sql_watch_events(),
        "large as (select * replace (case when event_type in ('play', 'pause') then 'live' "
        "else session_id end as session_id) from watch)",
        _latest("latest", "large"),
        # Without the history text: every row of the large session would repeat it.
        _folded("folded", "latest", history=False),
    )
    + f"select {_state_list('control_event_count')} from folded",
    "control_history": _with(*_FOLDED_SAMPLE)
    + "select event_id, cast(control_event_count as integer) as n_control, history from folded",
    "control_event_rows": _with(*_FOLDED_SAMPLE)
    + "select session_id, control_event_count as position, event_id, event_time, event_type, "
    "coalesce(pause_reason, resume_reason, abandoned_reason) as reason from folded "
    "where event_type in ('pause', 'resume', 'abandoned')",
    "filter_upserts": _with(*_TWO_BATCHES)
    + f"select {_state_list('control_event_count')} from upserts",
    "merge_upsert": _EXACT_STATE,
    "merge_upsert_parity": _with(*_TWO_BATCHES)
    + f"select {_state_list('history')} from target "
    "where event_id not in (select event_id from upserts)\nunion all\n"
    f"select {_state_list('history')} from upserts",
    "accumulated_stream": _EXACT_STATE,
    "pipeline_stream": _STREAMED + f"select {_state_list('history')} from folded",
    "store_upsert": _with(*_FOLDED_SAMPLE) + f"select {_state_list('control_event_count')} from folded",
    "store_snapshot": _SNAPSHOT,
    "store_history": _SNAPSHOT_HISTORY,
    "store_stream": _STREAMED + f"select {_state_list('control_event_count')} from folded",
    # Instants are those of the sample's own times, whichever way they are written.
    "accumulate_by_instant": _with(
        sample.sql_watch_events(), _latest("latest", "watch"), _folded("folded", "latest", history=False)
    )
    + f"select event_id, {', '.join(STATE_COLUMNS)}, control_event_count from folded",
    "session_snapshot": _SNAPSHOT,
    "snapshot_history": _SNAPSHOT_HISTORY,
    "history_ordered": _with(*_FOLDED_SAMPLE, _LAST_OF_SESSION)
    + "select l.session_id, coalesce(string_agg(concat_ws('|', c.event_time, c.event_type, "
    "coalesce(c.pause_reason, c.resume_reason, c.abandoned_reason, '-')), ';' "
    "order by c.event_time nulls last, c.control_event_count desc) "
    "filter (where c.event_id is not null), '') as history "
    "from last_rows l left join folded c on c.session_id = l.session_id "
    "and c.event_type in ('pause', 'resume', 'abandoned') and c.control_event_count <= l.control_event_count "
    "group by l.session_id",
    "contract_violations": _codes("full"),
    "contract_violations_json_schema": _codes("json_schema"),
    "dead_letter": _with(sample.sql_bronze(), _contract("full"))
    + f"select '{EVENT_TOPIC}' as original_topic, event_key as key, raw_value as payload, "
    "array_to_string(codes, '; ') as error from checked where len(codes) > 0",
    "dead_letter_messages": _with(sample.sql_bronze(), _contract("full"))
    + f"select '{DEAD_LETTER_TOPIC}' as topic, event_key as key, '{EVENT_TOPIC}' as original_topic, "
    "array_to_string(codes, '; ') as error, json_extract_string(doc, '$.user_id') as payload_user, "
    "raw_value as payload_text from checked where len(codes) > 0",
    "dead_letter_stream": _with(sample.sql_bronze(), _contract("full"))
    + f"select '{EVENT_TOPIC}' as original_topic, event_key as key, raw_value as payload, "
    "array_to_string(codes, '; ') as error, epoch_us(kafka_timestamp) / 1e6 as timestamp "
    "from checked where len(codes) > 0",
    "dead_letter_replay": _with(
        sample.sql_bronze(),
        _contract("full").replace("objects as", "first_objects as").replace("checked as", "rejected as").replace("from objects", "from first_objects"),
        f"repaired as (select event_key, replace(raw_value, '{_DAMAGED}', '{_REPAIRED}') as raw_value "
        "from rejected where len(codes) > 0)",
        _contract("full", "repaired"),
    )
    + f"select event_key, raw_value, {_VIOLATIONS} from checked",
    "replay": _with(
        sample.sql_silver(),
        _contract("full"),
        # Copies of a record are alike in all that is selected here.
        f"rules as (select raw_value as text, any_value(array_to_string(codes, '; ')) as violations "
        "from checked group by raw_value)",
    )
    + f"select {', '.join(EVENT_FIELDS)}, event_key, raw_value, "
    "strftime(kafka_timestamp, '%Y-%m-%d %H:%M:%S') as spooled_at, violations, "
    "cast(valid as integer) as is_valid from parsed join rules on raw_value is not distinct from text",
    "replay_resend": _with(
        sample.sql_bronze(),
        "sized as (select topic, event_key, raw_value as value, kafka_timestamp, sha256("
        + " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("topic", "event_key", "raw_value"))
        + ") as digest from bronze)",
        "placed as (select *, row_number() over (order by kafka_timestamp nulls first, digest) - 1 as position from sized)",
    )
    + f"select topic, event_key, value, digest, position, cast(position // {_ROUND} as integer) as round from placed",
    "publish_records": _with(sample.sql_watch_events(), _latest("latest", "watch"))
    + f"select '{EVENT_TOPIC}' as topic, session_id as key, "
    f"{sample.sql_payload()} as value, 1 as n_headers from latest",
    "publish_roundtrip": _with(sample.sql_watch_events(), _latest("latest", "watch"))
    + f"select {', '.join(EVENT_FIELDS)}, session_id as event_key, '' as violations from latest",
    "quality_counts": _quality(),
    # What an outbox sends is every record, whether it parses or not.
    "quality_ledger": _quality(replayed="true"),
    "lag_by_batches": _lag_of_range(),
    "ingest_lag": _lag(),
    "lag_percentiles": _percentiles(),
}
