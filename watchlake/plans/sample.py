"""Watch events derived from a generic ``events`` table.

``events`` is ``event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING,
value DOUBLE, props STRING '{"k": 0..99}'``. Every row becomes one watch event,
and ``k`` decides what else happens to it: exact duplicates, re-emissions,
corrections and late arrivals here, broken payloads in ``broker_records``.

Each rule has a Spark and an SQL form, written independently; the SQL forms feed
the oracle queries.
"""

from pyspark.sql import Column, DataFrame, functions as F

from watchlake.functions.barrier import computed_once
from watchlake.operators.envelopes import event_payload
from watchlake.schemas import EVENT_FIELDS, EVENT_TOPIC, LINEAGE_FIELDS, SILVER_SCHEMA

# Start of the second arrival window when the sample is fed in two batches.
CUTOFF = "2024-01-16 00:00:00"

TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _tagged(events: DataFrame) -> DataFrame:
    """All copies of every event, unserialised, with ``k``, ``copy``, ``part``, ``eid``."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.expr(
        "CASE event_type WHEN 'view' THEN 'play' WHEN 'click' THEN 'pause' "
        "WHEN 'signup' THEN 'resume' WHEN 'purchase' THEN 'completed' ELSE 'abandoned' END"
    )
    base = events.select(
        F.col("event_id").alias("eid"),
        F.col("user_id").alias("uid"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").cast("int").alias("position"),
        kind.alias("event_type"),
        k.alias("k"),
    )
    copies = F.expr(
        """filter(array(
             named_struct('copy', 0, 'version', 1, 'again', 0,
                          'days', if(k < 12, 2, 0), 'kept', true),
             named_struct('copy', 1, 'version', 1, 'again', 0,
                          'days', if(k < 12, 2, 0), 'kept', k BETWEEN 70 AND 79),
             named_struct('copy', 2, 'version', 1, 'again', 1, 'days', 3, 'kept', k >= 86),
             named_struct('copy', 3, 'version', 2, 'again', 0, 'days', 5,
                          'kept', k BETWEEN 40 AND 44)
           ), c -> c.kept)"""
    )
    sent = base.select("*", F.inline(copies)).withColumn(
        "kafka_timestamp", F.expr("ts + make_dt_interval(days)")
    )
    return sent.selectExpr(
        "k",
        "copy",
        "eid",
        "cast(uid % 4 AS int) AS part",
        "cast(eid AS string) AS event_id",
        "event_type",
        "concat('user_', uid) AS user_id",
        "concat('s', uid, '_', cast(floor((day(ts) - 1) / 7) AS int)) AS session_id",
        "concat('c', cast(floor(k / 9) AS int)) AS content_id",
        f'date_format(ts, "{TEXT}") AS event_time',
        "version AS event_version",
        "again AS event_header_reemission",
        "position AS playback_position",
        """CASE WHEN event_type = 'play' THEN
             CASE WHEN k < 34 THEN 'mobile' WHEN k < 67 THEN 'desktop' ELSE 'tv' END
           END AS device_type""",
        """CASE WHEN event_type = 'play' THEN
             CASE WHEN k < 17 THEN 'ios' WHEN k < 34 THEN 'android' WHEN k < 67 THEN 'web'
                  ELSE 'webos' END
           END AS platform""",
        """CASE WHEN event_type = 'play' THEN
             CASE WHEN k < 10 THEN '4g' WHEN k < 20 THEN '5g' ELSE 'wifi' END
           END AS network_type""",
        "CASE WHEN event_type = 'pause' THEN 'user_clicked_pause' END AS pause_reason",
        "CASE WHEN event_type = 'resume' THEN 'user_clicked_play' END AS resume_reason",
        """CASE event_type WHEN 'completed' THEN 100
                WHEN 'abandoned' THEN cast(floor(k * 3 / 4) AS int) + 5
           END AS completion_percent""",
        "CASE WHEN event_type IN ('completed', 'abandoned') THEN position END AS watch_duration_sec",
        "CASE WHEN event_type = 'abandoned' THEN 'app_closed' END AS abandoned_reason",
        "kafka_timestamp",
        "kafka_timestamp + make_dt_interval(0, 0, 0, k * 0.137) AS ingest_ts",
    )


def watch_events(events: DataFrame) -> DataFrame:
    """Well-formed Silver rows."""
    rows = computed_once(_tagged(events), event_payload().alias("raw_value"))
    return rows.withColumn("event_key", F.col("session_id")).select(*SILVER_SCHEMA.names)


def broker_records(events: DataFrame) -> DataFrame:
    """Broker records, a quarter of them with a broken or unusual payload.

    The extra column ``landed_at`` is the ingest time of the sample.
    """
    rows = _tagged(events).withColumn("event_key", F.col("session_id"))
    rows = rows.withColumns(
        {
            "event_type": F.expr("if(k BETWEEN 8 AND 10, 'Unknown Event', event_type)"),
            "session_id": F.expr("CASE k WHEN 16 THEN '' WHEN 26 THEN NULL ELSE session_id END"),
            "event_time": F.expr("if(k = 19, 'yesterday', event_time)"),
            "event_version": F.expr("if(k = 17, 0, event_version)"),
            "completion_percent": F.expr(
                "CASE k WHEN 15 THEN 140 WHEN 21 THEN NULL WHEN 22 THEN 99 ELSE completion_percent END"
            ),
            "pause_reason": F.expr("if(k = 20, NULL, pause_reason)"),
            "resume_reason": F.expr("if(k = 20, NULL, resume_reason)"),
            "abandoned_reason": F.expr("if(k = 20, NULL, abandoned_reason)"),
        }
    )
    rows = computed_once(rows, event_payload().alias("good"))
    broken = F.expr(
        """CASE
             WHEN k <= 3 THEN 'not json'
             WHEN k <= 7 THEN replace(good, concat('"event_id":"', event_id, '",'), '')
             WHEN k BETWEEN 11 AND 13 THEN
               replace(good, concat('"playback_position":', playback_position, ','),
                             '"playback_position":"invalid",')
             WHEN k = 14 THEN concat(left(good, length(good) - 1), ',"extra":true}')
             WHEN k = 18 THEN replace(good, '"schema_version":1', '"schema_version":2')
             WHEN k = 23 THEN '[1, 2]'
             WHEN k = 24 THEN ''
             WHEN k = 25 THEN NULL
             ELSE good
           END"""
    )
    return computed_once(rows, F.encode(broken, "UTF-8").alias("value")).select(
        F.encode("event_key", "UTF-8").alias("key"),
        "value",
        F.lit(EVENT_TOPIC).alias("topic"),
        F.col("part").alias("partition"),
        (F.col("eid") * 4 + F.col("copy")).alias("offset"),
        F.col("kafka_timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.col("ingest_ts").alias("landed_at"),
    )


def one_large_session(silver: DataFrame) -> DataFrame:
    """The sample with two event types, about 40 % of all rows, in a single session."""
    return silver.withColumn(
        "session_id",
        F.when(F.col("event_type").isin("play", "pause"), "live").otherwise(F.col("session_id")),
    )


_SQL_TAGGED = """
base as (
  select event_id as eid, user_id as uid, ts, cast(floor(value) as integer) as position,
    case event_type when 'view' then 'play' when 'click' then 'pause'
      when 'signup' then 'resume' when 'purchase' then 'completed' else 'abandoned'
    end as event_type,
    cast(json_extract(props, '$.k') as integer) as k
  from events
),
sent as (
  select *, 0 as copy, 1 as version, 0 as again, case when k < 12 then 2 else 0 end as days
  from base
  union all
  select *, 1, 1, 0, case when k < 12 then 2 else 0 end from base where k between 70 and 79
  union all
  select *, 2, 1, 1, 3 from base where k >= 86
  union all
  select *, 3, 2, 0, 5 from base where k between 40 and 44
),
tagged as (
  select k, copy, eid, cast(uid % 4 as integer) as part,
    cast(eid as varchar) as event_id,
    event_type,
    'user_' || uid as user_id,
    's' || uid || '_' || cast(floor((day(ts) - 1) / 7) as integer) as session_id,
    'c' || cast(floor(k / 9) as integer) as content_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as event_time,
    version as event_version,
    again as event_header_reemission,
    position as playback_position,
    case when event_type = 'play' then
      case when k < 34 then 'mobile' when k < 67 then 'desktop' else 'tv' end end as device_type,
    case when event_type = 'play' then
      case when k < 17 then 'ios' when k < 34 then 'android' when k < 67 then 'web'
           else 'webos' end end as platform,
    case when event_type = 'play' then
      case when k < 10 then '4g' when k < 20 then '5g' else 'wifi' end end as network_type,
    case when event_type = 'pause' then 'user_clicked_pause' end as pause_reason,
    case when event_type = 'resume' then 'user_clicked_play' end as resume_reason,
    case event_type when 'completed' then 100
      when 'abandoned' then cast(floor(k * 3 / 4) as integer) + 5 end as completion_percent,
    case when event_type in ('completed', 'abandoned') then position end as watch_duration_sec,
    case when event_type = 'abandoned' then 'app_closed' end as abandoned_reason,
    ts + to_days(days) as kafka_timestamp,
    ts + to_days(days) + to_milliseconds(k * 137) as ingest_ts
  from sent
)"""


def sql_payload() -> str:
    """The canonical payload of a row with all event fields."""
    fields = ", ".join(f"'{name}': {name}" for name in EVENT_FIELDS)
    return (
        "cast(to_json({'schema_name': 'watch_event', 'schema_version': 1, " + fields + "}) as varchar)"
    )


def sql_watch_events() -> str:
    """WITH list ending in ``watch``, the counterpart of ``watch_events``."""
    names = ", ".join([*EVENT_FIELDS, "session_id as event_key", "kafka_timestamp", "ingest_ts"])
    return f"{_SQL_TAGGED},\nwatch as (select {names}, {sql_payload()} as raw_value from tagged)"


def sql_bronze() -> str:
    """WITH list ending in ``bronze``, the landed counterpart of ``broker_records``."""
    changed = {
        "event_type": "case when k between 8 and 10 then 'Unknown Event' else event_type end",
        "session_id": "case k when 16 then '' when 26 then null else session_id end",
        "event_time": "case when k = 19 then 'yesterday' else event_time end",
        "event_version": "case when k = 17 then 0 else event_version end",
        "completion_percent": "case k when 15 then 140 when 21 then null when 22 then 99"
        " else completion_percent end",
        "pause_reason": "case when k = 20 then null else pause_reason end",
        "resume_reason": "case when k = 20 then null else resume_reason end",
        "abandoned_reason": "case when k = 20 then null else abandoned_reason end",
    }
    fields = ", ".join(f"{changed.get(name, name)} as {name}" for name in EVENT_FIELDS)
    return f"""{_SQL_TAGGED},
odd as (
  select k, copy, eid, part, session_id as event_key, kafka_timestamp, ingest_ts, {fields} from tagged
),
good as (select *, {sql_payload()} as good from odd),
bronze as (
  select '{EVENT_TOPIC}' as topic, part as "partition", eid * 4 + copy as "offset",
    kafka_timestamp, 0 as "timestampType", event_key,
    case when k <= 3 then 'not json'
      when k <= 7 then replace(good, '"event_id":"' || event_id || '",', '')
      when k between 11 and 13 then
        replace(good, '"playback_position":' || playback_position || ',',
                '"playback_position":"invalid",')
      when k = 14 then left(good, length(good) - 1) || ',"extra":true}}'
      when k = 18 then replace(good, '"schema_version":1', '"schema_version":2')
      when k = 23 then '[1, 2]' when k = 24 then '' when k = 25 then null
      else good end as raw_value,
    ingest_ts, cast(ingest_ts as date) as date
  from good
)"""


def sql_silver() -> str:
    """WITH list ending in ``parsed`` (Silver columns plus ``valid``), on ``sql_bronze``."""
    readable = "case when json_valid(raw_value) then raw_value end"
    fields = []
    for name, kind in EVENT_FIELDS.items():
        if kind == "integer":
            fields.append(f"try_cast(json_extract(doc, '$.{name}') as integer) as {name}")
        else:
            fields.append(f"json_extract_string(doc, '$.{name}') as {name}")
    lineage = ", ".join(LINEAGE_FIELDS)
    return f"""{sql_bronze()},
docs as (select *, {readable} as doc from bronze),
flat as (select {", ".join(fields)}, {lineage} from docs),
parsed as (
  select *, event_id is not null and user_id is not null and event_type is not null as valid from flat
)"""
