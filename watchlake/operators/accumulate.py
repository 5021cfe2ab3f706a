"""Fold each session's events into a running state.

Every output row carries the session state, the last known value of the carried
fields, and the control events, all as of that row.

A window runs a whole group in one task. That is right for ordinary sessions and
wrong for one that holds a large share of all rows, so sessions above ``hot_rows``
are cut into segments: a row whose order key falls on one of ``hot_rows / 2`` hash
values is a cut, and a row's segment is the number of cuts up to it. One window
folds every segment, and what a session's earlier segments leave behind is carried
into the later ones. Cuts come from the rows alone, so a recomputed task finds
the same segments, and neither a range partitioning nor a copy of the rows is needed.
"""

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec, functions as F

from watchlake.functions.ordering import oldest_first, order_key
from watchlake.functions.playback import control_event, is_control_event, playback_state
from watchlake.operators.sizing import broadcast_if_known_small
from watchlake.schemas import CARRIED_FIELDS, HISTORY_TYPES
from watchlake.session import shared_folder

# Rows above which a session is cut. An array history makes a task's output
# grow with the square of its session, so it is cut much earlier.
HOT_ROWS = {"array": 20_000, "count": 2_000_000}

STATE_COLUMNS = ["session_state", *(f"current_{name}" for name in CARRIED_FIELDS)]
HISTORY_COLUMN = {form: name for form, (name, _) in HISTORY_TYPES.items()}


def running_frame(*keys: Column | str, time_column: str | None = None) -> WindowSpec:
    """All rows of the group up to the current one, oldest first.

    ``event_id`` closes the order, so it is total once ids are unique.
    """
    return (
        Window.partitionBy(*keys)
        .orderBy(*oldest_first("event_id", time_column=time_column))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _folded(frame: WindowSpec, history: str) -> dict[str, Column]:
    columns = {"session_state": F.last(playback_state(), ignorenulls=True).over(frame)}
    for name in CARRIED_FIELDS:
        columns[f"current_{name}"] = F.last(name, ignorenulls=True).over(frame)
    if history == "array":
        columns["control_event_history"] = F.collect_list(control_event()).over(frame)
    else:
        columns["control_event_count"] = F.count_if(is_control_event()).over(frame)
    return columns


def accumulate_state(
    events: DataFrame,
    *,
    history: str = "array",
    null_sessions: str = "shared",
    hot_rows: int | None = None,
    sessions_from: DataFrame | None = None,
    time_column: str | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add the running session columns to deduplicated events.

    ``history="array"`` adds ``control_event_history``, which grows with the
    square of a session; ``"count"`` adds ``control_event_count``, the length of
    that array, from which ``operators.history`` rebuilds it for any row.

    ``null_sessions="shared"`` folds all rows without a session together, ``"own"``
    folds each by itself. Sessions above ``hot_rows`` (by default as in ``HOT_ROWS``)
    are cut into segments. ``sessions_from`` is a cheaper frame to count session
    sizes and find cuts in, if there is one; its counts must not be below those of ``events``.
    Where no session can have more rows than ``largest``, that may spare the count.
    """
    if history not in HISTORY_COLUMN:
        raise ValueError(f"history must be one of {sorted(HISTORY_COLUMN)}")
    if null_sessions not in ("shared", "own"):
        raise ValueError("null_sessions must be 'shared' or 'own'")
    own = null_sessions == "own"

    hot_rows = hot_rows or HOT_ROWS[history]
    keys = [F.col("session_id")]
    if own:
        keys.append(F.when(F.col("session_id").isNull(), F.col("event_id")))
    if largest is not None and largest <= hot_rows:
        return events.withColumns(_folded(running_frame(*keys, time_column=time_column), history))
    sizes = events if sessions_from is None else sessions_from
    if own:
        sizes = sizes.where("session_id IS NOT NULL")
    # Fixed, being read by both sides of the carry.
    shared_folder(events.sparkSession)
    cuts = _cuts(sizes, hot_rows, time_column).checkpoint()
    size = _size_of(cuts)
    if not size.most:
        # No session has a segment but its first, so there is nothing to carry.
        return events.withColumns(_folded(running_frame(*keys, time_column=time_column), history))

    segment = _cuts_up_to(F.col("_cuts"), F.col("_key"), size.most)
    keyed = events.withColumns({"_group": _group_key(own), "_key": order_key("event_id", time_column=time_column)})
    rows = keyed.join(broadcast_if_known_small(cuts, size.bytes), "_group", "left").withColumn("_segment", segment)
    left_behind = _left_behind(rows.where("_cuts IS NOT NULL"), history)
    folded = rows.drop("_key", "_cuts").withColumns(
        _folded(running_frame("_group", "_segment", time_column=time_column), history)
    )
    return _carried_on(folded, left_behind, history).drop("_group", "_segment")


def _group_key(own: bool) -> Column:
    """A never-NULL text that is equal exactly for rows folded together."""
    alone = F.concat(F.lit("e:"), F.col("event_id")) if own else F.lit("n:")
    return F.when(F.col("session_id").isNull(), alone).otherwise(
        F.concat(F.lit("s:"), F.col("session_id"))
    )


def _cuts(events: DataFrame, hot_rows: int, time_column: str | None) -> DataFrame:
    """Per group above ``hot_rows`` the sorted order keys at which a segment starts.

    Keys are chosen by their hash: one in ``hot_rows / 2``, equal keys once. Any choice
    gives the same fold, so copies not yet deduplicated do no harm. One pass counts rows
    and finds cuts; a group's rows are counted before they meet.
    """
    key = order_key("event_id", time_column=time_column)
    chosen = F.pmod(F.xxhash64(key), F.lit(max(1, hot_rows // 2))) == 0
    return (
        events.select(_group_key(own=False).alias("_group"), F.when(chosen, key).alias("_key"))
        .groupBy("_group", "_key")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy("_group")
        .agg(F.sum("_rows").alias("_rows"), F.array_sort(F.collect_list("_key")).alias("_cuts"))
        .where((F.col("_rows") > hot_rows) & (F.size("_cuts") > 0))
        .select("_group", "_cuts")
    )


def _size_of(cuts: DataFrame) -> Row:
    """``most`` cuts of one group (NULL: no cuts), and a bound of the ``bytes`` of all."""
    text = F.octet_length(F.to_json("_cuts")) + F.octet_length("_group") + 64
    return cuts.agg(F.max(F.size("_cuts")).alias("most"), F.sum(text).alias("bytes")).first()


def _cuts_up_to(cuts: Column, key: Column, most: int) -> Column:
    """How many of at most ``most`` sorted ``cuts`` are not above ``key``, by halving."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))])
    counted = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at),
    )
    return F.when(cuts.isNull(), 0).otherwise(counted)


def _left_behind(rows: DataFrame, history: str) -> DataFrame:
    """What all earlier segments of a group leave to each of its segments.

    A segment is summed up before anything is shuffled; a group then has a row a segment.
    """

    def newest(value: Column, name: str) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), F.col("_key"))).alias(name)

    values = {"session_state": playback_state()}
    values |= {f"current_{name}": F.col(name) for name in CARRIED_FIELDS}
    if history == "array":
        keyed = F.when(is_control_event(), F.struct(F.col("_key"), control_event().alias("entry")))
        past = F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["entry"])
    else:
        past = F.count_if(is_control_event())
    ends = rows.groupBy("_group", "_segment").agg(
        *[newest(value, name) for name, value in values.items()], past.alias("_past")
    )
    earlier = (
        Window.partitionBy("_group")
        .orderBy("_segment")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if history == "array":
        past_history = F.flatten(F.collect_list("_past").over(earlier))
    else:
        past_history = F.coalesce(F.sum("_past").over(earlier), F.lit(0))
    carried = [F.last(name, ignorenulls=True).over(earlier).alias(f"_in_{name}") for name in STATE_COLUMNS]
    return ends.select("_group", "_segment", *carried, past_history.alias("_in_history")).where("_segment > 0")


def _carried_on(folded: DataFrame, left_behind: DataFrame, history: str) -> DataFrame:
    """Folded segments with what came before them."""
    name = HISTORY_COLUMN[history]
    before = F.col("_in_history")
    total = F.concat(before, F.col(name)) if history == "array" else before + F.col(name)
    return (
        # The large side is partitioned and sorted for a merge join already, and
        # carried arrays have no size bound that would permit a broadcast.
        folded.join(left_behind.hint("merge"), ["_group", "_segment"], "left")
        .withColumns(
            {column: F.coalesce(F.col(column), F.col(f"_in_{column}")) for column in STATE_COLUMNS}
            | {name: F.coalesce(total, F.col(name))}
        )
        .drop("_in_history", *(f"_in_{column}" for column in STATE_COLUMNS))
    )
