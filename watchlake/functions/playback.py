"""Expressions over one watch event."""

from functools import reduce

from pyspark.sql import Column, functions as F

from watchlake.schemas import REASON_OF_EVENT, STATE_OF_EVENT


def _case(branches: dict[str, Column], event_type: str) -> Column:
    """CASE event_type WHEN ... THEN ... END; NULL where no branch matches."""
    first, *rest = branches.items()
    return reduce(
        lambda case, branch: case.when(F.col(event_type) == branch[0], branch[1]),
        rest,
        F.when(F.col(event_type) == first[0], first[1]),
    )


def playback_state(event_type: str = "event_type") -> Column:
    """State the event puts its session in; NULL (no change) for unknown types."""
    return _case({kind: F.lit(state) for kind, state in STATE_OF_EVENT.items()}, event_type)


def is_control_event(event_type: str = "event_type") -> Column:
    return F.col(event_type).isin(*REASON_OF_EVENT)


def control_reason(event_type: str = "event_type") -> Column:
    return _case({kind: F.col(name) for kind, name in REASON_OF_EVENT.items()}, event_type)


def control_event() -> Column:
    """``struct(event_time, event_type, reason)``, NULL for other event types."""
    entry = F.struct("event_time", "event_type", control_reason().alias("reason"))
    return F.when(is_control_event(), entry)


def time_ordered(history: Column | str) -> Column:
    """Sort a control-event array by ``event_time``; equal or NULL times keep their order.

    Arrays built by the session windows are already in this order. It serves
    arrays gathered in any other way. The position is the second sort key, and
    NULL times stay after all others.
    """
    history = F.col(history) if isinstance(history, str) else history
    keyed = F.transform(
        history,
        lambda entry, i: F.struct(
            entry["event_time"].isNull().alias("late"),
            entry["event_time"].alias("at"),
            i.alias("i"),
            entry.alias("entry"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["entry"])


def without_nulls(history: Column | str) -> Column:
    """Drop NULL entries of a control-event array."""
    return F.array_compact(history)


def history_text(history: Column | str) -> Column:
    """Flat text of a control-event array: ``time|type|reason`` joined by ``;``."""
    history = F.col(history) if isinstance(history, str) else history
    return F.array_join(F.transform(history, entry_text), ";")


def entry_text(entry: Column) -> Column:
    """Flat text of one control event."""
    return F.concat_ws("|", entry["event_time"], entry["event_type"], F.coalesce(entry["reason"], F.lit("-")))
