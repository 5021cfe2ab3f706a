"""The layers end to end as batch plans."""

from pyspark.sql import Column, DataFrame

from watchlake.operators.accumulate import accumulate_state
from watchlake.operators.contract import error_text, validate_contract
from watchlake.operators.dedup import latest_events
from watchlake.operators.envelopes import to_dead_letter
from watchlake.operators.landing import land_records
from watchlake.operators.parsing import invalid_events, parse_events, valid_events


def bronze(records: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    return land_records(records, ingest_ts)


def silver(bronze_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantine."""
    parsed = parse_events(bronze_rows)
    return valid_events(parsed), invalid_events(parsed)


def accumulated(
    silver_rows: DataFrame,
    history: str = "array",
    null_sessions: str = "shared",
    hot_rows: int | None = None,
    time_column: str | None = None,
) -> DataFrame:
    """Full recompute of the accumulated table.

    ``time_column`` names a timestamp to order events by in place of their text time,
    for feeds that mix offsets. Session sizes are counted before dedup: an upper bound, from one column.
    """
    return accumulate_state(
        latest_events(silver_rows, time_column),
        history=history,
        null_sessions=null_sessions,
        hot_rows=hot_rows,
        sessions_from=silver_rows,
        time_column=time_column,
    )


def dead_letters(bronze_rows: DataFrame, rules: str = "full", at: Column | None = None) -> DataFrame:
    """Contract-breaking records with everything that is wrong with each."""
    checked = validate_contract(bronze_rows, rules)
    return to_dead_letter(checked.where("size(violations) > 0"), error_text(), at=at)
