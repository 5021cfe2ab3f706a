"""Keeping costly expressions from being copied by the optimizer."""

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that later filters and projections read but must not compute again.

    A filter moves below a projection by copying the projected expressions into
    itself, which for JSON parsing means one parse per predicate. The output of a
    generator is not copied, so the columns come from a one-row ``inline``; it
    stays inside the generated code and needs no shuffle.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))
