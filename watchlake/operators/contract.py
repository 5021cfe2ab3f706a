"""Contract validation over raw JSON text."""

from pyspark.sql import Column, DataFrame, functions as F

from watchlake.functions.barrier import computed_once
from watchlake.functions.contract import (
    DOCUMENT_SCHEMA,
    document_kinds,
    document_values,
    violation_codes,
)

# Rules of a step. The JVM interprets a method of over 8,000 bytes for good; a step is one, and a rule takes some 165.
_COMPILED = 20


def validate_contract(rows: DataFrame, rules: str = "full", text: str = "raw_value") -> DataFrame:
    """Add ``violations ARRAY<STRING>``; a row is valid when the array is empty."""
    parsed = computed_once(
        rows,
        F.from_json(text, DOCUMENT_SCHEMA).alias("_document"),
        F.json_object_keys(text).alias("_keys"),
    )
    typed = computed_once(parsed, document_kinds("_document").alias("_kinds"))
    facts = computed_once(typed, document_values("_document", "_kinds").alias("_values"))
    codes = violation_codes("_kinds", "_values", "_keys", rules)
    groups = {f"_codes_{i}": codes[i : i + _COMPILED] for i in range(0, len(codes), _COMPILED)}
    for name, group in groups.items():
        facts = computed_once(facts, F.array(*group).alias(name))
    # Codes differ, so taking out NULL is all that ARRAY_EXCEPT does. Unlike ARRAY_COMPACT, which runs a lambda, it is compiled.
    violations = F.array_except(F.concat(*groups), F.array(F.lit(None).cast("string")))
    return computed_once(facts, violations.alias("violations")).drop(
        "_document", "_keys", "_kinds", "_values", *groups
    )


def error_text(violations: str = "violations") -> Column:
    """The violations as one line, for a dead letter."""
    return F.array_join(violations, "; ")
