"""The watch-event contract as one rule table and one Column per rule.

A rule yields its violation code when a document breaks it and NULL otherwise.
``json_schema`` is the structural rule set, ``full`` adds the application rules.
"""

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from watchlake.schemas import REASON_OF_EVENT, STATE_OF_EVENT


@dataclass(frozen=True)
class Field:
    kind: str
    required: bool = False
    const: str | int | None = None
    enum: tuple[str, ...] = ()
    minimum: int | None = None
    maximum: int | None = None
    non_blank: bool = False

    @property
    def nullable(self) -> bool:
        return not self.required


# The contract, one entry per property. ``non_blank`` belongs to the
# full rule set only; optional properties may be null.
CONTRACT = {
    "schema_name": Field("string", required=True, const="watch_event"),
    "schema_version": Field("integer", required=True, const=1),
    "event_id": Field("string", required=True, non_blank=True),
    "event_type": Field("string", required=True, enum=tuple(STATE_OF_EVENT)),
    "user_id": Field("string", required=True, non_blank=True),
    "session_id": Field("string", required=True, non_blank=True),
    "content_id": Field("string", required=True, non_blank=True),
    "event_time": Field("string", required=True),
    "event_version": Field("integer", required=True, minimum=1),
    "event_header_reemission": Field("integer", required=True, minimum=0),
    "playback_position": Field("integer", minimum=0),
    "device_type": Field("string", non_blank=True),
    "platform": Field("string", non_blank=True),
    "network_type": Field("string", non_blank=True),
    "pause_reason": Field("string", non_blank=True),
    "resume_reason": Field("string", non_blank=True),
    "completion_percent": Field("integer", minimum=0, maximum=100),
    "watch_duration_sec": Field("integer", minimum=0),
    "abandoned_reason": Field("string", non_blank=True),
}

RULE_SETS = ("json_schema", "full")

# A calendar date, alone or followed by a time; bare times and years are refused.
_DATE_TIME = r"^\d{4}-\d{2}-\d{2}([Tt ]|$)"


# Every property as a VARIANT: what ``from_json`` extracts for the rules.
DOCUMENT_SCHEMA = ", ".join(f"{name} VARIANT" for name in CONTRACT)


def document_kinds(document: str) -> Column:
    """Type name of every contract property of a parsed document.

    A typed ``from_json`` turns a mistyped value into NULL; a VARIANT still knows
    that the value was there and what it was. A kind is NULL for an absent
    property and ``VOID`` for a JSON null.
    """
    return F.struct(*[F.schema_of_variant(f"{document}.{name}").alias(name) for name in CONTRACT])


def document_values(document: str, kinds: str) -> Column:
    """Text or number of every contract property; NULL where the kind is another."""
    values = []
    for name, field in CONTRACT.items():
        property_, kind = F.col(f"{document}.{name}"), F.col(f"{kinds}.{name}")
        if field.kind == "string":
            value = F.when(kind == "STRING", F.try_variant_get(property_, "$", "string"))
        else:
            numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
            value = F.when(numeric, F.try_variant_get(property_, "$", "double"))
        values.append(value.alias(name))
    return F.struct(*values)


def violation_codes(kinds: str, values: str, keys: str, rules: str) -> list[Column]:
    """Violation codes, in contract order, over the kinds and values of a document.

    ``keys`` names the array of the document's own property names, which is NULL
    for anything that is not a JSON object.
    """
    if rules not in RULE_SETS:
        raise ValueError(f"rules must be one of {RULE_SETS}, not {rules!r}")
    full = rules == "full"
    is_object = F.col(keys).isNotNull()
    codes = [F.when(~is_object, F.lit("malformed"))]

    def add(code: str | Column, broken: Column) -> None:
        codes.append(F.when(is_object & broken, F.lit(code) if isinstance(code, str) else code))

    for name, field in CONTRACT.items():
        kind, value = F.col(f"{kinds}.{name}"), F.col(f"{values}.{name}")
        present = kind.isNotNull() if field.required else kind.isNotNull() & (kind != "VOID")
        if field.required:
            add(f"missing:{name}", kind.isNull())
        if field.kind == "string":
            well_typed = kind == "STRING"
        else:
            well_typed = F.coalesce(value == F.rint(value), F.lit(False))
        add(f"type:{name}", present & ~well_typed)
        if field.const is not None:
            add(f"const:{name}", present & ~value.eqNullSafe(F.lit(field.const)))
        if field.enum:
            add(f"enum:{name}", present & ~F.coalesce(value.isin(*field.enum), F.lit(False)))
        if field.minimum is not None:
            outside = value < field.minimum
            if field.maximum is not None:
                outside = outside | (value > field.maximum)
            add(f"range:{name}", outside)
        if full and field.non_blank:
            add(f"blank:{name}", value == "")

    unknown = F.array_except(F.col(keys), F.array(*[F.lit(n) for n in CONTRACT]))
    add(
        F.concat(F.lit("unknown:"), F.array_join(F.sort_array(unknown), ",")),
        F.size(unknown) > 0,
    )

    if full:
        event_type, when = F.col(f"{values}.event_type"), F.col(f"{values}.event_time")
        is_time = when.rlike(_DATE_TIME) & F.try_to_timestamp(when).isNotNull()
        add("format:event_time", when.isNotNull() & ~is_time)
        for kind, reason in REASON_OF_EVENT.items():
            absent = F.coalesce(F.col(f"{kinds}.{reason}"), F.lit("VOID")) == "VOID"
            add(f"requires:{reason}", (event_type == kind) & absent)
        percent = F.coalesce(F.col(f"{kinds}.completion_percent"), F.lit("VOID"))
        completed = event_type == "completed"
        add("requires:completion_percent", completed & (percent == "VOID"))
        add("incomplete:completion_percent", completed & (F.col(f"{values}.completion_percent") != 100))
    return codes
