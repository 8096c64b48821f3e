"""JSON payload tests as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqstream.contract import INVALID_VALUE, MISSING_FIELD
from dqstream.functions.timefmt import format_column
from dqstream.policy import FieldRule


def strict_variant(text: Column) -> Column:
    """Parse `[text, hash(text)]`; null when that is no JSON array.

    The parser stops after the first value and ignores what follows it. With
    the hash as second element, text that closes the array early, or holds
    more than one value, leaves a wrong second or a third element, see
    `is_strict`. One parse serves the test and every later field access.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), _seal(text).cast("string"), F.lit("]")))


def is_strict(wrapped: Column, text: Column) -> Column:
    """True when `text` is exactly one JSON value."""
    second = F.try_variant_get(wrapped, "$[1]", "bigint")
    third = F.try_variant_get(wrapped, "$[2]", "variant")
    return F.coalesce((second == _seal(text)) & third.isNull(), F.lit(False))


def field(wrapped: Column, name: str) -> Column:
    """A top-level payload field as a variant; null when absent."""
    return F.try_variant_get(wrapped, f"$[0]{_member(name)}", "variant")


def type_name(value: Column) -> Column:
    """Null for an absent field, `VOID` for JSON null."""
    return F.schema_of_variant(value)


def absent(kind: Column) -> Column:
    """Absent and JSON null count the same."""
    return kind.isNull() | (kind == "VOID")


def is_number_like(kind: Column) -> Column:
    """Numbers and booleans; numeric strings are not numbers."""
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")


def as_number(value: Column, kind: Column) -> Column:
    """The numeric value; a boolean reads 1 or 0."""
    flag = F.try_variant_get(value, "$", "boolean").cast("double")
    return F.when(kind == "BOOLEAN", flag).when(is_number_like(kind), F.try_variant_get(value, "$", "double"))


def rule_column(value: Column, kind: Column, rule: FieldRule | None) -> Column:
    """Reason code of a field, null when it is fine.

    A missing field is only missing. Otherwise type, minimum and formats are
    tested in this order and the first failure counts, so there is at most one
    code per field.
    """
    verdict = F.when(absent(kind), F.lit(MISSING_FIELD))
    if rule is None:
        return verdict
    if rule.type == "number":
        verdict = verdict.when(~is_number_like(kind), F.lit(INVALID_VALUE))
    if rule.min is not None:
        # Null, and so no failure, for what is no number.
        verdict = verdict.when(as_number(value, kind) < F.lit(float(rule.min)), F.lit(INVALID_VALUE))
    if rule.accepted_formats:
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        verdict = verdict.when(text.isNotNull() & ~format_column(text, rule.accepted_formats), F.lit(INVALID_VALUE))
    return verdict


def list_of(parts: Sequence[Column]) -> Column:
    """The non-null parts, in order, duplicates kept."""
    none = F.array().cast("array<string>")
    # `array_compact` would run a lambda outside generated code.
    return F.concat(none, *[F.when(c.isNull(), none).otherwise(F.array(c)) for c in parts])


def _seal(text: Column) -> Column:
    return F.xxhash64(text)


def _member(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"field name cannot hold quotes or backslashes: {name!r}")
    return f"['{name}']"
