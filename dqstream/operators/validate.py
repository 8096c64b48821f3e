"""Record-level checks: decode, envelope structure, payload content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqstream.contract import ENVELOPE, ENVELOPE_AVRO, INVALID_VALUE, MISSING_FIELD, REQUIRED_ENVELOPE, SCHEMA_VIOLATION
from dqstream.functions import payload as pay
from dqstream.policy import Policy
from dqstream.session import check_configured


def drop_tombstones(raw: DataFrame) -> DataFrame:
    """Leave out records without a value."""
    return raw.filter(F.col("value").isNotNull())


def decode_envelopes(raw: DataFrame, col: str = "value", fmt: str = "json") -> DataFrame:
    """Turn an encoded envelope into its nine columns.

    A value that cannot be decoded gives null fields, which the structural
    check then reports, and is kept as `raw_value`. JSON must be exactly one
    object with nothing after it. `avro` reads schemaless binary and needs the
    spark-avro package on the classpath.
    """
    if fmt == "json":
        text = F.col(col).cast("string")
        wrapped = pay.strict_variant(text)
        whole = pay.is_strict(wrapped, text) & F.try_variant_get(wrapped, "$[0]", "variant").isNotNull()
        is_object = F.ltrim(text, F.lit(" \t\n\r")).startswith("{")
        decoded = F.when(whole & is_object, F.from_json(text, ENVELOPE))
    elif fmt == "avro":
        from pyspark.sql.avro.functions import from_avro

        decoded = from_avro(F.col(col), ENVELOPE_AVRO, {"mode": "PERMISSIVE"})
    else:
        raise ValueError(f"unknown envelope format: {fmt}")
    kept = [c for c in raw.columns if c not in (col, "raw_value") and c not in ENVELOPE.fieldNames()]
    opened = raw.select(*kept, F.col(col).cast("string").alias("__raw"), decoded.alias("__e"))
    undecoded = F.when(F.col("__e").isNull(), F.col("__raw")).alias("raw_value")
    return opened.select(*kept, *[F.col(f"__e.{f}").alias(f) for f in ENVELOPE.fieldNames()], undecoded)


def encode_envelopes(df: DataFrame, fmt: str = "json") -> DataFrame:
    """Add `value`, the encoded envelope. Null fields are left out of JSON."""
    whole = F.struct(*[F.col(f) for f in ENVELOPE.fieldNames()])
    if fmt == "json":
        return df.withColumn("value", F.to_json(whole))
    if fmt == "avro":
        from pyspark.sql.avro.functions import to_avro

        return df.withColumn("value", to_avro(whole, ENVELOPE_AVRO))
    raise ValueError(f"unknown envelope format: {fmt}")


def normalize_occurred_at(df: DataFrame, col: str = "occurred_at") -> DataFrame:
    """Event time as epoch milliseconds; what is neither time nor integer is null."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        ms: Column = F.unix_millis(F.col(col).cast("timestamp"))
    elif isinstance(kind, T.IntegralType):
        ms = F.col(col).cast("bigint")
    elif isinstance(kind, T.StringType):
        ms = F.when(F.col(col).rlike(r"\A[+-]?\d+\z"), F.col(col).try_cast("bigint"))
    else:
        ms = F.lit(None).cast("bigint")
    return df.withColumn(col, ms)


def structural_failure(columns: list[str]) -> Column:
    """True when a required envelope field is absent or null."""
    bad = F.lit(False)
    for name in REQUIRED_ENVELOPE:
        bad = bad | (F.col(name).isNull() if name in columns else F.lit(True))
    return bad


def check_structure(df: DataFrame) -> DataFrame:
    """Add `schema_violation`: the envelope lacks a required field."""
    return df.withColumn("schema_violation", structural_failure(df.columns))


def _fenced(df: DataFrame, made: dict[str, Column], keep: list[str]) -> DataFrame:
    """Let computed columns leave through a generator.

    A filter on them then stays above it. Without this it would be pushed
    below and the whole computation, JSON parse included, done twice.
    """
    row = F.struct(*[c.alias(n) for n, c in made.items()])
    return df.select(*[c for c in keep if c not in made], F.inline(F.array(row)))


def _read(df: DataFrame, p: Policy, parse: Column) -> tuple[DataFrame, list[Column]]:
    """Parse each payload once and read each required field once.

    Gives the rows with `__strict`, the fields and their types, and one reason
    code column per required field. Each step is a projection of its own: what
    a later one uses more than once is not computed more than once.
    """
    check_configured(df.sparkSession)
    wrapped, fields = F.col("__json"), range(len(p.required_fields))
    parsed = df.withColumn("__json", parse)
    read = parsed.select(
        *df.columns,
        pay.is_strict(wrapped, F.col("payload_json")).alias("__strict"),
        *[pay.field(wrapped, name).alias(f"__v{i}") for i, name in enumerate(p.required_fields)],
    )
    typed = read.select("*", *[pay.type_name(F.col(f"__v{i}")).alias(f"__k{i}") for i in fields])
    verdicts = [
        pay.rule_column(F.col(f"__v{i}"), F.col(f"__k{i}"), p.field_rules.get(name))
        for i, name in enumerate(p.required_fields)
    ]
    return typed, verdicts


def _judge(df: DataFrame, p: Policy, broken: Column | None) -> DataFrame:
    """Add `violations`."""
    parse = pay.strict_variant(F.col("payload_json"))
    # The parse is skipped where the structure already fails.
    read, verdicts = _read(df, p, parse if broken is None else F.when(~broken, parse))
    unreadable = F.array(F.lit(INVALID_VALUE), F.lit(MISSING_FIELD))
    found = F.when(F.col("__strict"), pay.list_of(verdicts)).otherwise(unreadable)
    if broken is not None:
        found = F.when(broken, F.array(F.lit(SCHEMA_VIOLATION))).otherwise(found)
    return _fenced(read, {"violations": found}, df.columns)


def field_codes(df: DataFrame, p: Policy) -> DataFrame:
    """Add `is_json` and, per required field, its JSON type and reason code.

    Types read as the variant type names; an absent field has no type.
    """
    read, verdicts = _read(df, p, pay.strict_variant(F.col("payload_json")))
    made = {"is_json": F.col("__strict")}
    for i, (name, verdict) in enumerate(zip(p.required_fields, verdicts)):
        made[f"{name}_kind"] = F.when(F.col("__strict"), F.col(f"__k{i}"))
        made[f"{name}_code"] = F.when(F.col("__strict"), verdict)
    return _fenced(read, made, df.columns)


def payload_violations(df: DataFrame, p: Policy) -> DataFrame:
    """Add `violations`, the reason codes of the payload in field order."""
    return _judge(df, p, None)


def validate_events(df: DataFrame, p: Policy) -> DataFrame:
    """Add `violations` and `is_valid`.

    A structural failure carries its own code alone and its payload is not
    looked at; policy `on_decode_failure='drop'` leaves such records out.
    """
    broken = structural_failure(df.columns)
    if p.on_decode_failure == "drop":
        df = df.filter(~broken)
    return _judge(df, p, broken).withColumn("is_valid", F.size("violations") == 0)
