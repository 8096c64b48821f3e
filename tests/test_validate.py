from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from dqstream.contract import ENVELOPE, ENVELOPE_AVRO, REQUIRED_ENVELOPE
from dqstream.functions import payload as pay
from dqstream.functions.timefmt import is_epoch_millis, is_iso8601
from dqstream.operators import validate as va
from dqstream.policy import FieldRule, starter
from dqstream.sources.readers import topic_options, trigger_limit

OK = {"user_id": "u", "timestamp": "2024-01-15T10:30:00Z", "price": 29.99}
MISSING, INVALID = "missing_required_field", "invalid_field_value"


def payload(**changes):
    return json.dumps({k: v for k, v in {**OK, **changes}.items() if v != "ABSENT"})


CASES = [
    (payload(), []),
    (payload(user_id="ABSENT"), [MISSING]),
    (payload(user_id=None), [MISSING]),
    (payload(price=-5), [INVALID]),
    (payload(price=0), []),
    (payload(price="free"), [INVALID]),
    (payload(price="12"), [INVALID]),
    (payload(price=True), []),
    (payload(price=False), []),
    (payload(price=[1]), [INVALID]),
    (payload(price=10**30), []),
    (payload(timestamp="1705314600000"), []),
    (payload(timestamp=1705314600000), []),
    (payload(timestamp={"a": 1}), []),
    (payload(timestamp="yesterday"), [INVALID]),
    (payload(timestamp=""), [INVALID]),
    (payload(user_id="ABSENT", price=-1, timestamp="x"), [MISSING, INVALID, INVALID]),
    ("not valid json", [INVALID, MISSING]),
    ("", [INVALID, MISSING]),
    ("[]", [MISSING] * 3),
    ("null", [MISSING] * 3),
    ("{}", [MISSING] * 3),
    (payload() + " x", [INVALID, MISSING]),
    (payload() + "]", [INVALID, MISSING]),
    ('{"user_id": null, "user_id": "u", "timestamp": "2024-01-15", "price": 1}', []),
    (payload(extra={"deep": [1, {"x": None}]}), []),
]


def test_payload_cases(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, payload_json string")
    got = {r["i"]: list(r["violations"]) for r in va.payload_violations(df, starter()).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_unknown_format_never_matches_and_unruled_fields_are_free(spark):
    p = starter(
        required_fields=("a", "b"),
        field_rules={"a": FieldRule(accepted_formats=("rfc9999",)), "c": FieldRule(type="number")},
    )
    df = spark.createDataFrame([('{"a": "2024-01-01", "b": 1, "c": "x"}',)], "payload_json string")
    assert va.payload_violations(df, p).first()["violations"] == [INVALID]


def test_boolean_counts_as_one_or_zero_for_the_minimum(spark):
    p = starter(required_fields=("a",), field_rules={"a": FieldRule(min=1)})
    df = spark.createDataFrame([('{"a": true}',), ('{"a": false}',), ('{"a": "0"}',)], "payload_json string")
    assert [r["violations"] for r in va.payload_violations(df, p).collect()] == [[], [INVALID], []]


def _spoil(rng, text, letters):
    chars = list(text)
    for _ in range(rng.randint(1, 3)):
        at = rng.randint(0, len(chars))
        move = rng.random()
        if move < 0.4:
            chars.insert(at, rng.choice(letters))
        elif chars and move < 0.8:
            chars.pop(min(at, len(chars) - 1))
        elif chars:
            chars[min(at, len(chars) - 1)] = rng.choice(letters)
    return "".join(chars)


def _is_json(text):
    try:
        json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
        return True
    except ValueError:
        return False


def test_strict_json_agrees_with_the_standard_parser(spark):
    rng = random.Random(5)
    seeds = ['{"p": 1}', "[1, 2]", "null", '"a"', "true", '{"a": {"b": [1, {"c": null}]}}', "1.5e3", "{}", "[]", " 1 "]
    texts = sorted({_spoil(rng, s, '[]{}",:01 trfn\\e.-+') for s in seeds for _ in range(200)} | set(seeds))
    df = spark.createDataFrame([(t, _is_json(t)) for t in texts], "t string, want boolean")
    got = df.withColumn("w", pay.strict_variant(F.col("t"))).withColumn("got", pay.is_strict(F.col("w"), F.col("t")))
    assert [r["t"] for r in got.filter("want <> got").collect()] == []


def _iso(text):
    try:
        datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
        return True
    except ValueError:
        return False


def _epoch(text):
    try:
        datetime.datetime.fromtimestamp(int(text) / 1000, tz=datetime.UTC)
        return True
    except (ValueError, OSError, OverflowError):
        return False


def test_iso_and_epoch_accept_nothing_false(spark):
    rng = random.Random(6)
    seeds = [
        "2024-01-15", "20240115", "2024-W03-1", "2024W031", "2024-W03", "2020-W53-7", "2021-W53", "2024-01-15T10:30:00Z",
        "2024-01-15 10", "20240115T103000.123+0530", "2024-02-29", "2023-02-29", "0000-01-01", "0001-01-01",
        "9999-12-31T23:59:59", "2024-01-15T24:00", "2024-W01-12", "1705314600000", " 170531 ", "1_000", "+5",
        "-62135596800000", "-62135596800001", "253402300799999", "253402300800000", "2024", "12:30", "2024-1-5",
    ]
    texts = sorted({_spoil(rng, s, "0123456789-:TZW+., _") for s in seeds for _ in range(60)} | set(seeds))
    df = spark.createDataFrame([(t, _iso(t), _epoch(t)) for t in texts], "t string, iso boolean, epoch boolean")
    got = df.select("*", is_iso8601(F.col("t")).alias("i"), is_epoch_millis(F.col("t")).alias("e")).collect()
    assert [r["t"] for r in got if (r["i"] and not r["iso"]) or r["epoch"] != r["e"]] == []
    # Rejected though the standard parser takes it: odd fractions and offsets only.
    assert sum(r["iso"] and not r["i"] for r in got) < 0.02 * len(got)
    plain = {r["t"]: r["i"] for r in got}
    assert all(plain[s] == _iso(s) for s in seeds)


def envelope(**changes):
    row = {
        "event_id": "e1", "event_type": "t", "event_version": 1, "producer": "p", "occurred_at": 1705314600000,
        "partition_key": "k", "payload_json": payload(), "trace_id": None, "headers": None,
    }
    row.update(changes)
    return row


def test_structure_each_required_field(spark):
    rows = [envelope(event_id=f"e-{f}", **({f: None} if f != "event_id" else {})) for f in REQUIRED_ENVELOPE]
    rows[0]["event_id"] = None
    rows.append(envelope(event_id="fine", trace_id=None))
    checked = va.validate_events(spark.createDataFrame(rows, ENVELOPE), starter()).collect()
    assert [r["violations"] for r in checked[:-1]] == [["schema_violation"]] * len(REQUIRED_ENVELOPE)
    assert checked[-1]["is_valid"]
    dropped = va.validate_events(spark.createDataFrame(rows, ENVELOPE), starter(on_decode_failure="drop"))
    assert dropped.count() == 1


def test_encode_then_decode_gives_the_same_envelope(spark):
    rows = [envelope(), envelope(event_id="e2", trace_id="t", headers={"a": "b"}, payload_json='{"q": "\\"x\\""}')]
    df = spark.createDataFrame(rows, ENVELOPE)
    back = va.decode_envelopes(va.encode_envelopes(df).select("value")).drop("raw_value")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    broken = spark.createDataFrame([(bytearray(b"\x00\x01"),), (None,)], "value binary")
    assert va.decode_envelopes(va.drop_tombstones(broken)).first()["event_id"] is None
    with pytest.raises(ValueError):
        va.decode_envelopes(broken, fmt="xml")


def test_contract_forms_agree():
    fields = json.loads(ENVELOPE_AVRO)["fields"]
    assert [f["name"] for f in fields] == ENVELOPE.fieldNames()
    assert [f["name"] for f in fields if "default" not in f] == REQUIRED_ENVELOPE


def test_topic_options_and_trigger_limit():
    p = starter(rate_limit_records_per_sec=10, batch_timeout_ms=5000, batch_size=40)
    assert topic_options(p)["startingOffsets"] == "earliest" and topic_options(p)["subscribe"] == "raw_events"
    assert (trigger_limit(p, False), trigger_limit(p, True)) == (50, 40)
    assert (trigger_limit(starter(), False), trigger_limit(starter(), True)) == (None, 100)


def test_occurred_at_kinds(spark):
    times = spark.sql("SELECT timestamp'2024-01-15 10:30:00.123456' AS occurred_at")
    assert va.normalize_occurred_at(times).first()[0] == 1705314600123
    texts = spark.createDataFrame([("17",), ("x",), ("1.5",), (None,)], "occurred_at string")
    assert [r[0] for r in va.normalize_occurred_at(texts).collect()] == [17, None, None, None]
    floats = spark.createDataFrame([(1.5,)], "occurred_at double")
    assert va.normalize_occurred_at(floats).first()[0] is None


def test_json_is_parsed_once_even_under_a_filter(spark, sf_dir):
    from dqstream.sources import fixtures as fx

    plan = va.validate_events(fx.envelopes(spark, sf_dir), starter()).filter("is_valid")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson") == 1 and "Python" not in text
