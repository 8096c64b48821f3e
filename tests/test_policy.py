from __future__ import annotations

import json

import pytest

from dqstream.policy import Policy, PolicyError, starter

TEXT = """
validation:
  required_payload_fields: [user_id, price]
  field_rules:
    price: {type: number, min: 1}
thresholds:
  null_rate: {warning: 0.1, critical: 0.2}
window:
  stall_drop_ratio: 0.6
anomaly:
  score_threshold: 0.8
rollout:
  mode: shadow
  shadow_percentage: 0.25
"""


def test_file_values_defaults_and_environment(tmp_path):
    path = tmp_path / "policy.yaml"
    path.write_text(TEXT)
    p = Policy.load(path, env={"CLEAN_TOPIC": "good", "BATCH_SIZE": "7"})
    assert p.required_fields == ("user_id", "price")
    assert p.field_rules["price"].type == "number" and p.field_rules["price"].min == 1
    assert (p.null_rate_warning, p.null_rate_critical) == (0.1, 0.2)
    assert p.stall_drop_ratio == 0.6 and p.score_threshold == 0.8
    assert p.mode == "shadow" and p.routes and p.shadow_percentage == 0.25
    assert p.clean_topic == "good" and p.batch_size == 7
    assert p.short_window_seconds == 60 and p.schema_rate_critical == 0.0


def test_json_file(tmp_path):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({"alerts": {"warning_consecutive_windows": 5}}))
    assert Policy.load(path, env={}).warning_windows == 5


def test_absent_and_empty_files_are_refused(tmp_path):
    with pytest.raises(PolicyError):
        Policy.load(tmp_path / "none.yaml")
    empty = tmp_path / "empty.yaml"
    empty.write_text("")
    with pytest.raises(PolicyError):
        Policy.load(empty)


@pytest.mark.parametrize(
    "change",
    [
        {"bootstrap_servers": ""},
        {"input_topic": ""},
        {"clean_topic": ""},
        {"error_topic": ""},
        {"batch_size": 0},
        {"batch_timeout_ms": 99},
        {"mode": "later"},
        {"on_decode_failure": "ignore"},
    ],
)
def test_values_that_cannot_work_are_refused(change):
    with pytest.raises(PolicyError):
        starter(**change)


def test_dry_run_does_not_route():
    assert not starter(mode="dry_run").routes


def test_a_truth_value_given_as_text(tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"idempotency": {"enabled": "false"}}')
    assert Policy.load(path, {}).dedup_enabled is False
