"""The quality policy: thresholds, field rules, windows, weights, rollout.

A policy is a plain driver-side object. Operators turn its values into
literals, so Catalyst can fold them and push them down.
"""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


class PolicyError(ValueError):
    """The policy file is absent, empty or holds values that cannot work."""


@dataclass(frozen=True)
class FieldRule:
    accepted_formats: tuple[str, ...] = ()
    type: str | None = None
    min: float | None = None


@dataclass(frozen=True)
class Policy:
    # payload content
    required_fields: tuple[str, ...] = ()
    field_rules: Mapping[str, FieldRule] = field(default_factory=dict)
    # batch thresholds; a threshold left at zero always fires
    null_rate_warning: float = 0.0
    null_rate_critical: float = 0.0
    late_ratio_critical: float = 0.0
    schema_rate_warning: float = 0.0
    schema_rate_critical: float = 0.0
    # circuit breaker
    halt_on: tuple[str, ...] = ()
    quarantine_on: tuple[str, ...] = ()
    failure_limit: int = 3
    # True also opens the breaker on a run of quarantined batches.
    halt_on_quarantine_run: bool = False
    # alerts
    warning_windows: int = 3
    critical_multiplier: float = 2.0
    # event-time windows
    short_window_seconds: int = 60
    baseline_window_seconds: int = 3600
    max_allowed_lag_ms: int = 60000
    stall_drop_ratio: float = 0.40
    stall_min_volume: int = 5
    # True flags a batch below the minimum volume as a stall too.
    flag_outage: bool = False
    lag_samples: int = 1000
    # anomaly score
    volume_weight: float = 0.4
    lag_weight: float = 0.3
    violation_weight: float = 0.3
    score_threshold: float = 0.7
    # drift monitors
    drift_trailing_batches: int = 10
    drift_z_limit: float = 3.0
    # intake
    batch_size: int = 100
    batch_timeout_ms: int = 5000
    rate_limit_records_per_sec: int = 0
    throttle_on_lag: int = 0
    on_decode_failure: str = "quarantine"
    # rollout and sinks
    mode: str = "enforcement"
    shadow_percentage: float = 0.0
    dedup_enabled: bool = True
    dedup_window_seconds: int = 3600
    key_fields: tuple[str, ...] = ("event_id", "batch_id")
    bootstrap_servers: str = "localhost:9092"
    input_topic: str = "raw_events"
    clean_topic: str = "clean_sink"
    error_topic: str = "error_stream"
    shadow_topic: str = "shadow_sink"
    consumer_group: str = "dqstream-v1"

    def __post_init__(self) -> None:
        for name in ("bootstrap_servers", "input_topic", "clean_topic", "error_topic"):
            if not getattr(self, name):
                raise PolicyError(f"{name} must not be empty")
        if self.batch_size < 1:
            raise PolicyError("batch_size must be at least 1")
        if self.batch_timeout_ms < 100:
            raise PolicyError("batch_timeout_ms must be at least 100")
        if self.mode not in MODES:
            raise PolicyError(f"mode must be one of {', '.join(MODES)}")
        if self.on_decode_failure not in ("quarantine", "drop"):
            raise PolicyError("on_decode_failure must be quarantine or drop")

    def but(self, **changes: Any) -> Policy:
        """A copy with some values changed."""
        return dataclasses.replace(self, **changes)

    @property
    def routes(self) -> bool:
        """Shadow and enforcement both route; a dry run only reports."""
        return self.mode != "dry_run"

    @classmethod
    def load(cls, path: str | Path, env: Mapping[str, str] | None = None) -> Policy:
        """Read a YAML (or JSON) policy file; environment values win."""
        path = Path(path)
        if not path.exists():
            raise PolicyError(f"policy file not found: {path}")
        tree = _parse(path)
        if tree is None:
            raise PolicyError(f"policy file is empty: {path}")
        values: dict[str, Any] = {}
        for where, (name, cast) in _FILE_KEYS.items():
            found = _dig(tree, where)
            if found is not None:
                values[name] = cast(found)
        for key, (name, cast) in _ENV_KEYS.items():
            found = (os.environ if env is None else env).get(key)
            if found is not None:
                values[name] = cast(found)
        return cls(**values)


# Rollout modes.
MODES = ("dry_run", "shadow", "enforcement")


def _rules(raw: Mapping[str, Any]) -> dict[str, FieldRule]:
    return {
        name: FieldRule(tuple(body.get("accepted_formats") or ()), body.get("type"), body.get("min"))
        for name, body in raw.items()
    }


def _flag(raw: Any) -> bool:
    """A truth value, also where a file has it as text."""
    if isinstance(raw, str):
        text = raw.strip().lower()
        if text not in ("true", "false"):
            raise PolicyError(f"not a truth value: {raw}")
        return text == "true"
    return bool(raw)


# Where each setting lives in the policy file.
_FILE_KEYS: dict[str, tuple[str, Any]] = {
    "validation.required_payload_fields": ("required_fields", tuple),
    "validation.field_rules": ("field_rules", _rules),
    "thresholds.null_rate.warning": ("null_rate_warning", float),
    "thresholds.null_rate.critical": ("null_rate_critical", float),
    "thresholds.late_event_ratio.critical": ("late_ratio_critical", float),
    "thresholds.schema_violation_rate.warning": ("schema_rate_warning", float),
    "thresholds.schema_violation_rate.critical": ("schema_rate_critical", float),
    "circuit_breaker.halt_on": ("halt_on", tuple),
    "circuit_breaker.quarantine_on": ("quarantine_on", tuple),
    "alerts.warning_consecutive_windows": ("warning_windows", int),
    "alerts.critical_multiplier": ("critical_multiplier", float),
    "window.short_window_seconds": ("short_window_seconds", int),
    "window.baseline_window_seconds": ("baseline_window_seconds", int),
    "window.max_allowed_lag_ms": ("max_allowed_lag_ms", int),
    "window.stall_drop_ratio": ("stall_drop_ratio", float),
    "window.stall_min_volume": ("stall_min_volume", int),
    "anomaly.volume_weight": ("volume_weight", float),
    "anomaly.lag_weight": ("lag_weight", float),
    "anomaly.violation_weight": ("violation_weight", float),
    "anomaly.score_threshold": ("score_threshold", float),
    "backpressure.rate_limit_records_per_sec": ("rate_limit_records_per_sec", int),
    "backpressure.throttle_on_lag": ("throttle_on_lag", int),
    "rollout.mode": ("mode", str),
    "rollout.shadow_topic": ("shadow_topic", str),
    "rollout.shadow_percentage": ("shadow_percentage", float),
    "idempotency.enabled": ("dedup_enabled", _flag),
    "idempotency.dedup_window_seconds": ("dedup_window_seconds", int),
    "idempotency.key_fields": ("key_fields", tuple),
}

# Environment overrides.
_ENV_KEYS: dict[str, tuple[str, Any]] = {
    "KAFKA_BOOTSTRAP_SERVERS": ("bootstrap_servers", str),
    "INPUT_TOPIC": ("input_topic", str),
    "CLEAN_TOPIC": ("clean_topic", str),
    "ERROR_TOPIC": ("error_topic", str),
    "CONSUMER_GROUP": ("consumer_group", str),
    "BATCH_SIZE": ("batch_size", int),
    "BATCH_TIMEOUT_MS": ("batch_timeout_ms", int),
}


def _parse(path: Path) -> Any:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text) if text.strip() else None
    try:
        import yaml
    except ImportError as missing:
        raise PolicyError("reading YAML needs the yaml package; use a .json file") from missing
    return yaml.safe_load(text)


def _dig(tree: Any, where: str) -> Any:
    for part in where.split("."):
        if not isinstance(tree, Mapping):
            return None
        tree = tree.get(part)
    return tree


def starter(**changes: Any) -> Policy:
    """The stock retail-event policy: user, timestamp and price are required."""
    return Policy(
        required_fields=("user_id", "timestamp", "price"),
        field_rules={
            "timestamp": FieldRule(accepted_formats=("iso8601", "epoch_millis")),
            "price": FieldRule(type="number", min=0),
        },
        null_rate_warning=0.02,
        null_rate_critical=0.05,
        late_ratio_critical=0.02,
        schema_rate_warning=0.10,
        schema_rate_critical=0.20,
        halt_on=("schema_violation_rate_critical",),
        quarantine_on=("schema_violation", "null_rate_exceeded"),
        throttle_on_lag=10000,
    ).but(**changes)
