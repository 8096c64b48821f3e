"""The same queries as plain SQL over the raw tables.

Written from the meaning of each operator, not from the Spark plans: volumes
compare every event with every batch, samples are joined row by row, the dedup
chain is a recursion.
"""

from __future__ import annotations

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
_SQL: dict[str, str] = {}


def part(name: str, needs: str, sql: str) -> None:
    _PARTS[name] = (tuple(needs.split()), sql)


def check(name: str, needs: str, sql: str) -> None:
    wanted: list[str] = []

    def visit(n: str) -> None:
        for below in _PARTS[n][0]:
            visit(below)
        if n not in wanted:
            wanted.append(n)

    for n in needs.split():
        visit(n)
    recursive = "RECURSIVE " if any("/*recursive*/" in _PARTS[n][1] for n in wanted) else ""
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" if "/*recursive*/" not in _PARTS[n][1] else f"{n} AS ({_PARTS[n][1]})" for n in wanted)
    _SQL[name] = (f"WITH {recursive}{parts}\n" if parts else "") + sql


def all_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- fixtures --------------------------------------------------------------

_MS = "(epoch_us(ts) // 1000)"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"

part(
    "env",
    "",
    f"""SELECT 'main' AS feed, event_id AS seq, event_id // 100 AS batch_id,
  concat('evt-', lpad(CAST(event_id AS VARCHAR), 9, '0')) AS event_id,
  CASE WHEN event_id % 100 = 89 OR ((event_id // 100) % 20 IN (6, 7, 8) AND event_id % 4 = 0)
       THEN NULL ELSE event_type END AS event_type,
  1 AS event_version,
  concat('svc-', CAST(user_id % 4 AS VARCHAR)) AS producer,
  {_MS} AS occurred_at,
  {_MS} + CASE WHEN (event_id // 100) % 12 IN (4, 5, 6, 7) AND event_id % 5 = 0 THEN 120000
               WHEN event_id % 17 = 0 THEN -500
               ELSE (event_id * 37) % 5000 END AS received_at,
  concat('usr_', CAST(user_id AS VARCHAR)) AS partition_key,
  CASE event_id % 100
    WHEN 7 THEN 'not valid json'
    WHEN 81 THEN '[]'
    WHEN 13 THEN concat('{{"timestamp": "', {_ISO}, '", "price": ', CAST(value AS VARCHAR), '}}')
    ELSE concat('{{"user_id": ',
      CASE event_id % 100 WHEN 21 THEN 'null' ELSE concat('"usr_', CAST(user_id AS VARCHAR), '"') END,
      ', "timestamp": ',
      CASE event_id % 100 WHEN 55 THEN '"yesterday"'
        WHEN 63 THEN concat('"', CAST({_MS} AS VARCHAR), '"')
        WHEN 71 THEN CAST({_MS} AS VARCHAR)
        ELSE concat('"', {_ISO}, '"') END,
      ', "price": ',
      CASE event_id % 100 WHEN 34 THEN '-5' WHEN 42 THEN '"free"' WHEN 77 THEN 'true'
        ELSE CAST(value AS VARCHAR) END, '}}')
  END AS payload_json,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('trace-', CAST(event_id AS VARCHAR)) END AS trace_id
FROM events""",
)
part(
    "thin",
    "env",
    """SELECT * EXCLUDE early REPLACE (occurred_at - early AS occurred_at, received_at - early AS received_at)
FROM (SELECT *, CASE WHEN day(make_timestamp(occurred_at * 1000)) BETWEEN 10 AND 12 AND seq % 5 <> 0
  THEN 259200000 ELSE 0 END AS early FROM env)""",
)
part("thin_small", "thin", "SELECT * REPLACE (seq // 10 AS batch_id) FROM thin")
part("thin_timed", "thin", "SELECT * REPLACE (received_at // 21600000 AS batch_id) FROM thin")
part("small", "env", "SELECT * REPLACE (seq // 10 AS batch_id) FROM env")
part("timed", "env", "SELECT * REPLACE (received_at // 21600000 AS batch_id) FROM env")
part(
    "drifted",
    "env",
    """SELECT * REPLACE (CASE WHEN batch_id % 10 IN (5, 6) THEN replace(payload_json, '"user_id"', '"uuid"')
  WHEN batch_id % 10 = 8 THEN regexp_replace(payload_json, '"price": ([0-9.]+)\\}', '"price": \\1e2}')
  ELSE payload_json END AS payload_json) FROM env""",
)
part(
    "widened",
    "env",
    """SELECT * REPLACE (CASE WHEN batch_id % 10 <> 8 THEN payload_json
  WHEN seq % 2 = 0 THEN regexp_replace(payload_json, '"price": ([0-9.]+)\\}', '"price": \\1e1}')
  ELSE regexp_replace(payload_json, '"price": ([0-9.]+)\\}', '"price": \\1e-1}') END AS payload_json) FROM env""",
)
part(
    "copies",
    "env",
    """SELECT * EXCLUDE (shift) REPLACE (received_at + shift AS received_at), shift // 600000 AS copy
FROM (SELECT *, 0 AS shift FROM env
  UNION ALL SELECT *, 600000 FROM env WHERE seq % 50 = 0
  UNION ALL SELECT *, 7200000 FROM env WHERE seq % 75 = 0)""",
)


def _json_pairs() -> str:
    pairs = []
    for name in (
        "event_id",
        "event_type",
        "event_version",
        "producer",
        "occurred_at",
        "partition_key",
        "payload_json",
        "trace_id",
    ):
        pairs.append(f"""CASE WHEN {name} IS NULL THEN NULL ELSE '"{name}":' || CAST(to_json({name}) AS VARCHAR) END""")
    return f"'{{' || concat_ws(',', {', '.join(pairs)}) || '}}'"


part("encoded", "env", f"SELECT *, {_json_pairs()} AS value FROM env")
part(
    "transport",
    "encoded",
    """SELECT * EXCLUDE (value), 'raw_events' AS topic, CAST(user_no % 3 AS INTEGER) AS partition,
  row_number() OVER (PARTITION BY user_no % 3 ORDER BY seq) - 1 AS "offset",
  partition_key AS key, CASE WHEN seq % 97 = 0 THEN NULL ELSE value END AS value
FROM (SELECT *, CAST(substr(partition_key, 5) AS BIGINT) AS user_no FROM encoded)""",
)
part(
    "lagging",
    "transport",
    """SELECT topic, CAST(sum(greatest(high - coalesce(committed, 0), 0)) AS BIGINT) AS consumer_lag
FROM (SELECT topic, partition, max("offset") + 1 AS high,
        CASE WHEN partition <> 2 THEN max("offset") + 1 - 10 * partition END AS committed
      FROM transport GROUP BY topic, partition) GROUP BY topic""",
)

# ---- record checks ---------------------------------------------------------

_ISO_SHAPE = "[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?(Z|[+-][0-9]{2}:[0-9]{2})?)?"


def _iso(t: str) -> str:
    return f"coalesce(regexp_full_match({t}, '{_ISO_SHAPE}') AND try_cast(substr({t}, 1, 10) AS DATE) IS NOT NULL, false)"


def _epoch(t: str) -> str:
    return (
        f"coalesce(regexp_full_match(trim({t}), '[+-]?[0-9]+') AND "
        f"try_cast(ltrim(trim({t}), '+') AS HUGEINT) BETWEEN -62135596800000 AND 253402300799999, false)"
    )


def _fields(source: str) -> str:
    return f"""SELECT *,
  CASE WHEN user_kind IS NULL OR user_kind = 'NULL' THEN 'missing_required_field' END AS user_code,
  CASE WHEN time_kind IS NULL OR time_kind = 'NULL' THEN 'missing_required_field'
       WHEN time_kind = 'VARCHAR' AND NOT {_iso('time_text')} AND NOT {_epoch('time_text')}
       THEN 'invalid_field_value' END AS time_code,
  CASE WHEN price_kind IS NULL OR price_kind = 'NULL' THEN 'missing_required_field'
       WHEN price_kind IN ('VARCHAR', 'OBJECT', 'ARRAY') THEN 'invalid_field_value'
       WHEN price_kind <> 'BOOLEAN' AND price < 0 THEN 'invalid_field_value' END AS price_code
FROM (SELECT *, json_type(j, '$.user_id') AS user_kind, json_type(j, '$.timestamp') AS time_kind,
        json_type(j, '$.price') AS price_kind, json_extract_string(j, '$.timestamp') AS time_text,
        try_cast(json_extract_string(j, '$.price') AS DOUBLE) AS price
      FROM (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM {source}))"""


_STRUCTURE = " OR ".join(
    f"{c} IS NULL"
    for c in ("event_id", "event_type", "event_version", "producer", "occurred_at", "partition_key", "payload_json")
)
_LIST = """CASE WHEN j IS NULL THEN ['invalid_field_value', 'missing_required_field']
  ELSE list_filter([user_code, time_code, price_code], lambda x: x IS NOT NULL) END"""


def _judged(fields: str) -> str:
    return f"""SELECT *, len(violations) = 0 AS is_valid FROM (
  SELECT *, {_LIST} AS content, CASE WHEN {_STRUCTURE} THEN ['schema_violation'] ELSE {_LIST} END AS violations
  FROM {fields})"""


for _name in ("env", "thin", "small", "thin_small", "copies"):
    part(f"{_name}_fields", _name, _fields(_name))
    part(f"{_name}_checked", f"{_name}_fields", _judged(f"{_name}_fields"))


def _of(code: str) -> str:
    return f"CAST(sum(len(list_filter(violations, lambda x: x = '{code}'))) AS BIGINT)"


def _report(source: str, null_critical: float) -> str:
    return f"""SELECT *,
  null_rate >= 0.02 AS null_rate_warning, null_rate >= {null_critical} AS null_rate_critical,
  schema_violation_rate >= 0.1 AS schema_rate_warning, schema_violation_rate >= 0.2 AS schema_rate_critical
FROM (SELECT *, total_records - passed AS quarantined,
        missing_required_fields / (total_records * 3) AS null_rate,
        schema_violations / total_records AS schema_violation_rate
      FROM (SELECT feed, batch_id, count(*) AS total_records, count(*) FILTER (is_valid) AS passed,
              {_of('missing_required_field')} AS missing_required_fields,
              {_of('invalid_field_value')} AS invalid_field_values,
              count(*) FILTER (list_contains(violations, 'schema_violation')) AS schema_violations,
              min(received_at) AS started_at, max(received_at) AS completed_at,
              CAST(max(received_at) - min(received_at) AS DOUBLE) AS latency_ms
            FROM {source} GROUP BY feed, batch_id))"""


part("report", "env_checked", _report("env_checked", 0.05))
for _name in ("small", "thin_small"):
    part(f"{_name}_report", f"{_name}_checked", _report(f"{_name}_checked", 0.03))

# ---- breaker ---------------------------------------------------------------

part(
    "resets",
    "",
    "SELECT DISTINCT 'main' AS feed, event_id // 10 AS batch_id FROM events WHERE (event_id // 10) % 200 = 150",
)

def _latched(classed: str, epoch: str) -> str:
    return f"""SELECT *, coalesce(max(opens) OVER (PARTITION BY {epoch} ORDER BY batch_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was_open
FROM (SELECT *, CASE WHEN batch_class = 'halt' AND failure_streak >= 3 THEN 1 ELSE 0 END AS opens
  FROM (SELECT *, count(*) FILTER (batch_class <> 'pass') OVER (PARTITION BY {epoch}, island ORDER BY batch_id)
          AS failure_streak
        FROM (SELECT *, count(*) FILTER (batch_class = 'pass') OVER (PARTITION BY {epoch} ORDER BY batch_id) AS island
              FROM {classed})))"""


for _pre, _name in (("", "small"), ("thin_", "thin_small")):
    part(
        f"{_pre}classed",
        f"{_name}_report resets",
        f"""SELECT *, CASE WHEN schema_rate_critical THEN 'halt'
    WHEN quarantined > 0 OR null_rate_warning OR schema_rate_warning THEN 'quarantine' ELSE 'pass' END AS batch_class,
  (SELECT count(*) FROM resets r WHERE r.batch_id <= s.batch_id) AS epoch
FROM {_name}_report s""",
    )
    part(f"{_pre}latched", f"{_pre}classed", _latched(f"{_pre}classed", "feed"))
    part(f"{_pre}latched_reset", f"{_pre}classed", _latched(f"{_pre}classed", "epoch"))
    part(
        f"{_pre}outcomes",
        f"{_pre}latched_reset",
        f"""SELECT *, CASE WHEN was_open THEN 'halt' ELSE batch_class END AS outcome,
  was_open OR opens = 1 AS breaker_open FROM {_pre}latched_reset""",
    )
part("routed", "small_checked outcomes", "SELECT s.*, o.outcome FROM small_checked s JOIN outcomes o USING (feed, batch_id)")

# ---- monitors --------------------------------------------------------------

_LAG = "greatest(received_at - occurred_at, 0)"


def _lag_totals(source: str) -> str:
    return f"""SELECT *, late_event_count / total_event_count AS late_ratio, late_count / event_count AS batch_late_ratio
FROM (SELECT *, CAST(sum(event_count) OVER w AS BIGINT) AS total_event_count,
        CAST(sum(late_count) OVER w AS BIGINT) AS late_event_count, max(batch_max_lag_ms) OVER w AS max_seen_lag_ms
      FROM (SELECT feed, batch_id, count(*) AS event_count, count(*) FILTER ({_LAG} > 60000) AS late_count,
              max({_LAG}) AS batch_max_lag_ms FROM {source} GROUP BY feed, batch_id)
      WINDOW w AS (ORDER BY batch_id))"""


def _p95(source: str) -> str:
    return f"""SELECT feed, batch_id, len(l) AS sample_count, CAST(l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS DOUBLE) AS p95_lag_ms
FROM (SELECT e.feed, e.batch_id, list_sort(list(r.lag)) AS l
      FROM (SELECT feed, batch_id, max(rn) AS hi FROM {source}_ranked GROUP BY feed, batch_id) e
      JOIN {source}_ranked r ON r.rn > e.hi - 1000 AND r.rn <= e.hi GROUP BY e.feed, e.batch_id)"""


def _volumes(source: str) -> str:
    return f"""SELECT b.feed, b.batch_id, b.clock,
  count(*) FILTER ((e.occurred_at // 86400000 + 1) * 86400000 > b.clock - 86400000) AS short_volume,
  count(*) FILTER (e.occurred_at >= b.clock - 604800000) AS baseline_total
FROM (SELECT feed, batch_id, max(newest) OVER (ORDER BY batch_id) AS clock
      FROM (SELECT feed, batch_id, max(received_at) AS newest FROM {source} GROUP BY feed, batch_id)) b
JOIN {source} e ON e.batch_id <= b.batch_id GROUP BY b.feed, b.batch_id, b.clock"""


def _stalls(source: str) -> str:
    return f"""SELECT *, CASE WHEN stalled THEN first_value(short_volume) OVER i ELSE 0 END AS stall_short_volume,
  CASE WHEN stalled THEN first_value(baseline_avg) OVER i ELSE 0.0 END AS stall_baseline_avg,
  CASE WHEN stalled THEN first_value(drop_now) OVER i ELSE 0.0 END AS stall_drop_ratio,
  CASE WHEN stalled THEN first_value(clock) OVER i END AS stall_detected_at,
  CASE WHEN stalled THEN row_number() OVER i ELSE 0 END AS stall_streak
FROM (SELECT *, count(*) FILTER (NOT stalled) OVER (ORDER BY batch_id) AS island
      FROM (SELECT *, short_volume >= 5 AND drop_now >= 0.4 AS stalled
            FROM (SELECT *, CASE WHEN baseline_avg > 0 THEN 1.0::DOUBLE - short_volume / baseline_avg ELSE 0.0 END AS drop_now
                  FROM (SELECT *, baseline_total / 7.0::DOUBLE AS baseline_avg FROM {source}_volumes))))
WINDOW i AS (PARTITION BY island, stalled ORDER BY batch_id)"""


for _name in ("timed", "thin_timed", "small", "thin_small"):
    part(f"{_name}_lag", _name, _lag_totals(_name))
    part(f"{_name}_volumes", _name, _volumes(_name))
    part(f"{_name}_stalls", f"{_name}_volumes", _stalls(_name))
for _name in ("env", "thin_small"):
    part(
        f"{_name}_ranked",
        _name,
        f"SELECT feed, batch_id, {_LAG} AS lag, row_number() OVER (ORDER BY batch_id, seq) AS rn FROM {_name}",
    )
    part(f"{_name}_p95", f"{_name}_ranked", _p95(_name))

part(
    "signals",
    "thin_outcomes thin_small_lag thin_small_p95 thin_small_stalls",
    """SELECT *, anomaly_score >= 0.5 AS anomaly_active, CASE WHEN anomaly_score >= 0.5 THEN clock END AS anomaly_detected_at
FROM (SELECT *, 0.4::DOUBLE * volume_score + 0.3::DOUBLE * lag_score + 0.3::DOUBLE * violation_score AS anomaly_score
  FROM (SELECT o.*, l.* EXCLUDE (feed, batch_id), p.* EXCLUDE (feed, batch_id), s.* EXCLUDE (feed, batch_id),
      CASE WHEN s.stalled AND s.stall_drop_ratio >= 0.4 THEN least(s.stall_drop_ratio / 0.4::DOUBLE, 1.0::DOUBLE)
           ELSE 0.0::DOUBLE END AS volume_score,
      CASE WHEN l.max_seen_lag_ms >= 60000 THEN least(l.late_ratio * 5.0::DOUBLE, 1.0::DOUBLE)
           ELSE least(l.max_seen_lag_ms / 60000.0::DOUBLE * 0.5::DOUBLE, 0.5::DOUBLE) END AS lag_score,
      ((o.quarantined > 0)::INT + o.null_rate_critical::INT + o.schema_rate_critical::INT) / 3.0::DOUBLE AS violation_score
    FROM thin_outcomes o JOIN thin_small_lag l USING (feed, batch_id) JOIN thin_small_p95 p USING (feed, batch_id)
      JOIN thin_small_stalls s USING (feed, batch_id)))""",
)


def _streak(flag: str, epoch: str) -> str:
    return f"""CASE WHEN {flag} THEN count(*) FILTER ({flag}) OVER (PARTITION BY {epoch}, i_{flag} ORDER BY batch_id)
    ELSE 0 END AS s_{flag}"""


def _alerts(epoch: str) -> str:
    flags = ("nulls", "schemas", "lags", "anomalies")
    islands = ", ".join(
        f"count(*) FILTER (NOT {f}) OVER (PARTITION BY {epoch} ORDER BY batch_id) AS i_{f}" for f in flags
    )
    counted = ", ".join(_streak(f, epoch) for f in flags)
    return f"""SELECT feed, batch_id, rule, level, streak, runbook_key FROM (
  SELECT feed, batch_id, unnest([
    {{'rule': 'stall', 'level': CASE WHEN stall_streak < 2 THEN NULL WHEN stall_streak >= 3 THEN 'critical' ELSE 'warning' END,
      'streak': stall_streak, 'runbook_key': CASE WHEN stall_streak >= 3 THEN 'consecutive_stall' ELSE 'stall_detected' END}},
    {{'rule': 'null_rate', 'level': CASE WHEN s_nulls < 2 THEN NULL WHEN s_nulls >= 3 THEN 'critical' ELSE 'warning' END,
      'streak': s_nulls, 'runbook_key': CASE WHEN s_nulls >= 3 THEN 'null_rate_critical' ELSE 'null_rate_warning' END}},
    {{'rule': 'schema', 'level': CASE WHEN s_schemas >= 2 THEN 'critical' END, 'streak': s_schemas,
      'runbook_key': 'schema_violation_critical'}},
    {{'rule': 'lag', 'level': CASE WHEN s_lags >= 2 THEN 'warning' END, 'streak': s_lags, 'runbook_key': 'high_lag'}},
    {{'rule': 'anomaly', 'level': CASE WHEN s_anomalies >= 2 THEN 'warning' END, 'streak': s_anomalies,
      'runbook_key': 'anomaly_detected'}}], recursive := true)
  FROM (SELECT *, {counted}
        FROM (SELECT *, {islands}
              FROM (SELECT *, null_rate_critical AS nulls, schema_rate_critical AS schemas, late_ratio > 0.02 AS lags,
                      anomaly_active AS anomalies FROM signals))))
WHERE level IS NOT NULL"""


part("alerts", "signals", _alerts("feed"))
part("alerts_reset", "signals", _alerts("epoch"))
for _pre in ("", "thin_"):
    part(
        f"{_pre}halts",
        f"{_pre}outcomes",
        f"""SELECT feed, min(batch_id) AS batch_id, 'halt' AS rule, 'critical' AS level,
  'circuit_breaker_halted' AS runbook_key FROM {_pre}outcomes WHERE outcome = 'halt' GROUP BY feed, epoch""",
    )
part(
    "stored",
    "signals",
    """SELECT feed, batch_id, outcome, total_records, passed, quarantined, schema_violations, missing_required_fields,
  invalid_field_values, round(null_rate, 6) AS null_rate, round(schema_violation_rate, 6) AS schema_violation_rate,
  round(p95_lag_ms, 2) AS p95_lag_ms, round(late_ratio, 6) AS late_ratio, stalled AS stall_active,
  round(anomaly_score, 4) AS anomaly_score, round(latency_ms, 2) AS latency_ms, started_at, completed_at
FROM signals""",
)

# ---- intake ----------------------------------------------------------------

check(
    "batch_assign_count",
    "transport",
    """SELECT concat(topic, '-', partition) AS feed, "offset" // 100 AS batch_id, count(*) AS records,
  min("offset") AS offset_first, max("offset") AS offset_last FROM transport GROUP BY 1, 2""",
)
check(
    "batch_assign_time",
    "timed",
    """SELECT feed, batch_id, count(*) AS records, min(received_at) AS first_received,
  max(received_at) AS last_received FROM timed GROUP BY feed, batch_id""",
)
check("tombstone_filter", "transport", 'SELECT partition, "offset", key FROM transport WHERE value IS NOT NULL')
check(
    "envelope_decode_json",
    "transport",
    """SELECT partition, "offset", value->>'event_id' AS event_id, value->>'event_type' AS event_type,
  CAST(value->>'event_version' AS INTEGER) AS event_version, value->>'producer' AS producer,
  CAST(value->>'occurred_at' AS BIGINT) AS occurred_at, value->>'partition_key' AS partition_key,
  value->>'payload_json' AS payload_json, value->>'trace_id' AS trace_id
FROM transport WHERE value IS NOT NULL""",
)
part(
    "spoiled",
    "transport",
    """SELECT topic, partition, "offset", seq, seq % 5 = 0 AS whole, value->>'event_id' AS event_id,
  value->>'event_type' IS NULL AS untyped,
  CASE seq % 5 WHEN 1 THEN value || ' x' WHEN 2 THEN value || value WHEN 3 THEN substr(value, 1, 40)
    WHEN 4 THEN '[' || value || ']' ELSE ' ' || value || chr(10) END AS raw
FROM transport WHERE value IS NOT NULL""",
)
check(
    "envelope_decode_strict",
    "spoiled",
    """SELECT partition, "offset", CASE WHEN whole THEN event_id END AS event_id,
  CASE WHEN NOT whole THEN raw END AS raw_value, NOT whole OR untyped AS schema_violation FROM spoiled""",
)
check(
    "undecodable_dead_letters",
    "spoiled",
    """SELECT substr(sha256(concat(topic, '/', partition, '/', "offset", '/', sha256(raw), ':', seq // 100,
    ':dlq:schema_violation')), 1, 32) AS idempotency_key, seq // 100 AS batch_id,
  'schema_violation' AS reason_codes, 'envelope cannot be decoded' AS error_detail, raw AS original_payload_json
FROM spoiled WHERE NOT whole""",
)
check("envelope_encode_json", "encoded", "SELECT seq, value FROM encoded")
check("envelope_structural_check", "env", f"SELECT seq, event_id, {_STRUCTURE} AS schema_violation FROM env")
check(
    "occurred_at_normalize",
    "env",
    f"""SELECT e.event_id AS seq, {_MS} AS from_time,
  CASE WHEN e.event_id % 4 <> 0 THEN v.occurred_at END AS from_text
FROM events e LEFT JOIN env v ON v.seq = e.event_id""",
)
check(
    "batch_offset_context",
    "transport",
    """SELECT feed, batch_id, arg_min(topic, seq) AS topic, arg_min(partition, seq) AS partition,
  arg_min("offset", seq) AS offset_first, arg_max("offset", seq) AS offset_last FROM transport GROUP BY feed, batch_id""",
)
check("consumer_lag", "lagging", "SELECT * FROM lagging")
check("backpressure_flag", "lagging", "SELECT *, consumer_lag > 1000 AS backpressure FROM lagging")

# ---- record checks ---------------------------------------------------------

check(
    "json_parse_check",
    "env",
    """SELECT seq, json_valid(CASE seq % 7 WHEN 1 THEN payload_json || ' x' WHEN 2 THEN payload_json || ']'
  WHEN 3 THEN payload_json || '}' WHEN 4 THEN payload_json || ',' || payload_json
  WHEN 5 THEN substr(payload_json, 1, 20) ELSE ' ' || payload_json || chr(10) END) AS is_json FROM env""",
)
check(
    "required_fields",
    "env_fields",
    """SELECT seq, coalesce(user_code = 'missing_required_field', false) AS user_id_missing,
  coalesce(time_code = 'missing_required_field', false) AS timestamp_missing,
  coalesce(price_code = 'missing_required_field', false) AS price_missing FROM env_fields WHERE j IS NOT NULL
UNION ALL SELECT seq, NULL, NULL, NULL FROM env_fields WHERE j IS NULL""",
)
check(
    "number_type_rule",
    "env_fields",
    """SELECT seq, CASE WHEN price_kind <> 'NULL' THEN price_kind NOT IN ('VARCHAR', 'OBJECT', 'ARRAY') END
  AS price_is_number FROM env_fields""",
)
check(
    "min_rule",
    "env_fields",
    """SELECT seq, CASE WHEN price_kind IS NULL OR price_kind = 'NULL' THEN NULL WHEN price_kind = 'BOOLEAN' THEN true
  WHEN price_kind IN ('VARCHAR', 'OBJECT', 'ARRAY') THEN false ELSE price < 10 END AS below_minimum FROM env_fields""",
)
check(
    "iso8601_format",
    "",
    f"""SELECT event_id, text, {_iso('text')} AS is_iso8601 FROM (SELECT event_id, CASE event_id % 8
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d')
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 3 THEN strftime(ts, '%Y/%m/%d')
  WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+05:30') WHEN 5 THEN strftime(ts, '%Y-13-%d')
  WHEN 6 THEN strftime(ts, '%Y-02-%d') ELSE strftime(ts, '%Y-%m-%dT24:%M') END AS text FROM events)""",
)
check(
    "epoch_millis_format",
    "env",
    f"""SELECT seq, text, {_epoch('text')} AS is_epoch_millis FROM (SELECT seq, CASE seq % 7
  WHEN 1 THEN '+' || ms WHEN 2 THEN ' ' || ms || ' ' WHEN 3 THEN ms || '.5' WHEN 4 THEN ms || '000'
  WHEN 5 THEN ms || '000000000000' WHEN 6 THEN '-' || ms ELSE ms END AS text
FROM (SELECT seq, CAST(occurred_at AS VARCHAR) AS ms FROM env))""",
)
check(
    "format_disjunction",
    "env_fields",
    """SELECT seq, CASE WHEN time_kind <> 'NULL' THEN time_kind = 'VARCHAR' END AS is_text,
  CASE WHEN time_kind <> 'NULL' THEN time_code IS NOT NULL END AS fails FROM env_fields""",
)
check(
    "field_rule_gating",
    "env_fields",
    """SELECT seq, CASE WHEN j IS NOT NULL THEN coalesce(user_code, '') END AS user_id_code,
  CASE WHEN j IS NOT NULL THEN coalesce(time_code, '') END AS timestamp_code,
  CASE WHEN j IS NOT NULL THEN coalesce(price_code, '') END AS price_code FROM env_fields""",
)
check("payload_violations", "env_checked", "SELECT seq, array_to_string(content, ',') AS violations FROM env_checked")
check("valid_events", "env_checked", "SELECT seq, event_id FROM env_checked WHERE is_valid")
check(
    "validate_events",
    "env_checked",
    "SELECT seq, array_to_string(violations, ',') AS violations, is_valid FROM env_checked",
)
check(
    "payload_key_drift",
    "drifted",
    """, valid AS (SELECT feed, batch_id, CASE WHEN json_valid(payload_json) AND json_type(payload_json) = 'OBJECT'
    THEN json_keys(payload_json) ELSE [] END AS keys FROM drifted),
totals AS (SELECT feed, batch_id, count(*) AS total FROM valid GROUP BY feed, batch_id),
seen AS (SELECT feed, batch_id, payload_key, count(*) AS seen
  FROM (SELECT feed, batch_id, unnest(list_distinct(keys)) AS payload_key FROM valid) GROUP BY feed, batch_id, payload_key),
wanted AS (SELECT feed, batch_id, unnest(['user_id', 'timestamp', 'price']) AS payload_key FROM totals)
SELECT feed, batch_id, payload_key, coalesce(seen, 0) AS seen, total, round(coalesce(seen, 0) / total, 6) AS share,
  CASE WHEN payload_key NOT IN ('user_id', 'timestamp', 'price') THEN 'unknown'
       WHEN coalesce(seen, 0) = 0 THEN 'missing' ELSE 'ok' END AS status
FROM (seen FULL JOIN wanted USING (feed, batch_id, payload_key)) JOIN totals USING (feed, batch_id)""",
)
check(
    "payload_distribution_drift",
    "drifted",
    """, prices AS (SELECT feed, batch_id, CASE WHEN json_type(j, '$.price') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      THEN CAST(json_extract_string(j, '$.price') AS DOUBLE) END AS x
    FROM (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM drifted)),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY batch_id) AS no FROM prices),
own AS (SELECT feed, batch_id, no, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS spread, min(x) AS low, max(x) AS high
  FROM numbered GROUP BY feed, batch_id, no),
past AS (SELECT o.batch_id, count(p.x) AS base_n, avg(p.x) AS base_mean, stddev_samp(p.x) AS base_spread
  FROM own o LEFT JOIN numbered p ON p.no BETWEEN o.no - 10 AND o.no - 1 GROUP BY o.batch_id)
SELECT feed, batch_id, n, round(mean, 8) AS mean, round(spread, 4) AS spread, round(low, 4) AS low, round(high, 4) AS high,
  base_n, round(base_mean, 8) AS base_mean, round(base_spread, 4) AS base_spread,
  round(abs(mean - base_mean) / base_spread, 4) AS z_score,
  coalesce(abs(mean - base_mean) / base_spread > 1.5, false) AS drifted
FROM own JOIN past USING (batch_id)""",
)

check(
    "payload_drift_large_values",
    "env",
    """, numbered AS (SELECT feed, batch_id, dense_rank() OVER (ORDER BY batch_id) AS no,
    CAST(1700000000000 + seq * 37 % 13 + CASE WHEN batch_id % 10 = 8 THEN 1000 ELSE 0 END AS DOUBLE) AS x FROM env),
own AS (SELECT feed, batch_id, no, count(x) AS n, avg(x - 1700000000000) + 1700000000000 AS mean,
    stddev_samp(x - 1700000000000) AS spread FROM numbered GROUP BY feed, batch_id, no),
past AS (SELECT o.batch_id, count(p.x) AS base_n, avg(p.x - 1700000000000) + 1700000000000 AS base_mean,
    stddev_samp(p.x - 1700000000000) AS base_spread
  FROM own o LEFT JOIN numbered p ON p.no BETWEEN o.no - 10 AND o.no - 1 GROUP BY o.batch_id)
SELECT feed, batch_id, n, round(mean, 2) AS mean, round(base_mean, 2) AS base_mean, round(spread, 4) AS spread,
  round(base_spread, 4) AS base_spread, round(abs(mean - base_mean) / base_spread, 3) AS z_score, base_n,
  coalesce(abs(mean - base_mean) / base_spread > 3.0, false) AS drifted
FROM own JOIN past USING (batch_id)""",
)

check(
    "payload_shape_drift",
    "widened",
    """, prices AS (SELECT feed, batch_id, CASE WHEN json_type(j, '$.price') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      THEN CAST(json_extract_string(j, '$.price') AS DOUBLE) END AS x
    FROM (SELECT *, CASE WHEN json_valid(payload_json) THEN payload_json END AS j FROM widened)),
numbered AS (SELECT feed, batch_id, x, dense_rank() OVER (ORDER BY batch_id) AS no,
    CASE WHEN x = 0 THEN 0 WHEN x IS NOT NULL THEN sign(x) * (floor(ln(abs(x)) * 2) + 2000) END AS bucket FROM prices),
batches AS (SELECT feed, batch_id, no, count(x) AS n FROM numbered GROUP BY feed, batch_id, no),
hist AS (SELECT no, bucket, count(*) AS c FROM numbered WHERE x IS NOT NULL GROUP BY no, bucket),
base AS (SELECT b.no, h.bucket, sum(h.c) AS c
  FROM batches b JOIN hist h ON h.no BETWEEN b.no - 10 AND b.no - 1 GROUP BY b.no, h.bucket),
sides AS (SELECT no, bucket, coalesce(h.c, 0) AS own, coalesce(t.c, 0) AS base
  FROM hist h FULL JOIN base t USING (no, bucket)),
sized AS (SELECT *, sum(own) OVER w AS n, sum(base) OVER w AS base_n, count(*) OVER w AS k,
    sum(own) OVER (w ORDER BY bucket) AS own_up, sum(base) OVER (w ORDER BY bucket) AS base_up
  FROM sides WINDOW w AS (PARTITION BY no)),
shares AS (SELECT *, (own + 0.5::DOUBLE) / (n + 0.5::DOUBLE * k) AS o, (base + 0.5::DOUBLE) / (base_n + 0.5::DOUBLE * k) AS b
  FROM sized),
scored AS (SELECT no, max(base_n) AS base_n, count(*) AS buckets,
    sum(CASE WHEN n > 0 AND base_n > 0 THEN (o - b) * ln(o / b) END) AS psi,
    max(CASE WHEN n > 0 AND base_n > 0 THEN abs(own_up / n - base_up / base_n) END) AS ks
  FROM shares GROUP BY no)
SELECT feed, batch_id, n, CAST(coalesce(base_n, 0) AS BIGINT) AS base_n, CAST(coalesce(buckets, 0) AS BIGINT) AS buckets,
  round(psi, 6) AS psi, round(ks, 6) AS ks,
  CASE WHEN psi IS NOT NULL THEN psi - (buckets - 1) * (1 / n + 1 / base_n) > 0.25 ELSE false END AS drifted
FROM batches LEFT JOIN scored USING (no)""",
)

# ---- batch report ----------------------------------------------------------

check("batch_counts", "report", "SELECT feed, batch_id, total_records, passed, quarantined FROM report")
check("batch_missing_count", "report", "SELECT feed, batch_id, missing_required_fields FROM report")
check("batch_null_rate", "report", "SELECT feed, batch_id, round(null_rate, 6) AS null_rate FROM report")
check(
    "batch_schema_violation_rate",
    "report",
    "SELECT feed, batch_id, schema_violations, round(schema_violation_rate, 6) AS schema_violation_rate FROM report",
)
check("batch_invalid_count", "report", "SELECT feed, batch_id, invalid_field_values FROM report")
check(
    "batch_threshold_flags",
    "report",
    """SELECT feed, batch_id, null_rate_warning, null_rate_critical, schema_rate_warning, schema_rate_critical
FROM report""",
)
check(
    "empty_batch_stats",
    "env_checked",
    """, four AS (SELECT CASE WHEN day(make_timestamp(occurred_at * 1000)) BETWEEN 10 AND 12 THEN seq - seq % 5 ELSE seq END // 4
      AS batch_id, count(*) AS total, count(*) FILTER (is_valid) AS passed,
    sum(len(list_filter(violations, lambda x: x = 'missing_required_field'))) / (count(*) * 3) AS null_rate,
    count(*) FILTER (list_contains(violations, 'schema_violation')) / count(*) AS schema_rate
  FROM env_checked GROUP BY 1)
SELECT 'main' AS feed, batch_id, coalesce(total, 0) AS total_records, coalesce(passed, 0) AS passed,
  coalesce(total - passed, 0) AS quarantined, round(coalesce(null_rate, 0.0::DOUBLE), 6) AS null_rate,
  coalesce(null_rate >= 0.02, false) AS null_rate_warning, coalesce(schema_rate >= 0.1, false) AS schema_rate_warning
FROM (SELECT DISTINCT event_id // 4 AS batch_id FROM events) LEFT JOIN four USING (batch_id)""",
)
check("batch_latency", "report", "SELECT feed, batch_id, started_at, completed_at, latency_ms FROM report")
check(
    "window_rate",
    "env",
    """SELECT feed, occurred_at // 3600000 * 3600000 AS window_start, (occurred_at // 3600000 + 1) * 3600000 AS window_end,
  count(*) AS record_count, round(count(*) / 3600.0::DOUBLE, 6) AS volume_per_second FROM env GROUP BY 1, 2, 3""",
)
check(
    "batch_quality_report",
    "report",
    """SELECT feed, batch_id, total_records, passed, quarantined, schema_violations, missing_required_fields,
  invalid_field_values, round(null_rate, 6) AS null_rate, round(schema_violation_rate, 6) AS schema_violation_rate,
  null_rate_warning, null_rate_critical, schema_rate_warning, schema_rate_critical FROM report""",
)

# ---- breaker and routing ---------------------------------------------------

check("breaker_class", "classed", "SELECT feed, batch_id, batch_class FROM classed")
check("breaker_streak", "latched", "SELECT feed, batch_id, failure_streak FROM latched")
check(
    "breaker_outcome",
    "latched",
    """SELECT feed, batch_id, CASE WHEN was_open THEN 'halt' ELSE batch_class END AS outcome,
  was_open OR opens = 1 AS breaker_open FROM latched""",
)
check(
    "breaker_with_reset",
    "outcomes",
    "SELECT feed, batch_id, batch_class, failure_streak, outcome, breaker_open FROM outcomes",
)
part(
    "actions",
    "resets",
    """SELECT DISTINCT feed, batch_id, CASE WHEN batch_id % 2 = 0 THEN 'retry' ELSE 'release' END AS action
FROM (SELECT * FROM resets UNION ALL SELECT 'main', event_id // 10 FROM events WHERE (event_id // 10) % 7 = 3)""",
)
part(
    "action_classed",
    "classed actions",
    "SELECT * REPLACE ((SELECT count(*) FROM actions a WHERE a.batch_id <= c.batch_id) AS epoch) FROM classed c",
)
part("action_latched", "action_classed", _latched("action_classed", "epoch"))
check(
    "breaker_release",
    "action_latched",
    """SELECT l.feed, l.batch_id, CASE WHEN was_open THEN 'halt' ELSE batch_class END AS outcome,
  was_open OR opens = 1 AS breaker_open,
  (was_open OR batch_class = 'halt') AND coalesce(a.action, 'none') <> 'release' AS held_back
FROM action_latched l LEFT JOIN actions a USING (feed, batch_id)""",
)
check(
    "route_clean",
    "routed",
    "SELECT feed, batch_id, seq, event_id FROM routed WHERE is_valid AND outcome <> 'halt'",
)
check(
    "route_dlq",
    "routed",
    """SELECT feed, batch_id, seq, event_id, array_to_string(violations, ',') AS violations
FROM routed WHERE NOT is_valid AND outcome <> 'halt'""",
)
check(
    "dlq_records",
    "routed",
    """SELECT event_id, event_type, array_to_string(violations, ',') AS reason_codes, received_at AS quarantined_at,
  batch_id, trace_id, '' AS error_detail, payload_json AS original_payload_json
FROM routed WHERE NOT is_valid AND outcome <> 'halt'""",
)
check(
    "dlq_reason_counts",
    "routed",
    """SELECT reason_code, count(*) AS records FROM (SELECT unnest(violations) AS reason_code FROM routed
  WHERE NOT is_valid AND outcome <> 'halt') GROUP BY reason_code""",
)
check("halted_events", "routed", "SELECT feed, batch_id, seq, event_id, is_valid FROM routed WHERE outcome = 'halt'")
check("dry_run_report", "outcomes", "SELECT feed, batch_id, outcome, total_records, passed, quarantined FROM outcomes")

_CLEAN_KEY = "substr(sha256(concat(event_id, ':clean_sink:')), 1, 32)"

check(
    "idempotency_key",
    "small_checked",
    """SELECT seq, substr(sha256(concat(event_id, ':clean_sink::', producer, ':', coalesce(trace_id, 'None'))), 1, 32)
  AS idempotency_key FROM small_checked WHERE is_valid""",
)
check(
    "dlq_idempotency_key",
    "small_checked",
    """SELECT seq, substr(sha256(concat(event_id, ':', batch_id, ':dlq:', array_to_string(list_sort(violations), '.'))), 1, 32)
  AS idempotency_key FROM small_checked WHERE NOT is_valid""",
)
part("keyed", "copies", f"SELECT seq, copy, {_CLEAN_KEY} AS idempotency_key, received_at FROM copies")
part(
    "chain",
    "keyed",
    """/*recursive*/ SELECT idempotency_key, min(received_at) AS t FROM keyed GROUP BY idempotency_key
UNION ALL
SELECT idempotency_key, t FROM (SELECT c.idempotency_key, min(k.received_at) AS t FROM chain c JOIN keyed k
    ON k.idempotency_key = c.idempotency_key AND k.received_at > c.t + 3600000 GROUP BY c.idempotency_key)""",
)
check(
    "dedup_window",
    "chain",
    """SELECT k.seq, CAST(min(k.copy) AS BIGINT) AS copy, k.idempotency_key, k.received_at FROM keyed k JOIN chain c
  ON k.idempotency_key = c.idempotency_key AND k.received_at = c.t GROUP BY k.seq, k.idempotency_key, k.received_at""",
)
check(
    "dedup_two_feeds",
    "chain",
    """SELECT concat('feed-', k.seq % 2) AS feed, CAST(k.seq // 2 * 100 + min(k.copy) AS BIGINT) AS row_no,
  k.idempotency_key, k.received_at FROM keyed k JOIN chain c ON k.idempotency_key = c.idempotency_key
  AND k.received_at = c.t GROUP BY k.seq, k.idempotency_key, k.received_at""",
)
check(
    "dedup_first_seen",
    "keyed",
    """SELECT seq, CAST(copy AS BIGINT) AS copy, idempotency_key, received_at FROM keyed
QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY received_at, seq, copy) = 1""",
)
_SHARE = f"CAST(('0x' || substr({_CLEAN_KEY}, 1, 8))::BIGINT % 100 AS DOUBLE) / 100.0::DOUBLE"
check(
    "shadow_sample",
    "small_checked",
    f"SELECT seq, {_CLEAN_KEY} AS idempotency_key FROM small_checked WHERE is_valid AND {_SHARE} < 0.07::DOUBLE",
)
check(
    "sink_rows",
    "env_checked",
    f"""SELECT 'clean_sink' AS topic, partition_key AS key, {_json_pairs()} AS value, 'idempotency_key' AS header_key,
  {_CLEAN_KEY} AS header_value FROM env_checked WHERE is_valid""",
)
check(
    "dlq_replay",
    "copies_checked",
    """, letters AS (SELECT *, CASE WHEN j IS NULL THEN ['invalid_field_value', 'missing_required_field']
    ELSE list_filter([user_code, time_code], lambda x: x IS NOT NULL) END AS again
  FROM copies_checked WHERE NOT is_valid AND NOT list_contains(violations, 'schema_violation'))
SELECT event_id, array_to_string(again, ',') AS violations, len(again) = 0 AS recovered FROM letters
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at) = 1""",
)

# ---- monitors --------------------------------------------------------------

check("event_lag", "env", f"SELECT seq, {_LAG} AS lag_ms FROM env")
check(
    "batch_late_counts", "timed_lag", "SELECT feed, batch_id, event_count, late_count, batch_max_lag_ms FROM timed_lag"
)
check(
    "lag_running",
    "timed_lag",
    "SELECT feed, batch_id, total_event_count, late_event_count, max_seen_lag_ms FROM timed_lag",
)
check(
    "late_ratio",
    "timed_lag",
    """SELECT feed, batch_id, round(late_ratio, 6) AS late_ratio, round(batch_late_ratio, 6) AS batch_late_ratio
FROM timed_lag""",
)
check("lag_p95_rolling", "env_p95", "SELECT feed, batch_id, sample_count, p95_lag_ms FROM env_p95")
check(
    "volume_tumbling",
    "thin",
    "SELECT feed, occurred_at // 3600000 * 3600000 AS bucket_start, count(*) AS events FROM thin GROUP BY 1, 2",
)
check("short_window_volume", "thin_timed_volumes", "SELECT feed, batch_id, clock, short_volume FROM thin_timed_volumes")
check(
    "baseline_volume",
    "thin_timed_volumes",
    "SELECT feed, batch_id, baseline_total, round(baseline_total / 7.0::DOUBLE, 6) AS baseline_avg FROM thin_timed_volumes",
)
check("stall_signal", "thin_timed_stalls", "SELECT feed, batch_id, round(drop_now, 6) AS drop_now, stalled FROM thin_timed_stalls")
check(
    "stall_streak",
    "thin_timed_stalls",
    """SELECT feed, batch_id, stalled AS stall_active, stall_streak, stall_short_volume,
  round(stall_baseline_avg, 6) AS stall_baseline_avg, round(stall_drop_ratio, 6) AS stall_drop_ratio, stall_detected_at
FROM thin_timed_stalls""",
)
check(
    "window_snapshot",
    "thin_timed_volumes",
    """SELECT feed, batch_id, clock - 86400000 AS window_start, clock AS window_end, short_volume AS record_count
FROM thin_timed_volumes""",
)
check(
    "volume_vs_baseline",
    "thin",
    """, hours AS (SELECT feed, occurred_at // 3600000 AS w, count(*) AS events FROM thin GROUP BY 1, 2),
based AS (SELECT h.feed, h.w, h.events, avg(p.events) AS base FROM hours h JOIN hours p
  ON p.w BETWEEN h.w - 24 AND h.w GROUP BY h.feed, h.w, h.events)
SELECT feed, w * 3600000 AS bucket_start, events, round(base, 6) AS baseline_avg,
  round(1.0::DOUBLE - events / base, 6) AS drop_ratio, 1.0::DOUBLE - events / base >= 0.4::DOUBLE AS stalling FROM based""",
)
check(
    "late_event_corrections",
    "env",
    f"""SELECT feed, strftime(make_timestamp(occurred_at * 1000), '%Y-%m-%d') AS event_date,
  count(*) FILTER ({_LAG} <= 60000) AS on_time, count(*) FILTER ({_LAG} > 60000) AS late,
  max(received_at) FILTER ({_LAG} > 60000) AS last_correction_at FROM env GROUP BY 1, 2""",
)

# ---- score and alerts ------------------------------------------------------

check(
    "anomaly_components",
    "signals",
    """SELECT feed, batch_id, round(volume_score, 6) AS volume_score, round(lag_score, 6) AS lag_score,
  round(violation_score, 6) AS violation_score FROM signals""",
)
check(
    "anomaly_score",
    "signals",
    """SELECT feed, batch_id, round(0.4::DOUBLE * volume_score, 6) AS volume_contribution,
  round(0.3::DOUBLE * lag_score, 6) AS lag_contribution, round(0.3::DOUBLE * violation_score, 6) AS violation_contribution,
  round(anomaly_score, 6) AS anomaly_score, anomaly_active, anomaly_detected_at FROM signals""",
)
check(
    "anomaly_details",
    "signals",
    """SELECT feed, batch_id, concat_ws(';',
  CASE WHEN volume_score >= 0.5 THEN printf('volume_anomaly(score=%.2f)', volume_score) END,
  CASE WHEN lag_score >= 0.5 THEN printf('lag_anomaly(score=%.2f)', lag_score) END,
  CASE WHEN violation_score >= 0.5 THEN printf('violation_anomaly(score=%.2f)', violation_score) END) AS details
FROM signals""",
)
for _rule in ("stall", "null_rate", "schema", "lag", "anomaly"):
    check(
        f"alert_{_rule}",
        "alerts",
        f"SELECT feed, batch_id, level, streak, runbook_key FROM alerts WHERE rule = '{_rule}'",
    )
check("alert_halt", "halts", "SELECT feed, batch_id, level, runbook_key FROM halts")
check(
    "alert_with_reset", "alerts_reset", "SELECT feed, batch_id, rule, level, streak, runbook_key FROM alerts_reset"
)
check(
    "alerts_fired",
    "alerts_reset thin_halts",
    """SELECT feed, batch_id, string_agg(concat(rule, '=', level), ';'
  ORDER BY list_position(['stall', 'null_rate', 'schema', 'lag', 'anomaly', 'halt'], rule)) AS levels
FROM (SELECT feed, batch_id, rule, level FROM alerts_reset UNION ALL SELECT feed, batch_id, rule, level FROM thin_halts)
GROUP BY feed, batch_id""",
)


def _runbook_case() -> str:
    from dqstream.operators.alerts import RUNBOOKS

    whens = " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in RUNBOOKS.items() if k != "high_lag"
    )
    return f"CASE runbook_key {whens} ELSE concat(runbook_key, ': no steps are on file') END"


check(
    "alert_runbook", "alerts", f"SELECT feed, batch_id, rule, runbook_key, {_runbook_case()} AS runbook FROM alerts"
)

# ---- history and metrics ---------------------------------------------------

check("batch_outcomes", "stored", "SELECT * FROM stored")
check("history_idempotent_append", "stored", "SELECT * FROM stored")
check(
    "recent_stats",
    "stored",
    """SELECT count(*) AS total_batches, CAST(coalesce(sum(total_records), 0) AS BIGINT) AS total_records,
  coalesce(round(avg(null_rate), 4), 0.0) AS avg_null_rate, coalesce(round(avg(p95_lag_ms), 2), 0.0) AS avg_p95_lag_ms,
  coalesce(round(avg(anomaly_score), 4), 0.0) AS avg_anomaly_score
FROM stored WHERE started_at >= (SELECT max(completed_at) FROM stored) - 604800000""",
)
check(
    "outcome_history",
    "stored",
    """SELECT feed, batch_id, outcome, total_records, quarantined, started_at FROM stored
WHERE outcome = 'quarantine' AND started_at >= epoch_ms(TIMESTAMP '2024-01-08')""",
)
check(
    "quality_by_weekday",
    "stored",
    """SELECT CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, count(*) AS batches,
  CAST(sum(total_records) AS BIGINT) AS records, round(sum(passed) / sum(total_records), 6) AS quality
FROM (SELECT *, dayofweek(make_timestamp(started_at * 1000)) + 1 AS weekday,
        hour(make_timestamp(started_at * 1000)) AS hour FROM stored)
GROUP BY ROLLUP (weekday, hour)""",
)
check(
    "metric_records_total",
    "outcomes",
    """SELECT feed, 'pass' AS outcome, CAST(sum(passed) AS BIGINT) AS total FROM outcomes GROUP BY feed
UNION ALL SELECT feed, 'quarantine', CAST(sum(quarantined) AS BIGINT) FROM outcomes GROUP BY feed
UNION ALL SELECT feed, 'halt', count(*) FILTER (outcome = 'halt') FROM outcomes GROUP BY feed""",
)


def _histogram(metric: str, value: str, edges: list[str]) -> str:
    rows = [
        f"SELECT feed, '{metric}' AS metric, '{e}' AS le, count(*) FILTER ({value} <= {e}) AS observations FROM signals GROUP BY feed"
        for e in edges
    ]
    rows.append(f"SELECT feed, '{metric}', '+Inf', count({value}) FROM signals GROUP BY feed")
    return "\nUNION ALL ".join(rows)


_SECONDS = ["0.01", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10"]
check(
    "metric_histograms",
    "signals",
    "\nUNION ALL ".join(
        [
            _histogram("batch_duration_seconds", "(latency_ms / 1000.0::DOUBLE)", _SECONDS),
            _histogram("validation_latency_ms", "latency_ms", ["10", "25", "50", "100", "200", "500", "1000", "2500"]),
            _histogram(
                "event_lag_ms", "max_seen_lag_ms", ["100", "500", "1000", "5000", "10000", "30000", "60000", "120000"]
            ),
        ]
    ),
)


def _unpivot(source: str, keep: str, label: str, value: str, entries: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {keep}, '{name}' AS {label}, round(CAST({sql} AS DOUBLE), 6) AS {value} FROM {source}"
        for name, sql in entries.items()
    )


check(
    "metric_gauges_latest",
    "signals",
    ", last AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY feed ORDER BY batch_id DESC) = 1)\n"
    + _unpivot(
        "last",
        "feed",
        "gauge",
        "value",
        {
            "null_rate": "null_rate",
            "schema_violation_rate": "schema_violation_rate",
            "circuit_breaker_state": "(outcome = 'halt')::INT",
            "late_event_ratio": "late_ratio",
            "p95_lag_ms": "p95_lag_ms",
            "short_window_volume": "stall_short_volume",
            "baseline_volume_avg": "stall_baseline_avg",
            "stall_active": "stalled::INT",
            "consecutive_stall_windows": "stall_streak",
            "anomaly_score": "anomaly_score",
            "anomaly_active": "anomaly_active::INT",
            "rollout_mode": "2",
        },
    ),
)
check(
    "metric_rollout",
    "small_checked lagging",
    f"""SELECT feed AS source, 'clean_records' AS metric, count(*) AS value FROM small_checked WHERE is_valid GROUP BY feed
UNION ALL SELECT feed, 'shadow_routed', count(*) FILTER ({_SHARE} < 0.07::DOUBLE) FROM small_checked WHERE is_valid GROUP BY feed
UNION ALL SELECT topic, 'backpressure_active', CAST(consumer_lag > 1000 AS BIGINT) FROM lagging""",
)
part(
    "minutes",
    "signals",
    """SELECT feed, completed_at // 60000 * 60000 AS minute_ms, sum(passed) AS p, sum(quarantined) AS q,
  count(*) FILTER (outcome = 'halt') AS h FROM signals GROUP BY 1, 2""",
)
check(
    "dash_records_rate",
    "minutes",
    _unpivot(
        "minutes",
        "feed, minute_ms",
        "outcome",
        "per_second",
        {"pass": "p / 60.0::DOUBLE", "quarantine": "q / 60.0::DOUBLE", "halt": "h / 60.0::DOUBLE"},
    ),
)
check(
    "dash_threshold_series",
    "signals",
    """SELECT feed, batch_id, series, round(value, 6) AS value,
  CASE WHEN value >= critical THEN 'critical' WHEN value >= warning THEN 'warning' ELSE 'ok' END AS severity
FROM (SELECT feed, batch_id, 'null_rate' AS series, null_rate AS value, 0.02::DOUBLE AS warning, 0.03::DOUBLE AS critical FROM signals
  UNION ALL SELECT feed, batch_id, 'anomaly_score', anomaly_score, 0.5::DOUBLE, 0.5::DOUBLE FROM signals
  UNION ALL SELECT feed, batch_id, 'stall_active', stalled::INT::DOUBLE, 1, 1 FROM signals
  UNION ALL SELECT feed, batch_id, 'anomaly_active', anomaly_active::INT::DOUBLE, 1, 1 FROM signals)""",
)
check(
    "dash_quality_series",
    "signals",
    _unpivot(
        "signals",
        "feed, batch_id",
        "series",
        "value",
        {
            "latency_ms": "latency_ms",
            "p95_lag_ms": "p95_lag_ms",
            "schema_violation_rate": "schema_violation_rate",
            "late_event_ratio": "late_ratio",
            "short_window_volume": "short_volume",
            "baseline_volume_avg": "baseline_avg",
        },
    ),
)
check(
    "dash_latency_buckets",
    "signals",
    ", placed AS (SELECT feed, completed_at // 60000 * 60000 AS minute_ms, latency_ms / 1000.0::DOUBLE AS s FROM signals)\n"
    + "\nUNION ALL ".join(
        f"""SELECT feed, minute_ms, '{e}' AS le, round(count(*) FILTER (s <= {e}) / 60.0::DOUBLE, 6) AS per_second
FROM placed GROUP BY feed, minute_ms"""
        for e in _SECONDS
    ),
)
