"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings that change results, not speed.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # json.loads keeps the last of two equal keys; the variant parser refuses
    # them unless told otherwise.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that the results depend on."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def check_configured(spark: SparkSession) -> None:
    """Refuse to judge payloads under settings that would change the verdicts."""
    name = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(name, "false") != _SETTINGS[name]:
        raise RuntimeError("call dqstream.configure(spark) first")
