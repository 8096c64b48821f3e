"""Circuit breaker: pass, quarantine or halt per batch, with a latch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.contract import HALT, PASS, QUARANTINE
from dqstream.plans.scan import SPAN, running, streaks
from dqstream.policy import Policy

# Control rows sort before the batch they precede.
ORDER = ["batch_id", "__is_batch"]


def batch_class(p: Policy) -> Column:
    """What a batch deserves on its own, before the latch."""
    halts = F.col("schema_rate_critical") if "schema_violation_rate_critical" in p.halt_on else F.lit(False)
    holds = F.col("quarantined") > 0
    if "null_rate_exceeded" in p.quarantine_on:
        holds = holds | F.col("null_rate_warning")
    if "schema_violation" in p.quarantine_on:
        holds = holds | F.col("schema_rate_warning")
    return F.when(halts, HALT).when(holds, QUARANTINE).otherwise(PASS)


def classify(report: DataFrame, p: Policy) -> DataFrame:
    return report.withColumn("batch_class", batch_class(p))


def with_resets(rows: DataFrame, resets: DataFrame | None) -> DataFrame:
    """Put manual resets in line with the batches.

    `resets` holds (feed, batch_id): the reset comes just before that batch,
    whether or not the batch exists.
    """
    placed = rows.withColumn("__is_batch", F.lit(1))
    if resets is None:
        return placed
    control = resets.select("feed", "batch_id").distinct().withColumn("__is_batch", F.lit(0))
    return placed.unionByName(control, allowMissingColumns=True)


def failure_streak(classified: DataFrame, initial: DataFrame | None = None, span: int | None = SPAN) -> DataFrame:
    """Batches in a row that did not pass; a reset ends the row as well.

    It goes on counting while the breaker is open, and a batch that would pass
    sets it to zero there too; outcomes do not depend on it then.
    """
    batch = F.col("__is_batch") == 1
    ends = ~batch | (F.col("batch_class") == PASS)
    return streaks(classified, ["feed"], ORDER, {"failure_streak": (batch, ends)}, initial, span)


def breaker(
    report: DataFrame,
    p: Policy,
    resets: DataFrame | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Add `batch_class`, `failure_streak`, `outcome` and `breaker_open`.

    A halt-class batch that ends a run of failures opens the breaker; from then
    on every batch halts until a reset. With `halt_on_quarantine_run` any failing
    batch that ends such a run opens it, and halts itself. Whether it is open depends only on
    openings since the last reset, so no feedback is needed and running maxima
    give the exact state. `report` is read more than once: stage it.
    """
    counted = failure_streak(classify(with_resets(report, resets), p), initial, span)
    reached = F.col("failure_streak") >= p.failure_limit
    failing = F.col("batch_class") != PASS if p.halt_on_quarantine_run else F.col("batch_class") == HALT
    batch = F.col("__is_batch") == 1
    here = F.struct(*[F.col(c) for c in ORDER])
    marked = counted.withColumn("__opens", batch & reached & failing)
    latched = running(
        marked,
        ["feed"],
        ORDER,
        maxes={"last_reset": F.when(~batch, here)},
        maxes_before={"last_opening": F.when(F.col("__opens"), here)},
        initial=initial,
        span=span,
    )
    was_open = F.coalesce(
        F.col("last_opening").isNotNull()
        & (F.col("last_reset").isNull() | (F.col("last_opening") > F.col("last_reset"))),
        F.lit(False),
    )
    return (
        latched.withColumn("breaker_open", was_open | F.col("__opens"))
        .withColumn("outcome", F.when(F.col("breaker_open"), HALT).otherwise(F.col("batch_class")))
        # Kept inclusive, so that the row can seed a later run.
        .withColumn("last_opening", F.when(F.col("__opens"), here).otherwise(F.col("last_opening")))
        .filter(batch)
        .drop("__opens", "__is_batch")
    )
