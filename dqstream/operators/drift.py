"""Drift of payload keys and of payload values from batch to batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.contract import BATCH
from dqstream.functions import payload as pay
from dqstream.plans.scan import SPAN, running, with_reach
from dqstream.plans.stage import stage
from dqstream.policy import Policy

# Buckets of a histogram per e-fold of a value: each is about two thirds wider than the one before.
BUCKETS_PER_E = 2
# Change of shape that counts, as a population stability index beyond that of equal shapes.
SHAPE_LIMIT = 0.25


def key_drift(df: DataFrame, p: Policy) -> DataFrame:
    """Per batch and payload key: `ok`, `missing` or `unknown`, and its share.

    Each event gives its own keys and the required ones; a renamed field turns
    up as one unknown key and one missing key.
    """
    required = F.array(*[F.lit(f) for f in p.required_fields]).cast("array<string>")
    wrapped = F.col("__json")
    text = F.col("payload_json")
    parsed = df.select(*BATCH, text, pay.strict_variant(text).alias("__json"))
    own = F.when(pay.is_strict(wrapped, text), F.json_object_keys(text))
    keyed = parsed.select(*BATCH, F.coalesce(own, F.array().cast("array<string>")).alias("__keys"))
    # An unnamed entry per event counts the batch.
    entries = keyed.select(
        *BATCH,
        "__keys",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_union("__keys", required))).alias(
            "payload_key"
        ),
    )
    counted = stage(
        entries.groupBy(*BATCH, "payload_key").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.array_contains("__keys", F.col("payload_key"))).alias("seen"),
        )
    )
    totals = counted.filter("payload_key IS NULL").select(*BATCH, F.col("rows").alias("total"))
    is_required = F.array_contains(required, F.col("payload_key"))
    return (
        counted.filter("payload_key IS NOT NULL")
        .join(totals, BATCH)
        .select(
            *BATCH,
            "payload_key",
            "seen",
            "total",
            (F.col("seen") / F.col("total")).alias("share"),
            F.when(~is_required, "unknown").when(F.col("seen") == 0, "missing").otherwise("ok").alias("status"),
        )
    )


def _numbers(df: DataFrame, field: str) -> DataFrame:
    """Per event the payload field as `__x`, null where it is no number."""
    text = F.col("payload_json")
    parsed = df.select(*BATCH, text, pay.strict_variant(text).alias("__json"))
    value = pay.field(F.col("__json"), field)
    kind = pay.type_name(value)
    number = F.when(
        pay.is_strict(F.col("__json"), text) & pay.is_number_like(kind) & (kind != "BOOLEAN"),
        F.try_variant_get(value, "$", "double"),
    )
    return parsed.select(*BATCH, number.alias("__x"))


def value_stats(df: DataFrame, field: str) -> DataFrame:
    """Per batch: count, mean, spread and bounds of a numeric payload field."""
    x = F.col("__x")
    return (
        _numbers(df, field)
        .groupBy(*BATCH)
        .agg(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("spread"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("__m2"),
        )
    )


def distribution_drift(df: DataFrame, field: str, p: Policy, span: int | None = SPAN) -> DataFrame:
    """Each batch's mean against the values of the trailing batches.

    The z-score divides by the spread of the trailing values. A batch without
    a usable baseline is not flagged. Counts, means and squared deviations of
    the batches are merged around a common mean, which stays exact where values
    are large and close together.
    """
    stats = stage(value_stats(df, field))
    placed = running(stats, ["feed"], ["batch_id"], sums={"batch_no": F.lit(1).cast("bigint")}, span=span)
    seen = with_reach(placed, "batch_no", span or SPAN, p.drift_trailing_batches)
    past = (
        W.partitionBy("feed", "__chunk").orderBy("batch_no").rangeBetween(-p.drift_trailing_batches, -1)
    )
    # At most one entry per trailing batch.
    own = F.when(F.col("n") > 0, F.struct("n", "mean", F.col("__m2").alias("m2")))
    based = seen.withColumn("__past", F.collect_list(own).over(past)).filter("__own")
    zero = F.lit(0.0)
    anchor = F.col("__past")[0]["mean"]
    moved = F.aggregate("__past", zero, lambda done, b: done + b["n"] * (b["mean"] - anchor))
    apart = lambda b: b["mean"] - F.col("base_mean")
    squares = F.aggregate("__past", zero, lambda done, b: done + b["m2"] + b["n"] * apart(b) * apart(b))
    scored = (
        based.withColumn("base_n", F.aggregate("__past", F.lit(0).cast("bigint"), lambda done, b: done + b["n"]))
        .withColumn("base_mean", F.when(F.col("base_n") > 0, anchor + moved / F.col("base_n")))
        .withColumn("base_spread", F.when(F.col("base_n") > 1, F.sqrt(squares / (F.col("base_n") - 1))))
        .withColumn(
            "z_score",
            F.when(F.col("base_spread") > 0, F.abs(F.col("mean") - F.col("base_mean")) / F.col("base_spread")),
        )
    )
    return scored.select(
        *BATCH, "n", "mean", "spread", "low", "high", "base_n", "base_mean", "base_spread", "z_score",
        F.coalesce(F.col("z_score") > F.lit(p.drift_z_limit), F.lit(False)).alias("drifted"),
    )


def log_bucket(x: Column) -> Column:
    """The bucket of a number on a fixed scale that is even in its logarithm; order is kept.

    Zero has its own bucket, negative numbers mirror positive ones. A double
    falls into one of fewer than 6,000 buckets, whatever its size.
    """
    size = F.floor(F.ln(F.abs(x)) * BUCKETS_PER_E) + 1_000 * BUCKETS_PER_E
    return F.when(x == 0, F.lit(0)).when(x > 0, size).when(x < 0, -size).cast("bigint")


def value_histogram(df: DataFrame, field: str) -> DataFrame:
    """Per batch and bucket of a numeric payload field: `rows`. A null bucket counts events without a number."""
    return _numbers(df, field).groupBy(*BATCH, log_bucket(F.col("__x")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def shape_drift(df: DataFrame, field: str, p: Policy, limit: float = SHAPE_LIMIT, span: int | None = SPAN) -> DataFrame:
    """The shape of each batch's values against that of the trailing batches, also where the means agree.

    Histograms of the trailing batches are added up bucket by bucket. `ks` is the
    greatest distance of the two running shares, `psi` the population stability
    index, with half a row more in every bucket that either side uses. Equal
    shapes have an expected index of (buckets - 1) (1 / n + 1 / base_n); a batch
    has drifted if its index exceeds that by more than `limit`. A batch without
    numbers, or without any in the trailing batches, has neither figure and is
    not flagged. Events reach the shuffle folded; after that a batch is its buckets.
    """
    counted = stage(value_histogram(df, field))
    filled = F.col("bucket").isNotNull()
    batches = counted.groupBy(*BATCH).agg(F.coalesce(F.sum(F.when(filled, F.col("rows"))), F.lit(0)).alias("n"))
    placed = stage(running(batches, ["feed"], ["batch_id"], sums={"__no": F.lit(1).cast("bigint")}, span=span))
    held = counted.filter(filled).join(placed.select(*BATCH, "__no"), BATCH)
    # A bucket counts for its own batch and for the base of each batch that looks back to it.
    reach = F.sequence(F.col("__no"), F.col("__no") + p.drift_trailing_batches)
    seen = held.select("feed", "bucket", "rows", "__no", F.explode(reach).alias("__for"))
    own = F.col("__no") == F.col("__for")
    buckets = seen.groupBy("feed", F.col("__for").alias("__no"), "bucket").agg(
        F.coalesce(F.sum(F.when(own, F.col("rows"))), F.lit(0)).alias("__own"),
        F.coalesce(F.sum(F.when(~own, F.col("rows"))), F.lit(0)).alias("__base"),
    )
    # As many rows as there are buckets.
    batch = W.partitionBy("feed", "__no")
    upto = batch.orderBy("bucket")
    shares = buckets.select(
        "*",
        F.count(F.lit(1)).over(batch).alias("__k"),
        *[F.sum(c).over(batch).alias(f"{c}_n") for c in ("__own", "__base")],
        *[F.sum(c).over(upto).alias(f"{c}_up") for c in ("__own", "__base")],
    )

    def share(c: str) -> Column:
        return (F.col(c) + 0.5) / (F.col(f"{c}_n") + F.col("__k") * 0.5)

    apart = F.abs(F.col("__own_up") / F.col("__own_n") - F.col("__base_up") / F.col("__base_n"))
    moved = (share("__own") - share("__base")) * F.ln(share("__own") / share("__base"))
    usable = (F.col("__own_n") > 0) & (F.col("__base_n") > 0)
    scored = shares.groupBy("feed", "__no").agg(
        F.max("__base_n").alias("base_n"),
        F.count(F.lit(1)).alias("buckets"),
        F.sum(F.when(usable, moved)).alias("psi"),
        F.max(F.when(usable, apart)).alias("ks"),
    )
    noise = (F.col("buckets") - 1) * (1 / F.col("n") + 1 / F.col("base_n"))
    return placed.join(scored, ["feed", "__no"], "left").select(
        *BATCH,
        "n",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("base_n", "buckets")],
        "psi",
        "ks",
        F.coalesce(F.when(F.col("psi").isNotNull(), F.col("psi") - noise > F.lit(limit)), F.lit(False)).alias("drifted"),
    )
