"""Running values and sliding frames that do not need one task per feed.

A window partitioned by feed alone puts all rows of a feed into one task. Here
the order column is cut into spans: a window runs inside each (feed, span), one
total per span is carried forward, and the two are combined. Only the span
totals meet in one task, and there is one of them per `span` batches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 100_000
_CHUNK = "__chunk"
_BEFORE_ALL = -(2**62)


def span_of(staged: DataFrame) -> int | None:
    """How to cut a staged table: not at all while one span would hold it."""
    return None if staged.limit(SPAN + 1).count() <= SPAN else SPAN


def running(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    maxes_before: Mapping[str, Column] | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Add running sums and maxima over `order` within `by`.

    `order[0]` must be a BIGINT ordinal; `maxes_before` leaves the current row
    out. `initial` may hold one row per `by` with the values reached earlier.
    The input is read twice, so give it a stored or staged table. Where each
    `by` is known to hold few rows, `span=None` takes one window and one read.
    """
    sums, maxes, maxes_before = dict(sums or {}), dict(maxes or {}), dict(maxes_before or {})
    peaks = {**maxes, **maxes_before}
    by = list(by)
    cut = rows.withColumn(_CHUNK, _chunk_of(order[0], span))

    inside = W.partitionBy(*by, _CHUNK).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    local = cut.select(
        "*",
        *[F.sum(c).over(upto).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.max(c).over(upto).alias(f"__m_{n}") for n, c in maxes.items()],
        *[F.max(c).over(before).alias(f"__m_{n}") for n, c in maxes_before.items()],
    )

    if span is None:
        joined = _with_start(
            local, by, initial, {**{f"__cs_{n}": n for n in sums}, **{f"__cm_{n}": n for n in peaks}}
        )
    else:
        totals = cut.groupBy(*by, _CHUNK).agg(
            *[F.sum(c).alias(n) for n, c in sums.items()],
            *[F.max(c).alias(n) for n, c in peaks.items()],
        )
        if initial is not None:
            start = initial.select(*by, F.lit(_BEFORE_ALL).alias(_CHUNK), *sums, *peaks)
            totals = totals.unionByName(start)
        earlier = W.partitionBy(*by).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select(
            *by,
            _CHUNK,
            *[F.sum(n).over(earlier).alias(f"__cs_{n}") for n in sums],
            *[F.max(n).over(earlier).alias(f"__cm_{n}") for n in peaks],
        )
        joined = local.join(carried, [*by, _CHUNK], "left")
    started = span is not None or initial is not None

    def total(n: str) -> Column:
        own = F.coalesce(F.col(f"__s_{n}"), F.lit(0))
        return F.coalesce(F.col(f"__cs_{n}"), F.lit(0)) + own if started else own

    def peak(n: str) -> Column:
        return _later(F.col(f"__cm_{n}"), F.col(f"__m_{n}")) if started else F.col(f"__m_{n}")

    made = {**{n: total(n) for n in sums}, **{n: peak(n) for n in peaks}}
    return joined.select(*[c for c in rows.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def _chunk_of(order: str, span: int | None) -> Column:
    return F.lit(0).cast("bigint") if span is None else F.expr(f"`{order}` div {span}L")


def _with_start(local: DataFrame, by: list[str], initial: DataFrame | None, names: Mapping[str, str]) -> DataFrame:
    """Put the values an earlier run reached next to the rows."""
    if initial is None:
        return local
    return local.join(initial.select(*by, *[F.col(n).alias(a) for a, n in names.items()]), by, "left")


def _later(a: Column, b: Column) -> Column:
    """The greater of two values that may be null; structs compare field by field."""
    return F.when(a.isNull(), b).when(b.isNull() | (a > b), a).otherwise(b)


def with_reach(rows: DataFrame, order: str, span: int, reach: int) -> DataFrame:
    """Copy each row into every span its value can still be seen from.

    A frame that looks back at most `reach` along `order` can then be computed
    inside (feed, span). Keep only the rows with `__own` afterwards.
    """
    home = F.expr(f"`{order}` div {span}L")
    last = F.expr(f"(`{order}` + {reach}L) div {span}L")
    return (
        rows.withColumn("__home", home)
        .withColumn(_CHUNK, F.explode(F.sequence(F.col("__home"), last)))
        .withColumn("__own", F.col(_CHUNK) == F.col("__home"))
        .drop("__home")
    )


def dense_rank_of_rows(
    rows: DataFrame, by: Sequence[str], order: str, name: str, span: int = 65_536
) -> DataFrame:
    """0-based position of each row within `by`, ordered by a BIGINT column.

    Rows are numbered inside (by, span of `order`); the counts of the earlier
    spans are added, so no task holds a whole `by` group.
    """
    by = list(by)
    cut = rows.withColumn(_CHUNK, F.expr(f"`{order}` div {span}L"))
    counts = cut.groupBy(*by, _CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy(*by).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(*by, _CHUNK, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*by, _CHUNK).orderBy(order)
    return (
        cut.withColumn("__rn", F.row_number().over(inside))
        .join(base, [*by, _CHUNK])
        .withColumn(name, F.col("__base") + F.col("__rn") - 1)
        .drop(_CHUNK, "__rn", "__base")
    )


def streaks(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    tests: Mapping[str, tuple[Column, Column]],
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Add the number of counted rows since the last break, per named test.

    A test is (counts, breaks): a row that breaks sets the streak to zero, a
    row that only counts adds one, any other row holds it. `initial` may hold
    one row per `by` with the streaks reached earlier. The input is read twice.
    """
    by, names = list(by), list(tests)
    inside = W.partitionBy(*by, _CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = rows.select(
        *[c for c in rows.columns if c not in names],
        _chunk_of(order[0], span).alias(_CHUNK),
        *[F.coalesce(counts, F.lit(False)).cast("bigint").alias(f"__n_{n}") for n, (counts, _) in tests.items()],
        *[F.coalesce(breaks, F.lit(False)).alias(f"__b_{n}") for n, (_, breaks) in tests.items()],
    )
    counted = cut.select("*", *[F.sum(f"__n_{n}").over(inside).alias(f"__c_{n}") for n in names])
    local = counted.select(
        "*", *[F.max(F.when(F.col(f"__b_{n}"), F.col(f"__c_{n}"))).over(inside).alias(f"__a_{n}") for n in names]
    )

    if span is None:
        joined = _with_start(local, by, initial, {f"__k_{n}": n for n in names})
    else:
        totals = local.groupBy(*by, _CHUNK).agg(
            *[F.max(f"__c_{n}").alias(f"__t_{n}") for n in names],
            *[F.max(f"__a_{n}").alias(f"__l_{n}") for n in names],
        )
        if initial is not None:
            totals = totals.unionByName(
                initial.select(
                    *by,
                    F.lit(_BEFORE_ALL).alias(_CHUNK),
                    *[F.col(n).cast("bigint").alias(f"__t_{n}") for n in names],
                    *[F.lit(0).cast("bigint").alias(f"__l_{n}") for n in names],
                )
            )
        chunks = W.partitionBy(*by).orderBy(_CHUNK)
        upto = chunks.rowsBetween(W.unboundedPreceding, W.currentRow)
        earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
        # Position of the last break, counted from the start of the feed.
        placed = totals.select(
            *by,
            _CHUNK,
            *[F.sum(f"__t_{n}").over(earlier).alias(f"__e_{n}") for n in names],
            *[
                (F.sum(f"__t_{n}").over(upto) - F.col(f"__t_{n}") + F.col(f"__l_{n}")).alias(f"__p_{n}")
                for n in names
            ],
        )
        carried = placed.select(
            *by,
            _CHUNK,
            *[
                (
                    F.coalesce(F.col(f"__e_{n}"), F.lit(0))
                    - F.coalesce(F.max(f"__p_{n}").over(earlier), F.lit(0))
                ).alias(f"__k_{n}")
                for n in names
            ],
        )
        joined = local.join(carried, [*by, _CHUNK], "left")
    started = span is not None or initial is not None

    def streak(n: str) -> Column:
        open_ended = F.col(f"__c_{n}")
        if started:
            open_ended = open_ended + F.coalesce(F.col(f"__k_{n}"), F.lit(0))
        return F.when(F.col(f"__a_{n}").isNull(), open_ended).otherwise(F.col(f"__c_{n}") - F.col(f"__a_{n}"))

    made = [streak(n).alias(n) for n in names]
    return joined.select(*[c for c in rows.columns if c not in names], *made)
