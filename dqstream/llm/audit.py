"""How text filters interact: what each removes alone, after others, and in every order.

Documents come as a stream of files that is worked off in available-now
micro-batches. Filters A to D look at a text alone; E rejects a text that a
smaller doc_id has as well, and is kept as state: per text the smallest id seen
and the rows that have it. A row that arrives with a larger id fails E. Where a
smaller id arrives later, the rows counted as passing E until then are
retracted: counted minus one under their old mask and plus one under the new.

State and counters are tables with one folder per micro-batch, which holds what
the batch changed. A batch reads the folders of earlier ones and replaces its own
when it runs again. The state is keyed by text: old rows of a text and its new
ones meet in one shuffle. Counters per (part, mask, labels) add up to the table's.

Hot texts: each task folds its rows to one per text before the shuffle by text,
so that a text which a third of all rows hold reaches its state as one row per
task. Rows meet the labels by id and a salt made of the text, for ids that are
often repeated. Labels grow with the documents and are never broadcast.

Nulls: a null text is empty, a null source the empty part. A row without an id is
neither smaller nor larger than any, so it passes E and hides no other; labels do
not reach it. Rows of equal id and text all count and do not hide each other. A
label is given where any of an id's label rows gives it. An empty table gives no
parts and no rows. Texts of any length are looked at whole; E compares them by
SHA-256. No column but doc_id, text and source is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import permutations
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqstream.llm.common import _arrow_schema, small_batches
from dqstream.plans.stage import shared_folder

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
# A table is read in this many micro-batches, unless told otherwise.
BATCHES = 8
# Copies of each label, for ids that a large part of all rows share.
SALTS = 8
# Texts a task folds before it hands them on.
FOLD_TEXTS = 50_000

_SPACE = r"[\x20\x09-\x0D]+"
_ROWS = "array<struct<part:string,good:int,toxic:int,n:bigint>>"
_FOLDED = f"text_key string, mask int, low bigint, at_low {_ROWS}, above {_ROWS}, nameless {_ROWS}"
_STATE = f"text_key string, mask int, low bigint, passing {_ROWS}, retracted {_ROWS}"


def failures(text: Column) -> Column:
    """Filters A to D as bits 1, 2, 4, 8; a set bit is a failure."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    fails = [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 2,
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def counters(docs: DataFrame, labels: DataFrame, folder: str) -> None:
    """Work off the stream `docs`; `folder` gets the counters of every micro-batch.

    Started again on the same folder it goes on behind the last finished batch.
    """
    spark = small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("text_key"),
        failures(text).alias("mask"),
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)))
    told = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")
        .where("quality = 1 OR toxic = 1")
        .groupBy("doc_id")
        .agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    )
    # Never broadcast: files tell a hundredth of what the copies take in memory.
    marked = rows.join(told.hint("merge"), ["doc_id", "salt"], "left").select(
        "text_key", "mask", "doc_id", "part", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )
    schema = _arrow_schema(spark, _FOLDED)
    folded = marked.mapInArrow(lambda batches: _fold(batches, schema), _FOLDED)

    def work_off(frame: DataFrame, epoch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/folded/epoch={epoch}")
        _update_state(spark, folder, epoch)
        _count(spark, folder, epoch)

    writer = folded.writeStream.foreachBatch(work_off).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def _update_state(spark: SparkSession, folder: str, epoch: int) -> None:
    """Per text that got a smaller id, or more rows of its smallest: the rows that pass E now, and those that do no longer.

    The state of a text are the rows of its smallest id over all earlier batches.
    """
    new = spark.read.parquet(f"{folder}/folded/epoch={epoch}").where("low IS NOT NULL")
    new = new.select("text_key", "mask", "low", F.col("at_low").alias("passing"), F.lit(False).alias("held"))
    old = spark.createDataFrame([], new.schema)
    if epoch:
        earlier = [f"{folder}/state/epoch={e}" for e in range(epoch)]
        old = spark.read.schema(_STATE).parquet(*earlier).select("text_key", "mask", "low", "passing", F.lit(True).alias("held"))
    # One row per task and batch at most, so the list of a text is short.
    texts = new.union(old).groupBy("text_key").agg(
        F.first("mask").alias("mask"),
        F.min(F.when(F.col("held"), F.col("low"))).alias("before"),
        F.min(F.when(~F.col("held"), F.col("low"))).alias("low"),
        F.collect_list(F.struct("low", "held", "passing")).alias("seen"),
    )

    def rows(which: str) -> Column:
        return F.expr(f"flatten(transform(filter(seen, s -> {which}), s -> s.passing))")

    texts.where("low <= coalesce(before, low)").select(
        "text_key",
        "mask",
        "low",
        rows("NOT s.held AND s.low = low").alias("passing"),
        F.when(F.col("low") < F.col("before"), rows("s.held AND s.low = before")).alias("retracted"),
    ).write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")


def _count(spark: SparkSession, folder: str, epoch: int) -> None:
    """Changes of the counters: each row with an id is counted as failing E, and those that pass are moved."""
    folded = spark.read.parquet(f"{folder}/folded/epoch={epoch}")
    state = spark.read.schema(_STATE).parquet(f"{folder}/state/epoch={epoch}")

    def told(frame: DataFrame, rows: str, bits: str, sign: int) -> DataFrame:
        return frame.select(F.expr(bits).alias("mask"), F.inline(rows)).select(
            "part", "mask", "good", "toxic", (F.col("n") * sign).alias("n")
        )

    fails = f"mask | {DUPLICATE}"
    changes = told(folded, "at_low", fails, 1).union(told(folded, "above", fails, 1)).union(told(folded, "nameless", "mask", 1))
    for rows, sign in (("passing", 1), ("retracted", -1)):
        changes = changes.union(told(state, rows, "mask", sign)).union(told(state, rows, fails, -sign))
    counted = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")
    counted.write.mode("overwrite").parquet(f"{folder}/counters/epoch={epoch}")


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per text: its smallest id with the rows of it, the rows of larger ids, and those without an id."""
    held: dict[str, _Text] = {}

    def out() -> pa.RecordBatch:
        texts = held.values()
        columns = [list(held), [t.mask for t in texts], [t.low for t in texts]]
        columns += [[_told(c) for c in counts] for counts in zip(*[(t.at_low, t.above, t.nameless) for t in texts])]
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        held.clear()
        return made

    for batch in batches:
        for key, mask, doc, part, good, toxic in zip(*[c.to_pylist() for c in batch.columns]):
            text = held.get(key)
            if text is None:
                text = held[key] = _Text(mask)
            text.add(doc, (part, good, toxic))
        if len(held) >= FOLD_TEXTS:
            yield out()
    if held:
        yield out()


def _told(rows: dict[tuple, int]) -> list[dict]:
    return [{"part": p, "good": g, "toxic": t, "n": n} for (p, g, t), n in rows.items()]


class _Text:
    """The rows of one text, counted by part and labels."""

    __slots__ = ("mask", "low", "at_low", "above", "nameless")

    def __init__(self, mask: int) -> None:
        self.mask = mask
        self.low: int | None = None
        self.at_low: dict[tuple, int] = {}
        self.above: dict[tuple, int] = {}
        self.nameless: dict[tuple, int] = {}

    def add(self, doc: int | None, row: tuple) -> None:
        if doc is None:
            rows = self.nameless
        elif self.low is None or doc < self.low:
            for k, n in self.at_low.items():
                self.above[k] = self.above.get(k, 0) + n
            self.low, self.at_low = doc, {}
            rows = self.at_low
        else:
            rows = self.at_low if doc == self.low else self.above
        rows[row] = rows.get(row, 0) + 1


def report(spark: SparkSession, folder: str) -> DataFrame:
    """Every filter at every step of all orders, per part, from the summed counters."""
    schema = "part string, mask int, good int, toxic int, n bigint, epoch int"
    held = spark.read.schema(schema).parquet(f"{folder}/counters")
    sums = {"n": "n", "good": "n * good", "toxic": "n * toxic"}
    masks = held.groupBy("part", "mask").agg(*[F.sum(F.expr(e)).alias(c) for c, e in sums.items()])
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = masks.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    steps = steps.withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))

    def fails(at: str) -> str:
        return f"getbit(mask, instr('{FILTERS}', substring(filter_order, {at}, 1)) - 1) = 1"

    earlier = " OR ".join(f"(step > {i} AND {fails(str(i))})" for i in range(1, len(FILTERS)))
    steps = steps.select("*", F.expr(fails("step")).alias("own"), F.expr(earlier).alias("earlier"))
    counts = {
        "kept": ("NOT own AND NOT earlier", "n"),
        "removed": ("own AND NOT earlier", "n"),
        "redundant": ("own AND earlier", "n"),
        "unique_fails": ("own AND bit_count(mask) = 1", "n"),
        "good_lost": ("own AND NOT earlier", "good"),
        "toxic_lost": ("own AND NOT earlier", "toxic"),
        # Of all orders, a filter comes first among k failing ones in one of k.
        "shapley": ("own", f"n * ({len(orders)} div greatest(bit_count(mask), 1))"),
    }
    made = [F.expr(f"sum(CASE WHEN {when} THEN {value} ELSE 0 END)").alias(name) for name, (when, value) in counts.items()]
    return steps.groupBy("part", "filter_order", "step").agg(*made)


def audit(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Stream the Parquet file or folder `path` through the audit and report on it."""
    listed = spark.read.parquet(path)
    if files_per_batch is None:
        files_per_batch = max(1, ceil(len(listed.inputFiles()) / BATCHES))
    # A glob takes a single file as well as a folder.
    source = spark.readStream.schema(listed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    folder = f"{shared_folder(spark).rstrip('/')}/dqstream-audit/{uuid.uuid4().hex}"
    counters(source, labels, folder)
    return report(spark, folder)
