"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are compared by cosine. Equal vectors are one class first.
All classes give the second moments whose principal axes turn the vectors, so
that their leading coordinates carry most of every product. Ordered by their
angle to the first axis they are cut into blocks; two blocks whose angles lie
further apart than the threshold allows never meet. For the others a tile adds up
products over the leading coordinates, bounds what the rest can add by the norms
of the suffixes, and stops for every pair that can no longer reach the threshold.
A tile emits link counts per vector and a spanning forest, never its pairs. Only
pairs within a billionth of the threshold leave a tile as such: turning a vector
rounds its components, so their cosine is taken once more from the vectors as
they are given, product over norms, and counts where it reaches the threshold.

Defined results: a vector that is null, empty, zero or holds null or non-finite
components, and one without a label, links with nothing and is kept. Vectors of
different lengths do not link. A null vec_id is never the smallest; it is kept
only if nothing it reaches has an id. Repeated rows are copies of each other. An
empty table gives no rows. Only vec_id, embedding and label are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import _arrow_schema, slim
from dqstream.llm.components import Forest, components
from dqstream.plans.stage import stage

THRESHOLD = 0.93
# Vectors per block; a tile compares two blocks.
BLOCK = 1024
# Leading coordinates after which pairs are dropped.
STEPS = (4, 8, 16, 32)
# A tile with fewer open pairs than this share goes on pair by pair.
SPARSE = 0.05
_SLACK = 1e-9
# Cosines this near to the threshold are taken from the vectors as given.
UNSURE = 1e-9


def unit_rows(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch by vector length: length, positions, unit vectors."""
    vectors = batch.column(column).to_pylist()
    size = np.array([len(v) for v in vectors])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, unit_rows([vectors[i] for i in at])


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes of the unit vectors, by vector length; columns by falling weight."""
    schema = "size int, moments binary"
    out = _arrow_schema(classes.sparkSession, schema)

    def emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], schema=out
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_size(batch, "embedding"):
                sums[d] = sums.get(d, 0) + x.T @ x
        yield from emit(sums)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sums[d] = sums.get(d, 0) + np.frombuffer(raw).reshape(d, d)
        yield from emit(sums)

    # One matrix per task, summed in a few tasks; the driver sums what those have.
    rows = classes.select("embedding").mapInArrow(partial, schema).repartition(8).mapInArrow(merged, schema).collect()
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums[r["size"]] = sums.get(r["size"], 0) + np.frombuffer(r["moments"]).reshape(r["size"], r["size"])
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in sums.items()}


def blocks(classes: DataFrame, turn: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of at most BLOCK turned vectors of one label and length, in the order of their angle."""
    label = classes.schema["label"].dataType.simpleString()
    turned_schema = f"label {label}, size int, angle double, cid bigint, n bigint, turned binary"
    block_schema = f"label {label}, size int, low double, high double, cids binary, counts binary, turned binary"
    out = [_arrow_schema(classes.sparkSession, s) for s in (turned_schema, block_schema)]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_size(batch, "embedding"):
                y = x @ turn[d]
                own = batch.take(pa.array(at))
                arrays = [
                    own.column("label").cast(out[0].field(0).type),
                    pa.array(np.full(len(at), d), pa.int32()),
                    pa.array(np.arccos(y[:, 0].clip(-1, 1))),
                    own.column("cid"),
                    own.column("n"),
                    pa.array([r.tobytes() for r in y], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=out[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            label, size, angle, cid, n, raw = zip(*held)
            row = (label[0], size[0], angle[0], angle[-1], np.array(cid).tobytes(), np.array(n).tobytes(), b"".join(raw))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out[1])], schema=out[1])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == BLOCK or row[:2] != held[0][:2]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    order = ["label", "size", "angle", "cid"]
    sorted_ = classes.mapInArrow(turned, turned_schema).repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(cut, block_schema).withColumn("block", F.monotonically_increasing_id())


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and products of the pairs of rows that reach `threshold`; rows are turned unit vectors."""
    d = a.shape[1]
    rest_a = np.sqrt(np.maximum((a * a)[:, ::-1].cumsum(axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum((b * b)[:, ::-1].cumsum(axis=1)[:, ::-1], 0))
    steps = [s for s in STEPS if s < d]
    product, done = np.zeros((len(a), len(b))), 0
    for i, end in enumerate([*steps, d]):
        product += a[:, done:end] @ b[:, done:end].T
        done = end
        if end == d:
            break
        live = product + np.outer(rest_a[:, end], rest_b[:, end]) >= threshold - _SLACK
        if np.count_nonzero(live) <= SPARSE * live.size:
            x, y = np.nonzero(live)
            kept = product[x, y]
            for end in [*steps[i + 1 :], d]:
                kept = kept + np.einsum("ij,ij->i", a[x, done:end], b[y, done:end])
                done = end
                bound = rest_a[x, end] * rest_b[y, end] - _SLACK if end < d else 0.0
                live = kept + bound >= threshold
                x, y, kept = x[live], y[live], kept[live]
            return x, y, kept
    x, y = np.nonzero(product >= threshold)
    return x, y, product[x, y]


def tiles(cut: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, n, null): a links to n more vectors; rows (a, null, b): a and b are in one component.

    Rows (a, -1, b): the cosine of a and b is to be taken again.
    """
    arc = float(np.arccos(max(threshold - UNSURE, -1.0))) + _SLACK
    ends = cut.select("label", "size", "low", "high", "block")
    left = ends.toDF("label", "size", "low_a", "high_a", "a")
    right = ends.toDF("label", "size", "low_b", "high_b", "b")
    near = (F.col("a") <= F.col("b")) & (F.col("low_b") - F.col("high_a") <= arc) & (F.col("low_a") - F.col("high_b") <= arc)
    pairs = left.join(right, ["label", "size"]).where(near).select("a", "b", "size")
    data = cut.select("block", "cids", "counts", "turned")
    for side in "ab":
        pairs = pairs.join(data.toDF(side, f"cids_{side}", f"counts_{side}", f"turned_{side}"), side)
    schema = "a bigint, n bigint, b bigint"
    out = _arrow_schema(cut.sparkSession, schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                yield _tile(t, threshold, out)

    names = ["a", "b", "size", *[f"{c}_{s}" for s in "ab" for c in ("cids", "counts", "turned")]]
    return pairs.select(*names).mapInArrow(compared, schema)


def _tile(t: dict, threshold: float, out: pa.Schema) -> pa.RecordBatch:
    cid = [np.frombuffer(t[f"cids_{s}"], np.int64) for s in "ab"]
    count = [np.frombuffer(t[f"counts_{s}"], np.int64) for s in "ab"]
    a, b = (np.frombuffer(t[f"turned_{s}"]).reshape(-1, t["size"]) for s in "ab")
    x, y, cosine = close_pairs(a, b, threshold - UNSURE)
    if t["a"] == t["b"]:
        # Both halves of the square count, so each link is taken once.
        x, y, cosine = x[x < y], y[x < y], cosine[x < y]
        ids, shift = cid[0], 0
    else:
        ids, shift = np.concatenate(cid), len(a)
    near = cosine < threshold + UNSURE
    unsure_a, unsure_b = ids[x[near]], ids[y[near] + shift]
    x, y = x[~near], y[~near]
    many = np.bincount(x, count[1][y], len(ids)) + np.bincount(y + shift, count[0][x], len(ids))
    groups = Forest(len(ids))
    groups.link(x, y + shift)
    linked, member = np.flatnonzero(many), np.flatnonzero(groups.root != np.arange(len(ids)))
    first = np.concatenate([ids[linked], ids[groups.root[member]], unsure_a])
    n = np.concatenate([many[linked], np.zeros(len(member)), np.full(len(unsure_a), -1)]).astype(np.int64)
    other = np.concatenate([np.zeros(len(linked), np.int64), ids[member], unsure_b])
    kind = np.repeat([0, 1, 2], [len(linked), len(member), len(unsure_a)])
    columns = [pa.array(first, pa.int64()), pa.array(n, mask=kind == 1), pa.array(other, pa.int64(), mask=kind == 0)]
    return pa.RecordBatch.from_arrays(columns, schema=out)


def settled(found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """`found` with its unsure pairs as links of both ends, or left out, by the cosine of the given vectors."""
    known = classes.select("cid", "n", "embedding")
    pairs = found.where("n = -1").select("a", "b")
    for side in "ab":
        pairs = pairs.join(known.toDF(side, f"n_{side}", f"v_{side}"), side)

    def dot(x: str, y: str) -> str:
        return f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, p) -> s + p)"

    # As long as its largest component is one, no vector overflows.
    for side in "ab":
        pairs = pairs.withColumn(f"m_{side}", F.expr(f"array_max(transform(v_{side}, c -> abs(c)))"))
        outside = f"m_{side} > 1e100 OR m_{side} < 1e-100"
        pairs = pairs.withColumn(
            f"v_{side}", F.expr(f"IF({outside}, transform(v_{side}, c -> c / m_{side}), v_{side})")
        )
    cosine = F.expr(f"{dot('v_a', 'v_b')} / (sqrt({dot('v_a', 'v_a')}) * sqrt({dot('v_b', 'v_b')}))")
    linked = pairs.where(cosine >= F.lit(threshold)).select(
        F.inline(
            F.expr(
                "array(named_struct('a', a, 'n', n_b, 'b', NULL), named_struct('a', b, 'n', n_a, 'b', NULL),"
                " named_struct('a', a, 'n', CAST(NULL AS BIGINT), 'b', b))"
            )
        )
    )
    return found.where("n IS NULL OR n >= 0").unionByName(linked)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    wide = slim(vectors, "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    keyed = wide.withColumn("usable", F.coalesce(usable, F.lit(False))).select(
        "vec_id",
        F.when(F.col("usable"), F.col("label")).alias("label"),
        F.when(F.col("usable"), F.xxhash64("embedding")).alias("h1"),
        F.when(F.col("usable"), F.xxhash64(F.lit(1), "embedding")).alias("h2"),
        F.when(F.col("usable"), F.col("embedding")).alias("embedding"),
    )
    key = ["label", "h1", "h2"]
    grouped = keyed.where("label is not null").groupBy(*key, "embedding")
    classes = stage(grouped.agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    cut = stage(blocks(classes.select("label", "embedding", "cid", "n"), axes(classes)))
    found = stage(settled(stage(tiles(cut, threshold)), classes, threshold))
    counts = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    narrow = classes.select(*key, "cid", "first", "n")
    linked = stage(narrow.join(roots, "cid").join(counts, "cid"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "root").select("cid", "links", "smallest")
    result = stage(
        narrow.join(linked, "cid", "left").select(
            *key,
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("smallest", "first").alias("smallest"),
        )
    )
    rows = keyed.select("vec_id", *key)
    alone = rows.where("label is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    grouped_rows = rows.where("label is not null").join(result, key)
    grouped_rows = grouped_rows.select("vec_id", F.col("links").alias("n_links"), F.col("smallest").alias("component_id"))
    every = grouped_rows.unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
