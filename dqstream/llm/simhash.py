"""SimHash near-duplicates: a self-join of binary tries under an error budget.

Two fingerprints that differ in at most four of 64 bits agree on at least one of
five blocks of bits. Each distinct fingerprint is therefore entered in five
tries, one per block, with that block's bits first; a trie's top is cut at the
block, and its subtrees are dealt out to tasks. There pairs of trie nodes are
walked down together, adding up the bits in which their paths differ, and a pair
is left as soon as it has spent the budget, is empty, or lies wholly inside one
group. A subtree emits a spanning forest of what it links, never all pairs.

Nulls: a null text has no words, like an empty one; all such texts have
fingerprint zero and are linked. A null doc_id is carried along and is never the
smallest. Equal rows share a fingerprint. An empty table gives no rows. No
column but doc_id and text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import LOWER, _arrow_schema, per_row
from dqstream.llm.components import Forest, components
from dqstream.plans.stage import stage

SHINGLE = 4
BUDGET = 4
# First bit of each block, counted from the highest; BUDGET + 1 blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
# Subtrees are walked together until they hold this many fingerprints, and node
# pairs in runs of this many. Both bound memory only.
TOGETHER = 1 << 17
FRONTIER = 1 << 18
_SMALL = 64


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    span = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s:e], 42) for s, e in zip(starts[: len(words) - span].tolist(), ends[span:].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The key columns and the fingerprint as a BIGINT `fp`."""
    return per_row(docs, "fp bigint", lambda texts: [[fingerprint(t) for t in texts]], keys)


def walk(keys: np.ndarray, roots: list[tuple[int, int, int]], budget: int = BUDGET) -> Forest:
    """Join the subtrees of sorted distinct 64-bit `keys`; `roots` are (from, to, depth)."""
    groups = Forest(len(keys))
    near = np.arange(len(keys) - 1)
    near = near[np.bitwise_count(keys[near] ^ keys[near + 1]) <= budget]
    inside = np.zeros(len(keys), bool)
    for start, end, _ in roots:
        inside[start + 1 : end] = True
    near = near[inside[near + 1]]
    groups.link(near, near + 1)

    by_depth: dict[int, list[tuple[int, int]]] = {}
    for start, end, depth in roots:
        if end - start > 1:
            by_depth.setdefault(depth, []).append((start, end))
    # A stack of (depth, node pairs): first and last position of both nodes, and errors so far.
    stack = []
    for depth, nodes in by_depth.items():
        at = np.array(nodes)
        stack.append((depth, np.column_stack([at, at, np.zeros(len(at), np.int64)])))
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:]), (depth, pairs[:half])]
            continue
        pairs = pairs[~_inside_one_group(groups.root, pairs)]
        a0, a1, b0, b1, _ = pairs.T
        done = ((a1 - a0) * (b1 - b0) <= _SMALL) if depth < 64 else np.ones(len(pairs), bool)
        _compare(keys, groups, pairs[done], budget)
        pairs = pairs[~done]
        if len(pairs):
            children = _split(keys, depth, pairs)
            stack.append((depth + 1, children[children[:, 4] <= budget]))
    return groups


def _inside_one_group(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    changes = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    a0, a1, b0, b1, _ = pairs.T
    return (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (root[a0] == root[b0])


def _split(keys: np.ndarray, depth: int, pairs: np.ndarray) -> np.ndarray:
    """Node pairs one bit further down."""
    ones = np.concatenate([[0], np.cumsum(keys >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64)])
    a0, a1, b0, b1, err = pairs.T
    am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
    same = a0 == b0
    made = [
        np.column_stack([a0, am, b0, bm, err]),
        np.column_stack([am, a1, bm, b1, err]),
        np.column_stack([a0, am, bm, b1, err + 1]),
        np.column_stack([am, a1, b0, bm, err + 1])[~same],
    ]
    out = np.concatenate(made)
    full = (out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3])
    alone = (out[:, 0] == out[:, 2]) & (out[:, 1] - out[:, 0] == 1)
    return out[full & ~alone]


def _compare(keys: np.ndarray, groups: Forest, pairs: np.ndarray, budget: int) -> None:
    """Compare what a few leaves hold, in bounded runs."""
    run = FRONTIER // _SMALL * 16
    for i in range(0, len(pairs), run):
        a0, a1, b0, b1, _ = pairs[i : i + run].T
        wide = b1 - b0
        many = (a1 - a0) * wide
        which = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        a, b = a0[which] + nth // wide[which], b0[which] + nth % wide[which]
        close = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
        groups.link(a[close], b[close])


def links(distinct: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints `fp`."""
    turned = [
        F.struct(
            F.lit(i).alias("block"),
            (F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")).alias("key"),
            F.expr(f"shiftrightunsigned(fp, {64 - at - bits}) & {(1 << bits) - 1}L").alias("top"),
        )
        for i, (at, bits) in enumerate(BLOCKS)
    ]
    tries = distinct.select(F.explode(F.array(*turned)).alias("t")).select("t.*")
    out = _arrow_schema(distinct.sparkSession, "a bigint, b bigint")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
            held.append(rows)
            size += len(rows)
            if size >= TOGETHER:
                rows = np.concatenate(held)
                # The last subtree may go on in the next batch.
                last = (rows[:, 0] == rows[-1, 0]) & (rows[:, 2] == rows[-1, 2])
                if not last.all():
                    yield from _edges(rows[~last], out)
                held = [rows[last]]
                size = len(held[0]) if not last.all() else 0
        if held and len(rows := np.concatenate(held)):
            yield from _edges(rows, out)

    dealt = tries.repartition("block", "top").sortWithinPartitions("block", "top")
    return dealt.select("block", "key", "top").mapInArrow(joined, "a bigint, b bigint")


def _edges(rows: np.ndarray, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for block in np.unique(rows[:, 0]):
        at, bits = BLOCKS[block]
        keys = np.sort(rows[rows[:, 0] == block, 1].view(np.uint64))
        cuts = np.flatnonzero(np.diff(keys >> np.uint64(64 - bits))) + 1
        bounds = np.concatenate([[0], cuts, [len(keys)]])
        groups = walk(keys, [(int(s), int(e), bits) for s, e in zip(bounds[:-1], bounds[1:])])
        member = np.flatnonzero(groups.root != np.arange(len(keys)))
        back = (keys >> np.uint64(at) | keys << np.uint64(64 - at)) if at else keys
        ends = [back[groups.root[member]].view(np.int64), back[member].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], schema=out)


def grouped(prints: DataFrame, first: Column) -> DataFrame:
    """Rows (fp, first): for each fingerprint the smallest `first` among all documents reached."""
    classes = stage(prints.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(links(classes.select("fp")))
    linked = stage(classes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    linked = linked.join(smallest, "root").select("fp", "smallest")
    return stage(classes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("first")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = stage(fingerprints(docs))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    groups = grouped(prints, F.col("doc_id"))
    return prints.join(groups, "fp").select("doc_id", shown, F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One whole row of each group: that of the smallest doc_id; of equal ids, and of none, the first read."""
    names = docs.columns
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()))
    prints = stage(fingerprints(numbered, ("doc_id", "__row")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    keep = grouped(prints, first).select(F.col("first.__row").alias("__row"))
    return numbered.join(keep.distinct(), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in names])
