"""Benchmark decontamination with suffix arrays of the training text.

Each task lower-cases its documents, cuts them into words and numbers the words
that the benchmark uses; any other word ends every match, so stretches too short
for the shortest window are left out without loss. The rest is one shard: its
suffix array is built by prefix doubling, and every suffix of every benchmark
item is looked up by binary search, which gives the longest verbatim match, where
it lies, and the range of positions at which a whole window occurs. Shards live
and die inside one task, so nothing is shuffled.

The benchmark is a stated query set. It is read in blocks of at most BLOCK_WORDS
words (an item that is longer is a block by itself), and what a block needs grows
with its words, however long its items are. Blocks are broadcast one by one and
stay on disk; a task has one of them in memory at a time, and each is one more pass
in the same stage over the rows the task holds.

Nulls: a null text has no words; a null item_id is listed as `null`; a null
doc_id is carried along. Items with the same id count once. An empty benchmark
hits nothing, an empty table gives no rows. Only doc_id and text are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import _arrow_schema, slim, small_batches

WINDOW = 10
BLOCK_WORDS = 1 << 20
# A shard is closed once its kept stretches hold this many words.
SHARD_WORDS = 1 << 21
# A task holds rows of this many bytes, or so many rows, for all blocks to pass over.
SHARD_BYTES = 64 << 20
SHARD_ROWS = 1 << 17

# Lower case, and a space for every ASCII character that is no digit or letter.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


@dataclass
class Block:
    """Some items of the benchmark, as numbers."""

    ids: list[str] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id: object, words: list[bytes]) -> None:
        number = self.vocabulary
        self.ids.append("null" if item_id is None else str(item_id))
        self.items.append(np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32))

    def queries(self, window: int) -> Queries:
        """All suffixes, as places in one text; of equal windows of an item only the first starts one."""
        lengths = np.array(list(map(len, self.items)), np.int64)
        text = np.zeros(int(lengths.sum()) + len(lengths), np.int32)
        begins = np.cumsum(lengths + 1) - lengths - 1
        for b, words in zip(begins.tolist(), self.items):
            text[b : b + len(words)] = words
        item = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        start = np.flatnonzero(text)
        left = (begins + lengths)[item] - start
        size = np.minimum(window, lengths)[item].astype(np.int32)
        size[left < size] = 0
        _, first = np.unique(item * np.int64(len(text)) + _classes(text, window)[start], return_index=True)
        again = np.ones(len(start), bool)
        again[first] = False
        size[again & (left >= window)] = 0
        return Queries(text, start, left.astype(np.int32), size, item)


@dataclass
class Queries:
    """Suffixes of items: where they start in `text`, their words, window length (0 if none starts) and item."""

    text: np.ndarray
    start: np.ndarray
    left: np.ndarray
    size: np.ndarray
    item: np.ndarray


def _classes(text: np.ndarray, window: int) -> np.ndarray:
    """A number per position, the same where the same `window` words start."""
    rank, n = np.unique(text, return_inverse=True)[1].astype(np.int64), len(text)
    step = 1
    while step < min(window, n):
        more = min(step, window - step)
        after = np.zeros(n, np.int64)
        after[: n - more] = rank[more:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        step += more
    return rank


def blocks_of(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items with words, in blocks; one partition of items and one block are in memory at a time."""
    block, size = Block(), 0
    for row in slim(benchmark, "item_id", "text").toLocalIterator():
        words = words_of(row[1])
        if not words:
            continue
        if size and size + len(words) > most:
            yield block
            block, size = Block(), 0
        block.add(row[0], words)
        size += len(words)
    if block.items:
        yield block


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that start there; `text` ends with a unique 0."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


def _order_against(
    text: np.ndarray, at: np.ndarray, queries: np.ndarray, start: np.ndarray, depth: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Compare suffixes at `at` with `queries` from `start` on, over `depth` words: sign, and words in common."""
    sign = np.zeros(len(at), np.int8)
    common = np.zeros(len(at), np.int32)
    open_ = np.arange(len(at))
    for i in range(int(depth.max(initial=0))):
        open_ = open_[depth[open_] > i]
        if not len(open_):
            break
        own = text[np.minimum(at[open_] + i, len(text) - 1)]
        wanted = queries[start[open_] + i]
        sign[open_] = np.sign(own.astype(np.int64) - wanted)
        open_ = open_[own == wanted]
        common[open_] += 1
    return sign, common


def search(
    text: np.ndarray, suffixes: np.ndarray, queries: np.ndarray, start: np.ndarray, depth: np.ndarray, after: bool
) -> np.ndarray:
    """First place in the suffix array whose suffix is not before (or is after) the query, over `depth` words."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(suffixes))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        sign, _ = _order_against(text, suffixes[mid], queries, start[open_], depth[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def longest_matches(
    text: np.ndarray, suffixes: np.ndarray, queries: np.ndarray, start: np.ndarray, depth: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Length and one position of the longest verbatim match of each query's start."""
    place = search(text, suffixes, queries, start, depth, after=False)
    length, where = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
    for side in (place - 1, place):
        at = suffixes[side.clip(0, len(suffixes) - 1)]
        common = _order_against(text, at, queries, start, depth)[1]
        better = common > length
        length[better], where[better] = common[better], at[better]
    return length, where


class Shard:
    """Stretches of benchmark words of a run of documents."""

    def __init__(self, block: Block, window: int) -> None:
        self.block, self.window = block, window
        self.queries = block.queries(window)
        self.order: np.ndarray | None = None  # suffixes of the items themselves
        self.shortest = int(self.queries.size[self.queries.size > 0].min())
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.spots: list[tuple[int, int, int]] = []  # document, its word, length
        self.words = 0
        self.found: tuple[np.ndarray, ...] | None = None

    def add(self, doc: int, words: list[bytes]) -> None:
        n = len(words)
        numbers = np.fromiter(map(self.block.vocabulary.get, words, repeat(0)), np.int32, n)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (numbers > 0).view(np.int8), [0]])))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            self.parts.append(numbers[s:e])
            self.spots.append((doc, s, e - s))
            self.words += e - s

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every window occurrence: document, first word, words, item; and per suffix its longest match."""
        none, q = np.zeros(0, np.int64), self.queries
        if not self.parts:
            return none, none, none, none, np.zeros(len(q.start), np.int32)
        lengths = np.array([s[2] for s in self.spots])
        text = np.zeros(int(lengths.sum()) + len(lengths), np.int32)
        begins = np.cumsum(lengths + 1) - lengths - 1
        for b, p in zip(begins.tolist(), self.parts):
            text[b : b + len(p)] = p
        order = suffix_array(text)
        longest, _ = longest_matches(text, order, q.text, q.start, q.left)
        live = np.flatnonzero((q.size > 0) & (longest >= q.size))
        start, size = q.start[live], q.size[live]
        first, last = (search(text, order, q.text, start, size, after) for after in (False, True))
        many = last - first
        which = np.repeat(np.arange(len(live)), many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        at = order[first[which] + nth]
        run = np.searchsorted(begins, at, "right") - 1
        item = q.item[live[which]]
        self.found = text, at, (begins + lengths)[run] - at, size[which], item
        spots = np.array(self.spots).reshape(-1, 3)[run]
        return spots[:, 0], spots[:, 1] + at - begins[run], size[which], item, longest


    def matches(self) -> list[np.ndarray]:
        """For each occurrence of `hits`: words of the longest verbatim match from there on, its item and place there."""
        q = self.queries
        if self.found is None or not len(self.found[1]):
            return [np.zeros(0, np.int64)] * 3
        if self.order is None:
            self.order = suffix_array(q.text)
        text, at, left, size, own = self.found
        spot, first, again = np.unique(at, return_index=True, return_inverse=True)
        length, where = longest_matches(q.text, self.order, text, spot, left[first])
        item = q.item[np.searchsorted(q.start, where)]
        place = where - q.start[np.searchsorted(q.item, item)]
        length, item, place = (v[again].astype(np.int64) for v in (length, item, place))
        # Less than a window counts for a short item only, and then it is the whole item.
        whole = length < self.window
        return [np.where(whole, a, b) for a, b in ((size, length), (own, item), (0, place))]


class Passes:
    """The blocks of a benchmark, each taken over the rows a task holds, one in memory at a time."""

    def __init__(self, blocks: list[Broadcast], window: int) -> None:
        self._blocks, self._window = blocks, window
        self._only: Shard | None = None

    def _shard(self, shared: Broadcast) -> Shard:
        if self._only:
            return self._only
        shard = Shard(shared.value, self._window)
        if len(self._blocks) == 1:
            self._only = shard
        elif getattr(shared, "_path", None):
            # Else the worker keeps every block it has read. (Encrypted ones cannot be read again.)
            vars(shared).pop("_value", None)
        return shard

    def hits(
        self, held: list[pa.RecordBatch], column: int, matches: bool = False
    ) -> Iterator[tuple[list[str], list[np.ndarray]]]:
        """Ids of a block, and window occurrences in the texts of `held`: row, first word, words, item of the block.

        With `matches` also the words, item and place of the longest match from there on.
        """
        for shared in self._blocks:
            shard, row = self._shard(shared), 0
            for batch in held:
                for text in batch.column(column).to_pylist():
                    shard.add(row, words_of(text))
                    row += 1
                    if shard.words >= SHARD_WORDS:
                        yield shard.block.ids, [*shard.hits()[:4], *(shard.matches() if matches else [])]
                        shard.clear()
            yield shard.block.ids, [*shard.hits()[:4], *(shard.matches() if matches else [])]
            shard.clear()
            # The next block is read when this one is gone.
            del shard


def _shared(benchmark: DataFrame) -> list[Broadcast]:
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(b) for b in blocks_of(benchmark)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches, as many as a task holds at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= SHARD_BYTES or sum(b.num_rows for b in held) >= SHARD_ROWS:
            yield held
            held = []
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the longest match, spans.

    `longest` is the number of words of the longest verbatim match with one item that
    holds a window of it (0 without any), `longest_at` its first word in the
    document, the smallest among equals, `longest_item` and `longest_place` an item that
    holds it and the word there; null without any. `spans` lists hit stretches as
    first:end in words.
    """
    blocks = _shared(benchmark)
    schema = (
        "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
        "contaminated boolean, longest bigint, longest_at bigint, longest_item string, longest_place bigint, spans string"
    )
    out = _arrow_schema(docs.sparkSession, schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Passes(blocks, window)
        for held in _runs(batches):
            yield _report(held, passes, out)

    texts = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(found, schema)


def _report(held: list[pa.RecordBatch], passes: Passes, out: pa.Schema) -> pa.RecordBatch:
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 7]
    names: list[str] = []
    for ids, hits in passes.hits(held, 1, matches=True):
        # Only the names of items that were found are kept.
        used, item = np.unique(np.concatenate([hits[3], hits[5]]), return_inverse=True)
        item, source = np.split(item + len(names), 2)
        found.append([*hits[:3], item, hits[4], source, hits[6]])
        names += [ids[i] for i in used.tolist()]
    doc, word, size, item, length, source, place = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort([word, doc])
    doc, word, end, item = doc[order], word[order], (word + size)[order], item[order]
    length, source, place = length[order], source[order], place[order]
    cuts = np.searchsorted(doc, np.arange(sum(b.num_rows for b in held) + 1))
    rows = []
    for batch in held:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = slice(cuts[len(rows)], cuts[len(rows) + 1])
            spans = _merged(word[own], end[own])
            items = sorted({names[i] for i in np.unique(item[own]).tolist()})
            digest = hashlib.sha256(",".join(items).encode()).hexdigest()
            n_hit = sum(e - s for s, e in spans)
            longest: tuple = (0, None, None, None)
            if n_hit:
                k = cuts[len(rows)] + int(np.argmax(length[own]))
                longest = int(length[k]), int(word[k]), names[source[k]], int(place[k])
            shown = ",".join(f"{s}:{e}" for s, e in spans)
            rows.append((doc_id, len(words_of(text)), n_hit, len(items), digest, n_hit > 0, *longest, shown))
    columns = list(zip(*rows)) or [()] * len(out)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    if not len(start):
        return []
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), reach[last].tolist()))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark, with all their columns."""
    small_batches(docs.sparkSession)
    blocks = _shared(benchmark)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = Passes(blocks, window)
        for held in _runs(batches):
            keep = np.ones(sum(b.num_rows for b in held), bool)
            for _, hits in passes.hits(held, at):
                keep[hits[0]] = False
            first = 0
            for batch in held:
                yield batch.filter(pa.array(keep[first : first + batch.num_rows]))
                first += batch.num_rows

    return docs.mapInArrow(clean, docs.schema)
