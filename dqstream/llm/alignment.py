"""Token ids of two tokenizers aligned by the bytes they stand for.

One tokenizer is byte-level (A, over a space and the text), one of sentence pieces
(B, which adds that space itself). Both always cut at a single space between two
visible characters, so a text is split there into windows. The new windows of a
text are encoded together, aligned in one go and remembered by their words. Texts
and models for which that does not hold are encoded whole; their windows lie between
anchors, places where both have a token end and both go on with a token that starts
with a space, and are remembered by their two id tuples. Inside a window, byte offsets
where both have an end cut groups; all A-B pairs of a group are linked.

A pair of ids counts in as many documents as hold it linked. Documents are
folded to chunks, each with a dictionary of its pairs, so that dictionaries
travel and not the links of single documents: one row per (chunk, pair) is
summed up over the corpus, and goes back to its chunk with the sum.

Nulls, empty texts and texts that one of the tokenizers does not give back byte
by byte have no tokens: zeros and an empty alignment. Every row is a document of
its own, also repeated rows and rows without an id. A very long text makes a
chunk by itself; its windows are taken in blocks. Among pairs of equal count
all are best. An empty table gives no rows. No column but doc_id and text is read.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import _arrow_schema, slim
from dqstream.llm.encoder import Encoder, _plain
from dqstream.plans.stage import stage

# A chunk is closed once it holds this many pairs of documents, or documents.
CHUNK_PAIRS = 1 << 20
CHUNK_DOCS = 1 << 14
# Windows of a document that are looked at together.
BLOCK_WINDOWS = 1 << 16
# Windows remembered per Python worker in each of two generations, and how many ids one may have.
MEMO_WINDOWS = 300_000
MEMO_IDS = 64

# A group of more links counts its pairs first.
_FEW_LINKS = 64
# A single space between two visible characters.
_BETWEEN = re.compile(r" (?=\S)(?<=\S )")
# Encoded before new words, so that the first of them follows a word too.
_LEAD = " a"

_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_CHUNK = (
    "chunk bigint, doc_ids array<bigint>, " + ", ".join(f"{n} array<bigint>" for n in _NUMBERS) + ", shas array<string>, "
    "groups array<string>, sizes array<bigint>, places binary, links binary, pairs array<bigint>, docs array<bigint>"
)
_RESULT = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in _NUMBERS) + ", n_best bigint, count_sum bigint, groups_sha256 string"


class ByteLevel:
    """Tokenizer A: ids of a space and the text, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        self._encoder = Encoder(path, plain=True)
        self.spelled = self._encoder.spelled()
        probe = ["ab", " cd", ".", "\n", "ef", "'", " s"]
        self.apart = self._encoder._ids("".join(probe)) == b"".join(map(self._encoder._ids, probe))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encoder._ids(" " + text), "<u4")


class SentencePieces:
    """Tokenizer B: ids of the text, and the bytes of every id.

    Merges never reach over a space or a newline if no piece but runs of spaces holds a
    space behind its start, and none but the newline itself a newline. Scores that are
    ranks make the merges of one word free of those of another.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.spelled = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        probe = ["ab", "ﬁ.", "Å½", "①²", "c'd"]
        self.apart = (
            all(p == "\n" or "\n" not in p and ("▁" not in p[1:] or not p.strip("▁")) for p in pieces)
            and all(model.get_score(i).is_integer() for i in range(len(pieces)))
            and model.encode(" ".join(probe)) == [i for p in probe for i in model.encode(p)]
        )

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), "<u4")


class Aligner:
    """Aligns the two tokenizations of one text after the other."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self._a, self._b = ByteLevel(path_a), SentencePieces(path_b)
        self._apart = self._a.apart and self._b.apart
        self._size_a, self._size_b = ([len(s) for s in t.spelled] for t in (self._a, self._b))
        self._spelled = tuple(np.array(t.spelled, object) for t in (self._a, self._b))
        self._sizes = np.array(self._size_a), np.array(self._size_b)
        self._marked = tuple(np.array([s[:1] == b" " for s in t.spelled]) for t in (self._a, self._b))
        self._name_a, self._name_b = ([str(i) for i in range(len(s))] for s in (self._size_a, self._size_b))
        # Ids as they are shown inside their side of a group and at its end.
        shown = [f"{i}{end}" for i in self._name_a for end in ",|"] + [f"{i}{end}" for i in self._name_b for end in ",;"]
        self._shown, self._shown_size = np.array(shown, object), np.array([len(s) for s in shown])
        self.n_b = len(self._size_b)
        # Windows by their word or their two id tuples.
        self._young: dict[str | tuple[bytes, bytes], tuple] = {}
        self._old: dict[str | tuple[bytes, bytes], tuple] = {}

    def by_word(self, text: str | None) -> Iterator[list[tuple] | None]:
        """The aligned windows in blocks, one window per word; None if words do not tell the whole."""
        if not text:
            return
        if not self._apart or "▁" in text or text[0].isspace():
            yield None
            return
        # A word stands for itself and the space before it, or the newline that it starts with.
        words = text.replace("\n", " \n").split(" ") if _plain(text) else _BETWEEN.split(text)
        for at in range(0, len(words), BLOCK_WINDOWS):
            block = words[at : at + BLOCK_WINDOWS]
            held = list(map(self._young.get, block))
            unknown = dict.fromkeys([w for w, window in zip(block, held) if window is None])
            if unknown:
                fresh = self._words(list(unknown))
                if fresh is None:
                    yield None
                    return
                held = [window or fresh[w] for w, window in zip(block, held)]
            yield held

    def by_anchor(self, text: str) -> Iterator[list[tuple]]:
        """The aligned windows in blocks, cut at anchors; none if a tokenizer does not give back the text."""
        a, b = self._a.encode(text), self._b.encode(text)
        if not self._same(b" " + text.encode(), a, b):
            return
        cut_a, cut_b = self._anchors(a, b)
        raw_a, raw_b = a.tobytes(), b.tobytes()
        known, fresh = self._young.get, self._window
        for at in range(0, len(cut_a) - 1, BLOCK_WINDOWS):
            ia, ib = (c[at : at + BLOCK_WINDOWS + 1] for c in (cut_a, cut_b))
            keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(ia, ia[1:], ib, ib[1:])]
            yield [known(key) or fresh(key) for key in keys]
            known = self._young.get

    def _same(self, whole: bytes, *sides: np.ndarray) -> bool:
        return all(b"".join(spelled[ids].tolist()) == whole for ids, spelled in zip(sides, self._spelled))

    def _words(self, words: list[str]) -> dict[str, tuple] | None:
        """Windows of words that are not among the young ones."""
        found = {w: window for w in words if (window := self._old.get(w))}
        new = [w for w in words if w not in found]
        # White space at the end of a text must not meet the space before another word.
        last = [w for w in new if not w or w[-1].isspace()]
        for some in ([w for w in new if w and not w[-1].isspace()], *([w] for w in last)):
            made = self._together(some) if some else []
            if made is None:
                return None
            found.update(zip(some, made))
        for w, window in found.items():
            self._keep(w, window)
        return found

    def _keep(self, key: str | tuple[bytes, bytes], window: tuple) -> None:
        if window[-2] + window[-1] <= MEMO_IDS:
            if len(self._young) >= MEMO_WINDOWS:
                self._old, self._young = self._young, {}
            self._young[key] = window

    def _together(self, words: list[str]) -> list[tuple] | None:
        """Words encoded as one text and aligned at once; None if their bytes or ends are not all found."""
        spaced = [_LEAD, *[w if w[:1] == "\n" else " " + w for w in words]]
        whole = "".join(spaced)
        sizes = [len(w) for w in spaced] if whole.isascii() else [len(w.encode()) for w in spaced]
        a, b = self._a.encode(whole[1:]), self._b.encode(whole[1:])
        if not self._same(whole.encode(), a, b):
            return None
        end_a, end_b = (np.cumsum(s[i]) for s, i in zip(self._sizes, (a, b)))
        is_end = np.zeros((2, end_a[-1] + 1), bool)
        is_end[0, end_a] = is_end[1, end_b] = True
        # Tokens that end a group, and their places.
        shut_a, shut_b = is_end[1, end_a], is_end[0, end_b]
        last_a, last_b = np.flatnonzero(shut_a), np.flatnonzero(shut_b)
        ends, want = end_a[last_a], np.cumsum(sizes)
        at = np.searchsorted(ends, want)
        if (ends[at] != want).any():
            return None
        from_a, from_b = (np.concatenate([[0], last[:-1] + 1]) for last in (last_a, last_b))
        n_a, n_b = last_a + 1 - from_a, last_b + 1 - from_b
        group_a, group_b = (np.cumsum(shut) - shut for shut in (shut_a, shut_b))
        # As text, each group shows its A ids, then its B ids.
        tokens = np.empty(len(a) + len(b), np.int64)
        tokens[np.arange(len(a)) + from_b[group_a]] = a.astype(np.int64) * 2 + shut_a
        tokens[np.arange(len(b)) + last_a[group_b] + 1] = (b.astype(np.int64) + len(self._name_a)) * 2 + shut_b
        shown = "".join(self._shown[tokens].tolist())
        shown_at = np.cumsum(self._shown_size[tokens])[(last_a + last_b + 1)[at]].tolist()
        # Every A id with all B ids of its group; words with a group of many links are taken alone.
        links = n_a * n_b
        few = links <= _FEW_LINKS
        times = np.where(few, n_b, 0)[group_a]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        codes = np.repeat(a.astype(np.int64) * self.n_b, times) + b[np.repeat(from_b[group_a], times) + step]
        codes = codes.astype("<i8").tobytes()
        code_at = (8 * np.cumsum(np.where(few, links, 0))[at]).tolist()
        many_at = np.cumsum(~few)[at].tolist()
        link_at, a_at, b_at, group_at = (x[at].tolist() for x in (np.cumsum(links), last_a + 1, last_b + 1, np.arange(1, len(ends) + 1)))
        out = []
        for k in range(1, len(at)):
            j = k - 1
            if many_at[k] > many_at[j]:
                out.append(self._aligned(a[a_at[j] : a_at[k]].tobytes(), b[b_at[j] : b_at[k]].tobytes()))
                continue
            out.append((
                shown[shown_at[j] : shown_at[k] - 1], group_at[k] - group_at[j], link_at[k] - link_at[j],
                codes[code_at[j] : code_at[k]], None, a_at[k] - a_at[j], b_at[k] - b_at[j],
            ))
        return out

    def _anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Byte places in the id arrays where windows start, and the end of the last."""
        # Verified: an end that both share, and a marked token behind it on both sides.
        at = [np.flatnonzero(m[i[1:]]) for m, i in zip(self._marked, (a, b))]
        end_a, end_b = (np.cumsum(s[i])[k] for s, i, k in zip(self._sizes, (a, b), at))
        meets = np.searchsorted(end_b, end_a)
        shared = np.flatnonzero(np.append(end_b, -1)[meets] == end_a)
        cuts = at[0][shared], at[1][meets[shared]]
        return tuple([0, *((c + 1) * 4).tolist(), 4 * len(i)] for c, i in zip(cuts, (a, b)))

    def _window(self, key: tuple[bytes, bytes]) -> tuple:
        held = self._old.get(key) or self._aligned(*key)
        self._keep(key, held)
        return held

    def _aligned(self, raw_a: bytes, raw_b: bytes) -> tuple:
        """One window: its groups as text, their number, links, pair codes, their links (None: one each), A and B ids.

        Ids between neighbouring shared ends are a group; both sides stand for the same bytes.
        """
        a, b = memoryview(raw_a).cast("I"), memoryview(raw_b).cast("I")
        size_a, size_b, name_a, name_b, n_b = self._size_a, self._size_b, self._name_a, self._name_b, self.n_b
        shown: list[str] = []
        codes: list[int] = []
        many: list[tuple[int, int]] = []
        i = j = links = 0
        while i < len(a):
            first_a, first_b = i, j
            x, y = a[i], b[j]
            # How far A's end is ahead of B's, in bytes.
            ahead = size_a[x] - size_b[y]
            i, j = i + 1, j + 1
            if not ahead:
                shown.append(f"{name_a[x]}|{name_b[y]}")
                codes.append(x * n_b + y)
                links += 1
                continue
            while ahead:
                if ahead < 0:
                    ahead += size_a[a[i]]
                    i += 1
                else:
                    ahead -= size_b[b[j]]
                    j += 1
            left, right = a[first_a:i].tolist(), b[first_b:j].tolist()
            shown.append(f"{','.join([name_a[x] for x in left])}|{','.join([name_b[y] for y in right])}")
            links += len(left) * len(right)
            if len(left) * len(right) <= _FEW_LINKS:
                codes += [x * n_b + y for x in left for y in right]
            else:
                times = Counter(right).items()
                many += [(x * n_b + y, n * m) for x, n in Counter(left).items() for y, m in times]
        each = None
        if many:
            each = array("q", [1] * len(codes) + [n for _, n in many]).tobytes()
            codes += [c for c, _ in many]
        return ";".join(shown), len(shown), links, array("q", codes).tobytes(), each, len(a), len(b)


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """One row per document with its counts, and its alignment as text if wanted.

    n_best counts the links whose pair is held by most documents among all pairs
    of its A id, count_sum adds up those numbers over all links.
    """
    n_b = _aligner(path_a, path_b).n_b
    chunks = stage(_chunks(docs, path_a, path_b, keep_groups))
    held = chunks.select("chunk", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("docs").alias("docs"))))
    held = held.toDF("chunk", "pair", "docs")
    told = held.select("chunk", "pair").join(pair_counts(held, n_b), "pair").select("chunk", "pair", "count", "best")
    schema = _RESULT + (", groups string" if keep_groups else "")
    out = _arrow_schema(docs.sparkSession, schema)

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([b for row in left.to_pylist() for b in [_told(row, right, out)]], out)

    blobs = chunks.drop("pairs", "docs").groupBy("chunk")
    return blobs.cogroup(told.groupBy("chunk")).applyInArrow(rows, schema)


def pair_counts(held: DataFrame, n_b: int) -> DataFrame:
    """Per pair code the documents that hold it, and whether no pair of its A id is in more.

    A pair code is A id * number of B ids + B id, so an A id has at most that many rows.
    """
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {n_b}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _chunks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool) -> DataFrame:
    schema = _arrow_schema(docs.sparkSession, _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here makes cycles, and looking for them among remembered windows takes long.
        gc.disable()
        try:
            yield from chunks(batches)
        finally:
            gc.enable()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part, made = _aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((doc, *_document(aligner, text, keep_groups)))
                size += len(rows[-1][-1])
                if size >= CHUNK_PAIRS or len(rows) >= CHUNK_DOCS:
                    yield pa.RecordBatch.from_pylist([_chunk(part << 32 | made, rows)], schema)
                    rows, size, made = [], 0, made + 1
        if rows:
            yield pa.RecordBatch.from_pylist([_chunk(part << 32 | made, rows)], schema)

    return slim(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _CHUNK)


def _document(aligner: Aligner, text: str | None, keep_groups: bool) -> tuple:
    return _folded(aligner.by_word(text), keep_groups) or _folded(aligner.by_anchor(text), keep_groups)


def _folded(blocks: Iterator[list[tuple] | None], keep_groups: bool) -> tuple | None:
    """The row of a document from its windows; None if they cannot be had this way."""
    n_a, n_b, sha, shown, n_groups, n_links = 0, 0, hashlib.sha256(), [], 0, 0
    codes, links = [], []
    for windows in blocks:
        if windows is None:
            return None
        names, groups, linked, coded, each, of_a, of_b = zip(*windows)
        told = ";".join(names)
        sha.update((";" if n_groups else "").encode() + told.encode())
        n_a, n_b, n_groups, n_links = n_a + sum(of_a), n_b + sum(of_b), n_groups + sum(groups), n_links + sum(linked)
        if keep_groups:
            shown.append(told)
        times = None
        if any(each):
            times = np.frombuffer(b"".join([e or array("q", [1] * (len(c) // 8)).tobytes() for c, e in zip(coded, each)]), "<i8")
        c, n = _summed(np.frombuffer(b"".join(coded), "<i8"), times)
        codes.append(c)
        links.append(n)
    if len(codes) != 1:
        codes, links = ([np.concatenate([np.zeros(0, np.int64), *v])] for v in (codes, links))
        codes[0], links[0] = _summed(codes[0], links[0])
    return n_a, n_b, n_groups, n_links, sha.hexdigest() if n_groups else "", ";".join(shown), links[0], codes[0]


def _summed(codes: np.ndarray, links: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the links of each; None counts every code once."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if links is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes)
        codes, links = codes[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(first, append=len(codes)) if links is None else np.add.reduceat(links, first)


def _chunk(number: int, rows: list[tuple]) -> dict:
    codes = np.concatenate([r[-1] for r in rows])
    pairs, places = np.unique(codes, return_inverse=True)
    return {
        "chunk": number,
        "doc_ids": [r[0] for r in rows],
        **{n: [r[k] for r in rows] for k, n in enumerate(_NUMBERS, 1)},
        "shas": [r[5] for r in rows],
        "groups": [r[6] for r in rows],
        "sizes": [len(r[-1]) for r in rows],
        # Places grow within a document, so their steps are small.
        "places": _packed(np.diff(places, prepend=0)),
        "links": _packed(np.concatenate([r[-2] for r in rows])),
        "pairs": pairs.tolist(),
        "docs": np.bincount(places, minlength=len(pairs)).tolist(),
    }


def _packed(numbers: np.ndarray) -> bytes:
    """Signed 64-bit numbers with like bytes side by side, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view("u1").reshape(-1, 8).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), "u1").reshape(8, -1).T).view("<i8").ravel()


def _told(row: dict, told: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    """The documents of one chunk with the counts of their pairs."""
    order = np.argsort(told.column("pair").to_numpy())
    count = told.column("count").to_numpy()[order]
    best = told.column("best").to_numpy(zero_copy_only=False)[order]
    places, links = np.cumsum(_unpacked(row["places"])), _unpacked(row["links"])
    sizes = np.array(row["sizes"], np.int64)
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (links * best[places], links * count[places])]
    ends = np.cumsum(sizes)
    n_best, count_sum = (s[ends] - s[ends - sizes] for s in sums)
    columns = [row["doc_ids"], *(row[n] for n in _NUMBERS), n_best, count_sum, row["shas"], row["groups"]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
