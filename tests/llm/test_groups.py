"""Operators that compare rows: near-duplicates, decontamination, shards, packing."""

from __future__ import annotations

import collections
import gc
import hashlib
import math
import re
import tracemalloc
import weakref
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from dqstream.llm import decontam, packing, queries, sharding, simhash, vectors
from dqstream.llm.components import components

from .rows import TEXTS, none, odd

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    edges += [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    sets = Sets({n for e in edges for n in e})
    for a, b in edges:
        sets.link(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: sets.find(n) for n in got} and len(got) >= 70
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_trie_walk_equals_all_pairs():
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for c in centres for _ in range(40)]
    keys = np.unique(np.array(keys, np.uint64))
    walked = simhash.walk(keys, [(0, len(keys), 0)])
    sets = Sets(range(len(keys)))
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 4) + i + 1:
            sets.link(i, int(j))
    assert walked.root.tolist() == [sets.find(i) for i in range(len(keys))]


def test_simhash_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: simple_fingerprint(t) for i, t in docs.items()}
    sets = Sets(docs)
    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                sets.link(a, b)
    got = queries.op8_simhash_trie(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == {(i, f"{prints[i]:016x}", sets.find(i)) for i in docs}


def test_simhash_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(TEXTS)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {3}
    kept = simhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "5", "6", "7", "None"]
    assert simhash.near_duplicates(none(spark)).count() == simhash.one_of_each(none(spark)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_of(text, items):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for name, other in items:
        own = WORD.findall(lower(other))
        k = min(10, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else ()
        for i in range(len(words) - k + 1 if own else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("null" if name is None else str(name))
    names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), names, bool(hit)


def test_decontamination_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:6] for r in queries.op7_suffix_array_decontamination(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: hits_of(r["text"], items) for r in docs}
    assert any(g[4] for g in got.values())


def test_longest_matches_and_their_places(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdx"), rng.integers(0, 40))) for _ in range(60)]
    texts += ["w1 w2 w3 w4 w5 w6", "a a a a a a a a", None]
    items = [" ".join(rng.choice(list("abcd"), n)) for n in (1, 2, 3, 4, 5, 9, 14, 30)]
    items += ["w1 w2 w3 w4 w5", "w3 w4 w5 w6", "a a a a a a a", ""]
    benchmark = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string").coalesce(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    split = [t.split() for t in items]

    def longest(words):
        best = (0, 0)
        for i in range(len(words)):
            for item in split[1:]:
                for p in range(len(item)):
                    n = 0
                    while i + n < len(words) and p + n < len(item) and words[i + n] == item[p + n]:
                        n += 1
                    if n >= min(4, len(item)) and n:
                        best = max(best, (n, -i))
        return (best[0], -best[1]) if best[0] else (0, None)

    benchmark = benchmark.filter("item_id <> '0'")
    for most in (decontam.BLOCK_WORDS, 12):
        real = decontam.blocks_of
        monkeypatch.setattr(decontam, "blocks_of", lambda b, most=most, real=real: real(b, most))
        for r in decontam.find_contamination(docs, benchmark, window=4).collect():
            words = (texts[r["doc_id"]] or "").split()
            assert (r["longest"], r["longest_at"]) == longest(words)
            if r["longest"]:
                n, i, p = r["longest"], r["longest_at"], r["longest_place"]
                assert words[i : i + n] == split[int(r["longest_item"])][p : p + n]
            else:
                assert r["longest_item"] is None and r["longest_place"] is None and not r["contaminated"]
        monkeypatch.setattr(decontam, "blocks_of", real)


def test_decontamination_of_odd_rows_and_short_items(spark, monkeypatch):
    items = [(1, "brown fox"), (2, None), (3, "..."), (None, "lazy dog"), (4, "The QUICK brown fox jumps over the lazy dog near the river"),
             (5, "dog"), (5, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (6, "ipsum sit")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    want = sorted((hits_of(t, items) for _, t in TEXTS), key=str)
    # In one block, and in several of a few words each.
    for words in (decontam.BLOCK_WORDS, 6):
        real = decontam.blocks_of
        monkeypatch.setattr(decontam, "blocks_of", lambda b, most=words: real(b, most))
        got = [tuple(r)[1:6] for r in decontam.find_contamination(odd(spark), benchmark).collect()]
        monkeypatch.undo()
        assert sorted(got, key=str) == want
    kept = decontam.decontaminate(odd(spark), benchmark)
    assert kept.columns == odd(spark).columns and kept.count() == sum(not w[4] for w in want)
    assert decontam.find_contamination(none(spark), benchmark).count() == 0
    nothing = benchmark.limit(0)
    assert decontam.decontaminate(odd(spark), nothing).count() == len(TEXTS)


@pytest.mark.parametrize("repeats", [False, True])
def test_memory_of_a_block_grows_with_its_words(repeats):
    """One very long item, whole in one text and in part in another, beside short ones."""
    rng = np.random.default_rng(5)
    long = "again and over " * 1000 if repeats else " ".join(f"w{i}" for i in rng.integers(0, 900, 3000))
    items = [("long", long), ("short", " ".join(f"s{i}" for i in range(12))), ("tiny", "s3 w5")]
    texts = ["x " + long + " y", " ".join(long.split()[100:115]), "s3 w5 w5", None, "s1 s2 s3"]
    block = decontam.Block()
    for name, text in items:
        block.add(name, decontam.words_of(text))
    tracemalloc.start()
    shard = decontam.Shard(block, decontam.WINDOW)
    for i, text in enumerate(texts):
        shard.add(i, decontam.words_of(text))
    doc, word, size, item, longest = shard.hits()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i, text in enumerate(texts):
        own = doc == i
        hit = {k for w, n in zip(word[own], size[own]) for k in range(w, w + n)}
        found = sorted({block.ids[k] for k in item[own]})
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (len(hit), len(found), digest, bool(hit)) == hits_of(text, items)[1:]
    assert longest[0] == 3000
    assert peak < (120 << 20 if repeats else 6 << 20)


def test_a_task_has_one_block_at_a_time(monkeypatch):
    alive = []

    class Shared:
        def __init__(self, block):
            self._path, self.block = "x", block

        @property
        def value(self):
            gc.collect()
            alive.append(sum(s() is not None for s in made))
            return self.block

    made, real = [], decontam.Shard.__init__
    monkeypatch.setattr(decontam.Shard, "__init__", lambda self, *a: (made.append(weakref.ref(self)), real(self, *a))[1])
    blocks = []
    for name in "abc":
        blocks.append(decontam.Block())
        blocks[-1].add(name, [name.encode()] * 3)
    held = [pa.record_batch({"text": ["a a a", None, "b b b b", "c c c"]})]
    got = [(ids, hits[0].tolist()) for ids, hits in decontam.Passes([Shared(b) for b in blocks], 3).hits(held, 0)]
    assert got == [(["a"], [0]), (["b"], [2, 2]), (["c"], [3])]
    assert alive == [0, 0, 0]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 300):
        text = np.concatenate([rng.integers(1, 4, n), [0]]).astype(np.int32)
        order = decontam.suffix_array(text)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def cosine_links(rows, threshold=0.93):
    usable = [
        (i, np.array(v, float) / np.abs(v).max(), label)
        for i, v, label in rows
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    n, sets = collections.Counter(), Sets([r[0] for r in rows])
    for a, (i, v, label) in enumerate(usable):
        for j, w, other in usable[a + 1 :]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                n[i] += 1
                n[j] += 1
                sets.link(i, j)
    return {(i, n[i], sets.find(i), sets.find(i) == i) for i, _, _ in rows}


def test_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * rng.choice([0, 0.1, 0.3])).tolist(), int(i % 12 % 3)) for i in range(240)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 24, 1), (303, [float("nan")] * 24, 1), (304, [None, 1.0], 1),
             (305, [1.0] * 24, None), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [1e200, 1e200], 2), (309, [2e200, 2e200], 2)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS n", "2 AS cid", "3 AS links")
    got = {tuple(r) for r in vectors.near_duplicates(table).collect()}
    assert got == cosine_links(rows)
    assert max(r[1] for r in got) > 5
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_tiles_stop_early_without_loss():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 64))
    x = vectors.unit_rows((np.concatenate([base, base + rng.normal(size=base.shape) * 0.2])).tolist())
    turned = x @ np.linalg.eigh(x.T @ x)[1][:, ::-1]
    got = set(zip(*(c.tolist() for c in vectors.close_pairs(turned, turned, 0.93)[:2])))
    want = set(zip(*(c.tolist() for c in np.nonzero(x @ x.T >= 0.93))))
    assert got == want


def test_pairs_at_the_threshold_are_judged_by_the_given_vectors(spark):
    side = [93.0, 1351**0.5]
    over, under = [93.0, 1351**0.5 * (1 - 1e-12)], [93.0, 1351**0.5 * (1 + 1e-12)]
    rows = [(i, v, i // 10) for k, pair in enumerate([([1.0, 0.0], side), ([1.0, 0.0], over), ([2.0, 0.0], under)])
            for i, v in enumerate([*pair, pair[0]], 10 * k)]
    # A ring whose neighbours lie close to the threshold on both sides.
    step = math.acos(0.93)
    rows += [(100 + i, [math.cos(i * step * f), math.sin(i * step * f)], 9) for i, f in enumerate([1, 1, 1 + 1e-12, 1 - 1e-12, 1, 1 + 1e-15])]
    got = {tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}

    def cosine(x, y):
        return sum(p * q for p, q in zip(x, y)) / (math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y)))

    for i, v, label in rows:
        n = sum(j != i and label == other and cosine(v, w) >= 0.93 for j, w, other in rows)
        assert next(r[1] for r in got if r[0] == i) == n
    assert {r[0]: r[1] for r in got}[1] == 2 and {r[0]: r[1] for r in got}[11] == 2 and {r[0]: r[1] for r in got}[21] == 0


def test_embedding_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op4_embedding_tiles(spark, sf_dir).collect()} == cosine_links(rows)


def test_shards_equal_sql_and_fit(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = queries.all_sql()["op6_extendible_shards"].replace(f"<= {sharding.LIMIT}", "<= 20000")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall())
    placed = sharding.shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20_000)
    got = sorted(tuple(r[c] for c in sorted(names)) for r in placed.collect())
    assert got == want and all(r[sorted(names).index("shard_bytes")] <= 20_000 for r in got)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    entries = sorted((r["first_hash"], r["last_hash"]) for r in sharding.directory(placed).collect())
    assert all(a[1] < b[0] for a, b in zip(entries, entries[1:]))


def test_shards_of_odd_rows(spark):
    rows = sharding.shards(odd(spark), 100).collect()
    assert len(rows) == len(TEXTS)
    assert all(r["shard_bytes"] <= 100 or r["shard_docs"] == 1 for r in rows)
    # Two equal rows of 68 bytes part by page only.
    assert len({r["page"] for r in rows if r["doc_id"] == 2}) == 2
    assert sharding.shards(none(spark)).count() == 0


def check_packed(rows):
    by_document, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_document[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for (_, tokens), own in by_document.items():
        assert sum(n for _, n in own) % tokens == 0
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    return len(by_sequence), sum(r["length"] for r in rows)


def test_packing_query(spark, sf_dir):
    rows = queries.op3_packing(spark, sf_dir).collect()
    sequences, tokens = check_packed(rows)
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} == ids
    assert tokens / (sequences * packing.WINDOW) > 0.97


def test_packing_of_odd_rows(spark):
    rows = packing.pack(packing.pieces(odd(spark), VOCABULARY)).collect()
    check_packed(rows)
    ends = [r for r in rows if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == len(TEXTS)


def test_a_length_that_most_share_is_cut(spark):
    """Pieces of 1,100 tokens cannot pair; cut ones carry the checksum of what they hold."""
    text = " the" * 1099
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id bigint, text string")
    rows = packing.pack(packing.pieces(docs, VOCABULARY)).collect()
    sequences, tokens = check_packed(rows)
    assert tokens == 60 * 1100 and tokens / (sequences * packing.WINDOW) > 0.97 and len(rows) > 60
    ids = np.array(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids + [1], "<u4")
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.pack(packing.pieces(none(spark), VOCABULARY)).count() == 0


def test_least_squares_is_optimal():
    rng = np.random.default_rng(8)
    for _ in range(10):
        a, b = rng.random((12, 20)), rng.random(12)
        x = packing.nnls(a, b, 1e-9)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-5 and np.abs(gain[x > 0]).max() < 1e-5


@pytest.mark.parametrize("kind", ["even", "one", "long", "tiny"])
def test_plan_uses_every_piece_once(kind):
    rng = np.random.default_rng(1)
    histogram = {
        "even": {b: int(rng.integers(0, 300)) for b in range(1, 257)},
        "one": {150: 1001},
        "long": {b: 50 for b in range(200, 257)},
        "tiny": {1: 10_000, 2: 3},
    }[kind]
    plan = packing.solve(histogram)
    bins = np.concatenate([np.full(n, b) for b, n in histogram.items()])
    rank = np.concatenate([np.arange(n) for n in histogram.values()])
    sequence, slot, cut = packing.place(plan, bins, rank, 256)
    assert len({*zip(sequence.tolist(), slot.tolist())}) == len(bins)
    room = np.bincount(sequence, np.where(cut > 0, cut, bins), plan.sequences)
    room += np.bincount(sequence[cut > 0] + 1, (bins - cut)[cut > 0], plan.sequences)
    assert room.max() <= 256 and (room > 0).all()
    ideal = sum(b * n for b, n in histogram.items()) / 256
    assert plan.sequences <= ideal * 1.01 + 2
