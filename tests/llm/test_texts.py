"""Operators that look at each text alone: private data, secrets, tokens, token files."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dqstream.llm import privacy, secrets, token_files
from dqstream.llm.eliasfano import EliasFano
from dqstream.llm.encoder import Encoder
from dqstream.llm.queries import all_queries

from .rows import TEXTS, none, odd

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "@", ".", "1", "2", "25", "255", " ", "-", "+", "(", ")", "token", "=", '"', "AKIA", "Z9", "f0", "\n",
          "é", "ſ", "K", "%", "com", "4", "0", "api_key", "TOKEN", ":", "0123456789abcdef", "QZ7x", "/"]


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def private(text):
    """The base patterns, word for word."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def secret(text):
    names = "password passwd secret token api_?key".split()
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in names)
    kinds = ["assign", "access", "hex"]
    found = [
        ("assign", *m.span())
        for m in re.finditer(rf"({either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text)
        if len(m[2]) >= 6
    ]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda f: (f[1], kinds.index(f[0])))


def written(found):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        assert [(privacy.KINDS[k], s, e) for k, s, e in sorted(privacy.base_spans(text))] == private(text)
        base, every = secrets.spans_of(text)
        assert secrets.shown(base) == written(secret(text))
        assert set(base) <= set(every) and every == sorted(every)


def test_scans_are_linear_in_the_text():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000, "token" + " " * 200_000, "a@" * 100_000, "+1" * 100_000):
        privacy.candidates(text)
        secrets.spans_of(text)


@pytest.mark.parametrize("name", ["op1_private_data", "op2_secret_entropy"])
def test_every_document_is_scanned(spark, sf_dir, name):
    brute = private if name.startswith("op1") else secret
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in all_queries()[name](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = written(brute(text))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_labelers_are_told_apart_and_candidates_are_added():
    """Cells of a text with good and bad candidates; the estimate follows the better labelers."""
    good = ["tel 212 555-0187 home", "call (212) 555-0187, please", "ssn 219-09-9999 is mine", "Dr. Anna Kowalski wrote"]
    bad = ["order 000-00-0000x", "x=912-00-1234_7", "version 1.2.3.4x"]
    cells = [c[3] for t in good * 30 + bad * 5 for c in privacy.candidates(t)]
    values, counts = np.unique(np.array(cells, np.int64), return_counts=True)
    truth, trust = privacy.estimate(values, counts)
    assert ((0 <= truth) & (truth <= 1)).all() and np.allclose(trust.sum(axis=1), 1)
    accept = privacy.accepted(values, counts)
    assert all(c[3] in accept for t in good for c in privacy.candidates(t))
    assert privacy.accepted(np.zeros(0, np.int64), np.zeros(0, np.int64)) == set()


def entropy(window):
    shares = [window.count(c) / len(window) for c in set(window)]
    return -sum(s * math.log2(s) for s in shares)


@given(st.text(alphabet="abcXYZ0129+/", min_size=0, max_size=120))
@settings(max_examples=200, deadline=None)
def test_sliding_entropy_equals_counting_anew(run):
    want = set()
    for i in range(len(run) - secrets.WIDTH + 1):
        window = run[i : i + secrets.WIDTH]
        mixed = sum(c.isdigit() for c in window) >= 2 and sum(c.isalpha() for c in window) >= 2
        if mixed and entropy(window) >= 2.9 - 1e-12:
            want.update(range(i, i + secrets.WIDTH))
    got = {i for s, e in secrets.windows(run, 2.9) for i in range(s, e)}
    assert got == want


def test_entropy_adds_spans_and_the_allow_list_takes_them_back():
    key = "kJ8s2Lq0ZpX7vB3nWm5R"
    assert secrets.by_entropy(f"use {key} here") == [(4, 3, 24)]
    for text in ("id 123e4567-e89b-12d3-a456-426614174000", f"https://host/{key}", f"sha256-{key}", "EXAMPLE" + key):
        assert secrets.by_entropy(text) == []
    assert secrets.by_entropy("Donaudampfschifffahrtsgesellschaft 12345678901234567890") == []
    assert secrets.masked('x token = "abcdef123" y') == 'x token = "[SECRET]" y'
    assert secrets.masked(None) is None and secrets.masked("plain") == "plain"


def test_the_allow_list_takes_back_only_what_it_overlaps():
    key, uuid = "kJ8s2Lq0ZpX7vB3nWm5R", "123e4567-e89b-12d3-a456-426614174000"
    texts = [f"{uuid}/{key}", f"{key}/{uuid}", f"sample_key={key}", f"{key}/placeholder", f"xxxxxx-{key}", f"https://user:{key}@host/x",
             f"https://{key}@host", f"https://host/{'a' * 30}?key={key}", f"https://host/p?u=https://other/p&key={key}", f"https://a/1,https://user:{key}@b", f"https://host/p#t={key}",
             f"sha256:{'0123456789abcdef' * 4}/{key}"]
    for text in texts:
        at = text.index(key)
        found = secrets.by_entropy(text)
        assert any(s <= at and at + len(key) <= e for s, _, e in found), text
        assert key not in secrets.masked(text)
        assert uuid not in text or uuid in secrets.masked(text)
    for text in (f"{uuid}/{uuid}", f"https://host/a/{key}/b", f"https://user@host/{key}", f"https://{key}.host:80/", f"x_sample{key}_y", f"md5:{key}", f"http://a,https://host/{key}"):
        assert secrets.by_entropy(text) == [], text
    for text in ("a://" * 50_000, "sample_" * 30_000 + key, f"https://h/{key} " * 5_000, "://" + "a" * 200_000 + key):
        secrets.masked(text)


def test_encoder_gives_the_ids_of_the_library(spark, sf_dir):
    plain, own = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    odd_texts = [" a", "a ", "a\n", "\na", " ", "\n", "a \n b", "don't we'll x.\nY's", "a\tb c", "x  y", "é́ a", "1,234.5 x² ½",
                 "a,\n.b", ". , .,", "a\r\nb", "A\x1cb \x1c c", "日本語 テキスト。\nです", *[t or "" for _, t in TEXTS]]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    for text in odd_texts + [r["text"] for r in rows]:
        want = plain.encode(text, add_special_tokens=False).ids
        for _ in range(2):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == want


@given(st.lists(st.integers(0, 1 << 40), max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values):
    values.sort()
    code = EliasFano.of(np.array(values, np.int64))
    assert code.all().tolist() == values
    for i in range(0, len(values), 37):
        assert code.select(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    code = EliasFano.of(ends)
    assert len(code.lows) + len(code.highs) + len(code.samples) < 10_000 * 14 / 8


def encoded(text, end):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files_round_trip(spark, sf_dir, tmp_path):
    got = sorted(all_queries()["op10_token_files"](spark, sf_dir).collect())
    start = 0
    for row, doc in zip(got, spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()):
        ids = encoded(doc["text"], 2)
        raw = np.array(ids, "<u4").tobytes()
        assert tuple(row) == (doc["doc_id"], start, len(ids), zlib.crc32(raw))
        start += len(ids)
    path = str(tmp_path / "odd")
    token_files.write_tokens(odd(spark), path, VOCABULARY)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in rows) == sorted(
        (i is not None, i or 0, tuple(encoded(t, 2))) for i, t in TEXTS
    )
    known = [r["doc_id"] for r in rows]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:])
    empty = str(tmp_path / "none")
    token_files.write_tokens(none(spark), empty, VOCABULARY)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_scans_take_odd_rows(spark):
    for rows in (privacy.find(odd(spark)), secrets.scan(odd(spark))):
        assert rows.count() == len(TEXTS)
    assert privacy.find(none(spark)).count() == secrets.scan(none(spark)).count() == 0
    masked = secrets.mask(odd(spark))
    assert masked.columns == odd(spark).columns
    assert sorted(str(r["text"]) for r in masked.collect()) == sorted(str(secrets.masked(t)) for _, t in TEXTS)


def test_parts_of_an_address_may_have_many_zeros(spark):
    texts = ["0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "255", "1.2.3." + "0" * 5000, "9" * 5000 + ".1.1.1"]
    got = privacy.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["n_ip"]) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 0)]
