"""Cross-tokenizer alignment against both libraries and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from dqstream.llm import alignment
from dqstream.llm.queries import PIECES, VOCABULARY, all_queries

from .rows import none, odd

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokens():
    """Functions from a text to (id, bytes) of both tokenizers."""
    byte_level = Tokenizer.from_file(VOCABULARY)
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def a(text):
        coded = byte_level.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(letter[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]

    def b(text):
        named = [(i, pieces.id_to_piece(i)) for i in pieces.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named]

    return a, b


def ends(coded):
    at, out = 0, []
    for _, raw in coded:
        at += len(raw)
        out.append(at)
    return out


def groups(text, tokens):
    if not text:
        return 0, 0, []
    a, b = (t(text) for t in tokens)
    if any(b"".join(raw for _, raw in c) != b" " + text.encode() for c in (a, b)):
        return 0, 0, []
    cuts = sorted({0} | (set(ends(a)) & set(ends(b))))
    sides = [list(zip([i for i, _ in c], ends(c))) for c in (a, b)]
    at = {cut: k for k, cut in enumerate(cuts)}
    out = [([], []) for _ in cuts[1:]]
    for side, named in enumerate(sides):
        group = 0
        for i, end in named:
            out[group][side].append(i)
            group += end in at
    return len(a), len(b), out


def plain(docs, tokens):
    made, counts = [], Counter()
    for doc, text in docs:
        n_a, n_b, held = groups(text, tokens)
        links = [(x, y) for left, right in held for x in left for y in right]
        counts.update(set(links))
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in held)
        made.append((doc, n_a, n_b, len(held), links, hashlib.sha256(shown.encode()).hexdigest() if held else ""))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return key_sorted(
        (doc, n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha)
        for doc, n_a, n_b, n_groups, links, sha in made
    )


def key_sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v or 0) for v in r[:-1]))


def test_the_query_gives_what_the_libraries_give_on_the_whole_table(spark, sf_dir, tokens):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = all_queries()["op12_token_alignment"](spark, sf_dir).select(*COLUMNS).collect()
    assert key_sorted(got) == plain(docs, tokens)


ODD = ["  two  spaces ", "a▁b", "<|endoftext|> <s>", "<0x41>", "naïve 日本語 😀😀", "\n\n x", "x\x00y", "aaaa" * 50 + " b", "日" * 90, "́" * 300 + "🙂" * 40, " ", "́ é"]


def test_odd_texts_blocks_and_chunks(spark, tokens, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD, None, ""])] + [(None, "no id"), (3, "three again"), (3, "three again")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = alignment.align(frame, VOCABULARY, PIECES, keep_groups=True)
    assert key_sorted(got.select(*COLUMNS).collect()) == plain(rows, tokens)
    for r in got.collect():
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
    one = next(r for r in got.collect() if r["doc_id"] == 1)
    assert (one["n_a"], one["groups"]) == (0, "")
    # Windows in blocks give the same as all at once.
    aligner = alignment.Aligner(VOCABULARY, PIECES)
    text = " ".join(["some words", *ODD[4:8]] * 20)
    whole = alignment._document(aligner, text, True)
    monkeypatch.setattr(alignment, "BLOCK_WINDOWS", 7)
    monkeypatch.setattr(alignment, "MEMO_WINDOWS", 3)
    cut = alignment._document(alignment.Aligner(VOCABULARY, PIECES), text, True)
    assert cut[:6] == whole[:6]
    assert all((x == y).all() for x, y in zip(cut[6:], whole[6:]))


def test_chunks_of_any_size_tell_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).coalesce(1)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    aligner = alignment.Aligner(VOCABULARY, PIECES)
    held = [(d, *alignment._document(aligner, t, False)) for d, t in rows]
    for size in (1, 7, 40):
        chunks = [alignment._chunk(k, held[k : k + size]) for k in range(0, 40, size)]
        counts = Counter()
        for c in chunks:
            counts.update(dict(zip(c["pairs"], c["docs"])))
        assert counts == Counter(p for r in held for p in r[-1].tolist())
        for c, k in zip(chunks, range(0, 40, size)):
            places = alignment._unpacked(c["places"]).cumsum()
            assert [c["pairs"][p] for p in places] == [p for r in held[k : k + size] for p in r[-1].tolist()]


def test_odd_rows_and_an_empty_table(spark, tokens):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = alignment.align(odd(spark), VOCABULARY, PIECES).select(*COLUMNS).collect()
    assert key_sorted(got) == plain(rows, tokens)
    assert alignment.align(none(spark), VOCABULARY, PIECES).count() == 0


EDGES = ["x ", "x\n", "x\n y", "x\n\ny z", "a  b c   d ", "\ta b", " lead", "it's we'll.\nIt's", "a\u00a0b \u3000c d", "ends▁ here", "\n", "a b\x1c c", "日本 " + "日" * 30 + " 語\n日本", "end \n"]


def test_words_tell_what_anchors_tell(tokens):
    for order in (1, -1):
        aligner = alignment.Aligner(VOCABULARY, PIECES)
        for text in [*ODD, *EDGES, " ".join([*EDGES, *ODD]), "\n".join(["x", *ODD[3:9]])][::order]:
            by_anchor = alignment._folded(aligner.by_anchor(text), True)
            n_a, n_b, held = groups(text, tokens)
            shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in held)
            links = Counter(x * aligner.n_b + y for left, right in held for x in left for y in right)
            for got in (by_anchor, alignment._document(aligner, text, True)):
                assert got[:4] == (n_a, n_b, len(held), sum(links.values())) and got[5] == shown
                assert dict(zip(got[7].tolist(), got[6].tolist())) == links


def test_known_words_are_not_encoded_again(monkeypatch):
    aligner, seen = alignment.Aligner(VOCABULARY, PIECES), []
    for kind in (alignment.ByteLevel, alignment.SentencePieces):
        plain_encode = kind.encode
        monkeypatch.setattr(kind, "encode", lambda self, text, f=plain_encode: seen.append(text) or f(self, text))
    alignment._document(aligner, "They know some words of a text.\nThey come again.", False)
    assert seen
    seen.clear()
    text = "They come again. some words know\nThey a text.\nThey"
    known = alignment._document(aligner, text, True)
    assert not seen
    assert known[:6] == alignment._folded(aligner.by_anchor(text), True)[:6]
    # New words of a text go together, behind a word that leads them.
    seen.clear()
    alignment._document(aligner, "Some unseen words come unheard again.", False)
    assert [t.split()[1:] for t in seen] == [["Some", "unseen", "unheard"]] * 2
    # Where words do not tell the whole, texts go whole.
    monkeypatch.setattr(aligner, "_apart", False)
    seen.clear()
    assert alignment._document(aligner, "They come again.", True)[0] and seen == ["They come again."] * 2


def test_words_that_come_back_other_are_judged_with_the_whole_text(monkeypatch):
    aligner = alignment.Aligner(VOCABULARY, PIECES)
    plain_encode = alignment.SentencePieces.encode
    monkeypatch.setattr(alignment.SentencePieces, "encode", lambda self, text: plain_encode(self, text.replace("ﬁ", "fi")))
    assert alignment._document(aligner, "good ﬁne words", True)[:6] == (0, 0, 0, 0, "", "")
    assert alignment._document(aligner, "good fine words", True)[2] > 0
