"""Personal data by weak supervision.

Fixed patterns give the base spans. Wider patterns propose further candidates,
and five labelers vote on every candidate, base ones too: a strict form check, a
gazetteer, the words before it, the characters around it, and its size. A vote is
yes, no or nothing. Candidates are counted per cell (kind, votes, shape), which
is a fixed number of cells however many documents there are. Over those counts
expectation-maximisation estimates how far each labeler can be trusted and how
likely each cell is personal data; a span classifier is then fitted to these
likelihoods from kind, votes and shape. Candidates that it accepts are added to
the base spans, which always stay.

Nulls: a null text holds nothing; a null doc_id is carried along. Equal rows are
scanned alike and both count. An empty table gives no rows, a table without
candidates a classifier that accepts nothing. Texts are read whole, in time
linear in their length. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import Reach, _arrow_schema, per_row
from dqstream.plans.stage import stage

# Base kinds first; the others are candidates only.
KINDS = ("email", "ip", "card", "phone", "written_email", "number", "local_phone", "social", "name")
BASE = 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No match starts inside a run of digits unless one starts with it, so starts there are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?")

# Gazetteers.
_ENDINGS = frozenset("com org net edu gov io de fr es uk info biz eu ch at it nl".split())
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
_GIVEN = frozenset("James Mary John Anna Peter Maria Paul Laura David Sarah Thomas Julia Carlos Lucia Pierre Marie Hans Eva".split())
_FOR = re.compile(r"\b(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|social security|address|host|name)\b[^.\n]{0,20}$", re.IGNORECASE)
_AGAINST = re.compile(r"\b(?:version|isbn|issn|order|invoice|ref|section|chapter|part|build|release|id|no)\b\.?[^.\n]{0,12}$", re.IGNORECASE)

LABELERS = 5
SHAPES = 6
# Accept a candidate from this likelihood on.
ACCEPT = 0.5

Candidate = tuple[int, int, int, int]  # kind, start, end, cell


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns."""
    found = [(0, s, e) for s, e in _emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    found += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def candidates(text: str | None) -> list[Candidate]:
    """Base spans and further candidates, each with its cell."""
    text = text or ""
    spans = base_spans(text)
    taken = Reach((s, e) for _, s, e in spans)
    more = []
    if "(" in text or "[" in text:
        more += [(4, m.start(), m.end()) for m in _WRITTEN.finditer(text)]
    more += [(5, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19]
    more += [(6, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    more += [(7, m.start(), m.end()) for m in _SOCIAL.finditer(text)]
    more += [(8, m.start(), m.end()) for m in _NAME.finditer(text)]
    for kind, s, e in more:
        if taken.until(e) <= s:
            spans.append((kind, s, e))
    return [(k, s, e, cell(text, k, s, e)) for k, s, e in sorted(spans)]


def cell(text: str, kind: int, start: int, end: int) -> int:
    """Kind, five votes and six bits of shape as one number."""
    code = kind
    for vote in votes(text, kind, start, end):
        code = code * 3 + vote + 1
    for bit in shape(text, start, end):
        code = code * 2 + bit
    return code


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """What each labeler says: 1 personal data, -1 not, 0 nothing."""
    own, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 48) : start]
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    if kind == 0:
        ending = own.rpartition(".")[2].lower()
        form, known = 1 if ending.isalpha() and len(ending) >= 2 else -1, 1 if ending in _ENDINGS else -1
        size = 1 if len(own) <= 64 else -1
    elif kind == 1:
        parts = own.split(".")
        form = 1 if all(p == (p.lstrip("0") or "0") for p in parts) else -1
        known = -1 if parts[0] in ("0", "10", "127", "255") or parts[:2] == ["192", "168"] else 1
        size = 1 if len(digits) >= 6 else -1
    elif kind in (2, 5):
        form, known = 1 if luhn(digits) else -1, 1 if digits[0] in "3456" else -1
        size = 1 if len(digits) in (15, 16) else -1
    elif kind in (3, 6):
        form = 1 if len(digits) >= 10 else -1
        known = 0 if kind == 6 else 1 if digits.startswith(_COUNTRIES) else -1
        size = 1 if len(own) - len(digits) >= 2 else 0
    elif kind == 7:
        form = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1
        known, size = 0, 1
    elif kind == 8:
        form, known, size = 1, 1 if own.split()[1] in _GIVEN else 0, 1 if own.count(" ") == 2 else 0
    else:
        form, known, size = 1, 1 if own.rpartition(".")[2].strip().lower() in _ENDINGS else 0, 1 if len(own) <= 80 else -1
    context = 1 if _FOR.search(before) else -1 if _AGAINST.search(before) else 0
    edges = -1 if any(c.isalnum() or c in "_@#=/" for c in around) else 1
    return [form, known, context, edges, size]


def shape(text: str, start: int, end: int) -> list[int]:
    own = text[start:end]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    return [
        int(any(c.isalpha() for c in own)),
        int(len(own) > 16),
        int(" " in own or "-" in own),
        int(not before or before == "\n"),
        int(before in ('"', "'", "=", ":") and before != ""),
        int(not after or after in ".,;:)\n"),
    ]


def decode(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and shapes of cells."""
    shapes = np.stack([cells >> (SHAPES - 1 - i) & 1 for i in range(SHAPES)], axis=1)
    rest = cells >> SHAPES
    said = np.stack([rest // 3 ** (LABELERS - 1 - i) % 3 - 1 for i in range(LABELERS)], axis=1)
    return rest // 3**LABELERS, said, shapes


def estimate(cells: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: likelihood per cell, and P(vote | labeler, truth)."""
    kind, said, _ = decode(cells)
    weight = counts.astype(float)
    # Start from the majority of votes.
    truth = 1 / (1 + np.exp(-said.sum(axis=1)))
    for _ in range(rounds):
        trust = np.empty((LABELERS, 3, 2))
        share = np.empty((len(KINDS), 2))
        for y, p in enumerate((1 - truth, truth)):
            mass = weight * p
            for i in range(LABELERS):
                trust[i, :, y] = np.bincount(said[:, i] + 1, mass, 3) + 0.5
            share[:, y] = np.bincount(kind, mass, len(KINDS)) + 0.5
        trust /= trust.sum(axis=1, keepdims=True)
        share /= share.sum(axis=1, keepdims=True)
        odds = np.log(share[kind, 1] / share[kind, 0])
        for i in range(LABELERS):
            odds += np.log(trust[i, said[:, i] + 1, 1] / trust[i, said[:, i] + 1, 0])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - truth).max() < 1e-6:
            return new, trust
        truth = new
    return truth, trust


def features(cells: np.ndarray) -> np.ndarray:
    kind, said, shapes = decode(cells)
    kinds = kind[:, None] == np.arange(len(KINDS))
    return np.column_stack([np.ones(len(cells)), kinds, said == 1, said == -1, shapes]).astype(float)


def classifier(cells: np.ndarray, counts: np.ndarray, truth: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, weighted by counts, by Newton steps."""
    x, weight = features(cells), counts / counts.sum() * min(1e6, float(counts.sum()))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (truth - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w += move
        if np.abs(move).max() < 1e-7:
            break
    return w


def accepted(cells: np.ndarray, counts: np.ndarray) -> set[int]:
    """Cells whose candidates count as personal data."""
    if not len(cells):
        return set()
    truth, _ = estimate(cells, counts)
    w = classifier(cells, counts, truth)
    likely = 1 / (1 + np.exp(-np.clip(features(cells) @ w, -30, 30)))
    return set(cells[likely >= ACCEPT].tolist())


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The texts are read once; what is kept of them is the candidates.
    """

    def propose(texts: list) -> list[list]:
        return [[[v for c in candidates(t) for v in c] for t in texts]]

    held = stage(per_row(docs, "found array<bigint>", propose))
    # Every fourth value is a cell.
    cell_of = F.explode(F.filter("found", lambda _, i: i % 4 == 3)).alias("cell")
    counted = held.where(F.size("found") > 0).select(cell_of).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    # At most kinds * 3^labelers * 2^shapes rows.
    rows = counted.orderBy("cell").collect()
    accept = accepted(np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    out = _arrow_schema(docs.sparkSession, schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc, flat in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(zip(*[iter(flat)] * 4))
                base = [c[:3] for c in found if c[0] < BASE]
                every = [c[:3] for c in found if c[0] < BASE or c[3] in accept]
                many = [sum(c[0] == k for c in base) for k in range(BASE)]
                made.append((doc, *many, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
            columns = list(zip(*made)) if made else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return held.mapInArrow(report, schema)
