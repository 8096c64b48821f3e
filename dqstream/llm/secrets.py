"""Secret scan: fixed patterns, and sliding-window entropy per character class.

Long unbroken strings are candidates. Over each, a window of fixed width slides
with incrementally kept counts, so a step costs the same whatever the width: for
the class of hex digits over the stretches made of them, and for the class of
base64 letters over the whole string. Where the Shannon entropy reaches the
class's threshold the window is a secret; windows that overlap are one span. An
allow-list suppresses the windows that overlap what only looks random: UUIDs, hosts
and paths of URLs (not their user info and queries), integrity digests as long as
they are by their name, parts between / _ = - with a word that marks examples; and
plain numbers and words.

Nulls: a null text has no secrets; a null doc_id is carried along. Empty texts
and tables give what they hold: nothing. Repeated rows are scanned alike. Texts
are read whole, in time linear in their length. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import Reach, per_row, small_batches

# The patterns every scan reports, in order of their kinds.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

WIDTH = 20
# Bits per character of a window, by class. Random strings of 20 characters have
# about 3.4 bits over hex digits and 4.1 over base64 letters.
THRESHOLDS = {"hex": 3.0, "base64": 3.8}
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WIDTH},}}")
_HEX_RUN = re.compile(rf"[0-9A-Fa-f]{{{WIDTH},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# URLs as far as the next one, their hosts and paths as far as this, and how far a string may be from `://`.
_URL = re.compile(r"(?<=[a-z])://((?:(?!://)[^\s\"'<>])*)")
_QUERY = re.compile(r"[?#&]")
_NEAR = 200
# Digests by the name before them, as many hex digits or base64 letters as they have.
_DIGEST = re.compile(r"(sha(?:1|256|384|512)|md5)-")
_DIGEST_BEFORE = re.compile(r"\b(sha(?:1|256|384|512)|md5):$")
_DIGEST_BITS = {"sha1": 160, "sha256": 256, "sha384": 384, "sha512": 512, "md5": 128}
_PART = re.compile(r"[^/_=-]+")
_MARK = re.compile(r"example|sample|placeholder|x{6}", re.IGNORECASE)

MASK = "[SECRET]"

# c * log2(c) for every count a window can hold.
_TERMS = [0.0] + [c * math.log2(c) for c in range(1, WIDTH + 1)]
Span = tuple[int, int, int]  # start, kind, end


def fixed(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def windows(run: str, threshold: float) -> Iterator[tuple[int, int]]:
    """Merged stretches whose windows reach `threshold` bits and mix letters and digits."""
    counts: dict[str, int] = {}
    total, letters, digits = 0.0, 0, 0
    start = end = -1
    bound = WIDTH * (math.log2(WIDTH) - threshold)
    for i, c in enumerate(run):
        if i >= WIDTH:
            old = run[i - WIDTH]
            k = counts[old]
            total -= _TERMS[k] - _TERMS[k - 1]
            counts[old] = k - 1
            digits -= old.isdigit()
            letters -= old.isalpha()
        k = counts.get(c, 0)
        total += _TERMS[k + 1] - _TERMS[k]
        counts[c] = k + 1
        digits += c.isdigit()
        letters += c.isalpha()
        # Entropy is log2(width) minus the sum of c log2 c over the width.
        if i >= WIDTH - 1 and total <= bound + 1e-9 and digits >= 2 and letters >= 2:
            first = i - WIDTH + 1
            if start >= 0 and first <= end:
                end = i + 1
            else:
                if start >= 0:
                    yield start, end
                start, end = first, i + 1
    if start >= 0:
        yield start, end


def _urls(text: str) -> list[tuple[int, list[tuple[int, int]]]]:
    """Where the URLs' `://` stand, with the stretches of `//`, host and path."""
    found = []
    for m in _URL.finditer(text):
        start, rest = m.start() + 1, m.start(1)
        query = _QUERY.search(text, rest, m.end())
        end = query.start() if query else m.end()
        slash = text.find("/", rest, end)
        # User info ends at the last @ before the path.
        host = text.rfind("@", rest, end if slash < 0 else slash) + 1
        found.append((m.start(), [(start, rest), (host, end)] if host else [(start, end)]))
    return found


def _digest(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The digest at the start of a string."""
    m = _DIGEST.match(text, start, end)
    at = m.end() if m else start
    m = m or _DIGEST_BEFORE.search(text[max(0, start - 10) : start])
    if not m:
        return []
    bits = _DIGEST_BITS[m[1]]
    digits = bits // 4
    run = re.compile(rf"[0-9A-Fa-f]{{{digits}}}").match(text, at, end)
    return [(start, min(end, at + (digits if run else -(-bits // 24) * 4)))]


def _allowed(text: str, start: int, end: int, urls: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int]]:
    """Stretches of the string that are on the allow-list."""
    found = _digest(text, start, end)
    found += [m.span() for m in _UUID.finditer(text, start, end)]
    found += [m.span() for m in _PART.finditer(text, start, end) if _MARK.search(m[0])]
    k = bisect_left(urls, (start,)) - 1
    if k >= 0 and start - urls[k][0] < _NEAR:
        found += [(max(s, start), min(e, end)) for s, e in urls[k][1] if s < end and e > start]
    return _merged(found)


def _random(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a string whose windows reach the threshold of either class."""
    own = text[start:end]
    spans = [(start + h.start() + s, start + h.start() + e) for h in _HEX_RUN.finditer(own) for s, e in windows(h[0], THRESHOLDS["hex"])]
    return spans + [(start + s, start + e) for s, e in windows(own, THRESHOLDS["base64"])]


def by_entropy(text: str) -> list[Span]:
    """Spans the entropy windows find."""
    found, urls = [], None
    for m in _CANDIDATE.finditer(text):
        spans = _random(text, *m.span())
        if not spans:
            continue
        urls = _urls(text) if urls is None else urls
        known = _allowed(text, *m.span(), urls)
        if known:
            # Windows that overlap none of these lie between them.
            edges = [m.start(), *(x for stretch in known for x in stretch), m.end()]
            spans = [x for s, e in zip(edges[::2], edges[1::2]) if e - s >= WIDTH for x in _random(text, s, e)]
        found += [(s, 3, e) for s, e in _merged(spans)]
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """Fixed spans, and all spans; an entropy span inside a fixed one is not repeated."""
    text = text or ""
    base = fixed(text)
    known = Reach((s, e) for s, _, e in base)
    more = [x for x in by_entropy(text) if known.until(x[0] + 1) < x[2]]
    return base, sorted(base + more)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""

    def made(texts: list) -> list[list]:
        rows = []
        for text in texts:
            base, every = spans_of(text)
            many = [sum(k == kind for _, k, _ in every) for kind in range(4)]
            rows.append((*many[:3], hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), many[3]))
        return [list(c) for c in zip(*rows)] if rows else [[]] * 6

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"
    return per_row(docs, schema, made)


def masked(text: str | None) -> str | None:
    """The text with the value of every secret replaced."""
    if not text:
        return text
    _, every = spans_of(text)
    if not every:
        return text
    values = {(m.start(), m.end()): m.span(2) for m in _ASSIGN.finditer(text)}
    parts, at = [], 0
    for s, e in _merged([values.get((s, e), (s, e)) if k == 0 else (s, e) for s, k, e in every]):
        parts += [text[at:s], MASK]
        at = e
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, with secrets masked in `text` and `n_chars` counted anew."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([masked(t) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return done
