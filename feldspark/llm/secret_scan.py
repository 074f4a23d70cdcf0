"""Secrets in texts: fixed patterns, and a battery of randomness tests for strings without a known form.

The patterns give spans of the kinds assign, access and hex. Every other run of key-like characters is a candidate
of the battery, less the spans in it: as a whole, unless it is made of words and numbers alone, and each of its parts
between separators; one that mixes the separators of base64 and base64url, as a path does, also at either's. Its
encoding is inferred from its characters; three tests take the hypothesis that its characters are drawn evenly and
independently from that alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and serial
correlation of neighbours. What counts as a discovery is a string that is *not* ordinary text, so its p-value is the
chance that ordinary text of that length would look as even as it does, put together (Fisher) with that of as many
changes between digits, capitals and small letters; the hypothesis of a random string must also stand. Within a
document, the false-discovery rate is held by weighted Benjamini-Hochberg over the candidates that could be discovered
at all, in which longer candidates, whose tests tell more, get larger weights. Everything depends on the one text alone.

Candidates have LEAST characters or more, and are not digits alone, which can't be told from numbers. A string whose
length and alphabet leave no p-value under the rate, however even it is, can't be discovered and needs no test (small
letters alone: under some 25 characters). Null and empty texts have no span. Positions are code points, ends exclusive.
Equal texts have equal spans. The result has the key and its own columns; others of the documents, whatever their names,
are left out (in redact_documents they stay). Repeated rows are repeated; whole texts are scanned, at any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

KINDS = ("assign", "access", "hex", "random")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
# a match is the whole run, so a shorter run can be passed over in the pattern itself
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Characters of a candidate of the battery, at least.
LEAST = 12
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_DIGIT = re.compile(r"[0-9]")
_PART = re.compile(r"[A-Za-z0-9]+={0,2}")
_WORDY = re.compile(r"[+/_-]*(?:(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+)(?:[+/_-]+|$))*=*")
_NUMBERED = re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*[0-9]{0,4}")
_FAMILIES = (re.compile(rf"[A-Za-z0-9_-]{{{LEAST},}}={{0,2}}"), re.compile(rf"[A-Za-z0-9+/]{{{LEAST},}}={{0,2}}"))

#: Encodings in the order of inference, with their alphabets.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Encodings of words: one letter case but for a capital in front.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Share of a document's discoveries that may be false; p-values under which a random string's hypothesis falls;
#: sum of squared shares of the characters of ordinary text (letters of English: 0.0667, of other languages more; with a capital for
#: about every fifth letter 0.05, as in "letters").
RATE, STANDS, REPEATS, REPEATS_OF_LETTERS = 0.01, 1e-3, 0.0667, 0.05
#: Shares of neighbours of ordinary text that differ in being digits, capitals or small letters, at most: by encoding, else.
CHANGES, ANY_CHANGES = {"hex": 0.2, "HEX": 0.2, "base32": 0.2, "base36": 0.2, "BASE36": 0.2, "letters": 0.4}, 0.35
#: Results of the battery that a worker keeps, and characters of their strings at most.
KNOWN, KEPT = 50_000, 100


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    spans = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _ASSIGNED):
            spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if _DIGIT.search(text) or len(text) >= 32:
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def encoding(token: str) -> tuple[str, str] | None:
    """The first encoding whose alphabet has all characters; None for digits alone. A capital in front of small letters is a small letter."""
    body = token.rstrip("=")
    if body.isdigit():
        return None
    if body.isalpha() and (body[1:].islower() or body.isupper()):
        return ("upper", UPPER) if body.isupper() else ("lower", LOWER)
    chars = set(body)
    return next(((name, alphabet) for name, alphabet in ENCODINGS if chars <= set(alphabet)), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_upper(x: float, df: int) -> float:
    """P(chi-squared >= x), by Wilson and Hilferty's cube root."""
    return _upper(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _noncentral_lower(x: float, df: float, extra: float) -> float:
    """P(noncentral chi-squared <= x), by Sankaran's approximation."""
    total, twice = df + extra, df + 2 * extra
    h = 1 - 2 * total * (df + 3 * extra) / (3 * twice**2)
    p = twice / total**2
    m = (h - 1) * (1 - 3 * h)
    z = ((x / total) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))
    return _upper(-z)


def _poisson_lower(k: int, mean: float) -> float:
    """P(Poisson <= k); 0 for means over 500, where the normal tail decides."""
    if mean > 500:
        return 0.0
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def _changes(token: str) -> int:
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in token]
    return sum(a != b and 3 not in (a, b) for a, b in zip(kinds, kinds[1:], strict=False))


def _changes_upper(n: int, k: int, share: float) -> float:
    """P(as many changes between kinds of characters in ordinary text, or more): binomial, by Chernoff's bound in long ones."""
    if n <= 200:
        return min(1.0, sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k, n + 1)))
    q = k / n
    if q <= share:
        return 1.0
    rest = (1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0
    return math.exp(-n * (q * math.log(q / share) + rest))


def pieces(run: str) -> list[tuple[int, int]]:
    """Places of the candidates in a run of key-like characters."""
    found = {m.span() for m in _PART.finditer(run) if m.end() - m.start() >= LEAST}
    if not _WORDY.fullmatch(run) and run not in (run.lower(), run.upper()):
        mixed = ("/" in run or "+" in run) and ("_" in run or "-" in run)
        found |= {m.span() for p in _FAMILIES for m in p.finditer(run) if not _WORDY.fullmatch(m.group())} if mixed else {(0, len(run))}
    return sorted(found)


@lru_cache(maxsize=KNOWN)
def _discoverable(name: str, size: int, n: int) -> bool:
    """Whether a string of n characters of an alphabet of `size` could be discovered: the most even one, with changes all along."""
    each, more = divmod(n, size)
    return _ordinary(((size - more) * each**2 + more * (each + 1) ** 2) * size / n - n, size, n, name, n - 1) <= RATE


def _ordinary(chi2: float, size: int, n: int, name: str, changes: int, letters: bool = False) -> float:
    """The chance that ordinary text of n characters (letters: words with a number after them) is as even, or changes as often, put together by Fisher's method."""
    repeats = max(REPEATS_OF_LETTERS if letters or name == "letters" else REPEATS, 1.6 / size)
    even = _noncentral_lower(max(chi2, 1e-9), size - 1, n * max(size * repeats - 1, 0.1))
    # chi-squared counts the pairs of equal characters; a short string has few, which are about a Poisson variable
    pairs = (chi2 + n) * n / size - n
    even = max(even, _poisson_lower(round(pairs / 2), repeats * n * (n - 1) / 2))
    if name in ("lower", "upper"):
        return even
    both = max(even * _changes_upper(n - 1, changes, CHANGES.get(name, ANY_CHANGES)), 1e-300)
    return both * (1 - math.log(both))


def battery(token: str) -> tuple[str, float, float] | None:
    """(encoding, p of ordinary text, least p of a random string over the three tests); None if no encoding fits or the token can't be discovered."""
    return _known(token) if len(token) <= KEPT else _known.__wrapped__(token)


@lru_cache(maxsize=KNOWN)
def _known(token: str) -> tuple[str, float, float] | None:
    body = token.rstrip("=")
    found = encoding(body)
    if not found or not _discoverable(found[0], len(found[1]), len(body)):
        return None
    name, alphabet = found
    size = len(alphabet)
    at = {c: i for i, c in enumerate(alphabet)}
    values = np.array([at[c] for c in (body.lower() if name == "lower" else body)])
    n = len(values)
    counts = np.bincount(values, minlength=size)
    chi2 = float((counts.astype(float) ** 2).sum() * size / n - n)
    uniform = _chi2_upper(max(chi2, 1e-9), size - 1)
    high = values >= size / 2
    more, less = int(high.sum()), int(n - high.sum())
    if more and less and n > 1:
        runs = 1 + int(np.count_nonzero(high[1:] != high[:-1]))
        mean = 2 * more * less / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs_p = 2 * _upper(abs(runs - mean) / math.sqrt(var))
    else:
        runs_p = 2.0 ** (1 - n)
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial_p = 2 * _upper(abs(float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    ordinary = _ordinary(chi2, size, n, name, _changes(body), size > 36 and bool(_NUMBERED.fullmatch(body)))
    return name, ordinary, min(1.0, uniform * 3, runs_p * 3, serial_p * 3)


def _outside(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key-like characters, without the spans in them."""
    spans = sorted((s, e) for s, _, e in taken)
    k = 0
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            start, stop = spans[k]
            if stop > at:
                if start - at >= LEAST:
                    yield at, start
                at = stop
            if stop > end:
                break  # it goes on into later runs
            k += 1
        if end - at >= LEAST:
            yield at, end


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the battery outside those taken: its discoveries at the false-discovery rate RATE."""
    candidates = []
    for start, end in _outside(text, taken):
        run = text[start:end]
        # words are the most of them
        if run.isalpha() and run[1:].islower() and not _discoverable("lower", len(LOWER), len(run)):
            continue
        for s, e in pieces(run):
            got = battery(run[s:e])
            if got:
                candidates.append((start + s, start + e, got[1], got[2]))
    if not candidates:
        return []
    weights = np.array([e - s for s, e, _, _ in candidates], float)
    weights /= weights.mean()
    p = np.array([c[2] for c in candidates])
    order = np.argsort(p / weights, kind="stable")
    passed = np.flatnonzero((p / weights)[order] <= RATE * np.arange(1, len(p) + 1) / len(p))
    found = order[: passed[-1] + 1] if len(passed) else []
    spans: list[tuple[int, int, int]] = []
    held = _Intervals()
    for i in found:
        start, end, own, stands = candidates[i]
        # of pieces that overlap, the least p
        if own <= RATE and stands >= STANDS and held.add(start, end):
            spans.append((start, 3, end))
    return spans


class _Intervals:
    """Intervals that don't overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Whether the interval overlaps none so far and is one of them now."""
        k = bisect_right(self.starts, start)
        if k and self.ends[k - 1] > start or k < len(self.starts) and self.starts[k] < end:
            return False
        self.starts.insert(k, start), self.ends.insert(k, end)
        return True


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, as (start, kind, end) in order."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base))


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row."""
    small_batches(documents.sparkSession)
    schema = documents.select(key).schema
    for name in ("n_assign", "n_access", "n_hex", "n_random"):
        schema.add(name, "long")
    schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in spans) for _, spans in rows], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([_said(s) for _, s in rows], pa.string())], names=schema.names)

    return documents.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def redact(text: str | None) -> str | None:
    """text with each span (those that overlap as one) replaced by [SECRET:kind]; a clean text is the same."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[SECRET:{KINDS[k]}]"]
        at = e
    return "".join(out) + text[at:]


def redact_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with secrets replaced in the text; all columns stay, and null texts stay null."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text)
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([redact(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return documents.mapInArrow(run, schema)
