"""Operator 8: personal data by a character-level BiLSTM-CRF over overlapping windows, beside patterns whose spans always stay.

The tagger scores windows that start on a grid over the text. Where windows overlap, their scores are averaged, those near a window's
edge counting least, and one best path is sought over each whole stretch, so that a span may be longer than a window. It knows the
patterns' kinds in more forms (mail written with (at) and (dot), phone numbers without +) and secrets: keys, tokens and passwords.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adtflow.llm.pii_model import KINDS, LENGTH, SYMBOLS, TAGS, Tagger, symbols, tag_spans, trained
from adtflow.llm.shared import map_arrow

#: Kinds that have a pattern.
PATTERNS = 4
#: Windows are as long as in training and start this far apart.
STRIDE = LENGTH // 2
#: Characters on either side of a sign that are decoded. Without a sign in it, or just before a secret, nothing is a plausible span.
REACH = LENGTH // 2
#: Windows scored, and stretches decoded, at a time.
WINDOWS = 256

#: Signs begin with these; one class of characters, which is searched for fast.
_MARKS = re.compile(r"[0-9@\[({:=]+")
_DATA = re.compile(r"[0-9@]")
_AT = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_LABEL = re.compile(r"(?:passw(?:or)?d|token|secret|key)[\"']?\s?\Z", re.I)
#: Characters before : or = in which a label may stand.
_LABEL_REACH = 12
_KEYS = ("AKIA", "ASIA")
_WEIGHT = np.minimum(np.arange(LENGTH), np.arange(LENGTH)[::-1]).astype(np.float32)[:, None] + 1
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Begins with a digit, as such are searched for fast, which no other digit stands before.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain; from each @ backwards, so that long words cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, end := m.end()))
        else:
            end = max(end, at)
        at = text.find("@", max(end, at + 1))
    return out


def valid(kind: int, s: str) -> bool:
    """What a match of a kind must fulfil besides its pattern."""
    if kind == 1:
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in s.split("."))
    d = _digits(s)
    return kind == 0 or (13 <= len(d) <= 19 and luhn(d) if kind == 2 else 9 <= len(d) <= 15)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    out = [(0, *x) for x in _emails(text)] if "@" in text else []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


def signs(text: str) -> list[tuple[int, int]]:
    """Where digits and @ stand, (at), the : or = after a label of a secret, and the beginnings of keys that need no digit."""
    out = []
    for m in _MARKS.finditer(text):
        s = m[0]
        if _DATA.search(s) or s[-1] in "[({" and _AT.match(text, m.end() - 1) or s[0] in ":=" and _LABEL.search(text, max(0, m.start() - _LABEL_REACH), m.start()):
            out.append(m.span())
    for key in _KEYS:
        at = text.find(key)
        while at >= 0:
            out.append((at, at + len(key)))
            at = text.find(key, at + len(key))
    return sorted(out)


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text within REACH of a sign."""
    out: list[tuple[int, int]] = []
    for start, end in signs(text):
        a, b = max(0, start - REACH), min(len(text), end + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HIDDEN_MAIL = re.compile(r"[\w.%+-]+\s?[\[({]\s?at\s?[\])}]\s?[\w-]+(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\.)[\w-]+)+", re.I | re.A)


def _plausible(kind: int, s: str) -> bool:
    """Whether what the tagger found is such data; a wrong checksum, number or sign count is dropped, as with the patterns."""
    if kind == 0:
        user, sign, host = s.partition("@")
        return bool(sign and user and "." in host.strip(".") and " " not in s) or bool(_HIDDEN_MAIL.fullmatch(s))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and valid(1, s)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", s)) and valid(2, s)
    if kind == 3:
        return bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s)) and valid(3, s) and ("(" in s or "+" in s)
    return bool(re.fullmatch(r"[A-Za-z0-9+/=_-]{8,}", s)) and (any(c.isdigit() for c in s) or s.startswith(("AKIA", "ASIA")))


def _scores(texts: list[str], parts: list[tuple[int, int, int]], model: Tagger) -> list[np.ndarray]:
    """The averaged scores (time, tags) of each part (text, start, end)."""
    out = [np.zeros((b - a, TAGS), np.float32) for _, a, b in parts]
    weights = [np.zeros((b - a, 1), np.float32) for _, a, b in parts]
    places = [(n, k * STRIDE) for n, (_, a, b) in enumerate(parts) for k in range(max(0, a // STRIDE - 1), (b - 1) // STRIDE + 1)]
    for at in range(0, len(places), WINDOWS):
        some = places[at : at + WINDOWS]
        ids = np.full((len(some), LENGTH), SYMBOLS - 1, np.int64)
        for row, (n, s) in enumerate(some):
            x = symbols(texts[parts[n][0]][s : s + LENGTH])
            ids[row, : len(x)] = x
        scores = model.emissions(ids)
        for row, (n, s) in enumerate(some):
            _, a, b = parts[n]
            first, last = max(a, s), min(b, s + LENGTH)
            if first < last:
                out[n][first - a : last - a] += scores[first - s : last - s, row] * _WEIGHT[first - s : last - s]
                weights[n][first - a : last - a] += _WEIGHT[first - s : last - s]
    return [x / w for x, w in zip(out, weights, strict=True)]


def tagged_spans(texts: list[str], model: Tagger, everywhere: bool = False) -> list[list[Span]]:
    """Plausible spans of each text as the tagger sees them, near signs or, with the same result, everywhere."""
    parts = [(i, a, b) for i, t in enumerate(texts) for a, b in ([(0, len(t))] * bool(t) if everywhere else stretches(t))]
    parts.sort(key=lambda x: x[2] - x[1])  # those decoded together are about as long
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(parts):
        longest = WINDOWS * 4 * LENGTH  # characters decoded at a time, or one part
        some = parts[at : at + 1]
        while at + len(some) < len(parts) and len(some) < WINDOWS and (len(some) + 1) * (parts[at + len(some)][2] - parts[at + len(some)][1]) <= longest:
            some.append(parts[at + len(some)])
        at += len(some)
        each = _scores(texts, some, model)
        lengths = np.array([len(x) for x in each])
        scores = np.zeros((lengths.max(), len(each), TAGS), np.float32)
        for row, x in enumerate(each):
            scores[: len(x), row] = x
        for (i, a, b), tags in zip(some, model.viterbi(scores, lengths), strict=True):
            out[i] += [(kind, a + x, a + y) for kind, x, y in tag_spans(tags[: b - a]) if _plausible(kind, texts[i][a + x : a + y])]
    return [sorted(x) for x in out]


def find(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans: what the tagger adds overlaps no base span."""
    out: list[tuple[list[Span], list[Span]]] = []
    for t, found in zip(texts, tagged_spans(texts, model), strict=True):
        base = base_spans(t) if _DATA.search(t) else []
        taken, added = sorted((a, b) for _, a, b in base), []
        ends = list(accumulate((b for _, b in taken), max))
        for x in found:
            before = bisect_left(taken, (x[2], 0))  # base spans that start before its end
            if not before or ends[before - 1] <= x[1]:
                added.append(x)
        out.append((base, sorted(base + added)))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def private_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the numbers of base spans of each kind, base_sha256, spans, and the number of all spans, of every document.

    Places are code points, ends exclusive. Null and empty texts have no spans; null ids stay null; repeated rows are handled alike; an
    empty table gives no rows; other columns are not read. A long text takes memory in proportion to its own length. Only stretches
    near a sign are decoded, as nothing else is a plausible span.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trained())  # a few thousand numbers

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, every in find([x or "" for x in batch.column(1).to_pylist()], sent.value):
            n = [sum(k == kind for k, _, _ in base) for kind in range(PATTERNS)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every)))
        kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    slim = documents.select(documents[id_col].cast("long").alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return map_arrow(slim, each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind; overlapping spans become one mark of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(documents: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """documents with personal data and secrets replaced in the text, and the length column, if there is one, brought up to date.

    Null texts stay null and empty ones empty; repeated rows are handled alike; an empty table stays so; all other columns, whatever
    their names, are kept as they are.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trained())
    at = documents.columns.index(text_col)
    n_at = documents.columns.index(length_col) if length_col in documents.columns else None

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = find([x or "" for x in texts], sent.value)
        new = [t if not every else redact(t, every) for t, (_, every) in zip(texts, found, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if n_at is not None:
            columns[n_at] = pa.array([n if not every else len(t) for n, t, (_, every) in zip(columns[n_at].to_pylist(), new, found, strict=True)], batch.schema.field(n_at).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(documents, each, documents.schema)
