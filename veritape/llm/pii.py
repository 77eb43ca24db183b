"""Personal data by candidate gradient boosting.

Base rules give the spans that always stand. Generators of high recall then propose more spans,
overlapping ones too: obfuscated addresses, digit groups of card length, telephone shapes without
a leading plus, dotted and colon-separated addresses. Boosted trees score each proposal from its
format and context; a proposal outside the base spans is added where its calibrated probability
reaches its kind's threshold, the least one at which the held-out fifth of the training rows has a
precision of ``PRECISION`` (``THRESHOLD`` where a kind has too few of them). Of overlapping additions the likelier one stays, then the longer, then the
earlier.

The trees learn from the corpus itself by weak labels, not by what the base rules find: a proposal
is a positive if it lies in a base span of its kind or its own form or context speaks for it
(:func:`weak_label`), a negative if they speak against it; undecided ones train nothing. So that
forms that are rare in a corpus are known, each base span also stands in its place as two twins:
the same data in another form (obfuscated, without a plus, 13 digits, colon-separated) and a decoy.
The trees are fitted on at most ``max_train`` rows, those with the least hash of (doc_id, start,
kind, form); every proposal of every text is scored.

Null text counts as empty: no spans. Repeated rows give repeated results, an empty table an empty
one, and columns may have any name. Scans take a text's length, and its spans' number times its
logarithm, so very long texts and long runs of digits are safe.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veritape.llm.boosting import BoostedTrees
from veritape.llm.common import bounded_sample, sha256_hex, short_batches, span_text, texts_of
from veritape.session import cut

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 20_000
THRESHOLD = 0.9
PRECISION = 0.98
LEAST_HELD = 50  # held-out rows of a kind from which its threshold is set

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Words near a span that speak for personal data, by kind.
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact"),
}
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63})+", re.ASCII | re.IGNORECASE)
_HINT = re.compile(r"dot|[(\[{]at[)\]}]", re.ASCII | re.IGNORECASE)
_DIGITS = re.compile(r"[0-9](?:[\x20.-]?[0-9])*+")
_SHAPE = re.compile(r"[+(]?[0-9][\x20().0-9/-]*+")
_SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_ANY = re.compile(r"[0-9@]")
_MARKED = re.compile(r"[(\[{](?:at|dot)[)\]}]|\x20dot\x20", re.ASCII | re.IGNORECASE)
_GROUPED = re.compile(r"\(?[0-9]{3}(?:\)\x20?|[\x20.-])[0-9]{3}[\x20.-][0-9]{4}", re.ASCII)
_DATE = re.compile(r"[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules: leftmost, non-overlapping within a kind, checked after matching."""
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:  # the leftmost start for an @ is the start of the run of local characters before it
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    if not _ANY.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the generators. They favour recall; spans of different kinds may overlap."""
    out = []
    if "@" in text:
        out += [(s, k, e) for s, k, e in base_spans(text) if k == 0]
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _OBFUSCATED.finditer(text)]
    if not _ANY.search(text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if m.end() - m.start() <= 23]
    if text.count(":") >= 4:
        out += [(m.start(), 1, m.end()) for m in _SIX.finditer(text)]
    for m in _DIGITS.finditer(text):
        if 12 <= len(_digits(m[0])) <= 19:
            out.append((m.start(), 2, m.end()))
    for m in _SHAPE.finditer(text):
        s, e = m.start(), m.end()
        while e > s and not "0" <= text[e - 1] <= "9":
            e -= 1
        if 8 <= len(_digits(text[s:e])) <= 15:
            out.append((s, 3, e))
    return out


def _near(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a context word of the kind is among the four words before the span or the one after it."""
    s, k, e = span
    near = re.findall(r"[a-z-]+", text[max(0, s - 40) : s].lower())[-4:] + re.findall(r"[a-z-]+", text[e : e + 20].lower())[:1]
    return any(w in CONTEXT_WORDS[KINDS[k]] for w in near)


def _colon_address(x: str) -> bool:
    """Eight groups, not all of two digits as in hardware addresses and fingerprints."""
    groups = x.split(":")
    return len(groups) == 8 and any(len(g) != 2 for g in groups)


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    s, k, e = span
    x = text[s:e]
    d = _digits(x)
    groups = re.findall("[0-9]+", x)
    before, after = text[max(0, s - 40) : s].lower(), text[e : e + 20].lower()
    octets = [int(g[-4:]) for g in groups] if k == 1 else []
    return [
        float(k == 0), float(k == 1), float(k == 2), float(k == 3),
        len(x), len(d), len(d) / max(1, len(x)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(bool(d) and luhn(d)), float(int(d[0])) if d else -1.0, len(set(d)), float("(" in x), x.count("."), x.count("-"), x.count(" "), x.count(":"),
        sum(c.isalpha() for c in x), float(max(octets, default=0) <= 255 and len(octets) == 4), float(k == 1 and _colon_address(x)),
        float(k == 0 and " at " in x.lower()), float(bool(_MARKED.search(x))), float(bool(_GROUPED.fullmatch(x))), float(bool(_DATE.match(x))),
        float(before[-1:].isspace() or not before), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in "#*%$&!"),
        float(_near(text, span)), float("." in before[-2:]),
    ]


def weak_label(text: str, span: tuple[int, int, int], base: list[tuple[int, int, int]]) -> float | None:
    """1 or 0 by the base rules, the span's own form and the words near it; None where they do not decide."""
    s, k, e = span
    met = [b for b in base if b[0] < e and s < b[2]]
    if any(bk == k and bs <= s and e <= be for bs, bk, be in met):
        return 1.0
    if met:  # part of other data, or more than a span of its own kind
        return None if any(bk == k for _, bk, _ in met) else 0.0
    x = text[s:e]
    if k == 0:
        return float(bool(_MARKED.search(x)) or _near(text, span))
    if k == 1:
        return float(_colon_address(x))
    if text[max(0, s - 1) : s].isalnum() or text[e : e + 1].isalnum():
        return 0.0  # digits of a longer word
    if k == 2:
        return float(luhn(_digits(x)) and _near(text, span))
    return float(not _DATE.match(x) and (bool(_GROUPED.fullmatch(x)) or _near(text, span)))


def twins(text: str, span: tuple[int, int, int]) -> list[tuple[str, tuple[int, int, int]]]:
    """(text, span) of a base span's data in another form and of a decoy, in the span's own surroundings."""
    s, k, e = span
    x = text[s:e]
    d, pick = _digits(x), zlib.crc32(x.encode("utf-8", "surrogatepass"))
    if k == 0:
        local, _, host = x.partition("@")
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" {at} ", "."))[pick % 4]
        forms = [("", local[:64] + at + host.replace(".", dot)), ("", f"{local[-8:]} at {host}")]
    elif k == 1:
        h = sha256_hex(x)
        colons = lambda n, w: ":".join(h[4 * i : 4 * i + w] for i in range(n))
        forms = [("", colons(8, 4 if pick % 2 else 3)), ("", colons((6, 5, 8, 7)[pick % 4], 2))]
    elif k == 2:
        n = 12 - pick % 2
        short = next(d[:n] + c for c in "0123456789" if luhn(d[:n] + c))
        forms = [("card ", short), (("", short), ("card ", d[:-1] + str((int(d[-1]) + 1) % 10)))[pick // 2 % 2]]
    else:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        forms = [(("", f"({a}) {b}-{c}"), ("", f"{a}-{b}-{c}"), ("", f"{a}.{b}.{c}"), ("call ", d), ("phone ", a + b + c))[pick % 5], (("", d), ("", a + b + c[:2]), ("call ", f"20{d[-2:]}-0{pick % 9 + 1}-1{d[-1]}"))[pick // 5 % 3]]
    out = []
    for lead, form in forms:
        before = text[max(0, s - 40) : s] + lead
        out.append((before + form + text[e : e + 20], (len(before), k, len(before) + len(form))))
    return out


def training_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, start, kind, form, label, x) for each proposal that has a weak label (form 0), and for the twins of each base span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = proposals(text) if text else []
                base = base_spans(text) if found else []
                for s, k, e in found:
                    label = weak_label(text, (s, k, e), base)
                    if label is not None:
                        rows.append((doc, s, k, 0, label, features(text, (s, k, e))))
                for s, k, e in base:
                    for form, (twin, at) in enumerate(twins(text, (s, k, e)), 1):
                        rows.append((doc, s, k, form, weak_label(twin, at, []), features(twin, at)))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.list_(pa.float64()))], ["doc_id", "start", "kind", "form", "label", "x"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, kind int, form int, label double, x array<double>")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> BoostedTrees:
    """The trees, from at most ``max_train`` proposals and twins."""
    proposed = cut(training_rows(df, id_col, text_col), "proposals")
    rows = bounded_sample(proposed, ["doc_id", "start", "kind", "form"], max_train).select("label", "x").collect()
    if not rows:
        return BoostedTrees().fit(np.zeros((0, 1)), np.zeros(0))
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    model = BoostedTrees().fit(x, y)
    model.limits = thresholds(model.predict(x), x, y, np.arange(len(y)) % 5 == 4)
    return model


def thresholds(p: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> list[float]:
    """For each kind the least probability of held rows from which on they have the precision wanted, a half at least."""
    out = []
    for k in range(len(KINDS)):
        own = np.flatnonzero(held & (x[:, k] == 1))
        own = own[np.argsort(-p[own], kind="stable")]
        good = np.cumsum(y[own]) >= PRECISION * np.arange(1, len(own) + 1)
        last = np.append(p[own][1:] < p[own][:-1], True)[: len(own)]  # rows of equal probability go together
        reached = np.flatnonzero(good & last)
        out.append(max(0.5, float(p[own][reached[-1]])) if len(own) >= LEAST_HELD and len(reached) else THRESHOLD)
    return out


class _Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, span: tuple[int, int, int]) -> bool:
        i = bisect_left(self.starts, span[2])
        return i == 0 or self.ends[i - 1] <= span[0]

    def add(self, span: tuple[int, int, int]) -> None:
        i = bisect_left(self.starts, span[0])
        self.starts.insert(i, span[0])
        self.ends.insert(i, span[2])


def added_spans(text: str, base: list[tuple[int, int, int]], model: BoostedTrees, threshold: float | None = None) -> list[tuple[int, int, int]]:
    """Proposals that the model selects and no base span or likelier addition overlaps. ``threshold``: one for all kinds, in place of the model's own."""
    taken = _Taken(base)
    fresh = [p for p in dict.fromkeys(proposals(text)) if taken.free(p)]
    if not fresh or not model.forest:
        return []
    limits = getattr(model, "limits", [THRESHOLD] * len(KINDS)) if threshold is None else [threshold] * len(KINDS)
    prob = model.predict(np.array([features(text, p) for p in fresh]))
    out: list[tuple[int, int, int]] = []
    chosen = _Taken()
    for _, p in sorted(((q, p) for q, p in zip(prob, fresh, strict=True) if q >= limits[p[1]]), key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
        if chosen.free(p):
            out.append(p)
            chosen.add(p)
    return out


def find(df: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, shared.value, threshold) if text else []
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                digests.append(sha256_hex(span_text(base, KINDS)))
                spans.append(span_text(base + more, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes one mark with the kind of its first span."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, model: BoostedTrees, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``df`` with the same columns and rows, its text redacted; a null text stays null."""
    shared = short_batches(df).sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    texts[i] = redact_text(text, base + added_spans(text, base, shared.value, threshold))
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
