"""Secrets by dictionary-primed zstandard novelty.

Base rules give the spans that always stand. Further candidates are opaque strings (16 characters
or more from the base64 and hexadecimal alphabets, with letters and digits) within ``REACH`` of a
sensitive word, before or after it, and those on lines that follow one another from such a string,
as in a key block. For each the marginal cost is measured: the compressed bytes of context plus candidate less
those of the context alone, by a compressor primed with a dictionary of identifiers and the text
around the candidate, out of which copies of the candidate itself are taken. Ordinary identifiers and words compress to little; a string that costs at
least ``novelty`` bytes a character is reported. The limits are above what dictionary words cost and
below the 5 bits a character of random letters and digits, or the 4 bits of random hexadecimal.
Strings that separators cut into plain words and numbers only are names, not candidates.

Null text counts as empty. Scans are linear in the text. Repeated rows give repeated results, an
empty table an empty one, and columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from veritape.llm.common import sha256_hex, span_text, texts_of

KINDS = ("assign", "access", "hex")
NOVELTY = 0.6
HEX_NOVELTY = 0.45
AROUND = 400
REACH = 400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WORDS = ("pass", "secret", "token", "api", "key", "auth", "bearer", "credential", "private", "pwd", "signature", "cookie", "session")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")

_MIXED = re.compile("[0-9][A-Za-z]|[A-Za-z][0-9]")
_HEX_ONLY = re.compile("[0-9a-fA-F=_/+-]+")
_NEXT_LINE = re.compile(r"""[\s"'`\\,;>|#*.]{1,64}""")
_LAST_LINE = re.compile(r"""[\x20\t"'`,;>|#*.]*(?:\r?\n|\\n)[\x20\t"'`>|#*]*([A-Za-z0-9+/]{1,15}={1,2}|[A-Za-z0-9+/]{1,15}(?=["'\\,;\s]{1,64}-----END))(?![A-Za-z0-9+/_=])""", re.ASCII)

# Identifiers and words that code and prose use, for the compression dictionary.
IDENTIFIERS = """
import export return function class public private static const void string integer boolean number object array
index length value result request response header content message error exception handler callback listener
database connection connect query select insert update delete create table column schema transaction
username password passwd secret token api_key apikey api-key access_key secret_key auth authorization bearer
credential private_key public_key certificate signature session cookie config configuration environment
settings production development staging localhost example default development_server application
get_value set_value get_token set_token refresh_token access_token client_id client_secret user_id
getUserName setUserName getPassword setPassword createConnection closeConnection readFile writeFile
http https www com org net html json yaml xml utf-8 ascii base64 sha256 sha1 md5 hmac
project module version release package source target main index page build test data type list item name code file path
true false null none undefined abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
""".strip().encode()

_PRESS: zstandard.ZstdCompressor | None = None


def lowered(text: str) -> str:
    """``text`` in lower case, character for character."""
    low = text.lower()
    return low if len(low) == len(text) else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules."""
    low = lowered(text) if low is None else low
    out = []
    if any(k in low for k in _KEYS):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def marginal_bytes(before: str, candidate: str) -> int:
    """What ``candidate`` adds to the compressed size of ``before``, with the identifier dictionary."""
    global _PRESS
    if _PRESS is None:
        _PRESS = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    return len(_PRESS.compress((before + candidate).encode("utf-8", "surrogatepass"))) - len(_PRESS.compress(before.encode("utf-8", "surrogatepass")))


def surroundings(text: str, s: int, e: int) -> str:
    """``AROUND`` characters on either side of text[s:e], without copies of it, even those that the edge cuts."""
    x, gone = text[s:e], "\0" * (e - s)
    before = text[max(0, s - AROUND - (e - s)) : s].replace(x, gone)[-AROUND:]
    return (before + text[e : e + AROUND + e - s].replace(x, gone)[:AROUND]).replace("\0", "")


def reached(text: str, low: str) -> list[list[tuple[int, int]]]:
    """Blocks of opaque strings on adjacent lines of which one lies within ``REACH`` of a sensitive word."""
    near: list[list[int]] = []
    for s, e in sorted((m.start(), m.end()) for word in _WORDS for m in re.finditer(word, low)):
        if near and s - REACH <= near[-1][1]:
            near[-1][1] = max(near[-1][1], e + REACH)
        else:
            near.append([s - REACH, e + REACH])
    blocks: list[list[tuple[int, int]]] = []
    for m in _OPAQUE.finditer(text) if near else ():
        gap = text[blocks[-1][-1][1] : m.start()] if blocks else ""
        if len(gap) <= 64 and ("\n" in gap or "\\" in gap) and _NEXT_LINE.fullmatch(gap):
            blocks[-1].append(m.span())
        else:
            blocks.append([m.span()])
    at, out = 0, []
    for block in blocks:
        for s, e in block:
            while at < len(near) and near[at][1] < s:
                at += 1
            if at < len(near) and near[at][0] <= e:
                out.append(block)
                break
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: float = NOVELTY, low: str | None = None) -> list[tuple[int, int, int]]:
    """Opaque strings that :func:`reached` gives and that stay costly beside their surroundings. They get the kind assign."""
    low = lowered(text) if low is None else low
    out = []
    for block in reached(text, low):
        whole = "".join(text[s:e] for s, e in block)
        if not (re.search("[0-9]", whole) and re.search("[A-Za-z]", whole)):
            continue
        if not any(len(x) >= 16 or _MIXED.search(x) for x in re.split("[-_/+=]", whole)):
            continue
        limit = min(novelty, HEX_NOVELTY) if _HEX_ONLY.fullmatch(whole) else novelty
        costly = False
        for s, e in block:
            costly = marginal_bytes(surroundings(text, s, e), text[s:e]) >= limit * (e - s)
            if costly and not any(bs < e and s < be for bs, _, be in base):
                out.append((s, 0, e))
        last = _LAST_LINE.match(text, block[-1][1]) if costly else None  # too short for a string of its own
        if last and not any(bs < last.end(1) and last.start(1) < be for bs, _, be in base):
            out.append((last.start(1), 0, last.end(1)))
    return out


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                low = lowered(text or "")
                base = base_spans(text, low) if text else []
                more = novel_spans(text, base, novelty, low) if text else []
                counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                digests.append(sha256_hex(span_text(base, KINDS)))
                spans.append(span_text(base + more, KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
