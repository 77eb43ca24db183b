"""Fill-in-middle transformation: a text becomes prefix, middle and suffix, rearranged between marks.

Each text is decoded to an array of code points (UTF-32). Every code point has a class; comparing
the classes of neighbours and taking ``flatnonzero`` gives the boundaries of its units, whichever
they are: lines (up to and with their newline), words (with the white space after them) or single
code points. Two ranks drawn for the document index the boundaries, and the pieces between them are
sliced and encoded again. Whether and how a text is rearranged follows from a hash of its id alone,
so every run, and every retry of a lost task, gives the same rows.

:func:`restore` rebuilds the text from the output and its form in DataFrame functions. It is exact:
a text that contains a mark stays plain, and a mark can't arise across a border, since marks must
not overlap one another (``check_marks``).

A null text counts as empty and stays plain, as does an empty one; a null id counts as an empty one
in the hash. Repeated rows give repeated results, an empty table an empty one, columns may have any
name, and a text of any length is cut whole: memory is that of an Arrow batch and four bytes a code
point of one text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.llm.common import arrow_map, texts_of

SEED = 7
RATE = 100  # percent of texts that are rearranged
SPM = 50  # percent of these that begin with the suffix
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
UNITS = ("line", "word", "char")
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must differ, be nonempty, and no end of one may begin another: else a text could seem to hold a mark across a border."""
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError(f"the marks {a!r} and {b!r} overlap")


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def encode(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end: 0, the places between two neighbours that part units, and the length. An empty text has only 0."""
    if unit == "line":
        newline = points == 10
        parted = newline[:-1]  # whatever follows a newline begins a line
    elif unit == "word":
        space = np.isin(points, _SPACES)
        parted = space[:-1] & ~space[1:]
    elif unit == "char":
        parted = np.ones(max(len(points) - 1, 0), bool)
    else:
        raise ValueError(f"unit must be one of {UNITS}")
    inner = np.flatnonzero(parted) + 1
    return np.concatenate(([0], inner, [len(points)])) if len(points) else np.zeros(1, np.int64)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int(x) for x in np.frombuffer(digest, ">u4", 4))


def rearrange(doc_id: int | None, text: str, unit: str, seed: int, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    points = codepoints(text)
    bounds = boundaries(points, unit)
    n = len(bounds) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if n == 0 or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    at, to = int(bounds[first]), int(bounds[last])
    prefix, middle, suffix = encode(points[:at]), encode(points[at:to]), encode(points[to:])
    p, s, m = marks
    if h4 % 100 < spm:
        return n, "spm", at, to - at, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", at, to - at, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, one row for each row of ``docs``."""
    check_marks(marks)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        cut = [rearrange(i, t or "", unit, seed, rate, spm, marks) for i, t in zip(ids, texts, strict=True)]
        columns = list(zip(*cut, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return arrow_map(texts_of(docs, id_col, text_col), rows, SCHEMA)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = marks

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(output, a, -1), b, 1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle(seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """The query's rows in DuckDB SQL, for lines and the marks above."""
    p, s, m = MARKS
    return f"""
with hashed as (select doc_id, coalesce(text, '') as t, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h from documents),
numbers as (
  select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as l, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2,
    ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4
  from hashed
),
ranks as (select *, len(l) as n, least(h1 % (len(l) + 1), h2 % (len(l) + 1))::bigint as a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1))::bigint as b from numbers),
pieces as (
  select *, case when t = '' or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end as form,
    array_to_string(l[1:a], '') as p, array_to_string(l[a + 1:b], '') as m, array_to_string(l[b + 1:], '') as s
  from ranks
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(p) end::bigint as prefix_chars,
  case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'psm' then '{p}' || p || '{s}' || s || '{m}' || m when 'spm' then '{s}' || s || '{p}' || p || '{m}' || m else t end) as output_sha256,
  sha256(t) as restored_sha256
from pieces
"""
