"""Language ID by rank-order profiles.

A profile lists a language's most frequent letter n-grams (1 to 3) by rank. A document's own
profile is compared with each language's by out-of-place distance: the sum, over the document's
n-grams, of how far each stands from its place in the language's list, or the full length of the
list if it isn't there. The nearest language wins; ties go to the smaller language name.

Counting covers every training document: each batch adds up n-grams per language, Spark sums the
counts, and a window over a language's distinct n-grams keeps the top ``profile_size``. Profiles are
broadcast in blocks of ``max_languages`` languages, and a document meets one block after the other,
so any number of languages can be learned.

Letters are those of Unicode, in all planes. Null or letterless text gives ``und`` with score 0.
Without any usable training row every document is ``und``. Repeated rows give repeated results, and
an empty table an empty one. Time is linear in a text, however long, and columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritape.llm.common import release, short_batches
from veritape.session import cut

PROFILE_SIZE = 400
MAX_LANGUAGES = 2000
HELD_OUT = (4, 2)
CHUNK = 1 << 21  # n-gram codes that training holds at a time, besides one document's


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Each code point that is a letter, itself; 0 for the others."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((i if chr(i).isalpha() else 0 for i in range(0x110000)), np.int32, 0x110000)
    return _LETTERS


def ngram_codes(text: str) -> np.ndarray:
    """The codes of all 1- to 3-grams of the letters of ``text``; other characters part words, a run of them counts as one space.

    A code holds its letters' code points, 21 bits each, so no two n-grams share one: three in the order of the text, two with
    the sign bit, one in the highest place.
    """
    c = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
    letter = c != 0
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of spaces, the first stays
    keep[0] = True
    c = c[keep]
    if not c[1]:
        c = c[1:]
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    two = (c[:-1] << 21) | c[1:] | np.int64(-(1 << 63))
    return np.concatenate((c[c != 0] << 42, two, three[c[1:-1] != 0]))


def top_ngrams(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first; ties by code."""
    grams, n = np.unique(codes, return_counts=True)
    return grams[np.lexsort((grams, -n))[:size]]


def is_held_out(df: DataFrame, id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))


def train_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank) from rows with a text and a language, all of which are counted."""
    rows = short_batches(df).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            held = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(codes := ngram_codes(text))
                held += len(codes)
                if held > CHUNK:
                    yield from counted(by)
                    held = 0
            yield from counted(by)

    def counted(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        while by:
            lang, codes = by.popitem()
            grams, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def load_profiles(rows: list, size: int = PROFILE_SIZE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language names in order, the sorted n-grams of all profiles, and a rank for each n-gram and language (``size`` if absent)."""
    langs = sorted({r.lang for r in rows})
    grams = np.unique(np.array([r.gram for r in rows], dtype=np.int64))
    ranks = np.full((len(grams), len(langs)), size, dtype=np.int32)
    place = {x: i for i, x in enumerate(langs)}
    for r in rows:
        ranks[np.searchsorted(grams, r.gram), place[r.lang]] = r.rank
    return langs, grams, ranks


def score_text(text: str | None, langs: list[str], grams: np.ndarray, ranks: np.ndarray, size: int = PROFILE_SIZE) -> tuple[str, float]:
    """The nearest language and a score: 1 for a profile in its exact place, 0 if no n-gram is known."""
    codes = ngram_codes(text) if text else np.empty(0, np.int64)
    if not len(codes) or not langs:
        return "und", 0.0
    top = top_ngrams(codes, size)
    at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
    known = grams[at] == top
    own = np.arange(len(top))[known]
    place = ranks[at[known]]
    off = np.where(place < size, np.abs(place - own[:, None]), size).sum(axis=0) + (len(top) - len(own)) * size
    best = int(np.argmin(off))
    return langs[best], float(1.0 - off[best] / (len(top) * size))


def identify(df: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE_SIZE, keep: tuple[str, ...] = (), max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """``keep`` columns, then lang_pred and score, of each row of ``df``; only the text decides. Kept columns of those two names go."""
    short_batches(df)
    profiles = cut(profiles, "profiles")
    names = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    kept = [c for c in (keep or (id_col,)) if c not in ("lang_pred", "score")]
    fields = df.select(*[f"`{c}`" for c in kept]).schema.fields
    out = df.select(*[f"`{c}`" for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = T.StructType([*fields, T.StructField("__text", T.StringType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    for at in range(0, len(names), max_languages):
        rows = profiles.where(F.col("lang").between(names[at], names[min(at + max_languages, len(names)) - 1])).collect()
        out = _best_of(out, df.sparkSession.sparkContext.broadcast(load_profiles(rows, size)), size, schema)
    return out.drop("__text")


def _best_of(df: DataFrame, model, size: int, schema: T.StructType) -> DataFrame:
    """lang_pred and score replaced where a language of ``model`` is nearer than those before it."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, ranks = model.value
        for batch in batches:
            *kept, text, lang, score = batch.columns
            out = []
            for t, *old in zip(text.to_pylist(), lang.to_pylist(), score.to_pylist(), strict=True):
                new = score_text(t, langs, grams, ranks, size)
                out.append(new if old[0] == "und" or new[1] > old[1] else old)
            yield pa.RecordBatch.from_arrays([*kept, text, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], batch.schema.names)
        release()

    return df.mapInArrow(predict, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out and label every row: doc_id, held_out, lang_pred, score."""
    profiles = train_profiles(docs.where(~is_held_out(docs)))
    labelled = identify(docs, profiles)
    return labelled.select("doc_id", is_held_out(labelled).alias("held_out"), "lang_pred", "score")
