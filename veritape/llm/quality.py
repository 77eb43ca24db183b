"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of six character classes (lower case, upper case, digits, white space,
symbols, other marks) and its histogram of common words (the listed function words and all others)
are compared with each language's by Jensen-Shannon distance (square root of the divergence to
base 2, from 0 to 1). The references are sums over all documents of that language that pass the
base rules. A document fails if its distance even from the nearest reference is over ``MAX_CLASS``
or ``MAX_JS_WORDS``, or if both histograms stray at once (``BOTH``), as lists of words between marks
do; short documents, whose histograms say little, are exempt by ``MIN_CHARS`` and ``MIN_JS_WORDS``, but
those with next to no common word (``SHORT_WORDS``) fail.

Base rules: fewer than 50 words, or over half of the words in repeated 3-word windows.

Per-document lists stay in their row; the only shuffle sums a few numbers per language. Windows are
compared by 64-bit hash within one document. Null text has no words and fails. With no reference
(no language, or no passing document) distances are 0. A language is a reference if it has at least
``LEAST_SHARE`` of the passing documents with a language, which bounds their number; documents of
rarer languages can't be compared with their own and are judged by the base rules only. Repeated
rows give repeated results, an empty table an empty one; a text of any length stays in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.session import cut

MIN_WORDS = 50
MIN_CHARS = 300
MIN_JS_WORDS = 100
MAX_CLASS = 0.30
MAX_JS_WORDS = 0.80
BOTH = (0.10, 0.20)  # class and word distance that fail together
SHORT_WORDS = 0.272  # word distance that fails a text of fewer words: it has next to none of the common ones
LEAST_SHARE = 1 / 256

# The eight most usual function words of English, French, German and Spanish.
COMMON_WORDS = "the of and to in a is that de la le et les des en un der die das und den von zu ist el los que las del se por con".split()

_SPACE = "[\\x20\\x09-\\x0D]"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and commons (arrays of counts)."""
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = df.withColumn("__t", t).withColumn("__w", F.filter(F.split("__t", f"{_SPACE}+"), lambda x: x != ""))
    out = out.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    rest = F.regexp_replace("__t", "\\p{L}+", "")
    out = out.withColumn("__rest", rest)
    out = out.withColumn("n_symbols", (F.length("__rest") - F.length(F.regexp_replace("__rest", "[#*$%&|<>]+", ""))).cast("long"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("__lines", lines).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    hashes = "case when size(__w) >= 3 then transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) else cast(array() as array<bigint>) end"
    out = out.withColumn("__h", F.expr(hashes))
    twice = "transform(filter(transform(s, (x, i) -> named_struct('p', x.p, 'd', (i > 0 and s[i - 1].h = x.h) or (i < size(s) - 1 and s[i + 1].h = x.h))), x -> x.d), x -> x.p)"
    covered = "aggregate(transform(q, (x, i) -> if(i < size(q) - 1, least(3, q[i + 1] - x), 3)), 0, (a, x) -> a + x)"
    repeat = f"case when size(array_distinct(__h)) = size(__h) then 0 else {_let('sort_array(transform(__h, (x, i) -> named_struct(' + chr(39) + 'h' + chr(39) + ', x, ' + chr(39) + 'p' + chr(39) + ', i)))', 's', _let(f'sort_array({twice})', 'q', covered))} end"
    out = out.withColumn("n_repeat_words", F.expr(f"cast({repeat} as bigint)"))
    length, upper = F.length("__t"), F.length("__t") - F.length(F.regexp_replace("__t", "\\p{Lu}+", ""))
    letters, digits = F.length("__t") - F.length("__rest"), F.length("__rest") - F.length(F.regexp_replace("__rest", "[0-9]+", ""))
    space = F.length("__t") - F.col("word_chars")
    classes = F.array(letters - upper, upper, digits, space, F.col("n_symbols"), length - letters - digits - space - F.col("n_symbols"))
    listed = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    out = out.withColumn("classes", classes.cast("array<double>")).withColumn("__c", F.expr(f"filter(__w, x -> x in ({listed}))"))
    each = [F.expr(f"size(filter(__c, x -> x = '{w}'))") for w in COMMON_WORDS]
    out = out.withColumn("commons", F.array(*each, F.size("__w") - F.size("__c")).cast("array<double>"))
    return out.drop("__t", "__w", "__rest", "__lines", "__h", "__c")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(measured: DataFrame, lang_col: str, least_share: float = LEAST_SHARE) -> list[tuple[str, list[float], list[float]]]:
    """Name, class and common-word shares of each language with enough documents, from all of these that pass the base rules."""
    rows = measured.where(F.col(lang_col).isNotNull() & ~base_failed())
    sums = rows.groupBy(lang_col).agg(F.count("*").alias("n"), *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(6)], *[F.sum(F.col("commons")[i]).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)])
    sums = cut(sums, "references")
    total = sums.agg(F.sum("n")).first()[0] or 0
    out = []
    for r in sums.where(F.col("n") >= max(1, least_share * total)).orderBy(lang_col).collect():  # at most 1 / least_share
        c, w = [r[f"c{i}"] for i in range(6)], [r[f"w{i}"] for i in range(len(COMMON_WORDS) + 1)]
        out.append((r[lang_col], [x / sum(c) for x in c], [x / sum(w) for x in w]))
    return out


def _distance(counts: str, refs: list[list[float]]) -> str:
    """SQL for the least Jensen-Shannon distance of a count array from the references; 0 for no counts or references."""
    if not refs:
        return "0D"
    literal = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in r) + ")" for r in refs) + ")"
    half = "if({0} > 0, {0} * log2({0} / {1}), 0D)"
    term = half.format("x", "((x + y) / 2)") + " + " + half.format("y", "((x + y) / 2)")
    each = f"sqrt(greatest(0D, aggregate(zip_with(p, r, (x, y) -> {term}), 0D, (a, x) -> a + x) / 2))"
    shares = _let(f"aggregate({counts}, 0D, (a, x) -> a + x)", "n", f"transform({counts}, x -> if(n > 0, x / n, 0D))")
    return f"case when exists({counts}, x -> x > 0) then {_let(shares, 'p', f'array_min(transform({literal}, r -> {each}))')} else 0D end"


def strays(chars, words, class_distance, word_distance, max_class: float = MAX_CLASS, max_words: float = MAX_JS_WORDS):
    """Whether a document of so many characters and words fails by its distances; for columns and for plain values."""
    enough = words >= MIN_JS_WORDS
    return ((chars >= MIN_CHARS) & (class_distance > max_class)) | (enough & (word_distance > max_words)) | (enough & (class_distance > BOTH[0]) & (word_distance > BOTH[1])) | ((words >= MIN_WORDS) & (words < MIN_JS_WORDS) & (word_distance > SHORT_WORDS))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_class: float = MAX_CLASS, max_words: float = MAX_JS_WORDS) -> DataFrame:
    """doc_id, the measures, class_distance, word_distance, base_failed and kept of each row."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    measured = cut(measures(rows).withColumn("__chars", F.length(F.coalesce("text", F.lit("")))).drop("text"), "quality")
    refs = references(measured, "lang")
    out = measured.withColumn("class_distance", F.expr(_distance("classes", [c for _, c, _ in refs]))).withColumn("word_distance", F.expr(_distance("commons", [w for *_, w in refs])))
    diverges = strays(F.col("__chars"), F.col("n_words"), F.col("class_distance"), F.col("word_distance"), max_class, max_words)
    rare = F.col("lang").isNotNull() & ~F.col("lang").isin([name for name, *_ in refs])
    diverges = diverges & ~F.coalesce(rare, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~diverges).alias("kept"), "class_distance", "word_distance")
