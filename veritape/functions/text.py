"""Text expressions: cleaning, sentence rules, metric, direction and magnitude extraction. All Column to Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritape.functions import vocab as V


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(V.SPACES))


def clean_sentence(c: Column) -> Column:
    """Line breaks and tabs to spaces, runs of white space to one, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\r\n\t]+", " "), f"[{V.WHITE}]{{2,}}", " "))


def strip_artefacts(c: Column) -> Column:
    """Cleaned, and cut from the first page or confidentiality mark on; a mark inside a word counts too."""
    return strip(F.regexp_replace(clean_sentence(c), V.ARTEFACT, ""))


def dedup_key(c: Column) -> Column:
    """Lower case, runs of white space to one, every other character to a space of its own, so ``a, b`` differs from ``a b``."""
    return F.trim(F.regexp_replace(F.lower(c), f"(?![{V.KEY_LETTERS}])(?:[{V.WHITE}]{{2,}}|[^ ])", " "))  # a single space stays as it is


def clean_lower(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, f"[{V.WHITE}]+", " ")))


def clean_lines(c: Column) -> Column:
    """Unified line ends, without lines of digits and marks only and lines of three characters or fewer; kept lines stay as they are."""
    lines = F.split(F.regexp_replace(c, "\r\n|\r", "\n"), V.LINE_END)
    return F.array_join(F.filter(lines, lambda x: (F.length(strip(x)) > 3) & ~strip(x).rlike(V.LINE_NOISE)), "\n")


def plain_breaks(c: Column) -> Column:
    """The parts of a text that end with ``.``, ``!`` or ``?`` and white space."""
    return F.split(F.regexp_replace(c, f"([.!?])[{V.WHITE}]+", "$1\u0001"), "\u0001")


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space. A deterministic rule; ``operators/sentence_model.py`` learns where it is wrong.

    A break takes a whole run of white space, so a text is cleaned as its sentences are: at once, rather than one by one.
    """
    cleaned = F.regexp_replace(c, f"(?![{V.PRINTED}])(?:[{V.WHITE}]{{2,}}|[\r\n\t])", " ")
    return F.filter(F.transform(plain_breaks(cleaned), strip), lambda x: x != "")


def is_valid_sentence(c: Column) -> Column:
    """20 characters, none of ``SENTENCE_MARKS``, and three runs of two letters; so it isn't of numbers only, nor of six letters."""
    low = F.lower(c)
    marked = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in V.SENTENCE_MARKS])
    return (F.length(c) >= 20) & ~marked & (F.size(F.regexp_extract_all(c, F.lit("([a-zA-Z]{2,})"), 1)) >= 3)


def hard_exclusion(c: Column) -> Column:
    """Questions, transitions, numbers only, or under 25 characters: never a claim."""
    s = strip(c)
    return s.endswith("?") | s.rlike(V.TRANSITION) | s.rlike(V.GARBAGE) | (F.length(s) < 25)


def is_noise(c: Column) -> Column:
    return (F.length(c) < 40) | c.contains("Page") | c.contains("Classification")


def is_numeric_claim(c: Column) -> Column:
    return c.rlike(V.NUMERIC_CLAIM)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _longest(words: list[str], before: str = "") -> str:
    """A pattern of the longest of ``words`` that begins at a place, as group 1. ``before``: what must hold there.

    Most places are ruled out by the sets of first, second and third letters. Words that begin alike share their beginning.
    """
    tree: dict = {}
    for w in words:
        at = tree
        for letter in w:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        rest = [re.escape(letter) + pattern(below) for letter, below in sorted(at.items()) if letter]
        if not rest:
            return ""
        return f"(?:{'|'.join(rest)})" + "?" * ("" in at) if len(rest) > 1 or "" in at else rest[0]

    sets = ["".join(sorted({re.escape(w[i]) for w in words})) for i in range(min(3, *map(len, words)))]
    return f"(?={''.join(f'[{x}]' for x in sets)}){before}({pattern(tree)})"


def _different(found: Column, words: list[str]) -> Column:
    """How many different ``words`` begin one of ``found``, which are words themselves."""
    inside = {w: [x for x in words if w.startswith(x)] for w in words}
    inside = {w: xs for w, xs in inside.items() if len(xs) > 1}
    if inside:
        known = F.create_map(*[x for w, xs in inside.items() for x in (F.lit(w), F.array(*[F.lit(y) for y in xs]))])
        found = F.flatten(F.transform(found, lambda w: F.when(w.isin(list(inside)), F.element_at(known, w)).otherwise(F.array(w))))
    return F.size(F.array_distinct(found))


def keyword_score(c: Column, performance: list[str] | None = None, direction: list[str] | None = None) -> Column:
    """Performance words found as substrings plus direction words that begin some word of letters.

    Each list is one pattern that is tried once at each place, instead of a search of the text for each word.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    anywhere, begun = performance or V.PERFORMANCE_KEYWORDS, direction or V.DIRECTION_KEYWORDS
    inside = F.regexp_extract_all(low, F.lit(f"(?={_longest(anywhere)})"), 1)  # words may overlap
    return (_different(inside, anywhere) + _different(F.regexp_extract_all(low, F.lit(_longest(begun, "(?<![a-z])")), 1), begun)).cast("long")


def _negated(text: Column, low: Column, pattern: str) -> Column:
    """Whether ``text`` matches a pattern of negations, of which only a text with one of ``NEGATION_PARTS`` has any."""
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in V.NEGATION_PARTS]) & text.rlike(pattern)


def is_likely_claim(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) >= 25) & ~s.endswith("?") & ~s.rlike(V.GARBAGE) & ~s.rlike(V.TRANSITION_SHORT) & ~_negated(s, F.lower(s), V.NEGATION) & (keyword_score(s) >= 3)


def contrast_parts(c: Column, pattern: str = V.CONTRAST, least: int = 20) -> Column:
    """Parts between contrast words (case-sensitive), trimmed, over ``least`` characters."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda p: F.length(p) > least)


def metrics(c: Column, vocabulary: list[tuple[str, list[str]]] | None = None) -> Column:
    """Names whose keywords occur in the lower-cased text, in vocabulary order."""

    def hits(low: Column) -> Column:
        found = [F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in vocabulary or V.METRIC_KEYWORDS]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return _let(F.lower(c), hits)


def direction(c: Column, metric: Column) -> Column:
    """decrease, increase, neutral or null. Patterns match inside words. The last resort is ``better`` within eight words of the metric."""
    near_word = lambda ws: F.exists(F.transform(ws, lambda w, i: F.contains(w, metric) & F.contains(F.array_join(F.slice(ws, F.greatest(F.lit(1), i - 7), i + 9 - F.greatest(F.lit(1), i - 7)), " "), F.lit(V.NEARBY_INCREASE))), lambda x: x)

    def found(low: Column) -> Column:
        near = F.contains(low, F.lit(V.NEARBY_INCREASE)) & F.contains(low, metric) & _let(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1), near_word)
        return F.when(low.rlike(V.DECREASE), "decrease").when(low.rlike(V.INCREASE), "increase").when(low.rlike(V.SOFT) | low.rlike(V.NEUTRAL), "neutral").when(near, "increase")

    return _let(F.lower(c), found)


def magnitude(c: Column) -> Column:
    """The first number with a unit, or null."""
    return F.nullif(F.regexp_extract(c, "(?i)" + V.MAGNITUDE, 1), F.lit(""))


def signal_title(c: Column) -> Column:
    """The first eight words without trailing marks, and an ellipsis if there are more."""
    words = F.filter(F.split(c, f"[{V.WHITE}]+"), lambda x: x != "")
    return F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, 8), " "), "[,.;]+$", ""), F.when(F.size(words) > 8, "…").otherwise(""))


def display_name(c: Column, strict: bool = True) -> Column:
    """The folder name without ``2024 Quarterly Data``; not ``strict``: without the year too."""
    return F.trim(F.regexp_replace(c, r"(?i)\s*\d{4}\s*Quarterly\s*Data\s*" if strict else r"(?i)\s*(\d{4}\s*)?Quarterly\s*Data\s*", ""))


def company_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def vector_id(company: Column, ordinal: Column) -> Column:
    return F.concat(F.substring(F.replace(company, F.lit(" "), F.lit("_")), 1, 30), F.lit("_"), ordinal.cast("string"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_")


def local_name(c: Column) -> Column:
    """What follows the last ``}``, or else the last ``:``."""
    return F.when(c.contains("}"), F.element_at(F.split(c, "[}]"), -1)).otherwise(F.element_at(F.split(c, ":"), -1))


def parse_answer(c: Column) -> Column:
    """A model's answer as struct(explanation, positive, negative): the last SUMMARY line (the whole text without one), POS and NEG lines."""
    text = F.trim(c)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def lined(mark: str) -> Column:
        return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(mark))), lambda x: F.trim(F.replace(x, F.lit(mark), F.lit(""))))

    summary = lined("SUMMARY:")
    last = F.when(F.size(summary) > 0, F.nullif(F.element_at(summary, -1), F.lit("")))
    return F.struct(F.coalesce(last, text).alias("explanation"), lined("POS:").alias("positive"), lined("NEG:").alias("negative"))


def context_lines(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def nlp_features(c: Column) -> Column:
    """Lexical stand-in for a parser's features: struct of counts and flags that :func:`is_claim` takes.

    An entity is a number, percent or money sign; the root is the first verb of any list; the subject is the words before it.
    """
    # only words of the lists count, and their order is that of the text
    listed = _longest(V.NOUNS + V.ADJECTIVES + V.VERBS + V.SPEECH_VERBS + V.BE_VERBS, "(?<![a-z])") + "(?![a-z])"
    return _let(F.lower(c), lambda low: _let(F.regexp_extract_all(low, F.lit(listed), 1), lambda known: _of_known(c, low, known)))


def _of_known(c: Column, low: Column, known: Column) -> Column:
    count = lambda vocabulary: F.size(F.filter(known, lambda w: w.isin(vocabulary))).cast("long")
    verb = F.array_min(F.transform(known, lambda w, i: F.when(w.isin(V.VERBS + V.SPEECH_VERBS + V.BE_VERBS), i)))
    subject = F.exists(F.slice(known, 1, verb), lambda w: w.isin(V.NOUNS))
    return F.struct(
        count(V.NOUNS).alias("nouns"),
        count(V.VERBS).alias("verbs"),
        count(V.ADJECTIVES).alias("adjectives"),
        c.rlike(rf"[{V.DIGIT}%₹$]").alias("entity"),
        F.coalesce(subject, F.lit(False)).alias("subject"),
        F.coalesce(F.get(known, verb), F.lit("")).alias("root"),
        _negated(low, low, V.NEGATED).alias("negated"),
    )


def is_claim(c: Column, f: Column) -> Column:
    """The rule classifier over a feature struct, in rule order."""
    return _let(f, lambda held: _judged(c, held))


def _judged(c: Column, f: Column) -> Column:
    strong = (f.subject & f.root.isin(V.VERBS)) | ((f.nouns >= 1) & (f.verbs >= 1)) | ((f.nouns >= 1) & f.entity) | (f.nouns + f.verbs + f.adjectives >= 4) | ((f.nouns >= 1) & (f.adjectives >= 1))
    return (
        F.when(hard_exclusion(c) | f.negated, False)
        .when(f.root.isin(V.SPEECH_VERBS) & ~f.entity, False)
        .when(f.root.isin(V.BE_VERBS), ((f.nouns >= 1) & f.entity) | (f.subject & (f.adjectives >= 1)))
        .otherwise(strong)
    )
