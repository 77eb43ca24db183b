"""Sentence ends learned from the corpus itself, without labels (after Kiss and Strunk, 2006).

A word that nearly always bears a period, is short and holds periods inside is an abbreviation: the log
likelihood of "the period belongs to the word" against "periods fall as often as anywhere" is weighted
down by length and by each occurrence without a period. A word that follows sure sentence ends far more
often than chance starts sentences. Both are counts over all texts, summed by word before they are shuffled.

A break of the plain rule is taken back where the word before it is an abbreviation or an initial, unless
the next word is written with a capital and is known to start sentences. The applied model is two lists of words
inside an expression. Only words that make up ``LEAST_SHARE`` of all words or more are learned, so neither
list can pass 1 / ``LEAST_SHARE`` words at any size of the corpus; rarer ones fall to the plain rule.

Null texts have no sentences (null); empty ones an empty list. Repeated texts count each time. Without any
text or period the lists are empty and the plain rule stands.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.functions import vocab as V
from veritape.functions.text import _let as let
from veritape.functions.text import clean_sentence, plain_breaks
from veritape.session import cut, drop_cut

LEAST_SHARE = 1 / 50_000
LEAST_SCORE = 0.3  # of an abbreviation; with the next, values of the paper
LEAST_START = 30.0  # of a sentence starter
SURE = 0.99  # how often a true abbreviation bears its period


def word(token: Column) -> Column:
    """The token in lower case without marks around it; a period at its end stays."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}.]+$", ""))


def bare(w: Column) -> Column:
    return F.regexp_replace(w, r"\.+$", "")


def last_token(part: Column) -> Column:
    """What follows the last white space; a search for a token at the end would try each token before it."""
    return F.regexp_replace(part, f"(?s)^.*[{V.WHITE}]", "")


def first_token(part: Column) -> Column:
    return F.regexp_extract(part, f"^([^{V.WHITE}]+)", 1)


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """token, n: how often each different token stands in the texts."""
    return texts.select(F.explode(F.split(F.col(f"`{text_col}`"), f"[{V.WHITE}]+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def word_counts(texts: DataFrame, text_col: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """word, n_with, n_without: how often each word that has a letter stands with and without a period at its end. ``tokens``: the texts' :func:`token_counts`, if they are there."""
    each = (token_counts(texts, text_col) if tokens is None else tokens).select(word(F.col("token")).alias("w"), "n").where(F.col("w").rlike(r"\p{L}"))
    dot = F.col("w").endswith(".")
    return each.groupBy(bare(F.col("w")).alias("word")).agg(F.sum(F.when(dot, F.col("n")).otherwise(0)).alias("n_with"), F.sum(F.when(dot, 0).otherwise(F.col("n"))).alias("n_without"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """word, n_with, n_without, share, score of the words that ever bear a period."""
    totals = counts.agg(F.sum("n_with").alias("__dots"), F.sum(F.col("n_with") + F.col("n_without")).alias("__all"))
    n, m = F.col("n_with").cast("double"), F.col("n_without").cast("double")
    anywhere = F.col("__dots") / F.col("__all")
    log_likelihood = -2 * (n * F.log(anywhere / SURE) + m * F.log((1 - anywhere) / (1 - SURE)))
    inside = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    length = (F.length("word") - inside).cast("double")
    score = F.when(anywhere < 1, log_likelihood * F.exp(-length) * (inside + 1) * F.pow(length, -m)).otherwise(0.0)
    return counts.where("n_with > 0").crossJoin(F.broadcast(totals)).select("word", "n_with", "n_without", ((n + m) / F.col("__all")).alias("share"), score.alias("score"))  # totals are one row


def start_counts(texts: DataFrame, abbreviations: list[str], text_col: str = "text", tokens: DataFrame | None = None) -> DataFrame:
    """word, n_start, n: how often each word follows a sure sentence end, and how often it follows anything.

    A word follows something wherever it stands but first in a text, so only the breaks after ``.``, ``!`` and ``?`` are
    looked at one by one; the rest are counts of tokens. ``tokens``: the texts' :func:`token_counts`, if they are there.
    """
    none = F.lit(0).cast("long")
    parts = F.split(F.ltrim(F.col(f"`{text_col}`"), F.lit(V.SPACES)), f"(?<=[.!?])[{V.WHITE}]+")
    # the first part follows nothing, and a last one without a token isn't there
    pairs = let(parts, lambda a: F.transform(a, lambda y, i: F.struct(F.when(i > 0, last_token(F.get(a, i - 1))).alias("x"), first_token(y).alias("y"))))
    breaks = texts.select(F.explode(pairs).alias("p")).select("p.x", "p.y").where("y <> ''")
    ends = breaks.select("x", bare(word(F.col("y"))).alias("word")).withColumn("xw", word(F.col("x"))).withColumn("before", bare(F.col("xw")))
    sure = ~(F.col("xw").endswith(".") & ((F.length("before") < 2) | ~F.col("before").rlike(r"\p{L}") | F.col("before").isin(abbreviations)))
    starts = ends.select("word", F.coalesce(sure.cast("long"), none).alias("n_start"), F.when(F.col("x").isNull(), -1).otherwise(0).cast("long").alias("n"))
    each = (token_counts(texts, text_col) if tokens is None else tokens).select(bare(word(F.col("token"))).alias("word"), none.alias("n_start"), "n")
    return each.unionAll(starts).groupBy("word").agg(F.sum("n_start").alias("n_start"), F.sum("n").alias("n")).where("n > 0")


def start_scores(counts: DataFrame) -> DataFrame:
    """word, n_start, n, share, score of the words that follow sentence ends more often than other words."""
    totals = counts.agg(F.sum("n_start").alias("__ends"), F.sum("n").alias("__all"))
    ends, rest = F.col("__ends").cast("double"), (F.col("__all") - F.col("__ends")).cast("double")
    a, b = F.col("n_start").cast("double"), (F.col("n") - F.col("n_start")).cast("double")

    def fit(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)

    p, p1, p2 = (a + b) / (ends + rest), a / ends, b / rest
    score = F.when((ends > 0) & (rest > 0), F.when(p1 > p2, 2 * (fit(a, ends, p1) + fit(b, rest, p2) - fit(a, ends, p) - fit(b, rest, p))))
    starts = counts.where("n_start > 0 and word rlike '\\\\p{L}'").crossJoin(F.broadcast(totals))  # totals are one row
    return starts.select("word", "n_start", "n", (F.col("n") / F.col("__all")).alias("share"), score.alias("score")).where("score is not null")


@dataclass
class SentenceModel:
    abbreviations: list[str]
    starters: list[str]

    def sentences(self, text: Column) -> Column:
        """The cleaned sentences of a text."""

        def glued(left: Column, right: Column) -> Column:
            capital = lambda first: first.rlike(r"^[^\p{L}\p{Nd}]*\p{Lu}") & bare(word(first)).isin(self.starters)
            short = lambda w: w.endswith(".") & let(bare(w), lambda b: b.isin(self.abbreviations) | b.rlike(r"^\p{L}$"))
            return let(word(last_token(left)), short) & ~let(first_token(right), capital)

        def rejoined(parts: Column) -> Column:
            later = F.zip_with(parts, F.slice(parts, 2, F.size(parts)), lambda x, y: F.when(y.isNull(), "").otherwise(F.concat(F.when(glued(x, y), " ").otherwise("\u0001"), y)))
            return F.concat(parts[0], F.array_join(later, ""))

        whole = F.transform(F.array(plain_breaks(text)), rejoined)[0]
        return F.filter(F.transform(F.split(whole, "\u0001"), clean_sentence), lambda x: x != "")


def _abbreviations(tokens: DataFrame, least_share: float) -> list[str]:
    known = abbreviation_scores(word_counts(tokens, tokens=tokens)).where((F.col("score") >= LEAST_SCORE) & (F.col("share") >= least_share))
    return sorted(r.word for r in known.select("word").collect())  # at most 1 / least_share words


def scored_starters(texts: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE) -> tuple[list[str], DataFrame, DataFrame]:
    """The abbreviations of ``texts``, the rows of :func:`start_scores` that are learned, and the written counts that they read."""
    held = texts.select(F.col(f"`{text_col}`").alias("text"))
    tokens = cut(token_counts(held), "tokens")
    short = _abbreviations(tokens, least_share)
    found = start_scores(start_counts(held, short, tokens=tokens)).where((F.col("score") >= LEAST_START) & (F.col("share") >= least_share))
    return short, found, tokens


def fit(texts: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE) -> SentenceModel:
    """Learn from all of ``texts``, in two passes: different tokens are counted and written once, and breaks are judged by what these counts say."""
    short, found, tokens = scored_starters(texts, text_col, least_share)
    starts = [r.word for r in found.select("word").collect()]
    drop_cut(tokens)
    return SentenceModel(short, sorted(starts))
