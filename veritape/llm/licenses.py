"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes a list of words (A-Z in lower case; runs of ASCII letters and digits and of any other
characters beyond ASCII). Hundreds of hand-written expressions (:mod:`veritape.llm.license_rules`) are
gated by keywords: a word that is no rule's keyword costs one look into a hash set, and at a keyword
only its own rules are tried, on the ``HEAD`` words before and ``TAIL`` words after it. So the time is
linear in the text, however long, and places of matches are word numbers.

Overlapping detections: one goes if its words lie within those of another of at least its priority
(of two over the same words the greater priority stays, then the earlier rule). Detections in order of
their start, longest first, are judged in one pass that keeps the furthest end of each priority.

Base phrases are rules of the same scan; they are counted before anything is suppressed, and their
labels stay. The score is that of the best rule that stays.

Everything happens within the row: no shuffle, no Python worker, no group. Null and empty texts have
no words, labels or places and score 0; repeated rows give repeated results, an empty table an empty
one, ties are settled by the rules' order, and columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritape.llm.license_rules import Rule, rules

# The phrases that the base rule looks for, and their labels.
BASE = (("under the @mit license", "mit"), ("@apache license version 2", "apache-2"), ("@cc by nc", "cc-by-nc"))

HEAD, TAIL = 12, 16  # words before a keyword, and from it on, that its rules see
SCORES = (0.5, 0.7, 0.9, 1.0)  # by priority, from 1
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def base_rules(phrases: tuple[tuple[str, str], ...] = BASE) -> list[Rule]:
    return [Rule(label, len(SCORES), p.split("@")[1].split()[0], f"(?:^| ){p}(?: |$)") for p, label in phrases]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def detections(words: Column, ordered: list[Rule], n_base: int) -> Column:
    """All matches, as an array of (start, to, before, rule, label, priority, base), sorted: ``to`` and ``before`` are the negated end and priority."""
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(ordered):
        by_keyword.setdefault(r.keyword, []).append(i)

    def entry(i: int) -> Column:
        r = ordered[i]
        fields = {"rule": i, "pattern": r.pattern, "label": r.label, "priority": r.priority, "base": i < n_base}
        return F.struct(*[F.lit(v).alias(k) for k, v in fields.items()])

    table = F.create_map(*[x for k, at in by_keyword.items() for x in (F.lit(k), F.array(*[entry(i) for i in at]))])
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*by_keyword), i)), lambda i: i.isNotNull())

    def tried(i: Column) -> Column:
        head = F.array_join(F.slice(words, F.greatest(i - HEAD, F.lit(0)) + 1, F.least(i, F.lit(HEAD))), " ")
        tail = F.array_join(F.slice(words, i + 1, TAIL), " ")
        seen = F.concat(head, F.when(i > 0, " @").otherwise("@"), tail)
        own = F.element_at(table, F.element_at(words, i + 1))

        def match(window: Column) -> Column:
            found = F.transform(own, lambda r: F.struct(F.trim(F.call_function("regexp_extract", window, r["pattern"], F.lit(0))).alias("m"), r.alias("r")))
            return F.transform(
                F.filter(found, lambda f: f["m"] != ""),
                lambda f: F.struct(
                    (i - _spaces(F.substring_index(f["m"], "@", 1))).alias("start"),
                    (_spaces(F.substring_index(f["m"], "@", 1)) - i - _spaces(f["m"]) - 1).alias("to"),
                    (-f["r"]["priority"]).alias("before"),
                    f["r"]["rule"].alias("rule"),
                    f["r"]["label"].alias("label"),
                    f["r"]["base"].alias("base"),
                ),
            )

        return F.flatten(F.transform(F.array(seen), match))

    return F.array_sort(F.flatten(F.transform(places, tried)))


def resolved(found: Column) -> Column:
    """The labels that stay: an array of (label, n, first, last, priority). Its size is bounded by the rules, whatever the text."""
    kept = "array<struct<label:string,n:bigint,first:int,last:int,priority:int>>"
    start = F.struct(F.array(*[F.lit(0)] * len(SCORES)).alias("ends"), F.array().cast(kept).alias("labels"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["to"], -d["before"]
        covered = F.element_at(acc["ends"], priority) >= end
        ends = F.transform(acc["ends"], lambda e, i: F.when(i < priority, F.greatest(e, end)).otherwise(e))
        new = F.struct(d["label"].alias("label"), F.lit(1).cast("long").alias("n"), d["start"].alias("first"), d["start"].alias("last"), priority.alias("priority"))
        more = F.transform(
            acc["labels"],
            lambda x: F.when(
                x["label"] == d["label"],
                F.struct(x["label"].alias("label"), (x["n"] + 1).alias("n"), x["first"].alias("first"), d["start"].alias("last"), F.greatest(x["priority"], priority).alias("priority")),
            ).otherwise(x),
        )
        labels = F.when(covered, acc["labels"]).when(F.exists(acc["labels"], lambda x: x["label"] == d["label"]), more).otherwise(F.concat(acc["labels"], F.array(new)))
        return F.struct(ends.alias("ends"), labels.alias("labels"))

    return F.aggregate(found, start, step, lambda acc: acc["labels"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple[tuple[str, str], ...] = BASE, more: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``.

    doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest start, from 0; null
    without one), base_labels, labels (base ones and those that stay; sorted, comma-joined), score, and licenses: an array of
    label, number of places, first and last place, and best priority.
    """
    own = base_rules(base)
    ordered = own + (rules() if more is None else more)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), detections(F.col("words"), ordered, len(own)).alias("found"))
    rows = rows.select("doc_id", "n_words", F.filter("found", lambda d: d["base"]).alias("base"), resolved(F.col("found")).alias("licenses"))
    base_labels, starts = F.transform("base", lambda d: d["label"]), F.transform("base", lambda d: d["start"])
    labels = F.array_union(base_labels, F.transform("licenses", lambda x: x["label"]))
    best = F.array_max(F.transform("licenses", lambda x: x["priority"]))
    score = F.coalesce(F.when(F.size("base") > 0, SCORES[-1]), *[F.when(best == k, x) for k, x in enumerate(SCORES, 1)], F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        score.alias("score"),
        "licenses",
    )


def oracle() -> str:
    """The query's rows in DuckDB SQL: words, rules and detections are tables there, and containment is an anti-join."""
    own = base_rules()
    values = ", ".join(f"({i}, '{r.label}', {r.priority}, '{r.keyword}', '{r.pattern}', {str(i < len(own)).lower()})" for i, r in enumerate(own + rules()))
    scores = ", ".join(map(str, SCORES))
    return f"""
with rules(rule, label, priority, keyword, pattern, base) as (values {values}),
docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
places as (select rid, w, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from docs),
gated as (
  select rid, i, word, array_to_string(w[greatest(i - {HEAD}, 0) + 1:i], ' ') || case when i > 0 then ' @' else '@' end || array_to_string(w[i + 1:i + {TAIL}], ' ') as seen
  from places where word in (select keyword from rules)
),
tried as (select rid, i, r.*, trim(regexp_extract(seen, pattern, 0)) as m from gated join rules r on word = keyword),
spans as (
  select rid, rule, label, priority, base, i - (length(split_part(m, '@', 1)) - length(replace(split_part(m, '@', 1), ' ', ''))) as s,
    length(m) - length(replace(m, ' ', '')) + 1 as n from tried where m <> ''
),
stay as (
  select * from spans a where not exists (
    select 1 from spans b where b.rid = a.rid and b.s <= a.s and b.s + b.n >= a.s + a.n and b.priority >= a.priority
      and (b.s <> a.s or b.n <> a.n or b.priority > a.priority or b.rule < a.rule))
),
based as (select rid, count(*) as n_base, min(s) as first_word, max(s) as last_word, list_distinct(list(label)) as ls from spans where base group by 1),
named as (select rid, list_distinct(list(label)) as ls, max(priority) as best from stay group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(list_sort(coalesce(b.ls, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(n.ls, [])))), ',') as labels,
  (case when n_base > 0 then {SCORES[-1]} when best is null then 0.0 else [{scores}][best] end)::double as score
from docs left join based b using (rid) left join named n using (rid)
"""
