"""Fiscal quarters as text ``YYYY-Qn``: from dates, folder and file names, and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_quarter(date: Column) -> Column:
    """April starts the fiscal year, which is named by its end: January to March is Q4 of the same year."""
    y, m = F.year(date), F.month(date)
    return F.when(m <= 3, F.concat(y.cast("string"), F.lit("-Q4"))).otherwise(F.concat((y + 1).cast("string"), F.lit("-Q"), F.ceil((m - 3) / 3).cast("string")))


def period_admitted(start: Column, end: Column, most: int = 105) -> Column:
    """At most ``most`` days; a period that can't be parsed is not held against a fact."""
    day = lambda c: F.try_to_date(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.coalesce(F.datediff(day(end), day(start)) <= most, F.lit(True))


def normalise_quarter(c: Column) -> Column:
    """Free text to ``YYYY-Qn``. Without FY, Q1 to Q3 move to the next year, each time it is applied; text without a quarter is only put in upper case."""
    q = F.upper(F.trim(c))
    before, after = r"([1-4])[Qq].*?(?:FY|20)?(\d{2,4})", r"[Qq]([1-4]).*?(?:FY|20)?(\d{2,4})"
    plain = q.rlike(r"^\d{4}-Q[1-4]$")
    part = lambda i: F.when(q.rlike(before), F.regexp_extract(q, before, i)).when(q.rlike(after), F.regexp_extract(q, after, i)).when(plain, F.substring(q, 7, 1) if i == 1 else F.substring(q, 1, 4))
    n, y = part(1).cast("int"), part(2).cast("int")
    exact = plain & ~q.rlike(before) & ~q.rlike(after)
    year = F.when((y < 100) & ~exact, y + 2000).otherwise(y)
    shifted = F.when(q.contains("FY") | (n == 4), year).otherwise(year + 1)
    return F.when(year.isNotNull() & (year != 0), F.concat(shifted.cast("string"), F.lit("-Q"), n.cast("string"))).otherwise(q)


def folder_year(c: Column) -> Column:
    """The year in a folder name, or null: the second of ``24-25``, the digits at the end after ``_`` or a space, else a 20xx."""
    pair = F.regexp_extract(c, r"(\d{2})-(\d{2})", 2)
    end = F.regexp_extract(c, r"[_\s](\d{2,4})$", 1)
    any_ = F.regexp_extract(c, r"(20\d{2})", 1)
    n = lambda x: F.nullif(x, F.lit("")).cast("int")
    return F.when(pair != "", n(pair) + 2000).when(end != "", F.when(n(end) > 2000, n(end)).otherwise(n(end) + 2000)).when(any_ != "", n(any_))


def file_quarter(name: Column, year: Column) -> Column:
    q = F.regexp_extract(name, "[Qq]([1-4])", 1)
    return F.when(year.isNull(), F.lit("Unknown")).when(q != "", F.concat(year.cast("string"), F.lit("-Q"), q)).otherwise(F.concat(year.cast("string"), F.lit("-Unknown")))


def sort_key(c: Column) -> Column:
    """struct(year, quarter) for ``YYYY-Qn``; (0, 0) for anything else."""
    good = c.rlike(r"^\s*[+-]?\d+\s*-Q\s*[+-]?\d+\s*$")
    return F.struct(
        F.when(good, F.trim(F.split_part(c, F.lit("-Q"), F.lit(1))).cast("int")).otherwise(0).alias("y"),
        F.when(good, F.trim(F.split_part(c, F.lit("-Q"), F.lit(2))).cast("int")).otherwise(0).alias("q"),
    )


def reference_type(sentence: Column) -> Column:
    low = F.lower(sentence)
    return F.when(low.contains("yoy") | low.contains("year"), "yoy").otherwise("qoq")
