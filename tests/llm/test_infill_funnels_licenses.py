"""Fill-in-middle, funnel counting and license scan against brute force."""

import collections
import hashlib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veritape.llm import funnels, infill, licenses
from veritape.llm.license_rules import Rule, rules

TEXTS = [
    (1, "one\ntwo\nthree"),
    (2, "one\n\n\ntwo\n"),
    (3, "\n"),
    (4, ""),
    (5, None),
    (None, "no id\nat all"),
    (6, "has a <M> mark\nin it"),
    (7, "café \U0001f600\n  \x00 x<\nS>\ttail  "),
    (8, "long line " * 9000 + "\n" + "x\n" * 20000),
    (9, "same\ntext\nhere"),
    (9, "same\ntext\nhere"),
    (10, "<P"),
    (11, "a\r\nb\rc"),
]
CLASH = ["n", "form", "output", "words", "found", "labels", "c", "at", "w", "bits", "step", "gap", "funnel"]


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fim(doc_id, text, rate=100, spm=50):
    """The contract, by regular expression."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 100), (0, 0), (100, 0)])
def test_infill(spark, rate, spm):
    more = [(100 + i, "\n".join(f"line {k} of {i}" for k in range(i % 7))) for i in range(60)]
    df = with_clashes(spark.createDataFrame(TEXTS + more, "doc_id long, text string"))
    out = infill.fill_in_middle(df, rate=rate, spm=spm).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out), key=repr)
    assert got == sorted(((i, *fim(i, t or "", rate, spm), t or "") for i, t in TEXTS + more), key=repr)
    if rate == 100 and spm == 50:
        assert {g[2] for g in got} == {"plain", "spm", "psm"}


def test_infill_units(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for unit, pattern in (("word", r"\A[ \t\n\r\x0b\x0c]+|[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*"), ("char", r"(?s).")):
        out = infill.fill_in_middle(df, unit=unit).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
        assert sorted((r.restored for r in out)) == sorted(t or "" for _, t in TEXTS)
        assert sorted(r.n for r in out) == sorted(len(re.findall(pattern, t or "")) for _, t in TEXTS)
    assert infill.fill_in_middle(df.limit(0)).count() == 0
    other = ("[a]", "[b]", "[c]")
    out = infill.fill_in_middle(df, marks=other).withColumn("restored", infill.restore(F.col("output"), F.col("form"), other)).collect()
    assert sorted(r.restored for r in out) == sorted(t or "" for _, t in TEXTS) and not [r for r in out if r.doc_id == 6 and r.form == "plain"]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "bc", "d"), ("aa", "b", "c"), ("x", "axb", "c")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(df, marks=bad)


def brute_funnels(rows, within=timedelta(minutes=15), percent=50, plans=funnels.FUNNELS):
    times = collections.defaultdict(set)
    for c, k, t in rows:
        if None not in (c, k, t):
            times[c].add((t, k))
    found = {}
    for name, steps, out in plans:
        for c, ts in times.items():
            gaps = [[] for _ in steps]
            for start in (t for t, k in ts if k == steps[0]):
                gaps[0].append(None)
                prev = start
                for i, kind in enumerate(steps[1:], 1):
                    later = [t for t, k in ts if k == kind and t > prev]
                    if not later or min(later) - prev > within or any(k == out and prev < t <= min(later) for t, k in ts):
                        break
                    gaps[i].append((min(later) - prev) // timedelta(microseconds=1))
                    prev = min(later)
            if gaps[0]:
                mid = [sorted(g)[-(-percent * len(g) // 100) - 1] if g else None for g in gaps[1:]]
                found[name, c] = (*map(len, gaps), sum(map(bool, gaps)), *mid)
    depth = collections.Counter((k[0], v[4]) for k, v in found.items())
    return {k: (*v, depth[k[0], v[4]]) for k, v in found.items()}


def clicks_of(seed, n, clients=6):
    rng = random.Random(seed)
    kinds, base, rows = ["view"] * 6 + ["click"] * 5 + ["purchase"] * 3 + ["signup", "error", "other", None], datetime(2024, 3, 9, 22), []
    for _ in range(n):
        t = base + timedelta(minutes=rng.randrange(0, 4000), seconds=rng.choice([0, 0, 30]), microseconds=rng.choice([0, 0, 1, 999_999]))
        rows.append((rng.choice([0, 0, 0, *range(clients), None]), rng.choice(kinds), None if rng.random() < 0.02 else t))
    return rows + rows[: n // 10]


@pytest.mark.parametrize(("window", "zone"), [(timedelta(hours=3), "UTC"), (timedelta(minutes=16), "America/New_York"), (timedelta(days=9), "Asia/Kolkata")])
def test_funnels(spark, window, zone):
    rows = clicks_of(int(window.total_seconds()), 1500)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = with_clashes(spark.createDataFrame(rows, "client_id long, kind string, ts timestamp_ntz"))
        got = {(r[0], r[1]): tuple(r[2:]) for r in funnels.count_funnels(df, window=window).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == brute_funnels(rows) and len({v[4] for v in got.values()}) > 2


def test_funnels_edges(spark):
    t = datetime(2024, 1, 1, 2, 59, 59, 999_999)  # the last microsecond of a window
    m = timedelta(minutes=15)
    rows = [(1, "view", t), (1, "click", t + m), (1, "view", t + 2 * m), (1, "purchase", t + 3 * m)]
    rows += [(2, "view", t), (2, "click", t + m + timedelta(microseconds=1))]
    rows += [(3, "view", t), (3, "click", t + m), (3, "error", t + m)]  # excluded at the very time of the step
    rows += [(4, "view", t), (4, "error", t), (4, "click", t + m)]  # excluded at the start: not later than it
    rows += [(5, "click", t), (5, "click", t), (6, "click", t), (6, "click", t + m), (6, "purchase", t + m)]
    rows += [(7, "purchase", t), (None, "view", t), (8, None, t), (8, "view", None)]
    df = spark.createDataFrame(rows, "client_id long, kind string, ts timestamp_ntz")
    got = {(r[0], r[1]): tuple(r[2:]) for r in funnels.count_funnels(df).collect()}
    assert got == brute_funnels(rows)
    assert got["A", 1][:5] == (2, 1, 1, 1, 4) and got["A", 2][4] == 1 and got["A", 3][4] == 1 and got["A", 4][4] == 2 and got["C", 5][:2] == (1, 0)
    assert funnels.count_funnels(df.limit(0)).count() == 0
    assert funnels.count_funnels(df.where("kind = 'purchase'")).count() == 0
    short = (("S", ("view", "click"), "error"),)
    named = funnels.count_funnels(df.selectExpr("cast(client_id as string) who", "kind what", "cast(ts as timestamp) when"), short, client_col="who", kind_col="what", time_col="when", percent=100)
    assert {(r.client_id, r.n1, r.n2, r.deepest) for r in named.collect()} == {("1", 2, 1, 2), ("2", 1, 0, 1), ("3", 1, 0, 1), ("4", 1, 1, 2)}


def test_funnel_percentiles(spark):
    rng = random.Random(4)
    rows = [("F", c, s, None if s == 1 else rng.choice([0, 1, 7, 32767, 32768, rng.randrange(900_000_001)]), rng.randrange(1, 4)) for c in range(5) for s in (1, 2, 3) for _ in range(40)]
    df = spark.createDataFrame(rows, "funnel string, client_id long, step int, gap long, n long").groupBy("funnel", "client_id", "step", "gap").agg(F.sum("n").alias("n"))
    for percent in (0, 1, 50, 99, 100):
        got = {(r.client_id, r.step): r.gap for r in funnels.percentile(df, percent, 900_000_000).collect()}
        for c in range(5):
            for s in (2, 3):
                all_gaps = sorted(g for _, c2, s2, g, n in rows if (c2, s2) == (c, s) for _ in range(n))
                assert got[c, s] == all_gaps[max(-(-percent * len(all_gaps) // 100), 1) - 1]


def brute_licenses(text, ordered, n_base):
    """Words, all detections, and those that another covers, by plain comparison of all pairs."""
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spans = []
    for i, word in enumerate(words):
        seen = " ".join([*words[max(0, i - licenses.HEAD) : i], "@" + " ".join(words[i : i + licenses.TAIL])])
        for k, r in enumerate(ordered):
            if r.keyword == word and (m := re.search(r.pattern, seen)):
                before = m[0].strip().split("@")[0].count(" ")
                spans.append((i - before, i - before + m[0].strip().count(" ") + 1, r.priority, k))
    stay = [a for a in spans if not any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[:2] != a[:2] or b[2] > a[2] or b[3] < a[3]) for b in spans)]
    base = [s for s in spans if s[3] < n_base]
    labels = {ordered[s[3]].label for s in stay}
    based = {ordered[s[3]].label for s in base}
    score = 1.0 if base else max((licenses.SCORES[s[2] - 1] for s in stay), default=0.0)
    starts = [s[0] for s in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(based)), ",".join(sorted(based | labels)), score


PLANTED = {
    "Released under the MIT License, (c) 2020": "mit",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
    "This work is licensed under the GNU General Public\n License, version 3.": "gpl-3",
    "GNU Lesser General Public License v2.1": "lgpl-2.1",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc,cc-by-nc-sa",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "see http://www.apache.org/licenses/LICENSE-2.0 for it": "apache-2",
    "Apache License, Version 2.0": "apache-2",
    "the Apache License": "apache",
    "under the three-clause BSD license": "bsd-3-clause",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Mozilla Public License, v. 2.0": "mpl-2",
    "All rights reserved.": "proprietary",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "a mit of a license, the artistic freedom of apache people": "",
    "she took the mit and left": "",
    "UNDER THE MIT LICENSE cc by nc cc-by-nc; under  the mit\tlicense x": "cc-by-nc,mit",
    "İunder the mit license K cc by ncé": "cc-by,mit",
}


def test_licenses(spark):
    more = [None, "", " \n", "a b " * 30000 + "under the mit license", "Under the MIT License. " * 400, "CC BY-NC", "x under the mit", "mit license cc by", "under the mit license under the mit license"]
    texts = [*PLANTED, *more, *more]
    df = with_clashes(spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    out = licenses.scan(df).drop("licenses")
    own = licenses.base_rules()
    ordered = own + rules()
    got = {r.doc_id or 0: tuple(r[1:]) for r in out.collect()}
    short = {i: brute_licenses(t, ordered, len(own)) for i, t in enumerate(texts)}
    assert got == short
    for i, (text, labels) in enumerate(PLANTED.items()):
        assert got[i][5] == labels, text
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_rules_resolve(spark):
    """Priority, containment, order and counts, with rules of our own."""
    assert len(rules()) > 200
    ordered = [Rule("low", 1, "b", "(?:^| )a @b c(?: |$)"), Rule("in", 1, "b", "(?:^| )@b(?: |$)"), Rule("high", 2, "b", "(?:^| )@b c d(?: |$)"), Rule("same", 1, "c", "(?:^| )a b @c(?: |$)")]
    texts = ["a b c", "a b c d", "b", "b b", "b c d", "a b", "z a b c d z b a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df, base=(), more=ordered).collect():
        assert tuple(r[1:8]) == brute_licenses(texts[r.doc_id], ordered, 0)
    rows = {r.doc_id: r.licenses for r in licenses.scan(df, base=(), more=ordered).collect()}
    assert [tuple(x) for x in rows[0]] == [("low", 1, 0, 0, 1)] and [tuple(x) for x in rows[3]] == [("in", 2, 0, 1, 1)]
    assert [x.label for x in rows[1]] == ["low", "high"] and [tuple(x)[:4] for x in rows[6]] == [("low", 2, 1, 7), ("high", 1, 2, 2), ("in", 1, 6, 6)]


def test_sql(spark):
    import duckdb

    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "clicks"):
        duck.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name in ("op11_fill_in_middle", "op12_funnel_sweep", "op13_license_rules"):
        df = __spark_entry__.queries()[name](spark, sf)
        found = duck.sql(__spark_entry__.oracle_sql()[name])
        assert sorted(found.columns) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, found.select(", ".join(df.columns)).fetchall()))
