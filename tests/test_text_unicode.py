"""White space, line ends and digits beyond ASCII, and name similarity, against the standard library."""

import difflib
import random
import re

from pyspark.sql import functions as F

from veritape.functions import text as T
from veritape.functions import vocab as V
from veritape.operators import fuzzy

ODD = [chr(i) for i in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x2000, 0x2003, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def texts():
    rng = random.Random(11)
    parts = [*ODD, *ODD, "\r\n", "abc", "Revenue rose", "12", "١٢", "3.5", "%", "|", "(4)", ".", "! ", "?", "x", "​", "é", "AB", ","]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)]


def test_white_space_set():
    assert set(V.SPACES) == {chr(i) for i in range(0x110000) if chr(i).isspace()} == {c for c in V.SPACES if re.fullmatch(f"[{re.sub(r'x{([0-9a-f]+)}', lambda m: 'u' + m[1], V.SPACE)}]", c)}


def test_against_python(spark):
    rows = texts()

    def cleaned(s):
        return re.sub(r"\s{2,}", " ", re.sub(r"[\r\n\t]+", " ", s)).strip()

    def lines(s):
        kept = [x for x in re.sub(r"\r\n|\r", "\n", s).splitlines() if not re.fullmatch(r"[\d\s.,|\-%()]+", x.strip()) and len(x.strip()) > 3]
        return "\n".join(kept)

    def valid(s):
        return len(s) >= 20 and not re.search(r"(?i)(^[\d\s.,|\-%()$₹/:]+$|^\s*[A-Z\s]{1,6}\s*$|www\.|http|©|™|®)", s) and len(re.findall("[a-zA-Z]{2,}", s)) >= 3

    c = F.col("t")
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = df.select(T.clean_sentence(c), T.clean_lines(c), T.dedup_key(c), T.is_numeric_claim(c), T.is_valid_sentence(T.clean_sentence(c)), T.strip(c), T.magnitude(c)).collect()
    for t, r in zip(rows, got, strict=True):
        mag = re.search(r"(?i)(\d+(\.\d+)?\s*(%|bps|basis points|crore|million|billion|lakh))", t)
        key = re.sub(r"[^a-z0-9 ]", " ", re.sub(r"\s+", " ", t.lower())).strip()
        assert tuple(r) == (cleaned(t), lines(t), key, bool(re.search(r"\d+\.?\d*\s?[%m|bncrk₹$]", t, re.I)), valid(cleaned(t)), t.strip(), mag[1] if mag else None), repr(t)


def test_similar_names(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeit") for _ in range(rng.randrange(2, 7))) for _ in range(30)] + ["diet", "abcx", "abcy"]
    df = spark.createDataFrame([(w,) for w in words], "name string")
    queries = ["tide", "abcd", *["".join(rng.choice("abcdeit") for _ in range(5)) for _ in range(12)]]
    for q in queries:
        found = fuzzy.lookup(df, ["name"], "name", q).first()
        if any(q in w for w in words):
            assert found.tier <= 2
            continue
        want = difflib.get_close_matches(q, words, n=1, cutoff=0.5)
        assert ([found.name] if found else []) == want, q
    assert fuzzy.lookup(spark.createDataFrame([("diet",)], "name string"), ["name"], "name", "tide").first().score == 0.5


def test_white_space_class_for_java(spark):
    """The class that Java's patterns get holds the same characters, also when it is negated."""
    every = "".join(chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000)
    df = spark.createDataFrame([(every,)], "s string")
    kept, left = df.select(F.regexp_replace("s", f"[^{V.WHITE}]", ""), F.regexp_replace("s", f"[{V.WHITE}]", "")).first()
    assert set(kept) == set(V.SPACES) and set(left) == set(every) - set(V.SPACES)


def test_logits_are_computed_once_a_row(spark):
    """Each row's logits are asked for once, by the softmax and by the filter of claims together."""
    from veritape.models import model_claims

    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def logits(_):
        asked.add(1)
        return [0.0, 2.0]

    rows = spark.range(20).selectExpr("'c' company", "'q' quarter", "concat('sentence ', id) sentence", "id doc_id")
    assert len(model_claims(rows, logits=logits, order=["doc_id"]).collect()) == 20
    assert asked.value == 20


def test_rules_at_once_equal_rules_one_by_one(spark):
    """Texts are cleaned whole, keys made in one pass and words found by one pattern a list; the plain rules give the same."""
    import random
    import re

    from veritape.functions import vocab as V

    r = random.Random(5)
    parts = [*"  \t\r\n\x0b\x1f  　\x01.!?,-©", ". ", "?\n", "abc", "Ab", "x1", "İKK", "été", "\U0001f600", "revenues", "PROFITs", "loancost", "regrew", "9grew", "spreadebtdebt", "accelerated", "www.", "two words here"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(600))]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    c = F.col("s")
    plain = F.filter(F.transform(T.plain_breaks(c), T.clean_sentence), lambda x: x != "")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"[{V.WHITE}]+", " "), "[^a-z0-9 ]", " "))
    garbage = rf"(?i)(^[{V.DIGIT}{V.SPACE}.,|\-%()$₹/:]+$|^[{V.SPACE}]*[A-Z{V.SPACE}]{{1,6}}[{V.SPACE}]*$|www\.|http|©|™|®)"
    valid = (F.length(c) >= 20) & ~c.rlike(garbage) & (F.size(F.regexp_extract_all(c, F.lit("([a-zA-Z]{2,})"), 1)) >= 3)
    got = df.select(F.lower(c).alias("low"), T.sentences(c), plain, T.dedup_key(c), key, T.is_valid_sentence(c), valid, T.keyword_score(c).alias("score"))
    rows = got.collect()
    for x in rows:
        assert x[1] == x[2] and x[3] == x[4] and x[5] == x[6]
        words = re.findall("[a-z]+", x.low)
        assert x.score == sum(w in x.low for w in V.PERFORMANCE_KEYWORDS) + sum(any(y.startswith(w) for y in words) for w in V.DIRECTION_KEYWORDS)
    assert len({x.score for x in rows}) > 4 and {True, False} == {x[5] for x in rows}
    scored = df.select(T.keyword_score(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" not in scored.lower()  # no search of the text for each word
    split = df.select(T.sentences(c).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert split.count("regexp_replace") == 2  # none for each sentence


def test_listed_words_by_one_pattern(spark):
    """Counts and root are those of the whole words of letters that the lists have; words that aren't listed are never taken out of the text."""
    import random
    import re

    from veritape.functions import vocab as V

    r = random.Random(7)
    parts = ["profit", "profits", "profitable", "reprofit", "PROFIT", "grew", "Grew9fell", "be", "being", "believe", "are", "area", "strong", "stronger", " ", " ", "-", "é", "\U0001d400", "", "cost"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.nlp_features(F.col("s")).alias("f"))
    for s, f in df.collect():
        words = re.findall("[a-z]+", s.lower())
        assert [f.nouns, f.verbs, f.adjectives] == [sum(w in v for w in words) for v in (V.NOUNS, V.VERBS, V.ADJECTIVES)]
        assert f.root == next((w for w in words if w in V.VERBS + V.SPEECH_VERBS + V.BE_VERBS), "")
    assert "([a-z]+)" not in df._jdf.queryExecution().optimizedPlan().toString()
