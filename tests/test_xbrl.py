"""The pull reader of filings against whole trees, on odd documents and in bounded memory."""

import tracemalloc
from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritape.sources import xbrl

HEAD = '<x xmlns:i="http://www.xbrl.org/2003/instance" xmlns:e="http://example.org">'
DAY = "<i:period><i:startDate> 2024-01-01 </i:startDate><i:endDate>2024-03-31</i:endDate></i:period>"


def by_tree(content: bytes) -> list[tuple]:
    """The same facts from the whole tree, by searches from the root."""
    try:
        top = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    space = {"i": "http://www.xbrl.org/2003/instance"}
    out = []
    for n, e in enumerate(top.iter()):
        ref = e.get("contextRef")
        owner = next((c for c in top.iter() if c.get("id") == ref), None) if ref is not None else None
        if owner is None:
            continue
        period = owner.find("i:period", space)
        dates = [None if period is None else period.find(f"i:{d}", space) for d in ("startDate", "endDate", "instant")]
        out.append((n, e.tag, ref, e.get("unitRef"), e.text, *(None if d is None else (d.text or "").strip() for d in dates)))
    return out


CASES = [
    "",
    HEAD + "</x>",
    HEAD + f'<i:context id="a">{DAY}</i:context><e:v contextRef="a" unitRef="u">1</e:v></x>',
    HEAD + f'<e:v contextRef="a">1<!-- c -->2<b/>3</e:v><i:context id="a">{DAY}</i:context></x>',  # a context after its fact, text up to a child
    HEAD + f'<i:context id="a">{DAY}</i:context><i:context id="a"><i:period><i:instant>2020-01-01</i:instant></i:period></i:context><e:v contextRef="a"/></x>',  # the first one counts
    HEAD + f'<i:context id="a"><i:period/>{DAY}</i:context><e:v contextRef="a">7</e:v></x>',  # the first period counts
    HEAD + '<i:context id="a"><i:period><i:instant/><i:instant>2020-01-01</i:instant></i:period></i:context><e:v contextRef="a">7</e:v></x>',
    HEAD + f'<e:v contextRef="a" id="a">7<e:w contextRef="b">8</e:w></e:v><y id="b"><z>{DAY}</z></y></x>',  # its own context; a period too deep
    HEAD + f'<i:context id="a">{DAY}<i:context id="b">{DAY}</i:context></i:context><e:v contextRef="b">&lt;&#233;</e:v></x>',
    HEAD + f'<i:context id="a">{DAY}</i:context><e:v contextRef="a">1</e:v>',  # breaks at the very end
    HEAD + '<e:v contextRef="a">&none;</e:v></x>',
    HEAD + f'<i:context id="">{DAY}</i:context><e:v contextRef="">1</e:v><e:v contextRef="none">1</e:v></x>',
]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_like_a_tree(text, chunk, monkeypatch):
    monkeypatch.setattr(xbrl, "CHUNK", chunk)
    assert list(xbrl.raw_facts_of(text.encode())) == by_tree(text.encode())


PARTS = st.sampled_from([*"abc", "<i:period>", "</i:period>", "<i:startDate>", "</i:startDate>", "<i:instant>", "</i:instant>", '<c id="a">', '<c id="b">', "</c>", '<f contextRef="a">', '<f contextRef="b" id="b">', "</f>", "<!--x-->"])


@st.composite
def documents(draw):
    """Well-formed documents of nested parts: what isn't closed is closed, what doesn't close the open part is left out."""
    open_, out = [], []
    for part in draw(st.lists(PARTS, max_size=40)):
        if part.startswith("</"):
            if not open_ or open_[-1] != part:
                continue
            open_.pop()
        elif part.startswith("<") and not part.startswith("<!"):
            open_.append(f"</{part[1:].split('>')[0].split()[0]}>")
        out.append(part)
    return HEAD + "".join(out) + "".join(reversed(open_)) + "</x>"


@settings(max_examples=300, deadline=None)
@given(documents())
def test_any_document(text):
    assert list(xbrl.raw_facts_of(text.encode())) == by_tree(text.encode())


def test_bounded_memory():
    """40 MB with an id on each fact: what is held beside the bytes is a thousandth of them."""
    fact = '<e:v contextRef="a" unitRef="u" id="{:09}">1234</e:v>'
    content = (HEAD + f'<i:context id="a">{DAY}</i:context>' + "".join(fact.format(i) for i in range(700_000)) + "</x>").encode()
    assert len(content) > 36_000_000
    tracemalloc.start()
    n = sum(1 for _ in xbrl.raw_facts_of(content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 700_000 and peak < 2_000_000


def test_frames(spark):
    """Batches of a few facts, nulls and broken files; the table function gives the same rows."""
    rows = [(i, None if i == 3 else c.encode()) for i, c in enumerate(CASES)] + [(99, b"\xff\xfe")]
    files = spark.createDataFrame(rows, "n int, content binary")
    want = sorted((n, *f) for n, c in rows if c is not None for f in by_tree(c))
    assert sorted(tuple(r) for r in xbrl.raw_facts(files, ("n",)).collect()) == want
    xbrl.register(spark)
    files.createOrReplaceTempView("files_of_xbrl")
    got = spark.sql("select n, f.* from files_of_xbrl, lateral xbrl_facts(content) f").collect()
    assert sorted(tuple(r) for r in got) == want
    assert xbrl.raw_facts(files.where("false"), ("n",)).count() == 0
    assert xbrl.raw_facts(files.withColumn("n", F.lit(1)), ("n",)).count() == len(want)


def test_filings_are_dealt_to_all_cores(spark):
    """The table's one small file doesn't leave all parsing to one task."""
    from veritape.plans import registry

    found = registry.filing_facts(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
