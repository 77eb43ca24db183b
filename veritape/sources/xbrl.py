"""XBRL filings: a pull reader that emits raw facts; every later rule is relational (operators.facts).

A document is parsed three times without ever being held as a tree: once to see that it is well formed and which contexts
its facts name, once for the periods of these contexts, and once for the facts, which go out as they close. What is kept
is one entry a context and one frame an open element, so a filing costs its own bytes and no multiple of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, chain
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritape.operators.facts import facts
from veritape.sources.tree import listing

_NS = "{http://www.xbrl.org/2003/instance}"
_PERIOD = f"{_NS}period"
_DATES = {f"{_NS}startDate": 0, f"{_NS}endDate": 1, f"{_NS}instant": 2}
CHUNK = 1 << 16  # bytes that the parser is given at a time
ROWS = 8192  # facts in a batch
FACT = "ordinal long, tag string, context_ref string, unit_ref string, text string, start string, end string, instant string"
RAW = f"company string, folder string, file string, weight double, {FACT}"


class _Target:
    """A parser's target that returns nothing at the end."""

    def close(self) -> None:
        pass


class _References(_Target):
    """Which contexts the facts of a document name."""

    def __init__(self):
        self.found: set[str] = set()

    def start(self, _: str, attributes: dict[str, str]) -> None:
        if "contextRef" in attributes:
            self.found.add(attributes["contextRef"])


class _Periods(_Target):
    """(start, end, instant) of the first element with each wanted id: dates right in the first period right in that element."""

    def __init__(self, wanted: set[str]):
        self.wanted, self.found = wanted, {}
        self.open: list[list] = []  # frames of [the context that starts here, the context whose period this is, the date that this is]
        self.text: list[str] | None = None

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        own = period = date = None
        parent = self.open[-1] if self.open else [None] * 3
        self.text = None  # only what stands before the first child counts
        if parent[0] is not None and tag == _PERIOD and not parent[0]["seen"]:
            period, parent[0]["seen"] = parent[0], True
        elif parent[1] is not None and tag in _DATES and parent[1]["dates"][_DATES[tag]] is None:
            self.text = []
            date = (parent[1]["dates"], _DATES[tag], self.text)
        key = attributes.get("id")
        if key in self.wanted and key not in self.found:
            own = {"seen": False, "dates": [None, None, None]}
            self.found[key] = own["dates"]
        self.open.append([own, period, date])

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, _: str) -> None:
        date, self.text = self.open.pop()[2], None
        if date is not None:
            date[0][date[1]] = "".join(date[2]).strip()


class _Facts(_Target):
    """Facts in document order; ``ready`` is emptied by whoever feeds the parser."""

    def __init__(self, contexts: dict[str, list]):
        self.contexts, self.ordinal, self.ready = contexts, -1, []
        self.fact: tuple | None = None
        self.text: list[str] = []

    def _close(self) -> None:
        if self.fact is not None:
            ordinal, tag, ref, unit = self.fact
            self.ready.append((ordinal, tag, ref, unit, "".join(self.text) or None, *self.contexts[ref]))
            self.fact = None

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self._close()
        self.ordinal += 1
        ref = attributes.get("contextRef")
        if ref is not None and ref in self.contexts:
            self.fact, self.text = (self.ordinal, tag, ref, attributes.get("unitRef")), []

    def data(self, text: str) -> None:
        if self.fact is not None:
            self.text.append(text)

    def end(self, _: str) -> None:
        self._close()


def _feed(content: bytes, target: object) -> Iterator[None]:
    """Parse for ``target``, stopping after each chunk; a broken document raises."""
    parser = ElementTree.XMLParser(target=target)
    view = memoryview(content)
    for i in range(0, len(view), CHUNK):
        parser.feed(bytes(view[i : i + CHUNK]))
        yield
    parser.feed(b"")
    parser.close()
    yield


def raw_facts_of(content: bytes | None) -> Iterator[tuple]:
    """(ordinal, tag, context_ref, unit_ref, text, start, end, instant) of each element with a context, in document order.

    Nothing comes out of a null, an empty or a broken document, wherever it breaks. A context is the first element with the
    id, before or after its facts; a fact that names none is left out. An element's text ends at its first child.
    """
    if not content:
        return
    references = _References()
    try:
        for _ in _feed(content, references):
            pass
    except ElementTree.ParseError:
        return
    periods = _Periods(references.found)
    for _ in _feed(content, periods):
        pass
    found = _Facts(periods.found)
    for _ in _feed(content, found):
        ready, found.ready = found.ready, []
        yield from ready


def raw_facts(files: DataFrame, keep: tuple[str, ...] = ("company", "folder", "file", "weight")) -> DataFrame:
    """The columns ``keep`` of a file listing with the raw facts of its ``content``, in batches of at most ``ROWS``."""
    source = files.select(*keep, "content")
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    heads = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = ((i, *fact) for i in range(batch.num_rows) for fact in raw_facts_of(batch.column(heads)[i].as_py()))
            for rows in batched(each, ROWS):
                at, ordinal, *texts = zip(*rows, strict=True)
                taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(heads)]
                made = [pa.array(ordinal, pa.int64()), *(pa.array(x, pa.string()) for x in texts)]
                yield pa.RecordBatch.from_arrays([*taken, *made], [*keep, *(f.split()[0] for f in FACT.split(", "))])

    return source.mapInArrow(run, ", ".join(chain(types, [FACT])))


@F.udtf(returnType=FACT)
class XbrlFacts:
    """``SELECT ... FROM files, LATERAL xbrl_facts(content)`` after :func:`register`."""

    def eval(self, content: bytes):
        yield from raw_facts_of(content)


def register(spark: SparkSession) -> None:
    """``xbrl_facts(content)`` for SQL."""
    spark.udtf.register("xbrl_facts", XbrlFacts)


def filings(spark: SparkSession, root: str, company: str | list[str] | None = None) -> DataFrame:
    """company, quarter, metric, value, weight of all filings. Only ``.xml`` in lower case is read."""
    raw = raw_facts(listing(spark, root, r"\.xml$", company=company))
    return facts(raw.withColumn("file", F.concat_ws("/", "company", "folder", "file")))
