"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Blocks in menus, headers, footers, sidebars, forms,
adverts, notices and comments (by tag, role or name) and hidden ones are bad. Pass one decides what
it can of the others by length, link density and stop-word density: blocks that are mostly link text
are bad; long blocks with many stop words are good; long blocks without them are bad. Blocks with
some stop words (near), short blocks, and inside an article also those with few stop words (thin)
stay ambiguous. Pass two gives each ambiguous block the label of its nearest decided neighbour; of
two as near, a good one wins only if the other is good too or the block itself has some stop words;
a heading goes with the block that follows.

An ``article`` or ``main`` element is a hint. It bounds the neighbourhood: what lies outside is bad,
and its blocks inherit from good blocks inside it, since a menu beside an article says nothing about
its first line. Where no block inside is decided, near ones count as good; without these, too, the
element is believed, for an article may be two words long.

Names count as whole class words (``sidebar``), and as parts of one (``site-footer``) only for
containers outside an article that hold none; headings are never bad by name. Where a page has no
stop word at all its language is unknown and blocks are judged by length and links only.

Null or empty pages, and pages without good blocks, give empty text. Unclosed tags, comments and
scripts run to the end of the page, as browsers have it. Text areas and select lists are form
controls and go; ``noscript``, ``math`` and ``svg`` text is text. Repeated rows give repeated
results, and an empty table an empty one; nothing is compared between rows, so there are no ties.
Scanning is linear in the page, however long.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritape.llm.common import short_batches

SHORT = 70
LONG = 200
STOP_LOW = 0.30
STOP_HIGH = 0.32
LINKS = 0.33
ARTICLE_LINKS = 0.5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
the of and to in a is that it for on with as was by be are this from at or an not have has but which they you
he she we his her their its were been will would can more when who what there all one so if no out up into about
de la le et les des en un une du que qui dans pour pas sur au par il est ne se ce plus avec sont aux son mais
comme ou si leur elle ils nous vous cette ces été être
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man
el los las del se por con una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin
sobre también me hasta hay donde quien desde todo nos durante
""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_HOLDS = frozenset("article aside blockquote button details dialog div dl fieldset figure footer form head header main menu nav ol section select table ul".split())
_BAD_TAGS = frozenset("nav header footer aside form menu dialog button select head fieldset".split())
_GOOD_TAGS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert toolbar".split())
_BAD_NAMES = frozenset(
    """
ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
notices popup modal newsletter subscribe subscription share sharing social comment comments disqus reply replies respond
sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead related recommended recommendations
widget widgets login signin signup search pagination pager toolbar copyright legal disclaimer skip hidden
""".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|iframe|object|canvas)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<more>(?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|</?[a-z][^<>]*+>|<[!?/][^>]*+>|<[a-z/!?][^<>]*+\Z",
    re.DOTALL | re.IGNORECASE | re.ASCII,
)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9:-]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE | re.ASCII)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _badness(tag: str, more: str, in_article: bool) -> int:
    """2: certainly not main text; 1: by part of a name, which an article inside outweighs; 0: not known to be bad."""
    if tag in _BAD_TAGS and not (tag == "header" and in_article):
        return 2
    out = 0
    for m in _ATTRIBUTE.finditer(more) if more else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
            return 2
        if tag in ("body", "html", "main") or tag in _HEADINGS:
            continue
        if name == "role" and value in _BAD_ROLES:
            return 2
        if name in ("class", "id"):
            words = value.split()
            if any(w in _BAD_NAMES for w in words):
                return 2
            if not in_article and tag in _HOLDS and tag not in _GOOD_TAGS and any(x in _BAD_NAMES for w in words for x in re.split(r"[^a-z]+", w)):
                out = 1
    return out


class Block:
    __slots__ = ("bad", "heading", "inside", "links", "text")

    def __init__(self, text: str, links: int, bad: bool, inside: bool, heading: bool = False):
        self.text, self.links, self.bad, self.inside, self.heading = text, links, bad, inside, heading


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, their link characters, and whether bad or article elements hold them."""
    out: list[Block] = []
    parts: list[str] = []
    links = bad_depth = doubt_depth = good_depth = link_depth = 0
    own_bad = False  # of a p, li or heading that is bad by its own name
    heading = False
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, links, bad_depth > 0 or own_bad or (doubt_depth > 0 and not good_depth), good_depth > 0, heading))
            parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            parts.append(piece)
            if link_depth:
                links += len("".join(piece.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link_depth = 0 if m["close"] else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCK:
            continue
        end_block()
        own_bad, link_depth, heading = False, 0, tag in _HEADINGS and not m["close"]
        if m["close"]:
            if open_tags.get(tag):
                while True:
                    name, bad = stack.pop()
                    open_tags[name] -= 1
                    bad_depth -= bad == 2
                    doubt_depth -= bad == 1
                    good_depth -= name in _GOOD_TAGS
                    if name == tag:
                        break
        elif tag in _HOLDS:
            if not m["more"].endswith("/"):
                bad = _badness(tag, m["more"], good_depth > 0)
                stack.append((tag, bad))
                open_tags[tag] = open_tags.get(tag, 0) + 1
                bad_depth += bad == 2
                doubt_depth += bad == 1
                good_depth += tag in _GOOD_TAGS
        elif tag == "title":
            own_bad = True
        elif tag == "body":
            while stack and stack[-1][0] == "head":
                name, bad = stack.pop()
                open_tags[name] -= 1
                bad_depth -= bad == 2
                doubt_depth -= bad == 1
        else:
            own_bad = _badness(tag, m["more"], good_depth > 0) == 2
    add(page[at:])
    end_block()
    return out


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()#*%$&") in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(b: Block, article: bool, stops: float, known: bool) -> str:
    """good, bad, or the ambiguous near, short and thin. ``known``: the page has stop words that we know."""
    n = len(b.text)
    if b.bad or (article and not b.inside):
        return "bad"
    if b.links / max(1, len(b.text.replace(" ", ""))) > (ARTICLE_LINKS if article else LINKS):
        return "bad"
    if not article and n <= LONG and b.text.lower().startswith(("©", "(c) ", "copyright ")):
        return "bad"
    if n < SHORT:
        return "short" if not b.links or article else "bad"
    if stops >= STOP_HIGH or not known:
        return "good" if n > LONG else "near"
    if stops >= STOP_LOW:
        return "near"
    return "thin" if article else "bad"


def labels(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    article = any(b.inside and not b.bad for b in blocks)
    stops = [stop_density(b.text) for b in blocks]
    known = any(stops)
    first = [_first_pass(b, article, d, known) for b, d in zip(blocks, stops, strict=True)]
    if article:
        left = [i for i, x in enumerate(first) if x != "bad"]
        if not any(first[i] == "good" for i in left):
            for i in [i for i in left if first[i] == "near"] or left:
                first[i] = "good"
        counts = ("good",)  # what the element holds is judged by its own good blocks
    else:
        counts = ("good", "bad")
    n = len(first)
    before, after = [None] * n, [None] * n  # the nearest decided block on each side
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            into[i] = last
            if first[i] in counts:
                last = i
    out = []
    for i, label in enumerate(first):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        near = [x for x in (before[i], after[i]) if x is not None]
        if not near:
            out.append(label == "near")
            continue
        gap = min(abs(x - i) for x in near)
        kinds = {first[x] for x in near if abs(x - i) == gap}
        if blocks[i].heading and len(near) == 2 and len(kinds) == 2:
            kinds = {first[near[1]]}  # a heading goes with what follows it
        out.append(kinds == {"good"} or ("good" in kinds and label == "near"))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, good in zip(blocks, labels(blocks), strict=True) if good)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = short_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
