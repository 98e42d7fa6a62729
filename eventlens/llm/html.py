"""Main text of web pages by tree scoring (operator 1).

A page becomes a tree whose leaves are text blocks. Each block passes points for its length and commas to the elements
around it: all to the nearest, half to the next, less further out. Points are discounted by link density. The best
element, raised to the article or main element that holds it, is kept. Of its siblings (the children of a page's body, if that is
best) those stay whose own text speaks for them: articles, paragraphs, headings, lists, and other text that is long or ends like a
sentence; short text of mere containers, copyright lines and links of a body that is best stay only between kept text. Siblings and
blocks beside another best element that are mostly links go, and of a page with a main element goes what stands outside it. Elements that are never main text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out by their tag, role or class words, wherever
they stand. Inside articles a doubtful word (``share``, ``related``) counts only if the rest of its class name is a common layout word,
and not in an id. A form that holds an article or a heading and most of a page's text wraps the page and is none of these.

Blocks come in page order, joined by one line feed; character references are decoded and white space inside a block
is one space. NULL, empty and text-free pages give an empty text. Broken markup is read as far as it goes: unclosed
elements end with their parents, and from a quote on that leaves no end to its tag quotes are read as plain letters. Work grows
linearly with a page's length, however deep it nests. Every row is worked on alone and whole, so repeated rows and ties need no
rule, but that the outermost of equally scored elements wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eventlens.llm.common import query, sliced, table

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORD = re.compile(r"[a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split())
_NEVER = frozenset(
    "nav footer aside script style noscript template iframe textarea title head select button menu dialog svg math canvas object "
    "embed audio video search fieldset xmp noembed noframes input label".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments "
    "commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login paywall search widget widgets toolbar pagination pager".split())
# Words that may also name a topic, and what stands beside them in names of layout.
_DOUBTFUL_WORDS = frozenset(
    "ad ads sponsor promo promotion banner menu nav navigation header consent notice notices alert overlay comment reply replies respond share "
    "sharing social related recommended recommendations subscription login search widget widgets toolbar".split())
_LAYOUT_WORDS = frozenset(
    "site page main global top bottom left right primary secondary inner outer wrapper wrap container box bar block area section panel list item "
    "items link links button buttons btn group row col column content text title form thread post posts article articles story stories topics "
    "tags icon icons image media body head module js is user reader readers count unit slot sticky fixed floating mobile desktop small large more "
    "also like author date avatar email print facebook twitter linkedin whatsapp".split())
_OUTSIDE_WORDS = frozenset("copyright legal teaser teasers colophon imprint disclaimer topbar logo tagline".split())
_MAIN_WORDS = frozenset("article content entry main post story text body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROOTS = frozenset("#root html body".split())
_CONTAINERS = frozenset("#root html body div section center address table tbody tr".split())
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_SENTENCE = re.compile(r"[.!?:…。！？][\"'”’»)\]]*\Z")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}


class _Element:
    __slots__ = ("tag", "parent", "block", "form", "never", "in_main", "in_text", "words", "points", "chars", "link_chars", "depth")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.points, self.chars, self.link_chars, self.words = 0.0, 0, 0, frozenset()
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in _BLOCK or not parent else parent.block
        self.form = self if tag == "form" else parent and parent.form
        self.in_main = bool(parent and (parent.in_main or parent.tag in ("article", "main")))
        self.in_text = self.in_main or bool(parent and (parent.in_text or parent.words & _MAIN_WORDS))
        self.never = bool(parent and parent.never) or tag in _NEVER or (tag == "header" and not self.in_main)
        if attributes and not self.never and not attributes.isspace() and tag not in ("html", "body"):
            given = {}
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                given.setdefault(name.lower(), unescape(a or b or c).lower())
            self.words = frozenset(_WORD.findall(f"{given.get('class', '')} {given.get('id', '')}"))
            self.never = (
                (tag != "main" and self._named_never(given)) or given.get("role") in _NEVER_ROLES - ({"form"} if tag == "form" else set())
                or "hidden" in given
                or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""))

    def _named_never(self, given: dict[str, str]) -> bool:
        # The id of a heading is made from its text.
        banned = frozenset() if self.tag in _HEADINGS else self.words & _NEVER_WORDS
        if self.in_main:
            banned -= {"header", "alert"}
        names = given.get("class", "").split()
        if not self.in_text:
            return bool(banned) or (self.tag != "article" and any(name in _OUTSIDE_WORDS for name in names))
        if banned - _DOUBTFUL_WORDS:
            return True
        parts = (frozenset(_WORD.findall(name)) for name in names)
        return any(some & banned and all(w in _NEVER_WORDS or w in _LAYOUT_WORDS or w.isdigit() for w in some) for some in parts)


_Block = tuple[str, _Element, int]


def _tag_end(html: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Place of the ``>`` that ends a tag, past quoted ones if ``quotes``; -1 if there is none. False if a quote never ends."""
    plain = html.find(">", at)
    while quotes and plain >= 0:
        mark = _MARK.search(html, at)
        if mark and mark[0] == ">":
            return mark.start(), True
        at = html.find(mark[0], mark.end()) + 1 if mark else 0
        quotes = at > 0
    return plain, quotes or plain < 0


def blocks_of(html: str) -> tuple[list[_Block], list[_Element]]:
    """Text blocks of a page in order, each with its element and its link characters, none of elements that are never main text;
    and the elements in page order."""
    root = _Element("#root", None, "")
    stack, pieces, out, elements = [root], [], [], [root]
    opened: dict[str, list[int]] = {}
    links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append((text, stack[-1].block, min(link_chars, len(text))))
        link_chars = 0

    def text(raw: str) -> None:
        nonlocal link_chars
        if raw and not stack[-1].never:
            clean = unescape(raw)
            pieces.append(clean)
            if links:
                link_chars += len(clean.strip())

    def close(k: int) -> None:
        nonlocal links
        if stack[-1].block.depth >= stack[k].depth:
            flush()
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            links -= tag == "a"

    def last(tag: str) -> int:
        return opened[tag][-1] if opened.get(tag) else 0

    at, quotes = 0, True
    while (start := html.find("<", at)) >= 0:
        text(html[at:start])
        at = start + 1
        if html.startswith("!--", at):
            end = html.find("-->", at + 3)
            at = end + 3 if end >= 0 else len(html)
            continue
        if html.startswith("![CDATA[", at):
            end = html.find("]]>", at)
            text(html[at + 8 : end if end >= 0 else len(html)].replace("&", "&amp;"))
            at = end + 3 if end >= 0 else len(html)
            continue
        named = _NAME.match(html, at)
        if not named and html[at : at + 1] not in ("!", "?"):
            text("<")
            continue
        end, quotes = _tag_end(html, named.end(), quotes) if named else (html.find(">", at), quotes)
        if end < 0:  # no tag ends any more
            at = start
            break
        closing, at = html[at] == "/", end + 1
        if not named:
            continue
        tag, attributes = named[1].lower(), html[named.end() : end]
        if closing:
            if k := last(tag):
                close(k)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            if (k := last("p")) and stack[-1].block is stack[k]:
                close(k)
            for name in _CLOSES.get(tag, ()):
                k = last(name)
                if k and k > max(last(fence) for fence in ("table", "ul", "ol", "dl", "select")):
                    close(k)
            flush()
        if tag == "br":
            text(" ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = ends.end() if ends else len(html)
            continue
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        links += tag == "a"
        opened.setdefault(tag, []).append(len(stack))
        stack.append(_Element(tag, stack[-1], attributes))
        elements.append(stack[-1])
    text(html[at:])
    flush()
    return _without_forms(out, elements), elements


def _without_forms(blocks: list[_Block], elements: list[_Element]) -> list[_Block]:
    """Blocks outside of forms, and of forms that wrap most of the page's text."""
    if not any(place.form for _, place, _ in blocks):
        return blocks
    chars: dict[_Element, int] = {}
    for text, place, _ in blocks:
        if place.form:
            chars[place.form] = chars.get(place.form, 0) + len(text)
    for form in [e for e in reversed(elements) if e.tag == "form" and e.parent.form]:
        chars[form.parent.form] = chars.get(form.parent.form, 0) + chars.get(form, 0)
    telling = {e.form for e in elements if not e.never and (e.tag in _HEADINGS or e.tag in ("article", "main"))}
    for form in [e for e in reversed(elements) if e.tag == "form" and e in telling and e.parent.form]:
        telling.add(form.parent.form)
    whole = sum(len(text) for text, _, _ in blocks)
    wraps: set[_Element | None] = {None}
    for form in (e for e in elements if e.tag == "form"):
        if form in telling and 2 * chars.get(form, 0) > whole and form.parent.form in wraps:
            wraps.add(form)
    return [block for block in blocks if block[1].form in wraps]


def extract(html: str | None) -> str:
    """Main text of one page."""
    blocks, elements = blocks_of(html or "")
    if not blocks:
        return ""
    for text, place, link_chars in blocks:
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        (place if place.tag not in ("p", "pre", "li", *_HEADINGS) else place.parent or place).points += points
        place.chars += len(text)
        place.link_chars += link_chars
    for element in reversed(elements):  # children come after their parents
        if up := element.parent:
            up.points += element.points / 2
            up.chars += element.chars
            up.link_chars += element.link_chars

    def score(e: _Element) -> float:
        return (e.points + 25 * (e.tag in ("article", "main") or bool(e.words & _MAIN_WORDS))) * (1 - e.link_chars / max(e.chars, 1))

    best = max((e for e in elements if e.chars), key=lambda e: (score(e), -e.depth))
    holder = best
    for element in _line(best):
        if element.tag in ("article", "main"):
            holder = element
    line = set(_line(holder))
    in_main = any(element.tag == "main" for element in line)

    inside, linked, unit = set(), set(), {}
    for element in elements:
        up = element.parent
        if (element is holder and holder.tag not in _ROOTS) or element.tag in ("article", "main") or up in inside:
            inside.add(element)
        if element not in line:
            unit[element] = unit.get(up, element)
            # A heading may be a link to its section; what it heads decides.
            if up in linked or (element.tag not in _HEADINGS and element.link_chars > element.chars / 2):
                linked.add(element)

    def gone(text: str, place: _Element, link_chars: int) -> bool:
        mostly_links = place.tag not in _HEADINGS and link_chars > len(text) / 2
        return place not in inside and holder.tag not in _ROOTS and (in_main or mostly_links or place in linked)

    def strong(text: str, place: _Element) -> bool:
        if place in linked or (len(text) < 200 and _COPYRIGHT.match(text)):
            return False
        return place.tag not in _CONTAINERS or len(text) >= 80 or (len(text) >= 20 and bool(_SENTENCE.search(text)))

    left = [block for block in blocks if not gone(*block)]
    speaking = {unit.get(place) for text, place, _ in left if unit.get(place) and strong(text, place)}
    sure = [place in inside or (unit[place] in speaking if place in unit else strong(text, place)) for text, place, _ in left]
    if True not in sure:
        return "\n".join(block[0] for block in left)
    first, end = sure.index(True), len(sure) - sure[::-1].index(True)
    return "\n".join(block[0] for block in left[first:end])


def _line(element: _Element | None) -> Iterator[_Element]:
    while element:
        yield element
        element = element.parent


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each input row."""
    picked = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = StructType([picked.schema["page_id"], picked.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [extract(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(text) for text in texts], pa.int64()),
            })

    return picked.mapInArrow(work, schema)


@query("op1_html_main_text")
def op1_html_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
