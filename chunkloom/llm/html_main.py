"""Main text of web pages by tree scoring.

A page becomes a tree of elements with blocks of text. Each block passes points to its ancestors: one for being there, one for
each comma and one for each hundred characters, in full to its element, half to the next ancestor and less to further
ones. An element's points are discounted by its link density, the share of its text that stands in links. If the best element
lies in an article or main, the outermost of them is kept whole. Otherwise the best element is kept with all beside it that
doesn't mostly stand in links, and so on outwards as long as what stands beside is flow of text (headings, paragraphs, lists,
tables, quotes, code, loose text) or little against the article. Elements that aren't part of an article by their tag, role or
class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) are left out beforehand. The header of an
article is part of it; a form that holds most of the page's text is a frame around it. Controls inside a paragraph don't cut it.

Character references are decoded, white space (line breaks too) inside a block becomes one space, blocks are
trimmed and joined in page order by one line feed. Nothing else is dropped or capped.

Defined results: null and empty pages, and pages without text outside of boilerplate, give the empty text. Markup that is
broken or not closed is read as far as it goes. Other columns are passed on.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.common import bounded_batches, utf8

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of these ends if they are open.
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "body": frozenset(["head"]),
}
#: Where the search for an element to end stops.
SCOPE = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
#: Controls and pictures inside a line: their text goes, the block goes on.
INLINE_ASIDE = frozenset("button input label object select textarea".split())
#: Elements that are no part of an article.
ASIDE_TAGS = frozenset("nav header footer aside form script style iframe noscript template svg math dialog menu head title fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose class and id are read for words; those of headings, paragraphs and inline elements tell about a piece of text.
CONTAINERS = frozenset("div section aside ul ol dl dir li table tbody tfoot thead tr td th center details fieldset figure".split())
#: Words in class and id of containers that are no part of an article: a whole name, or its last word that isn't one of PLACE_WORDS.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs byline combx comment comments commentlist community "
    "consent cookie cookies disqus footer foot gdpr header masthead menu menus modal nav navbar navigation navi newsletter notice notices overlay pager pagination "
    "adsbygoogle popup popover print promo promoted promotion related remark replies reply respond rss share sharing shoutbox sidebar sidebars side sidenav skyscraper social "
    "sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets".split()
)
#: Words that mark the article itself, whatever else a class says.
MAIN_WORDS = frozenset("article body content entry main post story text".split())
#: Words at a name's end that only say what kind of box or which of them it is.
PLACE_WORDS = frozenset(
    "area bar block bottom box button buttons col column container group holder icons inner item items left link links list outer panel posts right row section top "
    "thread threads unit wrap wrapper zone".split()
)
#: Words that mark boilerplate beside a word of the article too, and words after which a name only tells about its surroundings.
STRONG_WORDS = frozenset("comment comments sidebar cookie cookies".split())
ABOUT_WORDS = frozenset("has with no without".split())

#: Points of an element for what it is, before its blocks count.
BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 2.0, "pre": 2.0, "td": 2.0, "blockquote": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
#: A sibling is kept from this share of the best element's points on.
SIBLING_SHARE = 0.2
#: Ancestors that a block passes points to.
LEVELS = 16
#: A form with this share of the page's text is a frame around the page.
FRAME_SHARE = 0.8
#: What stands beside the article is kept if less than this share of its text stands in links.
LINKED_SHARE = 0.5
#: An ancestor holds little else than the article if other containers have at most this share of its text.
LITTLE_SHARE = 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that belong to a flow of text, not to the layout of a page.
FLOW = HEADINGS | frozenset("p ul ol dl table pre blockquote figure details address".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACES = re.compile(r"\s+")
_MARKS = "\x02\x03\x04\x05"
_INSIDE = re.compile("\x04[^\x04\x05]*\x05?")


class _Text(NamedTuple):
    """A block's text and how many of its characters stand in links."""

    block: str
    linked: int


class _Element:
    __slots__ = ("children", "parent", "points", "tag", "text", "linked", "aside", "code", "article")

    def __init__(self, tag: str, parent: _Element | None, aside: bool):
        self.tag, self.parent, self.aside = tag, parent, aside
        self.code = tag == "pre" or (parent is not None and parent.code)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.children: list[_Element | str | _Text] = []
        self.points = 0.0
        self.text = self.linked = 0


def _last(words: list[str], skip: frozenset[str]) -> str:
    """The last word of a name that tells what it is of; a name of nothing else counts by its first word."""
    n = len(words)
    while n > 1 and words[n - 1] in skip:
        n -= 1
    return words[n - 1]


def _names_aside(words: list[str]) -> bool:
    """Whether one name of an element (main-nav, siteFooter, share-buttons) is of boilerplate; the header of an article is part of it."""
    last = _last(words, PLACE_WORDS)
    return last in ASIDE_WORDS and not (last == "header" and MAIN_WORDS.intersection(words))


def _is_aside(tag: str, attributes: str, code: bool = False, article: bool = False) -> bool:
    """Whether an element is no part of an article. Inside ``code`` (pre too) words in class and id don't count; ``article``: inside of one."""
    if tag in ASIDE_TAGS and not (tag == "header" and article):
        return True
    if tag in ("body", "html", "main") or not attributes:
        return False
    values: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(value))
    if values.get("role", "").strip().lower() in ASIDE_ROLES or "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
        return True
    if code or tag not in CONTAINERS and tag not in ("article", "header", "ins"):
        return False
    names = [w for x in values.get("class", "").split() if (w := [w.lower() for w in _WORDS.findall(x)])]
    of_id = [w.lower() for w in _WORDS.findall(values.get("id", ""))]
    if tag == "ins":  # inserted text, but for the box of adverts
        return ["adsbygoogle"] in names
    if tag == "section" or ["section"] in names:
        told = [w for w in of_id if w not in PLACE_WORDS]
        if len(told) != 1 or told[0] not in STRONG_WORDS:
            of_id = []  # a section's id is made from its heading
    names = [w for w in [*names, of_id] if w and not ABOUT_WORDS.intersection(w[:-1])]
    if any(_last(w, PLACE_WORDS | MAIN_WORDS) in STRONG_WORDS for w in names):
        return True
    if tag in ("article", "header"):  # of these, only reader comments are told by name
        return False
    return any(_names_aside(w) for w in names) and not any(MAIN_WORDS.issuperset(w) for w in names)


def parse(page: str) -> _Element:
    """The page as a tree; a block's text stands in it as a string, with marks around what is in links."""
    root = here = _Element("html", None, False)
    piece: list[str] = []
    links = codes = 0
    opened: Counter[str] = Counter()  # open elements by tag, so that a stray end tag costs no walk
    controls: list[str] = []  # open controls inside the block

    def end_block() -> None:
        controls.clear()
        if piece:
            here.children.append("".join(piece))
            piece.clear()
            if links:
                piece.append("\x02")

    def close(upto: _Element) -> None:
        nonlocal here
        end_block()
        while here is not upto:
            opened[here.tag] -= 1
            here = here.parent
        opened[here.tag] -= 1
        here = upto.parent or root

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            piece.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            piece.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                if links:
                    links -= 1
                    if not links:
                        piece.append("\x03")
            elif tag == "code":
                codes = max(0, codes - 1)
            elif tag in controls:
                while controls.pop() != tag:
                    piece.append("\x05")
                piece.append("\x05")
            elif opened[tag] > 0:
                e = here
                while e.tag != tag:
                    e = e.parent
                close(e)
            elif tag in BLOCK:
                end_block()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else n
            continue
        if tag == "br" or tag == "wbr":
            piece.append(" " if tag == "br" else "")
            continue
        if tag in INLINE_ASIDE and tag not in VOID:
            if not m[3].endswith("/"):
                controls.append(tag)
                piece.append("\x04")
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag == "a":
            if not links:
                piece.append("\x02")
            links += 1
            continue
        if tag in ("article", "main", "nav", "footer", "section", "p"):
            codes = 0  # code that was never closed
        aside = _is_aside(tag, m[3], here.code or codes > 0, here.article)
        if tag == "code" and not aside and not m[3].endswith("/"):
            codes += 1
        if tag not in BLOCK and not aside:
            continue  # an inline element: its text belongs to the block
        frame = next((c for c in controls if c != "label"), None)
        end_block()
        if frame:  # a control that holds blocks is an element; a label that isn't closed is none
            box = _Element(frame, here, True)
            here.children.append(box)
            opened[frame] += 1
            here = box
        if tag in BLOCK and links:
            piece.clear()
            if tag in ("article", "main", "nav", "footer", "section", "p"):  # a link that was never closed
                links = 0
            else:
                piece.append("\x02")
        if tag in BLOCK and here.tag == "p":
            close(here)
        ends = ENDED_BY.get(tag)
        if ends and any(opened[x] > 0 for x in ends):
            e, stop = here, SCOPE.get(tag, frozenset())
            while e is not None and e.tag not in stop:
                if e.tag in ends:
                    close(e)
                    break
                e = e.parent
        if tag in ("html", "body") and here is root:
            continue
        element = _Element(tag, here, aside)
        here.children.append(element)
        if not m[3].endswith("/"):
            opened[tag] += 1
            here = element
    end_block()
    return root


def _clean(block: str) -> _Text:
    linked = 0
    while "\x04" in block:  # the innermost controls first; one that isn't closed goes on to the block's end
        block = _INSIDE.sub("", block)
    block = block.replace("\x05", "")
    if "\x02" in block or "\x03" in block:
        inside = [x.partition("\x03")[0] for x in block.split("\x02")[1:]]
        linked = sum(len(_SPACES.sub(" ", x).strip()) for x in inside)
        block = block.replace("\x02", "").replace("\x03", "")
    return _Text(_SPACES.sub(" ", block).strip(), linked)


def _in_order(root: _Element) -> list[_Element]:
    """All elements, an ancestor before what it holds, in page order."""
    out, stack = [], [root]
    while stack:
        e = stack.pop()
        out.append(e)
        stack += [c for c in reversed(e.children) if isinstance(c, _Element)]
    return out


def _frames(elements: list[_Element]) -> None:
    """Forms that hold most of the page's text are no boilerplate."""
    forms = [e for e in elements if e.tag == "form" and e.aside]
    if not forms:
        return
    size = {id(e): sum(len(c) for c in e.children if isinstance(c, str)) for e in elements}
    for e in reversed(elements):
        if e.parent is not None:
            size[id(e.parent)] += size[id(e)]
    for e in forms:
        e.aside = size[id(e)] < FRAME_SHARE * size[id(elements[0])] or not any(c.tag == "p" or c.article for c in _in_order(e)[1:] if not c.aside)


def _score(root: _Element) -> list[_Element]:
    """Add up texts bottom-up and pass the points of all blocks on to their nearest ancestors; the elements that got some, in page order."""
    elements = _in_order(root)
    _frames(elements)
    live: list[_Element] = []
    stack = [root]
    while stack:
        e = stack.pop()
        live.append(e)
        stack += [c for c in reversed(e.children) if isinstance(c, _Element) and not c.aside]
    scored: list[_Element] = []
    seen: set[int] = set()
    for e in elements:
        e.children = [_clean(c) if isinstance(c, str) else c for c in e.children]
    for e in live:
        for text, linked in (c for c in e.children if isinstance(c, _Text)):
            if not text:
                continue
            e.text += len(text)
            e.linked += linked
            points = (1 + text.count(",") + len(text) / 100) * (1 - min(1.0, linked / len(text)))
            to: _Element | None = e
            if to.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "dd", "dt", "td", "th", "figcaption", "summary") and to.parent is not None:
                to = to.parent  # a paragraph's points go to what holds it
            for level in range(LEVELS):
                if to is None:
                    break
                if id(to) not in seen:
                    seen.add(id(to))
                    scored.append(to)
                    to.points += BONUS.get(to.tag, 0.0)
                to.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                to = to.parent
    for e in reversed(live):
        if e.parent is not None:
            e.parent.text += e.text
            e.parent.linked += e.linked
    return scored


def _value(e: _Element) -> float:
    return e.points * (1 - (e.linked / e.text if e.text else 0.0))


def _blocks(e: _Element | _Text) -> Iterator[str]:
    stack: list[_Element | str | _Text] = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, _Text):
            if x.block:
                yield x.block
        elif isinstance(x, _Element) and not x.aside:
            stack += reversed(x.children)


def _size(x: _Element | _Text) -> int:
    """How many characters an element or a block brings."""
    return len(x.block) if isinstance(x, _Text) else 0 if x.aside else x.text


def _kept(best: _Element) -> list[_Element | _Text]:
    """The parts of the page that make the article around the best element, in page order."""
    outer, e = None, best
    while e is not None:
        if e.tag in ("article", "main"):
            outer = e
        e = e.parent
    least = max(1.0, SIBLING_SHARE * _value(best))
    if outer is not None:
        if outer.parent is None or outer.tag == "main":
            return [outer]
        beside = outer.parent.children
        at = next(i for i, s in enumerate(beside) if s is outer)
        alike = [s is outer or (isinstance(s, _Element) and not s.aside and (s.tag == "article" and _value(s) >= least or i < at and s.tag in HEADINGS and s.linked < LINKED_SHARE * s.text)) for i, s in enumerate(beside)]
        return [s for s, keep in zip(beside, alike, strict=True) if keep]
    before: list[list[_Element | _Text]] = []
    after: list[list[_Element | _Text]] = []
    e, first = best, True
    while e.parent is not None:
        beside = e.parent.children
        at = next(i for i, s in enumerate(beside) if s is e)
        plain = [s is not e and _size(s) > 0 and s.linked < LINKED_SHARE * _size(s) for s in beside]
        flow = [isinstance(s, _Text) or s.tag in FLOW for s in beside]
        little = sum(_size(s) for s, a, b in zip(beside, plain, flow, strict=True) if a and not b) <= LITTLE_SHARE * e.parent.text
        strong = [first and isinstance(s, _Element) and s is not e and s.text > 0 and not s.aside and _value(s) >= least for s in beside]
        keep = [d or a and (first or little or b) for a, b, d in zip(plain, flow, strong, strict=True)]
        before.append([s for s, k in zip(beside[:at], keep[:at], strict=True) if k])
        after.append([s for s, k in zip(beside[at + 1 :], keep[at + 1 :], strict=True) if k])
        if not little:
            break
        e, first = e.parent, False
    return [*(s for level in reversed(before) for s in level), best, *(s for level in after for s in level)]


def main_text(page: str) -> str:
    """The main text of a page."""
    if not page:
        return ""
    for mark in _MARKS:
        page = page.replace(mark, " ")
    root = parse(page)
    scored = _score(root)
    if not scored:
        return ""
    return "\n".join(b for part in _kept(max(scored, key=_value)) for b in _blocks(part))


@F.arrow_udf(T.StringType())
def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.decode("utf-8", "replace")) for p in utf8(pages)], pa.string())


def extract(pages: DataFrame, html_col: str = "html", to: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each as column ``to``."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn(to, _extract(F.col(html_col)))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, to="text").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
