"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one per block element. Each line's length counts its text outside
links and outside page furniture: elements such as nav and footer, and those whose class or id says
so, unless they wrap the page's main text. Lengths are summed over a sliding window of lines. The text
surges where a window rises from nothing and dives where it falls back; what stands between the
first surge and the last dive of the heaviest stretch's region is the main text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tune

#: Lines in a sliding window.
WINDOW = 3
#: A stretch of another region is kept when it weighs at least this share of the heaviest.
SHARE = 0.5

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object xmp".split())
FURNITURE = set("nav header footer aside form menu dialog button select label fieldset head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
MAIN = set("article main".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in a class or id that mark page furniture.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside header masthead footer related recommended share sharing social "
    "comment comments respond reply replies disqus newsletter subscribe subscription signup login register widget toolbar pagination pager skip hidden".split()
)
#: Marks that hold for article and main too. Such an element is furniture even where it is longer than the text.
BESIDE = set("comment comments related recommended promo sponsored ad advert advertisement".split())
#: What a name with a mark is when it ends so: a part of what is marked.
PARTS = set(
    "wrap wrapper container box area section block list item items inner outer bar links link button buttons post posts icon icons form text body content message messages panel group row col unit slot "
    "left right top bottom primary secondary".split()
)
#: First words of names that tell what a page has.
STATES = set("has have no not with without is hide show toggle open".split())
#: Shares of the page's text from which a marked element is a wrapper: names of which a part is a mark, and names of marks only.
WRAPS = {1: 0.5, 2: 0.75, 3: 1.0}
#: Elements that enclose whole pages: their classes describe a layout and exclude nothing.
SHELL = set("html body article main".split())
#: Elements that text blocks stand in.
CONTAINERS = set("html body article main div section td center".split())
_token = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)(?:>|(?=<)|$)", re.S)
_attr = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_space = re.compile(r"[\s]+")
_word = re.compile(r"[A-Za-z]+")


@dataclass
class Element:
    name: str
    parent: int
    sure: bool  # furniture by its name, role or state, or inside such
    mark: int  # how sure its class or id marks furniture: a key of WRAPS, or 0
    plain: bool = True  # without attributes
    weight: int = 0
    core: int = 0  # of it outside of BESIDE
    furniture: bool = False
    main: int = 0  # the innermost article or main


@dataclass
class Line:
    text: str
    weight: int
    own: int  # the element that holds it
    furniture: bool = False
    main: int = 0


def mark_of(name: str) -> int:
    """2 for a class or id of marks only (``sidebar``, ``cookie-notice``), 1 where the marked word is
    what the name is (``site-header``, ``share-buttons``), 0 where it says of what kind something
    else is or what a page has (``share-price``, ``nav-closed``, ``has-sidebar``)."""
    words = _word.findall(name)
    if not MARKS.intersection(words):
        return 0
    if MARKS.issuperset(words):
        return 2
    if words[0] in STATES:
        return 0
    while words and words[-1] in PARTS:
        words.pop()
    return int(bool(words) and words[-1] in MARKS)


@lru_cache(4096)
def is_furniture(name: str, attrs: str) -> tuple[bool, int]:
    """(surely, mark): whether the element is furniture by its name, role or state, and else how sure
    its class or id says so."""
    if name in FURNITURE or name in RAW:
        return True, 0
    if name in SHELL and name not in MAIN or not attrs.strip():
        return False, 0
    mark = 0
    for m in _attr.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, 0
        if key == "role" and value in ROLES:
            return True, 0
        if key in ("class", "id"):
            for token in value.split():
                beside = bool(BESIDE.intersection(_word.findall(token)))
                if (beside or name not in MAIN) and (found := mark_of(token)):
                    mark = max(mark, 3 if beside and found == 2 else found)
    return False, mark


def judge(elements: list[Element], lines: list[Line]) -> None:
    """Decide which marked elements are furniture. One that holds most of the page's text (comments
    and their like apart), or the heaviest article or main where little unmarked text stands
    outside, is a wrapper."""
    free = 0  # weight outside of marked elements
    marked = [False] * len(elements)
    beside = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        marked[i] = marked[e.parent] or e.mark > 0
        beside[i] = beside[e.parent] or e.mark == 3
    for x in lines:
        if not elements[x.own].sure:
            elements[x.own].weight += x.weight
            elements[x.own].core += 0 if beside[x.own] else x.weight
            free += 0 if marked[x.own] else x.weight
    for e in reversed(elements[1:]):
        elements[e.parent].weight += e.weight
        elements[e.parent].core += e.core
    page = elements[0]
    best = max((i for i, e in enumerate(elements) if e.name in MAIN and not (e.sure or e.mark or beside[i])), key=lambda i: elements[i].weight, default=0)
    holders = set()
    if best and elements[best].weight and elements[best].weight >= SHARE * free:
        while best:
            holders.add(best)
            best = elements[best].parent
    for i, e in enumerate(elements[1:], 1):
        held, whole = (e.weight, page.weight) if e.mark == 3 else (e.core, page.core)
        wrapper = e.mark and held and (held >= WRAPS[e.mark] * whole or e.mark < 3 and i in holders)
        e.furniture = elements[e.parent].furniture or e.sure or e.mark > 0 and not wrapper
        e.main = i if e.name in MAIN else elements[e.parent].main
    for x in lines:
        x.furniture, x.main = elements[x.own].furniture, elements[x.own].main
        if x.furniture:
            x.text, x.weight = "", 0


def lines_of(page: str) -> tuple[list[Line], list[Element]]:
    """One line per block, in page order, and all elements; furniture gives lines of weight 0."""
    out: list[Line] = []
    elements = [Element("", 0, False, 0)]
    stack: list[tuple[str, int]] = []  # open elements: name, number
    parts: list[str] = []
    weight, links, at = 0, 0, 0

    def flush() -> None:
        nonlocal weight
        text = _space.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Line(text, weight, stack[-1][1] if stack else 0))
        parts.clear()
        weight = 0

    def text(s: str) -> None:
        nonlocal weight
        if s:
            parts.append(s)
            if not links:
                weight += len(s.strip())

    def close(to: int) -> None:
        nonlocal links
        if any(x[0] not in INLINE or elements[x[1]].sure or elements[x[1]].mark for x in stack[to:]):
            flush()
        links -= sum(x[0] == "a" for x in stack[to:])
        del stack[to:]

    size = len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _token.match(page, lt)
        if not m:
            rest = page[lt:]
            if re.match(r"</?[A-Za-z]", rest) and ">" not in rest:
                text(page[at:lt])  # markup that the page's end cuts off
                break
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        name, attrs = m[2].lower(), m[3] or ""
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in MAIN and name not in SHELL and stack[k][0] != name:
                    break
            else:
                if name not in INLINE:
                    flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name == "body":  # ends an unclosed head
            for k, x in enumerate(stack):
                if x[0] == "head":
                    close(k)
                    break
        elif name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name not in INLINE:
            # An open paragraph or item of the same kind ends where the next block begins.
            ends = {"p"} if name not in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p", name} | ({"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th", "tr") else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        sure, mark = is_furniture(name, attrs)
        if name not in INLINE or sure or mark:
            flush()
        if name == "a":
            links += 1
        up = stack[-1][1] if stack else 0
        stack.append((name, len(elements)))
        elements.append(Element(name, up, sure or elements[up].sure, mark, not attrs.strip()))
        if m[4]:  # self-closing
            close(len(stack) - 1)
    flush()
    judge(elements, out)
    return out, elements


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) line ranges: a surge is the first line with text of a window that rises from
    nothing, a dive the last before ``window`` lines in a row hold nothing."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, start = [], None
    for i, s in enumerate(sums):
        if s and start is None and weights[i]:
            start = i
        if start is not None and weights[i]:
            last = i
        if start is not None and (not s or i == len(sums) - 1):
            out.append((start, last + 1))
            start = None
    return out


def region(elements: list[Element], owns: list[int]) -> int:
    """The element that the lines of a stretch have in common: a container, and one with attributes
    where there is one below body."""
    at = owns[0]
    for i in owns[1:]:
        while at != i:  # parents have smaller numbers
            at, i = (elements[at].parent, i) if at > i else (at, elements[i].parent)
    while at and elements[at].name not in CONTAINERS:
        at = elements[at].parent
    while elements[at].plain and elements[at].name not in SHELL and at and elements[elements[at].parent].name not in ("", "html", "body"):
        at = elements[at].parent
    return at


def inside(elements: list[Element], at: int, top: int) -> bool:
    while at > top:
        at = elements[at].parent
    return at == top


def main_text(page: str | None) -> str:
    """The blocks of the main region, one per line.

    The heaviest stretch leads, in article or main and elsewhere. With it stay stretches of at least
    ``SHARE`` of its weight and those of the same region: all in article or main where it lies in
    such, else those in its container. Between the first surge and the last dive every block that is
    no furniture stays, link-only blocks and light stretches too. So do the link-only blocks at the
    edges of a kept article, and link-only headings and paragraphs right before and after."""
    lines, elements = lines_of(page or "")
    found = stretches([x.weight for x in lines])
    if not found:
        return ""

    def weigh(r: tuple[int, int]) -> int:
        return sum(x.weight for x in lines[r[0] : r[1]])

    parts = []  # stretches, divided where an article or main begins or ends
    for a, b in found:
        heavy = [i for i in range(a, b) if lines[i].weight]
        cuts = [a, *(j for i, j in zip(heavy, heavy[1:], strict=False) if bool(lines[i].main) != bool(lines[j].main)), b]
        parts += zip(cuts, cuts[1:], strict=False)
    marked = bool(lines[max(parts, key=weigh)[0]].main)
    if not marked:
        parts = found
    lead = max(parts, key=weigh)
    top = 0 if marked else region(elements, [x.own for x in lines[lead[0] : lead[1]] if x.weight])

    def stays(r: tuple[int, int]) -> bool:
        if weigh(r) >= SHARE * weigh(lead):
            return True
        return bool(lines[r[0]].main) if marked else any(x.weight and inside(elements, x.own, top) for x in lines[r[0] : r[1]])

    kept = [r for r in parts if stays(r)]
    start, end = kept[0][0], kept[-1][1]

    def beside(i: int) -> bool:
        at = lines[i].own
        while at and elements[at].name in INLINE:
            at = elements[at].parent
        return not lines[i].furniture and not lines[i].weight and bool(lines[i].main) == marked and elements[at].name in ("h1", "h2", "h3", "h4", "h5", "h6", "p") and inside(elements, at, top)

    while start and beside(start - 1):
        start -= 1
    while end < len(lines) and beside(end):
        end += 1
    own = {x.main for r in kept if marked for x in lines[r[0] : r[1]] if x.weight and x.main}
    return "\n".join(x.text for i, x in enumerate(lines) if x.text and not x.furniture and (start <= i < end or x.main in own))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null or empty page, and one without main text, has the empty text and 0 characters. Pages cut
    off anywhere, unclosed and misnested elements are read as far as they go; whole pages are read.
    Null and repeated ids are carried through; other columns are ignored; an empty table gives an
    empty table."""
    tune(pages.sparkSession)

    def run(batches):
        for b in batches:
            found = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars bigint")
