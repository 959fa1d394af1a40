"""Main text of web pages by the ratios of their tag paths."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardflow.llm.common import bounded_batches, pick

# Fixed values of HTML: elements that begin a block, that have no end tag, and whose content is not text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section "
    "select summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that ends where one of the others begins.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
    "option": {"option", "optgroup"}, "head": {"body"},
}
# Elements, and words of class, id and role, that are not part of an article.
NEVER = frozenset("head title noscript template svg iframe object select textarea button".split())
APART = frozenset("nav footer aside form menu dialog".split())
APART_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that say of a class token that something is there, is not, or how it is: the element itself is not that thing.
MODIFIERS = frozenset("no not has have with without is free open opened closed hidden enabled disabled active".split())
#: A header of these is the heading of an article.
OF_ARTICLES = frozenset("entry post article content page story section title".split())
BODY = frozenset("html body main".split())
CONTAINERS = frozenset("article main".split())
#: Words that tell a reader's comment from an article where the element is an article.
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
#: What a section inside an article may be called ("Related work").
OF_SECTIONS = frozenset({"related"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^<>]*>?|<[!?][^>]*>?"
    r"|[^<]+|<",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·¿¡]")
#: Weights of a node's neighbours, nearest in the middle.
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
#: A path is left out if its score is under this share of the page's mean, and more than a deviation below it.
SHARE = 0.5
#: Share of the kept text that the container of an article has.
CONTAINED = 0.8


def _named(tag: str, attributes: str, inside: bool) -> bool:
    """Whether a class, id or role names a part that is not of an article: by the first or the last word of a token."""
    for found in NAMES.finditer(attributes):
        for token in (found[1] or found[2] or found[3] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            if not words or not MODIFIERS.isdisjoint(words):
                continue
            ends = {words[0], words[-1]} & (COMMENT_WORDS if tag == "article" else APART_WORDS)
            if inside or not OF_ARTICLES.isdisjoint(words):
                ends -= {"header"}
            if inside and tag == "section":
                ends -= OF_SECTIONS
            if ends:
                return True
    return False


class Element:
    """A block element with its parent and a number for its path of tags. Elements are numbered as they open, so those inside one follow it.

    ``never``: no text of an article, whatever it holds. ``apart`` and
    ``named``: the tag, or a name, says that it is not part of an article.
    """

    __slots__ = ("tag", "parent", "number", "last", "depth", "path", "outer", "never", "apart", "named", "aside", "holds", "chars", "dropped")

    def __init__(self, tag: str, parent: Element | None, number: int, path: int, never: bool, apart: bool, named: bool) -> None:
        self.tag, self.parent, self.number, self.last, self.path = tag, parent, number, number, path
        self.depth = parent.depth + 1 if parent else 0
        self.never = never or bool(parent and parent.never)
        self.apart, self.named = apart, named
        # Below something that is apart; a form may stand around a whole page and does not count.
        self.aside = bool(parent and parent.aside) or named or (apart and tag != "form")
        self.outer = parent.outer if parent and parent.outer is not None else path if tag in CONTAINERS else None
        self.holds, self.chars, self.dropped = False, 0, False


@dataclass(frozen=True)
class Node:
    """A block of text with the element it stands in, and whether most of it is the text of links."""

    element: Element
    text: str
    linked: bool


def nodes(source: str) -> tuple[list[Node], list[Element]]:
    """The blocks of text of a page in order, and its block elements; what is apart from an article is left out.

    An element that is apart by its tag or by its name stays if it holds an
    article or main element that is not, where the page has no other, or if it
    is a form around one; on a page without article or main it stays with over
    half the text. Every token is handled in constant time, however deep it stands.
    """
    found: list[Node] = []
    paths: dict[tuple[int, str], int] = {}
    root = Element("", None, 0, 0, False, False, False)
    elements, opened, count = [root], [root], defaultdict(int)
    pieces: list[str] = []
    links, in_link = 0, False
    plain: list[Element] = []  # containers that stand outside of what is apart
    beside: list[Element] = []

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text and not opened[-1].never:
                found.append(Node(opened[-1], text, 2 * links > len(text)))
        links = 0

    def pop() -> Element:
        e = opened.pop()
        e.last = len(elements) - 1
        count[e.tag] -= 1
        return e

    for token in TOKEN.finditer(source):
        tag = token[3]
        if tag is None:
            said = token[0]
            if said[0] != "<" or said == "<":
                pieces.append(said)
                links += len(said.strip()) if in_link else 0
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = not token[2]
            continue
        flush()
        if token[2]:
            if count[tag]:
                while pop().tag != tag:
                    pass
            continue
        if tag in VOID or token[4].endswith("/"):
            continue
        if opened[-1].tag == "p" or opened[-1].tag in HEADINGS and tag in HEADINGS:
            pop()
        while opened[-1].tag in ENDED_BY and tag in ENDED_BY[opened[-1].tag]:
            pop()
        parent = opened[-1]
        inside = parent.outer is not None
        named = _named(tag, token[4], inside) and tag not in BODY
        path = paths.setdefault((parent.path, tag), len(paths) + 1)
        e = Element(tag, parent, len(elements), path, tag in NEVER, tag in APART or (tag == "header" and not inside), named)
        elements.append(e)
        opened.append(e)
        count[tag] += 1
        if tag in CONTAINERS and not named and not e.never:
            (beside if parent.aside else plain).append(e)
    flush()
    while len(opened) > 1:
        pop()
    root.last = len(elements) - 1

    for e in plain or beside:
        while e.parent is not None and not e.parent.holds:
            e = e.parent
            e.holds = True
    for x in found:
        x.element.chars += len(x.text)
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
    articles, total = bool(plain or beside), root.chars
    for e in elements[1:]:
        own = (e.apart or e.named) and not e.holds and (articles or 2 * e.chars <= total)
        e.dropped = e.parent.dropped or own
    return [n for n in found if not n.element.dropped], elements


def path_scores(found: list[Node]) -> np.ndarray:
    """A score for each node: mean text length times mean punctuation of its tag path, each smoothed over the page.

    A node inside an article or main element has at least the mean ratios of
    that element, longer blocks counting for more, so a list or a short
    heading is not torn out of its text.
    """
    chars, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    keys = [(x.element.path, ("in", x.element.outer) if x.element.outer is not None else x.element.path) for x in found]
    for x, (path, outer) in zip(found, keys):
        n, m = len(x.text), len(PUNCTUATION.findall(x.text))
        for key, weight in ((path, 1), (outer, n)) if outer != path else ((path, 1),):
            chars[key] += weight * n
            marks[key] += weight * m
            count[key] += weight

    def ratio(total: dict) -> np.ndarray:
        own = [max(total[k] / count[k] for k in pair) for pair in keys]
        values = np.array(own, float)
        reach = len(KERNEL) // 2
        padded = np.pad(values, reach, mode="edge")
        return np.convolve(padded, KERNEL / KERNEL.sum(), "valid")

    return np.sqrt(ratio(chars) * (1 + ratio(marks)))


def main_text(source: str) -> str:
    """The content nodes of a page, joined by line ends."""
    found, elements = nodes(source)
    if not found:
        return ""
    scores = path_scores(found)
    weights = np.array([len(x.text) for x in found], float)
    mean = float(np.average(scores, weights=weights))
    spread = float(np.sqrt(np.average((scores - mean) ** 2, weights=weights)))
    of_path: dict[int, list[float]] = defaultdict(list)
    for x, value in zip(found, scores):
        of_path[x.element.path].append(value)
    least = min(mean - spread, SHARE * mean)
    kept_paths = {path for path, values in of_path.items() if sum(values) / len(values) >= least}
    above = lambda e: e.parent.path if e.parent else None
    parents = {above(x.element) for x in found if x.element.path in kept_paths}
    kept = [x.element.path in kept_paths or (x.element.tag in HEADINGS and above(x.element) in parents) for x in found]
    return "\n".join(x.text for x, k in zip(found, _with_inner(found, elements, kept)) if k)


def _with_inner(found: list[Node], elements: list[Element], kept: list[bool]) -> list[bool]:
    """Also what the ratios leave out inside the text: lists, tables and short lines of the container of the kept blocks, and its heading.

    On a page without article or main the container is the deepest element
    with CONTAINED of the kept text. All between its first and last kept block
    stays; what stands before or after those stays unless it is made of links,
    or the container is the body itself, where menus and imprints stand.
    """
    kept = list(kept)
    if not any(x.element.outer is not None for x in found):
        chars = [0] * len(elements)
        for x, k in zip(found, kept):
            chars[x.element.number] += len(x.text) if k else 0
        for e in reversed(elements[1:]):
            chars[e.parent.number] += chars[e.number]
        whole = chars[0]
        holds_most = [e for e in elements[1:] if chars[e.number] and chars[e.number] >= CONTAINED * whole]
        best = max(holds_most, key=lambda e: e.depth, default=None)
        inside = [i for i, x in enumerate(found) if best is None or best.number <= x.element.number <= best.last]
        text = [i for i in inside if kept[i]]
        for i in inside:
            closed = best is not None and best.tag not in BODY and not found[i].linked
            kept[i] = kept[i] or text[0] < i < text[-1] or closed
    first = kept.index(True) if True in kept else 0
    for i in range(first):
        kept[i] = found[i].element.tag == "h1"
    while first and found[first - 1].element.tag in HEADINGS:
        first -= 1
        kept[first] = True
    return kept


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
        columns = [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, from its whole html.

    The length and the punctuation of the text blocks are added up per path of
    block elements; the two ratios of a path are smoothed over the page and
    multiplied, and paths well below the page's mean are left out unless they
    stand inside the text, as are elements that are not part of an article
    (menus, forms, comments, ...).

    * null or empty html gives an empty text; a null url or id stays null.
    * a page without any tag is one block; broken markup is read as it comes.
    * repeated rows give repeated rows; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    base = pick(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return base.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
