"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
#: The same without regard to quotes, for pages on which looking for their ends has taken PATIENCE times the page's length.
PLAIN_TAG, PATIENCE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S), 20
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…]")

#: Elements whose content is no text of the page, and which of them swallow the rest of the page if they are never closed.
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
SWALLOWING = frozenset("script style title textarea".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements of the second kind end when an element of the first begins.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
LISTS = frozenset("ul ol dl table article section div main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are part of a text and not what holds it.
PARTS = frozenset("p li dd dt pre blockquote ul ol dl tr td th tbody thead table figure figcaption".split()) | HEADINGS

#: What names tell, the signal that is fused with the ratios: elements for and against an article, and words of class, id and
#: role against it. A word counts only if all of its parts are marks or say no more than where and what kind of box it is.
FOR = frozenset("article main".split())
AGAINST = frozenset("nav footer aside form button dialog menu header fieldset".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus reply replies related recommended share sharing social newsletter subscribe popup modal widget toolbar search login complementary contentinfo".split()
)
BOXES = frozenset("area bar block box buttons column container form group inner item items left links list main outer page panel post posts right section site slot top bottom unit wrap wrapper articles stories".split())
#: Marks of what readers write: never the main text, however long it is.
READERS = frozenset("comment comments disqus reply replies".split())
#: Of an article's own parts, in its header: its title and lead.
OWN = frozenset("header masthead".split())
FAVOUR, PENALTY = 4.0, 0.1
#: Elements that hold no article at all, however much they have.
NEVER = frozenset("nav footer menu".split())
SMOOTH = 1.0


def tags(page: str, done: Callable[[], int]) -> Iterator[re.Match[str]]:
    """The tags and comments of a page, from where the reader has got to each time."""
    tag, begin, looked = TAG, page.find("<"), 0
    while begin >= 0:
        found = tag.match(page, begin)
        if found:
            yield found
            begin = page.find("<", done())
            continue
        if tag is PLAIN_TAG and page.find(">", begin) < 0:
            return
        looked += len(page) - begin if page[begin + 1 : begin + 2].strip(" \t\n<>") else 0
        tag = PLAIN_TAG if looked > PATIENCE * len(page) else TAG
        begin = page.find("<", begin + 1)


class Page:
    """The elements of a page, numbered as they begin, 0 being the page itself, and its blocks in order.

    Of each element: its parent, name, and tag path; of each tag path: its names and marks on the way. All of it takes time and
    memory in proportion to the page, however deep elements stand in each other.
    """

    def __init__(self, page: str) -> None:
        self.parent, self.names, self.path, self.blocks = [-1], [""], [0], []
        self.paths: dict[tuple[int, str], int] = {}
        #: Of each path: the last component's name, how many components tell for, against, and that they are a header, and whether
        #: there is one that holds no article, or what readers write.
        self.last, self.tells, self.never, self.readers = [""], [(0, 0, 0)], [False], [False]
        self.read(page)
        self.own = [told(c) for c in self.components]

    def path_of(self, above: int, component: str) -> int:
        found = self.paths.get((above, component))
        if found is None:
            found = self.paths[above, component] = len(self.last)
            name, tells = name_of(component), told(component)
            self.last.append(name)
            self.tells.append(tuple(n + (tells == kind) for n, kind in zip(self.tells[above], ("for", "against", "own"))))
            self.never.append(self.never[above] or name in NEVER)
            self.readers.append(self.readers[above] or (tells == "against" and bool(READERS.intersection(re.split(r"[^a-z]+", component.partition(".")[2])))))
        return found

    def read(self, page: str) -> None:
        stack: list[int] = [0]
        places: dict[str, list[int]] = {}  # of open elements by name, their places on the stack
        holders: list[int] = []  # the places of those that end no others
        self.components, unclosed = [""], set()
        at = links = 0
        current: Block | None = None

        def add(piece: str) -> None:
            nonlocal current
            if current is None:
                current = Block(stack[-1], self.path[stack[-1]])
                self.blocks.append(current)
            current.pieces.append(piece)
            current.linked += len(piece) if links else 0

        def close(names: tuple[str, ...], within: bool) -> None:
            nonlocal current
            place = max((places[n][-1] for n in names if places.get(n)), default=0)
            if place == 0 or (within and holders and holders[-1] > place):
                return
            for element in reversed(stack[place:]):
                places[self.names[element]].pop()
            del stack[place:]
            while holders and holders[-1] >= place:
                holders.pop()
            current = None

        for m in tags(page, lambda: at):
            if m.start() > at:
                add(page[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name, closed = name.lower(), m[3].endswith("/")
            if name == "a":
                links = 0 if m[1] else 1
            if m[1]:
                if name not in INLINE:
                    close((name,), False)
                    current, links = None, 0
                continue
            if name in RAW and not (closed and name in ("svg", "math")):
                end = None if name in unclosed else RAW_END[name].search(page, at)
                if end is None:
                    unclosed.add(name)
                at = end.end() if end else len(page) if name in SWALLOWING else at
                continue
            if name in ("br", "hr"):
                add(" ")
            if name in VOID or name in INLINE or closed:
                continue
            if name in ENDS:
                close(ENDS[name], True)
            elif self.names[stack[-1]] == "p":
                close(("p",), True)
            marks = " ".join(x for found in NAMES.findall(m[3]) for x in found if x).lower() if m[3] else ""
            component = f"{name}.{marks}" if marks else name
            self.parent.append(stack[-1])
            self.names.append(name)
            self.components.append(component)
            self.path.append(self.path_of(self.path[stack[-1]], component))
            places.setdefault(name, []).append(len(stack))
            if name in LISTS:
                holders.append(len(stack))
            stack.append(len(self.names) - 1)
            current, links = None, 0
        if at < len(page):
            add(page[at:])

    def up(self, values: list) -> list:
        """Sums over each element and all below it."""
        for e in range(len(values) - 1, 0, -1):
            values[self.parent[e]] += values[e]
        return values

    def line(self, element: int) -> list[int]:
        """The element and what it stands in, up to the page."""
        out = [element]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out


class Block:
    """A run of text of one block element: the element, its tag path, the text's pieces, and how many of its characters are links."""

    __slots__ = ("element", "path", "pieces", "linked")

    def __init__(self, element: int, path: int):
        self.element, self.path, self.pieces, self.linked = element, path, [], 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def name_of(component: str) -> str:
    return component.partition(".")[0]


def told(component: str) -> str:
    """What a path's component tells by its name or marks: `for`, `against`, `own` (of a header), or nothing."""
    name, _, marks = component.partition(".")
    if name in FOR:
        return "for"
    for word in marks.split():
        parts = [p for p in re.split(r"[^a-z]+", word) if p]
        found = MARKS.intersection(parts)
        if found and all(p in MARKS or p in BOXES for p in parts):
            return "own" if found <= OWN else "against"
    return ("own" if name in OWN else "against") if name in AGAINST else ""


def signal(favour: int, against: int, own: int) -> float:
    """The names' part of a path's value: a factor for each thing that is told, at most one in favour."""
    return (FAVOUR if favour else 1.0) * PENALTY ** (against + (0 if favour else own))


def smoothed(values: np.ndarray) -> np.ndarray:
    """A Gaussian mean over neighbours; at the ends over those that are there."""
    reach = int(3 * SMOOTH)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SMOOTH) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weight


def ratios(texts: list[str], made: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block the number of its tag path, and of that path: the length of text that is no link and the punctuation, both for
    each of its blocks, and the share of links in its text."""
    path = np.unique([b.path for b in made], return_inverse=True)[1]
    sizes, linked = np.array([len(t) for t in texts]), np.array([b.linked for b in made])
    plain = np.maximum(sizes - linked, 0) + 0.1 * np.minimum(linked, sizes)
    each = np.bincount(path)
    length, marks = np.bincount(path, plain) / each, np.bincount(path, [len(PUNCTUATION.findall(t)) for t in texts]) / each
    return path, length[path], marks[path], (np.bincount(path, np.minimum(linked, sizes)) / np.bincount(path, sizes))[path]


def selected(texts: list[str], made: list[Block], names: np.ndarray) -> np.ndarray:
    """Which blocks are content: all those of the tag paths that reach the threshold.

    As sequences over the page's blocks both ratios of the tag paths are smoothed; the fusion is the product of the raw and
    smoothed lengths' geometric mean, of one plus that of punctuation, and of what the path's names tell. A path has the mean of
    its blocks' values. The threshold is the standard deviation of the values over the blocks, but no more than a third of the
    largest.
    """
    path, length, marks, _ = ratios(texts, made)
    fused = np.sqrt(length * smoothed(length)) * (1 + np.sqrt(marks * smoothed(marks))) * names
    values = (np.bincount(path, fused) / np.bincount(path))[path]
    return values >= min(values.std(), values.max() / 3)


def holder(page: Page, texts: list[str], made: list[Block], content: np.ndarray) -> int:
    """The element that holds the article, 0 for the page: from the deepest one with nearly all selected blocks and nearly all of
    their text up to what holds it as a part, to siblings with selected text or headings, and to the article or main
    element around it."""
    n = len(page.names)
    mass, count, heads = [0] * n, [0] * n, [0] * n
    for block, text, good in zip(made, texts, content):
        if good:
            mass[block.element] += len(text)
            count[block.element] += 1
        if page.last[block.path] in HEADINGS and not any(page.tells[block.path][1:]):
            heads[block.element] += 1
    mass, count, heads = page.up(mass), page.up(count), page.up(heads)
    article = max((e for e in range(1, n) if count[e] and mass[e] >= 0.9 * mass[0] and count[e] >= 0.9 * count[0]), default=0)
    if not article:
        return 0
    for kind in ("article", "main"):
        around = [e for e in page.line(article) if page.names[e] == kind]
        if around:
            return around[0]
    children: dict[int, list[int]] = {}
    for e in range(1, n):
        children.setdefault(page.parent[e], []).append(e)
    while article:
        top = page.names[article]
        if top in ("html", "body"):
            return 0
        more = any((heads[e] or mass[e]) and page.own[e] not in ("against", "own") for e in children[page.parent[article]] if e != article)
        if top not in PARTS and not more:
            return article
        article = page.parent[article]
    return 0


def main_text(text: str | None) -> str:
    """The page's main text: blocks in order, joined by one space; empty if there is none.

    The ratios select paths; the element that holds them is the article. Of its blocks those go that names below it tell against,
    be they ever so long, and those of paths that the ratios neither select nor call text, being links for the most part,
    unless they are parts of a text such as list items. If the whole page is the holder, the selected blocks are returned, with
    what stands between them and the heading before, unless names tell against that.
    """
    page = Page(text or "")
    texts = [b.text() for b in page.blocks]
    made, texts = [b for b, t in zip(page.blocks, texts) if t], [t for t in texts if t]
    if not made:
        return ""
    content = selected(texts, made, np.array([0.0 if page.readers[b.path] else signal(*page.tells[b.path]) for b in made]))
    content &= ~np.array([page.readers[b.path] for b in made])
    if not content.any():
        return ""
    never = np.array([page.never[b.path] for b in made])
    if never[content].all():
        return ""
    article = holder(page, texts, made, content)
    if article:
        links = ratios(texts, made)[3]
        inside = [0] * len(page.names)
        inside[article] = 1
        for e in range(article + 1, len(inside)):
            inside[e] = inside[page.parent[e]]
        against = page.tells[page.path[article]][1]
        keep = [inside[b.element] and page.tells[b.path][1] == against and (good or share <= 0.5 or b.element == article or page.last[b.path] in PARTS) for b, good, share in zip(made, content, links)]
    else:
        first, last = int(np.argmax(content)), len(content) - 1 - int(np.argmax(content[::-1]))
        if first and page.last[made[first - 1].path] in HEADINGS:
            first -= 1
        keep = [good or (first <= i <= last and not any(page.tells[b.path])) for i, (b, good) in enumerate(zip(made, content))]
    return " ".join(t for t, kept, out in zip(texts, keep, never) if kept and not out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page, from its whole html.

    NULL and empty html, and html without text, give the empty text. Pages of any length and depth take time in proportion. Repeated rows and NULL ids stay; other columns are
    ignored; no rows give no rows.
    """

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in column], dtype=object)

    got = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
