"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block of text. Blank lines part what stands in different
containers, and stand for what the contract names as no text (scripts, forms, menus and the
like). Text and link lengths are summed over windows of a few lines: where the sum rises from
zero is a surge, where it is zero again a dive, and the lines between them form one passage.
The page's heaviest passage sets the height that others must reach; <article> and <main> are a
weight in that comparison. The whole is linear in the page's length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.llm.common import by_size


@dataclass(frozen=True)
class LineBlockParams:
    window: int = 3  # lines whose text lengths are summed
    links: float = 0.5  # a passage of more link text than this share is a menu
    height: float = 0.5  # least peak of a further passage, against that of the heaviest
    weight: float = 2.0  # what a character in <article> or <main> counts against others


# HTML's element kinds.
RAW = "script style noscript template iframe textarea select svg math object canvas title head".split()
BOILERPLATE = set("nav header footer aside form button dialog menu".split())
MAIN = {"article", "main"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q ruby s samp small span strike strong sub sup time tt u var wbr rp rt nobr".split()
)
# Blocks of a running text; other blocks are containers of them.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address details summary".split())
# Whole names in class and id attributes that say menu, header, footer, sidebar, notice, advert,
# form or reader comments, alone or with a word for a place or a box. Other names say nothing:
# what they hold is judged by its text.
HINTS = re.compile(
    r"(?:^|\s)(?:(?:site|page|top|bottom|left|right|main|global|primary|secondary|user|reader|cookie|google|text|side|sticky|article|post)[_-])*"
    r"(?:ads?|advert(?:s|isements?|ising)?|banners?|sponsor(?:ed|s)?|promos?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|headers?|masthead|cookies?|consent|notices?|gdpr|popups?|modals?|newsletter|comments?|disqus|replies)"
    r"(?:[_-](?:box|bar|block|area|list|section|container|wrapper|wrap|inner|outer|content|unit|slot|banner|notice|consent|form|thread|item|links?|top|bottom|left|right|[0-9]+))*(?=$|\s)",
    re.I,
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW[:-1])})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def is_boilerplate(name: str, rest: str) -> bool:
    if name in BOILERPLATE:
        return True
    if not rest or name in ("body", "html", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id") and HINTS.search(value):
            return True
    return False


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    main: int  # number of the innermost <article> or <main> around it, or 0
    inside: int  # number of the container it stands in
    around: int  # the container around that one
    direct: bool  # no textual block between it and its container


@dataclass
class Open:
    """An open element. ``inside`` and ``around`` are what text in it stands in."""

    name: str
    bad: bool
    number: int
    inside: int
    around: int
    direct: bool
    main: int


ROOT = Open("", False, 0, 0, -1, True, 0)


class Reader:
    """The page's blocks of text in order, with ``blank`` None lines where anything was taken
    out and where the container changes. ``places`` gives the lines of every <article> and
    <main>, by its number. Every element is entered and left once, so work is linear."""

    def __init__(self, page: str, blank: int):
        self.blank = [None] * blank
        self.out: list[Line | None] = []
        self.places: dict[int, tuple[int, int]] = {}
        self.stack = [ROOT]
        self.depths: dict[str, list[int]] = {}  # places of the open elements of a name
        self.blocks = [0]  # places of the open elements that are blocks
        self.parts: list[str] = []
        self.skipped = self.links = self.linked = self.count = 0
        self.last: Line | None = None
        at = 0
        for m in TOKEN.finditer(page):
            self.say(page[at : m.start()])
            at = m.end()
            name = (m["name"] or "").lower()
            if name:
                self.tag(name, bool(m["close"]), m["rest"])
        self.say(page[at:])
        self.leave(1)
        self.end_block()

    def say(self, raw: str) -> None:
        if raw and not self.skipped:
            text = entities.unescape(raw)
            self.parts.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            top = self.stack[-1]
            if self.last and self.last.inside != top.inside:
                self.out.extend(self.blank)
            self.last = Line(text, self.linked, top.main, top.inside, top.around, top.direct)
            self.out.append(self.last)
        self.parts.clear()
        self.linked = 0

    def leave(self, depth: int) -> None:
        """Close the open elements from this place on."""
        while len(self.stack) > max(depth, 1):
            element = self.stack[-1]
            if element.name not in INLINE:
                self.end_block()
                self.blocks.pop()
            self.stack.pop()
            self.depths[element.name].pop()
            self.skipped -= element.bad
            self.links -= element.name == "a"
            if element.name in MAIN:
                self.places[element.number] = (self.places[element.number][0], len(self.out))
            if element.bad:
                self.out.extend(self.blank)

    def nearest(self, *names: str) -> int:
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def tag(self, name: str, closing: bool, rest: str) -> None:
        if name not in INLINE:
            self.end_block()
        if closing:
            if depth := self.nearest(name):
                self.leave(depth)
            return
        if name in VOID or rest.endswith("/"):
            return
        # Blocks whose end tags may be left out.
        if name == "p" and self.stack[self.blocks[-1]].name == "p":
            self.leave(self.blocks[-1])
        elif name in FENCES and self.nearest(name) > self.nearest(*FENCES[name]):
            self.leave(self.nearest(name))
        bad = is_boilerplate(name, rest)
        if name in MAIN and self.skipped and not self.stack[-1].main:
            # The main text does not stand in a menu: an element before it was never closed.
            self.leave(next(i for i, e in enumerate(self.stack) if e.bad))
        if bad:
            self.end_block()
            self.out.extend(self.blank)
        self.count += 1
        up = self.stack[-1]
        if name in INLINE:
            place = (up.inside, up.around, up.direct)
        elif name in TEXTUAL:
            place = (up.inside, up.around, False)
        else:
            place = (self.count, up.inside, True)
        if name in MAIN:
            self.places[self.count] = (len(self.out), len(self.out))
        self.depths.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(Open(name, bad, self.count, *place, self.count if name in MAIN else up.main))
        self.skipped += bad
        self.links += name == "a"


# Elements that a new one of the same name closes, unless one of these stands between.
FENCES = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",),
}


@dataclass
class Passage:
    lines: list[Line]
    start: int  # place of its first line in the page
    peak: int  # highest window sum of text
    size: int
    linked: int

    def joins(self, other: Passage) -> bool:
        """Does the other passage, which follows, go on in the same container or in one that
        is no more than a paragraph of it?"""
        a, b = self.lines[-1], other.lines[0]
        if a.main != b.main:
            return False
        homes = [{x.inside, x.around if x.direct else x.inside} for x in (a, b)]
        return bool(homes[0] & homes[1])


def passages(rows: list[Line | None], window: int) -> list[Passage]:
    """Runs of lines between a surge and a dive of the window sums."""
    sizes = [len(r.text) if r else 0 for r in rows]
    out: list[Passage] = []
    surge, total, peak = None, 0, 0
    for i in range(len(sizes) + window):  # total covers the lines i-window+1 .. i
        total += (sizes[i] if i < len(sizes) else 0) - (sizes[i - window] if i >= window else 0)
        if total and surge is None:
            surge, peak = i, 0
        peak = max(peak, total)
        if not total and surge is not None:
            own = [r for r in rows[surge:i] if r]
            out.append(Passage(own, surge, peak, sum(len(r.text) for r in own), sum(r.linked for r in own)))
            surge = None
    return out


def joined(found: list[Passage], near: Callable[[Passage, Passage], bool]) -> list[Passage]:
    """Neighbouring passages as one where they are ``near`` each other."""
    out: list[Passage] = []
    for p in found:
        if out and near(out[-1], p):
            q = out[-1]
            q.lines.extend(p.lines)
            q.peak, q.size, q.linked = max(q.peak, p.peak), q.size + p.size, q.linked + p.linked
        else:
            out.append(Passage(list(p.lines), p.start, p.peak, p.size, p.linked))
    return out


def main_text(page: str | None, params: LineBlockParams = LineBlockParams()) -> str:
    """Main text of one page: blocks in page order, joined by one space; "" if there is none.

    Passages that only a removed element parts are joined; those that are mostly links are
    menus, unless they stand in <article> or <main> with text of their own. Of the others the
    one of most text is the core: links count against it, and text in <article> or <main>
    counts ``weight`` times. Another passage is kept if its peak, so weighted, is at least
    ``height`` of the core's (in the core's own <article> or <main>: of the core's unweighted
    peak); if it stands in an <article> or <main> that does not hold the core (a teaser stays,
    but decides nothing); if it stands in a container of which another passage is kept, or
    between two kept ones of one container's parts. Inside the core's region, too, the windows
    decide: a list of links or a short passage in a container of its own goes. Nothing is cut
    or capped.
    """
    read = Reader(page or "", params.window)
    running = lambda p: p.linked <= params.links * p.size or bool(p.lines[0].main) and p.linked < p.size - _spaces(p)
    weight = lambda p: params.weight if p.lines[0].main else 1.0
    same = joined(passages(read.out, params.window), lambda a, b: a.lines[-1].inside == b.lines[0].inside and a.lines[-1].main == b.lines[0].main)
    found = joined([p for p in same if running(p)], Passage.joins)
    if not found:
        return ""
    core = max(found, key=lambda p: p.size * weight(p) - p.linked)
    home = core.lines[0].main
    around = {n for n, (first, last) in read.places.items() if first <= core.start < last}
    least = params.height * core.peak
    kept = set()
    for p in found:
        own = p.lines[0].main
        apart = own and own not in around
        if p is core or apart or p.peak * weight(p) >= (least if own == home else least * weight(core)):
            kept.add(p.start)
    shared = {r.inside for p in found if p.start in kept for r in p.lines}
    spread: dict[int, list[int]] = {}  # container -> first and last kept part
    for p in found:
        if p.start in kept:
            spread.setdefault(p.lines[0].around, [p.start, p.start])[1] = p.start
    for p in found:
        first, last = spread.get(p.lines[0].around, (0, 0))
        if first < p.start < last or any(r.inside in shared for r in p.lines):
            kept.add(p.start)
    return " ".join(r.text for p in found if p.start in kept for r in p.lines)


def _spaces(p: Passage) -> int:
    """Spaces of a passage's lines, which are not counted as link text."""
    return sum(r.text.count(" ") for r in p.lines)


def extract_pages(pages: DataFrame, params: LineBlockParams = LineBlockParams(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html gives an empty text.

    No shuffle; a task holds a batch of pages. Rows with equal or null keys stay rows.
    """

    def run(batches):
        for batch in batches:
            sources = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in by_size(sources, 4_000_000):
                texts = [main_text(t, params) for t in sources[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
