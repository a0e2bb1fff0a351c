"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of text is a line; furniture (menus, adverts, forms,
comments) becomes a gap of empty lines. The text lengths of sliding windows of lines,
links not counted, rise at a surge and fall to nothing at a dive. The stretches between
are weighed by their highest window. A stretch is kept, whole, if it is the page's main one
or reaches a fair share of its peak. On a page with article or main elements, whose borders
are dives, the stretches of each element are weighed together and the others are left out.

Pages are read forward only: whatever is broken in them, each character is looked at a
bounded number of times.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame

from turnloom.llm.texts import map_texts

#: Lines of a window; the share of the highest window that a stretch must reach.
WINDOW, SHARE = 3, 0.3

# Elements without readable text, furniture, blocks, and those never closed.
SILENT = frozenset("script style noscript template svg iframe object canvas head select option button".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Fixed value: words of class, id and role names that mark furniture.
MARKS = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|respond|cookies?|consent|"
    r"disqus|footer|header|masthead|menu|nav\w*|newsletter|notice|pagination|pager|popup|modal|promo\w*|"
    r"related|recommend\w*|share|sharing|sidebar|side-?bar|social|sponsor\w*|subscribe|subscription|"
    r"tags?|toolbar|topbar|widgets?|contentinfo|complementary|navigation|search|dialog|alert)(?:$|[\s_-])"
)
# Marks that name parts of an article as well, and elements whose ids are made
# from headings.
PARTS = frozenset("alert notice tag tags search header masthead dialog".split())
HEADED = frozenset("h1 h2 h3 h4 h5 h6 p section li dt dd".split())
# Class names of reader comments, also where an element is an article; names that say
# an element holds the content, whatever stands beside them; words before a mark that only speak of it.
COMMENTS = re.compile(r"(?i)(?:^|\s)(?:(?:reader|user|post|article|entry)[_-]?)?(?:comments?|responses?|replies|respond|disqus)(?:$|[\s_-])")
CONTENT = frozenset("post article entry content story page hentry main site".split())
ABOUT = frozenset("has with no without is not".split())
NAMES = re.compile(r"""(?is)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDDEN = re.compile(
    r"(?is)(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none"
)
CLOSERS = {name: re.compile(rf"(?i)</{name}\s*+>") for name in (*SILENT, "textarea")}
CLOSERS["head"] = re.compile(r"(?i)</head\s*+>|<body\b")
SPACE, WORDS = re.compile(r"\s+"), re.compile(r"([\s_-]+)")


class Line(NamedTuple):
    text: str
    weight: int  # characters outside links; in an article or main element, all
    main: int  # number of the outermost article or main element around it; 0 for none
    marked: bool  # inside an element that only its names mark as furniture


class Tag(NamedTuple):
    start: int  # where the text before it ends
    end: int
    name: str  # empty for comments and the like
    closing: bool = False
    attributes: str = ""
    text: str = ""  # of a CDATA section


class Tags:
    """The tags of a page, from left to right.

    A tag ends at the first ``>`` outside quotes. Where there is none, the first ``>`` will do;
    where there is not even one, the rest is text. A search that fails is not tried again:
    ``dead`` are quotes from which no tag ends, ``lost`` what does not come any more.
    """

    OPEN = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*+")
    PLAIN = re.compile(r"[^>\"']*+")

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()
        self.lost: set[str] = set()
        self.closers: dict[str, re.Match | None] = {}

    def find(self, what: str, at: int) -> int:
        if what in self.lost:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.lost.add(what)
        return found

    def closer(self, name: str, at: int) -> re.Match | None:
        """The next closing tag of an element without markup inside."""
        known = self.closers.get(name)
        if name not in self.closers or (known is not None and known.start() < at):
            known = self.closers[name] = CLOSERS[name].search(self.page, at)
        return known

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: the place of its ``>``, or -1."""
        page, opened = self.page, []
        nearest = self.find(">", at)
        if nearest < 0:
            return -1
        while True:
            at = self.PLAIN.match(page, at).end()
            if at >= len(page) or at in self.dead:
                break
            if page[at] == ">":
                return at
            opened.append(at)
            close = self.find(page[at], at + 1)
            at = at + 1 if close < 0 else close + 1
        self.dead.update(opened)
        return nearest

    def after(self, at: int) -> Tag | None:
        """The first tag from ``at`` on."""
        page = self.page
        while (start := self.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return Tag(start, len(page) if end < 0 else end + 3, "")
            if page.startswith("<![CDATA[", start) and (end := self.find("]]>", start)) >= 0:
                return Tag(start, end + 3, "", text=page[start + 9 : end])
            if page.startswith(("<!", "<?"), start):
                if (end := self.find(">", start)) >= 0:
                    return Tag(start, end + 1, "")
            elif opened := self.OPEN.match(page, start):
                end = self._end(opened.end())
                if end >= 0:
                    name = opened[0].lstrip("</").lower()
                    return Tag(start, end + 1, name, opened[0][1] == "/", page[opened.end() : end])
        return None


def _furniture(name: str, attributes: str, in_main: bool) -> str:
    """``skip`` for furniture, ``mark`` where only class, id or role say so, else nothing."""
    if name in FURNITURE and not (name == "header" and in_main):
        return "skip"
    if not attributes:
        return ""
    if HIDDEN.search(attributes):
        return "skip"
    names = [(kind.lower(), a or b or c) for kind, a, b, c in NAMES.findall(attributes)]
    if name not in ("body", "html") and any(kind == "class" and COMMENTS.search(named) for kind, named in names):
        return "skip"
    if name in MAIN or name in ("body", "html"):
        return ""
    for kind, named in names:
        if kind == "id" and (in_main or name in HEADED):
            if _only_marks(named):
                return "mark"
        elif kind == "class":
            if _marked_class(named, in_main):
                return "mark"
        elif MARKS.search(named):
            return "mark"
    return ""


def _marked_class(names: str, in_main: bool) -> bool:
    """Whether class names mark furniture: not where one of them says that the element is the
    content, nor by a name that only speaks of furniture (``has-sidebar``)."""
    own = names.lower().split()
    if not CONTENT.isdisjoint(own):
        return False
    named = " ".join(n for n in own if WORDS.split(n)[0] not in ABOUT)
    if in_main:
        named = "".join([w for w in WORDS.split(named) if w not in PARTS])
    return bool(MARKS.search(named))


def _only_marks(name: str) -> bool:
    """Whether the whole name is marks: ``comments`` and ``cookie-notice``, not ``related-work``."""
    return bool(MARKS.fullmatch(name)) or all(map(MARKS.fullmatch, WORDS.split(name)[::2]))


def lines_of(page: str) -> list[Line | None]:
    """The page's blocks in order; None stands for a gap where furniture or a frame was.

    Lines of an article or main element inside a marked element (not inside other furniture)
    are listed as such; ``main_text`` decides on them.
    """
    lines: list[Line | None] = []
    pieces: list[str] = []
    state = {"links": 0}
    stack: list[tuple[str, str]] = []  # open elements: name, and what they are
    opened: Counter[str] = Counter()
    skip = marks = main = mains = link = 0

    def hidden() -> bool:
        return skip > 0 or (marks > 0 and main == 0)

    def close() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            weight = len(text) if main else max(len(text) - state["links"], 0)
            lines.append(Line(text, weight, mains if main else 0, marks > 0))
        state["links"] = 0

    def add(text: str) -> None:
        if not text or hidden():
            return
        pieces.append(text)
        if link:
            state["links"] += len(SPACE.sub(" ", entities.unescape(text)))

    def leave(kind: str) -> None:
        nonlocal skip, marks, main, link
        if kind in ("skip", "mark"):
            close()
            skip, marks = skip - (kind == "skip"), marks - (kind == "mark")
            if not hidden():
                lines.append(None)
        elif kind == "main":
            close()
            main -= 1
            lines.append(None)
        elif kind == "link":
            link -= 1

    at, tags = 0, Tags(page)
    while (tag := tags.after(at)) is not None:
        add(page[at : tag.start])
        at = tag.end
        add(tag.text)
        name, attributes = tag.name, tag.attributes
        if not name:
            continue
        single = attributes.endswith("/") or attributes.rstrip().endswith("/")
        if name == "textarea" and not tag.closing:
            closed = tags.closer(name, at)
            add(" " + page[at : closed.start()] + " " if closed else " ")
            at = closed.end() if closed else at
            continue
        if name in SILENT and not tag.closing:
            if not single:
                closed = tags.closer(name, at)
                if name == "head" and closed and closed[0].lower().startswith("<body"):
                    at = closed.start()
                    continue
                at = closed.end() if closed else (len(page) if name in ("script", "style") else at)
            if name not in BLOCKS and name not in ("script", "style", "iframe"):
                add(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            elif name == "br":
                add(" ")
            continue
        if not tag.closing:
            if name in BLOCKS:
                close()
                if name == "p" and stack and stack[-1][0] == "p":
                    opened["p"] -= 1
                    leave(stack.pop()[1])
            kind = _furniture(name, attributes, main > 0)
            if kind:
                if not hidden():
                    close()
                    lines.append(None)
                kind = "skip" if main else kind
                skip, marks = skip + (kind == "skip"), marks + (kind == "mark")
            elif name in MAIN:
                kind = "main"
                if not main:
                    mains += 1
                lines.append(None)
                main += 1
            elif name == "a":
                kind = "link"
                link += 1
            if single and name not in BLOCKS:
                leave(kind)
                continue
            if name in BLOCKS or kind:
                stack.append((name, kind))
                opened[name] += 1
            continue
        if name in BLOCKS:
            close()
        if not opened[name]:
            continue
        while stack:
            open_name, kind = stack.pop()
            opened[open_name] -= 1
            leave(kind)
            if open_name == name:
                break
    else:
        add(page[at:])
    close()
    return lines


def stretches(lines: list[Line | None]) -> list[list[Line]]:
    """Runs from a surge to the next dive: to a window of lines that is empty. Lines of links
    within a window before the surge belong to it."""
    weights: list[int] = []
    owners: list[Line | None] = []
    for line in lines:
        if line is None:  # a gap empties a whole window
            weights += [0] * WINDOW
            owners += [None] * WINDOW
        else:
            weights.append(line.weight)
            owners.append(line)
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    runs: list[list[Line]] = []
    inside, dived = False, 0
    for at, owner in enumerate(owners):
        block = upto[min(at + WINDOW, len(weights))] - upto[at]
        behind = upto[at + 1] - upto[max(at + 1 - WINDOW, 0)]
        if not inside and block > 0 and owner is not None and owner.weight > 0:  # surge
            inside = True
            near = owners[max(at + 1 - WINDOW, dived) : at]
            near = near[max((k + 1 for k, line in enumerate(near) if line is None), default=0) :]
            runs.append(near)
        elif inside and block == 0 and behind == 0:  # dive
            inside, dived = False, at
        if inside and owner is not None:
            runs[-1].append(owner)
    return runs


def _peak(run: list[Line]) -> int:
    weights = [line.weight for line in run]
    return max(sum(weights[k : k + WINDOW]) for k in range(len(weights)))


def _by_element(lines: list[Line | None]) -> list[list[Line | None]]:
    """The lines of each outermost article or main element, with their gaps. Elements that stand
    inside a marked one count only on a page that has no others."""
    plain = any(line is not None and line.main and not line.marked for line in lines)
    found: dict[int, list[Line | None]] = {}
    own: list[Line | None] = []
    for line in lines:
        if line is None:
            own.append(None)
        elif line.main and not (plain and line.marked):
            own = found.setdefault(line.main, [])
            own.append(line)
    return list(found.values())


def main_text(page: str | None) -> str:
    """The article's blocks, a line each; empty without any."""
    if not page:
        return ""
    lines = lines_of(page)
    # Of a page without such elements, each stretch stands for itself.
    elements = [stretches(own) for own in _by_element(lines)] or [[run] for run in stretches(lines)]
    peaks = [max(map(_peak, runs)) for runs in elements]
    highest = max(peaks, default=0)
    kept = [runs for runs, peak in zip(elements, peaks) if peak >= SHARE * highest]
    return "\n".join(line.text for runs in kept for run in runs for line in run)


def extract_text(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keys, text, n_chars``: each page's main text and its code points.

    NULL and empty pages, and pages of furniture only, give the empty text. Pages of any
    length are read whole, in time that grows with their length whatever is broken in them.
    An element is furniture by its name (``nav``, ``aside``, ``form`` ...), or by words of its class, id
    or role (``sidebar``, ``related`` ...), unless one of its classes says that it is the content. An
    article inside an element of the second kind is kept if the page has no other; one whose
    class says that it is a reader's comment never is. Of several articles those are left out
    whose highest window is below 0.3 of the page's highest. Repeated rows are extracted each; an empty table gives none;
    other columns are not read, whatever their names. No shuffle.
    """

    def make():
        def work(pages: list[str | None]) -> list:
            texts = [main_text(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return map_texts(df, keys, html, make, "text string, n_chars long")
