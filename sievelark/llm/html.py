"""Web pages as text blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

# Names of the HTML standard, and words that sites use in class and id.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head title noscript template iframe svg math canvas object audio video select button textarea datalist".split())
FURNITURE = frozenset("nav aside form footer header menu dialog".split())
MARKED = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar menu menus nav navbar navigation breadcrumb breadcrumbs comment comments replies respond "
    "disqus share sharing social related recommended newsletter subscribe signup login popup modal widget pagination pager "
    "toolbar masthead footer header complementary contentinfo search".split())
REMARKS = frozenset("comment comments replies respond disqus".split())
WHOLE = frozenset("html body main article".split())
NEGATIONS = frozenset("has no not non with without hide show is".split())
LAYOUT = frozenset("area fixed sticky results result layout enabled disabled open closed visible hidden active inactive on off".split())

ADVERTS = frozenset("ad ads advert advertisement advertising adverts sponsor sponsored promo".split())
REMARK_PARTS = frozenset("list section area thread form wrapper box container user reader post block".split())

_TAG_END = re.compile(r"[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+>")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_BROKEN = re.compile(r"[^<>]*+>?")
_SOUND = re.compile(
    r"<(?!(?i:script|style)[\s/>])(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attributes>[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+)>"
    r"|<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?](?!--|\[CDATA\[)[^>]*+>"
    r"|(?i:<(?P<raw>script|style)(?=[\s/>])[^\"'>]*+(?:\"[^\"]*+\"[^\"'>]*+|'[^']*+'[^\"'>]*+)*+>.*?</(?P=raw)\s*>)"
    r"|(?P<odd><(?:[!?]|/?[a-zA-Z]))", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_LONG = re.compile(r"&#(?:0*[1-9][0-9]{7,}+|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}+);?")
_ZEROS = re.compile(r"&#([xX]?)0{8,}+")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[^a-z0-9]+")
_TITLE_END = re.compile(r"</title", re.I)
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articleBody\b", re.I)


def decode_references(text: str) -> str:
    """Character references decoded; numbers of any length, those beyond the last character become U+FFFD."""
    if "&" not in text:
        return text
    return html.unescape(_ZEROS.sub(r"&#\g<1>0", _LONG.sub("\ufffd", text)))


class _Ends:
    """Where tags end, in time that grows with the page however it is broken.

    A tag ends at the first ``>`` outside quotes. While tags do end, each search goes on where the one before stopped. After one
    that ran to the end of the page in vain, places of quotes and ``>`` are looked up, and every place from which the end was
    not found is remembered, so no stretch is walked twice.
    """

    def __init__(self, page: str):
        self.page = page
        self.places: dict[str, list[int]] | None = None
        self.failed: set[int] = set()

    def after(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``, -1 if it does not end."""
        if self.places is None:
            if found := _TAG_END.match(self.page, at):
                return found.end()
            self.places = {c: [m.start() for m in re.finditer(re.escape(c), self.page)] for c in "\"'>"}
        path = []
        while at not in self.failed:
            path.append(at)
            nearest = min(((p[k], c) for c, p in self.places.items() if (k := bisect_left(p, at)) < len(p)), default=None)
            if nearest is None:
                break
            place, kind = nearest
            if kind == ">":
                return place + 1
            own = self.places[kind]
            k = bisect_left(own, place + 1)
            if k == len(own):
                break
            at = own[k] + 1
        self.failed.update(path)
        return -1


Tag = tuple[int, int, str, bool, str]
"""Start; end, behind the content of a script or style; name, empty for comments, declarations, scripts, styles and broken
tags; whether it is an end tag; attributes."""


def tags(page: str) -> Iterator[Tag]:
    """The tags of a page in order. From the first one that does not end as it should on, :func:`_careful_tags` reads the page."""
    for tag in _SOUND.finditer(page):
        start, end = tag.span()
        slash, name, attributes, _, odd = tag.groups()
        if odd:
            yield from _careful_tags(page, start)
            return
        if name is None:
            yield start, end, "", False, ""
        else:
            yield start, end, name.lower(), slash == "/", attributes


def _careful_tags(page: str, at: int) -> Iterator[Tag]:
    """The tags from ``at`` on, however they are broken, every character looked at a bounded number of times."""
    ends, at = _Ends(page), page.find("<", at)
    while at >= 0:
        end, name, closing, attributes = -1, "", False, ""
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
        elif head := _NAME.match(page, at + 1):
            end = ends.after(head.end())
            name, closing = head[2].lower(), bool(head[1])
            if end < 0:
                end, name = _BROKEN.match(page, at + 1).end(), ""
            elif not closing and name in _RAW_END:
                raw = _RAW_END[name].search(page, end)
                end, name = raw.end() if raw else len(page), ""
            else:
                attributes = page[head.end() : end - 1]
        else:
            at = page.find("<", at + 1)
            continue
        yield at, end, name, closing, attributes
        at = page.find("<", end)


class Facts:
    """Title, language of a page and the targets of its links, references decoded."""

    def __init__(self, page: str):
        self.page, self.title, self.language, self.links, self._titles = page, None, None, [], 0

    def take(self, tag: Tag) -> None:
        name = tag[2]
        if name == "a":
            if found := _HREF.search(tag[4]):
                self.links.append(decode_references(found[1] or found[2] or found[3] or ""))
        elif name == "title":
            self._titles += 1
            if self._titles == 1 and (found := _TITLE_END.search(self.page, tag[1])):
                self.title = decode_references(self.page[tag[1] : found.start()]) or None
        elif name == "html" and self.language is None and (found := _LANG.search(tag[4])):
            self.language = found[1]


def facts(page: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language and links alone."""
    found = Facts(page)
    for tag in tags(page):
        if not tag[3]:
            found.take(tag)
    return found.title, found.language, found.links


@dataclass(slots=True)
class Block:
    text: str
    article: bool
    """Inside an article or main element."""
    furniture: bool
    """Inside a menu, header, footer, sidebar, notice, advert, form or reader comment."""


def _marks(attributes: str, inside: bool) -> set[str]:
    """Names in class, id and role that can mark furniture.

    Outside articles these are the values, and the first and last part of those without a negation in front or a layout word
    behind. Inside an article a value counts as a whole, since ``ad-hoc`` or ``share-price`` may be a subject: adverts and remarks always,
    others if all names of the attribute are marks; names of remarks may have the usual parts beside.
    """
    found: set[str] = set()
    for _, *values in _ATTRIBUTE.findall(attributes):
        names = "".join(values).lower().split()
        if inside and not all(n in MARKED for n in names):
            names = [n for n in names if n in ADVERTS or n in REMARKS or _is_remark(n)]
        for value in names:
            found.add(value)
            parts = [p for p in _PART.split(value) if p]
            if not inside and parts and parts[0] not in NEGATIONS and parts[-1] not in LAYOUT:
                found.update((parts[0], parts[-1]))
            elif inside and _is_remark(value):
                found.add("comments")
    return found


def _names(attributes: str) -> set[str]:
    return {n for _, *values in _ATTRIBUTE.findall(attributes) for n in "".join(values).lower().split()}


def _is_remark(name: str) -> bool:
    parts = set(_PART.split(name)) - {""}
    return bool(parts & REMARKS) and parts <= REMARKS | REMARK_PARTS


def blocks(page: str | None, seen: Facts | None = None) -> list[Block]:
    """Visible text blocks of a page in order, references decoded and white space made single.

    Scripts, styles, comments and the head are no text. Tags may be left open: a block element ends an open
    paragraph, and an end tag closes everything opened since its start tag; one without start tag is ignored.
    Inline elements that a whole name marks as an advert are no text either, up to their end tag or that of the block around them.
    A class or id that marks furniture does not count for an article or main element inside, nor where it holds more than half of
    the text and, if there are articles, more blocks than these; marks of reader comments always count, since comments are
    often longer than the page. Time and memory grow with the page, also where it is long, broken or deeply nested. ``seen`` is shown
    the tags.
    """
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, int, bool]] = []  # name and the state around it
    open_names: defaultdict[str, int] = defaultdict(int)
    silent = article = furniture = advert = False
    mark = -1  # the innermost open mark
    within: list[int] = []  # the innermost mark of each block
    above: list[int] = []  # the mark around each mark
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(decode_references("".join(parts)).split())
            parts.clear()
            if text and not silent:
                found.append(Block(text, article, furniture))
                within.append(mark)

    at = 0
    page = page or ""
    for tag in tags(page):
        start, end, name, closing, attributes = tag
        if start > at and not silent and not advert:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if seen is not None and not closing:
            seen.take(tag)
        block = name in BLOCKS
        if block:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            if open_names[name]:
                if not block and name in SILENT:
                    flush()
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                _, silent, article, furniture, mark, advert = stack[depth]
                for level in stack[depth:]:
                    open_names[level[0]] -= 1
                del stack[depth:]
            continue
        if name in VOID:
            continue
        if block and stack and stack[-1][0] == "p":
            _, silent, article, furniture, mark, advert = stack.pop()
            open_names["p"] -= 1
        inline = not block and name not in SILENT
        if inline and not advert and not (attributes and _names(attributes) & ADVERTS):
            continue  # other inline elements change nothing
        if name in SILENT:
            flush()
        if attributes.endswith("/") and not block:
            continue
        stack.append((name, silent, article, furniture, mark, advert))
        open_names[name] += 1
        if inline:
            advert = True
            continue
        silent = silent or name in SILENT
        marks = _marks(attributes, article) if attributes else set()
        if name in ("article", "main") or attributes and _MAIN.search(attributes):
            article = article or not furniture
            furniture = furniture or bool(marks & REMARKS)
            mark = -1
        elif name in FURNITURE:
            furniture = furniture or not (article and name == "header")
        elif marks and name not in WHOLE:
            if marks & REMARKS:
                furniture = True
            elif marks & (MARKED - {"header"} if article else MARKED):
                above.append(mark)
                mark = len(above) - 1
    if at < len(page) and not silent and not advert:
        parts.append(page[at:])
    flush()
    _unmark(found, within, above)
    return found


def _unmark(found: list[Block], within: list[int], above: list[int]) -> None:
    """Make the blocks of marks furniture, but for marks that hold most of the page."""
    total = sum(len(b.text) for b in found if not b.furniture)
    articles = sum(b.article and not b.furniture for b in found)
    held, lines = [0] * len(above), [0] * len(above)
    for n, b in zip(within, found, strict=True):
        if n >= 0 and not b.furniture:
            held[n] += len(b.text)
            lines[n] += 1
    for n in range(len(above) - 1, -1, -1):  # a mark comes after the one around it
        if above[n] >= 0:
            held[above[n]] += held[n]
            lines[above[n]] += lines[n]
    counts = [False] * len(above)
    for n, outer in enumerate(above):
        counts[n] = 2 * held[n] <= total or lines[n] <= articles or outer >= 0 and counts[outer]
    for n, b in zip(within, found, strict=True):
        b.furniture = b.furniture or n >= 0 and counts[n]
