"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block of the page; text that markup itself marks as menus, adverts,
forms and the like is left out. Text lengths are summed over sliding windows of lines. A surge is a
window that rises over the threshold, a dive one that falls to nothing; the stretch between them
with the most text is the core. The text is what the core's own container holds, so short first and last
paragraphs are not cut; where the core lies straight in the body, it is all stretches of the page that lie outside other articles. Article and main
elements bound and extend the core: those that hold most of it, and their siblings with text, are the text as a whole.
"""
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines of a window
SURGE = 60  # characters without links that a window must reach
HOLDS = 0.5  # article elements bound the core from so much text, as a share of what the best stretch has outside them
MOST = 0.5  # an element with more than this share of the page's text is kept, whatever its class

# Element names by what they do to the text.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside form button select option dialog menu svg object canvas audio video fieldset label".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Parts of class names and ids, cut at hyphens, underscores and capitals, of text that is not the article.
CHROME = frozenset("""ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidenav menu nav
    navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist
    commentary respond reply replies discussion disqus responses widget widgets toolbar pagination pager skip teaser outbrain taboola""".split())
HEADERS = frozenset("header".split())  # only outside the article: within it they hold its title
HARMLESS = frozenset("has with no without is js on off not show hide".split())  # "has-sidebar" speaks of the page, not of the element

# A quote opens a value only right after its equals sign; elsewhere it is a character like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Line:
    text: str
    plain: int  # characters outside links
    inside: int  # the innermost open container, -1 for none
    heading: bool = False


@dataclass
class _Open:
    name: str
    number: int
    dropped: bool
    main: bool
    container: int  # the innermost block element, itself included
    heading: bool
    chrome: bool  # dropped, and not only for a class
    named: bool  # its class says that it is no article
    before: int  # characters seen before it


@dataclass
class _Page:
    lines: list[Line] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # of elements by number
    above: list[int] = field(default_factory=list)  # the container around each element, -1 for none; always a smaller number
    most: frozenset[int] = frozenset()  # elements left out for their class that hold most of the page's text

    def sizes(self, lines: list[Line]) -> list[int]:
        """Characters outside links that each element holds."""
        out = [0] * len(self.names)
        for line in lines:
            if line.inside >= 0:
                out[line.inside] += line.plain
        for n in range(len(out) - 1, -1, -1):
            if self.above[n] >= 0:
                out[self.above[n]] += out[n]
        return out

    def lines_in(self, chosen: set[int]) -> list[bool]:
        """Which lines lie in one of the chosen elements."""
        within = [False] * len(self.names)
        for n in range(len(within)):
            within[n] = n in chosen or self.above[n] >= 0 and within[self.above[n]]
        return [x.inside >= 0 and within[x.inside] for x in self.lines]

    def articles(self) -> list[int]:
        """The outermost article and main elements."""
        inner, out = [False] * len(self.names), []
        for n, name in enumerate(self.names):
            inner[n] = self.above[n] >= 0 and (inner[self.above[n]] or self.names[self.above[n]] in MAIN)
            if name in MAIN and not inner[n]:
                out.append(n)
        return out


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _is_chrome(name: str, attributes: str, in_main: bool) -> bool:
    """Whether the element itself, its state or its role says that it is no article."""
    if name in DROPPED or name == "header" and not in_main:
        return True
    if not attributes.strip() or name in ("html", "body", "main", "article", "a"):
        return False
    found = _attributes(attributes)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return found.get("role", "").lower() in ROLES


def _named_chrome(name: str, attributes: str, in_main: bool) -> bool:
    """Whether a word of the element's class or id says so."""
    if not attributes.strip() or name in ("html", "body", "main", "article", "a"):
        return False
    found = _attributes(attributes)
    for token in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = [p.lower() for p in PARTS.findall(token)]
        if parts and parts[0] not in HARMLESS and (set(parts) & CHROME or not in_main and set(parts) & HEADERS):
            return True
    return False


def strip_markup(page: str) -> _Page:
    """Lines of the page's blocks, without text that markup marks as no article.

    An element that holds most of the page's text outside links is never left out for a word of its class.
    """
    made = _stripped(page, frozenset())
    return _stripped(page, made.most) if made.most else made


def _stripped(page: str, spared: frozenset[int]) -> _Page:
    out, stack, at = _Page(), [], 0
    text: list[str] = []
    opened: Counter[str] = Counter()
    plain = links = seen = 0  # seen: characters outside links and outside what is dropped for other reasons than its class
    doubtful: list[tuple[int, int]] = []  # element dropped for its class and the characters in it

    def flush() -> None:
        nonlocal plain
        line = " ".join("".join(text).split())
        if line:
            out.lines.append(Line(line, min(plain, len(line)), stack[-1].container if stack else -1, bool(stack) and stack[-1].heading))
        text.clear()
        plain = 0

    def add(raw: str) -> None:
        nonlocal plain, seen
        if stack and stack[-1].chrome:
            return
        if raw and not links:
            seen += len("".join(raw.split()))
        if raw and not (stack and stack[-1].dropped):
            piece = html.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if not links:
                plain += len(piece)

    def close(index: int) -> None:
        nonlocal links
        if any(o.name in BLOCK for o in stack[index:]):
            flush()
        links -= sum(o.name == "a" for o in stack[index:])
        opened.subtract(o.name for o in stack[index:])
        doubtful.extend((o.number, seen - o.before) for o in stack[index:] if o.named)
        del stack[index:]

    def last(names: tuple[str, ...] | frozenset[str], stop: frozenset[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stop:
                return -1
        return -1

    scopes = BLOCK - {"p", "li", "dd", "dt", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
    while True:
        token = TOKEN.search(page, at)
        add(page[at:token.start()] if token else page[at:])
        if not token:
            break
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA["):
                add(token[0][9:].removesuffix("]]>"))
            continue
        if token[1] or token[4]:
            found = last((name,)) if opened[name] > 0 else -1
            if found >= 0:
                close(found)
            elif name == "p":
                flush()
            continue
        attributes = token[3] or token[6] or ""
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            if (at_p := last(("p",), scopes)) >= 0:
                close(at_p)
            for closed, until in ((("li",), frozenset({"ul", "ol", "menu"})), (("dd", "dt"), frozenset({"dl"})),
                                  (("td", "th"), frozenset({"tr", "table"})), (("tr",), frozenset({"table"}))):
                if name in closed and (before := last(closed, until)) >= 0:
                    close(before)
            flush()
        elif name == "a" and links and (before := last(("a",), scopes)) >= 0:
            close(before)
        if attributes.endswith("/") and name not in BLOCK and name != "a":
            continue
        in_main = bool(stack) and stack[-1].main
        chrome = bool(stack) and stack[-1].chrome or _is_chrome(name, attributes, in_main)
        named = not chrome and _named_chrome(name, attributes, in_main)
        main = in_main or name in MAIN or 'role="main"' in attributes
        around = stack[-1].container if stack else -1
        number = len(out.names)
        dropped = bool(stack) and stack[-1].dropped or chrome or named and number not in spared
        stack.append(_Open(name, number, dropped, main, number if name in BLOCK else around,
                           name in ("h1", "h2") or bool(stack) and stack[-1].heading, chrome, named, seen))
        out.names.append(name)
        out.above.append(around)
        opened[name] += 1
        links += name == "a"
    flush()
    close(0)
    out.most = frozenset(n for n, size in doubtful if size >= SURGE and size > MOST * seen)
    return out


def stretches(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[first, last) lines of every stretch between a surge and a dive."""
    size = [line.plain for line in lines]
    sums = [sum(size[i:i + window]) for i in range(len(size))]
    out, start = [], None
    for i in range(len(size) + 1):
        low = i == len(size) or sums[i] == 0
        if start is None and not low and sums[i] >= surge and size[i] > 0:
            start = i
        elif start is not None and low:
            out.append((start, i))
            start = None
    return out


def core(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """[first, last) line of the stretch with the most text between a surge and a dive; empty without a surge."""
    return max(stretches(lines, window, surge), key=lambda s: (sum(x.plain for x in lines[s[0]:s[1]]), -s[0]), default=(0, 0))


def _bounds(made: _Page, found: list[tuple[int, int]], best: tuple[int, int]) -> set[int]:
    """The outermost article elements that hold the core; none if they hold too little of the page's best stretch.

    The core is the stretch with the most text in article elements. Their siblings come with them if they have a stretch of their own.
    """
    lines, articles = made.lines, made.articles()
    if not articles:
        return set()
    whole, inside = made.sizes(lines), made.lines_in(set(articles))
    first, past = max(found, key=lambda s: (sum(x.plain for x, a in zip(lines[s[0]:s[1]], inside[s[0]:s[1]], strict=True) if a), -s[0]))
    held = made.sizes(lines[first:past])
    chosen = {n for n in articles if held[n] > 0}
    kept = made.lines_in(chosen)
    if not chosen or sum(whole[n] for n in chosen) < HOLDS * sum(lines[i].plain for i in range(*best) if not kept[i]):
        return set()
    around = {made.above[n] for n in chosen}
    return chosen | {n for n in articles if made.above[n] in around and whole[n] >= SURGE}


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    made = strip_markup(page or "")
    lines = made.lines
    if sum(x.plain for x in lines) == 0:
        return ""
    best = core(lines)
    found = stretches(lines)
    if not found:
        best = (0, len(lines))
        whole = made.sizes(lines)
        chosen = {n for n in made.articles() if whole[n] > 0}
    else:
        chosen = _bounds(made, found, best)
    if chosen:
        return "\n".join(x.text for x, kept in zip(lines, made.lines_in(chosen), strict=True) if kept)
    first, past = best
    held = made.sizes(lines[first:past])
    total = sum(x.plain for x in lines[first:past])
    inner = [n for n, size in enumerate(held) if size >= total and made.names[n] in BLOCK and made.names[n] not in ("html", "body")]
    if inner:
        return "\n".join(x.text for x, kept in zip(lines, made.lines_in({max(inner)}), strict=True) if kept)
    kept = made.lines_in({n for n in made.articles() if held[n] > 0})  # an article that the stretch reaches into is not cut
    for first, past in found or [best]:
        while first > 0 and lines[first - 1].heading:
            first -= 1
        kept[first:past] = [True] * (past - first)
    return "\n".join(x.text for x, keep in zip(lines, kept, strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``text`` and ``n_chars`` in place of ``html``.

    A null html is empty and has an empty text. Pages are read one by one, whole: ties, repeated rows,
    clashing extra columns (left out) and empty tables change nothing.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    found = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(batches, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
