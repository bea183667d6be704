"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line's weight is the length of its text
outside links; a window's sum runs over `WINDOW` lines.  Text surges where the sum of a window reaches `SURGE`
characters, and dives where it falls to nothing; all stretches from a surge to its dive are kept, whole, with
all their lines, however short.

What a page declares can only lower weights.  Blocks declared to be something else (menus, headers, footers, sidebars,
notices, adverts, forms, comments, by element, role, class or id) have no weight, and so have all lines outside the
articles of a page that declares articles; no stretch holds them.  Inside an article windows pass over them, links
count as text, and any text is a surge.  A form, or a block declared by name alone and not
comments, is a mere wrapper if an article stands in it where none stands free, or if it holds several lines and most of
the page's text outside links.  A name declares a block only if all its words are of that kind ("share-price" is none),
and never a paragraph, heading, list item or cell inside an article.

Defined results: null or empty html and pages without text give an empty text; a cut-off page is read as far as
it goes; an incomplete last tag is dropped; repeated rows give repeated results; empty tables give none; further columns
are ignored.  Time and memory are linear in the page's length.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, whole_text

WINDOW, SURGE = 3, 60
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style title textarea iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same kind, or of the kinds named, closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OUTSIDE = frozenset("head nav footer aside button select menu dialog fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ARTICLE = frozenset(("article", "main"))
#: Elements of an article that are text whatever they are called.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr table caption figcaption code em strong b i span".split())
# fixed values: words of class and id that declare a block to be other than main text, and words that may stand beside them
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos "
    "replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar widget widgets recommended related".split()
)
BESIDE_NAMES = frozenset(
    "a and area article bar block body bottom box btn button buttons center col column container content fixed form global group has icon icons inner item items js label left link links list main "
    "message nav outer page panel policy post posts primary right row secondary section site sticky text title top unit wrap wrapper x".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist replies reply respond disqus".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def name_words(found: dict[str, str]) -> set[str]:
    """The words of those names of class and id that have none but words of boilerplate."""
    out: set[str] = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = {w.lower() for w in NAME_WORD.findall(name)}
        if words & OUTSIDE_NAMES and words <= OUTSIDE_NAMES | BESIDE_NAMES:
            out |= words & OUTSIDE_NAMES
    return out


INSIDE, WRAPPER, OUT = 0, 1, 2


def is_outside(tag: str, raw: str, in_article: bool) -> int:
    """Whether the element declares itself to be something other than main text: OUT, or WRAPPER if it may be a mere wrapper."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return OUT
    if not raw or tag in ("html", "body"):
        return WRAPPER if tag == "form" else INSIDE
    found = attributes(raw)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return OUT
    words = name_words(found) if "class" in found or "id" in found else set()
    if tag in ARTICLE:
        return OUT if words & COMMENT_NAMES else INSIDE
    role = found.get("role", "").lower()
    if role in OUTSIDE_ROLES and not (tag == role == "form"):
        return OUT
    if in_article and tag in TEXT:
        return INSIDE
    if words & COMMENT_NAMES:
        return OUT
    return WRAPPER if words or tag == "form" else INSIDE


class Line:
    """A block of the page: its text, the length outside links, whether it is declared to be other than text, the
    innermost of the possible wrappers around it or 0, the number of its article or 0."""

    __slots__ = ("article", "out", "plain", "text", "wrapper")

    def __init__(self, text: str, plain: int, out: bool, article: int, wrapper: int) -> None:
        self.text, self.plain, self.out, self.article, self.wrapper = text, plain, out, article, wrapper


class Lines:
    """The blocks of a page in order."""

    def __init__(self) -> None:
        self.rows: list[Line] = []
        self.parts: list[str] = []
        self.plain = 0
        self.stack: list[tuple[str, bool, int, int, int]] = []  # element, outside, article, wrapper, blocks up to here
        self.places: dict[str, list[int]] = {}  # of each open element in the stack
        self.links = self.articles = 0
        self.around = [0]  # of each wrapper the one around it

    def state(self) -> tuple[bool, int, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, 0, 0)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.rows.append(Line(text, min(self.plain, len(text)), *self.state()[:3]))
            self.parts, self.plain = [], 0

    def text(self, raw: str) -> None:
        raw = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(raw)
        if not self.links:
            self.plain += len(raw)

    def open(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES and self.stack and self.stack[-1][0] in CLOSES[tag]:
            self.close(self.stack[-1][0])
        before, article, wrapper, blocks = self.state()
        declared = OUT if before else is_outside(tag, raw, bool(article))
        outside = declared == OUT
        if tag in ARTICLE and not outside and not article:
            self.articles += 1
            article = self.articles
        if tag == "a":
            self.links += 1
        if declared and not before:
            self.flush()
        if declared == WRAPPER:
            self.around.append(wrapper)
            wrapper = len(self.around) - 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, outside, article, wrapper, blocks + (tag in BLOCK)))

    def close(self, tag: str) -> None:
        places = self.places.get(tag)
        if not places:
            if tag in BLOCK:
                self.flush()
            return
        at = places[-1]
        below = self.stack[at - 1] if at else ("", False, 0, 0, 0)
        if tag not in BLOCK and self.stack[-1][4] > self.stack[at][4]:
            return  # an inline end tag does not end the block it stands in
        if self.stack[-1][4] > below[4] or self.stack[-1][1] != below[1] or self.stack[-1][3] != below[3]:
            self.flush()
        for name, *_ in self.stack[at:]:
            self.places[name].pop()
            self.links -= name == "a"
        del self.stack[at:]


def page_lines(page: str) -> Lines:
    lines, at, size = Lines(), 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lines.text(page[at:])
            break
        if lt > at:
            lines.text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(close, lt + 2)
            at = size if end < 0 else end + len(close)
            continue
        if not (after.isalpha() and after.isascii()) and after != "/":
            lines.text("<")
            at = lt + 1
            continue
        m = TAG.match(page, lt) or LOOSE_TAG.match(page, lt)
        if m is None:
            end = -1 if page[lt + 2 : lt + 3].isalpha() else page.find(">", lt)
            if after == "/" and end > 0:
                at = end + 1
                continue
            break  # the page ends inside a tag
        at, tag = m.end(), m[2].lower()
        if m[1]:
            lines.close(tag)
        elif tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = size if close < 0 else close + 1
        else:
            lines.open(tag, m[3])
    lines.flush()
    return lines


def lower_wrappers(lines: Lines) -> None:
    """Marks the lines in wrappers that are more than that as being outside."""
    rows, around = [r for r in lines.rows if not r.out], lines.around
    if len(around) == 1:
        return
    inside, size, held = [0] * len(around), [0] * len(around), [0] * len(around)
    for r in rows:
        inside[r.wrapper] |= bool(r.article)
        size[r.wrapper] += r.plain
        held[r.wrapper] += 1
    begun: dict[int, int] = {}  # of every article the outermost wrapper of its lines: it stands in that and those around it
    for r in rows:
        if r.article:
            begun[r.article] = min(begun.get(r.article, r.wrapper), r.wrapper)
    for w in range(len(around) - 1, 0, -1):  # a wrapper's number is above that of the one around it
        size[around[w]] += size[w]
        held[around[w]] += held[w]
    mere = [False] * len(around)
    mere[0] = True
    if begun:
        if 0 not in begun.values():
            for w in set(begun.values()):
                while w and not mere[w]:
                    mere[w] = True
                    w = around[w]
    else:
        for w in range(1, len(around)):
            mere[w] = 2 * size[w] > size[0] and held[w] > 1
    free = [True] * len(around)
    for w in range(1, len(around)):
        free[w] = mere[w] and free[around[w]]
    for r in rows:
        r.out = not free[r.wrapper]


def weights_of(rows: list[Line]) -> list[int]:
    """The lines' weights: -1 for what is declared to be outside, in an article the length of the whole line, else that outside links."""
    if any(r.article and not r.out for r in rows):
        return [-1 if r.out or not r.article else len(r.text) for r in rows]
    return [-1 if r.out else r.plain for r in rows]


def stretches(weights: list[int], inside: list[bool], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """From each surge point to its dive point, as [first, last) lines: the sum of a sliding window of lines reaches
    `surge`, and stays above nothing until the dive.  Lines of weight -1 weigh nothing and part stretches; windows
    pass over those that are `inside` of an article."""
    seen = [i for i, w in enumerate(weights) if w >= 0 or not inside[i]]
    n, running = len(seen), [0]
    for i in seen:
        running.append(running[-1] + max(0, weights[i]))
    found: list[tuple[int, int]] = []
    start, high = 0, 0
    for k in range(n + 1):
        total = running[min(n, k + window)] - running[k] if k < n else 0
        if total:
            high = max(high, total)
            continue
        if high >= surge:
            part = [i for i in seen[start:k] if weights[i] >= 0]
            while part and not weights[part[0]]:
                part.pop(0)
            last = len(part)
            while last and not weights[part[last - 1]]:
                last -= 1
            for i in part[:last]:
                if found and found[-1][1] == i:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((i, i + 1))
        start, high = k + 1, 0
    return found


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = page_lines(page)
    lower_wrappers(lines)
    rows = lines.rows
    weights, inside = weights_of(rows), [bool(r.article) for r in rows]
    declared = any(w > 0 and i for w, i in zip(weights, inside, strict=True))
    found = stretches(weights, inside, window, 1 if declared else surge) or stretches(weights, inside, window, 1)
    return "\n\n".join(r.text for a, b in found for r in rows[a:b])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            text = [main_text(h, window, surge) for h in batch.html]
            yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": text, "n_chars": [len(t) for t in text]})

    rows = narrowed(pages, [id_col, url_col, html_col]).select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), whole_text(html_col).alias("html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
