"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block-level element: those without
text, and those left out, are empty lines, and tags between two texts make one
at most.  Text inside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments is left out, and
where a page marks its article (``article``, ``main``, outside of those) so are
the lines outside the marks.  A line weighs the code points of its text, on
pages without marks those outside links.  Weights are summed over a sliding
window of lines.  Where the sum falls to nothing is a dive; between two dives
the lines are one region.  A region is text if the sum surges in it: gets over
half of the page's largest sum, or ``SURGE`` if that is less.  The lines of
such a region from its first weighing line to its last are the text, short ones
and links among them too.

So on a page that marks its article the marks decide, and the article is one
region around the largest sum; on other pages the distribution decides, and a
menu or a row of links, whose lines weigh nothing, parts the regions.

A null, empty or text-free page gives an empty text.  White space in a block
becomes one space, blocks are joined by an empty line.  Repeated rows each get
their row; an empty table gives an empty one; further columns of the input are
not read.  A page is handled whole in one task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_null, rows_of

WINDOW = 3
SURGE = 80

#: Elements whose content is never text.
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|title|select|canvas|audio|video"
BOILERPLATE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
#: Words that mark what is not the article, in a name of a class, an id or a
#: role all of whose words are of these or of GENERIC_WORDS.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar aside complementary menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager "
    "header masthead footer contentinfo comment comments reply replies discussion disqus respond "
    "share sharing social related recommended widget login signup search hidden".split()
)
GENERIC_WORDS = frozenset(
    "site main page top bottom left right middle inner outer container wrapper wrap box block area section region "
    "list item items link links icon icons button buttons bar panel unit slot post posts article articles entry entries "
    "story stories user users reader readers primary secondary global mobile desktop sticky fixed js mod col row the and".split()
)
#: Of the above, what makes an element no article although its tag says so.
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
ARTICLE_TAGS = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Inline elements: they do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th br center input link meta".split()
)
#: A start tag of the second ends an open element of the first.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}

_MARKUP = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_MAYBE = re.compile(r"class|id|role|hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _is_boilerplate(tag: str, rest: str) -> bool:
    if tag in BOILERPLATE_TAGS:
        return True
    if not rest or tag in ("html", "body") or not _MAYBE.search(rest):
        return False
    own: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        own.setdefault(name.lower(), html.unescape("".join(values)))
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or _INVISIBLE.search(own.get("style", "")):
        return True
    for name in " ".join(own.get(a, "") for a in ("class", "id", "role")).split():
        words = [w.lower() for w in _WORD.findall(name)]
        if tag in ARTICLE_TAGS:
            if words and all(w in COMMENT_WORDS or w in GENERIC_WORDS for w in words) and not COMMENT_WORDS.isdisjoint(words):
                return True
        elif words and all(w in BOILERPLATE_WORDS or w in GENERIC_WORDS for w in words) and not BOILERPLATE_WORDS.isdisjoint(words):
            return True
    return False


def lines_of(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, code points outside links, inside a marked article) for each
    line, without boilerplate; and whether the page marks an article."""
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []  # open elements: name, is boilerplate
    bad = article = link = 0
    marked = bare = False  # bare: nothing since the start tag of the innermost element
    parts: list[str] = []
    linked: list[str] = []

    def end_line() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            plain = len(text) - len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()) if linked else len(text)
            lines.append((text, max(0, plain), article > 0))
        elif lines and lines[-1][0]:
            lines.append(("", 0, article > 0))
        parts.clear()
        linked.clear()

    def close(to: int) -> None:
        nonlocal bad, article, link
        while len(stack) > to:
            name, was_bad = stack.pop()
            bad -= was_bad
            article -= name in ARTICLE_TAGS
            link -= name == "a"

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at and not bad:
            bare = bare and page[at : m.start()].isspace()
            parts.append(page[at : m.start()])
            if link:
                linked.append(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in ("br", "td", "th"):
            parts.append(" ")
        if tag not in INLINE:
            end_line()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE and (bare or bad and bad == sum(b for _, b in stack[i:])):
                        lines.append(("", 0, article > 0))
                    close(i)
                    break
                if stack[i][0] in ARTICLE_TAGS or stack[i][0] in BOILERPLATE_TAGS:
                    if tag not in ARTICLE_TAGS and tag not in BOILERPLATE_TAGS and tag not in ("div", "section", "body", "html"):
                        break  # a stray end tag does not close the regions around it
            bare = False
        elif tag not in VOID and not m["rest"].endswith("/"):
            bare = True
            if stack and stack[-1][0] in IMPLIED_END.get(tag, ()):
                close(len(stack) - 1)
            if stack and stack[-1][0] == "p" and tag not in INLINE:
                close(len(stack) - 1)
            is_bad = _is_boilerplate(tag, m["rest"])
            stack.append((tag, is_bad))
            bad += is_bad
            article += tag in ARTICLE_TAGS
            link += tag == "a"
            marked |= tag in ARTICLE_TAGS and not bad
    if at < len(page) and not bad:
        parts.append(page[at:])
    end_line()
    return lines, marked


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    if not page:
        return ""
    lines, marked = lines_of(page)
    if marked:
        lines = [line for line in lines if line[2] and line[0]]
    weights = [len(text) if marked else plain for text, plain, _ in lines]
    sums = [0, *accumulate(weights)]
    blocks = [sums[min(i + window, len(lines))] - sums[i] for i in range(len(lines))]
    least = min(surge, max(blocks, default=0) / 2)
    kept: list[str] = []
    begin = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not blocks[i]:  # a dive, or the end
            if any(b > least for b in blocks[begin:i]):
                own = [k for k in range(begin, i) if weights[k]]
                kept += [text for text, _, _ in lines[own[0] : own[-1] + 1] if text]
            begin = i + 1
    return "\n\n".join(kept)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in rows_of(frames, "page_id", "url", "html"):
        texts = [main_text(None if is_null(h) else h) for _, _, h in rows]
        out = [(i, None if is_null(u) else u, t, len(t)) for (i, u, _), t in zip(rows, texts, strict=True)]
        yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: the main text and its length."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    return pages.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
