"""URL filter rules, carried to aliases by redirects and canonical links.

A rule is an action, a host and a start of a path.  It fits the host and its
subdomains where the path starts so; of the rules that fit, the longest (host
and path) decides, at equal length an allowing one, then the first by text.

Pages name other addresses of theirs: a ``link rel=canonical`` or a ``meta
http-equiv=refresh``.  These are the edges of a graph of addresses (without
fragments; scheme and host lower-cased), whose connected components are the
aliases of one resource.  An address that a rule blocks blocks its component;
an address that a rule allows stays allowed whatever its aliases are.  So the
verdict of a page is its own rule's, else block if any alias is blocked, else
allow.

A null url has an empty host and path, no rule and no aliases.  Rows are
judged one by one, repeated ones alike.  Other columns are ignored.  Rules are
configuration on the driver: their number bounds the size of one expression.
No group is collected: components come from rounds of joins and minima by key
(:mod:`.components`), every round written to the shared folder.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, LOWER, UPPER, is_null, lower_ascii, rows_of, saved
from .components import connected


class Rule(NamedTuple):
    action: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


_TO_LOWER = str.maketrans(UPPER, LOWER)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|xmp|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(link|meta|base)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.I | re.S,
)
_START = re.compile(r".*?://[^/?#]*", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_REFRESH = re.compile(r"\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?(['\"]?)(.*?)\1\s*\Z", re.I | re.S)


def url_host(url: str | Column = "url") -> Column:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: str | Column = "url") -> Column:
    """Path: after the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The rule that decides as struct(rule, action); null if none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.action != "allow", r.text))
    fits = [(F.concat(F.lit("."), host).endswith("." + r.host)) & path.startswith(r.path) for r in ranked]
    found = [F.when(fit, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))) for fit, r in zip(fits, ranked, strict=True)]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule: string, action: string>")


def address(url: str) -> str:
    """A url as a node: without fragment, A-Z of scheme and host lower-cased."""
    url = url.partition("#")[0]
    start = _START.match(url)
    return start[0].translate(_TO_LOWER) + url[start.end() :] if start else url


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html_entities.unescape(next((v for v in values if v), "")))
    return found


def links_of(url: str, page: str) -> list[str]:
    """Addresses that a page states for itself: canonical links and refreshes,
    resolved against its url (or its ``base``).  Comments and scripts are
    skipped; targets that are no http(s) address are no links."""
    base, targets = url, []
    for match in _TAG.finditer(page):
        kind = (match[2] or "").lower()
        if not kind:
            continue
        own = _attributes(match[3])
        if kind == "base" and own.get("href") and base == url:
            base = _joined(url, own["href"]) or url
        elif kind == "link" and "canonical" in own.get("rel", "").lower().split():
            targets.append(own.get("href", ""))
        elif kind == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            found = _REFRESH.match(own.get("content", ""))
            targets.append(found[2] if found else "")
    joined = (_joined(base, t) for t in (t.strip(ASCII_SPACE) for t in targets) if t)
    return [t for t in joined if t]


def _joined(base: str, target: str) -> str | None:
    try:
        whole = urljoin(base, target)
        parts = urlsplit(whole)
    except ValueError:  # no address, such as one with an unclosed [
        return None
    return address(whole) if parts.scheme.lower() in ("http", "https") and parts.netloc else None


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between addresses that ``pages(url, html)`` state."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in rows_of(frames, "url", "html"):
            out = [(address(u), t) for u, h in rows if not is_null(u) and not is_null(h) for t in links_of(u, h)]
            yield pd.DataFrame(out, columns=["a", "b"])

    able = F.lower("html").rlike("canonical|refresh")  # no other page can state a link
    return pages.where(able).select("url", "html").mapInPandas(find, "a string, b string")


def blocked_aliases(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``node``: addresses without a rule of their own whose component a
    blocking rule hits."""
    roots = connected(links)
    own = best_rule(rules, url_host("node"), url_path("node"))["action"]
    judged = roots.select("node", "root", own.alias("action"))
    bad = judged.where("action = 'block'").select("root").distinct()
    return judged.where("action IS NULL").join(bad, "root", "left_semi").select("node")


def url_node(url: str | Column = "url") -> Column:
    """:func:`address` as an expression."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    start = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(lower_ascii(start), F.substr(bare, F.length(start) + 1))


def verdicts(pages: DataFrame, rules: Sequence[Rule], links: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, host, path, the rule
    that decides (its host and path, null if none fits) and the verdict.
    ``links(a, b)`` are further redirects known from elsewhere."""
    edges = page_links(pages)
    if links is not None:
        edges = edges.unionByName(links.select(url_node("a").alias("a"), url_node("b").alias("b")).dropna())
    aliases = saved(blocked_aliases(saved(edges, "alias-links"), rules), "blocked-aliases")
    judged = pages.select(
        "page_id", url_host("url").alias("host"), url_path("url").alias("path"), url_node("url").alias("node")
    ).withColumn("own", best_rule(rules, F.col("host"), F.col("path")))
    judged = judged.join(aliases.withColumn("hit", F.lit(True)), "node", "left")
    verdict = F.coalesce("own.action", F.when(F.col("hit"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
