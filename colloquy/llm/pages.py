"""Main text of web pages by consensus paths of their host.

Each page scores its containers: a block's text, less its links, counts for the container above it, and
for those further up by one over the distance. The page votes for the generalised tag-class path (numbers
become #) with the highest score, widened to the article around it and to what surrounds it with text of
its own. Spark counts the votes by host; the second pass takes, on every page, the elements at its host's
winning path, or at the page's own best path where the winner has less than a quarter of that one's text.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by element, role, class or id, wherever they stand; a class or id that only says what an element has or
lacks (with-sidebar) does not count, nor does a name, reader comments aside, on most of a page's text. White space is that of HTML (blank, tab, line
and page ends) and runs of it become one blank, as do block ends.

Nulls: a null html is empty, and a page without text gives "" and 0; a null url is a host of its own.
Repeated rows give equal results; ties in votes go to the higher score, then the greater path. Empty
table: no rows. Other columns are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: A quote counts only where a value begins; within an unquoted value, or a name, it is a sign like others.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|["'])?|[^>=])*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_SPACE = re.compile(r"[ \t-\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
LEFT_OUT = frozenset("head title script style noscript template nav header footer aside form menu dialog button select option textarea iframe svg canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar form search".split())
#: Names that count however much of the page they hold, and first words of a class that speaks of something else.
ALWAYS = frozenset("comment comments disqus".split())
APART = frozenset("with without has have no not is".split())
#: Of its own best path's text a page must have this share at the host's path.
SHARE = 0.25
#: An element that starts closes an open one of these kinds.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: They keep an open paragraph or item outside from being closed from within.
FENCES = frozenset("table td th div article section main aside nav body html ul ol dl button".split())


def _name(tag: str, attributes: dict[str, str]) -> str:
    """tag.class.class with numbers as #, classes in order of name."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").lower().split()})
    return ".".join([tag, *classes])


def _left_out(tag: str, attributes: dict[str, str]) -> bool:
    """By element, role or the name of reader comments."""
    return tag in LEFT_OUT or attributes.get("role", "").lower() in ROLES or not ALWAYS.isdisjoint(_words(tag, attributes))


def _words(tag: str, attributes: dict[str, str]) -> list[str]:
    """The words of class and id, but of those that tell of another element."""
    if tag in ("html", "body") or not attributes:
        return []
    names = [re.split(r"[_-]+", n) for n in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()]
    return [w for name in names if len(name) == 1 or name[0] not in APART for w in name]


class Node:
    __slots__ = ("tag", "path", "out", "link", "up", "named")

    def __init__(self, tag: str, path: str, out: bool, link: bool, up: Node | None, named: bool = False):
        self.tag, self.path, self.out, self.link, self.up = tag, path, out, link, up
        #: The nearest element, this one or around it, that is left out by its name.
        self.named: Node | None = self if named else up.named if up else None


def read(html: str) -> list[tuple[Node, str]]:
    """The page as runs of text with the element around each; an empty text marks a block's end."""
    at, runs = Node("", "", False, False, None), []
    i, n = 0, len(html)
    while i < n:
        m = _TAG.search(html, i)
        start = m.start() if m else n
        if start > i and not at.out:
            runs.append((at, unescape(html[i:start])))
        if not m:
            break
        i = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE and (not runs or runs[-1][1]):
            runs.append((at, ""))
        if m[1]:
            x = at
            while x.up and x.tag != tag:
                x = x.up
            if x.up:
                at = x.up
            continue
        if tag in CLOSES:
            x = at
            while x.up and x.tag not in CLOSES[tag] and x.tag not in FENCES:
                x = x.up
            if x.up and x.tag in CLOSES[tag]:
                at = x.up
        if tag in VOID:
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, i)
            i = end.end() if end else n
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("path", "circle", "rect"):
            path = f"{at.path}>{_name(tag, attributes)}" if tag in CONTAINERS else at.path
            at = Node(tag, path, at.out or _left_out(tag, attributes), at.link or tag == "a", at, not NAMES.isdisjoint(_words(tag, attributes)))
    return _unnamed(runs)


def _unnamed(runs: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The runs less those under an element that its name leaves out and that has no more than half of the text."""
    if not any(at.named for at, _ in runs):
        return runs
    held: dict[Node, int] = defaultdict(int)
    total = 0
    for at, text in runs:
        n = 0 if at.link else len(text.strip())
        total += n
        x = at.named
        while x:
            held[x] += n
            x = x.up.named

    def stays(x: Node | None) -> bool:
        while x:
            if 2 * held[x] <= total:
                return False
            x = x.up.named
        return True

    return [(at, text) for at, text in runs if not text or stays(at.named)]


def scores(runs: list[tuple[Node, str]]) -> dict[str, float]:
    """Score of each container path of a page."""
    own: dict[int, list] = {}
    for at, text in runs:
        x = at
        while x.up and x.tag not in CONTAINERS:
            x = x.up
        if text and x.path:
            got = own.setdefault(id(x), [x, 0])
            got[1] += 0 if at.link else len(text.strip())
    total: dict[str, float] = defaultdict(float)
    for x, weight in own.values():
        distance = 1
        while x and x.up:
            if x.tag in CONTAINERS:
                total[x.path] += weight / distance
                distance += 1
            x = x.up
    return total


def best_path(total: dict[str, float]) -> tuple[str, float]:
    """The path of the highest score; the greater path breaks a tie."""
    score, path = max(((s, p) for p, s in total.items()), default=(0.0, ""))
    return path, score


def widened(runs: list[tuple[Node, str]], path: str) -> str:
    """The path of the article around it, or of the highest container but the body around it with text of its own."""
    parts = path.split(">")
    above = [">".join(parts[:k]) for k in range(2, len(parts))]
    tags = [p.split(".")[0] for p in parts[1:-1]]
    own = set()
    for at, text in runs:
        if text.strip() and not at.link:
            own.add(at.path)
    wide = [p for p, tag in zip(above, tags) if tag == "article" or tag != "body" and p in own]
    return wide[0] if wide else path


def own_path(runs: list[tuple[Node, str]]) -> tuple[str, float]:
    """The page's own best path, widened, and the score it had."""
    path, score = best_path(scores(runs))
    return widened(runs, path), score


def weight_at(runs: list[tuple[Node, str]], path: str) -> int:
    """Characters at the path outside links."""
    return sum(len(t.strip()) for at, t in runs if not at.link and under(at.path, path))


def under(path: str, prefix: str) -> bool:
    return path == prefix or path.startswith(prefix + ">")


def text_at(runs: list[tuple[Node, str]], path: str) -> str:
    """Text of all elements at the path, blocks joined by one blank."""
    return _SPACE.sub(" ", "".join([t if t else " " for at, t in runs if not t or under(at.path, path)])).strip(" ")


def extract(html: str | None, winner: str | None) -> str:
    runs = read(html or "")
    text = text_at(runs, winner) if winner else ""
    path = own_path(runs)[0]
    if not text or path and path != winner and weight_at(runs, winner) < SHARE * weight_at(runs, path):
        text = text_at(runs, path) if path else _SPACE.sub(" ", "".join(t or " " for _, t in runs)).strip(" ")
    return text


@F.pandas_udf(T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())]))
def vote(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([own_path(read(h or "")) for h in html], columns=["path", "score"])


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series, winner: pd.Series) -> pd.Series:
    return pd.Series([extract(h, w) for h, w in zip(html, winner)], dtype=object)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """_host, _path: one row a host. Votes are summed before they are shuffled."""
    votes = pages.select(host(F.col("url")).alias("_host"), vote("html").alias("v")).filter("v.path <> ''")
    counted = votes.groupBy("_host", F.col("v.path").alias("path")).agg(F.count("*").alias("n"), F.sum("v.score").alias("score"))
    return counted.groupBy("_host").agg(F.max(F.struct("n", "score", "path")).alias("best")).select("_host", F.col("best.path").alias("_path"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's)."""
    winners = stored(winning_paths(pages), "paths")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("_h")).join(winners, F.col("_h") == F.col("_host"), "left")
    out = rows.select("page_id", "url", main_text("html", "_path").alias("text"), F.col("_path").alias("path"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
