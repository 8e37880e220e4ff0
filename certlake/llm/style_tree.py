"""Main text of web pages by a site style tree.

1. Each page is read into a tree of elements.  Elements whose role is plain from tag, role or a class that names
   nothing else (menus, page headers and footers, sidebars, notices, adverts, forms, comments, scripts and styles)
   are no content at any importance; ``roles`` off leaves all but scripts and styles to the tree.
2. The trees of all pages of a host are merged: elements with the same path of tags and classes are one node of
   the site style tree.  A node's importance is a mean of two entropies over its pages: that of its styles (the
   sequences of its children), and that of the texts below it.  A branch that looks and reads alike on all
   pages has importance 0, one that differs everywhere 1.
3. Branches of low importance are removed from each page, and so are branches of mere links outside articles.
   What is left is the answer.

Step 1 goes beyond entropies, because the menus and adverts of one site may differ from page to page.  Article
and main elements are a prior on importance: branches inside them get ``prior`` of what they lack, those beside
them keep ``beside`` of what they have, and where the tree does not know a branch it counts as half important,
so what is inside stays and what is beside goes.  Pages of one host with the same article text count once for
each style and text, so that copies of one article on a site are not taken for a frame.
The merged counts are sums by host, node and text, so a host with most of all pages is spread like others.

A null or empty html gives the empty text.  A null url is the host of the empty name.  Pages of a host with fewer
than ``min_pages`` pages rely on step 1 and the prior alone.  Repeated rows without an article count as pages.
Very long pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import materialize, spare

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Names of HTML, by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_BLOCKS = frozenset("p".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_CONTENT = frozenset("head nav aside footer form button select menu dialog audio video map fieldset label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav"
    " footer masthead comment comments disqus replies respond reply cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup login teaser share sharing social related recommended toolbar pagination pager copyright disclaimer".split()
)
# Words that say where a role stands or how it is built, and no more.
PLACES = frozenset(
    "site main page post global primary secondary left right top bottom sub slot box wrapper wrap container inner outer block unit area section bar form link links"
    " list item items widget group row col head body content buttons icons policy".split()
)
NOISE_OUTSIDE = frozenset("header topbar search".split())  # only where no article is around
SILENT = frozenset("img script style noscript template svg canvas iframe object input source track embed link meta param area textarea".split())  # no text, no break
MAIN = frozenset(("article", "main"))


@dataclass(frozen=True)
class TreeConfig:
    """Branches below ``threshold`` on ``min_pages`` pages or more are removed; ``style`` is the weight of the
    styles' entropy, ``prior`` and ``beside`` are those of articles.  Up to ``broadcast_nodes`` branches are
    broadcast, more are joined by host.  ``roles`` lets tags, roles and classes decide before the tree."""

    threshold: float = 0.25
    style: float = 0.2
    prior: float = 0.1
    beside: float = 0.4
    min_pages: int = 5
    links: float = 0.8
    broadcast_nodes: int = 500_000
    roles: bool = True


class Element:
    __slots__ = ("tag", "key", "parent", "children", "noise", "main", "linked", "chars")

    def __init__(self, tag: str, key: int, parent: Element | None, noise: bool, main: bool):
        self.tag, self.key, self.parent, self.noise, self.main = tag, key, parent, noise, main
        self.children: list[str] = []
        self.linked = self.chars = 0


_KEYS: dict[tuple[int, str], int] = {}


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _key(parent: int, label: str) -> int:
    key = _KEYS.get((parent, label))
    if key is None:
        if len(_KEYS) > 200_000:
            _KEYS.clear()
        key = _KEYS[parent, label] = _hash(f"{parent} {label}")
    return key


def _names_noise(name: str, main: bool) -> bool:
    """Whether a class or id names a role of noise, with words of place beside it at most."""
    words = {w.lower() for w in PARTS.findall(name)}
    roles = words & (NOISE if main else NOISE | NOISE_OUTSIDE)
    return bool(roles) and words <= roles | PLACES


def _open(tag: str, rest: str, parent: Element | None, roles: bool = True) -> Element:
    main, label = bool(parent and parent.main) or tag in MAIN, tag
    noise = bool(parent and parent.noise) or tag == "head" or (roles and (tag in NO_CONTENT or (tag == "header" and not main)))
    if rest and not rest.isspace():
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        if names:
            label = f"{tag}.{' '.join(sorted({w.lower() for n in names for w in PARTS.findall(n)}))}"
            if roles and tag not in ("html", "body", "main"):
                noise |= any(_names_noise(n, main) for n in names)
        role = found.get("role", "").lower()
        main |= role in ("main", "article")
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        noise |= roles and (role in ROLES or hidden)
    element = Element(tag, _key(parent.key if parent else 0, label), parent, noise, main)
    if parent and not (parent.children and parent.children[-1] == label):
        parent.children.append(label)
    return element


def read_page(page: str | None, roles: bool = True) -> list[tuple[Element, str]]:
    """The text blocks of a page in order, each with the element that it stands in; noise is left out."""
    blocks: list[tuple[Element, str]] = []
    here = _open("html", "", None)
    text, length, in_link = [], 0, 0
    at, page = 0, page or ""

    def end_block() -> None:
        nonlocal length
        if text:
            words = " ".join("".join(text).split())
            if words:
                block = here
                while block.parent and block.tag in INLINE:
                    block = block.parent
                blocks.append((block, words))
                e = block
                while e:
                    e.chars += len(words)
                    e.linked += min(length, len(words))
                    e = e.parent
            text.clear()
        length = 0

    def add(raw: str) -> None:
        nonlocal length
        if raw and not here.noise:
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if in_link:
                length += len(raw.strip())

    for m in iter(lambda: TOKEN.search(page, at), None):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE or tag in SILENT
        if not inline:
            end_block()
        if m[1]:
            e = here
            while e.parent and e.tag != tag:
                e = e.parent
            if e.parent:
                while here is not e.parent:
                    in_link -= here.tag == "a"
                    here = here.parent
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else len(page)
        elif tag == "br" or tag in VOID:
            continue
        elif tag in ("html", "body"):
            if tag == "body" and here.tag == "head":
                here = here.parent
            if tag == "body":
                here = _open(tag, m[3], here, roles)
        else:
            closes = SAME_CLOSES.get(tag, ())
            if not inline:
                e = here
                while e.parent and (e.tag in INLINE or e.tag in CLOSED_BY_BLOCKS or e.tag in closes):
                    if e.tag in CLOSED_BY_BLOCKS or e.tag in closes:
                        while here is not e.parent:
                            in_link -= here.tag == "a"
                            here = here.parent
                    e = e.parent
            if not m[3].endswith("/"):
                here = _open(tag, m[3], here, roles)
                in_link += tag == "a"
    add(page[at:])
    end_block()
    return [(e, words) for e, words in blocks if not e.noise]


def _up(element: Element) -> Iterable[Element]:
    while element:
        yield element
        element = element.parent


def tree_rows(page: str | None, roles: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(node, kind, feature, article, place) of a page for the site style tree, each once: kind 0 has the node's
    style, kind 1 its texts.  ``article`` is the hash of the article's text, 0 without one; ``place`` is 1 inside
    an article, 2 beside one and 0 elsewhere."""
    blocks = read_page(page, roles)
    inside = [words for e, words in blocks if e.main]
    article = _hash("\n".join(inside)) or 1 if inside else 0
    around = {id(x) for e, _ in blocks if e.main for x in _up(e)}
    rows: dict[tuple[int, int, int, int, int], None] = {}
    styles: dict[tuple[int, int], set[str]] = {}
    for e, words in blocks:
        feature = _hash(words)
        for x in _up(e):
            if x.parent and x.tag != "body":
                place = 1 if x.main else 2 if article and id(x) not in around else 0
                rows[x.key, 1, feature, article, place] = None
                styles.setdefault((x.key, place), set()).add(" ".join(x.children))
    return [*rows, *((k, 0, _hash("|".join(sorted(s))), article, place) for (k, place), s in styles.items())]


def main_text(page: str | None, removed: Iterable[int] = (), links: float = TreeConfig.links, kept: Iterable[int] = (), roles: bool = True) -> str:
    """The page's text without noise, ``removed`` nodes and branches of mere links; beside an article, only
    ``kept`` nodes have text."""
    blocks, removed, kept = read_page(page, roles), frozenset(removed if removed is not None else ()), frozenset(kept if kept is not None else ())
    article = any(e.main for e, _ in blocks)

    def stays(e: Element) -> bool:
        if any(x.key in removed for x in _up(e)):
            return False
        if e.main:
            return True
        return not (article and e.key not in kept) and not any(x.parent and x.tag not in ("body", "p") and x.linked >= links * x.chars and x.chars for x in _up(e))

    return " ".join(words for e, words in blocks if stays(e))


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def branches(pages: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """(host, removed, kept): each host's nodes of low importance, and those beside articles of high importance.

    A node must stand on ``min_pages`` pages and read alike there, or stand beside articles, so a host has few.
    """

    @F.pandas_udf("array<struct<node long, kind int, feature long, article long, place int>>")
    def rows(pages: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("node", "kind", "feature", "article", "place"), r, strict=True)) for r in tree_rows(p, config.roles)] for p in pages], dtype=object)

    each = pages.select(host_of().alias("host"), F.explode(rows("html")).alias("r")).select("host", "r.*")
    key = ("host", "node", "kind", "feature")
    once = each.groupBy(*key, "article").agg(F.count("*").alias("c"), F.max(F.col("place") == 1).alias("inside"), F.max(F.col("place") == 2).alias("beside"))
    once = once.withColumn("c", F.when(F.col("article") == 0, F.col("c")).otherwise(1).cast("double"))
    counted = once.groupBy(*key).agg(F.sum("c").alias("c"), F.max("inside").alias("inside"), F.max("beside").alias("beside"))
    style, text = F.col("kind") == 0, F.col("kind") == 1
    nodes = counted.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("c"))).alias("m"), F.sum(F.when(style, F.col("c") * F.log("c"))).alias("styles"), F.avg(F.when(text, F.log("c"))).alias("texts"),
        F.max("inside").alias("inside"), F.max("beside").alias("beside"),
    ).where(F.col("m") >= config.min_pages)
    importance = F.lit(config.style) * (1 - F.col("styles") / (F.col("m") * F.log("m"))) + F.lit(1 - config.style) * (1 - F.col("texts") / F.log("m"))
    known = nodes.withColumn("low", F.when(F.col("inside"), importance + config.prior * (1 - importance)).otherwise(importance) < config.threshold)
    known = known.withColumn("high", F.col("beside") & ~F.col("inside") & (importance * config.beside >= config.threshold))
    lists = (F.sort_array(F.collect_list(F.when(F.col(c), F.col("node")))).alias(name) for c, name in (("low", "removed"), ("high", "kept")))
    return known.where("low or high").groupBy("host").agg(*lists)


def extract(pages: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """``pages`` (url, html and any other columns) with ``text`` and ``n_chars``."""
    known = materialize(branches(pages, config), "branches")
    size = known.agg(F.coalesce(F.sum(F.size("removed") + F.size("kept")), F.lit(0))).first()[0]
    at, gone, stay = (spare(pages.columns, name) for name in ("host", "removed", "kept"))
    known = known.select(F.col("host").alias(at), F.col("removed").alias(gone), F.col("kept").alias(stay))

    @F.pandas_udf("string")
    def text(pages: pd.Series, removed: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, r, config.links, k, config.roles) for p, r, k in zip(pages, removed, kept, strict=True)], dtype=object)

    # Beyond the bound a merge join, in which Spark splits the partitions of hot hosts.
    known = F.broadcast(known) if size <= config.broadcast_nodes else known.hint("merge")
    out = pages.drop("text", "n_chars").withColumn(at, host_of()).join(known, at, "left")
    return out.withColumn("text", text("html", gone, stay)).withColumn("n_chars", F.length("text").cast("long")).drop(at, gone, stay)
