"""Main text of web pages, with site templates removed by recurring subtrees.

Pages become element trees, and every element's whole subtree is hashed, menus and scripts like any other.
Spark counts, per host, on how many different pages each hash occurs; subtrees on LEAST_PAGES of a host's
pages or more, and on more than SHARE of them, are the site's template and are deleted. Pages of the same
main text are one page for these counts, so that copies of an article don't make it a template. Of what
is left, parts that are not the article by their meaning (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) go by element, role, and whole names in class and id. All
other blocks are the text, wherever they stand on the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import only, small_enough, table, written

SHARE, LEAST_PAGES = 0.5, 5
#: Template subtrees, over all hosts, up to which they are broadcast; else they are joined by host.
MOST_BROADCAST = 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article's text.
DROPPED = frozenset("aside button canvas datalist dialog embed footer form head header iframe input label math-ad menu nav noscript object script select style svg template textarea title video audio".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that tell the same: alone, or in a name of such words and PLAIN ones.
TOLD = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification notifications outbrain pager pagination popup promo promos promotion promoted recommended related replies reply respond search share sharing sidebar sidebars "
    "signin signup skip social sponsor sponsored subscribe subscription taboola toolbar warning widget widgets".split()
)
PLAIN = frozenset("area bar block bottom box container content element first global inner item items last left link links list main outer page panel primary right section secondary site small sticky text top unit wrap wrapper zone".split())
REMARKS = frozenset("comment comments reply replies respond disqus".split())
ROOTS = frozenset(("html", "body", "main", "article"))
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("attrs", "children", "hash", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.hash = tag, attrs, [], 0


class _Tree(HTMLParser):
    """Builds a tree as browsers roughly do: paragraphs, items and cells close each other; stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.depth: dict[str, int] = {}

    def _pop(self) -> None:
        self.depth[self.open.pop().tag] -= 1

    def _close(self, tags: set, limits: set) -> None:
        if not any(self.depth.get(t) for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if tag in limits:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SAME:
            self._close(SAME[tag], WITHIN[tag])
        node = Node(tag, {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif self.depth.get(tag):
            # inline ends don't close the blocks around them
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    while len(self.open) > k:
                        self._pop()
                    return
                if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                    return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _unwanted(n: Node) -> bool:
    if n.tag in DROPPED or n.attrs.get("role", "").lower() in ROLES:
        return True
    if not n.attrs:
        return False
    if "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true" or "display:none" in n.attrs.get("style", "").replace(" ", "").lower():
        return n.tag not in ROOTS
    if n.tag in ROOTS and n.tag != "article":
        return False
    telling = REMARKS if n.tag == "article" else TOLD
    for name in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if w}
        if words & telling and words <= telling | PLAIN:
            return True
    return False


def tree(html: str | None) -> Node:
    """The page's tree, each element with its subtree's hash (0 if it has no text)."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    # children before parents; an explicit stack, for depth has no bound
    order, stack = [], [parser.root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [c for c in n.children if not isinstance(c, str)]
    for n in reversed(order):
        h, some = xxhash.xxh64(f"{n.tag} {n.attrs.get('class', '')} {n.attrs.get('id', '')}".encode("utf-8", "replace")), False
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    h.update(b"t" + " ".join(c.split()).encode("utf-8", "replace"))
                    some = True
            elif c.hash:
                h.update(b"e" + c.hash.to_bytes(8, "big"))
                some = True
        n.hash = (h.intdigest() or 1) if some else 0
    return parser.root


def pruned(root: Node, template: frozenset[int] | set[int] = frozenset()) -> Node:
    """The tree without the subtrees in template, and without unwanted parts."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not (c.hash in template or _unwanted(c))]
        stack += [c for c in n.children if not isinstance(c, str)]
    return root


def _under(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack += [c for c in reversed(n.children) if not isinstance(c, str)]


def _containers(root: Node) -> list[Node]:
    """The outermost articles, else main parts, else the page: by these, pages are told to be copies of an article."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.attrs.get("role") == "main"):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if wanted(n):
                found.append(n)
            else:
                stack += [c for c in reversed(n.children) if not isinstance(c, str)]
        if any(n.hash for n in found):
            return found
    return [root]


def subtree_hashes(root: Node) -> set[int]:
    return {n.hash for n in _under(root) if n.hash and n.tag and n.tag not in ("html", "body")}


def text_of(tops: list[Node]) -> str:
    """The text of parts of a pruned tree."""
    blocks: list[str] = []
    words: list[str] = []

    def end() -> None:
        if line := " ".join("".join(words).split()):
            blocks.append(line)
        words.clear()

    for top in tops:
        stack: list = [top]
        while stack:
            n = stack.pop()
            if n is None:
                end()
            elif isinstance(n, str):
                words.append(n)
            elif n.tag == "br":
                words.append(" ")
            else:
                if n.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack += reversed(n.children)
        end()
    return "\n".join(blocks)


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    return text_of([pruned(tree(html), template)])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        hosts, same, own = [], [], []
        for host, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            root = tree(html)
            hosts.append(host)
            own.append(sorted(map(_signed, subtree_hashes(root))))
            same.append(_signed(xxhash.xxh64_intdigest(text_of(_containers(pruned(root))).encode("utf-8", "replace"))))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(same, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["host", "same", "own"])


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        texts = [main_text(html, {h % (1 << 64) for h in hs or ()}) for html, hs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def templates(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, hash, n, pages): the subtrees of pages(host, html) on n of the host's different pages, least_pages of them or more and over share of all."""
    each = pages.select("host", "html").mapInArrow(_hashes, "host string, same long, own array<long>").groupBy("host", "same").agg(F.min("own").alias("own"))
    each = written(each, "subtrees")
    n = each.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    found = each.select("host", F.explode("own").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return found.join(n, "host").where(F.col("n") > share * F.col("pages")).select("host", "hash", "n", "pages")


def main_texts(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) for each row of pages(page_id, url, html).

    Null or empty html gives an empty text; pages without a host in their url are of one host; rows that share
    an id, or have none, stay rows of their own; an empty table gives an empty result. Blocks are joined by
    one newline, white space inside a block is one space. A host with fewer than least_pages different pages
    has no template.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = only(pages, "page_id", "url", "html").withColumn("host", host)
    found = written(templates(pages, share, least_pages), "templates")
    by_host = found.groupBy("host").agg(F.collect_set("hash").alias("template"))
    if small_enough(found, MOST_BROADCAST):
        by_host = F.broadcast(by_host)
    return pages.join(by_host, "host", "left").select("page_id", "url", "html", "template").mapInArrow(_texts, "page_id long, url string, text string")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
