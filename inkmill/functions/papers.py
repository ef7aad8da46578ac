"""Examples from LaTeXML pages: the text of one section withheld, the rest of the page as its context.

A worker reads a page once into a list of texts in which every element is a range, so that masking a section,
numbering citations and leaving figures out are ranges to pass over, and makes its texts clean, in time that follows the
page's length. What is said of texts (hashes, which rule rejects) is done by columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions.html_text import KINDS, NUMBER, PARTING, SKIPPED, VOID
from inkmill.functions.text import PLAIN

#: Classes that are not a section's prose.
NON_PROSE = frozenset("ltx_figure ltx_table ltx_float ltx_listing ltx_tabular ltx_acknowledgements".split())
#: A label of acknowledgements inside a text.
THANKS = r"(?i)\backnowledg(?:e)?ments?\b"
#: What a paper needs.
NEEDED, LEAST_ITEMS, LEAST_WORDS = ("abstract", "introduction"), 10, 60
TEX = "application/x-tex"
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


#: Tags as LaTeXML sets nearly all of them, which need no tolerant reading; elements whose contents are no markup are left to the library.
_START, _ATTR, _END = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&<>]*")*)>'), re.compile(r' ([a-z][a-z0-9-]*)="([^"]*)"'), re.compile(r"</([a-z][a-z0-9]*)>")
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_NONE = frozenset()


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict
    first: int  # its texts are those from first up to last
    at: int  # it and the elements in it are those from at up to end
    classes: frozenset
    last: int = -1
    end: int = -1


class _Page(HTMLParser):
    """Elements in page order, and texts; an element ends with its tag, its parent or the page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self._open, self._tags = [], [], [], Counter()
        self.feed(html)
        self.close()
        while self._open:
            self._end()

    def updatepos(self, i, j):
        return j  # lines are not asked for

    def parse_starttag(self, i):
        m = _START.match(self.rawdata, i)
        if m is None or m[1] in _RAW:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], _ATTR.findall(m[2]) if m[2] else ())
        return m.end()

    def parse_endtag(self, i):
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None or m[1] in _RAW:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        classes = attrs.get("class")
        e = Element(tag, attrs, len(self.texts), len(self.elements), frozenset(classes.split()) if classes else _NONE)
        self.elements.append(e)
        self.texts.append("")  # its own place, so that an empty element has a range too
        self._open.append(e)
        self._tags[tag] += 1
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._tags[tag]:
            while self._end() != tag:
                pass

    def _end(self) -> str:
        e = self._open.pop()
        e.last, e.end = len(self.texts), len(self.elements)
        self._tags[e.tag] -= 1
        return e.tag

    def handle_data(self, data):
        self.texts.append(data)

    def inner(self, e: Element):
        """The elements inside it, one by one."""
        return (self.elements[k] for k in range(e.at + 1, e.end))

    def words(self, e: Element) -> str:
        """Its stripped texts, single spaces between them."""
        return " ".join(t for t in map(str.strip, self.texts[e.first : e.last]) if t)


def _outermost(elements: list[Element]) -> list[Element]:
    out = []
    for e in elements:
        if not out or e.first >= out[-1].last:
            out.append(e)
    return out


def _render(page: _Page, root: Element, instead: dict[int, tuple[int, str]], prose: bool = False) -> str:
    """The text of root, white space as single spaces. instead: first -> (last, text) of ranges with another text; prose: without its first heading and all that is no prose."""
    jump = dict(instead)
    spaces: set[int] = set()
    ranges, k = sorted((a, b) for a, (b, _) in instead.items()), 0
    seek, past = prose, -1
    replaced = -1  # up to where the ranges so far reach
    for at in range(root.at, root.end):
        e = page.elements[at]
        while k < len(ranges) and ranges[k][0] <= e.first:
            replaced = max(replaced, ranges[k][1])
            k += 1
        if e.first < replaced:
            continue
        heading = seek and e.tag in HEADINGS
        seek = seek and not heading
        if e.first < past:  # inside one that is left out
            continue
        if heading or e.tag in SKIPPED or "ltx_ERROR" in e.classes or (prose and e.classes & NON_PROSE):
            past = e.last
            jump[e.first] = (past, "")
        elif e.tag == "math":
            tex = next((x for x in page.inner(e) if x.tag == "annotation" and x.attrs.get("encoding") == TEX), None)
            shown = "".join(page.texts[tex.first : tex.last]) if tex else e.attrs.get("alttext", " ".join(page.texts[e.first : e.last]))
            past = e.last
            jump[e.first] = (past, shown)
        elif e.tag in PARTING:
            spaces |= {e.first, e.last}
    out, at = [], root.first
    while at < root.last:
        if at in spaces:
            out.append(" ")
        if at in jump:
            at, shown = jump[at]
            out.append(shown)
        else:
            out.append(page.texts[at])
            at += 1
    text = unicodedata.normalize("NFC", "".join(out))
    if not text.isascii():
        for mark, plain in PLAIN.items():
            text = text.replace(mark, plain)
    return " ".join(text.split())


def paper_of(html: str | None) -> dict | None:
    """What the rules need of a page, and each section's text and context; None without a LaTeXML document."""
    page = _Page(html or "")
    root = next((e for e in page.elements if "ltx_document" in e.classes), None)
    if root is None:
        return None
    inside = list(page.inner(root))
    items = [e for e in inside if "ltx_bibitem" in e.classes and "id" in e.attrs]
    numbers = {e.attrs["id"]: n for n, e in enumerate(items, 1)}
    instead, gone = {}, bytearray(len(page.elements))
    for e in items:
        label = next((x for x in page.inner(e) if "ltx_tag_bibitem" in x.classes), None)
        if label:  # the label stays, its contents change
            instead[label.first + 1 if label.last > label.first + 1 else label.first] = (label.last, f"[{numbers[e.attrs['id']]}]")
            gone[label.at + 1 : label.end] = b"\1" * (label.end - label.at - 1)
    for e in _outermost([e for e in inside if "ltx_cite" in e.classes and not gone[e.at]]):
        links = [x.attrs["href"][1:] for x in page.inner(e) if x.tag == "a" and x.attrs.get("href", "").startswith("#")]
        cited = sorted({numbers[x] for x in links if x in numbers})
        if cited:
            instead[e.first] = (e.last, "[" + ", ".join(map(str, cited)) + "]")
            gone[e.at : e.end] = b"\1" * (e.end - e.at)
    inside = [e for e in inside if not gone[e.at]]
    abstracts = [e for e in inside if "ltx_abstract" in e.classes]
    targets, repeated = {"abstract": e for e in abstracts[:1]}, None
    for section in _outermost([e for e in inside if "ltx_section" in e.classes]):
        head = next((e for e in page.inner(section) if e.tag in HEADINGS and not gone[e.at]), None)
        bare = NUMBER.sub("", page.words(head)).strip().casefold() if head else ""
        kind = next((k for k, p in KINDS.items() if k != "abstract" and re.fullmatch(p, bare)), None)
        if kind and kind in targets:
            repeated = repeated or f"{kind}, headed {bare!r}"
        elif kind:
            targets[kind] = section
    missing = [k for k in NEEDED if k not in targets]
    bibliography, errors = sum("ltx_bibitem" in e.classes for e in inside), sum("ltx_ERROR" in e.classes for e in inside)
    broken = _render_raw(page, root, instead).count("�") if any("�" in t for t in page.texts) else 0
    out = []
    # a page that a rule on pages rejects has no sections to show
    fit = len(abstracts) == 1 and not repeated and not missing and bibliography >= LEAST_ITEMS and not errors + broken
    named: dict[str, Element] = {}
    for e in [root, *inside] if fit else []:
        named.setdefault(e.attrs.get("id", ""), e)
    for kind, e in targets.items() if fit else []:
        name = e.attrs.get("id", "")
        first = named[name] if name else None
        masked = {a: b for a, b in instead.items() if not (first and first.first <= a < first.last)}
        if first:
            masked[first.first] = (first.last, f"[Missing {kind.replace('_', ' ')} section]")
        reference, context = _render(page, e, {a: b for a, b in instead.items() if e.first <= a < e.last}, True), _render(page, root, masked)
        out.append({"kind": kind, "id": name, "reference": reference, "context": context, "words": len(reference.split()), "elsewhere": reference in context})
    return {"abstracts": len(abstracts), "repeated": repeated, "missing": missing, "items": bibliography, "errors": errors, "broken": broken, "sections": out}


def _render_raw(page: _Page, root: Element, instead: dict[int, tuple[int, str]]) -> str:
    """All texts of root but those of scripts and styles."""
    jump = {e.first: (e.last, "") for e in page.inner(root) if e.tag in ("script", "style")} | instead
    out, at = [], root.first
    while at < root.last:
        shown = jump.get(at, (at + 1, page.texts[at]))
        out.append(shown[1])
        at = shown[0]
    return "".join(out)


_SECTION = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "id", "reference", "context")] + [T.StructField("words", T.LongType()), T.StructField("elsewhere", T.BooleanType())])
_PAPER = T.StructType(
    [T.StructField("found", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("abstracts", "items", "errors", "broken")]
    + [T.StructField("repeated", T.StringType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("sections", T.ArrayType(_SECTION))]
)


@F.udf(_PAPER, useArrow=False)
def _papers(html: str | None) -> dict:
    """A page and its texts at a time, as rows reach a worker by the hundred: Arrow's batches would hold ten thousand of them."""
    p = paper_of(html)
    return {"found": p is not None, **(p or {"abstracts": 0, "items": 0, "errors": 0, "broken": 0, "repeated": None, "missing": [], "sections": []})}


#: So that a filter on what it says is not pushed below it as a second reading of the page.
_papers = _papers.asNondeterministic()


def _reason(x: Column) -> Column:
    """How the rules on a section are worded."""
    return (
        F.when(x["reference"].rlike(THANKS), F.concat(x["kind"], F.lit(" contains acknowledgements the markup does not set apart")))
        .when(x["words"] < LEAST_WORDS, F.concat(x["kind"], F.lit(" has "), x["words"], F.lit(f" words; at least {LEAST_WORDS} required")))
        .when(x["id"] == "", F.concat(x["kind"], F.lit(" section has no HTML id")))
        .when(x["elsewhere"], F.concat(x["kind"], F.lit(" text also appears elsewhere in the paper, so removing it does not hide it")))
    )


def read_papers(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(paper_id, reason, bibliography_items, sections): reason is the first rule that rejects the paper, null if none.

    A null page has no document. Every section looked for lies in its own page, so that none can be missing from it.
    """
    p = F.col("p")
    read = pages.select(F.col(key).cast("string").alias("paper_id"), _papers(F.col(html)).alias("p"))
    say = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    #: How the rules on a page are worded.
    whole = (
        F.when(~p["found"], "Page has no LaTeXML document (.ltx_document)")
        .when(p["abstracts"] != 1, say("Page has ", p["abstracts"], " abstracts; expected 1"))
        .when(p["repeated"].isNotNull(), say("Found a second top-level ", F.replace(p["repeated"], F.lit(", headed"), F.lit(" section, headed"))))
        .when(F.size(p["missing"]) > 0, say("Top-level sections not found: ", F.array_join(p["missing"], ", ")))
        .when(p["items"] < LEAST_ITEMS, say("Bibliography has ", p["items"], f" entries; at least {LEAST_ITEMS} required"))
        .when(p["errors"] + p["broken"] > 0, say("Page has ", p["errors"], " LaTeXML error node(s) and ", p["broken"], " U+FFFD character(s)"))
    )
    first = F.get(F.array_compact(F.transform(p["sections"], _reason)), F.lit(0))
    return read.select("paper_id", F.coalesce(whole, first).alias("reason"), p["items"].alias("bibliography_items"), p["sections"].alias("sections"))


def rejected(papers: DataFrame) -> DataFrame:
    return papers.where("reason is not null").select("paper_id", "reason")


def examples(papers: DataFrame) -> DataFrame:
    """A row for each section of a paper that no rule rejects."""
    x = papers.where("reason is null").select("paper_id", "bibliography_items", F.explode("sections").alias("x"))
    return x.select(
        F.concat_ws("_", "paper_id", "x.kind").alias("example_id"), F.col("paper_id").alias("source_id"), "x.kind", "x.context", "x.reference",
        F.sha2("x.context", 256).alias("context_hash"), F.sha2("x.reference", 256).alias("reference_hash"), F.col("x.words").alias("target_words"), "bibliography_items",
    )
