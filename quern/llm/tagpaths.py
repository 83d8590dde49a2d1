"""Main text of web pages by tag-path ratios.

A small scanner cuts a page into blocks of text, each with its path of block elements from the root (``html/body/article/p``), and
sums for each path the characters outside links, the punctuation and the number of blocks, in one pass.  Blocks in elements that
are never content (menus, page headers and footers, asides, scripts, hidden elements) are dropped there.  The rest is a Spark
projection: a path's ratio grows with text and punctuation per block and with its share of the page; it is smoothed with the
ratio of all paths in the same container, so that a heading or a list in the article rises with its paragraphs; landmarks
(``article``, ``main``) are fused in as a factor, and so are class names, ids and roles that mark notices, adverts, forms or comments of readers:
they lower a path's ratio.  The paths within a factor of the best one are kept, so marks decide only beside better paths, and
marked paths need half of the page's text in their container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A path is kept if its fused ratio is at least this part of the best path's.
KEEP_SHARE = 0.02
#: Factors of a path in a landmark, of one that a whole class name marks, and of one that a part of a name marks.
LANDMARK_FACTOR, MARKED, HINTED = 25.0, 0.0005, 0.008

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.DOTALL
)
_COMMENT = re.compile("<!--")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_PART = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，！？；：]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe select".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hgroup dialog menu head button "
    "search".split()
)
#: Elements that structure text inside a container; a path's container is its nearest ancestor that is none of these.
INNER = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary "
    "center hgroup address".split()
)
LANDMARK = frozenset(("main", "article"))
NEVER = frozenset("head nav footer aside button menu dialog search".split())
#: Elements that a new element of the key closes if open: those of the value, up to a barrier.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in class or id that mark what is not content; of these, what readers write and what leads to other pages.
MARKS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments reply replies respond disqus discussion pagination pager widget toolbar "
    "masthead topbar skip".split()
)
OTHERS = frozenset("related recommended comment comments reply replies respond disqus discussion".split())
#: Parts of a name after which it says what an element has beside it, not what it is.
BESIDE = frozenset("has no with without".split())


@dataclass
class Element:
    """An open block element: its tag, path, container, whether its text is dropped, in a landmark, and its marks' factor."""

    tag: str
    path: int
    container: int
    dropped: bool
    landmark: bool
    factor: float
    others: bool


def _marks(names: list[str]) -> tuple[float, bool]:
    """The factor of class names and ids, and whether they mark readers' comments or other pages."""
    factor, others = 1.0, False
    for name in names:
        parts = _PART.findall(name)
        if len(parts) == 1 and name in MARKS:
            factor, others = MARKED, others or name in OTHERS
        elif parts and parts[0] not in BESIDE and not MARKS.isdisjoint(parts):
            factor, others = min(factor, HINTED), others or not OTHERS.isdisjoint(parts)
    return factor, others


class Scanner:
    """One page: ``blocks`` (path number, text) in order, and sums for each path number."""

    def __init__(self, page: str):
        self.blocks: list[tuple[int, str]] = []
        #: by (parent's number, name, landmark, factor): the number of a path
        self.numbers: dict[tuple, int] = {}
        #: by path number: container, landmark, factor, blocks, characters outside links, punctuation
        self.sums: list[list] = []
        self.stack: list[Element] = []
        #: by tag: places of open elements in the stack
        self.open: dict[str, list[int]] = {}
        self.pieces: list[str] = []
        self.linked, self.in_link, self.dropped = 0, False, 0
        self._top = self._element("", "", {}, None)
        self._scan(page)

    def _element(self, tag: str, name: str, found: dict[str, str], up: Element | None) -> Element:
        """A new element under ``up``."""
        inside = bool(up and up.landmark)
        factor, others, dropped = (up.factor, up.others, up.dropped) if up else (1.0, False, False)
        role = found.get("role", "").lower()
        landmark = tag in LANDMARK or role in LANDMARK
        if found:
            dropped = dropped or "hidden" in found or found.get("aria-hidden") == "true"
            dropped = dropped or "display:none" in found.get("style", "").replace(" ", "").lower()
        if landmark:  # a landmark is content whatever it lies in, but for comments and links to other pages
            if tag == "main" or role == "main" or not others:
                factor = 1.0
        elif tag not in ("html", "body"):
            dropped = dropped or tag in NEVER or (tag == "header" and not inside) or role in ROLES
            if tag in ("form", "fieldset"):
                factor *= MARKED
            if found and not (tag in INNER and inside):
                names = found.get("class", "").lower().split() + ([] if tag in INNER else found.get("id", "").lower().split())
                own, comments = _marks(names)
                if not inside and "header" in names:
                    own = min(own, MARKED)
                factor, others = max(factor * own, 1e-12), others or comments
        key = (up.path if up else -1, name, inside or landmark, factor)
        number = self.numbers.setdefault(key, len(self.sums))
        container = number if tag not in INNER or not up else up.container
        if number == len(self.sums):
            self.sums.append([container, inside or landmark, factor, 0, 0, 0])
        return Element(tag, number, container, dropped, inside or landmark, factor, others)

    def _last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _flush(self) -> None:
        top = self.stack[-1] if self.stack else self._top
        text = " ".join("".join(self.pieces).split())
        if text and not top.dropped:
            self.blocks.append((top.path, text))
            sums = self.sums[top.path]
            sums[3] += 1
            sums[4] += max(0, len(text) - self.linked)
            sums[5] += len(_PUNCTUATION.findall(text))
        self.pieces, self.linked = [], 0

    def _close(self, i: int) -> None:
        self._flush()
        for e in reversed(self.stack[i:]):
            self.open[e.tag].pop()
        del self.stack[i:]

    def _add(self, data: str) -> None:
        size = 0 if self.in_link else len(data)
        if self.stack and self.stack[-1].dropped:
            self.dropped += 0 if data.isspace() else size
        else:
            data = html.unescape(data) if "&" in data else data
            self.pieces.append(data)
            self.linked += len(data) if self.in_link else 0

    def _start(self, tag: str, attributes: str) -> None:
        p, cell = self._last("p"), self._last("td", "th", "button")
        if p > cell:
            self._close(p)
        if tag in CLOSES:
            barrier = self._last(*BARRIER[tag])
            within = [i for t in CLOSES[tag] for i in self.open.get(t, ()) if i > barrier]
            if within:
                self._close(min(within))
        self._flush()
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        first = _PART.findall(found.get("class", "").lower())[:1]
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(self._element(tag, f"{tag}.{first[0]}" if first else tag, found, self.stack[-1] if self.stack else self._top))

    def _scan(self, page: str) -> None:
        at, stop = 0, page.rfind(">") + 1
        while found := _TAG.search(page, at, stop) or _COMMENT.search(page, max(at, stop)):
            if found.start() > at:
                self._add(page[at : found.start()])
            at = found.end()
            if found[0].startswith("<!--"):
                at = at if found[0].endswith("-->") else len(page)  # or a comment that never ends
                continue
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                if tag == "a":
                    self.in_link = False
                elif tag in BLOCK and (last := self._last(tag)) >= 0:
                    self._close(last)
            elif tag in RAW:
                if not found[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else len(page)
            elif tag == "a":
                self.in_link = True
            elif tag in ("br", "hr"):
                self.pieces.append(" ")
            elif tag in BLOCK:
                self._start(tag, found[3])
        self._add(page[at:])
        self._flush()

    def row(self) -> dict:
        """Blocks and paths as Spark reads them; a path has its own sums and those of its box: its container, or all in landmarks."""
        boxes: dict = {}
        for container, landmark, factor, n, chars, points in self.sums:
            box = boxes.setdefault(("all" if landmark else container, factor), [0, 0, 0])
            for i, x in enumerate((n, chars, points)):
                box[i] += x
        paths = [
            {"landmark": s[1], "factor": s[2], "n": s[3], "chars": s[4], "points": s[5], "box_n": b[0], "box_chars": b[1], "box_points": b[2]}
            for s in self.sums
            for b in [boxes[("all" if s[1] else s[0], s[2])]]
        ]
        return {"blocks": [{"path": p, "text": x} for p, x in self.blocks], "paths": paths, "dropped": self.dropped}


_COUNTS = ("n", "chars", "points", "box_n", "box_chars", "box_points")
_ARROW = pa.struct(
    [
        ("blocks", pa.list_(pa.struct([("path", pa.int32()), ("text", pa.string())]))),
        ("paths", pa.list_(pa.struct([("landmark", pa.bool_()), ("factor", pa.float64()), *((c, pa.int64()) for c in _COUNTS)]))),
        ("dropped", pa.int64()),
    ]
)
_SCANNED = (
    "struct<blocks:array<struct<path:int,text:string>>,paths:array<struct<landmark:boolean,factor:double,"
    + ",".join(f"{c}:long" for c in _COUNTS)
    + ">>,dropped:long>"
)


def _scan(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([Scanner(x.as_py() or "").row() for x in batch], _ARROW)


def _ratio(n: Column, chars: Column, points: Column, whole: Column) -> Column:
    """Text per block, raised by punctuation per block and by the share of the page's text."""
    n = F.greatest(n, F.lit(1))
    return chars / n * F.sqrt(F.lit(1.0) + points / n) * chars / whole


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``.

    A null or empty page, or one without content, has the text ''.  Repeated rows are extracted each.  Broken markup is read as far as
    it goes: elements left open end with their parents, stray end tags are ignored.  A column of the name ``text`` or
    ``n_chars`` in ``pages`` is replaced; no other name clashes.  Time grows in proportion to a page's length.
    """
    scan = F.arrow_udf(_scan, _SCANNED)
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    rows = pages.select(F.struct(*[pages[c] for c in kept]).alias("row"), scan(pages[column]).alias("page"))
    total = F.aggregate("page.paths", F.lit(0).cast("long"), lambda a, p: a + p["chars"])
    rows = rows.withColumn("whole", F.greatest(F.lit(1).cast("long"), total + F.col("page.dropped")))

    def fused(p: Column) -> Column:
        whole = F.col("whole")
        smooth = (_ratio(p["n"], p["chars"], p["points"], whole) + _ratio(p["box_n"], p["box_chars"], p["box_points"], whole)) / 2
        ratio = smooth * F.when(p["landmark"], LANDMARK_FACTOR).otherwise(1.0) * p["factor"]
        allowed = (p["factor"] == 1) | (2 * p["box_chars"] >= whole)
        return F.when(p["n"] == 0, -1.0).when(allowed, ratio).otherwise(-1.0)

    rows = rows.withColumn("ratios", F.transform("page.paths", fused))
    rows = rows.withColumn("least", F.array_max("ratios") * KEEP_SHARE)
    good = F.filter("page.blocks", lambda b: (F.get("ratios", b["path"]) >= F.col("least")) & (F.get("ratios", b["path"]) >= 0))
    text = F.array_join(F.transform(good, lambda b: b["text"]), " ")
    return rows.select("row.*", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op4_html_extraction": op4_html_extraction}
