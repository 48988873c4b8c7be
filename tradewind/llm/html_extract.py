"""Main text of web pages by the ratio of text to tags."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Standard deviation of the Gaussian that smooths the ratios, in lines, and how far it reaches.
SIGMA = 1.0
REACH = 2
# Lines below the threshold between two lines above it that still belong to one region.
GAP = 2

# Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
# Elements that only part words.
PARTS = frozenset("br td th option wbr img".split()) - {"wbr"}
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose text is never part of an article.
FURNITURE = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video nav aside "
    "footer form button select textarea datalist menu dialog".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words in the class or id of such elements, and in their role.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs masthead footer comment comments disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "pagination pager toolbar skip".split()
)
READERS = frozenset("comment comments disqus related recommended".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
# A wrapper of the whole page may be named after what it holds.
WRAPPERS = frozenset("has with no layout page wrapper container content main body site".split())
# An open element of the first kind ends where one of the second begins.
ENDS = {
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "option": frozenset({"option"}),
}
_WORD = re.compile("[a-z0-9]+")
_CUT = re.compile(r"<(?:!--.*|[A-Za-z/!?][^>]*)\Z", re.DOTALL)


class Lines(HTMLParser):
    """Collects the lines of a page from parser events: text, tags, linked characters, the article
    they are in, and whether an element around them rules them out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool]] = []
        # Tag, whether it is ruled out, why (readers' words stay out in any case), article.
        self.open: list[tuple[str, bool, bool, int]] = []
        self.articles: tuple[int, ...] = ()
        self.seen = 0
        self.links = 0
        self.tags = 0
        self.text: list[str] = []
        self.linked = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            out = bool(self.open) and self.open[-1][1]
            self.lines.append((text, self.tags, self.linked, self.articles, out))
            self.tags = self.linked = 0
        self.text = []

    def _rules_out(self, tag: str, attrs) -> tuple[bool, bool]:
        if tag in FURNITURE:
            return True, True
        values = {k: v or "" for k, v in attrs}
        if tag in ("html", "body", "main"):
            return False, False
        kinds = values.get("class", "").lower().split()
        # A heading's id is made of its words.
        own = [] if tag in HEADINGS else [values.get("id", "").strip().lower()]
        names = set(_WORD.findall(" ".join(kinds + own)))
        hidden = (
            "hidden" in values
            or values.get("aria-hidden") == "true"
            or "display:none" in values.get("style", "").replace(" ", "").lower()
        )
        if hidden or values.get("role", "").lower() in ROLES:
            return True, True
        if tag == "header":
            return True, False
        marks = names & MARKS
        if self.articles or tag == "article":
            # Parts of an article are named after what they are about (related-work), so that one
            # word of a name says nothing: it is the whole id, or a class of such words alone.
            marks &= {w for k in kinds if MARKS.issuperset(parts := _WORD.findall(k)) for w in parts}.union(own)
        if marks and not (names & WRAPPERS and tag in ("div", "section")):
            return True, bool(marks & READERS)
        return False, False

    def _close(self, upto: int) -> None:
        """Closes the open elements from this one on."""
        self._end_line()
        while len(self.open) > upto:
            tag, _, _, article = self.open.pop()
            if article:
                self.articles = self.articles[:-1]
            if tag == "a":
                self.links -= 1

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in BLOCKS
        if block:
            self._end_line()
            # A block ends the paragraph that it is in, however many inline elements are open.
            places = range(len(self.open) - 1, -1, -1)
            nearest = next((i for i in places if self.open[i][0] == "p" or self.open[i][0] in BLOCKS), None)
            if nearest is not None and self.open[nearest][0] == "p":
                self._close(nearest)
        elif tag in PARTS:
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if (enders := ENDS.get(tag)) and self.open and self.open[-1][0] in enders:
            self._close(len(self.open) - 1)
        above = bool(self.open) and self.open[-1][1]
        fixed = bool(self.open) and self.open[-1][2]
        own, own_fixed = self._rules_out(tag, attrs)
        article = 0
        if tag in ("article", "main"):
            self.seen += 1
            article = self.seen
            self.articles = (*self.articles, article)
            above = above and fixed
        if tag in HEADINGS and self.articles and not fixed:
            above = False
        if tag == "a":
            self.links += 1
        self.open.append((tag, above or own, fixed or own_fixed, article))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in BLOCKS or tag in FURNITURE:
                    self._close(at)
                elif not any(x[0] in BLOCKS for x in self.open[at:]):
                    if tag == "a":
                        self.links -= 1
                    del self.open[at]
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    def done(self):
        # A comment or tag that the page ends in is no text.
        self.rawdata = _CUT.sub("", self.rawdata)
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA, reach: int = REACH) -> list[float]:
    """Gaussian mean of each value and its neighbours; the ends have fewer."""
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for at in range(len(values)):
        weight = total = 0.0
        for k, w in enumerate(kernel):
            place = at + k - reach
            if 0 <= place < len(values):
                weight += w
                total += w * values[place]
        out.append(total / weight)
    return out


def regions(ratios: list[float], gap: int = GAP) -> list[tuple[int, int]]:
    """Runs of lines [first, after) whose smoothed ratio reaches the threshold, the standard
    deviation over the page; runs at most ``gap`` lines apart are one."""
    if not ratios:
        return []
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    threshold = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    found: list[list[int]] = []
    for at, value in enumerate(smooth):
        if value >= threshold:
            if found and at - found[-1][1] <= gap:
                found[-1][1] = at + 1
            else:
                found.append([at, at + 1])
    return [(a, b) for a, b in found]


def main_text(html: str | None) -> str:
    """The article of a page: its lines joined by line feeds.

    Lines (blocks) come from the standard library's parser in one pass. Each has a ratio of
    characters to tags; ratios are smoothed and the regions above the threshold are the content.
    Where most of the content lies in an ``article`` or ``main`` element, that element is the
    region, with its short lines. Elements that are no article by their kind, role or name
    (menus, headers, footers, sidebars, notices, adverts, forms, comments) never count; inside an
    article a name does so as a whole only. Regions that are mostly links count inside it alone."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = [line for line in parser.done() if not line[4]]
    ratios = [len(text) / max(tags, 1) for text, tags, _, _, _ in lines]
    chosen: list[int] = []
    for first, after in regions(ratios):
        part = lines[first:after]
        size = sum(len(line[0]) for line in part)
        if 2 * sum(line[2] for line in part) <= size:
            chosen += range(first, after)
        else:
            # Lists of links are no content, unless they are what an article is made of.
            chosen += [i for i in range(first, after) if lines[i][3]]
    size = sum(len(lines[i][0]) for i in chosen)
    inside: dict[int, int] = {}
    for i in chosen:
        for article in lines[i][3]:
            inside[article] = inside.get(article, 0) + len(lines[i][0])
    held = [article for article, part in inside.items() if 2 * part > size]
    if held:
        # The innermost that still has most of it.
        article = max(held)
        chosen = [i for i, line in enumerate(lines) if article in line[3]]
    return "\n".join(lines[i][0] for i in chosen)


def _extracted(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("kept"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["kept", "text", "n_chars"],
        )


def extract(
    pages: DataFrame,
    id_column: str = "page_id",
    html_column: str = "html",
    carry: tuple[str, ...] = ("url",),
) -> DataFrame:
    """Adds the main text of every page, from its whole html, and its length in code points.

    One row per input row and no shuffle. A null or empty page, and one without an article, has
    an empty text; broken or cut markup is read as far as it goes. Other columns are ignored,
    except those in ``carry``. Columns: the id column, ``carry``, text, n_chars."""
    kept = F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    rows = pages.select(kept.alias("kept"), F.col(html_column).alias("html"))
    kind = rows.schema["kept"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"kept {kind}, text string, n_chars bigint").select(
        F.col("kept.id").alias(id_column),
        *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)],
        "text",
        "n_chars",
    )


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
