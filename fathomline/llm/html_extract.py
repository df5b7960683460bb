"""Main-text extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser cuts a page into lines, one a block element. Lines inside elements
that never hold an article's text (menus, page headers and footers, forms, adverts, readers' comments and so
on, by tag, role, or a whole word of class or id) are boilerplate; a name alone never makes an article or main
element boilerplate, nor a page's only text. Each other line's ratio of text characters to tags is smoothed
along the page, and lines whose smoothed ratio reaches the threshold form the content clusters. A cluster
inside an article or main element stands for that element, whose short lines then belong to the text too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._common import batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
BOILERPLATE = frozenset("head nav header footer aside form menu button select textarea noscript template iframe object svg canvas dialog script style title".split())
CONTENT = frozenset(["article", "main"])
#: Elements that a name does not make boilerplate.
UNNAMED = CONTENT | {"body", "html"}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form toolbar".split())
#: Start tags that end an open p; for li, dd and dt those that end it, and elements beyond which no open one is looked for.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS_ITEM = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
LISTS = SCOPE | {"ul", "ol", "dl", "menu", "dir"}
#: Names of boilerplate. A word of class or id is one if it is a name, ends with one after a qualifier (site-footer), or has one and then the shape of its box (comment-list).
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice popup modal overlay newsletter subscribe signup login nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar side header footer masthead toolbar share sharing social related recommended comment comments disqus respond reply replies widget".split()
)
SHAPES = frozenset("list area box wrap wrapper container section block left right top bottom inner item items links bar thread slot unit panel".split())
#: Qualifiers that tell of a page's layout, not of the element.
LAYOUT = frozenset("no not has with without open closed enable enabled disable disabled hide show".split())


def named_boilerplate(value: str) -> bool:
    """Whether a class or id attribute has a word that names boilerplate."""
    for word in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", word) if p]
        while len(parts) > 1 and (parts[-1] in SHAPES or parts[-1].isdigit()):
            parts.pop()
        if parts and parts[-1] in NAMES and not LAYOUT.intersection(parts):
            return True
    return False


SIGMA, RADIUS = 1.0, 2
#: Lines whose smoothed ratio is at least this share of the mean smoothed ratio are content.
SHARE = 0.5


class _Lines(HTMLParser):
    """lines: [text parts, tags, content element's number or 0, whether boilerplate by name], in page order, without other boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0, 0, False]]
        self.open: list[tuple[str, int, int]] = []  # tag, boilerplate (1 by name, 2 otherwise), content element
        self.at: dict[str, list[int]] = defaultdict(list)  # where in open the elements of a tag are
        self.elements = 0

    def _state(self) -> tuple[int, int]:
        return self.open[-1][1:] if self.open else (0, 0)

    def _told(self) -> None:
        skip, element = self._state()
        self.lines[-1][2:] = [element, skip == 1]

    def _break(self) -> None:
        if self.lines[-1][0]:
            self.lines.append([[], 0, 0, False])
        self._told()

    def _cut(self, k: int) -> None:
        """Ends the k-th open element and all in it. Each element is ended once, so a page's work is in proportion to its tags."""
        for tag, _, _ in self.open[k:]:
            self.at[tag].pop()
        del self.open[k:]

    def _imply_end(self, tags: tuple[str, ...], scope: frozenset[str]) -> None:
        """Ends the innermost open element of these tags inside the scope; what is implied is no tag of the page."""
        k = max((self.at[t][-1] for t in tags if self.at[t]), default=-1)
        if k >= 0 and k > max((self.at[t][-1] for t in scope if self.at[t]), default=-1):
            self._break()
            self._cut(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_ITEM:
            self._imply_end(ENDS_ITEM[tag], LISTS)
        if tag in ENDS_P or tag in ENDS_ITEM:
            self._imply_end(("p",), SCOPE)
        skip, element = self._state()
        if tag not in INLINE:
            self._break()
        if tag not in VOID:
            if skip < 2:
                own = dict(attrs)
                if tag in BOILERPLATE or "hidden" in own or (own.get("role") or "").lower() in ROLES:
                    skip = 2
                elif tag not in UNNAMED and any(own.get(k) and named_boilerplate(own[k]) for k in ("class", "id")):
                    skip = 1
                if tag in CONTENT and not skip:
                    self.elements += 1
                    element = self.elements
            self.at[tag].append(len(self.open))
            self.open.append((tag, skip, element))
            if tag not in INLINE:
                self._told()
        if skip < 2:
            self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        if self.at[tag]:
            k = self.at[tag][-1]
            if self.open[k][1] < 2:
                self.lines[-1][1] += 1
            self._cut(k)
        if tag not in INLINE:
            self._told()

    def handle_data(self, data: str) -> None:
        skip = self._state()[0]
        if skip < 2 and data:
            if (skip == 1) != self.lines[-1][3] and self.lines[-1][0]:
                self._break()  # an inline element by whose name its text is boilerplate
            self._told()
            self.lines[-1][0].append(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends of the page."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    out, weight = np.zeros(len(ratios)), np.zeros(len(ratios))
    for k, w in zip(range(-RADIUS, RADIUS + 1), kernel):
        lo, hi = max(0, -k), min(len(ratios), len(ratios) - k)
        if lo < hi:
            out[lo:hi] += w * ratios[lo + k : hi + k]
            weight[lo:hi] += w
    return out / weight


def extract(html: str) -> str:
    """The main text of a page; a tag cut off at the end of the page is no text."""
    parser = _Lines()
    parser.feed(re.sub(r"<(?:[A-Za-z/!][^<>]*)?$", "", html))
    parser.close()
    lines = [(" ".join("".join(parts).split()), tags, element, named) for parts, tags, element, named in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    # Names may mislead: where they leave no text at all, they count for nothing.
    lines = [x[:3] for x in lines if not x[3]] or [x[:3] for x in lines]
    ratio = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in lines], float))
    content = ratio >= min(ratio.max(), SHARE * ratio.mean())
    elements = {element for (_, _, element), ok in zip(lines, content) if ok and element}
    # An article or main element with content is text as a whole; beside it the ratios choose.
    return " ".join(text for (text, _, element), ok in zip(lines, content) if ok or element in elements)


@batches
def _extracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [extract(h.as_py() or "") for h in batch.column(2)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each row of pages (page_id, url, html).

    A null or empty page has an empty text; null ids and urls and repeated rows pass as they are; other
    columns are not looked at. An empty table gives an empty result.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(_extracted, schema)
