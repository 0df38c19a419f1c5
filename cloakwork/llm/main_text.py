"""The main text of web pages.

The standard library's parser streams a page's events into lines, one per block
element.  The text-to-tag ratio of the lines is smoothed with a Gaussian, and
clusters of lines over a threshold are the content regions.  Ratios alone would cut
short paragraphs at the ends of an article, so the regions decide which element of the
page is the article: one marked as such, or the lowest that holds all of them, since an
article may be split into several.  All lines of that element are kept but those of menus,
forms and the like inside it.  If it is the whole page, its parts without a region before
the first and after the last go too.  A long notice that nothing marks is kept.

Defined results: null, empty or text-free html gives the empty text; broken markup is
read as far as it goes (what is left open ends with its parent); a page without any
line over the threshold counts as one region; repeated rows give repeated results; an
empty table gives no rows; other columns are kept and a column named like the output
is replaced.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FED_AT_ONCE = 65_536

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " title tr ul".split()
)
#: Elements that may be the article, or hold it.
SECTIONS = frozenset("article body div html main section table td".split())
ARTICLES = frozenset(("article", "main"))
PAGES = frozenset(("page", "html", "body"))
#: Never part of an article, with all they hold.
DROPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style svg"
    " template textarea title".split()
)
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted"
    " related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
DROPPED_ROLES = frozenset(
    "alert banner complementary contentinfo dialog menu menubar navigation search".split()
)
#: Parts of a class that say where or whether something is; such a class names no element.
MODIFIER_FIRST = frozenset("has with without no is".split())
MODIFIER_LAST = frozenset("left right open closed enabled disabled on off none".split())
#: Never dropped by class or id.
KEPT = frozenset("article body html main".split())
#: What readers add may be longer than the article; it is dropped by name unless there is nothing else.
READERS = frozenset("comment comments disqus replies".split())
UNSEEN = 2
#: A paragraph ends where one of these begins.
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("article aside body div footer form header main nav ol section table ul dl".split())

#: Lines to each side that smoothing reaches, and its standard deviation, in lines.
REACH, SIGMA = 2, 1.0

_NAME_PARTS = re.compile(r"[^0-9a-z]+|(?<=[a-z])(?=[0-9])")


class PageLines(HTMLParser):
    """Lines of a page: text, tags, the section they are in, and whether they are dropped."""

    def __init__(self, inline_names: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self._inline_names = inline_names
        # Elements dropped by name: the one each is in, and whether readers' text; the one of each line.
        self.named_in: list[int] = [-1]
        self.readers: list[bool] = [False]
        self.named: list[int] = []
        self.unseen_by_name = 0
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.sections: list[int] = []
        self.dropped: list[bool] = []
        self.parents: list[int] = [-1]
        self.names: list[str] = ["page"]
        # Name, whether it is dropped (inside of a line without ending it: UNSEEN), section, element dropped by name.
        self._open: list[tuple[str, int, int, int]] = [("page", 0, 0, 0)]
        self._data: list[str] = []
        self._n_tags = 0

    def _end_line(self) -> None:
        if self._data:
            text = " ".join("".join(self._data).split())
            self._data.clear()
            if text:
                _, dropped, section, named = self._open[-1]
                self.named.append(max(named, 0))
                self.texts.append(text)
                self.tags.append(self._n_tags)
                self.sections.append(section)
                self.dropped.append(dropped > 0)
                self._n_tags = 0

    def _close(self, names: tuple[str, ...], within: frozenset = frozenset()) -> None:
        """End the innermost open element of such a name, unless one of `within` is opened inside it."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k][0]
            if name in names:
                del self._open[k:]
                return
            if name in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            if tag in ENDS_PARAGRAPH:
                self._close(("p",), SCOPES)
            if tag in ENDS_LIKE:
                self._close(ENDS_LIKE[tag], SCOPES)
        self._n_tags += 1
        if tag == "br":
            self._data.append(" ")
        if tag in VOID:
            return
        _, dropped, section, named = self._open[-1]
        if not dropped:
            if tag in DROPPED or attrs and _marked_dropped(attrs) or tag == "header" and not self._in_article():
                dropped = 1 if tag in BLOCKS else UNSEEN
            elif attrs and tag not in KEPT and (names := _dropping_names(attrs)):
                if tag in BLOCKS:
                    self.named_in.append(named)
                    self.readers.append(not READERS.isdisjoint(names))
                    named = len(self.named_in) - 1
                elif self._inline_names:
                    dropped, named = UNSEEN, named or -1
        if tag in SECTIONS:
            self.parents.append(section)
            self.names.append(tag)
            section = len(self.names) - 1
        self._open.append((tag, dropped, section, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._n_tags += 1
        if tag in BLOCKS:
            self._end_line()
        if tag == "br":
            self._data.append(" ")
        if tag not in VOID:
            self._close((tag,), frozenset() if tag in SCOPES else SCOPES)

    def handle_data(self, data: str) -> None:
        if self._open[-1][1] != UNSEEN:
            self._data.append(data)
        elif self._open[-1][3] < 0:
            self.unseen_by_name += len(data.strip())

    def _in_article(self) -> bool:
        return any(name in ARTICLES for name, *_ in self._open)

    def finish(self) -> None:
        self.close()
        self._end_line()


def _marked_dropped(attrs: list) -> bool:
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
        elif name == "role" and value.lower() in DROPPED_ROLES or name == "aria-hidden" and value == "true":
            return True
    return False


def _dropping_names(attrs: list) -> set[str]:
    """The parts of class and id for which an element is dropped."""
    found: set[str] = set()
    sided: set[str] = set()
    others = False
    for name, value in attrs:
        if value and name in ("class", "id"):
            for word in value.lower().split():
                parts = [p for p in _NAME_PARTS.split(word) if p]
                if not parts or parts[0] in MODIFIER_FIRST or not MODIFIER_FIRST.isdisjoint(parts[1:-1]):
                    others = True
                elif parts[-1] in MODIFIER_LAST:
                    sided |= DROPPED_NAMES.intersection(parts)
                else:
                    others = True
                    found |= DROPPED_NAMES.intersection(parts)
    # A name with a side is a modifier beside other names, and the element's own name without.
    return found if others else sided


def dropped_lines(lines: PageLines) -> np.ndarray:
    """Which lines are dropped: by tag or role, or by the name of an element that doesn't hold most region text."""
    dropped, named = np.array(lines.dropped, bool), np.array(lines.named, int)
    if dropped.all() or not named.any():
        return dropped
    lengths = np.array([len(t) for t in lines.texts])
    chosen = region_lines(lengths, np.array(lines.tags), dropped)
    held = np.bincount(named, np.where(chosen, lengths, 0), len(lines.named_in))
    for element in range(len(held) - 1, 0, -1):  # an element comes before those in it
        held[lines.named_in[element]] += held[element]
    gone = np.zeros(len(held), bool)
    for element in range(1, len(held)):
        most = held[element] >= held[0] if lines.readers[element] else held[element] > held[0] / 2
        gone[element] = gone[lines.named_in[element]] or not most
    return dropped | gone[named]


def smoothed(ratios: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights beyond the ends are left out and the rest scaled up."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.concatenate([np.zeros(reach), ratios, np.zeros(reach)])
    inside = np.concatenate([np.zeros(reach), np.ones(len(ratios)), np.zeros(reach)])
    return np.convolve(padded, kernel, "valid") / np.convolve(inside, kernel, "valid")


def region_lines(lengths: np.ndarray, tags: np.ndarray, dropped: np.ndarray) -> np.ndarray:
    """Which lines are in content regions: smoothed ratio over its standard deviation."""
    ratios = np.where(dropped, 0.0, lengths / np.maximum(tags, 1))
    smooth = smoothed(ratios)
    over = (smooth >= smooth.std()) & ~dropped
    return over if over.any() else ~dropped


def core_lines(lengths: np.ndarray, tags: np.ndarray, dropped: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The lines of regions that are over the threshold by themselves, not only by those beside them."""
    ratios = np.where(dropped, 0.0, lengths / np.maximum(tags, 1))
    core = chosen & (ratios >= smoothed(ratios).std())
    return core if core.any() else chosen


def _common(parents: list[int], one: int, two: int) -> int:
    """The lowest section that holds both; a parent comes before its sections."""
    while one != two:
        if one > two:
            one = parents[one]
        else:
            two = parents[two]
    return one


def article_of(lines: PageLines, weights: np.ndarray, core: np.ndarray) -> int:
    """The section that is the article: a marked one with the most text in regions, or the lowest that holds all cores."""
    total = [0.0] * len(lines.names)
    for section, weight in zip(lines.sections, weights.tolist()):
        total[section] += weight
    for section in range(len(total) - 1, 0, -1):  # a parent comes before its sections
        total[lines.parents[section]] += total[section]

    def inside_marked(section: int) -> bool:
        while (section := lines.parents[section]) >= 0:
            if lines.names[section] in ARTICLES:
                return True
        return False

    marked = [s for s, n in enumerate(lines.names) if n in ARTICLES and total[s] > 0 and not inside_marked(s)]
    if marked:
        return max(marked, key=lambda s: (total[s], -s))
    own = [lines.sections[i] for i in np.flatnonzero(core)]
    best = own[0]
    for section in own[1:]:
        best = _common(lines.parents, best, section)
    return best


def kept_lines(lines: PageLines, article: int, chosen: np.ndarray, core: np.ndarray) -> list[bool]:
    """The lines of the article; of a whole page those of its parts that hold a core, and what is between or in a region."""
    # For each section the one directly in the article that it is in; the article itself is -1, others None.
    part: list[int | None] = [None] * len(lines.names)
    for section, parent in enumerate(lines.parents):
        if section == article:
            part[section] = -1
        elif parent >= 0 and part[parent] is not None:
            part[section] = section if part[parent] == -1 else part[parent]
    inside = [part[section] is not None for section in lines.sections]
    if lines.names[article] not in PAGES:
        return inside
    at = np.flatnonzero(core)
    with_core = {part[lines.sections[i]] for i in at} | {-1}
    first, last = at[0], at[-1]
    return [
        here and (bool(chosen[i]) or first <= i <= last or part[lines.sections[i]] in with_core) for i, here in enumerate(inside)
    ]


def _lines_of(html: str, inline_names: bool = True) -> PageLines:
    lines = PageLines(inline_names)
    for at in range(0, len(html), FED_AT_ONCE):
        lines.feed(html[at : at + FED_AT_ONCE])
    lines.finish()
    return lines


def main_text(html: str | None) -> str:
    if not html:
        return ""
    lines = _lines_of(html)
    dropped = dropped_lines(lines)
    if lines.unseen_by_name > sum(len(t) for t, drop in zip(lines.texts, dropped) if not drop):
        # The page is in an element that ends no line, such as one of its own making.
        lines = _lines_of(html, inline_names=False)
        dropped = dropped_lines(lines)
    if dropped.all():
        return ""
    lengths, tags = np.array([len(t) for t in lines.texts]), np.array(lines.tags)
    chosen = region_lines(lengths, tags, dropped)
    core = core_lines(lengths, tags, dropped, chosen)
    kept = kept_lines(lines, article_of(lines, np.where(chosen, lengths, 0), core), chosen, core)
    return "\n".join(text for text, keep, drop in zip(lines.texts, kept, dropped) if keep and not drop)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The frame with the main text of each page as column `out`."""

    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page) for page in pages.to_pylist()], pa.string())

    return df.withColumn(out, F.arrow_udf(extracted, "string")(F.col(html)))
