"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. Lines of menus, headers, footers, sidebars, notices, adverts,
forms and comments are left out beforehand, by their element or by a class, id or role that says nothing else.
Every other line has a weight, and the weights' sums over a sliding window of lines decide on every page: where a sum
surges over a threshold, dense text begins, and where it dives to nothing, it ends. The lines between are the text, and
neighbours with a weight of their own belong to it.

A line weighs as much as it has characters outside links; a whole sentence inside a link weighs too. Markup settles what
density leaves open: the characters of a marked article weigh more, and if it holds a tenth of the text, only its
lines of the dense stretches stay. Without a marked article, a run of bare labels at either end of the text is a menu, and
what follows a line that announces comments is the readers'. A class word doesn't set aside what holds most of a page's text
where nothing else is marked as its article.

A null page and a page without text give an empty text; if no sum surges, all lines with a weight are the text.
Pages are independent of each other; repeated pages give repeated rows; columns other than the kept ones play
no part. The work is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Lines in a window, the window sum at which the text begins, and how often a marked article's characters count.
WINDOW, SURGE, MARKED = 3, 86, 4

# Elements by their role.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ASIDE = {"nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "audio", "video", "object", "dialog", "menu", "search", "math", "map", "datalist"}
_NEVER = {"html", "body", "main", *_HEADINGS, "b", "i", "em", "strong", "tr", "td", "th"}
#: Words of class, id or role that mark what isn't the article, ...
_MARKS = set(
    "ad ads adbox adsbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menubar topbar toolbar header masthead footer contentinfo sidebar side aside complementary rail "
    "widget widgets comment comments commentlist reply replies respond disqus discussion related recommended recommendations share sharing social breadcrumb breadcrumbs "
    "pagination pager copyright disclaimer search paywall trending popular".split()
)
#: ... and those that may stand beside them: a name with any other word (ad-hoc, social-science) marks nothing.
_PLAIN = set(
    "site page main global top bottom left right upper lower primary secondary first last post posts entry article story blog section block box area zone slot unit module list items item "
    "container wrapper wrap inner outer content body row col column bar strip panel group buttons button icons icon links link text title form field fields input label thread tree count "
    "wp js id el css google dfp policy law eu message messages media network networks follow us tools actions options toggle mobile desktop small large fixed sticky bg img image".split()
)
_COMMENTS = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "discussion"}
_TITLES = {"header", "masthead", "banner"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_ROLE_MAIN = re.compile(r"""role\s*=\s*["']?(?:main|article)\b|itemprop\s*=\s*["']?articleBody""", re.I)
_WORDS = re.compile(r"[a-z]+")


def _marks(name: str, attrs: str) -> set[str]:
    """The words by which an element's class, id or role says that it isn't the article."""
    if not attrs or name in _NEVER:
        return set()
    out: set[str] = set()
    for m in _MARKED.finditer(attrs):
        for value in m[1].strip("\"'").split():
            words = {w for w in _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) if len(w) > 1}
            if words & _MARKS and words <= _MARKS | _PLAIN:
                out |= words & _MARKS
    return out


#: A line that announces readers' comments, the end of a sentence, and labels in a row that are a menu.
_ANNOUNCED = re.compile(r"(?:\d+\s+|leave\s+(?:a|your)\s+|post\s+a\s+|add\s+a\s+|all\s+|read\s+)?(?:comments?|repl(?:y|ies)|responses?)(?:\s*\(\d+\))?:?", re.I)
_SENTENCE = re.compile(r"[.!?\u2026:;][\"'\u201d\u2019\u00bb)\]]*$")
MENU = 4

#: A line is set aside by no region, by its element for good, or by the class of region 1, 2, ...
_NONE, _GONE = 0, -1


class _Lines:
    """The lines of a page: text, characters outside and inside links, whether inside a marked article, region, whether a heading."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        # open elements: name, region, article, link, header inside an article; how many of a name; where the blocks are
        self.open: list[tuple[str, int, bool, bool, bool]] = []
        self.count: Counter = Counter()
        self.blocks: list[int] = []
        self.regions: list[set[str]] = [set()]
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            self._text(page[at : m.start() if m else n])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name)
                continue
            attrs = m[3] if m[2] else m[6]
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            self._start(name, attrs)
        self._line()

    def _state(self) -> tuple[str, int, bool, bool, bool]:
        return self.open[-1] if self.open else ("", _NONE, False, False, False)

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self._state()[3]:
            self.linked += len("".join(text.split()))

    def _line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, region, article, _, heading_only = self._state()
            heading = any(self.count[h] for h in _HEADINGS)
            if heading_only and not heading:
                region = _GONE
            full = len(text) - text.count(" ")
            self.lines.append((text, max(0, full - self.linked), min(full, self.linked), article, region, heading))
        self.parts, self.linked = [], 0

    def _cut(self, k: int) -> None:
        """Close the elements from place k on."""
        for x in self.open[k:]:
            self.count[x[0]] -= 1
        del self.open[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def _start(self, name: str, attrs: str) -> None:
        if name in _BLOCK:
            self._line()
            if self.blocks:  # an open paragraph ends where a block begins
                inner = self.open[self.blocks[-1]][0]
                if inner == "p" or inner == name == "li":
                    self._cut(self.blocks[-1])
        elif name in ("br", "td", "th"):
            self.parts.append(" ")
        if name in _VOID:
            return
        _, region, article, link, heading_only = self._state()
        if region == _NONE:
            marks = _marks(name, attrs)
            if name in _ASIDE or name == "header" and not article or attrs and name not in _NEVER and _HIDDEN.search(attrs):
                region = _GONE
            elif marks and article and marks <= _TITLES:
                heading_only = True
            elif marks:
                region = len(self.regions)
                self.regions.append(marks)
            if region and name not in _BLOCK:
                self._line()
        if region == _NONE and (name in ("article", "main") or attrs and _ROLE_MAIN.search(attrs)):
            article = True
        if name in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((name, region, article, link or name == "a", heading_only or name == "header" and article))
        self.count[name] += 1

    def _close(self, name: str) -> None:
        if name in _BLOCK:
            self._line()
        if not self.count[name]:
            return
        k = len(self.open) - 1
        while self.open[k][0] != name:
            k -= 1
        if self.open[k][1] and name not in _BLOCK:
            self._line()
        self._cut(k)


def between(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines are text: those from a window whose sum surges until one whose sum is nothing, without lines of no
    weight at both ends, and with neighbours of some weight. Without a surge: all lines with a weight."""
    n, keep = len(weights), [False] * len(weights)
    sums, i = [sum(weights[k : k + window]) for k in range(n)], 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        start = i
        while not weights[start]:
            start += 1
        while i < n and sums[i]:  # until the dive
            i += 1
        end = min(i, n)
        while not weights[end - 1]:
            end -= 1
        while start and weights[start - 1] and not keep[start - 1]:
            start -= 1
        keep[start:end] = [True] * (end - start)
    return keep if any(keep) else [w > 0 for w in weights]


def _label(text: str) -> bool:
    return len(text.split()) <= 4 and not _SENTENCE.search(text)


def _trimmed(lines: list[tuple], keep: list[bool], surge: int) -> list[bool]:
    """Of a page without a marked article: without announced comments, and without menus of bare labels at the ends."""
    places = [i for i, k in enumerate(keep) if k]
    sizes = 0
    for n, i in enumerate(places):
        if sizes >= surge and _ANNOUNCED.fullmatch(lines[i][0]):
            places = places[:n]
            break
        sizes += lines[i][1]
    for side in (1, -1):
        ends, labels = places[::side], 0
        while labels < len(ends) and not lines[ends[labels]][5] and _label(lines[ends[labels]][0]):
            labels += 1
        if MENU <= labels < len(ends):
            places = ends[labels:][::side]
    out = [False] * len(keep)
    for i in places:
        out[i] = True
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page; blocks are joined by an empty line."""
    found = _Lines(page or "")
    lines = found.lines
    marked = sum(x[1] for x in lines if x[3] and x[4] == _NONE)
    by_region, total = Counter(), 0
    for _, own, _, _, region, _ in lines:
        if region != _GONE:
            by_region[region] += own
            total += own
    # a class word doesn't set aside most of a page's text
    pardoned = {_NONE, *(r for r, own in by_region.items() if r and not marked and own >= surge and 3 * own >= 2 * total and not found.regions[r] & _COMMENTS)}
    lines = [x for x in lines if x[4] in pardoned]
    all_own = sum(x[1] for x in lines)
    if marked and (2 * marked >= all_own or marked >= surge and 10 * marked >= all_own):
        # density decides where text stands, the mark which of it is the article
        keep = between([MARKED * (own + linked) if article else own for _, own, linked, article, _, _ in lines], window, surge)
        keep = [k and x[3] for k, x in zip(keep, lines, strict=True)]
        if not any(keep):
            keep = [x[3] and x[1] + x[2] > 0 for x in lines]
    else:
        keep = between([own + (linked if linked and len(text.split()) > 5 and _SENTENCE.search(text) else 0) for text, own, linked, _, _, _ in lines], window, surge)
        keep = _trimmed(lines, keep, surge)
    return "\n\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k)


def extract_text(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Main text of every whole page: per row ``keep`` and ``text, n_chars`` (code points). No shuffle."""

    def scan():
        def run(column: pa.Array) -> list:
            texts = [main_text(x.as_py(), window, surge) for x in column]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

        return run

    return map_texts(df, page, list(keep), "text string, n_chars long", scan)
