"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a text line for each block element, and blank lines where containers open or close
between them, as in a page that has each container tag on a line of its own. Navigation, page headers, footers, asides,
forms, adverts, notices and comments lose their text and leave `window` blank lines. A line
weighs the length of its text, or nothing if most of it is link text. The weights of `window` lines from each line on
give the distribution: a run surges where the sum passes `surge` and dives where it is zero again, and the
text between these points is kept.

<article> and <main> are evidence that the distribution weighs: if the surging runs hold at least as much text inside
such landmarks as outside, the landmarks in which text surges are kept whole, with their short titles and last
lines, and the runs outside go; else (cards of an article each around the text) the runs decide alone. Where no
run surges, the landmarks are kept, and without any the run of the most text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, table

# Element names of the HTML standard.
RAW = frozenset("script style noscript template textarea select iframe svg object title canvas audio video annotation annotation-xml".split())
INLINE = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption option summary address hr br html body".split())
DROPPED = frozenset("nav header footer aside form button dialog menu fieldset head".split())
LANDMARKS = frozenset("article main".split())
CLOSED_BY_ITSELF = frozenset("p li tr td th dt dd option".split())
# Class, id and role names that mark what is not the article; a name of several parts counts if each part is one of these or says where or what kind of box.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus menubar breadcrumb breadcrumbs "
    "sidebar sidebars rail aside complementary footer footers contentinfo header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist disqus respond reply replies related recommended widget widgets toolbar pagination pager search copyright skip".split()
)
BOXES = frozenset("site page main top bottom left right side list box bar container wrapper wrap block item items area section inner outer content global primary secondary links link buttons button posts articles stories message thread form field module unit slot".split())
NO_ID = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre".split())  # an id on these is an anchor

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_END_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class Line:
    """A line of the stripped page; landmark is the number of the outermost one around it (0: none), linked the length of its link text."""

    text: str
    landmark: int
    linked: int


def _boilerplate(name: str) -> bool:
    parts = [x for x in re.split(r"[_-]+", name) if x and not x.isdigit()]
    return any(x in NOT_ARTICLE for x in parts) and all(x in NOT_ARTICLE or x in BOXES for x in parts)


def _unwanted(name: str, attrs: str, in_landmark: bool) -> bool:
    if name in DROPPED and not (name == "header" and in_landmark):
        return True
    if not attrs or name in ("html", "body") or name in LANDMARKS:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
            return True
        if key in ("class", "role") or key == "id" and name not in NO_ID:
            if any(_boilerplate(w) for w in value.lower().split()):
                return True
    return False


class _Page:
    """Lines out of tags and texts; `stack` holds the open block elements that are kept."""

    def __init__(self, window: int):
        self.window, self.lines = window, []
        self.buf: list[str] = []
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.linked, self.in_link = 0, False
        self.landmark = self.landmarks = self.depth = 0
        self.skipped, self.inner = "", Counter()  # the dropped element and what is open in it

    def text(self, piece: str) -> None:
        if not self.skipped and piece:
            self.buf.append(piece)
            self.linked += len(piece) * self.in_link

    def flush(self) -> None:
        if self.buf:
            if text := " ".join(html_lib.unescape("".join(self.buf)).split()):
                self.lines.append(Line(text, self.landmark, self.linked))
            self.buf.clear()
        self.linked = 0

    def blank(self, n: int = 1) -> None:
        self.lines += [Line("", self.landmark, 0)] * n

    def leave(self, k: int) -> None:
        for name in self.stack[k:]:
            self.open[name] -= 1
            if name in LANDMARKS:
                self.depth -= 1
                self.landmark *= self.depth > 0
            if name not in TEXT_BLOCKS:
                self.blank()
        del self.stack[k:]
        self.in_link = False

    def skip(self, name: str) -> None:
        self.flush()
        self.blank(self.window)
        self.skipped = name
        self.inner.clear()

    def start(self, name: str, attrs: str) -> None:
        if self.skipped:
            if name == self.skipped and name in CLOSED_BY_ITSELF and not +self.inner:
                self.skipped = ""
            else:
                if name not in VOID and not attrs.endswith("/"):
                    self.inner[name] += 1
                return
        alone = name in VOID or attrs.endswith("/")
        if _unwanted(name, attrs, self.depth > 0):
            if not alone:
                self.skip(name)
            return
        if name in INLINE:
            self.in_link = self.in_link or name == "a" and not alone
            return
        if name == "br":
            self.buf.append(" ")
            return
        self.flush()
        if self.stack and (self.stack[-1] == "p" or self.stack[-1] == name and name in CLOSED_BY_ITSELF):
            self.leave(len(self.stack) - 1)
        if name in LANDMARKS and not alone:
            self.landmarks += self.depth == 0
            self.landmark = self.landmarks
            self.depth += 1
        if name not in TEXT_BLOCKS:
            self.blank()
        if not alone:
            self.stack.append(name)
            self.open[name] += 1

    def end(self, name: str) -> None:
        if self.skipped:
            if self.inner[name]:
                self.inner[name] -= 1
                return
            if name == self.skipped:
                self.skipped = ""
                return
            if not self.open[name]:
                return
            self.skipped = ""  # its parent ends
        if name in INLINE:
            self.in_link &= name != "a"
            return
        self.flush()
        if self.open[name]:
            k = len(self.stack) - 1
            while self.stack[k] != name:
                k -= 1
            self.leave(k)


def page_lines(html: str, window: int = 3) -> list[Line]:
    """The lines of a page; every character is looked at a bounded number of times."""
    page, at, last = _Page(window), 0, html.rfind(">")
    done = 0  # what is before has been given as text or markup
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at) or html.startswith("<![CDATA[", at):
            page.text(html[done:at])
            end = "-->" if html[at + 2] == "-" else "]]>"
            stop = html.find(end, at + 4)
            at = done = len(html) if stop < 0 else stop + 3
            continue
        if at > last:
            break
        if html[at + 1] in "!?":
            page.text(html[done:at])
            at = done = html.find(">", at) + 1
            continue
        m = _TAG.match(html, at)
        if not m:  # a sign of the text
            at += 1
            continue
        page.text(html[done:at])
        at = done = m.end()
        name = m[2].lower()
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = _END_RAW[name].search(html, at)
                at = done = end.end() if end else len(html)
            page.text(" ")
        elif m[1]:
            page.end(name)
        else:
            page.start(name, m[3])
    page.text(html[done:])
    page.flush()
    return page.lines


def main_text(html: str | None, window: int = 3, surge: int = 86) -> str:
    """The kept lines joined by one blank; empty where there is no text."""
    lines = page_lines(html or "", window)
    weights = [0 if x.linked * 2 > len(x.text) else len(x.text) for x in lines]
    total = [0, *accumulate(weights)]
    n = len(lines)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    runs, i = [], 0  # (first line, behind the last line, peak)
    while i < n:
        j = i
        while j < n and sums[j]:
            j += 1
        if j > i:
            runs.append((i, j, max(sums[i:j])))
        i = j + 1
    surging = [r for r in runs if r[2] > surge]
    inside, around = Counter(), 0
    for a, b, _ in surging:
        for k in range(a, b):
            if lines[k].landmark:
                inside[lines[k].landmark] += weights[k]
            else:
                around += weights[k]
    if any(x.landmark and x.text for x in lines) and inside.total() >= around:
        return " ".join(x.text for x in lines if x.text and x.landmark and (inside[x.landmark] or not surging))
    if not surging and runs:
        surging = [max(runs, key=lambda r: total[r[1]] - total[r[0]])]
    kept: list[str] = []
    for a, b, _ in surging:
        heavy = [k for k in range(a, b) if weights[k]]
        kept += [x.text for x in lines[heavy[0] : heavy[-1] + 1] if x.text]
    return " ".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: int = 86) -> DataFrame:
    """id, url, text, n_chars: the main text of each page, one row per input row.

    A null or empty page, or one without text, has an empty text. Where no run of lines surges,
    the longest run is kept. White space in a block is one blank; character references are
    decoded once. A `<` that begins no tag is text. Very long pages take a few linear passes; repeated rows are extracted again; a null
    id or url stays null; other columns are ignored. Ids are whole numbers, or texts of digits; others are an error.
    """
    types = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batch: pa.RecordBatch):
        for a, b in byte_slices(batch.column(2)):
            texts = [main_text(x, window, surge) for x in batch.column(2).slice(a, b - a).to_pylist()]
            yield {id_col: batch.column(0).slice(a, b - a), url_col: batch.column(1).slice(a, b - a), "text": texts, "n_chars": [len(x) for x in texts]}

    return arrow_map(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), html_col), rows, f"`{id_col}` bigint, `{url_col}` string, text string, n_chars bigint", types)


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
