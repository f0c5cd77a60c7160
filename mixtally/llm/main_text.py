"""Main text of web pages by block rules in two passes.

A page's markup is read as a stream of tags and text and cut into blocks. The first pass decides blocks by themselves: blocks inside
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and blocks that are mostly links, aren't the article;
long enough blocks with the density of stop words that running text has are. All others, headings and short or odd paragraphs, are
ambiguous: in the second pass they take the label of the nearest decided neighbour of their region, the article's where both are as
near or none is decided. A region is an article (or main) element, or the rest of the page; if a page has such an element with text,
what lies outside is no article. Stop words are those of the language that a page has most of; in other languages length alone counts.

The work is one row at a time and needs no shuffle: a page is read once, in time linear in its length, whatever its markup: unclosed
tags, comments or scripts, any depth of nesting, tags of any length. Null html is an empty text, like a page without blocks. Rows may
repeat; each gives its row. The key and url may be of any type. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import small_batches
from .divergence import COMMON_WORDS

#: Share of a block's characters in links from which on it is links; of a short block's.
LINKS, SHORT_LINKS = 0.5, 0.2
#: Share of stop words of running text, and characters of a block that is judged by it.
STOP_WORDS, LONG = 0.2, 70
#: Elements whose content is no text, and those of them whose content isn't markup either.
NO_TEXT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button".split())
RAW = frozenset("script style title textarea iframe".split())
#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the beginning of another ends, besides a paragraph, which any block ends.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
#: Elements that aren't the article, and the article itself.
ASIDE = frozenset("nav aside footer menu header form dialog".split())
ARTICLE = frozenset(["article", "main"])
#: Words in class, id or role that mark what isn't the article: whole words, beginnings of words, and words that say that it isn't there.
MARKS = frozenset(
    "ad ads adsense nav menu header masthead footer aside notice notices alert popup modal overlay banner promo share sharing social related login signup search widget toolbar topbar pager reply replies respond responses discussion "
    "complementary contentinfo dialog alertdialog form gdpr consent copyright".split()
)
MARK_BEGINNINGS = ("adsby", "advert", "breadcrumb", "comment", "cookie", "disqus", "navbar", "navigation", "newsletter", "pagination", "paywall", "recommend", "sidebar", "sponsor", "subscri")
ABSENT = frozenset("has no not with without".split())
#: Of these, inside an article, headings are kept; elsewhere nothing is.
HEADERS = frozenset("header masthead banner".split())
#: Share of stop words below which a page is in none of the known languages, so that stop words can't tell.
UNKNOWN = 0.02

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_MARKED = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+(?=[\s/>\"']|\Z)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_STOPS = [frozenset(words.split()) for words in COMMON_WORDS.values()]

GOOD, BAD, OPEN = 1, -1, 0


def _marks(name: str, rest: str) -> tuple[bool, bool]:
    """Whether a tag's attributes mark it as no article, and whether as a header of some kind."""
    bad = name in ASIDE
    head = name == "header"
    if not rest:
        return bad, head
    for m in _MARKED.finditer(rest):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True, False
        for token in value.split() if key in ("class", "id", "role") else ():
            words = [w.lower() for w in _WORD.findall(token)]
            found = [w for before, w in zip(["", *words], words) if before not in ABSENT and (w in MARKS or w.startswith(MARK_BEGINNINGS))]
            bad |= bool(found)
            head |= any(w in HEADERS for w in found)
    return bad, head


class Page:
    """A page's elements, parents first, and its blocks with the element that each stands in."""

    def __init__(self, markup: str):
        self.parent, self.name, self.bad, self.head = [-1], [""], [False], [False]
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.element: list[int] = []
        self._words: list[str] = []
        self._links = 0
        self._read(markup)

    def _block(self, element: int) -> None:
        """Ends the block that stands in the element."""
        if self._words:
            text = " ".join("".join(self._words).split())
            if text:
                self.texts.append(text)
                self.linked.append(self._links)
                self.element.append(element)
        self._words, self._links = [], 0

    def _read(self, markup: str) -> None:
        stack, opened = [0], {}
        silent, breaks = 0, 0
        link, firm = False, False  # in a link; and in one whose end comes before the next begins
        ends = iter(_LINK.finditer(markup))
        tag = next(ends, None)  # the first link tag not yet passed
        at, end = 0, len(markup)

        def text(raw: str) -> None:
            nonlocal breaks
            if silent or not raw:
                return
            plain = references.unescape(raw) if "&" in raw else raw
            self._words.append(plain)
            if not plain.isspace():
                breaks = 0
                if link:
                    self._links += len("".join(plain.split()))

        def close(name: str) -> None:
            """Ends the element, and those still open inside it."""
            nonlocal silent
            self._block(stack[-1])
            while opened.get(name):
                own = self.name[stack.pop()]
                opened[own] -= 1
                silent -= own in NO_TEXT
                if own == name:
                    return

        while at < end:
            start = markup.find("<", at)
            if start < 0:
                text(markup[at:])
                break
            m = _TOKEN.match(markup, start)
            if m is None:
                text(markup[at : start + 1])
                at = start + 1
                continue
            text(markup[at:start])
            at = m.end()
            name = (m[2] or "").lower()
            if name == "a":
                link = not m[1]
                while tag is not None and tag.start() < at:
                    tag = next(ends, None)
                firm = tag is not None and bool(tag[1])
            elif name == "br":
                breaks += 1
                self._words.append(" ")
                if breaks == 2:
                    self._block(stack[-1])
            elif name == "hr":
                self._block(stack[-1])
            elif name in BLOCKS or name in NO_TEXT:
                if m[1]:
                    close(name)
                    continue
                if m[3].endswith("/") and name in ("svg", "math"):
                    continue
                if name in BLOCKS:
                    link = link and firm
                    self._block(stack[-1])
                    if self.name[stack[-1]] == "p":
                        close("p")
                    while self.name[stack[-1]] in ENDED_BY.get(name, ()):
                        close(self.name[stack[-1]])
                bad, head = _marks(name, m[3])
                self.parent.append(stack[-1])
                self.name.append(name)
                self.bad.append(bad)
                self.head.append(head)
                stack.append(len(self.name) - 1)
                opened[name] = opened.get(name, 0) + 1
                silent += name in NO_TEXT
                breaks = 0
                if name in RAW:
                    over = re.compile(f"</{name}(?=[\\s/>])", re.I).search(markup, at)
                    at = over.start() if over else end
        self._block(stack[-1])

    def places(self) -> tuple[list[bool], list[int]]:
        """For each element: whether it lies in something that isn't the article, and in which article (0: none)."""
        n = len(self.name)
        has_article = [name == "article" and not bad for name, bad in zip(self.name, self.bad)]
        size = [0] * n
        for e, text in zip(self.element, self.texts):
            size[e] += len(text)
        for e in range(n - 1, 0, -1):
            has_article[self.parent[e]] |= has_article[e]
            size[self.parent[e]] += size[e]
        # The page's own article is the unmarked one with most text; without one, what holds the first heading is taken for it. A
        # marked wrapper of the page's own article isn't what its mark says.
        own = max((e for e in range(1, n) if self.name[e] in ARTICLE and not self.bad[e]), key=lambda e: (size[e], self.name[e] == "article"), default=0)
        wrapper = [False] * n
        if own:
            while own:
                wrapper[own] = True
                own = self.parent[own]
        else:
            own = next((e for e in range(1, n) if self.name[e] == "h1"), 0)
            while own and not self.head[own] and self.name[own] not in ASIDE:
                wrapper[own] = True
                own = self.parent[own]
        outside, region = [0] * n, [0] * n  # outside: 0 no, 1 yes, 2 in an article's own header
        for e in range(1, n):
            p, name = self.parent[e], self.name[e]
            outside[e], region[e] = outside[p], region[p]
            if outside[p] == 1:
                continue
            marked = self.bad[e] and not wrapper[e] and name not in ("html", "body")
            if outside[p] == 2 and name in HEADINGS:
                outside[e] = 0
            elif marked and not (self.head[e] and name in HEADINGS):
                outside[e] = 2 if self.head[e] and region[p] else 1
            elif not region[p] and not self.bad[e] and (name == "article" or name == "main" and not has_article[e]):
                region[e] = e
        return [o > 0 for o in outside], region


def stop_words(blocks: list[list[str]]) -> frozenset[str] | None:
    """The stop words of the language whose stop words the blocks hold most of; none if they hold next to none."""
    found = [sum(sum(map(stops.__contains__, words)) for words in blocks) for stops in _STOPS]
    best = max(range(len(_STOPS)), key=found.__getitem__)
    return _STOPS[best] if found[best] > UNKNOWN * sum(map(len, blocks)) else None


def decided(text: str, words: list[str], linked: int, stops: frozenset[str] | None) -> int:
    """First pass: a block's label by its own length, links and stop words."""
    share = linked / max(1, len(text) - text.count(" "))
    if share > LINKS or share > SHORT_LINKS and len(text) < LONG:
        return BAD
    if len(text) < LONG:
        return OPEN
    return GOOD if stops is None or sum(map(stops.__contains__, words)) >= STOP_WORDS * max(1, len(words)) else OPEN


def inherited(labels: list[int]) -> list[int]:
    """Second pass: open blocks take the label of the nearest decided one, the good one's if both are as near; good if there is none."""
    known = [i for i, label in enumerate(labels) if label != OPEN]
    if not known:
        return [GOOD] * len(labels)
    out, after = list(labels), 0
    for i, label in enumerate(labels):
        if label != OPEN:
            after += 1
            continue
        near = known[max(0, after - 1) : after + 1]
        least = min(abs(i - k) for k in near)
        out[i] = max(labels[k] for k in near if abs(i - k) == least)
    return out


def main_text(markup: str | None) -> str:
    """The article of a page, its blocks joined by empty lines."""
    if not markup:
        return ""
    page = Page(markup)
    outside, region = page.places()
    regions: dict[int, list[int]] = {}
    for i, e in enumerate(page.element):
        if not outside[e]:
            regions.setdefault(region[e], []).append(i)
    if any(regions):
        regions.pop(0, None)
    words = {i: _LETTERS.findall(page.texts[i].lower()) for own in regions.values() for i in own}
    stops = stop_words(list(words.values()))
    keep: list[int] = []
    for own in regions.values():
        labels = inherited([decided(page.texts[i], words[i], page.linked[i], stops) for i in own])
        keep += [i for i, label in zip(own, labels) if label == GOOD]
    return "\n\n".join(page.texts[i] for i in sorted(keep))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page."""
    kinds = dict(pages.dtypes)
    schema = f"k {kinds[key]}, u {kinds[url]}, text string, n_chars long"  # Spark can't pass names with dots to Arrow functions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(*(F.col(f"`{c}`").alias(n) for c, n in ((key, "k"), (url, "u"), (html, "h")))).mapInArrow(run, schema).toDF(key, url, "text", "n_chars")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP11_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs'), '<article>(.*?)(</article>|$)', 1, 's') AS h FROM pages),
b AS (SELECT page_id, unnest(regexp_split_to_array(h, '</?(p|h1|h2|h3|ul|li|div|blockquote)>')) AS t, generate_subscripts(regexp_split_to_array(h, '</?(p|h1|h2|h3|ul|li|div|blockquote)>'), 1) AS i FROM a),
c AS (SELECT page_id, i, trim(regexp_replace(html_unescape, '\s+', ' ', 'g')) AS t FROM (
  SELECT page_id, i, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]*(>|$)', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g') AS html_unescape FROM b)),
t AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY page_id)
SELECT pages.page_id, pages.url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN t USING (page_id)
"""
