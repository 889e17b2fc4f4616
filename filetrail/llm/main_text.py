"""Main text of web pages: parser events to lines, text-to-tag ratios, smoothing, and the regions that hold the content lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
REGIONS = frozenset("article body center div dl fieldset figure main section table td".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer head header iframe math menu nav noembed noframes noscript object script "
    "search select style svg template textarea title video".split())
# An element whose class, id or role has one of these words is no part of the article.
NAMED_DROPPED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget related recommended share "
    "sharing social comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login search pagination pager toolbar".split())
NEGATED = frozenset("has with no without".split())  # "has-sidebar" says what is beside an element, not what it is
ARTICLE_NAMES = frozenset("main articlebody".split())
# A start tag that ends an open element of these kinds, unless one of the limits lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
}
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLANKS = re.compile("[ \t\n\r\f\x0b]+")
UNFINISHED = re.compile("</?[A-Za-z]")
BY_FORM, BY_KIND = 1, 2
DEPTH = 512


class Lines(HTMLParser):
    """Events of one page as lines: a line ends where a block begins or ends, and counts the tags since the line before.

    A line is its text, its tags, whether it has text outside of dropped elements, its innermost region and the outermost article (or
    main part) that holds it, or 0. Text of dropped elements leaves lines without text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int]] = []  # name, why it is dropped, its region, its article
        self.open: Counter[str] = Counter()
        self.parent = [-1]  # the region around each region; region 0 is the page
        self.kinds = [""]
        self.text: list[str] = []
        self.left_out = False
        self.tags = 0
        self.lines: list[tuple[str, int, bool, int, int]] = []

    def top(self) -> tuple[int, int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0, 0)

    def end_line(self) -> None:
        _, region, article = self.top()
        text = BLANKS.sub(" ", "".join(self.text)).strip(" ")
        if text or self.left_out:
            self.lines.append((text, max(self.tags, 1), bool(text), region, article))
            self.tags = 0
        self.text.clear()
        self.left_out = False

    def pop_to(self, depth: int) -> None:
        for name, *_ in self.stack[depth:]:
            self.open[name] -= 1
        del self.stack[depth:]

    def close_implied(self, tag: str) -> None:
        kinds, limits = IMPLIED.get(tag, ({"p"}, {"button", "td", "th", "caption", "table", "article", "section", "div"}))
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if name in kinds:
                self.pop_to(depth)
                if tag not in IMPLIED or name == tag:
                    return
            elif name in limits:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in VOID or (tag in ("html", "body", "head") and self.open[tag]):
            return
        if tag in BLOCKS and (tag in IMPLIED and any(self.open[k] for k in IMPLIED[tag][0]) or tag not in IMPLIED and self.open["p"]):
            self.close_implied(tag)
        dropped, region, article = self.top()
        if tag == "body" and self.open["head"]:
            dropped = 0
        words = {w.lower() for key, value in attrs if key in ("class", "id", "role", "itemprop") and value for w in WORD.findall(value)}
        joined = {(value or "").lower() for key, value in attrs if key in ("role", "itemprop")}
        starts = tag in ("article", "main") or bool(joined & ARTICLE_NAMES)
        if starts and dropped == BY_FORM:
            dropped = 0  # a form around the whole page
        if tag == "article" and article and self.kinds[article] == "article":
            dropped = BY_KIND  # an article inside an article is a reader's comment
        elif tag in DROPPED or (tag not in ("html", "body") and not starts and words & NAMED_DROPPED and not words & NEGATED):
            dropped = BY_KIND
        elif tag == "form" and not dropped:
            dropped = BY_FORM
        if (tag in REGIONS or starts) and not dropped:
            self.parent.append(region)
            self.kinds.append("article" if tag == "article" else "main" if starts else tag)
            region = len(self.parent) - 1
            if starts and (not article or self.kinds[article] != "article"):
                article = region
        if len(self.stack) < DEPTH or tag in BLOCKS:
            self.stack.append((tag, dropped, region, article))
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element of HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        if tag == "br":
            self.text.append(" ")
        self.tags += 1
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth][0]
            if name == tag:
                if tag in BLOCKS or depth == len(self.stack) - 1:
                    self.pop_to(depth)
                else:
                    self.open[tag] -= 1
                    del self.stack[depth]
                return
            if tag not in BLOCKS and tag not in DROPPED and name in BLOCKS:
                return  # an inline element does not end the block that began inside it

    def handle_data(self, data: str) -> None:
        if self.top()[0]:
            self.left_out = True
        else:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Ratios after a Gaussian filter over neighbouring lines; at both ends of the page the weights left are scaled up."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius:radius + len(ratios)] / weights


def content(lines: list[tuple[str, int, bool, int, int]], parent: list[int], kinds: list[str], sigma: float = 1.0) -> list[str]:
    """Texts of the lines that belong to content regions.

    Lines in dropped elements have ratio 0. A line is content when its smoothed ratio reaches the threshold, the standard deviation over
    the page; a region needs a line that reaches it unsmoothed too, so that a long neighbour does not lift a menu. Candidates are the page's articles; failing those, its main parts; failing those, the innermost regions. All kept lines of a
    candidate with a content line belong to the text, short ones too; when no candidate has one, those of the candidate with the highest ratio do.
    """
    if not lines:
        return []
    ratios = np.array([len(text) / tags if kept else 0.0 for text, tags, kept, _, _ in lines])
    level = smoothed(ratios, sigma)
    threshold = level.std()
    rising = level >= threshold
    choices: dict[int, list[int]] = {}
    for kind in ("article", "main", None):
        for i, (_, _, kept, region, article) in enumerate(lines):
            if kept and (kind is None or article and kinds[article] == kind):
                choices.setdefault(article if kind else region, []).append(i)
        if choices:
            break
    if not choices:
        return []
    chosen = {r for r, rows in choices.items() if rising[rows].any() and ratios[rows].max() >= threshold}
    if not chosen:
        chosen = {max(choices, key=lambda r: (level[choices[r]].max(), -r))}
    if kind is not None:
        return [lines[i][0] for r in sorted(chosen) for i in choices[r]]
    chosen_in: dict[int, bool] = {}
    for r in range(len(parent)):  # a region comes after the one around it
        chosen_in[r] = r in chosen or (kinds[parent[r]] not in ("", "body") and chosen_in[parent[r]] if r else False)
    return [text for text, _, kept, region, _ in lines if kept and chosen_in[region]]


def main_text(html: str, sigma: float = 1.0) -> str:
    parser = Lines()
    parser.feed(html)
    if UNFINISHED.match(parser.rawdata):
        parser.rawdata = ""  # the page ends inside a tag
    parser.close()
    parser.end_line()
    return "\n\n".join(content(parser.lines, parser.parent, parser.kinds, sigma))


def extract(pages: DataFrame, sigma: float = 1.0, batch_chars: int = 4 << 20) -> DataFrame:
    """page_id, url, text, n_chars: the article of each page, whole.

    The standard library's parser streams the events of a page; lines are the blocks. Menus, headers, footers, sidebars, notices, adverts,
    forms, scripts, styles and comments go by element, or by words of class, id and role. Text-to-tag ratios of the lines, smoothed with a Gaussian,
    are clustered by a threshold, and regions with lines above it are the content (`content`). Character references are decoded, white space in a
    block is one space, blocks are joined by two line ends in page order.
    Null and empty pages, and pages without a content line, give the empty text. Pages may be broken in any way: unclosed elements end where HTML lets them
    end. Repeated rows are pages of their own; other columns are ignored; an empty table gives no row. A page is one row
    from the start, so memory is that of a page and of output batches of `batch_chars` characters. Nothing is shuffled.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, urls: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        for batch in batches:
            ids, urls, texts, chars = [], [], [], 0
            for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids.append(page.as_py())
                urls.append(url.as_py())
                texts.append(main_text(html.as_py() or "", sigma))
                chars += len(texts[-1])
                if chars > batch_chars:
                    yield made(ids, urls, texts)
                    ids, urls, texts, chars = [], [], [], 0
            yield made(ids, urls, texts)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)
