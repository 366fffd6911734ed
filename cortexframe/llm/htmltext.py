"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, and lines belong to the
container they stand in (the innermost ``div``, ``section`` or the like; an article
as a whole).  A line weighs what its text outside links has of characters; where the
page's structure says that it is a menu, header, footer, sidebar, notice, advert, form
or comment it weighs nothing (by tags and roles) or little (by names), and outside the page's article, if there
is one, a quarter.  Weights are summed over sliding windows of a container's lines.
Text surges at the first container with a window of at least ``SHARE`` of the page's
highest sum and dives after the last one; what lies between is kept, but for light
containers that the structure marks or that are outside the page's article.
One pass, a page at a time.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructType

from .common import bounded_batches, frugal

WINDOW = 3
SHARE = 0.3
#: what is left of the weight of lines that nothing, names or tags and roles mark as furniture, and of lines outside the article
MARKED, OUTSIDE = (1.0, 0.001, 0.0), 0.25

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
FURNITURE = {"head", "nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "input", "label", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment",
    "comments", "respond", "replies", "disqus", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login", "related", "recommended",
    "pagination", "pager", "widget", "toolbar", "copyright", "skip",
}
#: a start tag of the first kind ends an open element of the second
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "aside", "nav"}


CONTAINERS = {"article", "main", "div", "section", "td", "th", "body", "header", "footer", "nav", "aside", "form", "details", "center", "dialog"}


@dataclass
class Line:
    text: str
    letters: int  # outside links, or all in an article's lines of links only
    article: int  # 0 outside articles, else which one
    marked: int  # furniture by the page's structure, see MARKED
    group: int  # container; an article's unmarked lines are one


def _marked(name: str, attrs: str, inside_article: bool) -> int:
    """2 if the tag or a role says that this is furniture, or that it is hidden; 1 if a class or an id does; else 0."""
    if name in FURNITURE or name == "header" and not inside_article:
        return 2
    if not attrs.strip() or name in ("html", "body", "main"):
        return 0
    found = 0
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if key == "role" and value.lower() in ROLES:
            return 2
        if key in ("class", "id") and {w.lower() for w in _WORD.findall(value)} & NAMES:
            found = 1
    return found


def page_lines(page: str) -> list[Line]:
    """Blocks of text in page order."""
    lines: list[Line] = []
    stack: list[tuple[str, int, int, int]] = []  # name, marked, article, container
    text: list[str] = []
    linked = 0
    at, articles, containers = 0, 0, 0
    # where each name is open, and how many blocks are, so that nothing has to look through the stack
    places: dict[str, list[int]] = {}
    blocks = [0]  # in the first so many elements

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            marked, article, group = stack[-1][1:] if stack else (0, 0, 0)
            lines.append(Line(joined, max(0, len(joined) - linked) or (len(joined) if article else 0), article, marked, -article if article and not marked else group))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece)
            text.append(piece)
            if places.get("a"):
                linked += len(" ".join(piece.split()))

    def pop(to: int) -> None:
        while len(stack) > to:
            places[stack.pop()[0]].pop()
            blocks.pop()

    def close(to: int) -> None:
        flush()
        pop(to)

    while m := _MARK.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            found = last(name)
            if found < 0:
                if name == "p":
                    flush()
                continue
            if name in BLOCK or blocks[-1] > blocks[found]:
                if name not in BLOCK:
                    continue  # an inline end tag does not end blocks
                close(found)
            else:
                pop(found)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
            ends = ENDS.get(name, set()) | ({"p"} if name not in ("br", "option") else set())
            nearest = max((last(x) for x in ends), default=-1)
            if nearest > max(last(x) for x in FENCE):
                close(nearest)
        if name in VOID:
            continue
        marked, article, group = stack[-1][1:] if stack else (0, 0, 0)
        own = _marked(name, m[3], article > 0 or name in ("article", "main"))
        if name in ("article", "main") and not article and not marked and not own:
            articles += 1
            article = articles
        if name in CONTAINERS or own > marked:
            containers += 1
            group = containers
        places.setdefault(name, []).append(len(stack))
        blocks.append(blocks[-1] + (name in BLOCK))
        stack.append((name, max(marked, own), article, group))
    add(page[at:] if not page[at:].lstrip().startswith("<") else "")
    flush()
    return lines


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    """The article's blocks joined by one space; empty if there is none.

    ``window`` lines are summed; a window of at least ``share`` of the highest is a surge.
    """
    lines = page_lines(page) if page else []
    scoped = any(x.article and x.letters and not x.marked for x in lines)
    weights = [x.letters * MARKED[x.marked] * (OUTSIDE if scoped and not x.article else 1) for x in lines]
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        groups.setdefault(x.group, []).append(i)
    peaks = {g: max(sum(weights[i] for i in at[k : k + window]) for k in range(max(1, len(at) - window + 1))) for g, at in groups.items()}
    top = max(peaks.values(), default=0)
    if not top:
        return ""
    dense = {g for g, peak in peaks.items() if peak >= share * top}
    surge, dive = min(groups[g][0] for g in dense), max(groups[g][-1] for g in dense)
    linked = _links_in_text(lines, groups, dense, window)
    return " ".join(x.text for i, x in enumerate(lines) if surge <= i <= dive and (x.letters and (x.group in dense or not (x.marked or scoped)) or i in linked))


def _links_in_text(lines: list[Line], groups: dict[int, list[int]], dense: set[int], window: int) -> set[int]:
    """Lines of links only that are text: fewer than ``window`` of them between lines of text in a dense container."""
    out: set[int] = set()
    for g in dense:
        run: list[int] | None = None  # none before the first line of text
        for i in groups[g]:
            if not lines[i].letters:
                if run is not None:
                    run.append(i)
                continue
            if run and len(run) < window and not lines[i].marked:
                out.update(run)
            run = None if lines[i].marked else []
    return out


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text`` and ``n_chars``; a null or empty page gives an empty text.

    Pages of any length are read whole and their text is never cut.  Repeated rows and null
    ids are rows like others; an empty table gives no rows.  Input columns named ``text`` or
    ``n_chars`` are replaced.
    """
    bounded_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    narrow = pages.select(*[f"`{c}`" for c in keep], f"`{html}`")
    schema = StructType([pages.schema[c] for c in keep]).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())], names=schema.names)

    return narrow.mapInArrow(frugal(run), schema)


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
