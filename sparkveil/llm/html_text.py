"""Main text of web pages by two passes of block rules.

One scan of the markup cuts the page into blocks at block-level tags and leaves out what the page itself marks
as no main text: scripts, styles, forms, navigation, headers, footers, asides, notices, adverts and reader
comments. Both passes run on all blocks that are left, wherever they stand:

1. A block is bad if over LINKED of its characters are in links. It is good if its stop-word density reaches DENSE
   and it has SHORT characters or more, or reaches SPARSE at LONG or more. A block of SHORT or more with
   less than SPARSE density and some linked text is bad. All others are undecided.
2. An undecided block takes the label of the nearest decided blocks: that of both neighbours if they agree, else
   the nearer one's, good on a tie and where the page has no decided block at all.

Null and empty pages, and pages without a good block, give an empty text; an empty table gives an empty
result. Repeated rows are extracted alike, each on its own. Unclosed tags end where HTML ends them: a p at the next block, an
li at the next li, everything at the end of an enclosing block or of the page. Pages of any length are scanned once from
start to end; nothing is cut or capped. Columns of the input beside the three that are named are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers

#: Words that are frequent in running text of the languages at hand.
STOP_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "als auf aus bei das dem den der des die ein eine ich im ist mit nicht sich sie und von zu "
    "al como con del el en es la las lo los no o para por que se su un una y".split()
)
LONG, SHORT = 200, 70
LINKED, DENSE, SPARSE = 0.33, 0.25, 0.12
#: Elements whose content is no text of the page.
NO_TEXT = frozenset("noscript template object svg math canvas select button form".split())
#: Elements that start and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
#: Elements that end an open one of the first kind, if none of the second stands between them.
_ENDS = {tag: (frozenset(same.split()), frozenset(scope.split())) for tags, same, scope in (("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("tr", "tr", "table"), ("td th", "td th", "tr table")) for tag in tags.split()}
#: Parts of class names and ids that mark adverts, menus, headers, footers, sidebars, notices and reader comments.
_BAD_PART = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|footer|masthead|"
    r"comments?|commentlist|disqus\w*|respond|replies|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe",
    re.I,
)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Elements whose content is no markup: only their own end tag ends them.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in ("script", "style", "textarea", "title", "iframe")}
#: Quotes count in a tag only after an equals sign; where one is never closed, the tag ends at the next >.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|([^<]++|<)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RUN = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
_HREF = re.compile(r"\bhref\s*=", re.I)


class Block:
    """Text with white space as single spaces, and how many of its characters are in links."""

    __slots__ = ("text", "linked")

    def __init__(self, text: str, linked: int):
        self.text, self.linked = text, linked


def _bad_name(value: str, tag: str, in_article: bool) -> bool:
    for name in value.split():
        parts = re.split("[_-]+", name.lower())
        if any(map(_BAD_PART.fullmatch, parts)) or "header" in parts and not in_article and (len(parts) == 1 or parts[0] in ("site", "page", "top", "global", "main")):
            return True
    return False


def _place(tag: str, attributes: str, inside: int) -> int:
    """-1 for elements beside the main text and all that stands in them, 1 in an article or main element, else 0. Only headers are judged by whether they stand in an article."""
    if inside < 0 or tag in BAD_TAGS or tag in NO_TEXT or tag == "header" and not inside:
        return -1
    if attributes:
        for m in _NAMED.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return -1
            if name == "role" and value.lower() in _BAD_ROLE or name in ("class", "id") and tag not in ("body", "html", "article", "main") and _bad_name(value, tag, inside > 0):
                return -1
            if name == "role" and value.lower() == "main":
                return 1
    return 1 if tag in GOOD_TAGS else inside


def blocks(html: str) -> list[Block]:
    """The blocks of a page, without what its elements mark as no main text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked, in_link, place = 0, False, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = _RUN.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked))
            parts.clear()
        linked = 0

    def cut(k: int) -> None:
        nonlocal place
        del stack[k:]
        place = stack[-1][1] if stack else 0

    at = 0
    while m := _TOKEN.match(html, at):
        at, text = m.end(), m[4]
        if text is not None:
            if place >= 0:
                text = unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            if not m[3].endswith("/"):
                end = RAW[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            in_link = not closing and _HREF.search(m[3]) is not None
            continue
        own = tag in BLOCKS
        if own:
            close()
            in_link = False
        elif tag == "br" and place >= 0:
            parts.append(" ")
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
                if not own and stack[k][0] in BLOCKS:  # an inline end tag reaches no further than its block
                    break
            continue
        if tag == "form" and any(t == "form" for t, _ in stack) or tag in NO_TEXT and m[3].endswith("/"):
            continue
        if own:
            same, scope = _ENDS.get(tag, ((), ()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in same or stack[k][0] == "p":
                    cut(k)
                    if not same:
                        break
                elif stack[k][0] in scope or not same and stack[k][0] in BLOCKS or stack[k][0] in NO_TEXT:
                    break
        place = _place(tag, m[3], place)
        stack.append((tag, place))
    close()
    return out


def decided(block: Block) -> int:
    """Pass 1: 1 good, -1 bad, 0 undecided."""
    n = len(block.text)
    link = block.linked / n
    if link > LINKED:
        return -1
    if n < SHORT:
        return 0
    found = _WORD.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if density >= DENSE or n >= LONG and density >= SPARSE:
        return 1
    return -1 if density < SPARSE and link > 0 else 0


def inherited(labels: list[int]) -> list[int]:
    """Pass 2: labels with each 0 replaced by what the nearest decided blocks say."""
    before: list[tuple[int, int]] = []
    last = (0, -1)
    for at, label in enumerate(labels):
        last = (label, at) if label else last
        before.append(last)
    last, out = (0, -1), []
    for at in range(len(labels) - 1, -1, -1):
        label = labels[at]
        if label:
            last = (label, at)
        else:
            (left, i), (right, j) = before[at], last
            if not left or not right or left == right:
                label = left or right or 1
            else:
                label = right if j - at < at - i else left if at - i < j - at else 1
        out.append(label)
    return out[::-1]


def judged(html: str | None) -> tuple[str, int, int]:
    """The main text, how many blocks pass 1 decided, and how many inherited a label."""
    found = blocks(html or "")
    labels = [decided(b) for b in found]
    undecided = labels.count(0)
    return "\n".join(b.text for b, label in zip(found, inherited(labels), strict=True) if label > 0), len(labels) - undecided, undecided


def main_text(html: str | None) -> str:
    return judged(html)[0]


_OUT = "text string, n_chars long, n_by_rule long, n_inherited long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [judged(h.as_py()) for h in batch.column("_html")]
        counts = [pa.array(c, pa.int64()) for c in ([len(t) for t, *_ in got], [n for _, n, _ in got], [n for *_, n in got])]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array([t for t, *_ in got], pa.string()), *counts], ["_id", "_url", *(c.split()[0] for c in _OUT.split(", "))])


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points), n_by_rule and n_inherited (blocks) of every page."""
    on_workers(pages.sparkSession)
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    found = rows.mapInArrow(_extract, f"_id {rows.schema['_id'].dataType.simpleString()}, _url {rows.schema['_url'].dataType.simpleString()}, {_OUT}")
    return found.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), *(c.split()[0] for c in _OUT.split(", ")))
