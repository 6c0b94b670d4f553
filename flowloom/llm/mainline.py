"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block of the page; boilerplate elements
leave a gap of blank lines.  The lengths of a few lines in a row are summed over a
sliding window: the sum surges where prose begins and dives to nothing in gaps
and after it.  Text between surge and dive is kept.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.frames import map_texts, pick

# Lines summed at each place, and the sum from which prose begins.
WINDOW = 3
SURGE = 86

# Names of elements and of classes.
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "xmp", "noembed")
_BOILERPLATE = ("nav", "footer", "aside", "form", "select", "button", "menu", "dialog", "object", "head", "fieldset")
_BLOCKS = (
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul"
).split()
_MAIN = ("article", "main")
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
_BOILERPLATE_CLASSES = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer masthead comment comments disqus respond replies reply share sharing social related recommended "
    "newsletter subscribe subscription signup login search widget pagination pager skip hidden toolbar"
).split()
_BOILERPLATE_ROLES = "navigation banner contentinfo complementary search form alert dialog menu menubar".split()

_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?", re.I)
_NOT_NAME = re.compile(r"[^a-z0-9]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    text: str
    linked: int = 0
    main: bool = False


def _is_boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    if name in _BOILERPLATE or (name == "header" and not in_main):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key in ("class", "id"):
            if not set(_NOT_NAME.split(value)).isdisjoint(_BOILERPLATE_CLASSES) and name not in _MAIN:
                return True
        elif key == "role":
            if value in _BOILERPLATE_ROLES:
                return True
        elif key == "style":
            if _HIDING.search(value):
                return True
        elif key == "hidden" or value == "true":
            return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page as lines of bare text, boilerplate elements as gaps of blank lines."""
    lines: list[Line] = []
    parts: list[str] = []
    state = {"linked": 0}
    skipping, depth = "", 0
    in_link, main_depth = False, 0
    tag = _TAG

    def end_line() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, state["linked"], main_depth > 0))
        parts.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if text and not skipping:
            parts.append(text)
            if in_link:
                state["linked"] += len(text.strip())

    def gap() -> None:
        lines.extend(Line("") for _ in range(WINDOW))

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = len(page) if end < 0 else end + 1
            continue
        m = tag.match(page, begin)
        if m is None and tag is _TAG and _PLAIN_TAG.match(page, begin):
            tag = _PLAIN_TAG  # a quote that never ends: attributes are read plainly from here on
            m = tag.match(page, begin)
        if m is None:
            if re.match(r"</?[a-zA-Z]", page[begin : begin + 3]):
                break  # a tag cut off by the end of the page
            add("<")
            at = begin + 1
            continue
        at = m.end()
        name, closing = m.group(1).lower(), page[begin + 1] == "/"
        attributes = m.group(2)
        self_closed = attributes.endswith("/") or name in _VOID
        if skipping:
            if name == skipping:
                depth += -1 if closing else 0 if self_closed else 1
            if depth <= 0 or (name in _MAIN and not closing and skipping not in ("div", "section", "aside", "ul", "ol")):
                # also where an unclosed menu runs into the article
                skipping = ""
                gap()
                if name not in _MAIN or closing:
                    continue
            else:
                continue
        if name in _RAW and not closing:
            if not self_closed:
                end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = len(page) if end is None else end.end()
            continue
        if not closing and not self_closed and _is_boilerplate(name, attributes, main_depth > 0):
            end_line()
            gap()
            skipping, depth = name, 1
            continue
        if name == "a":
            in_link = not closing
        if name in _BLOCKS:
            end_line()
            in_link = in_link and name in ("br", "li") and not closing
        if name in _MAIN:
            main_depth = max(main_depth - 1, 0) if closing else main_depth + 1
    if not skipping:
        end_line()
    return lines


def text_lengths(lines: list[Line]) -> list[int]:
    """Characters of each line that count as prose.

    Where the page marks its main part, other lines count nothing and every
    line of that part counts as a surge.  Lines that are mostly links count nothing.
    """
    marked = any(line.main and line.text for line in lines)
    lengths = []
    for line in lines:
        n = len(line.text)
        if marked:
            lengths.append(max(n, SURGE) if line.main and n else 0)
        else:
            lengths.append(0 if 2 * line.linked > n else n)
    return lengths


def regions(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs of lines [begin, end) from a surge of the window sum to its dive to nothing."""
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    found, k = [], 0
    while k < len(sums):
        if sums[k] < surge or not lengths[k]:
            k += 1
            continue
        end = k
        while end < len(sums) and sums[end]:
            end += 1
        found.append((k, end))
        k = end
    return found


def main_text(page: str) -> str:
    """The text between surges and dives, blocks joined by one space."""
    lines = lines_of(page)
    kept = regions(text_lengths(lines))
    return " ".join(line.text for begin, end in kept for line in lines[begin:end] if line.text)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id, url, text`` and its code points ``n_chars``.

    Takes ``page_id``, ``url`` and ``html``; other columns are left out.  Null or
    empty pages, and pages without prose, give the empty text.  Repeated rows and
    null ids are treated one by one.  A map over rows: no shuffle.
    """

    def prepare():
        def work(texts):
            found = [main_text(t) for t in texts]
            return found, [len(t) for t in found]

        return work

    read = map_texts(pick(pages, "page_id", "url", "html"), "html", "text string, n_chars long", prepare)
    return read.select("page_id", "url", F.col("text"), "n_chars")
