"""Main text of web pages by line-block distribution.

A page becomes lines: one for each block element, without markup and without regions that are boilerplate by their element or their class. Lines
that are mostly links have no length, but for those inside article and main, whose text weighs more. Text lengths are summed over sliding windows of lines; a surge, where the sum rises
to the level of the page and stays, opens a run of text, and a dive, where a whole window is empty, closes it. Text between the first
surge and its dive is kept; further runs are kept too, and short lines inside a run stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronofold.llm.common import col, map_arrow

#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown, and those whose content isn't markup.
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no part of an article.
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select textarea fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that say that a region is no part of an article.
LABELS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: An end tag of one of these also ends what is left open inside; other end tags without a start are ignored.
CLOSED_BY_BLOCK = frozenset("p li dt dd tr td th option thead tbody tfoot".split())

#: Words that may stand beside one of LABELS in a name, as in site-header or comment-list; a name with any other word says something else (no-sidebar, topic-social).
BESIDE = frozenset(
    "site page main top bottom left right global primary secondary list box bar area block container wrapper inner outer section link links button buttons "
    "item items panel form text policy consent slot unit post posts article articles content row col group toggle title icon icons media".split()
)

START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
QUOTE = re.compile(r"=\s*([\"'])|>")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDES = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def _labelled(name: str, rest: str) -> bool:
    if not rest or name in ("body", "html", "article", "main"):
        return False
    for m in NAMED.finditer(rest):
        for one in (m[1] or m[2] or m[3] or "").lower().split():
            parts = PART.findall(one)
            if one in LABELS or not LABELS.isdisjoint(parts) and all(w in LABELS or w in BESIDE for w in parts):
                return True
    return bool(HIDES.search(rest))


def _tag_end(page: str, at: int, gone: set[str]) -> int:
    """The place behind the > of a tag. A quote counts only as the start of a value; one that nothing closes is an ordinary character. gone: quotes of which no more come."""
    while m := QUOTE.search(page, at):
        if not m[1]:
            return m.end()
        close = -1 if m[1] in gone else page.find(m[1], m.end())
        if close < 0:
            gone.add(m[1])
        at = m.end() if close < 0 else close + 1
    return len(page)


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters inside links, boilerplate, inside article or main) of each line of a page."""
    out: list[tuple[str, int, bool, bool]] = []
    held: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # name, hidden, boilerplate, inside an article
    off, plain, main, links = False, False, False, 0

    def end_line() -> None:
        nonlocal linked
        if held:
            text = SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((text, linked, plain, main))
            held.clear()
        linked = 0

    at, size, gone = 0, len(page), set()
    is_open: Counter[str] = Counter()

    def close(depth: int) -> None:
        nonlocal off, plain, main
        for entry in stack[depth:]:
            is_open[entry[0]] -= 1
        del stack[depth:]
        _, off, plain, main = stack[-1] if stack else ("", False, False, False)

    while at < size:
        m = START.search(page, at)
        stop = m.start() if m else size
        if stop > at and not off:
            held.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else ">", m.end())
            at = size if end < 0 else end + (3 if m[1] else 1)
            continue
        name, rest = m[4].lower(), m.end()
        at = _tag_end(page, rest, gone)
        if m[3]:
            if name in BLOCKS or name in HIDDEN:
                end_line()
            if name == "a":
                links = max(links - 1, 0)
            if is_open[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name not in BLOCKS and stack[i][0] in BLOCKS:
                        break
            continue
        attributes = page[rest : at - 1]
        if name in BLOCKS:
            end_line()
        elif name == "br":
            held.append(" ")
        elif name == "a":
            links += 1
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = size if not end else size if (end := page.find(">", end.end())) < 0 else end + 1
            continue
        if name in CLOSED_BY_BLOCK and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        label = _labelled(name, attributes)
        if name in BLOCKS or name in HIDDEN or name in BOILERPLATE or label:
            inside = main or name in ("article", "main")
            bad = name in BOILERPLATE and not (name == "header" and main) or label
            stack.append((name, off or name in HIDDEN, plain or bad, inside))
            is_open[name] += 1
            _, off, plain, main = stack[-1]
    end_line()
    return out


def kept(rows: list[tuple[str, int, bool, bool]], window: int = 3, level: float = 0.2, weight: float = 4.0) -> list[bool]:
    """Which lines lie between a surge and its dive.

    Text inside article or main counts `weight` times, links in it as text; elsewhere lines that are mostly links have no length. Boilerplate is stripped with the markup: it is no line here.
    """
    shown = [i for i, row in enumerate(rows) if not row[2]]
    if not shown:
        return [False] * len(rows)
    size = np.array([0 if not main and 2 * linked > len(text) else len(text) * (weight if main else 1) for text, linked, _, main in (rows[i] for i in shown)], float)
    block = np.convolve(np.concatenate([size, np.zeros(window)]), np.ones(window))[window - 1 : window - 1 + len(size)]
    surge = min(block.max() * level, 80.0)
    out = [False] * len(rows)
    on = False
    for i, line in enumerate(shown):
        if not on and size[i] and block[i] >= surge:
            on = True
            j = i  # short lines of the article right before it, such as headlines
            while j and size[j - 1] and rows[shown[j - 1]][3] and not out[shown[j - 1]]:
                j -= 1
                out[shown[j]] = True
        elif on and not block[i]:
            on = False
        out[line] = bool(on and size[i] > 0)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, a line for each block; empty for a null page and for one without text."""
    rows = lines(page or "")
    return "\n".join(text for (text, *_), keep in zip(rows, kept(rows)) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html counts as empty; rows that repeat are rows of the result."""

    def make():
        def each(batch: pa.RecordBatch):
            text = [main_text(x) for x in batch.column("html").to_pylist()]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": [len(x) for x in text]}

        return each

    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    return map_arrow(rows, make, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
