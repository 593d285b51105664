"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines (one per block element), each with the length of its own text. Sums over sliding windows
of lines rise where the main text surges and fall where it dives; what lies between is kept. Lines of elements that
never hold main text (menus, forms, adverts ...) weigh nothing and are not kept; lines of a marked article weigh more, and
on each page the marked or the unmarked lines make up the main text, whichever have the heaviest run.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches

#: Lines of a block; a block of more text is a surge of its own; the weight of a marked article's text, and what it weighs at least.
WINDOW, FLOOR, BONUS, MARKED = 3, 80, 4, 200
#: HTML's block elements, elements that end by themselves, ones whose content is no text (the embedded ones only up to an end tag), and boilerplate.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style title textarea"
EMBEDDED = frozenset("noscript template iframe object svg math select button audio video canvas".split())
DROPPED = frozenset("nav footer aside form head dialog menu".split())
LOOSE = frozenset("p li dt dd option td th tr".split())  # these may stay open
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments respond replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager toolbar skip".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})(?:\s*/>|\s[^>]*[\s\"']/>|(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORD = re.compile(r"[a-z]+")
#: How running text ends, and how a page's own notice starts.
SENTENCE, NOTICE = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$"), re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main") and not re.search("comment", attributes, re.I):
        return False
    if HIDDEN.search(attributes):
        return True
    for key, *values in ATTRIBUTE.findall(attributes):
        names = [WORD.findall(x) for x in "".join(values).lower().split()]
        if key.lower() == "role" and any(not ROLES.isdisjoint(words) for words in names):
            return True
        if key.lower() in ("class", "id") and any(words and MARKS.issuperset(words) for words in names):  # not has-sidebar
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """The page's lines: text, length without links (0 for boilerplate, whose text is empty), whether an article holds it,
    and whether it is running text or a title: it ends as a sentence does, or is a main heading."""
    tokens = [(m.start(), m.end(), m[2], (m[3] or "").lower(), m[4]) for m in TOKEN.finditer(page)]
    # Where each open tag ends: at its own end tag, or for those that may stay open at the next block.
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, (_, _, slash, name, attributes) in enumerate(tokens):
        if not name or name in VOID or name in EMBEDDED and not slash and attributes.endswith("/"):
            continue
        if slash:
            if stack := open_.get(name):
                ends[stack.pop()] = k
        else:
            if name in BLOCKS:
                for loose in LOOSE:
                    if (loose == name or name not in LOOSE) and loose in ("p", name) and open_.get(loose):
                        ends[open_[loose].pop()] = k
            open_.setdefault(name, []).append(k)
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked, title = [0], [False]
    articles: list[int] = []  # token numbers at which open articles end
    link_until = skip_until = -1
    at = 0

    def close(in_article: bool) -> None:
        text = " ".join("".join(parts).split())
        if text:
            own = max(0, len(text) - linked[0])
            out.append((text, own, in_article, title[0] or own * 2 >= len(text) and bool(SENTENCE.search(text)) and not NOTICE.match(text)))
        parts.clear()
        linked[0] = 0

    for k, (start, end, slash, name, attributes) in enumerate([*tokens, (len(page), len(page), "", "", "")]):
        if k >= skip_until:
            # What precedes its end tag belongs to a dropped element. Each piece is decoded by itself: no reference spans a tag.
            text = "" if k == skip_until else html.unescape(page[at:start])
            parts.append(text)
            if k <= link_until:
                linked[0] += len(text)
            if name in BLOCKS:
                close(bool(articles))
                title[0] = name == "h1" and not slash
            elif name == "br":
                parts.append(" ")
            while articles and k >= articles[-1]:
                articles.pop()
            if not slash and name:
                last = ends.get(k)
                if name in EMBEDDED:
                    if last is not None:
                        skip_until = last
                elif _boilerplate(name, attributes or "", bool(articles)):
                    close(bool(articles))
                    if last is not None:
                        skip_until = last
                        out.append(("", 0, bool(articles), False))
                elif name in ("article", "main"):
                    articles.append(len(tokens) + 1 if last is None else last)
                elif name == "a" and last is not None:
                    link_until = last
        at = end
    close(bool(articles))
    return out


def surges(weights: list[int], window: int = WINDOW, floor: int = 0) -> list[tuple[int, int]]:
    """Runs of lines (from, to) between a surge and the dive that follows.

    A block's sum over ``window`` lines above ``floor`` is a surge; the run goes on until a whole block is empty.
    """
    out, n, i = [], len(weights), 0
    sums = [sum(weights[k : k + window]) for k in range(n)]
    while i < n:
        if sums[i] > floor:
            start = next(k for k in range(i, n) if weights[k])
            while start and weights[start - 1]:  # the block that rose above the floor may begin within the text
                start -= 1
            i = next((k for k in range(start, n) if not sums[k]), n)
            end = i
            while end and not weights[end - 1]:
                end -= 1
            out.append((start, end))
        i += 1
    return out


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by newlines; empty if it has none.

    Marked and unmarked lines are weighed apart, and the side with the heaviest run is the page's; of its runs those of
    an article are all kept. Of unmarked ones the kept are those with a surge above the floor, what lies between them,
    and those with running text or the title; what remains are scraps such as labels and copyright lines.
    """
    found = lines(page or "")
    sides = []
    for side in (True, False):
        weights = [(len(text) if side else n) if inside == side else 0 for text, n, inside, _ in found]
        runs = surges(weights)
        heaviest = max((sum(weights[a:b]) for a, b in runs), default=0)
        sides.append((MARKED + BONUS * heaviest if side and heaviest else heaviest, side, weights, runs))
    heaviest, side, weights, runs = max(sides, key=lambda x: x[0])
    if not heaviest:
        return ""
    if not side:
        strong = surges(weights, WINDOW, min(FLOOR, max(weights) // 2))
        first, last = strong[0][0], strong[-1][1]
        runs = [(a, b) for a, b in runs if first <= a and b <= last or any(found[k][3] and weights[k] for k in range(a, b))]
    return "\n".join(found[k][0] for a, b in runs for k in range(a, b) if found[k][0] and found[k][2] == side)


def extract(df: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """All of df's columns but html_col, and ``to`` with the main text (a column of that name is replaced).

    A null or empty page, or one without text, has the empty text. Rows are neither joined nor dropped.
    """
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (html_col, to)]
    schema = df.select(*kept).schema.add(to, "string")

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(main_text, batch.column(batch.num_columns - 1).to_pylist()), pa.string())], names=[*kept, to])

    return map_batches(df.select(*kept, html_col), make, schema)


def op10_html_extraction(pages: DataFrame) -> DataFrame:
    """The main text of every page and its length in code points; null and empty pages, and those without text, have the empty one."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
