"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element in page order; each line weighs as many characters as it has
outside links, a paragraph of links alone 1. Lines within boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments: by element, class, id or role) are taken out first, so that they part no text. Where that is said by a
form, a fieldset, a header or a name of layout only ("has-sidebar", "right-sidebar", "page-with-navbar") the windows have
a say before: if no window surges without such elements, the heaviest of them comes back, without those inside it, as
long as it holds MOSTLY all of the page's text; then it is what the page is wrapped in. Lines in an article that the page
marks (article, main, itemprop=articleBody) weigh BONUS more, so that links and short lines of an article don't end it.
Weights are summed over windows of WIDTH lines; text dives where a window falls to nothing, and is kept where a window
between two dives surges, that is reaches SURGE: from the first weighing line to the last, short ones before the surge
and links amid them too. A page where no window surges keeps all lines that weigh something. Of what is kept, lines outside marked articles go only if the heaviest article weighs as much as all of
them together; so an article beside a longer text (a card, a listing) takes nothing from it.

Defined results: a null or empty html gives an empty text; an unclosed element ends with its parent; a page cut off in
a tag loses that tag; an element whose text isn't shown (script, svg ...) ends at its end tag, or, but for those that
hold no markup, at once where it is self-closed or has no end tag. Character references are decoded, white space inside
a block (also br) becomes one space, blocks are joined by one newline, nothing is capped; very long and deeply nested
pages take time in proportion to their length. Of equally heavy articles and outsides the articles stay. Repeated rows
give repeated results, an empty table gives none, and other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from showloom.llm.common import only, python_rows

WIDTH, SURGE = 3, 80
#: Share of a page's weight, in per cent, that an element has which the page is wrapped in.
MOSTLY = 90
#: Doubtful elements around a line that are told apart; deeper ones are like what they are in.
DEEPEST = 20
#: Of a line in a marked article; WIDTH of them reach SURGE.
BONUS = 27
TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements by kind, and words of class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg select noembed annotation annotation-xml".split())
#: Of RAW, those that hold no markup: without an end tag the rest of the page is theirs.
NO_MARKUP = frozenset("script style textarea title".split())
RAW_ENDS = {name: re.compile(f"</{name}\\b[^>]*>", re.I) for name in RAW}
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
BOILERPLATE = frozenset("aside button dialog footer head label menu nav".split())
#: Boilerplate, unless the page is wrapped in it; and words of BAD_WORDS and VAGUE_WORDS that may describe a page's layout.
WRAPPERS = frozenset("fieldset form header".split())
LAYOUT = frozenset("banner breadcrumb breadcrumbs dialog footer form header login masthead menu menubar modal nav navbar navigation overlay pager pagination paywall search searchbox sidebar signin signup toolbar topbar".split())
MARKED = frozenset(["article", "main"])
BAD_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement advertisements adverts adsense banner breadcrumb breadcrumbs captcha commentlist contentinfo cookie cookies disqus footer gdpr header masthead "
    "menubar nav navbar newsletter outbrain pager pagination paywall popup promo searchbox sidebar signin signup taboola toolbar topbar".split()
)
#: Words that name boilerplate alone or with words of parts of pages, and a subject with others ("related-work").
VAGUE_WORDS = frozenset(
    "advertising alert comment comments complementary consent copyright dialog disclaimer discussion form legal login menu modal navigation notice notices notification overlay promoted promotion "
    "promotions recommended recommendations related reply replies respond response responses search share sharing social sponsor sponsored sponsors subscribe subscription widget widgets".split()
)
PART_WORDS = frozenset(
    "a all area article articles author bar block body bottom box btn button buttons center col column container content contents count div entry field footer for form group has head header heading "
    "icon icons id inline inner input is item items js label left link links list main message messages meta module more my news of on outer page pages panel post posts reader right row section sections site small "
    "stories story text the thread title to top ui user users view visitor wrap wrapper your".split()
)
#: Elements that a class never turns into boilerplate, and those that an end tag of another name closes.
WHOLE = frozenset(["html", "body", "main", "article"])
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


def boilerplate_words(value: str, in_article: bool) -> set[str]:
    """The words by which a name (a class, an id, a role, a label; lower case) is one of boilerplate."""
    words = set(re.split(r"[^a-z0-9]+", value)) - {""}
    strong, vague = words & BAD_WORDS, words & VAGUE_WORDS
    if in_article:
        strong, vague = strong - {"header"}, vague - {"discussion"}
    return strong | (vague if all(w in VAGUE_WORDS or w in PART_WORDS or w.isdigit() for w in words) else set())


KEPT, OUT, PERHAPS = range(3)


def judged(name: str, text: str, in_article: bool) -> int:
    """Whether an element of this name and these attributes is KEPT, holds boilerplate, or PERHAPS does."""
    if name in BOILERPLATE and not (name == "label" and in_article):
        return OUT
    found = PERHAPS if name in WRAPPERS and not (name == "header" and in_article) else KEPT
    if not text.strip(" /") or name in WHOLE:
        return found
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        for x in value.split() if key == "class" else [value] if key in ("id", "role", "aria-label") else []:
            if words := boilerplate_words(x, in_article):
                if key in ("role", "aria-label") or words - LAYOUT:
                    return OUT
                found = PERHAPS
    return found


def lines_of(page: str) -> list[tuple[str, int, bool, int, tuple[int, ...]]]:
    """Text, characters outside links (at least 1 in a paragraph), in boilerplate, number of the marked article (0: none),
    numbers of the elements around it that perhaps are boilerplate: of each line that isn't empty."""
    out: list[tuple[str, int, bool, int, tuple[int, ...]]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool]] = []  # name, how it was judged, starts an article
    around: tuple[int, ...] = ()
    open_names: dict[str, int] = defaultdict(int)
    blocks: list[int] = []  # places of block elements in the stack
    endless: set[str] = set()
    bad = marked = links = articles = paragraphs = doubtful = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((text, max(paragraphs > 0, len(text) - linked), bad > 0, articles if marked else 0, around))
            parts, linked = [], 0

    def pop() -> None:
        nonlocal bad, marked, links, paragraphs, around
        name, verdict, was_marked = stack.pop()
        open_names[name] -= 1
        if name in BLOCKS:
            blocks.pop()
            flush()
        bad, marked, links = bad - (verdict == OUT), marked - was_marked, links - (name == "a")
        paragraphs -= name == "p"
        around = around[:-1] if verdict == PERHAPS else around

    def text(start: int, end: int) -> None:
        nonlocal linked
        if end > start:
            parts.append(page[start:end])
            if links:
                linked += end - start

    at = 0
    while m := TAG.search(page, at):
        text(at, m.start())
        at = m.end()
        if not (name := (m[2] or "").lower()):
            continue
        if m[1]:
            if name == "br":
                parts.append(" ")
            elif open_names.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in BLOCKS:
                flush()
            continue
        if name in RAW:
            if name in NO_MARKUP or not (m[3].endswith("/") or name in endless):
                end = RAW_ENDS[name].search(page, at)
                at = end.end() if end else len(page) if name in NO_MARKUP else at
                endless.update(() if end else (name,))
            continue
        if name in BLOCKS:
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            if blocks and stack[blocks[-1]][0] == "p":
                for _ in range(len(stack) - blocks[-1]):  # a block ends the paragraph and what is left open in it
                    pop()
            if name == "body":
                while stack and stack[-1][0] != "html":
                    pop()
            flush()
        elif name == "br":
            parts.append(" ")
        elif name in ("img", "input", "wbr"):
            pass
        elif name == "a":
            while links:
                if stack[-1][0] in BLOCKS:
                    break
                pop()
        if name in VOID:
            continue
        verdict = judged(name, m[3], marked > 0)
        started_marked = name in MARKED or "articleBody" in m[3]
        if name in BLOCKS:
            blocks.append(len(stack))
        if verdict == PERHAPS and len(around) == DEEPEST:
            verdict = KEPT
        if verdict == PERHAPS:
            if name not in BLOCKS:
                flush()
            doubtful += 1
            around = (*around, doubtful)
        stack.append((name, verdict, started_marked))
        open_names[name] += 1
        articles += started_marked and not marked
        bad, marked, links = bad + (verdict == OUT), marked + started_marked, links + (name == "a")
        paragraphs += name == "p"
    text(at, len(page))
    flush()
    return out


def chosen(weights: list[int]) -> list[bool]:
    """Which lines stay, by windows alone."""
    sums = [sum(weights[i : i + WIDTH]) for i in range(len(weights))]
    kept = [False] * len(weights)
    i = 0
    while i < len(weights):
        start, last = i, -1
        while i < len(weights) and sums[i]:
            last = i if weights[i] else last
            i += 1
        if last >= 0 and max(sums[start:i]) >= SURGE:
            first = next(k for k in range(start, i) if weights[k])
            kept[first : last + 1] = [True] * (last + 1 - first)
        i += i == start
    return kept if any(kept) else [w > 0 for w in weights]


def surges(weights: list[int]) -> bool:
    return any(sum(weights[i : i + WIDTH]) >= SURGE for i in range(len(weights)))


def inside(lines: list[tuple[str, int, int, tuple[int, ...]]]) -> list[tuple[str, int, int]]:
    """The lines that are in no doubtful element but those that the page is wrapped in."""
    total, wrappers = sum(n for _, n, _, _ in lines), ()
    visible = first = [x[:3] for x in lines if not x[3]]
    while not surges([n for _, n, _ in visible]):
        depth = len(wrappers)
        weights: dict[int, int] = defaultdict(int)
        for _, n, _, around in lines:
            if len(around) > depth and around[:depth] == wrappers:
                weights[around[depth]] += n
        element, weight = max(weights.items(), key=lambda x: x[1], default=(0, 0))
        if weight < SURGE or 100 * weight < MOSTLY * total:
            return first
        wrappers = (*wrappers, element)
        visible = [x[:3] for x in lines if x[3] == wrappers[: len(x[3])]]
    return visible


def main_text(page: str | None) -> str:
    lines = inside([(x, n + BONUS if m else n, m, around) for x, n, b, m, around in lines_of(page or "") if not b])
    kept = chosen([n for _, n, _ in lines])
    by_article: dict[int, int] = {}
    for (_, w, m), k in zip(lines, kept, strict=True):
        by_article[m] = by_article.get(m, 0) + w * k
    outside = by_article.pop(0, 0)
    if max(by_article.values(), default=0) >= outside > 0:
        kept = [k and m > 0 for (_, _, m), k in zip(lines, kept, strict=True)]
    return "\n".join(x[0] for x, k in zip(lines, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (htmls,) in python_rows(batches, "html"):
            texts = [main_text(x) for x in htmls]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
