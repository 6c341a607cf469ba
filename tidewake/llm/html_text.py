"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies a block on its own, by link
density, length and stop-word density. The second pass decides the short and the nearly good
blocks by votes of their nearest decided neighbours.

Where a block stands is evidence. Blocks of menus, footers, sidebars, notices, adverts, small forms
and comments are never main text and no one's neighbours. Membership in an article lowers the
thresholds of the first pass and adds a vote in the second, whose neighbours are then those of
articles; standing outside articles that hold most of the page's text does the opposite.
Stop words count only on pages whose language is one of those with listed stop words.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split())
#: Tags whose content is no text of the page.
SILENT_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button".split())
#: Tags whose content is never main text; a header only outside articles.
BAD_TAGS = frozenset("nav footer aside header menu dialog".split())
#: Tags that are judged as bad names are: bad unless they hold most of the page's text.
FORM_TAGS = frozenset(("form", "fieldset"))
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Parts of class, id and role names that mark boilerplate.
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar|"
    r"side|widget|related|recommend\w*|share|sharing|social|comments?|replies|respond|disqus|cookies?|consent|notice|alert|popup|modal|"
    r"subscribe|newsletter|signup|login|search|pagination|pager|copyright|legal|complementary|contentinfo)(?=$|[\s_-]|\d)", re.I)

#: Names that mark an article as its tags do.
MAIN_NAMES = re.compile(r"(?:^|\s)(?:(?:article|post|entry|story|main)[_-]?(?:body|content|text)|main|article|maincontent)(?=$|\s)", re.I)

# The published method's link density, lengths and stop-word densities.
MOST_LINKS = 0.2
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.30, 0.32

#: In an article a block may hold more links, and is good from this stop-word density at any length of ``SHORT`` or more.
MOST_LINKS_IN_ARTICLE = 0.8
STOPS_IN_ARTICLE = 0.15
#: Least stop-word density of the longer blocks of a page in a listed language.
STOPS_LISTED = 0.25

# Frequent function words of the page languages.
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more my no not of on "
    "one or our out she so some than that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer es für hat ich ihr im in ist "
    "kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "ai au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour "
    "qu que qui sa se ses son sont sur un une vous y "
    "al como con cuando del desde donde el ella ellos es esta este esto fue ha hay la las lo los más me mi muy no nos o para pero por "
    "porque que se si sin sobre su sus también te tu un una y ya".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    main: bool  # in an article
    bad: bool  # in boilerplate
    heading: bool = False


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order.

    Names and forms that hold most of the page's text outside bad tags (and of its articles' text, if it has
    articles), and names of an article, mark nothing: they speak of the page's layout. Time is linear in the tags.
    """
    open_tags: list[tuple[str, bool, bool, int]] = []  # name, makes bad, makes main, first block where it is bad by name (else -1)
    places: dict[str, list[int]] = {}  # places in open_tags by name
    block_places: list[int] = []  # those of block tags
    named: list[tuple[int, int]] = []  # runs of blocks in elements of bad names
    unclosed: set[str] = set()  # silent tags without an end in the rest of the page
    bad = main = links = 0
    articles = False
    parts: list[str] = []
    linked = at = 0
    out: list[Block] = []

    def close_block():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            heading = bool(block_places) and open_tags[block_places[-1]][0] in HEADINGS
            out.append(Block(text, linked, main > 0, bad > 0, heading))
        parts, linked = [], 0

    def pop_to(index: int):
        nonlocal bad, main, links
        for name, was_bad, was_main, first in reversed(open_tags[index:]):
            if first >= 0:
                named.append((first, len(out)))
            bad -= was_bad
            main -= was_main
            links -= name == "a"
            places[name].pop()
            if name in BLOCK_TAGS:
                block_places.pop()
        del open_tags[index:]

    def add(text: str):
        nonlocal linked
        text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    while True:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if name in BLOCK_TAGS:
            close_block()
        if found[1]:
            # a stray end tag closes nothing, and that of an inline element no block
            if places.get(name) and (name in BLOCK_TAGS or not block_places or places[name][-1] > block_places[-1]):
                pop_to(places[name][-1])
            continue
        if name in VOID_TAGS:
            parts.append(" ")
            continue
        if name in SILENT_TAGS and not found[3].endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif name in ("script", "style", "template", "textarea", "iframe", "noscript"):
                break  # the rest of the page is inside it
            else:
                unclosed.add(name)
            parts.append(" ")
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and block_places and open_tags[block_places[-1]][0] == name:
            pop_to(block_places[-1])  # the one before ends here
        marks = " ".join("".join(m) for m in _NAMES.findall(found[3])) if found[3] else ""
        bad_name = bool(marks) and name not in ("html", "body") and BAD_NAMES.search(marks) is not None
        is_bad = name in BAD_TAGS and not (name == "header" and main)
        is_main = not is_bad and (name in MAIN_TAGS or bool(marks) and not bad_name and MAIN_NAMES.search(marks) is not None)
        articles = articles or is_main
        # an article's own header may be named one
        by_name = name in FORM_TAGS or bad_name and not is_bad and not is_main and name != "header"
        places.setdefault(name, []).append(len(open_tags))
        if name in BLOCK_TAGS:
            block_places.append(len(open_tags))
        open_tags.append((name, is_bad, is_main, len(out) if by_name else -1))
        bad += is_bad
        main += is_main
        links += name == "a"
    close_block()
    pop_to(0)
    upto, upto_main = [0], [0]  # characters outside bad tags before each block, and of articles alone
    for block in out:
        upto.append(upto[-1] + (0 if block.bad else len(block.text)))
        upto_main.append(upto_main[-1] + (len(block.text) if block.main and not block.bad else 0))

    def most(counts, first, end):
        return 2 * (counts[end] - counts[first]) > counts[-1]

    steps = [0] * (len(out) + 1)
    for first, end in named:
        if not (most(upto, first, end) and (not articles or most(upto_main, first, end))):
            steps[first] += 1
            steps[end] -= 1
    depth = 0
    for i, block in enumerate(out):
        depth += steps[i]
        out[i] = block._replace(bad=block.bad or depth > 0)
    return out


def _weight(text: str) -> int:
    """Characters of a text; those of scripts that write a word in one or two (from U+2E80) count as two."""
    return len(text) if text.isascii() else len(text) + sum(c >= "⺀" for c in text)


def _stops(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def _longer_stops(block: Block) -> tuple[int, int] | None:
    """Stop words and words of a block that tells the page's language."""
    longer = not block.bad and len(block.text) >= SHORT and block.linked <= MOST_LINKS * len(block.text)
    return _stops(block.text) if longer else None


def _listed(counts: list[tuple[int, int] | None]) -> bool:
    """Whether stop words say anything on this page: its longer blocks, taken together, hold enough of them."""
    words = sum(c[1] for c in counts if c)
    return words > 0 and sum(c[0] for c in counts if c) >= STOPS_LISTED * words


def first_pass(block: Block, listed: bool, outside: bool, counts: tuple[int, int] | None = None) -> tuple[str, str]:
    """Kind of a block (``good``, ``bad``, ``near`` or ``short``; ``none`` in boilerplate) and the rule that says so."""
    if block.bad:
        return "none", "place"
    if block.linked > (MOST_LINKS_IN_ARTICLE if block.main else MOST_LINKS) * len(block.text):
        return "bad", "links"
    size = _weight(block.text)
    if size < SHORT:
        return ("bad", "links") if block.linked and not block.main else ("short", "length")
    if not listed:
        return ("near" if outside or size <= LONG and not block.main else "good"), "length"
    stops, words = counts or _stops(block.text)
    density = stops / max(1, words)
    if block.main:
        return ("good" if density >= STOPS_IN_ARTICLE else "near"), "stop words"
    if density < STOPS_LOW:
        return "bad", "stop words"
    return ("good" if density >= STOPS_HIGH and size > LONG and not outside else "near"), "stop words"


def second_pass(blocks: list[Block], kinds: list[str], outside: bool) -> list[bool]:
    """Whether each block is good.

    A good neighbour is a vote for and a bad one a vote against a short or nearly good block (no vote
    where a nearly good block lies before it, for short ones). Nearly good blocks, those of articles and
    headings of articles have a vote of their own for, blocks outside of decisive articles two
    against. The page's ends count as bad for short blocks outside articles. Ties are good in articles.
    """
    good = [kind == "good" for kind in kinds]
    for of_articles in (True, False):
        line = [i for i, b in enumerate(blocks) if kinds[i] != "none" and (b.main or not of_articles)]
        votes = {i: 0 for i in line}
        for order in (line, line[::-1]):
            seen, near = 0, False  # vote of the last decided block (0: none), a nearly good one since
            for i in order:
                if kinds[i] in ("good", "bad"):
                    seen, near = (1 if kinds[i] == "good" else -1), False
                    continue
                vote = seen
                if kinds[i] == "short" and seen < 1 and not of_articles:
                    vote = 0 if near else -1
                elif kinds[i] == "short" and near:
                    vote = max(0, seen)
                votes[i] += vote
                near = near or kinds[i] == "near"
        for i in line:
            if kinds[i] in ("near", "short") and blocks[i].main == of_articles:
                own = (kinds[i] == "near") + of_articles + (of_articles and blocks[i].heading) - 2 * (outside and not of_articles)
                good[i] = votes[i] + own > (-1 if of_articles else 0)
    return good


def judged_blocks(page: str | None) -> list[tuple[str, bool, str]]:
    """Blocks of a page in order: text, whether it is main text, and the rule that decided (``place``, ``links``,
    ``length``, ``stop words`` or ``neighbours``)."""
    blocks = blocks_of(page or "")
    inside = sum(len(b.text) for b in blocks if b.main and not b.bad)
    outside = 2 * inside > sum(len(b.text) for b in blocks if not b.bad)
    counts = [_longer_stops(b) for b in blocks]
    listed = _listed(counts)
    found = [first_pass(b, listed, outside and not b.main, c) for b, c in zip(blocks, counts)]
    good = second_pass(blocks, [kind for kind, _ in found], outside)
    return [(b.text, g, "neighbours" if kind in ("near", "short") else rule) for b, g, (kind, rule) in zip(blocks, good, found)]


def main_text(page: str | None) -> str:
    """Main text of one page: good blocks in page order, joined by a line feed."""
    return "\n".join(text for text, good, _ in judged_blocks(page) if good)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` (empty where a page has none or is NULL), ``n_chars``.

    One row per input row, repeated rows and rows of one id included, so there are no ties; an empty table gives
    an empty one. Pages are read whole, however long, in time linear in their tags. Columns of ``pages`` other than
    ``page_id``, ``url`` and ``html`` are dropped, so none can clash. No shuffle.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [main_text(p) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
