"""Main text of web pages by two-pass block rules.

A page becomes blocks at its block-level tags; what can't be article text by markup alone (scripts, styles,
navigation, asides, and elements whose whole name is that of an advert, a notice, a menu, comments and the like) is
left out. The first pass judges each block by itself: links with little text around them make it bad, stop words and
length make it good, and short blocks, headings and doubtful ones stay open; so do shorter blocks of few stop words without links,
which need good neighbours on both sides. The second pass gives each open block the
label of its nearest decided neighbours: both agree, or else headings follow what comes after them and other blocks
follow a good neighbour only if their own stop words speak for it.

Markup that names the article (article, main, role=main) is one feature of a block, not a verdict. It counts if at
least half of the text that is good by itself stands inside, and is passed over otherwise (a teaser may be marked and its article
not). If it counts, fewer stop words do inside and what speaks against a block leaves it open, and open blocks look at
neighbours inside; outside, long blocks of many stop words stay good, and what else would be good is only open and needs
a good neighbour on either side. A mark with nothing decided in it keeps its open blocks. On a page whose text the
stop lists don't fit, length and links alone decide. A page of less text than a long block is too short to be judged: what isn't all
links stays.

A null, empty or markup-only page has an empty text. A page cut off anywhere is read to its end, and a long one in
one pass. Repeated rows are extracted alone; page_id and url pass through, null or not. An empty table has no rows.
Of pages only page_id, url and html are read; other columns may have any names.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_texts, read

#: Frequent function words of English, German, Spanish and French.
STOP_WORDS = frozenset(
    """a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more not of on one or
    our she so than that the their them there they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann
    mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    al algo como con de del desde el ella en entre era es esta está este fue ha hay la las le lo los más me mi muy no o para pero por que se si sin
    sobre su sus también un una uno y ya yo
    à au aux avec ce ces cette comme dans de des du elle en est et été il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui
    sa se ses son sont sur un une vous""".split()
)
#: Elements of HTML by their role.
RAW = frozenset("script style".split())
DROPPED = frozenset("script style noscript template svg math iframe object embed nav footer aside button select textarea label dialog menu canvas audio video title head".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class and id that name page furniture, words that say nothing about it, and words that
#: turn a name into one of something else.
FURNITURE = frozenset(
    """ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu
    menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion related respond share sharing
    sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split()
)
PLAIN_NAMES = frozenset("area articles bar block body bottom box buttons col column content group header holder inner item items left link links list news panel posts right section slot small space stories text top unit zone".split())
HOLDERS = frozenset("container outer wrap wrapper".split())
MODIFIERS = frozenset("hide is no not show with without has".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))|</?\Z""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, LINKS, STOPS_LOW, STOPS_HIGH = 70, 200, 0.34, 0.15, 0.25
#: Share of stop words in a page's text below which no list fits its language.
FITS = 0.08


@functools.lru_cache(maxsize=10_000)
def names_furniture(name: str) -> bool:
    """Whether one class or id as a whole names furniture: its head word does, and it holds nothing else."""
    words = [w.lower() for w in NAME.findall(name)]
    if not words or MODIFIERS.intersection(words):
        return False
    holder = False
    while len(words) > 1 and (words[-1] in PLAIN_NAMES or words[-1] in HOLDERS):
        holder |= words.pop() in HOLDERS
    return FURNITURE.issuperset(words) if holder else words[-1] in FURNITURE


def furniture(tag: str, attributes: str) -> bool:
    """Whether an element is page furniture by its tag or its attributes."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and any(map(names_furniture, value.split())):
            return True
    return False


@dataclass
class Block:
    text: str
    linked: float  # share of the text in links
    heading: bool = False
    inside: bool = False  # in an article or main element
    form: bool = False


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    heading = False
    opened: list[tuple[str, bool, bool]] = []  # tag, dropped, article
    counts: Counter[str] = Counter()
    dropped = articles = links = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked, heading
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(whole, min(1.0, linked / len(whole)), heading, articles > 0, counts["form"] > 0))
            text.clear()
        linked, heading = 0, False

    def add(chunk: str) -> None:
        nonlocal linked
        if chunk and not dropped:
            chunk = html.unescape(chunk)
            text.append(chunk)
            if links:
                linked += len(" ".join(chunk.split()))

    def close(k: int) -> None:
        nonlocal dropped, articles, links
        flush()
        for tag, gone, article in opened[k:]:
            dropped -= gone
            articles -= article
            links -= tag == "a"
            counts[tag] -= 1
        del opened[k:]

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if counts[tag]:
                k = next(i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == tag)
                if tag in BLOCKS or tag in DROPPED or opened[k][1]:
                    close(k)
                else:
                    links -= tag == "a"
                    counts[tag] -= 1
                    del opened[k]
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            flush()
            if opened and opened[-1][0] in ("p", *HEADINGS, "li", "dt", "dd") and (opened[-1][0] == tag or opened[-1][0] == "p"):
                close(len(opened) - 1)
            heading = tag in HEADINGS
        if tag in VOID or attributes.rstrip(">").endswith("/") and tag not in BLOCKS:
            continue
        role = "main" in attributes and re.search(r"""role\s*=\s*["']?main\b""", attributes) is not None
        article = tag in ("article", "main") or role
        # an article in an article may be a comment; the outermost one is judged by its text
        gone = (not article or articles > 0) and (furniture(tag, attributes) or tag == "header" and not articles)
        if tag == "body" and counts["head"]:  # an unclosed head
            close(0)
        article = article and not dropped and not gone
        opened.append((tag, gone, article))
        counts[tag] += 1
        dropped += gone
        articles += article
        links += tag == "a"
    flush()
    return out


def nearest(labels: list[bool | None]) -> list[tuple[bool | None, bool | None]]:
    """For each place the last decided label before it and the first after it."""
    before: list[bool | None] = []
    after: list[bool | None] = []
    for out, run in ((before, labels), (after, labels[::-1])):
        last = None
        for x in run:
            out.append(last)
            last = last if x is None else x
    return [*zip(before, after[::-1])]


def stop_shares(found: list[Block]) -> list[float]:
    """The share of stop words in each block; 1 for all if they don't fit the page's language."""
    words = [WORD.findall(b.text.lower()) for b in found]
    stops = [sum(w in STOP_WORDS for w in x) for x in words]
    prose = [k for k, b in enumerate(found) if b.linked <= LINKS]
    if sum(stops[k] for k in prose) < FITS * sum(len(words[k]) for k in prose):
        return [1.0] * len(found)
    return [n / len(x) if x else 0.0 for n, x in zip(stops, words)]


def first_pass(b: Block, stops: float, inside: bool, marked: bool) -> bool | None:
    """A block's label by itself; None: open. marked: the page has an article that counts, inside: the block stands in it."""
    against = None if inside else False
    if b.linked > LINKS and len(b.text) * (1 - b.linked) < SHORT or len(b.text) < LONG and ("©" in b.text or b.form):
        return against
    if b.heading or len(b.text) < SHORT:
        return None
    if stops >= (STOPS_LOW if inside or len(b.text) >= LONG else STOPS_HIGH):
        return None if marked and not inside and (len(b.text) < LONG or stops < STOPS_HIGH) else True
    return None if stops >= STOPS_LOW or not b.linked and len(b.text) < LONG else against


def mark_counts(found: list[Block], shares: list[float]) -> bool:
    """Whether at least half of the text that is good by itself, if there is any, stands in a marked article."""
    if not any(b.inside for b in found):
        return False
    good = [b for b, s in zip(found, shares) if first_pass(b, s, False, False)]
    return 2 * sum(len(b.text) for b in good if b.inside) >= sum(len(b.text) for b in good)


def label(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    if sum(len(b.text) for b in found) < LONG:
        return [b.linked < 1 and "©" not in b.text and not b.form and (b.inside or not any(x.inside for x in found)) for b in found]
    shares = stop_shares(found)
    marked = mark_counts(found, shares)
    insides = [marked and b.inside for b in found]
    first = [first_pass(b, s, inside, marked) for b, s, inside in zip(found, shares, insides)]
    around = nearest(first)
    within = [k for k, inside in enumerate(insides) if inside]
    for k, pair in zip(within, nearest([first[k] for k in within])):
        around[k] = pair
    out = []
    for b, share, inside, x, (a, z) in zip(found, shares, insides, first, around):
        if x is None:
            if marked and not inside or not inside and not b.heading and len(b.text) >= SHORT and share < STOPS_LOW:
                x = bool(a and z)  # what speaks against it takes good text on both sides
            elif a is None and z is None:  # nothing is decided: a page, or an article, of a few words
                x = inside or b.linked == 0
            elif a is None or z is None or a == z:
                x = bool(a or z)
            elif b.heading:
                x = bool(z)
            else:
                x = inside or share >= STOPS_HIGH
        out.append(x)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, label(found)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return run

    return map_texts(pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")), make, "page_id long, url string, text string, n_chars long", "html")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
