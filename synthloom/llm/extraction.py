"""Main text of web pages by block rules in two passes."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from synthloom.llm.common import slices, table

#: Function words of four languages: prose has many of them, lists of links and labels few.
STOP_WORDS = frozenset(
    """a all an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or
    our she so that the their there they this to was we were when which who will with would you
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit
    nach nicht noch nur oder sich sie sind über um und uns vom von vor war wie wir zu zum zur
    au aux avec ce ces cette dans de du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui
    sa se ses son sont sur un une vous y
    al como con cuando del el ella entre era esta este fue ha hay las lo los más muy nos o para pero por que se ser si sin
    sobre su sus también una ya""".split()
)

#: A block of at least this many characters and this share of stop words is decided to be text.
LENGTH, STOP_DENSITY = 70, 0.12
#: Share of a page's long blocks that must have so many stop words, else its language is taken for one without a list.
KNOWN = 0.25
#: A block whose links hold more than this share of its characters is decided to be navigation.
LINK_DENSITY = 0.5

RAW = frozenset("script style template iframe object svg canvas textarea select title head button option".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hr html legend li main nav noscript ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Blocks that HTML lets go unclosed: they end where the next block begins, and hold no others.
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr hr pre caption legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in a class or id that mark what surrounds an article; the first set also marks articles of others inside it.
OTHERS = frozenset("comment comments commentlist disqus discussion replies reply respond related recommended recommendations teaser teasers".split())
AROUND = OTHERS | frozenset(
    """ad ads adsense advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs consent cookie
    cookies copyright disclaimer footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice
    notices notification overlay pager pagination popup promo promoted promotion search share sharebar sharing sidebar signup
    skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split()
)
#: Words in the class or id of an element within a line that put its text out.
ADVERTS = frozenset("ad ads adsense advert advertisement advertisements advertising adverts promo promoted promotion sponsor sponsored".split())
#: Ids of sections that mark comments inside a region too, where other ids are anchors.
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Parts of a class that say what an element lacks, goes with or is filed under, and parts that only say how it is laid out.
#: Builders of pages name each box of a text a widget; a hero banner is an article's head.
MODIFIERS = frozenset("builder cat category elementor has hero hide no not tag term text topic with without".split())
LAYOUT = frozenset(
    """area block body bottom box btn button buttons container content group inner item items left link links list main outer panel
    right row section text top wrap wrapper""".split()
)
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed img input link meta param source track wbr".split())

# a tag ends before the next "<" that isn't in a quoted value of some 4,096 characters: whatever is left open, no place is read
# often
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,4096}+\"|'[^']{0,4096}+'|[^'\"<>])*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_UNSEEN = re.compile(r"(?:^|[;\s])display\s*+:\s*+none\b", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    tag: str = ""
    region: int = 0  # the article or main element it lies in, 0 outside of any
    out: bool = False  # in an element that surrounds articles
    by: frozenset[str] = frozenset()  # the words of classes and ids that put it out, if nothing else did
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


@dataclass
class Open:
    tag: str
    region: int
    out: bool
    others: bool  # out for holding what others wrote: articles inside don't come back
    header: bool
    by: frozenset[str] = frozenset()
    barred: bool = False  # out by element, role or hiding, whatever the classes say


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case; of those that repeat the first counts, as in browsers."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def is_hidden(marks: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it: what values of other attributes say is not asked."""
    return marks.get("hidden", "false").strip().lower() != "false" or marks.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(marks.get("style", "")))


def words_of(value: str) -> set[str]:
    """What the names in a class or id stand for: each whole, or its last part that says more than layout.

    has-sidebar, no-sidebar, tag-search and what follows "--" tell of the element's surroundings or subject: they give nothing.
    """
    found = set()
    for token in value.split():
        parts = [x.lower() for x in _NAMES.findall(token.split("--")[0])]
        found.add("".join(parts))
        while len(parts) > 1 and parts[-1] in LAYOUT:
            parts.pop()
        if parts and MODIFIERS.isdisjoint(parts[:-1]):
            found.add(parts[-1])
    return found


def blocks(page: str, but: frozenset[str] = frozenset()) -> list[tuple[str, Block]]:
    """The page's runs of text between block tags, with white space made one space, in page order; empty ones are left out.

    The words in but mark nothing in classes and ids.
    """
    stack = [Open("", 0, False, False, False)]
    found: list[tuple[str, Block]] = []
    block = Block()
    links = regions = at = 0
    anchors: list[bool] = []  # open a elements: whether each is a link
    depth: Counter[str] = Counter()
    endless: set[str] = set()
    muted: list[str] = []  # an advert within a line and the elements of its name inside; any block ends it

    def close(tag: str) -> None:
        nonlocal block
        text = " ".join(entities.unescape("".join(block.pieces)).split())
        if text:
            found.append((text, block))
        top = stack[-1]
        out = top.out or (top.header and tag not in HEADINGS)
        block = Block(tag, top.region, out, frozenset() if top.barred or out and not top.out else top.by)

    def say(text: str) -> None:
        if text and not muted:
            block.pieces.append(text)
            if links:
                block.linked += len(" ".join(text.split()))

    for m in _TAG.finditer(page):
        if m.start() < at:  # inside what a raw element held
            continue
        say(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            muted.clear()
        elif muted and name == muted[0]:
            if closing:
                muted.pop()
            else:
                muted.append(name)
        elif not closing and not muted and name not in RAW and name not in VOID and ("class" in attributes or "id" in attributes):
            marks = attributes_of(attributes)
            if not ADVERTS.isdisjoint(words_of(f"{marks.get('class', '')} {marks.get('id', '')}")):
                muted.append(name)
        if closing:
            if name == "a" and anchors:
                links -= anchors.pop()
            elif name in BLOCKS:
                if name not in LEAVES and depth[name]:
                    while True:
                        gone = stack.pop().tag
                        depth[gone] -= 1
                        if gone == name:
                            break
                    links = 0
                    anchors.clear()
                close("")
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*+>?", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                if name in ("script", "style"):
                    at = len(page)
            say(" ")
            continue
        if name in ("br", "img", "input", "wbr"):
            say(" " if name != "wbr" else "")
            continue
        if name == "a":  # without href it is a place, no link
            anchors.append("href" in attributes_of(attributes))
            links += anchors[-1]
            continue
        if name not in BLOCKS:
            continue
        top = stack[-1]
        marks = attributes_of(attributes)
        names = words_of(marks.get("class", ""))
        if name not in HEADINGS:  # the id of a heading is an anchor
            ids = words_of(marks.get("id", ""))
            names |= ids & COMMENTS if name == "section" and stack[-1].region else ids
        if name == "noscript" and not top.region:  # outside of articles it holds notices
            names.add("notice")
        names -= but
        hidden = is_hidden(marks)
        if name in ("html", "body"):
            close(name)
            continue
        others = top.others or bool(names & OTHERS) or name == "aside"
        barred = top.barred or name in ASIDE or marks.get("role", "").lower() in ROLES or hidden
        by = top.by | (names & AROUND)
        out = top.out or bool(names & AROUND) or barred
        region, header = top.region, top.header or name == "header" or "header" in names
        if header and not region:
            if name == "header":
                barred = True
            elif not top.header:
                by |= {"header"}
            out, header = True, False
        if name in MAIN or marks.get("role", "").lower() == "main":
            if not others and not hidden and not names & AROUND:
                out, header, by, barred = False, False, frozenset(), False
            if not region:
                regions += 1
                region = regions
        if name in LEAVES:
            close(name)
            block.out = block.out or out
            block.by = frozenset() if barred else block.by | by
        else:
            stack.append(Open(name, region, out, others, header, by, barred))
            depth[name] += 1
            close(name)
    say(page[at:])
    close("")
    return found


def stop_share(text: str) -> float:
    """The share of stop words in the words of a text."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def is_prose(text: str, linked: int, known: bool = True) -> bool:
    """Whether a block is long enough and has few links, and stop words enough if the page's language is a known one."""
    return len(text) >= LENGTH and linked <= 0.2 * len(text) and (not known or stop_share(text) >= STOP_DENSITY)


def is_known(texts: list[tuple[str, int]]) -> bool:
    """Whether stop words can judge a page of these blocks (text, characters in links): not if of those that are long and have
    few links less than a share of KNOWN, in characters, has stop words enough."""
    long = [text for text, linked in texts if is_prose(text, linked, False)]
    return sum(len(t) for t in long if stop_share(t) >= STOP_DENSITY) >= KNOWN * sum(map(len, long))


def main_text(page: str) -> str:
    """The article of a page: its blocks joined by newlines.

    An empty page gives an empty text. What browsers don't show (hidden elements) is left out.

    First pass: a block is other if it lies in what surrounds articles or is mostly links, text if it is long enough and
    has stop words enough (in a language that the list of stop words doesn't know, if it is long enough and has few links),
    and undecided else. Second pass: an undecided block takes the label of the nearest decided
    neighbours in its region, those that surround articles aside; of two as near that disagree, text wins; where nothing
    is decided it is text. If article and main elements hold text, and as much of what is text by the first pass as lies
    outside of them at least, what lies outside is other.

    If nothing or headings only would be left, and classes or ids alone put prose out, the page is read again without the
    words that put out its longest block of prose, comments and the like last.
    """
    found = blocks(page)
    decided = chosen(found)
    if all(b.tag in HEADINGS for (_, b), d in zip(found, decided, strict=True) if d):
        known = is_known([(text, b.linked) for text, b in found])
        lost = [(not b.by & OTHERS, len(text), b.by) for text, b in found if b.out and b.by and is_prose(text, b.linked, known)]
        if lost:
            found = blocks(page, max(lost, key=lambda x: x[:2])[2])
            decided = chosen(found)
    return "\n".join(text for (text, _), d in zip(found, decided, strict=True) if d)


def chosen(found: list[tuple[str, Block]]) -> list[bool]:
    """Whether each block belongs to the article."""
    known = is_known([(text, b.linked) for text, b in found if not b.out])
    labels: list[bool | None] = [False if b.out or b.linked > LINK_DENSITY * len(text) else True if is_prose(text, b.linked, known) else None for text, b in found]
    near: list[list[tuple[int, bool]]] = [[] for _ in found]  # (distance, whether it is other) of the decided neighbours
    for order in (range(len(found)), reversed(range(len(found)))):
        last: dict[int, int] = {}
        for i in order:
            b = found[i][1]
            if labels[i] is None and b.region in last:
                near[i].append((abs(i - last[b.region]), not labels[last[b.region]]))
            elif labels[i] is not None and not b.out:
                last[b.region] = i
    decided = [label if label is not None else not min(n)[1] if n else True for label, n in zip(labels, near, strict=True)]
    held = [0, 0]  # characters of prose outside of regions and inside
    for (text, b), label in zip(found, labels, strict=True):
        held[bool(b.region)] += len(text) if label else 0
    if held[1] >= held[0] and any(d and b.region for (_, b), d in zip(found, decided, strict=True)):
        decided = [bool(d and b.region) for (_, b), d in zip(found, decided, strict=True)]
    return decided


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of its html column in text_col, and without the html.

    Null and empty pages give an empty text; other columns, rows that repeat and their order in a partition are kept; a
    column that is already named text_col is replaced. Whole pages are read, however long, in time linear in their length.
    """
    others = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField(text_col, T.StringType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, texts in slices(batch, html_col):
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in others), pa.array([main_text(x) for x in texts], pa.string())], names=schema.names)

    return pages.select(*others, html_col).mapInArrow(take, schema)


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from pyspark.sql import functions as F

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
