"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, asides, scripts and styles are
left out, and so are those in elements whose class, id or role names such a part, and in forms; but a name only rejects
what is a part of its page: an element that holds nearly all the page's text without links (all of it, for reader comments) is
a frame, whatever its name, as a page in one form or in a "search" section is. Names of states and layouts ("has-sidebar",
"comments-open") are no marks. The first pass judges all others by length,
density of stop-words and density of links: good, bad (links), or undecided (short, few stop-words, some links). The
second pass gives undecided blocks the label of their nearest decided neighbours: good where both are good or where
there is but one and it is good, and where they differ if the block is near-good itself, heads a good block, or has a
near-good block between it and the bad one. Neighbours are looked for on a block's own side of article and main
elements, so what stands around an article does not follow it; such elements decide nothing else. An article element
of short blocks alone (verses, say) is taken as it is if it holds as much as a long block does; what is good elsewhere
then stays only if it is more. Other undecided blocks without decided neighbours are good if no block of the page is;
those in article elements go before others.

Stop-words are those of four languages. A page none of whose longer blocks has some is in another language: there
length and links decide alone.

Character references are decoded; white space inside a block becomes one space. Quotes that nothing closes end with
their tag, and markup that breaks off counts as closed at the end. A null page is empty; so is the text of a page
without good blocks. A null page_id or url is carried. Repeated rows get equal results. Empty table: empty result.
Extra columns are unread. Pages are whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a block, whose content is no text, and that hold no article text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math canvas object audio video".split())
BARE = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("head nav header footer aside menu dialog button select".split())

# Words in class, id and role names that mark such elements; of reader comments; of states and layouts, which unmark a name.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share complementary consent contentinfo cookie cookies dropdown foot footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pagination popup promo promoted promotion recommended related search share sharing sidebar side signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist cmt cmts disqus discussion feedback guestbook reactions replies respond responses talkback".split())
STATES = frozenset("has with without no not is by open opened closed enabled disabled on off active layout template theme page result results".split())

# Stop-words of English, German, French and Spanish.
STOP = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you " "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht sein sich sie sind über um und von vor war werden wie wir zu zum zur " "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous ou par pas plus pour qu que qui sa se ses son sur un une vous " "al como con del el ella en es esta este la las lo los más no o para pero por que se sin su sus un una y ya".split()
)

#: Characters of a short block and of a long one; link shares over which a block is undecided, and bad; stop-word shares
#: of near-good and good ones.
SHORT, LONG, LINKS, LINKED, SOME_STOP, MANY_STOP = 70, 200, 0.3, 0.8, 0.12, 0.22
#: Share of a marked element, in its own text and that without any mark (links apart), from which it is the page's frame.
FRAME = 0.9

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"<]*\"|=\s*'[^'<]*'|=)*)(?:>|$)", re.S)
_ODD = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’…–—·"
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*[^>]*(?:>|$)", re.I) for name in RAW}


class Block(NamedTuple):
    text: str
    links: float  # share of characters in links
    outside: bool  # in an element that never holds article text
    article: int  # number of the outermost article or main element around it; 0 is none
    heading: bool
    marked: tuple[int, ...]  # numbers of the marked elements around it; those of comments are negative


def mark_of(name: str, values: str) -> str | None:
    """What an element's names say it is: comments, another part beside the article, or nothing."""
    found = "part" if name == "form" else None
    for value in values.lower().split():
        words = [w.rstrip("0123456789") or w for w in re.split("[-_]+", value)]
        if STATES.isdisjoint(words):
            if not COMMENTS.isdisjoint(words):
                return "comments"
            if not MARKS.isdisjoint(words):
                found = "part"
    return found


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page, in order."""
    out, piece = [], []
    stack: list[tuple[str, bool, int, int]] = []  # name, outside, article, mark
    links = chars = linked = numbered = 0
    heading = False

    def close() -> None:
        nonlocal chars, linked, heading
        text = " ".join("".join(piece).split())
        if text:
            article = next((s[2] for s in stack if s[2]), 0)
            out.append(Block(text, linked / max(1, chars), any(s[1] for s in stack), article, heading, tuple(s[3] for s in stack if s[3])))
        piece.clear()
        chars = linked = 0
        heading = False

    def say(raw: str) -> None:
        nonlocal chars, linked
        if raw:
            text = unescape(raw)
            piece.append(text)
            n = len(text.strip())
            chars += n
            linked += n if links else 0

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK or name in OUTSIDE:
                close()
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = _CLOSE[name].search(html, at)
            if name not in ("svg", "math", "object") or not m[3].endswith("/"):
                at = end.end() if end else n
            continue
        if name in BLOCK or name in OUTSIDE:
            close()
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name == "a":
            links += 1
        elif name not in BARE and not m[3].endswith("/") and (name in BLOCK or name in OUTSIDE):
            values = " ".join(a or b or c for a, b, c in _MARK.findall(m[3]))
            while name in ("p", "li", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
            within, numbered = any(s[2] for s in stack), numbered + 1
            outside = name in OUTSIDE and not (name == "header" and within)
            mark = None if name in ("body", "html", "article", "main") else mark_of(name, values)
            article = numbered if name in ("article", "main") and not any(s[1] for s in stack) else 0
            stack.append((name, outside, article, 0 if mark is None else -numbered if mark == "comments" else numbered))
    close()
    return out


def stop_share(text: str) -> float:
    words = text.split()
    return sum(w.lower().strip(_ODD) in STOP for w in words) / len(words)


def first_pass(blocks: list[Block]) -> list[str]:
    """The label of each block: good, bad, near (near-good), poor or short; the last three are undecided."""
    shares = [stop_share(b.text) if len(b.text) >= SHORT else 0.0 for b in blocks]
    known = any(share >= SOME_STOP for share, b in zip(shares, blocks) if b.links <= LINKS)
    out = []
    for (text, links, *_), share in zip(blocks, shares):
        if links > LINKED:
            out.append("bad")
        elif len(text) < SHORT:
            out.append("short")
        elif links > LINKS or known and share < SOME_STOP:
            out.append("poor")
        else:
            out.append("good" if len(text) >= LONG and (share >= MANY_STOP or not known) else "near")
    return out


def second_pass(first: list[str], blocks: list[Block]) -> list[bool]:
    """Whether each block is text of the article."""
    n = len(first)

    def nearest(order: range) -> tuple[list[str | None], list[bool]]:
        """The nearest decided label before each block on its side, and whether a near-good block stands in between."""
        label: list[str | None] = [None] * n
        between = [False] * n
        last: dict[bool, str] = {}
        near = {False: False, True: False}
        for k in order:
            side = bool(blocks[k].article)
            label[k], between[k] = last.get(side), near[side]
            if first[k] in ("good", "bad"):
                last[side], near[side] = first[k], False
            elif first[k] == "near":
                near[side] = True
        return label, between

    (before, near_before), (after, near_after) = nearest(range(n)), nearest(range(n - 1, -1, -1))
    # Where nothing is good, what an article element holds goes before what stands around it.
    nothing_good, within = "good" not in first, any(b.article for b in blocks)
    out = []
    for k, label in enumerate(first):
        sides = {before[k], after[k]} - {None}
        if label in ("good", "bad"):
            out.append(label == "good")
        elif not sides:
            out.append(nothing_good and bool(blocks[k].article) == within)
        elif len(sides) == 1:
            out.append("good" in sides or nothing_good and label == "near" and bool(blocks[k].article) == within)
        else:  # the side that says bad may have a near-good block closer by
            out.append(label == "near" or (near_before[k] if before[k] == "bad" else near_after[k]) or blocks[k].heading and after[k] == "good")
    return out


def in_the_article(blocks: list[Block]) -> list[Block]:
    """The blocks that no mark rejects: a marked element that holds nearly all text without links is the page's frame."""
    blocks = [b for b in blocks if not b.outside]
    plain = [len(b.text) if b.links <= LINKS else 0 for b in blocks]
    held: dict[int, int] = {}
    for b, n in zip(blocks, plain):
        for m in b.marked:
            held[m] = held.get(m, 0) + n
    total, free = sum(plain), sum(n for b, n in zip(blocks, plain) if not b.marked)
    frames = {m for m, n in held.items() if n and (n == total if m < 0 else n >= FRAME * (n + free) and 2 * n > total)}
    return [b for b in blocks if frames.issuperset(b.marked)]


def short_articles(first: list[str], blocks: list[Block]) -> list[str]:
    """Labels with the blocks of article elements that hold short ones alone decided; see above."""
    within: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        if b.article:
            within.setdefault(b.article, []).append(k)
    size = lambda chosen: sum(len(blocks[k].text) for k in chosen)
    elsewhere = [k for k, label in enumerate(first) if label == "good"]
    out = list(first)
    for own in within.values():
        if all(first[k] in ("short", "near", "poor") for k in own) and size(k for k in own if blocks[k].links <= LINKS) >= LONG:
            for k in own:
                out[k] = "good" if blocks[k].links <= LINKS else "bad"
            if size(elsewhere) <= size(own):
                for k in elsewhere:
                    out[k] = "bad"
    return out


def main_text(html: str | None) -> str:
    blocks = in_the_article(blocks_of(html or ""))
    return " ".join(b.text for b, good in zip(blocks, second_pass(short_articles(first_pass(blocks), blocks), blocks)) if good)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        "html",
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
