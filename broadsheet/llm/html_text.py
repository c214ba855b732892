"""Operator 7: main text of web pages by two passes of block rules.

A page falls into blocks at its block-level tags. Pass one classifies a block by stop-word density, link density and
length as good, near, short or bad; standing in an article raises a block by a step, standing beside one lowers it, and
what can't be text by its element (navigation, a form, a footer) is bad. A class name is a hint: the blocks it stands for
go, unless the page had no text then. Pass two lets near and short blocks inherit the label of their nearest decided
neighbours, inside an article only of those in the same article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words of the languages at hand; a parameter of extract().
STOP_WORDS = frozenset(
    """
    the of and to in is that it for on with as was by be are at this from or an a not have has but they which you he his
    le la les de des du et un une en que qui pour dans est sur pas au avec il elle ce se par plus ne
    der die das und ist ein eine den von zu mit für auf sich nicht als auch es dem im an aus bei wie
    el los las y del una por con no su para al lo como más pero sus o si ha este
    """.split()
)
# Elements whose content is no markup (their end is the next end tag of that name), and others never shown
# as text.
RAW = frozenset("script style textarea title iframe noscript xmp noframes noembed".split())
UNSEEN = frozenset("template object svg math canvas audio video select".split())
OUTSIDE = frozenset("nav footer aside form button menu dialog".split())
MAIN = frozenset("article main".split())
# Elements that part blocks.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead tr ul button
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOLD = frozenset("b strong".split())
#: Elements whose end tags may be left out: the next one of the same name ends them.
REPEATING = frozenset("p li td th tr dt dd option".split())
# Words in class, id or role that tell what a part of a page is for.
PARTS = frozenset(
    """
    ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside nav navbar
    navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification
    popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist
    respond replies disqus related recommended pagination pager toolbar search form copyright disclaimer complementary
    contentinfo alert
    """.split()
)
#: Of these, the ones that inside an article name its own head; and words that make a name tell of a state, not a part.
OWN_HEAD = frozenset("header masthead".split())
STATES = frozenset("has is no not with without".split())
LINK_DENSITY, ALL_LINKS = 0.33, 0.9
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.16
HEADING_REACH = 200

# Quotes matter after an equals sign only; each part is possessive, so that a tag is read once. A quote without its
# partner is the last of its kind on the page, so looking for the partner in vain happens once a kind.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+[\"']?true", re.I)
_LINK = re.compile(r"\bhref\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    outside: bool  # in an element that never holds text, or hidden
    named: bool  # in an element whose class, id or role tells of another part
    around: bool  # the same, but told of the article itself or of what it stands in
    region: int  # the article it stands in, from 1; 0: none
    heading: bool
    label: str = ""

    @property
    def removed(self) -> bool:
        return self.outside or self.named or self.around


@dataclass(frozen=True)
class _Open:
    name: str
    outside: bool
    named: bool
    around: bool
    region: int


def _tells_part(names: str, in_main: bool) -> bool:
    """Whether one of the names, or the last part of one, is in PARTS."""
    for name in names.split():
        parts = re.split(r"[_-]+", name)
        for part in (name, parts[-1]):
            if part in PARTS and parts[0] not in STATES and not (in_main and part in OWN_HEAD):
                return True
    return False


class _Blocks:
    """One pass over a page, linear in its length: flags are inherited when an element opens, and an end tag looks for
    its element only if one is open."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.stack = [_Open("", False, False, False, 0)]
        self.opened: Counter[str] = Counter()
        self.regions = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.plain = 0  # characters of a block that aren't bold
        self.in_link = self.heading = False
        self.bold = 0

    def add(self, piece: str) -> None:
        self.parts.append(piece)
        if self.in_link:
            self.linked.append(piece)
        if not self.bold:
            self.plain += len(piece.strip())

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            top = self.stack[-1]
            linked = len(" ".join(html.unescape("".join(self.linked)).split()))
            self.found.append(Block(text, linked, top.outside, top.named, top.around, top.region, self.heading or not self.plain))
        self.parts, self.linked, self.plain = [], [], 0

    def open(self, name: str, attributes: str) -> None:
        if name in REPEATING and self.stack[-1].name == name:
            self.opened[self.stack.pop().name] -= 1
        top, outside, named = self.stack[-1], False, False
        if name not in ("html", "body"):
            outside = name in OUTSIDE or (name == "header" and not top.region) or bool(_HIDDEN.search(attributes))
            named = _tells_part(" ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower(), bool(top.region) or name in MAIN)
        named, outside = named or top.named, outside or top.outside
        if name in MAIN and not top.region:
            self.regions += 1
            self.stack.append(_Open(name, outside, False, named, self.regions))
        else:
            self.stack.append(_Open(name, outside, named, top.around, top.region))
        self.opened[name] += 1
        self.heading = name in HEADINGS

    def close(self, name: str) -> None:
        self.heading = False
        while self.opened[name]:
            last = self.stack.pop().name
            self.opened[last] -= 1
            if last == name:
                break


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with white space made one space and character references decoded."""
    b, at, end = _Blocks(), 0, len(page)
    unclosed: set[str] = set()
    muted, depth = "", 0  # the element whose text isn't shown, and how often it is open
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at and not muted:
            b.add(page[at:start])
        if start == end:
            break
        if page.startswith(("<!", "<?", "</"), start) and not page[start + 2 : start + 3].isalpha() or page.startswith("<!", start):
            # comments, declarations and what only looks like an end tag
            close = next((c for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, start)), ">")
            stop = page.find(close, start + 2)
            at = end if stop < 0 else stop + len(close)
            continue
        m = _TAG.match(page, start)
        if not m:
            if page[start + 1 : start + 2].isalpha() or page.startswith("</", start):
                break  # a tag that never ends takes the rest of the page
            if not muted:
                b.add("<")
            at = start + 1
            continue
        at, name, closing, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
        if muted:
            depth += (name == muted) * (-1 if closing else 0 if attributes.endswith("/") else 1)
            muted = muted if depth else ""
            continue
        if name in RAW or name in UNSEEN:
            if closing or (name in UNSEEN and attributes.endswith("/")):
                continue
            stop = None if name in unclosed else re.compile(rf"</{name}\b", re.I).search(page, at)
            if not stop:
                unclosed.add(name)
                if name in ("script", "style"):
                    break
            elif name in RAW:
                stop = page.find(">", stop.end())
                at = end if stop < 0 else stop + 1
            else:
                muted, depth = name, 1
        elif name == "a":
            b.in_link = not closing and bool(_LINK.search(attributes))
        elif name == "br":
            b.parts.append(" ")
        elif name in BOLD:
            b.bold = max(0, b.bold + (-1 if closing else 1))
        elif name in BLOCKS:
            b.flush()
            b.bold = 0
            if closing:
                b.close(name)
            elif name not in VOID:
                b.open(name, attributes)
        elif not closing and name not in VOID and not attributes.endswith("/") and _HIDDEN.search(attributes) and name not in unclosed:
            if re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at):
                muted, depth = name, 1  # hidden words inside a block
            else:
                unclosed.add(name)
    b.flush()
    return b.found


def density(text: str, stop_words: frozenset[str]) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return sum(w in stop_words for w in words) / max(1, len(words))


def first_label(block: Block, stop_words: frozenset[str], marked: bool) -> str:
    """Pass one: good, near, short or bad. marked: the page marks an article, in which this block stands or not."""
    n, links = len(block.text), block.linked / len(block.text)
    if block.removed:
        return "bad"
    if links > LINK_DENSITY and not (block.region and links < ALL_LINKS and n > SHORT):
        return "bad"
    if n < SHORT:
        return "bad" if marked and not block.region else "short"
    stops = density(block.text, stop_words)
    grade = 0 if stops < STOP_LOW else 2 if stops >= STOP_HIGH and n >= LONG else 1
    grade += 1 if block.region else -1 if marked else 0
    return "good" if grade >= 2 else "near" if grade == 1 else "bad"


def _nearest(labels: list[str], at: range, decided: list[int]) -> dict[int, str | None]:
    """For each place the label of the last decided one before it, in the order of `at`."""
    out, last, known = {}, None, set(decided)
    for i in at:
        out[i] = last
        if i in known:
            last = labels[i]
    return out


def inherit(found: list[Block], labels: list[str], surely: bool) -> list[str]:
    """Pass two. surely: what is good is so by its words; else a short block needs two good neighbours even in an article."""
    out = list(labels)
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    places: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        places.setdefault(0 if b.removed else b.region, []).append(i)
    for region, own in places.items():
        # in an article, what was taken out of it is no neighbour; elsewhere every block of the page is
        among = own if region else list(range(len(found)))
        near = [i for i in decided if not region or found[i].region == region and not found[i].removed]
        back, on = _nearest(labels, among, near), _nearest(labels, among[::-1], near)
        for i in own:
            if labels[i] in ("good", "bad") or found[i].heading:
                continue
            sides = (back[i], on[i])
            enough = sides == ("good", "good") if labels[i] == "short" and not (region and surely) else "good" in sides
            out[i] = "good" if enough else "bad"
    # a heading goes with the good block that follows soon, or in an article with the one before
    ahead, distance, before = None, 0, {}
    for i, b in enumerate(found):
        before[i] = ahead if b.region and ahead == b.region else None
        if out[i] == "good":
            ahead = b.region
    ahead = None
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if out[i] in ("good", "bad"):
            if out[i] == "good":
                ahead, distance = b.region, 0
            else:
                distance += len(b.text)
            continue
        follows = ahead is not None and (distance <= HEADING_REACH or (b.region and ahead == b.region))
        out[i] = "good" if follows or (before[i] is not None and surely) else "bad"
        if out[i] == "good":
            ahead, distance = b.region, 0
        else:
            distance += len(b.text)
    return out


def classify(found: list[Block], stop_words: frozenset[str] = STOP_WORDS) -> list[Block]:
    """Both passes; sets the labels good and bad.

    Hints that leave a page without text are not believed. If no block of a page is good by its words, blocks with any
    stop word are; if it has none at all, the long ones; if there is none, what the page marks, or its only block.
    """
    if not any(b.region and not b.removed for b in found):
        for b in found:  # the only article stands in, or is, something with such a name
            b.around = False
    marked = any(b.region and not b.removed for b in found)
    labels = [first_label(b, stop_words, marked) for b in found]
    if "good" not in labels and not marked:
        named = [b for b in found if b.named]
        for b in named:
            b.named = False
        again = [first_label(b, stop_words, marked) for b in found]
        if "good" in again:
            labels = again
        else:
            for b in named:
                b.named = True
    surely = True
    if "good" not in labels:
        may = [i for i, x in enumerate(labels) if x in ("near", "short") and (found[i].region or not marked)]
        some = [i for i in may if (found[i].region or labels[i] == "near") and density(found[i].text, stop_words) > 0]
        long = [i for i, b in enumerate(found) if len(b.text) >= LONG and labels[i] == "near"]
        surely = bool(some)
        for i in some or long or (may if marked or len(found) == 1 else []):
            labels[i] = "good"
    for b, label in zip(found, inherit(found, labels, surely)):
        b.label = label
    return found


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The good blocks of a page, joined by line feeds; empty if there are none."""
    return "\n".join(b.text for b in classify(blocks(page or ""), stop_words) if b.label == "good")


def extract_column(page: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, stop_words) for p in pages], dtype=object)

    return run(page)


def extract(df: DataFrame, html_col: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """df with text and n_chars (code points) in place of html_col. Null and empty pages have empty text.

    Comments, script and style reach to their end or to the end of the page; a tag that never ends takes the rest of the
    page, as in browsers; other unclosed elements end with what they stand in. Reading a page is linear in its length.
    Columns of df named text or n_chars are replaced, others stay. Repeated rows are extracted each; an empty table gives
    no rows.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in (html_col, "text", "n_chars")]
    out = df.select(*others, extract_column(F.col(f"`{html_col}`"), stop_words).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
