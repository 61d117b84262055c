"""Main-text extraction from HTML by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by the element it stands in
(menus, headers, footers, hidden parts, dialogs and the like are out), then by link density, length and the
density of stop words. A page in another language than the four of the stop words is told by having hardly
any; there a sentence's end stands in for them, and letters of scripts without spaces count as words by
pairs. Blocks too short to decide are left open. The second pass gives an open block the label of its
nearest decided neighbour in its container (on a tie the one before it, for a heading the one after it),
without one there that of its nearest on the page. Where no block is in, the open blocks of the container
that has most of them are.

Class and id names that speak of menus, adverts, sidebars or comments, and forms, put an element out by a weight: it
stays in if it holds nine tenths of the text around it (a frame of the whole page) and some of it is long, for names of comments if there is
no other text at all.

An article or main element shifts these rules and replaces none: where it holds text that is in by itself,
text outside must be longer to be in. An open block inside stays in unless the decided blocks on both sides
are out, or nothing inside is in by itself and less text is open there than is in outside. An open block
outside follows decided blocks outside only.

Null and empty html give an empty text. Texts are never cut; unknown references stay as they are. Only
the named columns are read, so others may have any name. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML that start a new block, that are never text, and that frame a page
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody tfoot thead tr ul caption title".split()
)
FORMS = frozenset(["form", "fieldset"])
SILENT = frozenset("head title nav footer aside menu select button textarea datalist dialog iframe object audio video canvas svg template noscript search".split())
RAW = "script style xmp noembed noframes"
FRAME = BLOCK - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "option", "caption", "legend", "summary"} | SILENT | FORMS
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in class and id names that mark what is not the article
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
    "disqus respond reply replies discussion related recommended recommendations share sharing social newsletter subscribe subscription signup "
    "login pagination pager widget toolbar skip".split()
)
TALK = frozenset("comment comments disqus respond reply replies discussion".split())
HOMES = frozenset("html body main article section div center header td th details".split())
# Frequent function words of English, German, French and Spanish
STOP = frozenset(
    "the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your "
    "der die das und zu den mit von für auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei sich des "
    "le la les de des du et un une que qui dans en est pour pas sur au avec ce il par plus se ne sont ou son "
    "el los las del y que en un una por con no su para es al lo como más o pero sus se le ya este".split()
)
_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<(script|style|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\b[^>]*>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>|<[!?/].*|<[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_LOUD = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# What a class name begins with that says what an element has, not what it is
HAS = frozenset("with has have no not without is js".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADING = re.compile(r"h[1-6]\Z")


def _marked(names: str) -> set[str]:
    """Words of class or id names that are those of something else than an article."""
    found = set()
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if parts and parts[0] not in HAS:
            found |= MARKS.intersection(parts)
    return found


def _says(attributes: str) -> tuple[bool, set[str]]:
    """Whether the element's own attributes hide it or give it another role, and the marks among its names."""
    hard, marks = False, set()
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            marks |= _marked(value)
        hard |= key == "hidden" or bool(key == "style" and _LOUD.search(value)) or (key == "role" and value.lower() in ROLES) or (key == "aria-hidden" and value.lower() == "true")
    return hard, marks


class _Marks:
    """Marked elements as a tree: parent (-1: none around), and whether the names are of comments."""

    def __init__(self):
        self.parent, self.talk = [], []

    def add(self, parent: int, words: set[str]) -> int:
        self.parent.append(parent)
        self.talk.append(not TALK.isdisjoint(words))
        return len(self.parent) - 1

    def lifted(self, made: list[_Block]) -> list[bool]:
        """For each marked element whether it is but a frame: nine tenths of the text around it, long and all, are in it, and no
        article is beside it."""
        long, any_text, framed = ([0] * (len(self.parent) + 1) for _ in range(3))  # the last is the page
        for b in made:
            if not b.out and b.linked <= 0.2 * b.size:
                any_text[b.mark] += b.size
                long[b.mark] += b.size if b.size >= LONG else 0
                framed[b.mark] += b.inside
        for k in reversed(range(len(self.parent))):
            long[self.parent[k]] += long[k]
            any_text[self.parent[k]] += any_text[k]
            framed[self.parent[k]] += framed[k]
        found: list[bool] = []
        for k, parent in enumerate(self.parent):
            most = any_text[k] == any_text[parent] if self.talk[k] else min(10 * long[k] - 9 * long[parent], 10 * any_text[k] - 9 * any_text[parent]) >= 0
            beside = framed[parent] > 0 and not framed[k]  # an article is elsewhere
            found.append((parent < 0 or found[parent]) and long[k] > 0 and most and not beside)
        return found


class _Block:
    __slots__ = ("heading", "home", "inside", "linked", "mark", "out", "parts", "size", "text")

    def __init__(self, inside: bool, out: bool, heading: bool, home: int, mark: int):
        self.parts, self.linked, self.inside, self.out, self.heading, self.home, self.mark = [], 0, inside, out, heading, home, mark


class Found(NamedTuple):
    """A block that has text; ``home`` numbers its container."""

    text: str
    linked: float  # share of letters in links
    inside: bool  # an article
    out: bool  # by the element that it stands in
    heading: bool
    home: int


class _Frame:
    """An open element, with what it and the elements around it say about text inside."""

    __slots__ = ("article", "hard", "home", "kinds", "mark", "name", "other", "strict", "strong")

    def __init__(self, name: str, attributes: str, around: _Frame | None, marks: _Marks, number: int):
        hard, words = _says(attributes) if name not in ("html", "body") and attributes else (False, set())
        own = name in ("article", "main")
        self.name = name
        self.article = own or (around is not None and around.article)
        # an article inside a marked element is not put out by it, only by marks of articles and those inside
        self.strict = (hard and own) or (around is not None and around.strict)
        self.hard = hard or self.strict or (around is not None and around.hard and not own)
        outer = -1 if around is None else around.strong if own else around.mark
        self.mark = marks.add(outer, words) if words or name in FORMS else outer
        self.strong = self.mark if own and words else -1 if around is None else around.strong
        kind = name in SILENT or name == "header"
        self.kinds = kind or (around is not None and around.kinds)
        self.other = (kind and name != "header") or (around is not None and around.other)
        self.home = number if name in HOMES or around is None else around.home


LONG = 60  # letters of a text that weighs in the judgement of a marked element


def blocks(page: str) -> list[Found]:
    """Each block that has text."""
    made: list[_Block] = []
    stack: list[_Frame] = []
    opened: Counter[str] = Counter()  # how many elements of a name are open
    marks, frames = _Marks(), 0
    links, heading, own, fresh, at = 0, False, (False, set()), True, 0

    def text(piece: str) -> None:
        nonlocal fresh
        if fresh:
            top = stack[-1] if stack else None
            inside, hard, kinds, mark = (top.article, top.hard, top.kinds, top.mark) if top else (False, False, False, -1)
            lead = heading and inside and not hard and mark < 0 and kinds and not top.other
            mark = marks.add(mark, own[1]) if own[1] else mark
            made.append(_Block(inside, (kinds and not lead) or hard or own[0], heading, top.home if top else -1, mark))
            fresh = False
        piece = htmllib.unescape(piece)
        made[-1].parts.append(piece)
        if links:
            made[-1].linked += len(piece.strip())

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = m[2] == "/"
        if name in BLOCK:
            fresh, links = True, links if name in ("li", "ul", "ol") else 0
            heading = bool(_HEADING.match(name)) and not closing
            own = _says(m[4]) if not closing and name not in FRAME and m[4] else (False, set())
        elif name in ("br", "td", "th", "img") and not fresh:
            made[-1].parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        if name in FRAME or (not closing and name == "span" and m[4] and any(_says(m[4]))):
            if not closing:
                if not m[4].endswith("/") or name in BLOCK:
                    frames += 1
                    stack.append(_Frame(name, m[4], stack[-1] if stack else None, marks, frames))
                    opened[name] += 1
                    fresh = True
            elif opened[name]:
                while (top := stack.pop().name) != name:
                    opened[top] -= 1
                opened[name] -= 1
                fresh = True
        elif closing and name == "span" and stack and stack[-1].name == "span":
            opened[stack.pop().name] -= 1
            fresh = True
    if at < len(page):
        text(page[at:])
    for b in made:
        b.text = " ".join("".join(b.parts).split())
        b.size = len(b.text)
    made = [b for b in made if b.size]
    lifted = marks.lifted(made)
    return [Found(b.text, min(1.0, b.linked / b.size), b.inside, b.out or (b.mark >= 0 and not lifted[b.mark]), b.heading, b.home) for b in made]


IN, OUT, OPEN = 1, 0, -1


LEAST_WORDS, SURE_WORDS = 10, 40
OUTSIDE_WORDS = 20  # in place of LEAST_WORDS for a block outside an article that has text
FOREIGN = 0.08  # a page with a smaller share of stop words is in none of their languages
_CLOSE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")  # scripts without spaces: Thai, kana, Han
_SENTENCE = re.compile("[.!?…。！？।؟]")


def first_pass(found: list[Found]) -> list[int]:
    measured = []
    for b in found:
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in STOP for w in words)
        measured.append((len(words) + len(_CLOSE.findall(b.text)) // 2, len(words), stops))
    told = [m for m, b in zip(measured, found, strict=True) if not b.out and m[0] >= LEAST_WORDS]
    foreign = sum(m[2] for m in told) < FOREIGN * sum(m[1] for m in told)
    labels, unsure = [], []
    for k, ((n, words, stops), b) in enumerate(zip(measured, found, strict=True)):
        dense = stops / words
        if b.out:
            labels.append(OUT)
        elif (b.linked > 0.5 or (b.linked > 0.2 and n < LEAST_WORDS)) and not (b.inside and b.heading):
            labels.append(OUT)
        elif n >= LEAST_WORDS and (dense >= 0.2 or n >= SURE_WORDS or (foreign and not b.inside and _SENTENCE.search(b.text))):
            labels.append(IN)
        else:
            if not b.inside and (b.text[0] in "©|" or (n >= LEAST_WORDS and dense < 0.05 and not b.heading)):
                unsure.append(k)
            labels.append(OPEN)
    homes = {b.home for b, v in zip(found, labels, strict=True) if v == IN}
    for k in unsure:  # hardly prose: out where nothing around it is in
        labels[k] = OPEN if found[k].home in homes else OUT
    if any(v == IN and b.inside for v, b in zip(labels, found, strict=True)):
        labels = [OPEN if v == IN and not b.inside and m[0] < OUTSIDE_WORDS else v for v, b, m in zip(labels, found, measured, strict=True)]
    return labels


def contained_pass(found: list[Found], labels: list[int]) -> list[int]:
    """The second pass of a page without an article: open blocks look in their container first."""
    homes: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b.out:
            homes.setdefault(b.home, []).append(i)
    if IN not in labels:
        most = max(homes.values(), key=lambda rows: sum(len(found[i].text) for i in rows if labels[i] == OPEN), default=[])
        chosen = set(most)
        return [IN if v == OPEN and i in chosen else OUT for i, v in enumerate(labels)]
    done = list(labels)
    for rows in homes.values():
        mine = [labels[i] for i in rows]
        if IN in mine or OUT in mine:
            for i, v in zip(rows, second_pass(mine, [found[i].heading for i in rows]), strict=True):
                done[i] = v
    return second_pass(done, [b.heading for b in found])


def second_pass(labels: list[int], headings: list[bool]) -> list[int]:
    """Open labels take that of the nearest decided block; on a tie the earlier one, for a heading the later."""
    done = list(labels)
    decided = [i for i, v in enumerate(labels) if v != OPEN]
    for i, v in enumerate(labels):
        if v == OPEN:
            k = bisect(decided, i)
            done[i] = labels[min(decided[max(k - 1, 0) : k + 1], key=lambda d: (abs(d - i), (d < i) == headings[i]))] if decided else OUT
    return done


def framed_pass(found: list[Found], labels: list[int]) -> list[int]:
    """The second pass of a page with an article: open blocks inside and outside are decided apart."""
    done = list(labels)
    outside = [i for i, b in enumerate(found) if not b[2]]
    for i, v in zip(outside, second_pass([labels[i] for i in outside], [found[i][4] for i in outside]), strict=True):
        done[i] = v
    inside = [i for i, b in enumerate(found) if b[2] and not b[3]]
    size = lambda rows: sum(len(found[i][0]) for i in rows)
    holds = any(labels[i] == IN for i in inside) or size(i for i in inside if labels[i] == OPEN) >= size(i for i in outside if done[i] == IN)
    decided = [i for i in inside if labels[i] != OPEN]
    for i in inside:
        if labels[i] == OPEN:
            k = bisect(decided, i)
            between = 0 < k < len(decided) and labels[decided[k - 1]] == OUT == labels[decided[k]]
            done[i] = IN if holds and not between else OUT
    return done


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = first_pass(found)
    framed = any(b.inside and not b.out for b in found)
    keep = framed_pass(found, labels) if framed else contained_pass(found, labels)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k == IN)


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` and the main ``text`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([main_text(x.as_py()) for x in batch.column(len(keys))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*keys, "text"])

    given = pages.select(*keys, F.col(html).alias("_html"))
    kinds = ", ".join(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys)
    return given.mapInArrow(run, f"{kinds}, text string")
