"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass 1 decides each block by link density, length and stop-word density; text
inside navigation, headers, footers and asides is decided at once. So is text in forms that hold less than half of the page, and in
elements whose class, id or role names an advert, menu or notice and nothing else, or tells of comments or cookies at either end
(user-comments, cookie-message), unless nothing else of the page stays; these marks end at an article or main element, those of comments
do not, and an article may be a comment itself. A name that is only the end of a longer one (entry-header) makes pass 1 stricter. Pass 2 gives each ambiguous
short block the label of its nearest decided neighbour: within an article only text passes on its label, elsewhere both do, and
on a tie the text stays. A page without any decided block keeps its blocks. Where the articles of a page hold at least half of
the text kept, text outside them goes; else only articles without decided text go.

Cases: null and empty pages, and pages without text, give an empty text. Unclosed and wrongly nested tags are tolerated, and quotes
that are never closed hide no text; the time is linear in the page. Empty tables give none, repeated pages repeated rows; other
columns are not read. Pages are handled one by one, whole, in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Elements whose whole content goes.
DROPPED = frozenset("script style noscript template head iframe object svg math canvas select option button textarea audio video".split())
#: Elements whose blocks are boilerplate.
BOILERPLATE = frozenset("nav footer aside menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner menu nav navbar navigation navigationbar breadcrumb breadcrumbs sidebar aside rail "
    "footer foot header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "disqus reply replies respond related recommended recommendations share sharing social toolbar pagination pager widget search complementary contentinfo banner".split()
)
#: Words that may stand beside them, words that negate them, and names of a title block where they are in an article.
PLACES = frozenset("site page top bottom left right main primary secondary global inner outer box bar list item items link links slot unit container wrapper wrap block section area body row col panel form text icon icons".split())
NEGATED = frozenset("no non has have with without hide hides hidden show shows is not".split())
TITLES = frozenset("header head masthead banner".split())
#: Beginnings of words, at either end of a name, that tell reader comments or notices whatever else the name says; unless it tells a state.
COMMENTS, NOTICES = ("comment", "disqus", "reply", "replies"), ("cookie", "consent", "gdpr")
STATES = frozenset("open closed enabled disabled allowed count counts number off on status ping pings free".split())
#: How far an element's mark goes: a name makes pass 1 stricter; a form drops its blocks, unless it holds most of the page; a name drops
#: them up to an article in it, a name of comments also beyond; a tag does so for good.
FREE, HINTED, FORMED, NAMED, COMMENTED, TAGGED = range(6)
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with be at by this have from or an not but which they you his her he she we their has had were been one all there who what when "
    "de la le les des du et un une en que qui est pour dans sur au aux par pas plus ne ce il elle avec sont ou son sa ses "
    "der die das und ist in den von zu mit sich des auf für ein eine einer dem nicht auch als es an werden aus er hat dass sie nach wird bei "
    "el los las del y que en un una por con no se su para es al lo como más o pero sus le ha este si".split()
)
#: Pass 1: more than LINKS of a block's characters in links is boilerplate; at least LONG characters, or MEDIUM with enough stop words, is text.
LINKS, SHORT, LONG, LOW, HIGH = 0.5, 70, 200, 0.10, 0.20

_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)")
#: The end of a tag, or a quote that opens a value (one that stands elsewhere is a character like any other).
_STOP = re.compile(r">|=\s*[\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Where an element that goes as a whole ends.
_END = {tag: re.compile(rf"</{tag}\s*>" + (r"|<body[\s>]" if tag == "head" else ""), re.I) for tag in DROPPED}
_EDGE = re.compile(r"^\W+|\W+$")


def mark(tag: str, attrs: str, in_article: bool) -> int:
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return TAGGED
    if tag in ("html", "body", "main"):
        return FREE
    level = FORMED if tag == "form" else FREE
    for values in _NAMED.findall(attrs) if attrs else ():
        for token in "".join(values).lower().split():
            parts = [p for p in re.split(r"[^a-z]+", token) if p]
            if not parts or not NEGATED.isdisjoint(parts):
                continue
            ends = parts[0], parts[-1]
            told = [k for k, stems in ((COMMENTED, COMMENTS), (NAMED, NOTICES)) if any(e.startswith(s) or e.endswith((s, s + "s")) for e in ends for s in stems)]
            if told and STATES.isdisjoint(parts):
                level = max(level, *told)
                continue
            named = [p for p in parts if p in NAMES and not (in_article and p in TITLES)]
            if not named or told or tag == "article":
                continue
            if all(p in NAMES or p in PLACES for p in parts):
                level = max(level, NAMED)
            elif parts[-1] in NAMES:
                level = max(level, HINTED)
    return level


def tokens(page: str) -> Generator[tuple[str, str, str, int], int | None, None]:
    """(kind, tag, what it holds, end) of each piece of a page: text, open or close. Comments and declarations give none. A reader may
    send the place to go on at. Each search that fails is made once, so the time is linear in the page whatever its markup."""
    at, n, quoted = 0, len(page), True
    closed = page.rfind(">") + 1  # no tag ends beyond
    while at < n:
        begin = page.find("<", at)
        begin = n if begin < 0 else begin
        if begin > at:
            at = (yield "text", "", page[at:begin], begin) or begin
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end, after = (n, n) if end < 0 else (end, end + 3)
            at = (yield "text", "", page[at + 9 : end], after) or after
        elif page.startswith(("<!", "<?"), at) and at < closed:
            at = page.find(">", at) + 1
        elif at < closed and (m := _TAG.match(page, at)):
            end = -1
            if quoted:  # values may hold a >, unless a quote is never closed
                stop = _STOP.search(page, m.end())
                while stop and stop[0] != ">":
                    shut = page.find(stop[0][-1], stop.end())
                    stop = _STOP.search(page, shut + 1) if shut >= 0 else None
                end = stop.start() if stop else -1
                quoted = end >= 0
            end = page.find(">", m.end()) if end < 0 else end
            at = (yield "close" if m[1] else "open", m[2].lower(), page[m.end() : end], end + 1) or end + 1
        else:
            at = (yield "text", "", "<", at + 1) or at + 1


def blocks(page: str) -> list[tuple[str, int, int, int]]:
    """(text, characters in links, mark, article number or 0) of each block with text, in page order."""
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, mark, article
    opened: Counter = Counter()  # how often each tag is in the stack
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = links = articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, linked, *(stack[-1][1:] if stack else (FREE, 0))))
            parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    stream = tokens(page)
    token = next(stream, None)
    while token:
        (kind, tag, content, at), go = token, None
        if kind == "text":
            content = html.unescape(content)
            parts.append(content)
            if links:
                linked += len(content)
        elif tag in DROPPED and kind == "open":
            if not content.endswith("/"):
                end = None if tag in unclosed else _END[tag].search(page, at)
                if end is None:
                    unclosed.add(tag)
                go = len(page) if end is None else end.start() if end[0][1] != "/" else end.end()
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        else:
            if tag == "a":
                links = int(kind == "open")
            level = mark(tag, content, bool(stack and stack[-1][2])) if kind == "open" else FREE
            # an inline tag breaks no block, unless its class makes it boilerplate
            if tag not in INLINE or (opened[tag] if kind == "close" else level >= NAMED):
                flush()
                links = 0
                if kind == "close":
                    if opened[tag]:
                        while pop() != tag:
                            pass
                elif tag not in VOID and not content.endswith("/"):
                    if tag in ("p", "li") and stack and stack[-1][0] == tag:
                        pop()
                    top = stack[-1] if stack else ("", FREE, 0)
                    article = top[2]
                    if tag in ("article", "main") and not article and max(top[1], level) < COMMENTED:
                        articles += 1
                        article = articles
                    above = FREE if tag in ("article", "main") and top[1] < COMMENTED else top[1]
                    stack.append((tag, max(above, level), article))
                    opened[tag] += 1
        token = _after(stream, go)
    flush()
    return out


def _after(stream: Generator, place: int | None) -> tuple | None:
    """The next token, from a place or from the end of the last one."""
    try:
        return stream.send(place)
    except StopIteration:
        return None


def first_pass(text: str, linked: int, level: int) -> bool | None:
    """True: text, False: boilerplate, None: ambiguous."""
    if level >= FORMED or linked > (LINKS / 2 if level else LINKS) * len(text):
        return False
    words = text.split()
    density = sum(_EDGE.sub("", w).lower() in STOP_WORDS for w in words) / len(words)
    if len(text) < SHORT:
        return None
    if density >= HIGH or (density >= LOW and len(text) >= LONG):
        return True
    return True if len(text) >= LONG and not level else None


def second_pass(labels: list[bool | None], groups: list[int]) -> list[bool]:
    """Pass 2 in linear time: nearest decided neighbour before and after, in the block's own article and on the page."""
    n = len(labels)
    near: list[dict] = [{} for _ in range(n)]
    for side, order in (("before", range(n)), ("after", range(n - 1, -1, -1))):
        last: dict[int | None, int] = {}
        for i in order:
            near[i][side] = (last.get(groups[i]), last.get(None))
            if labels[i] is not None:
                last[groups[i]] = last[None] = i
    out = []
    for i, label in enumerate(labels):
        for scope in (0, 1) if groups[i] else (1,):
            if label is None:
                found = [(abs(i - j), not labels[j]) for j in (near[i]["before"][scope], near[i]["after"][scope]) if j is not None and not (scope == 0 and labels[j] is False)]
                if found:
                    label = not min(found)[1]
            if label is None and scope == 0:
                label = True  # an article without decided text keeps its short blocks
        out.append(label is not False)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    formed, open_ = (sum(len(text) for text, _, level, _ in found if level in levels) for levels in ((FORMED,), (FREE, HINTED)))
    if formed > open_:  # a form around the page
        found = [(text, linked, FREE if level == FORMED else level, article) for text, linked, level, article in found]
    articles = [article for *_, article in found]
    labels = [first_pass(text, linked, level) for text, linked, level, _ in found]
    kept = second_pass(labels, articles)
    if True not in kept and any(FORMED <= level < TAGGED for *_, level, _ in found):  # names alone don't empty a page
        labels = [first_pass(text, linked, HINTED if FORMED <= level < TAGGED else level) for text, linked, level, _ in found]
        kept = second_pass(labels, articles) if True in labels else kept
    inside, outside = (sum(len(b[0]) for b, keep in zip(found, kept, strict=True) if keep and bool(b[3]) == x) for x in (True, False))
    solid = {article for article, label in zip(articles, labels, strict=True) if label}
    stays = (lambda article: article) if inside >= outside and inside else (lambda article: not article or not outside or article in solid)
    return "\n\n".join(text for (text, *_, article), keep in zip(found, kept, strict=True) if keep and stays(article))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["_key", "_url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(content).alias("_html")).mapInArrow(extract, f"_key {kind}, _url string, text string, n_chars long")
    return found.withColumnsRenamed({"_key": key, "_url": url})


ship(__name__)
