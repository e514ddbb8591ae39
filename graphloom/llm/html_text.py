"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of the page. A line weighs what its text is worth: its length
in characters, nothing if it is made of links or is a copyright notice, and nothing if the page itself marks
it as something else than text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments). The weights of WINDOW successive lines are summed. Where the sum rises from nothing, text surges; where
it falls back to nothing, it dives: so WINDOW lines without weight part two stretches, fewer do not. A stretch
counts if its greatest sum reaches SURGE of the greatest sum on the page, and all lines between its surge and its
dive are kept, links and all, but for those that the page marks.

Where the page has articles (or a main part), their lines are looked at alone, each article's for itself, and every
stretch in them counts. But if the lines around them hold BEYOND times as much, they are teasers, and the whole
page is looked at.

Null and empty pages, and pages without text, give an empty text. Rows are independent: equal rows give
equal results, an empty table gives an empty result, several stretches (also equal ones) are joined in page order,
and columns not named in the call are neither read nor touched; if `text` or `n_chars` is to be carried, name the
results otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

WINDOW, SURGE, BEYOND = 3, 0.125, 8
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("hr br img input link meta area base col embed source track wbr".split())
#: Elements whose content is no text of the page; of the first kind the end tag alone ends it.
TO_THE_END = frozenset("script style textarea".split())
RAW = TO_THE_END | frozenset("template noscript iframe svg math select object canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog head title button".split())
#: Words in class, id or role that tell what isn't the article.
TELLS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar footer header masthead breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal newsletter subscribe "
    "signup login share sharing social related recommended comment comments disqus reply replies pagination pager toolbar widget".split()
)
#: Words that say nothing next to one of those, and words that speak for the article but for the tells in NOT_ARTICLE.
BESIDE = frozenset(
    "top bottom left right middle box block list wrap wrapper container inner outer area section bar item items slot unit site page global "
    "primary secondary main form links link message user users reader readers the of on and sub module panel row col column group thread "
    "policy google text title heading label icon button buttons js fixed sticky mobile desktop".split()
)
ARTICLE = frozenset("article story post entry content blog news body".split())
NOT_ARTICLE = TELLS - frozenset("header notice notices banner".split())
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader |user )?(?:comments?|kommentare?|commentaires?|comentarios?|commenti|reacties|leave a (?:comment|reply))\W*(?:\d+\W*)?", re.I)
COPYRIGHT = re.compile(r"(?:copyright\s*)?(?:©|\(c\)\s*(?:\d{4}|copyright))|copyright\s+\d{4}", re.I)
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+)/?>", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class Line:
    """A block's text, its characters outside of links, whether the page marks it as no text, its article (in
    a main part without article the negative of that part's number, else 0), and whether it's a heading."""

    text: str
    free: int
    marked: bool
    article: int
    heading: bool

    def weight(self) -> int:
        if self.marked or COPYRIGHT.match(self.text):
            return 0
        linked = len(self.text) - self.free
        return len(self.text) if self.heading or linked <= (len(self.text) - 1 if self.article else self.free) else 0


def told(name: str) -> frozenset[str]:
    """What one word of a class, id or role tells against its element, if the rest of it doesn't tell otherwise."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    said = TELLS.intersection(words)
    return said if all(w in TELLS or w in BESIDE or (w in ARTICLE and said & NOT_ARTICLE) for w in words) else frozenset()


def is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    if name in BOILERPLATE:
        return not (name == "header" and in_article)
    if "=" not in attributes or name in ("body", "html", "main"):
        return False
    names = [n for found in NAMED.finditer(attributes) for n in "".join(filter(None, found.groups())).split()]
    against = TELLS - {"header"} if in_article else TELLS
    if name == "article" or any(n.lower() in ARTICLE for n in names):
        against &= NOT_ARTICLE
    return any(told(n) & against for n in names)


def lines_of(html: str) -> list[Line]:
    """The page's lines: blocks in page order."""
    lines: list[Line] = []
    run: list[str] = []
    free: list[str] = []
    open_blocks: list[tuple[str, bool, bool]] = []  # name, marked, article
    marks = links = number = 0
    inside: list[int] = []  # numbers of the open articles, negative for main parts
    comments: tuple[int, int] | None = None  # from a heading over comments: open blocks then, and its level
    at = 0

    def flush() -> None:
        nonlocal comments
        text = " ".join(unescape("".join(run)).split())
        if text:
            out = " ".join(unescape("".join(free)).split())
            level = next((int(b[0][1]) for b in reversed(open_blocks) if len(b[0]) == 2 and b[0][0] == "h" and b[0][1].isdigit()), 0)
            if comments and level and level <= comments[1]:
                comments = None
            if level and not marks and COMMENTS.fullmatch(text):
                comments = (len(open_blocks) - 1, level)
            # what stands between links alone, such as bars, is no text
            size = len(out) if out == text or any(c.isalnum() for c in out) else 0
            article = next((i for i in inside if i > 0), inside[0] if inside else 0)
            lines.append(Line(text, size, marks > 0 or comments is not None, article, level > 0))
        run.clear()
        free.clear()

    def close(k: int) -> None:
        nonlocal marks, comments
        for _, marked, article in open_blocks[k:]:
            marks -= marked
            if article:
                inside.pop()
        del open_blocks[k:]
        if comments and k < comments[0]:
            comments = None

    def say(text: str) -> None:
        run.append(text)
        if not links:
            free.append(text)

    while tag := TAG.search(html, at):
        if tag.start() > at:
            say(html[at : tag.start()])
        at = tag.end()
        name, end = (tag[2] or "").lower(), bool(tag[1])
        if not name:
            continue
        if name in RAW:
            if not end and not tag[0].endswith("/>"):
                last = _END[name].search(html, at)
                at = last.end() if last else len(html) if name in TO_THE_END else at
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            links = 0 if end else 1
            continue
        marked = not end and is_boilerplate(name, tag[3], bool(inside))
        if name not in BLOCKS and not marked and not (end and any(b[0] == name for b in open_blocks[-4:])):
            continue
        flush()
        links = 0
        if end:
            k = next((k for k in range(len(open_blocks) - 1, -1, -1) if open_blocks[k][0] == name), -1)
            if k >= 0 and (name != "p" or k == len(open_blocks) - 1):
                close(k)
        elif name not in VOID:
            if open_blocks and open_blocks[-1][0] == "p" and name in BLOCKS:
                close(len(open_blocks) - 1)
            if open_blocks and name in ("li", "dt", "dd", "tr", "td", "th") and open_blocks[-1][0] == name:
                close(len(open_blocks) - 1)
            if name in ("body", "main", "article"):
                # menus and headers that were never closed end here, at the body and the main part all else too
                unclosed = ("nav", "menu", "header", "head", "title", "button") if name == "article" else BOILERPLATE
                k = next((k for k, b in enumerate(open_blocks) if b[1] and b[0] in unclosed and not any(x[1] for x in open_blocks[:k])), -1)
                if k >= 0:
                    close(k)
            article = name in ("article", "main") and not marked and not marks
            if article:
                number += 1
                inside.append(number if name == "article" else -number)
                comments = None
            open_blocks.append((name, marked, article))
            marks += marked
    say(html[at:])
    flush()
    return lines


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """From each surge to its dive: line numbers, end exclusive."""
    found, start, total = [], None, sum(weights[:window])
    for k in range(len(weights)):
        if total and start is None and weights[k]:
            start = k
        if start is not None and not total:
            found.append((start, k))
            start = None
        total += (weights[k + window] if k + window < len(weights) else 0) - weights[k]
    if start is not None:
        found.append((start, len(weights)))
    return found


def peak(weights: list[int], window: int = WINDOW) -> int:
    """The greatest sum of a window."""
    return max((sum(weights[k : k + window]) for k in range(len(weights))), default=0)


def surges(lines: list[Line], least: float = 0.0) -> list[Line]:
    """The lines between surge and dive, of the stretches whose greatest sum reaches the share `least` of the greatest."""
    weights = [x.weight() for x in lines]
    some = [(a, b, peak(weights[a:b])) for a, b in stretches(weights)]
    top = max((p for _, _, p in some), default=0)
    # a stretch ends with its last line that weighs something
    return [x for a, b, p in some if p >= least * top for x in lines[a : max((k + 1 for k in range(a, b) if weights[k]), default=a)] if not x.marked]


def main_text(html: str) -> str:
    lines = lines_of(html)
    parts: dict[int, list[Line]] = {}
    for x in lines:
        if x.article:
            parts.setdefault(x.article, []).append(x)
    size = lambda some: sum(len(x.text) for x in some)
    kept = surges(lines, SURGE)
    for within in ([p for k, p in parts.items() if k < 0], [p for k, p in parts.items() if k > 0]):
        own = [x for p in within for x in surges(p)]
        known = {id(x) for x in own}
        if own and size(x for x in kept if id(x) not in known) <= BEYOND * size(own):
            kept = own
    return "\n".join(x.text for x in kept)


def extracted(pages: DataFrame, carry: list[str], html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Every row's `carry` columns with text and n_chars."""

    def make() -> Callable[[list[str]], dict[str, list]]:
        def work(texts: list[str]) -> dict[str, list]:
            found = [main_text(t) for t in texts]
            return {text: found, n_chars: [len(t) for t in found]}

        return work

    return C.map_texts(pages, carry, html, make, T.StructType([T.StructField(text, C.STRING), T.StructField(n_chars, C.LONG)]))
