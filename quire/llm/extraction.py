"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the article.
HIDDEN = frozenset(
    "head script style template noscript svg canvas audio video nav footer aside "
    "form button select textarea dialog menu".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements inside a line of text; they do not end a block and are no part of a path.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr br img math mi mn mo mrow msub msup msubsup mfrac msqrt "
    "mroot mtext mspace mover munder munderover mstyle semantics annotation".split())
#: Words of class, id and role that name furniture. What holds most of the text is no furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices "
    "sidebar menu nav navbar navigation footer comment comments disqus reply replies respond promo "
    "promotion sponsor sponsored share sharing social related newsletter subscribe breadcrumb breadcrumbs "
    "popup modal widget masthead contentinfo complementary search pagination".split())
#: Elements that no name makes furniture.
WHOLE = frozenset("html body main article".split())
#: Block elements that an opening tag of the same kind, or of a kind in the value, closes.
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()),
    "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
    "th": frozenset("td th".split()), "option": frozenset("option".split()),
}
#: A path is content when its fused ratio reaches this share of the page's largest.
THRESHOLD = 0.1
#: Weight of paths in an article or main element over others.
BONUS = 3
#: Elements that stay with the content whatever their ratio: below the content's common parent, and
#: within an article or main element.
LISTED = frozenset("h1 h2 h3 h4 li blockquote pre".split())
TEXTUAL = LISTED | frozenset(
    "h5 h6 p td th caption dt dd figcaption address summary article main".split())
MARKS = re.compile(r"[,.;:!?、。，！？…]")
#: A tag that the end of the page cuts off.
CUT = re.compile(r"<[A-Za-z/!?][^<>]*$")
NAMES = re.compile(r"[a-z0-9]+")


class Blocks(HTMLParser):
    """Blocks of text in page order with the path of block elements above each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, path, hidden, place in named or -1
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.found: list[tuple[int, str]] = []
        self.named: list[int] = []  # first block of each element with a name of furniture
        self.ends: list[int] = []  # its last block + 1, or -1 while it is open
        self.pieces: list[str] = []

    @property
    def path(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    @property
    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                self.found.append((self.path, text))

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "br" and not self.hidden:
                self.pieces.append(" ")
            return
        self.flush()
        closing = CLOSES.get(tag)
        if self.stack and self.stack[-1][0] == "p" and tag not in VOID:
            self.leave(len(self.stack) - 1)  # a paragraph holds no other block
        if closing:
            for depth in range(len(self.stack) - 1, max(-1, len(self.stack) - 4), -1):
                if self.stack[depth][0] in closing:
                    self.leave(depth)
                    break
                if self.stack[depth][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        if tag in VOID:
            return
        key = (self.path, tag)
        path = self.paths.get(key)
        if path is None:
            path = self.paths[key] = len(self.parents)
            self.parents.append(self.path)
            self.tags.append(tag)
        named = -1
        if tag not in WHOLE and self.has_name(attrs):
            named = len(self.named)
            self.named.append(len(self.found))
            self.ends.append(-1)
        self.stack.append((tag, path, self.hidden or self.is_furniture(tag, attrs), named))

    def leave(self, depth: int) -> None:
        """Close all elements from this depth on."""
        for *_, named in self.stack[depth:]:
            if named >= 0:
                self.ends[named] = len(self.found)
        del self.stack[depth:]

    def is_furniture(self, tag, attrs) -> bool:
        if tag in HIDDEN:
            return True
        inside = any(t in ("article", "main") for t, *_ in self.stack)
        if tag == "header" and not inside:
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
                return True
        return False

    def has_name(self, attrs) -> bool:
        return any(
            name in ("class", "id", "role") and value and not FURNITURE.isdisjoint(NAMES.findall(value.lower()))
            for name, value in attrs)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE or tag in VOID:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.flush()
                self.leave(depth)
                return

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)

    def close(self):
        super().close()
        self.flush()
        self.leave(0)


def without_furniture(page: Blocks) -> list[tuple[int, str]]:
    """Blocks outside the elements that a name makes furniture.

    An element with such a name goes unless it holds most of the text that is left, punctuation
    counted too; where article or main elements have text, only theirs counts. The largest are looked
    at first, so outer ones come before what they hold.
    """
    owned = [in_content(page, p) for p, _ in page.found]
    everything = not any(owned)
    sums = [0, *accumulate(
        len(t) * (1 + len(MARKS.findall(t))) * (everything or own) for (_, t), own in zip(page.found, owned, strict=True))]
    left, total = [True] * len(owned), sums[-1]
    spans = [(sums[end] - sums[start], start, end) for start, end in zip(page.named, page.ends, strict=True) if end > start]
    for held, start, end in sorted(spans, key=lambda s: (-s[0], s[1] - s[2])):
        if left[start] and 2 * held <= total:
            left[start:end] = [False] * (end - start)
            total -= held
    return [b for b, ok in zip(page.found, left, strict=True) if ok]


def path_scores(paths: list[int], texts: list[str], inside: list[bool]) -> dict[int, float]:
    """Fused ratio of each path: text and punctuation per node, smoothed along the page.

    Blocks of an article or main element lend nothing to those outside, and count BONUS times.
    """
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    nodes: dict[int, int] = {}
    for path, text in zip(paths, texts, strict=True):
        chars[path] = chars.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(MARKS.findall(text))
        nodes[path] = nodes.get(path, 0) + 1
    fused = [
        math.sqrt(chars[p] / nodes[p] * (1 + marks[p] / nodes[p])) for p in paths
    ]
    last = len(fused) - 1

    def lent(i: int, j: int) -> float:
        return fused[j] if 0 <= j <= last and inside[i] == inside[j] else fused[i]

    smooth = [(lent(i, i - 1) + 2 * v + lent(i, i + 1)) / 4 for i, v in enumerate(fused)]
    scores: dict[int, float] = {}
    for path, value, own in zip(paths, smooth, inside, strict=True):
        scores[path] = scores.get(path, 0.0) + value * (BONUS if own else 1) / nodes[path]
    return scores


def main_text(html: str | None) -> str:
    """Blocks of the article, one per line; empty when there is none."""
    if not html:
        return ""
    page = Blocks()
    page.feed(CUT.sub("", html))
    page.close()
    found = without_furniture(page)
    if not found:
        return ""
    paths = [p for p, _ in found]
    texts = [t for _, t in found]
    inside = [in_content(page, p) for p in paths]
    scores = path_scores(paths, texts, inside)
    floor = THRESHOLD * max(scores.values())
    chosen = {p for p, s in scores.items() if s >= floor}
    top = common_parent(page, [p for p in chosen])
    marked = any(inside)

    def accompanies(path: int, own: bool) -> bool:
        if marked:
            return own and page.tags[path] in TEXTUAL
        return page.tags[path] in LISTED and below(page, path, top)

    return "\n".join(
        t for p, t, own in zip(paths, texts, inside, strict=True) if p in chosen or accompanies(p, own))


def in_content(page: Blocks, path: int) -> bool:
    """An article or main element is above a path or is its last."""
    while path > 0:
        if page.tags[path] in ("article", "main"):
            return True
        path = page.parents[path]
    return False


def common_parent(page: Blocks, paths: list[int]) -> int:
    def line(path: int) -> list[int]:
        out = []
        while path > 0:
            out.append(path)
            path = page.parents[path]
        return out[::-1]

    lines = [line(page.parents[p]) for p in paths]
    top = 0
    for level in zip(*lines, strict=False):
        if len(set(level)) > 1:
            break
        top = level[0]
    return top


def below(page: Blocks, path: int, top: int) -> bool:
    while path > 0:
        if path == top:
            return True
        path = page.parents[path]
    return top == 0


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Append the main text of each page; all columns stay, one named ``text`` is replaced.

    A null or empty page gives an empty text. Pages are independent: no shuffle, one page in
    memory beside its Arrow batch. Menus, page headers, footers, asides, forms, scripts, styles,
    and elements whose class, id or role names furniture are left out, but for those that hold most of
    the page's text; tag paths then decide.
    """
    kept = [c for c in df.columns if c != text]
    rest = df.select(*[F.col(f"`{c}`") for c in kept])

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return rest.withColumn(text, read(F.col(f"`{html}`")))


def extraction_report(df: DataFrame) -> DataFrame:
    return extract(df.select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
