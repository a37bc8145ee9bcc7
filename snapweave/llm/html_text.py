"""Main text of web pages by tag-path ratios.

A page is read into blocks: text between block-level tags, with its root-to-leaf tag path. Per path the text
length, the punctuation and the length inside links are summed and divided by the number of nodes of the
path (text ratio, punctuation ratio). Both are smoothed along the order in which paths first appear (with a
Gaussian over neighbouring paths below the same section), fused by their product, weighted by the share of
text outside links, and paths at or above `share` of the page's fused standard deviation are content.
The other paths of that article or main (or, without one, beside or below a chosen path in the same parent) come along unless
they are mostly links: so short paragraphs and headings of the article stay, link lists and footers don't.

Never content, whatever the ratios: scripts, styles, templates, head, nav, aside, form controls, page headers
and footers. Elements whose class, id or role names an advert, menu, notice, sidebar, share bar or
comments aren't either, unless they hold nearly all of the chosen text. Comments in markup and tags go; character references are decoded; white space inside a block becomes
one space, blocks are trimmed, empty ones left out, and the rest joined in page order by one newline.

Everything about one page is found in one row, so pages need no shuffle; pages are processed by the batch.
Null or empty html, and pages without content: text '', n_chars 0. html without any markup is one content
block. Unclosed and crossing tags are closed by their ancestors. Repeated rows give equal rows. Empty table:
empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

# HTML element names and words in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROPPED = RAW | frozenset("head nav aside footer form button select option input dialog menu object canvas audio video".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising banner banners promo promotion sponsor sponsored menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars cookie cookies consent notice notices newsletter subscribe signup popup modal overlay share sharing social comment comments respond replies disqus footer header masthead related recommended toolbar pagination pager login search widget complementary contentinfo".split())
SECTIONS = frozenset("article main".split())

#: Share of the chosen text from which an element is kept whatever its names.
OVERRULED = 0.9

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)>|<[!?/][^>]*>", re.S)
MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?¡¿…。、，！？；：]")
WORDS = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    dropped: bool
    named: tuple[int, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0


def is_dropped(name: str, inside: list[str]) -> bool:
    """Elements that are never content."""
    return name in DROPPED or (name == "header" and not SECTIONS & set(inside))


def is_noise(name: str, attributes: str) -> bool:
    """Elements whose class, id or role names something else than content."""
    if "=" not in attributes or name in ("html", "body", "article", "main"):
        return False
    return any(NOISE.intersection(WORDS.findall((a or b or c).lower())) for _, a, b, c in MARKS.findall(attributes))


def blocks_of(html: str) -> list[Block]:
    """Blocks in page order; each with its tag path of block-level elements, whether it is in a dropped element, and the numbers of the noise elements that hold it."""
    stack: list[tuple[str, bool, tuple[int, ...]]] = []  # open elements, whether each is (inside) a dropped one, and its noise elements
    noisy = 0
    out: list[Block] = []
    block: Block | None = None
    links, at, size = 0, 0, len(html)

    def say(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(tuple(n for n, _, _ in stack if n not in INLINE), bool(stack and stack[-1][1]), stack[-1][2] if stack else ())
            out.append(block)
        block.text.append(text)
        if links:
            block.linked += len(text)

    while at < size:
        m = MARKUP.search(html, at)
        if m is None:
            say(unescape(html[at:]))
            break
        say(unescape(html[at : m.start()]))
        at = m.end()
        if m["data"] is not None:
            say(m["data"])
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            say(" ")
            continue
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is None or (name in INLINE and any(n not in INLINE for n, _, _ in stack[depth:])):
                continue
            if any(n not in INLINE for n, _, _ in stack[depth:]):
                block = None
            del stack[depth:]
        else:
            if name in ENDS_P:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
                if depth is not None and all(n in INLINE or n == "p" for n, _, _ in stack[depth:]):
                    del stack[depth:]
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}.get(name, ("table",))
                same = ("td", "th", "tr") if name == "tr" else ("td", "th") if name in ("td", "th") else ("dt", "dd") if name in ("dt", "dd") else (name,)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in stop or (name in ("td", "th") and stack[i][0] == "tr"):
                        break
                    if stack[i][0] in same:
                        del stack[i:]
                        break
            if name not in INLINE:
                block = None
            if name in VOID:
                continue
            dropped = bool(stack and stack[-1][1]) or is_dropped(name, [n for n, _, _ in stack])
            named = stack[-1][2] if stack else ()
            if not dropped and is_noise(name, m["attributes"] or ""):
                named, noisy = (*named, noisy), noisy + 1
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                block = None
                continue
            stack.append((name, dropped, named))
            if (dropped or named) and name in INLINE:  # an inline advert or share link is a block of its own
                block = None
        links = sum(n == "a" for n, _, _ in stack)
        if block is not None and (bool(stack and stack[-1][1]), stack[-1][2] if stack else ()) != (block.dropped, block.named):
            block = None
    return out


def smooth(values: np.ndarray, sections: list[tuple[str, ...]], sigma: float = 1.0) -> np.ndarray:
    """Gaussian over neighbouring paths of one section."""
    out = np.zeros(len(values))
    for i in range(len(values)):
        near = [j for j in range(max(0, i - 3), min(len(values), i + 4)) if sections[j] == sections[i]]
        w = np.exp([-((i - j) ** 2) / (2 * sigma**2) for j in near])
        out[i] = (w * values[near]).sum() / w.sum()
    return out


@dataclass
class Paths:
    """The tag paths of some blocks with their sums and which of them the ratios choose."""

    names: list[tuple[str, ...]]
    length: np.ndarray
    linked: np.ndarray
    good: np.ndarray
    strong: np.ndarray

    @classmethod
    def of(cls, blocks: list[Block], share: float) -> "Paths":
        sums: dict[tuple[str, ...], np.ndarray] = {}
        for b in blocks:
            text = "".join(b.text)
            sums.setdefault(b.path, np.zeros(4))[:] += (1, len(text.strip()), len(PUNCTUATION.findall(text)), b.linked)
        names, m = list(sums), np.array(list(sums.values())).reshape(-1, 4)
        sections = [n[:-1] for n in names]
        text, marks = smooth(m[:, 1] / m[:, 0], sections), smooth(m[:, 2] / m[:, 0], sections)
        fused = np.sqrt(text * (marks + 1)) * np.clip(1 - m[:, 3] / np.maximum(m[:, 1], 1), 0, 1)
        good = (fused >= min(share * fused.std(), fused.max())) & (fused > 0) if names else np.zeros(0, bool)
        return cls(names, m[:, 1], m[:, 3], good, good & (fused >= 0.5 * fused.max(initial=0)))

    def content(self) -> set[tuple[str, ...]]:
        """The chosen paths of the section that holds most of the chosen text, and with them what is short but stands among them.

        The section is an article or main if one holds half of the chosen text; else the parents of chosen paths that do, and strongly chosen paths elsewhere.
        Other paths come along if they are not mostly links and lie in that article or main, or beside or below a chosen
        path, in the same parent element.
        """
        chosen = {n for n, g in zip(self.names, self.good) if g}
        plain = {n for n, x, links in zip(self.names, self.length, self.linked) if links <= 0.5 * max(x, 1)}
        weight: dict[tuple[str, ...], float] = {}
        for n, x in zip(self.names, self.length):
            if n in chosen:
                for d in range(len(n) + 1):
                    weight[n[:d]] = weight.get(n[:d], 0) + x
        total = weight.get((), 0)
        homes = [p for p in weight if p and p[-1] in SECTIONS and weight[p] >= 0.5 * total]
        if homes:
            home = min(homes, key=len)
            return {n for n in self.names if n[: len(home)] == home and (n in chosen or n in plain)}
        parents = {n[:-1] for n in chosen if weight[n[:-1]] >= 0.5 * total and len(n) > 1}
        parents = {p for p in parents if not any(q != p and q[: len(p)] == p for q in parents)}
        if not parents:
            return chosen
        strong = {n for n, g in zip(self.names, self.strong) if g}
        return strong | {n for n in chosen | plain if any(len(n) > len(p) and n[: len(p)] == p for p in parents)}


def main_text(html: str | None, share: float = 0.5, words: bool = True) -> str:
    """words: whether class, id and role names count against an element."""
    if not html:
        return ""
    blocks = [b for b in blocks_of(html) if not b.dropped]
    if words and any(b.named for b in blocks):
        # a name can't drop an element that holds nearly all text that the ratios choose
        paths = Paths.of(blocks, share)
        good, held, total = {n for n, g in zip(paths.names, paths.good) if g}, {}, 0
        for b in blocks:
            if b.path in good:
                n = sum(map(len, b.text))
                total += n
                for k in b.named:
                    held[k] = held.get(k, 0) + n
        blocks = [b for b in blocks if all(held.get(k, 0) >= OVERRULED * total > 0 for k in b.named)]
    good = Paths.of(blocks, share).content()
    lines = (" ".join("".join(b.text).split()) for b in blocks if b.path in good)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, share: float = 0.5, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    bound_batches(pages.sparkSession)
    kept = pages.select("page_id", "url", F.col(html_col).alias("_html"))
    types = dict(kept.dtypes)

    def work(batches):
        for batch, htmls in slices(batches, "_html"):
            texts = [main_text(h.decode("utf-8", "replace") if h else None, share) for h in htmls]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(work, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
