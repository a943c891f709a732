"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read into a sequence of words and tags.  Words score positive and tags negative, with weights by where
they stand: plain words, words in the element a page declares as its article, words of links, words of page furniture
(menus, notices, adverts and so on), and block, inline, link and list tags, inside and outside a declared
article.  One linear scan finds the contiguous region with the greatest sum; its blocks, without furniture that stands
among them, are the text.  Equal sums go to the longer region.

``fit`` learns from labelled pages: which elements, class names and roles are furniture or article, by the log-odds of
the words below them; the word weights, by the log-odds of their kind; and the tag weights, by coordinate search for
the greatest F1 of words.  A labelled page is ``(html, text)`` with the text joined from blocks as the result is.
``declared_pages`` labels pages of a table whose markup names its article; ``example_pages`` makes layouts
with furniture of many names by rule, for tables whose pages do not show it.  An element that holds most paragraphs of a
page (a form around everything) is not furniture.

Defined cases: null and empty html: empty text; a page without words: empty text; markup cut anywhere or left open is
read as browsers do, so a tag that never ends takes the rest of the page; character references, once decoded, are
text; the heading of an article's own header stays, the rest of that header goes; very long pages are read whole in
linear time; repeated rows give equal rows; null ids and urls are kept; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import frugal, table

#: Pages that the weights are fitted on, and the longest of them.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 20_000
#: Log-odds in hundredths beyond which a name marks furniture or an article, and words it must have been seen over.
SURE, LEAST_WORDS = 150, 3

# Element names of the HTML standard, by their role in it.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER_TEXT = RAW | set("head noscript template object svg canvas audio video map button select datalist".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
LISTS = set("ul ol li dl dt dd menu table thead tbody tfoot tr td th caption nav option".split())
HEADINGS = {f"h{k}" for k in range(1, 7)}
ENDS_PARAGRAPH = HEADINGS | set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("table td th caption ul ol dl object template html".split())
#: Elements whose very name says what they hold; all others are told apart by class, id and role alone.
TELLING = set("article main nav header footer aside form".split())
NAMES_PAGE = {"html", "body"}

_ATTRIBUTES = r"""(?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|=|["'])*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|</?([A-Za-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_CUE_ATTRIBUTES = {"class", "id", "role", "itemprop"}


class Node:
    """An open element: what it says of itself, and whether it stands in furniture (``bad``) and in an article (``good``)."""

    __slots__ = ("parent", "tag", "cues", "bad", "good", "words")

    def __init__(self, parent: Node | None, tag: str, cues: frozenset[str], bad: bool = False, good: bool = False):
        self.parent, self.tag, self.cues, self.bad, self.good, self.words = parent, tag, cues, bad, good, 0

    def path(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent


PLAIN, ARTICLE, LINKED, FURNITURE, INNER, BLOCK, INLINE_TAG, LINK_TAG, LIST_TAG, IN_BLOCK, IN_INLINE, IN_LINK, IN_LIST = range(13)
KINDS = 13


@dataclass
class Page:
    """Words and tags in page order, by kind and how many; blocks carry their words and element, tags None."""

    kinds: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    blocks: list[tuple[list[str], Node] | None] = field(default_factory=list)


NONE: frozenset[str] = frozenset()


def _cues(tag: str, attributes: str) -> frozenset[str]:
    """What an element's name, class, id and role say of it, as lower-case names."""
    out = {f"<{tag}>"} if tag in TELLING else set()
    if "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes) if tag not in NAMES_PAGE else ():
            name, value = name.lower(), entities.unescape(value.strip("\"'"))
            if name in _CUE_ATTRIBUTES:
                out.update(x.lower() for x in _NAME.findall(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                out.add("hidden")
    return frozenset(out) if out else NONE


def _spelled(word: str) -> bool:
    return any(map(str.isalnum, word))


def _tag_kind(tag: str) -> int:
    return LINK_TAG if tag == "a" else INLINE_TAG if tag in INLINE else LIST_TAG if tag in LISTS else BLOCK


def parse(html: str, furniture: frozenset[str] = NONE, article: frozenset[str] = NONE) -> Page:
    """The page's words, by block, and its tags; furniture and articles are told by the names given."""
    page, forms = _parse(html, furniture, article)
    if forms and "<form>" in furniture:
        total = sum(n for n, b in zip(page.counts, page.blocks, strict=True) if b is not None and any(x.tag == "p" for x in b[1].path()))
        if any(2 * f.words > total for f in forms):
            page, _ = _parse(html, furniture - {"<form>"}, article)
    return page


def _parse(html: str, furniture: frozenset[str], article: frozenset[str]) -> tuple[Page, list[Node]]:
    page, root = Page(), Node(None, "", NONE)
    kinds, sizes, blocks = page.kinds, page.counts, page.blocks
    stack, at, n = [root], 0, len(html)
    counts: dict[str, int] = {}
    paragraphs: list[int] = []
    scopes: list[int] = []
    pieces: list[str] = []
    forms: list[Node] = []
    silent = anchors = linked = 0
    find, match = html.find, _TOKEN.match

    def flush() -> None:
        nonlocal linked
        words = "".join(pieces).split()
        pieces.clear()
        if words:
            node = stack[-1]
            bad, good = node.bad, node.good
            if good and not bad:
                bad = _in_own_header(node)
            if bad:
                kind = INNER if good else FURNITURE
            else:
                kind = ARTICLE if good else LINKED if linked and 2 * linked >= sum(map(_spelled, words)) else PLAIN
            kinds.append(kind)
            sizes.append(len(words))
            blocks.append((words, node))
            if forms and counts.get("p"):
                for x in node.path():
                    if x.tag == "form":
                        x.words += len(words)
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not silent:
            if "&" in text:
                text = entities.unescape(text)
            pieces.append(text)
            if anchors:
                linked += len(text.split())

    def close(depth: int) -> None:
        nonlocal silent, anchors
        while len(stack) > depth:
            tag = stack.pop().tag
            counts[tag] -= 1
            if tag in NEVER_TEXT:
                silent -= 1
            elif tag == "a":
                anchors -= 1
        while paragraphs and paragraphs[-1] >= depth:
            paragraphs.pop()
        while scopes and scopes[-1] >= depth:
            scopes.pop()

    while at < n:
        start = find("<", at)
        if start < 0:
            say(html[at:])
            break
        m = match(html, start)
        if m is None:
            say(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            say(html[at:start])
        at = m.end()
        tag, attributes = m.groups()
        if tag is None:
            continue
        if html[at - 1] != ">":
            break
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        inline = tag in INLINE
        if pieces and not inline:
            flush()
        if html[start + 1] == "/":
            if counts.get(tag):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                if not inline or not scopes or depth > scopes[-1]:
                    close(depth)
        else:
            if paragraphs and tag in ENDS_PARAGRAPH and (not scopes or paragraphs[-1] > scopes[-1]):
                close(paragraphs[-1])
            if tag in OWN_KIND:
                for depth in range(len(stack) - 1, scopes[-1] if scopes else 0, -1):
                    if stack[depth].tag in OWN_KIND[tag]:
                        close(depth)
                        break
                    if stack[depth].tag not in INLINE and stack[depth].tag not in ("p", "div"):
                        break
            up = stack[-1]
            cues = _cues(tag, attributes)
            bad, good = up.bad, up.good
            if cues:
                says_article = not article.isdisjoint(cues)
                says_furniture = not furniture.isdisjoint(cues) and not (good and "<header>" in cues)
                bad = bad or says_furniture and not (says_article and tag in ("article", "main"))
                good = good or says_article and not bad
            node = Node(up, tag, cues, bad, good)
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                at = n if end is None else end.start()
            if tag not in VOID:
                if tag == "p":
                    paragraphs.append(len(stack))
                elif tag in SCOPE:
                    scopes.append(len(stack))
                elif tag == "form":
                    forms.append(node)
                elif tag == "a":
                    anchors += 1
                stack.append(node)
                counts[tag] = counts.get(tag, 0) + 1
                if tag in NEVER_TEXT:
                    silent += 1
        kind = _tag_kind(tag) + (4 if stack[-1].good else 0)
        if kinds and kinds[-1] == kind and blocks[-1] is None:
            sizes[-1] += 1
        else:
            kinds.append(kind)
            sizes.append(1)
            blocks.append(None)
    flush()
    return page, forms


def _in_own_header(node: Node) -> bool:
    """Whether a block stands in an article's header without being a heading."""
    heading = False
    for x in node.path():
        heading = heading or x.tag in HEADINGS
        if "<header>" in x.cues:
            return not heading
    return False


@dataclass
class Weights:
    """What names say, and the score of each kind of word and tag."""

    furniture: frozenset[str]
    article: frozenset[str]
    scores: list[int]


def best_region(kinds: list[int], counts: list[int], scores: list[int]) -> tuple[int, int]:
    """Ends of the contiguous stretch with the greatest positive sum, the longer of equals; (0, 0) if there is none."""
    best, a, b, total, start = 0, 0, 0, 0, 0
    for i, kind in enumerate(kinds):
        if total < 0:
            total, start = 0, i
        total += scores[kind] * counts[i]
        if total > best or total == best and best and i + 1 - start > b - a:
            best, a, b = total, start, i + 1
    return a, b


def main_text(html: str | None, weights: Weights) -> str:
    """The blocks of the best region, joined by one space."""
    page = parse(html or "", weights.furniture, weights.article)
    a, b = best_region(page.kinds, page.counts, weights.scores)
    words = (x[0] for x, kind in zip(page.blocks[a:b], page.kinds[a:b], strict=True) if x is not None and kind not in (FURNITURE, INNER))
    return " ".join([" ".join(w) for w in words])


def label_blocks(page: Page, text: str) -> list[bool] | None:
    """Which blocks make up ``text``: those that spell it in order within the fewest blocks; None if none do."""
    blocks = [" ".join(e[0]) for e in page.blocks if e is not None]
    best: list[int] | None = None
    for s, block in enumerate(blocks):
        if not text.startswith(block):
            continue
        at, chosen = 0, []
        for i in range(s, len(blocks)):
            if text.startswith(blocks[i], at) and text[at + len(blocks[i]) : at + len(blocks[i]) + 1] in ("", " "):
                chosen.append(i)
                at += len(blocks[i]) + 1
            if at > len(text):
                break
        if at == len(text) + 1 and (best is None or chosen[-1] - chosen[0] < best[-1] - best[0]):
            best = chosen
    if best is None:
        return None if text else [False] * len(blocks)
    marked = set(best)
    return [i in marked for i in range(len(blocks))]


#: Scores are hundredths.  Two tags never outweigh a plain word, so the shortest paragraph within reach stays.
MOST_WORD, TAG_SCORES = 400, (1, 10, 50, 150)


def _odds(inside: float, outside: float) -> float:
    return 100 * math.log((inside + 0.5) / (outside + 0.5))


def fit(pages: Iterable[tuple[str, str]]) -> Weights:
    """Weights from labelled pages ``(html, main text)``; pages whose text their blocks do not spell are left out."""
    seen: dict[str, list[int]] = {}
    read = []
    for html, text in pages:
        page = parse(html)
        label = label_blocks(page, text)
        if label is None:
            continue
        read.append((html, label))
        for (words, node), mine in zip(filter(None, page.blocks), label, strict=True):
            for name in {c for x in node.path() for c in x.cues}:
                seen.setdefault(name, [0, 0])[mine] += len(words)
    odds = {c: _odds(i, o) for c, (o, i) in seen.items() if o + i >= LEAST_WORDS}
    furniture = frozenset(c for c, x in odds.items() if x <= -SURE)
    article = frozenset(c for c, x in odds.items() if x >= SURE)
    inside, outside, tallies = [0] * KINDS, [0] * KINDS, []
    for html, label in read:
        page, by_block = parse(html, furniture, article), iter(label)
        mine = [e is not None and next(by_block) for e in page.blocks]
        for kind, n, x, e in zip(page.kinds, page.counts, mine, page.blocks, strict=True):
            if e is not None:
                (inside if x else outside)[kind] += n
        tallies.append((page, sum(n for n, x in zip(page.counts, mine, strict=True) if x), mine))
    scores = [0] * KINDS
    for kind in (PLAIN, ARTICLE):
        scores[kind] = round(min(MOST_WORD, max(2 * TAG_SCORES[-1] + 1, _odds(inside[kind], outside[kind]))))
    scores[LINKED] = round(min(-20, max(-MOST_WORD, _odds(inside[LINKED], outside[LINKED]))))
    scores[FURNITURE] = round(min(-20, _odds(inside[FURNITURE], outside[FURNITURE]) / 4))
    tags = list(range(BLOCK, KINDS))
    for t in tags:
        scores[t] = -TAG_SCORES[1]

    def quality() -> float:
        total = 0.0
        for page, wanted, label in tallies:
            a, b = best_region(page.kinds, page.counts, scores)
            got = hit = 0
            for i in range(a, b):
                if page.blocks[i] is not None and page.kinds[i] not in (FURNITURE, INNER):
                    got += page.counts[i]
                    hit += page.counts[i] * label[i]
            total += 2 * hit / (got + wanted) if got + wanted else 1.0
        return total

    best = quality()
    for t in tags:
        kept = scores[t]
        for x in TAG_SCORES:
            if -x != kept:
                scores[t] = -x
                now = quality()
                if now > best:
                    best, kept = now, -x
        scores[t] = kept
    return Weights(furniture, article, scores)


# Names that pages use for what is not their article, and for the article; the layouts below give them their meaning.
FURNITURE_NAMES = (
    "nav navigation navbar menu submenu breadcrumb breadcrumbs pagination pager toc skip header masthead topbar banner logo footer colophon "
    "copyright legal sidebar aside widget rail related recommended recommendations trending popular teaser cookie cookies consent gdpr notice "
    "alert popup modal overlay toast newsletter subscribe subscription signup paywall ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion promoted outbrain taboola form search login share sharing social follow comment comments respond disqus "
    "discussion replies reply feedback hidden byline tags metadata complementary contentinfo navigation dialog"
).split()
ARTICLE_NAMES = "article content entry post story main body articlebody".split()
_SYLLABLES = "an ber cor dal en fir gon hal ist jun kel lor mar nes ost per rin sal tor und vel wen".split()


def example_pages(rounds: int = 3, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled pages made by rule: articles with and without a name of their own, among furniture of every name."""
    r = random.Random(seed)

    def prose(n: int) -> str:
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."

    def prefixed(name: str) -> str:
        return name if r.random() < 0.5 else f"{r.choice(['site', 'page', 'js', 'block'])}-{name}"

    def furniture(name: str) -> str:
        tag = r.choice([*TELLING - {"article", "main"}, "div", "section"]) if r.random() < 0.2 else "div"
        mark = prefixed(name)
        key = r.choice(["class", "class", "id"])
        inner = r.choice(
            [
                lambda: "<ul>" + "".join(f'<li><a href="/{k}">{prose(r.randint(1, 3))}</a></li>' for k in range(r.randint(2, 6))) + "</ul>",
                lambda: prose(r.randint(4, 40)),
                lambda: "".join(f"<p>{prose(r.randint(4, 25))}</p>" for _ in range(r.randint(1, 3))),
            ]
        )()
        return f'<{tag} {key}="{mark}">{inner}</{tag}>'

    def links() -> str:
        return "<div>" + " | ".join(f'<a href="/{k}">{prose(r.randint(1, 2))}</a>' for k in range(r.randint(3, 7))) + "</div>"

    out = []
    plain = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
    for _ in range(rounds):
        names = FURNITURE_NAMES * 2
        r.shuffle(names)
        for at in range(0, len(names), 6):
            some = [furniture(x) for x in names[at : at + 6]]
            some.append(r.choice([links, *(lambda t=t: f"<{t}>{prose(r.randint(2, 20))}</{t}>" for t in plain)])())
            blocks = [f"<h1>{(title := prose(r.randint(1, 8)))}</h1>"]
            texts = [title]
            for k in range(r.randint(1, 8)):
                if k and r.random() < 0.15:
                    items = [prose(r.randint(2, 12)) for _ in range(r.randint(2, 4))]
                    blocks.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                    texts += items
                elif k and r.random() < 0.15:
                    blocks.append(some.pop())
                else:
                    a, b = prose(r.randint(1, 60)), prose(r.randint(1, 60))
                    blocks.append(f'<p>{a} <a href="#">{b}</a></p>' if r.random() < 0.2 else f"<p>{a} {b}</p>")
                    texts.append(f"{a} {b}")
            cut = r.randint(1, len(some))
            kind = r.random()
            name = r.choice(ARTICLE_NAMES)
            wrap = ("<article>", "</article>") if kind < 0.25 else ("<main>", "</main>") if kind < 0.4 else (f'<div class="{prefixed(name)}">', "</div>") if kind < 0.7 else ("<div>", "</div>")
            if r.random() < 0.3 and kind < 0.4:
                blocks[0] = f"<header>{blocks[0]}<p>{prose(3)}</p></header>"
            page = "".join(some[:cut]) + wrap[0] + "".join(blocks) + wrap[1] + "".join(some[cut:])
            out.append((f"<html><head><title>{prose(3)}</title></head><body>{page if r.random() < 0.5 else f'<div id="page">{page}</div>'}</body></html>", " ".join(texts)))
    return out


def declared_text(html: str) -> str | None:
    """The text below the one ``article`` or ``main`` element of a page, without elements named as furniture."""
    roots, found = set(), []
    for words, node in filter(None, parse(html).blocks):
        path = list(node.path())
        root = [x for x in path if x.tag in ("article", "main")]
        if root and not any(x.tag in TELLING - {"article", "main"} for x in path):
            roots.add(id(root[-1]))
            found += words
    return " ".join(found) if len(roots) == 1 else None


def declared_pages(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """Labelled pages from those that declare one article: at most ``rows`` of ``chars`` characters, the first by a hash."""
    some = pages.select(F.col("html")).filter(F.length("html") <= chars).filter(F.expr(r"html rlike '(?i)<(article|main)\\b'"))
    some = some.orderBy(F.xxhash64("html"), "html").limit(rows).collect()
    found = ((r.html, declared_text(r.html)) for r in some)
    return [(html, text) for html, text in found if text]


def fit_pages(pages: DataFrame, labelled: DataFrame | None = None) -> Weights:
    """Weights from ``labelled`` rows ``(html, text)`` if given, else from pages that declare their article; with examples."""
    if labelled is None:
        known = declared_pages(pages)
    else:
        some = labelled.filter(F.length("html") <= SAMPLE_CHARS).select("html", F.coalesce("text", F.lit("")).alias("text"))
        known = [(r.html, r.text) for r in some.orderBy(F.xxhash64("html"), "html", "text").limit(SAMPLE_PAGES).collect()]
    return fit([*known, *example_pages()])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                found = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_pages(pages))
