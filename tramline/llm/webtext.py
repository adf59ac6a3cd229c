"""HTML main-text extraction by tag-path ratios.

A page becomes text blocks, each with the root-to-leaf path of its block-level tags.  Per path
the text length and punctuation of its blocks are totalled; both ratios are smoothed over
neighbouring blocks, fused by their product and compared with the spread over the page.  Blocks
of passing paths are content; headings, list items and other text elements beside them follow.
The same holds inside article elements: a link list, a short unnamed box or a short paragraph of a
path without punctuation in one is no content.  Where no path passes there is no text.
Elements that say they are something else (navigation, adverts, forms, reader comments) count
only where nothing else is left; a name alone does not condemn what holds the page's article.

Paths are nodes of a tree, so a page costs time and memory in proportion to its length, however
deep its elements are nested.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_ATTRS = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_MARKS = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"[\s ]+")
_PUNCT = re.compile(r"[.,;:!?…。，！？]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea template svg title xmp noembed noframes object".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is not the article's.
OTHER = frozenset("head nav footer aside form fieldset button select option label menu dialog datalist".split())
#: Words of class, id or role that mark adverts, menus, notices, sidebars and reader comments.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside footer masthead toolbar "
    "comment comments commentlist respond disqus replies share sharing social related recommended recommendations newsletter subscribe signup "
    "login search widget complementary contentinfo".split()
)
#: Words before such a name that make it speak of the layout, not of the element.
ABOUT = frozenset("has have with without no not".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: kept beside content even where their own path is too short to pass, a paragraph only
#: where its path has punctuation.
BESIDE = frozenset("li dd dt blockquote pre td th figcaption p".split())
#: Elements that end where the next of their kind begins.
ITEMS = frozenset("li td th tr dt dd".split())
#: Mean length of a path's blocks against the longest path's, at least, for content that no element of running text holds.
OWN = 0.15


@dataclass
class Block:
    path: int  # node of the page's tree of block-level tags
    leaf: str
    inside: int  # number of the enclosing article or main element, 0 outside
    context: int  # number of the innermost named, article or main element, 0 outside
    other: int  # 0 may be content; else why not: 1 by name, 2 by tag, 3 hidden
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


@dataclass
class Context:
    tag: str
    parent: int
    named: bool  # says that it is something else
    inside: int
    size: int = 0  # text in it
    headed: bool = False  # holds the first h1


def _named_other(attrs: str) -> bool:
    for m in _MARKS.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            pieces = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if any(w in OTHER_NAMES and (k == 0 or pieces[k - 1] not in ABOUT) for k, w in enumerate(pieces)):
                return True
    return False


def _judge(out: list[Block], contexts: list[Context], h1: int | None) -> None:
    """Mark the blocks that names exclude: not those of wrappers that hold the page's article."""
    for b in out:
        if b.other < 2:
            contexts[b.context].size += sum(map(len, b.parts))
    while h1:
        contexts[h1].headed = True
        h1 = contexts[h1].parent
    for c in reversed(contexts[1:]):
        contexts[c.parent].size += c.size
    page = contexts[0].size
    bad, outermost = [False], [0]
    for k, c in enumerate(contexts[1:], 1):
        top = outermost[c.parent]
        if c.tag in ARTICLE:
            own = not c.named and (c.headed or 2 * c.size > page) and not contexts[top].inside
            bad.append(bad[c.parent] and not (c.tag == "main" or own))
        else:
            top = top or k
            wrapper = not c.inside and (2 * c.size > page and c.headed or 10 * c.size > 9 * page)
            bad.append(bad[c.parent] or not wrapper)
        outermost.append(top)
    for b in out:
        b.other = b.other or int(bad[b.context])


class Paths:
    """Tree of the root-to-leaf paths of a page: children are numbered after their parents."""

    def __init__(self) -> None:
        self.parent, self.tag = [0], [""]
        self._child: dict[tuple[int, str], int] = {}

    def down(self, node: int, tag: str) -> int:
        if (k := self._child.get((node, tag))) is None:
            k = self._child[node, tag] = len(self.parent)
            self.parent.append(node)
            self.tag.append(tag)
        return k


def blocks(page: str) -> tuple[list[Block], Paths]:
    """Text blocks in page order and their paths; an unclosed or misnested tag ends where its parent does."""
    stack: list[tuple[str, int, int, int, int]] = []  # tag, why text is not the article's, enclosing article, context, path
    opened: Counter = Counter()  # of the stack, so that the stack is only searched for what it holds
    paths = Paths()
    contexts = [Context("", 0, False, 0)]
    h1: int | None = None
    out: list[Block] = []
    now: Block | None = None
    at, articles = 0, 0

    def say(text: str) -> None:
        nonlocal now
        if not text:
            return
        if now is None:
            if text.isspace():
                return
            other, inside, context, path = stack[-1][1:] if stack else (0, 0, 0, 0)
            now = Block(path, paths.tag[path], inside, context, other)
            out.append(now)
        now.parts.append(text)
        if opened["a"]:
            now.linked += len(text)

    def close(k: int) -> None:
        opened.subtract(t for t, *_ in stack[k:])
        del stack[k:]

    while (m := _TOKEN.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        rest = _ATTRS.match(page, at)
        end = rest.end() - 1 if rest else page.find(">", at)
        if end < 0:  # the page ends inside a tag
            at = len(page)
            break
        name, closing, attrs = m[2].lower(), m[1], page[at:end]
        at = end + 1
        if name == "br":
            say(" ")
        if name in BLOCK:
            now = None
        if closing:
            if opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if stack[k][0] in BLOCK and name not in BLOCK:
                        break
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if name in VOID:
            continue
        if name in BLOCK and (opened["p"] or name in ITEMS and opened[name]):  # an open paragraph, or an item of the same list or row, ends here
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" or t == name and name in ITEMS:
                    close(k)
                    break
                if t in BLOCK:
                    break
        other, inside, context, path = stack[-1][1:] if stack else (0, 0, 0, 0)
        outer, article = inside, name in ARTICLE and not other
        if article:
            articles += 1
            inside = articles
        elif name in OTHER or name == "header" and not inside:
            other = max(other, 2)
        elif name not in ("html", "body") and attrs and _HIDDEN.search(attrs):
            other = 3
        named = bool(attrs) and not other and name not in ("html", "body") and _named_other(attrs)
        if article or named:
            contexts.append(Context(name, context, named, outer))
            context = len(contexts) - 1
        if name == "h1" and h1 is None and not other:
            h1 = context
        stack.append((name, other, inside, context, paths.down(path, name) if name in BLOCK else path))
        opened[name] += 1
    say(page[at:])
    _judge(out, contexts, h1)
    return out, paths


def path_ratios(rows: list[tuple[Block, str]]) -> list[float]:
    """Each block's fused ratio: text and punctuation per block of its path, both smoothed over the neighbours, multiplied."""
    size: dict[int, list[float]] = {}
    for b, t in rows:
        s = size.setdefault(b.path, [0, 0, 0])
        s[0] += len(t)
        s[1] += len(_PUNCT.findall(t))
        s[2] += 1
    ratio = [(size[b.path][0] / size[b.path][2], (1 + size[b.path][1]) / size[b.path][2]) for b, _ in rows]
    kernel = [math.exp(-(d * d) / 2.0) for d in (-1, 0, 1)]
    fused = []
    for i in range(len(rows)):
        near = [(k, ratio[i + d]) for d, k in zip((-1, 0, 1), kernel, strict=True) if 0 <= i + d < len(rows)]
        w = sum(k for k, _ in near)
        fused.append(sum(k * r[0] for k, r in near) / w * sum(k * r[1] for k, r in near) / w)
    return fused


def plain_paths(rows: list[tuple[Block, str]]) -> set[int]:
    """Paths of running text; those of paragraphs without any punctuation must have length of their own."""
    return {b.path for b, t in rows if b.leaf in BESIDE and (b.leaf != "p" or _PUNCT.search(t))}


def passing_paths(rows: list[tuple[Block, str]], spread: float = 0.5) -> set[int]:
    """Paths whose best block stands out against the page's spread and is within sight of its best."""
    fused = path_ratios(rows)
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    best: dict[int, float] = {}
    length: dict[int, list[int]] = {}
    plain = plain_paths(rows)
    for (b, t), x in zip(rows, fused, strict=True):
        best[b.path] = max(best.get(b.path, 0.0), x)
        n = length.setdefault(b.path, [0, 0])
        n[0] += len(t)
        n[1] += 1
    longest = max(n / k for n, k in length.values())
    top = max(best.values())
    # a short box beside long ones is lifted by smoothing: it must have length of its own
    return {p for p, x in best.items() if x >= spread * deviation and x >= 0.1 * top and (p in plain or length[p][0] / length[p][1] >= OWN * longest)}


def select_blocks(found: list[Block], paths: Paths, spread: float = 0.5) -> list[str]:
    """Texts of the content blocks, in page order."""
    rows = [(b, t) for b in found if (t := b.text())]
    rows = next((left for why in range(3) if (left := [(b, t) for b, t in rows if b.other <= why])), [])
    if not rows:
        return []
    passing = passing_paths(rows, spread)
    wordy = [b.linked < 0.6 * max(1, sum(map(len, b.parts))) for b, _ in rows]
    chosen = [i for i, (b, t) in enumerate(rows) if b.path in passing and wordy[i]]
    if not chosen:  # only link lists pass: the ratios of what is left decide
        rest = [i for i in range(len(rows)) if wordy[i]] or list(range(len(rows)))
        passing = passing_paths([rows[i] for i in rest], spread)
        chosen = [i for i in rest if rows[i][0].path in passing]
    if not chosen:
        return []
    plain = plain_paths(rows)
    keep, first, last = set(chosen), chosen[0], chosen[-1]
    homes = {rows[i][0].inside for i in chosen if rows[i][0].inside}
    if homes:  # content outside the article elements that hold some is not the article's
        keep = {i for i in chosen if rows[i][0].inside in homes}
    parents = {paths.parent[rows[i][0].path] for i in chosen}
    under = [False]
    for node in range(1, len(paths.parent)):
        under.append(node in parents or under[paths.parent[node]])
    for i, (b, t) in enumerate(rows):
        heading = b.leaf in HEADINGS
        if homes:
            near = b.inside in homes
        else:
            near = (first - 2 <= i <= last + 1 if heading else first <= i <= last) and under[b.path]
        if near and (heading or b.path in plain and wordy[i]):
            keep.add(i)
    return [rows[i][1] for i in sorted(keep)]


def extract(page: str | None) -> str:
    """Main text of a page; empty for null, empty or text-free pages."""
    return " ".join(select_blocks(*blocks(page))) if page else ""


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with its html column replaced by ``text``; a map, no shuffle.

    Null and empty pages give an empty text; other columns, null keys, repeated rows and empty
    tables pass through unchanged.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    schema = pages.select(*kept, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(x.as_py()) for x in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], [*kept, "text"])

    return pages.select(*kept, F.col(html_col)).mapInArrow(tidy(run), schema)


def op9_webtext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, from the whole html."""
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
