"""HTML extraction by tag-path ratios.

1. A page is cut into text blocks.  Each block has a root-to-leaf tag path (tags with their class names); paths are numbers in
   a tree, so deep and long pages take linear time and memory.
2. Per path the text length and the punctuation are added up, and each is divided by the number of blocks on that path:
   text-path ratio and punctuation-path ratio.  Both are smoothed over the paths in page order and fused by their
   product; a path in a marked article weighs MARKED times, one whose tag or class says that it is something else (menu,
   form, comments, ...) NAMED times.  A path is content when the fused ratio reaches a share of the deviation over the page.
3. The content node is the deepest path of a single element that holds SHARE of the fused mass of the content paths.  Its blocks
   on content paths and their headings are the text; of a marked article that has a content path, all blocks are.  Parts that
   say they are something else are left out.

Inside an article a word of class or id may be its subject (a section id made from a heading): there a word of many
meanings, or a part of an id, drops an element only if its blocks don't read as article text, and never a heading or a paragraph.

Edge cases: null, empty or text-free html gives an empty text.  Unclosed tags end with their parent; the
text of an unclosed script or style is dropped, as a browser does; from an unclosed quote on, quotes don't hide the end of a tag,
and what follows the last ``>`` is text.  Repeated rows are extracted alike, an empty table gives no row, other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import lean, slices, texts, with_column_names

_TOKENS = (
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>%s)>"
    r"|<[!?/][^>]*+>"
    r"|(?P<text>[^<]++)"
)
TOKEN = re.compile(_TOKENS % r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+", re.S | re.I)
LOOSE = re.compile(_TOKENS % r"[^>]*+", re.S | re.I)
ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Fixed values of HTML: elements that a tag ends, up to the nearest of some others; elements that flow inside a block of text, and those that have no end tag.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Elements that hold no article text, and words in class, id or role that say the same of any element.
DROP_TAGS = frozenset("head nav aside footer form button menu dialog script style noscript template".split())
DROP_ROLES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertorial|sponsor(?:ed)?|promo(?:tion)?s?|banner|sidebar|side|aside|menu|navbar|nav|navigation|breadcrumbs?|footer|foot"
    r"|comments?|comment-?list|replies|reply|respond|discussion|disqus|cookies?|consent|gdpr|notices?|notification|alert|disclaimer|popup|modal|newsletter|subscribe|signup|login"
    r"|share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|search|masthead|topbar|complementary|contentinfo|skip-?links?)(?:$|[\s_-])",
    re.I,
)
#: Those of the words above that an article's own sections are named after too.
MANIFOLD = re.compile(r"(?:^|(?<=[\s_-]))(?:side|foot|discussion|consent|notices?|notification|alert|disclaimer|share|sharing|social|related|search|promotions?)(?=$|[\s_-])", re.I)
HEADING = re.compile(r"h[1-6]\Z")
#: Characters that a block of sentences has at least, on the average of a part without its headings.
SENTENCES = 60
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post-?(?:body|content)|entry-?content|story-?body|main-?content|content-?main)(?:$|[\s_-])", re.I)
#: What an article may say that it is no article.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:isement)?s?|sponsored|promo|comments?|reply|replies|related|recommended)(?:$|[\s_-])", re.I)
#: Weights of the ratios of paths inside a marked article, and of those that say they are something else.
MARKED, NAMED = 2.0, 0.02
#: Share of the content's mass that the content node holds.
SHARE = 0.8
#: Elements that are text of a node and no node themselves.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption center address hr".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。，]")
SPACE = re.compile(r"\s+")


class Block:
    """A text with the number of its path; what its element and its ancestors say."""

    __slots__ = ("path", "text", "dropped", "article", "doubt", "heading")

    def __init__(self, path, text, dropped, article, doubt=0, heading=False):
        self.path, self.text, self.dropped, self.article, self.doubt, self.heading = path, text, dropped, article, doubt, heading


class Paths:
    """Tag paths as a tree: parent and label of each number; number 0 is the page itself, and parents come before children."""

    def __init__(self):
        self.parent, self.label, self.elements, self.known = [0], [""], [1], {}

    def child(self, parent: int, label: str) -> int:
        if (parent, label) not in self.known:
            self.known[parent, label] = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.elements.append(0)
        self.elements[self.known[parent, label]] += 1
        return self.known[parent, label]

    def tag(self, path: int) -> str:
        return self.label[path].partition(".")[0]


def says_what_it_is(classes: str, ident: str) -> bool:
    """Whether an element in an article is no article text by its class, role or whole id, without a second meaning."""
    return bool(DROP_ROLES.search(MANIFOLD.sub("", classes)) or (m := DROP_ROLES.match(ident)) and m[0] == ident and not MANIFOLD.match(ident))


def judge_doubtful(blocks: list[Block]) -> None:
    """Drop the blocks of each doubtful element that doesn't read as article text: sentences of some length with marks."""
    of: dict[int, list[Block]] = {}
    for b in blocks:
        if b.doubt and not b.dropped:
            of.setdefault(b.doubt, []).append(b)
    for part in of.values():
        body = [b.text for b in part if not b.heading]
        if not body or sum(map(len, body)) < SENTENCES * len(body) or sum(len(PUNCTUATION.findall(t)) for t in body) < len(body):
            for b in part:
                b.dropped = True


def tokens(page: str) -> Iterator[re.Match | str]:
    """Tags, comments and raw elements as matches; what is no tag as text.  Linear in the page, whatever is left open."""
    at, end, last, token = 0, len(page), page.rfind(">"), TOKEN
    while at < end:
        if at > last and page[at] == "<":
            yield page[at:]
            return
        m = token.match(page, at)
        if m is None and token is TOKEN and page[at : at + 2] not in ("<", "< "):
            token = LOOSE
            m = token.match(page, at)
        if m is None:
            yield "<"
            at += 1
            continue
        yield m
        at = m.end()


def blocks_of(page: str) -> tuple[list[Block], Paths]:
    """Text blocks in page order, each with its tag path and what its ancestors say."""
    out: list[Block] = []
    paths = Paths()
    stack: list[tuple[str, int, bool, int, int]] = []  # tag, path, dropped, number of the article around it or 0, of the doubtful element
    where: defaultdict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
    parts: list[str] = []
    articles = doubts = 0

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                tag, *top = stack[-1] if stack else ("", 0, False, 0, 0)
                out.append(Block(top[0], text, *top[1:], bool(HEADING.match(tag))))

    def pop_to(k: int) -> None:
        flush()
        for tag, *_ in stack[k:]:
            where[tag].pop()
        del stack[k:]

    for m in tokens(page):
        if isinstance(m, str) or (text := m["text"]) is not None:
            parts.append(m if isinstance(m, str) else text)
            continue
        if m["raw"] or m["tag"] is None:
            if m["raw"] and parts:
                parts.append(" ")
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        if m["close"]:
            if where[tag]:
                pop_to(where[tag][-1])
            else:
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and where["p"]:
            pop_to(where["p"][-1])
        elif tag in ENDS:
            ends, limits = ENDS[tag]
            limit = max((where[x][-1] for x in limits if where[x]), default=-1)
            open_ = [where[x][bisect_right(where[x], limit) if tag == "tr" else -1] for x in ends if where[x] and where[x][-1] > limit]
            if open_:
                pop_to(min(open_) if tag == "tr" else max(open_))
        label, said, idents = tag, [], []
        for a in ATTR.finditer(m["attrs"] or ""):
            value = a[2] or a[3] or a[4] or ""
            said.append(value)
            if a[1].lower() == "id":
                idents.append(said.pop())
            if a[1].lower() == "class" and value:
                label = f"{tag}.{'.'.join(value.split())}"
        words, ident = " ".join([*said, *idents]), " ".join(idents)
        _, path, dropped, article, doubt = stack[-1] if stack else ("", 0, False, 0, 0)
        opens = tag in ("article", "main") or bool(words and ARTICLE.search(words))
        dropped = dropped or tag in DROP_TAGS or (tag == "header" and not article)
        if words and tag not in ("html", "body", "article", "main") and not opens:
            if not article:
                dropped = dropped or bool(DROP_ROLES.search(words))
            elif not dropped and DROP_ROLES.search(words):
                dropped = says_what_it_is(" ".join(said), ident)
                if not dropped and not doubt and tag != "p" and not HEADING.match(tag):
                    doubts += 1
                    doubt = doubts
        if tag == "article":
            dropped = dropped or bool(ASIDE.search(words)) or bool(where["article"])
        if opens and not article:
            articles += 1
            article = articles
        where[tag].append(len(stack))
        stack.append((tag, paths.child(path, label), dropped, article, doubt))
    flush()
    judge_doubtful(out)
    return out, paths


def path_ratios(blocks: list[Block]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The distinct paths in page order, the fused, smoothed ratio of each, its blocks."""
    paths: dict[int, list[float]] = {}
    for b in blocks:
        of = paths.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        of[0] += 1
        of[1] += len(b.text)
        of[2] += len(PUNCTUATION.findall(b.text))
        of[3] += NAMED if b.dropped else MARKED if b.article else 1.0
    count, length, marks, weight = np.array(list(paths.values())).T
    return list(paths), smoothed(length / count) * (1 + smoothed(marks / count)) * (weight / count), count


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """A 1-2-1 kernel over neighbouring paths that keeps three quarters of a path's own ratio."""
    padded = np.pad(ratio, 1, mode="edge")
    return 0.75 * ratio + 0.125 * (padded[:-2] + padded[2:])


def content_node(paths: Paths, mass: dict[int, float], share: float = SHARE) -> int:
    """The deepest path of a single element, no text of one, that holds ``share`` of the mass."""
    total = [0.0] * len(paths.parent)
    best = [0] * len(paths.parent)
    for k in range(len(total) - 1, 0, -1):
        total[k] += mass.get(k, 0.0)
        up = paths.parent[k]
        total[up] += total[k]
        if not best[up] or total[k] >= total[best[up]]:
            best[up] = k
    node = 0
    while (k := best[node]) and total[k] >= share * total[0] and paths.elements[k] == 1 and paths.tag(k) not in TEXTUAL:
        node = k
    return node


def extract(page: str | None, share: float = 0.5) -> str:
    """The main text: content blocks joined by two line feeds."""
    blocks, paths = blocks_of(page) if page else ([], Paths())
    if not any(not b.dropped for b in blocks):
        return ""
    order, fused, count = path_ratios(blocks)
    limit = share * fused.std()
    mass = {p: f * n for p, f, n in zip(order, fused, count, strict=True) if f >= limit}
    node = content_node(paths, mass)
    inside = [node == 0] * len(paths.parent)
    for k in range(1, len(inside)):
        inside[k] = k == node or inside[paths.parent[k]]
    # a heading takes the verdict of the content it stands in, as its own ratio is always low
    parents = {paths.parent[p] for p in mass}
    said = {b.article for b in blocks if b.article and b.path in mass}
    kept = [b for b in blocks if inside[b.path] and not b.dropped and (b.article in said or b.path in mass or (b.heading and paths.parent[b.path] in parents))]
    return "\n\n".join(b.text for b in kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; a map over the rows, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            out = [extract(t) for t in texts(b, "html")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    pages = with_column_names(pages, "page_id", "url", "html")
    kind = dict(pages.dtypes)["page_id"]
    return pages.mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")
