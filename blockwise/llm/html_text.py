"""HTML extraction (operator 7): the main text of a page by tree scoring.

A forgiving tokenizer, linear in the page, builds the element tree. Elements that hold no text for readers (scripts,
styles, the head, hidden ones ...) are cut. Elements that by tag, role or the words of class and id are menus, headers and
footers of the page, sidebars, forms, notices, adverts or what readers write are *marked*; so is an ``article`` inside a
longer one, as comments are written.

Scoring
    Every paragraph passes points (one, plus its commas, plus one per hundred characters up to three, less
    its share of links) to its ``LEVELS`` nearest ancestors: all to the parent, half to the grandparent, a third ... A
    marked element keeps its points to itself. A container's score grows by a bonus for its tag and is reduced by its
    link density and, for each mark on it or above it, by a penalty. So a marked element is the best container only
    where nothing else compares with it.

Result
    The best container (widened to the ``article`` or ``main`` that encloses it) with its siblings: those that
    score at least a fifth of it, other articles, and beside a container that is no article all that is not mostly links.
    Marked elements in it are left out, unless the best container lies in them. All other text survives, in page order,
    however short.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockwise.llm.frames import table

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NO_TEXT = frozenset("head script style title textarea noscript template iframe object embed svg math canvas audio video map button select option optgroup datalist input label noembed noframes xmp".split())
NOT_MAIN = frozenset("nav footer aside form fieldset dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("br caption tbody td tfoot th thead tr html body legend".split())
SCOPE = frozenset("table td th caption button object html body".split())
SIBLING_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("td th table".split())
PASSES_BARRIER = frozenset("tr table tbody thead tfoot td th div article main section body html".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot select".split())
LISTY = LISTS | frozenset("li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# Words of class and id. Elements beside the article, what readers write, and the article itself.
BESIDE = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification pager pagination paywall popup promo promotion promoted recommended related search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar topbar widget widgets".split()
)
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
# These name a part of many articles too, so they count outside an article only.
READERS_OUTSIDE = frozenset("discussion discussions responses".split())
MAIN = frozenset("article body content entry main post story text".split())
STORY = frozenset("article entry post story".split())
STATE_FIRST = frozenset("has with without no is not hide show".split())
STATE_LAST = frozenset("open opened closed active visible hidden enabled disabled count on off".split())
HEAD_ONLY = frozenset("html head base link meta title style script noscript template".split())
KEPT, NAMED, TAGGED, READER, CUT = range(5)
TAG_BONUS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}
#: Ancestors that a paragraph's points reach.
LEVELS = 12
PENALTY = {KEPT: 1.0, NAMED: 0.3, TAGGED: 0.3, READER: 0.001}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_MARKING = re.compile("class|id|role|hidden|style", re.I)
_WORD = re.compile("[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


class Node:
    __slots__ = ("tag", "parent", "kids", "why", "closed", "story", "inside", "shaded", "paragraph", "item", "score", "chars", "link_chars", "factor")

    def __init__(self, tag: str, parent: Node | None, why: int = KEPT):
        self.tag, self.parent, self.why, self.closed = tag, parent, why, False
        self.kids: list[Node | str] = []
        self.story = tag in ("article", "main")
        # What lies above, so that the parser never climbs to find it: an article, a shaded part of the head, the open paragraph, the nearest list part.
        self.inside = parent is not None and (parent.inside or parent.story)
        self.shaded = parent is not None and (parent.shaded or parent.tag in ("noscript", "template"))
        self.paragraph = self if tag == "p" else None if tag in SCOPE or parent is None else parent.paragraph
        self.item = self if tag in LISTY else parent.item if parent is not None else None
        self.score, self.factor = 0.0, 1.0
        self.chars = self.link_chars = 0


def _named(value: str, inside: bool) -> int:
    """What the words of a class or an id say: KEPT, NAMED or READER."""
    why = KEPT
    for token in _CAMEL.sub("-", value).lower().split():
        parts = [w for w in re.split(r"[_\-]+|(?<=[a-z])(?=\d)", token) if w and not w.isdigit()]
        if not parts or parts[0] in STATE_FIRST or len(parts) > 1 and parts[-1] in STATE_LAST:
            continue
        readers = READERS if inside else READERS | READERS_OUTSIDE
        bad = [w in BESIDE or w in readers for w in parts]
        if not any(bad):
            continue
        # The last word is the noun (article-comments); before one that means the article, only a single bad word counts (sidebar-content).
        if bad[-1] or (bad[0] and (len(parts) == 2 or parts[-1] not in MAIN)) or not any(w in MAIN for w in parts):
            why = max(why, READER if any(w in readers for w in parts) else NAMED)
    return why


def _mark(tag: str, attrs: str, inside: bool) -> int:
    """How an element is marked, or CUT."""
    if tag in NO_TEXT:
        return CUT
    why = TAGGED if tag in NOT_MAIN or tag == "header" and not inside else KEPT
    if not _MARKING.search(attrs):
        return why
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag not in ("html", "body"):
                said = _named(value, inside)
                if said == READER or tag not in ("article", "main"):
                    why = max(why, said)
        elif name == "role" and value.lower() in ROLES and tag not in ("html", "body"):
            why = max(why, NAMED)
        elif tag not in ("html", "body") and (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()):
            return CUT
    return why


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends that begins before ``at``; a quote opens a value only after ``=`` and only if it is closed. -1 if it does not end."""
    while True:
        m = _EDGE.search(page, at)
        if m is None or m[0] == ">":
            return m.start() if m else -1
        at = m.end()
        before = m.start() - 1
        while page[before].isspace():
            before -= 1
        if page[before] == "=":
            close = page.find(m[0], at)
            at = close + 1 if close >= 0 else at


def parse(page: str) -> Node:
    """The element tree; unclosed and stray tags are resolved as browsers do in the common cases. Linear in the page.

    Where a tag does not end because of its quotes, quotes are ignored from there on.
    """
    root = node = Node("#root", None)
    head, heads = None, 0  # the open head, heads and bodies so far
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]  # of what is open since the last cell or table
    quotes = True
    n, last = len(page), page.rfind(">")
    at = text_from = 0

    def close(target: Node) -> None:
        nonlocal node
        while True:
            x, node = node, node.parent
            if x.tag in BARRIER:
                scopes.pop()
            scopes[-1][x.tag] -= 1
            opened[x.tag] -= 1
            if x is head:
                leave_head()
            if x is target:
                return

    def leave_head() -> None:
        nonlocal head
        head = None

    def say(to: int) -> None:
        if to > text_from:
            text = page[text_from:to]
            if node is head and text.strip():
                close(head)
            node.kids.append(html.unescape(text))

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt >= last:
            break
        c = page[lt + 1]
        if c in "!?":
            say(lt)
            end = page.find("-->", lt + 4) + 2 if page.startswith("<!--", lt) else page.find(">", lt)
            at = text_from = end + 1 if end > lt else n
            continue
        ending = c == "/"
        m = _NAME.match(page, lt + 1 + ending)
        if m is None:
            at = lt + 1
            continue
        end = _tag_end(page, m.end()) if quotes and not ending else page.find(">", m.end())
        if end < 0:
            quotes, end = False, page.find(">", m.end())
            if end < 0:
                break
        say(lt)
        at = text_from = end + 1
        name, attrs = m[0].lower(), page[m.end() : end]
        if ending:
            if (opened if name in PASSES_BARRIER else scopes[-1])[name] > 0:
                up = node
                while up.tag != name:
                    up = up.parent
                up.closed = True
                close(up)
            continue
        if name == "head" and heads:
            continue
        if head is not None and name not in HEAD_ONLY and (name == "body" or not (node.shaded or node.tag in ("noscript", "template"))):
            close(head)  # the end tag of head may be left out
        heads += name in ("head", "body")
        if name in CLOSES_P and node.paragraph is not None:
            close(node.paragraph)
        if name in SIBLING_END:
            ends, up = SIBLING_END[name], node.item
            while up is not None and up.tag not in ends and up.tag not in LISTS:
                up = up.parent.item
            if up is not None and up.tag in ends:
                while up.parent.tag in ends:
                    up = up.parent
                close(up)
        child = Node(name, node, _mark(name, attrs, node.inside or node.story))
        if child.why == KEPT and not child.story and name not in ("html", "body"):
            child.story = any(not STORY.isdisjoint(_WORD.findall(v.lower())) for a, v in _ATTR.findall(attrs) if a.lower() in ("class", "id")) if _MARKING.search(attrs) else False
        node.kids.append(child)
        if name in VOID or attrs.endswith("/") and name in ("svg", "path", "circle"):
            continue
        if name in RAW:
            done = _RAW_END[name].search(page, at)
            at = text_from = done.end() if done else n
            continue
        opened[name] += 1
        scopes[-1][name] += 1
        if name in BARRIER:
            scopes.append(Counter())
        node = child
        if name == "head":
            head = child
    say(n)
    return root


def _in_order(root: Node) -> list[Node]:
    """All elements but those that are cut, in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(k for k in reversed(x.kids) if isinstance(k, Node) and k.why != CUT)
    return order


def _mark_nested(order: list[Node]) -> None:
    """Marks an article inside one whose own paragraphs are at least as long: what readers wrote."""
    own: dict[int, int] = {}
    for x in reversed(order):
        kids = sum(own[id(k)] for k in x.kids if isinstance(k, Node) and id(k) in own and k.tag != "article" and not k.why)
        own[id(x)] = kids + (sum(len(k.strip()) for k in x.kids if isinstance(k, str)) if x.tag != "a" else 0)
    outer: dict[int, Node | None] = {}
    for x in order:
        above = outer.get(id(x.parent)) if x.parent is not None else None
        if x.tag == "article":  # by the tag alone; names do not tell who wrote it
            if above is not None and not x.why and own[id(above)] >= own[id(x)]:
                x.why = READER
            above = x
        outer[id(x)] = above


def measure(order: list[Node]) -> None:
    """Fills chars, link_chars (without marked elements inside), factors and scores."""
    commas: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for x in reversed(order):
        chars = links = comma = 0
        held = False
        for k in x.kids:
            if isinstance(k, str):
                s = k.strip()
                chars += len(s)
                comma += s.count(",")
            elif k.why != CUT:
                held = held or holds[id(k)] or k.tag in ("article", "main") and k.chars > 0
                if not k.why:
                    chars += k.chars
                    links += k.link_chars
                    comma += commas[id(k)]
        x.chars, x.link_chars = chars, chars if x.tag == "a" else links
        commas[id(x)], holds[id(x)] = comma, held
    for x in order:
        own = PENALTY[x.why]
        if x.why == TAGGED and x.closed and x.tag not in ("form", "fieldset") and not holds[id(x)]:
            own = 0.0
        x.factor = own * (x.parent.factor if x.parent is not None else 1.0)
        x.score = 0.0
    for x in order:
        own = x.tag not in PARAGRAPH and x.tag in BLOCK and any(isinstance(k, str) and k.strip() for k in x.kids)
        if not x.chars or not (x.tag in PARAGRAPH or own):
            continue
        points = (1 + commas[id(x)] + min(x.chars / 100, 3.0)) * (1 - x.link_chars / x.chars)
        up = x if own or x.why else x.parent
        for level in range(1, LEVELS + 1):
            if up is None or up.tag == "#root":
                break
            up.score += points / level
            if up.why:
                break
            up = up.parent
    for x in order:
        if x.score:
            x.score = (x.score + TAG_BONUS.get(x.tag, 0.0)) * (1 - x.link_chars / max(x.chars, 1)) * x.factor


def _texts(x: Node | str, out: list[str]) -> None:
    """Appends the kept text under x; block edges become spaces."""
    stack: list[Node | str] = [x]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.why:
            if k.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(k.kids))


def best_container(order: list[Node]) -> Node:
    """The element of the highest score, the first of equals, widened to the article or main around it."""
    best = max(order, key=lambda x: x.score)
    if best.score <= 0:
        best = next((x for x in order if x.tag in ("article", "main", "body") and x.chars and x.factor == 1.0), order[0])
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    return best


def _beside(k: Node | str, best: Node, least: float) -> bool:
    """A sibling of the best container belongs to the text."""
    if isinstance(k, str):
        return best.tag != "article"
    if k is best:
        return True
    if k.why or k.tag in ("html", "body"):
        return False
    if best.tag == "article":
        return k.score >= least or k.tag == "article" and k.link_chars < 0.5 * k.chars
    return k.score >= least or k.tag in ("h1", "h2", "h3", "h4") or k.link_chars < 0.25 * k.chars


def main_text(page: str | None) -> str:
    """Main text of a page: blocks in page order, white space collapsed, joined by one space; "" if there is none.

    Null and empty pages give "". A page without tags is its own text. Of equally good containers the first counts.
    """
    if not page:
        return ""
    order = _in_order(parse(page))
    _mark_nested(order)
    measure(order)
    best = best_container(order)
    up: Node | None = best
    while up is not None:
        up.why, up = KEPT, up.parent
    out: list[str] = []
    if best.parent is None or best.tag in ("main", "body", "html"):
        _texts(best, out)
    else:
        least = max(10.0, 0.2 * best.score)
        for k in best.parent.kids:
            if _beside(k, best, least):
                _texts(k, out)
    return " ".join("".join(out).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html give empty text, repeated rows are extracted one by one, nulls in other columns are passed
    through, an empty table gives an empty result; other columns are not read. Work is linear in a page.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
