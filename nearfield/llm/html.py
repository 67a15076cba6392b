"""Main text of web pages by wrapper induction over the pages of a host.

Pages become small trees of elements in which siblings of one name are one (list items, paragraphs). All trees of a host are
folded into a template by simple tree matching: the alignment of two trees that pairs most nodes, parents with parents
and in order. A node of the template knows how many pages have it, on how many it has text, how much outside links, and
whether that text was the same in all.

The template then decides, for all pages of the host alike. Constant text is template. Of the boxes of a layout those go
in which little varies, against the largest one next to them, and most of that is links; a headline, an intro or a note
in a box of its own stays. What the template leaves open is
settled by names: an article or main element is the content; a box whose class, id or role ends in the name of a menu,
comments and so on is beside it, unless it holds more than all others; readers' comments are even then. Inside an article only boxes go that are so named
or constant on all pages; paragraphs and headings stay, as a host's pages may share whole passages.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.base import Scratch, map_batches, materialize

#: Elements without an end tag; whose content is no text; that start a block; of those, that hold text and no layout;
#: that never hold what an article says.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TEXT = frozenset("address blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre summary ul".split())
BESIDE = frozenset("nav footer aside form button select option label input dialog menu script style head noscript template iframe svg math title textarea".split())
#: Words that name such holders where one is the last of a class, id or role, or only GENERAL ones follow it.
BESIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply search share sharing sidebar skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: Those of them that are readers' own words, which may well be more than the article.
READERS = frozenset("comment comments replies reply".split())
GENERAL = frozenset("area bar block box container content holder inner item items left list outer panel right section slot text top wrap wrapper".split())
QUALIFIERS = frozenset("has no not with without".split())
#: Start tags that end an open element of these: the end tags that HTML leaves out.
ENDS = {"p": BLOCK - {"tbody", "td", "th", "tr", "thead", "tfoot", "caption", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_ENDING = frozenset().union(*ENDS.values())
#: Pages that must have the same text before it counts as template.
LEAST_PAGES = 3
#: A box of a layout that is links for the most part is beside the content if it holds less than this part of what varies
#: in the largest box next to it.
SMALL = 0.1
#: Elements open at once; deeper ones become children of the last one. Nodes of a template; one with more is handed on
#: by its task, and is kept without those of one page once it has been decided on.
DEEPEST, MOST_NODES = 100, 20_000
#: Templates that a task holds at once.
MOST_HOSTS = 2000

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_NEXT = re.compile(r"[>=]\s*")
_NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+")
_DIGITS = re.compile(r"\d+")
_ROOT = "html"


@dataclass
class Element:
    tag: str
    name: str = ""  # tag with class, id and role; numbers in them are all one
    children: list = field(default_factory=list)  # Elements and str, in order


def _element(tag: str, attributes: str) -> Element:
    names = [next(filter(None, m.groups()[1:]), "") for m in _NAMED.finditer(attributes)] if attributes else []
    return Element(tag, " ".join([tag, *(_DIGITS.sub("#", n) for n in names)]))


def _names_beside(name: str, known: frozenset = BESIDE_WORDS) -> bool:
    words = [w for w in _SPLIT.split(name.lower()) if w]
    while len(words) > 1 and words[-1] in GENERAL:
        words.pop()
    return bool(words) and words[-1] in known and words[0] not in QUALIFIERS


def _tags(page: str) -> Iterator[tuple[str, int, int, int, str]]:
    """Markup in order: kind ("/" an end tag, "" a start tag, "!" the rest), where it starts and ends, the end of the name,
    and the name.

    A quote after "=" hides ">" up to the same quote; one that never comes again is an ordinary character. A tag that
    does not end takes the rest of the page. Every character is looked at a bounded number of times.
    """
    n, last = len(page), {q: page.rfind(q) for q in "\"'"}
    raw: dict[str, re.Pattern] = {}
    at = 0
    while (m := _OPEN.search(page, at)) is not None:
        if m[1]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else n
            yield "!", m.start(), at, 0, ""
            continue
        i = m.end()
        while (x := _NEXT.search(page, i)) is not None and x[0][0] == "=":
            q = page[x.end() : x.end() + 1]
            close = page.find(q, x.end() + 1) if last.get(q, -1) > x.end() else -1
            i = close + 1 if close >= 0 else x.end()
        at = x.start() + 1 if x else n
        tag = (m[3] or "").lower()
        yield m[2] if tag else "!", m.start(), at, m.end(), tag
        if tag in RAW and not m[2] and not (tag in ("svg", "math") and page[at - 2 : at] == "/>"):  # the only ones that may close themselves
            if tag not in raw:
                raw[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
            end = raw[tag].search(page, at)
            yield "!", at, end.end() if end else n, 0, ""
            at = end.end() if end else n


def parse(page: str) -> Element:
    """A tree of the page; missing end tags are supplied, unknown ones passed over."""
    root = Element(_ROOT, _ROOT)
    stack, flat, upto = [root], Counter(), 0
    for kind, start, end, name, tag in _tags(page):
        if start > upto:
            stack[-1].children.append(page[upto:start])
        upto = end
        if kind == "/":
            if flat[tag]:  # of an element too deep to be opened
                flat[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if not (tag not in BLOCK and any(s.tag in BLOCK for s in stack[i + 1 :])):
                        del stack[i:]
                    break
        elif kind == "":
            while tag in _ENDING and len(stack) > 1:
                i = len(stack) - 1
                while i > 0 and stack[i].tag not in BLOCK:  # inline elements inside, as in <p><b>...<p>
                    i -= 1
                if i and tag in ENDS.get(stack[i].tag, ()):
                    del stack[i:]
                else:
                    break
            e = _element(tag, page[name:end])
            stack[-1].children.append(e)
            if tag not in RAW and tag not in VOID:
                if len(stack) < DEEPEST:
                    stack.append(e)
                else:
                    flat[tag] += 1
    if upto < len(page):
        stack[-1].children.append(page[upto:])
    return root


def clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


@dataclass
class Node:
    """Of a page or a template: ``text`` is a digest of the own text, None if there is none, -1 if it varies; ``filled``
    is the number of pages with such text, ``chars`` what they have of it in all, without links, ``linked`` what of it is links."""

    name: str
    text: int | None = None
    pages: int = 1
    children: list[Node] = field(default_factory=list)
    filled: int = 0
    chars: int = 0
    linked: int = 0
    # What the whole template says of the node: whether its text is template, anywhere or inside an article as well; how
    # much varies under it, and in its own text, on a page that has it; what of it is links on all pages; whether it holds an article or main element; and
    # whether it is named as a menu, comments and so on.
    constant: bool = False
    shared: bool = False
    weight: float = 0.0
    own: float = 0.0
    links: int = 0
    main: bool = False
    named: bool = False
    readers: bool = False
    # Of the root: nodes of a single page have gone.
    pruned: bool = False

    def dump(self) -> list:
        return [self.name, self.text, self.pages, [c.dump() for c in self.children], self.filled, self.chars, self.linked]

    @classmethod
    def load(cls, x: list) -> Node:
        return cls(x[0], x[1], x[2], [cls.load(c) for c in x[3]], x[4], x[5], x[6])

    @property
    def tag(self) -> str:
        return self.name.split(" ", 1)[0]

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def _join(a: Node, b: Node, pages: int, memo: dict) -> Node:
    """Two nodes as one: siblings of one page, whose texts become one, or aligned ones of several pages."""
    if a.text is None or b.text is None:
        text = b.text if a.text is None else a.text
    elif pages == 1:
        text = zlib.crc32(b"%d %d" % (a.text, b.text))
    else:
        text = a.text if a.text == b.text else -1
    filled = a.filled + b.filled if pages > 1 else max(a.filled, b.filled)
    return Node(a.name, text, pages, _merge(a.children, b.children, a.pages + b.pages if pages > 1 else 1, memo), filled, a.chars + b.chars, a.linked + b.linked)


def _own(e: Element, out: list[str], size: list[int], linked: bool = False) -> None:
    """Add the text outside inner blocks to ``out``, and its characters in no link and in links to ``size``."""
    for c in e.children:
        if isinstance(c, str):
            out.append(c)
            size[linked] += sum(map(len, c.split()))
        elif c.tag == "br":
            out.append(" ")
        elif c.tag not in BLOCK and c.tag not in RAW:
            _own(c, out, size, linked or c.tag == "a")


def _blocks_of(e: Element) -> Iterator[Element]:
    for c in e.children:
        if isinstance(c, Element):
            if c.tag in BLOCK:
                yield c
            elif c.tag not in RAW:
                yield from _blocks_of(c)


def skeleton(e: Element) -> Node:
    """The tree of blocks, with siblings of one name as one node in the place of the first."""
    out: dict[str, Node] = {}
    for c in _blocks_of(e):
        x = Node(c.name) if c.tag in BESIDE else skeleton(c)
        out[x.name] = _join(out[x.name], x, 1, {}) if x.name in out else x
    parts: list[str] = []
    size = [0, 0]
    _own(e, parts, size)
    text = clean("".join(parts))
    return Node(e.name, zlib.crc32(text.encode()) if text else None, 1, list(out.values()), int(bool(text)), *size)


def match(a: list[Node], b: list[Node], memo: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two rows of siblings, each with names of its own: pairs of the order-preserving alignment
    that covers most nodes, as the heaviest rising sequence of places."""
    memo = {} if memo is None else memo
    place = {y.name: j for j, y in enumerate(b)}
    pairs = [(i, place[x.name]) for i, x in enumerate(a) if x.name in place]
    if all(p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True)):
        return pairs
    best, before = [(0, -1)] * (len(b) + 1), []  # a Fenwick tree of (weight, last pair) by place
    top = (0, -1)
    for k, (i, j) in enumerate(pairs):
        x, at = (0, -1), j
        while at:
            x = max(x, best[at])
            at -= at & -at
        before.append(x[1])
        x = (x[0] + _score(a[i], b[j], memo), k)
        top, at = max(top, x), j + 1
        while at <= len(b):
            best[at] = max(best[at], x)
            at += at & -at
    out, k = [], top[1]
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _score(a: Node, b: Node, memo: dict) -> int:
    """Nodes that an alignment of two trees covers; each two are aligned once."""
    key = id(a), id(b)
    if key not in memo:
        memo[key] = 1 + sum(_score(a.children[x], b.children[y], memo) for x, y in match(a.children, b.children, memo))
    return memo[key]


def _merge(a: list[Node], b: list[Node], pages: int, memo: dict) -> list[Node]:
    """Siblings of two trees: aligned ones joined, the others in order of place. Of unaligned ones of one name a single
    node is kept, so a template grows with the names that occur and not with the pages."""
    pairs = match(a, b, memo)
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += [*a[i:x], *b[j:y]]
        if x < len(a):
            out.append(_join(a[x], b[y], a[x].pages + b[y].pages if pages > 1 else 1, memo))
        i, j = x + 1, y + 1
    first: dict[str, int] = {}
    kept: list[Node] = []
    for n in out:
        if n.name in first:
            k = first[n.name]
            kept[k] = _join(kept[k], n, kept[k].pages + n.pages if pages > 1 else 1, memo)
        else:
            first[n.name] = len(kept)
            kept.append(n)
    return kept


def fold(a: Node, b: Node) -> Node:
    """The template of two templates or pages of a host; every node of either is in it."""
    return _join(a, b, a.pages + b.pages, {})


def fold_all(parts: Iterator[Node]) -> Node:
    """The template of many, those of as many parts with each other, so that a large one is not gone through for every part."""
    stack: list[tuple[int, Node]] = []
    for t in parts:
        n = 1
        while stack and stack[-1][0] <= n:
            m, last = stack.pop()
            n, t = m + n, fold(last, t)
        stack.append((n, t))
    _, out = stack.pop()
    while stack:
        out = fold(stack.pop()[1], out)
    return out


def _varies(t: Node) -> bool:
    """Whether pages of the host differ at all; copies of one page have no template."""
    return t.text == -1 or any(map(_varies, t.children))


def decide(t: Node) -> Node:
    """Let the template say of each of its nodes what it is, from all pages of the host."""
    differ = _varies(t)

    def settle(x: Node) -> float:
        same = differ and t.pages >= LEAST_PAGES and x.text not in (None, -1) and x.filled >= LEAST_PAGES
        x.constant = same and 2 * x.filled > t.pages
        x.shared = x.constant and x.filled >= t.pages and x.tag in ("div", "section")
        varying = 0 if x.constant else x.chars
        total = 0 if x.tag in BESIDE else varying + sum([settle(c) for c in x.children])
        x.links = 0 if x.tag in BESIDE else x.linked + sum(c.links for c in x.children)
        x.weight, x.own = total / x.pages, varying / x.pages
        x.main = x.tag in ("article", "main") or any(c.main for c in x.children)
        words = x.name.split(" ")[1:] if x.tag not in TEXT and x.tag not in ("html", "body", "main", "article") else []
        x.named = x.tag == "header" or any(map(_names_beside, words))
        x.readers = any(_names_beside(w, READERS) for w in words)
        return total

    settle(t)
    if t.size() > MOST_NODES:
        t.children = [_without_rare(c) for c in t.children if c.pages > 1]
        t.pruned = True
    return t


def _without_rare(t: Node) -> Node:
    """A node that has been decided on, without those of a single page: what is above counts them, and that page has them."""
    t.children = [_without_rare(c) for c in t.children if c.pages > 1]
    return t


def _with_own(t: Node, own: Node) -> Node:
    """Of a template without nodes of a single page what a page has, with such nodes as the page itself tells them."""
    of = {c.name: c for c in t.children}
    return replace(t, children=[_with_own(of[c.name], c) if c.name in of else decide(c) for c in own.children])


def _beside(t: Node, there: list[Node], inside: bool) -> tuple[set[str], bool]:
    """Of the nodes that one page has under ``t``, the names of those beside the content, and whether the text around them is."""
    boxes = sorted((c for c in there if c.tag not in TEXT and c.tag not in BESIDE), key=lambda c: -c.weight)
    if not boxes:
        return set(), False
    plain = {c.name for c in boxes if not c.named or inside and c.name == "header"}
    holds = [] if inside else [c.name for c in boxes if c.main]
    holds = [n for n in holds if n in plain] or holds
    if holds:
        return {c.name for c in boxes} - set(holds), True
    text = t.own + sum(c.weight for c in there if c.tag in TEXT)
    rest = text + sum(c.weight for c in boxes if c.name in plain)
    layout, out = not inside and text < SMALL * boxes[0].weight, set()
    for c in boxes:
        if layout and c.weight < SMALL * boxes[0].weight and c.links >= c.weight * c.pages or c.name not in plain and (c.weight <= rest or c.readers and rest):
            out.add(c.name)
        elif c.name not in plain:  # a name says less than that all else is less
            rest += c.weight
    return out, False


def extract(page: str, template: Node | None) -> str:
    """The content's blocks, one a line; ``template`` has been through ``decide``. Without one, all but markup, menus,
    forms and the like by their tags."""
    out: list[str] = []
    root = parse(page)
    _collect(root, _with_own(template, skeleton(root)) if template and template.pruned else template, out, False)
    return "\n".join(out)


def _holds_article(e: Element) -> bool:
    return e.tag == "article" or any(map(_holds_article, _blocks_of(e)))


def _collect(e: Element, t: Node | None, out: list[str], inside: bool) -> None:
    """Blocks under ``e`` in page order; ``t`` is its node of the template, if it has one."""
    part: list[str] = []
    inside = inside or e.tag == "article" or e.tag == "main" and not any(_holds_article(c) for c in _blocks_of(e))
    of = {c.name: c for c in t.children} if t else {}
    beside, around = _beside(t, list({c.name: of[c.name] for c in _blocks_of(e) if c.name in of}.values()), inside) if of else (set(), False)
    constant = t is not None and (t.shared if inside else t.constant) or around

    def end() -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text and not constant:
            out.append(text)

    def walk(x: Element) -> None:
        for c in x.children:
            if isinstance(c, str):
                part.append(html.unescape(c))
            elif c.tag in BLOCK:
                end()
                if c.tag not in BESIDE and c.name not in beside and not (around and c.tag in TEXT):
                    _collect(c, of.get(c.name), out, inside)
            elif c.tag == "br":
                part.append(" ")
            elif c.tag not in RAW and c.tag not in BESIDE:
                walk(c)

    walk(e)
    end()


#: The host of an address.
def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _packed(t: Node) -> bytes:
    return zlib.compress(json.dumps(t.dump(), separators=(",", ":")).encode(), 1)


def _unpacked(b: bytes) -> Node:
    return Node.load(json.loads(zlib.decompress(b)))


def _spread(seen: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([_packed(t) for t in seen.values()], pa.binary())], names=["host", "template"])


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One template for each key; a key has a row for each task and for each MOST_NODES nodes that the task has met."""

    def run(key, group):
        whole = fold_all(_unpacked(t.as_py()) for t in group["template"])
        return pa.table({"host": [key[0].as_py()], "template": pa.array([_packed(whole)], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, "host string, template binary")


def induce(pages: DataFrame) -> DataFrame:
    """(host, template) from all pages: folded in each task, MOST_HOSTS at a time, then over groups of tasks, then over all.

    A template over MOST_NODES nodes is handed on and the task begins another: nothing is left out, and a page is not folded
    into a template much larger than that.
    """

    def run(batches):
        seen: dict[str, Node] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = skeleton(parse(page or ""))
                seen[host] = fold(seen[host], t) if host in seen else t
                if seen[host].pages % 64 == 0 and seen[host].size() > MOST_NODES:
                    yield _spread({host: seen.pop(host)})
                if len(seen) >= MOST_HOSTS:
                    yield _spread(seen)
                    seen = {}
        if seen:
            yield _spread(seen)

    parts = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, template binary")
    return _folded(_folded(parts.withColumn("task", F.spark_partition_id() % 1024), ["host", "task"]), ["host"])


#: Bytes of templates that are sent to all executors; beyond, pages and templates are joined by host.
BROADCAST_BYTES = 8 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    Null or empty html gives an empty text; a null url belongs to the host "". Repeated rows stay; other columns are
    left out. Within a block white space is one space; blocks are joined by one newline.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", _host().alias("host"), "html")
    with Scratch(spark, "templates") as s:
        templates, shared = s.write(induce(pages), "templates"), None
        size = templates.agg(F.sum(F.length("template")).alias("b")).first()["b"] or 0
        if size <= BROADCAST_BYTES:
            shared = spark.sparkContext.broadcast({r["host"]: bytes(r["template"]) for r in templates.collect()})
            rows = rows.withColumn("template", F.lit(None).cast("binary"))
        else:
            rows = rows.join(materialize(templates, "templates"), "host", "left")

    def make():
        known: dict[str, Node] = {}

        def run(b: pa.RecordBatch):
            out = []
            for host, page, own in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    packed = own or (shared.value.get(host) if shared else None)
                    known[host] = decide(_unpacked(packed)) if packed else None
                out.append(extract(page or "", known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return run

    return map_batches(rows.select("page_id", "url", "host", "html", "template"), make, "page_id long, url string, text string, n_chars long")
