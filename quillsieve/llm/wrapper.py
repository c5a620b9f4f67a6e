"""Main text of web pages by wrapper induction.

Pages of one host come from one template. Trees of block elements are aligned by simple tree
matching: the largest number of node pairs of equal kind (tag with class or id), in order, level
by level. Runs of siblings of one kind are one iterated node, as lists and paragraphs repeat.

All pages of a host take part in each step; those of the same blocks, texts and links count once.
First every page becomes its record: the kinds of its nodes, and of their texts digest and size.
Names of elements that stand on fewer than `LEAST` pages of the host (numbers of articles and the
like) are one name, `?`. From all records a template is merged: a position for every node of any
page. Then every record is aligned with it, and for each position it is counted on how many pages it
stands, how much text of its own it has, how much of that is links, how often it repeats the page's
title, and on how many pages each of its texts stands there. From these the positions are judged (`judge`):

- a text that stands at its position on at least `SHARE` of the pages that have it is constant: template;
- the content is the lowest position that holds most of the text that varies and isn't linked;
- positions beside the way down to it are template, but for those that repeat the title, stand
  between that and the way down, or hold text of the same order; positions within it are content,
  but for those that are mostly links.

Last, every page is aligned again and gives the text of its content positions. A node at no
known position takes part in what is around it; outside the content it has to have unlinked text
and no mark, and one at a position of fewer than `LEAST` pages, or of the name `?`, no mark. Marks are tags, roles, classes and ids by which an element names itself as menu,
advert, form, comments and the like: they also cut such elements within the content, and they
alone decide (`prune`) on hosts with fewer than `LEAST` different pages or without text that
varies, and on pages that lack the content positions of their host. The column `rule` tells which of
both decided on a page, `cut_aligned` and `cut_marked` how many code points went by either.

The text: blocks in page order, one line each; character references decoded, white space within a
block turned into one blank.

Defined results: a null or empty page, or one without such text, gives the empty text; all pages
without an address are one host; markup that never ends counts to the end of the page; rows of
one id are extracted each on their own; an empty table gives an empty table; nesting has no limit.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import scratch, small, staged

LEAST = 5  # different pages below which a host has no template, a text isn't constant, and a name of an element is none
SHARE = 0.8
MOST = 0.6  # of the varying text of a position that one below it must hold to be the way down
ORDER = 0.1  # of the text of the way down that a position beside it must have to be content
TEXT = 200  # code points a page, on average, below which a position whose own mark says that it is no article isn't content
PART = 2  # hexadecimal digits of the digests of shapes that are merged in one task: 256 parts of a host
MOST_COUNTS = 1 << 17  # entries that a task holds before it gives them on
CELLS = 1 << 21  # pairs of children above which a table is split, so that memory stays bounded; the result is as large
SPARSE = 32  # pairs of children for one that may pair, beyond which only those are gone through

TOKEN = re.compile(r"<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul noscript template select button svg canvas object audio video option".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt option legend summary select button svg canvas object audio video noscript template head html body".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
INERT = frozenset("head noscript template select button svg canvas object audio video dialog".split())  # never text of a page
OFF_TAGS = INERT | frozenset("nav footer aside form menu".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
OFF_WORDS = frozenset("nav navbar navigation menu footer sidebar ad ads advert adverts advertisement advertising banner cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social breadcrumb breadcrumbs comment comments respond replies disqus related promo promotion sponsor sponsored pagination pager widget widgets toolbar login masthead copyright".split())
#: Words that say nothing beside one of the above: "site-footer" is a footer, "related-work" isn't.
PLAIN_WORDS = frozenset("site page main top bottom left right upper lower inner outer first last primary secondary global local box bar wrapper wrap container block slot area list item items section region panel holder unit group row col column links link posts post articles stories form policy overlay buttons button icons icon media thread feed text header head title body responsive sticky fixed mobile desktop small large id js the".split())
HEADINGS = frozenset("h1 h2 h3".split())


class Linked(str):
    """Text within a link."""

    __slots__ = ()


class Node:
    __slots__ = ("inert", "items", "key", "off", "tag")

    def __init__(self, tag: str, key: str = "", off: bool = False, inert: bool = False) -> None:
        self.tag, self.key, self.off, self.inert, self.items = tag, key, off, inert, []


def _named_off(value: str) -> bool:
    """Whether one of the names in a class or id is made of words for what is no article."""
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit() and not re.fullmatch(r"[0-9]+x[0-9]+", w)]
        if any(w in OFF_WORDS for w in words) and all(w in OFF_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


def _judge(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Class or id of an element, whether it says that it is no article, and whether it is never shown as text."""
    key, inert = "", tag in INERT
    off = tag in OFF_TAGS
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                key = key or value
                off = off or _named_off(value)
            elif name == "role":
                off = off or value in OFF_ROLES
                key = "main" if value == "main" else key
            elif name == "hidden":
                inert = True
            elif name == "aria-hidden":
                inert = inert or value == "true"
            else:
                inert = inert or "display:none" in value.replace(" ", "")
    return key, off or inert, inert


def parse(page: str) -> tuple[Node, str]:
    """The tree of block elements and the title; runs of text stand between elements, inline elements dissolve."""
    root, title = Node("html"), ""
    stack, at = [root], 0
    open_: Counter[str] = Counter()
    hidden = None  # an inline element that is no article, with the depth of its own kind
    link = 0  # the length of the stack where a link began, 0 outside

    def text(piece: str) -> None:
        if piece and hidden is None:
            piece = entities.unescape(piece) if "&" in piece else piece
            stack[-1].items.append(Linked(piece) if link else piece)

    def close(i: int) -> None:
        nonlocal link
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]
        link = link if link <= len(stack) else 0

    match = TOKEN.search(page)
    while match:
        text(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = match[1], match[2], match[3]
        if tag:
            tag = tag.lower()
            if closing:
                if hidden and tag == hidden[0]:
                    hidden = (tag, hidden[1] - 1) if hidden[1] > 1 else None
                elif tag == "a":
                    link = 0
                elif tag in BLOCK and open_[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                if tag == "title" and not title:
                    title = " ".join(entities.unescape(page[at : end.start() if end else len(page)]).split())
                if not end:
                    at = len(page)
                    break
                at = end.start()
            elif tag in VOID:
                if tag == "hr":
                    stack[-1].items.append(Node("hr"))
                else:
                    text(" " if tag in ("br", "img") else "")
            elif tag in BLOCK:
                hidden = None
                if tag in CLOSES_P and open_["p"]:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag == "p":
                            close(i)
                            break
                        if stack[i].tag in ("td", "th", "button", "object", "table"):
                            break
                if tag in SAME and any(open_[t] for t in SAME[tag]):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in SAME[tag]:
                            close(i)
                            break
                        if stack[i].tag in HOLDS[tag]:
                            break
                if tag in ("html", "body") and not attributes.strip():
                    pass
                elif not attributes.rstrip().endswith("/") or tag not in ("svg", "canvas", "object"):
                    node = Node(tag, *_judge(tag, attributes))
                    stack[-1].items.append(node)
                    stack.append(node)
                    open_[tag] += 1
            elif hidden:
                hidden = (hidden[0], hidden[1] + (tag == hidden[0]))
            elif attributes and _judge(tag, attributes)[1] and not attributes.rstrip().endswith("/"):
                hidden = (tag, 1)
            elif tag == "a":
                link = link or len(stack)
        match = TOKEN.search(page, at)
    text(page[at:])
    return root, title


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.items) if not isinstance(x, str)]


def own(node: Node) -> str:
    """The text of a node outside its children, in one line."""
    return " ".join(" ".join(x if isinstance(x, str) else " " for x in node.items).split())


def _amounts(node: Node) -> tuple[int, int]:
    """Code points of text in a subtree, and those in links."""
    every = links = 0
    for n in _walk(node):
        for x in n.items:
            if isinstance(x, str):
                size = len(x.strip())
                every += size
                links += size if isinstance(x, Linked) else 0
    return every, links


# --- marks --------------------------------------------------------------------------------------


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.key == "main"


def prune(root: Node) -> tuple[Node, int]:
    """The part of the tree that may be article, by its marks alone, and the code points that went."""
    main = {id(root)}
    order = list(_walk(root))
    heads: set[int] = set()
    for node in reversed(order):  # children come before their parents
        below = [x for x in node.items if not isinstance(x, str)]
        if _is_main(node) and not node.off or any(id(x) in main for x in below):
            main.add(id(node))
        if node.tag in HEADINGS or any(id(x) in heads for x in below):
            heads.add(id(node))
    before = _amounts(root)[0]
    stack = [(root, _is_main(root))]
    while stack:
        node, inside = stack.pop()
        items = []
        for x in node.items:
            if isinstance(x, str):
                items.append(x)
                continue
            head = x.tag == "header" or "header" in re.split(r"[^a-z0-9]+", x.key)
            if x.inert or x.off and (inside or id(x) not in main) or head and id(x) not in main and not (inside and id(x) in heads):
                items.append(Node("hr"))
            else:
                items.append(x)
                stack.append((x, inside or _is_main(x)))
        node.items = items
    for wanted in (lambda n: n.tag == "article", _is_main):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if wanted(node):
                found.append(node)
            else:
                stack += [x for x in reversed(node.items) if not isinstance(x, str)]
        if found:
            top = Node("html")
            top.items = found
            return top, before - _amounts(top)[0]
    return root, before - _amounts(root)[0]


# --- simple tree matching -----------------------------------------------------------------------


class Slot:
    """A position: its kind, the positions below it, the nodes of one page that stand there (or what is seen of them), and what is known of it."""

    __slots__ = ("constant", "does", "kids", "kind", "names", "nodes", "number", "places")

    def __init__(self, kind: str, kids: list[Slot] | None = None, nodes: list[Node] | None = None) -> None:
        self.kind, self.kids, self.nodes = kind, kids or [], nodes or []
        self.constant, self.does, self.names, self.number = frozenset(), "", frozenset(), 0
        self.places: dict[str, list[int]] | None = None

    def by_kind(self) -> dict[str, list[int]]:
        """The places among the positions below of each kind; made once, so that a page's cost isn't that of a wide template."""
        if self.places is None:
            self.places = {}
            for i, kid in enumerate(self.kids):
                self.places.setdefault(kid.kind, []).append(i)
        return self.places


def _totals(weights: np.ndarray) -> np.ndarray:
    """The largest totals of all rows with each prefix of the columns."""
    row = np.zeros(weights.shape[1] + 1, np.int64)
    for w in weights:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
    return row


def alignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns, in order, of the largest total weight; weight 0 never pairs."""
    n, m = weights.shape
    if n * m > CELLS and n > 1:
        half = n // 2
        ahead, back = _totals(weights[:half]), _totals(weights[half:][::-1, ::-1])
        cut = int(np.argmax(ahead + back[::-1]))
        return alignment(weights[:half, :cut]) + [(half + i, cut + j) for i, j in alignment(weights[half:, cut:])]
    best = np.zeros((n + 1, m + 1), np.int64)
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weights[i]))
    pairs, i, j = [], n, m
    while i and j and best[i, j]:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def chain(matches: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """As `alignment`, from the pairs that have a weight (row, column, weight), for tables in which few have."""
    columns = {j: k for k, j in enumerate(sorted({j for _, j, _ in matches}), 1)}
    tree = [(0, -1)] * (len(columns) + 1)  # the best chain that ends in some first columns, by its last match
    order = sorted(matches, key=lambda x: (x[0], -x[1]))  # a row's columns from the right, so that none follows another
    before = []
    for n, (_, j, w) in enumerate(order):
        k, best = columns[j] - 1, (0, -1)
        while k:
            if tree[k][0] > best[0]:
                best = tree[k]
            k &= k - 1
        before.append(best[1])
        k, total = columns[j], best[0] + w
        while k < len(tree):
            if tree[k][0] < total:
                tree[k] = (total, n)
            k += k & -k
    n, pairs = max(tree, key=lambda x: x[0])[1], []
    while n >= 0:
        pairs.append(order[n][:2])
        n = before[n]
    return pairs[::-1]


def pairing(a: Slot, b: Slot) -> tuple[dict[tuple[int, int], list[tuple[int, int]]], int]:
    """For pairs of positions with positions below: which of those pair; and how many nodes of both trees pair, a and b being a pair."""
    todo = [(a, b)]
    for s, n in todo:  # grows; those below come after
        if s.kids:
            places = s.by_kind()
            for y in n.kids:
                if y.kids:
                    todo += [(s.kids[i], y) for i in places.get(y.kind, ()) if s.kids[i].kids]
    weight: dict[tuple[int, int], int] = {}
    plan: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for s, n in reversed(todo):
        places = s.by_kind()
        if len(s.kids) == len(n.kids) == len(places) and all(x.kind == y.kind for x, y in zip(s.kids, n.kids, strict=True)):  # nothing pairs more than all in their order
            pairs = [(i, i) for i in range(len(s.kids))]
        else:
            columns = [j for j, y in enumerate(n.kids) if y.kind in places]
            rows = sorted({i for kind in {n.kids[j].kind for j in columns} for i in places[kind]})
            if sum(len(places[n.kids[j].kind]) for j in columns) * SPARSE < len(rows) * len(columns):
                pairs = chain([(i, j, weight.get((id(s.kids[i]), id(n.kids[j])), 1)) for j in columns for i in places[n.kids[j].kind]])
            else:
                row = {i: k for k, i in enumerate(rows)}
                weights = np.zeros((len(rows), len(columns)), np.int32)
                for k, j in enumerate(columns):
                    for i in places[n.kids[j].kind]:
                        weights[row[i], k] = weight.get((id(s.kids[i]), id(n.kids[j])), 1)
                pairs = [(rows[i], columns[k]) for i, k in alignment(weights)]
        plan[id(s), id(n)] = pairs
        weight[id(s), id(n)] = 1 + sum(weight.get((id(s.kids[i]), id(n.kids[j])), 1) for i, j in pairs)
    return plan, weight[id(a), id(b)]


def paired(a: Slot, b: Slot) -> Iterator[tuple[Slot, Slot]]:
    plan, _ = pairing(a, b)
    stack = [(a, b)]
    while stack:
        s, n = stack.pop()
        yield s, n
        stack += [(s.kids[i], n.kids[j]) for i, j in plan.get((id(s), id(n)), ())]


def merge(a: Slot, b: Slot) -> None:
    """Brings what b has into a, whose positions stay those they are."""
    plan, _ = pairing(a, b)
    stack = [(a, b)]
    while stack:
        s, n = stack.pop()
        s.nodes += n.nodes
        kids, i, j = [], 0, 0
        for x, y in plan.get((id(s), id(n)), ()):
            kids += s.kids[i:x] + n.kids[j:y] + [s.kids[x]]
            stack.append((s.kids[x], n.kids[y]))
            i, j = x + 1, y + 1
        s.kids, s.places = kids + s.kids[i:] + n.kids[j:], None


def fold(root: Node) -> Slot:
    """The positions of one page: siblings of one kind in a row are one."""
    made: dict[int, Slot] = {}
    for node in reversed(list(_walk(root))):
        slot = Slot(f"{node.tag} {node.key}", nodes=[node])
        for x in node.items:
            if not isinstance(x, str) and not x.inert:
                below = made.pop(id(x))
                if slot.kids and slot.kids[-1].kind == below.kind:
                    merge(slot.kids[-1], below)
                else:
                    slot.kids.append(below)
        made[id(node)] = slot
    return made[id(root)]


def slots(top: Slot) -> Iterator[Slot]:
    stack = [top]
    while stack:
        slot = stack.pop()
        yield slot
        stack += reversed(slot.kids)


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


# --- templates ----------------------------------------------------------------------------------


def _seen(node: Node, title: str) -> list:
    """Digest and code points of a node's own text, those in links, and whether it repeats the title."""
    line = own(node)
    if not line:
        return []
    links = sum(len(x.strip()) for x in node.items if isinstance(x, Linked))
    return [_digest(line), len(line), links, int(2 * links < len(line) and bool(title) and (line in title or title in line))]


def record(page: str) -> str:
    """A page as JSON: of each position in order its kind, the number of those just below it, and what is seen of its nodes."""
    tree, title = parse(page)
    return json.dumps([[s.kind, len(s.kids), [_seen(n, title) for n in s.nodes]] for s in slots(fold(tree))])


def read(rows: list[list]) -> Slot:
    """The positions of a record, or of a shape, which has kinds and numbers only."""
    top, open_ = None, []
    for i, (kind, kids, *nodes) in enumerate(rows):
        slot = Slot(kind, nodes=nodes[0] if nodes else None)
        slot.number = i
        while open_ and not open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].kids.append(slot)
            open_[-1][1] -= 1
        else:
            top = slot
        open_.append([slot, kids])
    return top


def renamed(top: Slot, names: frozenset[str]) -> Slot:
    """The positions of one page with kinds beyond those given as kinds of the name ?, folded anew."""
    order = list(slots(top))
    if all(s.kind in names for s in order):
        return top
    for slot in reversed(order):  # positions come before those above them
        if slot.kind not in names:
            slot.kind = slot.kind.partition(" ")[0] + " ?"
        kids: list[Slot] = []
        for kid in slot.kids:
            if kids and kids[-1].kind == kid.kind:
                merge(kids[-1], kid)
            else:
                kids.append(kid)
        slot.kids, slot.places = kids, None
    return top


def shape(top: Slot) -> str:
    """As JSON: of each position in order its kind and the number of those just below it."""
    return json.dumps([[s.kind, len(s.kids)] for s in slots(top)])


def merged(shapes: Iterable[str]) -> str:
    top = None
    for made in shapes:
        if top is None:
            top = read(json.loads(made))
        else:
            merge(top, read(json.loads(made)))
    return shape(top)


class Template:
    """Merges the pages of one host as `templates` does, in one place."""

    def __init__(self) -> None:
        self.known: set[str] = set()

    def add(self, page: str) -> None:
        self.known.add(record(page))

    def made(self) -> str | None:
        """The shape of all pages together."""
        if len(self.known) < LEAST:
            return None
        pages = [json.loads(r) for r in self.known]
        stands = Counter(kind for rows in pages for kind in {row[0] for row in rows})
        names = frozenset(kind for kind, n in stands.items() if n >= LEAST)
        parts: dict[str, list[str]] = {}
        for at, made in sorted((_digest(x), x) for x in {shape(renamed(read(rows), names)) for rows in pages}):
            parts.setdefault(at[:PART], []).append(made)
        return merged(merged(part) for part in parts.values())


def load(made: str, does: str = "", constants: list[list[str]] | None = None) -> Slot:
    top = read(json.loads(made))
    order = list(slots(top))
    for i, slot in enumerate(order):
        slot.does, slot.constant = does[i : i + 1], frozenset(constants[i] if constants else ())
    top.names = frozenset(slot.kind for slot in order)
    return top


#: What is counted for a position, or for a text at a position: pages, code points, those in links, pages on which it repeats the title.
Counts = dict[tuple[int, str], list[int]]


def count(page: str, template: Slot, counts: Counts) -> None:
    count_record(record(page), template, counts)


def count_record(made: str, template: Slot, counts: Counts) -> None:
    for slot, here in paired(template, renamed(read(json.loads(made)), template.names)):
        every, links, titled, texts = 0, 0, 0, Counter()
        for seen in here.nodes:
            if seen:
                every += seen[1]
                links += seen[2]
                titled = seen[3]
                texts[seen[0]] += seen[1]
        titled = titled if len(here.nodes) == 1 else 0
        for at, row in [((slot.number, ""), (1, every, links, titled))] + [((slot.number, t), (1, n, 0, 0)) for t, n in texts.items()]:
            have = counts.get(at)
            if have is None:
                counts[at] = list(row)
            else:
                for k in range(4):
                    have[k] += row[k]


def _marked(slot: Slot) -> bool:
    tag, _, key = slot.kind.partition(" ")
    return tag in OFF_TAGS or _named_off(key)


def judge(made: str, counts: Counts) -> tuple[str, list[list[str]]] | None:
    """What each position is (c: content, r: content on fewer than LEAST pages, t: template, p: on the way to content) and its constant texts; None if there is too little to judge by."""
    order = list(slots(load(made)))
    n = len(order)
    pages, every, links, titled = (np.array([counts.get((i, ""), (0, 0, 0, 0))[k] for i in range(n)], np.int64) for k in range(4))
    constants: list[list[str]] = [[] for _ in order]
    free = every - links
    for (i, t), seen in sorted(counts.items()):
        if t and seen[0] >= LEAST and seen[0] >= SHARE * pages[i]:
            constants[i].append(t)
            free[i] -= seen[1]
    free = np.maximum(free, 0)
    mass, linked = free.copy(), links.copy()
    for slot in reversed(order):
        for kid in slot.kids:
            mass[slot.number] += mass[kid.number]
            linked[slot.number] += linked[kid.number]
    does = ["t"] * n
    at = order[0]
    while True:
        down = max((s for s in at.kids if pages[s.number] >= LEAST), key=lambda s: mass[s.number], default=None)
        if down is None or not down.kids or mass[down.number] < MOST * mass[at.number] or free[at.number] > ORDER * mass[at.number]:
            break
        does[at.number] = "p"
        level = mass[down.number] / pages[down.number]
        place = at.kids.index(down)
        title = next((k for k, kid in enumerate(at.kids) if 2 * titled[kid.number] > pages[kid.number] > 0), place)
        for k, kid in enumerate(at.kids):
            i = kid.number
            unlinked = linked[i] < mass[i]
            if k != place and unlinked and (title <= k < place or 2 * titled[i] > pages[i] or mass[i] / pages[i] >= ORDER * level):
                does[i] = "c"
        at = down
    does[at.number] = "c"
    way = [s for s in order if does[s.number] == "p"] + [at]
    if not mass[at.number] or mass[at.number] < TEXT * pages[0] and any(_marked(s) for s in way):
        return None
    roots = [s for s in order if does[s.number] == "c"]
    for root in roots:
        for slot in slots(root):
            i = slot.number
            if slot is root:
                continue
            often = 2 * pages[i] > pages[root.number]
            does[i] = "t" if often and linked[i] > mass[i] else "c"
    return "".join("r" if d == "c" and pages[i] < LEAST else d for i, d in enumerate(does)), constants


# --- extraction ---------------------------------------------------------------------------------


class Blocks:
    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []

    def flush(self) -> None:
        line = " ".join("".join(self.run).split())
        if line:
            self.lines.append(line)
        self.run.clear()


def _by_template(tree: Node, template: Slot) -> tuple[str, int, int] | None:
    """Text and the code points that went by position and by marks; None if the page has none of the content positions."""
    at: dict[int, Slot] = {}
    found = False
    for slot, here in paired(template, renamed(fold(tree), template.names)):
        found |= slot.does == "c"
        for node in here.nodes:
            at[id(node)] = slot
    if not found:
        return None
    blocks, cut, marked = Blocks(), 0, 0
    stack: list = [(tree, 0, at[id(tree)].does)]
    while stack:
        node, i, state = stack.pop()
        slot = at.get(id(node))
        mute = state != "c" or bool(slot and slot.constant and _digest(own(node)) in slot.constant)
        while i < len(node.items):
            x = node.items[i]
            i += 1
            if isinstance(x, str):
                if mute:
                    cut += len(x.strip())
                else:
                    blocks.run.append(x)
                continue
            blocks.flush()
            known = at.get(id(x))
            below = known.does if known and state != "t" else state
            unsure = not known or known.does == "r" or known.does == "c" and known.kind.endswith(" ?")
            below = "c" if below == "r" else below
            if x.inert or (x.off and state == "c") or (x.off and state == "p" and unsure):
                marked += _amounts(x)[0]
                continue
            if below == "p" and not known:  # at no known position, outside the content
                every, links = _amounts(x)
                below = "c" if every > 2 * links else "t"
            stack.append((node, i, state))
            node, i, state = x, 0, below
            slot = known
            mute = state != "c" or bool(slot and slot.constant and _digest(own(node)) in slot.constant)
        blocks.flush()
    return "\n".join(blocks.lines), cut, marked


def _by_marks(tree: Node) -> tuple[str, int, int]:
    top, cut = prune(tree)
    blocks = Blocks()
    stack: list = [(top, 0)]
    while stack:
        node, i = stack.pop()
        while i < len(node.items):
            x = node.items[i]
            i += 1
            if isinstance(x, str):
                blocks.run.append(x)
            else:
                blocks.flush()
                stack.append((node, i))
                node, i = x, 0
        blocks.flush()
    return "\n".join(blocks.lines), 0, cut


def extract(page: str | None, template: Slot | None = None) -> tuple[str, str, int, int]:
    """The main text of a page, the rule that decided on it (aligned or marks), and the code points that went by position and by marks."""
    if not page:
        return "", "marks", 0, 0
    tree, _ = parse(page)
    done = _by_template(tree, template) if template else None
    return (done[0], "aligned", *done[1:]) if done else (lambda x: (x[0], "marks", *x[1:]))(_by_marks(tree))


# --- over tables --------------------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _pack(text: str) -> bytes:
    """What is sent along with every page of a host, where names come again and again."""
    return zlib.compress(text.encode("utf-8", "surrogatepass"), 6)


def _unpack(packed: bytes) -> str:
    return zlib.decompress(packed).decode("utf-8", "surrogatepass")


def _records():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [record(page or "") for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "record"])

    return run


def records(pages: DataFrame) -> DataFrame:
    """host, record: the different pages of each host (pages: host, html)."""
    return pages.select("host", "html").mapInArrow(_records(), "host string, record string").distinct()


def _kinds():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            columns = [[h for h, _ in counts], [k for _, k in counts], list(counts.values())]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["host", "kind", "pages"])

        for batch in batches:
            for h, made in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((h, kind) for kind in {row[0] for row in json.loads(made)})
                if len(counts) > MOST_COUNTS:
                    yield out()
                    counts.clear()
        yield out()

    return run


def _names():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_pack(json.dumps(sorted(x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary())], ["host", "names"])

    return run


def _shapes():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, frozenset[str]] = {}
        known: set[tuple[str, str]] = set()  # those given already, a bounded number of them
        for batch in batches:
            out = [[], [], []]
            for h, made, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if packed not in names:
                    if len(names) > 1000:
                        names.clear()
                    names[packed] = frozenset(json.loads(_unpack(packed)))
                here = shape(renamed(read(json.loads(made)), names[packed]))
                at = _digest(here)
                if (h, at) not in known:
                    if len(known) > MOST_COUNTS:
                        known.clear()
                    known.add((h, at))
                    for column, x in zip(out, (h, at, here), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["host", "at", "shape"])

    return run


def _merge():
    """Merges the different shapes of each host and part, which follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, top = None, None, None

        def out() -> pa.RecordBatch:
            columns = [[now[0]], [now[1]], [shape(top)]] if now else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "at", "shape"])

        for batch in batches:
            for h, part, at, made in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (h, part) != now:
                    yield out()
                    now, last, top = (h, part), at, read(json.loads(made))
                elif at != last:
                    last = at
                    merge(top, read(json.loads(made)))
        yield out()

    return run


def templates(seen: DataFrame) -> DataFrame:
    """host, template: positions merged from all pages of each host that has LEAST different ones (seen: host, record).

    Shapes are merged in the order of their digests, first those whose digests begin alike, each
    such part in one task, then the parts of a host.
    """
    tasks = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = seen.mapInArrow(_kinds(), "host string, kind string, pages long").groupBy("host", "kind").agg(F.sum("pages").alias("pages"))
    by_host = kinds.where(F.col("pages") >= LEAST).groupBy("host").agg(F.collect_list("kind").alias("kinds"))
    names = staged(by_host.mapInArrow(_names(), "host string, names binary"), "names")
    rows = seen.join(small(names, _bytes(names)), "host").select("host", "record", "names")
    shapes = rows.mapInArrow(_shapes(), "host string, at string, shape string")
    for part in (F.substring("at", 1, PART), F.lit("")):
        shapes = shapes.select("host", part.alias("part"), "at", "shape").repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "at")
        shapes = shapes.mapInArrow(_merge(), "host string, at string, shape string")
    return shapes.select("host", F.col("shape").alias("template"))


class Loaded:
    """Templates by their packed text, a bounded number of them."""

    def __init__(self) -> None:
        self.kept: dict[bytes, Slot] = {}

    def get(self, packed: bytes) -> Slot:
        if packed not in self.kept:
            if len(self.kept) > 1000:
                self.kept.clear()
            self.kept[packed] = load(*json.loads(_unpack(packed)))
        return self.kept[packed]


def _packed():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_pack(json.dumps([x])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["host", "template"])

    return run


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, counts, held = Loaded(), {}, 0

        def out() -> pa.RecordBatch:
            rows = [(h, *at, *row) for h, some in counts.items() for at, row in some.items()]
            kinds = [pa.string(), pa.int32(), pa.string()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "slot", "text", "pages", "chars", "links", "titled"])

        for batch in batches:
            for h, made, template in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                some = counts.setdefault(h, {})
                held -= len(some)
                count_record(made, loaded.get(template), some)
                held += len(some)
                if held > MOST_COUNTS:
                    yield out()
                    counts, held = {}, 0
        yield out()

    return run


def _judged():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, made = [], []
            for h, template, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                whole = json.loads(_unpack(template))[0]
                done = judge(whole, {(r["slot"], r["text"]): [r["pages"], r["chars"], r["links"], r["titled"]] for r in rows})
                if done:
                    hosts.append(h)
                    made.append(_pack(json.dumps([whole, *done])))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.binary())], ["host", "wrapper"])

    return run


def _bytes(made: DataFrame) -> int:
    """What a small table of templates would count as, in rows of four columns."""
    size = made.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(F.length(c) for c in made.columns)).alias("bytes")).first()
    return size.n + (size.bytes or 0) // 64


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (template, what its positions do, constant texts; packed) of the hosts that have enough to judge by (pages: host, html)."""
    seen = staged(records(pages), "records")
    made = staged(templates(seen).mapInArrow(_packed(), "host string, template binary"), "templates")
    rows = seen.join(small(made, _bytes(made)), "host").select("host", "record", "template")
    counts = rows.mapInArrow(_count(), "host string, slot int, text string, pages long, chars long, links long, titled long")
    total = counts.groupBy("host", "slot", "text").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links", "titled")])
    total = staged(total.where((F.col("text") == "") | (F.col("pages") >= LEAST)), "counts")
    places = total.where(F.col("text") == "")
    every = places.select("host", "slot", F.col("pages").alias("every"))
    texts = total.where(F.col("text") != "").join(small(every, every.count()), ["host", "slot"]).where(F.col("pages") >= SHARE * F.col("every")).drop("every")
    # As many rows of a host as its template has positions, and for each the few texts that may be constant.
    by_host = places.unionByName(texts).groupBy("host").agg(F.collect_list(F.struct("slot", "text", "pages", "chars", "links", "titled")).alias("counts"))
    judged = by_host.join(made, "host").select("host", "template", "counts")
    return judged.mapInArrow(_judged(), "host string, wrapper binary")


def _extract():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Loaded()
        for batch in batches:
            out = [[], [], [], []]
            for page, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for column, x in zip(out, extract(page, loaded.get(packed) if packed else None), strict=True):
                    column.append(x)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["page_id", "url", "text", "rule", "cut_aligned", "cut_marked"])

    return run


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, rule, cut_aligned, cut_marked."""
    ship(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(host(url).alias("host"), url.alias("url"), F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    with scratch() as keep:
        made = keep(staged(wrappers(rows), "wrappers"))
    rows = rows.join(small(made, _bytes(made)), "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select(F.col("id").alias("page_id"), "url", "html", "wrapper").mapInArrow(_extract(), f"page_id {kind}, url string, text string, rule string, cut_aligned long, cut_marked long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "rule", "cut_aligned", "cut_marked")
