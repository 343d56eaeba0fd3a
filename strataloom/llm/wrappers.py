"""Main text of web pages by wrapper induction.

Pages of one host share templates. Every page is parsed once into a skeleton (its tree of block elements)
and its blocks of text. For the commonest structures of a host one page each becomes a reference; every
page is aligned with the reference of its structure, or with the one that fits best, by simple tree
matching. What all pages of the host have at a node of the reference makes the wrapper:

* a node whose text is the same on most pages is template;
* the other nodes are slots. From the root, the wrapper goes down to the child that holds most of the
  slots' text outside links, as long as one does: the content region. Menus, notices, adverts and footers
  lie outside it, whatever they are called and however they vary. Varying headings passed on the way down
  belong to the region.

Content is what lies in the region and is no template. Tag and class names decide only inside the region
(forms, reader comments and the like) and on pages that no wrapper fits: those of hosts of fewer than
``LEAST_PAGES`` different pages, as nothing can be induced from them, and those without the region.
"""

from __future__ import annotations

import html as entities
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, maybe_broadcast, text_chunks

#: A host's commonest structures, as many as this, get a reference page each that serves all its pages; every other
#: structure that enough pages have gets one for its own pages.
REFERENCES = 4
BROADCAST_BYTES = 16 << 20
#: A node is template if at least these many pages have it, with one text in this share of them.
LEAST_PAGES, CONSTANT_SHARE = 4, 0.6
#: The region goes down to a child that holds this share of its parent's varying text, if no sibling has this much.
DOMINANT, BESIDE = 0.5, 0.1
#: Repeated items are a thread if the last comes on at most this share of the pages of the first, or if an item begins
#: with a text of at most so many characters, such as a name.
FADING, NAME = 0.7, 30
#: Cells of one alignment table at a time; longer child lists are halved first, which loses no pair.
CELLS = 1 << 20

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are a piece of a text, and never by themselves the region.
PIECES = HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "summary", "tr", "td", "th", "tbody", "thead", "tfoot", "figure", "address"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas"}
DROP = RAW | {"nav", "footer", "aside", "form", "button", "select", "option", "head", "menu", "dialog", "fieldset", "label"}
BLOCKS = {"address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", *DROP}
#: Elements that a new one of the set closes, up to the nearest of the bounds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "nav", "footer", "aside", "header", "form", "blockquote"}
P_CLOSERS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ROLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|masthead|cookies?|consent|notice|newsletter|subscri\w*|share|social|related|recommend\w*|comments?|replies|reply|respond|disqus|login|search|pagination|pager|toolbar|popup|modal|widget|legal|copyright)(?:$|[\s_-])", re.I)
ROLES_ATTR = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TEXT_ONLY = {"script", "style", "title", "textarea"}
_TAG = re.compile(r"</?[a-zA-Z]")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "mark", "children", "text", "index", "drop", "order", "role")

    def __init__(self, tag: str, mark: str = "", drop: bool = False):
        self.tag, self.mark, self.drop = tag, mark, drop
        self.children: list[Node] = []
        self.text, self.index, self.order = "", -1, -1
        self.role = False  # a word of its class or id is of a region that is no article

    @property
    def label(self) -> tuple[str, str]:
        return self.tag, self.mark


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def parse(page: str) -> Node:
    """A tolerant DOM: element nodes, and "#text" nodes with decoded text. Unclosed and stray tags are
    mended as browsers do in the common cases."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)

    def put(text: str) -> None:
        if text:
            t = Node("#text")
            t.text = entities.unescape(text)
            stack[-1].children.append(t)

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "article", "body") and tag in ("p", "b", "i", "em", "strong", "a", "span"):
                    break
            continue
        if tag in P_CLOSERS or tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES.get(tag, ()) or (tag in P_CLOSERS and stack[k].tag == "p"):
                    del stack[k:]
                    break
                if stack[k].tag in BOUNDS:
                    break
        attrs = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        mark = attrs.get("class", "") + ("#" + attrs["id"] if attrs.get("id") else "")
        drop = tag in DROP or attrs.get("role", "").lower() in ROLES_ATTR or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        node = Node(tag, mark, drop)
        if not drop and mark and tag not in ("html", "body", "article", "main"):
            node.role = bool(ROLE.search(attrs.get("class", "")) or ROLE.search(attrs.get("id", "")))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and (tag not in RAW or tag == "svg"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in TEXT_ONLY:  # never closed: its own text goes, what follows the next tag stays
                after = _TAG.search(page, at)
                at = after.start() if after else n
            continue
        stack.append(node)
    _mend(root)
    return root


def _mend(root: Node) -> None:
    """A header inside an article is its headline; one elsewhere is the page's."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.tag == "header" and not inside:
            node.drop = True
        inside = inside or node.tag in ("article", "main")
        todo += [(c, inside) for c in node.children]
    _roles(root)


def _roles(root: Node) -> None:
    """Drops the regions that their class or id names, but none that holds all articles (or else all main
    elements) of the page, or on a page without such elements more than half of the text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.drop:
            order.append(node)
            todo += node.children
    held = {}
    for node in reversed(order):  # children before parents
        parts = [held[id(c)] for c in node.children if id(c) in held]
        own = (node.tag == "article", node.tag == "main", len(node.text.strip()))
        held[id(node)] = tuple(own[k] + sum(x[k] for x in parts) for k in range(3))
    every = held.get(id(root), (0, 0, 0))
    kind = next((k for k in (0, 1) if every[k]), 2)
    for node in order:
        if node.role:
            here = held[id(node)][kind]
            node.drop = 2 * here <= every[2] if kind == 2 else here < every[kind]


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, share of it in links by hundredths) of each run of text between block
    boundaries, in page order."""
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked = [0, 0]
    owner: list[Node] = [root]

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            out.append((owner[0], text, 100 * linked[1] // max(linked[0], 1)))
        held.clear()
        linked[:] = [0, 0]

    todo: list[tuple[str, Node, Node, bool]] = [("in", root, root, False)]
    while todo:
        what, node, block, link = todo.pop()
        if what == "end":
            flush()
            continue
        if node.tag == "#text":
            if not held:
                owner[0] = block
            held.append(node.text)
            n = len(node.text.strip())
            linked[0] += n
            linked[1] += n if link else 0
            continue
        if node.tag in RAW:
            if node.tag in BLOCKS and node.tag != "title":
                held.append(" ")
            continue
        if node.tag in BLOCKS:
            flush()
            todo.append(("end", node, block, link))
            block = node if node.tag != "br" else block
        link = link or node.tag == "a"
        todo += [("in", c, block, link) for c in reversed(node.children)]
    flush()
    return out


def elements(root: Node) -> list[Node]:
    """Element nodes in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if c.tag != "#text"]
    return out


def skeleton(root: Node) -> str:
    """The tree of block elements, a line each in page order: depth, tag, class and id with digits alike.
    Inline elements belong to their text, unless they hold blocks. Numbers the elements that it has."""
    nodes = elements(root)
    parent = {id(c): x for x in nodes for c in x.children}
    held = set()
    for x in reversed(nodes):
        if id(x) in held or x is root or (x.tag in BLOCKS and x.tag not in RAW and x.tag not in ("br", "head")):
            held.add(id(x))
            if x is not root:
                held.add(id(parent[id(x)]))
    lines, depth = [], {}
    for x in nodes:
        if id(x) in held:
            d = depth[id(x)] = 0 if x is root else depth[id(parent[id(x)])] + 1
            x.index = len(lines)
            lines.append(f"{d} {x.tag} {_DIGITS.sub('0', ' '.join(x.mark.split()))}")
    return "\n".join(lines)


def read_page(page: str) -> tuple[str, list[tuple[str, int, int, bool, bool]]]:
    """Skeleton of a page and its blocks: (text, element, link share, in a region that by its names is no
    article, content if names alone decide)."""
    root = parse(page)
    shape = skeleton(root)
    parent = {id(c): x for x in elements(root) for c in x.children}
    main = {x.tag for x in elements(root) if x.tag in ("article", "main") and not x.drop}
    main = {"article"} & main or main
    out = []
    for owner, text, link in blocks(root):
        veto, within, x = False, not main, owner
        while x is not None:
            veto = veto or x.drop
            within = within or x.tag in main
            x = parent.get(id(x))
        out.append((text, owner.index, link, veto, within and not veto))
    return shape, out


# --------------------------------------------------------------------------- tree matching


class Shapes:
    """Interned subtrees: trees of equal shape have one number, so a pair of shapes is matched once."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.label: list[str] = []
        self.parts: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, label: str, parts: tuple[int, ...]) -> int:
        key = (label, parts)
        if key not in self.number:
            self.number[key] = len(self.label)
            self.label.append(label)
            self.parts.append(parts)
            self.size.append(1 + sum(self.size[p] for p in parts))
        return self.number[key]

    def quick(self, s: int, t: int) -> int | None:
        """The number of pairs of the best match of two shapes, where it needs no table or is known."""
        if s == t:
            return self.size[s]
        if self.label[s] != self.label[t]:
            return 0
        if not self.parts[s] or not self.parts[t]:
            return 1
        return self.known.get((s, t))

    def weight(self, s: int, t: int) -> int:
        """The number of pairs of the best match of two shapes. No recursion: trees may be deep."""
        todo = [(s, t)]
        while todo:
            x, y = todo[-1]
            if self.quick(x, y) is not None:
                todo.pop()
                continue
            lo, hi = trimmed(self.parts[x], self.parts[y])
            a, b = self.parts[x][lo : len(self.parts[x]) - hi], self.parts[y][lo : len(self.parts[y]) - hi]
            missing = [(u, v) for u in set(a) for v in set(b) if self.quick(u, v) is None]
            if missing:
                todo += missing
                continue
            gain = 1 + sum(self.size[p] for p in (*self.parts[x][:lo], *self.parts[x][len(self.parts[x]) - hi :]))
            if a and b:
                gain += int(self.last_row(a, self.table(a, b))[-1])
            self.known[x, y] = gain
            todo.pop()
        return self.quick(s, t)

    def table(self, a, b) -> dict[int, np.ndarray]:
        """For each shape of ``a``, its weights against the list ``b``."""
        kinds, at = np.unique(np.asarray(b), return_inverse=True)
        return {u: np.asarray([self.weight(u, int(v)) for v in kinds], np.int64)[at] for u in set(a)}

    @staticmethod
    def last_row(a, w: dict[int, np.ndarray]) -> np.ndarray:
        """Best totals of matching all of ``a`` with the first 0, 1, .. of the other list, in order."""
        row = np.zeros(len(next(iter(w.values()))) + 1, np.int64)
        for u in a:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w[u]))
        return row

    def pairs(self, a, b) -> list[tuple[int, int]]:
        """Positions matched in two lists of shapes, of the largest total in order."""
        out, todo = [], [(0, len(a), 0, len(b))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            lo, hi = trimmed(a[i0:i1], b[j0:j1])
            out += [(i0 + k, j0 + k) for k in range(lo)] + [(i1 - k, j1 - k) for k in range(1, hi + 1)]
            i0, i1, j0, j1 = i0 + lo, i1 - hi, j0 + lo, j1 - hi
            if i0 == i1 or j0 == j1:
                continue
            x, y = a[i0:i1], b[j0:j1]
            w = self.table(x, y)
            if len(x) * len(y) > CELLS and len(x) > 1:
                half = len(x) // 2
                front = self.last_row(x[:half], w)
                back = self.last_row(x[:half - 1 : -1], {u: r[::-1] for u, r in w.items()})[::-1]
                cut = j0 + int(np.argmax(front + back))
                todo += [(i0, i0 + half, j0, cut), (i0 + half, i1, cut, j1)]
                continue
            m = np.zeros((len(x) + 1, len(y) + 1), np.int64)
            for i, u in enumerate(x):
                m[i + 1, 1:] = np.maximum.accumulate(np.maximum(m[i, 1:], m[i, :-1] + w[u]))
            i, j = len(x), len(y)
            while i and j:
                if m[i, j] == m[i - 1, j]:
                    i -= 1
                elif m[i, j] == m[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i0 + i, j0 + j))
        return out


def trimmed(a, b) -> tuple[int, int]:
    """Lengths of the equal start and end of two lists of shapes. Matching equal shapes with each other is
    always among the best: neither can gain more elsewhere, and in order only one of them could."""
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return lo, hi


class Tree:
    """A skeleton read again: parents, children and shapes by element."""

    def __init__(self, text: str, shapes: Shapes):
        self.tag, self.parent, self.children, labels, path = [], [], [], [], []
        for i, line in enumerate(text.split("\n")):
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            self.tag.append(label.split(" ", 1)[0])
            labels.append(label)
            self.parent.append(path[-1] if path else -1)
            self.children.append([])
            if path:
                self.children[path[-1]].append(i)
            path.append(i)
        self.shape = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            self.shape[i] = shapes.of(labels[i], tuple(self.shape[c] for c in self.children[i]))


def match(a: Tree, b: Tree, shapes: Shapes) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping alignment of two trees with equal labels from the root
    down, as element of ``a`` -> element of ``b``."""
    out, todo = {}, [(0, 0)] if shapes.quick(a.shape[0], b.shape[0]) != 0 else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        xs, ys = a.children[x], b.children[y]
        found = shapes.pairs(tuple(a.shape[c] for c in xs), tuple(b.shape[c] for c in ys))
        todo += [(xs[i], ys[j]) for i, j in found]
    return out


class Aligner:
    """Aligns pages with the references of their host; trees of references are kept between pages."""

    def __init__(self):
        self.shapes, self.trees = Shapes(), OrderedDict()

    def tree(self, text: str) -> Tree:
        if text not in self.trees:
            self.trees[text] = Tree(text, self.shapes)
            while len(self.trees) > 256:
                self.trees.popitem(last=False)
        self.trees.move_to_end(text)
        return self.trees[text]

    def align(self, page: str, key: int, references: list[dict]) -> tuple[int, list[int]]:
        """The reference that serves a page, by its number, and for each element of the page the element of
        the reference that it, or else its nearest aligned ancestor, has, as 2 n for its own and 2 n + 1 for
        an ancestor's. (-1, []) without references."""
        if len(self.shapes.label) > 200_000 or len(self.shapes.known) > 1_000_000:
            self.__init__()
        tree, best = Tree(page, self.shapes), None
        own = [r for r in references if r["key"] == key] or references
        for r in own:
            other = self.tree(r["skeleton"])
            found = match(tree, other, self.shapes)
            like = len(found) / (len(tree.tag) + len(other.tag))
            if best is None or like > best[0]:
                best = (like, r["k"], found)
        if best is None:
            return -1, []
        at: list[int] = []
        for i, p in enumerate(tree.parent):
            at.append(2 * best[2][i] if i in best[2] else at[p] | 1 if p >= 0 else -1)
        return best[1], at


# --------------------------------------------------------------------------- wrappers


def induce(skeleton: str, slots: list[dict]) -> tuple[list[int], list[dict]]:
    """The wrapper of one reference from its slots' statistics (at, pages, top, h, mass): the elements whose
    subtrees are the content region, and the template entries (at, h)."""
    tree = Tree(skeleton, Shapes())
    fixed, mass, varying = [], [0.0] * len(tree.tag), set()
    for s in slots:
        node = s["at"] >> 1
        if not s["at"] & 1 and s["pages"] >= LEAST_PAGES and s["top"] >= CONSTANT_SHARE * s["pages"]:
            if tree.tag[node] not in HEADINGS:  # a heading that texts share still is theirs where it is in the region
                fixed.append({"at": s["at"], "h": s["h"]})
            continue
        mass[node] += s["mass"]
        varying.add(node)
    total = list(mass)
    for i in range(len(total) - 1, 0, -1):
        total[tree.parent[i]] += total[i]
    if not total[0]:
        return [], fixed
    seen, first = [0] * len(tree.tag), [0.0] * len(tree.tag)  # most pages of a slot of an element; characters of its first
    for s in slots:
        seen[s["at"] >> 1] = max(seen[s["at"] >> 1], s["pages"])
        first[s["at"] >> 1] = max(first[s["at"] >> 1], s["mass"] / max(s["pages"], 1))
    for i in range(len(seen) - 1, 0, -1):
        up = tree.parent[i]
        seen[up] = max(seen[up], seen[i])
        first[up] = first[i] or first[up]  # from the last child to the first
    region, beside, here = [0], [], 0
    while True:
        kids = [c for c in tree.children[here] if tree.tag[c] not in PIECES and total[c] > 0]
        threads = [c for c in kids if thread(tree, c, seen, first)]
        kids = [c for c in kids if c not in threads] or kids
        held = sum(total[c] for c in kids)
        pieces = total[here] - held - sum(total[c] for c in threads if c not in kids)
        top = max(kids, key=lambda c: total[c], default=None)
        if top is None or total[top] < DOMINANT * (held + pieces):
            if threads and kids != threads:  # all but the threads
                region = [c for c in tree.children[here] if c not in threads]
            break
        others = [c for c in kids if c != top and total[c] >= BESIDE * (held + pieces)]
        if others:
            region = sorted([top, *others])
            beside += [c for c in tree.children[here] if c < region[-1] and tree.tag[c] in HEADINGS and c in varying]
            break
        beside += [c for c in tree.children[here] if c < top and tree.tag[c] in HEADINGS and c in varying]
        here = top
        region = [here]
    return region + beside, fixed


def thread(tree: Tree, node: int, seen: list[int], first: list[float]) -> bool:
    """Whether an element is a list of like items without headings, as reader comments are: most of its children that
    hold others have one shape, and either later ones come on fewer pages or each begins with a name."""
    items = [c for c in tree.children[node] if tree.children[c]]
    by = defaultdict(list)
    for c in items:
        by[tree.shape[c]].append(c)
    like = max(by.values(), key=len, default=[])
    if len(like) < 2 or 5 * len(like) < 3 * len(tree.children[node]):
        return False
    todo = list(like)
    while todo:
        c = todo.pop()
        if tree.tag[c] in HEADINGS:
            return False
        todo += tree.children[c]
    fades = min(seen[c] for c in like) <= FADING * max(seen[c] for c in like)
    return fades or all(len(tree.children[c]) > 1 and 0 < first[c] <= NAME for c in like)


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _structure(skeleton: str) -> int:
    """A key of the kind of a page: the labels of its upper levels, repetitions aside."""
    seen = dict.fromkeys(line for line in skeleton.split("\n") if int(line.split(" ", 1)[0]) <= 4 and line.split(" ", 2)[1] not in PIECES)
    return _text_hash("\n".join(seen))


REFERENCE = "array<struct<k:int,key:bigint,skeleton:string>>"


def _read(pages: DataFrame) -> DataFrame:
    """Materialised pages: page_id, url, host, skeleton, key, same (equal for pages of equal blocks), blocks."""
    # parse_url fails on malformed addresses; a pattern does not
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))
    p = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    block = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("link", pa.int32()), ("veto", pa.bool_()), ("ok", pa.bool_())]))
    names = ("text", "at", "link", "veto", "ok")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 3):
            skeletons, rows = zip(*(read_page(x) for x in b.column(3).to_pylist()), strict=True)
            same = [_text_hash("\0".join(x[0] for x in r)) for r in rows]
            cols = [*b.columns[:3], pa.array(skeletons, pa.string()), pa.array([_structure(x) for x in skeletons], pa.int64()), pa.array(same, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in rows], block)], ["page_id", "url", "host", "skeleton", "key", "same", "blocks"])

    schema = "page_id long, url string, host string, skeleton string, key long, same long, blocks array<struct<text:string,at:int,link:int,veto:boolean,ok:boolean>>"
    return materialize(p.mapInArrow(run, schema), "page-blocks")


def _references(read: DataFrame) -> DataFrame:
    """(host, k, key, skeleton): the references of each host, one page of each of its structures that at least
    LEAST_PAGES pages have or that are among its REFERENCES commonest; k is the rank."""
    kinds = read.where(F.col("host") != "").groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("same", "skeleton").alias("h"), "skeleton"))["skeleton"].alias("skeleton"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("n").desc(), "key"))
    kinds = kinds.withColumn("k", rank.cast("int")).where((F.col("k") <= REFERENCES) | (F.col("n") >= LEAST_PAGES))
    return kinds.select("host", "k", "key", "skeleton")


def _with_references(pages: DataFrame, refs: DataFrame, weight: int, how: str) -> DataFrame:
    """``pages`` (host, key, ...) with ``refs``: their host's common references and that of their own structure."""
    r = F.struct(*[c for c in refs.columns if c != "host"])
    common = refs.where(F.col("k") <= REFERENCES).groupBy(F.col("host").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("k", r.alias("r")))).alias("_c"))
    own = refs.where(F.col("k") > REFERENCES).select(F.col("host").alias("_oh"), F.col("key").alias("_ok"), F.array(r).alias("_own"))
    d = pages.join(maybe_broadcast(common, weight, BROADCAST_BYTES), F.col("host") == F.col("_h"), how)
    d = d.join(maybe_broadcast(own, weight, BROADCAST_BYTES), (F.col("host") == F.col("_oh")) & (F.col("key") == F.col("_ok")), "left")
    every = F.when(F.col("_own").isNull(), F.transform("_c", lambda x: x["r"])).otherwise(F.concat(F.transform("_c", lambda x: x["r"]), "_own"))
    return d.withColumn("refs", every).drop("_h", "_c", "_oh", "_ok", "_own")


def _slots(read: DataFrame, refs: DataFrame, weight: int) -> DataFrame:
    """(host, k, at, pages, top, h, mass) of each reference's elements over all pages that it serves: how many
    texts are there, how often the commonest comes, which it is, and the characters outside links and outside
    regions that by their names are no article. Pages of equal blocks count once, so copies of one article
    don't pass for a template. Only hashes and counts travel."""
    d = _with_references(read.where(F.col("host") != ""), refs, weight, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                out = defaultdict(list)
                for host, page, key, same, found, refs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k, where = aligner.align(page, key, refs)
                    for x in found:
                        for name, v in zip(("host", "k", "same", "at", "h", "mass"), (host, k, same, where[x["at"]], x["h"], x["mass"]), strict=True):
                            out[name].append(v)
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                names = ["host", "k", "same", "at", "h", "mass"]
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names)

    slim = F.transform("blocks", lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["text"]).alias("h"), F.when(x["veto"], 0).otherwise(F.char_length(x["text"]) * (100 - x["link"]) / 100).cast("int").alias("mass")))
    flat = d.select("host", "skeleton", "key", "same", slim.alias("found"), "refs").mapInArrow(run, "host string, k int, same long, at int, h long, mass int")
    texts = flat.groupBy("host", "k", "at", "h", "same").agg(F.max("mass").alias("mass")).groupBy("host", "k", "at", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))
    return texts.groupBy("host", "k", "at").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "h")).alias("best"), F.sum("mass").alias("mass")).select("host", "k", "at", "pages", F.col("best.n").alias("top"), F.col("best.h").alias("h"), F.col("mass").cast("double").alias("mass"))


def _wrappers(refs: DataFrame, slots: DataFrame, served: DataFrame) -> DataFrame:
    """The references (host, k, key, skeleton) with their wrappers, region null where too few pages are served.
    A group has at most two entries for each element of a reference."""
    entry = F.struct("at", "pages", "top", "h", "mass")
    by = slots.groupBy("host", "k").agg(F.collect_list(entry).alias("slots"))
    r = refs.join(by, ["host", "k"], "left").join(served, ["host"], "left")
    cols = ["host", "k", "key", "skeleton", "pages", "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [induce(s, x or []) if (n or 0) >= LEAST_PAGES else (None, []) for s, n, x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            region, fixed = (list(x) for x in zip(*got, strict=True)) if got else ([], [])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(region, pa.list_(pa.int32())), pa.array(fixed, kind)], ["host", "k", "key", "skeleton", "region", "fixed"])

    return r.select(cols).mapInArrow(run, "host string, k int, key long, skeleton string, region array<int>, fixed array<struct<at:int,h:bigint>>")


def content(aligner: Aligner, page: str, key: int, found: list[dict], refs: list[dict] | None) -> list[bool]:
    """Which blocks of a page are content by the wrapper of its host, or else by names."""
    refs = refs or []
    k, where = aligner.align(page, key, refs)
    ref = next((r for r in refs if r["k"] == k), None)
    if ref is None or not ref["region"]:
        return [x["ok"] for x in found]
    tree, region = aligner.tree(ref["skeleton"]), set(ref["region"])
    if not any(w >= 0 and not w & 1 and w >> 1 in region for w in where):
        return [x["ok"] for x in found]
    fixed = {(x["at"], x["h"]) for x in ref["fixed"]}
    out = []
    for x in found:
        w = where[x["at"]]
        node = w >> 1
        while node >= 0 and node not in region:
            node = tree.parent[node]
        out.append(node >= 0 and not x["veto"] and (w, x["h"]) not in fixed)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null html or a page without content: text ''. A page without a host, or of a host of fewer than
    LEAST_PAGES different pages, is judged by the names of its elements. Repeated rows each get their text.
    Pages and child lists of any length and depth are parsed and aligned whole. Empty input: no rows. Other
    columns are ignored.
    """
    read = _read(pages)
    refs = materialize(_references(read), "references")
    weight = refs.agg(F.sum(F.octet_length("skeleton"))).first()[0] or 0
    slots = materialize(_slots(read, refs, weight), "slots")
    # equal pages count once here too
    served = read.where(F.col("host") != "").select("host", "same").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    wrappers = materialize(_wrappers(refs, slots, served), "wrappers")
    discard(refs, slots)
    weight = wrappers.agg(F.sum(F.octet_length("skeleton") + 12 * F.size("fixed"))).first()[0] or 0
    d = _with_references(read, wrappers, weight, "left")
    d = d.withColumn("blocks", F.transform("blocks", lambda x: F.struct(x["text"].alias("text"), x["at"].alias("at"), F.xxhash64(x["text"]).alias("h"), x["veto"].alias("veto"), x["ok"].alias("ok"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                b = batch.slice(at, 128)
                texts = []
                for page, key, found, own in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    keep = content(aligner, page, key, found, own)
                    texts.append("\n\n".join(x["text"] for x, ok in zip(found, keep, strict=True) if ok))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = d.select("page_id", "url", "skeleton", "key", "blocks", "refs").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
