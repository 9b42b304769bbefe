"""A small DOM for whole pages: tolerant parsing, tree matching, and the text of its blocks."""

from __future__ import annotations

import html
import math
import re

import xxhash

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split()
)
#: A start tag of the key closes an open element of the value's tags, up to the nearest of :data:`SCOPES`.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl select button div article section main aside nav header footer form td th".split())
#: Tags that never hold the main text; tags and names of classes, ids and roles that mark such parts; words that such names
#: are put together with; and names of what readers write.
NEVER = frozenset("nav script style noscript iframe button select textarea template head menu dialog svg math title xmp input".split())
BESIDE = frozenset("header footer aside form".split())
MARKS = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pager|pagination|sidebar|side|rail|widget|related|recommend\w*|trending|share|sharing|social|"
    r"header|masthead|footer|foot|copyright|legal|disclaimer|comments?|disqus|respond|replies|reply|form|search|contentinfo|complementary|toolbar|skip\w*"
)
LAYOUT = frozenset(
    "a area article bar bars block body bottom box btn button buttons card col column container content data desktop div fixed global group head home id in inner item items js left link links "
    "list main mobile module more new outer page pane panel post primary region right row secondary section site slot static sticky strip sub tag tags text top ui unit up user view wrap wrapper zone".split()
)
READERS = re.compile("comments?|disqus|respond|replies|reply")


class Node:
    __slots__ = ("tag", "mark", "children", "up")

    def __init__(self, tag: str, mark: str = "", up: Node | None = None):
        self.tag, self.mark, self.children, self.up = tag, mark, [], up

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.mark}"

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _mark(attributes: str) -> str:
    """The names in class, id and role, without digits, in a fixed order."""
    if "=" not in attributes:
        return ""
    found = [v.strip("\"'").lower() for _, v in NAMED.findall(attributes)]
    return " ".join(sorted({re.sub(r"\d+", "", w) for v in found for w in v.split()}))


def parse(source: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are taken as browsers mostly do."""
    root = Node("#")
    at, now, end = 0, root, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if not m:
            now.children.append(source[at:])
            break
        if m.start() > at:
            now.children.append(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            x = now
            while x is not root and x.tag != tag:
                x = x.up
            if x is not root:
                now = x.up
            continue
        shut = {"p"} if tag in BLOCKS else set()
        shut = shut | CLOSES.get(tag, set())
        x, outer = now, None
        while shut and x is not root and (x.tag not in SCOPES or x.tag in shut):
            if x.tag in shut:
                outer = x
            x = x.up
        if outer is not None:
            now = outer.up
        attributes = m[3] or m[6] or ""
        node = Node(tag, _mark(attributes), now)
        now.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>?", re.I).search(source, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.endswith("/"):
            now = node
    return root


def apart(node: Node) -> int:
    """How surely the node's tag or names set it apart from the main text: 3 whatever it holds, 2 by a name or tag that says
    nothing else, 1 where such a word stands among others in a name, 0 not at all."""
    if node.tag in NEVER:
        return 3
    level = 2 if node.tag in BESIDE else 0
    for name in node.mark.split() if node.tag not in ("body", "html", "article", "main") else ():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        told = [w for w in (*words, "".join(words)) if MARKS.fullmatch(w)]
        if told:
            plain = all(w in LAYOUT or MARKS.fullmatch(w) for w in words) or MARKS.fullmatch("".join(words))
            level = max(level, (3 if any(READERS.fullmatch(w) for w in told) else 2) if plain else 1)
    return level


def blocks(node: Node, drop=lambda n: False) -> list[str]:
    """The text of the node's blocks, without dropped parts: references decoded, white space as one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x is not node and drop(x):
            if x.tag in BLOCKS:
                flush()
        else:
            edge = x.tag in BLOCKS
            if edge:
                flush()
                stack.append(None)
            elif x.tag in ("br", "td", "th", "img"):
                run.append(" ")
            stack.extend(reversed(x.children))
    flush()
    return out


def preorder(root) -> list:
    """All nodes of a tree, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.nodes()))
    return out


class Facts:
    """Of each node of a page: a hash of the texts below it in order, their length, how much of it lies in links, whether
    a block is below it, and a hash of its labels' tree."""

    def __init__(self, root: Node):
        self.hash: dict[int, int] = {}
        self.length: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        self.holds: dict[int, bool] = {}
        self.form: dict[int, int] = {}
        for x in reversed(preorder(root)):
            parts, length, linked, holds = [], 0, 0, False
            for c in x.children:
                if isinstance(c, str):
                    text = " ".join(html.unescape(c).split())
                    if text:
                        parts.append(xxhash.xxh64_intdigest(text))
                        length += len(text)
                else:
                    k = id(c)
                    if self.length[k]:
                        parts.append(self.hash[k])
                        length += self.length[k]
                        linked += self.linked[k]
                    holds = holds or self.holds[k] or c.tag in BLOCKS
            k = id(x)
            self.form[k] = xxhash.xxh64_intdigest(repr((x.label, [self.form[id(c)] for c in x.nodes()])))
            self.hash[k] = parts[0] if len(parts) == 1 else xxhash.xxh64_intdigest(repr(parts))
            self.length[k], self.linked[k], self.holds[k] = length, length if x.tag == "a" else linked, holds

    def prose(self, node: Node) -> int:
        """Characters of the node's text outside links."""
        return self.length[id(node)] - self.linked[id(node)]


class Outline:
    """A node of a page's outline: a block, or a run of paragraphs, items or headings with the same label."""

    __slots__ = ("label", "kids", "members")

    def __init__(self, label: str, members: list[Node] | None = None):
        self.label, self.kids, self.members = label, [], members or []

    def nodes(self) -> list[Outline]:
        return self.kids


#: Blocks of text; neighbours of one label are a list whose length may vary, and their insides are not outlined.
TEXTUAL = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 pre blockquote figcaption option".split())


def outline(root: Node, facts: Facts) -> Outline:
    """The blocks of a page, without what is inline."""
    top = Outline(root.label, [root])
    stack = [top]
    while stack:
        x = stack.pop()
        for c in x.members[0].nodes():
            if c.tag not in BLOCKS and not facts.holds[id(c)]:
                continue
            if c.tag in TEXTUAL and x.kids and x.kids[-1].label == c.label:
                x.kids[-1].members.append(c)
                continue
            x.kids.append(Outline(c.label, [c]))
            if c.tag not in TEXTUAL:
                stack.append(x.kids[-1])
    return top


def _kinds(root, known: dict, count: dict[int, int]) -> dict[int, int]:
    """A number for each node, equal where whole trees of labels are; ``count`` has the nodes of a tree of that kind."""
    out: dict[int, int] = {}
    for x in reversed(preorder(root)):
        own = [out[id(c)] for c in x.nodes()]
        k = out[id(x)] = known.setdefault((x.label, *own), len(known))
        if k not in count:
            count[k] = 1 + sum(count[c] for c in own)
    return out


def align(a, b) -> tuple[int, list[tuple]]:
    """Simple tree matching of two trees with equal labels: the size of the largest order-keeping match of nodes under
    matched parents, and its pairs, the roots first.

    Trees of one kind match in full; other sizes are worked out from the leaves, for each pair of kinds once. Equal kinds
    at both ends of two sibling lists are paired at once. Of the table of the rest only some rows are kept, from which the
    way back is redone. Nothing recurses, however deep the trees.
    """
    known: dict = {}
    count: dict[int, int] = {}
    kinds = _kinds(a, known, count) | _kinds(b, known, count)
    sizes: dict[tuple[int, int], int] = {}

    def size(x, y) -> int:
        i, j = kinds[id(x)], kinds[id(y)]
        return 0 if x.label != y.label else count[i] if i == j else sizes[i, j]

    def ends(xs: list, ys: list) -> tuple[int, int]:
        """How many siblings of equal kinds lead both lists, and how many end them."""
        most = min(len(xs), len(ys))
        head = next((i for i in range(most) if kinds[id(xs[i])] != kinds[id(ys[i])]), most)
        most -= head
        tail = next((i for i in range(most) if kinds[id(xs[-1 - i])] != kinds[id(ys[-1 - i])]), most)
        return head, tail

    def row(x, ys: list, before: list[int]) -> list[int]:
        out = [0]
        for j, y in enumerate(ys, 1):
            own = size(x, y)
            out.append(max(before[j], out[-1], before[j - 1] + own if own else 0))
        return out

    def middle(x, y) -> tuple[list, list, int, int]:
        xs, ys = x.nodes(), y.nodes()
        head, tail = ends(xs, ys)
        return xs[head : len(xs) - tail], ys[head : len(ys) - tail], head, tail

    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = kinds[id(x)], kinds[id(y)]
        if key in sizes or key[0] == key[1]:
            stack.pop()
            continue
        xs, ys, head, tail = middle(x, y)
        ones, others = {kinds[id(c)]: c for c in xs}, {kinds[id(c)]: c for c in ys}
        todo = [(c, d) for i, c in ones.items() for j, d in others.items() if i != j and c.label == d.label and (i, j) not in sizes]
        if todo:
            stack.extend(todo)
            continue
        last = [0] * (len(ys) + 1)
        for c in xs:
            last = row(c, ys, last)
        same = x.nodes()[:head] + x.nodes()[len(x.nodes()) - tail :]
        sizes[key] = 1 + last[-1] + sum(count[kinds[id(c)]] for c in same)
        stack.pop()

    pairs: list[tuple] = []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        xs, ys, head, tail = middle(x, y)
        stack.extend(zip(x.nodes()[:head], y.nodes()[:head], strict=True))
        if tail:
            stack.extend(zip(x.nodes()[-tail:], y.nodes()[-tail:], strict=True))
        step = math.isqrt(len(xs)) + 1
        last = [0] * (len(ys) + 1)
        kept, rows, low = [last], [last], -1
        for i, c in enumerate(xs, 1):
            last = row(c, ys, last)
            if i % step == 0:
                kept.append(last)
        i, j = len(xs), len(ys)
        while i and j:
            if (i - 1) // step != low:
                low = (i - 1) // step
                rows = [kept[low]]
                for c in xs[low * step : i]:
                    rows.append(row(c, ys, rows[-1]))
            now, before, own = rows[i - low * step], rows[i - low * step - 1], size(xs[i - 1], ys[j - 1])
            if own and now[j] == before[j - 1] + own:
                stack.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif now[j] == before[j]:
                i -= 1
            else:
                j -= 1
    return len(pairs), pairs
