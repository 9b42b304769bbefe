"""Main text of pages by wrapper induction.

Pages of a host with the same upper tags are a group. A bounded sample of a group's different pages is aligned by simple
tree matching; what nearly all of them share is the skeleton, with lists of any length as one node. Every page of the
group is then aligned with the skeleton, and the texts of its nodes are counted over all different pages: a text that
most pages have at a node is template, whatever the node is called; nodes whose text varies are slots. The content is
where the varying text outside links has its mass: from the root the skeleton is descended to the node, or the nodes,
that hold it. Small blocks in it that every page has in one form are furniture, and slots of links are menus.

Tags such as footer or form, and the usual names of classes, only break ties: they keep a part out of the search, and out of
the text, unless it holds more than half of what there is; a name that has such a word among others ("ad-hoc-analysis") tells
of small parts only. Scripts, menus, controls and what readers write are left out however large they are. The wrapper, a
flat list as JSON, is joined to all pages of its host and aligned with each; its content slots give the text. Where a group
has one page only, or a page lacks the slots, tags and names alone decide; where they would leave no text, the page is
taken without them.

Defined cases: null and empty pages have an empty text; a null url belongs to the host ""; null ids stay null; repeated
rows give equal rows and count once; other columns are ignored, whatever their names; an empty table gives an empty
result. Texts are never cut, and pages may be as deep and as wide as they are.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, cut
from .bounded import BROADCAST_BYTES
from .dom import NEVER, TEXTUAL, Facts, Node, Outline, align, apart, blocks, outline, parse, preorder

#: Different pages of a group that its skeleton is induced from, and the share of pages that make a node part of the
#: skeleton and a text template.
SAMPLE, SHARED = 8, 0.75
#: Slots with a greater share of their text in links are menus.
LINKS = 0.5
#: The search descends to a part that holds all but the first share of the varying text, or half of it where only its
#: form varies; a piece of furniture holds at most the second, and all together the first.
MAJOR, MINOR = 0.15, 0.05
#: What a tag or name sets apart stays if it holds more than the first share of the text outside links; what a name only
#: hints at, if it holds more than the second.
MOST, HINTED = 0.5, 0.05
#: Levels of tags that pages of a group share.
LEVELS = 3
MAIN = ("article", "main")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


class Page:
    """A parsed page with its facts and outline."""

    def __init__(self, source: str):
        self.root = parse(source)
        self.facts = Facts(self.root)
        self.outline = outline(self.root, self.facts)

    def shape(self) -> str:
        """A hash of the tags of the upper levels, repeats as one."""
        level, out = [self.outline], []
        for _ in range(LEVELS):
            below = []
            for x in level:
                tags = [k.label.split(".", 1)[0] for k in x.kids]
                out.append([t for i, t in enumerate(tags) if not i or t != tags[i - 1]])
                below += x.kids
            level = below
        return xxhash.xxh64_hexdigest(repr(out))

    def matched(self, skeleton: Outline, places: dict[int, int]) -> dict[int, Outline]:
        """The outline's nodes by the number of the skeleton's node that they are aligned with."""
        return {places[id(a)]: b for a, b in align(skeleton, self.outline)[1]}


def induce(pages: list[Page]) -> list[list] | None:
    """The skeleton of at least two pages: [label, number of the parent] of each node, parents first."""
    if len(pages) < 2:
        return None
    first = sorted(pages, key=lambda p: len(preorder(p.outline)))[len(pages) // 2]
    times: Counter[int] = Counter()
    for other in pages:
        if other is not first:
            times.update(id(a) for a, _ in align(first.outline, other.outline)[1])
    most = math.ceil(SHARED * (len(pages) - 1))
    out, number = [], {}
    stack: list[tuple[Outline, int]] = [(first.outline, -1)]
    while stack:
        x, up = stack.pop()
        if up >= 0 and times[id(x)] < most:
            continue
        number[id(x)] = len(out)
        out.append([x.label, up])
        stack.extend((k, number[id(x)]) for k in reversed(x.kids))
    return out


def rooted(skeleton: list[list]) -> tuple[Outline, dict[int, int]]:
    """The skeleton as a tree, and the numbers of its nodes."""
    nodes = [Outline(label) for label, _ in skeleton]
    for n, (_, up) in zip(nodes, skeleton, strict=True):
        if up >= 0:
            nodes[up].kids.append(n)
    return nodes[0], {id(n): i for i, n in enumerate(nodes)}


def observe(page: Page, skeleton: Outline, places: dict[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(node, text, length, linked, form): what the page has at each node of the skeleton (text 0), and the texts that may
    be template, each under the nearest node that holds it (length of the text, linked -1)."""
    facts, at = page.facts, {id(x): i for i, x in page.matched(skeleton, places).items()}
    stack = [(page.outline, -1)]
    while stack:
        x, above = stack.pop()
        own, first = at.get(id(x), -1), id(x.members[0])
        lengths = [facts.length[id(m)] for m in x.members]
        if own >= 0 and any(lengths):
            yield own, 0, sum(lengths), sum(facts.linked[id(m)] for m in x.members), facts.form[first]
        under = above if x.members[0].tag in TEXTUAL or own < 0 else own
        if under >= 0:
            for text, length in {facts.hash[id(m)]: n for m, n in zip(x.members, lengths, strict=True) if n}.items():
                yield under, text, length, -1, 0
        stack.extend((k, own if own >= 0 else above) for k in x.kids)


def decide(skeleton: list[list], seen: pd.DataFrame) -> dict:
    """The wrapper: the skeleton, its content slots, the nodes left out in them, and template texts by node.

    ``seen`` has (node, pages, length, linked, form, texts): on how many different pages the node has text, the mean of its
    length and of what lies in links, the share of pages with its usual form, and the template texts with their lengths.
    """
    n = len(skeleton)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i, (_, up) in enumerate(skeleton):
        if up >= 0:
            kids[up].append(i)
    length, linked, form, gone = [0.0] * n, [0.0] * n, [0.0] * n, defaultdict(dict)
    for r in seen.itertuples():
        length[r.node], linked[r.node], form[r.node] = r.length, r.linked, r.form
        gone[r.node] = {int(t): float(c) for t, c in r.texts}
    tags = [label.split(".", 1)[0] for label, _ in skeleton]
    levels = [apart(Node(*label.split(".", 1))) if label[0] != "#" else 0 for label, _ in skeleton]

    listed = [sum(max(length[k] - linked[k], 0.0) for k in kids[i] if tags[k] in TEXTUAL) for i in range(n)]
    fixed_share = [min(sum(gone[i].values()) / listed[i], 1.0) if listed[i] else 0.0 for i in range(n)]

    def worth(out_of_search: list[bool]) -> list[float]:
        """Varying text of each node outside links, menus and the parts that are out of the search."""
        out = [0.0] * n
        for i in reversed(range(n)):
            below = sum(max(length[k] - linked[k], 0.0) for k in kids[i])
            rest = max(length[i] - linked[i] - below, 0.0)
            if tags[i] in TEXTUAL and skeleton[i][1] >= 0:
                rest *= 1 - fixed_share[skeleton[i][1]]
            menu = linked[i] > LINKS * length[i]
            out[i] = 0.0 if menu or out_of_search[i] else rest + sum(out[k] for k in kids[i])
            if any(c >= 0.9 * length[i] for c in gone[i].values()):
                out[i] = 0.0
        return out

    whole = worth([x == 3 for x in levels])
    value = worth([x == 3 or x == 2 and whole[i] <= MOST * whole[0] for i, x in enumerate(levels)])
    if value[0] <= 0:
        value = worth([False] * n)
    slots: list[int] = []
    heads: list[int] = []
    stack = [0]
    while stack:
        i = stack.pop()
        inner = [k for k in kids[i] if tags[k] not in TEXTUAL and value[k] > 0]
        main = [k for k in inner if tags[k] in MAIN and value[k] >= MAJOR * value[i]]
        titles = [k for k in kids[i] if tags[k] in ("h1", "h2") and value[k] > 0]
        best = max(inner, key=lambda k: value[k], default=-1)
        others = [k for k in inner if k != best]
        plain = value[i] - sum(value[k] for k in inner) - sum(value[k] for k in titles)
        alone_in_form = best >= 0 and form[best] < SHARED and all(form[k] >= SHARED for k in others)
        if tags[i] not in MAIN and main:
            heads += titles
            stack.extend(reversed(main))
        elif (
            tags[i] not in MAIN and best >= 0 and plain <= MINOR * value[i]
            and (value[best] >= (1 - MAJOR) * value[i] or alone_in_form and 2 * value[best] >= value[i])
        ):
            heads += titles
            stack.append(best)
        else:
            slots.append(i)
    leave, inside = [], set(slots)
    for i in range(n):
        if skeleton[i][1] in inside:
            inside.add(i)
    for i in slots:
        fixed = [k for k in kids[i] if tags[k] not in TEXTUAL and form[k] >= SHARED and 0 < value[k] <= MINOR * value[i]]
        if sum(value[k] for k in fixed) <= MAJOR * value[i]:
            leave += fixed
        leave += [k for k in kids[i] if length[k] and linked[k] > LINKS * length[k]]
    return {"n": skeleton, "slots": sorted({*slots, *heads}), "leave": leave, "gone": sorted({str(t) for i in inside for t in gone[i]})}


def _heads_article(node: Node) -> bool:
    """Whether the node is a header within an article that holds a heading: the article's own, not the site's."""
    if node.tag != "header" and "header" not in re.split("[-_ ]", node.mark):
        return False
    up = node.up
    while up is not None and up.tag not in MAIN:
        up = up.up
    stack = [node] if up is not None else []
    while stack:
        x = stack.pop()
        if x.tag in ("h1", "h2"):
            return True
        stack.extend(x.nodes())
    return False


def alone(page: Node, facts: Facts) -> list[Node]:
    """The content nodes of a page by itself: its outermost articles, or else all that is not set apart."""
    out: list[Node] = []
    stack = [page]
    while stack:
        x = stack.pop()
        if x.tag in MAIN:
            out.append(x)
        elif apart(x) < 2 or apart(x) == 2 and facts.prose(x) > MOST * facts.prose(page):
            stack.extend(reversed(x.nodes()))
    return out or [page]


class Wrapper:
    """A wrapper that is ready to be aligned with pages."""

    def __init__(self, read: dict):
        self.tree, self.places = rooted(read["n"])
        self.slots, self.leave, self.gone = read["slots"], read["leave"], {int(t) for t in read["gone"]}


def extract(source: str | None, wrapper: Wrapper | dict[str, Wrapper] | None) -> str:
    """The main text of a page under the wrapper of its group (one, or each by its shape)."""
    if not source:
        return ""
    page = Page(source)
    if isinstance(wrapper, dict):
        wrapper = wrapper.get(page.shape())
    nodes, left, gone = [], set(), set()
    if wrapper:
        found = page.matched(wrapper.tree, wrapper.places)
        nodes = [m for i in wrapper.slots if i in found for m in found[i].members]
        left = {id(m) for i in wrapper.leave if i in found for m in found[i].members}
        gone = wrapper.gone
    if not any(page.facts.length[id(n)] for n in nodes):
        nodes, left, gone = alone(page.root, page.facts), set(), set()
    whole = sum(map(page.facts.prose, nodes))

    def drop(n: Node) -> bool:
        level = apart(n)
        if level in (1, 2):
            level = 0 if page.facts.prose(n) > (MOST if level == 2 else HINTED) * whole or _heads_article(n) else level
        return id(n) in left or level > 0 or bool(gone) and page.facts.hash[id(n)] in gone and page.facts.length[id(n)] > 0

    out = [b for node in nodes for b in blocks(node, drop)]
    return "\n".join(out or blocks(page.root, lambda n: apart(n) == 3) or blocks(page.root, lambda n: n.tag in NEVER))


def _digest() -> Column:
    return F.unhex(F.md5(F.col("html").cast("binary")))


def shapes_of(pages: DataFrame) -> DataFrame:
    """(host, shape, digest) of the different pages (url, html) that are not empty."""

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"host": frame["host"], "digest": frame["digest"], "shape": [Page(h).shape() for h in frame["html"]]})

    known = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), _digest().alias("digest"), "html")
    return known.mapInPandas(shapes, "host string, digest binary, shape string").distinct()


def skeletons(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, shape, skeleton) of the groups of pages (url, html) with at least two different pages, from at most
    ``sample`` of them, chosen by their digest. Copies count once."""
    # the first of 256 parts of a group, then of the group, so that a host with very many pages does not meet in one task
    parted = shapes_of(pages).withColumn("part", F.substring(F.hex("digest"), 31, 2))
    for by in (["host", "shape", "part"], ["host", "shape"]):
        parted = parted.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("digest"))).where(F.col("n") <= sample)
    chosen = cut(parted.select("host", "shape", "digest"), "chosen")
    few = F.broadcast(chosen) if chosen.count() * 128 <= BROADCAST_BYTES else chosen
    known = pages.where("html <> ''").select(host_of(F.col("url")).alias("host"), _digest().alias("digest"), "html")
    rows = known.join(few, ["host", "digest"]).groupBy("host", "shape", "digest").agg(F.first("html").alias("html"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        skeleton = induce([Page(h) for h in frame.sort_values("digest")["html"]])
        return pd.DataFrame({"host": frame["host"].iloc[:1], "shape": frame["shape"].iloc[:1], "skeleton": [json.dumps(skeleton)]})

    return rows.groupBy("host", "shape").applyInPandas(one, "host string, shape string, skeleton string").where("skeleton <> 'null'")


def _with_host(pages: DataFrame, by_group: DataFrame, value: str) -> DataFrame:
    """Pages (with ``url``) with ``known``: the values of their host's shapes as JSON, null where it has none."""
    hosts = by_group.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("shape", value)))).alias("known"))
    hosts = cut(hosts, "hosts")
    small = (hosts.agg(F.sum(F.octet_length("known") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    return pages.withColumn("host", host_of(F.col("url"))).join(F.broadcast(hosts) if small else hosts, "host", "left")


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(host, shape, wrapper) of every group; texts are counted over all of its different pages."""
    bones = cut(skeletons(pages, sample).withColumn("g", F.xxhash64("host", "shape")), "skeletons")
    numbered = bones.select("host", "shape", F.concat(F.lit("["), F.col("g").cast("string"), F.lit(","), "skeleton", F.lit("]")).alias("skeleton"))
    rows = _with_host(pages.where("html <> ''").select("url", "html", F.xxhash64("html").alias("page")), numbered, "skeleton").where("known is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(read: dict) -> dict:
            every = {shape: json.loads(own) for shape, own in read.items()}
            return {shape: (g, *rooted(skeleton)) for shape, (g, skeleton) in every.items()}

        ready = _Ready(made)
        for frame in frames:
            out = []
            for known, own, source in zip(frame["known"], frame["page"], frame["html"], strict=True):
                page = Page(source)
                group = ready(known).get(page.shape())
                if group:
                    out += [(group[0], own, *(_signed(v) for v in seen)) for seen in observe(page, *group[1:])]
            yield pd.DataFrame(out, columns=["g", "page", "node", "text", "length", "linked", "form"])

    types = "g bigint, page bigint, node int, text bigint, length int, linked int, form bigint"
    seen = cut(rows.select("known", "page", "html").mapInPandas(run, types), "seen")
    key = ["g", "node"]
    pages_of = seen.where("linked >= 0").groupBy(*key, "page").agg(F.max("length").alias("length"), F.max("linked").alias("linked"), F.min("form").alias("form"))
    usual = pages_of.groupBy(*key, "form").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum("linked").alias("linked"))
    n = F.sum("n")
    means = usual.groupBy(*key).agg(n.alias("pages"), (F.sum("length") / n).alias("length"), (F.sum("linked") / n).alias("linked"), (F.max("n") / n).alias("form"))
    texts = seen.where("linked < 0").groupBy(*key, "text").agg(F.count_distinct("page").alias("n"), F.max("length").alias("chars")).where("n > 1")
    same = texts.join(means.select(*key, "pages"), key).where(F.col("n") >= SHARED * F.col("pages"))
    same = same.groupBy(*key).agg(F.collect_list(F.struct("text", F.col("chars").cast("bigint").alias("chars"))).alias("texts"))
    facts = means.join(same, key, "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<struct<text:bigint,chars:bigint>>")))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        skeleton = json.loads(frame["skeleton"].iloc[0])
        whole = frame.loc[frame["node"] == 0, "length"].max()
        # what is more than half of a page is no template: most pages of the group are copies of one article
        frame["texts"] = [[(r["text"] & MASK, r["chars"]) for r in t if r["chars"] <= whole / 2] for t in frame["texts"]]
        return pd.DataFrame({"host": frame["host"].iloc[:1], "shape": frame["shape"].iloc[:1], "wrapper": [json.dumps(decide(skeleton, frame))]})

    return facts.join(bones, "g").groupBy("host", "shape").applyInPandas(one, "host string, shape string, wrapper string")


MASK = (1 << 64) - 1


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


class _Ready:
    """What is made of a JSON text, kept for the texts seen last."""

    def __init__(self, make):
        self.make, self.known = make, {}

    def __call__(self, text):
        if not isinstance(text, str):
            return {}
        if text not in self.known:
            if len(self.known) > 200:
                self.known.clear()
            self.known[text] = self.make(json.loads(text))
        return self.known[text]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bound_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    joined = _with_host(pages, cut(wrappers(pages), "wrappers"), "wrapper")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = _Ready(lambda read: {shape: Wrapper(json.loads(own)) for shape, own in read.items()})
        for frame in frames:
            texts = [extract(source, ready(known)) for source, known in zip(frame["html"], frame["known"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = joined.select("page_id", "url", "html", "known").mapInPandas(run, "page_id string, url string, text string, n_chars bigint")
    return found.withColumn("page_id", F.col("page_id").cast("long"))
