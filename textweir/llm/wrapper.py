"""Main text of web pages by wrapper induction over pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Reference pages of a host, and distinct ones without which no text counts as constant.
REFERENCES, DISTINCT = 8, 3
#: Bytes of all templates up to which they are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 16 << 20
#: How much more a character counts inside a main or article element when the content is sought.
INSIDE = 8

# Fixed values of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements of one block, which are never the content as a whole.
LEAVES = HEADINGS | set("p li dt dd caption figcaption pre option summary legend".split())
#: Elements that HTML defines as no part of the text around them.
ASIDE = set("nav footer aside form button select dialog menu head".split())
#: Whole class, id or role names of what sites put inside the content itself.
ASIDE_NAMES = set("ad ads advert advertisement comment comments comment-list consent cookie-notice newsletter related respond share sidebar sponsored".split())


class Element:
    """An element of a page. Its kids are elements and blocks; a block is (text, characters outside links)."""

    __slots__ = ("tag", "names", "kids")

    def __init__(self, tag: str, names: tuple[str, ...]):
        self.tag, self.names, self.kids = tag, names, []


def names_of(attributes: str) -> tuple[str, ...]:
    """Names in class, id and role, numbers in them made equal."""
    found = {re.sub("[0-9]+", "0", name.lower()) for m in NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split()}
    return tuple(sorted(found))


def is_aside(tag: str, names: tuple[str, ...]) -> bool:
    return tag in ASIDE or (tag not in ("", "html", "body", "main", "article") and not ASIDE_NAMES.isdisjoint(names))


def parse(page: str | None) -> Element:
    """Tree of the elements that hold blocks. Inline elements are text; an inline element that is
    set aside is dropped with its text, and so are comments, scripts and styles."""
    root = Element("", ())
    stack, text, at = [root], [], 0
    links = linked = 0  # links open, and characters of this block inside them
    skipped = None  # the inline element being dropped, and its depth
    page = page or ""

    def flush() -> None:
        nonlocal linked
        block = SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if block:
            stack[-1].kids.append((block, max(len(block) - linked, 0)))
        linked = 0

    for m in RAW.finditer(page):
        if skipped is None and m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        if skipped:
            if tag == skipped[0]:
                skipped[1] += -1 if m[2] else 1
                skipped = skipped if skipped[1] else None
            continue
        if tag == "br":
            text.append(" ")
        elif tag in EMPTY and tag != "hr":
            continue
        elif tag in INLINE:
            if tag == "a":
                links = max(links + (-1 if m[2] else 1), 0)
            if not m[2] and m[4] and is_aside(tag, names_of(m[4])):
                skipped = [tag, 1]
        elif m[2]:
            flush()
            if any(e.tag == tag for e in stack[:0:-1]):
                while stack.pop().tag != tag:
                    pass
        else:
            flush()
            if stack[-1].tag == "p" or stack[-1].tag in HEADINGS:
                stack.pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                stack.pop()
            if tag != "hr":
                element = Element(tag, names_of(m[4]))
                stack[-1].kids.append(element)
                stack.append(element)
    if skipped is None:
        text.append(page[at:])
    flush()
    return root


class Group:
    """A node of a page's tree in which siblings that repeat are one, or a node of a template.

    `texts` has the blocks directly in it: the number of reference pages that have each, and its
    characters outside links. `content` marks what a template's text is taken from; `constant` is
    the texts that are part of it.
    """

    __slots__ = ("tag", "names", "kids", "elements", "texts", "content", "constant")

    def __init__(self, tag: str, names: tuple[str, ...]):
        self.tag, self.names = tag, names
        self.kids: list[Group] = []
        self.elements: list[Element] = []
        self.texts: dict[str, list[int]] = {}
        self.content, self.constant = False, frozenset()

    def label(self) -> tuple:
        return self.tag, self.names


def collapse(root: Element) -> Group:
    """The tree of a page with runs of equal siblings, such as paragraphs, as one node each."""
    top = Group(root.tag, root.names)
    top.elements.append(root)
    todo = [top]
    while todo:
        group = todo.pop()
        for element in group.elements:
            runs: list[Group] = []
            for kid in element.kids:
                if isinstance(kid, tuple):
                    group.texts.setdefault(kid[0], [1, 0])[1] += kid[1]
                    continue
                if not runs or runs[-1].label() != (kid.tag, kid.names):
                    runs.append(Group(kid.tag, kid.names))
                runs[-1].elements.append(kid)
            group.kids = united(group.kids, runs)
        todo += group.kids
    return top


def united(kids: list[Group], runs: list[Group]) -> list[Group]:
    """Children of a repeated element and those of its next instance: equal ones meet in order,
    others are put between."""
    if not kids or not runs:
        return kids or runs
    places: dict[tuple, list[int]] = {}
    for i, kid in enumerate(kids):
        places.setdefault(kid.label(), []).append(i)
    new: dict[int, list[Group]] = {}
    last = -1
    for run in runs:
        known = places.get(run.label(), [])
        i = bisect_right(known, last)
        if i < len(known):
            last = known[i]
            kids[last].elements += run.elements
        else:
            new.setdefault(last, []).append(run)
    return kids if not new else [*new.get(-1, []), *(x for i, kid in enumerate(kids) for x in (kid, *new.get(i, [])))]


def shapes(roots: list[Group]) -> dict[int, int]:
    """A number for each node of some trees, by id: nodes have the same one if the trees below them
    are equal in tags and names."""
    order = list(roots)
    for node in order:
        order += node.kids
    known: dict[tuple, int] = {}
    out: dict[int, int] = {}
    for node in reversed(order):
        out[id(node)] = known.setdefault((node.tag, node.names, *(out[id(k)] for k in node.kids)), len(known))
    return out


def match(a: Group, b: Group) -> list[tuple[Group, Group]]:
    """Simple tree matching: of two trees with equal roots, the pairs of nodes of a largest matching
    that keeps parents and the order of siblings. Nodes match by tag; equal names weigh as much again.

    A matching depends on shapes alone, so each pair of shapes is matched once, however often it
    occurs. Equal trees match wholly and no other match of either weighs more, so equal children at
    both ends match each other, and only those between are tried in all ways.
    """
    shape = shapes([a, b])
    best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    open_: dict[tuple[int, int], tuple] = {}
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (shape[id(x)], shape[id(y)])
        if key in best:
            stack.pop()
            continue
        if key not in open_:
            left, right = [shape[id(k)] for k in x.kids], [shape[id(k)] for k in y.kids]
            most, front, back = min(len(left), len(right)), 0, 0
            while front < most and left[front] == right[front]:
                front += 1
            while back < most - front and left[-1 - back] == right[-1 - back]:
                back += 1
            fixed = [(i, i) for i in range(front)] + [(len(left) - i, len(right) - i) for i in range(back, 0, -1)]
            rows, columns = range(front, len(left) - back), range(front, len(right) - back)
            between = [(i, j) for i in rows for j in columns if x.kids[i].tag == y.kids[j].tag]
            open_[key] = fixed, between
            needed = {(left[i], right[j]): (x.kids[i], y.kids[j]) for i, j in fixed + between}
            stack += [pair for k, pair in needed.items() if k not in best]
            continue
        fixed, between = open_.pop(key)
        weight = lambda i, j: best[shape[id(x.kids[i])], shape[id(y.kids[j])]][0]
        chosen = fixed + ordered({(i, j): weight(i, j) for i, j in between})
        best[key] = 1 + (x.names == y.names) + sum(weight(i, j) for i, j in chosen), chosen
        stack.pop()
    out = [(a, b)]
    for x, y in out:
        out += [(x.kids[i], y.kids[j]) for i, j in best[shape[id(x)], shape[id(y)]][1]]
    return out


def ordered(weights: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The heaviest set of pairs (i, j) in which both places ascend."""
    rows: dict[int, list[int]] = {}
    for i, j in weights:
        rows.setdefault(i, []).append(j)
    columns = sorted({j for _, j in weights})
    at = {j: k + 1 for k, j in enumerate(columns)}
    # The best chain that ends in the first k columns, in a tree of maxima over ranges of columns.
    tree: list[tuple[int, tuple | None]] = [(0, None)] * (len(columns) + 1)
    for i in sorted(rows):
        ends = []
        for j in rows[i]:
            k, best = at[j] - 1, (0, None)
            while k:
                best = max(best, tree[k], key=lambda x: x[0])
                k &= k - 1
            ends.append((at[j], (best[0] + weights[i, j], (i, j, best[1]))))
        for k, chain in ends:
            while k < len(tree):
                tree[k] = max(tree[k], chain, key=lambda x: x[0])
                k += k & -k
    k, best = len(columns), (0, None)
    while k:
        best = max(best, tree[k], key=lambda x: x[0])
        k &= k - 1
    out, link = [], best[1]
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def merge(template: Group, page: Group) -> None:
    """Aligns a page with a template and adds what the template lacks."""
    pairs = match(template, page)
    partner = {id(y): x for x, y in pairs}
    for x, y in pairs:
        for text, (_, size) in y.texts.items():
            known = x.texts.setdefault(text, [0, 0])
            known[0] += 1
            known[1] += size
        new: dict[int, list[Group]] = {}
        last = 0
        for kid in y.kids:
            if id(kid) in partner:
                last = id(partner[id(kid)])
            else:
                new.setdefault(last, []).append(kid)
        if new:
            x.kids = [*new.get(0, []), *(z for kid in x.kids for z in (kid, *new.get(id(kid), [])))]


def decide(template: Group, pages: int) -> Group:
    """Marks the constant texts and the content of a template made of so many pages.

    A text at one node in all pages is constant. The content is the deepest node with more than
    half of the varying text: links do not count, text inside main and article elements counts
    INSIDE times, that of elements set aside not at all. A main or article element around it is
    taken whole, and headings beside it or beside what it lies in belong to it.

    A heading that all articles of a host share stands among blocks that vary, so it is theirs and
    not constant; it goes only with a whole part of the page that varies nowhere.
    """
    order = [(template, -1, False, False)]
    for i, (node, _, inside, aside) in enumerate(order):
        inside, aside = inside or node.tag in ("main", "article"), aside or is_aside(node.tag, node.names)
        order[i] = (node, order[i][1], inside, aside)
        order += [(kid, i, inside, aside) for kid in node.kids]
        if pages >= DISTINCT:
            node.constant = frozenset(t for t, (n, _) in node.texts.items() if n == pages)
    mass = [0 if aside else (INSIDE if inside else 1) * sum(size for t, (_, size) in node.texts.items() if t not in node.constant) for node, _, inside, aside in order]
    for i in range(len(order) - 1, 0, -1):
        mass[order[i][1]] += mass[i]
    at = 0
    for i, (node, parent, _, _) in enumerate(order):
        if parent == at and 2 * mass[i] > mass[0] and node.tag not in LEAVES:
            at = i
    varies = [any(t not in node.constant for t in node.texts) for node, *_ in order]
    for i in range(len(order) - 1, 0, -1):
        varies[order[i][1]] |= varies[i]
    part = list(range(len(order)))
    for i, (node, parent, _, _) in enumerate(order):
        part[i] = part[parent] if parent >= 0 and node.tag in LEAVES else i
        if node.tag in HEADINGS and varies[part[i]]:
            node.constant = frozenset()
    path = [at]
    while order[path[-1]][1] >= 0:
        path.append(order[path[-1]][1])
    at = max((k for k, i in enumerate(path) if order[i][0].tag in ("main", "article")), default=0)
    order[path[at]][0].content = True
    for i in path[at + 1 :]:
        for kid in order[i][0].kids:
            kid.content = kid.content or kid.tag in HEADINGS
    return template


def induce(pages: list[str]) -> Group | None:
    """Template of a host from reference pages; None without any."""
    trees = {}
    for page in sorted(pages):
        tree = collapse(parse(page))
        trees.setdefault(tuple(all_texts(tree)), tree)
    if not trees:
        return None
    first, *rest = trees.values()
    for tree in rest:
        merge(first, tree)
    return decide(first, len(trees))


def all_texts(tree: Group) -> list[str]:
    nodes = [tree]
    for node in nodes:
        nodes += node.kids
    return [t for node in nodes for t in node.texts]


def dump(template: Group) -> str:
    """A template as text: its nodes from top to bottom, each with the number of its children."""
    rows, stack = [], [template]
    while stack:
        node = stack.pop()
        rows.append([node.tag, node.names, len(node.kids), node.content, sorted(node.constant)])
        stack += node.kids[::-1]
    return json.dumps(rows, ensure_ascii=False)


def load(text: str) -> Group:
    top = Group("", ())
    todo = [(top, 1)]
    for tag, names, kids, content, constant in json.loads(text):
        while not todo[-1][1]:
            todo.pop()
        parent, left = todo[-1]
        todo[-1] = (parent, left - 1)
        node = Group(tag, tuple(names))
        node.content, node.constant = content, frozenset(constant)
        parent.kids.append(node)
        todo.append((node, kids))
    return top.kids[0]


def extract(page: str | None, template: Group | None) -> str:
    """Main text of a page: the varying texts of the content. A page without the template's content
    is its own template."""
    root = parse(page)
    tree = collapse(root)
    role = {}
    if template is not None:
        role = {id(e): x for x, y in match(template, tree) for e in y.elements}
    if not any(x.content for x in role.values()):
        decide(tree, 1)
        role, nodes = {}, [tree]
        for node in nodes:
            role |= {id(e): node for e in node.elements}
            nodes += node.kids
    out, stack = [], [(root, False, False)]
    while stack:
        element, taken, inside = stack.pop()
        if isinstance(element, str):
            out.append(element)
            continue
        node = role.get(id(element))
        # A header is part of an article or of the main element, but not of the page.
        if is_aside(element.tag, element.names) or (element.tag == "header" and not inside):
            continue
        taken = taken or (node is not None and node.content)
        inside = inside or element.tag in ("main", "article")
        constant = node.constant if node is not None else frozenset()
        for kid in element.kids[::-1]:
            if isinstance(kid, Element):
                stack.append((kid, taken, inside))
            elif taken and kid[0] not in constant:
                stack.append((kid[0], True, inside))
    return "\n".join(out)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(host, template) for each host. References are the pages with the least hashes in each of
    REFERENCES classes of hashes, so they depend on all pages of a host."""
    hashed = F.xxhash64(F.col(id_col), F.col("html"))
    drawn = pages.select(host_of().alias("host"), F.pmod(hashed, F.lit(REFERENCES)).alias("class"), hashed.alias("hash"), "html").where("html is not null and host <> ''")
    chosen = drawn.groupBy("host", "class").agg(F.min_by("html", "hash").alias("html"))

    def run(key: tuple, refs: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "template": [dump(induce(refs["html"].tolist()))]})

    return chosen.groupBy("host").applyInPandas(run, "host string, template string")


def main_texts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Main text of every page: id, url, text, n_chars in code points.

    The trees of up to REFERENCES pages of a host are aligned from the root by simple tree
    matching and merged to a template: elements that correspond are one node, texts that are the
    same in all are constant, and the node that holds most of what varies is the content. A page
    is aligned with its host's template and gives what varies in the content, without elements
    that HTML or, inside the content, their own name sets aside.

    A null or empty page gives ''. A page without a host in its url, or without the content node
    of its host's template, is its own template. Fewer than DISTINCT different pages of a host
    show no constant texts. Rows that repeat give a row each; an empty
    table gives none; other input columns are not read.
    """
    found = staged(templates(pages, id_col))
    bytes_ = found.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("template")), F.lit(0))).head()[0]
    side = F.broadcast(found) if bytes_ <= BROADCAST_BYTES else found
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), "url", "html", host_of().alias("host")).join(side, "host", "left").select("id", "url", "html", "template")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Group] = {}
        for batch in batches:
            if len(loaded) > 1000:
                loaded.clear()
            texts = [extract(h, (loaded.get(t) or loaded.setdefault(t, load(t))) if t else None) for h, t in zip(batch["html"], batch["template"])]
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return rows.mapInPandas(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
