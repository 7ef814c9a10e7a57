"""HTML extraction by wrapper induction: pages of one host are aligned as trees, what stays the same between them is template."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.ship import ship

#: Pages of one host that are aligned with each other, about. A host with twice as many is handled in several such groups.
GROUP_PAGES = 64
#: Hosts of several groups that are broadcast at the most (some tens of bytes each), and what a host's rows are spread by where they are more.
BROADCAST_HOSTS, SALTS = 200_000, 64
#: Nodes that all pairs of are compared, at the most; larger ones meet by equal texts and by the order of equal elements, which keeps hostile pages cheap.
MOST_PAIRS = 40_000
#: A node is template when this many different pages have it with the same text.
TEMPLATE_PAGES = 3
#: And constant, if that is such a share of the pages that have the element around it.
CONSTANT_SHARE = 0.9

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math xmp object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCK - {"option", "legend", "caption", "tbody", "tfoot", "thead", "tr"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
# Elements and names (classes, ids, roles) of what is not the article.
ASIDE = frozenset("nav aside footer form script style head button select dialog menu".split())
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "comment comments disqus reply replies respond share sharing social related recommended sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager newsletter subscribe subscription signup login search footer masthead topbar complementary contentinfo".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies respond".split())
MAIN_NAMES = frozenset("main content article post entry story articlebody".split())

#: Elements whose names do not matter in the alignment, for there are few in a page; text between blocks; what may be a passage.
RUN = "#run"
WHOLE = frozenset(("html", "body", "article", "main", RUN))
PASSAGE = frozenset(("p", "li", RUN))
BASE, PRIME = 0x5851F42D4C957F2D, (1 << 61) - 1

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    names: frozenset[str] = frozenset()
    children: list = field(default_factory=list)
    template: bool = False
    #: Template, and the same in CONSTANT_SHARE of the pages that have the element around it.
    constant: bool = False

    def text(self) -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                stack.extend(reversed(x.children))
        return " ".join(" ".join(parts).split())


def parse(page: str) -> Node:
    """A tree of elements and text; end tags that HTML implies are supplied, those that match nothing are ignored."""
    root = Node("html")
    stack, at = [root], 0
    while m := TAG.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "article", "body") and tag not in ("article", "body", "main", "div", "section", "table"):
                    break
            continue
        if tag in SAME_LEVEL:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in HOLDS[tag]:
                    break
                if stack[k].tag in SAME_LEVEL[tag]:
                    del stack[k:]
                    break
        elif tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        names = frozenset(w for x in NAMES.finditer(m[3]) for w in WORD.findall((x[2] or x[3] or x[4] or "").lower())) if m[3] else frozenset()
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


class Place:
    """A block in the alignment: of a page, or of the wrapper that the pages of a host share. `votes` has how many pages had which text there."""

    __slots__ = ("node", "label", "mark", "kids", "size", "above", "votes", "pages", "index")

    def __init__(self, node: Node, mark: tuple[int, int], kids: list[Place]):
        self.node, self.mark, self.kids, self.above, self.pages = node, mark, kids, None, 0
        names = frozenset(w for w in node.names if not w.isdigit()) if node.names and node.tag not in WHOLE else node.names
        self.label = node.tag if node.tag in WHOLE else (node.tag, names)
        self.size = 1 + sum(k.size for k in kids)
        self.votes: dict[tuple[int, int], int] = {}
        self.index: dict | None = None
        for k in kids:
            k.above = self

    def find(self, label, mark: tuple[int, int]) -> Place | None:
        if self.index is None:
            self.index = {}
            for k in self.kids:
                for m in k.votes or (k.mark,):
                    self.index.setdefault((k.label, m), k)
        return self.index.get((label, mark))


def outline(root: Node) -> Place:
    """All blocks of a page that have text, with hashes of their words. Text and inline elements between blocks become a node RUN."""
    order = [root]
    for x in order:
        order.extend(c for c in x.children if isinstance(c, Node))
    done: dict[int, tuple[int, int, bool, list[Place]]] = {}
    for x in reversed(order):
        parts, holds = [], False
        for c in x.children:
            if isinstance(c, str):
                h = n = 0
                for w in c.split():
                    h, n = (h * BASE + hash(w)) % PRIME, n + 1
                parts.append((h, n))
            else:
                h, n, block, _ = done[id(c)]
                parts.append((h, n))
                holds = holds or block
        h, n = _joined(parts)
        kids: list[Place] = []
        if holds:
            children: list = []
            run: list = []
            for c, part in zip([*x.children, None], [*parts, None], strict=True):
                block = c is not None and not isinstance(c, str) and done[id(c)][2]
                if c is not None and not block:
                    run.append((c, part))
                    continue
                if (mark := _joined([q for _, q in run]))[1]:
                    children.append(Node(RUN, children=[r for r, _ in run]))
                    kids.append(Place(children[-1], mark, []))
                else:
                    children.extend(r for r, _ in run)
                run = []
                if block:
                    children.append(c)
                    if part[1]:
                        kids.append(Place(c, part, done[id(c)][3]))
            x.children = children
        done[id(x)] = (h, n, holds or x.tag in BLOCK, kids)
    return Place(root, (h, n), kids)


def _joined(parts: list[tuple[int, int]]) -> tuple[int, int]:
    h = n = 0
    for a, k in parts:
        if k:
            h, n = (h * pow(BASE, k, PRIME) + a) % PRIME, n + k
    return h, n


def _score(a: Place, b: Place) -> int:
    """Simple tree matching: the size of the largest order-preserving match of two trees with equal roots."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    row = [0] * (len(b.kids) + 1)
    for x in a.kids:
        last, row = row, [0]
        for j, y in enumerate(b.kids):
            row.append(max(last[j + 1], row[j], last[j] + _score(x, y)))
    return row[-1] + 1


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Most of the pairs, ordered by their first numbers, whose second numbers rise too."""
    tails: list[int] = []
    at: list[int] = []
    before = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1], at[n : n + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _pair(left: Sequence[Place], right: Sequence[Place]) -> list[tuple[Place, Place]]:
    """Matched children between two anchors."""
    if not left or not right:
        return []
    labels = [x.label for x in left]
    if labels == [y.label for y in right] and (len(set(labels)) == len(labels) or not any(x.kids for x in left)):
        return list(zip(left, right, strict=True))
    if not any(x.kids for x in left) and not any(y.kids for y in right):
        n, short = 0, min(len(left), len(right))
        while n < short and left[n].label == right[n].label:
            n += 1
        m = 0
        while m < short - n and left[-1 - m].label == right[-1 - m].label:
            m += 1
        if n or m:
            ends = list(zip(left[:n], right[:n], strict=True)) + list(zip(left[len(left) - m :], right[len(right) - m :], strict=True))
            return ends + _pair(left[n : len(left) - m], right[n : len(right) - m])
    if len(left) * len(right) > MOST_PAIRS:
        where: dict = {}
        for j, y in enumerate(right):
            where.setdefault(y.label, []).append(j)
        turn: dict = {}
        met = []
        for i, x in enumerate(left):
            k = turn[x.label] = turn.get(x.label, -1) + 1
            if k < len(where.get(x.label, ())):
                met.append((i, where[x.label][k]))
        return [(left[i], right[j]) for i, j in _rising(met)]
    exact = sum(x.size for x in left) * sum(y.size for y in right) <= MOST_PAIRS
    weight = [[_score(x, y) if exact else (x.label == y.label) * (1 + min(len(x.kids), len(y.kids))) for y in right] for x in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, w in enumerate(weight):
        for j, v in enumerate(w):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + v)
    out: list[tuple[Place, Place]] = []
    i, j = len(left), len(right)
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((left[i], right[j]))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def meet(a: Place, b: Place, grow: bool) -> list[tuple[Place, Place]]:
    """Matched places of two trees with equal roots: from the roots down, children with a text seen before meet first, between them the
    largest match counts. With `grow`, places of `b` without a match join `a` where they stand, and are their own match."""
    out: list[tuple[Place, Place]] = []
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if not y.kids:
            continue
        at = {id(k): i for i, k in enumerate(x.kids)}
        seen: dict[int, int] = {}
        for j, k in enumerate(y.kids):
            if (found := x.find(k.label, k.mark)) is not None:
                seen.setdefault(id(found), j)
        anchors = _rising(sorted((at[i], j) for i, j in seen.items()))
        met: list[tuple[Place, Place]] = []
        i = j = 0
        for p, q in [*anchors, (len(x.kids), len(y.kids))]:
            met += _pair(x.kids[i:p], y.kids[j:q])
            if p < len(x.kids):
                met.append((x.kids[p], y.kids[q]))
            i, j = p + 1, q + 1
        todo += met
        if grow and len(met) < len(y.kids):
            own = {id(k): at[id(w)] for w, k in met}
            kids: list[Place] = []
            i = added = 0
            for k in y.kids:
                if id(k) in own:
                    kids += x.kids[i : own[id(k)] + 1]
                    i = own[id(k)] + 1
                else:
                    kids.append(k)
                    k.above = x
                    x.index.setdefault((k.label, k.mark), k)
                    added += k.size
                    new = [k]
                    for w in new:
                        out.append((w, w))
                        new.extend(w.kids)
            x.kids = kids + x.kids[i:]
            while x is not None:
                x.size += added
                x = x.above
    return out


def align(a: Node, b: Node, into: list[tuple[Node, Node]]) -> int:
    """The matched nodes of two pages go to `into`; their number."""
    pairs = meet(outline(a), outline(b), False)
    into.extend((x.node, y.node) for x, y in pairs)
    return len(pairs)


def _keep_lists(page: Place) -> None:
    """Items go with all of their list or stay with all of it."""
    todo = [page]
    for x in todo:
        todo.extend(x.kids)
        items = [k.node for k in x.kids if k.node.tag == "li"]
        if not all(n.constant for n in items):
            for n in items:
                n.constant = n.template = False


def induce(trees: list[Node]) -> None:
    """Mark the template nodes of pages of one host: aligned nodes whose text is the same in TEMPLATE_PAGES different pages.

    Each page is aligned with a wrapper that starts as the first page and takes in the nodes it lacks (partial tree alignment), so
    pages of several layouts find their own kind. Pages alike in all of their text are one page.

    A passage may stand in several articles at one place where others have another; what is the same in CONSTANT_SHARE of the
    different pages that have the element around it is constant as well. Paragraphs, list items and runs of text
    are template only if constant, list items only if all of their list are.
    """
    pages = [outline(t) for t in trees]
    if len({p.mark for p in pages}) < TEMPLATE_PAGES:
        return
    wrapper = Place(Node("html"), (0, 0), [])
    seen: set[tuple[int, int]] = set()
    matches: list[tuple[Place, Node, tuple[int, int]]] = []
    for page in pages:
        vote = page.mark not in seen
        seen.add(page.mark)
        for w, y in meet(wrapper, page, True):
            matches.append((w, y.node, y.mark))
            w.votes[y.mark] = w.votes.get(y.mark, 0) + vote
            w.pages += vote
            if w.above is not None and w.above.index is not None:
                w.above.index.setdefault((w.label, y.mark), w)
    for w, node, mark in matches:
        if w.above is not None and w.votes[mark] >= TEMPLATE_PAGES:
            node.constant = w.votes[mark] >= CONSTANT_SHARE * w.above.pages
            node.template = node.constant or node.tag not in PASSAGE
    for page in pages:
        _keep_lists(page)


def _is_aside(node: Node, inside_main: bool) -> bool:
    if node.tag in ASIDE or node.tag in RAW or node.names & (COMMENT_NAMES if node.tag == "article" else ASIDE_NAMES) and node.tag not in ("body", "main"):
        return True
    return node.tag == "header" and not inside_main


def _find_main(root: Node) -> list[Node]:
    """The explicit content elements, outermost ones in page order: articles outside of asides, else main elements, else named containers."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    stack: list[tuple[Node, str]] = [(root, "")]
    while stack:
        node, inside = stack.pop()
        if _is_aside(node, True):
            continue
        if node.tag == "article":
            found["article"].append(node)
            continue
        if node.tag == "main" and "m" not in inside:
            found["main"].append(node)
            inside += "m"
        if node.names & MAIN_NAMES and node.tag in ("div", "section", "td") and "n" not in inside:
            found["named"].append(node)
            inside += "n"
        stack.extend((x, inside) for x in reversed(node.children) if isinstance(x, Node))
    return found["article"] or found["main"] or found["named"]


def _weights(root: Node) -> dict[int, int]:
    """Characters of each subtree outside of asides, links and template nodes."""
    total: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        x, done = stack.pop()
        if x.tag == "a" or x.template or _is_aside(x, False):
            total[id(x)] = 0
        elif done:
            total[id(x)] = sum(len(c.strip()) if isinstance(c, str) else total[id(c)] for c in x.children)
        else:
            stack.append((x, True))
            stack.extend((c, False) for c in x.children if isinstance(c, Node))
    return total


def _descend(root: Node) -> Node:
    """Without an explicit element: down from the root while one child holds nearly all text of a node that is not template."""
    node, weight = root, _weights(root)
    while weight[id(node)]:
        heavy = [x for x in node.children if isinstance(x, Node) and x.tag in BLOCK and x.tag not in ("p", "ul", "ol", "table") and weight[id(x)] >= 0.8 * weight[id(node)]]
        if not heavy:
            break
        node = heavy[0]
    return node


def _keeps_most(roots: list[Node]) -> bool:
    """Whether constant nodes hold at most half of the text of explicit elements; where they hold more, the pages are copies of one article."""
    gone = kept = 0
    stack = [(x, False) for x in roots]
    while stack:
        x, constant = stack.pop()
        for c in x.children:
            if isinstance(c, Node):
                if not _is_aside(c, True):
                    stack.append((c, constant or c.constant))
            elif constant:
                gone += len(c.strip())
            else:
                kept += len(c.strip())
    return gone <= kept


def _blocks(roots: list[Node], explicit: bool) -> Iterator[str]:
    drop_constant = explicit and _keeps_most(roots)
    for root in roots:
        buffer: list[str] = []
        stack: list = [(root, True)]
        while stack:
            x, enter = stack.pop()
            if isinstance(x, str):
                buffer.append(x)
                continue
            block = x.tag in BLOCK
            if block and buffer:
                yield "".join(buffer)
                buffer = []
            if not enter:
                continue
            if x is not root and (_is_aside(x, explicit) or (drop_constant and x.constant if explicit else x.template)):
                continue
            if x.tag in ("br", "td", "th", "img", "wbr"):
                buffer.append(" " if x.tag != "wbr" else "")
            if block:
                stack.append((x, False))
            stack.extend((c, True) for c in reversed(x.children))
        if buffer:
            yield "".join(buffer)


def main_text(root: Node) -> str:
    found = _find_main(root)
    blocks = (" ".join(html.unescape(b).split()) for b in _blocks(found or [_descend(root)], bool(found)))
    return "\n\n".join(b for b in blocks if b)


def extract_group(pages: list[str | None]) -> list[str]:
    """The main texts of pages of one host."""
    trees = [parse(p or "") for p in pages]
    if len(trees) >= TEMPLATE_PAGES:
        induce(trees)
    return [main_text(t) for t in trees]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", group_pages: int = GROUP_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of `pages`.

    Hosts of twice `group_pages` pages and more are cut by a hash of the page into groups of about that many or more, a number that
    depends on the host's pages alone; a group is one place of the shuffle, so a large host spreads over many tasks, and the pages of a group are
    aligned with each other in the order of that hash, whatever the number of partitions. Nodes with the same text in several different
    pages become template, varying ones content. Where a page names its article (`article`, `main`, or a named container), blocks
    of it marked as menus, headers, footers, sidebars, notices, adverts, forms or comments go, and of the template nodes those that
    are the same in CONSTANT_SHARE of the pages, since a passage may well stand in several articles; where these would be more than
    half of its text, the pages are copies and keep it. Elsewhere all template nodes go, and the node that holds the varying text is taken.

    Null and empty html give an empty text; so does a page with nothing but template. A null url is a host of its own. Repeated
    rows each give a row; other columns are not read.
    """
    ship(pages.sparkSession)
    id_kind = pages.schema[id_column].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_column), F.lit("")), r"://([^/?#]*)", 1))
    keyed = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), host.alias("host"))
    keyed = keyed.withColumn("h", F.xxhash64("url", "id", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count: list[int] = []

        def done(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            texts = extract_group([x[2] for x in held])
            for (id_, url, *_), text, n in zip(held, texts, count, strict=True):
                for at in range(0, n, 4096):
                    k = min(n - at, 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([id_] * k, kind), pa.array([url] * k, pa.string()), pa.array([text] * k, pa.string()), pa.array([len(text)] * k, pa.int64())], names=["id", "url", "text", "n_chars"]
                    )
            held.clear()
            count.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in zip(*(part.column(c).to_pylist() for c in ("id", "url", "html", "host", "part")), strict=True):
                    if held and row[3:] != held[-1][3:]:
                        yield from _joined_batches(done(kind))
                    if held and row == held[-1]:
                        count[-1] += 1
                    else:
                        held.append(row)
                        count.append(1)
        if held:
            yield from _joined_batches(done(kind))

    grouped = _dealt(keyed, group_pages).repartition("host", "part").sortWithinPartitions("host", "part", "h", "url", "id")
    return grouped.mapInArrow(run, f"id {id_kind}, url string, text string, n_chars long").select(F.col("id").alias(id_column), F.col("url").alias(url_column), "text", "n_chars")


def _joined_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches as one of at most some thousand rows."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(x.num_rows for x in held) >= 4096:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _dealt(keyed: DataFrame, group_pages: int, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """`keyed` with `part`, the group of the host that a page is in. Only hosts with several groups are looked up: by broadcast while they
    are few, else by a join in which a host's rows are spread by SALTS."""
    large = keyed.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2 * group_pages)
    large = scratch.table(large.select("host", F.floor(F.col("n") / group_pages).alias("parts")), "hosts")
    if large.count() <= broadcast_hosts:
        found = keyed.join(F.broadcast(large), "host", "left")
    else:
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        found = keyed.withColumn("salt", F.pmod(F.shiftright("h", 32), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")
    return found.select("id", "url", "html", "host", "h", F.pmod("h", F.coalesce("parts", F.lit(1))).alias("part"))
