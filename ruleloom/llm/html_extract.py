"""Main text of web pages by wrapper induction.

Pages of one host share a template. One page of each host, the one with the
smallest key hash, is the reference; every page's DOM tree is aligned with it
by simple tree matching (the largest set of node pairs that keeps tags, order
and ancestry), at every depth and width. A reference node counts the pages that
align with it, those of them that carry the same text there, and the varying
text of all; text of a page that aligns with nothing counts for the nearest
node above that does. Pages with the same text as the reference have no vote. The
counts of all pages are summed by key, so a host's size does not matter.

Nodes whose text stays the same on the host's pages are template and go
wherever a page repeats them. The wrapper is the slot that holds the varying
text: the subtree with nine tenths of it, or an article or main element with
half of it. What a page names as menu, header, footer, sidebar, notice, advert,
form or comments by tag, class, id or role is never main text and has no vote.
Each page's text is read from the nodes aligned with the wrapper.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize

# HTML's elements by role.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe object canvas audio video select option datalist textarea".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img button output svg math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
MAIN = ("article", "main")
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words that, as the whole of a class, id or role, name a part which is never main text; a part that holds an article or main element is none.
MARK = re.compile(r"(?:^|\s)(?:(?:site|page|main|top|left|right|cookie|comment|ad)[_-])?(?:ads?|advert\w*|sponsor(?:s|ed)?|promo|banner|cookies?|consent|notices?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|headers?|masthead|comments?|replies|disqus)(?:[_-](?:list|section|box|bar|area|banner|container|wrapper))?(?:$|\s)", re.I)
SPACE = re.compile(r"\s+")
#: Comments that end where they begin, and the ends of others.
COMMENT_ENDS, COMMENT_END = re.compile(r"<!--(?:-?>)"), re.compile(r"--!?>")
#: An article or main element with this share of the varying text is the wrapper; other elements need the second share.
HINTED, HELD = 0.5, 0.9
#: A node is template if this share of the pages aligned with it, and so many of them, have its text.
SAME, VOTERS = 0.9, 20
#: Cells of an alignment table that are kept at once; larger tables are halved.
CELLS = 1 << 22


class Node:
    __slots__ = ("bad", "items", "kids", "num", "shape", "tag")

    def __init__(self, tag: str, bad: bool = False):
        self.tag, self.bad, self.kids, self.items, self.num, self.shape = tag, bad, [], [], -1, -1

    def own(self) -> str:
        """The text of a block without the blocks below it, its white space normalised; an inline element's text is its block's."""
        if self.tag in INLINE:
            return ""
        out, todo = [], self.items[::-1]
        while todo:
            x = todo.pop()
            if x.__class__ is str:
                out.append(x)
            elif x.tag == "br":
                out.append(" ")
            elif x.tag in INLINE and not x.bad:
                todo.extend(reversed(x.items))
        return SPACE.sub(" ", "".join(out)).strip()


class _Tree(HTMLParser):
    """A tolerant tree builder: unknown end tags are ignored, open elements close with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.counts: Counter = Counter()
        self.marked: list[Node] = []  # open elements that are bad by their attributes alone

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end("p", {"article", "section", "div", "td", "li", "body", "main", "button", "blockquote"})
        if tag == "li":
            self._end("li", {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._end("dt", {"dl"}) or self._end("dd", {"dl"})
        elif tag in ("td", "th"):
            self._end("td", {"tr", "table"}) or self._end("th", {"tr", "table"})
        elif tag == "tr":
            self._end("tr", {"table"})
        elif tag == "body":
            self._end("head", set())
        bad = marked = False
        for k, v in attrs:
            if (k in ("class", "id", "role") and v and MARK.search(v)) or k == "hidden" or (k == "aria-hidden" and v == "true"):
                bad = marked = tag not in ("html", "body", "article", "main")
        if tag in ASIDE or tag in HIDDEN:
            bad, marked = True, False
        elif tag in MAIN:
            for n in self.marked:
                n.bad = False
            self.marked.clear()
        node = Node(tag, bad)
        self.open[-1].kids.append(node)
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] += 1
            if marked:
                self.marked.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "use"):
            self._close(len(self.open) - 1)

    def _close(self, i: int) -> None:
        for n in self.open[i:]:
            self.counts[n.tag] -= 1
            if self.marked and self.marked[-1] is n:  # a nested one is closed before
                self.marked.pop()
            elif self.marked:
                self.marked = [m for m in self.marked if m is not n]
        del self.open[i:]

    def _end(self, tag: str, stop: set[str]) -> bool:
        if not self.counts[tag]:
            return False
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return True
            if self.open[i].tag in stop:
                return False
        return False

    def handle_endtag(self, tag):
        if tag not in VOID:
            # an inline element that was left open does not keep a block from closing, but never closes one itself
            self._end(tag, ENDS_P | {"td", "li", "body"} if tag in INLINE else set())
        elif tag == "br":
            self.handle_starttag(tag, [])

    def handle_data(self, data):
        if data:
            self.open[-1].items.append(data)

    # Markup that never ends goes, and so does every declaration, processing instruction and marked section, whatever it holds: it is a comment up to
    # the next ">". None of them can raise.

    def parse_starttag(self, i):
        at = super().parse_starttag(i)
        return at if at >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        at = super().parse_endtag(i)
        return at if at >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.parse_pi(i)

    def parse_comment(self, i, report=True):
        if found := COMMENT_ENDS.match(self.rawdata, i):
            return found.end()
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_pi(self, i):
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)


def parse(html: str | None) -> Node:
    """The page's tree, its nodes numbered in document order."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    todo, count = [tree.root], 0
    while todo:
        n = todo.pop()
        n.num = count
        count += 1
        todo.extend(reversed(n.kids))
    return tree.root


class Shapes:
    """Numbers of subtrees by their tags alone: equal shapes, one number. ``base`` holds those of another tree."""

    def __init__(self, root: Node, base: Shapes | None = None):
        self.ids: dict[tuple, int] = {}
        self.base = base
        self.size: list[int] = list(base.size) if base else []
        self.node: list[Node] = list(base.node) if base else []
        order, todo = [], [root]
        while todo:
            n = todo.pop()
            order.append(n)
            todo.extend(n.kids)
        for n in reversed(order):  # children before their parents
            key = (n.tag, *[k.shape for k in n.kids])
            at = base.ids.get(key) if base else None
            at = self.ids.get(key) if at is None else at
            if at is None:
                at = self.ids[key] = len(self.size)
                self.size.append(1 + sum([self.size[k.shape] for k in n.kids]))
                self.node.append(n)
            n.shape = at


def _mid(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """How many children match by shape from the front, and of the others from the end; to pair those is always best."""
    most, front = min(len(x), len(y)), 0
    while front < most and x[front].shape == y[front].shape:
        front += 1
    back = 0
    while back < most - front and x[-1 - back].shape == y[-1 - back].shape:
        back += 1
    return front, back


def align(weights: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest set of pairs (i, j), both ascending, and its weight; ``weights[i][j]`` is 0 where i and j cannot pair."""
    m, n = len(weights), len(weights[0])
    if m * n > CELLS and m > 1:  # halve the rows where the best of both halves meet
        half = m // 2
        top = _last_row(weights[:half], n)
        low = _last_row([w[::-1] for w in reversed(weights[half:])], n)[::-1]
        cut = int((top + low).argmax())
        a, pa = align([w[:cut] for w in weights[:half]]) if cut else (0, [])
        b, pb = align([w[cut:] for w in weights[half:]]) if cut < n else (0, [])
        return a + b, pa + [(i + half, j + cut) for i, j in pb]
    best = [[0] * (n + 1)]
    for w in weights:
        above, row, left = best[-1], [0], 0
        for j in range(n):
            up = above[j + 1]
            left = up if up > left else left
            if w[j] and above[j] + w[j] > left:
                left = above[j] + w[j]
            row.append(left)
        best.append(row)
    i, j, pairs = m, n, []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[m][n], pairs[::-1]


def _last_row(weights: list[list[int]], n: int) -> np.ndarray:
    row = np.zeros(n + 1, np.int64)
    for w in weights:
        row[1:] = np.maximum(row[1:], row[:-1] + np.asarray(w, np.int64))
        np.maximum.accumulate(row, out=row)
    return row


def match(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest match of two trees, and its pairs. ``shapes``: those of ``a``, if known."""
    known = Shapes(b, shapes or Shapes(a))
    node, size = known.node, known.size
    found: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weight(x: int, y: int) -> int:
        return size[x] if x == y else found[x, y][0] if node[x].tag == node[y].tag else 0

    todo = [(a.shape, b.shape)] if a.shape != b.shape and a.tag == b.tag else []
    while todo:
        x, y = todo[-1]
        if (x, y) in found:
            todo.pop()
            continue
        xs, ys = node[x].kids, node[y].kids
        front, back = _mid(xs, ys)
        left, right = ([k.shape for k in kids[front : len(kids) - back]] for kids in (xs, ys))
        lone = [(u, v) for u in dict.fromkeys(left) for v in dict.fromkeys(right) if u != v and node[u].tag == node[v].tag]
        open_ = [p for p in lone if p not in found]
        if open_:
            todo.extend(open_)
            continue
        total = 1 + sum(size[k.shape] for k in xs[:front]) + sum(size[k.shape] for k in xs[len(xs) - back :])
        pairs = [(i, i) for i in range(front)]
        if left and right:
            rows = {u: [weight(u, v) for v in right] for u in dict.fromkeys(left)}
            most, middle = align([rows[u] for u in left])
            total += most
            pairs += [(i + front, j + front) for i, j in middle]
        found[x, y] = total, pairs + [(len(xs) - back + i, len(ys) - back + i) for i in range(back)]
        todo.pop()
    out, walk = [], [(a, b)] if a.tag == b.tag else []
    while walk:
        x, y = walk.pop()
        out.append((x, y))
        if x.shape == y.shape:
            walk.extend(reversed(list(zip(x.kids, y.kids, strict=True))))
        else:
            walk.extend((x.kids[i], y.kids[j]) for i, j in reversed(found[x.shape, y.shape][1]))
    return len(out), out


@lru_cache(maxsize=256)
def _reference(html: str | None) -> tuple[Node, Shapes, dict[int, str]]:
    """A reference tree, its shapes and the texts of its usable nodes by number; batches are read host by host."""
    root = parse(html)
    return root, Shapes(root), {n.num: n.own() for n, _ in _usable(root)}


def _usable(root: Node) -> Iterator[tuple[Node, Node | None]]:
    """(node, nearest article or main above or at it) of the nodes outside bad parts."""
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        n, main = todo.pop()
        main = n if main is None and n.tag in MAIN else main
        yield n, main
        todo.extend((k, main) for k in reversed(n.kids) if not k.bad)


def votes(html: str | None, reference: str | None) -> dict[int, tuple[int, int, int]]:
    """{reference node: (varying characters, 1 if its text is the same, 1)} from one page, for usable nodes with text of their own.

    Text outside the alignment varies, at the nearest aligned node above it,
    with a vote of 0. A page that differs in no usable text, as the reference itself, has no votes.
    """
    page = parse(html)
    ref, shapes, texts = _reference(reference)
    partner = {id(p): r.num for r, p in match(ref, page, shapes)[1]}
    out: dict[int, tuple[int, int, int]] = {}
    same = whole = 0
    todo = [(page, 0)]
    while todo:
        n, above = todo.pop()
        at = partner.get(id(n))
        if at in texts:
            a, b = texts[at], n.own()
            if a or b:
                equal = a == b
                v, s, k = out.get(at, (0, 0, 0))
                out[at] = v + (0 if equal else len(b)), s + equal, k + 1
                same, whole = same + len(b) * equal, whole + len(b)
            above = at
        elif b := n.own():
            v, s, k = out.get(above, (0, 0, 0))
            out[above] = v + len(b), s, k
            whole += len(b)
        todo.extend([(k, above) for k in n.kids if not k.bad])
    return {} if same == whole else out


def wrapper(reference: str | None, counts: dict[int, tuple[int, int, int]]) -> tuple[int, list[int]]:
    """The reference node that holds the main text, or -1, and the template nodes inside it.

    A host without varying text (one page, or copies of one) has no template;
    its reference's own text takes the place of the varying text.
    """
    ref = parse(reference)
    order = [n for n, _ in _usable(ref)]
    varying = sum(counts.get(n.num, (0,))[0] for n in order) > 0
    mass: dict[int, int] = {}
    for n in reversed(order):  # children before their parents
        mass[n.num] = (counts.get(n.num, (0,))[0] if varying else len(n.own())) + sum(mass[k.num] for k in n.kids if not k.bad)
    whole = mass[ref.num]
    if not whole:
        return -1, []
    mains = [n for n, main in _usable(ref) if main is n and mass[n.num] >= HINTED * whole]
    if mains:
        at = max(mains, key=lambda n: mass[n.num])
    else:
        at = ref
        while rich := [k for k in at.kids if not k.bad and mass[k.num] >= HELD * whole]:
            if rich[0].tag in INLINE or rich[0].tag in ENDS_P - {"article", "main", "div", "section", "table", "blockquote"}:
                break
            at = rich[0]
    fixed = [n.num for n, _ in _usable(at) if varying and n.num in counts and counts[n.num][2] >= VOTERS and counts[n.num][1] >= SAME * counts[n.num][2]]
    return at.num, fixed


def blocks(node: Node, template: frozenset[int] = frozenset()) -> list[str]:
    """The texts of the blocks below ``node`` in page order, without bad parts and the own texts of ``template`` nodes (by id())."""
    out: list[str] = []
    mute = set(template)
    run: list[str] = []

    def flush():
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append(" ")
        elif n is node or not n.bad:
            items = n.items
            if id(n) in mute:
                items = [x for x in items if isinstance(x, Node)]
                mute.update(id(x) for x in items if x.tag in INLINE)
            if n.tag in INLINE:
                todo.extend(reversed(items))
            else:
                todo.append(None)
                todo.extend(reversed(items))
                todo.append(None)
    flush()
    return out


def extract(html: str | None, reference: str | None, at: int, fixed: Sequence[int] = ()) -> str:
    """The text aligned with the wrapper without the template; of a page that does not align with it, its article or main elements, else all usable text."""
    page = parse(html)
    mains, template = [], frozenset()
    if at >= 0:
        ref, shapes, texts = _reference(reference)
        pairs = match(ref, page, shapes)[1]
        mains = [p for r, p in pairs if r.num == at]
        constant = frozenset(fixed)
        template = frozenset(id(p) for r, p in pairs if r.num in constant and p.own() == texts[r.num])
    mains = mains or [n for n, main in _usable(page) if main is n] or [page]
    return "\n".join(b for n in mains for b in blocks(n, template))


def _by_host(b: pa.RecordBatch, host: int) -> list[int]:
    """Row numbers of a batch, those of one host together."""
    hosts = b.column(host).to_pylist()
    return sorted(range(len(hosts)), key=hosts.__getitem__)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, pages, refs = (b.column(i).to_pylist() for i in range(3))
        sums: dict[tuple[str, int], tuple[int, int, int]] = {}
        for i in _by_host(b, 0):
            for node, x in votes(pages[i], refs[i]).items():
                y = sums.get((hosts[i], node), (0, 0, 0))
                sums[hosts[i], node] = x[0] + y[0], x[1] + y[1], x[2] + y[2]
        cols = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(3))]
        yield pa.RecordBatch.from_arrays(cols, ["host", "node", "varying", "same", "voters"])


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [wrapper(r["reference"], {c["node"]: (c["varying"], c["same"], c["voters"]) for c in r["counts"] or ()}) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["host", "reference", "at", "fixed"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            html, refs, at, fixed = (b.column(j).to_pylist() for j in (2, 3, 4, 5))
            texts = [""] * b.num_rows
            for j in _by_host(b, 6):
                texts[j] = extract(html[j], refs[j], at[j], fixed[j])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])


#: Characters of reference pages that are sent to every executor at most; more are joined by a shuffle.
SEND_CHARS = 32 << 20


def _sent(hosts: DataFrame) -> DataFrame:
    chars = hosts.agg(F.sum(F.length("reference") + F.length("host"))).first()[0]
    return F.broadcast(hosts) if (chars or 0) <= SEND_CHARS else hosts


HOST = r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of ``pages``.

    Null html counts as empty; pages without text get an empty one; pages
    without a host form one host; repeated rows are pages of their own; other
    columns are ignored. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by one newline in page order.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.lower(F.coalesce(F.regexp_extract(url_col, HOST, 1), F.lit(""))).alias("host"))
    hosts = rows.groupBy("host").agg(F.min(F.struct(F.xxhash64("id", "html").alias("h"), "html")).alias("r"))
    hosts = materialize(hosts.select("host", F.col("r.html").alias("reference")), "op10-references")
    pairs = rows.join(_sent(hosts), "host")
    counts = pairs.select("host", "html", "reference").mapInArrow(_votes, "host string, node long, varying long, same long, voters long")
    counts = counts.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("varying", "same", "voters")))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("node", "varying", "same", "voters")).alias("counts"))  # one entry a reference node
    wrappers = hosts.join(counts, "host", "left").select("host", "reference", "counts").mapInArrow(_wrappers, "host string, reference string, at long, fixed array<long>")
    wrappers = materialize(wrappers, "op10-wrappers")
    out = rows.join(_sent(wrappers), "host").select("id", "url", "html", "reference", "at", "fixed", "host").mapInArrow(_texts, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
