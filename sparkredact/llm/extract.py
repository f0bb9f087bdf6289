"""Main text of pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of block elements and texts (inline markup is dropped, what
is left open is closed). Siblings that repeat, single or in series of any length, are
folded into one repeated group, with their children aligned: what only some
have becomes optional. That leaves the page's skeleton, a union-free expression
whose only unknowns are text slots. Equal skeletons are counted together, so a
host with many pages moves few rows. The distinct skeletons of a host are then
aligned one with another, in groups of at most ``TOGETHER`` and repeatedly, until
one wrapper is left: matching elements merge, others become optional groups.

Slots of the wrapper are judged on the host's whole evidence, counted over distinct
pages (copies, pages with the same texts where main text can be, count as one):

* A page with slots in an article or main element has only text from these. A slot
  there that ``ENOUGH`` pages or more have is boilerplate where its text is the same
  on all of them (an h1 excepted) or is nearly all links. An element whose class, id or
  role has a word of ``ASIDE_WORDS`` is none of the article's text, whatever the evidence;
  one with a word of ``DOUBTFUL_WORDS`` is, if as many pages have it and its text varies.
* Pages of the host without such slots are plain: what is the same on three of them
  is no main text, nor is what is linked for the most part; main text is what is
  under the element that holds most of the rest.

Each page is read again with the verdicts on its slots. No walk over a tree is
recursive, so a page may nest as deeply as it likes; no attribute is cut.

Defined results: a null or empty html has the empty text; a page without main
text too. A null url, or one without a host, belongs to the host ''. Blocks are
in page order, white space (with no-break spaces) inside one is one space, <br>
is white space. Text that isn't shown (hidden elements) counts as text, as does that
of drawings and formulas; scripts, styles, templates and form controls don't. Repeated rows give repeated rows; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written
from .warc import host as host_of

#: Skeletons that one task aligns, and the rows and flags of verdicts up to which they are broadcast.
TOGETHER, BROADCAST_ROWS, BROADCAST_FLAGS = 200, 50_000, 5_000_000
#: Distinct pages whose evidence outweighs an article's tags.
ENOUGH = 5
#: Elements that end a block of text; others are inline.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are no text of the page at all.
SILENT = frozenset("script style noscript template iframe head title textarea select button label".split())
#: Elements around what isn't the main text.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Parts of class names and ids around what isn't the main text.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent popup modal overlay comment comments respond reply replies disqus share sharing social related recommended recommendations widget newsletter subscribe subscription signup login search pagination pager toolbar copyright skip".split())
#: The same where the host's evidence may say otherwise.
DOUBTFUL_WORDS = frozenset("header notice notices alert legal disclaimer".split())
_ASIDE_MARK = re.compile(rf"(?<![a-z])(?:{'|'.join(sorted(ASIDE_WORDS))})(?![a-z])")
_DOUBTFUL_MARK = re.compile(rf"(?<![a-z])(?:{'|'.join(sorted(DOUBTFUL_WORDS))})(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_MARKS = re.compile(r"""(?<![\w-])(class|id|role)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {name: re.compile(rf"</{name}(?![a-zA-Z0-9])[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe", "template")}
#: An opening tag that closes an open element of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_IN_P = BLOCKS - {"body", "html"}


@dataclass
class Node:
    """An element, a group of siblings (sig '+') or a text (sig '#') of an expression."""

    sig: str
    children: list[Node] = field(default_factory=list)
    many: bool = False
    optional: bool = False
    texts: list[tuple[str, int]] = field(default_factory=list)  # of a page: text and its linked characters

    @property
    def key(self) -> str:
        return "+" + self.children[0].key if self.sig == "+" else self.sig


def flat(walk):
    """The result of a recursive walk written as a generator that yields its own calls, without the interpreter's stack."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def signature(name: str, attributes: str) -> str:
    """The element with all its marks (digits made one 0), and at the end whether they tell that it is or may be aside."""
    marks, aside, doubtful = [], False, False
    for m in _MARKS.finditer(attributes):
        value = unescape((m[2] or "").strip("\"'")).lower()
        marks += value.split()
        if name in BLOCKS and name not in ("article", "main"):
            aside = aside or _ASIDE_MARK.search(value) is not None
            doubtful = doubtful or _DOUBTFUL_MARK.search(value) is not None
    # No mark has a space.
    return ".".join([name, *(re.sub(r"\d+", "0", x) for x in marks)]) + (" aside" if aside else " doubtful" if doubtful else "")


def parse(html: str) -> Node:
    """The tree of block elements and texts of a page."""
    root = Node("html")
    path: list[Node] = [root]
    names = ["html"]
    opened = Counter()  # how many elements of each name are open, but the root
    silent: list[str] = []  # open elements that aren't shown
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            path[-1].children.append(Node("#", texts=[(text, min(linked, len(text)))]))
        parts, linked = [], 0

    def close(depth: int) -> None:
        flush()
        opened.subtract(names[depth:])
        del path[depth:], names[depth:]

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else end]
        if text and not silent:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if silent:
            if closing and name in silent:
                del silent[len(silent) - 1 - silent[::-1].index(name) :]
            elif not closing and name == silent[-1] and name not in _VOID:
                silent.append(name)
            elif not closing and name in ("body", "article", "main"):  # an unclosed head, say
                silent.clear()
            if silent:
                continue
            if closing:
                continue
        if name in _VOID and name != "hr":
            if name == "br":
                parts.append(" ")
            continue
        if closing:
            if name == "a":
                links = max(0, links - 1)
            elif opened[name] > 0 and name not in ("html", "body"):
                close(len(names) - 1 - names[::-1].index(name))
            elif name in BLOCKS:
                flush()
            continue
        if name in SILENT:
            if (raw := _RAW.get(name)) is not None:
                shut = raw.search(html, at)
                at = shut.end() if shut else end
            elif not m[3].endswith("/"):
                silent.append(name)
            continue
        sig = signature(name, m[3])
        if name == "a":
            links += 1
        if name not in BLOCKS:
            continue
        links = 0 if name != "li" and links else links
        if name in ("html", "body"):
            flush()
            continue
        if name in ("article", "main") and any(opened[n] > 0 for n in ASIDE):  # an unclosed menu, say
            close(next(i for i, n in enumerate(names) if n in ASIDE))
        if name in _IN_P and opened["p"] > 0:
            close(len(names) - 1 - names[::-1].index("p"))
        if any(opened[n] > 0 for n in _CLOSES.get(name, ())):
            for i in range(len(names) - 1, 0, -1):
                if names[i] in _CLOSES[name]:
                    close(i)
                    break
                if names[i] in ("ul", "ol", "dl", "table", "menu"):
                    break
        flush()
        if name == "hr":
            continue
        node = Node(sig)
        path[-1].children.append(node)
        path.append(node)
        names.append(name)
        opened[name] += 1
    close(1)
    return root


def _merged(a: Node, b: Node):
    children = yield _aligned(a.children, b.children)
    return Node(a.sig, children, a.many or b.many, a.optional or b.optional, a.texts + b.texts)


def _aligned(a: list[Node], b: list[Node]):
    left, right = [x.key for x in a], [x.key for x in b]
    lead = 0
    while lead < min(len(a), len(b)) and left[lead] == right[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    n, m = len(a) - lead - tail, len(b) - lead - tail
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if left[lead + i] == right[lead + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        inner = lead <= i < lead + n or lead <= j < lead + m
        x, y = i - lead, j - lead
        if i < len(a) and j < len(b) and left[i] == right[j] and (not inner or x < n and y < m):
            one = yield _merged(a[i], b[j])
            out.append(one)
            i, j = i + 1, j + 1
        elif y >= m or x < n and best[x + 1][y] >= best[x][y + 1]:
            out.append(Node(a[i].sig, a[i].children, a[i].many, True, a[i].texts))
            i += 1
        else:
            out.append(Node(b[j].sig, b[j].children, b[j].many, True, b[j].texts))
            j += 1
    return out


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """The longest common series of keys merged, everything else optional."""
    return flat(_aligned(a, b))


def _copy(leaf: Node) -> Node:
    return Node(leaf.sig, [], leaf.many, leaf.optional, list(leaf.texts))


def _absorb(a: Node, b: Node):
    """Merges b into a, where neither is part of another tree."""
    a.many, a.optional = a.many or b.many, a.optional or b.optional
    a.texts += b.texts
    if len(a.children) != len(b.children) or any(x.key != y.key for x, y in zip(a.children, b.children, strict=True)):
        a.children = yield _aligned(a.children, b.children)
        return
    for x, y in zip(a.children, b.children, strict=True):
        if x.children or y.children:
            yield _absorb(x, y)
        else:
            x.many, x.optional = x.many or y.many, x.optional or y.optional
            x.texts += y.texts


def _folded(children: list[Node]):
    out: list[Node] = []
    for child in children:
        below = child.children
        if len(below) == 1 and not below[0].children:  # a paragraph, as a rule
            below = [_copy(below[0])]
        elif below:
            below = yield _folded(below)
        own = Node(child.sig, below, child.many, child.optional, list(child.texts))
        if out and out[-1].sig == own.sig and out[-1].key == own.key:
            yield _absorb(out[-1], own)
            out[-1].many = True
        else:
            out.append(own)
    length = 2
    while 2 * length <= len(out):
        keys = [x.key for x in out]
        same = [x == y for x, y in zip(keys, keys[length:], strict=False)]
        run = starts = 0
        found: list[tuple[int, int]] = []  # first sibling and turns of each series
        for i, equal in enumerate([*same, False]):
            if equal:
                starts, run = (i, 1) if not run else (starts, run + 1)
            else:
                if run >= length:
                    found.append((starts, run // length + 1))
                run = 0
        for start, turns in reversed(found):
            group = out[start : start + length]
            for t in range(1, turns):
                group = yield _aligned(group, out[start + t * length : start + (t + 1) * length])
            out[start : start + turns * length] = [Node("+", group, True)]
        length += 1
    return out


def folded(children: list[Node]) -> list[Node]:
    """Siblings with what repeats folded into repeated elements, and into groups of series of any length."""
    return flat(_folded(children))


def skeleton(html: str) -> Node:
    tree = parse(html)
    return Node("html", folded(tree.children))


def dumped(node: Node) -> str:
    """An expression as text, without a page's texts: name, flags and number of children of each node in order."""
    out: list = []
    left = [node]
    while left:
        x = left.pop()
        out += [x.sig, int(x.many) + 2 * int(x.optional), len(x.children)]
        left += reversed(x.children)
    return json.dumps(out, separators=(",", ":"), ensure_ascii=False)


def loaded(text: str) -> Node:
    flat_nodes = json.loads(text)
    top = Node("")
    open_ = [[top, 1]]  # nodes and how many children they still lack
    for sig, flags, n in zip(*[iter(flat_nodes)] * 3, strict=True):
        node = Node(sig, [], bool(flags & 1), bool(flags & 2))
        open_[-1][0].children.append(node)
        open_[-1][1] -= 1
        open_.append([node, n])
        while open_ and not open_[-1][1]:
            open_.pop()
    return top.children[0]


class Place(NamedTuple):
    """An element that a slot stands in (equal paths are one place), and what the names on the way to it tell."""

    above: int  # the place around it, -1 for none
    sig: str
    main: bool  # in an article or main element
    aside: bool  # in what isn't main text
    header: bool  # in an article's own header, of which headings are main text
    doubtful: bool

    @property
    def is_aside(self) -> bool:
        return self.aside or self.header and not re.match(r"h[1-6]\b", self.sig)

    @property
    def in_main(self) -> bool:
        return self.main and not self.is_aside


def slots(node: Node) -> tuple[list[tuple[Node, int]], list[Place]]:
    """The text slots of an expression in order, each with its place; a place stands after that around it."""
    found: list[tuple[Node, int]] = []
    places: list[Place] = []
    numbers: dict[tuple[int, str], int] = {}
    left = [(node, -1)]
    while left:
        x, above = left.pop()
        if x.sig == "#":
            found.append((x, above))
            continue
        if x.sig != "+":
            if (above, x.sig) not in numbers:
                numbers[above, x.sig] = len(places)
                around = places[above] if above >= 0 else Place(-1, "", False, False, False, False)
                name = x.sig.split(" ")[0].split(".")[0]
                main = name in ("article", "main")
                aside = around.aside or name in ASIDE or x.sig.endswith(" aside") or name == "header" and not around.main or main and around.header
                places.append(Place(above, x.sig, around.main or main, aside, around.header or name == "header", around.doubtful or x.sig.endswith(" doubtful")))
            above = numbers[above, x.sig]
        left += [(c, above) for c in reversed(x.children)]
    return found, places


def placed(small: Node, wrapper: Node) -> list[int]:
    """For each slot of a skeleton the slot of the wrapper that takes it.

    A wrapper has the elements of each of its skeletons in order, with others between.
    A sibling is taken where it has all that is below the skeleton's one; the first such
    is always right, since what follows has the more to choose from. So no slot is left over.
    """
    order = {id(n): i for i, (n, _) in enumerate(slots(wrapper)[0])}

    def walk(a: list[Node], b: list[Node]):
        out, j = [], 0
        for x in a:
            took = None
            while took is None:
                if j == len(b):
                    return None
                if x.key == b[j].key:
                    took = [order[id(b[j])]] if x.sig == "#" else (yield walk(x.children, b[j].children))
                j += 1
            out += took
        return out

    found = flat(walk(small.children, wrapper.children))
    if found is None:
        raise ValueError("the wrapper doesn't take this skeleton")
    return found


class Evidence(NamedTuple):
    """What the pages of a host have in a slot of the wrapper."""

    chars: int = 0
    linked: int = 0
    pages: int = 0  # distinct ones, up to some error beyond a few
    same: bool = False  # the text is the same on all of them
    fixed: bool = False  # so it is on three pages or more, of these or of all


def article_verdicts(wrapper: Node, evidence: list[Evidence]) -> list[bool]:
    """Which slots of a wrapper are main text of pages with an article or main element."""
    own, places = slots(wrapper)
    keep = []
    for (_, at), e in zip(own, evidence, strict=True):
        place = places[at]
        enough = e.pages >= ENOUGH
        boilerplate = enough and (e.same and not re.match(r"h1\b", place.sig) or 10 * e.linked >= 9 * e.chars)
        keep.append(place.in_main and not boilerplate and (not place.doubtful or enough and not e.same))
    return keep


def plain_verdicts(wrapper: Node, evidence: list[Evidence]) -> list[bool]:
    """Which slots of a wrapper are main text of plain pages."""
    own, places = slots(wrapper)
    good = [not places[at].is_aside and not places[at].doubtful and not e.fixed and 2 * e.linked <= e.chars for (_, at), e in zip(own, evidence, strict=True)]
    weight = [0] * len(places)
    for (_, at), g, e in zip(own, good, evidence, strict=True):
        weight[at] += e.chars * g
    depth = [0] * len(places)
    for i in range(len(places) - 1, 0, -1):
        weight[places[i].above] += weight[i]
    for i in range(1, len(places)):
        depth[i] = depth[places[i].above] + 1
    # The deepest element that still holds most of the text.
    holds = [i for i, w in enumerate(weight) if w and 10 * w >= 7 * weight[0] and not re.match(r"(p|li|h[1-6]|td|dd)\b", places[i].sig)]
    best = max(holds, key=depth.__getitem__, default=0)
    inside = [False] * len(places)
    for i in range(len(places)):
        inside[i] = i == best or i > 0 and inside[places[i].above]
    return [g and inside[at] for (_, at), g in zip(own, good, strict=True)]


def main_blocks(node: Node, folds: Node, keep: list[bool]) -> list[str]:
    """The texts of a page in page order whose slot is kept; node is the parsed page, folds its skeleton."""
    # folded() hands on the (text, links) tuples of the parsed nodes, so they are the same objects.
    kept = {id(t) for (slot, _), good in zip(slots(folds)[0], keep, strict=True) if good for t in slot.texts}
    out, left = [], [node]
    while left:
        x = left.pop()
        out += [t[0] for t in x.texts if id(t) in kept]
        left += reversed(x.children)
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, shape, skeleton, slot, chars, linked, text_hash): a row for each slot of each page, slot -1 for the page.

    The text_hash of a page is that of all its texts that can be main text.
    """
    source = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kinds = {"host": pa.string(), "shape": pa.int64(), "skeleton": pa.string(), "slot": pa.int32(), "chars": pa.int64(), "linked": pa.int64(), "text_hash": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if not html:
                        continue
                    own = skeleton(html)
                    text = dumped(own)
                    host, shape = host_of(url) or "", _hash(text)
                    found, places = slots(own)
                    content = sorted(t for slot, at in found if not places[at].is_aside for t, _ in slot.texts)
                    rows.append((host, shape, text, -1, 0, 0, _hash("\n".join(content))))
                    for i, (slot, _) in enumerate(found):
                        rows.append((host, shape, None, i, sum(len(t) for t, _ in slot.texts), sum(k for _, k in slot.texts), _hash("\n".join(t for t, _ in slot.texts))))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return source.mapInArrow(run, "host string, shape long, skeleton string, slot int, chars long, linked long, text_hash long")


def wrappers(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) from the distinct skeletons (host, skeleton) of each host."""

    def run(group: pa.Table) -> pa.Table:
        texts = sorted(group.column("skeleton").to_pylist(), key=lambda t: (len(t), t))
        made = loaded(texts[0])
        for text in texts[1:]:
            made = Node("html", aligned(made.children, loaded(text).children))
        return pa.table({"host": pa.array([group.column("host")[0].as_py()]), "skeleton": pa.array([dumped(made)])})

    left = shapes.select("host", "skeleton")
    while True:
        sizes = left.groupBy("host").agg(F.ceil(F.count("*") / TOGETHER).alias("groups"))
        left = left.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("skeleton"), F.col("groups")))
        left = written(left.groupBy("host", "part").applyInArrow(run, "host string, skeleton string"), "wrappers")
        if left.groupBy("host").count().filter("count > 1").isEmpty():
            return left.select("host", F.col("skeleton").alias("wrapper"))


def judged(pages: DataFrame) -> DataFrame:
    """(host, shape, keep array<boolean>): of each skeleton of a host, which slots are main text."""
    # A sketch of a few bytes counts distinct pages; up to 7 it holds their hashes, so whether there are three is exact.
    content = F.when(F.col("slot") == -1, F.col("text_hash"))
    rows = skeletons(pages).groupBy("host", "shape", "slot").agg(F.max("skeleton").alias("skeleton"), F.hll_sketch_agg(content, 4).alias("contents"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    rows = written(rows, "slots")
    shapes = rows.filter("slot = -1").select("host", "shape", "skeleton", "contents")
    by_host = wrappers(shapes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole = None, None
        for batch in batches:
            taken, plain = [], []
            for small, wrapper in zip(batch.column("skeleton").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper != last:
                    last, whole = wrapper, loaded(wrapper)
                own = loaded(small)
                taken.append(placed(own, whole))
                found, places = slots(own)
                plain.append(not any(places[at].in_main for _, at in found))
            columns = [batch.column("host"), batch.column("shape"), batch.column("contents"), pa.array(plain, pa.bool_()), pa.array(taken, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "shape", "contents", "plain", "places"])

    at = written(shapes.join(by_host, "host").select("host", "shape", "skeleton", "contents", "wrapper").mapInArrow(place, "host string, shape long, contents binary, plain boolean, places array<int>"), "places")
    own = at.select("host", "shape", "contents", "plain", F.posexplode("places").alias("slot", "place"))
    stats = rows.filter("slot >= 0").drop("contents").join(own, ["host", "shape", "slot"]).groupBy("host", "place", "plain").agg(F.hll_union_agg("contents").alias("contents"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("least").alias("least"), F.max("most").alias("most"))

    # What is the same on three pages of the host, or on three of its plain ones, is no main text of plain pages.
    every = Window.partitionBy("host", "place")
    pages, same = F.hll_sketch_estimate("contents"), F.col("least") == F.col("most")
    all_pages, all_same = F.hll_sketch_estimate(F.hll_union_agg("contents").over(every)), F.min("least").over(every) == F.max("most").over(every)
    stats = stats.select("host", "place", "plain", "chars", "linked", pages.alias("pages"), same.alias("same"), ((pages >= 3) & same | (all_pages >= 3) & all_same).alias("fixed"))

    def judge(found: pa.Table, wrapper: pa.Table) -> pa.Table:
        whole = loaded(wrapper.column("wrapper")[0].as_py())
        n = len(slots(whole)[0])
        rows = found.to_pylist()
        keep = []
        for plain, verdicts in ((True, plain_verdicts), (False, article_verdicts)):
            own = {r["place"]: Evidence(r["chars"], r["linked"], r["pages"], r["same"], r["fixed"]) for r in rows if r["plain"] == plain}
            keep.append(verdicts(whole, [own.get(i, Evidence()) for i in range(n)]))
        return pa.table({"host": pa.array([wrapper.column("host")[0].as_py()] * 2), "plain": pa.array([True, False]), "verdicts": pa.array(keep, pa.list_(pa.bool_()))})

    # A group is a host's wrapper and its slots: twice as many rows as the wrapper has slots at most.
    found = stats.groupBy("host").cogroup(by_host.groupBy("host")).applyInArrow(judge, "host string, plain boolean, verdicts array<boolean>")
    keep = F.transform("places", lambda p: F.element_at("verdicts", p + 1))
    return at.join(found, ["host", "plain"]).select("host", "shape", F.when(F.size("places") > 0, keep).otherwise(F.array().cast("array<boolean>")).alias("keep"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of pages."""
    ruled = written(judged(pages), "verdicts")
    size = ruled.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("keep")), F.lit(0)).alias("flags")).first()
    small = size["rows"] <= BROADCAST_ROWS and size["flags"] <= BROADCAST_FLAGS
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch], rules: dict | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                keeps = part.column("keep").to_pylist() if rules is None else [None] * part.num_rows
                for url, html, keep in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), keeps, strict=True):
                    tree = parse(html or "")
                    folds = Node("html", folded(tree.children))
                    if html and rules is not None:
                        keep = rules.get((host_of(url) or "", _hash(dumped(folds))))
                    texts.append("\n".join(main_blocks(tree, folds, keep)) if html and keep else "")
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = "page_id long, url string, text string"
    if small:  # a bounded number of rows and flags
        held = pages.sparkSession.sparkContext.broadcast({(r["host"], r["shape"]): r["keep"] for r in ruled.collect()})
        return source.mapInArrow(lambda batches: read(batches, held.value), out)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                hosts = [host_of(u) or "" for u in part.column("url").to_pylist()]
                shapes = [_hash(dumped(skeleton(h))) if h else None for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hosts), pa.array(shapes, pa.int64())], names=[*part.schema.names, "host", "shape"])

    shaped = source.mapInArrow(shape, "page_id long, url string, html string, host string, shape long")
    return shaped.join(ruled, ["host", "shape"], "left").select("page_id", "url", "html", "keep").mapInArrow(lambda batches: read(batches, None), out)


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
