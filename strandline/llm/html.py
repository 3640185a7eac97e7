"""Main text of web pages by site style trees.

The element trees of a host's pages are merged: elements of one path (tags with class and id from the root)
are one node of the host's tree. For each node Spark counts, over all distinct pages of the host, which
child sequences (presentation) and which texts (content) it has; pages with the same text outside menus and the
like count as one page, so copies of a page don't make its article look repeated. A node whose presentation or content
repeats from page to page has low importance, one that varies has high importance, both measured as entropies
to the base of the number of pages.

Words may differ on every page where the style doesn't: so a branch beside the article or main element is also weighed by its style, by how its text,
over all pages of the host, compares with the text of those elements, and by how much of it is links. Hosts of few pages take the weights of
the same path over all hosts. A branch of low weight goes; headings stay.

A label of low content importance is removed, a longer text only outside articles and main elements, where it is not the longest of its page. A branch of low composite
importance is removed with all its texts, unless an element below has importance of its own: by its presentation, or by a text
longer than a label. What names and tags say of an element is a prior that its importance
is multiplied by: little for menus, page headers, footers, sidebars, notices, adverts, forms and reader comments, more than one within an article or main element. Scripts,
styles and other elements that show no text are no content at all.
"""

from __future__ import annotations

import html
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator, Mapping
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, ship, slices
from strandline.llm.urls import host_of

#: Branches below this composite importance are removed, if so many distinct pages of the host have the node.
LEAST_IMPORTANCE, LEAST_PAGES, DAMPING = 0.3, 5, 0.9
#: Priors: of landmarks without main text, and of what lies in an article or main element.
DULL, MAIN = 0.1, 1.5
#: Code points from which a text is more than a label.
LABEL = 40
#: Merged nodes (of all hosts) that may be sent to every task, those of most pages first; all others are joined with the pages that have them.
BROADCAST_NODES = 200_000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset("head template iframe noscript svg canvas object embed audio video map".split())
DULL_TAGS = frozenset("nav footer aside form button select menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CLOSES = {  # an element that begins closes open ones of these kinds, up to the barrier
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}), "tbody": ("thead tbody tfoot tr td th", {"table"}), "tfoot": ("thead tbody tr td th", {"table"}),
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_DULL_WORDS = (
    "ad|ads|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|sponsors|promo|promos|promotion|sidebar|widget|widgets|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|masthead|cookie|cookies|consent|"
    "gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|recommendations|comment|comments|commentlist|disqus|replies|respond|pagination|pager|toolbar|topbar|alert|disclaimer|copyright"
)
BOILERPLATE = re.compile(rf"(?:^|[\s_-])(?:{_DULL_WORDS}|skip-link)(?:$|[\s_-])")
#: As the only word of a class: for articles, headings and paragraphs, whose compound names tell other things.
BOILERPLATE_ALONE = re.compile(rf"(?:^|\s)(?:{_DULL_WORDS})(?:$|\s)")
#: Class names that tell what a layout has or lacks say nothing of the element itself.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without|is)-\S+")
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|top-bar)(?:$|[\s_-])")
_STOP = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


# Kinds that an element closes, and the barriers of that, numbered for the scopes of a node.
_P_BARRIER = frozenset("button table td th li".split())
_SCOPES = [(frozenset(["p"]), _P_BARRIER), *((frozenset(kinds.split()), frozenset(barrier)) for kinds, barrier in CLOSES.values())]
_SCOPE_OF = {tag: i + 1 for i, tag in enumerate(CLOSES)}
_SCOPED = frozenset().union(*(kinds | barrier for kinds, barrier in _SCOPES))


def digest(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 16)
def child_path(path: int, name: str) -> int:
    return digest(f"{path}>{name}")


class Node:
    """A block element. ``path`` is a hash of the names from the root; ``prior`` weighs its importance (0: no content)."""

    __slots__ = ("tag", "name", "path", "prior", "children", "texts", "scope", "own", "main", "chars", "linked", "holds")

    def __init__(self, tag: str, name: str, up: Node | None, own: float, main: bool):
        self.tag, self.name, self.own, self.main = tag, name, own, main
        self.path = child_path(up.path, name) if up else 0
        self.prior = 1.0
        self.chars = self.linked = 0
        self.holds = False
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.scope: tuple[int, ...] = (0,) * len(_SCOPES)


def _tag_end(page: str, at: int, last: dict[str, int], failed: set[int]) -> int:
    """Place of the > that ends a tag whose name ends before ``at``; -1 without one. Quoted values may hold a >;
    where an opened quote is never closed, or no > stands outside quotes, it counts as a plain character. Each place is looked at a few times at most."""
    if last[">"] < at:
        return -1
    i, seen = at, []
    while True:
        m = _STOP.search(page, i)
        if m is None:
            break
        if m.group(1) is None:
            return m.start()
        opened = m.end() - 1
        if opened in failed:
            break
        seen.append(opened)
        i = page.find(m.group(1), opened + 1) + 1 if last[m.group(1)] > opened else opened + 1
    failed.update(seen)
    return page.find(">", at)


def _own_prior(tag: str, name: str, role: str, hidden: bool, in_main: bool) -> float:
    """What the markup of one element says of it: 0 no content, DULL a landmark without main text, else 1."""
    if hidden or tag in SILENT:
        return 0.0
    if tag in DULL_TAGS or role in ROLES:
        return DULL
    if tag in ("html", "body", "main"):
        return 1.0
    told = LAYOUT.sub("", name) if name else ""
    if told and (BOILERPLATE_ALONE if tag == "article" or tag in HEADINGS else BOILERPLATE).search(told):
        return DULL
    if not in_main and (tag == "header" or told and tag != "article" and PAGE_HEADER.search(told)):
        return DULL
    return 1.0


def parse(page: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements, and (element, text) of the blocks in page order, in time linear in the page.

    A block is the text between two block borders; inline elements don't part it.
    """
    root = Node("", "", None, 1.0, False)
    blocks: list[tuple[Node, str]] = []
    if not page:
        return root, blocks
    stack, run, opened = [root], [], {}
    last, failed = {c: page.rfind(c) for c in ">\"'"}, set()
    linked, link = 0, -1  # of the run: code points in links, and the first piece of a link that is open

    def end_link():
        nonlocal linked, link
        if link >= 0:
            linked, link = linked + sum(map(len, run[link:])), -1

    def close_run():
        nonlocal linked, link
        text = " ".join("".join(run).split())
        end_link()
        within, linked = linked, 0
        run.clear()
        if text:
            stack[-1].chars += len(text)
            stack[-1].linked += min(within, len(text))
            blocks.append((stack[-1], text))
            stack[-1].texts.append(text)

    def pop_to(i: int):
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        begin, stop = page.find("<", at), -1
        while begin >= 0:  # a < that begins nothing is text
            after = page[begin + 1 : begin + 2]
            if after in "!?" and after:
                if page.startswith("<!--", begin):
                    stop = page.find("-->", begin + 4)
                    stop = end if stop < 0 else stop + 3
                elif page.startswith("<![CDATA[", begin):
                    stop = page.find("]]>", begin + 9)
                    stop = end if stop < 0 else stop + 3
                elif last[">"] > begin:
                    stop = page.find(">", begin) + 1
            else:
                found = _NAME.match(page, begin + 1)
                stop = _tag_end(page, found.end(), last, failed) + 1 if found else 0
            if stop > 0:
                break
            begin = page.find("<", begin + 1)
        if begin < 0:
            run.append(html.unescape(page[at:]))
            break
        if begin > at:
            run.append(html.unescape(page[at:begin]))
        at = stop
        if after in "!?":
            if page.startswith("<![CDATA[", begin):
                run.append(page[begin + 9 : stop - 3 if page.endswith("]]>", begin, stop) else stop])
            continue
        tag = found.group(1).lower()
        if tag == "a":
            end_link()
            if after != "/":
                link = len(run)
            continue
        if after == "/":
            if tag in INLINE:
                continue
            if opened.get(tag):
                close_run()
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                pop_to(i)
            elif tag in CLOSES_P:
                close_run()
            continue
        if tag in RAW:
            over = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = (page.find(">", over.start()) + 1 or end) if over else end
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                run.append(" " if tag == "br" else "")
            continue
        close_run()
        if tag in CLOSES_P and stack[-1].scope[0]:
            pop_to(stack[-1].scope[0])
        if tag in _SCOPE_OF and stack[-1].scope[_SCOPE_OF[tag]]:
            pop_to(stack[-1].scope[_SCOPE_OF[tag]])
        if tag == "body" and opened.get("head"):
            pop_to(next(i for i, n in enumerate(stack) if n.tag == "head"))
        if tag in VOID:
            continue
        attrs, name, role, hidden = page[found.end() : stop - 1], "", "", False
        if attrs:
            for a in _ATTR.finditer(attrs):
                key = a.group(1).lower()
                value = a.group(2) or a.group(3) or a.group(4) or ""
                if key == "class" or key == "id" and tag not in HEADINGS:
                    name += " " + value.lower()
                elif key == "role":
                    role = value.lower().strip()
                elif key == "hidden" or key == "aria-modal":
                    hidden = True
        up = stack[-1]
        main = up.main or tag in ("article", "main") or role in ("main", "article")
        node = Node(tag, f"{tag}.{'.'.join(sorted(name.split()))}" if name else tag, up, _own_prior(tag, name, role, hidden, up.main), main)
        up.children.append(node)
        if not attrs.rstrip().endswith("/") or tag not in ("p", "div", "span"):
            node.scope = up.scope
            if tag in _SCOPED:
                here = len(stack)
                node.scope = tuple(0 if tag in barrier and tag not in kinds else s or here if tag in kinds else s for s, (kinds, barrier) in zip(up.scope, _SCOPES))
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    close_run()
    _weigh(root)
    return root, blocks


def preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out


def _weigh(root: Node) -> None:
    """Priors from the root downwards: a dull or silent element makes all within it so, but for one that holds a page's only
    article or main element by its class name alone."""
    order = preorder(root)
    holds: set[int] = set()
    for n in reversed(order):
        if n.tag in ("article", "main") and n.own == 1 or any(id(c) in holds for c in n.children):
            holds.add(id(n))
    for n in reversed(order):
        n.holds = any(c.holds or c.main and c.prior for c in n.children)
    for n in order:
        own = 1.0 if n.own == DULL and n.tag not in DULL_TAGS and id(n) in holds else n.own
        n.prior = own if n is root else MAIN if n.main and own == 1 and n.prior >= 1 else min(n.prior, own)
        for c in n.children:
            c.prior = n.prior


def merged_nodes(root: Node) -> dict[int, tuple[int, int]]:
    """path -> (presentation, content) of a page's elements; elements of one path count together."""
    styles: dict[int, list[str]] = {}
    texts: dict[int, list[str]] = {}
    for n in preorder(root):
        styles.setdefault(n.path, []).append(" ".join(c.name for c in n.children))
        texts.setdefault(n.path, []).extend(n.texts)
    return {p: (digest("\n".join(s)), digest("\n".join(texts[p]))) for p, s in styles.items()}


def page_key(blocks: list[tuple[Node, str]]) -> int:
    """What copies of a page have in common: the headlines of its article or main elements, without them their text, and without such
    elements all text outside dull landmarks."""
    main = [(n, t) for n, t in blocks if n.main and n.prior >= 1]
    heads = [t for n, t in main if n.tag == "h1"]
    return digest("\n".join(heads or [t for _, t in main] or [t for n, t in blocks if n.prior >= 1]))


def main_text(page: str | None, importance: Mapping[int, tuple[float, ...]], least: float = LEAST_IMPORTANCE) -> str:
    """Blocks outside branches without importance, joined by line ends. ``importance``: (by presentation, by content, weight of the style) of paths;
    the weight may be left out. Nodes that it lacks have full importance before the prior."""
    root, blocks = parse(page)
    order = preorder(root)
    full = (1.0, 1.0)
    importance = {p: v for p in {n.path for n in order} if (v := importance.get(p))}
    comp: dict[int, float] = {}
    worthy: set[int] = set()  # elements with importance of their own, and those above
    low: set[int] = set()
    light: set[int] = set()
    if importance:
        for n in reversed(order):
            node, leaf = importance.get(n.path, full)[:2]
            kept_here = n.main and n.prior >= 1
            if n.children:
                weight = DAMPING ** len(n.children)
                below = [comp[id(c)] for c in n.children] + ([leaf] if n.texts else [])
                comp[id(n)] = (1 - weight) * node + weight * sum(below) / len(below)
            else:
                comp[id(n)] = leaf
            told = (kept_here or leaf * n.prior >= least) and any(len(t) >= LABEL for t in n.texts)
            if n.children and comp[id(n)] * n.prior >= least or told or any(id(c) in worthy for c in n.children):
                worthy.add(id(n))
        for n in order:
            if id(n) in low or n.children and id(n) not in worthy:
                low.add(id(n))
                low.update(map(id, n.children))
            if id(n) in light or beside(n) and importance.get(n.path, full)[2:] and importance[n.path][2] < least:
                light.add(id(n))
                light.update(map(id, n.children))
    kept = [n.prior >= least and (n.main and n.prior >= 1 and len(t) >= LABEL or n.prior * importance.get(n.path, full)[1] >= least and id(n) not in low) for n, t in blocks]
    # The longest text of the page outside dull landmarks stays, if more than a label, and what the style alone would take if it left nothing.
    longest = max((i for i, (n, t) in enumerate(blocks) if n.prior >= 1 and len(t) >= LABEL), key=lambda i: (len(blocks[i][1]), -i), default=None)
    if longest is not None:
        kept[longest] = True
    styled = [k and id(n) not in light for k, (n, _) in zip(kept, blocks)]
    return "\n".join(t for (_, t), k in zip(blocks, styled if any(styled) else kept) if k)


def beside(n: Node) -> bool:
    """Whether an element lies beside articles and main elements: neither within one nor around one, and no heading."""
    return not n.main and not n.holds and (n.tag not in HEADINGS or n.tag == "p")


def _counted(pages: DataFrame, page: str, url: str) -> DataFrame:
    """Per (host, path), and per path over all hosts (host null): m distinct pages, importance ``node`` by presentation and ``leaf`` by content, and the ``weight`` of the style."""
    ship(pages.sparkSession)
    rows = pages.select(F.xxhash64(host_of(F.col(url))).alias("host"), F.col(page).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            out = []
            for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                root, blocks = parse(t)
                key, sizes = page_key(blocks), branch_sizes(root)
                within = sum(n.chars for n in preorder(root) if n.main and n.prior >= 1)
                out += [(h, key, p, s, c, *sizes[p], within) for p, (s, c) in merged_nodes(root).items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 9)], ["host", "key", "path", "style", "content", "chars", "linked", "beside", "within"])

    seen = rows.mapInArrow(run, "host long, key long, path long, style long, content long, chars long, linked long, beside long, within long")
    sizes = ("chars", "linked", "beside", "within")
    distinct = seen.groupBy("host", "path", "key").agg(*(F.min(c).alias(c) for c in ("style", "content", *sizes)))
    added = [F.sum(c).alias(c) if c != "beside" else F.min(c).alias(c) for c in sizes]
    kinds = distinct.groupBy("host", "path", "style", "content").agg(F.count(F.lit(1)).alias("n"), *added)
    both = kinds.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("style").alias("v")), F.struct(F.lit(1).alias("k"), F.col("content").alias("v")))).alias("x"), "n", *sizes)
    values = both.groupBy("host", "path", "x").agg(F.sum("n").alias("n"), *added)
    m_log = values.groupBy("host", "path").agg(
        (F.sum("n") / 2).alias("m"),
        F.sum(F.when(F.col("x.k") == 0, F.col("n") * F.log("n"))).alias("a"),
        F.sum(F.when(F.col("x.k") == 1, F.col("n") * F.log("n"))).alias("b"),
        *added,  # twice, which no quotient sees
    )
    counted = cut(m_log)
    over_all = counted.groupBy("path").agg(F.sum("m").alias("m"), *added).select(F.lit(None).cast("long").alias("host"), "path", "m", F.lit(1.0).alias("node"), F.lit(1.0).alias("leaf"), *sizes)
    of = lambda c: 1 - F.try_divide(F.col(c), F.col("m") * F.log("m"))  # noqa: E731  entropy to the base m = 1 - sum(n ln n) / (m ln m)
    by_host = counted.select("host", "path", "m", of("a").alias("node"), of("b").alias("leaf"), *sizes)
    links = F.coalesce(F.try_divide(F.col("linked").cast("double"), F.col("chars").cast("double")), F.lit(0.0))
    against = F.least(F.col("chars") / F.col("within"), F.lit(1.0)) * (1 - links)
    weight = F.when(F.col("beside") == 0, 1.0).when(F.col("within") > 0, against).when(links > 0.5, 1 - links).otherwise(1.0)
    return by_host.unionByName(over_all).select("host", "path", "m", "node", "leaf", weight.alias("weight"))


def branch_sizes(root: Node) -> dict[int, tuple[int, int, int]]:
    """path -> (code points of the text of the branches, those in links, 1 if all lie beside articles and main elements)."""
    sums: dict[int, tuple[int, int]] = {}
    out: dict[int, tuple[int, int, int]] = {}
    for n in reversed(preorder(root)):
        chars, linked = n.chars + sum(sums[id(c)][0] for c in n.children), n.linked + sum(sums[id(c)][1] for c in n.children)
        sums[id(n)] = chars, linked
        before = out.get(n.path, (0, 0, 1))
        out[n.path] = before[0] + chars, before[1] + linked, before[2] & beside(n)
    return out


def site_tree(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """(host, path, node, leaf): importance by presentation and by content of the nodes that repeat.

    With m distinct pages (by ``page_key``) that have the node: presentation importance is the entropy of its child sequences to the
    base m; content importance is one less the mean, over pages, of the entropy (to the base m) of the
    page's text being spread over the pages that share it. Of pages with one key and a node in several forms the
    form of the smallest digests counts. Nodes of fewer than ``LEAST_PAGES`` pages and
    nodes of full importance are left out; they count as 1.
    """
    return _counted(pages, page, url).where(F.col("m") >= LEAST_PAGES).where("host is not null and least(node, leaf) < 0.999").select("host", "path", "node", "leaf")


class _Trees:
    """The nodes of all hosts as sorted arrays; those over all hosts stand under host None."""

    def __init__(self, rows: list):
        keyed = sorted(((r.host is not None, r.host or 0, r.path, r.node, r.leaf, r.weight, r.m) for r in rows))
        self.some = np.array([k[0] for k in keyed], bool)
        self.host, self.path = (np.array([k[i] for k in keyed], np.int64) for i in (1, 2))
        self.values = np.array([k[3:6] for k in keyed], float).reshape(-1, 3)
        self.first = int(np.count_nonzero(~self.some))

    def of(self, host: int) -> ChainMap[int, tuple[float, float, float]]:
        """What is known of a host's paths, its own counts before those over all hosts."""
        return ChainMap(self.own(host), self.every)

    @cached_property
    def every(self) -> dict[int, tuple[float, float, float]]:
        return dict(zip(self.path[: self.first].tolist(), map(tuple, self.values[: self.first].tolist())))

    @lru_cache(1024)  # noqa: B019  pages of a host stand together more often than not
    def own(self, host: int) -> dict[int, tuple[float, float, float]]:
        low, high = (self.first + int(np.searchsorted(self.host[self.first :], host, side)) for side in ("left", "right"))
        return dict(zip(self.path[low:high].tolist(), map(tuple, self.values[low:high].tolist())))

    def __getstate__(self):
        return self.some, self.host, self.path, self.values, self.first

    def __setstate__(self, state):
        self.some, self.host, self.path, self.values, self.first = state


def _nodes_of_pages(rows: DataFrame, counted: DataFrame, rest: DataFrame, shared: Broadcast) -> DataFrame:
    """(host, page, nodes): the nodes of ``rest``, which are not sent, that stand on each page.

    Hosts of few pages take those over all hosts, by the (host, path) that ``counted`` has of them. ``page`` is a hash of the whole html; two pages
    of a host under one hash take the nodes of both, of which each looks up its own paths.
    """
    fields = ("node", "leaf", "weight")
    over_all = rest.where("host is null").select("path", *fields)
    taken = counted.where(F.col("host").isNotNull() & (F.col("m") < LEAST_PAGES)).select("host", "path").join(over_all, "path").select("host", "path", *fields)
    nodes = rest.where("host is not null").select("host", "path", *fields).unionByName(taken)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            paths = []
            for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                sent = shared.value.own(h)
                paths.append([p for p in {n.path for n in preorder(parse(t)[0])} if p not in sent])
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(paths, pa.list_(pa.int64()))], ["host", "page", "paths"])

    asked = rows.select("host", "page", "html").mapInArrow(run, "host long, page long, paths array<long>").select("host", "page", F.explode("paths").alias("path"))
    return asked.join(nodes, ["host", "path"]).groupBy("host", "page").agg(F.collect_set(F.struct("path", *fields)).alias("nodes"))


def extract(pages: DataFrame, page: str = "html", url: str = "url", extra: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``extra`` columns and text, the main text of each whole page.

    Blocks are block-level elements' runs of text, with character references decoded, white space (line
    breaks by <br> included) made one blank, and trimmed; they are joined in page order by one line end.
    Null and empty pages, and pages without main text, give an empty text. Rows stay as they are. Pages
    with a null url belong to one nameless host.
    """
    ship(pages.sparkSession)
    counted = _counted(pages, page, url)
    tree = cut(counted.where(F.col("m") >= LEAST_PAGES).where("least(node, leaf, weight) < 0.999 or host is not null"))
    # Columns are renamed by place, so that any names may stand in ``extra``.
    given = pages.select(*extra).schema.fields
    placed = [F.col(c).alias(f"c{i}") for i, c in enumerate(extra)]
    rows = pages.select(*placed, F.col(page).alias("html"), F.xxhash64(host_of(F.col(url))).alias("host"))
    upto = tree.groupBy("m").agg(F.count(F.lit(1)).alias("n")).select("m", F.sum("n").over(Window.orderBy(F.desc("m"))).alias("n"))
    beyond = upto.where(F.col("n") > BROADCAST_NODES).agg(F.max("m")).first()[0]  # nodes of so many pages or fewer are not sent
    few = beyond is None
    shared = pages.sparkSession.sparkContext.broadcast(_Trees((tree if few else tree.where(F.col("m") > beyond)).collect()))
    if not few:
        rows = rows.withColumn("page", F.xxhash64("html"))
        rows = rows.join(_nodes_of_pages(rows, counted, tree.where(F.col("m") <= beyond), shared), ["host", "page"], "left").drop("page")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            hosts, texts = b.column("host").to_pylist(), []
            for i, t in enumerate(b.column("html").to_pylist()):
                known = shared.value.of(hosts[i])
                if not few:
                    known = known.new_child({x["path"]: (x["node"], x["leaf"], x["weight"]) for x in b.column("nodes")[i].as_py() or ()})
                texts.append(main_text(t, known))
            yield pa.RecordBatch.from_arrays([*(b.column(f"c{i}") for i in range(len(extra))), pa.array(texts, pa.string())], [*names, "text"])

    names = [f"c{i}" for i in range(len(extra))]
    out = rows.mapInArrow(run, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, given)) + ", text string")
    return out.toDF(*(f.name for f in given), "text")
