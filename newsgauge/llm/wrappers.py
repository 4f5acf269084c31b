"""Main text of web pages by wrapper induction.

A page becomes a tree of its blocks. The trees of a host's pages are laid over one another by simple tree matching: two nodes
match if they have the same label, and their children are matched in order so that the matched subtrees are as large as
possible. What is laid over one another becomes one node of the host's wrapper, with the texts seen there. Texts that
are the same on nearly all pages of a node are template, and so are nodes that are named as page furniture or hold little but
links; what is left are slots, and what a page has in them is its content.

Wrappers are built from all pages of a host: each task folds the pages it reads into a wrapper per host, and these partial
wrappers are merged in rounds, a few at a time, so that a host of any size is never in one task. A wrapper holds every kind of
block of its host. Its texts are rows beside it, named by the nodes they were seen at, and counted by one aggregate.
"""

from __future__ import annotations

import html
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from newsgauge.llm.ordering import scalar
from newsgauge.session import drop_staged, staged

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
# What HTML says of its elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select".split())
_INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
                     "time tt u var").split())
_IN_HEAD = _RAW | {"base", "link", "meta", "head"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"},
           "tfoot": {"table"}, "option": {"datalist"}}
# Elements, roles and words in class and id that name page furniture.
_FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset head object canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation sidenav topnav mainnav subnav menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars side aside rail widget widgets "
    "header masthead topbar toolbar footer foot bottombar copyright legal colophon "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay disclaimer paywall "
    "newsletter subscribe subscription signup login signin register form search searchbox "
    "share sharing social follow comment comments commentlist commentform disqus respond responses reply replies discussion feedback reactions "
    "related recommended recommendations trending pagination pager skip skiplink").split())
_WITH = frozenset("has no not with without".split())
_MAIN = frozenset(("article", "main"))
_WORDS = re.compile(r"[A-Za-z][a-z]*")
#: Paragraph-like elements without a name share one label, as they stand in for each other in a text.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure address center".split())
#: Neighbours this alike are folded into one node of a wrapper.
_ALIKE = 0.75
#: What is nested deeper than this counts as nested this deep.
_DEEPEST = 100
#: Rows of children with a larger product of lengths are matched by their labels alone.
_CELLS = 40_000
#: A text on this share of the pages of a node, if those are at least so many, is template.
_SHARE, _LEAST = 0.85, 3
#: A task hands on the counts of its texts when it holds so many.
_TEXTS_HELD = 100_000
#: So many pages of a host, or bytes of them, share one copy of its wrapper when they meet it.
_TOGETHER, _TOGETHER_BYTES = 256, 4_000_000


class Node:
    """A block: its label, whether it is furniture, its inner blocks and the texts between them, in order. ``constant`` are
    the texts that its host's wrapper takes for template."""

    __slots__ = ("tag", "label", "furniture", "content", "constant")

    def __init__(self, tag: str, label: str, furniture: bool):
        self.tag, self.label, self.furniture = tag, label, furniture
        self.content: list = []  # nodes, and (text, characters in links)
        self.constant: frozenset = frozenset()


def _node(tag: str, attributes: str, inside_main: bool) -> Node:
    named, named_so = "", False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in _WORDS.findall(token)]
                    if words:
                        named += f" {'-'.join(words)}"
                    if _WITH.isdisjoint(words) and not _NAMES.isdisjoint(words):
                        named_so |= bool((_NAMES - {"header"} if inside_main else _NAMES).intersection(words))
            elif (name == "role" and value.strip().lower() in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and re.search(r"display\s*:\s*none", value)):
                named_so, named = True, f"{named} ({name})"
    furniture = (tag in _FURNITURE and not (inside_main and tag == "header")) or (named_so and tag not in ("html", "body"))
    return Node(tag, tag + named, furniture)


def parse(page: str) -> Node:
    """The tree of blocks of a page. Character references are decoded and white space in a text becomes one blank; scripts,
    styles, comments and the like are left out. Any text is a page: what is not closed ends with what holds it."""
    root = Node("", "", False)
    stack: list[Node] = [root]
    words: list[str] = []
    linked, in_link, beyond, muted, depth = 0, False, 0, "", 0

    def flush() -> None:
        nonlocal words, linked, muted
        if words:
            text = " ".join("".join(words).split())
            if text:
                stack[-1].content.append((text, min(linked, len(text))))
            words, linked = [], 0
        muted = ""

    def close(to: int) -> None:
        nonlocal in_link
        flush()
        del stack[to:]
        in_link = False

    at, size = 0, len(page)
    while at < size:
        match = _TOKEN.search(page, at)
        start = match.start() if match else size
        if start > at and not muted:
            part = page[at:start]
            part = html.unescape(part) if "&" in part else part
            words.append(part)
            linked += len(part.strip()) if in_link else 0
        if not match:
            break
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        closing, attributes = match[1], match[3]
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            if muted == tag:  # furniture in a line of text
                depth += -1 if closing else 1
                muted = muted if depth else ""
            elif not closing and not muted and attributes.strip() and _node(tag, attributes, True).furniture:
                muted, depth = tag, 1
            continue
        if closing:
            if beyond and tag not in _VOID:
                flush()
                beyond -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in ("p", "li") and stack[k].tag in ("article", "main", "td", "th", "table"):
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = size
            continue
        if tag in _VOID:
            if tag == "br" and not muted:
                words.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if len(stack) > _DEEPEST:
            beyond += 1
            continue
        ends, scope = _CLOSES.get(tag, ()), _SCOPES.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in scope:
                break
            if stack[k].tag in ends or (stack[k].tag == "p" and k == len(stack) - 1) or (stack[k].tag == "head" and tag not in _IN_HEAD):
                close(k)
        node = _node(tag, attributes, any(n.tag in _MAIN for n in stack))
        stack[-1].content.append(node)
        stack.append(node)
    flush()
    return root


# A wrapper node: label, furniture, pages, characters, characters in links, {text: pages}, children[, nodes of the page, or in
# the wrapper of a host the numbers under which texts of the node were handed on]
_LABEL, _FURNISHES, _PAGES, _CHARS, _LINKED, _TEXTS, _CHILDREN, _NODES = range(8)


def _short(text: str) -> str:
    """Texts are told apart by their first characters, their last ones and their length."""
    return text if len(text) <= 80 else f"{text[:48]}\0{text[-24:]}\0{len(text)}"


def _length(short: str) -> int:
    return int(short.rpartition("\0")[2]) if "\0" in short else len(short)


def skeleton(node: Node) -> list:
    """The wrapper of one page: neighbours of one kind are folded into one node, which lists them."""
    out = ["#flow" if node.label in _FLOW else node.label, node.furniture, 1, 0, 0, {}, [], [node]]
    children = out[_CHILDREN]
    for x in node.content:
        if isinstance(x, Node):
            child = skeleton(x)
            last = children[-1] if children else None
            if last is not None and last[_LABEL] == child[_LABEL] and (child[_LABEL] == "#flow" or similarity(last, child) >= _ALIKE):
                _lay(last, child, folding=True)
            else:
                children.append(child)
        else:
            out[_CHARS] += len(x[0])
            out[_LINKED] += x[1]
            out[_TEXTS][_short(x[0])] = 1
    return out


def _size(node: list) -> int:
    return 1 + sum(map(_size, node[_CHILDREN]))


def _shared(left: list, right: list) -> list[int]:
    """Where in ``left`` nodes are whose label is also in ``right``."""
    labels = {y[_LABEL] for y in right}
    return [i for i, x in enumerate(left) if x[_LABEL] in labels]


def _rows(left: list, right: list) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for k, y in enumerate(right):
            row.append(max(row[k], above[k + 1], above[k] + (matching(x, y) if x[_LABEL] == y[_LABEL] else 0)))
        rows.append(row)
    return rows


def _by_label(left: list, right: list) -> list[tuple[int, int]]:
    places: dict[str, list[int]] = {}
    for k in reversed(range(len(right))):
        places.setdefault(right[k][_LABEL], []).append(k)
    out, at = [], 0
    for i in _shared(left, right):
        free = places[left[i][_LABEL]]
        while free and free[-1] < at:
            free.pop()
        if free:
            at = free.pop() + 1
            out.append((i, at - 1))
    return out


def matching(a: list, b: list) -> int:
    """Simple tree matching: the most nodes of ``a`` and ``b``, alike in label, that can be laid over one another in order."""
    left, right = a[_CHILDREN], b[_CHILDREN]
    if not left or not right:
        return 1
    if len(left) * len(right) > _CELLS:
        return 1 + len(_by_label(left, right))
    return 1 + _rows([left[i] for i in _shared(left, right)], right)[-1][-1]


def similarity(a: list, b: list) -> float:
    return 2 * matching(a, b) / (_size(a) + _size(b))


def _pairs(left: list, right: list) -> list[tuple[int, int]]:
    """Which children are laid over one another."""
    if len(left) * len(right) > _CELLS:
        return _by_label(left, right)
    if [x[_LABEL] for x in left] == [y[_LABEL] for y in right] and len({x[_LABEL] for x in left}) == len(left):
        return [(k, k) for k in range(len(left))]
    at = _shared(left, right)
    rows, out = _rows([left[i] for i in at], right), []
    i, k = len(at), len(right)
    while i and k:
        if rows[i][k] == rows[i - 1][k]:
            i -= 1
        elif rows[i][k] == rows[i][k - 1]:
            k -= 1
        else:
            i, k = i - 1, k - 1
            out.append((at[i], k))
    return out[::-1]


def _lay(into: list, other: list, folding: bool = False) -> None:
    """Lays ``other`` over ``into``; in ``folding`` both are of one page."""
    into[_CHARS] += other[_CHARS]
    into[_LINKED] += other[_LINKED]
    into[_NODES] += other[_NODES]
    texts = into[_TEXTS]
    if folding:
        texts.update(other[_TEXTS])
    else:
        into[_PAGES] += other[_PAGES]
        for text, n in other[_TEXTS].items():
            texts[text] = texts.get(text, 0) + n
    left, right = into[_CHILDREN], other[_CHILDREN]
    if not right:
        return
    children, done, at = [], 0, 0
    for i, k in _pairs(left, right):
        children += left[done:i] + right[at:k]
        _lay(left[i], right[k], folding)
        children.append(left[i])
        done, at = i + 1, k + 1
    into[_CHILDREN] = children + left[done:] + right[at:]


def _all(node: list) -> Iterator[list]:
    """A node and all below it, always in the same order."""
    yield node
    for child in node[_CHILDREN]:
        yield from _all(child)


def _of_page(page: str) -> list:
    """The wrapper of a host of one page."""
    out = skeleton(parse(page))
    for node in _all(out):
        node[_NODES] = []
    return out


def merge(wrappers: Iterator[list]) -> list | None:
    out = None
    for wrapper in wrappers:
        if out is None:
            out = wrapper
        else:
            _lay(out, wrapper)
    return out


def template(wrapper: list, share: float = _SHARE, least: int = _LEAST, links: float = 0.6) -> list:
    """The wrapper with what is template in it: as furniture, nodes of which more than ``links`` is in links, and
    as texts only those on ``share`` of the at least ``least`` pages of their node.

    Where such texts make up more than half of all text outside furniture, the pages are copies of one another rather than
    filled from a template, and no text counts as constant.
    """
    whole = fixed = 0

    def walk(node: list) -> list:
        nonlocal whole, fixed
        label, furniture, pages, chars, linked, texts, children = node[:_NODES]
        constant = {t: n for t, n in texts.items() if pages >= least and n >= share * pages}
        if furniture:
            return [label, True, pages, chars, linked, {}, []]
        whole += chars
        fixed += sum(n * _length(t) for t, n in constant.items())
        own, inner = [chars, linked], [walk(c) for c in children]
        for c in inner:
            own[0] += c[_CHARS]
            own[1] += c[_LINKED]
        main = label.split(" ", 1)[0] in _MAIN
        return [label, not main and own[0] > 0 and own[1] > links * own[0], pages, *own, constant, inner]

    out = walk(wrapper)

    def clear(node: list) -> None:
        node[_TEXTS] = {}
        for c in node[_CHILDREN]:
            clear(c)

    if 2 * fixed > whole:
        clear(out)
    return out


def _mark(page: list, wrapper: list, inside_main: bool) -> None:
    """Carries what is template over to the nodes of a page."""
    inside_main |= page[_LABEL].split(" ", 1)[0] in _MAIN
    for node in page[_NODES]:
        node.constant = frozenset(wrapper[_TEXTS])
        node.furniture |= wrapper[_FURNISHES] and not inside_main
    if not wrapper[_FURNISHES] or inside_main:
        for i, k in _pairs(wrapper[_CHILDREN], page[_CHILDREN]):
            _mark(page[_CHILDREN][k], wrapper[_CHILDREN][i], inside_main)


def _has_main(node: Node, through_names: bool) -> bool:
    for x in node.content:
        if isinstance(x, Node) and (not x.furniture or (through_names and x.tag not in _FURNITURE)):
            if x.tag in _MAIN and not x.furniture or _has_main(x, through_names):
                return True
    return False


def content(page: str, wrapper: list | None = None) -> str:
    """The main text of a page, a line for each block. If a page has an article or main element, all else is left out."""
    root = parse(page)
    if wrapper is not None:
        _mark(skeleton(root), wrapper, False)
    through = not _has_main(root, False) and _has_main(root, True)  # the article is inside a block with a name of furniture
    only_main = through or _has_main(root, False)
    lines: list[str] = []

    def walk(node: Node, inside: bool) -> None:
        for x in node.content:
            if isinstance(x, Node):
                if not x.furniture or (through and not inside and x.tag not in _FURNITURE and _has_main(x, True)):
                    walk(x, inside or x.tag in _MAIN)
            elif inside and _short(x[0]) not in node.constant:
                lines.append(x[0])

    walk(root, not only_main)
    return "\n".join(lines)


def host_of(url: str) -> Column:
    """The host in a URL, in lower case without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def induce(pages: DataFrame, host: str, page: str, fan_in: int = 16) -> DataFrame:
    """(host, wrapper), staged: for each host what :func:`template` makes of the wrapper of all its pages, as JSON.

    Every task folds its pages into a wrapper for each host; the wrappers of ``fan_in`` neighbouring tasks are merged, round by
    round, without their texts. Those are counted exactly: each is a row with the number of its node in the task's wrapper, and
    the nodes of the last wrapper know which numbers were laid over one another in them. A wrapper grows with the kinds of blocks
    of its host, not with its pages or texts.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        part = texts = 0
        numbers = itertools.count()
        for batch in batches:
            for name, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = _of_page(text)
                texts += sum(len(node[_TEXTS]) for node in _all(one))
                held[name] = merge([held[name], one]) if name in held else one
                if texts >= _TEXTS_HELD or len(held) >= 256:
                    yield counts(held, part, numbers)
                    texts = 0
                if len(held) >= 256:
                    yield rows(held, part)
                    held = {}
        yield counts(held, part, numbers)
        yield rows(held, part)

    def counts(held: dict[str, list], part: int, numbers: Iterator[int]) -> pa.RecordBatch:
        found: list[tuple[int, str, int]] = []
        for node in itertools.chain.from_iterable(map(_all, held.values())):
            if node[_TEXTS]:
                node[_NODES] = node[_NODES] or [(part << 40) + next(numbers)]
                found += [(node[_NODES][0], text, n) for text, n in node[_TEXTS].items()]
                node[_TEXTS] = {}
        number, text, n = zip(*found, strict=True) if found else ((), (), ())
        none = pa.nulls(len(found), pa.string())
        return pa.RecordBatch.from_arrays([none, pa.nulls(len(found), pa.int32()), none, pa.array(number, pa.int64()), pa.array(text, pa.string()), pa.array(n, pa.int64())],
                                          names=["host", "part", "wrapper", "number", "text", "n"])

    def rows(held: dict[str, list], part: int) -> pa.RecordBatch:
        none = pa.nulls(len(held), pa.int64())
        columns = [pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, none, pa.nulls(len(held), pa.string()), none], names=["host", "part", "wrapper", "number", "text", "n"])

    def joined(table: pa.Table) -> pa.Table:
        whole = merge(json.loads(x) for x in table.sort_by("part").column("wrapper").to_pylist())
        return pa.table({"host": table.column("host").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // fan_in], pa.int32()),
                         "wrapper": pa.array([json.dumps(whole)])})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(number, name, place, node[_PAGES]) for place, node in enumerate(_all(json.loads(wrapper))) for number in node[_NODES]]
                yield pa.RecordBatch.from_pylist([dict(zip(places_schema.names, x, strict=True)) for x in found], schema=places_schema)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, constants in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                wrapper = json.loads(text)
                nodes = list(_all(wrapper))
                for x in constants or ():
                    nodes[x["place"]][_TEXTS][x["text"]] = x["n"]
                made.append(json.dumps(template(wrapper)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["host", "wrapper"])

    schema = "host string, part int, wrapper string"
    places_schema = pa.schema([("number", pa.int64()), ("host", pa.string()), ("place", pa.int32()), ("pages", pa.int64())])
    folded = staged(pages.select(host, F.coalesce(F.col(page), F.lit("")), F.spark_partition_id()).mapInArrow(fold, schema + ", number long, text string, n long"))
    parts = folded.where(F.col("wrapper").isNotNull()).select("host", "part", "wrapper")
    last, first = scalar(parts.agg(F.max("part")))[0] or 0, True
    while first or last:
        merged = staged(parts.groupBy("host", F.floor(F.col("part") / fan_in).alias("group")).applyInArrow(joined, schema))
        if not first:
            drop_staged(parts)
        parts, last, first = merged, last // fan_in, False
    places = staged(parts.select("host", "wrapper").mapInArrow(numbered, "number long, host string, place int, pages long"))
    seen = folded.where(F.col("number").isNotNull()).select("number", "text", "n").join(places.where(F.col("pages") >= _LEAST), "number")
    constant = (seen.groupBy("host", "place", "pages", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= _SHARE * F.col("pages"))
                .groupBy("host").agg(F.collect_list(F.struct("place", "text", "n")).alias("constants")))
    out = staged(parts.join(constant, "host", "left").select("host", "wrapper", "constants").mapInArrow(judged, "host string, wrapper string"))
    drop_staged(folded, places, parts)
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text) for each row of ``pages``: the main text of the whole page, empty for a page that is null or has none.

    Rows may repeat, keys may be null and URLs without a host share a wrapper. The wrappers are a narrow table, which
    the optimizer broadcasts if it is small; else pages are dealt by host and a host of very many pages is split by the
    adaptive join. An empty table gives an empty result.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("page"), host_of(url).alias("host"))
    wrappers = induce(rows, "host", "page")

    types = dict(pages.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("host")
            starts, size = [], 0
            hosts = batch.column("host").to_pylist()
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("page")), 0).to_pylist()):
                size += n
                if not i or hosts[i] != hosts[i - 1] or i - starts[-1] >= _TOGETHER or size > _TOGETHER_BYTES:
                    starts.append(i)
                    size = n
            ends = pa.array([*starts, len(hosts)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("key", "url", "page")]
            yield pa.RecordBatch.from_arrays([pa.array([hosts[i] for i in starts], pa.string()), *lists], names=["host", "key", "url", "page"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[str] = []
            for texts, wrapper in zip(batch.column("page"), batch.column("wrapper"), strict=True):
                whole = json.loads(wrapper.as_py()) if wrapper.is_valid else None
                made += [content(text or "", whole) for text in texts.as_py()]
            yield pa.RecordBatch.from_arrays([batch.column("key").flatten(), batch.column("url").flatten(), pa.array(made, pa.string())], names=[key, url, "text"])

    packed = rows.mapInArrow(pack, f"host string, key array<{types[key]}>, url array<{types[url]}>, page array<string>")
    joined = packed.join(wrappers, "host", "left").select("key", "url", "page", "wrapper")
    return joined.mapInArrow(take, f"`{key}` {types[key]}, `{url}` {types[url]}, text string")
