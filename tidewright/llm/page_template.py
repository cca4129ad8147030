"""HTML extraction by equivalence classes of tokens.

Tokens of a page are its elements, told apart by the path that leads to them (and by place, if they are containers
without a class), and its blocks of text. Over all distinct pages of a host, each token has an occurrence vector: how
often it occurs in each page. Tokens with equal vectors form an equivalence class. Large classes found in enough pages
are valid if they nest: an element belongs to the template if the elements around it do. What the template doesn't
cover are its slots.

Which slots hold main text is decided for the whole host: going down from the root of the template, the element that
fills most of its parent's slots, page by page, leads on to the container of main text. In each page, main text is what
fills the slots inside that container. Names of elements and classes only weigh in that choice, and tell adverts,
forms, comments and the like inside the container. A page without its host's container, or of a host with too few
pages, is read as a template of its own.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import schema_with, written
from .url_filter import host_of

#: Quantifiers don't give back what they took, so a match that fails costs no more than one pass over it.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: HTML's elements by kind.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
_ENDS_ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS_LISTS = frozenset("ul ol dl table body article main section div nav".split())
_ENDS = _HOLDS_LISTS.union(*_ENDS_ALIKE.values())
#: Elements that are content rather than containers of it, and those of them that hold others.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption pre blockquote figure details summary address".split())
_LISTS = frozenset("ul ol dl table".split())
#: Elements, roles and names that mark what is not main text. Those of the last set may also mark main
#: text, and do where they hold a good part of it.
_ASIDE = frozenset("nav footer aside form menu dialog button select noscript template head object svg canvas".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored cookie cookies consent gdpr "
    "sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer comments disqus newsletter pagination pager".split()
)
_WEAK_NAMES = frozenset(
    "promo promotion banner notice notices notification alert popup modal overlay side comment respond reply replies discussion "
    "share sharing social related recommended subscribe subscription signup login search widget toolbar skip hidden".split()
)
#: Classes that tell a state of a wrapper, such as has-sidebar.
_STATES = ("has-", "no-", "with-", "without-", "has_", "no_", "with_", "without_")
#: Kinds of elements. Shares of a container's text from which a name doesn't exclude, and weights of a kind's slots.
PLAIN, CONTENT, ASIDE, NAMED, WEAK, ARTICLE, HEADER = range(7)
_UNLESS = {NAMED: 0.8, WEAK: 0.5}
_WEIGHT = {ASIDE: 0.0, NAMED: 0.1, WEAK: 0.3, HEADER: 0.1, ARTICLE: 2.0}
#: The share of its parent's slots with which an element leads on, that of all slots below which it doesn't, and that of
#: its own text with which a container is the one.
_LEADS, _LEAST, _OWN = 0.6, 0.5, 0.1


@dataclass(frozen=True)
class Deduction:
    """least_pages: distinct ones of a host, for a template. structure_share: of the host's distinct pages that hold a
    token of a class of elements; since a page holds finitely many, these are few. text_share, text_bodies, text_pages:
    for a block of text to count as template, wherever it stands, the share of distinct pages and the least number of
    distinct bodies that hold it, and the least number of the host's pages. least_tokens: of a valid class.
    """

    least_pages: int = 3
    structure_share: float = 0.5
    text_share: float = 0.9
    text_pages: int = 10
    text_bodies: int = 5
    least_tokens: int = 3


@dataclass(slots=True)
class Node:
    """An element that isn't inline. Its token hangs on the path to it; up is its parent's place in the page's list."""

    up: int
    token: int
    kind: int
    tag: str
    chars: int = 0  # of text in it, at any depth
    linked: int = 0  # of these in links
    places: Counter[str] = field(default_factory=Counter)


@dataclass(slots=True)
class Page:
    """Nodes in page order, the first standing for the page itself, and blocks of text: (node, text)."""

    nodes: list[Node]
    blocks: list[tuple[int, str]]


def number(text: str, seed: int = 0) -> int:
    x = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed % (1 << 64))
    return x - (1 << 64) if x >= 1 << 63 else x


def _kind(tag: str, named: dict[str, str]) -> int:
    if tag in ("body", "html"):
        return PLAIN
    if tag in _ASIDE or named.get("role") in _ASIDE_ROLES:
        return ASIDE
    names = [x for x in f"{named.get('class', '')} {named.get('id', '')}".split() if not x.startswith(_STATES)]
    words = set(re.split(r"[^a-z]+", " ".join(names)))
    if tag in ("article", "main") or named.get("role") in ("main", "article"):
        return NAMED if tag == "article" and words & {"comment", "comments", "reply", "ad", "advert", "promo", "related", "sponsored"} else ARTICLE
    if words & _ASIDE_NAMES:
        return NAMED
    if tag in _TEXT:
        return CONTENT
    if words & _WEAK_NAMES:
        return WEAK
    if tag == "header" or words & {"header", "masthead"}:
        return HEADER
    return CONTENT if tag in _LISTS else PLAIN


def read_page(page: str) -> Page:
    """Elements and blocks of a page. Time and memory are linear in its length, whatever nests or stays open in it: open
    elements are found by their places, of which there are lists by tag, of those that aren't inline, and of those that
    an element of a list may end or stand in. Of the last there are few between two that hold lists."""
    nodes, blocks = [Node(-1, 0, PLAIN, "")], []
    stack: list[tuple[str, int] | None] = []  # open elements and their nodes; None for inline ones closed below others
    open_: defaultdict[str, list[int]] = defaultdict(list)  # their places by tag
    solid: list[int] = []
    ends: list[int] = []
    text: list[str] = []
    linked = 0

    def node() -> int:
        return stack[solid[-1]][1] if solid else 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(html.unescape(piece))
        linked += len(piece) if open_["a"] else 0

    def flush() -> None:
        nonlocal linked
        words = "".join(text).split()
        text.clear()
        if words:
            line = " ".join(words)
            blocks.append((node(), line))
            at = nodes[node()]
            at.chars += len(line)
            at.linked += min(linked, len(line))
        linked = 0

    def close(at: int) -> None:
        flush()
        while len(stack) > at:
            if (last := stack.pop()) is not None:
                open_[last[0]].pop()
        for places in (solid, ends):
            while places and places[-1] >= at:
                places.pop()

    at, last_end = 0, page.rfind(">")
    while at < len(page):
        if at > last_end:  # no tag ends any more
            comment = page.find("<!--", at)
            add(page[at:comment] if comment >= 0 else page[at:])
            break
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if not open_[tag]:
                if tag not in _INLINE:
                    flush()
            elif tag not in _INLINE:
                close(open_[tag][-1])
            elif not solid or solid[-1] < open_[tag][-1]:
                stack[open_[tag].pop()] = None
                while stack and stack[-1] is None:
                    stack.pop()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _INLINE:
            if tag not in _VOID and not attributes.endswith("/"):
                open_[tag].append(len(stack))
                stack.append((tag, node()))
            continue
        flush()
        if solid and stack[solid[-1]][0] == "p":
            close(solid[-1])
        for k in reversed(ends) if tag in _ENDS_ALIKE else ():
            if stack[k][0] in _ENDS_ALIKE[tag]:
                close(k)
                break
            if stack[k][0] in _HOLDS_LISTS:
                break
        named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        up, kind = node(), _kind(tag, named)
        name = tag + "".join(f".{c}" for c in named.get("class", "").split()[:3])
        if kind not in (CONTENT, ARTICLE) and name == tag:
            name = f"{tag}#{nodes[up].places[tag]}"
            nodes[up].places[tag] += 1
        nodes.append(Node(up, number(name, nodes[up].token), kind, tag))
        if tag not in _VOID and not attributes.endswith("/"):
            open_[tag].append(len(stack))
            solid.append(len(stack))
            if tag in _ENDS:
                ends.append(len(stack))
            stack.append((tag, len(nodes) - 1))
    flush()
    for n in reversed(nodes[1:]):
        nodes[n.up].chars += n.chars
        nodes[n.up].linked += n.linked
    return Page(nodes, blocks)


def _first_of_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages of a task with equal host and key, the first."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        new = []
        for row in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), strict=True):
            new.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(new, pa.bool_()))


def tokens_of(page: Page) -> list[tuple[int, bool, int | None, int, int, int, int]]:
    """(token, text, up, times, chars, linked, kind) of a page's elements and blocks; `up` is the token of the element
    around it, chars are those of text in it, with all its occurrences together."""
    found: dict[tuple[int, bool], list] = {}
    for n in page.nodes[1:]:
        row = found.setdefault((n.token, False), [page.nodes[n.up].token if n.up else None, 0, 0, 0, n.kind])
        row[1:4] = row[1] + 1, row[2] + n.chars, row[3] + n.linked
    for at, text in page.blocks:
        up = page.nodes[at].token
        row = found.setdefault((number(text, up), True), [up if at else None, 0, 0, 0, CONTENT])
        row[1:3] = row[1] + 1, row[2] + len(text)
    return [(token, text, *row) for (token, text), row in found.items()]


_TOKENS = "host string, token long, text boolean, up long, vector long, bodies long, chars long, linked long, kind int"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each distinct page; `vector` is a hash of the page and how often it holds the token, `bodies` a bit
    by the hash of the page's text."""
    names = [c.split()[0] for c in _TOKENS.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    for batch in _first_of_copies(batches):
        rows = []
        for host, page, key in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("key").to_pylist(), strict=True):
            read = read_page(page or "")
            aside = _outside(read, 0)
            body = 1 << number("\n".join(t for k, t in read.blocks if not aside[k])) % 63
            rows += [(host, token, text, up, number(str(times), key), body if text else 0, chars, linked, kind) for token, text, up, times, chars, linked, kind in tokens_of(read)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def deduce_templates(pages: DataFrame, how: Deduction = Deduction(), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, members): tokens of valid classes, with the text in them over all distinct pages.

    Occurrence vectors are summed as hashes of (page, count), so a host with very many pages is one row for each token
    and task before the shuffle. Exact copies of a page count once: each task drops its own, so that few meet in one
    task. Tokens of one page alone go before hosts come together. Distinct bodies are counted as bits that their hashes
    set, which may be too few and leaves text in place then.
    """
    page = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("key"))
    distinct = page.mapInArrow(_first_of_copies, "host string, html string, key long").repartition("host", "key")
    tokens = distinct.mapInArrow(_tokens, _TOKENS)
    sums = F.count("*").alias("pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.bit_count(F.bit_or("bodies")).alias("bodies"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    summed = tokens.groupBy("host", "token", "text", "up", "kind").agg(*sums).where(F.col("pages") >= max(1, min(how.least_pages * how.structure_share, 2)))
    sizes = page.groupBy("host").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("all"))
    everywhere = (F.col("rows") >= how.text_pages) & (F.col("bodies") >= how.text_bodies) & (F.col("pages") >= F.ceil(F.col("all") * how.text_share))
    common = summed.join(sizes, "host").where((F.col("all") >= how.least_pages) & F.when(F.col("text"), everywhere).otherwise(F.col("pages") >= F.ceil(F.col("all") * how.structure_share)))
    classes = common.groupBy("host", "vector", "pages", "all").agg(F.collect_list(F.struct("token", "text", "up", "chars", "linked", "kind")).alias("members"))
    # A class for each host and vector holds few tokens: those of half the host's pages or more.
    valid = classes.where((F.size("members") >= how.least_tokens) | (F.col("pages") == F.col("all")) | F.exists("members", lambda x: x["text"]))
    return valid.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("members"))


@dataclass(frozen=True)
class Template:
    """The token of the container of main text, and the tokens of text that is template."""

    container: int
    fixed: frozenset[int]


def template_of(members: list[tuple[int, bool, int | None, int, int, int]]) -> Template:
    """From (token, text, up, chars, linked, kind) of valid classes, of a host or of a single page."""
    inside: dict[int | None, list[tuple]] = defaultdict(list)
    for m in members:
        inside[m[2]].append(m)
    order, todo = [], [None]
    while todo:  # elements whose parents all belong to the template
        at = todo.pop()
        for m in inside[at]:
            order.append(m)
            if not m[1]:
                todo.append(m[0])
    slots = {m[0]: max(0, m[3] - m[4]) for m in order if not m[1]}
    fixed = {m[0]: m[2] for m in order if m[1]}
    length = {m[0]: m[3] for m in order if m[1]}
    taken: Counter[int] = Counter()
    for token, up in fixed.items():
        if up is not None:
            taken[up] += length[token]
    best: dict[int, tuple[int, int]] = {}  # the fullest article inside, by its slots
    for token, text, up, _, _, kind in reversed(order):
        if text:
            continue
        slots[token] = max(0, slots[token] - taken[token])
        if up is not None:
            taken[up] += taken[token]
            inner = max((best.get(token, (0, 0)), (slots[token], token) if kind == ARTICLE else (0, 0)))
            if kind != ASIDE:
                best[up] = max(best.get(up, (0, 0)), inner)
    kinds = {m[0]: m[5] for m in order if not m[1]}
    at, all_, filled = 0, 0, sum(slots[m[0]] * _WEIGHT.get(m[5], 1) for m in inside[None] if not m[1])
    while True:
        if kinds.get(at) == ARTICLE:
            size, token = best.get(at, (0, 0))
            if not size or size < _LEADS * slots[at]:
                break
            at = token
            continue
        below = [(slots[m[0]] * _WEIGHT.get(m[5], 1), m[0]) for m in inside[at or None] if not m[1] and m[5] != CONTENT]
        size, token = max(below, default=(0, 0))
        if at:  # with text of its own, in content or in elements that the template lacks
            own = max(0, slots[at] - sum(slots[m[0]] for m in inside[at] if not m[1] and m[5] != CONTENT))
            filled = own + sum(s for s, _ in below)
            if own > _OWN * filled:
                break
        all_ = max(all_, filled)
        if not size or size < _LEADS * filled or size < _LEAST * all_:
            break
        at = token
    return Template(at, frozenset(fixed))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, container, fixed) from (host, members)."""
    for batch in batches:
        found = [template_of([(m["token"], m["text"], m["up"], m["chars"], m["linked"], m["kind"]) for m in members]) for members in batch.column("members").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([t.container for t in found], pa.int64()), pa.array([sorted(t.fixed) for t in found], pa.list_(pa.int64()))], ["_host", "container", "fixed"])


def _outside(page: Page, container: int) -> list[bool]:
    """For each node, whether text directly in it is not main text: it is outside the container, or in an element in
    the container that its kind excludes. Container 0 is the whole page."""
    nodes = page.nodes
    whole = sum(n.chars for n in nodes[1:] if n.token == container and container) or nodes[0].chars
    inner = bool(container)
    out = [inner] + [True] * (len(nodes) - 1)
    for k, n in enumerate(nodes[1:], 1):
        if container and n.token == container:
            out[k] = False
            inner = inner and n.tag not in ("body", "html")
            continue
        excluded = n.kind == ASIDE or n.kind == HEADER and not inner or n.kind in _UNLESS and n.chars < _UNLESS[n.kind] * whole
        out[k] = out[n.up] or excluded
    return out


def main_text(page: Page, template: Template | None) -> list[str]:
    """The blocks in the slots of the container, and top headings before it."""
    if template is None or not template.container or not any(n.token == template.container for n in page.nodes):
        own = template_of([(token, text, up, chars, linked, kind) for token, text, up, _, chars, linked, kind in tokens_of(page) if not text])
        template = Template(own.container, template.fixed if template else frozenset())
    outside, everywhere = _outside(page, template.container), None
    out, begun = [], False
    for at, text in page.blocks:
        if number(text, page.nodes[at].token) in template.fixed:
            continue
        if not outside[at]:
            out.append(text)
            begun = True
        elif not begun and page.nodes[at].tag == "h1":
            everywhere = everywhere or _outside(page, 0)
            if not everywhere[at]:
                out.append(text)
    return out


def extract_main_text(pages: DataFrame, how: Deduction = Deduction(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by two newlines) and n_chars (code points).

    Templates are deduced over all pages of a host and joined to its pages; a host with very many pages is split by
    Spark in that join, whose other side has one row for the host.

    Null html gives an empty text. A null url, or one without ://, has the empty host like all its kind. Null ids,
    repeated ids and repeated rows pass through row by row; an empty table gives no rows; other columns are not read.
    Pages are read whole, and of any length and depth.
    """
    templates = written(deduce_templates(pages, how, url_col, html_col).mapInArrow(_chosen, "_host string, container long, fixed array<long>"))
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host")).join(templates, "_host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, container, fixed in zip(*(batch.column(c).to_pylist() for c in ("_html", "container", "fixed")), strict=True):
                texts.append("\n\n".join(main_text(read_page(page or ""), None if container is None else Template(container, frozenset(fixed)))))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(url_col), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.select(id_col, url_col, "_html", "container", "fixed").mapInArrow(work, schema_with(pages, [id_col, url_col], "text string, n_chars long"))
