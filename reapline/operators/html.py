"""Stored pages to node rows.

Parsing markup is the one step Spark has no expression for: a small parser turns one
page into its nodes inside ``mapInArrow``.  Everything after it is DataFrame work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content of interest, elements without end tag,
# attributes and class words to keep, and elements kept even when empty.
SKIPPED = frozenset(("script", "style", "noscript", "svg", "path", "head", "meta", "link", "iframe", "br", "hr", "wbr"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
KEPT_ATTRIBUTES = (
    "href", "src", "title", "placeholder", "type", "aria-label", "role", "data-id", "name", "value", "target",
)
CLASS_WORDS = (
    "btn", "nav", "menu", "item", "list", "card", "title", "input", "form", "active", "selected", "search", "link", "banner",
    "main", "footer", "header",
)
STRUCTURAL = frozenset(("div", "main", "section", "article", "header", "footer", "nav", "ul", "ol", "table", "tr", "td"))
UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")

# Which open elements a start tag ends, and the elements that search does not leave.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"td", "th", "button", "table"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}
BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split()
)

NODE_SCHEMA = (
    "page_id bigint, ref string, parent_ref string, ord int, pos int, n_siblings int, depth int, tag string, xpath string, "
    "node_id string, class string, txt string, attrs map<string,string>, ancestors array<string>"
)

RUN_SCHEMA = "hash string, run_no bigint, run_size bigint, run_role string, hidden boolean"
COMPRESSED = "compressed_list"


class _Element:
    __slots__ = ("tag", "attrs", "texts", "children", "parent", "xpath")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.texts, self.children, self.xpath = [], [], ""


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("html", {}, None)
        self.at = self.root

    def _close(self, names, stops) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stops:
            if node.tag in names:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in ("head", "body"):
            self.at = self.root
        if tag in ENDS:
            self._close(*ENDS[tag])
        elif tag in BLOCKS:
            self._close(*ENDS["p"])
        element = _Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        text = data.strip()
        if text:
            self.at.texts.append(text)


def clean_class(value: str | None) -> str | None:
    """Class attribute without utility-class noise."""
    if not value:
        return None
    if len(value) > 50 and value.count(" ") > 4:
        kept = [c for c in value.split(" ") if any(w in c.lower() for w in CLASS_WORDS)]
        return " ".join(kept) or None
    return value


def _paths(root) -> None:
    """Position paths for all elements, anchored at the nearest usable id."""
    root.xpath = "/html"
    stack = [root]
    while stack:
        parent = stack.pop()
        seen = {}
        for child in parent.children:
            seen[child.tag] = seen.get(child.tag, 0) + 1
            own_id = child.attrs.get("id", "")
            if re.fullmatch(r"[a-zA-Z][a-zA-Z0-9_-]*", own_id):
                child.xpath = f'//*[@id="{own_id}"]'
            elif child.tag == "body" and parent is root:
                child.xpath = "/html/body"
            else:
                child.xpath = f"{parent.xpath}/{child.tag}[{seen[child.tag]}]"
            stack.append(child)


def _hidden(element) -> bool:
    """Elements that no reader sees, by attribute or inline style; hidden inputs carry data and stay."""
    if "hidden" in element.attrs or UNSEEN.search(element.attrs.get("style", "")):
        if not (element.tag == "input" and element.attrs.get("type", "").lower() == "hidden"):
            return True
    return element.attrs.get("aria-hidden") == "true" and element.tag not in ("div", "span")


def _own(element):
    """Id, class, text and kept attributes, all of them whole."""
    attrs = {name: element.attrs[name] for name in KEPT_ATTRIBUTES if element.attrs.get(name)}
    return element.attrs.get("id") or None, clean_class(element.attrs.get("class")), " ".join(element.texts) or None, attrs


def _kept(top):
    """(element, own columns, kept children) bottom-up, for any depth; None for what carries nothing."""
    order, stack = [], [top]
    while stack:
        element = stack.pop()
        if element.tag not in SKIPPED and not _hidden(element):
            order.append(element)
            stack.extend(element.children)
    kept = {}
    for element in reversed(order):
        own = _own(element)
        children = [(i, kept[id(c)]) for i, c in enumerate(element.children) if id(c) in kept]
        if any(own) or children or element.tag in STRUCTURAL:
            kept[id(element)] = element, own, children
    return kept.get(id(top))


def _digest(tag, css, kid_tags, input_type) -> str:
    """Fingerprint of an element, equal to the column expression ``groups.shape``."""
    parts = [tag, css, "|".join(kid_tags) if kid_tags else None, input_type if tag == "input" else None]
    return hashlib.md5("_".join(p for p in parts if p is not None).encode()).hexdigest()


def sibling_runs(families, kids, tags, css, kinds, min_size):
    """(hash, run_no, run_size, run_role, hidden) of every element of one tree, children first.

    ``families``: lists of elements without a parent; ``kids``: elements below each one, in
    order; elements are positions in ``tags``, ``css`` and ``kinds``.  A ``skipped`` element
    is a run of its own.
    """
    order, stack = [], [at for family in families for at in family]
    while stack:
        order.append(stack.pop())
        stack.extend(kids[order[-1]])
    hashes, runs = [None] * len(tags), [None] * len(tags)

    def mark(family):
        shown, number, start = [], 0, 0
        while start < len(family):
            first, end = family[start], start + 1
            if tags[first] != "skipped":
                while end < len(family) and tags[family[end]] != "skipped" and hashes[family[end]] == hashes[first]:
                    end += 1
            number, size = number + 1, end - start
            packed = size >= min_size and tags[first] != "skipped"
            for at in family[start:end]:
                runs[at] = number, size, ("first" if at == first else "member") if packed else "single"
            shown.extend([COMPRESSED] if packed else [tags[at] for at in family[start:end]])
            start = end
        return shown

    for at in reversed(order):
        hashes[at] = _digest(tags[at], css[at], mark(kids[at]), kinds[at])
    for family in families:
        mark(family)
    hidden = [runs[at] is not None and runs[at][2] == "member" for at in range(len(tags))]
    for at in order:
        if hidden[at]:
            for kid in kids[at]:
                hidden[kid] = True
    return [(h, *(r or (0, 0, "single")), gone) for h, r, gone in zip(hashes, runs, hidden)]


def compressed_rows(page_id: int, html: str, min_size: int):
    """Node tuples with their runs and the first text at or below each, while the tree is in memory."""
    rows = list(page_rows(page_id, html))
    kids, at_ref = [[] for _ in rows], {}
    for at, row in enumerate(rows):
        at_ref[row[1]] = at
        if row[2] is not None:
            kids[at_ref[row[2]]].append(at)
    kinds = [dict(row[12]).get("type") for row in rows]
    marks = sibling_runs([[0]] if rows else [], kids, [r[7] for r in rows], [r[10] for r in rows], kinds, min_size)
    texts = [row[11] for row in rows]
    for at in range(len(rows) - 1, -1, -1):  # document order: children come after their parent
        texts[at] = texts[at] or next((texts[kid] for kid in kids[at] if texts[kid]), None)
    for row, mark, text in zip(rows, marks, texts):
        yield (*row, *mark, text)


def page_rows(page_id: int, html: str):
    """Node tuples of one page in document order."""
    builder = _TreeBuilder()
    builder.feed(html or "")
    builder.close()
    _paths(builder.root)
    body = next((c for c in builder.root.children if c.tag == "body"), builder.root)
    top = _kept(body)
    if top is None:
        return
    stack = [(top, None, 0, 1, 0, [])]
    number = 0
    while stack:
        (element, (node_id, css, text, attrs), children), parent, pos, total, depth, above = stack.pop()
        number += 1
        ref = f"r{number}"
        yield (
            page_id, ref, parent, number, pos, total, depth, element.tag, element.xpath, node_id, css, text,
            list(attrs.items()), above,
        )
        below = above + [ref]
        for index, kid in reversed(children):
            stack.append((kid, ref, index, len(element.children), depth + 1, below))


_ARROW = pa.schema(
    [
        ("page_id", pa.int64()), ("ref", pa.string()), ("parent_ref", pa.string()), ("ord", pa.int32()), ("pos", pa.int32()),
        ("n_siblings", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("xpath", pa.string()), ("node_id", pa.string()),
        ("class", pa.string()), ("txt", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("ancestors", pa.list_(pa.string())),
    ]
)


_RUNS = [
    ("hash", pa.string()), ("run_no", pa.int64()), ("run_size", pa.int64()), ("run_role", pa.string()), ("hidden", pa.bool_()),
]
_COMPRESSED = pa.schema([*_ARROW, *_RUNS, ("text", pa.string())])


def _parse(
    batches: Iterator[pa.RecordBatch], rows_of=page_rows, schema: pa.Schema = _ARROW, chunk: int = 20_000, pages: int = 64
) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush():
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for start in range(0, batch.num_rows, pages):  # only a few pages at a time as Python texts
            part = batch.slice(start, pages)
            for page_id, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows.extend(rows_of(page_id, html))
                if len(rows) >= chunk:
                    yield flush()
                    rows = []
    if rows:
        yield flush()


def only_closed_references(html) -> Column:
    """Markup in which ``&name`` without a semicolon stays as it is written, where a browser would guess a sign."""
    return F.regexp_replace(html, r"&(?!(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def html_to_nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per kept element of every page.

    Only the two needed columns reach Python; parsing is narrow, so it follows the
    partitions of the input.
    """
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(_parse, NODE_SCHEMA)


def html_to_compressed(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_size: int = 3) -> DataFrame:
    """Nodes as ``groups.compress_siblings`` gives them, marked by the parser itself.

    Runs, what they hide, and ``text`` (own text, else the first one below) come from one
    walk over the tree, so nothing is exchanged, joined or written out.  A page without a
    kept element gives no rows; a null page is an empty one.
    """
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"))
    parse = partial(_parse, rows_of=partial(compressed_rows, min_size=min_size), schema=_COMPRESSED)
    return slim.mapInArrow(lambda batches: parse(batches), f"{NODE_SCHEMA}, {RUN_SCHEMA}, text string")


def sample_children(nodes: DataFrame, head: int = 10, tail: int = 2, minimum: int = 16) -> DataFrame:
    """Long child lists cut to their first and last members, with one row that counts the rest.

    Rows below a left-out child go with it.
    """
    is_long = F.col("n_siblings") >= minimum
    cut = nodes.where(is_long & (F.col("pos") >= head) & (F.col("pos") < F.col("n_siblings") - tail)).select("page_id", "ref")
    below = (
        nodes.select("page_id", "ref", F.explode(F.concat("ancestors", F.array("ref"))).alias("_a"))
        .join(cut.withColumnRenamed("ref", "_a"), ["page_id", "_a"], "left_semi")
        .select("page_id", "ref").distinct()
    )
    kept = nodes.join(below, ["page_id", "ref"], "left_anti").withColumn("skipped", F.lit(None).cast("int"))
    marks = (
        nodes.where(is_long).groupBy("page_id", "parent_ref")
        .agg(F.max("n_siblings").alias("n_siblings"), F.max("depth").alias("depth"), F.first("ancestors").alias("ancestors"))
        .join(below.withColumnRenamed("ref", "parent_ref"), ["page_id", "parent_ref"], "left_anti")
        .select(
            "page_id", "parent_ref", "n_siblings", "depth", "ancestors", F.lit("skipped").alias("tag"), F.lit(head).alias("pos"),
            (F.col("n_siblings") - head - tail).alias("skipped"),
        )
        .where("skipped > 0")
    )
    return kept.unionByName(marks, allowMissingColumns=True)


def page_links(nodes: DataFrame) -> DataFrame:
    """Links of every page with their own text."""
    return nodes.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).select(
        "page_id", "ref", F.col("attrs")["href"].alias("href"), "txt"
    )


def deep_text(nodes: DataFrame) -> DataFrame:
    """Own text of a node, else the first text below it in document order."""
    texts = (
        nodes.where(F.col("txt").isNotNull() & (F.col("txt") != ""))
        .select("page_id", "ord", "txt", F.explode(F.concat("ancestors", F.array("ref"))).alias("_a"))
        .groupBy("page_id", "_a").agg(F.min_by("txt", "ord").alias("text"))
        .withColumnRenamed("_a", "ref")
    )
    return nodes.join(texts, ["page_id", "ref"], "left")


def decode_body(body: Column | str) -> Column:
    """Bytes of a response as text: the encoding that loses fewer characters, UTF-8 first."""
    return F.pandas_udf(_decode, "string")(body)


def _decode(values: pd.Series) -> pd.Series:
    def best(raw):
        if raw is None:
            return None
        texts = [bytes(raw).decode(e, errors="replace") for e in ("utf-8", "gb18030")]
        return min(texts, key=lambda t: t.count("�"))

    return values.map(best)
