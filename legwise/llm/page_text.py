"""Main text of web pages with a site style tree.

The pages of one host are merged: nodes with the same path of tags and classes are one
node of the host's style tree. For each of them two entropies are measured over the
distinct pages that have it, on a scale from 0 to 1: how much the sequence of
its children varies (presentation) and how much its own text varies (content). Their maximum,
blended with the mean of the children, is the importance of the node. A branch
that looks and reads alike on page after page has a low importance and is removed from
every page of the host.

Two rules stand beside the entropies, because menus or adverts may also vary from page
to page. Nodes that declare their part by tag, role or class (navigation, footer, advert,
comments, ...) have importance zero, but a word of class, id or role decides nothing for the page's largest article or
main part and what holds it; and nodes inside an article or main part have
``MARKED`` times their importance, so only what is nearly the same on every page goes there.
What lies outside such a part stays if the tree finds it important. If nothing is left of
a page, the branches removed for low importance come back, those of the marked part first.

A host with fewer than ``FEWEST_PAGES`` different pages has no tree: there a marked part is
read alone, unless the undeclared text outside it is longer, which makes it a teaser.

Defined cases: a null or empty page has an empty text; unclosed, stray and nested tags
are closed as browsers do in simple cases; text without any tag is one block; repeated
pages count once in the entropies and each get their text; a null url is a host of its own;
other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legwise.llm.text import slices, table_batch
from legwise.session import settle

BATCH_ROWS = 200
LOW_IMPORTANCE = 0.2
FEWEST_PAGES = 5
DAMPING = 0.9
MARKED = 2.0
#: A full importance damped this often is below LOW_IMPORTANCE.
LEVELS = math.ceil(math.log(LOW_IMPORTANCE) / math.log(DAMPING))

#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp "
    "small span strike strong sub sup time tt u var wbr".split())
NOT_CONTENT = frozenset(
    "script style noscript template head title nav footer aside form iframe svg canvas object embed applet button "
    "select option datalist input textarea dialog menu audio video map noembed noframes".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
#: Their id is an anchor of the text, not a part of the page.
TEXT_LEVEL = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("ul ol dl table article section main div body html".split())

#: Words in class, id and role that declare a part that is not the article.
NOT_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner banners sponsor sponsored sponsors "
    "promo promos promotion sidebar sidebars menu menus nav navs navbar navigation breadcrumb breadcrumbs "
    "footer footers masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist respond disqus reply replies "
    "share sharing social related recommended recommendations widget widgets pagination pager complementary "
    "contentinfo search searchbox form copyright legal".split())
HEADER_WORDS = frozenset("header headers".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Node:
    """An element with its children, which are elements and texts in page order."""

    tag: str
    label: str = ""
    declared: bool = False
    by_tag: bool = False
    children: list = field(default_factory=list)
    path: int = 0


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Style label of an element, and whether it declares itself as no part of the article."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag, tag in NOT_CONTENT
    found = {k.lower(): html.unescape((v or "").strip("\"'")).lower() for k, v in ATTRIBUTE.findall(attributes)}
    places = ("class", "role") if tag in TEXT_LEVEL else ("class", "id", "role")
    names = NAME.findall(" ".join(found.get(k, "") for k in places))
    away = (tag in NOT_CONTENT or any(n in NOT_CONTENT_WORDS for n in names) or "hidden" in found
            or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", ""))))
    if any(n in HEADER_WORDS for n in names):
        tag_label = "header"
    else:
        tag_label = tag
    return ".".join([tag_label, *NAME.findall(found.get("class", ""))]), away and tag not in ("html", "body")


def parse(page: str | None) -> Node:
    """The element tree of a page."""
    root = Node("#page", "#page")
    stack = [root]
    opened: Counter[str] = Counter()

    def close_to(depth: int) -> None:
        opened.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    at, page = 0, page or ""
    while at < len(page):
        hit = TOKEN.search(page, at)
        if hit is None:
            stack[-1].children.append(page[at:])
            break
        if hit.start() > at:
            stack[-1].children.append(page[at:hit.start()])
        at = hit.end()
        tag = (hit.group(2) or "").lower()
        if not tag:
            if hit.group().startswith("<![CDATA["):
                stack[-1].children.append(hit.group()[9:].removesuffix("]]>"))
            continue
        if hit.group(1):
            if not opened[tag]:  # a stray one
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
            continue
        closing = CLOSED_BY.get(tag, frozenset()) | (frozenset(["p"]) if tag in CLOSES_P else frozenset())
        for depth in range(len(stack) - 1, 0, -1) if any(opened[c] for c in closing) else ():
            if stack[depth].tag in closing:
                close_to(depth)
                break
            if stack[depth].tag in SCOPE:
                break
        label, declared = _describe(tag, hit.group(3))
        node = Node(tag, label, declared, tag in NOT_CONTENT)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>|$", re.I).search(page, at)
            node.children.append(page[at:end.start()])
            at = end.end()
        elif tag not in VOID and not hit.group(3).rstrip().endswith("/"):
            stack.append(node)
            opened[tag] += 1
    _free_largest_main(root)
    return root


def _free_largest_main(root: Node) -> None:
    """Words do not declare away the article or main part with the most text, nor what holds it."""
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, parent, away = todo.pop()
        away = away or node.by_tag
        order.append((node, parent, away))
        todo += [(c, node, away) for c in node.children if isinstance(c, Node)]
    size, above = Counter(), {}
    for node, parent, away in reversed(order):
        above[id(node)] = parent
        if not away:
            size[id(node)] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
            if parent is not None:
                size[id(parent)] += size[id(node)]
    mains = [n for n, _, away in order if n.tag in MAIN and not away]
    node = max(mains, key=lambda n: size[id(n)], default=None)
    while node is not None:
        node.declared = node.by_tag
        node = above[id(node)]


def _paths(root: Node) -> Iterator[tuple[Node, Node | None]]:
    """Elements with their parents, parents first, each with its path hash; no recursion, so depth is no matter."""
    root.path = 1
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, parent = todo.pop()
        if parent is not None:
            node.path = xxhash.xxh64_intdigest(f"{parent.path}/{node.label}") >> 1
        yield node, parent
        todo += [(c, node) for c in reversed(node.children) if isinstance(c, Node)]


def _squash(text: str) -> str:
    return " ".join(html.unescape(text).split())


def style_facts(page: str) -> dict[int, tuple]:
    """path -> (path and nearest ancestors, marked, children's sequence, own text, any text) of a page.

    Repeated siblings are one node; marked is a node inside an article or main part.
    """
    looks, reads = defaultdict(list), defaultdict(list)
    chain: dict[int, list[int]] = {}
    marked: dict[int, bool] = {}
    for node, parent in _paths(parse(page)):
        if node.declared:
            node.children = []
            continue
        chain[node.path] = [node.path, *(chain[parent.path][:LEVELS - 1] if parent else [])]
        marked[node.path] = node.tag in MAIN or parent is not None and marked[parent.path]
        looks[node.path].append(",".join(c.label for c in node.children if isinstance(c, Node)))
        reads[node.path].append(" ".join(_squash(c) for c in node.children if isinstance(c, str)))
    return {k: (chain[k], marked[k], xxhash.xxh64_intdigest("|".join(looks[k])) >> 1,
                xxhash.xxh64_intdigest("|".join(reads[k])) >> 1, any(reads[k])) for k in looks}


def host_of(url):
    """Host of an address, lower-cased; an address without one is its own name."""
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]+)", 1), F.lit(""))),
                      F.lit(""))


def _entropies(facts: DataFrame, column: str, out: str) -> DataFrame:
    """Entropy of ``column`` over the pages of each node, between 0 and 1."""
    keys = ["host", "path"]
    counted = facts.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2("n")).alias("s")).select(
        *keys, "pages", F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), (
            F.log2("pages") - F.col("s") / F.col("pages")) / F.log2("pages"))).otherwise(1.0).alias(out))


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, chain, pages, own) of every undeclared node of the hosts' style trees; the chain goes up from the node.

    The importance of nodes in a marked part is already raised.
    """
    schema = pa.schema([("copy", pa.int64()), ("host", pa.string()), ("path", pa.int64()), ("chain", pa.list_(pa.int64())),
                        ("marked", pa.bool_()), ("look", pa.int64()), ("words", pa.int64()), ("worded", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            rows = [(xxhash.xxh64_intdigest(page) >> 1, host, path, *fact)
                    for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for path, fact in style_facts(page).items()]
            if rows:
                yield table_batch(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

    # exact copies of a page say nothing about the site, so each page counts once
    facts = settle(pages.mapInArrow(
        run, "copy bigint, host string, path bigint, chain array<bigint>, marked boolean, look bigint, "
             "words bigint, worded boolean").distinct())
    looks = _entropies(facts, "look", "look_entropy")
    texts = _entropies(facts.where("worded"), "words", "text_entropy").drop("pages")
    # a path has one chain
    above = facts.groupBy("host", "path", "chain").agg(F.max("marked").alias("marked"))
    entropy = F.greatest("look_entropy", F.coalesce("text_entropy", F.lit(0.0)))
    return looks.join(texts, ["host", "path"], "left").join(above, ["host", "path"]).select(
        "host", "path", "chain", "pages",
        F.when(F.col("marked"), F.least(F.lit(1.0), MARKED * entropy)).otherwise(entropy).alias("own"))


def noise_paths(own: DataFrame, low: float = LOW_IMPORTANCE) -> DataFrame:
    """(host, noise) of every host with a tree: paths whose own importance and whose whole branch's importance are low.

    A branch is as important as its most important node, damped by each level. ``low`` is at
    least ``LOW_IMPORTANCE``, so nodes more than ``LEVELS`` - 1 levels below decide nothing,
    and each node tells its ancestors up to there; the plan does not grow with the depth.
    """
    tree = settle(own)
    told = tree.select("host", "own", F.posexplode("chain").alias("up", "path")).withColumn(
        "worth", F.col("own") * F.pow(F.lit(DAMPING), F.col("up")))
    branch = told.groupBy("host", "path").agg(F.max("worth").alias("branch"))
    often = tree.where(F.col("pages") >= FEWEST_PAGES).select("host", "path")
    # nulls are not collected, so a host whose nodes are all important has an empty list
    return often.join(branch, ["host", "path"]).groupBy("host").agg(
        F.collect_set(F.when(F.col("branch") < low, F.col("path"))).alias("noise"))


def _blocks(root: Node, drop: set[int], inside_main: bool) -> list[str]:
    """Texts of the blocks in page order, without declared and dropped branches."""
    out, current = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if text:
            out.append(text)

    todo: list = [(root, inside_main)]
    while todo:
        item, within = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            current.append(item)
        elif item.declared or item.path in drop or not within and item.label.split(".")[0] == "header":
            flush()
        else:
            block = item.tag not in INLINE
            within = within or item.tag in MAIN
            if block:
                flush()
                todo.append((None, within))
            todo += [(c, within) for c in reversed(item.children)]
    flush()
    return out


def main_text(page: str | None, noise: list[int] | None = None) -> str:
    """The article's text of a page, given the unimportant paths of its host; None is a host without a tree."""
    root = parse(page)
    mains, hidden = [], set()
    for node, parent in _paths(root):
        if parent is not None and (id(parent) in hidden):
            hidden.add(id(node))
        elif node.declared or node.tag in MAIN:
            hidden.add(id(node))  # a main part inside another belongs to the outer one
            if not node.declared:
                mains.append(node)
    whole = _blocks(root, set(noise or ()), False)
    if noise is not None and whole:
        return " ".join(whole)
    marked = [b for m in mains for b in _blocks(m, set(), True)]
    inside, every = sum(map(len, marked)), sum(map(len, whole))
    if marked and (noise is not None or every <= 2 * inside):
        return " ".join(marked)
    return " ".join(whole or _blocks(root, set(), False))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "host", host_of(F.col("url").cast("string")))
    noise = settle(noise_paths(importances(rows.select("host", "html"))))
    joined = rows.join(noise, "host", "left").select("page_id", "url", "html", "noise")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            texts = [main_text(h, n) for h, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield table_batch(schema, page_id=batch.column(0).cast(pa.int64()), url=batch.column(1), text=texts,
                              n_chars=[len(t) for t in texts])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
