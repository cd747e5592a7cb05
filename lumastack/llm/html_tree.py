"""Main text of web pages by site style trees.

The DOMs of a host are merged into one tree of style nodes, in two ways. Pooled nodes are the paths of block elements by label
(tag, class, id, role): each has the pages that hold it, its presentations (sequences of child labels) and its contents (block
texts). Slots are the places of block elements in their parents' presentations (by label and number below parents with more
than ``SEQUENCE`` children): each has its presentations too, with the size of the element's own text in powers of four. Pages
of a host with the same body (all text that may be main text) count as one, so that copies of an article do not lower its
importance.

Importance comes from entropy. Over the m pages of a pooled node, a content that c pages hold has the entropy log c / log m;
the content importance is 1 less the mean of these, the presentation importance the entropy of the presentations over log m,
and the node's importance their mean with ``weight`` on the contents. A slot's presentation importance is measured against 16
equally frequent presentations. A branch is removed, block by block, where
* it is never main text by its tag or name. A name counts only where the element does not hold most of the page's text: an
  element with such a word within a longer name (no-sidebar), or around one article or main element with most of the text, is
  no boilerplate, unless articles elsewhere hold a quarter or more;
* its pooled node is on at least ``min_pages`` pages and of an importance below ``importance``, or its text alone is on as many
  pages of the node and of low importance (1 less its entropy);
* no article or main elements hold most of the text, and its slot looks alike on at least ``min_pages`` pages: short text and
  few presentations (menus, adverts and notices without a name). Headings are exempt, and so are blocks in regions, slots of
  many presentations with blocks inside.
Where article or main elements hold most of the text that is left, the page's text is theirs; else where regions do, theirs;
else all that is left is.

Cases: a null or empty page and one without main text give an empty string; unclosed, crossed and cut tags are closed as
they stand; a null url is a host of its own; repeated rows give a row each and count once; other columns are ignored;
an empty table gives an empty result. Pages of any length and depth are read whole, in memory that grows with their length.
An importance that equals a limit is not below it.
Near copies that differ in few blocks are pages of their own, and the blocks that they share count on each.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import removed, shared_dir, stored

IMPORTANCE, WEIGHT, MIN_PAGES = 0.3, 0.9, 4
REGION, ALIKE, SEQUENCE = 0.45, 0.55, 8
BROADCAST_BYTES, SALTS, NODE_ROWS = 16 << 20, 32, 100_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed values of HTML: elements without content, with raw text, of block layout, and those that end an open paragraph or item.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object select".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# What is never main text, by element and by a word of the class, id or role.
NEVER = set("head nav footer aside form button dialog menu label input".split()) | RAW
NEVER_NAMES = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer masthead menu modal nav navbar navigation newsletter notice pagination popup promo related search share sharing sidebar social sponsor sponsored subscribe toolbar".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def node_id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


class Element:
    """An element of a page. ``kids`` are its child elements and the labels of those without content."""

    __slots__ = ("article", "block", "depth", "exact", "inside", "key", "kids", "label", "main", "named", "never", "parent", "region", "slot", "tag", "tagged", "words")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        names = sorted((a.lower(), b or c or d) for a, b, c, d in _ATTR.findall(attributes)) if attributes else []
        self.tag, self.label, self.kids, self.parent = tag, tag + "".join(f"[{k}={v.strip()}]" for k, v in names), [], parent
        self.depth, self.words, self.block = parent.depth + 1 if parent else 0, 0, tag in BLOCK or not parent
        words = {w.lower() for _, v in names for w in _NAME.findall(v)} if names else set()
        self.inside = tag in MAIN or bool(parent and parent.inside)
        self.article = self if tag in MAIN else parent and parent.article
        self.tagged = bool(parent and parent.tagged) or tag in NEVER or (tag == "header" and not self.inside)
        # the nearest element around, this one included, whose name says that it is never main text, and whether that is a whole name
        self.named = bool(words & NEVER_NAMES) and tag not in ("html", "body")
        self.exact = self.named and any(w.lower() in NEVER_NAMES for _, v in names for w in v.split())
        self.main = self.never = self.region = False
        self.key = self.slot = 0

    def around(self) -> Iterator[Element]:
        e = self
        while e is not None:
            yield e
            e = e.parent


def _clear(blocks: list[tuple]) -> None:
    """Clear the named elements that hold most of the text of ``blocks`` (block element, text, element)."""
    free, total, held = 0, 0, {}
    for _, text, e in blocks:
        if e.tagged:
            continue
        total += len(text)
        named = [n for n in e.around() if n.named]
        if not named and e.inside:
            free += len(text)
        for n in named:
            within = e.article if e.article and e.article.depth > n.depth else None
            if within or not n.exact:
                key = (n, within if n.exact else None)
                held[key] = held.get(key, 0) + len(text)
    for (n, _), size in held.items():
        n.main = n.main or (2 * size > total and 4 * free < total)


def _placed(elements: list[Element]) -> None:
    """Give block elements their keys and slots; an element inside a block shares the block's."""
    for e in elements:  # parents come first
        e.never = e.tagged or (e.named and not e.main) or bool(e.parent and e.parent.never)
        labels = shape(e)
        mark = node_id(" ".join(labels)) if len(labels) <= SEQUENCE else 0
        met: Counter = Counter()
        for i, k in enumerate(e.kids):
            if isinstance(k, Element):
                if k.block:
                    k.key = node_id(f"{e.key}/{k.label}")
                    k.slot = node_id(f"{e.slot}/{mark}:{i}" if mark else f"{e.slot}/{k.label}~{min(met[k.label], 3)}")
                else:
                    k.key, k.slot = e.key, e.slot
                met[k.label] += 1


def shape(e: Element) -> list[str]:
    return [k.label if isinstance(k, Element) else k for k in e.kids]


def parsed(page: str) -> tuple[list[tuple[Element, str, Element]], list[Element]]:
    """Blocks (block element, text, innermost element), in order, and all elements, parents first."""
    root = Element("", "", None)
    stack, elements, blocks, text = [root], [root], [], []
    open_: Counter = Counter()

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                top = next(e for e in reversed(stack) if e.block)
                top.words += block.count(" ") + 1
                blocks.append((top, block, stack[-1]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag] -= 1

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        until = m.start() if m else end
        if until > at:
            text.append(html.unescape(page[at:until]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] if m[2] else m[4]
        if closing:
            if not open_[tag]:
                if tag == "p":
                    flush()
                continue
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
            if any(e.block for e in stack[depth:]):
                flush()
            close(depth)
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("dd", "dt", "li", "option", "td", "th", "tr") or tag in CLOSES:
                ends = CLOSES.get(tag, {"p"})
                if any(open_[t] for t in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in ends:
                            close(i)
                            break
                        if stack[i].tag in BLOCK and stack[i].tag != "p":
                            break
        elif tag == "br":
            text.append(" ")
        attributes = (m[3] if m[2] else m[6]) or ""
        e = Element(tag, attributes, stack[-1])
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            stack[-1].kids.append(e.label)
            continue
        if tag in RAW:
            stack[-1].kids.append(e.label)
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        stack[-1].kids.append(e)
        stack.append(e)
        elements.append(e)
        open_[tag] += 1
    flush()
    _clear(blocks)
    _placed(elements)
    return blocks, elements


def host_of(url: Column) -> Column:
    """The lower-case host of a url, without user, port and brackets; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    return F.lower(F.regexp_replace(host, r"[\[\]]", ""))


# Kinds of rows: a page of a pooled node, its presentations and contents, and the presentations of slots without and with blocks inside.
PAGE, SHAPE, CONTENT, LEAF, INNER = range(5)


def page_rows(page: str) -> set[tuple]:
    """(node, kind, value, size class, label) of a page's style nodes, and last the id of its body, on all of them."""
    blocks, elements = parsed(page)
    body = node_id("\n".join(t for _, t, e in blocks if not e.never))
    out = {(top.key, CONTENT, node_id(t), 0, None, body) for top, t, _ in blocks}
    for e in elements:
        if e.block:
            labels = " ".join(shape(e))
            size = (e.words.bit_length() - 1) // 2 if e.words else -1
            inner = any(isinstance(k, Element) and k.block for k in e.kids)
            out.add((e.key, PAGE, 0, 0, e.label, body))
            out.add((e.key, SHAPE, node_id(labels), 0, None, body))
            out.add((e.slot, INNER if inner else LEAF, node_id(f"{labels} {size}"), size, None, body))
    return out


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set = set()
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            seen.update((host, *row) for row in page_rows(page or ""))
            if len(seen) > NODE_ROWS:
                yield _rows(seen)
                seen = set()
        if seen:
            yield _rows(seen)


def _rows(seen: set) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen, strict=True), types, strict=True)], ["host", "node", "kind", "value", "size", "label", "body"])


def _counted(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, size, label, c): the distinct page bodies that hold each part of a style node."""
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_tree, "host string, node long, kind int, value long, size int, label string, body long").distinct()
    return rows.groupBy("host", "node", "kind", "value", "size", "label").agg(F.count(F.lit(1)).alias("c"))


def style_tree(pages: DataFrame, *, weight: float = WEIGHT) -> DataFrame:
    """The merged trees: (host, node, label, pages, importance) of every pooled style node."""
    return _pooled(_counted(pages), weight)


def _pooled(counted: DataFrame, weight: float) -> DataFrame:
    # of presentations: sum of c log c; of contents: the number of values and the sum of log c
    of = lambda kind, v: F.sum(F.when(F.col("kind") == kind, v))
    nodes = counted.where(F.col("kind") <= CONTENT).groupBy("host", "node").agg(
        F.max("label").alias("label"), of(PAGE, F.col("c")).alias("pages"), of(SHAPE, F.col("c")).alias("shapes"), of(SHAPE, F.col("c") * F.log("c")).alias("shape_logs"),
        of(CONTENT, F.lit(1)).alias("values"), of(CONTENT, F.log("c")).alias("value_logs"),
    )
    size = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    shape_ = F.least((F.log("shapes") - F.col("shape_logs") / F.col("shapes")) / size, F.lit(1.0))
    content = 1 - F.least(F.col("value_logs") / F.col("values") / size, F.lit(1.0))
    both = F.when(F.col("values").isNull(), shape_).otherwise((1 - weight) * shape_ + weight * content)
    return nodes.select("host", "node", "label", "pages", F.when(F.col("pages") < 2, 1.0).otherwise(both).alias("importance"))


def slots(counted: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, size, inner) of every slot; ``size`` is of its own text, 1 from 64 words on."""
    size = F.least(F.log1p(2 * F.pow(F.lit(4.0), F.col("size"))) / F.log(F.lit(65.0)), F.lit(1.0))
    has = F.col("size") >= 0
    rows = counted.where(F.col("kind") >= LEAF).groupBy("host", "node").agg(
        F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("logs"), (F.sum(F.when(has, F.col("c") * size)) / F.sum(F.when(has, F.col("c")))).alias("size"), (F.max("kind") == INNER).alias("inner"),
    )
    entropy = F.log("pages") - F.col("logs") / F.col("pages")
    return rows.select("host", "node", "pages", F.least(entropy / math.log(16), F.lit(1.0)).alias("presentation"), "size", "inner")


def chosen(page: str, low: dict[str, set]) -> str:
    """The main text of a page; ``low`` has the host's nodes, texts, regions and alike slots."""
    blocks, elements = parsed(page)
    left = [(top, t) for top, t, e in blocks if not e.never and top.key not in low["nodes"] and (top.key, node_id(t)) not in low["texts"]]
    inside = [(top, t) for top, t in left if top.inside]
    if 2 * sum(len(t) for _, t in inside) > sum(len(t) for _, t in left):
        return "\n".join(t for _, t in inside)
    for e in elements:
        e.region = bool(e.parent and e.parent.region) or (e.block and e.tag not in ("", "html", "body") and e.slot in low["regions"])
    left = [(top, t) for top, t in left if top.region or top.tag in HEADINGS or top.slot not in low["alike"]]
    inside = [(top, t) for top, t in left if top.region]
    if 2 * sum(len(t) for _, t in inside) > sum(len(t) for _, t in left):
        left = inside
    return "\n".join(t for _, t in left)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, sets = [], {}
        for page, low in zip(batch.column("html").to_pylist(), batch.column("low"), strict=True):
            key = low["id"].as_py() if low.is_valid else None
            if key not in sets:  # a batch has many pages of few hosts
                found = low.as_py() if low.is_valid else {"nodes": (), "texts": (), "regions": (), "alike": ()}
                sets[key] = {k: set(found[k] or ()) for k in ("nodes", "regions", "alike")} | {"texts": {(x["node"], x["value"]) for x in found["texts"] or ()}}
            out.append(chosen(page or "", sets[key]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def verdicts(pages: DataFrame, *, importance: float = IMPORTANCE, weight: float = WEIGHT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, nodes, texts, regions, alike): of each host what its tree says, where it says anything."""
    spark = pages.sparkSession
    path = shared_dir(spark)
    counted = stored(_counted(pages), path)
    nodes = _pooled(counted, weight).where(F.col("pages") >= min_pages)
    texts = counted.where((F.col("kind") == CONTENT) & (F.col("c") >= min_pages)).join(nodes.select("host", "node", "pages"), ["host", "node"])
    texts = texts.where(1 - F.log("c") / F.log("pages") < importance)
    place = slots(counted).where(F.col("pages") >= min_pages)
    alike = F.coalesce(0.3 * F.col("presentation") + 0.7 * F.col("size") < ALIKE, F.lit(False))
    nothing = F.lit(None).cast("long").alias("value")
    rows = nodes.where(F.col("importance") < importance).select("host", "node", nothing, F.lit("nodes").alias("what"))
    rows = rows.union(texts.select("host", "node", "value", F.lit("texts")))
    rows = rows.union(place.where(F.col("inner") & (F.col("presentation") >= REGION)).select("host", "node", nothing, F.lit("regions")))
    rows = rows.union(place.where(~F.col("inner") & alike).select("host", "node", nothing, F.lit("alike")))
    of = lambda what, v: F.collect_list(F.when(F.col("what") == what, v)).alias(what)
    out = rows.groupBy("host").agg(of("nodes", F.col("node")), of("texts", F.struct("node", "value")), of("regions", F.col("node")), of("alike", F.col("node")))
    out = stored(out, shared_dir(spark))
    removed(spark, path)
    return out


def main_texts(pages: DataFrame, *, importance: float = IMPORTANCE, weight: float = WEIGHT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    found = verdicts(pages, importance=importance, weight=weight, min_pages=min_pages)
    lists = ("nodes", "texts", "regions", "alike")
    low = found.select("host", F.struct(F.xxhash64("host").alias("id"), *lists).alias("low"))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    held = found.agg(F.sum(F.length("host") + sum((F.size(c) * (16 if c == "texts" else 8) for c in lists), F.lit(64))).alias("b")).first()["b"] or 0
    if held <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:
        spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(low.withColumn("salt", spread), ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "low").mapInArrow(_texts, pages.select("page_id", "url").schema.simpleString()[7:-1].replace(":", " ") + ", text string, n_chars long")
