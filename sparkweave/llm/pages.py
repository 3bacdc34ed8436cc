"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by the path of their structural elements (tag, id and class from the body down).
For each node of this tree two entropies are taken over the host's pages: that of its presentation (the sequence of
its children's tags) and that of its content (its text), both as shares of their maximum. A node that looks and reads
alike on many pages has low importance; nodes below the threshold are removed from each page with all that is below
them. Nodes that name themselves as menus, headers, footers, sidebars, notices, adverts, forms or comments are removed
too. Where a page marks its main part (article, main), the mark chooses the root of the text: the same verdicts hold
inside it and for it, but they never empty it (a page left without any text keeps its marked parts without verdicts).

Copies of a page (equal html on a host) are one page of the tree, and equal nodes of a page count once, so neither
makes a page's own text look like boilerplate. Groups hold a page's part of a node, so a host with a third of all pages
is no larger a group than others; a node is named by a hash of its whole path.
Null or empty pages give an empty text; a page whose markup ends early is read to its end; repeated rows are pages of
their own; a page without a host in its url belongs to the host "". Other columns are not read.
"""

import hashlib
import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import slices
from .tables import Scratch

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
STRUCTURE = frozenset("body div section article main nav header footer aside form ul ol dl table tbody figure fieldset details dialog menu".split())
NOISE = frozenset("nav footer aside form menu dialog button select option fieldset head".split())
MAIN = frozenset("article main".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|promotion|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|header|masthead|footer|"
    r"comment|comments|disqus|reply|replies|respond|cookie|cookies|consent|gdpr|notice|notices|banner|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|toolbar|pagination)(?:$|[\s_-])",
    re.I,
)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")  # of a page with an open quote
_ATTRIBUTE = re.compile(r"""(id|class|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


@dataclass(frozen=True)
class Params:
    pages: int = 4  # pages of a host with a node, below which it is not judged
    importance: float = 0.3  # nodes below are removed
    nodes: int = 500_000  # removed nodes of all hosts that are broadcast at most; more are joined by a shuffle


class _Node:
    __slots__ = ("tag", "path", "children", "parts", "noise", "main", "within")

    def __init__(self, tag, path, noise, main, within=False):
        self.tag, self.path, self.noise, self.main, self.within = tag, path, noise, main, within or main
        self.children, self.parts = [], []  # tags of children; texts and nodes in page order


def _hash(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:16]


def _parse(page: str) -> _Node:
    """The structural tree of a page; text stands in it with a space for each end of a block."""
    root = _Node("body", "body", False, False)
    stack, at, low, pattern = [root], 0, None, _TAG
    opened: dict[str, int] = {}  # nodes on the stack by tag
    while at < len(page):
        start = page.find("<", at)
        stop = start if start >= 0 else len(page)
        if stop > at:
            stack[-1].parts.append(entities.unescape(page[at:stop]))
        if start < 0:
            break
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (4 if comment else 2))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        found = pattern.match(page, start)
        if not found and (following.isalpha() or following == "/") and pattern is _TAG and _LOOSE.match(page, start):
            pattern = _LOOSE
            found = pattern.match(page, start)
        if not found:
            if following and page.find(">", start) < 0:  # no tag can follow
                stack[-1].parts.append(entities.unescape(page[start:]))
                break
            stack[-1].parts.append("<")
            at = start + 1
            continue
        at, tag = found.end(), found[2].lower()
        here = stack[-1]
        if not found[1]:
            if tag in RAW:
                low = low or page.lower()
                if len(low) != len(page):  # lowering changed lengths: search without it
                    close = re.compile(f"</{tag}", re.I).search(page, at)
                    end = close.start() if close else len(page)
                else:
                    end = low.find(f"</{tag}", at)
                    end = len(page) if end < 0 else end
                at = page.find(">", end) + 1 or len(page)
                here.parts.append(" " if tag not in INLINE else "")
                continue
            if tag == "head":
                node = _Node(tag, here.path, True, False, here.within)
                here.parts.append(node)
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
                continue
            if tag in ("body", "html"):
                while len(stack) > 1 and stack[-1].tag == "head":
                    opened[stack.pop().tag] -= 1
                continue
            if tag not in INLINE:
                here.parts.append(" ")
            here.children.append(tag)
            if (tag in STRUCTURE or tag in NOISE) and not found[3].endswith("/") and tag not in VOID:
                names, hidden, role = [], False, ""
                for m in _ATTRIBUTE.finditer(found[3]):
                    value = m[2] or m[3] or m[4] or ""
                    key = m[1].lower()
                    if key in ("id", "class"):
                        names.append(value)
                    elif key == "role":
                        role = value.lower()
                    elif key == "hidden" and "aria" not in m[0].lower():
                        hidden = True
                name = " ".join(names)
                main = tag in MAIN or role in ("main", "article")
                outside = not here.within
                noise = tag in NOISE or hidden or (tag == "header" and outside) or (bool(NAMES.search(name)) and (not main or "comment" in name.lower())) or role in ("navigation", "banner", "contentinfo", "complementary", "search")
                path = f"{here.path}/{tag}" + (f".{name.strip()}" if name.strip() else "")
                node = _Node(tag, _hash(path), noise, main, here.within)
                here.parts.append(node)
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        else:
            if tag not in INLINE:
                here.parts.append(" ")
            if opened.get(tag):
                while stack[-1].tag != tag:
                    opened[stack.pop().tag] -= 1
                opened[stack.pop().tag] -= 1
    return root


def _text(node: _Node, dropped) -> str:
    out, todo = [], [iter(node.parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, str):
                out.append(part)
                continue
            out.append(" ")
            if not (part.noise or part.path in dropped):
                todo.append(iter(part.parts))
                break
        else:
            todo.pop()
            out.append(" ")
    return "".join(out)


def _mains(root: _Node) -> list[_Node]:
    """The outermost marked parts in page order; those inside them are theirs."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main:
            out.append(node)
        else:
            todo += reversed([p for p in node.parts if not isinstance(p, str) and not p.noise])
    return out


def main_text(page: str, dropped=frozenset()) -> str:
    """The main text of one page, without the host's low-importance nodes (paths)."""
    root = _parse(page or "")
    mains = _mains(root)
    text = " ".join(_text(n, dropped) for n in (mains or [root]) if n.path not in dropped).split()
    if mains and dropped and not text:
        text = " ".join(_text(n, ()) for n in mains).split()
    return " ".join(text)


def nodes_of(page: str) -> list[tuple[str, str, str]]:
    """path, presentation and content of each structural node of a page.

    A node's content is put together from its own texts and the contents of its children, each by its hash, so that
    the work is in proportion to the page, however deep it nests.
    """
    order, todo = [], [_parse(page or "")]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if not isinstance(p, str)]
    out, content = [], {}
    for node in reversed(order):  # children come before their parents
        parts = [" ".join(p.split()) if isinstance(p, str) else content[id(p)] for p in node.parts]
        content[id(node)] = _hash("\n".join(p for p in parts if p)) if any(parts) else ""
        if node.path != "body":
            style = ",".join(t for k, t in enumerate(node.children) if not k or t != node.children[k - 1])
            out.append((node.path, style, content[id(node)]))
    return out


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def style_tree(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """host, path, pages, importance of every node that enough pages of its host have."""

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1)):
                rows = []
                for host, page in zip(batch.column(0).slice(first, last - first).to_pylist(), batch.column(1).slice(first, last - first).to_pylist(), strict=True):
                    own, met = _hash(page), set()
                    for path, style, content in nodes_of(page):
                        rows.append((host, path, _hash(style), _hash(content), own, path not in met))
                        met.add(path)
                if rows:
                    types = (*[pa.string()] * 5, pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "path", "style", "content", "page", "first"])

    seen = pages.select(_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "host string, path string, style string, content string, page string, first boolean")
    # first: the path's first node in its page, so that its sum over a path counts pages
    seen = seen.groupBy("host", "path", "style", "content", "page").agg(F.max("first").cast("long").alias("first"))
    seen = seen.groupBy("host", "path", "style", "content").agg(F.count("*").alias("k"), F.sum("first").alias("pages"))
    seen = Scratch(pages.sparkSession, "styles").put(seen, "seen")

    def entropy(what):
        by = seen.groupBy("host", "path", what).agg(F.sum("k").alias("k"))
        sums = by.groupBy("host", "path").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s"))
        share = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
        return sums.select("host", "path", "m", share.alias(what))

    pages_of = seen.groupBy("host", "path").agg(F.sum("pages").alias("pages"))
    both = entropy("style").drop("m").join(entropy("content").drop("m"), ["host", "path"]).join(pages_of, ["host", "path"])
    return both.where(F.col("pages") >= params.pages).select("host", "path", "pages", F.greatest("style", "content").alias("importance"))


def extract(pages: DataFrame, params: Params = Params(), keep: list[str] | None = None) -> DataFrame:
    """keep columns (default page_id, url) and text of every page (url, html)."""
    keep = ["page_id", "url"] if keep is None else keep
    low = style_tree(pages, params).where(F.col("importance") < params.importance)
    low = Scratch(pages.sparkSession, "low").put(low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("dropped")), "low")
    few = (low.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= params.nodes
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string"

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(len(keep))):
                part = batch.slice(first, last - first)
                texts = [main_text(p, frozenset(d or ())) for p, d in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    source = pages.select(*keep, F.coalesce("html", F.lit("")).alias("__html"), _host(F.col("url")).alias("__host"))
    joined = source.join((F.broadcast(low) if few else low).withColumnRenamed("host", "__host"), "__host", "left")
    return joined.select(*keep, "__html", "dropped").mapInArrow(run, schema)
