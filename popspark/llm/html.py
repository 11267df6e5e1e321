"""Main text of web pages by site style trees.

The DOMs of one host are merged: elements meet by their path of tags and
classes, and each node of the merged tree holds how often which content and
which child styles occur under it. A content node's importance is the entropy
of its content over the host's pages, a presentation node's that of its child
styles joined with that of its children, both from 0 (the same on every page)
to 1. Branches in which all importance is low go from each page, whether or not
it marks its article, as do elements whose role is none of the article's (menus,
forms, notices, comments and so on).
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .durable import durable

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)>|<[!?/][^>]*>?", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WS = re.compile(r"\s+")
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without article text, whatever the site.
_ASIDE = frozenset("head script style textarea title noscript xmp iframe noembed noframes template nav header footer aside form button select option datalist fieldset dialog menu object svg canvas audio video map figcaption".split()) - {"figcaption"}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_MAIN = frozenset(["article", "main"])
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_OWN_CLOSE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that name something other than the article, in any part of a compound name.
_ROLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|sidebar|widget|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|footer|masthead|topbar|toolbar|comment|comments|disqus|replies|respond|sharing|recommended|newsletter|subscribe|subscription|signup|contentinfo|complementary|copyright)(?:$|[\s_-])|(?:^|\s)hidden(?:$|\s)", re.I)
#: What may follow the word that a name of a page's part is about.
_PARTS = "box|list|links?|buttons?|btn|bar|section|block|area|wrap|wrapper|container|posts?|articles?|stories|items?|unit|slot|form|widget|icons?|thread|notice|banner|consent"
_PART = rf"(?:[_-](?:{_PARTS}|\d+))*(?:$|\s)"
#: Words that compound names of an article's own parts have as well (search-results, side-effects, post-header): whole names only.
_ROLE_WHOLE = re.compile(
    r"(?:^|\s)(?:(?:(?:article|post|page|entry|site|js|main|top|left|right|user|reader)[_-])*(?:alert|side|rail|reply|share|social|related|login|search|skip|tags)|(?:(?:site|page|main|global|top|js)[_-])*header)"
    rf"(?:[_-](?:{_PARTS}|share|social|search|tags|panel|group|row|top|left|right|bottom|inner|to|content|\d+))*(?:$|\s)",
    re.I,
)
#: Whole names of these parts inside an article or main part, where single words of a name may well be the article's.
_ROLE_INSIDE = re.compile(
    r"(?:^|\s)(?:hidden|(?:(?:article|post|page|entry|site|js|user|reader)[_-])*"
    r"(?:ads?|advert|adverts|advertisement|advertising|sponsored|promo|gdpr|cookies?|popup|modal|navbar|navigation|nav|menu|sidebar|breadcrumbs?|pagination|pager"
    r"|comments?|replies|disqus|respond|notices?|banner|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|contentinfo|complementary))" + _PART,
    re.I,
)


#: Elements below one another that have style nodes of their own.
DEEP = 200


def names_of(attrs: str) -> str:
    """The classes, id and role of a tag's attributes, and ``hidden`` where an attribute says so."""
    out = []
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and "true" in value.lower():
            out.append("hidden")
        elif name in ("class", "id", "role"):
            out.append(value)
    return " ".join(out)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return (m[1] if m else "").lower()


class Node:
    __slots__ = ("tag", "style", "skip", "main", "depth")

    def __init__(self, tag: str, style: str, skip: bool, main: bool, depth: int):
        self.tag, self.style, self.skip, self.main, self.depth = tag, style, skip, main, depth


def _end_of(page: str, pos: int, tag: str) -> int | None:
    """Where the element that was opened just before ``pos`` ends; None if it is not closed."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, pos):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """(path, text, role outside the article, inside article or main) of a page's text blocks, in order.

    Unclosed tags end with the page; a closing tag without its opening is
    ignored. Elements below ``DEEP`` others share the style node of the one
    above them; where each begins and ends counts at any depth.
    """
    out: list[tuple[str, str, bool, bool]] = []
    stack = [Node("", "", False, False, 0)]
    opened: Counter = Counter()
    held: list[str] = []
    pos, n = 0, len(page)

    def flush() -> None:
        if held:
            text = _WS.sub(" ", _html.unescape("".join(held))).strip(" ")
            held.clear()
            if text:
                top = stack[-1]
                out.append((top.style, text, top.skip, top.main))

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            held.append(page[pos:])
            break
        if m.start() > pos:
            held.append(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                flush()
                close(k)
            elif tag == "p":
                flush()
            continue
        attrs = m[3] or ""
        names = names_of(attrs) if attrs else ""
        inside = stack[-1].main or tag in _MAIN
        odd = bool(names) and bool(_ROLE_INSIDE.search(names) if inside else _ROLE.search(names) or _ROLE_WHOLE.search(names))
        if tag in _INLINE and not odd:
            if tag == "br":
                held.append("\n")
            continue
        if tag in _INLINE:  # an advert or the like inside a line
            pos = _end_of(page, pos, tag) or pos
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in _VOID:
            flush()
            continue
        flush()
        if tag in _CLOSES_P and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ("td", "th", "button", "object"):
                    break
        elif tag in _OWN_CLOSE and any(opened[x] > 0 for x in _OWN_CLOSE[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _OWN_CLOSE[tag]:
                    close(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
        top = stack[-1]
        first = names.split()[0].lower() if names.split() else ""
        main = top.main or tag in _MAIN or " main " in f" {names} ".lower()
        style = f"{top.style}/{tag}" + (f".{first}" if first else "") if top.depth < DEEP else top.style
        stack.append(Node(tag, style, top.skip or odd or (tag in _ASIDE and not (tag == "header" and top.main)), main, top.depth + 1))
        opened[tag] += 1
    flush()
    return out


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def style_nodes(page: str) -> Iterator[tuple[str, int]]:
    """(path, content digest): content nodes by their text, presentation nodes by their child styles."""
    own: dict[str, list[str]] = {}
    styles: dict[str, list[str]] = {}
    for path, text, _, _ in blocks(page):
        own.setdefault(path, []).append(text)
        while path:
            up = path.rpartition("/")[0]
            kids = styles.setdefault(up, [])
            if not kids or kids[-1] != path:
                kids.append(path)
            path = up
    for path, texts in own.items():
        yield path, _digest("\n".join(texts))
    for path, kids in styles.items():
        yield f"{path} >", _digest("\n".join(kids))


def noisy(tree: dict[str, tuple[float, int, int]], least: float, decay: float = 0.9) -> list[str]:
    """The largest branches ("path >") and the other content nodes ("path") in which all importance is below ``least``.

    ``tree`` has each node's own importance, pages and number of styles. With l
    child styles a presentation node's composite importance is (1 - decay ** l)
    times its own and decay ** l times the mean of its children's, by pages; its
    own text counts as a child.
    """
    nodes = {path.removesuffix(" >") for path in tree}
    kids: dict[str, list[str]] = {path: [] for path in nodes}
    for path in nodes:
        if path:
            kids.setdefault(path.rpartition("/")[0], []).append(path)
    pages, value, low = {}, {}, {}
    for path in sorted(kids, key=lambda x: x.count("/"), reverse=True):
        own, m, styles = tree.get(f"{path} >", (0.0, 0, 0))
        parts = [(value[k], pages[k], low[k]) for k in kids[path]]
        if path in tree:
            parts.append((tree[path][0], tree[path][1], tree[path][0] < least))
        below = sum(v * n for v, n, _ in parts) / max(1, sum(n for _, n, _ in parts))
        pages[path] = max([m, *(n for _, n, _ in parts)])
        value[path] = (1 - decay**styles) * own + decay**styles * below
        low[path] = value[path] < least and all(x for *_, x in parts)
    branches = [f"{path} >" for path in kids if low[path] and not (path and low[path.rpartition("/")[0]])]
    return sorted(branches + [path for path in nodes if path in tree and tree[path][0] < least and not low[path]])


def off(path: str, low: frozenset[str]) -> bool:
    """Whether a block's path is a low content node or in a low branch."""
    if path in low:
        return True
    while path and f"{path} >" not in low:
        path = path.rpartition("/")[0]
    return f"{path} >" in low


def low_branches(pages: DataFrame, prior_pages: float, least: float) -> DataFrame:
    """(host, low): each host's ``noisy`` branches and content nodes.

    A node's own importance is the entropy over its pages, from 0 to 1, as if
    ``prior_pages`` more pages had shown something new each: one page tells
    nothing, and the more pages are alike, the lower it falls.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host = host_of(url)
                for path, digest in style_nodes(page or ""):
                    seen[host, path, digest] += 1
            if seen:
                h, p, d = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(d, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["host", "path", "digest", "n"])

    def branches(table: pa.Table) -> pa.Table:
        path, own, m, styles = (table.column(c).to_pylist() for c in ("path", "own", "m", "styles"))
        return pa.table({"host": table.column("host")[:1], "low": pa.array([noisy(dict(zip(path, zip(own, m, styles))), least)], pa.list_(pa.string()))})

    seen = pages.mapInArrow(nodes, "host string, path string, digest long, n long")
    per = seen.groupBy("host", "path", "digest").agg(F.sum("n").alias("n")).groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log(F.col("n"))).alias("s"), F.count(F.lit(1)).alias("styles"))
    spread = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(F.lit(1.0))
    own = (F.col("m") * spread + prior_pages) / (F.col("m") + prior_pages)
    tree = per.select("host", "path", own.alias("own"), "m", "styles")
    return tree.groupBy("host").applyInArrow(branches, "host string, low array<string>").where(F.size("low") > 0)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", prior_pages: float = 2.0, least: float = 0.2, broadcast_paths: int = 1_000_000) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    Blocks are joined in page order by a blank line; references are decoded and
    white space inside a block is one space. Where a page marks its article or
    main part, that is where text is taken. Of that, or of all blocks where there
    is no mark, low branches go; a page of which nothing were left, as a copy of
    most of its host's pages, keeps them. Null, empty or textless pages give an empty text; a
    null url is a host of its own; an empty table gives no rows; repeated rows
    give a row each; other columns are not read.
    """
    src = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    low = durable(low_branches(src.select("u", "h"), prior_pages, least))
    small = (low.agg(F.sum(F.size("low"))).collect()[0][0] or 0) <= broadcast_paths
    url_host = F.lower(F.regexp_extract(F.coalesce("u", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = src.withColumn("host_", url_host).join(F.broadcast(low) if small else low, F.col("host_") == F.col("host"), "left").select("k", "u", "h", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sets = [], {}
            for page, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                low = sets.setdefault(tuple(low), frozenset(low)) if low else None
                found = [x for x in blocks(page or "") if not x[2]]
                if any(x[3] for x in found):
                    found = [x for x in found if x[3]]
                if low:
                    found = [x for x in found if not off(x[0], low)] or found
                texts.append("\n\n".join(x[1] for x in found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["k", "u", "text", "n_chars"])

    kinds = {c: src.schema[c].dataType.simpleString() for c in ("k", "u")}
    return joined.mapInArrow(run, f"k {kinds['k']}, u {kinds['u']}, text string, n_chars long").withColumnsRenamed({"k": id_col, "u": url_col})
