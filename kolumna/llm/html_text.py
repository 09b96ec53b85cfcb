"""Main text of web pages: site templates found by counting subtrees per host, plus structural rules.

1. Every element is hashed as a whole subtree (tags, classes and text). Spark counts, per host, the pages on which each
   hash occurs; hosts of very many pages are counted by partial sums, never gathered.
2. A subtree on at least MIN_PAGES pages is template if those are MIN_SHARE of a host's pages, be it a menu, a footer, a
   notice or a box without a telling name. Of what holds running text of its own (it might be an article published
   several times) they must be RUNNING_SHARE. Inside the article only containers without running text can be template
   (see ``CONTAINERS``), at RUNNING_SHARE too.
3. Template subtrees are deleted. What is left of menus, headers, footers, sidebars, notices, adverts, forms, scripts,
   styles and reader comments (on hosts of few pages, or different on each page) goes by tag and name (``left_out``).
4. The text is that of the article (article or main element; without one, the body).

Blocks are joined by line feeds in page order; white space inside a block becomes one space; character references are
decoded. A tag whose quotes do not close makes quotes ordinary characters for the rest of its page.

Null html gives the empty text. A null or unparsable url is a host of its own (the empty one). Page ids may be null or
repeated: every row counts as a page and is extracted on its own. Other columns, whatever their names, are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolumna.llm.common import clean_text, stored

MIN_PAGES, MIN_SHARE, RUNNING_SHARE = 5, 0.01, 0.1
#: Template hashes and hosts that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_HASHES, SALTS = 200_000, 16
# Fixed values of the HTML standard: elements without end tags, elements whose content is not markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas math audio video nav header footer aside form button select option textarea input dialog menu title".split()
)
#: Elements that count as template only when repeated, also inside an article.
CONTAINERS = frozenset("div section ul ol dl table figure details".split())
#: Words in class, id or role that name a part to leave out.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted cookie cookies consent notice notices gdpr popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget toolbar header masthead footer subscribe newsletter signup login"
    " comment comments reply replies respond disqus discussion share sharing social related recommended".split()
)
CLOSES_P = BLOCK - {"body", "html"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


class Node:
    __slots__ = ("tag", "names", "items", "digest", "running")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.names, self.items, self.digest, self.running = tag, names, [], 0, False


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, name of an end tag, name of a start tag, its attributes) of each tag, comment and declaration."""
    at, last, quotes = 0, html.rfind(">"), True
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            yield start, at, "", "", ""
            continue
        if start >= last:  # nothing closes any more
            return
        close = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + close)
        if not name:
            if html.startswith(("<!", "<?"), start):
                at = html.find(">", start) + 1
                yield start, at, "", "", ""
            else:
                at = start + 1
            continue
        end = name.end()
        if close or not quotes:
            end = html.find(">", end)
        else:
            while (stop := _STOP.search(html, end)) and stop.group() != ">":
                end = html.find(stop.group(), stop.end()) + 1
                if not end:
                    stop = None
                    break
            quotes = stop is not None
            end = stop.start() if stop else html.find(">", name.end())
        if end < 0:
            return
        at = end + 1
        yield (start, at, name.group().lower(), "", "") if close else (start, at, "", name.group().lower(), html[name.end() : end])


def parse(html: str) -> Node:
    """A tree of elements and strings; forgiving about end tags as browsers are."""
    root = Node("html")
    stack, at, end = [root], 0, len(html)
    for start, after, close, tag, attrs in tags(html):
        if start < at:  # inside the text of a raw element
            continue
        if start > at:
            stack[-1].items.append(unescape(html[at:start]))
        at = after
        if close:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == close:
                    del stack[i:]
                    break
                if close not in BLOCK and stack[i].tag in BLOCK:  # an inline end tag does not reach out of its block
                    break
        elif tag:
            words = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if "=" in attrs else {}
            names = tuple(re.findall(r"[a-z]+", " ".join(words.get(k, "") for k in ("class", "id", "role")).lower()))
            if words.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs):
                names += ("__hidden",)
            if tag in CLOSES_P:
                open_p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[i].tag in BLOCK), 0)
                if open_p and stack[open_p].tag == "p":
                    del stack[open_p:]
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                like = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, (tag,))
                stop = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"} | ({"tr"} if tag in ("td", "th") else set())
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in like:
                        del stack[i:]
                        break
                    if stack[i].tag in stop:
                        break
            node = Node(tag, names)
            stack[-1].items.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if tag in ("title", "textarea"):
                    node.items.append(html[at : stop.start() if stop else end])
                at = stop.end() if stop else end
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                stack.append(node)
            elif tag not in VOID and tag in BLOCK:
                stack.append(node)
    if at < end:
        stack[-1].items.append(unescape(html[at:]))
    return root


def left_out(node: Node) -> bool:
    return node.tag in DROPPED or "__hidden" in node.names or (node.tag not in ("article", "main", "body", "html") and not PARTS.isdisjoint(node.names))


def hash_tree(root: Node) -> None:
    """Sets, from the leaves up, the hashes of all subtrees (tag, names, what is inside, in order) and ``running``.

    running: whether the element holds text of its own or a paragraph; then it is content, however often it is repeated.
    """
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += [x for x in node.items if isinstance(x, Node)]
    for node in reversed(nodes):
        h = xxhash.xxh64(f"{node.tag} {' '.join(node.names)}")
        for item in node.items:
            if isinstance(item, Node):
                h.update(item.digest.to_bytes(8, "big"))
                node.running = node.running or item.tag != "a" and (item.tag in ("p", "pre", "blockquote") or item.running and item.tag not in CONTAINERS)
            else:
                h.update(_SPACE.sub(" ", item).encode("utf-8", "surrogatepass"))
                node.running = node.running or bool(item.strip())
        node.digest = h.intdigest()


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def candidates(root: Node) -> set[tuple[int, bool]]:
    """Subtrees of a hashed page that may be template: (hash, whether it must recur on many of the host's pages).

    These are blocks outside the article, and containers without running text in it.
    """
    out: set[tuple[int, bool]] = set()
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        for item in node.items:
            if isinstance(item, Node):
                own = item.tag in BLOCK and item.tag not in ("article", "main", "body", "html")
                if own and (not inside or item.tag in CONTAINERS and not item.running):
                    out.add((_signed(item.digest), inside or item.running))
                stack.append((item, inside))
    return out


def text_of(root: Node, template: set[int] = frozenset(), structural: bool = True) -> str:
    """The page's main text without subtrees whose hash is in template and, if structural, without those left out.

    Without structural rules the text is that of the whole body: what templates alone leave.
    """
    unwanted = left_out if structural else lambda node: node.tag in ("head", *RAW)
    tops: list[Node] = []
    stack = [root] if structural else []
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            tops.append(node)
            continue
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and _signed(x.digest) not in template and not left_out(x)]
    blocks, now = [], []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip(" ")
        now.clear()
        if text:
            blocks.append(text)

    work = list(reversed(tops or [root]))
    while work:
        item = work.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            now.append(item)
        elif item.tag == "br":
            now.append(" ")
        elif _signed(item.digest) not in template and not unwanted(item):
            block = item.tag in BLOCK
            if block:
                close()
                work.append(None)
            work += reversed(item.items)
    close()
    return "\n".join(blocks)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, strict, pages) summed over the rows of a batch; hash null: the host's pages."""
    for batch in batches:
        count: dict[tuple, int] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(html)
            hash_tree(root)
            for h, strict in [(None, False), *candidates(root)]:
                count[host, h, strict] = count.get((host, h, strict), 0) + 1
        keys = [list(c) for c in zip(*count)] or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.bool_()), pa.array(list(count.values()), pa.int64())],
            names=["host", "hash", "strict", "pages"],
        )


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, running_share: float = RUNNING_SHARE) -> DataFrame:
    """(host, hashes): the template subtrees of each host that has any. At most 1/min_share times a page's elements each."""
    counts = pages.select("host", "html").mapInArrow(_hashes, "host string, hash long, strict boolean, pages long")
    counts = stored(counts.groupBy("host", "hash").agg(F.sum("pages").alias("pages"), F.max("strict").alias("strict")), "subtrees")
    whole = counts.where("hash is null").select("host", F.col("pages").alias("all_pages"))
    # a host may have very many subtrees: they are dealt out before they meet its number of pages
    whole = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = counts.where(F.col("hash").isNotNull() & (F.col("pages") >= min_pages))
    often = often.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(whole, ["host", "salt"])
    share = F.when(F.col("strict"), F.lit(running_share)).otherwise(F.lit(min_share))
    found = often.where(F.col("pages") >= share * F.col("all_pages"))
    return found.groupBy("host", "salt").agg(F.collect_list("hash").alias("part")).groupBy("host").agg(F.flatten(F.collect_list("part")).alias("hashes"))


def _extract(batches: Iterator[pa.RecordBatch], structural: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            root = parse(html)
            if hashes:
                hash_tree(root)
            texts.append(text_of(root, set(hashes or ()), structural))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, structural: bool = True) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row."""
    rows = pages.select("page_id", "url", F.lower(F.regexp_extract(clean_text(F.col("url")), _HOST, 1)).alias("host"), clean_text(F.col("html")).alias("html"))
    known = templates(rows, min_pages, min_share)
    kind = rows.schema["page_id"].dataType.simpleString()
    known = stored(known, "templates")
    total = known.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    if total <= BROADCAST_HASHES:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:  # a host of very many pages is spread over SALTS tasks
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "hashes")
    out = joined.mapInArrow(lambda it: _extract(it, structural), f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
