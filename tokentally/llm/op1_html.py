"""HTML extraction by consensus host paths.

Pass 1 parses every page, scores its containers by the text they hold outside
links and boilerplate, and votes with each container's share of the page on its
generalised path (tags and class names from the root, digits made one sign).
Spark sums the votes by host and path and keeps the path with most votes of
each host.  Pass 2 parses every page again and takes the text of all containers
on its host's path; a page without that path uses its own best container.

Skew: a host may hold a third of all pages.  Votes are summed in the tasks
before they are shuffled, and the winners are dealt to the pages under
``SALTS`` salts per host, so no task needs all pages of a host.

Text rules: boilerplate elements (navigation, page headers and footers, asides,
forms, scripts, styles, hidden parts, and class names of adverts, notices,
comments and the like) give nothing; character references are decoded; white
space inside a block becomes one space; blocks are joined by one line end.

Defined cases: null or empty html -> empty text; null or unreadable url -> the
host is empty (such pages vote together); broken markup is read as far as it
goes; repeated pages each give a row; empty tables work; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm import textops

#: Salts under which a host's winning path meets the host's pages.
SALTS = 64
#: A vote of 1.0 in the integer sums (sums don't depend on their order).
VOTE = 1_000_000

# a tag without end gives up at the next "<"; nothing is looked at twice, so broken markup takes linear time
_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|textarea|svg|iframe|object|title)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>\"'<]*+)({_ATTRIBUTES})>"
    r"|<[!?][^<>]*+>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Attributes with or without a value.
_ANY = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?i)hidden|display")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-z]+")

_CONTAINERS = frozenset("html body div section article main td th table tbody tr center span-block header footer nav "
                        "aside form ul ol dl figure blockquote details dialog menu fieldset".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption thead tfoot caption "
                                  "summary legend head option".split())
_JUNK_TAGS = frozenset("nav aside footer form head button select dialog menu canvas audio video".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# Words of class names, ids and roles that mark boilerplate.
_JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription share sharing social related recommended comment "
    "comments respond reply replies disqus discussion widget pagination pager skip search login signup toolbar "
    "contentinfo complementary disclaimer".split())
# Words behind a mark that leave it a mark ("comment-list" is one, "social-science" is none).
_PART_OF = frozenset(
    "area articles bar block body bottom box button buttons card cards container content feed footer form group header "
    "heading holder icon icons inner item items label left link links list main outer panel posts right row section "
    "slot small stories strip text title top unit wrap wrapper".split())
_NOT_JUNK = frozenset("with has no without".split())


#: Longest path that is spelled out; the part above goes into a hash.
PATH_CHARS = 400
# a new one of these ends an open one of those, up to the next container that is not in the way
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"},
         "tr": {"td", "th", "tr"}}
_IMPLIED = frozenset("p li dt dd option".split())


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    path: str
    parent: "Node | None"
    junk: bool
    owner: "Node | None"            # the article or main element around it
    score: float = 0.0
    inside: bool = False


@dataclass(slots=True, eq=False)
class Open:
    """An open element: its container and whether its text is hidden from a line that goes on around it."""
    tag: str
    node: Node
    mute: bool


def _hidden(attributes: str) -> bool:
    """Whether an attribute hides its element; words in other attributes' values don't."""
    if not _HIDDEN.search(attributes):
        return False
    for name, a, b, c in _ANY.findall(attributes):
        name, value = name.lower(), (a or b or c).strip().lower()
        if (name == "hidden" and value != "false" or name == "aria-hidden" and value == "true"
                or name == "style" and _UNSEEN.search(value)):
            return True
    return False


def _junk(tag: str, attributes: str, names: dict[str, str], parent: Node) -> bool:
    if tag in _JUNK_TAGS or (tag == "header" and parent.owner is None):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if _hidden(attributes):
        return True
    return any(map(_marked, " ".join(names.get(k, "") for k in ("class", "id", "role")).lower().split()))


def _marked(name: str) -> bool:
    """Whether a class name, id or role marks boilerplate: its last word that says what, not which part of it."""
    parts = [p for p in _PARTS.split(name) if p]
    if _NOT_JUNK.intersection(parts):
        return False
    while len(parts) > 1 and parts[-1] in _PART_OF and parts[-1] not in _JUNK_WORDS:
        parts.pop()
    return bool(parts) and parts[-1] in _JUNK_WORDS


def _path(above: str, step: str) -> str:
    """Generalised path of an element; of a very deep one the upper part is a hash, so paths stay short."""
    path = f"{above}/{step}"
    if len(path) <= PATH_CHARS:
        return path
    return "#" + hashlib.blake2b(above.encode(), digest_size=8).hexdigest() + f"/{step[:PATH_CHARS // 2]}"


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Containers of a page, and its text blocks outside boilerplate with the container of each."""
    root = Node("", "", None, False, None)
    nodes, found = [root], []
    stack = [Open("", root, False)]
    opened: Counter = Counter()
    # containers end the reach of implied ends: their places, and the open _IMPLIED elements since each
    fence, within = [0], [{}]
    text: list[str] = []
    link, link_chars = 0, 0

    def flush() -> None:
        nonlocal link_chars
        if text:
            block, here = " ".join(html_lib.unescape("".join(text)).split()), stack[-1].node
            if block and not here.junk:
                found.append((here, block))
                weight = max(0, len(block) - 2 * link_chars)
                owner = here.owner or here
                owner.score += weight
                if owner.parent is not None and here.owner is None:
                    owner.parent.score += weight / 2
            text.clear()
        link_chars = 0

    def close(place: int) -> None:
        """End the open elements from this place on."""
        while len(stack) > place:
            tag = stack.pop().tag
            opened[tag] -= 1
            if tag in _CONTAINERS or tag in _JUNK_TAGS:
                within.pop()
                fence.pop()
            elif tag in _IMPLIED:
                within[-1][tag] -= 1

    def implied_end(tag: str) -> None:
        """End the open elements that this start tag ends: what is passed over is ended, so it is passed over once."""
        ends = _ENDS.get(tag, ())
        while True:
            near = within[-1]
            if near.get("p") or any(near.get(t) for t in ends):
                place = len(stack) - 1
                while stack[place].tag != "p" and stack[place].tag not in ends:
                    place -= 1
            elif stack[fence[-1]].tag in ends:
                place = fence[-1]
            else:
                return
            ended = stack[place].tag
            close(place)
            if ended != "p" and tag != "tr":          # behind a p a li may end, behind a cell its row
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not stack[-1].mute:
            piece = page[at:m.start()]
            text.append(piece)
            if link:
                link_chars += len(piece)
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if m.group(2):
            if tag == "a":
                link = max(0, link - 1)
            if block and not stack[-1].mute:
                flush()
            if opened[tag] > 0:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        if tag == "br" and not stack[-1].mute:
            text.append(" ")
        if tag == "a":
            link += 1
        if block:
            if not stack[-1].mute:
                flush()
                link = 0
            implied_end(tag)
        attributes, top = m.group(4), stack[-1]
        if tag in _VOID or attributes.endswith("/"):
            continue
        if not block and not attributes and tag not in _JUNK_TAGS and not opened[tag]:
            continue
        names = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        junk = _junk(tag, attributes, names, top.node)
        if tag in _CONTAINERS or (block and junk):
            classes = ".".join(sorted(set(_DIGITS.sub("0", names.get("class", "")).split())))
            node = Node(tag, _path(top.node.path, tag + (f".{classes}" if classes else "")), top.node,
                        top.node.junk or junk, top.node.owner)
            if tag in ("article", "main") and not node.junk and (node.owner is None or node.owner.tag == "main"):
                node.owner = node
            nodes.append(node)
            stack.append(Open(tag, node, top.mute))
        elif block or junk or opened[tag]:
            # a line goes on around an inline element; one of the same name inside it needs its own end
            stack.append(Open(tag, top.node, top.mute or (junk and not block)))
        else:
            continue
        opened[tag] += 1
        if tag in _CONTAINERS or tag in _JUNK_TAGS:
            fence.append(len(stack) - 1)
            within.append({})
        elif tag in _IMPLIED:
            within[-1][tag] = within[-1].get(tag, 0) + 1
    if not stack[-1].mute:
        text.append(page[at:])
    flush()
    return nodes, found


def votes(page: str) -> dict[str, int]:
    """Share of the page's text under each generalised path, in integer votes."""
    nodes, _ = parse(page)
    by_path: dict[str, float] = defaultdict(float)
    for n in nodes:
        if n.score:
            by_path[n.path] += n.score
    total = sum(by_path.values())
    return {p: round(VOTE * s / total) for p, s in by_path.items()} if total else {}


def extract(page: str, path: str | None) -> tuple[str, bool]:
    """Main text of a page by the host's path, and whether the page has that path."""
    nodes, found = parse(page)
    if not found:
        return "", False
    on_path = path is not None and any(n.path == path and not n.junk for n in nodes)
    blocks = _within(nodes, found, path) if on_path else []
    if not blocks:
        on_path = False
        blocks = _within(nodes, found, max(nodes, key=lambda n: n.score).path)
    return "\n".join(blocks), on_path


def _within(nodes: list[Node], found: list[tuple[Node, str]], path: str) -> list[str]:
    """Blocks in or below the containers of a path (a container comes before what it holds)."""
    for n in nodes:
        n.inside = (n.path == path and not n.junk) or (n.parent is not None and n.parent.inside)
    return [block for n, block in found if n.inside]


def host_of(url):
    """Host part of a url column, lower case, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.chunks(batches, "html"):
        sums: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            for path, n in votes(page or "").items():
                s = sums[(host, path)]
                s[0] += n
                s[1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()),
             pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())],
            names=["host", "path", "votes", "pages"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes, pages): the path that each host's pages agree on."""
    cast = (pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
            .mapInArrow(_vote, "host string, path string, votes long, pages long"))
    sums = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))
    return (sums.groupBy("host").agg(F.max(F.struct("votes", "path", "pages")).alias("best"))
            .select("host", "best.path", "best.votes", "best.pages"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textops.chunks(batches, "html"):
        got = [extract(page or "", path) for page, path in
               zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([g[0] for g in got], pa.string()),
             pa.array([len(g[0]) for g in got], pa.int64()), batch.column("path"),
             pa.array([g[1] for g in got], pa.bool_())],
            names=["page_id", "url", "text", "n_chars", "host_path", "on_host_path"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host_path, on_host_path) of every page."""
    salts = F.explode(F.expr(f"sequence(0, {SALTS - 1})"))
    winners = host_paths(pages).select(F.col("host").alias("h2"), "path", salts.alias("s2"))
    dealt = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
             .withColumn("host", host_of(F.col("url")))
             .withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")))
    return (dealt.join(winners, (F.col("host") == F.col("h2")) & (F.col("salt") == F.col("s2")), "left")
            .select("page_id", "url", "html", "path")
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long, host_path string, "
                                  "on_host_path boolean"))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
