"""HTML extraction by consensus host paths.

Each page's containers are scored by the text they hold outside links and boilerplate, and the page votes
for the generalised path (tags and classes, digits blanked) of its best one. Votes are counted per host in
Spark, and each page is extracted again from the containers on its host's winning path; a page that has
none there, or far less text than in its own best container, is extracted from the latter.

While containers are scored, any word of boilerplate in a class or id lets an element go. In the text of the
chosen containers names say less: headings, paragraphs, list items, cells and the like stay whatever they are
named, and so does what has another word in its name (`related-work`, `share-price`).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body".split())
#: Never part of the main text.
BOILERPLATE = frozenset(
    "nav header footer aside form script style noscript template iframe svg math button input select textarea dialog menu object embed canvas audio video head title map noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids of boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond notice notices notification cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager".split()
)
#: Words beside them that say nothing else.
NEUTRAL = frozenset(
    "box boxes bar bars block blocks wrapper wrap container content area list lists item items inner outer group row column col panel section region zone slot unit holder top bottom left right main site page global primary secondary sticky fixed inline text title link links button buttons btn icon icons logo form field thread threads posts articles stories count load more toggle close js wp fb google dfp gpt amp mobile desktop small large".split()
)
#: Words beside names of what readers wrote.
OF_READERS = frozenset("post entry article user users reader readers blog guest visitor".split())
#: Elements that names say nothing about: they hold the text itself, or all of it.
SPOKEN = frozenset("body html main article h1 h2 h3 h4 h5 h6 hgroup p li pre blockquote dt dd caption figcaption summary tr td th thead tbody tfoot".split())
#: A section with this much text, and few links, isn't left out by its class.
SHORT_SECTION = 300
KEEP_NAMES = frozenset("has no with without is not".split())
#: What closes an open element of the kind on the left when it begins.
CLOSES = {
    "p": BLOCK - {"option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
#: An end tag or a new item doesn't close elements beyond one of these.
WALLS = frozenset("table td th ul ol dl body article section main div aside nav footer header form blockquote".split())

#: Hosts up to which their paths are broadcast (some 10 MB), and parts of a host's pages beyond it.
FEW_HOSTS, SALTS = 50_000, 64

COMMENT_END = re.compile(r"--!?>")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP, EQUALS = re.compile(r"[\s/]*"), re.compile(r"\s*=\s*")
ATTRIBUTE, UNQUOTED = re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
DIGITS = re.compile(r"\d+|[0-9a-f]{8,}")
#: Names of what readers wrote: it is left out even where it is most of a page.
READERS = frozenset("comment comments disqus reply replies respond".split())
#: Elements that an element closes when it begins.
CLOSED_BY: dict[str, list[str]] = {}
for _open, _by in CLOSES.items():
    for _tag in _by:
        CLOSED_BY.setdefault(_tag, []).append(_open)


@dataclass(eq=False)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    dropped: bool = False
    #: Characters of text below, outside boilerplate; those in links.
    text: int = 0
    linked: int = 0


class Tree:
    """Open elements while a page is read. Where elements of a tag stand among them is kept, so nothing walks up a deep nest in vain."""

    def __init__(self) -> None:
        self.open = [Node("html")]
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)

    def cut(self, place: int) -> None:
        """Close all from place on."""
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()
        while self.walls and self.walls[-1] >= place:
            self.walls.pop()

    def begin(self, tag: str, attributes: dict[str, str], stays: bool) -> None:
        # a new item closes the outermost element of its kind on this side of a wall; cells are no walls for rows
        if (kinds := CLOSED_BY.get(tag)) and any(self.places.get(t) for t in kinds):
            wall = next((w for w in reversed(self.walls) if self.open[w].tag not in ("td", "th")), 0)
            found = [p[i] for t in kinds if (p := self.places.get(t)) and (i := bisect_right(p, wall)) < len(p)]
            if found:
                self.cut(min(found))
        node = Node(tag, attributes, self.open[-1])
        self.open[-1].children.append(node)
        if stays:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in WALLS:
                self.walls.append(len(self.open))
            self.open.append(node)

    def end(self, tag: str) -> None:
        places = self.places.get(tag)
        if places and (tag in WALLS or not self.walls or places[-1] > self.walls[-1]):
            self.cut(places[-1])


def _attributes(source: str, at: int, unclosed: set[str]) -> tuple[dict[str, str], bool, int]:
    """A begin tag's attributes from behind its name, whether it ends with a slash, and where it ends (-1 if it doesn't).

    A quote that nothing closes is a character like others; unclosed remembers that, so it is looked for once.
    """
    found: dict[str, str] = {}
    while True:
        gap = GAP.match(source, at)
        at = gap.end()
        if at >= len(source):
            return found, False, -1
        if source[at] == ">":
            return found, gap[0].endswith("/"), at + 1
        name = ATTRIBUTE.match(source, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(source, at):
            at = equals.end()
            quote = source[at : at + 1]
            close = source.find(quote, at + 1) if quote and quote in "\"'" and quote not in unclosed else -1
            if close >= 0:
                at, value = close + 1, source[at + 1 : close]
            else:
                if quote and quote in "\"'":
                    unclosed.add(quote)
                plain = UNQUOTED.match(source, at)
                at, value = plain.end(), plain[0]
        found.setdefault(name[0].lower(), html.unescape(value))


def _end(at: int, size: int, length: int) -> int:
    return length if at < 0 else at + size


def parse(source: str) -> Node:
    """A tree of elements and decoded texts, in one pass; comments go, open elements are closed as browsers roughly do.

    What begins like a tag but doesn't end is text.
    """
    tree, length = Tree(), len(source)
    at = begin = 0
    unclosed: set[str] = set()
    tags_end = False

    def told(until: int) -> None:
        if until > begin:
            tree.text(html.unescape(source[begin:until]))

    while (lt := source.find("<", at)) >= 0:
        at = lt + 1
        after = source[at : at + 1]
        if after == "!" or after == "?":
            told(lt)
            if source.startswith("<!--", lt):
                short = 5 if source.startswith("<!-->", lt) else 6 if source.startswith("<!--->", lt) else 0
                close = None if short else COMMENT_END.search(source, lt + 4)
                at = lt + short if short else close.end() if close else length
            elif source.startswith("<![CDATA[", lt):
                close = source.find("]]>", lt + 9)
                tree.text(source[lt + 9 : close if close >= 0 else length])
                at = _end(close, 3, length)
            else:
                at = _end(source.find(">", at), 1, length)
            begin = at
            continue
        ends = after == "/"
        name = TAG_NAME.match(source, at + ends)
        if not name or tags_end:
            continue
        end = name.end()
        attributes, slash, end = ({}, False, end + 1) if source.startswith(">", end) else _attributes(source, end, unclosed)
        if end < 0:  # so no tag after it ends either
            tags_end = True
            continue
        told(lt)
        at = begin = end
        tag = name[0].lower()
        if ends:
            tree.end(tag)
        elif tag == "html":
            tree.open[0].attributes |= attributes
        elif tag in RAW:
            tree.begin(tag, attributes, False)
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
            at = begin = _end(source.find(">", close.end()), 1, length) if close else length
        else:
            tree.begin(tag, attributes, tag not in VOID and (not slash or tag in CONTAINERS))
    told(length)
    return tree.open[0]


def _named(node: Node, names: frozenset[str] = NAMES) -> bool:
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if parts and parts[0] not in KEEP_NAMES and not names.isdisjoint(parts):
            return True
    return False


def _boilerplate(node: Node) -> bool:
    a = node.attributes
    if node.tag in BOILERPLATE or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    return "style" in a and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.IGNORECASE))


def _by_name(node: Node) -> bool:
    a = node.attributes
    return node.tag not in SPOKEN and bool(a.get("class") or a.get("id")) and _named(node)


def _wholly(name: str, names: frozenset[str], beside: frozenset[str]) -> bool:
    """Whether a class or id has a word of names, and none that says something else."""
    parts = [p.lower() for p in PARTS.findall(name)]
    return not names.isdisjoint(parts) and all(p in NAMES or p in beside for p in parts)


def _out_of_text(node: Node) -> bool:
    """Whether an element's whole class or id names it as boilerplate within a text. A section's id is its heading's anchor, but for readers' comments."""
    named = [*node.attributes.get("class", "").split(), *node.attributes.get("id", "").split()]
    if any(_wholly(x, READERS, NEUTRAL | OF_READERS) for x in named):
        return True
    if node.tag == "section":
        named = node.attributes.get("class", "").split() if node.text <= SHORT_SECTION or node.linked * 2 >= node.text else []
    return any(_wholly(x, NAMES, NEUTRAL) for x in named)


def measure(root: Node) -> list[Node]:
    """Mark boilerplate and count text, bottom up. Returns what is marked by its name alone.

    What holds an article isn't boilerplate by its name alone; nor, on a page without one, what has most of its text, few links and
    nothing that readers wrote.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    by_name = _count(order, frozenset())
    if not any(n.tag in ("article", "main") for n in order):
        named = [n for n in order if n.dropped and n.text and not _boilerplate(n)]
        most = max(named, key=lambda n: n.text - n.linked, default=None)
        if most is not None and most.text > root.text and most.linked * 3 < most.text and not _named(most, READERS):
            by_name = _count(order, frozenset([most]))
    return by_name


def _count(order: list[Node], spared: frozenset[Node]) -> list[Node]:
    holds, by_name = set(), []
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node)]
        if node.tag in ("article", "main") or node in spared or any(c in holds for c in inner):
            holds.add(node)
        kept = node in holds and node.tag not in BOILERPLATE
        never = _boilerplate(node) and not kept
        node.dropped = never or (not kept and _by_name(node))
        if never:
            continue
        if node.dropped:
            by_name.append(node)
        node.text = sum(len(" ".join(c.split())) if isinstance(c, str) else 0 if c.dropped else c.text for c in node.children)
        node.linked = node.text if node.tag == "a" else sum(c.linked for c in inner if not c.dropped)
    return by_name


def step_of(node: Node) -> str:
    """A tag with its classes, digits blanked."""
    names = sorted({DIGITS.sub("N", c).replace(">", "_") for c in node.attributes.get("class", "").split()})
    return ".".join([node.tag.replace(">", "_"), *names])


def path_of(node: Node) -> str:
    """Steps from the body down."""
    steps = []
    while node is not None and node.tag != "html":
        steps.append(step_of(node))
        node = node.parent
    return ">".join(reversed(steps))


def on_path(root: Node, path: str) -> list[Node]:
    """Elements on a path, in page order, outside boilerplate."""
    level = [root]
    for step in path.split(">"):
        level = [c for n in level for c in n.children if isinstance(c, Node) and not c.dropped and step_of(c) == step]
    return level


def containers(root: Node) -> Iterator[tuple[Node, int]]:
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node.dropped:
            continue
        if node.tag in CONTAINERS:
            yield node, depth
        todo += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, Node)]


def score(node: Node, depth: int) -> float:
    """Text outside links, more for what is marked as content, a little more for what lies deeper."""
    worth = {"article": 1.6, "main": 1.3}.get(node.tag, 1.0)
    named = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')} {node.attributes.get('itemprop', '')}".lower()
    if worth == 1.0 and re.search(r"article|content|entry|post|story|main|body", named) and node.tag != "body":
        worth = 1.2
    return max(0, node.text - 2 * node.linked) * worth * 1.03 ** min(depth, 10)


def best_container(root: Node) -> tuple[Node | None, float]:
    found, top = None, 0.0
    for node, depth in containers(root):
        if (s := score(node, depth)) > top:
            found, top = node, s
    return found, top


def blocks(node: Node) -> list[str]:
    """Texts of an element's blocks in page order, white space closed up, empty ones left out."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            now.append(item)
        elif item.tag == "br":
            now.append(" ")
        elif not item.dropped:
            inner = item.children[::-1]
            if item.tag in BLOCK:
                close()
                inner = [None, *inner]
            todo += inner
    close()
    return out


def vote(source: str | None) -> tuple[str | None, float]:
    """The path of a page's best container, and its score."""
    root = parse(source or "")
    measure(root)
    node, s = best_container(root)
    return (path_of(node), s) if node is not None else (None, 0.0)


def extract(source: str | None, winner: str | None) -> str:
    """The text of the containers on the winning path, else of the page's best one, else of the page."""
    root = parse(source or "")
    by_name = measure(root)
    own, _ = best_container(root)
    chosen = [own or root]
    if own is not None and winner:
        found = on_path(root, winner)
        if 2 * sum(n.text for n in found) >= own.text:
            chosen = found
    for node in by_name:
        node.dropped = _out_of_text(node)
    return "\n".join(b for n in chosen for b in blocks(n))


def host_of(url: str = "url"):
    """Lower-case host of a URL column, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _with_winner(slim: DataFrame, winners: DataFrame) -> DataFrame:
    """Pages with their host's path. Few hosts are sent to all tasks; of many, each is sent to SALTS tasks, so no host's pages meet in one."""
    if winners.count() <= FEW_HOSTS:
        return slim.join(F.broadcast(winners), "host", "left")
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)))
    dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(dealt, ["host", "salt"], "left")


def html_extract(pages: DataFrame, source: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars for each row of pages.

    Nulls: a null page is empty and gives an empty text; a page whose URL is null or has no host is taken by
    its own best container; a null key is passed on. Ties of votes go to the larger summed score, then the
    larger path. Repeated rows vote each and give equal results. Other columns are not read. An empty table
    gives an empty result. Pages are taken whole.
    """
    ready(pages.sparkSession)
    slim = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(url).alias("host"))

    @F.arrow_udf("struct<path: string, score: double>")
    def voted(batch: pa.Array) -> pa.Array:
        rows = [vote(x) for x in batch.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], names=["path", "score"])

    @F.arrow_udf("string")
    def extracted(page: pa.Array, winner: pa.Array) -> pa.Array:
        return pa.array([extract(x, w) for x, w in zip(page.to_pylist(), winner.to_pylist(), strict=True)], pa.string())

    votes = slim.filter("host is not null and html is not null").select("host", voted("html").alias("v")).select("host", "v.path", "v.score").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round("score", 3).cast("decimal(30,3)")).alias("s"))
    winners = counted.groupBy("host").agg(F.max(F.struct("n", "s", "path")).alias("w")).select("host", F.col("w.path").alias("winner"))
    done = _with_winner(slim, table(winners, "winners")).select("key", "url", extracted("html", "winner").alias("text"))
    return done.select(F.col("key").alias(key), F.col("url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
