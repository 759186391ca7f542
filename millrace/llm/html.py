"""HTML extraction with site template removal.

First pass: every page is parsed, the subtrees of its elements are hashed, and
Spark counts for each host on how many different articles' pages a subtree
stands; copies of one page share the heading inside their article, or else its
text, and count once. Second pass: subtrees that recur on ten or more are deleted, with menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments, and
the blocks of text that are left in the article are the page's text.

Inside an article or main element only a box with a class or id and what is made
of links or controls can be a template: a passage, a list, its items, a table or
its rows that many articles share are content.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table, ship_by_value

#: A subtree is a template if it stands on pages of this many articles of its host, however many the host has.
MIN_TITLES = 10
#: Templates are broadcast up to this many hashes; beyond it each page is joined to its own.
MAX_BROADCAST = 200_000

# Element names of the HTML standard, by what they mean here.
DROPPED = frozenset("script style template head title nav footer aside form button select option textarea iframe dialog menu input".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre a abbr b bdi bdo cite code data del dfn em i ins kbd label mark math q s samp small span strong sub sup time u var wbr br img font big tt".split())
#: A start tag of the key closes an open element of these, up to the scope's border.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BORDERS = frozenset("article section div main body html table td th ul ol dl blockquote aside nav header footer form figure".split())
# Names that a class, id or role has for what surrounds an article. A whole name counts (`sidebar`), or one
# whose last part is listed (`site-footer`), or whose first part is and whose others say how it is built (`share-box`);
# a name that begins with a word of the last line tells about a page (`has-sidebar`).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promos promotion promoted related respond search share sharing sidebar skip sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
FIRST_ONLY = frozenset("social".split())
BUILT = frozenset("area bar block body bottom box button buttons column container content footer form group header icons inner item items left link links list main menu nav outer panel posts primary region right row section slot strip text title top unit widget wrap wrapper".split())
# Words that an article may be about: inside one, a compound that ends in one of these, or an id that is one, is believed
# only of what is made of links or controls, or beside another such word (`restaurant-menu` is none, `cookie-notice` is one).
TOPICS = frozenset("banner comment menu newsletter notice notices promotion search share subscription widget widgets".split())
SITE = frozenset("drop footer foot head header main mobile page site top".split())
CONTROLS = frozenset("button input select textarea form option".split())
#: Elements that, with a class or id, are boxes set into an article.
BOXES = frozenset("div section center details address figure".split())
#: Parts of lists and tables; with PROSE, what an article's text is made of and is never judged alone.
PARTS = frozenset("li dt dd tr td th caption figcaption thead tbody tfoot summary".split())
STATES = frozenset("has is no not with without hide hides show shows non un page single".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>?)", re.S)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}
_NAME_PART = re.compile("[a-z0-9]+")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    __slots__ = ("tag", "attributes", "children", "hash", "words", "linked", "control")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.hash = tag, attributes, 0
        self.words = self.linked = 0
        self.control = False
        self.children: list[Node | str] = []


def parse(html: str) -> Node:
    """A tree of elements and texts. Missing end tags are supplied as browsers do for p, li, table parts and options.

    Where the open elements of each name stand is kept, so that time is linear in
    the page whatever is left open.
    """
    root = Node("html", {})
    stack, at, text_at = [root], 0, 0
    places: dict[str, list[int]] = {}
    borders = [0]

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(text)

    def close(place: int) -> None:
        for node in reversed(stack[place:]):
            places[node.tag].pop()
        del stack[place:]
        while borders[-1] >= place:
            borders.pop()

    def last(tag: str) -> int:
        held = places.get(tag)
        return held[-1] if held else 0

    while m := _TAG.search(html, at):
        say(html[text_at : m.start()])
        at = text_at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if place := last(tag):
                close(place)
            continue
        closed = CLOSES.get(tag) or (("p",) if tag in BLOCKS else ())
        if closed and (place := max(map(last, closed))) and place >= borders[-1]:
            close(place)
        attributes = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3].removesuffix(">"))} if len(m[3]) > 1 else {}
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = text_at = end.end() if end else len(html)
        elif tag not in VOID:  # a slash before > means nothing on an HTML element
            places.setdefault(tag, []).append(len(stack))
            if tag in BORDERS:
                borders.append(len(stack))
            stack.append(node)
    say(html[text_at:])
    return root


#: Where an element stands.
OUTSIDE, IN_MAIN, IN_ARTICLE = 0, 1, 2


def walk(root: Node) -> list[tuple[Node, int]]:
    """All elements in page order, each with where it stands: in an article, in a main element, or outside both."""
    found, todo = [], [(root, OUTSIDE)]
    while todo:
        node, inside = todo.pop()
        found.append((node, inside))
        here = IN_ARTICLE if node.tag == "article" else max(inside, IN_MAIN) if is_main(node) else inside
        todo.extend((c, here) for c in reversed(node.children) if isinstance(c, Node))
    return found


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.attributes.get("role") == "main"


def put_hashes(nodes: list[tuple[Node, int]]) -> None:
    """Hashes, words, words in links and controls of all subtrees.

    A hash is over the element's name, its words and the hashes below; attributes and spacing don't count.
    """
    for node, _ in reversed(nodes):
        parts = [node.tag]
        node.words = node.linked = 0
        node.control = node.tag in CONTROLS
        for c in node.children:
            if isinstance(c, Node):
                parts.append(f"\x01{c.hash:x}")
                node.words += c.words
                node.linked += c.linked
                node.control = node.control or c.control
            else:
                found = c.split()
                parts.append("\x02" + " ".join(found))
                node.words += len(found)
        if node.tag == "a" and "href" in node.attributes:
            node.words = max(node.words, 1)  # a picture can be a link
            node.linked = node.words
        node.hash = xxhash.xxh3_64_intdigest("\x00".join(p for p in parts if p != "\x02")) - (1 << 63)


def made_of_links(node: Node) -> bool:
    """Whether a subtree has a control, or half of its words or more are links."""
    return node.control or (node.linked > 0 and 2 * node.linked >= node.words)


def judged(node: Node, inside: int) -> bool:
    """Whether a subtree may be a template.

    Outside articles and main that is anything; inside, a box that has a class or id
    and what is made of links or controls, and no part of a text, a list or a table
    by itself.
    """
    if node.tag in ("html", "body", "head", "article", "main"):
        return False
    if inside == OUTSIDE:
        return True
    named = any(k in node.attributes for k in ("class", "id", "role"))
    if node.tag in PARTS or (node.tag in PROSE and not named):
        return False
    return made_of_links(node) or (named and node.tag in BOXES)


def surrounds(name: str) -> bool:
    """Whether a name of a class, id or role, in small letters, says that its element is no part of an article."""
    if name in MARKS:
        return True
    parts = _NAME_PART.findall(name)
    if len(parts) < 2 or parts[0] in STATES:
        return False
    return parts[-1] in MARKS or ((parts[0] in MARKS or parts[0] in FIRST_ONLY) and all(x in BUILT or x.isdigit() for x in parts[1:]))


def by_name(node: Node, inside: int) -> bool:
    """Whether the element's own name says that it is no part of an article."""
    return node.tag in DROPPED or (node.tag == "header" and inside != IN_ARTICLE)


def doubtful(name: str, is_id: bool) -> bool:
    """Whether a name that marks an element can as well be what an article is about."""
    parts = _NAME_PART.findall(name)
    if len(parts) == 1:
        return is_id and name in TOPICS
    return len(parts) > 1 and parts[-1] in TOPICS and not any(x in MARKS or x in SITE or x in FIRST_ONLY for x in parts[:-1])


def by_attributes(node: Node, inside: int) -> bool:
    """Whether its class, id or role does; a page's whole class is about the page."""
    if not node.attributes or node.tag in ("html", "body"):
        return False
    for k in ("class", "id", "role"):
        for n in node.attributes.get(k, "").lower().split():
            if n == "header" and inside != IN_ARTICLE:
                return True
            if surrounds(n) and (inside == OUTSIDE or not doubtful(n, k == "id") or made_of_links(node)):
                return True
    return False


def main_parts(root: Node) -> tuple[list[Node], set[int]]:
    """(tops, kept): outermost articles, else main elements; ids of them and of what holds them.

    Those that stand in nothing marked come first: with one of them on the page,
    articles in a sidebar or among reader comments are none of its own. Where every
    article is marked or stands in something marked, marks by class or id are not
    believed, so that no class word costs a page its article.
    """

    def found(wanted: Callable[[Node], bool], strict: bool) -> list[tuple[Node, ...]]:
        paths: list[tuple[Node, ...]] = []
        todo: list[tuple[Node, tuple | None]] = [(root, None)]
        while todo:
            node, above = todo.pop()
            # A form can hold a whole page.
            if (by_name(node, OUTSIDE) and node.tag != "form" and not wanted(node)) or (strict and (by_attributes(node, OUTSIDE) or node.tag == "form")):
                continue
            chain = (node, above)
            if wanted(node):
                path = []
                link: tuple | None = chain
                while link:
                    path.append(link[0])
                    link = link[1]
                paths.append(tuple(path))
            else:
                todo.extend((c, chain) for c in reversed(node.children) if isinstance(c, Node))
        return paths

    def is_article(node: Node) -> bool:
        return node.tag == "article"

    for strict in (True, False):
        for wanted in (is_article, is_main):
            if paths := found(wanted, strict):
                return [p[0] for p in paths], {id(n) for p in paths for n in p}
    return [], set()


def title_of(root: Node, url: str) -> str:
    """What tells the page's article from others: the first h1 inside it, else its text, else the page's address.

    A heading outside the article can be the site's name, the same on every page.
    """
    tops, _ = main_parts(root)
    for top in tops:
        for node, _ in walk(top):
            if node.tag == "h1" and (text := " ".join(words_of(node))):
                return text
    return " ".join(w for top in tops or [root] for w in words_of(top)) or url


def words_of(node: Node) -> list[str]:
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found += unescape(x).split()
        else:
            todo.extend(reversed(x.children))
    return found


def extract(root: Node, templates: set[int] | frozenset[int]) -> str:
    """The blocks of the article (else main, else the body) that are left, joined by empty lines."""
    tops, kept = main_parts(root)
    gone = {id(n) for n, inside in walk(root) if id(n) not in kept and (by_name(n, inside) or by_attributes(n, inside) or (n.hash in templates and judged(n, inside)))}
    blocks: list[str] = []
    words: list[str] = []

    def end() -> None:
        if text := " ".join("".join(words).split()):
            blocks.append(text)
        words.clear()

    for top in tops or [root]:
        work: list[Node | str | None] = [top]
        while work:
            x = work.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                words.append(unescape(x))
            elif id(x) in gone:
                if x.tag in BLOCKS:
                    end()
            elif x.tag == "br":
                words.append(" ")
            elif x.tag in BLOCKS:
                end()
                work.append(None)
                work.extend(reversed(x.children))
            else:
                work.extend(reversed(x.children))
        end()
    return "\n\n".join(blocks)


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, hashes, titles = [], [], []
        for host, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = parse(html or "")
            nodes = walk(root)
            put_hashes(nodes)
            title = xxhash.xxh3_64_intdigest(title_of(root, url or "")) - (1 << 63)
            found = {node.hash for node, inside in nodes if judged(node, inside) and node.children}
            hosts += [host] * len(found)
            titles += [title] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(titles, pa.int64())], ["host", "hash", "title"])


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, digests, hashes = [], [], []
        for host, digest, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes = walk(parse(html or ""))
            put_hashes(nodes)
            found = {node.hash for node, inside in nodes if judged(node, inside) and node.children}
            hosts += [host] * len(found)
            digests += [digest] * len(found)
            hashes += found
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.string()), pa.array(hashes, pa.int64())], ["host", "digest", "hash"])


def _extract_pages(shared):
    """Batches of page_id, url, host, html and, where `shared` is None, the page's own templates as packed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing: frozenset[int] = frozenset()
        for batch in batches:
            texts = []
            packed = batch.column(4).to_pylist() if shared is None else None
            for i, (host, html) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if packed is None:
                    templates = shared.value.get(host, nothing)
                else:
                    templates = set(np.frombuffer(packed[i], dtype=">i8").tolist()) if packed[i] else nothing
                root = parse(html or "")
                put_hashes(walk(root))
                texts.append(extract(root, templates))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, *, min_titles: int = MIN_TITLES) -> DataFrame:
    """host, hash of the subtrees that recur.

    Titles are made distinct before they are counted, so the subtree that a hot
    host has on every page reaches one task as partial counts only.
    """
    rows = pages.select("host", "url", "html").mapInArrow(_hash_pages, "host string, hash long, title long")
    counts = rows.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_titles).select("host", "hash")


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = MAX_BROADCAST, **options) -> DataFrame:
    """One row per page: page_id, url, text and its length in code points.

    Null html is empty and gives an empty text; a page without address belongs to
    the host ''; a null id is kept. Repeated pages give repeated results and count
    once for templates. Very long pages are read whole, in linear time. Markup that
    is never closed runs to the end of the page. Extra columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = f"page_id {slim.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    templates = materialize(site_templates(slim, **options), "html-templates")
    if templates.count() <= max_broadcast:
        by_host: dict[str, set[int]] = {}
        for host, h in templates.collect():
            by_host.setdefault(host, set()).add(h)
        return slim.mapInArrow(_extract_pages(spark.sparkContext.broadcast(by_host)), schema)
    # A page is sent the templates that it holds, not all of its host, of which there may be any number.
    own = slim.select("host", F.md5(F.coalesce("html", F.lit(""))).alias("digest"), "html").mapInArrow(_own_hashes, "host string, digest string, hash long")
    packed = own.distinct().join(templates, ["host", "hash"]).groupBy(F.col("host").alias("_host"), F.col("digest").alias("_digest")).agg(F.collect_list("hash").alias("_all"))
    packed = packed.select("_host", "_digest", F.unhex(F.array_join(F.transform("_all", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("packed"))
    joined = slim.join(packed, (F.col("host") == F.col("_host")) & (F.md5(F.coalesce("html", F.lit(""))) == F.col("_digest")), "left")
    return joined.drop("_host", "_digest").mapInArrow(_extract_pages(None), schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


ship_by_value(__name__)
