"""Main text of web pages by scoring the element tree.

Paragraphs pass points for length and commas to their ancestors (parent in full, less with distance);
a container's points are discounted by its link density; the best container is kept with those
siblings that score or read like it; a container inside ``article``, ``main`` or an element named like
content gives way to that element. Menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out wherever they stand.

A class or id is evidence, not proof: words that state what a page has (``has-sidebar``, ``comments-open``)
say nothing, and an element whose names speak both for and against it, or that wraps a heading, ``main``
or ``article``, is in doubt. Doubtful elements are scored like any; one that neither holds the best container
nor half as much text as it goes.

Defined results: null or empty html, and pages without text, give an empty text; broken markup is
parsed as far as it goes (unclosed elements end where their parent ends); nothing is capped; repeated
rows give repeated results; an empty table gives an empty result; extra columns are carried along
unless their name is that of an output column.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sozgar.llm.common import bound_batches, boxed, slices, unboxed
from sozgar.llm.common import column as by_name

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table"), "option": ("option", "select datalist"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - frozenset("body html caption legend li dd dt td th tr tbody thead tfoot option optgroup summary".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg math object embed canvas dialog menu title head".split())
ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar tablist status".split())
# Parts of class and id names that mark what is not the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
GOOD = frozenset("article articlebody body content entry entrycontent main post postcontent story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
#: An attribute's name and value in turn, so that nothing inside a value is taken for a name.
ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# First and last parts of names that tell a state of the page, not what the element is.
STATE_FIRST, STATE_LAST = frozenset("has with no not without".split()), frozenset("open closed enabled disabled allowed off on".split())
REPLIES = frozenset("comment comments commentlist disqus reply replies respond".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
NAMED = 15.0
WORTH = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "li": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0}


class Node:
    __slots__ = ("tag", "noise", "doubt", "sure", "weight", "parent", "children", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, doubt: bool = False, sure: bool = False, weight: float = 0.0):
        self.tag, self.parent, self.noise, self.doubt, self.sure, self.weight = tag, parent, noise, doubt, sure, weight
        self.children: list[Node | str] = []
        self.score, self.chars, self.linked = 0.0, 0, 0


def named(value: str) -> tuple[set[str], bool, bool, bool]:
    """Of the names in a class or id: the words against it, whether a name speaks for it, against it, and both at once."""
    against: set[str] = set()
    good = bad = both = False
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not parts or (len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST)):
            continue
        for_it, words = not GOOD.isdisjoint(parts), NOISE.intersection(parts)
        if for_it:
            words -= {"header"}  # the head of an article, a post, an entry
        good |= for_it and not words
        bad |= bool(words) and not for_it
        both |= bool(words) and for_it
        against |= words
    return against, good, bad, both


def traits(tag: str, attrs: str) -> tuple[bool, bool, bool, float]:
    """Whether an element is left out, whether that is in doubt, whether no wrapped heading can change it, and what it adds to its score."""
    noise, weight = tag in DROPPED, WORTH.get(tag, 0.0)
    if not attrs or attrs.isspace():
        return noise, False, noise and tag != "form", weight
    found: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(attrs):
        found.setdefault(name.lower(), a or b or c)
    noise |= "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    noise |= not ROLES.isdisjoint(found.get("role", "").lower().split())
    style = "".join(found.get("style", "").lower().split())
    noise |= "display:none" in style or "visibility:hidden" in style
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if noise or names == " " or tag in ("html", "body", "main"):
        return noise, False, noise and tag != "form", weight
    against, good, bad, both = named(names)
    if tag == "article" and not against & REPLIES:
        bad = both = False
    if good and not bad and not both:
        weight += NAMED
    noise = bad and not good
    return noise, both or (bad and good), noise and not against.isdisjoint(REPLIES), weight


def parse(text: str) -> Node:
    root = Node("#root", None)
    at, here, end = 0, root, len(text)
    lower = None
    while at < end:
        m = TOKEN.search(text, at)
        if m is None:
            here.children.append(text[at:])
            break
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            here.children.append(html.escape(m["cdata"]))
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            node = here
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table") and tag not in BLOCK:
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = node.parent
            elif tag == "br":
                here.children.append(Node("br", here))
            continue
        if tag not in IN_HEAD:
            node = here
            while node is not root and node.tag != "head":
                node = node.parent
            if node is not root:  # only a few elements can stand in a head; any other ends it
                here = node.parent
        if tag in CLOSES:
            closing, scope = CLOSES[tag]
            node = here
            while node is not root and node.tag not in scope:
                if node.tag in closing:
                    here = node.parent
                node = node.parent
        if tag in ENDS_P:
            node = here
            while node is not root and node.tag not in ("td", "th", "li", "button", "div", "article", "section", "body", "blockquote"):
                if node.tag == "p":
                    here = node.parent
                    break
                node = node.parent
        new = Node(tag, here, *traits(tag, m["attrs"]))
        here.children.append(new)
        if tag in RAW:
            if not m["attrs"].endswith("/"):
                lower = text.lower() if lower is None else lower
                close = lower.find("</" + tag, at) if len(lower) == end else -1
                if close < 0:
                    found = re.compile("</" + tag, re.I).search(text, at)
                    close = found.start() if found else (end if tag in ("script", "style") else at)
                gt = text.find(">", close)
                at = (gt + 1 if gt >= 0 else end) if close < end and text.startswith("</", close) else close
        elif tag not in VOID and not m["attrs"].endswith("/"):
            here = new
        elif tag not in VOID and tag in ("p", "div", "a", "b", "i", "span", "article", "section"):
            here = new  # a slash at the end of a start tag means nothing in HTML
    return root


def kept_children(node: Node, in_article: bool):
    for child in node.children:
        if isinstance(child, str) or not (child.noise or (child.tag == "header" and not in_article)):
            yield child


def doubt_wrappers(root: Node) -> None:
    """Elements left out by name alone that hold ``main``, ``article`` or a first heading, and forms that do, are in doubt instead."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.sure:
            continue
        if node.tag in ("main", "article", "h1"):
            up = node.parent
            while up is not None and not (up.tag in ("main", "article") and not up.noise):
                if up.noise:
                    up.noise, up.doubt = False, True
                up = up.parent
        stack.extend(c for c in node.children if not isinstance(c, str))


def measure(root: Node) -> list[Node]:
    """Text and linked characters of every kept element; returns the elements in page order."""
    order, stack = [], [(root, False, False)]
    while stack:
        node, linked, article = stack.pop()
        order.append(node)
        article |= node.tag in ("article", "main")
        linked |= node.tag == "a"
        inner = list(kept_children(node, article))
        for child in inner:
            if isinstance(child, str):
                n = len(" ".join(child.split()))
                node.chars += n
                node.linked += n * linked
        stack.extend((c, linked, article) for c in reversed(inner) if not isinstance(c, str))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return order


def own_text(node: Node) -> str:
    """The text of an element without that of blocks inside it."""
    parts, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.noise and x.tag not in BLOCK:
            parts.append(" " if x.tag == "br" else "")
            stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def blocks(nodes: list[Node], in_article: bool) -> list[str]:
    """Blocks of text in page order, references decoded, white space turned into one space. Links in an article's header go, but for those in headings."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [(top, in_article, False)]
        while stack:
            x, article, head = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                parts.append(x)
            elif x.tag == "br":
                parts.append(" ")
            elif not (head and x.tag == "a"):
                if x.tag in BLOCK or x.tag == "#root":
                    flush()
                    stack.append((None, False, False))
                article = article or x.tag in ("article", "main")
                head = (head or x.tag == "header") and x.tag not in HEADING
                stack.extend((c, article, head) for c in reversed(list(kept_children(x, article))))
        flush()
    return out


def best_nodes(root: Node) -> tuple[list[Node], bool]:
    doubt_wrappers(root)
    order = measure(root)
    scored: dict[int, Node] = {}
    for node in order:
        if node.tag not in ("p", "pre", "td", "blockquote", "li", "div", "section", "article", "dd") or not node.chars:
            continue
        text = own_text(node)
        if not text:
            continue
        points = (1.0 if len(text) >= 25 else 0.2) + text.count(",") + text.count("，") + min(len(text) / 100.0, 3.0)
        up, share = (node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") else node), 1.0
        for depth in range(1, 6):
            if up is None or up.tag == "#root":
                break
            if id(up) not in scored:
                scored[id(up)] = up
                up.score += up.weight
            up.score += points * share
            up, share = up.parent, 1.0 / (2 if depth == 1 else 3 * depth)
    density = lambda n: n.linked / n.chars if n.chars else 0.0
    best = max(scored.values(), key=lambda n: n.score * (1.0 - density(n)), default=None)
    if best is None:
        tops = [n for n in order if n.tag in ("article", "main")] or [n for n in order if n.tag == "body"] or [root]
        return tops[:1], tops[0].tag in ("article", "main")
    inside, above, up = False, {id(best)}, best.parent
    while up is not None:
        above.add(id(up))
        if up.tag in ("article", "main") or (up.weight >= NAMED and up.tag not in ("html", "body")):
            best = up  # the whole of what calls itself the article
        inside |= up.tag in ("article", "main")
        up = up.parent
    inside |= best.tag in ("article", "main")
    for node in order:
        if node.doubt and id(node) not in above and 2 * node.chars < best.chars:
            node.noise = True
    if best.parent is None or best.tag in ("body", "html", "article", "main") or best.weight >= NAMED:
        return [best], inside
    worth = best.score * (1.0 - density(best))
    kept = []
    for sibling in kept_children(best.parent, inside):
        if isinstance(sibling, str):
            continue
        reads = sibling.tag in ("p", "blockquote", "pre") and (density(sibling) < 0.25 if sibling.chars > 80 else density(sibling) == 0 and sibling.chars > 0)
        heads = sibling.tag in HEADING and density(sibling) < 0.5
        scores = id(sibling) in scored and sibling.score * (1.0 - density(sibling)) >= max(4.0, 0.2 * worth)
        if sibling is best or reads or heads or scores:
            kept.append(sibling)
    return kept, inside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, inside = best_nodes(parse(page))
    return "\n\n".join(blocks(nodes, inside))


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) in place of the html column."""
    bound_batches(df.sparkSession)
    carried = df.select(*(by_name(c) for c in df.columns if c not in (column, "text", "n_chars")))
    schema = T.StructType([T.StructField("row", carried.schema), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    found = df.select(boxed(carried), by_name(column).alias("html")).mapInArrow(run, schema)
    return found.select(*unboxed(carried, carried.columns), "text", "n_chars")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
