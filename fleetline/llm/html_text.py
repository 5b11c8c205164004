"""Main text of web pages by host consensus.

Pages are split into a tree of block containers. Every container of every page gets a score: its text outside links,
less for links, navigation words and forms, more for paragraphs. A container's path is generalised to its tags and
classes, digits and positions left out. Hosts vote: the path whose containers score best over all of a host's pages,
summed in Spark, wins there. Each page is then read again from the containers on its host's winning path, grown to the
whole article around them; a page that has none falls back to its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles and markup never count
as text; names (class, id, role) tell them, as do tags. White space inside a block becomes one space, blocks are joined by two line feeds in page order, character
references are decoded. Names never drop a heading or paragraph, but for adverts; inside an article a name of more words
drops a part only if it is mostly links. Time and memory grow in proportion to a page, whatever its markup.

Defined results: null or empty html gives an empty text; a page without tags is its own text; unclosed and stray tags
are tolerated; a null url is a host of its own (its pages vote together); equal scores go to the longer, then the
alphabetically first path; repeated rows vote once each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import own_name
from fleetline.session import staged

#: Characters of a path that are kept as they are.
LONGEST_PATH = 1000

# ---- tags: fixed values of HTML ----
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
#: Tags whose content is never main text.
_DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select option "
                     "textarea input title menu dialog noembed noframes map audio video figure-nav xmp".split())
#: A new block of these closes an open one of the first set, as browsers do.
_CLOSED_BY = {"p": frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 "
                             "h4 h5 h6 header hr main nav ol p pre section table ul".split()),
              "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
              "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
#: Containers that may hold the main text.
_CONTAINERS = frozenset("body main article section div td center blockquote".split())
#: Words of class, id and role that mark what is not main text, as whole words of the attribute.
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline-nav comment comments "
    "commentlist consent cookie cookies copyright cta disclaimer disqus dropdown feedback footer footnote-nav form gdpr header hidden "
    "login masthead menu menus message-bar modal nav navbar navigation newsletter notice notices notification overlay paging pager "
    "pagination popup popups promo promoted promotion recommended recommendations related replies reply respond search share sharing "
    "shoutbox sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar topbar "
    "trending widget widgets complementary contentinfo".split())
#: Those of them that mark what readers wrote, however much of a page it is.
_READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words of a class that mark parts of an article.
_STORY = frozenset("abstract article body content deck entry headline hentry intro introduction lead lede main post standfirst story "
                   "summary text title".split())

#: Words that say where a part stands or how it looks, not what it is.
_NEUTRAL = frozenset("area articles bar block bottom box button buttons center column container content fixed footer full grid header "
                     "inner item items large left link links list main mobile outer page panel post posts primary right row secondary "
                     "section site small static sticky top wide wrap wrapper".split())
#: Words that mark an advert or the like even on a heading or paragraph.
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion "
                     "cookie cookies gdpr consent".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6".split())

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z][^<>]*+\Z", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^<>]*+)>")
_NAME = re.compile(r"</?[A-Za-z]")
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Open:
    """An open tag, the container that its text goes to, and how many blocks were open before it."""

    tag: str
    node: Node
    blocks: int
    story: bool = False
    #: Ended while blocks inside it were still open.
    ended: bool = False


@dataclass
class Node:
    """A container: what it holds is blocks of text and further containers, in page order."""

    tag: str
    path: str
    parent: Node | None
    dropped: bool
    items: list = field(default_factory=list)
    #: Dropped only for what it holds, see `_settle`.
    doubtful: int = 0
    in_story: bool = False


#: What an element's names say: nothing, perhaps boilerplate (a word inside a compound name with other words, or with words
#: of layout alone), or boilerplate.
CLEAN, DOUBTFUL, LAYOUT, BOILERPLATE = 0, 1, 2, 3


def _named(value: str, slug: bool = False) -> int:
    """A name is boilerplate if it is one of the words, or begins with one and adds only words of layout: `sidebar-left`.

    `content-with-sidebar` and `social-science` are doubtful; as ids (`slug`), which are often made from a heading, they say nothing.
    """
    found = CLEAN
    for w in value.split():
        parts = [p for p in re.split(r"[-_]+|\d+", w) if p]
        known = all(p in _BOILERPLATE or p in _NEUTRAL for p in parts)
        if w in _BOILERPLATE or parts and known and (parts[0] in _BOILERPLATE or parts[-1] in _READERS):
            return BOILERPLATE
        if any(p in _BOILERPLATE for p in parts) and (known or not slug):
            found = max(found, LAYOUT if known else DOUBTFUL)
    return found


def _marks(tag: str, attributes: str, in_story: bool) -> tuple[str, bool, int]:
    """Generalised class of a tag, whether it is hidden, and what its names say."""
    kind, hidden, named = "", False, CLEAN
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "class":
            kind = ".".join(sorted(set(_WORD.findall(value))))
        if name in ("class", "id", "role"):
            if tag in _TEXTUAL:  # only an advert is named on a heading or paragraph
                named = max(named, BOILERPLATE if name != "id" and not _ADVERTS.isdisjoint(value.split()) else CLEAN)
            else:
                words = " ".join(w for w in value.split() if not (in_story and w == "header"))
                named = max(named, _named(words, name == "id"))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return kind, hidden, named


def _settle(nodes: list[Node]) -> None:
    """Decides doubtful containers, outermost first, and drops what is inside dropped ones.

    They go if they hold no more than half of the page's text; inside an article, where a name has words of its own, only if
    they are mostly links.
    """
    if any(n.doubtful in (DOUBTFUL, LAYOUT) for n in nodes):
        sums = _sums(nodes)
        whole = sums[id(nodes[0])][0]
        for node in nodes:
            plain, linked = sums[id(node)]
            node.dropped = node.dropped or node.doubtful != CLEAN and (
                linked > plain if node.in_story and node.doubtful == DOUBTFUL else 2 * plain <= whole)
    for node in nodes:
        node.dropped = node.dropped or node.parent is not None and node.parent.dropped


def parse(page: str, by_name: bool = True) -> tuple[Node, list[Node]]:
    """The page's root and all its containers, outermost first; names drop none if not `by_name`.

    A name never drops html, body, main or an article, but for an article inside another one, which is a comment. A block of text is a list of strings: its text, decoded and cut at inline tags, and the text inside links apart.
    """
    root = Node("#", "", None, False)
    nodes, stack = [root], [Open("#", root, 0)]
    opened: dict[str, list[Open]] = {}
    around: list[Open] = []  # open blocks
    block: list[tuple[str, bool]] = []
    at, links, stories = 0, 0, 0

    def flush() -> None:
        nonlocal block
        node = stack[-1].node
        if block and not node.dropped:  # by itself; containers inside are settled at the end
            text = _SPACE.sub(" ", html_lib.unescape("".join(t for t, _ in block))).strip()
            if text:
                node.items.append((text, sum(len(t) for t, linked in block if linked), sum(len(t) for t, _ in block)))
        block = []

    def close(last: Open) -> None:
        """Ends all that is open from `last` on."""
        nonlocal links, stories
        while True:
            top = stack[-1]
            if top.tag not in _INLINE:
                flush()
                around.pop()
            if not top.ended:
                opened[top.tag].pop()
                links -= top.tag == "a"
            stories -= top.story
            stack.pop()
            if top is last:
                return

    for m in _tokens(page):
        if m.start() > at:
            block.append((page[at:m.start()], links > 0))
        elif m.start() < at:  # inside a raw element
            continue
        at = m.end()
        if m.re is _OTHER:
            if m.group().startswith("<![CDATA["):
                block.append((html_lib.escape(m.group()[9:].removesuffix("]]>")), links > 0))
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                one = opened[tag][-1]
                if tag in _INLINE and len(around) > one.blocks:  # an inline end tag does not close the blocks around it
                    one.ended = True
                    opened[tag].pop()
                    links -= tag == "a"
                else:
                    close(one)
            continue
        if tag == "br":
            block.append((" ", False))
            continue
        if tag not in _INLINE:
            flush()
            # Inline tags left open end with their block.
            while around and tag in _CLOSED_BY.get(around[-1].tag, ()):
                close(around[-1])
        if tag in _VOID or m[3].endswith("/") and tag not in _CONTAINERS and tag not in _RAW:
            continue
        holder = stack[-1].node
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        kind, bad, named = _marks(tag, m[3], stories > 0) if m[3] else ("", False, CLEAN)
        if not by_name or tag in ("html", "body", "main") or tag == "article" and not opened.get("article"):
            named = CLEAN
        bad = bad or named == BOILERPLATE
        # A header is site furniture unless it heads an article or section.
        bad = bad or tag in _DROPPED or tag == "header" and not any(opened.get(t) for t in ("article", "section", "main"))
        node = Node(tag, "", holder, holder.dropped or bad, doubtful=named, in_story=stories > 0)
        if bad or named or tag in _CONTAINERS:
            step = tag + ("." + kind if kind else "")
            node.path = f"{holder.path}/{step}"
            if len(node.path) > LONGEST_PATH:  # a digest keeps equal paths equal
                node.path = "#" + hashlib.sha1(node.path.encode()).hexdigest()
            holder.items.append(node)
            nodes.append(node)
            holder = node
        links += tag == "a"
        one = Open(tag, holder, len(around), story=holder is node and tag != "body" and _is_story(node))
        stories += one.story
        stack.append(one)
        opened.setdefault(tag, []).append(one)
        if tag not in _INLINE:
            around.append(one)
    if at < len(page):
        block.append((page[at:], links > 0))
    flush()
    if len(stack) > 1:
        close(stack[1])
    flush()
    _settle(nodes)
    return root, nodes


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and the like, in order; what is inside raw elements is for the caller to skip.

    A tag that no > ends outside quotes has a quote that is never closed; from there on quotes mean nothing, so that the
    rest of the page is not searched again and again.
    """
    at, quotes = page.find("<"), True
    while at >= 0:
        m = _OTHER.match(page, at)
        if m is None and _NAME.match(page, at):
            m = _TAG.match(page, at) if quotes else None
            if m is None:
                quotes, m = False, _PLAIN_TAG.match(page, at)
        if m is not None:
            yield m
        at = page.find("<", at + 1 if m is None else m.end())


def blocks(node: Node) -> list[str]:
    out, waiting = [], [iter(node.items)]
    while waiting:
        for item in waiting[-1]:
            if isinstance(item, Node):
                if not item.dropped:
                    waiting.append(iter(item.items))
                    break
            else:
                out.append(item[0])
        else:
            waiting.pop()
    return out


def scores(nodes: list[Node]) -> dict[str, float]:
    """Score by path: characters of a container's own blocks outside links, a third of its inner containers' on top.

    Blocks that are mostly links count against their container. Semantic containers count more.
    """
    value: dict[int, float] = {}
    out: dict[str, float] = {}
    for node in reversed(nodes):  # inner containers come after outer ones
        own = 0.0
        for item in node.items:
            if isinstance(item, Node):
                if not item.dropped:
                    own += value[id(item)] / 3
            else:
                _, linked, whole = item
                own += whole - 2 * linked if 2 * linked < whole else -float(linked)
        value[id(node)] = own
        if not node.dropped and node.parent is not None:
            weight = 1.5 if node.tag in ("article", "main") else 1.0
            out[node.path] = out.get(node.path, 0.0) + own * weight
    return out


def _on_path(nodes: list[Node], path: str) -> list[Node]:
    return [n for n in nodes if n.path == path and not n.dropped]


def _sums(nodes: list[Node]) -> dict[int, tuple[int, int]]:
    """Characters outside and inside links, of each container with all that is in it."""
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(nodes):
        plain = linked = 0
        for item in node.items:
            if not isinstance(item, Node):
                plain, linked = plain + item[2] - item[1], linked + item[1]
            elif not item.dropped:
                plain, linked = plain + out[id(item)][0], linked + out[id(item)][1]
        out[id(node)] = plain, linked
    return out


def _is_story(node: Node) -> bool:
    return node.tag in ("article", "main") or not _STORY.isdisjoint(node.path.rpartition("/")[2].split(".")[1:])


def whole_article(nodes: list[Node], chosen: list[Node]) -> list[Node]:
    """The containers that hold the article of which `chosen` are parts, in page order, none inside another.

    An article element is one article. Else the article grows to the container around it, as long as that is not the page,
    has as much text in the chosen parts as beside them (main: any) and is not mostly links beside them. Where it is the
    page, containers beside the article join it if they have text and a class that says that they are parts of one.
    """
    sums = _sums(nodes)
    page = next((n for n in nodes if n.tag == "body"), nodes[0])
    ids = {id(n) for n in chosen}
    tops: dict[int, Node] = {}
    inside: dict[int, int] = {}  # text of chosen parts in each container around them, outer parts counted once
    for node in chosen:
        around, above = node.parent, []
        while around is not None and id(around) not in ids:
            above.append(around)
            around = around.parent
        if around is None:
            for n in above:
                inside[id(n)] = inside.get(id(n), 0) + sums[id(node)][0]
    for node in chosen:
        top, around = node, node
        while around is not None:
            if around.tag == "article":
                top = around
            around = around.parent
        around = top.parent
        while top.tag != "article" and around is not None and around is not page and around.parent is not None and around.tag not in ("html", "body"):
            plain, linked = sums[id(around)]
            own = inside.get(id(around), plain)
            beside, beside_linked = plain - own, linked - sums[id(top)][1]
            is_page = plain == sums[id(page)][0] and not _is_story(around)
            if beside and (is_page or around.tag != "main" and beside > own or 2 * beside_linked > beside):
                break
            if beside or around.tag == "main":
                top = around
            around = around.parent
        tops[id(top)] = top
        if top.tag not in ("article", "main") and _is_story(top) and top.parent is not None:
            for n in top.parent.items:
                if isinstance(n, Node) and not n.dropped and _is_story(n) and sums[id(n)][0] > 2 * sums[id(n)][1]:
                    tops[id(n)] = n

    def covered(node: Node) -> bool:
        around = node.parent
        while around is not None and id(around) not in tops:
            around = around.parent
        return around is not None

    return [n for n in nodes if id(n) in tops and not covered(n)]


def main_text(page: str | None, path: str | None) -> str:
    """Text of the containers on `path`, or of the page's best container, or of the whole page.

    If names leave no text at all, the page is read again without them.
    """
    if not page:
        return ""
    found: list[str] = []
    for by_name in (True, False):
        root, nodes = parse(page, by_name)
        chosen = _on_path(nodes, path) if path else []
        found = [b for n in whole_article(nodes, chosen) for b in blocks(n)]
        if not found:
            own = {p: s for p, s in scores(nodes).items() if s > 0}
            best = max(own, key=lambda p: (own[p], len(p), p), default=None)
            found = [b for n in (whole_article(nodes, _on_path(nodes, best)) if best else [root]) for b in blocks(n)]
        if found:
            break
    return "\n\n".join(found)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the highest sum of scores over the host's pages, each page's score damped.

    Votes are summed per task before the shuffle, so a host with very many pages sends few rows.
    """

    @F.pandas_udf("array<struct<path:string,score:double>>")
    def vote(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda h: [{"path": p, "score": s ** 0.5} for p, s in scores(parse(h)[1]).items() if s > 0])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.explode(vote(F.coalesce(F.col(html_col), F.lit("")))).alias("v"))
    summed = votes.groupBy("host", "v.path").agg(F.sum("v.score").alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("score"), F.desc(F.length("path")), "path")
    return summed.withColumn("place", F.row_number().over(order)).filter("place = 1").select("host", "path")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars`; columns of those names are replaced.

    Winning paths, one for each host, are written and joined: Spark broadcasts them below its size threshold.
    """
    paths = staged(winning_paths(pages, url_col, html_col), "paths")
    host, path, text = (own_name(pages, n) for n in ("_host", "_path", "_text"))

    @F.pandas_udf("string")
    def read(htmls: pd.Series, chosen: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, p) for h, p in zip(htmls, chosen)], dtype=object)

    joined = pages.withColumn(host, host_of(F.col(url_col))).join(
        paths.select(F.col("host").alias(host), F.col("path").alias(path)), host, "left")
    return joined.withColumn(text, read(F.col(html_col), F.col(path))).drop(host, path).withColumns(
        {"text": F.col(text), "n_chars": F.length(text).cast("long")}).drop(text)
