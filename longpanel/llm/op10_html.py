"""HTML main-text extraction by wrapper induction.

Each page becomes a tree of its block elements; a block holds its lines of text, inline elements and
their text included.  Siblings with one label (tag and class words without digits) share a node, as the
entries of a list do, so the children of a node have distinct labels.  Simple tree matching of two such
trees pairs the nodes that have equal labels under paired parents, without search; all pages of a host
are aligned at once by grouping their nodes by the path of labels.

A text is template if all pages that have its node, ``LEAST_PAGES`` different ones at least, have it
there; everything else is a slot.  The alignment is two aggregations over (host, node, text) hashes,
summed up before each shuffle, so no task holds a host.  Pages that differ only in what markup names as
something else are one page here, since copies of an article prove nothing about a template.

A page's text is that of its slots.  Markup is evidence beside the alignment: navigation, headers,
footers, sidebars, adverts, notices, forms, scripts, styles and reader comments are left out, by tag, by
role or by whole words of class and id; where a page marks its articles, those are the text, in page
order, constant lines of theirs included (an article is not template because three pages carry it).
On a page that marks none, list entries that are nothing but a link are a menu.  Class words never
hide a heading, nor anything in preformatted text, nor the only articles of a page, nor all prose of a page
without any; a form around a whole page does not hide it either.  Character references are decoded in each text node
by itself.

Edge cases: null or empty html gives an empty text.  A null url is a host of its own without name.
Repeated pages count once for a template and keep a result row each.  Unclosed and misnested tags are
closed as their parents end; pages of any length and nesting depth take time in proportion to their
length.  Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Different pages that must agree before a text counts as template.
LEAST_PAGES = 3
#: Template tables up to this many bytes are broadcast; larger ones are joined by host.
BROADCAST_BYTES = 32 << 20

# Fixed names of HTML: elements without end tag, with raw text, that are blocks, and that never hold main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td template tfoot th thead tr ul".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
OUT = set("script style textarea title noscript iframe noembed noframes template head nav header footer aside form button select option input svg canvas object audio video dialog menu search".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words of class and id values that name something other than the article, and words that only place it.
OUT_WORDS = set("ad ads advert advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar aside cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup share sharing social related recommended comment comments reply replies respond disqus pagination pager toolbar widget".split())
PLACE_WORDS = set("site page main top bottom left right global primary secondary list container wrapper wrap inner outer box bar section area block slot banner unit panel item link links sticky fixed thread form".split())
# The head of a compound that names reader comments, and first parts that only say whether there are any.
COMMENTS = re.compile(r"(?:comments?|repl(?:y|ies)|responses)(?:list|area|section|thread|box|wrap|wrapper|container|block|feed)?")
STATE_WORDS = set("no not has have with without hide show open closed allow enable disable count".split())
# Words that tell a comment or an advert made as an article from an article.
ARTICLE_OUT = set("ad ads advert advertisement advertising sponsor sponsored promo related recommended comment comments reply replies respond".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Elements whose start ends an open one: what it ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
SPACE = " \t\n\x0b\x0c\r"
# A quote opens a value only after an equals sign; a tag ends at the first > outside such a value.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![^\s/"'])(class|id|role|hidden|aria-hidden|itemprop)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_GAPS = re.compile(r"[ \t\n\x0b\x0c\r]+")
_DIGITS = re.compile(r"\d+")
_named_cache: dict[str, tuple] = {}


_paths: dict[tuple, int] = {}


def _path(above: int, label: str) -> int:
    """Hash of a node's path of labels."""
    if (above, label) not in _paths:
        if len(_paths) > 100_000:
            _paths.clear()
        _paths[above, label] = int.from_bytes(hashlib.blake2b(f"{above}/{label}".encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)
    return _paths[above, label]


class Block:
    """A block element: the hash of its path of labels, its lines and child blocks in order, and the inline elements open in it."""

    __slots__ = ("tag", "path", "out", "soft", "kind", "items", "open", "code")

    def __init__(self, tag: str, path: int, out: bool, soft: bool, kind: str, code: bool):
        self.tag, self.path, self.out, self.soft, self.kind, self.code = tag, path, out, soft, kind, code
        self.items: list = []  # Blocks and (text, is a link)
        self.open: list = []  # inline (tag, hides its text)


def _names_other(word: str) -> bool:
    """Whether a class or id word names something other than main text: all its parts do, or only place it.

    Of reader comments the last part that does more than place is enough, whatever stands before it: user-comments, post-comments-list.
    """
    parts = [p for p in re.split(r"[-_]+", word) if p]
    named = [p for p in parts if p not in PLACE_WORDS and not p.isdigit()]
    if named and COMMENTS.fullmatch(named[-1]) and not STATE_WORDS.intersection(parts):
        return True
    return any(p in OUT_WORDS for p in parts) and all(p in OUT_WORDS or p in PLACE_WORDS or p.isdigit() for p in parts)


def _named(attrs: str) -> tuple[str, bool, bool, str]:
    """Of the attributes: the words for the label, whether they hide the element, whether they name something else, its kind."""
    if attrs not in _named_cache:
        if len(_named_cache) > 10_000:
            _named_cache.clear()
        words, out, soft, kind = [], False, False, ""
        for key, *values in _ATTR.findall(attrs):
            key, value = key.lower(), html_lib.unescape(next(filter(None, values), "")).lower()
            if key in ("class", "id"):
                soft |= any(map(_names_other, value.split()))
                words += _DIGITS.sub("", value).split()
            elif key == "role":
                soft |= value in OUT_ROLES
                kind = {"article": "article", "main": "main"}.get(value, kind)
            elif key == "hidden":
                out = True
            elif key == "aria-hidden":
                out |= value == "true"
            elif value == "articlebody":
                kind = "body"
        _named_cache[attrs] = " ".join(words), out, soft, kind
    return _named_cache[attrs]


def clean(text: str) -> str:
    return _GAPS.sub(" ", text).strip(SPACE)


def parse(page: str) -> Block:
    """The tree of a page's blocks.  Every step is paid for by a tag or an element that it closes."""
    root = Block("#root", 0, False, False, "", False)
    stack, count = [root], {}
    line: list[str] = []  # text of the current line, a node each
    linked, links, hidden = True, 0, 0  # whether the line is all link; open links and hiding inline elements

    def flush():
        nonlocal linked
        if line:
            text = clean("".join(line))
            if text:
                stack[-1].items.append((text, linked))
            line.clear()
        linked = True

    def add(raw):
        nonlocal linked
        if not hidden:
            line.append(html_lib.unescape(raw))  # a reference does not go on over a tag or a comment
            if not links and not raw.isspace():
                linked = False

    def close_inline(upto=0):
        nonlocal links, hidden
        inline = stack[-1].open
        while len(inline) > upto:
            tag, hides = inline.pop()
            count[tag, stack[-1]] -= 1
            links -= tag == "a"
            hidden -= hides

    def close_block():
        flush()
        close_inline()
        count[stack.pop().tag] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag in BLOCK:
                if count.get(tag):
                    while stack[-1].tag != tag:
                        close_block()
                    close_block()
            elif count.get((tag, stack[-1])):
                # an inline end tag does not end the block around it
                inline = stack[-1].open
                i = len(inline) - 1
                while inline[i][0] != tag:
                    i -= 1
                close_inline(i)
            continue
        if tag in ("br", "hr"):
            flush()
        if count.get("head") and tag not in IN_HEAD:
            while stack[-1].tag != "head":
                close_block()
            close_block()
        if tag in VOID:
            continue
        words, out, soft, kind = _named(attrs) if attrs and not attrs.isspace() else ("", False, False, "")
        code = stack[-1].code or tag in ("pre", "code")
        soft = soft and not code and tag not in HEADING
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
        elif tag in BLOCK:
            flush()
            if stack[-1].tag == "p":
                close_block()
            for ends, stops in [ENDS[tag]] if tag in ENDS else []:
                if any(count.get(t) for t in ends):
                    i = len(stack) - 1
                    while i and stack[i].tag not in ends and stack[i].tag not in stops:
                        i -= 1
                    if i and stack[i].tag in ends:
                        while len(stack) > i:
                            close_block()
            kind = kind or (tag if tag in ("article", "main") else "")
            soft = soft and tag not in ("html", "body") and (kind != "article" or bool(ARTICLE_OUT.intersection(re.split(r"[ _-]+", words))))
            # a block inside a hiding inline element stays hidden
            block = Block(tag, _path(stack[-1].path, f"{tag}.{words}"), out or tag in OUT or hidden > 0, soft, kind, code)
            stack[-1].items.append(block)
            stack.append(block)
            count[tag] = count.get(tag, 0) + 1
        elif not (tag in ("svg", "math") and attrs.rstrip().endswith("/")):
            hides = out or soft or tag in OUT
            stack[-1].open.append((tag, hides))
            count[tag, stack[-1]] = count.get((tag, stack[-1]), 0) + 1
            links += tag == "a"
            hidden += hides
    while len(stack) > 1:
        close_block()
    flush()
    return root


def _walk(root: Block, without: set = frozenset(), soft: bool = True, forms: bool = False) -> Iterator[tuple[Block, tuple]]:
    """(block, line) in page order outside what is left out and the blocks whose id() is in without.

    Blocks that only class words hide are left out if soft, forms unless forms.
    """
    todo = [(root, iter(root.items))]
    while todo:
        block, items = todo[-1]
        item = next(items, None)
        if item is None:
            todo.pop()
        elif isinstance(item, tuple):
            yield block, item
        elif (not item.out or (forms and item.tag == "form")) and not (soft and item.soft) and id(item) not in without:
            todo.append((item, iter(item.items)))


def articles(root: Block) -> list[Block]:
    """The outermost articles in page order, or else the marked article bodies.

    Class words hide an article only as long as another one is left.
    """
    for soft in (True, False):
        found: dict[str, list[Block]] = {"article": [], "body": [], "main": []}  # main elements count below
        todo = [(root, False)]
        while todo:
            block, inside = todo.pop()
            if block.kind and not (inside and block.kind == "article"):
                found[block.kind].append(block)
            inside |= block.kind == "article"
            todo += [(k, inside) for k in reversed(block.items) if isinstance(k, Block) and (not k.out or (k.tag == "form" and not soft)) and not (soft and k.soft)]
        for kind in ("article", "body"):
            if found[kind]:
                return found[kind]
    return []


def mains(root: Block) -> list[Block]:
    """The main elements, in page order."""
    found, todo = [], [root]
    while todo:
        block = todo.pop()
        if block.kind == "main":
            found.append(block)
        else:
            todo += [k for k in reversed(block.items) if isinstance(k, Block) and not k.out]
    return found


def _digest(*parts) -> bytes:
    return hashlib.blake2b("\x1f".join(map(str, parts)).encode(errors="surrogatepass"), digest_size=16).digest()


def _bare(root: Block) -> set[int]:
    """id() of the blocks hidden by class words that hold no paragraph, heading or preformatted text; each block is met once."""
    order, above = [root], [0]
    for i, block in enumerate(order):
        inner = [k for k in block.items if isinstance(k, Block) and not k.out]
        order += inner
        above += [i] * len(inner)
    prose = [(k.tag == "p" or k.tag in HEADING or k.code) and any(isinstance(x, tuple) for x in k.items) for k in order]
    for i in range(len(order) - 1, 0, -1):
        prose[above[i]] |= prose[i]
    return {id(k) for k, found in zip(order, prose, strict=True) if k.soft and not found}


def _slots(root: Block, template: frozenset = frozenset()) -> Iterator[tuple[Block, str]]:
    """(block, text) of the lines of a page without marked articles, in page order.

    A page that is nothing but blocks hidden by class words gives those of them that hold prose, and one that is nothing but a
    form, as some servers make it, gives that form without its controls: layout words and a form around it all hide no page.
    """
    tops = mains(root) or [root]
    for soft, forms in ((True, False), (False, False), (False, True)):
        without = frozenset() if soft else _bare(root)
        lines = [(block, line) for top in tops for block, line in _walk(top, without, soft, forms) if not (line[1] and block.tag == "li")]
        if lines:
            break
    for block, line in lines:
        if not (template and _digest(block.path, line[0]) in template):
            yield block, line[0]


def _text(root: Block, marked: list[Block], template: frozenset = frozenset()) -> str:
    if marked:
        return " ".join(line[0] for a in marked for _, line in _walk(a))
    return " ".join(text for _, text in _slots(root, template))


def extract(page: str | None, template: frozenset = frozenset()) -> str:
    """The main text of a page; template holds the digests of its host's template texts."""
    root = parse(page or "")
    return _text(root, articles(root), template)


def node_texts(page: str) -> tuple[bytes, set[tuple[int, bytes | None]]]:
    """A digest of the page's text by markup alone, and (path, digest of a text) of its nodes outside marked articles.

    A node itself has the pair (path, None).
    """
    root = parse(page)
    marked = articles(root)
    found: set = set()
    inside = {id(a) for a in marked}
    for block, line in _walk(root, inside):
        found |= {(block.path, None), (block.path, _digest(block.path, line[0]))}
    return _digest(_text(root, marked)), found


# -- the Spark side --------------------------------------------------------------------------------


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def nodes(pages: DataFrame) -> DataFrame:
    """host, page, path, text: the nodes of each page and their texts, as digests; text is null for the node itself."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    digest, found = node_texts(page)
                    rows += [(host, digest, path, text) for path, text in found]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "page", "path", "text"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, page binary, path bigint, text binary")


def templates(pages: DataFrame) -> DataFrame:
    """host, template (digests of the texts that all pages with their node have there) of the hosts that have any."""
    each = nodes(pages).distinct().groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    each = stored(each)
    held = each.where("text IS NULL").select("host", "path", "n")
    # a text on all pages of its node is on each of them, so a host's list is no longer than its pages' own nodes
    return each.where("text IS NOT NULL").join(held, ["host", "path", "n"]).groupBy("host").agg(F.collect_list("text").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages."""
    found = stored(templates(pages))
    size = found.agg(F.coalesce(F.sum(F.size("template") * 16 + 64), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    met = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def run(batches):
        ready: dict = {}
        for batch in batches:
            texts = []
            for page, host, template in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("template"), strict=True):
                if host not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[host] = frozenset(template.as_py() or ())
                texts.append(extract(page, ready[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    types = dict(pages.dtypes)
    return met.select("page_id", "url", "html", "host", "template").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
