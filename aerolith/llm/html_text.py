"""Main text of web pages, with site templates removed.

A first pass hashes the subtrees of each page's containers (tag and text, bottom-up). Spark counts for each host beside how
many different texts a subtree occurs: what else the page says, so that copies of a page or of an article with another
menu count once. Subtrees beside ``MANY`` texts, and beside as many as the square root of the host's different pages, are
templates. A second pass extracts the text without them.

The text is that of the main and article elements, or of the body, where there are none. Menus, headers and footers of the
site, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, too, where an element is said to
be one by its tag, its role, or by a class or id that has no other words in it ("share", "share-buttons", but not
"share-price"). Inside an article only containers can be templates, never its headings, paragraphs or list items.

Markup needn't be well-formed: tags close what they imply, end tags without a start are ignored, raw-text elements and
comments run to their end or the page's. Null pages are empty and have no text; a null or odd url has no host, and
nothing is removed as its template; repeated rows come back repeatedly and don't make a template by themselves. An empty
table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_to_empty, ship, small_batches

MANY = 4
#: A host's pages are dealt over so many groups when they meet its templates.
GROUPS = 64

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "aside"}
CONTAINER = {"aside", "center", "div", "dl", "fieldset", "figure", "footer", "form", "header", "menu", "nav", "ol", "section", "table", "ul"}
LEFT_OUT = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "datalist", "dialog", "svg", "math", "object", "canvas", "audio", "video", "fieldset"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
#: Words of a class or id that tell what an element is for, and words that may stand beside them.
PURPOSES = set(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices"
    " notification popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
BESIDE = set("site page main top bottom left right header global primary secondary list area bar box block button buttons container content form icons inner item items link links outer overlay section slot unit widgets wrap wrapper".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\sA-Za-z_-]+")
#: A start tag closes open elements of these kinds, as far up as the nearest of the others.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_ENDS = BLOCK - {"html", "body"}
P_SCOPE = {"button", "td", "th", "caption", "html", "body", "table", "object"}


class Element:
    __slots__ = ("tag", "out", "inside", "hash", "mark", "blocks", "text")

    def __init__(self, tag: str, out: bool, inside: bool, mark: int):
        self.tag, self.out, self.inside, self.mark, self.text = tag, out, inside, mark, False
        self.hash = xxhash.xxh3_64(tag)


@lru_cache(maxsize=4096)
def has_purpose(names: str) -> bool:
    """Whether a class or id among these says what its element is for, and nothing else."""
    for name in names.split():
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if parts & PURPOSES and not any(p not in PURPOSES and p not in BESIDE and not p.isdigit() for p in parts):
            return True
    return False


def left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no main text by what it says of itself. A header inside an article is the article's."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return bool(attributes) and tag == "article" and any(has_purpose(b or c or d) and "comment" in (b or c or d).lower() for a, b, c, d in NAMED.findall(attributes))
    for name, *values in NAMED.findall(attributes):
        value = "".join(values)
        if value.lower() in ROLES if name.lower() == "role" else has_purpose(value):
            return True
    return bool(HIDDEN.search(attributes))


def parse(page: str, templates: frozenset = frozenset()) -> tuple[list[str], list[tuple[int, int]]]:
    """The blocks of the main text; hashes of the subtrees that could be templates, each with that of the text beside it."""
    stack: list[Element] = []
    #: Kept pieces: level 1 is in an article or main, 0 elsewhere; subtrees that turn out to be templates are cut.
    blocks: list[tuple[int, str]] = []
    found: list[tuple[int, int, int]] = []
    piece: list[str] = []
    #: How many elements of each tag are open.
    count: dict[str, int] = defaultdict(int)
    out_depth = 0

    def flush() -> None:
        if piece:
            text = " ".join("".join(piece).split())
            piece.clear()
            if text:
                blocks.append((level(), text))

    def level() -> int:
        return 1 if count["article"] or count["main"] else 0

    def add(raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not out_depth:
            piece.append(text)
        words = text.split()
        if words and stack:
            top = stack[-1]
            top.text = True
            top.hash.update(" ".join(words).encode("utf-8", "surrogatepass"))

    def close() -> None:
        nonlocal out_depth
        e = stack[-1]
        if e.tag in BLOCK:
            flush()
        stack.pop()
        count[e.tag] -= 1
        out_depth -= e.out
        digest = e.hash.intdigest() - (1 << 63)
        if e.text and stack:
            stack[-1].text = True
            stack[-1].hash.update(digest.to_bytes(8, "little", signed=True))
        if e.text and e.tag in CONTAINER and not e.out and not out_depth:
            found.append((digest, e.mark, len(blocks)))
            if digest in templates:
                del blocks[e.mark :]

    at = 0
    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                piece.append(" ")
            elif count[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in P_ENDS:
            flush()
            for k in range(len(stack) - 1, -1, -1) if count["p"] else ():
                if stack[k].tag == "p":
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in P_SCOPE:
                    break
        if tag in CLOSES:
            kinds, limits = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1) if any(count[x] for x in kinds) else ():
                if stack[k].tag in kinds:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in limits:
                    break
        if tag in ("br", "td", "th", "img", "hr", "option"):
            piece.append(" ")
        if tag in VOID:
            continue
        inside = count["article"] > 0
        out = bool(out_depth) or left_out(tag, attributes, inside)
        if tag == "body":  # whatever the head has left open
            while stack and stack[-1].tag != "html":
                close()
        out = out and tag not in ("html", "body")
        e = Element(tag, out, inside, len(blocks))
        if out and not out_depth:
            flush() if tag in BLOCK else None
        stack.append(e)
        count[tag] += 1
        out_depth += out
        if attributes and attributes.endswith("/") and tag in ("svg", "math"):
            close()
    add(page[at:])
    flush()
    while stack:
        close()
    best = max((k for k, _ in blocks), default=0)
    kept = [t for k, t in blocks if k == best]
    if templates or not found:
        return kept, []
    # sums of the blocks' hashes, so that what is beside a subtree takes one step
    so_far = [0, *accumulate(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for _, t in blocks)]
    return kept, [(digest, (so_far[-1] - so_far[end] + so_far[mark]) % (1 << 64) - (1 << 63)) for digest, mark, end in found]


def host_of(url_col: str):
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def site_templates(pages: DataFrame) -> DataFrame:
    """host, templates (hashes). pages: host, html_. What a task sends is hashes, a few for each page."""

    def run(batches):
        for b in small_batches(batches, "html_", 4_000_000):
            html_ = b.column("html_").to_pylist()
            # the page's own entry (no subtree) counts the host's different pages
            own = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in html_]
            found = [[(None, page), *set(parse(t)[1])] for t, page in zip(html_, own)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([[{"subtree": x, "beside": y} for x, y in f] for f in found], pa.list_(pa.struct([("subtree", pa.int64()), ("beside", pa.int64())])))], ["host", "found"])

    seen = pages.where("host IS NOT NULL").mapInArrow(run, "host string, found array<struct<subtree: long, beside: long>>")
    rows = seen.select("host", F.inline("found")).distinct()
    counts = rows.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    whole = counts.where("subtree IS NULL").select("host", F.col("n").alias("all_pages"))
    often = counts.where(F.col("subtree").isNotNull() & (F.col("n") >= MANY)).join(whole, "host").where(F.col("n") * F.col("n") >= F.col("all_pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("templates"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (main text, blocks parted by line breaks), n_chars, n_blocks."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id_"), F.col(url_col).alias("url_"), host_of(url_col).alias("host"), null_to_empty(html_col).alias("html_"))
    templates = site_templates(rows).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("id_", "url_"), F.lit(GROUPS)).cast("int"))
    rows = rows.join(templates, ["host", "group"], "left").select("id_", "url_", "html_", "templates")

    def run(batches):
        for b in small_batches(batches, "html_", 4_000_000):
            found = [parse(t, frozenset(x or ()))[0] for t, x in zip(b.column("html_").to_pylist(), b.column("templates").to_pylist())]
            text = ["\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("id_"), b.column("url_"), pa.array(text), pa.array([len(t) for t in text], pa.int64()), pa.array([len(x) for x in found], pa.int32())], ["id_", "url_", "text", "n_chars", "n_blocks"])

    out = rows.mapInArrow(run, f"id_ {pages.schema[id_col].dataType.simpleString()}, url_ {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long, n_blocks int")
    return out.select(F.col("id_").alias(id_col), F.col("url_").alias(url_col), "text", "n_chars", "n_blocks")
