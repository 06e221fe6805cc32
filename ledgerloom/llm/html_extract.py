"""Main text of web pages, with site templates found by recurring element subtrees.

Each page is read into elements; every subtree gets a hash. Spark counts per host in how many pages of different main
content a subtree stands (so mirrored copies of one page count once). What recurs is the site's template and is deleted:
containers (div, section, ul and the like, in and around the article) from MIN_PAGES pages and MIN_SHARE of the host's
pages on; prose elements (paragraphs, headings, quotes, tables) from PROSE_PAGES and PROSE_SHARE on, and these only in
pages that mark no article, for copies of an article share its paragraphs. At most 1 / MIN_SHARE times the mean number of
elements of a page can reach that share, so the list of a host is bounded. The rest is the article (or main, or body)
without navigation, notices, adverts, forms and comments, which class, id and role name by whole words; of containers also
by the first or last part of a name (reader-comments, ad-wrap), which takes articles inside comment lists with it.

Reading is linear in the page, whatever its markup: no recursion, and no walk over open elements that closes none.

Defined cases: null or empty html gives an empty text; a null host is a host of its own; broken or cut-off markup is read
as far as it goes (open elements end with the page, an end tag that fits no open element is ignored, a tag without its
end is text); any depth of nesting; repeated rows give a row each; null page ids are kept; other columns pass only if
named in keep; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package

MIN_SHARE = 0.1
MIN_PAGES = 3
PROSE_SHARE = 0.5
PROSE_PAGES = 5
#: Elements whose text is never the article's.
DROPPED = frozenset("head nav footer aside form button select option textarea input label dialog menu noscript template svg canvas object iframe script style title audio video".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article section div ul ol dl table td th body html main aside nav form blockquote header footer".split())
#: Elements that hold an article's own text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th caption dl dt dd li ol figure figcaption".split())
#: Class, id and role words, each between white space and with - for _, that mark what is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget "
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper comment-form comment-list comment-section comments-area comments-section complementary contentinfo cookie-banner cookie-bar cookie-consent cookie-notice footer-nav google-ad main-menu main-nav nav-bar newsletter-signup page-footer page-header post-comments "
    "related-articles related-links related-posts search share-buttons share-links side-bar site-footer site-header site-menu site-nav site-navigation site-notice skip-link social-links social-share top-bar top-nav user-comments".split()
)
#: Marks that may as well name what an article is about: they count only outside of it.
WEAK = frozenset("notice notices related replies respond search social widget".split())
#: Parts between hyphens that mark a container by themselves, at the beginning or the end of a name.
STEMS = frozenset("ad ads advert adverts advertisement comment comments sponsored".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: What may still begin a token where no > follows.
LAST_TOKEN = re.compile(r"<!--.*|<[!?].*", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that a start tag may end, as bits.
BITS = {tag: 1 << i for i, tag in enumerate(("p", "li", "dt", "dd", "tr", "td", "th", "option"))}


class Element:
    """open: which of BITS are open from here up to the next scope."""

    __slots__ = ("tag", "parent", "off", "main", "holds_main", "parts", "hash", "open", "gone")

    def __init__(self, tag, parent, off, main):
        self.tag, self.parent, self.off, self.main, self.holds_main, self.parts, self.hash, self.gone = tag, parent, off, main, False, [], 0, False
        self.open = BITS.get(tag, 0) | (0 if parent is None or tag in SCOPES else parent.open)


def digest(data: str) -> int:
    return int.from_bytes(hashlib.blake2b(data.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def marked(attributes: str, container: bool = True, inside: bool = False) -> bool:
    """Whether class, id or role names what is no article text. inside: the element stands in the article."""
    names = (n for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role") for n in (m[2] or m[3] or m[4] or "").lower().replace("_", "-").split())
    for name in names:
        if name in MARKS and not (inside and name in WEAK):
            return True
        ends = name.split("-")
        if container and (STEMS.intersection((ends[0], ends[-1])) - {"ad", "ads"} or ends[0] in ("ad", "ads") and (len(ends) == 1 or ends[1] != "free") or re.fullmatch(r"ads?\d+", name)):
            return True
    return False


def read_page(html: str) -> tuple[list[Element], list[tuple[Element, str | None]]]:
    """Elements in order of their end, the root last, and runs (element, text), text None where a block begins or ends."""
    root = Element("", None, False, False)
    top, done, runs, at, last = root, [], [], 0, html.rfind(">")
    count: dict[str, int] = {}  # open elements by name

    def end(e: Element) -> Element:
        e.hash = digest(e.tag + "\x00" + "\x01".join(e.parts))
        e.parent.parts.append(str(e.hash))
        done.append(e)
        count[e.tag] -= 1
        return e.parent

    def text(a: int, b: int) -> None:
        if a < b:
            run = unescape(html[a:b])
            runs.append((top, run))
            if words := run.split():
                top.parts.append(" ".join(words))

    while m := TOKEN.search(html, at) if at <= last else LAST_TOKEN.search(html, at):
        text(at, m.start())
        at = m.end()
        if m.re is LAST_TOKEN:
            break
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            runs.append((top, None))
        elif name == "br":
            runs.append((top, " "))
        if m[1] or m[4]:
            while count.get(name):
                ended = top.tag
                top = end(top)
                if ended == name:
                    break
            continue
        if name in VOID:
            continue
        ending = ENDS.get(name, ()) if name not in BLOCKS or name in ENDS else ("p",)
        if any(top.open & BITS[tag] for tag in ending):
            while top.tag not in ending:
                top = end(top)
            top = end(top)
        attributes = m[3] or m[6] or ""
        inside = top.main
        off = top.off or name in DROPPED or (name == "header" and not inside) or (bool(attributes.strip()) and name not in ("html", "body", "main") and marked(attributes, name not in PROSE, inside))
        main = not off and (inside or name in ("article", "main"))
        top = Element(name, top, off, main)
        count[name] = count.get(name, 0) + 1
        if main and not inside:
            e = top
            while e is not None and not e.holds_main:
                e.holds_main, e = True, e.parent
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = close.start() if close else len(html)
        if attributes.rstrip().endswith("/") and name in ("svg", "path"):
            top = end(top)
    text(at, len(html))
    while top is not root:
        top = end(top)
    return [*done, root], runs


def text_of(runs, keep) -> str:
    blocks, now = [], []
    for e, run in runs:
        if run is None:
            if now and (block := " ".join("".join(now).split())):
                blocks.append(block)
            now = []
        elif keep(e):
            now.append(run)
    if now and (block := " ".join("".join(now).split())):
        blocks.append(block)
    return "\n".join(blocks)


def article_text(elements: list[Element], runs, templates: frozenset[int] = frozenset()) -> str:
    has_main = any(e.main for e in elements)
    for e in reversed(elements):  # from the root down
        recurs = e.hash in templates and not e.holds_main and bool(e.parts) and not (has_main and e.tag in PROSE)
        e.gone = e.off or recurs or (e.parent is not None and e.parent.gone)
    return text_of(runs, lambda e: (e.main or not has_main) and not e.gone)


def main_text(html: str, templates: frozenset[int] = frozenset()) -> str:
    """The article's text without elements of templates (an element that holds the article is never one)."""
    return article_text(*read_page(html), templates)


def subtrees(html: str) -> tuple[int, list[int], list[int]]:
    """Hash of the main content, and of every subtree that could belong to a template: containers, prose."""
    elements, runs = read_page(html)
    text = article_text(elements, runs)
    has_main = any(e.main for e in elements)
    own = [e for e in elements if e.parts and not e.gone and not e.holds_main and e.tag not in ("", "html", "head", "body") and (e.main or not has_main)]
    return digest(text), sorted({e.hash for e in own if e.tag not in PROSE}), sorted({e.hash for e in own if e.tag in PROSE} if not has_main else ())


def host_templates(pages: DataFrame, host, html_col: str, min_share: float, min_pages: int) -> DataFrame:
    """_host -> templates: array of subtree hashes. Pages with equal main content count as one."""
    own = pages.select(host.alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [subtrees(h) for h in part.column("_html").to_pylist()]
                lists = [pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column("_host"), pa.array([x[0] for x in found], pa.int64()), *lists], names=["_host", "_page", "_subtrees", "_prose"])

    trees = materialise(own.mapInArrow(run, "_host string, _page bigint, _subtrees array<bigint>, _prose array<bigint>"))
    pages_of = trees.select("_host", "_page").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    exploded = trees.select("_host", "_page", F.explode("_subtrees").alias("_tree"), F.lit(False).alias("_is_prose"))
    exploded = exploded.union(trees.select("_host", "_page", F.explode("_prose"), F.lit(True)))
    counts = exploded.distinct().groupBy("_host", "_tree", "_is_prose").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where(F.col("_n") >= F.when(F.col("_is_prose"), max(min_pages, PROSE_PAGES)).otherwise(min_pages))
    same = F.col("c._host").eqNullSafe(F.col("p._host"))
    share = F.when(F.col("_is_prose"), max(min_share, PROSE_SHARE)).otherwise(min_share)
    often = counts.alias("c").join(pages_of.alias("p"), same).where(F.col("_n") >= share * F.col("_pages"))
    return often.groupBy(F.col("c._host").alias("_template_host")).agg(F.array_sort(F.collect_set("_tree")).alias("_templates"))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id",), min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """keep, url, text, n_chars; a row for each page."""
    ship_package(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    templates = materialise(host_templates(pages, host, html_col, min_share, min_pages))  # few hosts; its size is known when the join is planned
    own = pages.select(*keep, F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"), host.alias("_host"))
    joined = own.join(templates, F.col("_host").eqNullSafe(F.col("_template_host")), "left").select(*keep, "_url", "_html", "_templates")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep, "_url").schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, frozenset(t or ())) for h, t in zip(part.column("_html").to_pylist(), part.column("_templates").to_pylist(), strict=True)]
                names = [*keep, "_url"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "text"])

    out = joined.mapInArrow(run, f"{kinds}, text string")
    return out.select(*keep, F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
