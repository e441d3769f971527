"""Main-text extraction from HTML with removal of site templates.

Spark counts, for each host, on how many different pages each element subtree
recurs; subtrees that recur across many of them are the host's template and are
deleted, inside articles as well as beside them, whatever they are called. Pages
that are copies or near copies of one another count as one page for this, so
that a text which is published many times over isn't taken for a template.

A host may have few pages; so elements whose tag, role or name says that they
are menus, headers, footers, sidebars, notices, adverts, forms or reader comments
are left out beside that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.html_tree import BLOCK, HEADINGS, Node, blocks, hashes, parse, preorder

#: A subtree is template if it is on this many different pages of its host, and on this share of them.
MIN_PAGES = 10
MIN_SHARE = 0.3
#: The share for running text inside an article or main element, as passages may be quoted.
PROSE_SHARE = 0.5

#: What is never main text.
DROPPED_TAGS = frozenset(
    "head title script style noscript template nav header footer aside form menu button select textarea input dialog iframe object embed svg canvas audio video search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words that name what is not main text.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promoted banner banners "
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidebars aside footer foot header masthead "
    "cookie cookies gdpr notice notices notification notifications alert popup popups modal overlay newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended comment comments commentlist cmt cmts reply replies disqus copyright".split()
)
#: Words that say where or how something is laid out. A name counts only if all its words are in these two lists.
LAYOUT_WORDS = frozenset(
    "site page main top bottom left right global primary secondary inner outer wrapper wrap container box bar list area section block item items widget widgets "
    "sticky floating fixed unit slot button buttons link links post posts thread form consent reader user users view the a of for js id".split()
)
#: The words that count on running text as well.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertisements sponsored".split())
#: Elements that no name drops.
KEPT_TAGS = frozenset("html body main math".split())
#: Elements of running text; of lists, tables and quotations the whole is judged, not their items.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
PROSE_PARTS = frozenset("li dt dd thead tbody tfoot tr td th caption figcaption".split())
_word = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _named(node: Node) -> bool:
    """Whether a name in class or id says that an element isn't main text: `cookie-notice`, but not `legal-theory`."""
    telling = ADVERT_WORDS if node.tag in PROSE - {"ul", "ol", "dl"} or node.tag in PROSE_PARTS else DROPPED_WORDS
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        words = {w.lower() for w in _word.findall(name) if len(w) > 1}
        if words & telling and words <= DROPPED_WORDS | LAYOUT_WORDS:
            return True
    return False


def _not_main(node: Node) -> bool:
    """Whether an element's own tag, role or name says that it isn't main text."""
    if node.tag in DROPPED_TAGS:
        return True
    a = node.attributes
    if not a or node.tag in KEPT_TAGS:
        return False
    return a.get("role", "").lower() in DROPPED_ROLES or _named(node)


class Survey(NamedTuple):
    root: Node
    #: The ids of elements that aren't main text by their tag, role or name.
    dropped: set[int]
    #: The elements that hold the main text, in page order.
    tops: list[Node]
    #: The elements that template removal judges: whether each, by id(), is running text of an article.
    judged: dict[int, bool]


def _holders(order: list[Node]) -> set[int]:
    """The forms that stand around a page's main part, as some servers put one around everything; order has parents first."""
    out: set[int] = set()
    for node in order:
        if node.tag in ("article", "main", "h1") or node.attributes.get("role") == "main":
            up = node.parent
            while up is not None and id(up) not in out:
                out.add(id(up))
                up = up.parent
    return {id(n) for n in order if n.tag == "form" and id(n) in out}


def survey(page: str) -> Survey:
    root = parse(page)
    order = preorder(root)
    dropped: set[int] = set()
    holders = _holders(order)
    articles, mains, in_article, in_main = [], [], set(), set()
    for node in order:
        up = id(node.parent) if node.parent else None
        if up in dropped or node is not root and id(node) not in holders and _not_main(node):
            dropped.add(id(node))
            continue
        for found, inside, fits in ((articles, in_article, node.tag == "article"), (mains, in_main, node.tag == "main" or node.attributes.get("role") == "main")):
            if up in inside:
                inside.add(id(node))
            elif fits:
                inside.add(id(node))
                found.append(node)
    tops = articles or mains or [root]
    inside = in_article if articles else in_main
    judged: dict[int, bool] = {}
    whole: set[int] = set()  # what is judged with an element around it
    for top in tops:
        stack = [top]
        while stack:
            node = stack.pop()
            for c in node.children:
                if isinstance(c, Node) and id(c) not in dropped:
                    stack.append(c)
                    if id(node) in whole:
                        whole.add(id(c))
                    elif c.tag in BLOCK or c.tag in ("span", "a"):
                        prose = c.tag in PROSE
                        if (c.tag in BLOCK or node.tag not in PROSE) and not (c.tag in HEADINGS and id(c) in inside):
                            judged[id(c)] = prose and id(c) in inside
                        if prose or c.tag not in BLOCK:
                            whole.add(id(c))
    return Survey(root, dropped, tops, judged)


def _texts(seen: Survey, template: set[int] | frozenset[int] = frozenset()) -> list[str]:
    gone = seen.dropped | template
    return [b for top in seen.tops for b in blocks(top, gone)]


def main_text(page: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The main text of one page, given the subtree hashes of its host's template."""
    if not page:
        return ""
    seen = survey(page)
    if not template:
        return "\n".join(_texts(seen))
    known = hashes(seen.root)
    return "\n".join(_texts(seen, {i for i in seen.judged if known.get(i) in template}))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page, subtree, prose: a hash of the page's main text, and those of the subtrees to judge, once each."""
    for batch in batches:
        hosts, pages, subtrees, proses = [], [], [], []
        for host, page in zip(batch.column("host"), batch.column("html"), strict=True):
            if not (page := page.as_py()):
                continue
            seen = survey(page)
            key = xxhash.xxh64_intdigest("\n".join(_texts(seen)).encode("utf-8", "replace"))
            known = hashes(seen.root)
            found: dict[int, bool] = {}
            for i, prose in seen.judged.items():
                if i in known:
                    found[known[i]] = found.get(known[i], False) or prose
            hosts += [host.as_py()] * len(found)
            pages += [key - (1 << 64) if key >> 63 else key] * len(found)
            subtrees += found
            proses += found.values()
        columns = [pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(subtrees, pa.int64()), pa.array(proses, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page", "subtree", "prose"])


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), "html")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """Rows host, subtree: the subtrees that recur across a host's pages.

    First every subtree is counted over the host's pages of different main texts.
    Pages are then told apart by one subtree of their own: of those that aren't on
    half of the pages, the one with the smallest hash. Near copies mostly have that
    in common, and so are counted as one page when recurrence is weighed: a
    template is on `min_pages` such pages and on `min_share` of them, running text
    of an article on `prose_share`. A subtree counts once for a page.
    """
    found = _with_host(pages).select("host", "html").mapInArrow(_subtrees, "host string, page long, subtree long, prose boolean")
    # a subtree may be running text on one page and not on another: then it is taken for running text
    found = materialize(found.groupBy("host", "page", "subtree").agg(F.max("prose").alias("prose")))
    size = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = found.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.max("prose").alias("prose")).filter(F.col("n") >= min_pages)
    often = materialize(often)

    common = often.join(size, "host").filter(F.col("n") >= F.col("pages") / 2).select("host", "subtree")
    own = found.join(common, ["host", "subtree"], "left_anti").groupBy("host", "page").agg(F.min(F.xxhash64("subtree")).alias("own"))
    held = found.join(often.select("host", "subtree"), ["host", "subtree"], "left_semi").select("host", "page", "subtree")
    told = F.coalesce("own", "page").alias("told")
    weighed = held.join(own, ["host", "page"], "left").select("host", "subtree", told).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    pages_told = found.select("host", "page").distinct().join(own, ["host", "page"], "left").select("host", told).distinct()
    pages_told = pages_told.groupBy("host").agg(F.count("*").alias("pages"))
    weighed = weighed.join(often.select("host", "subtree", "prose"), ["host", "subtree"]).join(pages_told, "host")
    least = F.col("pages") * F.when(F.col("prose"), prose_share).otherwise(min_share)
    return weighed.filter((F.col("n") >= min_pages) & (F.col("n") >= least)).select("host", "subtree")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        last, template = None, frozenset()
        for page, listed in zip(batch.column("html"), batch.column("subtrees"), strict=True):
            listed = listed.as_py()
            if listed != last:
                last, template = listed, frozenset(listed or ())
            texts.append(main_text(page.as_py(), template))
        lengths = pa.array(map(len, texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    `text` has the blocks of the articles (else the main elements, else the body) in
    page order, one a line, with character references decoded and each run of white
    space, line breaks included, as one space. Left out are: scripts, styles, forms,
    menus, headers, footers and asides by their tags or roles (but not a form around an
    article, a main element or a first heading, as a whole); those with a class or id all of whose words name such parts, adverts,
    notices or comments; and the host's template (see `templates`). Of running text
    names are looked at for adverts alone, and headings in articles are no template. Where a host has fewer than `min_pages`
    different pages, there is no template. A null or empty page, or one without main
    text, has an empty text. A null url is a host of its own. Repeated rows give
    repeated results; an empty table gives no rows; other columns are not read.
    """
    found = templates(pages, min_pages, min_share, prose_share).groupBy("host").agg(F.array_sort(F.collect_set("subtree")).alias("subtrees"))
    found = materialize(found).withColumnRenamed("host", "known_host")
    rows = _with_host(pages)
    joined = rows.join(found, rows["host"] == found["known_host"], "left").select("page_id", "url", "html", "subtrees")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
