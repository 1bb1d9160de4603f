"""HTML extraction: structure first, nearest-URL page differencing for the rest.

A page is cut into blocks of text. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are known by their element, role or
class. If an <article> or <main> element holds text, its remaining blocks are the
main text's lines, else all remaining blocks. Every page's lines are then compared
with its neighbours: the distinct pages of a host are ordered by URL path (copies,
also those that differ in digits only, are one page), and the next ones on either
side are taken. The page's lines are aligned with each by a longest common
subsequence, and the lines that it shares with both sides (the site's template) are
deleted. A neighbour that leaves too little of either page is a near copy and tells
nothing: the one behind it is taken, and without any the page keeps all its lines.

The lines of an article are aligned with those of other articles, and a line goes
only if all usable neighbours, three at least, have it: two pages may carry one
article or one paragraph, and a line that one of them lacks is no template.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship_package, shuffle_partitions, slices

TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z))", re.DOTALL)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
# element names by their role (HTML's own vocabulary)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
DROP = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "fieldset", "option", "datalist", "label"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "title", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: names (class, id, role, aria-label) that mark what is not the article
HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "header", "hidden", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "recommended", "related", "replies", "reply",
    "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "topbar", "widget",
}
#: words that may stand beside such a name ("site-header", "sidebar-left", "comment-list"); any other word beside it makes another name ("no-sidebar")
BESIDE = {
    "area", "bar", "block", "body", "bottom", "box", "container", "content", "desktop", "global", "group", "inner", "item", "items", "left", "links", "list", "local", "main",
    "mobile", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "the", "thread", "top", "unit", "wrap", "wrapper",
}
#: share of a page's characters above which a neighbour with the same lines is a near copy of it
NEAR_COPY = 0.8
#: what an opening element closes if it is still open (HTML's optional end tags)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(name: str) -> bool:
    """Whether a whole name marks what is not the article: a hint, alone or beside words that only say where or what part."""
    words = set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()))
    return bool(words & HINTS) and words <= HINTS | BESIDE


def _marked(attrs: str) -> bool:
    for m in ATTR.finditer(attrs):
        name = m.group(1).lower()
        if name in ("class", "id", "role", "aria-label"):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            if any(map(_named, [value] if name == "aria-label" else value.split())):
                return True
        elif name == "aria-hidden" and (m.group(2) or m.group(3) or m.group(4)) == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", attrs))


def blocks(page: str | None) -> tuple[list[str], list[str], bool]:
    """(main blocks, other blocks, whether the page has an article or main element with text).

    Other blocks are those outside any article or main element that no name or hint rules out.
    A hint never rules out a main element or one that holds it, nor an article (or what holds
    it) on a page that would have no main text without; other articles, such as comments, may go.
    """
    if not page:
        return [], [], False
    main, other, mains, articles = _blocks(page, frozenset())
    for held in (mains, mains | articles):
        if held and (held is mains or not main):
            main, other = _blocks(page, frozenset(held))[:2]
    return main, other, bool(main)


def _blocks(page: str, held: frozenset[int]) -> tuple[list[str], list[str], set[int], set[int]]:
    """(main blocks, other blocks, places of the elements that hints drop with a main element, the same with an article).

    Hints of elements at the places ``held`` don't count.
    """
    main: list[str] = []
    other: list[str] = []
    lost: dict[str, set[int]] = {"main": set(), "article": set()}
    hinted: list[tuple[int, int]] = []  # depth in the stack and place of the open elements that a hint drops
    text: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # element, then the state outside it: dropped, depth of main, header
    dropped = inside = header = 0
    heading = 0
    pos, end = 0, len(page)

    def flush() -> None:
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                (main if inside else other).append(line)

    def shown() -> bool:
        return not dropped and (not header or (inside and heading > 0))

    while pos < end:
        m = TAG.search(page, pos)
        if not m:
            if shown():
                text.append(page[pos:])
            break
        if m.start() > pos and shown():
            text.append(page[pos : m.start()])
        pos = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        closing = bool(m.group(1))
        if name in BLOCK:
            flush()
        elif name == "br" and shown():
            text.append(" ")
        if not closing:
            if name in RAW:  # its content is not markup: skip to its end tag
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, pos)
                shut = page.find(">", stop.end()) if stop else -1
                pos = shut + 1 if shut >= 0 else end
                continue
            if name in VOID or m.group(3).endswith("/") and name not in BLOCK:
                continue
            for open_name in [s[0] for s in reversed(stack)]:
                if open_name in CLOSES.get(name, ()):
                    while stack:
                        top, dropped, inside, header = stack.pop()
                        heading -= top in HEADINGS
                        if top == open_name:
                            break
                    break
                if open_name in ("ul", "ol", "dl", "table", "select", "div", "article", "main", "section", "body"):
                    break
            hinted = [h for h in hinted if h[0] <= len(stack)] if hinted else hinted
            stack.append((name, dropped, inside, header))
            heading += name in HEADINGS
            if name in DROP:
                dropped += 1
            elif name not in ("html", "body") and m.start() not in held and _marked(m.group(3)):
                dropped += 1
                hinted.append((len(stack), m.start()))
            if name in MAIN and hinted and dropped == len(hinted):  # nothing but hints drops it
                lost[name].update(place for _, place in hinted)
            if dropped == stack[-1][1]:
                if name == "header":
                    header += 1
                elif name in MAIN and not dropped:
                    inside += 1
        elif any(s[0] == name for s in stack):
            while stack:  # closes what was left open inside, too
                top, dropped, inside, header = stack.pop()
                heading -= top in HEADINGS
                if top == name:
                    break
    flush()
    return main, other, lost["main"], lost["article"]


def common_lines(a: Sequence[str], b: Sequence[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence of lines (Hunt and Szymanski)."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            else:
                tails[k], links[k] = j, node
    out, node = set(), links[-1] if links else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


#: usable neighbours that must all have an article's line before it counts as the site's
WITNESSES = 3


def article_template(mine: Sequence[int], sizes: Sequence[int], near: Sequence[dict]) -> list[int]:
    """Positions of an article's lines (their hashes and sizes) that every usable neighbour article shares, in order."""
    total, told = sum(sizes), []
    for page in near:
        shared = common_lines(mine, page["lines"])
        if sum(sizes[i] for i in shared) <= NEAR_COPY * min(total, page["size"]):
            told.append(shared)
    return sorted(set.intersection(*told)) if len(told) >= WITNESSES else []


def _template_positions(named: DataFrame) -> DataFrame:
    """(host, pk, gone): the positions of the lines that differencing deletes, for the articles that lose any.

    Lines travel as 64-bit hashes with their sizes, four copies of them at most.
    """
    lines = F.split("main", "\n")
    signs = F.struct(F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), F.transform(lines, lambda x: F.length(x)).alias("sizes"))
    articles = named.where("settled").select("host", "pk", "path", signs.alias("a")).groupBy("host", "pk").agg(F.min("path").alias("path"), F.min("a").alias("a"))
    articles = materialize(articles.select("host", "pk", "path", "a.lines", "a.sizes"), "article_lines")
    near = neighbours(articles.select("host", "path", "pk"), articles.select("host", "pk"))
    beside = near.select("host", F.col("pk").alias("me"), F.explode(F.array("p", "pp", "n", "nn")).alias("pk")).where("pk IS NOT NULL")
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x)
    theirs = beside.join(articles.select("host", "pk", "lines", size.alias("size")), ["host", "pk"])
    theirs = theirs.groupBy("host", F.col("me").alias("pk")).agg(F.collect_list(F.struct("lines", "size")).alias("theirs"))  # four at most
    paired = articles.join(theirs, ["host", "pk"]).select("host", "pk", "lines", "sizes", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            gone = [article_template(*row) for row in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.list_(pa.int32()))], ["host", "pk", "gone"])

    return paired.mapInArrow(run, "host string, pk binary, gone array<int>").where("size(gone) > 0")


def _parse(pages: DataFrame) -> DataFrame:
    """(pk, page_id, url) -> also settled, main, other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [blocks(h) for h in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), part.column(2), pa.array([s for _, _, s in got], pa.bool_()),
                    pa.array(["\n".join(m) if s else None for m, _, s in got], pa.string()), pa.array([o for _, o, _ in got], pa.list_(pa.string())),
                ],
                ["pk", "page_id", "url", "settled", "main", "other"],
            )

    return pages.mapInArrow(run, "pk string, page_id long, url string, settled boolean, main string, other array<string>")


def template_lines(mine: Sequence[str], left: Sequence[dict], right: Sequence[dict]) -> set[int]:
    """Positions in ``mine`` of the lines to delete; ``left`` and ``right`` are the neighbours (lines, article), nearest first."""
    total = sum(map(len, mine))

    def usable(pages: Sequence[dict]) -> list[set[int]]:
        out = []
        for page in pages:
            shared = common_lines(mine, page["lines"])
            n = sum(len(mine[i]) for i in shared)
            theirs = sum(map(len, page["lines"])) + page["article"]
            if n <= NEAR_COPY * min(total, theirs):
                out.append(shared)
        return out

    sides = usable(left), usable(right)
    chosen = [side[0] for side in sides if side]
    if len(chosen) == 1:  # at an end of the host: two from the one side, if it has them
        chosen = [*sides[0], *sides[1]][:2]
    return set.intersection(*chosen) if chosen else set()


def neighbours(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(host, pk, p, pp, n, nn): the two pages before and after each wanted page by URL path within its host (NULL: none).

    ``keys`` has host, path, pk, one row per (host, pk); ``wanted`` has host, pk. The
    order is a range partitioning of the keys, so a host with a third of all pages
    spreads over many tasks; the first and last key of each partition meet in one
    small table.
    """
    key = F.struct("host", "path", "pk")
    dealt = keys.repartitionByRange(shuffle_partitions(keys.sparkSession), "host", "path", "pk").select(F.spark_partition_id().alias("pid"), key.alias("me"))
    dealt = materialize(dealt, "url_order")
    ends = dealt.groupBy("pid").agg(F.min("me").alias("low"), F.max("me").alias("high"))  # one row per partition
    w = Window.orderBy("pid")
    ends = ends.select("pid", F.lag("high").over(w).alias("before"), F.lead("low").over(w).alias("after"))
    inside = Window.partitionBy("pid").orderBy("me")
    seen = dealt.select("pid", "me", F.lag("me").over(inside).alias("p"), F.lead("me").over(inside).alias("n")).join(F.broadcast(ends), "pid")
    seen = seen.select("me", F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))

    def same_host(c: str):
        return F.when(F.col(f"{c}.host") == F.col("me.host"), F.col(f"{c}.pk")).alias(c)

    seen = seen.select(F.col("me.host").alias("host"), F.col("me.pk").alias("pk"), same_host("p"), same_host("n"))
    mine = materialize(seen.join(wanted, ["host", "pk"], "left_semi"), "url_neighbours")
    far = mine.join(seen.select("host", F.col("pk").alias("p"), F.col("p").alias("pp")), ["host", "p"], "left")
    return far.join(seen.select("host", F.col("pk").alias("n"), F.col("n").alias("nn")), ["host", "n"], "left").select("host", "pk", "p", "pp", "n", "nn")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Edge cases: NULL or empty html, and pages without any main text, give the
    empty text; a page whose host has no other page but copies and near copies of
    it keeps all the lines that no name or hint rules out; a NULL URL counts as its own empty host;
    unfinished markup is read up to the end; repeated rows give the same text
    each. Other columns are ignored; an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)
    url, body = F.col(f"`{url_col}`").cast("string"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    pk = F.concat_ws(":", F.col(f"`{id_col}`"), F.xxhash64(url, body))
    parsed = materialize(_parse(pages.select(pk.alias("pk"), F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), body.alias("html"))), "page_blocks", codec="zstd")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    content = F.unhex(F.substring(F.sha2(F.regexp_replace(F.concat_ws("\n", F.coalesce("main", F.lit("")), F.lit("\0"), F.array_join("other", "\n")), "[0-9]+", "0"), 256), 1, 32))
    named = parsed.select("page_id", "url", "settled", "main", "other", host.alias("host"), path.alias("path"), content.alias("pk"))
    gone = materialize(_template_positions(named), "article_template")  # (articles without a template line have no row)
    kept = F.array_join(F.filter(F.split("main", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    done = named.where("settled").join(gone, ["host", "pk"], "left").select("page_id", "url", F.when(F.col("gone").isNull(), F.col("main")).otherwise(kept).alias("text"))
    open_pages = named.where("not settled").select("page_id", "url", "other", "host", "pk")
    told = named.where("size(other) > 0")  # a page without lines outside its article shows no template
    near = neighbours(told.groupBy("host", "pk").agg(F.min("path").alias("path")), open_pages.select("host", "pk").distinct())
    beside = near.select("host", F.col("pk").alias("me"), F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).alias("pk")) for i, c in enumerate(("p", "pp", "n", "nn"))))).alias("b"))
    beside = beside.where("b.pk IS NOT NULL").select("host", "me", "b.at", "b.pk")
    lines = told.join(beside.select("host", "pk").distinct(), ["host", "pk"], "left_semi").dropDuplicates(["host", "pk"])
    lines = beside.join(lines.select("host", "pk", F.coalesce(F.length("main"), F.lit(0)).alias("article"), F.col("other").alias("lines")), ["host", "pk"])
    theirs = lines.groupBy("host", F.col("me").alias("pk")).agg(F.collect_list(F.struct("at", "article", "lines")).alias("theirs"))  # four at most
    paired = open_pages.join(theirs, ["host", "pk"], "left").select("page_id", "url", "other", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = []
            for mine, theirs in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                theirs = sorted(theirs or [], key=lambda t: t["at"])
                shared = template_lines(mine, [t for t in theirs if t["at"] < 2], [t for t in theirs if t["at"] > 1])
                texts.append("\n".join(x for i, x in enumerate(mine) if i not in shared))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rest = paired.mapInArrow(run, "page_id long, url string, text string")
    return done.unionByName(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
