"""Main text of web pages by a site style tree.

Every page is read into blocks of text, each with the path of elements above it.
The pages of one host are merged on these paths into a style tree. A block that
many of the pages with its node have says little: its importance is one less the
entropy of its spread over them, 1 on a single page and 0 on all. A leaf has the
mean importance of its blocks by words, so a menu that leaves out or marks the
current page is as unimportant as one that never changes, and an article stays
although some of its paragraphs repeat. Copies of a page count once. A node above
leaves has a composite of the entropy of the child elements that pages show
there and the importance of what lies below it; where it and all nodes below it
that enough pages have are unimportant the whole branch is cut. A notice whose
whole text differs on every page cannot be told from main text by this.
Elements that never hold main text (scripts, forms, navigation, asides) have no
importance from the start, and names of classes (comments, adverts) speak against
small branches; both also serve hosts with too few pages to learn from. Of the
branches left, those inside an article (or else the main element) are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolift.functions.joins import even_join
from promolift.llm.common import staged

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas textarea select title".split())
#: Inline elements do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img br".split())
#: An open paragraph ends where one of these starts.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of their own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
#: Elements and names (of classes, ids and roles) that never hold main text.
BOILERPLATE = frozenset("nav header footer aside form button dialog menu".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar\w*|side|header|footer|"
    r"cookies?|consent|notices?|newsletter|subscribe|comments?|respond|replies|share|social|breadcrumbs?|"
    r"related|popup|modal|pagination|navigation|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
#: Elements whose names say nothing about their text.
HOLDERS = frozenset("html body main article".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)", re.S)
#: Marks of elements that never hold main text, and of those whose names say so.
CUT, NAMED = "!", "?"


def style(tag: str, attributes: str, inside: bool) -> str:
    """An element as its tag and class, with a mark in front where it holds no main text or is named so.

    A header inside an article has its title and stays.
    """
    names = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)] if attributes else []
    # A mark of the current item does not make another node of it.
    shown = tag if tag in SIBLINGS else tag + "".join(
        "." + ".".join(value.split()) for name, value in names if name == "class" and value.strip())
    title = inside and tag == "header"
    if tag in BOILERPLATE and not title:
        return CUT + shown
    if tag in HOLDERS or title or not any(NAMES.search(value) for _, value in names):
        return shown
    return NAMED + shown


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(path, text) of every block of a page in order, texts decoded and trimmed.

    A page without markup is one block.
    """
    text = html or ""
    stack: list[tuple[str, str]] = []
    path = ""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    at = 0

    def flush() -> None:
        if parts:
            words = " ".join(unescape("".join(parts)).split())
            if words:
                out.append((path, words))
            parts.clear()

    def renewed() -> str:
        return "/".join(name for _, name in stack)

    while at < len(text):
        found = TOKEN.search(text, at)
        if not found:
            parts.append(text[at:])
            break
        parts.append(text[at:found.start()])
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW and not closing:
            flush()
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in INLINE:
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
        else:
            if tag in CLOSES_P and any(name == "p" for name, _ in stack):
                while stack[-1][0] != "p":
                    stack.pop()
                stack.pop()
            if stack and stack[-1][0] in SIBLINGS.get(tag, ()):
                stack.pop()
            inside = any(name in ("article", "main") for name, _ in stack)
            stack.append((tag, style(tag, found[3], inside)))
        path = renewed()
    flush()
    return out


def cut_by_name(shown: list[tuple[list[str], str]], important: set[str]) -> set[str]:
    """The named branches of a page that are cut.

    Names are a prior for branches with little of the page's text: half of it or
    less, a fourth if the style tree finds them important, nine tenths inside an
    article, where comments can be long. A branch around the page's articles (or
    main elements) stays unless others remain.
    """
    words: Counter[str] = Counter()
    inner: set[str] = set()
    holding: set[str] = set()
    plain = False
    for names, text in shown:
        tags = [name.partition(".")[0] for name in names]
        core = next((tags.index(tag) for tag in ("article", "main") if tag in tags), None)
        article = tags.index("article") if "article" in tags else len(tags)
        named = [depth for depth, name in enumerate(names) if name.startswith(NAMED)]
        for depth in named:
            prefix = "/".join(names[:depth + 1])
            words[prefix] += len(text.split())
            if depth > article:
                inner.add(prefix)
            elif core is not None and depth < core:
                holding.add(prefix)
        plain = plain or (core is not None and not any(depth < core for depth in named))
    total = sum(len(text.split()) for _, text in shown)
    most = lambda path: 0.9 if path in inner else 0.25 if path in important else 0.5
    return {path for path, n in words.items() if n <= most(path) * total and (plain or path not in holding)}


def main_text(paths: list[str], texts: list[str], cut: set[str], important: set[str] = frozenset()) -> str:
    """The blocks that are main text, in page order."""
    shown = [(path.split("/"), text) for path, text in zip(paths, texts, strict=True)
             if not is_cut(path, cut) and not any(name.startswith(CUT) for name in path.split("/"))]
    named = cut_by_name(shown, important)
    kept = [(names, text) for names, text in shown if not is_cut("/".join(names), named)]
    for element in ("article", "main"):
        within = [text for names, text in kept if any(name.partition(".")[0] == element for name in names)]
        if within:
            return "\n".join(within)
    return "\n".join(text for _, text in kept)


def signed(data: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data.encode()), "big", signed=True)


PAGE_SCHEMA = (
    "host string, nodes array<struct<path: string, children: int, content: bigint, words: int>>, page_hash bigint")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]*:?//([^/?#]*)", 1), F.lit("")))
    return pages.select(F.col("page_id").cast("string").alias("page"), "url", host.alias("host"), "html")


def nodes_of(page: list[tuple[str, str]]) -> list[dict]:
    """Every different block of a page and, for each node above blocks, the child elements it shows.

    Blocks have 0 ``children``; runs of like children count as one.
    """
    held = {(path, said) for path, said in page}
    below: dict[str, list[str]] = {}
    for path, _ in page:
        names = path.split("/")
        for depth in range(1, len(names)):
            shown = below.setdefault("/".join(names[:depth]), [])
            if not shown or shown[-1] != names[depth]:
                shown.append(names[depth])
    return [
        {"path": path, "children": 0, "content": signed(said), "words": len(said.split())} for path, said in held
    ] + [
        {"path": path, "children": len(set(shown)), "content": signed("/".join(shown)), "words": 0}
        for path, shown in below.items()]


def page_nodes(pages: DataFrame) -> DataFrame:
    """The blocks and nodes of every page, with their contents as hashes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(html) for html in batch.pop("html")]
            batch["nodes"] = [nodes_of(page) for page in found]
            batch["page_hash"] = [signed(repr(page)) for page in found]
            yield batch

    return pages.select("host", "html").mapInPandas(read, PAGE_SCHEMA)


LEAST_PAGES, LEAST_IMPORTANCE, IMPORTANT, DAMPING = 8, 0.2, 0.5, 0.9


def style_tree(read: DataFrame) -> DataFrame:
    """``host, path, n_pages, importance`` of every node of the pages' paths.

    Counts are combined before they are shuffled, so a host with a third of all
    pages is no larger than its variety. A node alone on its page has importance 1.
    """
    seen = read.select("host", "page_hash", F.explode("nodes").alias("node")).select(
        "host", "page_hash", "node.*").distinct()
    pages = seen.select("host", "path", "page_hash", (F.col("words") > 0).alias("block")).distinct().groupBy(
        "host", "path", "block").agg(F.count("*").alias("n_pages"))
    counted = seen.groupBy("host", "path", (F.col("words") > 0).alias("block"), "content").agg(
        F.count("*").alias("n"), F.max("words").alias("words"), F.max("children").alias("children"))
    share = F.when(F.col("n_pages") > 1, F.log2("n") / F.log2("n_pages")).otherwise(F.lit(0.0))
    measured = even_join(counted, pages, ["host", "path", "block"], "inner").groupBy(
        "host", "path", "block", "n_pages").agg(
            F.sum(F.col("n") * F.col("words")).alias("words"),
            F.sum(F.col("n") * F.col("words") * (1 - share)).alias("weight"),
            # Of child elements: the entropy as a share of the most it could be.
            (F.sum(F.col("n") * (1 - share)) / F.first("n_pages")).alias("shown"),
            F.max("children").alias("children"))
    leaves = measured.where("block")
    names = F.split("path", "/")
    under = leaves.select("host", "words", "weight", "n_pages", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(names)), lambda depth: F.array_join(F.slice(names, 1, depth), "/"))).alias("path"))
    below = under.groupBy("host", "path").agg(
        (F.sum("weight") / F.sum("words")).alias("content"), F.max("n_pages").alias("n_pages"))
    styles = measured.where("not block").select("host", "path", "shown", "children")
    kept = F.pow(F.lit(DAMPING), F.coalesce("children", F.lit(0)))
    return below.join(styles, ["host", "path"], "left").select(
        "host", "path", "n_pages",
        ((1 - kept) * F.coalesce("shown", F.lit(0.0)) + kept * F.col("content")).alias("importance"))


def unimportant(tree: DataFrame) -> DataFrame:
    """``host, cut, important``: branches to cut on each host, and named ones that are important.

    A branch is unimportant if its node is and no node below it that enough pages
    have is important. A host has as many entries as nodes in its templates, not
    as pages.
    """
    enough = tree.where(F.col("n_pages") >= LEAST_PAGES)
    names = F.split("path", "/")
    important = enough.where(F.col("importance") >= LEAST_IMPORTANCE).select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(names)), lambda depth: F.array_join(F.slice(names, 1, depth), "/"))).alias("path"))
    low = enough.where(F.col("importance") < LEAST_IMPORTANCE).join(
        important.distinct(), ["host", "path"], "left_anti")
    named = enough.where((F.col("importance") >= IMPORTANT) & F.element_at(names, -1).startswith(NAMED))
    return low.select("host", F.col("path").alias("cut"), F.lit(None).cast("string").alias("important")).unionByName(
        named.select("host", F.lit(None).cast("string").alias("cut"), F.col("path").alias("important"))).groupBy(
        "host").agg(F.collect_set("cut").alias("cut"), F.collect_set("important").alias("important"))


def is_cut(path: str, cut: set[str]) -> bool:
    """Whether the path or one above it is cut."""
    return bool(cut) and (path in cut or any(path[:at] in cut for at, c in enumerate(path) if c == "/"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page; null and empty pages have no text.

    Null urls form one host. Repeated pages are extracted each. An empty table
    gives no rows. Pages are read twice, for the tree and for the text, which
    costs less than keeping all their blocks in between.
    """
    placed = with_host(pages)
    tree = style_tree(staged(page_nodes(placed), "nodes"))
    # Written first, so that Spark knows its size before it plans to move any page.
    joined = even_join(placed, staged(unimportant(tree), "cut"), ["host"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = []
            for html, cut, important in zip(batch["html"], batch["cut"], batch["important"], strict=True):
                found = blocks(html)
                text.append(main_text(
                    [path for path, _ in found], [said for _, said in found],
                    set(cut) if cut is not None else set(), set(important) if important is not None else set()))
            yield pd.DataFrame({"page": batch["page"], "url": batch["url"], "text": text})

    found = joined.select("page", "url", "html", "cut", "important").mapInPandas(
        write, "page string, url string, text string")
    return found.select(
        F.col("page").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text",
        F.length("text").cast("bigint").alias("n_chars"))
