"""Main text of web pages: markup first, then repeats among the pages of a host.

A page is cut into blocks of text, each in one of three zones: inside a declared article or main
element; inside a menu, header, footer, sidebar, notice, advert, form or comment section; or open.
If a page declares its article, that is its text: copies of an article, and passages that
many articles share, are text and stay. (Cutting what repeats inside articles would cut those.) Repeats decide
there too: a block of an article goes if repeats of the host's outer text cover all of it and it stands in
``REPEAT_PAGES`` different articles or more, such as a notice that is also put between paragraphs. A title that
many sidebars show is in one article only, and stays; nor does an article go as a whole.
A declared article below an element that only its class or id names an aside is text too if the page
declares no more elsewhere, and one below a form always is. Where several articles are declared and
the open text is longer than each, they are teasers, and open like the rest of the page; so is a
form that holds more than the open text. Class names count whole: ``site-footer``, not ``has-footer``.
Pages that declare none have only their open blocks, and there repeats decide: what stands outside
articles makes the token stream of a page, the streams of a host are put end to end, and substrings
of ``REPEAT_TOKENS`` or more tokens that lie in ``REPEAT_PAGES`` distinct pages or more, and in a share
of ``REPEAT_SHARE`` of the host's distinct pages or more, are boilerplate. Their tokens go, the other
runs stay: a passage quoted on a few pages is text on each of them.

Suffixes that share their first ``REPEAT_TOKENS`` tokens are neighbours in the host's suffix array,
and longer repeats are unions of such prefixes; so the array is kept as groups of equal prefixes,
one row each, reduced before the shuffle to the number of distinct pages that have it. No task sees
a whole host, and a prefix on every page of a hot host costs one row per map task. Pages of a host
count as one page if their addresses are equal, or their streams and articles but for numbers and the names of
months and days; so a page crawled on many days is not its own boilerplate.

Defined results: null html is empty, and so is its text; a null url, or one without ``://``, has an
empty host, whose pages have nothing in common, so that all their open text stays; repeated rows give repeated results; an empty table gives
no rows. Extra columns of the input are never read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.llm.flat import sliced
from censemble.llm.quality import let
from censemble.llm.urls import host_of, url_key
from censemble.session import stored

REPEAT_TOKENS = 8
REPEAT_PAGES = 4
REPEAT_SHARE = 0.2
# Tokens that may differ between crawls of one page.
DATED = (
    r"(?i)^\P{L}*\p{N}.*|^\W*(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?"
    r"|nov(ember)?|dec(ember)?|(mon|tues|wednes|thurs|fri|satur|sun)day|mon|tue|wed|thu|fri|sat|sun|am|pm)\W*$"
)

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never text of the page.
RAW_TAGS = "script|style|noscript|template|textarea|iframe|object|svg|math|select|button|audio|video|canvas"
MAIN_TAGS = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("nav menu aside footer form dialog head fieldset".split())
ASIDE_ROLES = frozenset(
    "navigation menu menubar banner contentinfo complementary search form dialog alert alertdialog".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
ADVERT_WORDS = frozenset("ad ads adbox advert adverts advertisement sponsor sponsored promo promoted".split())
ASIDE_WORDS = COMMENT_WORDS | ADVERT_WORDS | frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar widget related recommended "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall "
    "share sharing social footer skip".split()
)
HEADER_WORDS = frozenset("header masthead banner topbar".split())
# Articles below these are never the page's own.
OTHERS_WORDS = COMMENT_WORDS | ADVERT_WORDS | {"related", "recommended"}
# Words that may stand beside a known one in a class or id: site-footer, comment-list.
PLACE_WORDS = frozenset(
    "site page main global top bottom left right primary secondary area bar block body box buttons container inner "
    "item items line links list posts section wrap wrapper".split()
)
_NOT_NAMED_BY_ID = frozenset("h1 h2 h3 h4 h5 h6 section".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(?P<empty>svg|math)\b(?:[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+/>
    |<(?P<raw>{RAW_TAGS})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<more>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<more2>[^>]*)>
    |<[!?/][^>]*>""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([a-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
# Tags that end an open paragraph or list item.
_ENDS_P = BLOCK_TAGS - {"caption", "legend", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}

OPEN, ASIDE, MAIN = 0, 1, 2
# Undecided until the whole page is seen: asides by class or id, forms, and articles below the former.
NAMED, FORM, BELOW = 3, 4, 5


def _known(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id is one of the words, alone or with words that only say its place."""
    parts = _WORD.findall(name)
    return any(x in words for x in parts) and all(x in ASIDE_WORDS or x in HEADER_WORDS or x in PLACE_WORDS for x in parts)


def _zone(tag: str, more: str, inside_main: bool) -> int:
    """What an element makes of its content: ASIDE, MAIN, NAMED, FORM, or nothing (OPEN)."""
    classes: list[str] = []
    ids: list[str] = []
    role = ""
    if more and not more.isspace():
        for name, value in _ATTRIBUTE.findall(more):
            name = name.lower()
            value = value.strip("\"'").lower()
            if name == "class":
                classes += value.split()
            elif name == "id":
                ids += value.split()
            elif name == "role":
                role = value
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return ASIDE
            elif name == "style" and "display:none" in value.replace(" ", ""):
                return ASIDE
            elif name == "itemprop" and value == "articlebody":
                return MAIN
    # An id of a heading or section is a link's target, made from its title.
    names = classes if tag in _NOT_NAMED_BY_ID or "section" in classes else classes + ids
    if tag in MAIN_TAGS or role in ("main", "article"):
        return ASIDE if any(_known(x, COMMENT_WORDS | ADVERT_WORDS) for x in names) else MAIN
    if tag in ("html", "body"):
        return OPEN
    if any(_known(x, OTHERS_WORDS) for x in names):
        return ASIDE
    if tag == "form" or role == "form":
        return FORM
    if tag in ASIDE_TAGS or role in ASIDE_ROLES:
        return ASIDE
    if any(_known(x, ASIDE_WORDS) for x in names):
        return NAMED
    if not inside_main:
        if tag == "header":
            return ASIDE
        if any(_known(x, HEADER_WORDS) for x in names):
            return NAMED
    return OPEN


def _inside(outer: int, made: int) -> int:
    """The zone of an element's content, from the zone around it."""
    if made == OPEN or outer == ASIDE:
        return outer
    if made == MAIN:
        return BELOW if outer in (NAMED, BELOW) else MAIN
    # A form in an aside changes nothing, nor does an aside by name.
    return NAMED if made == FORM and outer == NAMED else made


def _decided(found: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """Blocks with undecided zones told by the whole page; the second number is the declared element's."""

    def size(zone: int) -> int:
        return sum(len(t) for z, _, t in found if z == zone)

    told = {z: z for z in (OPEN, ASIDE, MAIN)} | {NAMED: ASIDE, FORM: ASIDE, BELOW: ASIDE}
    if size(BELOW) >= max(size(MAIN), 1):
        told[BELOW] = MAIN
    if size(FORM) > size(OPEN):
        told[FORM] = OPEN
    per_article: dict[int, int] = {}
    for z, number, t in found:
        if told[z] == MAIN:
            per_article[number] = per_article.get(number, 0) + len(t)
    if not per_article and not any(told[z] == OPEN for z, _, _ in found):
        told[NAMED] = OPEN
    # Numbers below 0 are of main elements and the like: no teasers.
    open_size = sum(len(t) for z, _, t in found if told[z] == OPEN)
    if len(per_article) > 1 and min(per_article) > 0 and max(per_article.values()) < open_size:
        told = {z: OPEN if to == MAIN else to for z, to in told.items()}
    return [(told[z], t) for z, _, t in found]


def blocks_of(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order, as (zone, text); references decoded, white space made single."""
    out: list[tuple[int, int, str]] = []
    text: list[str] = []
    # Tag, what it makes of its content, the zone inside, and the number of the declared element.
    stack: list[tuple[str, int, int, int]] = []
    zone, number, declared = OPEN, 0, 0

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                out.append((zone, number, words))

    def pop_to(at: int) -> None:
        nonlocal zone, number
        del stack[at:]
        zone, number = stack[-1][2:] if stack else (OPEN, 0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["raw"] or m["empty"]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            text.append(" ")
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in BLOCK_TAGS and any(x[1] for x in stack[i:]):
                        flush()
                    pop_to(i)
                    break
            continue
        if tag in VOID_TAGS:
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name == "li" == tag:
                    pop_to(i)
                    break
                if name in BLOCK_TAGS:
                    break
        more = m["more"] or m["more2"] or ""
        if more.endswith("/") and tag not in BLOCK_TAGS:
            continue
        made = _zone(tag, more, zone in (MAIN, BELOW))
        if made and tag not in BLOCK_TAGS:
            flush()
        outer, zone = zone, _inside(zone, made)
        if zone in (MAIN, BELOW) and zone != outer and number == 0:
            declared += 1
            number = declared if tag == "article" else -declared
        stack.append((tag, made, zone, number))
    if at < len(page):
        piece = page[at:]
        # A tag cut off at the end of the page is no text.
        cut = re.search(r"<(?:/?[a-zA-Z!?])[^>]*\Z", piece)
        piece = piece[: cut.start()] if cut else piece
        text.append(entities.unescape(piece))
    flush()
    return _decided(out)


def parse_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``inside`` (the declared article's blocks, none if none is declared) and ``outside``: other blocks in order."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    outside = pa.list_(pa.struct([("open", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "html"):
                inner, others = [], []
                for page in batch.column("html").to_pylist():
                    blocks = blocks_of(page)
                    inner.append([t for z, t in blocks if z == MAIN])
                    others.append([{"open": z == OPEN, "text": t} for z, t in blocks if z != MAIN])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(inner, pa.list_(pa.string())), pa.array(others, outside)],
                    names=["page_id", "url", "inside", "outside"],
                )

    schema = f"page_id {kind}, url string, inside array<string>, outside array<struct<open:boolean,text:string>>"
    return rows.mapInArrow(run, schema)


def _tokens(outside: Column) -> Column:
    return F.flatten(F.transform(outside, lambda b: F.split(b["text"], " ")))


def _prefixes(tokens: Column, length: int) -> Column:
    """For every place the hash of the ``length`` tokens from there on."""

    def all_of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - length)
        each = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(length)]))
        return F.when(F.size(h) >= length, each).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), all_of)


def _words(blocks: str) -> Column:
    return F.flatten(F.transform(blocks, lambda b: F.split(b, " ")))


def _undated(tokens: Column) -> Column:
    """A hash of the tokens but numbers and dates."""
    return F.xxhash64(F.filter(tokens, lambda t: ~t.rlike(DATED)))


def distinct_pages(streams: DataFrame) -> DataFrame:
    """``(host, outside)``: one stream of those that differ in dates and numbers only, and one of an address."""
    named = streams.withColumn("undated", _undated(F.concat(_tokens(F.col("outside")), _words("inside"))))
    # The texts of one page of many go to the shuffle: the smallest of a map task, then of all.
    one = named.groupBy("host", "undated").agg(
        F.min("address").alias("address"), F.min(F.struct("stream", "outside")).alias("first")
    )
    # Without an address no page has an equal one.
    one = one.withColumn("address", F.coalesce("address", F.col("undated").cast("string")))
    return one.groupBy("host", "address").agg(F.min("first").alias("first")).select("host", "first.outside")


def _streams(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        host_of(F.col("url")).alias("host"), url_key(F.col("url")).alias("address"), F.xxhash64("outside").alias("stream"),
        "outside", "inside", (F.size("inside") == 0).alias("bare"),
    )


def repeated_prefixes(parsed: DataFrame, length: int = REPEAT_TOKENS) -> DataFrame:
    """``(host, prefix)``: hashes of ``length`` tokens that repeat in the outer text of the host's pages."""
    distinct = stored(distinct_pages(_streams(parsed).where(F.col("host") != "")), "distinct")
    of_host = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # Each page has a prefix once, so rows are pages.
    prefixes = distinct.select("host", F.explode(F.array_distinct(_prefixes(_tokens(F.col("outside")), length))).alias("prefix"))
    return (
        prefixes.groupBy("host", "prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= REPEAT_PAGES)
        .join(of_host, "host")
        .where(F.col("n") >= REPEAT_SHARE * F.col("pages"))
        .select("host", "prefix")
    )


def _without_repeats(found: DataFrame, repeated: DataFrame, length: int) -> DataFrame:
    """``(host, stream, text)``: the open text of ``(host, stream, outside)`` outside repeated substrings."""
    places = found.select("host", "stream", F.posexplode(_prefixes(_tokens(F.col("outside")), length)).alias("at", "prefix"))
    hits = places.join(repeated, ["host", "prefix"]).groupBy("host", "stream").agg(F.collect_set("at").alias("hits"))
    return _uncovered(found.join(hits, ["host", "stream"], "left"), length)


def unique_runs(parsed: DataFrame, repeated: DataFrame, length: int = REPEAT_TOKENS) -> DataFrame:
    """``(host, stream, text)``: for pages without an article, open text outside repeated substrings."""
    # Equal streams of a host have equal results.
    bare = _streams(parsed).where("bare").groupBy("host", "stream").agg(F.first("outside").alias("outside"))
    return _without_repeats(bare, repeated, length)


def furniture(parsed: DataFrame, repeated: DataFrame, length: int = REPEAT_TOKENS) -> DataFrame:
    """``(host, gone)``: the article blocks that repeats cover whole, and that ``REPEAT_PAGES`` different
    articles of the host hold. A block that does not begin with a repeat is not covered, so the texts of
    few blocks are shuffled."""
    host = host_of(F.col("url"))
    articles = parsed.where((host != "") & (F.size("inside") > 0)).select(
        host.alias("host"), "inside", _undated(_words("inside")).alias("article")
    )
    blocks = articles.select("host", "article", F.explode(F.array_distinct("inside")).alias("text"))
    tokens = F.split("text", " ")
    first = F.xxhash64(*[F.xxhash64(F.get(tokens, i)) for i in range(length)])
    begins = blocks.where(F.size(tokens) >= length).withColumn("prefix", first).join(repeated, ["host", "prefix"])
    shared = begins.groupBy("host", "text").agg(F.count_distinct("article").alias("n")).where(F.col("n") >= REPEAT_PAGES)
    held = shared.select(
        "host", F.xxhash64("text").alias("stream"), F.array(F.struct(F.lit(True).alias("open"), F.col("text").alias("text"))).alias("outside")
    )
    covered = _without_repeats(held, repeated, length).where(F.col("text") == "").select("host", "stream")
    return covered.groupBy("host").agg(F.collect_set("stream").alias("gone"))


def _uncovered(found: DataFrame, length: int) -> DataFrame:
    """``(host, stream, text)``: the open blocks without the tokens that ``hits`` (begins of repeated
    prefixes) cover. One pass over a page's tokens, however many repeats it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, hits in zip(batch.column("outside").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                tokens = [b["text"].split(" ") for b in blocks]
                change = np.zeros(sum(map(len, tokens)) + 1, dtype=np.int64)
                begins = np.array(hits or [], dtype=np.int64)
                change[begins] += 1
                change[begins + length] -= 1
                covered = (np.cumsum(change) > 0).tolist()
                left, at = [], 0
                for block, words in zip(blocks, tokens, strict=True):
                    if block["open"]:
                        left.append(" ".join(w for w, gone in zip(words, covered[at : at + len(words)], strict=True) if not gone))
                    at += len(words)
                texts.append("\n".join(t for t in left if t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("stream"), pa.array(texts, pa.string())], names=["host", "stream", "text"]
            )

    return found.select("host", "stream", "outside", "hits").mapInArrow(run, "host string, stream bigint, text string")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    parsed = stored(parse_pages(pages, page_id, url, html), "pages")
    # Read by both kinds of pages, and small: prefixes on a fifth of a host's pages.
    repeated = stored(repeated_prefixes(parsed), "repeats")
    pages_of = parsed.withColumn("host", host_of(F.col("url")))
    # Stored, so that Spark knows its size and shuffles no page while it is small.
    gone = stored(furniture(parsed, repeated), "furniture")
    articles = pages_of.where(F.size("inside") > 0).join(gone, "host", "left")
    kept = F.filter("inside", lambda b: ~F.coalesce(F.array_contains("gone", F.xxhash64(b)), F.lit(False)))
    declared = articles.select("page_id", "url", F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.col("inside")), "\n").alias("text"))
    bare = pages_of.where(F.size("inside") == 0).select("page_id", "url", "host", F.xxhash64("outside").alias("stream"))
    found = bare.join(unique_runs(parsed, repeated), ["host", "stream"], "left")
    return declared.unionByName(found.select("page_id", "url", F.coalesce("text", F.lit("")).alias("text")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
