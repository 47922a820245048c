"""URL filters: rules by host and path, and block decisions that follow redirects and canonical links.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule
wins. Pages that no rule fits take the decision of their aliases: documents that redirects or
canonical links tie together, directly or through others. If any alias is blocked by a rule, they
are blocked, whether that alias is a page of the table or only an address that a link or redirect
names; a page with an allow rule of its own stays allowed. All else is allowed.

Everything is a DataFrame expression or join. Links are read from the head of the page with regular
expressions; a table of observed redirects can be added.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and has
no aliases; null html has no links; repeated rows are judged one by one; an empty table gives no
rows. Extra columns of the input are kept by ``judge_urls`` unless they have the name of a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.llm.components import connected_components
from censemble.llm.quality import fresh, let
from censemble.operators.skew import split_join

# (verdict, host/path); the rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# Up to so many rules are one expression; longer lists, and tables of rules, are joined.
MOST_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = let(F.coalesce(url, F.lit("")), after_scheme)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(let(F.coalesce(url, F.lit("")), after_scheme), r"^[^/?#]*([^?#]*)", 1)


FIT = "struct<verdict:string,rule:string>"
Rules = Sequence[tuple[str, str]] | DataFrame


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """``struct<verdict, rule>`` of the longest rule that fits, or null; for short lists."""

    def first_fit(at: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(FIT))
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow")):
            rule_host, _, rest = rule.partition("/")
            fits = ((at["host"] == rule_host) | at["host"].endswith("." + rule_host)) & at["path"].startswith("/" + rest)
            out = out.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
        return out

    # Bound once: the conditions name host and path many times.
    return let(F.struct(host.alias("host"), path.alias("path")), first_fit)


def fitting_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, ``path`` and ``fit`` (as in ``fitting_rule``) of the addresses that a rule fits.

    ``addresses``: host, path. ``rules``: verdict, rule; any number, of equal rules an allowing one counts.
    A host is looked up by its endings at a dot, a path by its beginnings of the lengths that rules
    for that ending have. So an address makes a row per ending and length, never one per rule.
    """
    host, rest = F.substring_index("rule", "/", 1), F.regexp_extract("rule", r"(?s)^[^/]*/?(.*)$", 1)
    table = rules.groupBy("rule").agg(F.min("verdict").alias("verdict")).select(
        "rule", "verdict", host.alias("ending"), F.concat(F.lit("/"), rest).alias("beginning")
    )
    # One number: no ending of more labels is asked for, however long a host is.
    labels = table.agg(F.max(F.size(F.split("ending", r"\."))).alias("n")).first()["n"] or 1
    lengths = table.select("ending", F.length("beginning").alias("size")).distinct()
    parts = F.split(F.col("host"), r"\.")
    endings = let(parts, lambda p: F.transform(
        F.sequence(F.lit(1), F.least(F.size(p), F.lit(labels))), lambda n: F.array_join(F.slice(p, F.size(p) - n + 1, n), ".")
    ))
    asked = addresses.select("host", "path").distinct().withColumn("ending", F.explode(endings))
    probes = split_join(asked, lengths, ["ending"], "inner", spread_by=["host", "path"]).where(F.col("size") <= F.length("path"))
    probes = probes.select("host", "path", "ending", F.substring(F.col("path"), F.lit(1), F.col("size")).alias("beginning"))
    found = split_join(probes, table, ["ending", "beginning"], "inner", spread_by=["host", "path"])
    best = F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict"))
    return found.groupBy("host", "path").agg(best.alias("best")).select(
        "host", "path", F.struct(F.col("best.verdict").alias("verdict"), F.col("best.rule").alias("rule")).alias("fit")
    )


def with_fit(rows: DataFrame, rules: Rules, out: str, spread_by: Sequence[str]) -> DataFrame:
    """Adds ``out``, the rule that fits each row's host and path, or null; rows of one hot address
    are spread over tasks by ``spread_by``."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= MOST_RULES:
            return rows.withColumn(out, fitting_rule(F.col("host"), F.col("path"), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    fits = fitting_rules(rows, rules).withColumnRenamed("fit", out)
    return split_join(rows, fits, ["host", "path"], "left", spread_by=spread_by)


def url_key(url: Column) -> Column:
    """One name for a document's address: no scheme, fragment or campaign parameters."""
    return let(url, _key)


def _key(url: Column) -> Column:
    whole = F.regexp_replace(after_scheme(url), r"#.*$", "")
    plain = F.regexp_replace(whole, r"([?&])(utm_[^=&]*|gclid|fbclid)=[^&]*", "$1")
    tidy = F.regexp_replace(F.regexp_replace(plain, r"([?&])&+", "$1"), r"[?&]+$", "")
    rest = F.regexp_extract(tidy, r"(?s)^[^/?#]*(.*)$", 1)
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def _resolved(base: Column, href: Column) -> Column:
    """A link's address, seen from the page it stands in."""
    return let(F.struct(base.alias("base"), href.alias("href")), lambda x: _absolute(x["base"], x["href"]))


def _absolute(base: Column, href: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (href == ""), F.lit(None).cast("string"))
        .otherwise(F.concat(F.regexp_replace(folder, r"(?<=[^/])$", "/"), href))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: address keys tied by a canonical link or a refresh redirect in the page."""
    source = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(
        F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|http-equiv")
    )
    plain = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    tags = source.select("url", F.explode(F.regexp_extract_all(plain, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    refresh = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']?\s*\d+\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    href = F.when(
        F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), canonical
    ).when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""), refresh)
    target = _resolved(F.col("url"), F.replace(href, F.lit("&amp;"), F.lit("&")))
    return tags.select(url_key(F.col("url")).alias("a"), url_key(target).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )


def judge_urls(
    pages: DataFrame,
    rules: Rules = RULES,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Adds host, path, rule and verdict to every page.

    ``rules``: (verdict, host/path) pairs, or a table of verdict and rule of any length.
    ``redirects``: observed pairs ``(from_url, to_url)``, tied in like the links in the pages.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        seen = redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b"))
        edges = edges.unionByName(seen)
    aliases = connected_components(edges)
    ruled = pages.drop(*[c for c in pages.columns if c.lower() in RESULTS])
    key, own, bad = (fresh(pages, c) for c in ("key", "own", "bad"))
    ruled = ruled.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ruled = with_fit(ruled, rules, own, [url]).withColumn(key, url_key(F.col(url)))
    # Aliases need not be pages: a blocked site is seldom crawled. Pages are aliases too, if tied.
    address = F.concat(F.lit("://"), F.col("node"))
    named = with_fit(aliases.withColumn("host", host_of(address)).withColumn("path", path_of(address)), rules, "fit", ["node"])
    pages_named = ruled.where(F.col(own)["verdict"] == "block").select(F.col(key).alias("node")).join(aliases, "node").select("component")
    blocked = named.where(F.col("fit")["verdict"] == "block").select("component").unionByName(pages_named).distinct()
    infected = aliases.join(blocked, "component").select(F.col("node").alias(key), F.lit(True).alias(bad))
    out = ruled.join(infected, key, "left")
    verdict = F.coalesce(F.col(own)["verdict"], F.when(F.col(bad), "block").otherwise("allow"))
    return out.withColumn("rule", F.col(own)["rule"]).withColumn("verdict", verdict).drop(own, key, bad)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")
