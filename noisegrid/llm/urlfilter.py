"""URL rules whose block decisions follow redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import checkpoint, join_groups
from noisegrid.llm.graph import connected_components

#: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(after)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. The rules are a short literal list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def url_key(url: Column) -> Column:
    """A page's identity among links: host, path and query without scheme and fragment, an empty path being /; null
    without a host."""
    host = host_of(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolve(url: Column, href: Column) -> Column:
    """The absolute URL of a link on a page; null for an empty link, other schemes, and pages without a host."""
    scheme, page = r"^[A-Za-z][A-Za-z0-9+.-]*:", F.concat(F.lit("http://"), host_of(url))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    whole = (
        F.when(href.rlike(scheme + "//"), href)
        .when(href.rlike(scheme) | (href == ""), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(host_of(url) == "", F.lit(None).cast("string"))
        .when(href.startswith("#"), F.concat(page, path, query))
        .when(href.startswith("?"), F.concat(page, path, href))
        .when(href.startswith("/"), F.concat(page, href))
        .otherwise(F.concat(page, F.regexp_extract(path, "(?s)^(.*/)", 1), href))
    )
    tail = F.regexp_extract(whole, r"(?s)([?#].*)$", 1)
    return F.concat(F.lit("http://"), host_of(whole), without_dots(path_of(whole)), tail)


def without_dots(path: Column) -> Column:
    """The path without its . and .. segments, as browsers resolve them."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(kept, "/")).otherwise(path)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of pages and of the targets of their redirects (meta refresh) and canonical links.

    A target with a scheme at its start stands for itself; one that begins with // has the page's scheme, others are
    taken from the page's host, path or directory. Character references for & are read. Targets in other schemes and
    pages without such links or without a host give none.
    """
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    value = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tags = F.when(html.rlike("(?i)canonical|refresh"), F.expr("""regexp_extract_all(html, '(?i)<(?:link|meta)\\\\b[^>]*>', 0)""")).otherwise(F.array().cast("array<string>"))
    tag = pages.select("url", F.explode(tags).alias("tag"))
    one = lambda pattern: F.concat(*[F.regexp_extract("tag", pattern, k) for k in (1, 2, 3)])
    refresh = F.regexp_extract(one(rf"(?i)\bcontent\s*=\s*{value}"), r"""(?i)\burl\s*=\s*["']?\s*([^"']+)""", 1)
    is_link = F.col("tag").rlike(r"(?i)^<link\b") & F.lower(one(rf"(?i)\brel\s*=\s*{value}")).rlike(r"(?:^|\s)canonical(?:\s|$)")
    is_meta = F.col("tag").rlike(r"(?i)^<meta\b") & (F.lower(F.trim(one(rf"(?i)\bhttp-equiv\s*=\s*{value}"))) == "refresh")
    href = F.when(is_link, one(rf"(?i)\bhref\s*=\s*{value}")).when(is_meta, refresh)
    full = resolve(url, F.regexp_replace(F.trim(href), "(?i)&(?:amp|#38|#x26);", "&"))
    return tag.select(url_key(url).alias("a"), url_key(full).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Each page's verdict: (page_id, host, path, rule, verdict, component).

    A page's own rule decides, so that an explicit allow holds against blocked aliases. Of the other pages, one whose
    component (over redirects and canonical links, `edges`, by default those in the html) holds a URL that a rule
    allows is allowed; else one whose component holds a blocked URL is blocked; the rest get `default`. Null or
    hostless urls have empty host and path and belong to no component. Repeated rows are judged alike; an empty table
    gives no rows.
    """
    rules = RULES if rules is None else rules
    edges = checkpoint(link_edges(pages) if edges is None else edges.select("a", "b"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    # a hostless url's key is its own and meets none, so that such urls don't meet in one task
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("/"), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string"))))
    rule, own = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), own.alias("own"))
    linked = connected_components(edges)
    members = linked.union(linked.select("root", "root").distinct())
    key_url = F.concat(F.lit("http://"), F.col("node"))
    _, known = match_rules(host_of(key_url), path_of(key_url), rules)
    verdicts = members.select("root", known.alias("known")).groupBy("root").agg(F.count("*").alias("n"), F.max(F.col("known") == "allow").alias("allowed"), F.max(F.col("known") == "block").alias("blocked"))
    aliases = join_groups(members, checkpoint(verdicts), "root", "n").select(F.col("node").alias("key"), F.col("root").alias("component"), "allowed", "blocked")
    joined = rows.join(aliases, "key", "left")
    verdict = F.coalesce("own", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block"), F.lit(default))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
