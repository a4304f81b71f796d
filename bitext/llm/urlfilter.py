"""URL filters whose decisions follow redirects: pages that redirect to each other, or name a canonical page, are
aliases, and what a rule says of one holds for those that no rule names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tags that make an edge, and where they name the other page.
TAG = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CONTENT_URL = r"""(?is)\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'>\s]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a page: host, path (``/`` if empty) and query. The scheme and the fragment do not count."""
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1))


def without_dots(url: Column) -> Column:
    """The url with the ``.`` and ``..`` segments of its path resolved."""
    path = path_of(url)
    parts = F.split(path, "/")
    up = lambda seen: F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda seen, x: F.when(x == "..", up(seen)).when(x == ".", seen).otherwise(F.concat(seen, F.array(x))))
    ends = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    plain = F.concat(F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1), F.lit("/"), F.array_join(kept, "/"), ends, F.regexp_extract(url, r"://[^?#]*([?#].*)$", 1))
    return F.when(path.rlike(r"/\.\.?(/|$)"), plain).otherwise(url)


def links(pages: DataFrame) -> DataFrame:
    """``src, dst``: urls of the pages, and of the pages that their canonical links and refresh redirects name, made
    absolute."""
    tags = F.when(F.col("html").rlike(r"(?i)canonical|http-equiv"), F.regexp_extract_all("html", F.lit(TAG), F.lit(0)))
    tag = pages.where("html is not null and url like '%://%'").select("url", F.explode(tags).alias("tag"))
    href = F.concat(*(F.regexp_extract("tag", HREF, k) for k in (1, 2, 3)))
    raw = F.when(F.col("tag").rlike(CANONICAL), href).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", CONTENT_URL, 1))
    found = tag.select("url", F.trim(F.replace(raw, F.lit("&amp;"), F.lit("&"))).alias("to")).where("to <> ''")
    scheme = F.regexp_extract("url", r"^([^:/?#]*):", 1)
    root = F.regexp_extract("url", r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^?#]*/)", 1)
    own = F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    target = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(root, F.col("to")))
        .when(F.col("to").rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))  # the page itself; mailto: and the like
        .when(F.col("to").startswith("?"), F.concat(root, F.when(own == "", "/").otherwise(own), F.col("to")))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), F.col("to")))
    )
    return found.select(F.col("url").alias("src"), target.alias("dst")).withColumn("dst", without_dots(F.col("dst"))).where("dst is not null and dst like '%://%'")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (columns ``host, path`` among them) with ``rule`` and ``said``: the longest of
    ``rules(host, path, verdict)`` whose host is the url's or a parent domain of it and whose path starts the url's.
    Of equally long ones an allowing one counts. The rules meet distinct hosts only."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(above).alias("above"))
    own = F.struct((F.length("rule_host") + F.length("rule_path")).alias("long"), (F.col("verdict") == "allow").alias("allows"), "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    per_host = hosts.join(named, F.col("above") == F.col("rule_host")).groupBy("host").agg(F.collect_list(own).alias("_rules"))
    fits = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return urls.join(per_host, "host", "left").withColumn("_best", fits).withColumns({"rule": F.col("_best.rule"), "said": F.col("_best.verdict")}).drop("_rules", "_best")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages(page_id, url, html)``.

    A url that a rule fits has that rule's verdict. Any other has its alias group's: pages are joined by their
    canonical links and refresh redirects, and by ``redirects(src, dst)`` of urls if given; a group in which a rule
    allows a url is allowed, else one in which a rule blocks a url is blocked, else it is allowed. Urls that are only
    linked to count as members.

    Null urls and urls without ``://`` have an empty host and path and no alias; null html has no links; repeated rows
    are returned each; an empty table gives no rows; other columns are ignored."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.col("url").like("%://%"), F.xxhash64(node_of(F.col("url")))).alias("node"))
    rows = saved(match_rules(rows, rules), "pages")
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select("src", "dst").where("src like '%://%' and dst like '%://%'"))
    edges = saved(edges, "aliases")
    ends = edges.select(F.xxhash64(node_of(F.col("src"))).alias("src"), F.xxhash64(node_of(F.col("dst"))).alias("dst"))
    groups = connected_components(ends)
    urls = edges.select(F.col("src").alias("url")).unionAll(edges.select(F.col("dst").alias("url"))).distinct()
    judged = match_rules(urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(node_of(F.col("url"))).alias("node")), rules)
    said = groups.join(judged, "node").groupBy("component").agg(F.max((F.col("said") == "allow").cast("int")).alias("allows"), F.max((F.col("said") == "block").cast("int")).alias("blocks"))
    blocked = groups.join(said.where("coalesce(allows, 0) = 0 and blocks = 1"), "component").select("node", F.lit("block").alias("followed"))
    out = rows.join(blocked, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "followed", F.lit("allow")).alias("verdict"))
