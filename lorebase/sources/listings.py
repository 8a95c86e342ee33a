"""Lists of pages: sitemaps, robots, llms.txt, documentation indexes; and which source serves an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

#: Fixed value: sitemap files read in one run.
MAX_SITEMAPS = 500


def strategy(u: str | Column) -> Column:
    """file, npm, pypi, github or web."""
    x, h = urls.col(u), urls.host(u)
    return (
        F.when(urls.scheme(x) == "file", "file").when(h.isin("npmjs.com", "www.npmjs.com", "npmjs.org", "www.npmjs.org"), "npm").when(h.isin("pypi.org", "www.pypi.org"), "pypi")
        .when(h.isin("github.com", "www.github.com"), "github").when(urls.scheme(x).isin("http", "https"), "web")
    )


def locations(body: str) -> Column:
    found = F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1)
    return F.transform(found, lambda x: text.xml_unescape(x))


def sitemap(files: DataFrame, body: str) -> DataFrame:
    """files with ``loc`` for each location, and ``index``: whether the file lists sitemaps."""
    return files.select(*[c for c in files.columns if c != body], F.col(body).rlike(r"(?i)<sitemapindex").alias("index"), F.explode(locations(body)).alias("loc"))


def robots_sitemaps(files: DataFrame, body: str) -> DataFrame:
    return files.select(*[c for c in files.columns if c != body], F.explode(F.regexp_extract_all(body, F.lit(r"(?im)^[ \t]*sitemap:\s*(\S+)"), 1)).alias("sitemap"))


def walk_sitemaps(roots: DataFrame, files: DataFrame, most: int = MAX_SITEMAPS, depth: int = 10) -> DataFrame:
    """(loc): pages listed by the roots (url) and by what they list, over snapshot files (url, body). A level is one join; a file is read once, ``most`` at all (a run's limit), in order of address."""
    listed = sitemap(files, "body").select("url", "index", "loc")
    seen = roots.select("url").distinct().orderBy("url").limit(most)
    level, out = seen, None
    for _ in range(depth):
        rows = listed.join(level, "url")
        pages = rows.where("not index").select("loc")
        out = pages if out is None else out.union(pages)
        level = rows.where("index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        room = most - seen.count()
        if room <= 0 or level.isEmpty():
            break
        level = level.orderBy("url").limit(room)
        seen = seen.union(level)
    return out.distinct()


def llms_txt(files: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, title, section, name, link, note, optional) of each link, under the last H2 before it."""
    lines = files.select(id_col, F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1).alias("title"), F.posexplode(F.split(body, "\r?\n", -1)).alias("pos", "line"))
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^##\s+\S"), F.trim(F.regexp_replace("line", r"^##\s+", "")))
    rows = lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(F.col("line").rlike(r"^\s*[-*]\s*\[[^\]]*\]\([^)\s]+\)"))
    part = lambda i: F.regexp_extract("line", r"^\s*[-*]\s*\[([^\]]*)\]\(([^)\s]+)\)(?::\s*(.*?))?\s*$", i)
    return rows.select(id_col, "title", "section", part(1).alias("name"), part(2).alias("link"), F.nullif(part(3), F.lit("")).alias("note"), (F.lower("section") == "optional").alias("optional"))


def llms_candidates(u: str | Column) -> Column:
    """Where llms.txt may lie: at the address, its parent, the root."""
    x = F.regexp_replace(F.regexp_replace(urls.col(u), r"[?#].*$", ""), "/+$", "")
    root = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]+)", 1)
    return F.array_distinct(F.array(*[F.concat(p, F.lit("/llms.txt")) for p in (x, F.regexp_replace(x, r"([^/:])/[^/]*$", "$1"), root)]))


def sphinx_pages(raw: str | Column) -> Column:
    return F.transform(F.from_json(urls.col(raw), "struct<docnames:array<string>>")["docnames"], lambda x: F.concat(x, F.lit(".html")))


def mkdocs_pages(raw: str | Column) -> Column:
    """Of a search index: locations without fragments."""
    x = F.from_json(urls.col(raw), "struct<docs:array<struct<location:string>>>")["docs"]
    return F.array_distinct(F.transform(x, lambda d: F.regexp_replace(d["location"], "#.*$", "")))


def dokka_pages(raw: str | Column) -> Column:
    return F.array_distinct(F.transform(F.from_json(urls.col(raw), "array<struct<location:string>>"), lambda d: d["location"]))


def javadoc_pages(raw: str | Column) -> Column:
    """Of a type-search-index script: package path and class page."""
    body = F.regexp_extract(urls.col(raw), r"(?s)(\[.*\])", 1)
    return F.transform(F.from_json(body, "array<struct<p:string,l:string>>"), lambda d: F.concat(F.replace(F.coalesce(d["p"], F.lit("")), F.lit("."), F.lit("/")), F.lit("/"), d["l"], F.lit(".html")))
