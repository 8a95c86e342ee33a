"""Scalar functions over urls, texts, times and JSON: FLT, STR, URL, DAT, MIM, CHR, JSN and small MSC entries of the inventory."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mime, text, urls
from ..registry import query
from ..tables import Tables

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)"


def u(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url")


@query("flt_01_normalize_library", "SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS library FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.lower(F.trim(F.concat(F.lit("  "), "c_name", F.lit(" ")))).alias("library"))


@query("flt_02_normalize_version", "SELECT doc_id, lower(trim(coalesce(CASE WHEN lang = 'en' THEN NULL ELSE upper(lang) END, ''))) AS version FROM documents")
def _(t):
    return t.documents.select("doc_id", F.lower(F.trim(F.coalesce(F.when(F.col("lang") != "en", F.upper("lang")), F.lit("")))).alias("version"))


@query("flt_08_like_escape", r"SELECT page_id, regexp_replace(url, '([\\%_])', '\\\1', 'g') AS escaped FROM pages")
def _(t):
    return u(t).select("page_id", text.like_escape("url").alias("escaped"))


@query("flt_09_substring_any_case", "SELECT doc_id FROM documents WHERE contains(lower(text), lower('THE OF'))")
def _(t):
    return t.documents.where(F.contains(F.lower("text"), F.lower(F.lit("THE OF")))).select("doc_id")


@query("flt_10_literal_containment", "SELECT doc_id, n_chars FROM documents WHERE instr(text, 'License') > 0")
def _(t):
    return t.documents.where(F.instr("text", "License") > 0).select("doc_id", "n_chars")


@query("flt_11_pattern_kind", "SELECT page_id, CASE WHEN regexp_matches(p, '^/.+/$') THEN 'regex' ELSE 'glob' END AS kind FROM (SELECT page_id, " + _PATH + " AS p FROM pages)")
def _(t):
    return u(t).select("page_id", F.when(urls.path("url").rlike(r"^/.+/$"), "regex").otherwise("glob").alias("kind"))


@query("flt_12_match_any", f"SELECT page_id, regexp_matches(p, '^/?en/[^/]*$') OR regexp_matches(p, '^/?(?:.*/)?[^/]*\\.html$') OR regexp_matches(p, '/de/.*') AS matched FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def _(t):
    return u(t).select("page_id", urls.matches_any(urls.path("url"), ["/en/*", "**/*.html", "//de/.*/"]).alias("matched"))


@query("flt_13_host_pattern", f"SELECT page_id FROM pages WHERE regexp_matches({_HOST}, '^[^/]*\\.example\\.(?:com|org)$')")
def _(t):
    return u(t).where(urls.host("url").rlike("(?i)" + urls.glob_regex("*.example.{com,org}"))).select("page_id")


_PQ = f"(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || {_QUERY})"


@query("flt_14_include_exclude", f"SELECT page_id, regexp_matches({_PQ}, '^/?(?:.*/)?en/.*$') AND NOT regexp_matches({_PQ}, 'utm_|page=') AS admitted FROM pages")
def _(t):
    return u(t).select("page_id", urls.included("url", ["**/en/**"], ["/utm_|page=/"]).alias("admitted"))


def _like(glob: str) -> str:
    """A glob of the default list in RE2's terms."""
    if glob.startswith("/"):
        return glob[1:-1]
    parts = re.split(r"(\*\*/|\*\*|\*)", glob)
    return "^/?" + "".join({"**/": "(.*/)?", "**": ".*", "*": "[^/]*"}.get(x, re.escape(x)) for x in parts) + "$"


_LEFT_OUT = "|".join(f"({_like(g)})" for g in urls.DEFAULT_EXCLUDES).replace("'", "''")


@query("flt_15_default_exclusions", f"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '{_LEFT_OUT}') AND NOT regexp_matches({_PQ}, '{_LEFT_OUT}')")
def _(t):
    """Pages kept under the default file and folder globs."""
    return u(t).where(urls.included("url")).select("page_id", "url")


_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


@query("flt_16_scope_subpages", f"SELECT page_id FROM pages WHERE {_SCHEME} = 'https' AND {_HOST} = 'm.ththth.example.net' AND starts_with({_PATH}, '/en/')")
def _(t):
    return u(t).where(urls.in_scope("url", F.lit("https://m.ththth.example.net/en/index.html"), "subpages")).select("page_id")


@query("flt_17_scope_domain", rf"""SELECT page_id, {_HOST} = 'blog.ththan.example.net' AS same_host,
  CASE WHEN len(string_split({_HOST}, '.')) < 3 THEN {_HOST} ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END = 'example.net' AS same_domain FROM pages""")
def _(t):
    start = F.lit("http://blog.ththan.example.net/x")
    return u(t).select("page_id", urls.in_scope("url", start, "hostname").alias("same_host"), urls.in_scope("url", start, "domain").alias("same_domain"))


@query("flt_18_base_directory", rf"""SELECT page_id, CASE WHEN p = '' THEN '/' WHEN ends_with(p, '/') THEN p WHEN regexp_matches(p, '/index(\.[a-z0-9]+)?$') THEN regexp_replace(p, '[^/]*$', '') ELSE p || '/' END AS base FROM (SELECT page_id, {_PATH} AS p FROM pages)""")
def _(t):
    return u(t).select("page_id", urls.base_directory(urls.path("url")).alias("base"))


@query("flt_19_path_descendant", f"SELECT page_id, starts_with({_PATH} || '/', '/en/') AS below FROM pages")
def _(t):
    return u(t).select("page_id", urls.descendant(urls.path("url"), F.lit("/en")).alias("below"))


@query("flt_20_file_like", rf"""SELECT page_id, regexp_matches(l, '(?i)\.(?:html?|xhtml|php|aspx?|jsp|mdx?|markdown|txt|rst|adoc|json|ya?ml|xml|pdf)$') OR regexp_matches(l, '(?i)^index(\.[a-z0-9]+)?$') AS file_like
  FROM (SELECT page_id, regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1) AS l FROM pages)""")
def _(t):
    return u(t).select("page_id", urls.file_like(urls.path("url")).alias("file_like"))


@query("flt_21_crawl_admission", f"""WITH e(h, b) AS (VALUES ('blog.ththan.example.net', '/en/'), ('m.ththth.example.net', '/en/'), ('www.ththhe.example.com', '/'))
SELECT page_id FROM pages p WHERE NOT ends_with({_PATH}, '/llms.txt') AND EXISTS (SELECT 1 FROM e WHERE e.h = {_HOST} AND starts_with({_PATH}, e.b)) AND NOT regexp_matches({_PQ}, 'utm_')""")
def _(t):
    entries = t.spark.createDataFrame([("blog.ththan.example.net", "/en/"), ("m.ththth.example.net", "/en/"), ("www.ththhe.example.com", "/")], "h string, b string")
    x = u(t).where(~urls.path("url").endswith("/llms.txt") & urls.included("url", None, ["/utm_/"])).select("page_id", urls.host("url").alias("h"), urls.path("url").alias("p"))
    # three literal entry points
    return x.join(F.broadcast(entries), (x.h == entries.h) & x.p.startswith(entries.b), "left_semi").select("page_id")


_LINK = "unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1))"


def links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), 1)).alias("link"))


@query("flt_22_media_link", rf"SELECT page_id, count(*) AS n_media FROM (SELECT page_id, {_LINK} AS link FROM pages) WHERE regexp_matches(link, '\.(png|jpg|jpeg|gif)([?#].*)?$') GROUP BY page_id")
def _(t):
    return links(t).where(mime.is_binary_media(mime.detect("link")) & (mime.detect("link") != "image/svg+xml")).groupBy("page_id").agg(F.count("*").alias("n_media"))


@query("flt_23_archive_link", rf"SELECT page_id, link, regexp_matches(link, '(?i)\.(zip|tar|gz|tgz)$') AS archive FROM (SELECT page_id, {_LINK} AS link FROM pages)")
def _(t):
    return links(t).select("page_id", "link", F.col("link").rlike(r"(?i)\.(?:zip|tar|gz|tgz)$").alias("archive"))


#: Parts of the addresses of tracking images.
TRACKERS = (
    "adroll.com", "doubleclick.net", "google-analytics.com", "googletagmanager.com", "analytics.twitter.com", "twitter.com/1/i/adsct", "t.co/1/i/adsct", "bat.bing.com",
    "pixel.rubiconproject.com", "casalemedia.com", "tremorhub.com", "rlcdn.com", "facebook.com/tr", "linkedin.com/px", "quantserve.com", "scorecardresearch.com",
    "hotjar.com", "mouseflow.com", "crazyegg.com", "clarity.ms",
)


@query("flt_24_tracking_image", f"SELECT page_id, link, regexp_matches(link, '{'|'.join(x.replace('.', chr(92) + '.') for x in TRACKERS)}') AS tracker FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.googletagmanager.com' ELSE '' END || {_LINK} AS link FROM pages)")
def _(t):
    x = links(t).select("page_id", F.concat(F.when(F.col("page_id") % 2 == 0, "https://www.googletagmanager.com").otherwise(""), "link").alias("link"))
    return x.select("page_id", "link", F.col("link").rlike("|".join(s.replace(".", r"\.") for s in TRACKERS)).alias("tracker"))


@query("flt_25_needs_browser", r"""SELECT page_id, regexp_matches(html, '(?i)<frameset') OR (regexp_matches(html, '(?i)<script') AND length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) < 600) AS needs FROM pages""")
def _(t):
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " "), r"\s+", " ")
    return t.pages.select("page_id", (F.col("html").rlike("(?i)<frameset") | (F.col("html").rlike("(?i)<script") & (F.length(F.trim(bare)) < 600))).alias("needs"))


@query("flt_26_binary", "SELECT doc_id, contains(text, chr(0)) AS is_binary FROM documents")
def _(t):
    return t.documents.select("doc_id", F.coalesce(F.contains("text", F.lit("\0")), F.lit(False)).alias("is_binary"))


@query("prj_05_mime_coalesce", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(props, ''), 'unknown') AS label FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.nullif(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.lit("")), F.nullif("props", F.lit("")), F.lit("unknown")).alias("label"))


@query("prj_06_content_url", "SELECT page_id, coalesce(CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) END, url) AS content_url FROM pages")
def _(t):
    return u(t).select("page_id", F.coalesce(F.when(F.contains("url", F.lit("?")), F.substring_index("url", "?", 1)), "url").alias("content_url"))


# --- strings ---------------------------------------------------------------------------------------------------


@query("str_01_full_trim", r"SELECT doc_id, md5(regexp_replace(regexp_replace(chr(160) || text || chr(10) || chr(8195), '^[\s\x{A0}\x{2003}]+', ''), '[\s\x{A0}\x{2003}]+$', '')) AS trimmed FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.full_trim(F.concat(F.lit(" "), "text", F.lit("\n ")))).alias("trimmed"))


@query("str_02_format_bytes", """SELECT doc_id, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', floor(b / 1073741824.0::DOUBLE * 10 + 0.5) / 10) WHEN b >= 1048576 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) WHEN b >= 1024 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%d B', b) END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 2000) AS b FROM documents)""")
def _(t):
    return t.documents.select("doc_id", text.format_bytes(F.col("n_chars") * (1 + F.col("doc_id") % 2000)).alias("size"))


@query("str_03_collapsed", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.collapse("text")).alias("collapsed"))


@query("str_04_excerpt", """SELECT doc_id, CASE WHEN n <= 200 THEN text ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || substr(text, s, 200) || CASE WHEN s + 199 < n THEN '…' ELSE '' END END AS excerpt
  FROM (SELECT doc_id, text, length(text) AS n, greatest(1, least(instr(text, 'the') - 50, length(text) - 199)) AS s FROM documents WHERE instr(text, 'the') > 0)""")
def _(t):
    return t.documents.where(F.instr("text", "the") > 0).select("doc_id", text.excerpt("text", F.instr("text", "the")).alias("excerpt"))


@query("str_05_split_lines", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@query("str_06_strip_anchors", r"""SELECT page_id, trim(regexp_replace(regexp_replace(h, '\s*\{/\*.*?\*/\}\s*$', ''), '\s*\{#[^}]*\}\s*$', '')) AS heading FROM (SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) || CASE page_id % 3 WHEN 0 THEN ' {#top}' WHEN 1 THEN ' {/*a-b*/}' ELSE '' END AS h FROM pages)""")
def _(t):
    h = F.concat(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.when(F.col("page_id") % 3 == 0, " {#top}").when(F.col("page_id") % 3 == 1, " {/*a-b*/}").otherwise(""))
    return t.pages.select("page_id", text.strip_anchors(h).alias("heading"))


@query("str_07_reference_label", r"SELECT page_id, lower(trim(regexp_replace(url, '[/\s]+', ' ', 'g'))) AS label FROM pages")
def _(t):
    return u(t).select("page_id", F.lower(text.collapse(F.regexp_replace("url", r"[/\s]+", " "))).alias("label"))


@query("str_08_fence", "SELECT doc_id, repeat('`', greatest(3, 1 + CASE doc_id % 4 WHEN 0 THEN 0 ELSE 1 + doc_id % 5 END))::VARCHAR AS fence FROM documents")
def _(t):
    x = F.concat("text", F.when(F.col("doc_id") % 4 != 0, F.repeat(F.lit("`"), (1 + F.col("doc_id") % 5).cast("int"))).otherwise(F.lit("")), F.lit("x"))
    return t.documents.select("doc_id", text.fence(x).alias("fence"))


@query("str_10_fence_balance", "SELECT doc_id, ((length(x) - length(replace(x, '```', ''))) // 3) % 2 = 0 AS balanced FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '```' ELSE '' END AS x FROM documents)")
def _(t):
    return t.documents.select("doc_id", text.fences_balanced(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "```").otherwise(""))).alias("balanced"))


@query("str_11_presence", "SELECT page_id, length(trim(html)) > 0 AS has_content, length(trim(url)) > 0 AS has_url FROM pages")
def _(t):
    return t.pages.select("page_id", (F.length(F.trim("html")) > 0).alias("has_content"), (F.length(F.trim("url")) > 0).alias("has_url"))


@query("str_13_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ')) AS tokens FROM documents")
def _(t):
    x = text.tokens("text")
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.md5(F.array_join(x, " ")).alias("tokens"))


@query("str_14_suggestions", """WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), d AS (SELECT name, levenshtein(name, 'almond antique blu') / greatest(length(name), 18)::DOUBLE AS score FROM n)
SELECT name, round(score, 6) AS score FROM d WHERE score <= 0.7 ORDER BY score, name LIMIT 3""")
def _(t):
    wanted = "almond antique blu"
    n = t.part.select(F.lower("p_name").alias("name")).distinct()
    score = F.levenshtein("name", F.lit(wanted)) / F.greatest(F.length("name"), F.lit(len(wanted)))
    return n.withColumn("score", F.round(score, 6)).where("score <= 0.7").orderBy("score", "name").limit(3)


@query("str_15_markdown_escape", r"SELECT doc_id, md5(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g')) AS escaped FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(text.markdown_escape("text")).alias("escaped"))


@query("str_16_xml_entities", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS plain FROM pages")
def _(t):
    return t.pages.select("page_id", F.md5(text.xml_unescape("html")).alias("plain"))


# --- urls ------------------------------------------------------------------------------------------------------

_NORM = rf"""CASE WHEN n.s LIKE 'x%' THEN n.s ELSE n.s END"""


@query("url_01_normalize", rf"""SELECT page_id, CASE WHEN regexp_matches(short, '^[^/]+//[^/]+$') THEN short || '/' ELSE short END || q AS normalized FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(?i)/index\.(?:html?|asp|php|jsp)$', '/'), '^([^/]+//[^/]+/.*?[^/])/+$', '\1') AS short, {_QUERY} AS q FROM pages)""")
def _(t):
    return u(t).select("page_id", urls.normalize("url").alias("normalized"))


@query("url_02_validate", "SELECT page_id, regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS valid FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, '://', ':') ELSE url END AS x FROM pages)")
def _(t):
    return u(t).select("page_id", urls.valid(F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("://"), F.lit(":"))).otherwise(F.col("url"))).alias("valid"))


@query("url_03_primary_domain", rf"SELECT page_id, CASE WHEN len(string_split(h, '.')) < 3 THEN h WHEN ends_with(h, '.co.uk') THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS domain FROM (SELECT page_id, {_HOST} || CASE WHEN page_id % 4 = 0 THEN '.co.uk' ELSE '' END AS h FROM pages)")
def _(t):
    return u(t).select("page_id", urls.primary_domain(F.concat(urls.host("url"), F.when(F.col("page_id") % 4 == 0, ".co.uk").otherwise(""))).alias("domain"))


_MD = f"{_PATH} || CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.md.txt' ELSE '' END"


@query("url_04_markdown_twin", rf"SELECT page_id, regexp_matches(p, '(?i)(\.md\.txt|\.(md|mdx|markdown|mkd|mkdn|mkdown|mdown|mdwn|ronn))$') AS twin FROM (SELECT page_id, {_MD} AS p FROM pages)")
def _(t):
    end = F.when(F.col("page_id") % 4 == 0, ".md").when(F.col("page_id") % 4 == 1, ".md.txt").otherwise("")
    return u(t).select("page_id", urls.is_markdown_twin(F.concat(urls.path("url"), end)).alias("twin"))


@query("url_05_strip_markdown", r"""SELECT page_id, CASE WHEN regexp_matches(x, '(\.md\.txt|\.md)$') AND regexp_matches(x, '[^/]\.[^/.]*$') THEN
    CASE WHEN regexp_matches(x, '[^/]\.md\.txt$') THEN regexp_replace(x, '\.md\.txt$', '') ELSE regexp_replace(x, '\.[^/.]*$', '') END ELSE x END AS page FROM (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.md.txt' ELSE '' END AS x FROM pages)""")
def _(t):
    end = F.when(F.col("page_id") % 4 == 0, ".md").when(F.col("page_id") % 4 == 1, ".md.txt").otherwise("")
    return u(t).select("page_id", urls.strip_markdown_extension(F.concat(F.regexp_replace("url", r"[?#].*$", ""), end)).alias("page"))


@query("url_06_path_and_query", f"SELECT page_id, {_PQ} AS path_query FROM pages")
def _(t):
    return u(t).select("page_id", urls.path_and_query("url").alias("path_query"))


@query("url_07_host_dot", rf"SELECT page_id, regexp_replace({_HOST} || CASE WHEN page_id % 2 = 0 THEN '.' ELSE '' END, '\.$', '') AS host FROM pages")
def _(t):
    return u(t).select("page_id", F.regexp_replace(F.concat(urls.host("url"), F.when(F.col("page_id") % 2 == 0, ".").otherwise("")), r"\.$", "").alias("host"))


@query("url_08_resolve", rf"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS link FROM pages)")
def _(t):
    x = t.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), 1)).alias("link"))
    return x.select("page_id", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1), "link").alias("target"))


@query("url_10_for_evaluation", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', ''), '/$', ''), '\.md$', ''), '\.html$', '') AS page FROM pages")
def _(t):
    return u(t).select("page_id", urls.for_evaluation("url").alias("page"))


@query("url_11_bare", "SELECT page_id, split_part(url, '?', 1) AS bare FROM pages")
def _(t):
    return u(t).select("page_id", urls.bare("url").alias("bare"))


@query("url_12_twins", r"""SELECT page_id, CASE WHEN regexp_matches(x, '\.html?$') THEN regexp_replace(x, '\.html?$', '.md') || ' ' || x || '.md' ELSE x || '.md ' || x || '/index.md ' || x || '.html.md' END AS twins
  FROM (SELECT page_id, regexp_replace(split_part(regexp_replace(url, '#.*$', ''), '?', 1), '/+$', '') AS x FROM pages)""")
def _(t):
    return u(t).select("page_id", F.array_join(urls.twins("url"), " ").alias("twins"))


# --- times -----------------------------------------------------------------------------------------------------


@query("dat_01_now", "SELECT event_id, strftime(TIMESTAMP '2024-02-01 00:00:00', '%Y-%m-%d %H:%M:%S') AS now_text FROM events")
def _(t):
    """The instant is a parameter, so that results repeat."""
    return t.events.select("event_id", F.date_format(F.lit("2024-02-01 00:00:00").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("now_text"))


@query("dat_02_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query("dat_03_date", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query("dat_04_date_arithmetic", "SELECT o_orderkey, (CAST(o_orderdate AS DATE) - INTERVAL 7 DAY)::DATE AS before, (CAST(o_orderdate AS DATE) + INTERVAL 1 DAY)::DATE AS after FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_sub("o_orderdate", 7).alias("before"), F.date_add(F.to_date("o_orderdate"), 1).alias("after"))


@query("dat_05_window_clamp", "SELECT s_suppkey, greatest(1, least(366, CASE WHEN floor(s_acctbal) = 0 THEN 1 ELSE floor(s_acctbal) END))::BIGINT AS days FROM supplier")
def _(t):
    n = F.floor("s_acctbal")
    return t.supplier.select("s_suppkey", F.greatest(F.lit(1), F.least(F.lit(366), F.when(n == 0, 1).otherwise(n))).cast("long").alias("days"))


@query("dat_06_duration", """SELECT event_id, CASE WHEN s IS NULL THEN '—' WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, (s % 3600) // 60) ELSE printf('%dm %ds', s // 60, s % 60) END AS took FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT % 9000 END AS s FROM events)""")
def _(t):
    s = F.when(F.col("event_id") % 10 != 0, F.unix_timestamp("ts") % 9000)
    text_ = F.when(F.col("s").isNull(), "—").when(F.col("s") >= 3600, F.format_string("%dh %dm", F.expr("s div 3600"), F.expr("s % 3600 div 60"))).otherwise(F.format_string("%dm %ds", F.expr("s div 60"), F.expr("s % 60")))
    return t.events.select("event_id", s.alias("s")).select("event_id", text_.alias("took"))


@query("dat_07_relative", """SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN printf('%d min ago', m) WHEN m < 1440 THEN printf('%d h ago', m // 60) ELSE printf('%d d ago', m // 1440) END AS ago FROM (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01 00:00:00') // 60 AS m FROM events)""")
def _(t):
    m = F.floor((F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")) / 60)
    x = t.events.select("event_id", m.alias("m"))
    return x.select("event_id", F.when(F.col("m") < 1, "just now").when(F.col("m") < 60, F.format_string("%d min ago", "m")).when(F.col("m") < 1440, F.format_string("%d h ago", F.expr("m div 60"))).otherwise(F.format_string("%d d ago", F.expr("m div 1440"))).alias("ago"))


@query("dat_08_day_of_iso", "SELECT event_id, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 10) AS day FROM events")
def _(t):
    return t.events.select("event_id", F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, 10).alias("day"))


@query("dat_09_retry_after", """SELECT event_id, greatest(0, CASE WHEN event_id % 2 = 0 THEN (event_id % 300) * 1000 ELSE (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-15 00:00:00'))::BIGINT * 1000 END)::BIGINT AS wait_ms FROM events""")
def _(t):
    """Seconds, or an HTTP date, to milliseconds from an instant, not below zero."""
    head = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 300).cast("string")).otherwise(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    seconds = F.when(F.col("h").rlike(r"^\d+$"), F.expr("try_cast(h as bigint)")).otherwise(F.unix_timestamp(F.try_to_timestamp(F.substring("h", 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp")))
    return t.events.select("event_id", head.alias("h")).select("event_id", F.greatest(F.lit(0), seconds * 1000).cast("long").alias("wait_ms"))


@query("dat_10_indexed_at", "SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderdate END, TIMESTAMP '2024-01-01 00:00:00'), '%Y-%m-%dT%H:%M:%S.000Z') AS indexed_at FROM orders")
def _(t):
    at = F.coalesce(F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderdate").cast("timestamp")), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.orders.select("o_orderkey", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("indexed_at"))


# --- MIME, character sets --------------------------------------------------------------------------------------

_TYPES = ("text/html; charset=UTF-8", "Application/Node", "", "text/markdown", "application/json; charset=\"latin-1\"", "image/png", "text/x-python", "video/mp2t", "application/pdf", "text/x-c++src", "application/msword")
_PICK = "['" + "', '".join(_TYPES) + f"'][(event_id % {len(_TYPES)} + 1)::INT]"
_PARSED = f"""CASE m WHEN '' THEN 'application/octet-stream' WHEN 'application/node' THEN 'text/javascript' WHEN 'video/mp2t' THEN 'text/x-typescript' ELSE m END"""
_TYPED = f"(SELECT event_id, {_PARSED} AS mime FROM (SELECT event_id, lower(trim(split_part({_PICK}, ';', 1))) AS m FROM events))"


def typed(t: Tables) -> DataFrame:
    head = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    return t.events.select("event_id", head.alias("head"), mime.content_type(head).alias("mime"))


@query("mim_01_content_type", f"SELECT e.event_id, mime, CASE event_id % {len(_TYPES)} WHEN 0 THEN 'utf-8' WHEN 4 THEN 'latin-1' END AS charset FROM {_TYPED} e")
def _(t):
    return typed(t).select("event_id", "mime", mime.charset("head").alias("charset"))


@query("mim_02_text_kinds", f"SELECT event_id, mime = 'text/html' AS html, mime = 'text/markdown' AS markdown, starts_with(mime, 'text/') AND mime NOT IN ('text/html', 'text/markdown') AS plain, mime = 'application/json' AS json FROM {_TYPED}")
def _(t):
    return typed(t).select("event_id", mime.is_html("mime").alias("html"), mime.is_markdown("mime").alias("markdown"), mime.is_text("mime").alias("plain"), mime.is_json("mime").alias("json"))


@query("mim_03_safe_text", f"SELECT event_id, starts_with(mime, 'text/') OR mime = 'application/json' AS safe FROM {_TYPED}")
def _(t):
    return typed(t).select("event_id", mime.is_safe_text("mime").alias("safe"))


@query("mim_04_documents", f"SELECT event_id, mime IN ('application/pdf', 'application/msword') AS document FROM {_TYPED}")
def _(t):
    return typed(t).select("event_id", mime.is_document("mime").alias("document"))


@query("mim_05_binary_media", f"SELECT event_id, regexp_matches(mime, '^(image|video|audio|font)/') AS media FROM {_TYPED}")
def _(t):
    return typed(t).select("event_id", mime.is_binary_media("mime").alias("media"))


@query("mim_06_detect", f"SELECT page_id, CASE WHEN ends_with({_PATH}, '.html') THEN 'text/html' END AS mime FROM pages")
def _(t):
    return u(t).select("page_id", mime.detect("url").alias("mime"))


@query("mim_07_misfiled", f"SELECT event_id, {_PARSED} AS mime FROM (SELECT event_id, lower(trim(split_part({_PICK}, ';', 1))) AS m FROM events) WHERE m <> ''")
def _(t):
    return typed(t).where(F.col("head") != "").select("event_id", mime.normalized(F.substring_index("head", ";", 1)).alias("mime"))


@query("mim_08_language", f"SELECT event_id, CASE mime WHEN 'text/javascript' THEN 'javascript' WHEN 'text/x-typescript' THEN 'typescript' WHEN 'text/x-python' THEN 'python' WHEN 'text/x-c++src' THEN 'cpp' WHEN 'application/json' THEN 'json' ELSE '' END AS language FROM {_TYPED}")
def _(t):
    return typed(t).select("event_id", mime.language("mime").alias("language"))


@query("chr_01_meta_charset", "SELECT page_id, nullif(lower(regexp_extract(substr(html, 1, 1024), '(?i)<meta\\s+charset=[\"'']?([^\"''>\\s]+)', 1)), '') AS charset FROM pages")
def _(t):
    return t.pages.select("page_id", mime.meta_charset("html").alias("charset"))


@query("chr_02_resolved_charset", f"SELECT e.event_id, CASE e.event_id % {len(_TYPES)} WHEN 4 THEN 'latin1' ELSE 'utf-8' END AS charset FROM events e")
def _(t):
    return typed(t).select("event_id", mime.resolved_charset(F.lit("<p>"), "head", "mime").alias("charset"))


@query("chr_03_charset_alias", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'latin1' WHEN 1 THEN 'cp1252' WHEN 2 THEN 'utf-8' ELSE 'shift_jis' END AS charset FROM events")
def _(t):
    x = F.element_at(F.array(F.lit(" ISO-8859-1 "), F.lit("Windows-1252"), F.lit("UTF8"), F.lit("Shift_JIS")), (F.col("event_id") % 4 + 1).cast("int"))
    return t.events.select("event_id", mime.normalized_charset(x).alias("charset"))


@query("chr_04_decode", "SELECT doc_id, md5(text) AS decoded FROM documents")
def _(t):
    """Bytes in UTF-8, or else Latin-1; every third text is given in Latin-1 where that can hold it."""
    latin = (F.col("doc_id") % 3 == 0) & ~F.col("text").rlike(r"[^\x00-\x{FF}]") & F.col("text").rlike(r"[\x{C0}-\x{FF}] ")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return t.documents.select("doc_id", raw.alias("raw")).select("doc_id", F.md5(F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.decode("raw", "UTF-8")).otherwise(F.decode("raw", "ISO-8859-1"))).alias("decoded"))


@query("cnv_01_routing", f"""SELECT event_id, CASE WHEN mime = 'image/png' THEN NULL WHEN mime = 'application/json' THEN 'json' WHEN mime IN ('text/javascript', 'text/x-typescript', 'text/x-python', 'text/x-c++src') THEN 'source'
  WHEN mime IN ('application/pdf', 'application/msword') THEN 'document' WHEN mime = 'text/html' THEN 'html' WHEN mime = 'text/markdown' THEN 'markdown' ELSE 'text' END AS pipeline FROM {_TYPED}""")
def _(t):
    return typed(t).select("event_id", mime.pipeline("mime", F.lit("{}")).alias("pipeline"))


# --- JSON and arrays -------------------------------------------------------------------------------------------


@query("jsn_01_extract", "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS first_value FROM events")
def _(t):
    return t.events.select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first_value"))


@query("jsn_02_array_length", "SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.json_array_length(F.to_json(F.split("text", " ", -1))).cast("long").alias("n"))


@query("jsn_03_each", "SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def _(t):
    return t.events.select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@query("jsn_04_remove", "SELECT event_id, list_sort(json_keys(props))[2:]::VARCHAR AS rest FROM events")
def _(t):
    m = F.from_json("props", "map<string,string>")
    keys = F.array_sort(F.map_keys(m))
    kept = F.map_filter(m, lambda k, v: k != F.element_at(F.array_sort(F.map_keys(m)), 1))
    del keys
    return t.events.select("event_id", F.concat(F.lit("["), F.array_join(F.array_sort(F.map_keys(kept)), ", "), F.lit("]")).alias("rest"))


@query("jsn_05_merge_patch", """SELECT event_id, m ->> '$.a' AS a, m ->> '$.b' AS b FROM (SELECT event_id, json_merge_patch('{"a":"1","b":"2"}'::JSON, CASE WHEN event_id % 2 = 0 THEN '{"a":"x"}' ELSE '{"b":null}' END::JSON) AS m FROM events)""")
def _(t):
    """A patch over an object: its values win, its nulls delete."""
    old = F.from_json(F.lit('{"a":"1","b":"2"}'), "map<string,string>")
    patch = F.from_json(F.when(F.col("event_id") % 2 == 0, '{"a":"x"}').otherwise('{"b":null}'), "map<string,string>")
    merged = F.map_filter(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(patch, k)), patch), lambda k, v: v.isNotNull())
    return t.events.select("event_id", F.try_element_at(merged, F.lit("a")).alias("a"), F.try_element_at(merged, F.lit("b")).alias("b"))


@query("jsn_06_decode_or_empty", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE len(json_keys(props)) END::BIGINT AS n_keys FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return t.events.select("event_id", F.greatest(F.lit(0), F.coalesce(F.size(F.from_json(raw, "map<string,string>")), F.lit(0))).cast("long").alias("n_keys"))


@query("jsn_07_path_prefix", f"SELECT page_id, string_split({_PATH}, '/')[1:2] = ['', 'en'] AS below FROM pages")
def _(t):
    return u(t).select("page_id", (F.slice(F.split(urls.path("url"), "/", -1), 1, 2) == F.array(F.lit(""), F.lit("en"))).alias("below"))


@query("jsn_08_common_prefix", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'l/A' ELSE 'l' END AS prefix FROM lineitem")
def _(t):
    a, b = F.array(F.lit("l"), F.col("l_returnflag"), F.col("l_linestatus")), F.array(F.lit("l"), F.lit("A"), F.lit("?"))
    same = F.zip_with(a, b, lambda x, y: x == y)
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + F.when(s["go"] & x, 1).otherwise(0)).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(F.slice(a, F.lit(1), n), "/").alias("prefix"))


@query("jsn_09_push_pop", f"SELECT page_id, array_to_string(string_split({_PATH}, '/')[1:-2], '/') AS parent, {_PATH} || '/x' AS child FROM pages")
def _(t):
    p = F.split(urls.path("url"), "/", -1)
    return u(t).select("page_id", F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/").alias("parent"), F.array_join(F.array_append(p, F.lit("x")), "/").alias("child"))


@query("jsn_10_title", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'T' END, CASE WHEN event_id % 3 = 1 THEN 'N' END, 'Untitled') AS title FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 3 == 0, '{"title":"T","name":"x"}').when(F.col("event_id") % 3 == 1, '{"title":"","displayName":"N"}').otherwise('{"label":""}')
    field = lambda k: F.nullif(F.trim(F.get_json_object(raw, f"$.{k}")), F.lit(""))
    return t.events.select("event_id", F.coalesce(*[field(k) for k in ("title", "name", "displayName", "label")], F.lit("Untitled")).alias("title"))


@query("jsn_11_conditionals", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS positive, ifnull(nullif(c_nationkey, 3), -1)::BIGINT AS nation FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("other")).alias("segment"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("positive"), F.ifnull(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)).cast("long").alias("nation"))
