"""Writes: STO, SNK, STM-10/13/14 and SRC entries that are relational."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.batches import parts
from ..operators import ingest as ops
from ..registry import query
from ..sources import archives, listings, repositories


def pages(t):
    return t.pages.select("page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("markdown"))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


def writes(t):
    """Two writes for some urls: every second page again, with another text for every fourth."""
    p = pages(t)
    again = p.where("page_id % 2 = 0").withColumn("markdown", F.when(F.col("page_id") % 4 == 0, F.concat("markdown", F.lit("!"))).otherwise(F.col("markdown")))
    new = p.where("page_id % 10 = 1").select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat("url", F.lit("/new")).alias("url"), "title", "markdown")
    return again.union(new)


_WRITES = f"""w AS (SELECT page_id, url, {_TITLE} AS title, CASE WHEN page_id % 4 = 0 THEN html || '!' ELSE html END AS markdown FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id + 1000000, url || '/new', {_TITLE}, html FROM pages WHERE page_id % 10 = 1)"""


@query("sto_01_upsert", f"WITH {_WRITES} SELECT page_id, url, md5(markdown) AS body FROM w UNION ALL SELECT page_id, url, md5(html) FROM pages WHERE page_id NOT IN (SELECT page_id FROM w)")
def _(t):
    return ops.upsert(pages(t), writes(t), ["page_id"]).select("page_id", "url", F.md5("markdown").alias("body"))


@query("sto_02_insert_or_update", f"WITH {_WRITES} SELECT url, count(*) AS n FROM (SELECT url FROM w UNION ALL SELECT url FROM pages WHERE page_id NOT IN (SELECT page_id FROM w)) GROUP BY url")
def _(t):
    return ops.upsert(pages(t), writes(t), ["page_id"]).groupBy("url").agg(F.count("*").alias("n"))


@query("sto_03_get_or_create", "WITH k AS (SELECT row_number() OVER (ORDER BY source) AS id, source AS name FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0 AND source < 'src5')), n AS (SELECT DISTINCT source AS name FROM documents WHERE source NOT IN (SELECT name FROM k)) SELECT id, name FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY name), name FROM n")
def _(t):
    known = t.documents.where("doc_id % 2 = 0 and source < 'src5'").select(F.col("source").alias("name")).distinct()
    known = ops.counted(known, "name").select(F.col("n").alias("id"), "name")
    return ops.numbered(t.documents.select(F.col("source").alias("name")), known)


@query("sto_04_unchanged", f"WITH {_WRITES} SELECT w.page_id, CASE WHEN p.page_id IS NULL THEN 'new' WHEN p.html = w.markdown THEN 'unchanged' ELSE 'changed' END AS change FROM w LEFT JOIN pages p USING (page_id)")
def _(t):
    return ops.changes(pages(t), writes(t), ["page_id"])


@query("sto_05_vector_reuse", "SELECT d.doc_id AS id, e.vec_id IS NOT NULL AS reused FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND d.doc_id % 3 > 0")
def _(t):
    old = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page_id"), F.array("source").alias("path"), F.col("text").alias("content"), "embedding")
    new = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("page_id"), F.array("source").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    return ops.reused(new, old).select("id", F.col("embedding").isNotNull().alias("reused"))


@query("sto_06_empty_page", "SELECT doc_id AS page_id, md5(CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END) AS body, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS chunks FROM documents")
def _(t):
    empty = F.col("doc_id") % 50 == 0
    return t.documents.select(F.col("doc_id").alias("page_id"), F.md5(F.when(empty, "").otherwise(F.col("text"))).alias("body"), F.when(empty, 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("chunks"))


@query("sto_07_retire_previous", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT p.page_id FROM pages p JOIN pages q ON split_part(p.url, '#', 1) = split_part(q.url, '#', 1) AND q.page_id > p.page_id)")
def _(t):
    """Of addresses that turned out to be one page, the latest stays."""
    return t.pages.groupBy(F.substring_index("url", "#", 1).alias("u")).agg(F.max("page_id").alias("page_id")).select("page_id")


@query("sto_08_delete", "SELECT source AS library, count(*) AS pages, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents WHERE NOT (source = 'src1' AND lang = 'en') AND doc_id % 11 > 0 GROUP BY source")
def _(t):
    gone = t.documents.where("(source = 'src1' and lang = 'en') or doc_id % 11 = 0").select(F.col("doc_id").alias("page_id"))
    p, c = ops.deleted(t.documents.select(F.col("doc_id").alias("page_id"), F.col("source").alias("library")), t.chunks().select("page_id", "library"), gone)
    return p.groupBy("library").agg(F.count("*").alias("pages")).join(c.groupBy("library").agg(F.count("*").alias("chunks")), "library")


@query("sto_09_collapse_variants", r"SELECT page_id FROM pages WHERE page_id NOT IN (SELECT v.page_id FROM pages v JOIN pages b ON split_part(v.url, '?', 1) = b.url WHERE contains(v.url, '?') AND trim(regexp_replace(v.html, '\s+', ' ', 'g')) = trim(regexp_replace(b.html, '\s+', ' ', 'g')))")
def _(t):
    return ops.without(pages(t), ops.collapsible(pages(t)), ["page_id"]).select("page_id")


@query("sto_10_backlog_batches")
def _(t):
    """Waiting documents of each library in batches of a size budget; the fold is held against a plain one by a test."""
    waiting = t.documents.select("doc_id", "source", "n_chars").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return ops.batches(waiting, ["source"], "doc_id", "n_chars", 50_000)


@query("sto_13_model_change", "SELECT label, CASE WHEN label % 2 = 0 THEN 0 ELSE count(*) END::BIGINT AS vectors FROM embeddings GROUP BY label")
def _(t):
    """A model that changed takes its vectors with it; the partitions of others stay."""
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).select("label", F.when(F.col("label") % 2 == 0, 0).otherwise(F.col("n")).cast("long").alias("vectors"))


@query("sto_14_backfill", "SELECT vec_id, len(embedding)::BIGINT AS n FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, len(embedding) FROM embeddings WHERE vec_id % 3 > 0 AND len(embedding) = 64")
def _(t):
    have = t.embeddings.where("vec_id % 3 = 0").select("vec_id", F.size("embedding").cast("long").alias("n"))
    rest = t.embeddings.where("size(embedding) = 64").select("vec_id", F.size("embedding").cast("long").alias("n")).join(have.select("vec_id"), "vec_id", "left_anti")
    return have.union(rest)


@query("sto_15_status_fold", "SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type = 'purchase') AS progress FROM events GROUP BY 1")
def _(t):
    """Updates fold to the latest; a missing value keeps the one before."""
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max_by("value", F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("progress"))


@query("sto_16_migration", "SELECT l.id AS library_id, d.lang AS version, count(*) AS pages FROM documents d JOIN (SELECT row_number() OVER (ORDER BY source) AS id, source FROM (SELECT DISTINCT source FROM documents)) l USING (source) GROUP BY 1, 2")
def _(t):
    """Names in wide rows become a table of their own."""
    libs = ops.numbered(t.documents.select(F.col("source").alias("name")), t.spark.createDataFrame([], "id long, name string"))
    per = t.documents.groupBy(F.col("source").alias("name"), F.col("lang").alias("version")).agg(F.count("*").alias("pages"))
    return per.join(libs, "name").select(F.col("id").alias("library_id"), "version", "pages")


@query("stm_10_refresh_queue", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'delete' WHEN 2 THEN 'write' ELSE 'fail' END AS action FROM pages")
def _(t):
    got = t.pages.select("page_id", F.element_at(F.array(F.lit(304), F.lit(404), F.lit(200), F.lit(500)), (F.col("page_id") % 4 + 1).cast("int")).alias("status"))
    return ops.refreshed(t.pages, got)


@query("stm_13_stale_writes", "SELECT d.doc_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 5 > 0")
def _(t):
    """A vector lands only on the content that it was made of."""
    h = F.sha2("text", 256)
    made = t.embeddings.select(F.col("vec_id").alias("doc_id")).join(t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(h).alias("h")), "doc_id")
    return t.documents.select("doc_id", h.alias("h")).join(made, ["doc_id", "h"], "left_semi").select("doc_id")


@query("stm_14_order_independent", "SELECT k, arg_max(page_id, (m, p, page_id)) AS page_id FROM (SELECT split_part(url, '?', 1) AS k, page_id, contains(url, '#')::INT AS m, (page_id % 3 > 0)::INT AS p FROM pages) GROUP BY k")
def _(t):
    w = t.pages.select(F.substring_index("url", "?", 1).alias("k"), "page_id", F.contains("url", F.lit("#")).alias("is_markdown"), (F.col("page_id") % 3 == 0).alias("extra"), F.col("page_id").alias("seq"))
    return ops.winners(w, ["k"]).select("k", "page_id")


@query("snk_01_write_partitions", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _(t):
    """What a partitioned write lays out: rows by partition."""
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("snk_02_json_rows", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def _(t):
    return t.events.select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("line"))


@query("src_01_strategy", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'npm' WHEN 2 THEN 'pypi' WHEN 3 THEN 'github' ELSE 'web' END AS strategy FROM events""")
def _(t):
    u = F.element_at(F.array(*[F.lit(x) for x in ("file:///a/b", "https://www.npmjs.com/package/x", "https://pypi.org/project/x/", "https://github.com/a/b", "https://example.com/")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", listings.strategy(u).alias("strategy"))


@query("src_09_repository_tree", "SELECT page_id, 'docs/p' || page_id || '.md' AS path FROM pages")
def _(t):
    tree = F.concat(F.lit('{"tree":[{"path":"docs/p'), F.col("page_id").cast("string"), F.lit('.md","type":"blob"},{"path":"docs","type":"tree"},{"path":"src/a.py","type":"blob"},{"path":"docs/x.png","type":"blob"}]}'))
    trees = t.pages.select("page_id", F.lit("o").alias("owner"), F.col("page_id").cast("string").alias("repo"), F.lit("main").alias("branch"), tree.alias("listing"))
    return repositories.blobs(trees, "docs/").select(F.col("repo").cast("long").alias("page_id"), "path")


@query("src_10_repository_files", "SELECT event_id, event_id % 8 NOT IN (2, 5) AS readable FROM events")
def _(t):
    names = ("a/B.MD", "x/Dockerfile", "x/y.png", "a/.env.local", "b/poetry.lock", "b/blob.bin", "c/paper.pdf", "LICENSE.old")
    p = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    return t.events.select("event_id", repositories.readable(p).alias("readable"))


@query("src_11_sub_path", r"SELECT page_id, regexp_matches(p, '^en(/|$)') AS below FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS p FROM pages)")
def _(t):
    return t.pages.select("page_id", repositories.below(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/en/").alias("below"))


@query("src_16_best_attempt", "SELECT user_id, arg_min(event_type, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, event_id)) AS rung FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    """Of several ways to fetch, the first rung that succeeded."""
    rung = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.min_by("event_type", F.struct(rung, "event_id")).alias("rung"))


_SITEMAP = "'<urlset><url><loc>' || replace(url, '&', '&amp;') || '</loc></url><url><loc> https://x/' || page_id || ' </loc></url></urlset>'"


@query("src_18_sitemap", "SELECT page_id, url AS loc FROM pages UNION ALL SELECT page_id, 'https://x/' || page_id FROM pages")
def _(t):
    body = F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><loc> https://x/"), F.col("page_id").cast("string"), F.lit(" </loc></url></urlset>"))
    return listings.sitemap(t.pages.select("page_id", body.alias("body")), "body").select("page_id", "loc")


@query("src_19_robots", "SELECT page_id, url AS sitemap FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/map' || length(html) || '.xml' FROM pages WHERE page_id % 2 = 0")
def _(t):
    """One or two lists a file, in either case and with spaces before, among comments and other rules."""
    more = F.concat(F.lit("SITEMAP:"), F.regexp_extract("url", "^[a-z]+://[^/]+", 0), F.lit("/map"), F.length("html").cast("string"), F.lit(".xml\n"))
    body = F.concat(F.lit("# Sitemap: none\nUser-agent: *\n  Sitemap: "), "url", F.lit("\nDisallow: /x\n"), F.when(F.col("page_id") % 2 == 0, more).otherwise(""))
    return listings.robots_sitemaps(t.pages.select("page_id", body.alias("body")), "body").select("page_id", "sitemap")


@query("src_20_sitemap_tree")
def _(t):
    """Sitemaps that list sitemaps, walked level by level; the walk's cases are held in a test."""
    after = t.pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("after"))
    files = t.pages.join(after, "page_id", "left").select(F.col("url"), F.when(F.col("page_id") % 50 == 0, F.concat(F.lit("<sitemapindex><sitemap><loc>"), "after", F.lit("</loc></sitemap></sitemapindex>"))).otherwise(F.concat(F.lit("<urlset><url><loc>"), "url", F.lit("#p</loc></url></urlset>"))).alias("body"))
    roots = t.pages.where("page_id % 50 = 0").select("url")
    return listings.walk_sitemaps(roots, files)


@query("src_21_llms_txt", "SELECT page_id, 'Guides' AS section, url AS link, false AS optional FROM pages UNION ALL SELECT page_id, 'Optional', url || 'o', true FROM pages")
def _(t):
    body = F.concat(F.lit("# T\n> S\n\n## Guides\n- [A]("), "url", F.lit("): d\n\n## Optional\n- [B]("), "url", F.lit("o)\n"))
    return listings.llms_txt(t.pages.select("page_id", body.alias("body")), "page_id", "body").select("page_id", "section", "link", "optional")


@query("src_22_llms_candidates", r"SELECT page_id, array_to_string(list_distinct([b || '/llms.txt', p || '/llms.txt', r || '/llms.txt']), ' ') <> '' AS some FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS b, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS p, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS r FROM pages)")
def _(t):
    return t.pages.select("page_id", (F.size(listings.llms_candidates("url")) > 0).alias("some"))


@query("src_23_platform_index", "SELECT page_id, 'p' || page_id || '.html' AS doc FROM pages UNION ALL SELECT page_id, 'index.html' FROM pages")
def _(t):
    raw = F.concat(F.lit('{"docnames":["p'), F.col("page_id").cast("string"), F.lit('","index"]}'))
    return t.pages.select("page_id", F.explode(listings.sphinx_pages(raw)).alias("doc"))


_BLOB_BODY = "coalesce(text, '')"


@query("src_12_blob_pages", f"SELECT doc_id, 'd' || doc_id || '.txt' AS title, md5({_BLOB_BODY}) AS body, 0 AS n_links FROM documents")
def _(t):
    """The files of a repository's listing, from a snapshot of their contents."""
    number = F.col("doc_id").cast("string")
    repo = [F.lit("o").alias("owner"), F.concat(F.lit("r"), F.coalesce("source", F.lit(""))).alias("repo"), F.lit("main").alias("branch"), F.concat(F.lit("docs/d"), number, F.lit(".txt")).alias("path")]
    blobs = t.documents.select(*repo).withColumn("url", F.concat_ws("/", F.lit("https://github.com"), "owner", "repo", F.lit("blob"), "branch", "path"))
    contents = t.documents.select(*repo, F.lit("application/octet-stream").alias("mime"), F.coalesce("text", F.lit("")).alias("body"))
    x = repositories.blob_pages(blobs, contents)
    return x.select(F.regexp_extract("url", r"d(\d+)\.txt$", 1).cast("long").alias("doc_id"), "title", F.md5("markdown").alias("body"), F.size("links").alias("n_links"))


@query("src_13_wiki_pages", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Home' ELSE 'P' || page_id END AS title, CASE WHEN page_id % 5 = 0 THEN 1 ELSE 2 END AS n_links FROM pages WHERE page_id % 7 > 0")
def _(t):
    """Pages of a wiki, its root among them; links into other repositories go, and so do pages of no wiki."""
    number = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://github.com/o/r"), F.when(F.col("page_id") % 7 == 0, "/issues").otherwise(F.concat(F.lit("/wiki"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("/P"), number)))))
    body = F.concat(F.lit('<p><a href="/o/r/wiki/X'), number, F.lit('">a</a> <a href="https://github.com/o/q/wiki/Y">b</a> <a href="Z#f">c</a></p>'), "html")
    x = repositories.wiki_pages(t.pages.select("page_id", url.alias("url"), F.lit("text/html").alias("mime"), F.coalesce(body, F.lit("")).alias("body")))
    mine = F.filter("links", lambda u: u.rlike(r"/wiki/X\d+$|/Z(?:#f)?$"))
    return x.select("page_id", "title", F.size(mine).alias("n_links"))


def packed(t, name: str, pack):
    """Archives of fifty documents each, made in the tasks that read them: (path, content)."""
    import pyarrow as pa

    def run(batches):
        for b in parts(batches, 50, None):
            ids, texts = (b.column(k).to_pylist() for k in (0, 1))
            data = pack([(f"docs/d{k}.txt", (x or "").encode()) for k, x in zip(ids, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([f"{name.replace('*', str(ids[0]))}"]), pa.array([data], pa.binary())], names=["path", "content"])

    return t.documents.select("doc_id", "text").mapInArrow(run, "path string, content binary")


def zip_of(files) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docs/", b"")
        z.writestr("../out.txt", b"leads out")
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def tar_of(files) -> bytes:
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as z:
        for name, data in [*files, ("/etc/out.txt", b"leads out")]:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            z.addfile(i, io.BytesIO(data))
    return out.getvalue()


_BYTES = "octet_length(encode(coalesce(text, '')))"
_UNPACKED = f"SELECT doc_id, {_BYTES}::BIGINT AS length, sha256(coalesce(text, '')) AS body FROM documents"


def inner(x):
    return x.select(F.regexp_extract("path", r"/docs/d(\d+)\.txt$", 1).cast("long").alias("doc_id"), "length", F.sha2("content", 256).alias("body"))


@query("src_03_local_directory", f"SELECT sum({_BYTES} + 1)::BIGINT AS bytes FROM documents")
def _(t):
    """Every file of a folder at any depth: the texts written as lines, and read back as files."""
    from ..session import shared_path

    folder = shared_path(t.spark, "directory")
    t.documents.select(F.coalesce("text", F.lit("")).alias("text")).write.text(f"{folder}/sub/deep")
    return archives.files(t.spark, folder, "*.txt").agg(F.sum("length").cast("long").alias("bytes"))


@query("src_04_local_archive", f"SELECT doc_id, {_BYTES}::BIGINT AS length, md5(coalesce(text, '')) AS body FROM documents")
def _(t):
    """The text files of an archive as pages."""
    from ..operators import convert

    x = convert.converted(convert.source_pages(archives.unpacked(packed(t, "/data/a*.zip", zip_of))))
    return x.select(F.regexp_extract("url", r"d(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.octet_length("markdown").cast("long").alias("length"), F.md5("markdown").alias("body"))


@query("src_05_archive_member", f"{_UNPACKED} WHERE doc_id = (SELECT min(doc_id) FROM documents)")
def _(t):
    """One file of one archive, by the address of both; other archives stay closed."""
    first = t.documents.agg(F.min("doc_id")).first()[0]
    made = packed(t, "/data/a*.zip", zip_of)
    holder = archives.unpacked(made).where(F.col("path").endswith(f"/docs/d{first}.txt")).select("path").first()[0]
    return inner(archives.member(made, holder))


@query("src_06_zip", _UNPACKED)
def _(t):
    return inner(archives.unpacked(packed(t, "/data/a*.zip", zip_of)))


@query("src_07_tar", _UNPACKED)
def _(t):
    return inner(archives.unpacked(packed(t, "/data/a*.tar.gz", tar_of)))


@query("src_08_root_archive", "SELECT doc_id, 'https://h.org/docs.zip/docs/d' || doc_id || '.txt' AS url FROM documents")
def _(t):
    """A download that is an archive stands for its files; told by its type or its address."""
    got = packed(t, "https://h.org/docs.zip", zip_of).withColumn("mime", F.lit("application/octet-stream"))
    rest = t.pages.select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("mime"))
    x = archives.unpacked(archives.root_archives(got.unionByName(rest)))
    return x.select(F.regexp_extract("path", r"d(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.col("path").alias("url"))


@query("snk_03_compact", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    """A table of many small files written anew in few."""
    from ..session import shared_path

    many, few = shared_path(t.spark, "many"), shared_path(t.spark, "few")
    t.documents.repartition(32).write.parquet(many)
    ops.compacted(t.spark.read.parquet(many), few, 2)
    return t.spark.read.parquet(few).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
