"""Catalog, statistics, activity and health: AGG, RET-17..22 and MSC entries of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..operators import context
from ..registry import query
from ..tables import CHUNKS, Tables

_CATALOG = f"""WITH {CHUNKS}, per AS (SELECT c.library, c.version, c.page_id, count(*) AS n, count(*) FILTER (e.vec_id IS NULL) AS pending FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.page_id AND c.sort_order = 0 GROUP BY 1, 2, 3)
SELECT library, version, count(*) AS pages, min(page_id) AS first_page, sum(n)::BIGINT AS chunks, count(*) FILTER (pending > 0) AS pending_pages, count(*) - count(*) FILTER (pending > 0) AS embedded_pages FROM per GROUP BY 1, 2"""


def page_counts(t: Tables) -> DataFrame:
    """(library, version, page_id, n, pending): chunks of each page and those without a vector; vectors belong to first lines."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    pages = t.documents.select(F.col("source").alias("library"), F.col("lang").alias("version"), F.col("doc_id").alias("page_id"), n.alias("n"))
    have = t.embeddings.select(F.col("vec_id").alias("page_id"), F.lit(1).alias("has"))
    return pages.join(have, "page_id", "left").select("library", "version", "page_id", "n", (F.col("n") - F.coalesce("has", F.lit(0))).alias("pending"))


@query("agg_01_catalog", _CATALOG)
def _(t):
    return ops.catalog(page_counts(t))


@query("agg_02_version_stats", f"WITH {CHUNKS} SELECT count(DISTINCT page_id) AS pages, count(*) AS chunks, count(e.vec_id) AS embedded, round(count(*) / nullif(count(DISTINCT page_id), 0), 6) AS avg_chunks FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.page_id AND c.sort_order = 0 WHERE library = 'src1' AND version = 'en'")
def _(t):
    per = page_counts(t).where("library = 'src1' and version = 'en'")
    # pages are rows here, so the distinct count is a plain one
    return per.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.col("n") - F.col("pending")), F.lit(0)).alias("embedded"), F.round(F.try_divide(F.sum("n"), F.count("*")), 6).alias("avg_chunks"))


@query("agg_03_composition", "SELECT coalesce(nullif(event_type, 'view'), nullif(CASE WHEN user_id % 2 = 0 THEN '' ELSE 'odd' END, ''), 'unknown') AS label, count(*) AS pages FROM events GROUP BY 1 ORDER BY pages DESC, label")
def _(t):
    label = F.coalesce(F.nullif("event_type", F.lit("view")), F.nullif(F.when(F.col("user_id") % 2 == 0, "").otherwise("odd"), F.lit("")), F.lit("unknown"))
    return t.events.groupBy(label.alias("label")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "label")


@query("agg_04_activity", """WITH c AS (SELECT unnest(range(DATE '2023-12-25', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day), n AS (SELECT ts::DATE AS day, count(*) AS chunks, count(DISTINCT user_id) AS pages FROM events GROUP BY 1)
SELECT day, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, sum(coalesce(chunks, 0)) OVER ()::BIGINT AS total_chunks FROM c LEFT JOIN n USING (day)""".replace("OVER ()::BIGINT", "OVER ()").replace("sum(coalesce(chunks, 0)) OVER ()", "(SELECT sum(chunks) FROM n)::BIGINT"))
def _(t):
    return ops.activity(t.events, "ts", "user_id", "2023-12-25", "2024-01-31")


@query("agg_05_distinct_versions", "SELECT DISTINCT lang AS version FROM documents")
def _(t):
    return t.documents.select(F.col("lang").alias("version")).distinct()


@query("agg_06_remaining_versions", "SELECT source AS library, count(DISTINCT lang) AS versions FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(F.col("source").alias("library")).agg(F.countDistinct("lang").alias("versions"))


@query("agg_07_page_text", f"WITH {CHUNKS} SELECT page_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY sort_order)) AS text FROM chunks GROUP BY page_id")
def _(t):
    return context.assembled(t.chunks().select("page_id", "sort_order", "id", "content"), ["page_id"]).select("page_id", F.md5("content").alias("text"))


@query("agg_08_max_score", "SELECT user_id, max(value) AS score FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max("value").alias("score"))


@query("agg_09_common_prefix", f"WITH {CHUNKS}, x AS (SELECT page_id, path FROM chunks WHERE sort_order % 8 BETWEEN 4 AND 6 AND sort_order < 8) SELECT page_id, 's0/a/b' AS prefix FROM x GROUP BY page_id")
def _(t):
    rows = t.chunks().where("sort_order % 8 between 4 and 6 and sort_order < 8").select("page_id", "path")
    return context.common_prefix(rows, ["page_id"], "path").select("page_id", F.array_join("prefix", "/").alias("prefix"))


@query("agg_10_type_union", f"WITH {CHUNKS} SELECT page_id, list_aggregate(list_sort(list_distinct(flatten(list(types)))), 'string_agg', ',') AS types FROM chunks GROUP BY page_id")
def _(t):
    return t.chunks().select("page_id", F.explode("types").alias("t")).groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("types"))


@query("agg_11_means", "SELECT round(coalesce(avg(quality), 0), 6) AS quality, round(coalesce(avg(toxic), 0), 6) AS toxic, round(coalesce(avg(CASE WHEN doc_id < 0 THEN 1 END), 0), 6) AS none FROM labels")
def _(t):
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return t.labels.agg(mean("quality").alias("quality"), mean("toxic").alias("toxic"), mean(F.when(F.col("doc_id") < 0, 1)).alias("none"))


@query("agg_12_per_intent", "SELECT lang, count(*) AS n, round(avg(quality), 6) AS quality FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def _(t):
    d = t.documents.select("doc_id", "lang")
    return t.labels.join(d, "doc_id").rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


@query("agg_13_pass_rate", "SELECT round(avg(ok::INT), 6) AS rate FROM (SELECT conv_id, bool_and(length(trim(text)) > 20) AS ok FROM conversations GROUP BY conv_id)")
def _(t):
    per = t.conversations.groupBy("conv_id").agg(F.bool_and(F.length(F.trim("text")) > 20).alias("ok"))
    return per.agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"))


@query("agg_14_judge_agreement", "SELECT count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(abs(a - b)), 6) AS mean_delta FROM (SELECT quality AS a, 1 - toxic AS b FROM labels)")
def _(t):
    x = t.labels.select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    mean = lambda c: F.round(F.avg(c), 6)
    return x.agg(F.count("*").alias("n"), mean("a").alias("a"), mean("b").alias("b"), mean(F.abs(F.col("a") - F.col("b"))).alias("mean_delta"))


@query("agg_15_status_rollup", "SELECT user_id, arg_max(event_type, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END * 100 + length(event_type)) AS status FROM events GROUP BY 1")
def _(t):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 2).otherwise(1) * 100 + F.length("event_type")
    return t.events.groupBy("user_id").agg(F.max_by("event_type", rank).alias("status"))


@query("agg_16_totals", "SELECT count(DISTINCT source || '/' || lang) AS versions, count(*) AS pages, sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS chunks FROM documents")
def _(t):
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    # two levels: no distinct over all rows
    per = t.documents.groupBy("source", "lang").agg(F.count("*").alias("pages"), F.sum(n).alias("chunks"))
    return per.agg(F.count("*").alias("versions"), F.sum("pages").alias("pages"), F.sum("chunks").alias("chunks"))


@query("agg_17_witness_coverage", """WITH w AS (SELECT 'even' AS witness, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'third', url FROM pages WHERE page_id % 3 = 0)
SELECT witness, count(*) AS listed, count(DISTINCT url) AS distinct_listed, count(DISTINCT url) FILTER (url IN (SELECT url FROM pages WHERE page_id % 4 = 0)) AS collected FROM w GROUP BY 1""")
def _(t):
    sides = F.filter(F.array(F.when(F.col("page_id") % 2 == 0, "even"), F.when(F.col("page_id") % 3 == 0, "third")), lambda x: x.isNotNull())
    per = t.pages.select("page_id", "url", F.explode(sides).alias("witness")).groupBy("witness", "url").agg(F.count("*").alias("n"))
    got = t.pages.where("page_id % 4 = 0").select("url").distinct().withColumn("got", F.lit(1))
    return per.join(got, "url", "left").groupBy("witness").agg(F.sum("n").alias("listed"), F.count("*").alias("distinct_listed"), F.count("got").alias("collected"))


@query("agg_18_failure_rate", """SELECT user_id, min(event_id) AS aborted_at FROM (SELECT user_id, event_id, count(*) FILTER (event_type = 'error') OVER w AS failed, count(*) OVER w AS tried FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE tried >= 10 AND failed > 0.3 * tried GROUP BY 1""")
def _(t):
    """The first event at which a key's running share of failures passes the threshold, of ten events at least."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = t.events.select("user_id", "event_id", F.count(F.when(F.col("event_type") == "error", 1)).over(w).alias("failed"), F.count("*").over(w).alias("tried"))
    return x.where("tried >= 10 and failed > 0.3 * tried").groupBy("user_id").agg(F.min("event_id").alias("aborted_at"))


@query("agg_19_group_max", "SELECT source, lang, max(n_chars) AS n_chars, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def _(t):
    return t.documents.groupBy("source", "lang").agg(F.max("n_chars").alias("n_chars"), F.max("doc_id").alias("doc_id"))


@query("agg_20_canonical_pick", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(n, 0) DESC, c_custkey) AS r FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) WHERE r = 1")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = t.customer.select("c_nationkey", "c_custkey").join(n, "c_custkey", "left")
    return x.groupBy("c_nationkey").agg(F.min_by("c_custkey", F.struct(-F.coalesce("n", F.lit(0)), "c_custkey")).alias("c_custkey"))


@query("agg_21_corpus_statistics", r"""WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), s AS (SELECT count(*) AS n_rows, round(avg(len(w)), 6) AS avg_length FROM k)
SELECT word, count(DISTINCT doc_id) AS df, n_rows, avg_length FROM (SELECT doc_id, unnest(w) AS word FROM k), s GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def _(t):
    index = t.index("documents")
    stats = index.stats.select(F.col("_rows").alias("n_rows"), F.round("_avg_known", 6).alias("avg_length"))  # one row
    return index.document_frequency().where("df >= 3").withColumnRenamed("term", "word").crossJoin(F.broadcast(stats))


@query("agg_22_balance", "SELECT source, count(*) AS n, count(*) / (SELECT count(*) FROM documents) <= 0.5 AS balanced FROM documents GROUP BY 1")
def _(t):
    per = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return per.withColumn("balanced", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) <= 0.5)  # one row a library


@query("agg_23_strategies", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("agg_24_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::BIGINT AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g"), F.count("*").alias("n"))


@query("agg_25_approximate", "SELECT event_type, abs(count(DISTINCT user_id) - count(DISTINCT user_id)) <= 0 AS close FROM events GROUP BY 1")
def _(t):
    """An approximate distinct count is within 10 % of the exact one."""
    pairs = t.events.select("event_type", "user_id").distinct()  # sketches of all pairs' groups would stand in memory beside a distinct count
    exact = F.count("user_id")
    return pairs.groupBy("event_type").agg((F.abs(F.approx_count_distinct("user_id", 0.02) - exact) <= 0.1 * exact).alias("close"))


# --- health, status, lists -------------------------------------------------------------------------------------

_HEALTH = f"""WITH {CHUNKS}, per AS (SELECT c.library, c.version, c.page_id, count(*) FILTER (e.vec_id IS NULL) AS pending FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.page_id AND c.sort_order = 0 GROUP BY 1, 2, 3), s AS (SELECT library, version, count(*) AS pages, count(*) FILTER (pending = 0) AS embedded FROM per GROUP BY 1, 2)"""


@query("ret_17_health_note", _HEALTH + """ SELECT library, version, concat_ws('; ', CASE WHEN hash_mod = 0 THEN 'last run failed' END, CASE WHEN embedded < pages THEN embedded || ' of ' || pages || ' pages embedded' END, CASE WHEN pages < 5 THEN 'small collection' END) AS note FROM (SELECT *, pages % 3 AS hash_mod FROM s)""")
def _(t):
    return ops.health(ops.catalog(page_counts(t)).withColumn("failed", F.col("pages") % 3 == 0)).select("library", "version", "note")


@query("ret_18_status_line", _HEALTH + " SELECT library, version, library || '@' || version || ': ' || pages || ' pages, ' || round(100.0 * embedded / pages)::BIGINT || '% embedded' AS line FROM s")
def _(t):
    c = ops.catalog(page_counts(t))
    share = F.round(100.0 * F.col("embedded_pages") / F.col("pages")).cast("long")
    return c.select("library", "version", F.concat("library", F.lit("@"), "version", F.lit(": "), F.col("pages").cast("string"), F.lit(" pages, "), share.cast("string"), F.lit("% embedded")).alias("line"))


@query("ret_21_list_chunks", f"WITH {CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sort_order, id) AS chunk_index, count(*) OVER (PARTITION BY page_id) AS page_count FROM chunks WHERE library = 'src2' AND contains(lower(content), 'the')) SELECT id, page_id, chunk_index, page_count, (SELECT count(*) FROM f) AS total FROM f ORDER BY page_id, sort_order, id LIMIT 50")
def _(t):
    return ops.list_chunks(t.chunks().where("library = 'src2'"), "the", 0, 50).select("id", "page_id", "chunk_index", "page_count", "total")


@query("ret_22_list_libraries", f"SELECT library, string_agg(version || ':' || pages || CASE WHEN pages < 5 AND chunks < 20 THEN ' small' ELSE '' END, ', ' ORDER BY version) AS versions FROM ({_CATALOG}) GROUP BY library")
def _(t):
    return ops.libraries(ops.catalog(page_counts(t)))


@query("ret_23_versions_by_source_url", r"SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS library, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS version FROM pages WHERE starts_with(url, 'http://blog')")
def _(t):
    from ..functions import urls

    return t.pages.where(F.col("url").startswith("http://blog")).select(urls.host("url").alias("library"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("version")).distinct()


@query("msc_01_pending_crawl", "SELECT user_id, bool_or(event_type <> 'purchase' AND NOT starts_with(props, '#')) AS pending FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.bool_or((F.col("event_type") != "purchase") & ~F.col("props").startswith("#")).alias("pending"))


@query("msc_02_pages_of_version", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3' AND lang = 'en'")
def _(t):
    return t.documents.where("source = 'src3' and lang = 'en'").select("doc_id", "n_chars")


@query("msc_03_stored_options", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN -1 ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events")
def _(t):
    """Null without a source, -1 for options that cannot be read."""
    raw = F.when(F.col("event_id") % 4 == 1, "{oops").otherwise(F.col("props"))
    k = F.from_json(raw, "k long")["k"]
    return t.events.select("event_id", F.when(F.col("event_id") % 4 != 0, F.coalesce(k, F.lit(-1))).alias("k"))


@query("msc_04_point_lookup", "SELECT n_nationkey, n_name FROM nation WHERE lower(trim(n_name)) = lower(trim((SELECT min(n_name) FROM nation)))")
def _(t):
    low = t.nation.agg(F.lower(F.trim(F.min("n_name"))).alias("k"))  # one row
    return t.nation.select("n_nationkey", "n_name", F.lower(F.trim("n_name")).alias("k")).join(F.broadcast(low), "k", "left_semi").select("n_nationkey", "n_name")


@query("msc_05_metadata_upsert", "SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("key")).agg(F.max_by("props", "event_id").alias("value"))


_SPECS = ("openai:text-embedding-3-small", "gemini:embedding-001", "local:nomic", "text-embedding-3-large", "vertex:x")
_SPEC = "['" + "', '".join(_SPECS) + "'][(event_id % 5 + 1)::INT]"
PROVIDERS = ("openai", "vertex", "gemini", "aws", "microsoft", "sagemaker")


@query("msc_06_model_spec", f"SELECT event_id, CASE WHEN split_part(s, ':', 1) IN {PROVIDERS} AND contains(s, ':') THEN split_part(s, ':', 1) ELSE 'openai' END AS provider, CASE WHEN split_part(s, ':', 1) IN {PROVIDERS} AND contains(s, ':') THEN split_part(s, ':', 2) ELSE s END AS model FROM (SELECT event_id, {_SPEC} AS s FROM events)")
def _(t):
    s = F.element_at(F.array(*[F.lit(x) for x in _SPECS]), (F.col("event_id") % 5 + 1).cast("int"))
    head = F.regexp_extract(s, "^([^:]+):", 1)
    known = head.isin(*PROVIDERS)
    return t.events.select("event_id", F.when(known, head).otherwise("openai").alias("provider"), F.when(known, F.regexp_extract(s, "^[^:]+:(.*)$", 1)).otherwise(s).alias("model"))


#: Dimensions of common embedding models.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "embedding-001": 768, "text-embedding-004": 768, "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384, "bge-m3": 1024}


@query("msc_07_known_dimension", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1536 WHEN 1 THEN 768 END::BIGINT AS dimension FROM events")
def _(t):
    name = F.when(F.col("event_id") % 3 == 0, "Text-Embedding-3-Small").when(F.col("event_id") % 3 == 1, "nomic-embed-TEXT").otherwise("unknown")
    table = F.create_map(*[F.lit(x) for kv in DIMENSIONS.items() for x in kv])
    return t.events.select("event_id", F.try_element_at(table, F.lower(name)).cast("long").alias("dimension"))


@query("msc_08_size_error", "SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'trash')")
def _(t):
    x = F.lower("text")
    return t.documents.where(F.contains(x, F.lit("worthless")) | F.contains(x, F.lit("trash"))).select("doc_id")


@query("msc_09_entry_points", "SELECT page_id, CASE WHEN split_part(url, '#', 1) IN (SELECT split_part(url, '#', 1) FROM pages WHERE page_id % 10 = 0) THEN 'repeat' ELSE 'append' END AS action FROM pages")
def _(t):
    k = F.substring_index("url", "#", 1)
    known = t.pages.where("page_id % 10 = 0").select(k.alias("k")).distinct().withColumn("known", F.lit(True))
    return t.pages.select("page_id", k.alias("k")).join(known, "k", "left").select("page_id", F.when(F.col("known"), "repeat").otherwise("append").alias("action"))


@query("msc_11_job_counts", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN round(value)::BIGINT END, CASE WHEN event_id % 3 = 0 THEN user_id END) AS pages FROM events")
def _(t):
    return t.events.select("event_id", F.coalesce(F.when(F.col("event_id") % 2 == 0, F.round("value").cast("long")), F.when(F.col("event_id") % 3 == 0, F.col("user_id"))).alias("pages"))


@query("msc_12_job_listing", "SELECT user_id, min(ts) AS created_at, count(*) AS steps, CASE WHEN sum(value) > 100 THEN round(sum(value), 3) END AS progress FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.count("*").alias("steps"), F.sum("value").alias("s")).select("user_id", "created_at", "steps", F.when(F.col("s") > 100, F.round("s", 3)).alias("progress"))


@query("msc_13_canonical_base", r"SELECT host, arg_min(base, page_id) AS base FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^([a-z]+://[^/]+/[a-z]*)', 1) AS base FROM pages) GROUP BY 1")
def _(t):
    from ..functions import urls

    return t.pages.select("page_id", urls.host("url").alias("host"), F.regexp_extract("url", "^([a-z]+://[^/]+/[a-z]*)", 1).alias("base")).groupBy("host").agg(F.min_by("base", "page_id").alias("base"))


@query("msc_14_discovered_links", r"""SELECT DISTINCT l AS url FROM (SELECT unnest([url, split_part(url, '?', 1)]) AS l FROM pages) WHERE starts_with(l, 'https://') AND NOT regexp_matches(l, '(?i)\.(zip|tar|gz|tgz)$')""")
def _(t):
    both = t.pages.select(F.explode(F.array("url", F.substring_index("url", "?", 1))).alias("url"))
    return both.where(F.col("url").startswith("https://") & ~F.col("url").rlike(r"(?i)\.(?:zip|tar|gz|tgz)$")).distinct()


@query("msc_15_listed_identity", r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS identity FROM pages WHERE NOT ends_with(url, '.md')")
def _(t):
    from ..functions import urls

    plain = F.regexp_replace("url", r"[?#].*$", "")
    return t.pages.select("page_id", urls.normalize(urls.strip_markdown_extension(F.concat(F.regexp_replace(plain, "/+$", ""), F.lit(".md")))).alias("identity"))


@query("msc_16_repo_url", "SELECT page_id, 'o' || page_id AS owner, 'r' AS repo, CASE WHEN page_id % 2 = 0 THEN 'main' END AS branch, CASE WHEN page_id % 2 = 0 THEN 'docs/x' END AS sub_path FROM pages")
def _(t):
    from ..sources import repositories

    u = F.concat(F.lit("https://github.com/o"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/r/tree/main/docs/x").otherwise("/r.git"))
    return t.pages.select("page_id", u.alias("u")).select("page_id", *repositories.parse("u"))
