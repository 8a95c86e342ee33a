"""Joins, windows, sorts and set operations over the corpus model: JON, WIN, SRT, SET and PRJ entries of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import context, ranking
from ..registry import query
from ..tables import CHUNKS, Tables

#: Sides of a few dozen rows by their meaning (regions, nations).
small = F.broadcast


@query("flt_03_version_scope", "SELECT doc_id FROM documents WHERE lower(trim(source)) = 'src0' AND coalesce(lang, '') = coalesce('en', '')")
def _(t):
    return t.documents.where((F.lower(F.trim("source")) == "src0") & F.coalesce("lang", F.lit("")).eqNullSafe(F.lit("en"))).select("doc_id")


@query("flt_04_existence", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_open FROM customer")
def _(t):
    open_ = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has_open", F.lit(True))
    return t.customer.select("c_custkey").join(open_, "c_custkey", "left").fillna(False, ["has_open"])


@query("flt_05_exclude_structural", f"WITH {CHUNKS} SELECT id FROM chunks WHERE NOT list_contains(types, 'structural')")
def _(t):
    return t.chunks().where(~F.array_contains("types", "structural")).select("id")


@query("flt_06_status_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def _(t):
    return t.orders.where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("flt_07_url_list_count", "SELECT count(*) AS n FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def _(t):
    listed = t.pages.where("page_id % 3 = 0").select("url")
    return t.pages.select("url").join(listed, "url", "left_semi").agg(F.count("*").alias("n"))


@query("flt_27_representation", "SELECT page, page_id, markdown FROM (SELECT split_part(url, '?', 1) AS page, page_id, contains(url, '#') AS markdown, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY CASE WHEN contains(url, '#') THEN 0 ELSE 1 END, page_id) AS r FROM pages) WHERE r = 1")
def _(t):
    """Of the representations of a page a Markdown one wins, else the first to arrive."""
    x = t.pages.select(F.substring_index("url", "?", 1).alias("page"), "page_id", F.contains("url", F.lit("#")).alias("markdown"))
    best = F.min(F.struct((~F.col("markdown")).alias("other"), "page_id", "markdown"))
    return x.groupBy("page").agg(best.alias("b")).select("page", "b.page_id", "b.markdown")


@query("prj_01_chunk_page", f"WITH {CHUNKS} SELECT c.id, c.sort_order, md5(c.content) AS content, d.source, d.n_chars FROM chunks c JOIN documents d ON d.doc_id = c.page_id WHERE c.sort_order < 3")
def _(t):
    c = t.chunks().where("sort_order < 3")
    return c.join(t.documents.select(F.col("doc_id").alias("page_id"), "source", "n_chars"), "page_id").select("id", "sort_order", F.md5("content").alias("content"), "source", "n_chars")


@query("prj_02_chunks_by_ids", f"WITH {CHUNKS} SELECT id, sort_order FROM chunks WHERE id IN (SELECT doc_id * 1000000 + 1 FROM documents) ORDER BY sort_order, id")
def _(t):
    ids = t.documents.select((F.col("doc_id") * 1_000_000 + 1).alias("id"))
    return t.chunks().select("id", "sort_order").join(ids, "id", "left_semi").orderBy("sort_order", "id")


@query("prj_03_chunks_by_page", f"WITH {CHUNKS} SELECT id, sort_order, content FROM chunks WHERE page_id = 7 ORDER BY sort_order")
def _(t):
    return t.chunks().where("page_id = 7").select("id", "sort_order", "content").orderBy("sort_order")


@query("prj_04_embedding_text", f"WITH {CHUNKS} SELECT id, md5('<title>' || library || '</title>' || chr(10) || '<url>' || page_id || '</url>' || chr(10) || '<path>' || array_to_string(path, ' / ') || '</path>' || chr(10) || content) AS text FROM chunks")
def _(t):
    return t.chunks().select("id", F.md5(context.embedding_text("library", F.col("page_id").cast("string"), "path", "content")).alias("text"))


@query("prj_07_stored_options", """SELECT user_id, event_type, '{"kind":"' || event_type || '","value":' || round(max(value))::BIGINT || '}' AS options FROM events GROUP BY user_id, event_type""")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("v")).select("user_id", "event_type", F.to_json(F.struct(F.col("event_type").alias("kind"), F.round("v").cast("long").alias("value"))).alias("options"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("jon_01_four_way", """SELECT r_name, n_name, c_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    c = t.customer.select("c_custkey", "c_nationkey").join(small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("r_name", "n_name", "c_custkey", "o_orderkey")


@query("jon_02_full_outer", "SELECT coalesce(e.vec_id, l.doc_id) AS id, e.label AS vec, l.quality AS fts FROM embeddings e FULL JOIN labels l ON l.doc_id = e.vec_id")
def _(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("vec")).join(t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("fts")), "id", "full")


@query("jon_03_versions_left", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["n"])


@query("jon_04_pages_left_pending", "SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(late, 0) AS pending FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS late FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("pending"))
    return t.orders.select("o_orderkey").join(per, "o_orderkey", "left").fillna(0, ["n", "pending"])


@query("jon_05_calendar", """WITH c AS (SELECT unnest(range(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day), e AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), v AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT day, coalesce(e.n, 0) AS n_events, coalesce(v.n, 0) AS n_views FROM c LEFT JOIN e USING (day) LEFT JOIN v USING (day)""")
def _(t):
    # one aggregation serves both counts
    per = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"), F.count(F.when(F.col("event_type") == "view", 1)).alias("n_views"))
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-28").cast("date"), F.lit("2024-02-04").cast("date"))).alias("day"))
    return days.join(per, "day", "left").fillna(0, ["n_events", "n_views"])


@query("jon_06_anti", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("jon_07_semi", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("jon_08_not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(t):
    """The skip list holds no null here; NOT IN over one that does would give no rows, so nulls are left out by the filter."""
    return t.documents.select("doc_id").join(t.labels.where("quality = 0 and doc_id is not null").select("doc_id"), "doc_id", "left_anti")


@query("jon_09_as_of_parent", f"WITH {CHUNKS} SELECT c.id, (SELECT p.id FROM chunks p WHERE p.page_id = c.page_id AND p.path = c.path[1:-2] AND p.sort_order < c.sort_order ORDER BY p.sort_order DESC LIMIT 1) AS parent FROM chunks c")
def _(t):
    return context.parents(t.chunks().select("id", "page_id", "sort_order", "path")).select("id", "parent")


@query("jon_10_neighbours", f"""WITH {CHUNKS} SELECT id, lag(id, 1) OVER w AS before1, lead(id, 1) OVER w AS after1, lead(id, 2) OVER w AS after2 FROM chunks WINDOW w AS (PARTITION BY page_id, path ORDER BY sort_order, id)""")
def _(t):
    return context.neighbours(t.chunks().select("id", "page_id", "sort_order", "path")).select("id", "before1", "after1", "after2")


@query("jon_11_children", f"""WITH {CHUNKS} SELECT id, child FROM (SELECT p.id, c.id AS child, row_number() OVER (PARTITION BY p.id ORDER BY c.sort_order, c.id) AS r FROM chunks p JOIN chunks c ON c.page_id = p.page_id AND c.path[1:-2] = p.path AND c.sort_order > p.sort_order) WHERE r <= 3""")
def _(t):
    return context.children(t.chunks().select("id", "page_id", "sort_order", "path"), 3).select("id", "child")


@query("jon_12_ancestor", f"""WITH {CHUNKS}, k AS (SELECT DISTINCT page_id, path FROM chunks WHERE NOT (page_id % 2 = 0 AND len(path) = 2))
SELECT c.id, max(array_to_string(k.path, '/')) AS ancestor FROM chunks c JOIN (SELECT c.id, max(len(k.path)) AS n FROM chunks c JOIN k ON k.page_id = c.page_id AND len(k.path) < len(c.path) AND c.path[1:len(k.path)] = k.path GROUP BY c.id) m USING (id) JOIN k ON k.page_id = c.page_id AND len(k.path) = m.n AND c.path[1:m.n] = k.path GROUP BY c.id""")
def _(t):
    """The longest proper prefix of the path that the page has, where even pages lack some levels."""
    chunks = t.chunks().select("id", "page_id", "path")
    have = chunks.where("not (page_id % 2 = 0 and size(path) = 2)").select("page_id", "path").distinct()
    return context.ancestors(chunks, have).select("id", F.array_join("ancestor", "/").alias("ancestor"))


@query("jon_13_query_variants", "SELECT v.page_id, b.page_id AS bare_id FROM pages v JOIN pages b ON split_part(v.url, '?', 1) = b.url WHERE contains(v.url, '?')")
def _(t):
    v = t.pages.where(F.contains("url", F.lit("?"))).select("page_id", F.substring_index("url", "?", 1).alias("url"))
    return v.join(t.pages.select(F.col("page_id").alias("bare_id"), "url"), "url").select("page_id", "bare_id")


_INTERVALS = """iv AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS lo, epoch(date_trunc('second', ts))::BIGINT + 3600 * (1 + event_id % 24) AS hi FROM events)"""


def intervals(t: Tables) -> DataFrame:
    lo = F.unix_timestamp("ts")
    return t.events.select("user_id", "event_id", lo.alias("lo"), (lo + 3600 * (1 + F.col("event_id") % 24)).alias("hi"))


@query("jon_14_interval_containment", f"""WITH {_INTERVALS} SELECT s.event_id, arg_min(b.event_id, (b.hi - b.lo, b.event_id)) AS innermost FROM iv s JOIN iv b ON b.user_id = s.user_id AND b.lo <= s.lo AND b.hi >= s.hi AND b.event_id <> s.event_id GROUP BY s.event_id""")
def _(t):
    """Of the intervals of the same key that contain this one, the shortest. Intervals meet by a day bucket, so a key's rows are not all paired."""
    return context.containing(intervals(t), "user_id", "event_id", "lo", "hi", bucket=86_400).select("event_id", F.col("best").alias("innermost"))


@query("jon_15_boundary_parent", f"""WITH {_INTERVALS} SELECT event_id, parent FROM (SELECT s.event_id, b.event_id AS parent, row_number() OVER (PARTITION BY s.event_id ORDER BY b.hi - b.lo, b.event_id) AS r FROM iv s JOIN iv b ON b.user_id = s.user_id AND b.lo < s.lo AND b.hi > s.hi) WHERE r = 1""")
def _(t):
    return context.containing(intervals(t), "user_id", "event_id", "lo", "hi", bucket=86_400, strict=True).select("event_id", F.col("best").alias("parent"))


@query("jon_16_judged_results", r"""SELECT p.page_id, q.page_id AS judged, q.grade FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', ''), '/$', '') AS k FROM pages) p JOIN (SELECT page_id, page_id % 4 AS grade, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/$', '') AS k FROM pages WHERE page_id % 5 = 0) q USING (k)""")
def _(t):
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), r"\?.*$", ""), r"/$", "")
    judged = t.pages.where("page_id % 5 = 0").select(F.col("page_id").alias("judged"), (F.col("page_id") % 4).alias("grade"), key.alias("k"))
    return t.pages.select("page_id", key.alias("k")).join(judged, "k").select("page_id", "judged", "grade")


@query("jon_18_group_by_key", "SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) AS ids FROM events WHERE event_type = 'error' GROUP BY user_id")
def _(t):
    return t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), " ").alias("ids"))


@query("jon_19_join_choice", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def _(t):
    """No hint: the planner takes the side that it measures as small."""
    return t.customer.select("c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


# --- windows ---------------------------------------------------------------------------------------------------


@query("win_01_chunk_index", f"WITH {CHUNKS} SELECT id, row_number() OVER (PARTITION BY page_id ORDER BY sort_order, id) AS chunk_index FROM chunks")
def _(t):
    w = Window.partitionBy("page_id").orderBy("sort_order", "id")
    return t.chunks().select("id", "page_id", "sort_order").select("id", F.row_number().over(w).cast("long").alias("chunk_index"))


@query("win_02_page_count", f"WITH {CHUNKS} SELECT id, count(*) OVER (PARTITION BY page_id) AS n FROM chunks WHERE contains(lower(content), 'the')")
def _(t):
    return t.chunks().where(F.contains(F.lower("content"), F.lit("the"))).select("id", F.count("*").over(Window.partitionBy("page_id")).alias("n"))


@query("win_03_vector_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS vec_rank FROM events WHERE value IS NOT NULL")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.where("value is not null").select("event_id", F.row_number().over(w).cast("long").alias("vec_rank"))


@query("win_04_fts_rank", f"WITH {CHUNKS} SELECT id, row_number() OVER (PARTITION BY page_id ORDER BY length(content) DESC, id) AS fts_rank FROM chunks")
def _(t):
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "id")
    return t.chunks().select("id", "page_id", F.length("content").alias("score")).select("id", F.row_number().over(w).cast("long").alias("fts_rank"))


@query("win_05_gap_clusters", """SELECT event_id, sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (SELECT event_id, user_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 30 THEN 1 ELSE 0 END AS f FROM events)""")
def _(t):
    return context.clusters(t.events.select("event_id", "user_id"), ["user_id"], "event_id", 30).select("event_id", "cluster")


@query("win_06_neighbour_frame", f"WITH {CHUNKS} SELECT id, count(*) OVER (PARTITION BY page_id, path ORDER BY sort_order, id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS n FROM chunks")
def _(t):
    w = Window.partitionBy("page_id", "path").orderBy("sort_order", "id").rowsBetween(-1, 2)
    return t.chunks().select("id", F.count("*").over(w).alias("n"))


@query("win_07_queue_position", "SELECT event_id, CASE WHEN event_type = 'error' THEN count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS position FROM events")
def _(t):
    queued = F.col("event_type") == "error"
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.when(queued, F.count(F.when(queued, 1)).over(w)).alias("position"))


@query("win_08_first_occurrence", "SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def _(t):
    # the first of each key is a minimum: one aggregation, no window over whole keys
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))


@query("win_09_first_relevant", "SELECT user_id, 1.0::DOUBLE / min(event_id + 1) AS reciprocal FROM events WHERE event_type = 'error' GROUP BY 1")
def _(t):
    return t.events.where("event_type = 'error'").groupBy("user_id").agg((F.lit(1.0) / F.min(F.col("event_id") + 1)).alias("reciprocal"))


@query("win_10_latest_run", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) AS last_id FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("event_id").alias("last_id"))


@query("win_11_batch_budget", "SELECT doc_id FROM (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000 OR s = n_chars")
def _(t):
    """Of each source, in order, as many as fit the budget; the first always does."""
    return ranking.within_budget(t.documents.select("doc_id", "source", "n_chars"), ["source"], "doc_id", "n_chars", 20_000).select("doc_id")


@query("win_12_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
def _(t):
    return t.events.select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)), 4).alias("moving"))


@query("win_13_analytic", "SELECT event_id, ntile(4) OVER w::BIGINT AS quarter, round(percent_rank() OVER w, 6) AS pr, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)".replace("ntile(4) OVER w::BIGINT", "CAST(ntile(4) OVER w AS BIGINT)"))
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("event_id", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.nth_value("event_id", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"))


# --- sorts, limits, sets ---------------------------------------------------------------------------------------


@query("srt_04_candidate_limit", "SELECT s_suppkey, least(4096, greatest(1, ceil(s_suppkey * 2.0)::BIGINT) * 10) AS k FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.least(F.lit(4096), F.greatest(F.lit(1), F.ceil(F.col("s_suppkey") * F.lit(2.0).cast("double"))) * 10).cast("long").alias("k"))


@query("srt_05_content_dedup", "SELECT n_chars, doc_id FROM (SELECT n_chars, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 50")
def _(t):
    # one hash a text crosses the shuffle, not the text
    best = t.documents.select(F.sha2("text", 256).alias("h"), "n_chars", "doc_id").groupBy("h").agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("b"))
    return best.select((-F.col("b.n")).alias("n_chars"), "b.doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(50)


@query("srt_06_page", f"WITH {CHUNKS} SELECT id, page_id, sort_order FROM chunks ORDER BY page_id, sort_order, id LIMIT 50 OFFSET 100")
def _(t):
    return t.chunks().select("id", "page_id", "sort_order").orderBy("page_id", "sort_order", "id").offset(100).limit(50)


@query("srt_08_catalog_order", "SELECT DISTINCT source AS library, lang AS version FROM documents ORDER BY 1, 2")
def _(t):
    return t.documents.select(F.col("source").alias("library"), F.col("lang").alias("version")).distinct().orderBy("library", "version")


@query("srt_09_first_k", "SELECT doc_id, total FROM (SELECT doc_id, count(*) OVER () AS total, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE contains(text, 'the')) WHERE r <= 30")
def _(t):
    hits = t.documents.where(F.contains("text", F.lit("the"))).select("doc_id")
    return hits.orderBy("doc_id").limit(30).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # a single row


@query("srt_10_backlog", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 100")
def _(t):
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("srt_11_latest_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)


@query("srt_12_jobs_view", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click') ORDER BY CASE WHEN event_type = 'click' THEN event_id END, event_id DESC LIMIT 200")
def _(t):
    return t.events.where(F.col("event_type").isin("error", "click")).select("event_id", "event_type").orderBy(F.asc_nulls_last(F.when(F.col("event_type") == "click", F.col("event_id"))), F.desc("event_id")).limit(200)


@query("srt_13_hash_sample", "SELECT page_id FROM (SELECT page_id, substr(sha256(page_id || '::' || url), 1, 12) AS h FROM pages) ORDER BY h, page_id LIMIT 20")
def _(t):
    """A sample that any run repeats: the smallest hashes."""
    return t.pages.select("page_id", F.substring(F.sha2(F.concat(F.col("page_id").cast("string"), F.lit("::"), "url"), 256), 1, 12).alias("h")).orderBy("h", "page_id").limit(20).select("page_id")


@query("srt_14_unique_in_order", "SELECT page_id, len(list_distinct(l)) AS n, (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY x)) AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)")
def _(t):
    x = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    return t.pages.select("page_id", F.size(x).cast("long").alias("n"), F.when(F.size(x) > 0, F.array_join(x, " ")).alias("links"))


@query("set_01_union_distinct", "SELECT vec_id AS id FROM embeddings UNION SELECT doc_id FROM labels")
def _(t):
    return t.embeddings.select(F.col("vec_id").alias("id")).union(t.labels.select("doc_id")).distinct()


@query("set_02_union_all", "SELECT vec_id AS id FROM embeddings UNION ALL SELECT doc_id FROM labels")
def _(t):
    return t.embeddings.select(F.col("vec_id").alias("id")).union(t.labels.select("doc_id"))


@query("set_03_recursive", "WITH RECURSIVE c(day) AS (SELECT DATE '2024-01-01' UNION ALL SELECT (day + INTERVAL 1 DAY)::DATE FROM c WHERE day < DATE '2024-01-30') SELECT c.day, count(event_id) AS n FROM c LEFT JOIN events ON ts::DATE = c.day GROUP BY 1")
def _(t):
    days = t.spark.sql("WITH RECURSIVE c(day) AS (SELECT DATE'2024-01-01' UNION ALL SELECT date_add(day, 1) FROM c WHERE day < DATE'2024-01-30') SELECT day FROM c")
    return days.join(t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "day", "left").fillna(0, ["n"])


@query("set_04_context_ids", f"WITH {CHUNKS}, h AS (SELECT id, page_id, sort_order FROM chunks WHERE contains(content, 'License')) SELECT id FROM h UNION SELECT c.id FROM chunks c JOIN h ON h.page_id = c.page_id AND c.sort_order BETWEEN h.sort_order - 1 AND h.sort_order + 2")
def _(t):
    chunks = t.chunks().select("id", "page_id", "sort_order", "content")
    hits = chunks.where(F.contains("content", F.lit("License"))).select("page_id", F.explode(F.array(*[F.col("sort_order") + k for k in (-1, 0, 1, 2)])).alias("sort_order")).distinct()
    return chunks.select("id", "page_id", "sort_order").join(hits, ["page_id", "sort_order"], "left_semi").select("id")


@query("set_05_discovered_not_visited", "SELECT DISTINCT split_part(url, '?', 1) AS url FROM pages EXCEPT SELECT url FROM pages WHERE page_id % 2 = 0")
def _(t):
    return t.pages.select(F.substring_index("url", "?", 1).alias("url")).distinct().join(t.pages.where("page_id % 2 = 0").select("url"), "url", "left_anti")


@query("set_06_witness_union", "SELECT url, count(*) AS witnesses FROM (SELECT DISTINCT url, 0 AS w FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT DISTINCT url, 1 FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def _(t):
    sides = t.pages.select("url", F.explode(F.filter(F.array(F.when(F.col("page_id") % 2 == 0, 0), F.when(F.col("page_id") % 3 == 0, 1)), lambda x: x.isNotNull())).alias("w"))
    return sides.distinct().groupBy("url").agg(F.count("*").alias("witnesses"))


@query("set_07_intersect_except", "(SELECT vec_id AS id FROM embeddings INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM documents WHERE lang = 'fr'")
def _(t):
    return t.embeddings.select(F.col("vec_id").alias("id")).intersect(t.labels.select("doc_id")).subtract(t.documents.where("lang = 'fr'").select("doc_id"))
