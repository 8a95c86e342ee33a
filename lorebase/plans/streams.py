"""Jobs, events, frontier: STM entries and the streaming extensions, over the events table in batch form; tests hold streams against it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..streaming import jobs

_LINKS = "l AS (SELECT p.page_id AS a, q.page_id AS b FROM pages p JOIN pages q ON q.page_id IN (2 * p.page_id + 1, 2 * p.page_id + 2))"


def links(t):
    k = F.col("page_id")
    return t.pages.select(k.cast("string").alias("url"), F.explode(F.array(2 * k + 1, 2 * k + 2)).alias("n")).join(t.pages.select(F.col("page_id").alias("n")), "n", "left_semi").select("url", F.col("n").cast("string").alias("target"))


@query("stm_01_crawl", f"WITH RECURSIVE {_LINKS}, c(n, depth) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT l.b, depth + 1 FROM c JOIN l ON l.a = c.n WHERE depth < 3) SELECT n::VARCHAR AS url, min(depth) AS depth FROM c GROUP BY 1")
def _(t):
    roots = t.pages.where("page_id = 0").select(F.col("page_id").cast("string").alias("url"))
    return jobs.crawl(t.spark, roots, links(t))


@query("stm_02_admit", "SELECT split_part(url, '?', 1) AS key, bool_or(page_id % 3 = 0) AS done FROM pages GROUP BY 1")
def _(t):
    k = F.substring_index("url", "?", 1)
    frontier = t.pages.where("page_id % 3 = 0").select(k.alias("key")).distinct().withColumn("done", F.lit(True))
    return jobs.admitted(t.pages.select(k.alias("key")), frontier)


@query("stm_03_resume", "SELECT page_id FROM pages WHERE page_id % 3 > 0 AND NOT starts_with(url, '#')")
def _(t):
    """What a run that stopped has left: keys not done; keys with # are memory, not pages."""
    return t.pages.where("page_id % 3 > 0").where(~F.col("url").startswith("#")).select("page_id")


@query("stm_04_outcomes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'keep' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'count failure' ELSE 'skip' END AS action FROM events")
def _(t):
    k = F.col("event_type")
    return t.events.select("event_id", F.when(k == "view", "keep").when(k.isin("click", "purchase"), "write").when(k == "error", "count failure").otherwise("skip").alias("action"))


@query("stm_05_progress", "SELECT event_id, count(*) OVER w AS pages, count(*) FILTER (event_type <> 'error') OVER w AS indexed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("pages"), F.count(F.when(F.col("event_type") != "error", 1)).over(w).alias("indexed"))


@query("stm_06_abort", "SELECT user_id, count(*) FILTER (event_type = 'error') > 0.25 * count(*) AND count(*) >= 10 AS aborts FROM events GROUP BY 1")
def _(t):
    bad = F.count(F.when(F.col("event_type") == "error", 1))
    return t.events.groupBy("user_id").agg(((bad > 0.25 * F.count("*")) & (F.count("*") >= 10)).alias("aborts"))


def job_events(t):
    s = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "completed", "cancelling", "failed")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), s.alias("status"))


@query("stm_07_job_machine")
def _(t):
    """Each job's status by its state machine; a stream gives the same (test)."""
    return jobs.folded(job_events(t))


@query("stm_08_version_status", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'running' ELSE 'failed' END AS status FROM events")
def _(t):
    return job_events(t).select(F.col("seq").alias("event_id"), jobs.version_status("status").alias("status"))


@query("stm_09_recovery", "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'resume' WHEN bool_or(event_type = 'purchase') THEN 'refresh' ELSE 'fail' END AS action FROM events GROUP BY 1")
def _(t):
    any_ = lambda k: F.bool_or(F.col("event_type") == k)
    return t.events.groupBy("user_id").agg(F.when(any_("error"), "resume").when(any_("purchase"), "refresh").otherwise("fail").alias("action"))


@query("stm_11_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm_12_subscription", "SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def _(t):
    return jobs.subscribed(t.events, ["click", "error"]).select("event_id")


@query("stm_15_open_jobs", "SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'")
def _(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("s")).where("s <> 'purchase'").select("user_id")


@query("stm_16_two_misses", "SELECT DISTINCT user_id FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type = 'error' AND p = 'error'")
def _(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.events.select("user_id", "event_type", F.lag("event_type").over(w).alias("p")).where("event_type = 'error' and p = 'error'").select("user_id").distinct()


@query("ext_hourly_activity", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return jobs.activity(t.events).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("ext_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return jobs.sessions(t.events).withColumn("start", F.col("start").cast("timestamp_ntz"))
