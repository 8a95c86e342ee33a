"""Retrieval quality: EVL, MTH-04, MTH-05, JON-17 and SRC-25 entries. A query is a user; pages are event types and hours, graded by their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ops
from ..registry import query

_SETS = """r AS (SELECT user_id AS query, event_type || (event_id % 6) AS url, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS pos FROM events),
j AS (SELECT DISTINCT user_id AS query, event_type || (event_id % 6) AS url, (event_id % 6) % 4 AS grade FROM events WHERE (event_id % 6) % 4 < 3),
f AS (SELECT query, url, min(pos) AS pos FROM r GROUP BY 1, 2), g AS (SELECT * FROM j WHERE grade > 0), h AS (SELECT f.query, f.pos, g.grade FROM f JOIN g USING (query, url)),
got AS (SELECT query, 1.0::DOUBLE / (min(pos) + 1) AS mrr, count(*) FILTER (pos < 5) AS r5, sum(CASE WHEN pos < 5 THEN (2 ** grade - 1) / log2(pos + 2) ELSE 0 END) AS d5, max((pos < 1)::INT) AS h1 FROM h GROUP BY 1),
ideal AS (SELECT query, count(*) AS n, sum(CASE WHEN pos < 5 THEN (2 ** grade - 1) / log2(pos + 2) ELSE 0 END) AS i5 FROM (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, url) - 1 AS pos FROM g) GROUP BY 1),
m AS (SELECT q.query, coalesce(mrr, 0)::DOUBLE AS mrr, coalesce(h1, 0)::DOUBLE AS hit_1, coalesce(r5 / n, 0)::DOUBLE AS recall_5, coalesce(d5 / i5, 0)::DOUBLE AS ndcg_5, CASE WHEN coalesce(r5, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_5 FROM (SELECT query FROM r UNION SELECT query FROM j) q LEFT JOIN got USING (query) LEFT JOIN ideal USING (query))"""


def metrics(t):
    from pyspark.sql import Window

    url = F.concat("event_type", (F.col("event_id") % 6).cast("string"))
    ranked = t.events.select(F.col("user_id").alias("query"), url.alias("url"), (F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")) - 1).alias("pos"))
    judged = t.events.where("event_id % 6 % 4 < 3").select(F.col("user_id").alias("query"), url.alias("url"), (F.col("event_id") % 6 % 4).alias("grade")).distinct()
    return ops.per_query(ranked, judged, (5,))


_R = "round(mrr, 6) AS mrr, hit_1, round(recall_5, 6) AS recall_5, round(ndcg_5, 6) AS ndcg_5, hit_5"


@query("evl_01_per_query", f"WITH {_SETS} SELECT query, {_R} FROM m")
def _(t):
    return metrics(t).select("query", F.round("mrr", 6).alias("mrr"), "hit_1", F.round("recall_5", 6).alias("recall_5"), F.round("ndcg_5", 6).alias("ndcg_5"), "hit_5")


@query("mth_04_mrr_recall_hit", f"WITH {_SETS} SELECT query, round(mrr, 6) AS mrr, round(recall_5, 6) AS recall_5, hit_5 FROM m")
def _(t):
    return metrics(t).select("query", F.round("mrr", 6).alias("mrr"), F.round("recall_5", 6).alias("recall_5"), "hit_5")


@query("mth_05_ndcg", f"WITH {_SETS} SELECT query, round(ndcg_5, 6) AS ndcg_5 FROM m")
def _(t):
    return metrics(t).select("query", F.round("ndcg_5", 6).alias("ndcg_5"))


@query("evl_02_structure", "SELECT conv_id, bool_and(length(trim(text)) > 0) AS non_empty, bool_and(((length(text) - length(replace(text, '```', ''))) // 3) % 2 = 0) AS balanced FROM conversations GROUP BY conv_id")
def _(t):
    from ..functions import text

    return t.conversations.groupBy("conv_id").agg(F.bool_and(F.length(F.trim("text")) > 0).alias("non_empty"), F.bool_and(text.fences_balanced("text")).alias("balanced"))


@query("evl_03_run", f"WITH {_SETS} SELECT query % 3 AS intent, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_5), 6) AS recall_5, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(hit_5), 6) AS hit_5 FROM m GROUP BY ROLLUP (query % 3)".replace("SELECT query % 3 AS intent", "SELECT intent").replace("FROM m GROUP BY ROLLUP (query % 3)", "FROM (SELECT *, query % 3 AS intent FROM m) GROUP BY ROLLUP (intent)"))
def _(t):
    x = metrics(t).withColumn("intent", F.col("query") % 3)
    return x.rollup("intent").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("mrr", "recall_5", "ndcg_5", "hit_5")])


_VALUES = "SELECT lang AS scope, 'chars' AS metric, avg(n_chars)::DOUBLE AS value FROM documents WHERE doc_id % 2 = {0} GROUP BY lang UNION ALL SELECT '', 'chars', avg(n_chars) FROM documents WHERE doc_id % 2 = {0}"


def values(t, part):
    x = t.documents.where(f"doc_id % 2 = {part}").select("lang", "n_chars")
    per = x.rollup("lang").agg(F.avg("n_chars").alias("value"))
    return per.select(F.coalesce("lang", F.lit("")).alias("scope"), F.lit("chars").alias("metric"), "value")


_COMPARE = f"WITH b AS ({_VALUES.format(0)}), c AS ({_VALUES.format(1)}) SELECT scope, metric, round(b.value, 4) AS base, round(c.value, 4) AS now, CASE WHEN (c.value - b.value) / b.value > CASE WHEN scope = '' THEN 0.05 ELSE 0.1 END THEN 'better' WHEN (c.value - b.value) / b.value < -CASE WHEN scope = '' THEN 0.05 ELSE 0.1 END THEN 'worse' ELSE 'same' END AS verdict FROM b JOIN c USING (scope, metric)"


@query("evl_04_compare", _COMPARE)
def _(t):
    x = ops.compared(values(t, 0), values(t, 1))
    return x.select("scope", "metric", F.round("base", 4).alias("base"), F.round("now", 4).alias("now"), "verdict")


@query("jon_17_baseline_join", _COMPARE.replace("SELECT scope, metric, round(b.value, 4) AS base, round(c.value, 4) AS now,", "SELECT scope,"))
def _(t):
    return ops.compared(values(t, 0), values(t, 1)).select("scope", "verdict")


@query("evl_05_same_setup", "SELECT event_id, regexp_replace(a, '^openai:', '') = regexp_replace(b, '^openai:', '') AS same FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'openai:m' ELSE 'm' END AS a, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE 'm' END AS b FROM events)")
def _(t):
    bare = lambda c: F.regexp_replace(c, "^openai:", "")
    a, b = F.when(F.col("event_id") % 2 == 0, "openai:m").otherwise("m"), F.when(F.col("event_id") % 3 == 0, "x").otherwise("m")
    return t.events.select("event_id", (bare(a) == bare(b)).alias("same"))


@query("evl_06_providers", "SELECT coalesce(a.user_id, b.user_id) AS query, round(a.v, 4) AS ours, round(b.v, 4) AS theirs FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1) b USING (user_id)")
def _(t):
    # one scan: both sides are conditional means of a single aggregation
    side = lambda k: F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 4)
    x = t.events.where(F.col("event_type").isin("click", "error")).groupBy(F.col("user_id").alias("query"))
    return x.agg(side("click").alias("ours"), side("error").alias("theirs"))


@query("evl_07_cross_judge", "SELECT count(*) AS n, round(avg(quality), 6) AS a, round(avg(1 - toxic), 6) AS b, round(avg(abs(quality - (1 - toxic))), 6) AS delta FROM (SELECT * FROM labels ORDER BY substr(sha256('q::' || doc_id), 1, 12), doc_id LIMIT 100)")
def _(t):
    h = F.substring(F.sha2(F.concat(F.lit("q::"), F.col("doc_id").cast("string")), 256), 1, 12)
    x = t.labels.select("*", h.alias("h")).orderBy("h", "doc_id").limit(100)
    return x.agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("a"), F.round(F.avg(1 - F.col("toxic")), 6).alias("b"), F.round(F.avg(F.abs(F.col("quality") - (1 - F.col("toxic")))), 6).alias("delta"))


@query("evl_08_given_scores", "SELECT l_returnflag AS rubric, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def _(t):
    """Scores that a judge gave are inputs; their means are made here."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("rubric")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("src_25_dataset", "SELECT source AS library, count(*) AS n, count(*) <= 0.5 * (SELECT count(*) FROM documents) AS balanced, count(*) FILTER (length(trim(text)) = 0) AS empty FROM documents GROUP BY 1")
def _(t):
    from pyspark.sql import Window

    per = t.documents.groupBy(F.col("source").alias("library")).agg(F.count("*").alias("n"), F.count(F.when(F.length(F.trim("text")) == 0, 1)).alias("empty"))
    return per.withColumn("balanced", F.col("n") <= 0.5 * F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a library
