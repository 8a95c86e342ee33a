"""Vectors and scores: VEC and MTH entries of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, vectors
from ..registry import query

_L2 = "round(sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) ** 2))), 6)"


def probe(t):
    """The vector that queries are held against: that of the smallest id, one row."""
    return F.broadcast(t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q")))


@query("vec_01_l2_distance", f"SELECT e.vec_id, {_L2} AS distance FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q")
def _(t):
    return t.embeddings.crossJoin(probe(t)).select("vec_id", F.round(vectors.l2("embedding", "q"), 6).alias("distance"))


@query("vec_02_score", f"SELECT e.vec_id, round(1 / (1 + {_L2}), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q")
def _(t):
    return t.embeddings.crossJoin(probe(t)).select("vec_id", F.round(1 / (1 + F.round(vectors.l2("embedding", "q"), 6)), 6).alias("score"))


@query("vec_03_pad", "SELECT vec_id, len(embedding) + 36 AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def _(t):
    x = vectors.padded("embedding", 100)
    return t.embeddings.select("vec_id", F.size(x).cast("long").alias("n"), F.round(vectors.total(x), 4).alias("total"))


@query("vec_04_fixed_dimension", "SELECT vec_id, 32::BIGINT AS n, round(list_sum(embedding[1:32]::DOUBLE[]), 4) AS total FROM embeddings")
def _(t):
    x = vectors.fixed("embedding", 32)
    return t.embeddings.select("vec_id", F.size(x).cast("long").alias("n"), F.round(vectors.total(x), 4).alias("total"))


@query("vec_05_same_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def _(t):
    return t.embeddings.where(F.size("embedding") == 64).select("vec_id")


@query("vec_06_test_embedding")
def _(t):
    """The deterministic embedding of each benchmark text, which stands in where no model is at hand; held against a plain version by a test."""
    return vectors.hashed(t.benchmark, "item_id", "text", 256)


@query("srt_02_knn", f"SELECT vec_id, distance FROM (SELECT e.vec_id, {_L2} AS distance FROM embeddings e, (SELECT embedding, label FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE e.label = q.label) ORDER BY distance, vec_id LIMIT 10")
def _(t):
    """The nearest ten within the probe's partition."""
    q = F.broadcast(t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"), "label"))
    near = t.embeddings.join(q, "label").select("vec_id", F.round(vectors.l2("embedding", "q"), 6).alias("distance"))
    return near.orderBy("distance", "vec_id").limit(10)


@query("mth_01_rrf", "SELECT event_id, round(coalesce(1.0 / (60 + v), 0) + coalesce(2.0 / (60 + f), 0), 9)::DOUBLE AS score FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 + 1 END AS v, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 40 + 1 END AS f FROM events)")
def _(t):
    x = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50 + 1).alias("v"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 40 + 1).alias("f"))
    return x.select("event_id", F.round(ranking.rrf("v", "f", 1.0, 2.0), 9).alias("score"))


@query("mth_03_negate_and_clip", "SELECT event_id, CASE WHEN s IS NOT NULL THEN round(-least(s, 0), 6) + 0.0 END AS score FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 20 END AS s FROM events)")
def _(t):
    s = F.when(F.col("event_id") % 5 != 0, F.col("value") - 20)
    return t.events.select("event_id", F.when(s.isNotNull(), F.round(-F.least(s, F.lit(0.0)), 6) + F.lit(0.0)).alias("score"))


@query("mth_06_relative_delta", """SELECT event_id, CASE WHEN b = 0 AND c = 0 THEN 'same' WHEN b = 0 THEN 'better' WHEN (c - b) / b > 0.05 THEN 'better' WHEN (c - b) / b < -0.05 THEN 'worse' ELSE 'same' END AS verdict FROM (SELECT event_id, (event_id % 7)::DOUBLE AS b, (event_id % 5)::DOUBLE AS c FROM events)""")
def _(t):
    from ..operators import evaluation

    return t.events.select("event_id", (F.col("event_id") % 7).cast("double").alias("b"), (F.col("event_id") % 5).cast("double").alias("c")).select("event_id", evaluation.verdict("b", "c", 0.05).alias("verdict"))


@query("mth_07_progress", "SELECT event_id, least(100, greatest(0, round(100.0 * (event_id % 60) / greatest(1, event_id % 50))))::BIGINT AS percent FROM events")
def _(t):
    x = 100.0 * (F.col("event_id") % 60) / F.greatest(F.lit(1), F.col("event_id") % 50)
    return t.events.select("event_id", F.least(F.lit(100), F.greatest(F.lit(0), F.round(x))).cast("long").alias("percent"))


@query("mth_08_backoff", "SELECT event_id, least(600000, 1000 * 2 ** least(event_id % 20, 19))::BIGINT AS wait_ms FROM events")
def _(t):
    return t.events.select("event_id", F.least(F.lit(600_000), 1000 * F.pow(F.lit(2.0), F.least(F.col("event_id") % 20, F.lit(19)))).cast("long").alias("wait_ms"))


@query("mth_09_adaptive_concurrency")
def _(t):
    """Of each key, in order: halved by a failure, one more after a success, from 1 to 8 (a fold over the key's events; held against a plain one by a test)."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_type") == "error").alias("bad")))), lambda x: x["bad"])
    step = lambda n, bad: F.when(bad, F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.least(F.lit(8), n + 1))
    return t.events.groupBy("user_id").agg(seq.alias("s")).select("user_id", F.aggregate("s", F.lit(3), step).alias("concurrency"))
