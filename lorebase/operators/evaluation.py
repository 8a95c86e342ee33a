"""Retrieval quality: metrics per query, means, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative tolerances of headline metrics and of metrics by intent.
HEADLINE_TOLERANCE, INTENT_TOLERANCE = 0.05, 0.10


def per_query(ranked: DataFrame, judged: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Metrics of each query from ranked (query, url, pos from 0) and judged (query, url, grade).

    Of a url that comes twice the first place counts. The ideal order is a window over the judgements of a query.
    """
    first = ranked.groupBy("query", "url").agg(F.min("pos").alias("pos"))
    good = judged.where("grade > 0")
    hits = first.join(good, ["query", "url"])
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + F.lit(2.0))
    got = hits.groupBy("query").agg(
        (F.lit(1.0) / (F.min("pos") + 1)).alias("mrr"),
        *[F.count(F.when(F.col("pos") < k, 1)).alias(f"_r{k}") for k in ks],
        *[F.sum(F.when(F.col("pos") < k, gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias(f"_d{k}") for k in ks],
        F.max(F.when(F.col("pos") < 1, 1).otherwise(0)).alias("_h1"),
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "url")) - 1
    ideal = good.select("query", "grade", place.alias("pos")).groupBy("query").agg(F.count("*").alias("_n"), *[F.sum(F.when(F.col("pos") < k, gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias(f"_i{k}") for k in ks])
    every = ranked.select("query").union(judged.select("query")).distinct().join(got, "query", "left").join(ideal, "query", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(zero(a), F.col(b)), F.lit(0.0))
    return every.select(
        "query", F.coalesce("mrr", F.lit(0.0)).alias("mrr"), zero("_h1").cast("double").alias("hit_1"),
        *[share(f"_r{k}", "_n").alias(f"recall_{k}") for k in ks], *[share(f"_d{k}", f"_i{k}").alias(f"ndcg_{k}") for k in ks], *[F.when(zero(f"_r{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks],
    )


def means(metrics: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Mean of each column, 0 without rows; with ``by`` a row each and their number."""
    agg = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns]
    return metrics.groupBy(by).agg(F.count("*").alias("n"), *agg) if by else metrics.agg(F.count("*").alias("n"), *agg)


def relative(base: str | Column, now: str | Column) -> Column:
    """(now - base) / base; with base 0 infinite, or 0 if both are."""
    b, n = (F.col(x) if isinstance(x, str) else x for x in (base, now))
    return F.when(b != 0, (n - b) / b).when(n == 0, 0.0).when(n > 0, float("inf")).otherwise(float("-inf"))


def verdict(base: str | Column, now: str | Column, tolerance: float) -> Column:
    d = relative(base, now)
    return F.when(d > tolerance, "better").when(d < -tolerance, "worse").otherwise("same")


def compared(base: DataFrame, now: DataFrame, tolerance: float = HEADLINE_TOLERANCE, by_intent: float = INTENT_TOLERANCE) -> DataFrame:
    """base and now (scope, metric, value), joined on both; scope '' is the headline."""
    x = base.select("scope", "metric", F.col("value").alias("base")).join(now.select("scope", "metric", F.col("value").alias("now")), ["scope", "metric"], "full")
    head = verdict("base", "now", tolerance)
    return x.withColumn("verdict", F.when(F.col("base").isNull() | F.col("now").isNull(), "missing").when(F.col("scope") == "", head).otherwise(verdict("base", "now", by_intent)))


def same_setup(a: dict, b: dict) -> bool:
    """Whether two runs may be compared: equal settings; a model with and without its default provider is one."""
    plain = lambda d: {k: str(v).removeprefix("openai:") if k == "model" else v for k, v in d.items()}
    return plain(a) == plain(b)
