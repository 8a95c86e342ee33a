"""Order and hierarchy of chunks within a page: parents, neighbours, children, clusters, assembled context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def embedding_text(title: str | Column, url: str | Column, path: str, content: str) -> Column:
    """What is embedded of a chunk: title, address and path as headers, then the content."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("<title>"), c(title), F.lit("</title>\n<url>"), c(url), F.lit("</url>\n<path>"), F.array_join(path, " / "), F.lit("</path>\n"), F.col(content))


def parents(chunks: DataFrame) -> DataFrame:
    """Adds ``parent``: the last chunk before this one that has the path less its last part.

    As-of by union: each chunk asks under its parent's path and answers under its own; within (page, path) the last
    answer before a question is a running maximum. One shuffle, and no pairs.
    """
    asks = chunks.where(F.size("path") > 0).select("page_id", F.expr("slice(path, 1, size(path) - 1)").alias("key"), "sort_order", "id", F.lit(None).cast("struct<s:bigint,id:bigint>").alias("a"))
    answers = chunks.select("page_id", F.col("path").alias("key"), "sort_order", F.lit(None).cast("long").alias("id"), F.struct(F.col("sort_order").alias("s"), F.col("id").alias("id")).alias("a"))
    w = Window.partitionBy("page_id", "key").orderBy("sort_order").rangeBetween(Window.unboundedPreceding, -1)
    found = asks.union(answers).withColumn("p", F.max("a").over(w)).where("id is not null").select("id", F.col("p.id").alias("parent"))
    return chunks.join(found, "id", "left")


def neighbours(chunks: DataFrame) -> DataFrame:
    """Adds the ids of the chunk before and the two after it with the same path."""
    w = Window.partitionBy("page_id", "path").orderBy("sort_order", "id")
    return chunks.withColumns({"before1": F.lag("id").over(w), "after1": F.lead("id", 1).over(w), "after2": F.lead("id", 2).over(w)})


def children(chunks: DataFrame, limit: int) -> DataFrame:
    """(id, child) for the first ``limit`` chunks after each one that lie one level below it.

    Within (page, parent path) the children of a chunk are the next ones in order, so a frame of the following children
    does: questions and answers in one window, no pairs of a section's chunks.
    """
    asks = chunks.select("page_id", F.col("path").alias("key"), "sort_order", "id", F.lit(None).cast("bigint").alias("c"))
    answers = chunks.where(F.size("path") > 0).select("page_id", F.expr("slice(path, 1, size(path) - 1)").alias("key"), "sort_order", F.lit(None).cast("bigint").alias("id"), F.col("id").alias("c"))
    w = Window.partitionBy("page_id", "key").orderBy("sort_order", "c")
    rows = asks.union(answers).withColumn("nth", F.count("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a question sees how many answers came up to its own place; answers number themselves
    rows = rows.withColumn("nth", F.when(F.col("id").isNull(), F.col("nth")).otherwise(F.count("c").over(Window.partitionBy("page_id", "key").orderBy("sort_order").rangeBetween(Window.unboundedPreceding, 0))))
    wanted = rows.where("id is not null").select("page_id", "key", "id", F.explode(F.sequence(F.col("nth") + 1, F.col("nth") + limit)).alias("nth"))
    given = rows.where("id is null").select("page_id", "key", "nth", F.col("c").alias("child"))
    return wanted.join(given, ["page_id", "key", "nth"]).select("id", "child")


def ancestors(chunks: DataFrame, have: DataFrame) -> DataFrame:
    """(id, ancestor): the longest proper prefix of each chunk's path among the paths that ``have`` (page_id, path) holds."""
    asked = chunks.where(F.size("path") > 1).select("id", "page_id", F.explode(F.expr("transform(sequence(1, size(path) - 1), n -> slice(path, 1, n))")).alias("path"))
    return asked.join(have, ["page_id", "path"]).groupBy("id").agg(F.max_by("path", F.size("path")).alias("ancestor"))


def containing(rows: DataFrame, key: str, id_: str, lo: str, hi: str, bucket: int, strict: bool = False) -> DataFrame:
    """(id, best): of the other intervals of the key that contain this one, the shortest, ties by id. Intervals are filed under the buckets they touch and asked for under that of their start."""
    filed = rows.select(F.col(key).alias("k"), F.col(id_).alias("b"), F.col(lo).alias("bl"), F.col(hi).alias("bh"), F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))).alias("at"))
    asked = rows.select(F.col(key).alias("k"), F.col(id_), F.col(lo).alias("l"), F.col(hi).alias("h"), F.floor(F.col(lo) / bucket).alias("at"))
    inside = (F.col("bl") < F.col("l")) & (F.col("bh") > F.col("h")) if strict else (F.col("bl") <= F.col("l")) & (F.col("bh") >= F.col("h"))
    return asked.join(filed, ["k", "at"]).where(inside & (F.col("b") != F.col(id_))).groupBy(id_).agg(F.min_by("b", F.struct(F.col("bh") - F.col("bl"), "b")).alias("best"))


def clusters(rows: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """Adds ``cluster``, counted from 0 within the keys: a new one starts where the order jumps by more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def assembled(rows: DataFrame, keys: list[str], separator: str = "\n\n") -> DataFrame:
    """Per key the contents in order, joined."""
    seq = F.array_sort(F.collect_list(F.struct("sort_order", "id", "content")))
    return rows.groupBy(*keys).agg(seq.alias("_seq")).select(*keys, F.array_join(F.transform("_seq", lambda x: x["content"]), separator).alias("content"))


def common_prefix(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, prefix): the longest common prefix of a group's paths. Paths compare part by part, so that of the smallest and the largest is that of all; no list is collected."""
    per = rows.groupBy(*keys).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    n = F.expr("size(filter(transform(sequence(1, least(size(a), size(b)) + 1), n -> slice(a, 1, n) = slice(b, 1, n) and n <= least(size(a), size(b))), x -> x))")
    return per.select(*keys, F.slice("a", F.lit(1), n).alias("prefix"))


def expanded(hits: DataFrame, chunks: DataFrame, before: int = 1, children_limit: int = 3, after: int = 2) -> DataFrame:
    """(hit, id) of a hit and its context: the parent, the neighbours of its path before and after it, its first children."""
    wanted = hits.select(F.col("id").alias("hit"), F.col("id"))
    pages = chunks.join(hits.select("page_id").distinct(), "page_id", "left_semi")
    own = hits.select("id")
    up = parents(pages).join(own, "id", "left_semi").select(F.col("id").alias("hit"), F.col("parent").alias("id"))
    w = Window.partitionBy("page_id", "path").orderBy("sort_order", "id")
    side = pages.withColumn("near", F.array(*[F.lag("id", k).over(w) for k in range(1, before + 1)], *[F.lead("id", k).over(w) for k in range(1, after + 1)]))
    side = side.join(own, "id", "left_semi").select(F.col("id").alias("hit"), F.explode("near").alias("id"))
    down = children(pages, children_limit).join(own, "id", "left_semi").select(F.col("id").alias("hit"), F.col("child").alias("id"))
    return wanted.union(up).union(side).union(down).where("id is not null").distinct()
