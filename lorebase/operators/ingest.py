"""Writes as plans: upserts, reuse, deletion, backlog and refresh over page and chunk tables.

Tables are rewritten by partition (a version's), so each function gives the table's next state; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def winners(writes: DataFrame, keys: list[str]) -> DataFrame:
    """Of the writes of a page in one run (keys, seq, markdown flag ``is_markdown``, alternative flag ``extra``): Markdown over others, then a plain write over an alternative, then the last. Independent of the order of arrival but for the last rule."""
    rank = F.struct(F.col("is_markdown").cast("int").alias("m"), (~F.col("extra")).cast("int").alias("p"), "seq")
    cols = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("w")).select(*keys, "w.*")


def upsert(pages: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """pages with each write in place of the page of its keys; the columns are those of pages."""
    kept = pages.join(writes.select(*keys), keys, "left_anti")
    return kept.select(*pages.columns).unionByName(writes.select(*pages.columns))


def changes(pages: DataFrame, writes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of each write: new, unchanged (the same text and title) or changed; texts compare by hash."""
    h = lambda d, a: d.select(*keys, F.sha2(F.concat_ws("\x01", F.coalesce("title", F.lit("")), F.coalesce("markdown", F.lit(""))), 256).alias(a))
    x = h(writes, "new").join(h(pages, "old"), keys, "left")
    return x.select(*keys, F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed").alias("change"))


def reused(chunks: DataFrame, before: DataFrame) -> DataFrame:
    """New chunks with the vectors of old ones of the same page, path and content; each old chunk serves equal new ones."""
    key = lambda d: d.withColumn("_h", F.sha2(F.concat_ws("\x01", F.array_join("path", "\x02"), "content"), 256))
    old = key(before.where("embedding is not null")).groupBy("page_id", "_h").agg(F.min_by("embedding", "id").alias("embedding"))
    return key(chunks.drop("embedding")).join(old, ["page_id", "_h"], "left").drop("_h")


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").select(*table.columns)


def deleted(pages: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, chunks) without the pages of gone (page_id) and what hangs on them."""
    return without(pages, gone, ["page_id"]), without(chunks, gone, ["page_id"])


def collapsible(pages: DataFrame) -> DataFrame:
    """(page_id) of query variants whose bare page is there with the same text but for white space."""
    squeeze = lambda c: F.sha2(F.trim(F.regexp_replace(c, r"\s+", " ")), 256)
    variant = pages.where(F.contains("url", F.lit("?"))).select("page_id", F.substring_index("url", "?", 1).alias("url"), squeeze("markdown").alias("h"))
    return variant.join(pages.select("url", squeeze("markdown").alias("h")), ["url", "h"], "left_semi").select("page_id")


def counted(rows: DataFrame, order: str) -> DataFrame:
    """Adds ``n``, from 1 in the order of a column. Partitions of a sort are numbered by their sizes, so no task sees all rows."""
    parts = stored(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "sorted")
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", before.alias("_before"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_n", within).join(F.broadcast(sizes), "_part").select(*rows.columns, (F.col("_n") + F.col("_before")).cast("long").alias("n"))


def numbered(names: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name): known names with their ids, new ones after the highest, in order."""
    new = names.distinct().join(known.select("name"), "name", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    fresh = counted(new, "name").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).cast("long").alias("id"), "name")
    return known.select("id", "name").union(fresh)


def backlog(chunks: DataFrame, vectors: DataFrame, batch: int) -> DataFrame:
    """The oldest chunks that wait for a vector."""
    return chunks.join(vectors.select("id"), "id", "left_anti").orderBy("id").limit(batch)


def batches(rows: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Adds ``batch``: rows in order fill batches of at most ``budget``, a larger row is one of its own. A fold, so per key over an array of (order, size)."""
    seq = F.array_sort(F.collect_list(F.struct(order, size)))
    start = "named_struct('sum', 0L, 'batch', 0L, 'out', cast(array() as array<bigint>))"
    step = f"""(s, r) -> named_struct('sum', if(s.sum > 0 and s.sum + r.{size} > {budget}, r.{size}, s.sum + r.{size}),
        'batch', if(s.sum > 0 and s.sum + r.{size} > {budget}, s.batch + 1, s.batch), 'out', concat(s.out, array(if(s.sum > 0 and s.sum + r.{size} > {budget}, s.batch + 1, s.batch))))"""
    per = rows.select(*keys, order, F.col(size).cast("long").alias(size)).groupBy(*keys).agg(seq.alias("_s"))
    per = per.withColumn("_b", F.expr(f"aggregate(_s, {start}, {step}, s -> s.out)"))
    return per.select(*keys, F.explode(F.arrays_zip("_s", "_b")).alias("z")).select(*keys, F.col(f"z._s.{order}").alias(order), F.col("z._b").alias("batch"))


def refreshed(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(page_id, action) for snapshot outcomes (page_id, status): 304 keeps, 404 deletes, 200 writes, others fail; a page without an outcome keeps."""
    x = pages.select("page_id").join(outcomes, "page_id", "left")
    return x.select("page_id", F.when(F.col("status") == 404, "delete").when(F.col("status") == 200, "write").when(F.col("status").isNull() | (F.col("status") == 304), "keep").otherwise("fail").alias("action"))


#: Fixed value: input bytes of a file of a compacted table.
FILE_BYTES = 256 * 1024 * 1024


def compacted(df: DataFrame, path: str, files: int, most: int = FILE_BYTES) -> None:
    """Writes a table anew in few files: as many as asked for, more where one would be made of over ``most`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df.coalesce(min(max(files, -(-size // most)), 2**31 - 1)).write.mode("overwrite").parquet(path)
