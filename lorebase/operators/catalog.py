"""Libraries, versions, statistics, activity and health of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Below both a collection is small.
SMALL_PAGES, SMALL_CHUNKS = 5, 20


def catalog(pages: DataFrame) -> DataFrame:
    """Per version, from (library, version, page_id, n, pending): pages, chunks, pages with chunks that wait for vectors."""
    return pages.groupBy("library", "version").agg(
        F.count("*").alias("pages"), F.min("page_id").alias("first_page"), F.sum("n").alias("chunks"), F.count(F.when(F.col("pending") > 0, 1)).alias("pending_pages"), F.count(F.when(F.col("pending") <= 0, 1)).alias("embedded_pages"),
    )


def health(versions: DataFrame) -> DataFrame:
    """Adds ``note``: what a reader should know of a version, from the catalog and a flag ``failed``."""
    note = F.concat_ws(
        "; ",
        F.when(F.col("failed"), "last run failed"),
        F.when(F.col("embedded_pages") < F.col("pages"), F.concat(F.col("embedded_pages").cast("string"), F.lit(" of "), F.col("pages").cast("string"), F.lit(" pages embedded"))),
        F.when(F.col("pages") < SMALL_PAGES, "small collection"),
    )
    return versions.withColumn("note", note)


def libraries(versions: DataFrame) -> DataFrame:
    """Per library its versions in order with their pages, small ones marked. A library has as many entries as versions."""
    entry = F.concat("version", F.lit(":"), F.col("pages").cast("string"), F.when((F.col("pages") < SMALL_PAGES) & (F.col("chunks") < SMALL_CHUNKS), " small").otherwise(""))
    return versions.groupBy("library").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", entry.alias("e")))), lambda x: x["e"]), ", ").alias("versions"))


def activity(rows: DataFrame, ts: str, page: str, since: str, until: str) -> DataFrame:
    """(day, pages, chunks, total_chunks) for each day, zeros where nothing happened. Distinct pages are counted in two levels."""
    per = rows.groupBy(F.to_date(ts).alias("day"), page).agg(F.count("*").alias("n")).groupBy("day").agg(F.count("*").alias("pages"), F.sum("n").alias("chunks"))
    days = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(since).cast("date"), F.lit(until).cast("date"))).alias("day"))
    total = F.sum("chunks").over(Window.partitionBy(F.lit(0)))  # one row a day
    return days.join(per, "day", "left").fillna(0, ["pages", "chunks"]).withColumn("total_chunks", total)


def list_chunks(chunks: DataFrame, text: str | None, offset: int, limit: int) -> DataFrame:
    """A page of chunks with their index in their page, counted after the filter, and the total."""
    hits = chunks.where(F.contains(F.lower("content"), F.lit(text.lower()))) if text else chunks
    w = Window.partitionBy("page_id")
    shown = hits.select("id", "page_id", "sort_order", F.row_number().over(w.orderBy("sort_order", "id")).cast("long").alias("chunk_index"), F.count("*").over(w).alias("page_count"))
    total = hits.agg(F.count("*").alias("total"))  # one row
    return shown.orderBy("page_id", "sort_order", "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))
