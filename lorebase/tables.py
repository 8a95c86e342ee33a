"""Parquet tables of a folder, and the corpus model derived from them.

A page is a document, its chunks are its lines; the library is the source and the version the language. A chunk's path
follows from its place: every eighth line opens a section, the next three lie in its part ``a``, the others in ``a / b``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import postings
from .operators.postings import Index
from .session import state_of

_INDEXES: dict[tuple, Index] = {}


class Tables:
    """``t.documents`` reads documents.parquet of the folder; columns and filters are pruned by the plan that uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def index(self, what: str) -> Index:
        """The stored full-text index of ``documents`` (id, lang) or ``chunks`` (id, types, library, version), built at its first use in an application for the table as it is."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, what, state_of(self.spark, f"{self.sf_dir}/documents.parquet"))
        if key not in _INDEXES:
            if what == "chunks":
                _INDEXES[key] = postings.build(self.chunks(), ["content"], ["types", "library", "version"])
            else:
                _INDEXES[key] = postings.build(self.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang"), ["content"], ["lang"])
        return _INDEXES[key]

    def chunks(self) -> DataFrame:
        """id, page_id, library, version, sort_order, content, path, level, types: one row a line."""
        lines = self.documents.select("doc_id", "source", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "content"))
        pos = F.col("pos").cast("long")
        section = F.concat(F.lit("s"), F.floor(pos / 8).cast("string"))
        path = F.when(pos % 8 == 0, F.array(section)).when(pos % 8 <= 3, F.array(section, F.lit("a"))).otherwise(F.array(section, F.lit("a"), F.lit("b")))
        types = F.when(pos % 8 == 0, F.array(F.lit("text"), F.lit("heading"))).when(F.length("content") < 20, F.array(F.lit("text"), F.lit("structural"))).otherwise(F.array(F.lit("text")))
        return lines.select(
            (F.col("doc_id") * 1_000_000 + pos).alias("id"), F.col("doc_id").alias("page_id"), F.col("source").alias("library"), F.col("lang").alias("version"),
            pos.alias("sort_order"), "content", path.alias("path"), F.size(path).cast("long").alias("level"), types.alias("types"),
        )


#: The same model for DuckDB, as the start of a WITH clause; path and types are joined by a slash and a comma.
CHUNKS = """chunks AS (
  SELECT doc_id * 1000000 + pos AS id, doc_id AS page_id, source AS library, lang AS version, pos AS sort_order, content,
    CASE WHEN pos % 8 = 0 THEN ['s' || (pos // 8)] WHEN pos % 8 <= 3 THEN ['s' || (pos // 8), 'a'] ELSE ['s' || (pos // 8), 'a', 'b'] END AS path,
    CASE WHEN pos % 8 = 0 THEN 1 WHEN pos % 8 <= 3 THEN 2 ELSE 3 END::BIGINT AS level,
    CASE WHEN pos % 8 = 0 THEN ['text', 'heading'] WHEN length(content) < 20 THEN ['text', 'structural'] ELSE ['text'] END AS types
  FROM (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents))"""
