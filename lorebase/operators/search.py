"""Full-text and hybrid search: BM25 over weighted columns, KNN, rank fusion, clusters with context.

Words are looked up in a stored index (:mod:`.postings`) where the caller has one; without one a search reads the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import context, postings, ranking, vectors
from .postings import B, K1

#: Weights of the indexed columns.
WEIGHTS = {"content": 10.0, "title": 1.0, "url": 5.0, "path": 1.0}


def indexed(docs: DataFrame, columns: list[str], keep: list[str], stemmed: bool = False) -> DataFrame:
    """keep columns, and of each indexed column ``n_<column>``, its tokens' number, and ``x_<column>``, the tokens with a space on either side, so that a phrase is a substring. Unstemmed tokens come from Spark's expressions alone."""
    if not stemmed:
        made = docs.select(*keep, *[text.tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"w_{c}") for c in columns])
    else:
        kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}

        def run(batches):
            for b in batches:
                own = [b.column(i) for i in range(len(keep))]
                words = [pa.array([text.search_tokens(x or "") for x in b.column(len(keep) + i).to_pylist()], pa.list_(pa.string())) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*own, *words], names=[*keep, *(f"w_{c}" for c in columns)])

        schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), *(f"w_{c} array<string>" for c in columns)])
        made = docs.select(*keep, *[F.col(c).cast("string") for c in columns]).mapInArrow(run, schema)
    return made.select(*keep, *[F.size(f"w_{c}").alias(f"n_{c}") for c in columns], *[F.concat(F.lit(" "), F.array_join(f"w_{c}", "  "), F.lit(" ")).alias(f"x_{c}") for c in columns])


def phrase_count(spaced: str | Column, phrase: list[str]) -> Column:
    """How often the phrase stands in a spaced column of :func:`indexed`; occurrences don't overlap."""
    x, want = vectors.col(spaced), " " + "  ".join(phrase) + " "
    return F.floor((F.length(x) - F.length(F.replace(x, F.lit(want), F.lit("")))) / len(want)).cast("int")


def bm25(index: DataFrame, keep: list[str], columns: list[str], phrases: list[list[str]], weights: dict[str, float] | None = None) -> DataFrame:
    """keep columns and ``score`` of the rows that hold any phrase.

    One pass over the index counts each phrase in each column; the corpus's statistics (rows, tokens, and how many rows
    hold each phrase) are one aggregated row, broadcast. Only rows with a hit leave the scan.
    """
    weights = weights or dict.fromkeys(columns, 1.0)
    tf = [sum((F.lit(float(weights.get(c, 1.0))) * phrase_count(f"x_{c}", p) for c in columns), F.lit(0.0)) for p in phrases]
    size = sum((F.col(f"n_{c}") for c in columns), F.lit(0))
    counted = index.select(*keep, size.alias("_n"), *[x.alias(f"_t{i}") for i, x in enumerate(tf)], *[F.greatest(F.lit(0), *[phrase_count(f"x_{c}", p) for c in columns]).alias(f"_h{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(F.count("*").alias("_rows"), F.avg("_n").alias("_avg"), *[F.count(F.when(F.col(f"_h{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(phrases))])
    hits = counted.where(" or ".join(f"_h{i} > 0" for i in range(len(phrases)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.greatest(F.log((F.col("_rows") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(1e-6))
        t = F.col(f"_t{i}")
        score = score + F.when(F.col(f"_h{i}") > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    return hits.select(*keep, score.alias("score"))


def parsed(query: str, stemmed: bool = False) -> list[list[str]]:
    """A user's query as phrases of tokens, each once."""
    cut: Callable[[str], list[str]] = text.search_tokens if stemmed else (lambda x: [w for w in text._WORD.findall(x.lower())])
    out: list[list[str]] = []
    for p in text.phrases(query):
        words = cut(p)
        if words and words not in out:
            out.append(words)
    return out


def full_text(docs: DataFrame, query: str, limit: int, id_col: str = "id", columns: list[str] | None = None, stemmed: bool = False, index: postings.Index | None = None) -> DataFrame:
    """(id, score, rank) of the best ``limit`` rows, from the index of docs if there is one. Structural chunks are left out before the limit. A blank query finds nothing."""
    columns, stemmed = (list(index.columns), index.stemmed) if index else (columns or ["content"], stemmed)
    phrases = parsed(query, stemmed)
    if not phrases:
        return docs.limit(0).select(id_col, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    keep = [id_col, *(["types"] if "types" in docs.columns else [])]
    weights = {c: WEIGHTS.get(c, 1.0) for c in columns} if len(columns) > 1 else None
    if index:
        found = postings.bm25(index, phrases, keep[1:], weights).withColumnRenamed("id", id_col)
    else:
        found = bm25(indexed(docs, columns, keep, stemmed), keep, columns, phrases, weights)
    if "types" in keep:
        found = found.where(~F.array_contains("types", "structural"))
    best = found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), id_col)).cast("long")).select(id_col, "score", "rank")  # at most ``limit`` rows


def nearest(vecs: DataFrame, probe: list[float] | DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """(id, distance, rank) of the nearest ``limit`` vectors by Euclidean distance; probe is a literal or a one-row (q)."""
    if isinstance(probe, DataFrame):
        rows, q = vecs.crossJoin(F.broadcast(probe)), F.col("q")
    else:
        rows, q = vecs, F.array(*[F.lit(float(x)) for x in probe])
    best = rows.select(id_col, F.round(vectors.l2("embedding", q), 6).alias("distance")).orderBy("distance", id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", id_col)).cast("long"))


def hybrid(docs: DataFrame, vecs: DataFrame | None, query: str, probe, limit: int = 10, overfetch: float = 2, multiplier: int = 10, weight_vec: float = 1.0, weight_fts: float = 1.0, id_col: str = "id", **options) -> DataFrame:
    """(id, vec_rank, fts_rank, score): both channels' candidates, fused by reciprocal rank. Without vectors (no provider, no probe) the words alone decide."""
    window = ranking.candidate_window(limit, overfetch, multiplier)
    plain = docs.drop("types") if "types" in docs.columns else docs
    fts = full_text(plain, query, window, id_col, **options).select(id_col, F.col("rank").alias("fts_rank"))
    if vecs is None or probe is None:
        both = fts.withColumn("vec_rank", F.lit(None).cast("long"))
        both = both.withColumn("score", ranking.rrf("vec_rank", "fts_rank", weight_vec, weight_fts))
    else:
        vec = nearest(vecs, probe, window, id_col).select(id_col, F.col("rank").alias("vec_rank"))
        both = ranking.fused(vec, fts, [id_col], weight_vec, weight_fts)
    if "types" in docs.columns:  # after each channel's truncation
        both = both.join(docs.where(F.array_contains("types", "structural")).select(id_col), id_col, "left_anti")
    both = both.select(id_col, "vec_rank", "fts_rank", F.round("score", 9).alias("score"))
    return both.orderBy(F.desc("score"), id_col).limit(limit)


def with_context(hits: DataFrame, chunks: DataFrame, gap: int = 3, limit: int = 10, separator: str = "\n\n") -> DataFrame:
    """(page_id, content, score): hits of a page closer than ``gap`` form one result with their context in reading order; a cluster scores as its best hit; of results with one text the best stays."""
    # the hits are few (the candidate window bounds them): as literals they prune the scans of their pages
    spark = chunks.sparkSession
    found = {r["id"]: r["score"] for r in hits.select("id", "score").limit(ranking.MOST + 1).collect()}
    if len(found) > ranking.MOST:
        raise ValueError("more hits than a candidate window holds")
    where = chunks.where(F.col("id").isin(list(found))).select("id", "page_id", "sort_order").collect()
    columns = [pa.array([r[c] for r in where], pa.int64()) for c in ("id", "page_id", "sort_order")]
    table = pa.table([*columns, pa.array([float(found[r["id"]]) for r in where], pa.float64())], names=["id", "page_id", "sort_order", "score"])
    own = context.clusters(spark.createDataFrame(table), ["page_id"], "sort_order", gap)
    pages = chunks.where(F.col("page_id").isin(sorted({r["page_id"] for r in where})))
    around = context.expanded(own.select("id", "page_id"), pages)
    member = around.join(own.select(F.col("id").alias("hit"), "page_id", "cluster"), "hit").select("page_id", "cluster", "id").distinct()
    body = context.assembled(member.join(pages.select("id", "sort_order", "content"), "id"), ["page_id", "cluster"], separator)
    score = own.groupBy("page_id", "cluster").agg(F.max("score").alias("score"))
    out = body.join(score, ["page_id", "cluster"])
    best = out.groupBy("content").agg(F.max_by(F.struct("page_id", "score"), F.struct("score", -F.col("page_id"))).alias("b"))
    return best.select("b.page_id", "content", "b.score").orderBy(F.desc("score"), "page_id").limit(limit)


def ndcg(gains: list[float], ideal: list[float], k: int) -> float:
    """Plain normalised discounted gain, for tests and small tools."""
    dcg = lambda g: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(g[:k]))
    best = dcg(sorted(ideal, reverse=True))
    return dcg(gains) / best if best else 0.0
