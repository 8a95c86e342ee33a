"""A stored full-text index: postings with positions, read by term.

Rows are of two kinds. A posting (term not null): id, the columns kept, the indexed column's number, term, positions of
its tokens, and the row's tokens over all columns. A row of the corpus (term null) has its tokens' number only. The table
is a sequence of runs, each sorted by term and made where its texts are read, so nothing is shuffled; by the pages' least
and largest terms a query reads few pages of each run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import shared_path

#: BM25 constants.
K1, B = 1.2, 0.75
#: Tokens of a sorted run, of which a task holds one at a time, and rows that leave at once.
RUN, LEAVE = 2_000_000, 100_000


@dataclass(frozen=True)
class Index:
    """columns: the indexed ones, by number; stats: one row (rows, average tokens)."""

    rows: DataFrame
    stats: DataFrame
    columns: tuple[str, ...]
    stemmed: bool = False

    def where(self, condition: Column | str) -> Index:
        """The index of the rows that fulfil a condition on kept columns; statistics are theirs."""
        rows = self.rows.where(condition)
        return replace(self, rows=rows, stats=statistics(rows))

    def document_frequency(self) -> DataFrame:
        """(term, df): in how many rows each term stands."""
        found = self.rows.where("term is not null")
        per = found.groupBy("term").agg(F.count("*").alias("df")) if len(self.columns) == 1 else found.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))
        return per


def statistics(rows: DataFrame) -> DataFrame:
    return rows.where("term is null").agg(F.count("*").alias("_rows"), F.avg(F.coalesce("n", F.lit(0))).alias("_avg"), F.avg("n").alias("_avg_known"))


def runs(batches: Iterator[pa.RecordBatch], first: int, most: int) -> Iterator[pa.Table]:
    """Rows in order, together up to ``most`` tokens of the list columns from ``first`` on; a larger row is one of its own."""
    held, size = [], 0
    for b in batches:
        upto = np.concatenate([[0], np.cumsum(sum(np.asarray(pc.fill_null(pc.list_value_length(b.column(k)), 0), np.int64) for k in range(first, b.num_columns)))])
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + most - size, "right")) - 1)
            held.append(b.slice(start, stop - start))
            size += int(upto[stop] - upto[start])
            start = stop
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def inverted(tokens: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, term, positions) of lists of tokens, by term, then row."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    parent = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts)
    coded = tokens.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by_name), np.int64)
    rank[by_name.to_numpy()] = np.arange(len(by_name))
    # tokens stand by row and place already, so their numbers break ties
    shift = max(1, len(parent).bit_length())
    key = np.sort((rank[coded.indices.to_numpy()] << shift) | np.arange(len(parent)))
    token, name = key & ((1 << shift) - 1), key >> shift
    row = parent[token]
    starts = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.empty(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(at[token], pa.int32()))
    return row[starts], coded.dictionary.take(by_name.take(pa.array(name[starts]))), places


def build(docs: DataFrame, columns: list[str], keep: list[str] | None = None, id_col: str = "id", stemmed: bool = False, path: str | None = None) -> Index:
    """Writes the index of docs: one pass over the texts, no shuffle. Tokens come from Spark's expressions, or, stemmed, from the stemmer."""
    keep = keep or []
    spark = docs.sparkSession
    words = [F.array(F.col(f"`{c}`").cast("string")) if stemmed else text.tokens(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns]
    known = F.greatest(*[F.col(f"`{c}`").isNotNull() for c in columns], F.lit(False))
    made = docs.select(F.col(id_col).alias("id"), *keep, known.alias("known"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    kinds = [(f.name, f.dataType.simpleString()) for f in made.schema.fields[: 1 + len(keep)]]
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds), "col int", "term string", "positions array<int>", "n int"])
    own = [c for c, _ in kinds]

    def stems(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                lists = [pa.array([text.search_tokens(t[0] or "") for t in part.column(len(own) + 1 + i).to_pylist()], pa.list_(pa.string())) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own) + 1], *lists], names=part.schema.names)

    def run(batches):
        for part in runs(stems(batches) if stemmed else batches, len(own) + 1, RUN):
            part = part.combine_chunks().to_batches()[0]
            kept, lists = part.select(range(len(own))), part.columns[len(own) + 1 :]
            size = sum(np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64) for x in lists)

            def rows(row, col, term, places, n, kept=kept):
                for i in range(0, len(row), LEAVE):
                    columns = [*kept.take(pa.array(row[i : i + LEAVE])).columns, pa.array(col[i : i + LEAVE], pa.int32()), term[i : i + LEAVE], places[i : i + LEAVE], pa.array(n[i : i + LEAVE], pa.int32(), from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*own, "col", "term", "positions", "n"])

            every = np.arange(part.num_rows)
            yield from rows(every, [None] * len(every), pa.nulls(len(every), pa.string()), pa.nulls(len(every), pa.list_(pa.int32())), np.where(np.asarray(part.column(len(own))), size, np.nan))
            for k, x in enumerate(lists):
                row, term, places = inverted(x)
                yield from rows(row, np.full(len(row), k), term, places, size[row])

    path = path or shared_path(spark, "postings")
    rows = made.mapInArrow(run, schema)
    rows.write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    statistics(rows).coalesce(1).write.parquet(f"{path}/stats")
    return Index(rows, spark.read.parquet(f"{path}/stats"), tuple(columns), stemmed)


def occurrences(places: Column, phrase: list[str], col: int) -> Column:
    """How often the phrase stands in a column of a row, from a map of (column, term) to positions; occurrences don't overlap."""
    at = lambda w: F.coalesce(F.try_element_at(places, F.lit(f"{col} {w}")), F.array().cast("array<int>"))
    if len(phrase) == 1:
        return F.size(at(phrase[0]))
    starts = at(phrase[0])
    back = lambda places, k: F.transform(places, lambda p: p - k)
    for k, w in enumerate(phrase[1:], 1):
        starts = F.array_intersect(starts, back(at(w), k))
    if not any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase))):
        return F.size(starts)
    state = F.struct(F.lit(0).alias("n"), F.lit(-len(phrase)).alias("last"))
    take = lambda s, p: F.when(p >= s["last"] + len(phrase), F.struct((s["n"] + 1).alias("n"), p.alias("last"))).otherwise(s)
    return F.aggregate(F.array_sort(starts), state, take, lambda s: s["n"])


def hits(index: Index, phrases: list[list[str]], keep: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """id, kept columns, _n, and of each phrase i how often it stands in the row, _h{i}, and so weighed by column, _t{i}: rows that hold any phrase. Only the phrases' terms are read; their postings meet by id."""
    terms = sorted({w for p in phrases for w in p})
    weights = weights or dict.fromkeys(index.columns, 1.0)
    found = index.rows.where(F.col("term").isin(terms))
    first = [F.first(c).alias(c) for c in keep or []]
    entry = F.struct(F.concat(F.col("col").cast("string"), F.lit(" "), "term"), "positions")
    per = found.groupBy("id").agg(*first, F.first("n").alias("_n"), F.map_from_entries(F.collect_list(entry)).alias("_at"))
    held = [[occurrences(F.col("_at"), p, c) for c in range(len(index.columns))] for p in phrases]
    count = [sum(x, F.lit(0)).alias(f"_h{i}") for i, x in enumerate(held)]
    weighed = [sum((F.lit(float(weights.get(name, 1.0))) * x for name, x in zip(index.columns, xs, strict=True)), F.lit(0.0)).alias(f"_t{i}") for i, xs in enumerate(held)]
    return per.select("id", *(keep or []), "_n", *count, *weighed).where(" or ".join(f"_h{i} > 0" for i in range(len(phrases))))


def bm25(index: Index, phrases: list[list[str]], keep: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """id, kept columns and ``score`` of the rows that hold any phrase. How many rows hold each phrase is one row of sums over the hits, which with the corpus's stored statistics is broadcast."""
    rows = hits(index, phrases, keep, weights)
    seen = rows.agg(*[F.count(F.when(F.col(f"_h{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(phrases))])
    rows = rows.crossJoin(F.broadcast(seen.crossJoin(index.stats)))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.greatest(F.log((F.col("_rows") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(1e-6))
        t = F.col(f"_t{i}")
        score = score + F.when(F.col(f"_h{i}") > 0, idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    return rows.select("id", *(keep or []), score.alias("score"))
