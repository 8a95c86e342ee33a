"""Mixing sources to target weights as a Pfair schedule of blocks.

A source's rows form blocks of ``block_rows``. Slots are filled one block each. Block k of a source with weight w is
released at slot floor(k / w) and due before slot ceil((k + 1) / w); of the released blocks the one due first is taken
(ties: the larger weight, then the source's name). So after t slots each source has had w * t blocks, less than one more
or less. When a source has no block left, the others go on by their weights among themselves (a new phase, counted from
its own start), until every row has its place: none is dropped, none comes twice.

Weights are exact: they become whole numbers over their common denominator, and releases and deadlines are counted in
those over the whole of a phase, however long. One task lays the schedule out from the sources' row counts, a block at a
time, and holds a few numbers a source. Rows find their slots by their numbers within the source, which are summed up
from counts of hash buckets and of groups of them: no source is sorted, nor are its buckets, in one place.

Defined cases: a null source is a source of its own, named by null; a source without a target weight has the default
weight; a weight of 0 puts the source after all others; rows are ordered within a source by a hash of the id, then the
id, then a hash of the row, so the order is settled up to equal rows; a column that has the name of a result gives way
to it, other names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_names, stored

BLOCK_ROWS = 16
BUCKET_ROWS = 512


def whole(weights: list[Fraction]) -> list[int]:
    """The weights as whole numbers in the same proportions."""
    den = math.lcm(*(w.denominator for w in weights))
    out = [w.numerator * (den // w.denominator) for w in weights]
    part = math.gcd(*out) or 1
    return [x // part for x in out]


def earliest_deadlines(parts: list[int], left: list[int]) -> Iterator[int]:
    """Sources by slot, until a source whose turn it is has none of ``left`` blocks. Weights are parts / sum(parts)."""
    total = sum(parts)
    ready = [(-(-total // p), -p, i) for i, p in enumerate(parts)]
    heapq.heapify(ready)
    later: list[tuple[int, int]] = []
    used, slot = [0] * len(parts), 0
    while True:
        while later and later[0][0] <= slot:
            _, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(used[i] + 1) * total // parts[i]), -parts[i], i))
        _, _, i = heapq.heappop(ready)
        if used[i] == left[i]:
            return
        used[i] += 1
        yield i
        heapq.heappush(later, (used[i] * total // parts[i], i))
        slot += 1


def phases(counts: list[int], weights: list[Fraction]) -> Iterator[tuple[dict[int, int], Iterator[int]]]:
    """(parts by source, sources by slot) of each phase; a phase is to be read to its end before the next."""
    left, every = list(counts), whole(weights)

    def run(live: list[int], parts: list[int]) -> Iterator[int]:
        for k in earliest_deadlines(parts, [left[i] for i in live]):
            left[live[k]] -= 1
            yield live[k]

    live = [i for i, n in enumerate(left) if n]
    while live:
        now = [i for i in live if every[i] > 0]
        parts = [every[i] for i in now] if now else [1] * len(live)
        now = now or live
        yield dict(zip(now, parts, strict=True)), run(now, parts)
        live = [i for i in live if left[i]]


def layout(counts: list[int], weights: list[Fraction], period: int | None = None) -> list[dict]:
    """The phases as lists: start (slot), first (block number by source), periods, parts, cycle, rest (sources by slot). Weights are exact, so ``period`` rounds nothing: the parts' sum is the period, and a phase is one part of it or more, all in ``rest``."""
    first, start, out = [0] * len(counts), 0, []
    for parts, order in phases(counts, weights):
        out.append({"start": start, "first": {i: first[i] for i in parts}, "periods": 0, "parts": parts, "cycle": [], "rest": list(order)})
        start += len(out[-1]["rest"])
        for i in out[-1]["rest"]:
            first[i] += 1
    return out


def slots(sizes: DataFrame, weights: dict | None, block_rows: int, exponent: float, default: float | None) -> DataFrame:
    """(_s, _block, _slot) of every block, from (s, key, n) of the sources."""

    def run(batches):
        found = [row for b in batches for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("s", "key", "n")), strict=True)]
        found.sort(key=lambda r: (r[0] is None, str(r[0])))
        if weights is None:
            w = [Fraction(n**exponent) for _, _, n in found]
        else:
            other = min(weights.values(), default=1) if default is None else default
            # decimal fractions are meant, not the nearest binary ones
            w = [Fraction(weights.get(s, other)).limit_denominator(10**9) for s, _, _ in found]
        w = [max(x, Fraction(0)) for x in w]
        keys, next_block, held, slot = [r[1] for r in found], [0] * len(found), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in held], pa.string()), pa.array([k for _, k in held], pa.int64()), pa.array(range(slot - len(held), slot), pa.int64())], names=["_s", "_block", "_slot"])

        for _, order in phases([-(-n // block_rows) for _, _, n in found], w):
            for i in order:
                held.append((i, next_block[i]))
                next_block[i] += 1
                slot += 1
                if len(held) == 8192:
                    yield batch()
                    held.clear()
        yield batch()

    return sizes.coalesce(1).mapInArrow(run, "_s string, _block long, _slot long")


#: Hash buckets that a window of the first or second level goes over.
GROUP_BUCKETS = 4096
PLACES = ("mix_block", "mix_slot", "mix_position")


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int | None = None, exponent: float = 0.7, default: float | None = None) -> DataFrame:
    """docs with ``mix_block`` (of the source), ``mix_slot`` and ``mix_position`` (slot, then row in the block; last blocks may be short); columns of these names that docs has give way. Without weights a source's is its rows to the power ``exponent``. Weights are exact, ``period`` rounds nothing."""
    keep = [c for c in docs.columns if c.lower() not in PLACES]
    s, o, w, b, i, k, g, c, block, before, held_slots, slot, inner, outer = own_names(docs.columns, 14)
    # a source's key is never null: joins and windows on it then share one partitioning, so rows are shuffled once
    source, ident = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    key_of = F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source.cast("string"), F.lit("")))
    sizes = stored(docs.groupBy(source.alias("s"), key_of.alias("key")).agg(F.count("*").alias("n")), "sources")
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-largest // BUCKET_ROWS))
    # extra columns only travel with their row; the number is found from source and id
    order = F.xxhash64(ident.cast("string"), F.lit(3))
    all_of = F.xxhash64(*[F.col(f"`{x}`") for x, t in docs.dtypes if "map<" not in t and "variant" not in t])
    rows = docs.select(*[F.col(f"`{x}`") for x in keep], key_of.alias(s), order.alias(o), all_of.alias(w))
    # order by unsigned hash: the bucket is its upper part
    rows = rows.withColumn(b, F.floor((F.col(o).cast("double") + 2.0**63) / 2.0**64 * n_buckets))
    per = rows.groupBy(s, b).agg(F.count("*").alias(c)).withColumn(g, F.floor(F.col(b) / GROUP_BUCKETS))
    # rows before a bucket: those of its group's earlier buckets and those of the earlier groups, so that no window goes over a source
    earlier = lambda n, part, by: F.coalesce(F.sum(n).over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = per.groupBy(s, g).agg(F.sum(c).alias(c)).select(s, g, earlier(c, [s], g).alias(outer))
    counted = per.select(s, b, g, c, earlier(c, [s, g], b).alias(inner)).join(groups, [s, g]).select(s, b, c, (F.col(inner) + F.col(outer)).alias(before))
    # a bucket's slots, in the order of its blocks, come to its rows with its first number
    block_of = lambda number: F.floor(number / block_rows).cast("long")
    held = counted.select(s, b, before, F.explode(F.sequence(block_of(F.col(before)), block_of(F.col(before) + F.col(c) - 1))).alias(block))
    # the planner takes the slots for as few as the sources, and would broadcast them
    laid = slots(sizes, weights, block_rows, exponent, default).toDF(s, block, slot)
    held = held.join(laid.hint("merge"), [s, block])
    held = held.groupBy(s, b).agg(F.min(before).alias(before), F.sort_array(F.collect_list(F.struct(block, slot))).alias(held_slots))
    within = F.row_number().over(Window.partitionBy(s, b).orderBy(o, ident, w)) - 1
    rows = rows.withColumn(i, within).join(held, [s, b]).withColumn(k, F.col(i) + F.col(before)).withColumn(block, block_of(F.col(k)))
    at = F.get(F.col(held_slots), (F.col(block) - block_of(F.col(before))).cast("int"))[slot]
    return rows.select(*[F.col(f"`{x}`") for x in keep], F.col(block).alias("mix_block"), at.alias("mix_slot"), (at * block_rows + F.col(k) % block_rows).cast("long").alias("mix_position"))


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)
