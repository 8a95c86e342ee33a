"""Benchmark decontamination by training suffix arrays.

The training documents are cut into shards (about ``shard_bytes`` of whole documents). A shard's words, named by their
number in the benchmark's vocabulary (0: not in it), form one sequence with a 0 between documents; no benchmark text
holds a 0, so suffixes that start with one are left out of the array without loss. Suffixes are sorted by prefix
doubling down to the longest item, then every suffix of every item is binary-searched in every shard for its longest
verbatim match and a place of it. The suffixes whose match holds their window have it searched as a range, for all its
places; a hit place tells the longest match that starts there.

The benchmark is a stated query set. It goes to the tasks in blocks of about ``block_words`` words, one at a time: the
driver and a task hold one block, and a larger benchmark takes more blocks, each one more pass over a shard.

Defined cases: null or wordless texts have no words, no hits; an item without words has no window; of repeated item ids
each row counts, the id is listed once; repeated document rows each get a row; null item ids are not listed but hit;
an empty benchmark hits nothing; other columns are not read; very long items and texts, also such that repeat a few
words throughout, take time near linear in their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, blocks, column_bytes, record_batch, text_parts

WINDOW = 10
SHARD_BYTES = 8_000_000
BLOCK_WORDS = 2_000_000


@dataclass
class Queries:
    """Suffixes of a block of items: words as numbers from 1; each distinct suffix start with a window has its length."""

    vocabulary: dict[bytes, int]
    seq: np.ndarray  # items' words with 0 between them and enough 0 at the end
    starts: np.ndarray  # of suffixes in seq
    item: np.ndarray  # number of the item of each suffix
    left: np.ndarray  # words from the start to the item's end
    size: np.ndarray  # words of the window that starts here, 0: none
    ids: list[str | None]
    depth: int  # words of the longest item
    window: int
    order: np.ndarray  # starts of the suffixes, sorted
    kind: np.ndarray  # number of each suffix's window among the distinct ones
    items: list[list[int]]  # items that hold each distinct window


def queries(items: list[tuple], window: int = WINDOW) -> Queries:
    words = [alnum_words((text or "").encode()) for _, text in items]
    vocabulary: dict[bytes, int] = {}
    for w in words:
        for x in w:
            vocabulary.setdefault(x, len(vocabulary) + 1)
    depth = max([1, *map(len, words)])
    seq, starts, item, left, size = [], [], [], [], []
    for k, w in enumerate(words):
        n, at, win = len(w), len(seq), min(window, len(w))
        seq += [vocabulary[x] for x in w] + [0]
        starts += range(at, at + n)
        item += [k] * n
        left += range(n, 0, -1)
        size += [win if n - i >= win else 0 for i in range(n)]
    arr = lambda x: np.array(x, dtype=np.int64)
    seq, starts, item, size = arr(seq + [0] * depth), arr(starts), arr(item), arr(size)
    kind, held = alike(seq, starts, item, size)
    return Queries(vocabulary, seq, starts, item, arr(left), size, [None if i is None else str(i) for i, _ in items], depth, window, suffix_array(seq, depth), kind, held)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of seq that don't begin with 0, sorted by their first ``depth`` words; ties by place."""
    bits = max(1, int(seq.max(initial=0)).bit_length())
    step = max(1, 62 // bits)
    n = len(seq)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([seq, np.zeros(step, np.int64)])
    for i in range(step):
        key = (key << bits) | padded[i : i + n]
    at = np.flatnonzero(seq)
    order = at[np.argsort(key[at], kind="stable")]
    if not len(order):
        return order
    new = np.empty(len(order), bool)
    new[0] = True
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.zeros(n + 1, np.int64)
    group = np.cumsum(new)
    rank[order] = group
    del key, padded
    while step < depth:
        # only suffixes that share their rank are sorted again, by the rank that stands ``step`` words on
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        sub = order[tied]
        ahead = rank[np.minimum(sub + step, n)]
        sub = sub[np.lexsort((ahead, group[tied]))]
        order[tied] = sub
        ahead = rank[np.minimum(sub + step, n)]
        head = np.ones(len(tied), bool)
        same = (group[tied][1:] == group[tied][:-1]) & (ahead[1:] == ahead[:-1])
        head[1:] = ~same
        new[tied] = head | new[tied]
        group = np.cumsum(new)
        rank[order] = group
        step *= 2
    return order


class Shared:
    """How many words two places of a shard and of a block of items share, exactly and in bounded time.

    Words are compared one by one; of those behind the first ``FREE`` of a match up to ``WORK`` for each word held. Long
    matches in texts that repeat themselves would take more; the rest then goes by names of runs of 1, 2, 4, ... words,
    which are equal where the runs are, so that a match takes as many steps as its length has bits."""

    FREE, WORK = 32, 32

    def __init__(self, seq: np.ndarray, other: np.ndarray, depth: int):
        self.text = np.concatenate([seq, other])
        self.other = len(seq)  # where the block's words start
        self.depth, self.work, self.names = depth, self.WORK * len(self.text), None

    def runs(self) -> list[np.ndarray]:
        if self.names is None:
            self.names = [self.text.astype(np.int32)]
            step = 1
            while 2 * step <= self.depth:
                now, ahead = self.names[-1], np.zeros(len(self.text), np.int64)
                ahead[: max(0, len(now) - step)] = now[step:]
                key = (now.astype(np.int64) << 32) | ahead
                self.names.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
                step *= 2
        return self.names

    def prefix(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words shared from places a and b on, ``most`` at most; so many words from b on are none of them 0."""
        got = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        k = 0
        while len(live) and (k < self.FREE or self.work > 0):
            self.work -= len(live) * (k >= self.FREE)
            k += 1
            live = live[self.text[a[live] + got[live]] == self.text[b[live] + got[live]]]
            got[live] += 1
            live = live[got[live] < most[live]]
        if len(live):
            for k, names in reversed(list(enumerate(self.runs()))):  # at most depth words, so each length of run comes once at most
                at = live[most[live] - got[live] >= 1 << k]
                at = at[names[a[at] + got[at]] == names[b[at] + got[at]]]
                got[at] += 1 << k
        return got


def bound(shared: Shared, order: np.ndarray, starts: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """For each query (``size`` words from its start): suffixes in order that are less (upper: or start with it)."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        at, qa, m = order[mid], starts[open_], size[open_]
        got = shared.prefix(at, qa, m)
        less = np.full(len(open_), upper)  # equal in all words
        differ = got < m
        less[differ] = shared.text[(at + got)[differ]] < shared.text[(qa + got)[differ]]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def longest(shared: Shared, order: np.ndarray, starts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix (``left`` words from its start): words of its longest match with the suffixes in order, and one place of it."""
    n = len(starts)
    best, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not len(order) or not n:
        return best, place
    at = bound(shared, order, starts, left, False)
    for near in (np.minimum(at, len(order) - 1), np.maximum(at - 1, 0)):  # the neighbours in the order share most
        got = shared.prefix(order[near], starts, left)
        better = got > best
        best[better], place[better] = got[better], order[near][better]
    return best, place


def named(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The shard's sequence, a 0 after each document, and the documents' starts in it with the end."""
    parts, starts = [], [0]
    get = vocabulary.get
    for t in texts:
        w = alnum_words(t)
        a = np.zeros(len(w) + 1, np.int64)
        a[:-1] = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        parts.append(a)
        starts.append(starts[-1] + len(a))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(starts)


def windows(shared: Shared, order: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(place in seq, number of a query suffix) for each occurrence of each distinct window. A place holds as many as there are window lengths at most."""
    starts = shared.other + q.starts
    size, _ = longest(shared, order, starts, q.left)
    has = np.flatnonzero((q.size > 0) & (size >= q.size))
    if not len(has):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = bound(shared, order, starts[has], q.size[has], False)
    hi = bound(shared, order, starts[has], q.size[has], True)
    # equal windows have equal ranges; the first stands for all
    _, first = np.unique(np.stack([lo, hi, q.size[has]]), axis=1, return_index=True)
    n = hi[first] - lo[first]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(lo[first], n) + within], np.repeat(has[first], n)


def extents(shared: Shared, seq: np.ndarray, place: np.ndarray, suffix: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(places, words): the distinct hit places, and of each the longest match with an item that holds a window there."""
    at, back = np.unique(place, return_inverse=True)
    zero = np.flatnonzero(seq == 0)
    left = np.minimum(zero[np.searchsorted(zero, at)] - at, q.depth)
    size, _ = longest(shared, shared.other + q.order, at, left)
    window = np.zeros(len(at), np.int64)
    np.maximum.at(window, back, q.size[suffix])
    # shorter matches hold no window but that of a short item
    return at, np.where(size >= q.window, size, window)


def alike(seq: np.ndarray, starts: np.ndarray, item: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Number of each suffix's window among the distinct ones, and the items that hold each."""
    seen: dict[bytes, int] = {}
    kind, items = np.full(len(starts), -1, np.int64), []
    for i in np.flatnonzero(size):
        k = seen.setdefault(seq[starts[i] : starts[i] + size[i]].tobytes(), len(seen))
        if k == len(items):
            items.append([])
        kind[i] = k
        if not items[k] or items[k][-1] != item[i]:
            items[k].append(int(item[i]))
    return kind, items


@dataclass
class Hits:
    """Of a document: its words, runs of hit words [start, end), sorted ids of the items with windows in it, words of the longest match and the first word where one starts."""

    words: int
    runs: list[tuple[int, int]]
    items: list[str]
    longest: int
    at: int | None


def shard_hits(texts: list[bytes], q: Queries) -> list[Hits]:
    seq, starts = named(texts, q.vocabulary)
    order = suffix_array(seq, q.depth)
    shared = Shared(seq, q.seq, q.depth)
    place, suffix = windows(shared, order, q)
    edge = np.zeros(len(seq) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + q.size[suffix], -1)
    hit = np.cumsum(edge[:-1]) > 0
    of_place = lambda p: np.searchsorted(starts, p, "right") - 1
    pairs = np.unique(np.stack([of_place(place), q.kind[suffix]]), axis=1) if len(place) else np.zeros((2, 0), np.int64)
    of: dict[int, set] = {}
    for d, c in pairs.T.tolist():
        of.setdefault(d, set()).update(q.items[c])
    best: dict[int, tuple[int, int]] = {}
    if len(place):
        at, size = extents(shared, seq, place, suffix, q)
        doc = of_place(at)
        sort = np.lexsort((at, -size, doc))
        first = sort[np.concatenate([[True], doc[sort][1:] != doc[sort][:-1]])]
        best = {int(doc[i]): (int(size[i]), int(at[i] - starts[doc[i]])) for i in first}
    out = []
    for d in range(len(texts)):
        a, b = starts[d], starts[d + 1] - 1
        runs = []
        if d in of:
            flips = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
            runs = list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))
        out.append(Hits(int(b - a), runs, sorted({q.ids[i] for i in of.get(d, ()) if q.ids[i] is not None}), *best.get(d, (0, None))))
    return out


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def query_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Queries]:
    """The stated query set in blocks. It streams to the driver item by item; a block is closed at ``block_words`` words."""
    now, n, none = [], 0, True
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        now.append((row[0], row[1]))
        n += len(row[1] or "") // 4 + 1
        if n >= block_words:
            yield queries(now, window)
            now, n, none = [], 0, False
    if now or none:
        yield queries(now, window)


def sent_blocks(benchmark: DataFrame, window: int, block_words: int) -> list:
    """A broadcast for each block; the driver keeps none of them."""
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(q) for q in query_blocks(benchmark, window, block_words)]


def each_block(sent: list) -> Iterator[Queries]:
    """The blocks one after the other; of several, a task holds one at a time and reads it again from its executor's disk."""
    for b in sent:
        yield b.value
        if len(sent) > 1:
            b.__dict__.pop("_value", None)


def joined(per: tuple[Hits, ...]) -> Hits:
    """A document's hits in all blocks."""
    if len(per) == 1:
        return per[0]
    size, at = max(((h.longest, -h.at) for h in per if h.longest), default=(0, None))
    return Hits(per[0].words, merged([r for h in per for r in h.runs]), sorted({i for h in per for i in h.items}), size, None if at is None else -at)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, ``hits`` (runs of hit words), ``items`` (ids with occurring windows), ``longest`` (words of its longest verbatim match with an item that holds a window, else 0) and ``longest_at`` (the first word where one starts, else null). No shuffle: a shard is a part of a task's input."""
    sent = sent_blocks(benchmark, window, block_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = column_bytes(batch)
            for i, j in blocks(texts, shard_bytes):
                hits = [joined(x) for x in zip(*(shard_hits(texts[i:j], q) for q in each_block(sent)), strict=True)]
                own = batch.column(batch.schema.get_field_index("doc_id")).slice(i, j - i)
                schema = pa.schema([("doc_id", own.type), ("n_words", pa.int64()), ("hits", run_type), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())])
                yield record_batch(schema, [own, [h.words for h in hits], [[{"start": a, "end": b} for a, b in h.runs] for h in hits], [h.items for h in hits], [h.longest for h in hits], [h.at for h in hits]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, hits array<struct<start:bigint,end:bigint>>, items array<string>, longest long, longest_at long")


def longest_matches(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Of each suffix of each item the longest verbatim match in all documents: item (its number in order of item_id, text), item_id, item_word, length, doc_id, doc_word. Each shard gives its best; one aggregation by suffix keeps the best of all."""
    sent = sent_blocks(benchmark, WINDOW, block_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = column_bytes(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for i, j in blocks(texts, shard_bytes):
                base = 0
                for q in each_block(sent):
                    seq, starts = named(texts[i:j], q.vocabulary)
                    shared = Shared(seq, q.seq, q.depth)
                    size, place = longest(shared, suffix_array(seq, q.depth), shared.other + q.starts, q.left)
                    got = np.flatnonzero(size)
                    doc = np.searchsorted(starts, place[got], "right") - 1
                    first = np.searchsorted(q.item, np.arange(len(q.ids)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(q.item[got] + base), pa.array([q.ids[k] for k in q.item[got]], pa.string()), pa.array(got - first[q.item[got]]),
                            pa.array(size[got]), ids.take(pa.array(doc + i)), pa.array(place[got] - starts[doc]),
                        ],
                        names=["item", "item_id", "item_word", "length", "doc_id", "doc_word"],
                    )
                    base += len(q.ids)

    found = docs.select("doc_id", "text").mapInArrow(run, f"item long, item_id string, item_word long, length long, doc_id {kind}, doc_word long")
    best = found.groupBy("item", "item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("n"), "doc_id", "doc_word")).alias("b"))
    return best.select("item", "item_id", "item_word", (-F.col("b.n")).alias("length"), "b.doc_id", "b.doc_word")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window, with their columns. A null or repeated doc_id is no hindrance: each row is judged by its own text."""
    sent = sent_blocks(benchmark, options.get("window", WINDOW), options.get("block_words", BLOCK_WORDS))

    def run(batches):
        for batch in batches:
            for part, texts in text_parts(batch, options.get("shard_bytes", SHARD_BYTES)):
                keep = np.ones(len(texts), bool)
                for q in each_block(sent):
                    keep &= [not h.runs for h in shard_hits(texts, q)]
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return contamination(docs, bench).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
        "longest_at",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT k, i AS j, item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT k, item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
bw AS (SELECT DISTINCT item_id, n, g FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)),
m AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
runs AS (SELECT r, min(i) AS a, count(*) + n - 1 AS size
         FROM (SELECT r, k, n, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY r, k, i - j ORDER BY i) AS island FROM dw JOIN bp USING (n, g))
         GROUP BY r, k, n, diagonal, island),
lo AS (SELECT r, max(size) AS longest_match, arg_max(a, struct_pack(s := size, p := -a)) - 1 AS longest_at FROM runs GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest_match, 0)::BIGINT AS longest_match, longest_at
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN lo USING (r)
"""
