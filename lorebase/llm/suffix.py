"""Exact substring removal by suffix arrays that are built in groups, without recursive renaming.

1. Every ``length``-byte window of a text is owned by its smallest 64-bit hash of ``gram`` bytes (the leftmost of equal
   ones), which is the same for equal windows. The windows one anchor owns are a run; with the bytes they cover they
   are a piece. Only a hash of each piece is shuffled.
2. One aggregation by anchor hash drops anchors that stand alone: their windows repeat nowhere.
3. Of every other anchor each distinct piece is cut from the text that holds it first and, if it stands in several
   places, from the one that holds it last too, and sent to its anchor's bucket. A bucket's pieces are parsed into
   phrases at places that four bytes tell, named in the order of their bytes, and their suffixes are sorted by
   :func:`group_suffix_array`. Windows are equal if the bytes up to the first phrase start and the suffix there are.
   An anchor with more than ``crowd`` pieces (a line that stands in very many contexts) is salted over several buckets;
   what its windows share across buckets is told by their hashes, once a bucket each.
4. The places that repeat come together by document and are cut from the text.

Everything is judged on the input. Every removal is found in a suffix array, but for what a crowded anchor's buckets
share with each other; hashes choose what is compared, and a piece's third and further copies follow from the first two
by 128 bits of anchor and piece.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; each row is a text of its own, also
if its doc_id repeats or is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, mix64, stored

LENGTH = 400
GRAM = 128
#: Different pieces of one anchor that are sorted in one bucket; at most 2 * length bytes each.
CROWD = 2000
#: Bytes of pieces that a bucket holds on average.
BUCKET_BYTES = 1_000_000
#: Window starts worked on at once, so that long texts need no more memory.
STRIDE = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- suffix arrays ---------------------------------------------------------------------------------------------


def group_suffix_array(s: list[int]) -> list[int]:
    """The suffix array of s, whose last symbol must be its one smallest, in time proportional to its length (for a bounded alphabet).

    Suffixes start in groups by their first symbol. Groups are taken in descending order; each suffix of a group finds
    the last one before it that lies in a lower group (its previous-smaller pointer, found by jumping along pointers
    that are known), and the suffixes pointed at move out of their groups, just above what is left of them: those
    pointed at more often higher. In the end a group holds the suffixes with one Lyndon prefix. Then, in ascending
    order, each sorted suffix gives the one before it, and those on its chain of pointers, the next place in their groups.
    """
    n = len(s)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=s.__getitem__)  # stable: ascending places in a group
    where = [0] * n
    group = [0] * n  # start of the suffix's group in order
    size = [0] * n  # by start
    start = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            start = k
        where[i] = k
        group[i] = start
        size[start] += 1
    before = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0 and size[group[p]] > 1:
                g = group[p]
                last = g + size[g] - 1
                q, at = order[last], where[p]
                order[at], where[q] = q, at
                order[last], where[p] = p, last
                size[g] -= 1
                group[p] = last
                size[last] = 1
        else:
            counts: dict[int, int] = {}
            for i in sorted(order[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
            by: dict[int, dict[int, list[int]]] = {}
            for p, c in counts.items():
                by.setdefault(c, {}).setdefault(group[p], []).append(p)
            for c in sorted(by, reverse=True):
                for g, members in by[c].items():
                    if len(members) == size[g]:
                        continue
                    new = g + size[g] - len(members)
                    last = g + size[g] - 1
                    for p in members:
                        q, at = order[last], where[p]
                        order[at], where[q] = q, at
                        order[last], where[p] = p, last
                        group[p] = new
                        last -= 1
                    size[g] -= len(members)
                    size[new] = len(members)
        end = start
    placed = bytearray(n)
    free = group  # group[i] is the group's start; the next free place is kept by start
    nxt = list(range(n))
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = free[j]
            out[nxt[g]] = j
            nxt[g] += 1
            placed[j] = 1
            j = before[j]
    return out


# --- anchors ---------------------------------------------------------------------------------------------------


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, grown as texts need."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, m, 1 << 64))])
        return self.up[:n], self.down[:n]


def anchors(text: bytes, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window start, windows, anchor's place behind it, piece hash) of each run of windows with one anchor."""
    n = len(text) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    byte = np.frombuffer(text, np.uint8)
    span = length - gram + 1  # grams in a window
    out = []
    for base in range(0, n, STRIDE):
        count = min(STRIDE, n - base)
        part = byte[base : base + count + length - 1].astype(np.uint64) + np.uint64(1)
        up, down = powers.of(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        grams = mix64((total[gram:] - total[:-gram]) * down[: len(part) - gram + 1])
        # the hash's upper bits, then the place: the smallest is the leftmost of the smallest
        low = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, best = 1, low
        while width * 2 <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < span:
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        at = (best & np.uint64((1 << 20) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        size = np.diff(np.append(head, count))
        stop = head + size - 1 + length
        piece = mix64((total[stop] - total[head]) * down[head] + mix64(size.astype(np.uint64)))
        key = grams[at[head]]
        out.append((key.view(np.int64), head + base, size, at[head] - head, piece.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- pieces of one bucket --------------------------------------------------------------------------------------


def repeats(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows (of ``length`` bytes, by start) also start anywhere else in the pieces."""
    lens = np.array([len(p) for p in pieces])
    pad = b"\0" * 8
    data = b"".join(pieces) + pad
    byte = np.frombuffer(data, np.uint8)
    total = len(data) - 8
    offset = np.concatenate([[0], np.cumsum(lens)])
    owner_end = np.repeat(offset[1:], lens)  # of each byte
    # a phrase starts where four bytes that lie in the piece hash to 0 modulo 16
    four = byte[: total + 4].astype(np.uint32)
    word = four[:total] | (four[1 : total + 1] << np.uint32(8)) | (four[2 : total + 2] << np.uint32(16)) | (four[3 : total + 3] << np.uint32(24))
    is_start = (((word * np.uint32(2654435761)) >> np.uint32(28)) == 0) & (np.arange(total) + 4 <= owner_end)
    starts = np.flatnonzero(is_start)
    flags = np.zeros(total, bool)
    if len(starts):
        ends = np.append(starts[1:], total)
        stop = owner_end[starts]
        last = ends >= stop  # the piece's last phrase, up to its end
        ends = np.minimum(ends, stop)
        # a phrase with the next one's four bytes: no such name is a prefix of another, so their order is that of the bytes
        names = [data[a:b] for a, b in zip(starts.tolist(), np.where(last, ends, ends + 4).tolist(), strict=True)]
        rank = {x: k for k, x in enumerate(sorted(set(names)))}
        most = int(last.sum())
        # each piece ends in a symbol of its own below all phrases; the one at the very end is the smallest
        seq, place, ended = [], [], most
        for x, a, z in zip(names, starts.tolist(), last.tolist(), strict=True):
            seq.append(rank[x] + most + 1)
            place.append(a)
            if z:
                ended -= 1
                seq.append(ended)
                place.append(-1)
        order = np.array(place)[np.array(group_suffix_array(seq))]
        order = order[order >= 0]
        lcp = common(data, order, owner_end, length)
        flags |= by_tail(byte, starts, owner_end, order, lcp, length, offset, total)
    flags |= bare(data, is_start, owner_end, length)
    return [flags[a : max(a, b - length + 1)] for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)]


def common(data: bytes, order: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, that each suffix shares with the one before it in order; ends of pieces end a suffix."""
    byte = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(data) - 8
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):
        eight[:n] |= byte[k : n + k] << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    most = np.minimum(np.minimum(end[a] - a, end[b] - b), length)
    got = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = eight[np.minimum(a[live] + got[live], n)] ^ eight[np.minimum(b[live] + got[live], n)]
        same = np.full(len(live), 8)
        bad = np.flatnonzero(x)
        low = x[bad] & (~x[bad] + np.uint64(1))  # its lowest set bit
        same[bad] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        got[live] += same
        live = live[(same == 8) & (got[live] < most[live])]
    return np.concatenate([[0], np.minimum(got, most)])


def by_tail(byte: np.ndarray, starts: np.ndarray, end: np.ndarray, order: np.ndarray, lcp: np.ndarray, length: int, offset: np.ndarray, total: int) -> np.ndarray:
    """Windows with a phrase start at ``tail`` bytes after their own start: equal if the tails are and the suffixes share the rest."""
    flags = np.zeros(total, bool)
    piece_start = offset[np.searchsorted(offset, order, "right") - 1]
    at = np.searchsorted(starts, order)
    ahead = np.where(at > 0, starts[np.maximum(at - 1, 0)], -1)
    room = np.minimum(order - np.maximum(piece_start, ahead + 1), length - 4)  # bytes before it with no phrase start among them
    reach = end[order] - order
    live = np.arange(len(order))  # suffixes with room for the tail, in order, and a number for each different tail
    name = np.zeros(len(order), np.int64)
    for tail in range(int(room.max(initial=-1)) + 1):
        if tail:
            keep = room[live] >= tail
            live = live[keep]
            name = np.unique(name[keep] << 8 | byte[order[live] - tail], return_inverse=True)[1]
        need = length - tail
        fit = reach[live] >= need
        which = live[fit]
        if not len(which):
            continue
        group = np.cumsum(lcp < need)[which]
        key = name[fit] << 32 | group
        sort = np.argsort(key)
        same = key[sort[1:]] == key[sort[:-1]]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        flags[order[which[sort[twice]]] - tail] = True
    return flags


def bare(data: bytes, is_start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Windows without a phrase start in all but their last three bytes (as of one byte repeated), by the bytes themselves."""
    total = len(is_start)
    flags = np.zeros(total, bool)
    if total < length:
        return flags
    seen = np.concatenate([[0], np.cumsum(is_start)])
    at = np.arange(total - length + 1)
    at = at[(seen[at + length - 3] == seen[at]) & (end[at] - at >= length)]
    first: dict[bytes, int] = {}
    for p in at.tolist():
        q = first.setdefault(data[p : p + length], p)
        if q != p:
            flags[p] = flags[q] = True
    return flags


# --- Spark -----------------------------------------------------------------------------------------------------


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        powers = Powers()
        for b in batches:
            rid = b.column(b.schema.get_field_index("rid")).to_numpy(zero_copy_only=False)
            cols, size = [[] for _ in range(6)], 0
            for r, t in zip(rid, column_bytes(b), strict=True):
                found = anchors(t, length, gram, powers)
                size += len(found[0])
                for c, x in zip(cols, (np.full(len(found[0]), r), found[0], found[4], found[1], found[2]), strict=False):
                    c.append(x)
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols[:5]], names=["rid", "key", "piece", "first", "n"])
                    cols, size = [[] for _ in range(6)], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols[:5]], names=["rid", "key", "piece", "first", "n"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, key long, piece long, first long, n long")


def cut_pieces(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(key, salt, piece, copy, body): the bytes of each wanted copy of a piece, from the text that was named as its owner."""

    def run(batches):
        for b in batches:
            key, salt, piece, copy, body, size = [], [], [], [], [], 0
            for t, cuts in zip(column_bytes(b), b.column(b.schema.get_field_index("cuts")).to_pylist(), strict=True):
                for c in cuts:
                    key.append(c["key"])
                    salt.append(c["salt"])
                    piece.append(c["piece"])
                    copy.append(c["copy"])
                    body.append(t[c["first"] : c["first"] + c["n"] - 1 + length])
                    size += len(body[-1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(salt, pa.int32()), pa.array(piece, pa.int64()), pa.array(copy, pa.int32()), pa.array(body, pa.binary())], names=["key", "salt", "piece", "copy", "body"])
                    key, salt, piece, copy, body, size = [], [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(salt, pa.int32()), pa.array(piece, pa.int64()), pa.array(copy, pa.int32()), pa.array(body, pa.binary())], names=["key", "salt", "piece", "copy", "body"])

    cuts = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "salt", "piece", "copy", "first", "n")).alias("cuts"))
    return docs.select("rid", "text").join(cuts, "rid").select("text", "cuts").mapInArrow(run, "key long, salt int, piece long, copy int, body binary")


def window_hashes(body: bytes, length: int, powers: Powers) -> np.ndarray:
    part = np.frombuffer(body, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = powers.of(len(part) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[:-1])])
    return mix64((total[length:] - total[:-length]) * down[: len(part) - length + 1]).view(np.int64)


def compare_pieces(pieces: DataFrame, length: int, parts: int) -> DataFrame:
    """(key, piece, runs, windows): windows of a piece's first copy that also start in another piece or copy, as runs
    [start, end). Pieces of a key and salt lie together in a partition; a batch of whole buckets is sorted at once. With
    a salt of 0 or more, windows has the others, (at, h), and once a bucket (-1, h) for those in runs."""

    def run(batches):
        held: list[tuple[int, int, int, int, bytes]] = []
        powers = Powers()

        def flush(rows):
            keys, ids, runs, windows, told, bucket = [], [], [], [], set(), None
            if rows:
                for (k, salt, p, copy, body), hit in zip(rows, repeats([r[4] for r in rows], length), strict=True):
                    if copy:
                        continue
                    flips = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    if salt < 0 and not len(flips):
                        continue
                    keys.append(k)
                    ids.append(p)
                    runs.append([{"start": a, "end": z} for a, z in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True)])
                    windows.append(None)
                    if salt >= 0:
                        if bucket != (k, salt):
                            bucket, told = (k, salt), set()
                        h = window_hashes(body, length, powers)
                        new = set(h[hit].tolist()) - told
                        told |= new
                        alone = np.flatnonzero(~hit)
                        windows[-1] = [{"at": a, "h": x} for a, x in zip(alone.tolist(), h[alone].tolist(), strict=True)] + [{"at": -1, "h": x} for x in new]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            window = pa.list_(pa.struct([("at", pa.int64()), ("h", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(runs, span), pa.array(windows, window)], names=["key", "piece", "runs", "windows"])

        size = 0
        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "salt", "piece", "copy", "body")), strict=True):
                if size > BUCKET_BYTES and held[-1][:2] != row[:2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield flush(held)

    dealt = pieces.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(run, "key long, piece long, runs array<struct<start:bigint,end:bigint>>, windows array<struct<at:bigint,h:bigint>>")


def across_buckets(windows: DataFrame) -> DataFrame:
    """(key, piece, start, end): of windows (key, piece, at, h), each once a bucket, those that several buckets hold; rows whose at is -1 only tell that a bucket holds h."""
    twice = stored(windows.groupBy("key", "h").agg(F.count("*").alias("m")).where("m > 1").select("key", "h"), "twice")
    island = F.col("at") - F.row_number().over(Window.partitionBy("key", "piece").orderBy("at"))  # a piece has few windows
    hits = windows.where("at >= 0").join(twice, ["key", "h"]).select("key", "piece", "at", island.alias("island"))
    return hits.groupBy("key", "piece", "island").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end")).drop("island")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(rid, start, end): runs of window starts whose windows also start elsewhere, for docs of (rid, text)."""
    spark = docs.sparkSession
    rows = stored(anchor_rows(docs, length, gram), "anchors")
    # written, so that both sides of the join below have exchanges of their own, which skew handling can split at a hot key
    keys = stored(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "keys")
    hot = stored(rows.join(keys, "key"), "repeated")
    place = F.struct("rid", "first", "n")
    distinct = hot.groupBy("key", "piece").agg(F.count("*").alias("m"), F.min(place).alias("a"), F.max(place).alias("z"))
    copies = distinct.select("key", "piece", F.posexplode(F.when(F.col("m") > 1, F.array("a", "z")).otherwise(F.array("a"))).alias("copy", "o"))
    copies = stored(copies.select("key", "piece", "copy", "o.rid", "o.first", "o.n"), "pieces")
    crowded = copies.where("copy = 0").groupBy("key").count().where(F.col("count") > crowd)
    crowded = stored(crowded.select("key", F.ceil(F.col("count") / crowd).cast("int").alias("salts")), "crowded")
    copies = copies.join(crowded, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("piece"), "salts"), F.lit(-1)))
    total = copies.agg(F.sum(F.col("n") + length)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * BUCKET_BYTES)))
    found = stored(compare_pieces(cut_pieces(copies, docs, length), length, parts), "found")
    of_piece = found.select("key", "piece", F.explode("runs").alias("r")).select("key", "piece", "r.start", "r.end")
    if not crowded.isEmpty():
        windows = found.where("windows is not null").select("key", "piece", F.explode("windows").alias("w")).select("key", "piece", "w.at", "w.h")
        of_piece = stored(of_piece.union(across_buckets(windows)), "runs")
    return hot.join(of_piece, ["key", "piece"]).select("rid", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text): a number for each row that stays the same in every reading, whatever the ids. Ids that are unique and not null serve themselves."""
    ids = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if ids[0] == ids[1] == ids[2] and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        return docs.select(F.col("doc_id").cast("long").alias("rid"), "doc_id", "text")
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "numbered")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, text, and ``runs`` of repeated window starts [start, end), sorted."""
    rows = numbered(docs.select("doc_id", "text"))
    runs = repeated_runs(rows.select("rid", "text"), length, gram, crowd)
    per = runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    return rows.join(per, "rid", "left").select("doc_id", "text", F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("runs"))


def covered(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Runs of window starts, sorted, to maximal runs of covered bytes."""
    out: list[list[int]] = []
    for r in runs:
        a, b = r["start"], r["end"] - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    return b"".join([*out, text[last:]])


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row a document: doc_id, ``kept`` (the remaining bytes, which may start or end inside a character), n_bytes, and ``spans`` of removed bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            texts = column_bytes(b)
            spans = [covered(r, length) for r in b.column(b.schema.get_field_index("runs")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(b.schema.get_field_index("doc_id")), pa.array([without(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], span),
                ],
                names=["doc_id", "kept", "n_bytes", "spans"],
            )

    return removals(docs, length, gram, crowd).mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, spans array<struct<start:bigint,end:bigint>>")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by a table of every window: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        runs = [{"start": i, "end": i + 1} for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        spans = covered(runs, length)
        out.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(t, spans)).hexdigest()))
    return out
