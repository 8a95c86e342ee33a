"""Near-duplicate documents by a chosen-path set similarity join.

Each document is the set of its word shingles; equal sets are one node of the link graph from the start, so copies cost
a row each and no more. A set's 64 minwise values are its tokens. In each of several independent trees a node picks a
minwise token (and, with the chance that keeps the expected number of paths at 1 over the threshold, a second), which
branches its documents by that token's value. A node of at most ``small`` documents is compared exhaustively, a larger
one branches again, as long as that parts it. Trees are repeated to the recall wanted.

Documents compare by their tokens first, far below the threshold; what that joins, over all trees, is a family. Within
families links are confirmed on the full sets of 64-bit shingle hashes, so a text's set is sent once, not once a tree.

A node or family too large for one task is compared in chunks that all hold the same pivots; what then lies outside its
largest component is compared with every chunk; nodes of all trees take part, those of one family as one. So a family of
copies costs about one comparison a member, nothing is capped, and no task holds more than two chunks. Only links
between components are kept, at most one less than a group has members.

Defined cases: a null or wordless text is empty and linked with nothing; fewer words than a shingle make one shingle;
rows that share a doc_id are one document; a row with a null doc_id is linked with nothing, its component_id is null
and it is kept; ids may be of any type that sorts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, mix64, space_words, stored, text_parts

TOKENS = 64
SMALL = 256
LEVELS = 6
CHUNK = 1_000
#: Links that one task may join, 16 bytes each; more are joined by stars.
ONE_TASK_LINKS = 2_000_000
#: A pair at the threshold meets at one level of a tree with a chance near it; all trees miss it once in many millions.
TREES = 18
#: The low bits of a node's number are its tree's.
TREE_BITS = 31
#: Broadcast of wanted ids: at most so many rows (8 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000

_MULTIPLIERS = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.all(words)
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out + h[i : i + len(out)])
    return np.unique(out)


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of TOKENS hash functions, 32 bits each."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        best = np.minimum(best, (s[i : i + 4096, None] * _MULTIPLIERS).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def keep_tree(node: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A child's number: mixed, but for the low bits, which number the tree."""
    return (mix64(value) & ~np.uint64(TREE_BITS)) | (node & np.uint64(TREE_BITS))


def choose(node: np.ndarray, sig: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child): the paths that leave each row's node, by the values of the tokens that the node picks."""
    rows = np.arange(len(node))

    def step(salt: int, rows: np.ndarray) -> np.ndarray:
        p = node[rows]
        at = mix64(p + np.uint64(salt)) % np.uint64(TOKENS)
        value = sig[rows, at.astype(np.int64)].astype(np.uint64)
        return keep_tree(p, p ^ mix64(value + (at << np.uint64(32)) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))))

    more = rows[(mix64(node + np.uint64(97)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < 1 / similarity - 1]
    return np.concatenate([rows, more]), np.concatenate([step(1, rows), step(2, more)])


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set as two longs, and its minwise tokens, whole and the low byte of each."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hashes = WordHash()
        for b in batches:
            size, hi, lo, sig, low = [], [], [], [], []
            for _, texts in text_parts(b, 4_000_000):
                for t in texts:
                    s = shingle_set(t, n, hashes)
                    key = xxhash.xxh128_intdigest(s.tobytes())
                    size.append(len(s))
                    hi.append((key >> 64) - (1 << 63))
                    lo.append((key & ((1 << 64) - 1)) - (1 << 63))
                    tokens = minwise(s) if len(s) else None
                    sig.append(None if tokens is None else tokens.tobytes())
                    low.append(None if tokens is None else tokens.astype(np.uint8).tobytes())
            ids = b.column(b.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "hi", "lo", "sig", "low"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, hi long, lo long, sig binary, low binary")


def branch(rows: DataFrame, similarity: float, trees: range | None = None) -> DataFrame:
    """(node, rep, label) of the next level: from (node, rep, label, sig), or from (rep, label, sig) at the roots of ``trees``."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(b.schema.get_field_index("sig")).to_pylist()), np.uint32).reshape(-1, TOKENS)
            rep, label = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("rep", "label"))
            if trees is None:
                starts = [b.column(b.schema.get_field_index("node")).to_numpy(zero_copy_only=False).view(np.uint64)]
            else:
                starts = [keep_tree(np.full(len(rep), t, np.uint64), np.full(len(rep), t + 1, np.uint64)) for t in trees]
            for p in starts:
                row, child = choose(p, sig, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[row]), pa.array(label[row])], names=["node", "rep", "label"])

    return rows.mapInArrow(run, "node long, rep long, label long")


def joins(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def resolve(rep: np.ndarray, first: np.ndarray, label: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int, only_first: bool) -> list[tuple[int, int]]:
    """Links that join the components of one group: each document against all that are not yet in its component. ``first`` ones go first; with only_first the others are not compared among themselves."""
    m = len(rep)
    order = np.argsort(~first, kind="stable")
    label = label.copy()
    size = np.array([len(s) for s in sets])
    done = np.zeros(m, bool)
    found = []
    # five standard deviations of the estimate below the threshold
    p = percent / 100
    least = (p - 5 * (p * (1 - p) / TOKENS) ** 0.5) * TOKENS if m > 4 else 0
    for i in order:
        if only_first and not first[i]:
            break
        done[i] = True
        rest = np.flatnonzero(~done & (label != label[i]))
        if not len(rest):
            continue
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        if least > 0 and len(rest):
            rest = rest[(sig[rest] == sig[i]).sum(axis=1) >= least]
        for j in rest:
            if label[j] != label[i] and joins(sets[i], sets[j], percent):
                found.append((int(rep[i]), int(rep[j])))
                label[label == label[j]] = label[i]
    return found


def components(links: DataFrame, spark: SparkSession) -> DataFrame | None:
    """(rep, label): the smallest document of each linked document's component; None without links.

    Up to ONE_TASK_LINKS links, counted first, one task joins them; more go through large and small stars in turn until
    nothing moves.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v"), "links")
    n = edges.count()
    if not n:
        return None
    if n <= ONE_TASK_LINKS:
        return stored(edges.coalesce(1).mapInArrow(joined, "rep long, label long"), "components")
    return stars(edges)


def joined(batches):
    """Union-find over (v, u) in one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for b in batches:
        for v, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v, u = find(v), find(u)
            if v != u:
                parent[max(u, v)] = min(u, v)
    reps = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array([find(x) for x in reps], pa.int64())], names=["rep", "label"])


def stars(edges: DataFrame) -> DataFrame:
    """(rep, label) from edges (v, u), v > u, of any number."""
    edges = edges.distinct()
    state = None
    while True:
        both = edges.union(edges.select("u", "v"))  # (v, u): v's neighbour u
        low = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # large star: larger neighbours of v go to v's smallest
        edges = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        # small star: v's smaller neighbours, and v, go to the smallest of them
        low = edges.groupBy("v").agg(F.min("u").alias("m"))
        edges = edges.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        edges = stored(edges, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if now == state:
            return edges.select(F.col("v").alias("rep"), F.col("u").alias("label"))
        state = now


def tree_nodes(reps: DataFrame, trees: range, similarity: float, small: int, levels: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes to compare, as (node, rep, label): those of 2 to ``small`` documents, and those that stay larger, with their size ``n``. Nodes whose documents are all in one component are left out. Large nodes branch on while that parts them: a family of copies keeps together, and is left to :func:`chunked`."""
    rows = branch(reps.select("rep", "label", "sig"), similarity, trees)
    found, large, before = None, None, None
    for level in range(1, levels + 1):
        per = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"))
        per = stored(per.where("n > 1 and l0 <> l1").select("node", "n"), "nodes")
        part = rows.join(per.where(F.col("n") <= small).select("node"), "node")
        found = part if found is None else found.union(part)
        n = per.where(F.col("n") > small).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not n:
            return found, None
        large = stored(rows.join(per.where(F.col("n") > small), "node"), "large")
        if level == levels or (before is not None and n > before / 2):
            return found, large
        before = n
        rows = branch(large.join(reps.select("rep", "sig"), "rep").select("node", "rep", "label", "sig"), similarity)
    return found, large


_GROUP = ("gid", "only_first", "first", "rep", "label")


def small_groups(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("gid"), F.lit(False).alias("only_first"), F.lit(False).alias("first"), "rep", "label")


def of_nodes(rows: DataFrame, what: str) -> DataFrame:
    """A table of one row a node, written, and broadcast up to BROADCAST_ROWS rows: a large node's documents then join it where they lie, not all in one task."""
    rows = stored(rows, what)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def chunked(large: DataFrame, parted: bool, chunk: int) -> DataFrame:
    """Groups from nodes (node, rep, label, and their size ``n``, if it is known) of any size. Not parted (each document is its own component): chunks with the node's four pivots in each. Parted: what lies outside the node's largest component, in blocks, against every chunk."""
    n = large.groupBy("node").agg(F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64("rep", F.lit(10 + i)), "rep", "label")).alias(f"p{i}") for i in range(4)])
    n = of_nodes(n.withColumn("chunks", F.ceil(F.col("n") / chunk)), "sizes")
    known = "n" in large.columns
    rows = large.withColumn("chunks", F.ceil(F.col("n") / chunk)).drop("n") if known else large.join(n.select("node", "chunks"), "node")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")))
    every = lambda col: F.explode(F.sequence(F.lit(0).cast("long"), F.col(col) - 1))
    zero = F.lit(0).cast("long")
    if not parted:
        plain = rows.select("node", "chunk", zero.alias("block"), "rep", "label", F.lit(False).alias("first"))
        picked = n.select("node", "chunks", F.explode(F.array_distinct(F.array(*[F.struct(f"p{i}.rep", f"p{i}.label") for i in range(4)]))).alias("p"))
        picked = picked.select("node", every("chunks").alias("chunk"), zero.alias("block"), "p.rep", "p.label", F.lit(True).alias("first"))
    else:
        main = rows.groupBy("node", "label").agg(F.count("*").alias("k")).groupBy("node").agg(F.max_by("label", F.struct("k", -F.col("label"))).alias("main"))
        out = rows.join(of_nodes(main, "main"), "node").where("label <> main")
        many = of_nodes(out.groupBy("node").agg(F.ceil(F.count("*") / chunk).alias("blocks")), "blocks")
        out = out.join(many, "node").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(6)), F.col("blocks")))
        picked = out.select("node", every("chunks").alias("chunk"), "block", "rep", "label", F.lit(True).alias("first"))
        plain = rows.join(many, "node").select("node", "chunk", every("blocks").alias("block"), "rep", "label", F.lit(False).alias("first"))
    # a document that is first and also lies in the chunk is there once
    both = plain.union(picked).groupBy("node", "chunk", "block", "rep").agg(F.max("first").alias("first"), F.min("label").alias("label"))
    return both.select(F.xxhash64("node", "chunk", "block").alias("gid"), F.lit(parted).alias("only_first"), "first", "rep", "label")


def likely(groups: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what minwise tokens, a byte of each, may link at all (five standard deviations below the threshold) across the labels of each group; fewer than its members."""
    p = percent / 100
    least = (p - 5 * (p * (1 - p) / TOKENS) ** 0.5) * TOKENS

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        _, only, first, rep, own, sig = zip(*rows, strict=True)
        first = np.array(first, bool)
        sig = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, TOKENS)
        label = np.unique(own, return_inverse=True)[1]
        out = []
        for i in np.flatnonzero(first) if only[0] else range(len(rows) - 1):
            rest = np.flatnonzero(label != label[i]) if only[0] else i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            if len(rest):
                near = rest[(sig[rest] == sig[i]).sum(axis=1) >= least]
                if len(near):
                    new, at = np.unique(label[near], return_index=True)
                    out += [(rep[i], rep[k]) for k in near[at].tolist()]
                    label[np.isin(label, new)] = label[i]
        return out

    return in_groups(groups.join(reps.select("rep", "low"), "rep"), ("gid", "only_first", "first", "rep", "label", "low"), pairs)


def in_groups(rows: DataFrame, columns: tuple[str, ...], links) -> DataFrame:
    """(a, b) that ``links`` finds among the rows of each group (columns, the first its number), any number of groups in a partition."""

    def run(batches):
        held: list[tuple] = []
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, out = b.slice(at, 512), []
                for row in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
                    if held and held[0][0] != row[0]:
                        out += links(held)
                        held = []
                    held.append(row)
                yield batch(out)
        yield batch(links(held))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*columns).repartition(n, columns[0]).sortWithinPartitions(columns[0]).mapInArrow(run, "a long, b long")


def compare(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join the labels of each group."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        _, only, first, rep, label, sig, items = zip(*rows, strict=True)
        return resolve(np.array(rep), np.array(first, bool), np.array(label), np.frombuffer(b"".join(sig), np.uint32).reshape(-1, TOKENS), [np.frombuffer(x, np.uint64) for x in items], percent, only[0])

    return in_groups(groups, ("gid", "only_first", "first", "rep", "label", "sig", "items"), pairs)


def with_sets(groups: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Adds sig and items: the sets of the documents in groups, made anew from their texts, and their tokens."""
    groups = stored(groups, "groups")
    want = stored(groups.select("rep").distinct(), "wanted")
    if want.count() <= BROADCAST_ROWS:
        want = F.broadcast(want)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(want, "rep")

    def run(batches):
        hashes = WordHash()
        for b in batches:
            for part, raw in text_parts(b, 2_000_000):
                sets = [shingle_set(t, shingle, hashes) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("rep")), pa.array([minwise(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "sig", "items"])

    sets = texts.mapInArrow(run, "rep long, sig binary, items binary").where(F.length("items") > 0)
    return groups.join(sets, "rep")


def as_links(labels: DataFrame | None, *more: DataFrame) -> DataFrame:
    """Labels and further links as one table of links."""
    out = list(more) if labels is None else [labels.select(F.col("rep").alias("a"), F.col("label").alias("b")), *more]
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every


def relabelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, rep, label) with each document's component, itself without one."""
    if labels is None:
        return rows.select("node", "rep", F.col("rep").alias("label"))
    return rows.drop("label").join(labels, "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("label"))


def across_trees(large: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Large nodes (node, rep, label) of all trees that pivots left in more than one component. Those with the same largest component become one, named by it, with each document once: every two documents of a node stay together, and a family's nodes are gone through once, not once a tree."""
    # a document gets its label once, not once a tree
    rows = relabelled(large.groupBy("rep").agg(F.collect_list("node").alias("node")), labels).withColumn("node", F.explode("node"))
    per = rows.groupBy("node", "label").agg(F.count("*").alias("k")).groupBy("node").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", -F.col("label"))).alias("main"))
    return rows.join(of_nodes(per.where("labels > 1").select("node", "main"), "parted_nodes"), "node").select(F.col("main").alias("node"), "rep", "label").distinct()


def families(reps: DataFrame, trees: int, percent: int, small: int, levels: int, chunk: int) -> DataFrame | None:
    """(rep, label): components of what the trees bring together and tokens may link. Links hold within them."""
    nodes, large = tree_nodes(reps.withColumn("label", F.col("rep")), range(trees), percent / 100, small, levels)
    groups = small_groups(nodes)
    if large is None:
        return components(likely(groups, reps, percent), reps.sparkSession)
    labels = components(likely(groups.union(chunked(large, False, chunk)), reps, percent), reps.sparkSession)
    # written, as chunked reads it many times
    parted = stored(across_trees(large, labels), "parted")
    again = likely(chunked(parted, True, chunk), reps, percent)
    return components(as_links(labels, again), reps.sparkSession)


def linked(reps: DataFrame, docs: DataFrame, shingle: int, percent: int, trees: int, small: int, levels: int, chunk: int) -> DataFrame | None:
    """(rep, label): components by confirmed links. A document's set is made and sent once for its family, not once a tree."""
    family = families(reps, trees, percent, small, levels, 4 * chunk)
    if family is None:
        return None
    family = family.select(F.col("label").alias("node"), "rep", F.col("rep").alias("label"))
    big = stored(family.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "big")
    if big.isEmpty():
        return components(compare(with_sets(small_groups(family), docs, shingle), percent), reps.sparkSession)
    large = family.join(big, "node")
    groups = small_groups(family.join(big, "node", "left_anti")).union(chunked(large, False, chunk))
    labels = components(compare(with_sets(groups, docs, shingle), percent), reps.sparkSession)
    parted = stored(relabelled(large, labels), "parted")
    again = compare(with_sets(chunked(parted, True, chunk), docs, shingle), percent)
    return components(as_links(labels, again), reps.sparkSession)


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, small: int = SMALL, levels: int = LEVELS, chunk: int = CHUNK) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept. Ids that are no whole numbers are compared as they are sorted."""
    docs = docs.select("doc_id", "text")
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        # numbered in their order: partitions of a sort are ordered, and so are the numbers
        ids = stored(docs.select("doc_id").where("doc_id is not null").distinct().sort("doc_id").select("doc_id", F.monotonically_increasing_id().alias("number")), "ids")
        own = stored(docs.join(ids, "doc_id", "left").select(F.col("number").alias("doc_id"), "text"), "numbered")
        out = classes(own, shingle, percent, trees, small, levels, chunk).withColumnsRenamed({"doc_id": "number", "component_id": "component"})
        named = out.join(ids, "number", "left").join(ids.select(F.col("number").alias("component"), F.col("doc_id").alias("component_id")), "component", "left")
        return named.select("doc_id", "n_shingles", "component_id", "kept")
    sketch = stored(sketches(docs, shingle), "sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    own = full.groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").cast("long").alias("rep"), "sig", "low")).alias("r"))
    reps = stored(own.select("hi", "lo", "r.rep", "r.sig", "r.low"), "representatives")
    labels = linked(reps.select("rep", "sig", "low"), docs, shingle, percent, trees, small, levels, chunk)
    own = reps.select("hi", "lo", "rep")
    own = own.withColumn("label", F.col("rep")) if labels is None else own.join(labels, "rep", "left").select("hi", "lo", F.coalesce("label", "rep").alias("label"))
    out = sketch.select("doc_id", "n_shingles", "hi", "lo").join(own.select("hi", "lo", "label"), ["hi", "lo"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id").cast("long")).otherwise(F.col("label"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """The documents of docs that stay, one of each component, with their columns."""
    gone = stored(classes(docs, shingle, percent, **options).where("not kept").select("doc_id").distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:  # else texts cross a shuffle
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
