"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a document's score is the sum of its weights and of the products of all
pairs of its features' vectors. By the sum-of-squares identity, half of (the square of the sum less the sum of the
squares) gives that sum in time linear in the features.

Features of a text: its distinct words, hashed, with a damped count; bins of statistics of its structure (length, word
length, shares of symbols, capitals, digits, line breaks, repeated words and lines); of its metadata the stored length,
in bins. Labels, language, source and id are not features.

The model is fitted on at most ``max_train`` labelled rows (those with the smallest hash of their id), a documented
bound; everything else runs over all rows.

Defined cases: a null or empty text has the bins of an empty text only; labels of null quality or null id are not used;
a document with several labels takes each; without labels of both kinds every score is the share of label 1 (0.5
without any); repeated rows score equally; a column that has the score's name gives way; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, crc_mod, own_names, text_parts

BUCKETS = 1 << 16
RANK = 8
MAX_TRAIN = 12_000
#: Statistics of a text, each in BINS bins; stored before the hashed words.
STATS = 14
BINS = 24
STAT_WEIGHT = 0.35
#: Text worked on at once.
PART_BYTES = 3_000_000


def statistics(text: bytes, words: list[bytes], stored_length: int | None) -> list[float]:
    """Each in 0..1."""
    n, w = max(1, len(text)), max(1, len(words))
    symbols = n - len(text.translate(None, b"!#$%&*+<=>@\\^_`{|}~[]"))
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = n - len(text.translate(None, b"0123456789"))
    points = n - len(text.translate(None, b".,;:?"))
    bangs = n - len(text.translate(None, b"!"))
    lines = text.split(b"\n")
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    sizes = len(text) - text.count(b" ")
    log = lambda x, top: min(1.0, np.log1p(x) / np.log1p(top))
    return [
        log(len(words), 30_000),
        log(n, 200_000),
        min(1.0, sizes / w / 20),
        min(1.0, 4 * symbols / n),
        min(1.0, upper / n),
        min(1.0, 4 * digits / n),
        min(1.0, 6 * points / n),
        min(1.0, 10 * bangs / n),
        len(distinct) / w,
        len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 1.0,
        len(set(lines)) / len(lines),
        log(len(lines), 3_000),
        min(1.0, sum(x.endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines)),
        log(stored_length if stored_length and stored_length > 0 else 0, 200_000),
    ]


def features(texts: list[bytes], lengths: list[int | None], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, feature, value) of the texts, in rows."""
    ids, rows, stats = [], [], []
    for i, t in enumerate(texts):
        words = t.lower().split()
        h = hashes.all(words)
        ids.append((h % np.uint64(BUCKETS)).astype(np.int64))
        rows.append(np.full(len(words), i, np.int64))
        stats.append(statistics(t, words, lengths[i]))
    key = np.concatenate(rows) * BUCKETS + np.concatenate(ids) if rows else np.zeros(0, np.int64)
    key, count = np.unique(key, return_counts=True)
    row, word = key // BUCKETS, key % BUCKETS + STATS * BINS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, len(texts)))
    value = value / norm[row]
    bins = np.minimum((np.array(stats).reshape(-1, STATS) * BINS).astype(np.int64), BINS - 1) + np.arange(STATS) * BINS
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), STATS)])
    feature = np.concatenate([word, bins.ravel()])
    value = np.concatenate([value, np.full(bins.size, STAT_WEIGHT)])
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
    return offsets, feature[order], value[order]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def raw(self, offsets: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Linear in the features: bias + sum w x + half of (square of the sum - sum of the squares). Each row has features (its bins), so no segment is empty."""
        starts = offsets[:-1]
        if not len(starts):
            return np.zeros(0)
        vx = self.vector[feature] * value[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weight[feature] * value, starts) + 0.5 * ((total * total).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(offsets: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int = 8, rate: float = 0.08, decay: float = 2e-4, batch: int = 64) -> Machine:
    """Adaptive gradient steps on the logistic loss; the rarer label counts more, so that 0.5 parts the two."""
    size = BUCKETS + STATS * BINS
    rng = np.random.default_rng(7)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    n, ones = len(label), float(label.sum())
    if ones in (0.0, float(n)):
        share = ones / n if n else 0.5
        return Machine(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), m.weight, np.zeros((size, RANK)))
    # half-way between the plain loss and equal say of both labels
    cost = np.where(label > 0, (n / (2 * ones)) ** 0.5, (n / (2 * (n - ones))) ** 0.5)
    gw, gv, gb = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            lens = offsets[rows + 1] - offsets[rows]
            at = np.repeat(offsets[rows] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            f, x = feature[at], value[at]
            starts = np.concatenate([[0], np.cumsum(lens)])
            vx = m.vector[f] * x[:, None]
            total = np.add.reduceat(vx, starts[:-1], axis=0)
            raw = m.raw(starts, f, x)
            g = (sigmoid(raw) - label[rows]) * cost[rows] / len(rows)
            row = np.repeat(np.arange(len(rows)), lens)
            used, back = np.unique(f, return_inverse=True)
            gx = g[row] * x
            dw = np.bincount(back, gx, len(used)) + decay * m.weight[used]
            inner = gx[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(back, inner[:, k], len(used)) for k in range(RANK)], axis=1) + decay * m.vector[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.weight[used] -= rate * dw / np.sqrt(gw[used])
            m.vector[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            gb += g.sum() ** 2
            m.bias -= rate * g.sum() / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, held_out: bool = True) -> Machine:
    """Fits on at most ``max_train`` labelled rows; with ``held_out``, on none whose crc32 of the id mod 3 is 1. The chosen labels, so many rows at most, are broadcast; one task fits on the features of their documents, and the model comes to the driver."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    if held_out:
        usable = usable.where(crc_mod("id", 3) != 1)
    chosen = usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_train)
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").alias("id"), "text", length.alias("n")).join(F.broadcast(chosen), "id")

    def run(batches):
        hashes = WordHash()
        for b in batches:
            for part, texts in text_parts(b, PART_BYTES):
                col = lambda c, p=part: p.column(p.schema.get_field_index(c))
                off, feature, value = features(texts, col("n").to_pylist(), hashes)
                cut = list(zip(off[:-1], off[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [col("id").cast(pa.string()), col("label"), pa.array([feature[a:z].astype(np.int32).tobytes() for a, z in cut], pa.binary()), pa.array([value[a:z].astype(np.float32).tobytes() for a, z in cut], pa.binary())],
                    names=["id", "label", "f", "x"],
                )

    def learn(batches):
        found = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        f = [np.frombuffer(r[2], np.int32) for r in found]
        x = [np.frombuffer(r[3], np.float32) for r in found]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in f])]).astype(np.int64)
        m = fit(offsets, *(np.concatenate(a) if a else np.zeros(0, k) for a, k in ((f, np.int32), (x, np.float32))), np.array([float(r[1] > 0) for r in found]))
        yield pa.RecordBatch.from_arrays([pa.array([m.bias], pa.float64()), pa.array([m.weight.astype(np.float32).tobytes()], pa.binary()), pa.array([m.vector.astype(np.float32).tobytes()], pa.binary())], names=["bias", "weight", "vector"])

    # one task fits, on rows whose number is bounded; what comes to the driver has the model's fixed size
    made = rows.mapInArrow(run, "id string, label int, f binary, x binary").repartition(1).mapInArrow(learn, "bias double, weight binary, vector binary").first()
    if made is None:  # no rows, no task
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    return Machine(made["bias"], np.frombuffer(made["weight"], np.float32).astype(np.float64), np.frombuffer(made["vector"], np.float32).reshape(-1, RANK).astype(np.float64))


def scored(docs: DataFrame, model: Machine, out: str = "score") -> DataFrame:
    """docs with the score added as column ``out``; a column of that name gives way. The model has a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    lengths = "n_chars" in docs.columns
    keep = [i for i, c in enumerate(docs.columns) if c.lower() != out.lower()]

    def run(batches):
        hashes = WordHash()
        for b in batches:
            for part, texts in text_parts(b, PART_BYTES):
                lens = part.column(part.schema.get_field_index("n_chars")).to_pylist() if lengths else [None] * len(texts)
                yield part.select(keep).append_column(out, pa.array(sigmoid(sent.value.raw(*features(texts, lens, hashes)))))

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in keep), T.StructField(out, T.DoubleType())]))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text", "n_chars"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents that score at least ``least``, with their columns."""
    model = train(docs, labels, **options)
    (name,) = own_names(docs.columns, 1)
    return scored(docs, model, name).where(F.col(name) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
