"""Language-model scores by subword lattices.

A word, with the mark that opens it, is any sequence of an existing vocabulary's pieces that spells it; the lattice of
all these sequences is summed by a forward recursion in log space. Pieces of a word never cross into the next, so a
document's marginal probability is the product of its words' and of one end.

The vocabulary's own scores give the pieces their first weights; ``own_score`` is the document's probability under them.
Scores of ranks (pieces scored 0, -1, -2, ...) are no log probabilities and weigh as 1 / (rank + 8), others as
exp(score). One pass of expected counts over the training words, forward and backward in log space, then re-weights
them to what the corpus holds; ``score`` is the probability under these. The vocabulary itself stays as it is. A
character is also spelt by the vocabulary's 256 byte pieces, so every text has a probability.

Words are counted over the whole training part. A word's count and lattice scores go back to the shards that hold it:
a shard is a part of a task's input that keeps its words once and its documents as numbers of words, so neither texts
nor (document, word) rows are shuffled, and no table of all words is sent anywhere.

Defined cases: a null text is empty and has one token, the end; without training documents every count is 0 and the
pieces keep their first weights; each row counts, also where ids repeat; a null id is learned from as an empty id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column_bytes, crc_mod, space_words, stored

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHARD_BYTES = 8_000_000


class Trie:
    """The beginnings of pieces as numbered nodes, 0 the empty one. Steps of many at once go through an open hash table of (node, character)."""

    def __init__(self, pieces: dict[str, int]):
        begun = {t[:i] for t in pieces for i in range(1, len(t) + 1)}
        number = {"": 0} | {t: i for i, t in enumerate(sorted(begun), 1)}
        #: the piece that ends at a node, or -1
        self.piece = np.full(len(number), -1, np.int64)
        for t, i in pieces.items():
            self.piece[number[t]] = i
        keys = np.array([number[t[:-1]] << 21 | ord(t[-1]) for t in sorted(begun)], np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.child = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        todo, step = np.arange(len(keys)), 0
        while len(todo):  # all that are left try their next slot; the first of each free one gets it
            at = (self._slot(keys[todo]) + step) & self.mask
            free = np.flatnonzero(self.key[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            won = todo[free[first]]
            self.key[slot], self.child[slot] = keys[won], won + 1
            todo, step = np.setdiff1d(todo, won, assume_unique=True), step + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to, -1: none."""
        key = node << 21 | char
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        live = np.arange(len(key))
        while len(live):
            found = self.key[at[live]]
            same = found == key[live]
            out[live[same]] = self.child[at[live[same]]]
            live = live[~same & (found >= 0)]
            at[live] = (at[live] + 1) & self.mask
        return out


class Vocabulary:
    """Pieces by text, the 256 byte pieces by byte, and first weights by piece id."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = p.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.bytes = [-1] * 256
        score = np.full(self.size, -np.inf)
        for i in range(self.size):
            text = p.id_to_piece(i)
            if p.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and MARK not in text[1:]:
                self.pieces[text] = i
                score[i] = p.get_score(i)
        #: pieces by text, and -1 for beginnings of pieces: a search stops where no piece goes on
        self.begun = {t[:i]: -1 for t in self.pieces for i in range(1, len(t))} | self.pieces
        self.trie = Trie(self.pieces)
        self.spelled: dict[str, tuple[int, ...]] = {}
        known = np.array(sorted(self.pieces.values()))
        ranks = known.size and np.all(score[known] == np.round(score[known]))
        weight = np.zeros(self.size + 1)  # the last is the end
        weight[known] = 1 / (8 - score[known]) if ranks else np.exp(score[known])
        low = weight[known].min()
        for i in self.bytes:
            if i >= 0:
                weight[i] = low
        weight[self.size] = weight[known].sum() / 100
        self.first = weight / weight.sum()

        self.byte_ids = np.array(self.bytes)

    def spell(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character."""
        ids = self.spelled.get(char)
        if ids is None:
            ids = self.spelled[char] = tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str = TOKENIZER) -> Vocabulary:
    return Vocabulary(path)


def forward(word: str, v: Vocabulary, logp: list[float]) -> float:
    """Log of the word's weight summed over all segmentations: a forward recursion in log space."""
    text = MARK + word
    n = len(text)
    get, exp = v.begun.get, math.exp
    terms: list[list[float]] = [[] for _ in range(n + 1)]
    a = 0.0
    for i in range(n):
        if i:
            own = terms[i]
            if len(own) == 1:
                a = own[0]
            else:
                top = max(own)
                total = 0.0
                for x in own:
                    total += exp(x - top)
                a = top + math.log(total)
        for j in range(i + 1, n + 1):
            k = get(text[i:j])
            if k is None:
                break
            if k >= 0:
                terms[j].append(a + logp[k])
        terms[i + 1].append(a + sum([logp[k] for k in v.spell(text[i])]))
    own = terms[n]
    top = max(own)
    return top + math.log(sum([exp(x - top) for x in own]))


#: Characters of a word, with its mark, up to which words are worked on together; a longer one is worked on alone.
TOGETHER = 48


class Lattices:
    """The lattices of many words at once. A word has a slot for each of its characters, with its mark, and one for its end; an edge goes from slot to slot."""

    def __init__(self, words: list[str], v: Vocabulary):
        text = [MARK + w for w in words]
        self.v, self.size = v, np.array([len(t) for t in text], np.int64)
        code = np.frombuffer("\0".join([*text, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stop = np.cumsum(self.size + 1) - 1
        self.stop, start = stop, stop - self.size
        word = np.repeat(np.arange(len(text)), self.size + 1)
        at = np.arange(len(code)) - start[word]  # place in the word
        inner = np.flatnonzero(at < self.size[word])
        self.word, self.slots = word, len(code)
        #: by length: (slots that edges leave, pieces, how many edges end before each place)
        self.edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.code = code[inner]
        place = at[inner]
        most = int(self.size.max(initial=0))
        cut = lambda ends: np.searchsorted(ends, np.arange(most + 2))
        order = np.argsort(place.astype(np.uint8), kind="stable")
        self.spelt, self.spelt_code, self.spelt_cut = inner[order], self.code[order], cut(place[order] + 1)
        pos, node, n = self.spelt, np.zeros(len(inner), np.int64), 0
        while len(pos):
            node = v.trie.step(node, code[pos + n])
            n += 1
            keep = node >= 0
            pos, node = pos[keep], node[keep]
            piece = v.trie.piece[node]
            ends = np.flatnonzero(piece >= 0)
            self.edges.append((pos[ends], piece[ends], cut(at[pos[ends]] + n)))
            more = code[pos + n] != 0
            pos, node = pos[more], node[more]

    def spelling(self, logp: np.ndarray) -> np.ndarray:
        """Log weights of the spellings in bytes of the characters, in the order of ``spelt``."""
        own = np.zeros(len(self.spelt_code))
        for ids, rows in self.byte_pieces():
            own[rows] += logp[ids]
        return own

    def byte_pieces(self):
        """(byte pieces, characters of ``spelt`` that have them), once a byte of UTF-8."""
        c, ids = self.spelt_code, self.v.byte_ids
        n = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):  # from the last byte on
            rows = np.flatnonzero(n > k)
            part = c[rows] >> (6 * k)
            first = n[rows] == k + 1
            yield ids[np.where(first, np.where(n[rows] == 1, part, head[n[rows]] | part), 0x80 | (part & 0x3F))], rows

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all ways to each slot."""
        alpha = np.full(self.slots, -np.inf)
        alpha[self.stop - self.size] = 0.0
        spelt = self.spelling(logp)
        for k in range(1, int(self.size.max(initial=0)) + 1):
            a, z = self.spelt_cut[k], self.spelt_cut[k + 1]
            src = self.spelt[a:z]
            alpha[src + 1] = np.logaddexp(alpha[src + 1], alpha[src] + spelt[a:z])
            for n, (pos, piece, cut) in enumerate(self.edges[:k], 1):
                a, z = cut[k], cut[k + 1]
                if a < z:
                    src = pos[a:z]
                    alpha[src + n] = np.logaddexp(alpha[src + n], alpha[src] + logp[piece[a:z]])
        return alpha

    def scores(self, logp: np.ndarray) -> np.ndarray:
        """Log of each word's marginal weight."""
        return self.forward(logp)[self.stop]

    def expected(self, logp: np.ndarray, count: np.ndarray, into: np.ndarray) -> np.ndarray:
        """Adds count times the pieces' expected numbers; gives the scores."""
        alpha = self.forward(logp)
        beta = np.full(self.slots, -np.inf)
        beta[self.stop] = 0.0
        spelt = self.spelling(logp)
        for k in range(int(self.size.max(initial=0)), 0, -1):
            for n, (pos, piece, cut) in enumerate(self.edges[:k], 1):
                a, z = cut[k], cut[k + 1]
                if a < z:
                    src = pos[a:z]
                    beta[src] = np.logaddexp(beta[src], beta[src + n] + logp[piece[a:z]])
            a, z = self.spelt_cut[k], self.spelt_cut[k + 1]
            src = self.spelt[a:z]
            beta[src] = np.logaddexp(beta[src], beta[src + 1] + spelt[a:z])
        whole = alpha[self.stop]
        share = lambda src, n, w: np.exp(alpha[src] + w + beta[src + n] - whole[self.word[src]]) * count[self.word[src]]
        for n, (pos, piece, _) in enumerate(self.edges, 1):
            into += np.bincount(piece, share(pos, n, logp[piece]), len(into))
        own = share(self.spelt, 1, spelt)
        for ids, rows in self.byte_pieces():
            into += np.bincount(ids, own[rows], len(into))
        return whole


def measured(words: list[str], v: Vocabulary, logp: np.ndarray, count: np.ndarray | None = None, into: np.ndarray | None = None) -> np.ndarray:
    """Log of each word's marginal weight; with ``into`` also adds count times the expected numbers of pieces."""
    out = np.zeros(len(words))
    short = np.array([len(w) < TOGETHER for w in words], bool)
    at = np.flatnonzero(short)
    if len(at):
        many = Lattices([words[i] for i in at], v)
        out[at] = many.scores(logp) if into is None else many.expected(logp, count[at], into)
    rest = np.flatnonzero(~short)
    if len(rest):
        flat = logp.tolist()
        for i in rest.tolist():
            out[i] = forward(words[i], v, flat) if into is None else expected(words[i], float(count[i]), v, flat, into)
    return out


def expected(word: str, count: float, v: Vocabulary, logp: list[float], into: np.ndarray) -> float:
    """Adds count times the pieces' expected numbers over the word's segmentations, in log space; gives the log of its weight."""
    text = MARK + word
    n = len(text)
    get = v.begun.get
    ends: list[list[tuple]] = [[] for _ in range(n + 1)]
    alpha = [0.0] + [-math.inf] * n
    for i in range(n):
        for j in range(i + 1, n + 1):
            k = get(text[i:j])
            if k is None:
                break
            if k >= 0:
                ends[j].append((i, (k,), logp[k]))
                alpha[j] = _log_add(alpha[j], alpha[i] + logp[k])
        ids = v.spell(text[i])
        own = sum([logp[k] for k in ids])
        ends[i + 1].append((i, ids, own))
        alpha[i + 1] = _log_add(alpha[i + 1], alpha[i] + own)
    beta = [-math.inf] * n + [0.0]
    for j in range(n, 0, -1):
        for i, ids, own in ends[j]:
            x = beta[j] + own
            beta[i] = _log_add(beta[i], x)
            share = count * math.exp(alpha[i] + x - alpha[n])
            for q in ids:
                into[q] += share
    return alpha[n]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def shards(docs: DataFrame) -> DataFrame:
    """Rows of two kinds. Words (word not null): shard, place, word, count in training. Documents (ids not null): shard, doc_id, held_out, places and how often."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = column_bytes(b)
            held = np.array(b.column(b.schema.get_field_index("held_out")).to_pylist(), bool)
            ids = b.column(b.schema.get_field_index("doc_id"))
            for i, j in blocks(texts, SHARD_BYTES):
                shard = part << 24 | number
                number += 1
                place: dict[bytes, int] = {}
                counts, docs_at, docs_n = np.zeros(1024, np.int64), [], []
                for k in range(i, j):
                    words = space_words(texts[k])
                    at = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words))
                    at, n = np.unique(at, return_counts=True)
                    if len(place) > len(counts):
                        counts = np.concatenate([counts, np.zeros(len(place), np.int64)])
                    if not held[k]:
                        counts[at] += n
                    docs_at.append(at.tobytes())
                    docs_n.append(n.astype(np.int32).tobytes())
                n = len(place)
                none = lambda m, t: pa.nulls(m, t)
                names = ["shard", "place", "word", "n", "doc_id", "held_out", "at", "times"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int64)), pa.array(list(place), pa.binary()), pa.array(counts[:n]), none(n, ids.type), none(n, pa.bool_()), none(n, pa.binary()), none(n, pa.binary())], names=names)
                m = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), none(m, pa.int64()), none(m, pa.binary()), none(m, pa.int64()), ids.slice(i, m), pa.array(held[i:j]), pa.array(docs_at, pa.binary()), pa.array(docs_n, pa.binary())], names=names)

    return docs.mapInArrow(run, f"shard long, place long, word binary, n long, doc_id {kind}, held_out boolean, at binary, times binary")


def expectations(words: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of two kinds. Words (word not null): word, c, own: the natural log of its weight under the first weights. Pieces (piece not null): a task's expected number of each, over the training words."""

    def run(batches):
        v = vocabulary(tokenizer)
        with np.errstate(divide="ignore"):
            logp = np.log(v.first)
        into = np.zeros(v.size + 1)
        for b in batches:
            n = b.num_rows
            own = measured([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], v, logp, b.column(1).to_numpy(zero_copy_only=False).astype(np.float64), into)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())], names=["word", "c", "own", "piece", "mass"])
        at = np.flatnonzero(into)
        n = len(at)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(at), pa.array(into[at])], names=["word", "c", "own", "piece", "mass"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, own double, piece long, mass double")


def piece_weights(expected: DataFrame, ends: int, tokenizer: str) -> np.ndarray:
    """Probabilities of the pieces and the end: expected numbers over the training words and, as a tenth of one more token a piece, the first weights. The sums, as many as the vocabulary has pieces, come to the driver."""
    v = vocabulary(tokenizer)
    sums = expected.where("piece is not null").groupBy("piece").agg(F.sum("mass").alias("mass")).toPandas()
    total = v.first * v.size * 0.1
    total[sums["piece"].to_numpy(np.int64)] += sums["mass"].to_numpy()
    total[v.size] += ends
    return total / total.sum()


def word_scores(words: DataFrame, weights: np.ndarray, tokenizer: str) -> DataFrame:
    """(word, c, own, lattice): log10 of each word's marginal probability under the first weights and under those learned. The weights are as many as the vocabulary's pieces."""
    with np.errstate(divide="ignore"):
        sent = words.sparkSession.sparkContext.broadcast(np.log(weights))

    def run(batches):
        v, ten = vocabulary(tokenizer), math.log(10)
        for b in batches:
            score = measured([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], v, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy(zero_copy_only=False) / ten, pa.float32()), pa.array(score / ten)], names=["word", "c", "own", "lattice"])

    return words.select("word", "c", "own").mapInArrow(run, "word binary, c long, own float, lattice double")


def scores(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (under the weights learned) and own_score (under the vocabulary's own)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(shards(docs.select("doc_id", "text", (crc_mod("doc_id", 10) == 0).alias("held_out"))), "shards")
    vocab, texts = rows.where("word is not null"), rows.where("at is not null")
    expected = stored(expectations(vocab.groupBy("word").agg(F.sum("n").alias("c")), tokenizer), "words")
    words = expected.where("word is not null")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    ends, n_shards = texts.agg(F.count(F.when(~F.col("held_out"), 1)), F.countDistinct("shard")).first()
    total, distinct = sums[0] + ends, sums[1] + (ends > 0)
    weights = piece_weights(expected, ends, tokenizer)
    known = word_scores(words, weights, tokenizer)
    end_base = math.log10((ends + 0.1) / (total + 0.1 * (distinct + 1)))
    end_score, end_own = math.log10(weights[-1]), math.log10(vocabulary(tokenizer).first[-1])
    back = vocab.select("word", "shard", "place").join(known, "word").select("shard", F.lit(0).alias("kind"), "place", "c", "own", "lattice", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("times"))
    both = back.union(texts.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("float"), F.lit(None).cast("double"), "doc_id", "held_out", "at", "times"))

    def run(batches):
        parts = ("place", "c", "own", "lattice")
        now, held, table = None, {x: [] for x in parts}, None
        for b in batches:
            col = {x: b.column(b.schema.get_field_index(x)) for x in ("shard", "kind", *parts, "doc_id", "held_out", "at", "times")}
            shard, what = col["shard"].to_numpy(zero_copy_only=False), col["kind"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(what) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if i == j:
                    continue
                if shard[i] != now:
                    now, held, table = shard[i], {x: [] for x in parts}, None
                if what[i] == 0:
                    for x in parts:
                        held[x].append(col[x].slice(i, j - i).to_numpy(zero_copy_only=False))
                    continue
                if table is None:
                    at, seen, own, lattice = (np.concatenate(held[x]) if held[x] else np.zeros(0, np.int64) for x in parts)
                    table = np.zeros((4, len(at)))
                    table[:, at] = np.log10((seen + 0.1) / (total + 0.1 * (distinct + 1))), lattice, seen > 0, own
                out = []
                for at, n in zip(col["at"].slice(i, j - i).to_pylist(), col["times"].slice(i, j - i).to_pylist(), strict=True):
                    got = table[:, np.frombuffer(at, np.int32)] @ np.frombuffer(n, np.int32)
                    out.append((int(np.frombuffer(n, np.int32).sum()) + 1, round(got[2]) + (ends > 0), total, got[0] + end_base, got[1] + end_score, got[3] + end_own))
                yield pa.RecordBatch.from_arrays(
                    [col["doc_id"].slice(i, j - i), col["held_out"].slice(i, j - i), *(pa.array([x[k] for x in out], pa.int64() if k < 3 else pa.float64()) for k in range(6))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "own_score"],
                )

    # a task holds one shard at a time, and reads a few
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // 2))
    dealt = both.repartition(n, "shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, own_score double")


def op8_lattice_scores(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
