"""Helpers shared by the training-data operators: text bytes, hashing, checkpoints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

from ..session import shared_path, stored  # noqa: F401

#: Fixed value: A-Z lower-cased, every ASCII byte but 0-9 and a-z to a space; bytes of multi-byte characters stay.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def column_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return [v if v is not None else b"" for v in col.to_pylist()]


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes.lower() and bytes.split() touch ASCII only."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(ALNUM_TABLE).split()


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks(items: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of items of about ``limit`` bytes each; at least one item a range."""
    i, size = 0, 0
    for j, x in enumerate(items):
        if j > i and size + len(x) > limit:
            yield i, j
            i, size = j, 0
        size += len(x)
    if i < len(items):
        yield i, len(items)


def crc_mod(doc_id: str | F.Column, n: int) -> F.Column:
    """crc32(id as text) mod n; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def own_names(columns: Iterable[str], n: int) -> list[str]:
    """So many column names that differ from the given ones, whatever those are."""
    start = "_own"
    while any(c.lower().startswith(start) for c in columns):
        start = "_" + start
    return [f"{start}{i}" for i in range(n)]


def text_parts(batch: pa.RecordBatch, limit: int, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about ``limit`` bytes of text each, with the texts as bytes: only a slice's are Python objects at a time."""
    col = batch.column(batch.schema.get_field_index(name))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        part = batch.slice(i, j - i)
        yield part, column_bytes(part, name)
        i = j


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
