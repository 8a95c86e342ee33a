"""Arrow batches in small pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of a piece.
ROWS, BYTES = 256, 4 * 1024 * 1024


def parts(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int | None = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows, fewer where they pass ``size`` bytes, so that the Python values of a batch are never all there at once."""
    for b in batches:
        start = 0
        while start < b.num_rows:
            n = min(rows, b.num_rows - start)
            while size and n > 1 and b.slice(start, n).nbytes > size:
                n //= 2
            yield b.slice(start, n)
            start += n
