"""The embedding backlog as a stream: new chunks in, vectors out, each batch written once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import context, vectors

#: The first wait after a failure and the longest, in milliseconds.
BASE_MS, MOST_MS = 1_000, 600_000


def backoff(failures: int, retry_after_ms: int | None = None) -> int:
    """The wait after so many failures in a row: doubled each time, what the provider asks for at least, with an upper bound."""
    wait = 0 if failures <= 0 else BASE_MS * 2 ** (failures - 1)
    return min(MOST_MS, max(wait, retry_after_ms or 0))


def hashed(chunks: DataFrame, dimension: int) -> DataFrame:
    """The deterministic embedding of (id, text), for where no model is at hand."""
    return vectors.hashed(chunks, "id", "text", dimension)


def start(chunks: DataFrame, out: str, checkpoint: str, dimension: int = 1536, embed: Callable[[DataFrame, int], DataFrame] = hashed, tries: int = 5) -> StreamingQuery:
    """Embeds a stream of chunks (id, library, page_id, path, content) into Parquet under ``out``, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each vector is there once. A failing batch
    is tried again after :func:`backoff`; the last error stops the stream, which then resumes at that batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        text = batch.select("id", context.embedding_text("library", F.col("page_id").cast("string"), "path", "content").alias("text"))
        for failures in range(1, tries + 1):
            try:
                embed(text, dimension).select("id", vectors.padded("embedding", dimension).alias("embedding")).write.mode("overwrite").parquet(f"{out}/batch={number}")
                return
            except Exception:
                if failures == tries:
                    raise
                time.sleep(backoff(failures) / 1000)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
