"""Conversion and splitting of page tables: one Arrow pass a page, rows out."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import convert, mime, split
from ..functions.batches import parts

#: Fixed value: a larger document is not converted, in characters.
MAX_DOCUMENT = 10 * 1024 * 1024

_CHUNK = "page_id long, sort_order long, content string, types array<string>, level long, path array<string>"


def converted(pages: DataFrame) -> DataFrame:
    """(page_id, url, pipeline, language, title, links, markdown) of pages (page_id, url, mime, body); binary media and too large documents have no row."""
    rows = pages.select("page_id", "url", mime.pipeline("mime", "body").alias("pipeline"), mime.language("mime").alias("language"), "body")

    def run(batches):
        for part in parts(batches):
            # a condition in the plan would be pushed below and work the type out anew for each of its uses
            kind, body = part.column(2), part.column(4)
            fits = pc.or_kleene(pc.not_equal(kind, "document"), pc.less_equal(pc.utf8_length(body), MAX_DOCUMENT))
            part = part.filter(pc.and_kleene(pc.is_valid(kind), fits), null_selection_behavior="drop")
            titles, links, texts = [], [], []
            for url, kind, body in zip(*(part.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
                body = body or ""
                if kind == "html":
                    page = convert.html_page(body, url or "")
                elif kind == "markdown":
                    page = {"title": convert.markdown_title(body), "links": convert.markdown_links(body, url or ""), "markdown": convert.without_embedded_images(body)}
                else:
                    page = {"title": (url or "").rstrip("/").rsplit("/", 1)[-1] or "Untitled", "links": [], "markdown": body}
                titles.append(page["title"])
                links.append(page["links"])
                texts.append(page["markdown"])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(titles, pa.string()), pa.array(links, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["page_id", "url", "pipeline", "language", "title", "links", "markdown"])

    return rows.mapInArrow(run, "page_id long, url string, pipeline string, language string, title string, links array<string>, markdown string")


def chunked(pages: DataFrame) -> DataFrame:
    """(page_id, sort_order, content, types, level, path) of converted pages (page_id, pipeline, language, markdown)."""
    fields = [("page_id", pa.int64()), ("sort_order", pa.int64()), ("content", pa.string()), ("types", pa.list_(pa.string())), ("level", pa.int64()), ("path", pa.list_(pa.string()))]

    def run(batches):
        for b in parts(batches):
            out = []
            for page, kind, language, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(page, n, c["content"], c["types"], c["level"], c["path"]) for n, c in enumerate(split.split(text or "", kind, language))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])

    return pages.select("page_id", "pipeline", "language", "markdown").mapInArrow(run, _CHUNK)


def source_pages(files: DataFrame) -> DataFrame:
    """(page_id, url, mime, body) of files (path, content), for :func:`converted`; what is no text is left out. The number is a hash of the path."""
    kind = F.coalesce(mime.detect("path"), F.lit("application/octet-stream"))
    x = files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), kind.alias("mime"), F.col("content").cast("string").alias("body"))
    return x.where(mime.is_safe_text("mime") & ~F.contains("body", F.lit("\0")))


#: Splitters of one kind of text by name, for :func:`pieces`.
SPLITTERS = {"text": split.split_text, "list": split.split_list, "table": split.split_table, "code": split.split_code, "recursive": split.recursive}


def pieces(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """(id, pos, piece) of texts (id, body) by one splitter."""
    f = SPLITTERS[kind]

    def run(batches):
        for b in parts(batches):
            out = [(i, n, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, p in enumerate(f(t or "", size))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["id", "pos", "piece"])

    return rows.select("id", "body").mapInArrow(run, "id long, pos long, piece string")


def boundaries(rows: DataFrame, language: str) -> DataFrame:
    """(id, first, last, kind, name) of the declarations in sources (id, body)."""
    f = split.python_boundaries if language == "python" else split.script_boundaries

    def run(batches):
        for b in parts(batches):
            out = [(i, *x) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in f(t or "")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["id", "first", "last", "kind", "name"])

    return rows.select("id", "body").mapInArrow(run, "id long, first long, last long, kind string, name string")


def rewritten(rows: DataFrame, f) -> DataFrame:
    """(id, text): a plain function over texts (id, body)."""

    def run(batches):
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f(t or "") for t in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return rows.select("id", "body").mapInArrow(run, "id long, text string")


def bisected(rows: DataFrame, most: int) -> DataFrame:
    """(id, batch, size, failed) of texts (id, body) of one batch: a batch over the provider's size is halved until its parts fit; a single text that does not fails alone."""

    def run(batches):
        for b in batches:
            items = [(i, len(t or "")) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            done, todo = [], [items]
            while todo:
                part = todo.pop()
                if not part:
                    continue
                if len(part) > 1 and sum(n for _, n in part) > most:
                    todo += [part[len(part) // 2 :], part[: len(part) // 2]]
                    continue
                done += [(i, part[0][0], n, n > most) for i, n in part]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names=["id", "batch", "size", "failed"])

    return rows.select("id", "body").mapInArrow(run, "id long, batch long, size long, failed boolean")
