"""Media columns: interleaved documents as ordered structs of text and media references, resolved by digest.

HTML is parsed to segments in reading order: texts, and references to media by digest, each with its caption. Media are
kept once each under the SHA-256 of their stored form. References meet media by digest in a join of small rows; what a
medium yields (its size, digests, features, or its bytes, if asked for) is made once per distinct medium, not per
reference, and each segment keeps its position and caption.

The stored form is an 8-bit greyscale PNG of ``WIDTH`` columns: lossless, with the checksums that the format has.

Defined cases: null html has no segments; text of white space only is none; an unresolved digest keeps its segment with
null media; of media rows with one digest one counts; repeated documents keep rows of their own; a null id stays null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes

WIDTH = 192
SCHEME = "media:sha256:"
SEGMENT = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Elements that end a run of text, and those whose content is none.
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure figcaption footer h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_SILENT = frozenset("script style template noscript head".split())


# --- stored form -----------------------------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of WIDTH."""
    return text + b" " * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an unfiltered 8-bit greyscale PNG, rows by columns; raises ValueError for any other or a damaged one."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, size, body = 8, None, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if not size or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Height, mean, deviation, and a 64-bit block hash: which of 8 by 8 blocks are brighter than the median block."""
    total, squares, n = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum()), samples.size
    cut = np.linspace(0, len(samples), 9).astype(int)
    sums = np.concatenate([[np.zeros(8, np.int64)], np.cumsum(samples.reshape(len(samples), 8, -1).sum(axis=2, dtype=np.int64), axis=0)])
    blocks = (sums[cut[1:]] - sums[cut[:-1]]) / np.maximum(1, np.diff(cut))[:, None]
    bits = (blocks > np.median(blocks)).ravel()
    return f"h={len(samples)};mean={total / n:.4f};dev={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};hash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


# --- HTML ------------------------------------------------------------------------------------------------------


class Sequence(HTMLParser):
    """Segments in reading order: (kind, text, digest, caption)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.segments: list[list] = []
        self.run: list[str] = []
        self.figure: list[int] | None = None  # segments of the open figure that await its caption
        self.caption: list[str] | None = None
        self.silent = 0

    def close_text(self) -> None:
        text = "".join(self.run)
        self.run = []
        if text.strip():
            self.segments.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in _BLOCKS:
            self.close_text()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source", "embed"):
            a = dict(attrs)
            src = a.get("src") or ""
            self.close_text()
            self.segments.append(["media", None, src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, a.get("alt")])
            if self.figure is not None:
                self.figure.append(len(self.segments) - 1)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            for k in self.figure or ():
                self.segments[k][3] = "".join(self.caption).strip()
            self.caption = None
        elif tag in _BLOCKS:
            self.close_text()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if self.silent:
            return
        (self.run if self.caption is None else self.caption).append(data)


def segments_of(html: str | None) -> list[dict]:
    p = Sequence()
    p.feed(html or "")
    p.close()
    p.close_text()
    return [{"position": i, "kind": k, "text": t, "digest": d, "caption": c} for i, (k, t, d, c) in enumerate(p.segments)]


# --- Spark -----------------------------------------------------------------------------------------------------


def sequences(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(id, segments) of each page, texts and media references in reading order."""
    kind = pages.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([segments_of(h) for h in part.column(1).to_pylist()], item)], names=[id_col, "segments"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, segments {SEGMENT}")


def stored_media(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(digest, media): each distinct payload's stored form. Equal payloads of a task are stored once there, so that a hot one crosses the shuffle once a task; the digest's bucket keeps one."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            texts = column_bytes(b, column)
            digest, media, size = [], [], 0
            for t in texts:
                own = hashlib.blake2b(t, digest_size=16).digest()
                if own in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(own)
                png = to_png(payload_of(t))
                digest.append(hashlib.sha256(png).hexdigest())
                media.append(png)
                size += len(png)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(digest), pa.array(media, pa.binary())], names=["digest", "media"])
                    digest, media, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return payloads.select(column).mapInArrow(run, "digest string, media binary")


def described(media: DataFrame) -> DataFrame:
    """(digest, media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each distinct medium, read back from its stored bytes."""

    def run(batches):
        seen: set[str] = set()
        for b in batches:
            keep, rows = [], []
            for i, (d, png) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if d in seen:
                    continue
                seen.add(d)
                samples = from_png(png)
                payload = samples.tobytes()
                keep.append(i)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            own = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["digest", "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    n = int(media.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return media.repartition(n, "digest").mapInArrow(run, "digest string, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolved(sequences: DataFrame, media: DataFrame, id_col: str = "doc_id", with_bytes: bool = False) -> DataFrame:
    """(id, position, kind, text, digest, caption, and the columns of media) by segment: the digest join. Only rows of ``media`` columns move, unless the bytes are asked for."""
    flat = sequences.select(id_col, F.explode("segments").alias("s")).select(id_col, "s.*")
    side = media if with_bytes else media.drop("media")
    return flat.join(side, "digest", "left").select(id_col, *[c for c in flat.columns if c != id_col], *[c for c in side.columns if c != "digest"])


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html): each text as a page of one figure, its payload behind a digest, between a heading and its paragraphs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            for i in range(0, b.num_rows, 500):
                texts = column_bytes(b.slice(i, 500))
                own = ids.slice(i, 500)
                html = []
                for k, t in zip(own.to_pylist(), texts, strict=True):
                    digest = hashlib.sha256(to_png(payload_of(t))).hexdigest()
                    body = "".join(f"<p>{escape(x)}</p>" for x in t.decode("utf-8", "replace").split("\n"))
                    html.append(f'<h1>Document {k}</h1><figure><img src="{SCHEME}{digest}"><figcaption>Payload of {k}</figcaption></figure>{body}')
                yield pa.RecordBatch.from_arrays([own, pa.array([len(t) for t in texts], pa.int64()), pa.array(html, pa.string())], names=["doc_id", "n_bytes", "html"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, html string")


def op1_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pages = pages_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def parse(batches):
        # texts stay behind: the query keeps how many segments and code points of text surround each reference
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                every = [segments_of(h) for h in part.column(2).to_pylist()]
                refs = [[s for s in x if s["kind"] == "media"] for x in every]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(refs, item), pa.array([len(x) for x in every], pa.int64()), pa.array([sum(len(s["text"]) for s in x[2:]) for x in every], pa.int64())],
                    names=["doc_id", "n_bytes", "segments", "n_segments", "text_chars"],
                )

    seq = pages.mapInArrow(parse, f"doc_id {kind}, n_bytes long, segments {SEGMENT}, n_segments long, text_chars long")
    flat = seq.select(F.struct("doc_id", "n_bytes", "n_segments", "text_chars").alias("doc"), "segments")
    out = resolved(flat, described(stored_media(docs, "text")), "doc")
    return out.select("doc.doc_id", "doc.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "doc.n_segments", "doc.text_chars")
