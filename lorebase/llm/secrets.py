"""Secret scans: token efficiency under a byte-pair vocabulary exposes random strings.

A byte-pair vocabulary spends few tokens on language and many on random strings, so a candidate with few characters
per token is taken for a secret, unless it is a known digest or an identifier. Three plain patterns come first.

Defined cases: a null text is an empty one; an empty text has no span; equal rows give equal rows; columns other than
the named id and text are left alone; texts are scanned whole, at any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, record_batch, text_parts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

KINDS = ("assign", "access", "hex", "token")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Runs on lower-cased bytes, so that letters match in either case.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32,}")
_CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
#: Pure numbers and dates; parts of identifiers; words of letters, joined or not, each with a short number at most.
_NUMBERS = re.compile(rb"[\d_/=+-]+\Z")
_PART = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")
_SEPARATORS = re.compile(rb"[/_=+-]+")
#: No two ways to match one text, so that a failing match takes linear time.
_WORD = re.compile(rb"(?:[A-Za-z]?[a-z]*|[A-Z]+)\d{0,4}\Z")
_CAMEL = re.compile(rb"(?:[a-z]{2,})?(?:[A-Z][a-z]{2,})*\d{0,4}\Z")


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # one piece for the whole candidate: splits at letters and digits would hide how well it merges
    return tiktoken.Encoding("candidates", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def language(candidate: bytes, tokenizer: str) -> bool:
    """At least half the letters lie in parts, of four letters or more, that are vocabulary words in some case; random letters hardly ever are."""
    parts = _PART.findall(candidate)
    in_words = sum(len(p) for p in parts if len(p) >= 4 and is_word(p[:64], tokenizer))
    return 2 * in_words >= sum(map(len, parts))


@lru_cache(maxsize=100_000)
def is_word(part: bytes, tokenizer: str) -> bool:
    text = part.decode()
    forms = (text, text.lower(), text.capitalize())
    return any(len(encoding(tokenizer).encode_ordinary(before + x)) == 1 for x in forms for before in ("", " "))


def identifier(candidate: bytes) -> bool:
    """Words with a short number each between separators, or joined by capitals. One pass: each part is tested once."""
    return all(map(_WORD.match, _SEPARATORS.split(candidate))) or bool(_CAMEL.match(candidate))


def known(candidate: bytes, tokenizer: str = TOKENIZER) -> bool:
    """A digest by its length and alphabet, a UUID, a number, or an identifier made of words; other letters face the ratio."""
    return bool(
        (len(candidate) in DIGEST_LENGTHS and _DIGEST.match(candidate))
        or _UUID.match(candidate)
        or _NUMBERS.match(candidate)
        or (identifier(candidate) and language(candidate, tokenizer))
    )


def spans_of(text: bytes, max_ratio: float = 1.9, tokenizer: str = TOKENIZER) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, characters per token or 0) in bytes, sorted by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end(), 0.0) for m in _ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end(), 0.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), 0.0) for m in _HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        # long runs are weighed in slices, as merging takes more than linear time
        if known(word, tokenizer):
            continue
        tokens = sum(len(encoding(tokenizer).encode_ordinary(word[i : i + 4096].decode())) for i in range(0, len(word), 4096))
        if (ratio := len(word) / tokens) < max_ratio:
            found.append(("token", m.start(), m.end(), ratio))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def to_code_points(text: bytes, spans: list) -> list:
    """Byte offsets to code points, in one pass over the text."""
    if not spans or text.isascii():
        return spans
    cuts = sorted({p for s in spans for p in s[1:3]})
    at, last, n = {}, 0, 0
    for p in cuts:
        n += len(text[last:p].decode("utf-8", "replace"))
        at[p], last = n, p
    return [(k, at[a], at[b], r) for k, a, b, r in spans]


def redacted(text: bytes, spans: list, mark: bytes = b"[SECRET]") -> bytes:
    """Overlapping spans become one mark."""
    out, last, end = [], 0, -1
    for _, a, b, _ in spans:
        if a >= end:
            out += [text[last:a], mark]
        end = last = max(end, b)
    return b"".join([*out, text[last:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 1.9, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: its id and ``spans``, an array of (kind, start, end, chars_per_token) in code points."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chars_per_token", pa.float64())])

    def run(batches):
        for b in batches:
            texts = column_bytes(b, "_text")
            rows = [[dict(zip(("kind", "start", "end", "chars_per_token"), s, strict=True)) for s in to_code_points(t, spans_of(t, max_ratio, tokenizer))] for t in texts]
            ids = b.column(0)
            yield record_batch(pa.schema([("_id", ids.type), ("spans", pa.list_(item))]), [ids, rows])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,chars_per_token:double>>"
    )
    return out.withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", max_ratio: float = 1.9, tokenizer: str = TOKENIZER) -> DataFrame:
    """The same rows and columns, every span of a text replaced by [SECRET]; null stays null."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for part, texts in text_parts(b, 4_000_000, text_col):
                null = part.column(at).is_null().to_pylist()
                new = [None if z else redacted(t, spans_of(t, max_ratio, tokenizer)).decode("utf-8", "replace") for t, z in zip(texts, null, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, type=part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def digests(docs: DataFrame, max_ratio: float = 1.9, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of query op2, derived from :func:`scan`."""
    spans = F.col("spans")
    one = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter(spans, lambda x: x["kind"] != "token")
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    return scan(docs, max_ratio=max_ratio, tokenizer=tokenizer).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, one), ",").alias("spans"),
        count("token").alias("n_token"),
    )


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sha(spans: list) -> str:
    return hashlib.sha256(joined([s for s in spans if s[0] != "token"]).encode()).hexdigest()
