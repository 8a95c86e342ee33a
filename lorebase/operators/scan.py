"""Exact scans: grep over lines, whole pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import context

MAX_PATTERN, MAX_LIMIT = 1000, 200
#: A quantified group that is itself quantified can take time without bound.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]")


def compiled(pattern: str) -> tuple[str | None, str | None]:
    """(literal, expression) of a pattern: ``/expression/flags`` or plain text. Raises ValueError for what cannot be run safely."""
    if not pattern or len(pattern) > MAX_PATTERN:
        raise ValueError("empty or too long pattern")
    m = re.fullmatch(r"/(.+)/([a-z]*)", pattern, re.S)
    if not m:
        return pattern, None
    try:
        re.compile(m[1])
    except re.error as e:
        raise ValueError(f"invalid expression: {e}") from e
    if _NESTED.search(m[1]):
        raise ValueError("too slow: nested repetition")
    flags = "".join(f for f in "ims" if f in m[2])
    return None, (f"(?{flags})" if flags else "") + m[1]


def grep(pages: DataFrame, pattern: str, limit: int = 30) -> DataFrame:
    """(page_id, line, content, excerpt, total) of the first ``limit`` lines that match, in order of page and line; all are counted. A literal sifts whole pages before their lines are made."""
    limit = max(1, min(MAX_LIMIT, limit))
    literal, expression = compiled(pattern)
    src = pages.where(F.contains("markdown", F.lit(literal))) if literal else pages
    lines = src.select("page_id", F.posexplode(F.split("markdown", "\n", -1)).alias("pos", "content"))
    hits = lines.where(F.contains("content", F.lit(literal)) if literal else F.col("content").rlike(expression))
    at = F.instr("content", literal) if literal else F.greatest(F.lit(1), F.length(F.regexp_extract("content", f"^(.*?)(?:{expression})" if not expression.startswith("(?") else f"{expression[: expression.index(')') + 1]}^(.*?)(?:{expression[expression.index(')') + 1 :]})", 1)) + 1)
    shown = hits.select("page_id", (F.col("pos") + 1).cast("long").alias("line"), "content").orderBy("page_id", "line").limit(limit)
    total = hits.agg(F.count("*").alias("total"))  # one row
    return shown.withColumn("excerpt", text.excerpt("content", at)).crossJoin(F.broadcast(total))


def read_pages(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page_id, content): a page's Markdown, else its chunks joined by blank lines. Only pages without Markdown read their chunks."""
    missing = pages.where("markdown is null").select("page_id")
    joined = context.assembled(chunks.join(missing, "page_id", "left_semi").select("page_id", "sort_order", "id", "content"), ["page_id"])
    return pages.where("markdown is not null").select("page_id", F.col("markdown").alias("content")).union(missing.join(joined, "page_id", "left").select("page_id", "content"))
