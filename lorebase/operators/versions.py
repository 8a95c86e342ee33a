"""Version labels: classes, order and resolution."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEMVER = re.compile(r"v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?\Z")
_PARTIAL = re.compile(r"v?(\d+)(?:\.(\d+))?\Z")
_RANGE = re.compile(r"(\d+)(?:\.(x|\d+))?(?:\.(x|\d+))?\Z")
REQUEST = r"^\d+(?:\.(?:x(?:\.x)?|\d+(?:\.(?:x|\d+))?))?$"


def parsed(label: str) -> tuple | None:
    """(major, minor, patch, prerelease, strict) of a version, None for a tag. Build metadata does not count."""
    if m := _SEMVER.match(label):
        return int(m[1]), int(m[2]), int(m[3]), m[4] or "", True
    if m := _PARTIAL.match(label):
        return int(m[1]), int(m[2] or 0), 0, "", False
    return None


def _pre_key(pre: str) -> tuple:
    """Numbers before words, fewer parts before more; none at all is highest."""
    if not pre:
        return (1,)
    return (0, *((0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")))


def key(label: str) -> tuple:
    """Ascending keys give the canonical order: unversioned, versions from the highest (a full spelling first), tags by name."""
    if not label:
        return (0,)
    v = parsed(label)
    if v is None:
        return (2, label)
    inverse = _Reversed((v[0], v[1], v[2], _pre_key(v[3])))
    return (1, inverse, not v[4], label)


class _Reversed:
    def __init__(self, x):
        self.x = x

    def __lt__(self, other):
        return other.x < self.x

    def __eq__(self, other):
        return other.x == self.x


def ordered(labels: list[str]) -> list[str]:
    return sorted(labels, key=key)


def _precedence(label: str) -> tuple:
    v = parsed(label)
    return (v[0], v[1], v[2], _pre_key(v[3]))


def best_version(labels: list[str], wanted: str | None) -> tuple[str | None, bool]:
    """(label, whether unversioned documents exist): the label as asked for; else the highest version in its range or, for an exact one, below it; else, with nothing asked, a lone tag."""
    have = [x for x in labels if x]
    unversioned = "" in labels
    ask = (wanted or "").strip().lower()
    if ask and ask in have:
        return ask, unversioned
    versions = [x for x in have if parsed(x)]
    open_ = ask in ("", "latest")
    fit = versions if open_ else [x for x in versions if _in_range(x, ask)]
    if not fit and not open_:
        target = parsed(ask)
        if target and re.match(REQUEST, ask) and "x" not in ask:
            fit = [x for x in versions if _precedence(x) <= (target[0], target[1], target[2], _pre_key(target[3]))]
    if fit:
        top = max(map(_precedence, fit))
        return min((x for x in fit if _precedence(x) == top), key=lambda x: (not parsed(x)[4], x)), unversioned
    tags = [x for x in have if not parsed(x)]
    if open_ and len(tags) == 1 and not versions:
        return tags[0], unversioned
    return None, unversioned


def _in_range(label: str, ask: str) -> bool:
    """Whether a version lies in a partial or x range; prereleases belong to their release's range."""
    m = _RANGE.match(ask)
    if not m:
        return False
    v = parsed(label)
    parts = [p for p in m.groups() if p is not None and p != "x"]
    return all(v[i] == int(p) for i, p in enumerate(parts)) and (len(parts) < 3 or not v[3])


def kind(label: str | Column) -> Column:
    """version, partial, tag, or null for an empty label."""
    x = F.col(label) if isinstance(label, str) else label
    strict = x.rlike(r"^v?\d+\.\d+\.\d+(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?(?:\+[0-9A-Za-z.-]+)?$")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(None).cast("string")).when(strict, "version").when(x.rlike(r"^v?\d+(?:\.\d+)?$"), "partial").otherwise("tag")


def sort_columns(label: str | Column) -> list[Column]:
    """Columns to order by: the canonical order in Spark's own expressions. A prerelease's numbers are padded, so that its text compares as its parts do."""
    x = F.col(label) if isinstance(label, str) else label
    k = kind(x)
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")), F.lit("9999999999")), F.lit(0))
    pre = F.regexp_extract(x, r"^v?\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    padded = F.array_join(F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 12, "0"))).otherwise(F.concat(F.lit("1"), p))), "\x01")
    release = F.when(pre == "", F.lit("2")).otherwise(padded)
    versioned = k.isin("version", "partial")
    num = lambda i: F.when(versioned, part(i))
    return [
        F.when(k.isNull(), 0).when(versioned, 1).otherwise(2), F.desc_nulls_first(num(1)), F.desc_nulls_first(num(2)), F.desc_nulls_first(num(3)),
        F.desc_nulls_first(F.when(versioned, release)), F.when(k == "partial", 1).otherwise(0), x,
    ]


def resolve_all(labels: DataFrame, requests: DataFrame) -> DataFrame:
    """(library, wanted, best, unversioned) for each request (library, wanted), from labels (library, version). A library's labels are one array, as many as it has versions."""
    per = labels.groupBy("library").agg(F.array_sort(F.collect_set(F.coalesce("version", F.lit("")))).alias("labels"))
    rows = requests.join(per, "library", "left").select("library", "wanted", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))

    def run(batches):
        for b in batches:
            found = [best_version(have, ask) for have, ask in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], names=["library", "wanted", "best", "unversioned"])

    return rows.mapInArrow(run, "library string, wanted string, best string, unversioned boolean")
