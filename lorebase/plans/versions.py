"""Version labels: VER entries and SRT-07 of the inventory. Labels are made from the numbers of customers, so every class occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions as ops
from ..registry import query

_LABEL = """CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN (c_custkey % 4) || '.' || (c_custkey % 11) || '.' || (c_custkey % 3) WHEN 2 THEN (c_custkey % 4) || '.' || (c_custkey % 11) || '.0-rc.' || (c_custkey % 13)
  WHEN 3 THEN 'v' || (c_custkey % 5) || '.' || (c_custkey % 12) WHEN 4 THEN (c_custkey % 9)::VARCHAR ELSE 'node' || (c_custkey % 7) END"""
_L = f"l AS (SELECT c_custkey, 'lib' || c_nationkey AS library, {_LABEL} AS version FROM customer)"


def labels(t):
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    m = k % 6
    label = (
        F.when(m == 0, "").when(m == 1, F.concat_ws(".", s(k % 4), s(k % 11), s(k % 3))).when(m == 2, F.concat(F.concat_ws(".", s(k % 4), s(k % 11)), F.lit(".0-rc."), s(k % 13)))
        .when(m == 3, F.concat(F.lit("v"), F.concat_ws(".", s(k % 5), s(k % 12)))).when(m == 4, s(k % 9)).otherwise(F.concat(F.lit("node"), s(k % 7)))
    )
    return t.customer.select("c_custkey", F.concat(F.lit("lib"), F.col("c_nationkey").cast("string")).alias("library"), label.alias("version"))


_KIND = r"CASE WHEN version = '' THEN NULL WHEN regexp_matches(version, '^v?\d+\.\d+\.\d+(-.*)?$') THEN 'version' WHEN regexp_matches(version, '^v?\d+(\.\d+)?$') THEN 'partial' ELSE 'tag' END"


@query("ver_01_classify", f"WITH {_L} SELECT c_custkey, version, {_KIND} AS kind FROM l")
def _(t):
    return labels(t).select("c_custkey", "version", ops.kind("version").alias("kind"))


_KEYS = rf"""k AS (SELECT *, {_KIND} AS kind, coalesce(try_cast(regexp_extract(version, '^v?(\d+)', 1) AS INT), 0) AS a, coalesce(try_cast(regexp_extract(version, '^v?\d+\.(\d+)', 1) AS INT), 0) AS b, coalesce(try_cast(regexp_extract(version, '^v?\d+\.\d+\.(\d+)', 1) AS INT), 0) AS c,
  CASE WHEN contains(version, '-rc.') THEN try_cast(regexp_extract(version, '-rc\.(\d+)', 1) AS INT) ELSE 1000000 END AS pre FROM l)"""


@query("srt_07_version_order", f"WITH {_L}, {_KEYS} SELECT library, version, row_number() OVER (PARTITION BY library ORDER BY CASE WHEN kind IS NULL THEN 0 WHEN kind = 'tag' THEN 2 ELSE 1 END, CASE WHEN kind IN ('version', 'partial') THEN a END DESC, CASE WHEN kind IN ('version', 'partial') THEN b END DESC, CASE WHEN kind IN ('version', 'partial') THEN c END DESC, CASE WHEN kind IN ('version', 'partial') THEN pre END DESC, CASE WHEN kind = 'partial' THEN 1 ELSE 0 END, version) AS place FROM (SELECT DISTINCT library, version, kind, a, b, c, pre FROM k)")
def _(t):
    from pyspark.sql import Window

    x = labels(t).select("library", "version").distinct()
    return x.select("library", "version", F.row_number().over(Window.partitionBy("library").orderBy(*ops.sort_columns("version"))).cast("long").alias("place"))


@query("ver_02_compare", f"WITH {_L}, {_KEYS} SELECT library, arg_max(version, (a, b, c, pre, CASE WHEN kind = 'version' THEN 1 ELSE 0 END, version)) AS newest FROM (SELECT DISTINCT * EXCLUDE (c_custkey) FROM k) WHERE kind IN ('version', 'partial') GROUP BY library".replace("version))", "CASE WHEN kind = 'version' THEN version END))"))
def _(t):
    from pyspark.sql import Window

    x = labels(t).where(ops.kind("version").isin("version", "partial")).select("library", "version").distinct()
    w = Window.partitionBy("library").orderBy(*ops.sort_columns("version"))
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("library", F.col("version").alias("newest"))


@query("ver_03_resolve")
def _(t):
    """Several requests against each library's labels; the ladder's cases are held in a test."""
    wanted = t.spark.createDataFrame([("",), ("latest",), ("1.x",), ("2",), ("3.4.0",), ("node3",)], "wanted string")
    x = labels(t)
    # six literal requests for each library
    return ops.resolve_all(x.select("library", "version"), x.select("library").distinct().crossJoin(F.broadcast(wanted)))


@query("ver_04_range", f"WITH {_L}, {_KEYS} SELECT library, count(*) AS n, max(c) AS top_patch FROM k WHERE kind = 'version' AND a = 1 AND pre = 1000000 GROUP BY library")
def _(t):
    x = labels(t).where((ops.kind("version") == "version") & F.col("version").startswith("1.") & ~F.contains("version", F.lit("-")))
    return x.groupBy("library").agg(F.count("*").alias("n"), F.max(F.regexp_extract("version", r"(\d+)$", 1).cast("int")).alias("top_patch"))


@query("ver_05_best_and_unversioned", f"WITH {_L} SELECT library, bool_or(version = '') AS unversioned FROM l GROUP BY library")
def _(t):
    return labels(t).groupBy("library").agg(F.bool_or(F.col("version") == "").alias("unversioned"))


@query("ver_06_list", f"WITH {_L} SELECT library, count(DISTINCT version) AS n FROM l WHERE version <> '' GROUP BY library")
def _(t):
    return labels(t).where("version <> ''").groupBy("library").agg(F.countDistinct("version").alias("n"))


@query("ver_07_validate_library", f"WITH {_L}, w AS (SELECT * FROM (VALUES ('lib3'), ('lib33'), ('lbi7')) v(wanted)) SELECT wanted, EXISTS (SELECT 1 FROM l WHERE library = wanted) AS known, (SELECT library FROM (SELECT DISTINCT library FROM l) ORDER BY levenshtein(library, wanted), library LIMIT 1) AS suggestion FROM w")
def _(t):
    have = labels(t).select("library").distinct()
    wanted = t.spark.createDataFrame([("lib3",), ("lib33",), ("lbi7",)], "wanted string")
    near = have.crossJoin(F.broadcast(wanted)).groupBy("wanted").agg(F.min(F.struct(F.levenshtein("library", "wanted").alias("d"), "library")).alias("b"))  # three literal names
    return near.select("wanted", (F.col("b.d") == 0).alias("known"), F.col("b.library").alias("suggestion"))


@query("ver_08_request_pattern", rf"WITH {_L} SELECT c_custkey, regexp_matches(r, '^\d+(\.(x(\.x)?|\d+(\.(x|\d+))?))?$') AS ok FROM (SELECT c_custkey, version || CASE WHEN c_custkey % 2 = 0 THEN '.x' ELSE '' END AS r FROM l)")
def _(t):
    r = F.concat("version", F.when(F.col("c_custkey") % 2 == 0, ".x").otherwise(""))
    return labels(t).select("c_custkey", r.rlike(ops.REQUEST).alias("ok"))
