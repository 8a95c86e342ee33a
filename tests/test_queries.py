"""Every query against its SQL over the smallest tables."""

import datetime
import math

import pytest

import __spark_entry__ as entry
from lorebase import registry

NAMES = sorted(registry.queries())


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, duck):
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registry.oracles().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "content", "score"]


def test_whole_texts(spark, tmp_path):
    """A run of backticks and the end of a frontmatter far behind the first characters."""
    from __spark_entry__ import queries

    far = "word " * 20
    spark.createDataFrame([(4, f"{far}`````` end"), (1, f"{far}\nkey: x\n---\nend")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["fence"] for r in queries()["str_08_fence"](spark, str(tmp_path)).collect()}[4] == "`" * 7
    assert {r["doc_id"]: r["has"] for r in queries()["spl_06_frontmatter"](spark, str(tmp_path)).collect()}[1]
