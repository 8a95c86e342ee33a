"""The pipeline's stages over the smallest tables."""

import collections
import functools

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline as p
from lorebase.llm import neardup
from tests.llm.test_operators import plain_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for name, stage in p.STAGES:
        out = p.stored(stage(spark, docs, sf_dir), name)
        now = {r["doc_id"]: r for r in out.collect()}
        assert set(now) <= set(kept) and out.columns[: len(columns)] == columns and len(now) == out.count()
        if name == "near_duplicates":
            ids = sorted(kept)
            parts = plain_components([kept[i]["text"] for i in ids], 5, 80)
            assert set(now) == {i for k, i in enumerate(ids) if parts[k][1] == k}
        if name == "secret_scan":
            assert set(now) == set(kept) and all(r["n_chars"] == len(r["text"]) for r in now.values())
        if name == "source_mixing":
            assert set(now) == set(kept) and len({r["mix_position"] for r in now.values()}) == len(now)
        docs, kept = out, now
    assert 0 < len(kept) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_run(spark, sf_dir):
    assert p.run(spark, sf_dir).columns[-3:] == ["mix_block", "mix_slot", "mix_position"]
    assert neardup.TREES <= neardup.TREE_BITS


def odd_tables(spark, sf_dir, root, empty):
    """Nulls in each column, repeated rows, empty and long texts, and extra columns with the names that operators use."""
    for name in ("documents", "benchmark", "labels"):
        d = spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0 if empty else 60)
        if not empty:
            rows = [d, d.limit(5)]
            rows += [d.limit(3).withColumn(c, F.lit(None).cast(d.schema[c].dataType)) for c in d.columns]
            if "text" in d.columns:
                rows += [d.limit(2).withColumn("text", F.lit("")), d.limit(1).withColumn("text", F.expr("repeat('lorem ipsum dolor ', 4000)"))]
            d = functools.reduce(DataFrame.unionByName, rows)
        extra = [c for c in ("score", "label", "rep", "component_id", "kept", "spans", "_s", "_own0", "hits", "items", "mix_note", "n") if c not in d.columns]
        d.withColumns({c: F.lit(1) for c in extra}).write.parquet(f"{root}/{name}.parquet")


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, sf_dir, tmp_path, empty):
    odd_tables(spark, sf_dir, tmp_path, empty)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        before = collections.Counter(str(r["doc_id"]) for r in docs.collect())
        docs = p.stored(stage(spark, docs, str(tmp_path)), name)
        after = collections.Counter(str(r["doc_id"]) for r in docs.collect())
        assert docs.columns == [*columns, "mix_block", "mix_slot", "mix_position"][: None if name == "source_mixing" else len(columns)]
        assert after <= before and (name not in ("secret_scan", "source_mixing") or after == before)
        assert docs.where("score <> 1 or rep <> 1 or n <> 1").isEmpty()
    places = [r["mix_position"] for r in docs.collect()]
    assert len(set(places)) == len(places) and None not in places and (not places) == empty
