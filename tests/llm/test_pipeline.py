"""Each stage of the pipeline on what its predecessor kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ..conftest import DATA
from .test_ops import brute_components, brute_lines

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).withColumn("extra", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, "12 34"), (9003, "")], "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    for n, (name, stage) in enumerate(pipeline.STAGES, 1):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, DATA)
        if n < len(pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(n)))
        new = spark.read.parquet(str(tmp_path / str(n)))
        after = {r.doc_id: r for r in new.collect()}
        assert set(after) <= set(before)
        if name == "language":
            assert set(before) - set(after) == {9001, 9002, 9003}
        elif name == "lines":
            gone = brute_lines([(d, r.text) for d, r in before.items()])
            for d, r in before.items():
                kept = "\n".join(x for k, x in enumerate(r.text.split("\n")) if (d, k) not in gone)
                assert (d in after) == bool(kept.strip() or not any(x == d for x, _ in gone)) and (d not in after or (after[d].text == kept and after[d].n_chars == len(kept)))
        elif name == "near_duplicates":
            root, _ = brute_components([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d in before if root[d] == d}
        elif name == "packed":
            assert set(after) == set(before)
        docs = new


def test_near_duplicates_at_four_fifths(spark):
    w = [f"w{k}" for k in range(124)]
    edited = lambda *at: " ".join(f"other{k}" if k in at else x for k, x in enumerate(w))
    rows = [(1, edited()), (2, edited(30, 60)), (3, edited(10, 50, 70, 100))]  # 110 of 130 shingles are common, 100 of 140, at most 90 of 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, DATA).collect()) == [1, 3]


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0
