"""The pipeline's stages on small tables."""

from pathlib import Path

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions.ranking import shared_dir
from coppice.llm import common, secrets, simhash


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(7001, None, None, None, 0, 1), (7002, "", "en", "s", 0, 1)], docs.schema))
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
    before, after = seen["language"]
    assert after.where("text is null or text = ''").count() == 0 and after.count() >= 0.9 * before.count()
    before, after = seen["near_duplicates"]
    n = simhash.near_duplicates(before).select("component_id").distinct().count()
    assert after.count() == n == simhash.near_duplicates(after).select("component_id").distinct().count()
    before, after = seen["secrets"]
    assert after.count() == before.count()
    assert after.select(F.max(F.size(secrets.scan_text(F.col("text"))))).first()[0] == 0
    before, after = seen["mixture"]
    assert 0 < after.count() < before.count()
    before, after = seen["packing"]
    rows = after.toPandas()
    assert set(rows.doc_id) == {r[0] for r in before.select("doc_id").collect()}
    sizes = rows.groupby("sequence_id").length.sum()
    assert (np.sort(sizes)[1:] == 4096).all()


NAMES = ("blob", "spans", "key", "rate", "topic", "mix_rate", "_blob", "Tokens", "queue", "chunk", "component_id", "fp")


@pytest.mark.parametrize("stage", range(4))
def test_columns_of_any_name_and_odd_rows(spark, sf, stage):
    """Columns that the stages' own could clash with come back as they were; null ids and empty tables are rows like others."""
    name, run = P.STAGES[stage]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({n: F.lit(f"own {n}") for n in NAMES})
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("a text that has no id but token=abcdef123 and words enough to be in english the and of this that with from")})
    docs = docs.unionByName(odd).unionByName(odd).unionByName(odd.withColumns({"text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    out = run(spark, docs, sf)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    if name != "mixture":
        assert sum(r["doc_id"] is None and r["text"] is not None for r in rows) == 2
    if name == "secrets":
        assert len(rows) == docs.count() and not any("abcdef123" in (r["text"] or "") for r in rows)
    assert run(spark, docs.limit(0), sf).count() == 0


def test_packing_of_odd_tables(spark, sf):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", None, 1), (1, "", None, 1)], "doc_id long, text string, source string, ids int")
    assert P.pack(spark, docs, sf).count() == 3 and P.pack(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    """Only the result is left of what the stages write."""
    top, made = Path(shared_dir(spark).removeprefix("file:")), common.made()
    before = set(top.glob("table-*"))
    assert P.run(spark, sf).count() > 0
    assert set(top.glob("table-*")) == before and common.made() == made
    assert [p.name for p in max(top.glob("pipeline-*"), key=lambda p: p.stat().st_mtime).iterdir()] == ["4-packing"]
