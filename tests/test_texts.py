"""Molecule queries work on each different text once, in tasks by the number of texts."""

import pytest
from pyspark.sql import functions as F

from bondframe.plans import molecules as P
from bondframe.plans import registry


def test_each_text_once(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_TEXTS", 2)
    seen = []

    def work(texts):
        seen.append((sorted(x.smiles for x in texts.collect()), texts.rdd.getNumPartitions()))
        return texts.withColumn("n", F.length("smiles"))

    rows = [(k, "C" * (k % 7 + 1)) for k in range(100)]
    got = P.each_text(spark.createDataFrame(rows, "mol_id long, smiles string"), work).collect()
    assert sorted((x.mol_id, x.smiles, x.n) for x in got) == [(k, s, len(s)) for k, s in rows]
    assert seen == [(["C" * k for k in range(1, 8)], 4)]


#: Queries whose Python sees different texts alone.
TEXTS = [
    "molecule_counts",
    "molecule_descriptors",
    "molecule_scaffolds",
    "molecule_default_set",
]


@pytest.mark.parametrize("name", TEXTS)
def test_queries_deal_texts(spark, tmp_path, monkeypatch, name):
    """40 molecules of four texts: the worker's rows are the four, in a task each."""
    spark.range(40).selectExpr("id AS l_orderkey", "1L AS l_linenumber", "id % 4 AS l_partkey", "id AS l_suppkey", "1.0D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(P, "TASK_TEXTS", 1)
    calls = []
    each = P.each_text

    def spy(molecules, work):
        return each(molecules, lambda texts: calls.append((texts.count(), texts.rdd.getNumPartitions())) or work(texts))

    monkeypatch.setattr(P, "each_text", spy)
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert calls == [(4, 4)]
    assert got.agg(F.sum("n")).first()[0] == 40 if name == "molecule_scaffolds" else got.select("mol_id").distinct().count() == got.count() == 40
