"""Ranks inside groups whose rows are in no one task."""

import random

import pytest
from pyspark.sql import functions as F

from bondframe.operators import dataflow as D
from bondframe.plans import registry

DATA = "/root/testdata/sf0.001"


def test_group_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(D, "RANGE_ROWS", 40)
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randrange(6), float(r.randrange(90)), k) for k in range(400)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "g int, a int, b double, k int").withColumn("key", F.struct("k"))
    rank = lambda g, c: {x[3]: i + 1 for i, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[c], x[3])))}
    want = sorted((str(g), ra[k], rb[k]) for g in (1, 2, None) for ra, rb in [(rank(g, 1), rank(g, 2))] for k in ra)
    assert sorted((str(x.g), x.r0, x.r1) for x in D.group_ranks(d, ["a", "b"], "g", "key").collect()) == want


@pytest.mark.parametrize("name", ["rank_correlation_min", "column_cover"])
def test_no_task_has_a_group(spark, monkeypatch, name):
    """Of 6,000 lines in seven groups no written range has more than a few hundred."""
    monkeypatch.setattr(D, "RANGE_ROWS", 200)
    most = []
    cut = D.cut

    def spy(df, kind):
        out = cut(df, kind)
        most.append(out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        return out

    want = [tuple(x) for x in registry.QUERIES[name](spark, DATA).collect()]
    monkeypatch.setattr(D, "cut", spy)
    assert [tuple(x) for x in registry.QUERIES[name](spark, DATA).collect()] == want
    assert len(most) > 2 and max(most) < 800
