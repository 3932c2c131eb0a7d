"""Components of many links: tasks by their number, keys apart, repeats and loops."""

import random

from bondframe.operators import components as C
from bondframe.operators import dataflow as D
from bondframe.plans import registry


def test_more_tasks_for_more_links(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_ROWS", 100)
    seen = set()
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df, name: (seen.add(int(spark.conf.get("spark.sql.shuffle.partitions"))), cut(df, name))[1])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    r = random.Random(2)
    rows = [(r.randrange(900), r.randrange(900)) for _ in range(600)] + [(2000, 2000), (1, None)]
    group = {x: x for p in rows if None not in p for x in p}
    for _ in group:
        before = dict(group)
        for a, b in rows:
            if b is not None:
                group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    d = spark.createDataFrame(rows, "a long, b long")
    assert {x.node: x.grp for x in D.linked_groups(d.union(d), "a", "b").collect()} == group
    assert seen == {-(-4 * len(rows) // 100)} and spark.conf.get("spark.sql.shuffle.partitions") == was


def test_large_supplier_numbers_are_no_parts(spark, tmp_path):
    rows = [(100_005, 1), (7, 5), (8, 5)]  # part 5 had the number of supplier 100,005
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x.node: x.grp for x in registry.QUERIES["pair_components"](spark, str(tmp_path)).collect()}
    assert got == {100_005: 100_005, 1_000_001: 100_005, 7: 7, 8: 7, 1_000_005: 7}
