"""Graph kernels: long orders against SQL and brute force, no shuffle of pairs, tasks that don't grow."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bondframe.operators import graph as G
from bondframe.operators import kernels as K
from bondframe.plans import registry

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of 1 to 45 lines, with repeated quantities; the lines are out of order."""
    r = random.Random(3)
    rows = [(g, k + 1, r.randrange(900), k, float(r.randrange(1, 9)), float(r.randrange(1, 12)), 0.05) for g, n in enumerate([1, 2, 3, 4, 7, 23, 30, 45]) for k in range(n)]
    r.shuffle(rows)
    path = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


#: Queries whose pairs, walks or labels stay in the task that has the graph.
KERNELS = [
    "topological_charge",
    "estate_extremes",
    "autocorr_lags",
    "distance_edge",
    "balaban_index",
    "distance_indices",
    "tree_distances",
    "graph_distances",
    "walk_counts",
    "conjugated_components",
    "connectivity_indices",
    "kappa_shapes",
    "substructure_counts",
]


@pytest.mark.parametrize("name", KERNELS)
def test_long_orders_by_whole_graphs(spark, orders, name):
    df = registry.QUERIES[name](spark, orders)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("MapInArrow")[0]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{orders}/lineitem.parquet/*.parquet'")
    names = ", ".join(df.columns)
    want = con.execute(f"SELECT {names} FROM ({registry.ORACLE[name]})").fetchall()
    if name == "tree_distances":  # SQL stops at 8 bonds
        df = df.filter("d <= 8")
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in df.collect())


@pytest.mark.parametrize("name", ["connectivity_indices", "kappa_shapes", "substructure_counts"])
def test_tasks_grow_in_number_only(spark, orders, name, monkeypatch):
    monkeypatch.setattr(K, "TASK_ATOMS", 10)
    df = registry.QUERIES[name](spark, orders)
    rows = sum([1, 2, 3, 4, 7, 23, 30, 45])
    assert "hashpartitioning(l_orderkey#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {-(-rows // 10)}), REPARTITION_BY_NUM" in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{orders}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in df.collect())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    g, a, b, w = zip(*sorted(rows, key=lambda x: (x[0] is not None, x[0], x[2], x[1])))
    return pa.record_batch([pa.array(g, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64())], names=["g", "a", "b", "w"])


def test_blocks_and_batches_dont_change_results(monkeypatch):
    """Random graphs, in pieces, with lone atoms, an unknown graph, unknown values and bonds to atoms that aren't there."""
    r = random.Random(5)
    rows, far = [(None, 0, -1, 1.0), (None, 1, -1, 1.0), (None, 0, 1, None)], {}
    for g, n in enumerate([1, 5, 12, 20]):
        rows += [(g, i, -1, float(r.randrange(9)) if r.random() < 0.9 else None) for i in range(n)]
        bonds = {tuple(sorted(r.sample(range(n), 2))) for _ in range(n)} if n > 1 else set()
        rows += [(g, u, v, None) for u, v in bonds] + [(g, 0, n + 3, None)]
        d = {(i, i): 0 for i in range(n)}
        while True:
            new = {(i, k): x + 1 for (i, j), x in d.items() for u, v in bonds for a, k in ((u, v), (v, u)) if a == j and (i, k) not in d}
            if not new:
                break
            d |= {p: min(x for q, x in new.items() if q == p) for p in new}
        far |= {(g, i, j): x for (i, j), x in d.items()}
    whole = _table(rows)
    got = {}
    for cells, size in ((1 << 20, 1000), (7, 4), (1, 1)):
        monkeypatch.setattr(K, "CELLS", cells)
        batches = list(K.whole_graphs(iter([whole.slice(k, size) for k in range(0, len(whole), size)])))
        assert sorted(g for x in batches for g in x.g) == [K.NONE, 0, 1, 2, 3]
        pairs = {(int(x.g[x.of[i]]), int(x.idx[i]), int(x.idx[j])): int(n) for x in batches for p in x.pairs() for i, j, n in zip(*p)}
        assert pairs == far
        for name, run in (("charge", K.topological_charge(None)), ("auto", K.autocorrelations(4)), ("state", K.estates), ("balaban", K.balaban), ("edge", K.distance_edge(2, 2)), ("index", K.distance_indices), ("connected", K.connectivity), ("kappa", K.kappa_counts), ("path", K.path_matches((1, 2, 1)))):
            with np.errstate(all="ignore"):
                parts = [(x.g[p[0]].tolist(), *(pa.array(c).to_pylist() for c in p[1:])) for x in batches for p in run(x)]
            values = sorted(repr([round(c, 9) if isinstance(c, float) else c for c in row]) for p in parts for row in zip(*p))
            assert got.setdefault(name, values) == values


def test_a_graph_of_many_batches(spark):
    ring = spark.range(25_000).selectExpr("7L AS g", "cast(id as int) AS idx", "1.0D AS w")
    bonds = G.ring_bonds(ring)
    assert [(x.k, x.walks) for x in G.walks(ring, bonds, 3).orderBy("k").collect()] == [(k, 25_000 * 2**k) for k in (1, 2, 3)]
    assert G.components(ring, bonds).filter("comp <> 0").isEmpty()
    assert G.components(ring, bonds.filter("v <> 20000 AND u <> 0")).agg(F.count_distinct("comp")).first()[0] == 3
