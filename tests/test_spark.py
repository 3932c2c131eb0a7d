"""Featurization over tables, operators on small tables, and the registered queries against SQL."""

import math
import os
import random
import warnings

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bondframe.operators import dataflow as D
from bondframe.operators import graph as G
from bondframe.plans import registry
from bondframe.plans.featurize import _WARNED, column_set, expand_fingerprint, feature_names, featurize, parse, without_molecules
from bondframe.sources import molecules as M
from bondframe.streaming import molecules as S

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def table(spark):
    return M.from_list(spark, ["CCO", "c1ccccc1N", "[Na+].CC(=O)[O-]", "nope", "", None])


def test_errors_cost_their_own_row(table):
    rows = {r["mol_id"]: r for r in featurize(table, ["ExactMolWt", "HeavyAtomCount"], standardize="none").collect()}
    assert rows[0]["HeavyAtomCount"] == 3 and rows[0]["error"] is None
    assert all(math.isnan(rows[i]["ExactMolWt"]) and rows[i]["error"]["kind"] == "row" for i in (3, 4, 5))
    assert featurize(table, ["nC"], standardize="none", on_error="skip").count() == 3
    with pytest.raises(Exception, match="row 3|row 4|row 5"):
        featurize(table, ["nC"], standardize="none", on_error="raise").collect()
    with pytest.raises(ValueError, match="nan, raise, skip"):
        featurize(table, ["nC"], on_error="none such")
    _WARNED.clear()
    with pytest.warns(UserWarning, match="standardize"):
        featurize(table, ["nC"])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        featurize(table, ["nC"])
    with pytest.raises(TypeError, match="columns"):
        featurize(table, ["nC"], additional_descriptors=False)
    with pytest.raises(TypeError, match="no argument"):
        featurize(table, ["nC"], colums="full")


def test_projection_and_partitions_dont_change_values(table):
    full = {r["mol_id"]: r for r in featurize(table, "full", standardize="none").collect()}
    some = featurize(table.repartition(3), ["TPSA", "Lipinski", "SLogP"], standardize="none").collect()
    for r in some:
        for n in ("TPSA", "Lipinski", "SLogP"):
            a, b = r[n], full[r["mol_id"]][n]
            assert a == b or math.isnan(a) and math.isnan(b)
    assert [c for c in featurize(table, "full", standardize="none").columns if c not in ("mol_id", "smiles", "error")] == list(column_set("full"))


def test_wide_array_and_fingerprint(table):
    d = featurize(table, "minimal", standardize="none", wide=False, fingerprint=True, dtype="float")
    assert dict(d.dtypes)["features"] == "array<float>" and d.filter("size(features) <> 256").isEmpty()
    bits = expand_fingerprint(d.select("mol_id", "fp_bits"), 2048)
    assert len(bits.columns) == 2049 and bits.filter("mol_id = 3 AND ECFP_0 + ECFP_1 > 0").isEmpty()
    assert len(feature_names("small", fingerprint=True, fp_size=16)) == 408 + 16


def test_nested_graph(table):
    m = parse(table)
    assert m.select(F.size("mol.atoms")).filter("mol_id = 1").isEmpty() is False
    ring = m.filter("mol_id = 1").selectExpr("size(mol.rings) r", "size(filter(mol.atoms, a -> a.arom)) a").first()
    assert (ring.r, ring.a) == (1, 6) and m.filter("error IS NOT NULL").count() == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol\n\nc1ccccc1\tbenzene\n")
    assert sorted(r.smiles for r in M.read_smi(spark, str(tmp_path / "a.smi")).collect()) == ["CCO", "c1ccccc1"]
    (tmp_path / "d.csv").write_text("smi,y\nCC,1.5\nCO,none\n,2\n")
    assert [tuple(r)[1:] for r in M.read_labelled_csv(spark, str(tmp_path / "d.csv"), "smi", "y").collect()] == [("CC", 1.5)]
    d = featurize(M.from_list(spark, ["CC", "CO"]), ["nC"], standardize="none").select("mol_id", "nC")
    M.write_matrix(d, str(tmp_path / "m"), dtype="float")
    back = M.read_parquet(spark, str(tmp_path / "m"), smiles="nC", key="mol_id")
    assert M.check_rows(back, 2).count() == 2
    with pytest.raises(ValueError):
        M.check_rows(back, 3)
    M.write_records(d, str(tmp_path / "j"))
    assert M.skip_done(d, d.filter("mol_id = 0"), "mol_id").count() == 1
    with pytest.raises(Exception):
        M.quantize(spark.createDataFrame([(1.234,)], "s double"), "s").collect()


def test_stream(spark, tmp_path):
    M.from_list(spark, ["CCO", "nope"]).write.parquet(str(tmp_path / "in"))
    q = S.write_stream(S.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), ["nC"])
    q.awaitTermination(120)
    assert sorted(r.features[0] for r in spark.read.parquet(str(tmp_path / "out")).filter("error IS NULL").collect()) == [2.0]


def test_operators_on_odd_tables(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 4.0), (4, float("nan"))], "id long, s double")
    assert {r.id: r.r for r in D.rank_with_ties(d.filter("id < 4"), "s", "r").collect()} == {1: 2, 2: 2, 3: 3}
    assert D.top_mask(d.filter("id < 4"), "s", 1, "top").filter("top").count() == 0
    assert D.sample_without_replacement(d, "id", 2, 1).count() == 2 and D.sample_without_replacement(d.limit(0), "id", 2, 1).count() == 0
    got = D.greedy_cover([("a", "b", 0.99), ("b", "c", 0.99)], {"a": 1, "b": 2, "c": 3}, 0.95)
    assert got == {"a": "a", "b": "a", "c": "c"}
    folds = D.group_folds(spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)] * 2, "g string"), "g", 2).collect()
    assert {r.g: r.fold for r in folds} == {"x": 0, "y": 1, "z": 1}
    a = D.positional_join(d.select("id", "s"), d.filter("id <> 2").select("id", F.col("s").alias("t")), ["id"])
    with pytest.raises(Exception, match="no partner"):
        D.assert_aligned(a).collect()
    assert D.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))) is not None
    flips = D.agreement(spark.createDataFrame([(float("nan"), 1.0), (1.0, 1.0), (float("nan"), float("nan"))], "a double, b double"), "a", "b").first()
    assert (flips.n, flips.equal, flips.near, flips.nan_flips) == (3, 2, 2, 1)
    one = G.order_atoms(spark.read.parquet(f"{DATA}/lineitem.parquet").limit(0))
    assert G.autocorrelations(one, G.distances(one, G.ring_bonds(one), 3), 3).count() == 0


def _rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return (0, "")
        return (1, v) if isinstance(v, str) else (2, round(float(v), 4))

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and _rows(got) == _rows(want)


def test_public_names(spark):
    from bondframe import api

    t = M.from_list(spark, ["CCO"])
    assert len(api.featurize_all(t).columns) == 1270 + 3 and len(api.compute(t).columns) == 162 + 3 and len(api.minimal_columns()) == 256
    s = api.scaffolds(M.from_list(spark, ["Cc1ccccc1", "OCC", "nope"])).orderBy("mol_id").collect()
    assert s[0].scaffold and s[1].scaffold == "" and s[2].scaffold is None and s[0].canonical != s[1].canonical


def test_distances_in_long_orders(spark, tmp_path):
    """A ring of 20 lines is 10 bonds wide; nothing stops at the width of the small tables."""
    spark.range(20).selectExpr("1L AS l_orderkey", "id AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0D AS l_extendedprice", "1.0D AS l_quantity", "0.0D AS l_discount").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.i, r.j): r.d for r in registry.QUERIES["graph_distances"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): min(abs(i - j), 20 - abs(i - j)) for i in range(20) for j in range(20)}
    assert registry.QUERIES["distance_indices"](spark, str(tmp_path)).first().diameter == 10


def test_autocorrelations_on_the_edge_of_two_roundings(spark, tmp_path):
    """Ratios such as -0.2078125, whose doubles lie a bit off the edge, round as in SQL."""
    orders = {1: [7, 2, 20, 17, 45, 4, 17], 2: [14, 6, 27, 16, 1, 45, 6], 3: [5, 5, 5]}
    rows = [(g, k, k, k, 1.0, float(w), 0.0) for g, ws in orders.items() for k, w in enumerate(ws)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {x[:2]: tuple(x[2:]) for x in con.execute(f"SELECT g, lag, gsum, ats, aats, atsc, aatsc, mats, gats FROM ({registry.ORACLE['autocorr_lags']})").fetchall()}
    got = {(r.g, r.lag): (r.gsum, r.ats, r.aats, r.atsc, r.aatsc, r.mats, r.gats) for r in registry.QUERIES["autocorr_lags"](spark, str(tmp_path)).collect()}
    assert got == want and got[1, 1][5] == -0.207812 and got[3, 1][5] is None


def test_default_set_of_all_molecules(spark, tmp_path):
    spark.range(250).selectExpr("id AS l_orderkey", "1L AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "1.0D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry.QUERIES["molecule_default_set"](spark, str(tmp_path)).select("mol_id").distinct().count() == 250


def test_running_sums_and_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(D, "RANGE_ROWS", 40)
    r = random.Random(6)
    rows = [(k, r.randrange(25), r.randrange(9)) for k in range(300)]
    d = spark.createDataFrame(rows, "k long, score long, v long")
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    got = {x.k: x["rank"] for x in D.global_rank(d, [F.desc("score"), F.asc("k")], "rank").collect()}
    assert got == {k: i + 1 for i, (k, _, _) in enumerate(order)}
    got = {x.k: x["rank"] for x in D.rank_with_ties(d, "score", "rank").collect()}
    assert got == {k: sum(t >= s for _, t, _ in rows) for k, s, _ in rows}
    keys = sorted({r.randrange(400) for _ in range(200)})
    runs, at = [], 0
    for i, k in enumerate(keys):
        if i + 1 == len(keys) or keys[i + 1] != k + 1:
            runs.append((keys[at], k, i - at + 1))
            at = i + 1
    assert sorted(tuple(x) for x in D.islands(spark.createDataFrame([(k,) for k in keys * 2], "k long"), "k").collect()) == runs
    assert D.islands(d.limit(0), "k").count() == 0


def test_add_only_merge(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "arm long, v double")
    assert sorted(tuple(x) for x in D.merge_added(base, spark.createDataFrame([(3, 3.0)], "arm long, v double"), "arm").collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    with pytest.raises(Exception, match="there already: 2"):
        D.merge_added(base, spark.createDataFrame([(2, 9.0)], "arm long, v double"), "arm").collect()


def test_excluded_molecules(spark):
    t = M.from_list(spark, ["OCC", "c1ccccc1", "nope", "CCN"])
    assert sorted(x.smiles for x in without_molecules(t, M.from_list(spark, ["C(O)C", "NCC", "nope"])).collect()) == ["c1ccccc1", "nope"]


def test_components_of_all_pairs(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.randrange(60), r.randrange(80)) for _ in range(70)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    group = {x: x for a, b in rows for x in (a, 100_000 + b)}
    for _ in group:
        for a, b in rows:
            group[a] = group[100_000 + b] = min(group[a], group[100_000 + b])
    assert {x.node: x.grp for x in registry.QUERIES["pair_components"](spark, str(tmp_path)).collect()} == group
