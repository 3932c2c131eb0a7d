"""Queries over the test tables, each with the SQL that gives the same rows.

Orders serve as molecules: the lines of an order are its atoms, consecutive
lines are bonded and a closing bond makes a ring (see operators.graph).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataflow as D
from ..operators import graph as G
from . import molecules as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Longest lag of the autocorrelations.
LAGS = 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null, so that engines can be compared."""
    return df.select(*((F.when(~F.isnan(c), F.round(F.col(c), digits) + 0.0).alias(c) if k == "double" else F.col(c)) for c, k in df.dtypes))


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    atoms = G.order_atoms(table(spark, sf, "lineitem"))
    return atoms, G.ring_bonds(atoms)


ATOMS = """atoms AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx,
 CAST(l_linenumber AS INT) AS z, l_quantity AS w, l_discount AS q FROM lineitem), sizes AS (SELECT g, count(*) AS n FROM atoms GROUP BY g)"""
DIST = ATOMS + """, dist AS (SELECT a.g, a.idx AS i, b.idx AS j, least(abs(a.idx - b.idx), n - abs(a.idx - b.idx)) AS d, a.z AS zi, b.z AS zj, a.w AS wi, b.w AS wj, n
 FROM atoms a JOIN atoms b ON a.g = b.g JOIN sizes s ON s.g = a.g)"""
DEG = DIST + """, deg AS (SELECT a.g, a.idx, a.z, a.w, count(d.j) AS deg FROM atoms a LEFT JOIN (SELECT * FROM dist WHERE d = 1) d ON d.g = a.g AND d.i = a.idx GROUP BY ALL),
 ends AS (SELECT b.g, b.i, b.j, x.deg AS du, y.deg AS dv FROM dist b JOIN deg x ON x.g = b.g AND x.idx = b.i JOIN deg y ON y.g = b.g AND y.idx = b.j WHERE b.d = 1 AND b.i < b.j)"""


# ---------------------------------------------------------------- order graphs


@query(f"WITH {ATOMS} SELECT g, idx, z, w, q FROM atoms")
def graph_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return G.order_atoms(table(spark, sf, "lineitem")).withColumn("idx", F.col("idx").cast("bigint"))


@query(f"WITH {DIST} SELECT g, i AS u, j AS v FROM dist WHERE d = 1 AND i < j")
def graph_bonds(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf)[1].select("g", F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))


@query(f"WITH {DIST} SELECT g, i, j, d FROM dist")
def graph_distances(spark: SparkSession, sf: str) -> DataFrame:
    return G.distances(*graph(spark, sf)).select(*(F.col(c).cast("bigint").alias(c) for c in ("g", "i", "j", "d")))


@query(f"""WITH RECURSIVE {ATOMS}, tree AS (SELECT a.g, a.idx // 2 AS u, a.idx AS v FROM atoms a WHERE a.idx >= 1 UNION SELECT g, 1, n - 1 FROM sizes WHERE n > 4),
 near AS (SELECT g, u AS a, v AS b FROM tree UNION SELECT g, v, u FROM tree),
 ways AS (SELECT g, idx AS i, idx AS j, 0 AS d FROM atoms UNION SELECT w.g, w.i, n.b, w.d + 1 FROM ways w JOIN near n ON n.g = w.g AND n.a = w.j WHERE w.d < 8)
 SELECT g, i, j, CAST(min(d) AS BIGINT) AS d FROM ways GROUP BY g, i, j""")
def tree_distances(spark: SparkSession, sf: str) -> DataFrame:
    atoms = G.order_atoms(table(spark, sf, "lineitem"))
    return G.distances(atoms, G.tree_bonds(atoms)).select(*(F.col(c).cast("bigint").alias(c) for c in ("g", "i", "j", "d")))


@query(f"""WITH {DIST}, st AS (SELECT g, count(*) AS n, avg(w) AS m, sum(w * w) AS s2, sum(w * w) - count(*) * avg(w) * avg(w) AS sq FROM atoms GROUP BY g),
 far AS (SELECT d.g, d AS lag, count(*) AS gsum, sum(wi * wj) AS ats, sum((wi - m) * (wj - m)) AS atsc, sum((wi - wj) * (wi - wj)) AS gap FROM dist d JOIN st ON st.g = d.g WHERE i < j AND d <= 7 GROUP BY d.g, d
  UNION ALL SELECT g, 0, n, s2, sq, 0 FROM st)
 SELECT far.g, lag, gsum, round(ats, 6) AS ats, round(ats / gsum, 6) AS aats, round(atsc, 6) + 0.0 AS atsc, round(atsc / gsum, 6) + 0.0 AS aatsc,
 CASE WHEN sq > 1e-9 THEN round((atsc / gsum) / (sq / n), 6) + 0.0 END AS mats, CASE WHEN sq > 1e-9 AND n > 1 THEN round((gap / (2 * gsum)) / (sq / (n - 1)), 6) END AS gats FROM far JOIN st ON st.g = far.g""")
def autocorr_lags(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = graph(spark, sf)
    out = G.autocorrelations(atoms, bonds, LAGS)
    # as SQL rounds, by the rounded product: round() goes by the digits of the value, just under an edge the other way
    out = out.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c, k in out.dtypes if k == "double"})
    out = rounded(out)
    return out.withColumn("lag", F.col("lag").cast("bigint"))


@query(f"""WITH {DEG}, a AS (SELECT g, sum(deg) AS deg_sum, sum(deg * deg) AS zagreb1, sum(CASE WHEN deg > 0 THEN pow(deg, -0.5) ELSE 0 END) AS chi0, sum(CASE WHEN deg > 0 THEN pow(deg, -2.0) END) AS mzagreb1 FROM deg GROUP BY g),
 b AS (SELECT g, count(*) AS n_bonds, sum(du * dv) AS zagreb2, sum(pow(du * dv, -0.5)) AS chi1, sum(1.0 / (du * dv)) AS mzagreb2 FROM ends GROUP BY g)
 SELECT a.g, CAST(deg_sum AS BIGINT) AS deg_sum, CAST(zagreb1 AS BIGINT) AS zagreb1, round(chi0, 6) AS chi0, round(mzagreb1, 6) AS mzagreb1, n_bonds, CAST(zagreb2 AS BIGINT) AS zagreb2, round(chi1, 6) AS chi1, round(mzagreb2, 6) AS mzagreb2 FROM a LEFT JOIN b ON a.g = b.g""")
def connectivity_indices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.connectivity(*graph(spark, sf)))


@query(f"""WITH {DIST}, e AS (SELECT g, i, max(d) AS ecc, sum(d) AS s, count(*) FILTER (WHERE d = 3) AS p3 FROM dist GROUP BY g, i)
 SELECT g, CAST(max(ecc) AS BIGINT) AS diameter, CAST(min(ecc) AS BIGINT) AS radius, CAST(sum(s) / 2 AS BIGINT) AS wpath, CAST(sum(p3) / 2 AS BIGINT) AS wpol, CASE WHEN min(ecc) > 0 THEN round((max(ecc) - min(ecc)) / min(ecc)::DOUBLE, 6) END AS shape FROM e GROUP BY g""")
def distance_indices(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = graph(spark, sf)
    out = rounded(G.distance_indices(atoms, bonds))
    return out.withColumn("diameter", F.col("diameter").cast("bigint")).withColumn("radius", F.col("radius").cast("bigint"))


@query(f"""WITH {DIST}, s AS (SELECT g, i, sum(d) AS s FROM dist GROUP BY g, i), t AS (SELECT b.g, count(*) AS m, sum(1 / sqrt(x.s * y.s)) AS t FROM dist b JOIN s x ON x.g = b.g AND x.i = b.i JOIN s y ON y.g = b.g AND y.i = b.j WHERE b.d = 1 AND b.i < b.j GROUP BY b.g)
 SELECT sizes.g, round(CASE WHEN m IS NULL OR m - n + 2 = 0 THEN 0 ELSE m / (m - n + 2)::DOUBLE * t END, 6) AS balaban_j FROM sizes LEFT JOIN t ON t.g = sizes.g""")
def balaban_index(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = graph(spark, sf)
    return rounded(G.balaban(atoms, bonds))


@query(f"""WITH {DIST}, m AS (SELECT a.g, a.i, b.j, sum(CASE WHEN b.d > 0 THEN 1.0 / (b.d * b.d) ELSE 0 END) AS m FROM dist a JOIN dist b ON a.g = b.g AND a.j = b.i WHERE a.d = 1 GROUP BY a.g, a.i, b.j)
 SELECT d.g, d.d AS lag, round(sum(abs(x.m - y.m)), 6) AS ggi, round(avg(abs(x.m - y.m)), 6) AS jgi FROM dist d JOIN m x ON x.g = d.g AND x.i = d.i AND x.j = d.j JOIN m y ON y.g = d.g AND y.i = d.j AND y.j = d.i WHERE d.i > d.j GROUP BY d.g, d.d""")
def topological_charge(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = graph(spark, sf)
    return rounded(G.topological_charge(atoms, bonds)).withColumn("lag", F.col("lag").cast("bigint"))


@query(f"""WITH RECURSIVE {DIST}, near AS (SELECT g, i AS a, j AS b FROM dist WHERE d = 1), w AS (SELECT g, idx, 1::BIGINT AS c, 0 AS k FROM atoms UNION ALL SELECT w.g, n.a, w.c, w.k + 1 FROM w JOIN near n ON n.g = w.g AND n.b = w.idx WHERE w.k < 5)
 SELECT g, k, CAST(sum(c) AS BIGINT) AS walks FROM w WHERE k > 0 GROUP BY g, k""")
def walk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.walks(*graph(spark, sf), 5)


@query(f"""WITH {ATOMS}, c AS (SELECT g, z, count(*) AS c FROM atoms GROUP BY g, z) SELECT c.g, round(-sum(c / n::DOUBLE * log2(c / n::DOUBLE)), 6) + 0.0 AS ic0, round(log2(max(n)) + sum(c / n::DOUBLE * log2(c / n::DOUBLE)), 6) + 0.0 AS cic0, round(-sum(c * z * (c / n::DOUBLE) * log2(c / n::DOUBLE)), 6) + 0.0 AS zmic0 FROM c JOIN sizes s ON s.g = c.g GROUP BY c.g""")
def information_content(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.entropy(graph(spark, sf)[0]))


@query(f"WITH {ATOMS} SELECT g, CAST((q >= 0.02)::INT + (q >= 0.05)::INT + (q >= 0.08)::INT AS BIGINT) AS bin, sum(w) AS total FROM atoms GROUP BY ALL")
def binned_sums(spark: SparkSession, sf: str) -> DataFrame:
    return G.bin_sums(graph(spark, sf)[0], "q", [0.02, 0.05, 0.08], "w").withColumn("bin", F.col("bin").cast("bigint"))


@query(f"""WITH {DIST}, s AS (SELECT g, i, max(wi) + sum(CASE WHEN i <> j THEN (wi - wj) / ((d + 1.0) * (d + 1.0)) ELSE 0 END) AS s FROM dist GROUP BY g, i)
 SELECT g, round(max(s), 6) AS s_max, round(min(s), 6) AS s_min, round(max(abs(s)), 6) AS s_absmax, round(min(abs(s)), 6) AS s_absmin FROM s GROUP BY g""")
def estate_extremes(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = graph(spark, sf)
    return rounded(G.estates(atoms, bonds))


@query(f"""WITH {ATOMS}, c AS (SELECT g, q - 0.05 AS q FROM atoms) SELECT g, round(coalesce(max(q) FILTER (WHERE q > 0) / sum(q) FILTER (WHERE q > 0), 0), 6) AS rpcg, round(coalesce(min(q) FILTER (WHERE q < 0) / sum(q) FILTER (WHERE q < 0), 0), 6) AS rncg FROM c GROUP BY g""")
def relative_charges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.charge_extremes(graph(spark, sf)[0]))


@query(f"""WITH {DEG}, p AS (SELECT d.g, count(*) AS n, sum(ln(d.d)) AS l FROM dist d JOIN deg x ON x.g = d.g AND x.idx = d.i JOIN deg y ON y.g = d.g AND y.idx = d.j WHERE d.i < d.j AND x.deg = 2 AND y.deg = 2 GROUP BY d.g)
 SELECT s.g, round(p.n / exp(l / p.n), 6) AS mde FROM sizes s LEFT JOIN p ON p.g = s.g""")
def distance_edge(spark: SparkSession, sf: str) -> DataFrame:
    atoms, bonds = graph(spark, sf)
    return rounded(G.distance_edge(atoms, bonds, 2, 2))


@query(f"""WITH {ATOMS}, c AS (SELECT *, sum(CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY idx) AS b FROM atoms) SELECT g, idx, min(idx) OVER (PARTITION BY g, b) AS comp FROM c""")
def conjugated_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the chain whose bonds lead to an atom with z not divisible by 3."""
    atoms = G.order_atoms(table(spark, sf, "lineitem"))
    chain = atoms.filter("idx >= 1 AND z % 3 <> 0").select("g", (F.col("idx") - 1).alias("u"), F.col("idx").alias("v"))
    out = G.components(atoms, chain)
    return out.select("g", F.col("idx").cast("bigint").alias("idx"), F.col("comp").cast("bigint").alias("comp"))


@query(f"""WITH {DIST} SELECT a.g, count(DISTINCT list_sort([a.j, a.i, b.j])) AS n_matches FROM dist a JOIN dist b ON a.g = b.g AND a.i = b.i WHERE a.d = 1 AND b.d = 1 AND a.j <> b.j AND a.zj = 1 AND a.zi = 2 AND b.zj = 3 GROUP BY a.g""")
def substructure_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.path_matches(*graph(spark, sf), (1, 2, 3))


@query(f"""WITH {ATOMS} SELECT g, count(*) AS n_atoms, count(*) FILTER (WHERE z = 1) AS n_z1, count(*) FILTER (WHERE z = 2) AS n_z2, count(*) FILTER (WHERE z = 3) AS n_z3, count(*) FILTER (WHERE z = 4) AS n_z4, sum(w) AS weight, count(*) FILTER (WHERE z <> 1 AND w > 10) AS n_heavy,
 CAST(count(*) FILTER (WHERE z = 3) <= 5 AND count(*) FILTER (WHERE z = 1) <= 10 AND sum(w) <= 500 AS INT) AS rule FROM atoms GROUP BY g""")
def constitution_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.constitution(graph(spark, sf)[0])


@query(f"""WITH {DEG}, k AS (SELECT g, count(*) AS a, sum(deg) / 2.0 AS p1, sum(deg * (deg - 1)) / 2.0 AS p2 FROM deg GROUP BY g)
 SELECT g, CASE WHEN p1 > 0 THEN round(a * (a - 1) * (a - 1) / (p1 * p1)::DOUBLE, 6) END AS kappa1, CASE WHEN p2 > 0 THEN round((a - 1) * (a - 2) * (a - 2) / (p2 * p2)::DOUBLE, 6) END AS kappa2 FROM k""")
def kappa_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.kappa_shapes(*graph(spark, sf)))


# ---------------------------------------------------------------- rankings and metrics

LINES = "l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS id FROM lineitem)"


def keyed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a true score (total price) and a predicted one (a reading of the key)."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("y"), (F.round("o_totalprice", -3) + F.pmod("o_orderkey", F.lit(7)) * 1000).alias("p"), F.col("o_orderpriority").alias("grp"))


ORDERS = "o AS (SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS y, round(o_totalprice, -3) + (o_orderkey % 7) * 1000 AS p, o_orderpriority AS grp FROM orders)"


@query("WITH r AS (SELECT l_orderkey, l_quantity, count(*) OVER (ORDER BY l_quantity DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk FROM lineitem) SELECT l_quantity, count(*) AS n, CAST(max(rk) AS BIGINT) AS last_rank, max(rk) <= 1500 AS kept FROM r GROUP BY l_quantity")
def topk_pessimistic(spark: SparkSession, sf: str) -> DataFrame:
    r = D.rank_with_ties(table(spark, sf, "lineitem").select("l_quantity"), "l_quantity", "rk")
    return r.groupBy("l_quantity").agg(F.count("*").alias("n"), F.max("rk").alias("last_rank"), (F.max("rk") <= 1500).alias("kept"))


@query(f"""WITH {ORDERS}, n AS (SELECT floor(0.05 * count(*)) AS k FROM o), r AS (SELECT count(*) OVER (ORDER BY y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ry, count(*) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rp FROM o)
 SELECT count(*) FILTER (WHERE ry <= k AND rp <= k) AS hits, CAST(max(k) AS BIGINT) AS k, round(count(*) FILTER (WHERE ry <= k AND rp <= k) / max(k), 6) AS recovery FROM r, n""")
def recovery_at_fraction(spark: SparkSession, sf: str) -> DataFrame:
    o = keyed_orders(spark, sf)
    return rounded(D.recovery(o, "y", "p", 0.05, o.count())).withColumn("k", F.col("k").cast("bigint"))


@query(f"""WITH {ORDERS}, m AS (SELECT count(*) AS n FROM o), t AS (SELECT *, count(*) OVER (ORDER BY y DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100 AS hit, row_number() OVER (ORDER BY p DESC, id) AS rk FROM o),
 c AS (SELECT pt, (SELECT count(*) FROM t WHERE hit AND rk <= pt) / 100.0 AS y, log10(pt / (SELECT n FROM m)::DOUBLE) AS x FROM (VALUES (1), (3), (10), (30), (100), (300), (1000)) v(pt)), e AS (SELECT *, least(pt, 100) / 100.0 AS i, pt / (SELECT n FROM m)::DOUBLE AS r FROM c),
 s AS (SELECT (y + lag(y) OVER w) / 2 * (x - lag(x) OVER w) AS a, (i + lag(i) OVER w) / 2 * (x - lag(x) OVER w) AS ai, (r + lag(r) OVER w) / 2 * (x - lag(x) OVER w) AS ar FROM e WINDOW w AS (ORDER BY pt))
 SELECT round(sum(a), 6) AS area, round(sum(ai), 6) AS ideal, round(sum(ar), 6) AS random, round((sum(a) - sum(ar)) / (sum(ai) - sum(ar)), 6) AS normalised FROM s""")
def log_auc(spark: SparkSession, sf: str) -> DataFrame:
    o = keyed_orders(spark, sf)
    return rounded(D.log_auc(o, "id", "y", "p", 100, [1, 3, 10, 30, 100, 300, 1000], o.count()))


@query("WITH p AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, max(n) AS largest_tie, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS tied_rows FROM p")
def tie_report(spark: SparkSession, sf: str) -> DataFrame:
    return D.tie_report(table(spark, sf, "lineitem"), "l_quantity")


@query(f"WITH {ORDERS} SELECT grp, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(sqrt(avg((p - y) * (p - y))) / stddev_pop(y), 6) AS rmse_sd, round(corr(y, p), 6) AS pearson, round(1 - sum((p - y) * (p - y)) / (count(*) * var_pop(y)), 6) AS r2 FROM o GROUP BY grp")
def regression_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = D.regression_scores(keyed_orders(spark, sf), "y", "p", "grp")
    return rounded(out.withColumn("rmse", F.round("rmse", 4)))


@query("SELECT o_orderpriority AS arm, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def replicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("arm"))
    return o.agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query("WITH a AS (SELECT l_shipmode_day AS ds, l_linenumber AS arm, avg(l_extendedprice) AS m FROM (SELECT l_orderkey % 28 AS l_shipmode_day, l_linenumber, l_extendedprice FROM lineitem) GROUP BY 1, 2) SELECT x.ds, x.arm, round(x.m - y.m, 4) + 0.0 AS delta FROM a x JOIN a y ON x.ds = y.ds AND y.arm = 1 WHERE x.arm <> 1")
def delta_to_anchor(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(28)).alias("ds"), F.col("l_linenumber").alias("arm")).agg(F.avg("l_extendedprice").alias("m"))
    anchor = a.filter("arm = 1").select("ds", F.col("m").alias("m0"))
    return rounded(a.filter("arm <> 1").join(anchor, "ds").select("ds", "arm", (F.col("m") - F.col("m0")).alias("delta")), 4)


@query("WITH r AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_size ORDER BY avg(p_retailprice) DESC, p_brand) AS rk FROM part GROUP BY p_brand, p_size) SELECT p_brand, count(*) FILTER (WHERE rk <= 5) AS n_top, round(avg(rk), 6) AS mean_rank FROM r GROUP BY p_brand HAVING count(*) FILTER (WHERE rk <= 5) >= 3")
def top_membership(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    r = p.withColumn("rk", F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("m"), "p_brand")))
    return rounded(r.groupBy("p_brand").agg(F.count_if(F.col("rk") <= 5).alias("n_top"), F.avg("rk").alias("mean_rank")).filter("n_top >= 3"))


@query("WITH c AS (SELECT p_brand AS arm, avg(p_size) AS cost, avg(p_retailprice) AS err FROM part GROUP BY 1) SELECT arm, round(cost, 6) AS cost, round(err, 6) AS err FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.cost <= c.cost AND o.err <= c.err AND o.arm <> c.arm)")
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("arm")).agg(F.avg("p_size").alias("cost"), F.avg("p_retailprice").alias("err"))
    return rounded(D.pareto(c, "cost", "err"))


@query("""WITH s AS (SELECT s_suppkey - 1 AS id, s_acctbal AS v FROM supplier), m AS (SELECT count(*) AS n FROM s), pk AS (SELECT draw, CAST(floor(CAST(concat('0x', substr(md5(concat('7:', draw, '-', i)), 1, 13)) AS BIGINT) / pow(2.0, 52) * n) AS BIGINT) AS id FROM m, range(0, 20) d(draw), (SELECT unnest(range(n)) AS i FROM m) e)
 SELECT CAST(draw AS INT) AS draw, round(median(v), 6) AS median FROM pk JOIN s USING (id) GROUP BY draw""")
def bootstrap_medians(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") - 1).alias("id"), F.col("s_acctbal").alias("v"))
    return rounded(D.bootstrap_median(s, "id", "v", 20, s.count(), 7))


@query("WITH q AS (SELECT CAST(rint_q AS BIGINT) AS q, count(*) AS n FROM (SELECT round(l_discount * 100) AS rint_q FROM lineitem) GROUP BY 1), c AS (SELECT q, n, sum(n) OVER (ORDER BY q) AS cum FROM q) SELECT q, n, CAST(cum AS BIGINT) AS cum, cum > (SELECT floor(0.25 * sum(n)) FROM q) AS above FROM c")
def histogram_threshold(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from ..sources.molecules import quantize

    h = quantize(table(spark, sf, "lineitem").select("l_discount"), "l_discount").groupBy(F.col("q").cast("bigint").alias("q")).agg(F.count("*").alias("n"))
    total = h.agg(F.floor(F.sum("n") * 0.25).alias("t"))
    cum = F.sum("n").over(Window.orderBy("q"))  # one row for each of at most 65,536 steps
    return h.withColumn("cum", cum).crossJoin(F.broadcast(total)).select("q", "n", "cum", (F.col("cum") > F.col("t")).alias("above"))  # total is one row


@query(f"WITH {LINES} SELECT id // 1000 AS block, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM l GROUP BY 1")
def rowgroup_spread(spark: SparkSession, sf: str) -> DataFrame:
    o = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").withColumn("k", -F.col("l_orderkey"))
    r = D.global_rank(li, [F.col(c).asc() for c in o], "rank")
    return r.groupBy(F.expr("(rank - 1) div 1000").alias("block")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count("*").alias("n"))


# ---------------------------------------------------------------- joins and sets


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_partkey <= 60)")
def novel_scaffolds(spark: SparkSession, sf: str) -> DataFrame:
    """Usable rows whose group isn't among the training groups."""
    p = table(spark, sf, "part")
    train = p.filter("p_size = 1 AND p_partkey <= 60").select("p_brand").distinct()
    return p.filter("p_size > 10").join(train, "p_brand", "left_anti").select("p_partkey", "p_brand")


@query("WITH a AS (SELECT o_custkey AS shard, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS pos, o_totalprice AS y FROM orders), b AS (SELECT o_custkey AS shard, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS pos, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'P') SELECT coalesce(a.shard, b.shard) AS shard, coalesce(a.pos, b.pos) AS pos, y, p, (a.pos IS NOT NULL AND b.pos IS NOT NULL) AS aligned FROM a FULL JOIN b ON a.shard = b.shard AND a.pos = b.pos")
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    place = lambda df, *by: df.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by)).cast("bigint")).withColumnRenamed("o_custkey", "shard")
    a = place(o, "o_orderkey", "o_totalprice").select("shard", "pos", F.col("o_totalprice").alias("y"))
    b = place(o.filter("o_orderstatus <> 'P'"), "o_totalprice", "o_orderkey").select("shard", "pos", F.col("o_totalprice").alias("p"))
    return D.positional_join(a, b, ["shard", "pos"]).select("shard", "pos", "y", "p", "aligned")


SPANS = "sh AS (SELECT o_orderkey % 16 AS shard, count(*) AS size FROM orders GROUP BY 1), sp AS (SELECT shard, size, coalesce(sum(size) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sh)"


@query(f"WITH {SPANS} SELECT c_custkey AS id, shard, CAST(c_custkey - start AS BIGINT) AS local FROM customer JOIN sp ON c_custkey >= start AND c_custkey < start + size")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "orders").groupBy(F.pmod("o_orderkey", F.lit(16)).alias("shard")).agg(F.count("*").alias("size"))
    hit = D.locate(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", D.exclusive_sums(sizes, "shard", "size"))
    return hit.select("id", "shard", "local")


@query(f"WITH {SPANS} SELECT shard, size, CAST(start AS BIGINT) AS start FROM sp")
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "orders").groupBy(F.pmod("o_orderkey", F.lit(16)).alias("shard")).agg(F.count("*").alias("size"))
    return D.exclusive_sums(sizes, "shard", "size")


@query("WITH a AS (SELECT DISTINCT p_brand AS name FROM part), b AS (SELECT DISTINCT lower(p_brand) AS name, p_type FROM part WHERE p_size < 5) SELECT a.name, b.p_type FROM a JOIN b ON lower(a.name) = b.name")
def alias_join(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    b = p.filter("p_size < 5").select(F.lower("p_brand").alias("low"), "p_type").distinct()
    return p.select(F.col("p_brand").alias("name")).distinct().join(b, F.lower("name") == F.col("low")).select("name", "p_type")


@query("SELECT s_suppkey AS arm, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, -s_acctbal FROM supplier WHERE s_suppkey % 3 = 0")
def guarded_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("arm"), F.col("s_acctbal").alias("v"))
    return D.merge_new(s, s.filter("arm % 3 = 0").withColumn("v", -F.col("v")), "arm")


@query("WITH e AS (SELECT DISTINCT l_partkey AS a, l_orderkey % 40 AS b FROM lineitem WHERE l_quantity >= 49) SELECT count(DISTINCT a) AS n_nodes, count(DISTINCT b) AS n_hubs, count(*) AS n_links FROM e")
def pair_links(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("a"), F.pmod("l_orderkey", F.lit(40)).alias("b")).distinct()
    return e.agg(F.count_distinct("a").alias("n_nodes"), F.count_distinct("b").alias("n_hubs"), F.count("*").alias("n_links"))


@query()
def pair_components(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that share a member, directly or by others, are one group: no group is split. A recursive SQL over the whole table doesn't end."""
    li = table(spark, sf, "lineitem")
    apart = max(100_000, 10 ** len(str(li.agg(F.max("l_suppkey")).first()[0] or 0)))  # numbers of parts start beyond those of suppliers
    e = li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + apart).alias("b"))
    return D.linked_groups(e, "a", "b")


@query("SELECT l_orderkey, CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS x FROM lineitem WHERE l_linenumber = 1")
def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_discount", "l_tax"))
    return rounded(D.finite(table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", x.alias("x")), "x"))


@query()
def column_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Columns absorbed by cheaper ones that rank alike; sequential, over the pairs of a few columns."""
    o = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").withColumn("k", F.struct(*o)).withColumn("twice", F.col("l_extendedprice") * 2)
    cols = ["l_quantity", "l_extendedprice", "twice", "l_discount"]
    at = [(i, j) for i in range(len(cols)) for j in range(i)]
    rho = D.least_correlations(D.group_ranks(li, cols, "l_linenumber", "k"), [(f"r{i}", f"r{j}") for i, j in at], "l_linenumber").first()
    pairs = [(cols[i], cols[j], rho[f"rho_{k}"]) for k, (i, j) in enumerate(at)]
    kept = D.greedy_cover(pairs, {c: float(i) for i, c in enumerate(cols)}, 0.99)
    return spark.createDataFrame(sorted(kept.items()), "name string, survivor string")


@query("WITH ids AS (SELECT DISTINCT l_suppkey * 3 + l_linenumber AS k FROM lineitem WHERE l_quantity > 45), g AS (SELECT k, k - row_number() OVER (ORDER BY k) AS r FROM ids) SELECT min(k) AS lo, max(k) AS hi, count(*) AS n FROM g GROUP BY r")
def shard_islands(spark: SparkSession, sf: str) -> DataFrame:
    return D.islands(table(spark, sf, "lineitem").filter("l_quantity > 45").select((F.col("l_suppkey") * 3 + F.col("l_linenumber")).alias("k")), "k")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity = 50 INTERSECT SELECT p_partkey FROM part WHERE p_size <= 25")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("k")).intersect(table(spark, sf, "part").filter("p_size <= 25").select("p_partkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 420000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 50000")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    have, live = o.filter("o_totalprice > 420000").select("o_custkey"), o.filter("o_orderstatus = 'P' AND o_totalprice < 50000").select("o_custkey")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(have).subtract(live)


@query("SELECT l_orderkey AS id, bool_and(l_quantity > 5 OR l_discount > 0.02) AS ok FROM lineitem GROUP BY 1")
def mask_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min((F.col("l_quantity") > 5) | (F.col("l_discount") > 0.02)).alias("ok"))


@query("SELECT p_name AS name, min(tier) AS tier, min(seq) AS seq FROM (SELECT p_name, 1 AS tier, p_partkey AS seq FROM part WHERE p_size > 20 UNION ALL SELECT p_name, 0, p_partkey + 100000 FROM part WHERE p_size % 2 = 0) GROUP BY 1")
def merged_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    a = p.filter("p_size > 20").select(F.col("p_name").alias("name"), F.lit(1).alias("tier"), F.col("p_partkey").alias("seq"))
    b = p.filter("p_size % 2 = 0").select("p_name", F.lit(0), F.col("p_partkey") + 100000)
    return a.union(b).groupBy("name").agg(F.min("tier").alias("tier"), F.min("seq").alias("seq"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return D.first_seen(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"), "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("""WITH b AS (SELECT o_custkey % 64 AS b, sha256(string_agg(o_custkey::VARCHAR, ',' ORDER BY o_custkey)) AS s FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY 1) SELECT sha256(string_agg(s, ',' ORDER BY b)) AS digest FROM b""")
def frozen_digest(spark: SparkSession, sf: str) -> DataFrame:
    return D.digest(table(spark, sf, "orders").select("o_custkey"), "o_custkey")


# ---------------------------------------------------------------- draws and splits


def sql_draw(seed: int, key: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat('{seed}:', {key})), 1, 13)) AS BIGINT) / pow(2.0, 52))"


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql_draw(5, 'o_orderkey')}, o_orderkey LIMIT 500")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return D.sample_without_replacement(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 5)


@query(f"SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {sql_draw(3, 'p_partkey')}, p_partkey) AS r FROM part) WHERE r <= 3")
def depth_limited_pick(spark: SparkSession, sf: str) -> DataFrame:
    return D.pick_per_group(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 3, 3)


@query(f"(SELECT o_orderkey, 'top' AS part FROM orders WHERE o_totalprice <= 30000 ORDER BY {sql_draw(11, 'o_orderkey')}, o_orderkey LIMIT 80) UNION ALL (SELECT o_orderkey, 'rest' FROM orders WHERE o_totalprice > 30000 ORDER BY {sql_draw(12, 'o_orderkey')}, o_orderkey LIMIT 20)")
def stratified_draw(spark: SparkSession, sf: str) -> DataFrame:
    return D.stratified_draw(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 30000.0, 80, 20, 11).select("o_orderkey", "part")


@query(f"SELECT p_partkey, stratum FROM (SELECT p_partkey, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {sql_draw(2, 'p_partkey')}, p_partkey) AS r FROM (SELECT p_partkey, (p_size >= 15)::INT + (p_size >= 25)::INT + (p_size >= 35)::INT + (p_size >= 45)::INT AS stratum FROM part)) WHERE r <= 40")
def stratified_corpus(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", D.stratum(F.col("p_size"), [15, 25, 35, 45]).alias("stratum"))
    return D.pick_per_group(p, "stratum", "p_partkey", 40, 2)


@query(f"SELECT p_partkey, p_brand, CASE WHEN {sql_draw(9, 'p_brand')} < 0.9 THEN 'train' ELSE 'validation' END AS part FROM part")
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return D.group_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 0.9, 9)


@query()
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Whole groups packed to five folds; sequential, so tests hold it against its definition."""
    return D.group_folds(table(spark, sf, "part"), "p_brand", 5)


@query("""WITH s AS (SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1), e AS (SELECT grp, n / (SELECT sum(n) FROM s)::DOUBLE * 120 AS e FROM s), q AS (SELECT grp, e, greatest(1, floor(e)) AS q FROM e), r AS (SELECT *, row_number() OVER (ORDER BY e - floor(e) DESC, grp) AS r, 120 - sum(q) OVER () AS gap FROM q)
 SELECT grp, CAST(q + CASE WHEN r <= gap THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def proportional_quota(spark: SparkSession, sf: str) -> DataFrame:
    return D.quota(table(spark, sf, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n")), "grp", "n", 120)


# ---------------------------------------------------------------- columns

COLS = ["l_quantity", "l_discount", "l_tax"]
CELLS = "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value FROM lineitem" for c in COLS) + ")"


@query(f"WITH {CELLS}, p AS (SELECT name, value, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS r, sum(n) OVER (PARTITION BY name) AS t FROM p) SELECT name, value AS mode, round(n / t::DOUBLE, 6) AS share FROM r WHERE r = 1")
def modal_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.modal(D.long_columns(table(spark, sf, "lineitem"), COLS)))


@query(f"WITH {CELLS}, p AS (SELECT name, value, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT name, max(n) / sum(n)::DOUBLE AS share FROM p GROUP BY name) SELECT c.name, (stddev_pop(value) > 0 AND max(share) <= 0.999) AS usable FROM c JOIN m ON m.name = c.name GROUP BY c.name")
def usability_gate(spark: SparkSession, sf: str) -> DataFrame:
    return D.usable(D.long_columns(table(spark, sf, "lineitem"), COLS))


@query(f"WITH {LINES}, r AS (SELECT l_linenumber AS s, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_quantity, id) AS ra, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice, id) AS rb FROM l), k AS (SELECT s, count(*) AS n, abs(corr(ra, rb)) AS r FROM r GROUP BY s) SELECT round(min(CASE WHEN n >= 30 THEN coalesce(r, 0) ELSE 0 END), 6) AS rho_min, count(*) AS n_groups FROM k")
def rank_correlation_min(spark: SparkSession, sf: str) -> DataFrame:
    o = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").withColumn("k", F.struct(*o))
    return rounded(D.rank_correlation(li, "l_quantity", "l_extendedprice", "l_linenumber", "k"))


@query("SELECT round(count(*) FILTER (WHERE l_discount <> 0.05 AND l_tax <> 0.02) / count(*) FILTER (WHERE l_discount <> 0.05 OR l_tax <> 0.02)::DOUBLE, 6) AS jaccard, count(*) FILTER (WHERE l_discount <> 0.05 AND l_tax <> 0.02) AS both, count(*) FILTER (WHERE l_discount <> 0.05 OR l_tax <> 0.02) AS either FROM lineitem")
def support_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.support_overlap(table(spark, sf, "lineitem"), F.col("l_discount") != 0.05, F.col("l_tax") != 0.02))


@query("WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_orderkey % 10 <> 0) SELECT l_orderkey, round(sum((l_quantity - m) / s), 5) + 0.0 AS z FROM lineitem, f WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey")
def standardized_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    fit = D.standardize_fit(li.filter("l_orderkey % 10 <> 0"), ["l_quantity"])
    out = D.standardize_apply(li.filter("l_orderkey % 10 = 0"), fit, ["l_quantity"])
    return rounded(out.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("z")), 5)


@query("WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.id AS a, b.id AS b, round(1 - list_cosine_similarity(a.x, b.x), 5) + 0.0 AS cosine FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id WHERE a.id % 50 = 0")
def cosine_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of the vectors with an id divisible by 50, the queries, from all others of their label."""
    return rounded(D.cosine_pairs(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", F.col("vec_id") % 50 == 0), 5)


@query("WITH s AS (SELECT label, k, sum(v::DOUBLE) AS s FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k), d AS (SELECT vec_id, e.label, sum(v::DOUBLE * (s.s - v::DOUBLE)) AS dot FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) e JOIN s ON s.label = e.label AND s.k = e.k GROUP BY vec_id, e.label) SELECT label, count(*) AS n, round(avg((dot > 0)::INT), 6) AS consistency FROM d GROUP BY label")
def loo_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """How often a vector points the way of the sum of the others of its label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))
    s = e.groupBy("label", "k").agg(F.sum("v").alias("s"))
    dot = e.join(s, ["label", "k"]).groupBy("vec_id", "label").agg(F.sum(F.col("v") * (F.col("s") - F.col("v"))).alias("dot"))
    return rounded(dot.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("dot") > 0).cast("int")).alias("consistency")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS equal, count(*) FILTER (WHERE abs(a - b) <= greatest(abs(a), abs(b), 1e-300) * 1e-9) AS near, 0::BIGINT AS nan_flips FROM (SELECT l_extendedprice AS a, CASE WHEN l_orderkey % 5 = 0 THEN l_extendedprice * (1 + 1e-12) WHEN l_orderkey % 7 = 0 THEN l_extendedprice + 1 ELSE l_extendedprice END AS b FROM lineitem)")
def column_agreement(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_extendedprice")
    b = F.when(F.col("l_orderkey") % 5 == 0, x * (1 + 1e-12)).when(F.col("l_orderkey") % 7 == 0, x + 1).otherwise(x)
    return D.agreement(table(spark, sf, "lineitem").select(x.alias("a"), b.alias("b")), "a", "b")


@query("WITH v AS (SELECT l_partkey AS id, l_linenumber AS variant, l_extendedprice / l_quantity AS x FROM lineitem WHERE l_linenumber <= 2), m AS (SELECT id, max(x) - min(x) AS d FROM v GROUP BY id) SELECT round(max(d) / (SELECT stddev_pop(x) FROM v), 5) AS worst, count(*) FILTER (WHERE d > 1e-6) AS moved FROM m")
def notation_stability(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "lineitem").filter("l_linenumber <= 2").select(F.col("l_partkey").alias("id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    m = v.groupBy("id").agg((F.max("x") - F.min("x")).alias("d")).agg(F.max("d").alias("d"), F.count_if(F.col("d") > 1e-6).alias("moved"))
    return rounded(m.crossJoin(F.broadcast(v.agg(F.stddev_pop("x").alias("sd")))).select((F.col("d") / F.col("sd")).alias("worst"), "moved"), 5)  # both are one row


QUERIES |= M.QUERIES
ORACLE |= M.ORACLE
