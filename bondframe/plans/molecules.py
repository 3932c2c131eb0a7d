"""Queries over molecules spelled from the test tables.

Each line of an order is a fragment with two open ends; an order's fragments
in sequence are a molecule. Sums over fragments give the expected values in
SQL, so the whole way from text to descriptor is checked against it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import elements as el
from ..lineage import cut
from ..operators.kernels import task_count
from .featurize import featurize, parse, scaffolds

#: Fragment, and its heavy atoms, rings, carbons, nitrogens, oxygens, hydrogens inside a chain.
FRAGMENTS = [
    ("C", 1, 0, 1, 0, 0, 2), ("N", 1, 0, 0, 1, 0, 1), ("O", 1, 0, 0, 0, 1, 0), ("C(=O)", 2, 0, 1, 0, 1, 0), ("C(c1ccccc1)", 7, 1, 7, 0, 0, 6),
    ("C(C)", 2, 0, 2, 0, 0, 4), ("C1CCN(CC1)", 6, 1, 5, 1, 0, 9), ("C(C#N)", 3, 0, 2, 1, 0, 1), ("C(O)", 2, 0, 1, 0, 1, 2), ("C(N)", 2, 0, 1, 1, 0, 3),
]


def order_molecules(spark: SparkSession, sf: str) -> DataFrame:
    """(mol_id, smiles): the fragments of an order's lines between two methyl groups."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    li = li.repartition(task_count(li), "l_orderkey")  # a task's lines don't grow with the table
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    f = F.array(*(F.lit(x[0]) for x in FRAGMENTS))
    frag = F.get(f, F.pmod("l_partkey", F.lit(len(FRAGMENTS))).cast("int"))
    # an order has few lines, so its text is short
    parts = li.select(F.col("l_orderkey").alias("mol_id"), F.struct(F.row_number().over(by).alias("k"), frag.alias("f")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["f"]), "")
    return parts.groupBy("mol_id").agg(F.concat(F.lit("C"), text, F.lit("C")).alias("smiles"))


#: Different texts of a task: up to half a minute's work.
TASK_TEXTS = 500


def each_text(molecules: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``molecules`` with what ``work`` makes of their texts; each different text is worked on once.

    The texts are written, so that their number is known, and dealt to tasks
    by it: their work is far more than their bytes tell.
    """
    texts = cut(molecules.select("smiles").distinct(), "texts")
    tasks = max(molecules.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // TASK_TEXTS))
    return molecules.join(work(texts.repartition(tasks, "smiles")), "smiles")


def _case(i: int) -> str:
    return "CASE l_partkey % 10 " + " ".join(f"WHEN {k} THEN {row[i]}" for k, row in enumerate(FRAGMENTS)) + " END"


_SUMS = f"s AS (SELECT l_orderkey AS mol_id, sum({_case(1)}) + 2 AS heavy, sum({_case(2)}) AS rings, sum({_case(3)}) + 2 AS c, sum({_case(4)}) AS n, sum({_case(5)}) AS o, sum({_case(6)}) + 6 AS h FROM lineitem GROUP BY 1)"


def molecule_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by native expressions over the nested graph: only the parse runs in Python."""
    z = lambda k: F.size(F.filter("mol.atoms", lambda a: a["z"] == k)).cast("bigint")
    h = F.aggregate("mol.atoms", F.lit(0).cast("bigint"), lambda s, a: s + a["nh"])
    weight = F.aggregate("mol.atoms", F.lit(0.0), lambda s, a: s + a["mass"]) + h * el.WEIGHT["H"]
    arom = F.size(F.filter("mol.bonds", lambda b: b["arom"])).cast("bigint")
    counts = {
        "n_heavy": F.size("mol.atoms").cast("bigint"), "n_rings": F.size("mol.rings").cast("bigint"),
        "n_c": z(6), "n_n": z(7), "n_o": z(8), "n_h": h, "weight": F.round(weight, 4), "n_arom_bonds": arom,
    }
    m = each_text(order_molecules(spark, sf), lambda texts: parse(texts).select("smiles", *(c.alias(n) for n, c in counts.items())))
    return m.select("mol_id", *counts)


def molecule_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors of the kernel for the same molecules."""
    cols = ["HeavyAtomCount", "RingCount", "nC", "nN", "nO", "nH", "nBonds", "HeavyAtomMolWt", "NOCount"]
    d = each_text(order_molecules(spark, sf), lambda texts: featurize(texts, cols, standardize="none"))
    return d.select("mol_id", *(F.round(c, 3).alias(c) for c in cols))


def molecule_default_set(spark: SparkSession, sf: str) -> DataFrame:
    """The default set of all molecules, in long form: a report."""

    def report(texts: DataFrame) -> DataFrame:
        d = featurize(texts, "default", standardize="none", wide=False, fingerprint=True)
        return d.select("smiles", F.size("features").alias("n_features"), F.size(F.filter("features", lambda x: F.isnan(x))).alias("n_nan"), F.size("fp_bits").alias("n_bits"))

    return each_text(order_molecules(spark, sf), report).select("mol_id", "n_features", "n_nan", "n_bits")


def molecule_scaffolds(spark: SparkSession, sf: str) -> DataFrame:
    """How many molecules share each scaffold, and in how many ways they are written."""
    d = each_text(order_molecules(spark, sf), scaffolds)
    return d.groupBy("scaffold").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("n_different"))


def smiles_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the molecules' texts and how often each occurs: a native scan."""
    tokens = F.regexp_extract_all("smiles", F.lit(r"(\[[^\]]+\]|Br|Cl|[A-Za-z]|[=#()0-9])"), F.lit(1))
    return order_molecules(spark, sf).select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_TOKENS = "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all('C' || t || 'C', '(\\[[^\\]]+\\]|Br|Cl|[A-Za-z]|[=#()0-9])', 1)) AS token FROM (SELECT string_agg(CASE l_partkey % 10 " + " ".join(f"WHEN {k} THEN '{row[0]}'" for k, row in enumerate(FRAGMENTS)) + " END, '') AS t FROM lineitem GROUP BY l_orderkey)) GROUP BY token"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (molecule_counts, molecule_descriptors, molecule_default_set, molecule_scaffolds, smiles_tokens)}
ORACLE: dict[str, str] = {
    "molecule_counts": f"WITH {_SUMS} SELECT mol_id, CAST(heavy AS BIGINT) AS n_heavy, CAST(rings AS BIGINT) AS n_rings, CAST(c AS BIGINT) AS n_c, CAST(n AS BIGINT) AS n_n, CAST(o AS BIGINT) AS n_o, CAST(h AS BIGINT) AS n_h, round(c * 12.011 + n * 14.007 + o * 15.999 + h * 1.008, 4)::DOUBLE AS weight, CAST((SELECT count(*) FROM lineitem l WHERE l.l_orderkey = mol_id AND l_partkey % 10 = 4) * 6 AS BIGINT) AS n_arom_bonds FROM s",
    "molecule_descriptors": f'WITH {_SUMS} SELECT mol_id, heavy::DOUBLE AS "HeavyAtomCount", rings::DOUBLE AS "RingCount", c::DOUBLE AS "nC", n::DOUBLE AS "nN", o::DOUBLE AS "nO", h::DOUBLE AS "nH", (heavy + rings - 1 + h)::DOUBLE AS "nBonds", round(c * 12.011 + n * 14.007 + o * 15.999, 3)::DOUBLE AS "HeavyAtomMolWt", (n + o)::DOUBLE AS "NOCount" FROM s',
    "smiles_tokens": _TOKENS,
}
