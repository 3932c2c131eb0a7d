"""Shared helpers: connected components, columns by name, unions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators.components import components  # noqa: F401


#: Rows of a narrow table that are broadcast at most.
SMALL_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """A table of a few numbers a row, broadcast if it has SMALL_ROWS rows at most; a larger one is joined by shuffle.

    The count of a written table comes from the files' footers; the table's
    size in a join is so known before it, and bounded by some ten MB.
    """
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


#: Members up to which a table entry gives all its pairs at once.
SMALL = 16
#: Heads that a larger entry's members are compared with before the pairs still open are spelled out.
HEADS = 2
#: Members of a block of a large entry, about: two blocks at a time meet in a task.
TILE = 256


def shared_entries(probes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of (entry, h1, size), repeats allowed: the pairs (a, b) of entries of two rows, and (entry, n, h1, size) of the larger ones.

    Entries that hold one h1 alone are left out; size belongs to h1.
    """
    met = cut(probes.groupBy("entry").agg(F.count("*").alias("n"), F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b"), f"{name}-met")
    many = probes.join(small(met.filter("n > 2").select("entry")), "entry").groupBy("entry", "h1").agg(F.min("size").alias("size"))
    many = cut(many, f"{name}-members")
    counts = small(cut(many.groupBy("entry").agg(F.count("*").alias("n")), f"{name}-counts"))
    return met.filter("n = 2").select("a", "b"), many.join(counts, "entry").select("entry", "n", "h1", "size")


def _across(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs that ``links`` doesn't connect."""
    known = components(links, "a", "b")
    side = lambda z: known.select(F.col("node").alias(z), F.col("component").alias(f"c{z}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def decided_links(two: DataFrame, many: DataFrame, prove: Callable[[DataFrame], DataFrame], name: str, ratio: float, measures: tuple[str, ...] = ("{}",), meet: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) that connect what the similar pairs of ``shared_entries`` connect.

    ``prove`` keeps the similar ones of some pairs; none is similar if by all
    ``measures`` (SQL of a size) its sizes differ by more than ``ratio``, and
    such pairs aren't made. Every other pair of an entry is proved unless its ends are connected by then,
    so none is lost. Members of a large entry are first compared with its
    smallest, one head after another, which uses up a group of copies in
    linear work; after HEADS rounds all pairs of different components are
    proved. ``meet`` does that where an entry's rows (entry, h1, size, c)
    meet, for the pairs that SQL of sa, sb, ca and cb allows (see
    ``entry_pairs``), so that their number takes no disk; without it they are
    spelled out for ``prove``.
    """
    measured = [[m.format(x) for x in ("sa", "sb")] for m in measures]
    fit = "(" + " OR ".join(f"least({a}, {b}) >= greatest({a}, {b}) * {ratio!r}D - 1e-6D" for a, b in measured) + ")"
    few, big = many.filter(F.col("n") <= SMALL).drop("n"), many.filter(F.col("n") > SMALL).drop("n")
    as_ = lambda t, z: t.select("entry", F.col("h1").alias(z), F.col("size").alias(f"s{z}"))
    heads = big.groupBy("entry").agg(F.min(F.struct("h1", "size")).alias("m")).select("entry", "m.*")
    pairs = two.union(as_(few, "a").join(as_(few, "b"), "entry").filter(f"a < b AND {fit}").select("a", "b"))
    pairs = pairs.union(as_(big, "b").join(as_(heads, "a"), "entry").filter(f"a <> b AND {fit}").select("a", "b"))
    pairs = cut(pairs.distinct(), f"{name}-pairs")
    # a member's link with its smallest candidate first; what is connected by then needs no further proof
    tree = cut(prove(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), f"{name}-tree")
    links = cut(tree.union(prove(_across(pairs, tree))), f"{name}-links")
    if big.isEmpty():
        return links
    seen = heads
    for k in range(1, HEADS + 1):
        known = components(links, "a", "b")
        left = big.join(seen.select("entry", F.col("h1").alias("head")), "entry").filter("h1 <> head").drop("head")
        left = left.join(known, F.col("h1") == F.col("node"), "left").select("entry", "h1", "size", F.coalesce("component", "h1").alias("c"))
        left = cut(left, f"{name}-left")
        undecided = left.groupBy("entry").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("entry")
        left = cut(left.join(undecided, "entry", "left_semi"), f"{name}-left")
        if left.isEmpty():
            break
        big = left.select("entry", "h1", "size")
        if k == HEADS and meet:
            return cut(links.union(meet(left, f"ca <> cb AND {fit}")), f"{name}-links")
        y = left.select("entry", F.col("h1").alias("b"), F.col("size").alias("sb"), F.col("c").alias("cb"))
        if k < HEADS:
            seen = cut(left.groupBy("entry").agg(F.min(F.struct("h1", "size", "c")).alias("m")).select("entry", "m.*"), f"{name}-heads")
            open_ = seen.select("entry", F.col("h1").alias("a"), F.col("size").alias("sa"), F.col("c").alias("ca")).join(y, "entry").filter(f"ca <> cb AND {fit}")
        else:
            x = left.select("entry", F.col("h1").alias("a"), F.col("size").alias("sa"), F.col("c").alias("ca"))
            open_ = x.join(y, "entry").filter(f"a < b AND ca <> cb AND {fit}")
        open_ = cut(open_.select("a", "b").distinct(), f"{name}-open")
        links = cut(links.union(prove(open_)), f"{name}-links")
    return links


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (entry, h1, ..) with tiles, the number of their entry's blocks, and block: of a < b, a's isn't the later one.

    The blocks are even if h1 is a hash.
    """
    tiles = cut(members.groupBy("entry").agg(F.ceil(F.count("*") / TILE).alias("tiles")), "pair-tiles")
    place = "least(tiles - 1, cast(floor((h1 / 18446744073709551616D + 0.5D) * tiles) as bigint))"
    return members.join(small(tiles), "entry").withColumn("block", F.expr(place))


def entry_pairs(members: DataFrame, facts: DataFrame, allowed: str, late: dict[str, Column] | None = None) -> DataFrame:
    """Every two of ``members`` (entry, h1, ..) that share an entry, once, with their columns and those of ``facts`` (h1, ..).

    A column x is xa in the first, xb in the second, h1 is a and b, a < b.
    ``allowed`` is SQL of these. ``late`` names columns that are computed from
    the others after the shuffle. The pairs are streamed from the join: rows
    that are shuffled and written grow with the members, and with the square
    of an entry's divided by TILE beyond TILE. Every two blocks of an entry
    are dealt by themselves, so no task has to take more than their pairs. Of the entries that two share,
    only the least gives the pair.
    """
    shared = members.groupBy("h1").agg(F.sort_array(F.collect_set("entry")).alias("entries"))
    facts = facts.join(small(cut(shared, "pair-entries")), "h1")
    names = [c for c in [*members.columns, *facts.columns] if c not in ("entry", "h1")]
    rows = _blocks(members).join(facts, "h1")
    # a number keeps adaptive execution from packing the keys into few tasks by their bytes: their work is in the pairs
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none, last, block = F.lit(0).cast("bigint"), F.col("tiles") - 1, F.col("block")

    def side(z: str, lo: Column, hi: Column) -> DataFrame:
        met = rows.withColumn("other", F.explode(F.sequence(block, last) if z == "a" else F.sequence(none, block)))
        met = met.select("entry", (lo * F.col("tiles") + hi).alias("tile"), "h1", *names).repartition(parts, "entry", "tile")
        return met.withColumns(late or {}).select("entry", "tile", F.col("h1").alias(z), *(F.col(c).alias(c + z) for c in [*names, *(late or {})]))

    x, y = side("a", block, F.col("other")), side("b", F.col("other"), block)
    once = "(size(entriesa) = 1 OR size(entriesb) = 1 OR array_min(array_intersect(entriesa, entriesb)) = x.entry)"
    met = x.alias("x").hint("merge").join(y.alias("y"), (F.col("x.entry") == F.col("y.entry")) & (F.col("x.tile") == F.col("y.tile")) & F.expr(f"a < b AND {allowed} AND {once}"))
    return met.drop("entry", "tile")


def fewer_bits(lanes: int, *most: str) -> str:
    """SQL: the marks m0a, m0b, .. of two rows differ in ``most`` bits at most, see ``possible_pairs``."""
    sets = [range(k * lanes, (k + 1) * lanes) for k in range(len(most))]
    return "(" + " OR ".join("(" + " + ".join(f"bit_count(m{i}a ^ m{i}b)" for i in s) + f" <= {m})" for s, m in zip(sets, most)) + ")"


def possible_pairs(pairs: DataFrame, marks: DataFrame, lanes: int, *most: str) -> DataFrame:
    """The pairs (a, b) whose marks (h1, size, m0, m1, ..) differ in ``most`` bits (SQL of sa, sb) at most.

    With several ``most`` the marks are as many times ``lanes`` in a row, and
    those of one have to fit. A narrow join before texts are fetched; for
    every similar pair one ``most`` holds, so none is lost.
    """
    marks = small(marks)
    for z in "ab":
        pairs = pairs.join(marks.select(F.col("h1").alias(z), F.col("size").alias(f"s{z}"), *(F.col(f"m{i}").alias(f"m{i}{z}") for i in range(lanes * len(most)))), z)
    return pairs.filter(fewer_bits(lanes, *most)).select("a", "b")


def docs_only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast: extra or clashing columns cannot interfere."""
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
