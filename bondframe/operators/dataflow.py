"""The batch dataflow around a descriptor matrix, as DataFrame operators.

Ranks with ties, seeded draws, splits without leakage, guarded joins and
column statistics. Nothing is collected but what is bounded by the number of
columns or groups, which each operator names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..ship import map_arrow
from .components import components, tasks_for

NAN = float("nan")


def draw_key(seed: int, key: Column) -> Column:
    """A uniform number in [0, 1) from the seed and a key: the same on any engine and in any order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


# --- ranking


def rank_with_ties(df: DataFrame, score: str, name: str) -> DataFrame:
    """``df`` with the pessimistic rank: a block of equal scores has the rank of its last row."""
    per = df.groupBy(score).agg(F.count("*").alias("_n"))
    per = running(per, [F.desc(score)], "_n", name).select(score, name)
    return df.join(per, score)


def top_mask(df: DataFrame, score: str, k: int, name: str) -> DataFrame:
    """``df`` with the mask of rows whose whole tie block is among the first k."""
    return rank_with_ties(df, score, "_rank").withColumn(name, F.col("_rank") <= k).drop("_rank")


def recovery(df: DataFrame, true: str, pred: str, frac: float, n: int) -> DataFrame:
    """The share of the true top ``frac`` that the predicted top holds."""
    k = math.floor(frac * n)
    both = top_mask(top_mask(df, true, k, "_t"), pred, k, "_p")
    return both.agg(F.count_if(F.col("_t") & F.col("_p")).alias("hits"), F.lit(k).alias("k"), (F.count_if(F.col("_t") & F.col("_p")) / F.lit(float(k))).alias("recovery"))


def log_auc(df: DataFrame, key: str, true: str, pred: str, top: int, points: list[int], n: int) -> DataFrame:
    """Area under hits against log10 of rows looked at, at the sample points.

    Rows are put in the order of prediction (ties by key) by a distributed
    rank: ranges of predictions are counted, then rows are ranked inside
    their range. ``points`` is a bounded list of the caller's.
    """
    hits = top_mask(df, true, top, "_t")
    ordered = global_rank(hits, [F.desc(pred), F.asc(key)], "rank")
    found = ordered.filter("_t").select("rank")
    grid = df.sparkSession.createDataFrame([(p,) for p in points], "at bigint")
    curve = F.broadcast(grid).join(found, F.col("rank") <= F.col("at"), "left").groupBy("at").agg((F.count("rank") / F.lit(float(top))).alias("y"))  # one row a point
    w = Window.orderBy("at")
    x = F.log10(F.col("at") / F.lit(float(n)))
    step = curve.select("at", "y", x.alias("x"), F.lag("y").over(w).alias("y0"), F.lag(x).over(w).alias("x0"))
    # an ideal order has a hit at every place up to top, a random one the share of the rows looked at
    ideal, rand = F.least(F.col("at"), F.lit(top)) / F.lit(float(top)), F.col("at") / F.lit(float(n))
    for name, y in (("i", ideal), ("r", rand)):
        step = step.withColumn(name, y).withColumn(f"{name}0", F.lag(y).over(w))
    area = lambda y, y0: F.sum((F.col(y) + F.col(y0)) / 2 * (F.col("x") - F.col("x0")))
    out = step.agg(area("y", "y0").alias("area"), area("i", "i0").alias("ideal"), area("r", "r0").alias("random"))
    return out.withColumn("normalised", (F.col("area") - F.col("random")) / (F.col("ideal") - F.col("random")))


#: Rows of a range, about.
RANGE_ROWS = 250_000


def running(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each in ``order``, which must tell rows apart.

    The rows are dealt to ranges of the order, of about RANGE_ROWS each, and
    written, so that a row's range is settled; sums run inside the ranges
    and are shifted by the totals of the ranges before. No task has more
    than a range, but that of the totals, which has a row for each.
    """
    parts = max(1, -(-df.count() // RANGE_ROWS))
    df = cut(df.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), "ranges")
    totals = df.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_r0", inside).join(F.broadcast(before), "_b").withColumn(name, F.col("_r0") + F.col("_s")).drop("_b", "_r0", "_s")  # before has a row for each range


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 1-based rank in ``order``, which must tell rows apart (see ``running``)."""
    return running(df.withColumn("_one", F.lit(1)), order, "_one", name).drop("_one")


def tie_report(df: DataFrame, score: str) -> DataFrame:
    """Rows, different scores and the largest tie block."""
    per = df.groupBy(score).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.max("n").alias("largest_tie"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("tied_rows"))


# --- draws and splits


def sample_without_replacement(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by the seeded order of their keys: a top-k that merges per partition."""
    return df.withColumn("_u", draw_key(seed, F.col(key))).orderBy("_u", key).limit(k).drop("_u")


def pick_per_group(df: DataFrame, group: str, key: str, depth: int, seed: int) -> DataFrame:
    """At most ``depth`` rows of each group, in the seeded order."""
    w = Window.partitionBy(group).orderBy(draw_key(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= depth).drop("_r")


def stratified_draw(df: DataFrame, key: str, score: str, cut: float, n_top: int, n_rest: int, seed: int) -> DataFrame:
    """``n_top`` rows with a score under ``cut`` and ``n_rest`` of the others, marked by part."""
    top = sample_without_replacement(df.filter(F.col(score) <= cut), key, n_top, seed).withColumn("part", F.lit("top"))
    rest = sample_without_replacement(df.filter(F.col(score) > cut), key, n_rest, seed + 1).withColumn("part", F.lit("rest"))
    return top.unionByName(rest)


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): whole groups, the largest first, each to the fold with the fewest rows.

    The packing is sequential, over one row a group, on the driver; groups
    are bounded by the caller (scaffolds of a data set).
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()
    load, rows = [0] * folds, []
    for r in sizes:
        f = min(range(folds), key=lambda k: (load[k], k))
        load[f] += r["n"]
        rows.append((r[0], r["n"], f))
    kind = dict(df.dtypes)[group]
    return df.sparkSession.createDataFrame(rows, f"{group} {kind}, n bigint, fold int")


def group_split(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """``df`` with part train or validation, whole groups, by the seeded draw of the group."""
    return df.withColumn("part", F.when(draw_key(seed, F.col(group)) < share, "train").otherwise("validation"))


def digest(df: DataFrame, key: str, blocks: int = 64) -> DataFrame:
    """A sha256 of a key set that freezes it: digests of hashed blocks, joined in order."""
    b = F.pmod(F.col(key), F.lit(blocks))
    per = df.select(key).distinct().groupBy(b.alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").cast("binary"), 256).alias("s"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), ",").cast("binary"), 256).alias("digest"))


def stratum(value: Column, edges: list[float]) -> Column:
    """The 0-based bin of half-open intervals that start at the edges."""
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


# --- joins


def positional_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join by place with a mark for places that one side lacks; see ``assert_aligned``."""
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    return l.join(r, keys, "full_outer").withColumn("aligned", F.col("_l").isNotNull() & F.col("_r").isNotNull()).drop("_l", "_r")


def assert_aligned(joined: DataFrame) -> DataFrame:
    """The rows of a positional join; an error at the first place without a partner."""
    return joined.filter(F.when(F.col("aligned"), F.lit(True)).otherwise(F.raise_error(F.lit("a place has no partner")).cast("boolean"))).drop("aligned")


def locate(points: DataFrame, at: str, spans: DataFrame, most: int = 100_000) -> DataFrame:
    """``points`` with the span (start, size) that holds each, and local, its offset there.

    A range join by equi-keys: spans are listed under the blocks of the
    widest span's size that they touch, points under their own block.
    """
    width = spans.agg(F.max("size")).first()[0] or 1
    listed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("size") - 1) / width))))
    hit = points.withColumn("_b", F.floor(F.col(at) / width)).join(listed, "_b").filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("start") + F.col("size")))
    return hit.withColumn("local", F.col(at) - F.col("start")).drop("_b")


def exclusive_sums(df: DataFrame, key: str, size: str) -> DataFrame:
    """``df`` (one row a shard) with start, the sizes before it."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def islands(df: DataFrame, key: str) -> DataFrame:
    """(lo, hi, n) of the runs of consecutive numbers in a set of shard numbers."""
    ids = running(df.select(key).distinct().withColumn("_one", F.lit(1)), [F.asc(key)], "_one", "_r")
    runs = ids.withColumn("_g", F.col(key) - F.col("_r"))
    return runs.groupBy("_g").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).drop("_g")


def merge_added(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Add-only merge: ``more`` may bring new keys alone; a key of ``base`` in it fails the job."""
    seen = more.join(base.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    fail = F.raise_error(F.concat(F.lit("key is there already: "), F.col("_k").cast("string"))).cast("boolean")
    return base.unionByName(seen.filter(F.when(F.col("_k").isNotNull(), fail).otherwise(F.lit(True))).drop("_k"))


def merge_new(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``more`` replace those of ``base`` with the same key; no key of ``base`` is lost."""
    return base.join(more.select(key), key, "left_anti").unionByName(more)


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key, the first in ``order``: a partial aggregate, no window over a key's rows."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(key, *(F.col(f"_f.{c}").alias(c) for c in rest))


def linked_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, grp): the smallest node that each node is linked with, directly or by others.

    By contraction (see ``components``), in tasks that don't grow with the
    links: no row moves by the label that a whole group shares until the
    labels are known, and then it meets partial minima alone.
    """
    with tasks_for(links.sparkSession, 2 * links.count()) as tasks:
        # small parts first: what a scan's part has of different links would be held at once
        links = links.repartition(tasks, a, b)
        out = cut(components(links, a, b), "groups")
        alone = links.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct().join(out, "node", "left_anti")
        return out.select("node", F.col("component").alias("grp")).union(cut(alone, "alone").select("node", F.col("node").alias("grp")))


# --- columns


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with infinities of the named columns as NaN."""
    return df.withColumns({c: F.when(F.abs(c) == float("inf"), F.lit(NAN)).otherwise(F.col(c)) for c in columns})


def long_columns(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep..., name, value): one row for each cell of the named columns."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.name", "p.value")


def modal(cells: DataFrame) -> DataFrame:
    """(name, mode, share) of each column; of equally frequent values the smallest."""
    per = cells.groupBy("name", "value").agg(F.count("*").alias("n"))
    out = per.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.max("n").alias("top"), F.sum("n").alias("all"))
    return out.select("name", "mode", (F.col("top") / F.col("all")).alias("share"))


def usable(cells: DataFrame, finite: float = 0.5, share: float = 0.999) -> DataFrame:
    """(name, usable): enough finite values, some spread, no value that is nearly everywhere."""
    ok = ~F.isnan("value") & F.col("value").isNotNull() & (F.abs("value") != float("inf"))
    s = cells.groupBy("name").agg(F.avg(ok.cast("int")).alias("finite"), F.stddev_pop(F.when(ok, F.col("value"))).alias("sd"))
    return s.join(modal(cells.filter(ok)), "name").select("name", ((F.col("finite") >= finite) & (F.col("sd") > 0) & (F.col("share") <= share)).alias("usable"))


def group_ranks(df: DataFrame, columns: list[str], group: str, key: str) -> DataFrame:
    """(group, r0, r1, ..): each row's ordinal ranks by the columns inside its group, ties by key.

    Rows are numbered by key first, so that no other order carries it. Every
    order is that of ranges of about RANGE_ROWS rows, sorted and written; a
    rank is the place in the range, shifted by the ranges before it. No task
    has a whole group.
    """
    values = [f"_v{i}" for i in range(len(columns))]
    out = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), *(F.col(c).alias(v) for c, v in zip(columns, values)))
    out = places(out, ["_k"], "_id", drop=["_k"])
    for i, v in enumerate(values):
        out = places(out, ["_g", v, "_id"], f"r{i}", drop=[v])
    first = out.groupBy(F.col("_g").alias("_h")).agg(*(F.min(f"r{i}").alias(f"_f{i}") for i in range(len(columns))))
    return out.join(F.broadcast(first), F.col("_g").eqNullSafe(F.col("_h"))).select(F.col("_g").alias(group), *((F.col(f"r{i}") - F.col(f"_f{i}") + 1).alias(f"r{i}") for i in range(len(columns))))  # first has a row for each group


def places(df: DataFrame, order: list[str], name: str, drop: list[str]) -> DataFrame:
    """``df`` without ``drop``, with each row's 0-based place in ``order``, which must tell rows apart."""
    parts = max(1, -(-df.count() // RANGE_ROWS))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.monotonically_increasing_id())
    # numbers of a sorted range go on by one, in the lower 33 bits, under the range's number
    ranged = cut(ranged.drop(*drop), "places").withColumn("_b", F.shiftright("_p", 33))
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return ranged.join(F.broadcast(before), "_b").withColumn(name, F.col("_p").bitwiseAND(2**33 - 1) + F.col("_s")).drop("_b", "_p", "_s")  # before has a row for each range


def rank_correlation(df: DataFrame, a: str, b: str, group: str, key: str) -> DataFrame:
    """The least absolute correlation of ordinal ranks over the groups; groups under 30 rows count as 0.

    Ties are ranked by key, as an ordering of rows does.
    """
    return least_correlations(group_ranks(df, [a, b], group, key), [("r0", "r1")], group).select(F.col("rho_0").alias("rho_min"), "n_groups")


def least_correlations(ranks: DataFrame, pairs: list[tuple[str, str]], group: str) -> DataFrame:
    """(rho_0, rho_1, .., n_groups) of pairs of columns of ``group_ranks``, in one pass."""
    r = ranks.groupBy(group).agg(F.count("*").alias("n"), *(F.abs(F.corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    least = (F.min(F.when(F.col("n") >= 30, F.coalesce(f"c{i}", F.lit(0.0))).otherwise(0.0)).alias(f"rho_{i}") for i in range(len(pairs)))
    return r.agg(*least, F.count("*").alias("n_groups"))


def support_overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Jaccard overlap of two supports."""
    return df.agg((F.count_if(a & b) / F.count_if(a | b)).alias("jaccard"), F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"))


def greedy_cover(pairs: list[tuple[str, str, float]], cost: dict[str, float], least: float) -> dict[str, str]:
    """Column -> survivor: the cheapest first; a column is absorbed by the first kept one that it follows closely.

    Works on the driver over pairs of columns, of which there are at most a
    few thousand.
    """
    close = {(a, b) for x, y, r in pairs if r >= least for a, b in ((x, y), (y, x))}
    kept: list[str] = []
    out = {}
    for c in sorted(cost, key=lambda n: (cost[n], n)):
        out[c] = next((k for k in kept if (c, k) in close), c)
        if out[c] == c:
            kept.append(c)
    return out


def standardize_fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and deviations (1 where there is none), fitted on the training rows alone."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_sd")]
    return train.agg(*aggs)


def standardize_apply(df: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(fit))  # fit is one row
    return out.select(*(c for c in df.columns if c not in columns), *(((F.coalesce(c, f"{c}_mean") - F.col(f"{c}_mean")) / F.col(f"{c}_sd")).alias(c) for c in columns))


def regression_scores(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """rmse, rmse over the deviation of y, Pearson correlation and R squared."""
    err = F.pow(F.col(p) - F.col(y), 2)
    out = df.groupBy(*by).agg(F.sqrt(F.avg(err)).alias("rmse"), F.stddev_pop(y).alias("sd"), F.corr(y, p).alias("pearson"), F.sum(err).alias("sse"), F.count("*").alias("n"))
    return out.select(*by, "rmse", (F.col("rmse") / F.col("sd")).alias("rmse_sd"), "pearson", (1 - F.col("sse") / (F.col("n") * F.col("sd") * F.col("sd"))).alias("r2"))


def pareto(df: DataFrame, cost: str, error: str) -> DataFrame:
    """The rows that no other beats in both cost and error; one row a candidate, so one ordered partition is small."""
    best = F.min(error).over(Window.orderBy(cost, error).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", best).filter(F.col("_b").isNull() | (F.col(error) < F.col("_b"))).drop("_b")


def bootstrap_median(df: DataFrame, key: str, value: str, draws: int, n: int, seed: int) -> DataFrame:
    """(draw, median) of ``draws`` resamples of n rows; place i of draw b takes row floor(u(b, i) n)."""
    spark = df.sparkSession
    u = draw_key(seed, F.concat_ws("-", "draw", "i"))
    picks = spark.range(draws * n).selectExpr(f"cast(id div {max(n, 1)} as int) AS draw", f"id % {max(n, 1)} AS i")
    picks = picks.select("draw", F.floor(u * n).cast("bigint").alias(key))
    return picks.join(df.select(key, value), key).groupBy("draw").agg(F.median(value).alias("median"))


def quota(sizes: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """(group, quota): shares of ``total`` in proportion, one at least, settled by the largest remainders.

    One row a group.
    """
    all_ = Window.partitionBy()
    exact = F.col(size) / F.sum(size).over(all_) * total
    d = sizes.select(group, F.col(size).alias("_n"), exact.alias("_e")).withColumn("_q", F.greatest(F.lit(1), F.floor("_e")))
    gap = F.lit(total) - F.sum("_q").over(all_)
    up = F.row_number().over(Window.orderBy(F.desc(F.col("_e") - F.floor("_e")), group))
    return d.select(group, (F.col("_q") + F.when(up <= gap, 1).otherwise(0)).cast("bigint").alias("quota"))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine of two arrays; NaN where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(F.lit(NAN))


#: Blocks over which the rows of a group are dealt, and pairs that a step makes, about.
SALTS = 32
PAIRS = 1 << 18


def cosine_pairs(df: DataFrame, group: str, key: str, vector: str, asked: Column) -> DataFrame:
    """(a, b, cosine) of the rows that are asked for with all others of their group; NaN where one has no length, or lengths differ.

    A group's rows are dealt to SALTS blocks, and those asked for sent to
    each, so no task has a whole group. A block's rows stream past the asked
    ones in steps of about PAIRS pairs; memory is that of the asked of a group.
    """
    x = df.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), asked.alias("asked"))
    salt = F.lit(SALTS)
    rows = x.select("g", F.pmod(F.xxhash64("k"), salt).alias("block"), F.lit(1).alias("kind"), "k", "v")
    rows = rows.unionByName(x.filter("asked").select("g", F.explode(F.sequence(F.lit(0).cast("bigint"), (salt - 1).cast("bigint"))).alias("block"), F.lit(0).alias("kind"), "k", "v"))
    most = PAIRS

    def vectors(b: pa.RecordBatch) -> list:
        """(length, rows, vectors) of each length; none of those that are unknown."""
        v = b.column("v").to_pylist()
        size = np.array([len(e) if e is not None and None not in e else 0 for e in v])
        return [(n, at, np.array([v[i] for i in at])) for n in np.unique(size[size > 0]) for at in [np.flatnonzero(size == n)]]

    def cosines(known: list, ids: np.ndarray, batch: list, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, most // max(1, len(ids)))
        for low in range(0, len(keys), step):
            out = np.full((min(step, len(keys) - low), len(ids)), np.nan)
            for n, at, v in batch:
                here = (at >= low) & (at < low + step)
                for m, to, q in known:
                    if n == m and here.any():
                        y = v[here]
                        out[np.ix_(at[here] - low, to)] = 1 - (y @ q.T) / (np.sqrt((y * y).sum(1))[:, None] * np.sqrt((q * q).sum(1)))
            r, c = np.nonzero(keys[low : low + step, None] != ids[None, :])
            yield pa.record_batch([pa.array(ids[c]), pa.array(keys[low + r]), pa.array(out[r, c])], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked_, known, ids = None, [], None, None
        with np.errstate(all="ignore"):
            for b in batches:
                mark = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "block", "kind")])
                edges = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
                for low, high in zip(edges, edges[1:]):
                    if low == high:
                        continue
                    part, place = b.slice(low, high - low), tuple(mark[:2, low])
                    if place != at:
                        at, asked_, known = place, [], None
                    if mark[2, low] == 0:
                        asked_.append(part)
                    elif asked_:
                        if known is None:
                            all_ = pa.Table.from_batches(asked_).combine_chunks().to_batches()[0]
                            known, ids = vectors(all_), all_.column("k").to_numpy()
                        yield from cosines(known, ids, vectors(part), part.column("k").to_numpy())

    # a number keeps adaptive execution from packing the blocks into few tasks by their bytes: their work is in the pairs
    tasks = max(4 * SALTS, df.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("code", F.xxhash64("g")).repartition(tasks, "code", "block").sortWithinPartitions("code", "block", "kind").select("code", "block", "kind", "k", "v")
    return map_arrow(dealt, run, "a bigint, b bigint, cosine double")


def agreement(df: DataFrame, a: str, b: str, tol: float = 1e-9) -> DataFrame:
    """Cells that are equal, within a relative tolerance, or NaN on one side alone."""
    na, nb = F.isnan(a), F.isnan(b)
    near = (na & nb) | (~na & ~nb & (F.abs(F.col(a) - F.col(b)) <= F.greatest(F.abs(a), F.abs(b), F.lit(1e-300)) * tol))
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(a).eqNullSafe(F.col(b)) | (na & nb)).alias("equal"), F.count_if(near).alias("near"), F.count_if(na != nb).alias("nan_flips"))
