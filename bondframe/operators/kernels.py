"""Labelled graphs in batches of whole graphs: what takes pairs of atoms or repeated steps along bonds.

A task has whole graphs, sorted, in Arrow batches; their atoms are flat arrays
and every step is over all of a batch at once. Pairs are made, used and
forgotten in blocks of sources of about CELLS pairs, so that neither shuffles
nor memory grow with their number: memory with a batch and with the largest
graph's atoms and bonds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import map_arrow

#: Pairs of atoms that are held at once, about.
CELLS = 1 << 20
#: Atoms of a task, about.
TASK_ATOMS = 250_000
#: Stands for an unknown graph, which has no bonds and no pairs.
NONE = np.iinfo(np.int64).min


def task_count(df: DataFrame) -> int:
    """Tasks for ``df``, one for TASK_ATOMS rows and enough for all cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ATOMS))


class Graphs:
    """Some whole graphs. Atoms are numbered through, in the order of graphs and of idx; ``of`` is an atom's graph."""

    def __init__(self, rows: pa.Table):
        g = rows["g"].fill_null(int(NONE)).to_numpy()
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        atom = b < 0
        at = g[atom]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        self.g, self.start = at[first], first
        self.n = np.diff(np.r_[first, len(at)])
        self.of = np.repeat(np.arange(len(first)), self.n)
        self.idx = a[atom]
        self.w = rows["w"].to_numpy()[atom]
        self.has_w = rows["w"].is_valid().to_numpy()[atom]
        u, v = self._find(g[~atom], a[~atom]), self._find(g[~atom], b[~atom])
        here = (u >= 0) & (v >= 0)
        self.u, self.v = u[here], v[here]
        ends = np.r_[self.u, self.v]
        self.deg = np.bincount(ends, minlength=len(at))
        self.near = np.r_[self.v, self.u][np.argsort(ends, kind="stable")]
        self.first = np.cumsum(self.deg) - self.deg

    def _find(self, g: np.ndarray, idx: np.ndarray) -> np.ndarray:
        """The number of each graph's atom, -1 where it has none such."""
        if not len(self.idx):
            return np.full(len(g), -1)
        span = max(self.idx.max(), idx.max(initial=0)) + 1
        k = np.minimum(np.searchsorted(self.g, g), len(self.g) - 1)
        key, want = self.of * span + self.idx, k * span + idx
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where((self.g[k] == g) & (g != NONE) & (key[at] == want), at, -1)

    def neighbours(self, atoms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``atoms``, neighbour) of every bond of the given atoms."""
        deg = self.deg[atoms]
        place = np.repeat(np.arange(len(atoms)), deg)
        return place, self.near[np.arange(len(place)) + (self.first[atoms] - (np.cumsum(deg) - deg))[place]]

    def reach(self, sources: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(low, d): d has a cell for each source and atom of its graph, the bonds between, -1 beyond; atom j of source k is at low[k] + j."""
        size = self.n[self.of[sources]]
        low = np.cumsum(size) - size - self.start[self.of[sources]]
        d = np.full(size.sum(), -1, np.int32)
        owner = np.empty(len(d), np.int64)
        k, j, depth = np.arange(len(sources)), sources, 0
        d[low + sources] = 0
        while len(j) and (most is None or depth < most):
            depth += 1
            place, j = self.neighbours(j)
            k = k[place]
            cell = low[k] + j
            new = d[cell] < 0
            k, j, cell = k[new], j[new], cell[new]
            d[cell] = depth
            order = np.arange(len(cell))
            owner[cell] = order
            once = owner[cell] == order
            k, j = k[once], j[once]
        return low, d

    def blocks(self, down: bool = False) -> Iterator[np.ndarray]:
        """All atoms of known graphs, from the first or the last on, in blocks of about CELLS pairs."""
        s = np.flatnonzero(self.g[self.of] != NONE)
        if down:
            s = s[::-1]
        block = np.cumsum(self.n[self.of[s]]) // CELLS
        yield from (x for x in np.split(s, np.flatnonzero(np.diff(block)) + 1) if len(x))

    def pairs(self, most: int | None = None, down: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, d) of all connected pairs, both ways and with themselves, by i (descending if ``down``), then j."""
        for s in self.blocks(down):
            low, d = self.reach(s, most)
            at = np.flatnonzero(d >= 0)
            k = np.repeat(np.arange(len(s)), self.n[self.of[s]])[at]
            yield s[k], at - low[k], d[at]


def whole_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[Graphs]:
    """The graphs of sorted batches; one that goes on in the next batch waits for its end."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).fill_null(int(NONE)).to_numpy()
        change = np.flatnonzero(g[1:] != g[:-1])
        end = int(change[-1]) + 1 if len(change) else 0
        if held and (end or last != g[0]):
            yield Graphs(pa.Table.from_batches([*held, b.slice(0, end)]))
            held = []
        elif end:
            yield Graphs(pa.Table.from_batches([b.slice(0, end)]))
        held.append(b.slice(end))
        last = g[-1]
    if held:
        yield Graphs(pa.Table.from_batches(held))


def per_graphs(atoms: DataFrame, bonds: DataFrame, run: Callable[[Graphs], Iterator[tuple]], columns: str, label: str = "w") -> DataFrame:
    """(g, columns...): what ``run`` yields of some whole graphs, as (numbers of graphs, column, ...).

    Atoms and bonds of a graph meet in a task, whose size doesn't grow with
    the tables; what comes out isn't shuffled. ``label`` is the atoms' column
    that ``run`` has as w.
    """
    none = F.lit(None).cast("double")
    w = F.col(label).cast("double") if label in atoms.columns else none
    rows = atoms.select("g", F.col("idx").cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), w.alias("w"))
    rows = rows.unionByName(bonds.select("g", F.col("u").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b"), none.alias("w")))
    tasks = getattr(atoms, "_tasks", None) or task_count(atoms)
    rows = rows.repartition(tasks, "g").sortWithinPartitions("g", "b", "a")
    schema = T.StructType([T.StructField("g", atoms.schema["g"].dataType), *T._parse_datatype_string(columns).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def batch(graphs: Graphs, part: tuple) -> pa.RecordBatch:
        g = graphs.g[part[0]]
        made = [pa.array(g, mask=g == NONE).cast(kinds.field(0).type)]
        return pa.record_batch([*made, *(pa.array(x).cast(f.type) for x, f in zip(part[1:], list(kinds)[1:]))], schema=kinds)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for graphs in whole_graphs(batches):
                if len(graphs.g):
                    yield from (batch(graphs, part) for part in run(graphs))

    return map_arrow(rows, compute, schema)


def distances(most: int | None) -> Callable[[Graphs], Iterator[tuple]]:
    """i, j, d."""

    def run(x: Graphs) -> Iterator[tuple]:
        for i, j, d in x.pairs(most):
            yield x.of[i], x.idx[i], x.idx[j], d

    return run


def autocorrelations(lags: int) -> Callable[[Graphs], Iterator[tuple]]:
    """lag, gsum, ats, atsc, gap, n, sq; sums run from the last i down and each i's j upwards, null where no term is known."""

    def run(x: Graphs) -> Iterator[tuple]:
        known = x.g != NONE
        at, w, size = x.of[x.has_w], x.w[x.has_w], len(x.g)
        total, s2 = np.zeros(size), np.zeros(size)
        np.add.at(total, at, w)
        np.add.at(s2, at, w * w)
        m = total / np.bincount(at, minlength=size)
        sq = s2 - x.n * m * m
        gsum, some = np.zeros((2, size * (lags + 1)), np.int64)
        ats, atsc, gap = np.zeros((3, size * (lags + 1)))
        for i, j, d in x.pairs(lags, down=True):
            low = i < j
            i, j, d = i[low], j[low], d[low]
            cell = x.of[i] * (lags + 1) + d
            np.add.at(gsum, cell, 1)
            ok = x.has_w[i] & x.has_w[j]
            i, j, cell = i[ok], j[ok], cell[ok]
            wi, wj, mean = x.w[i], x.w[j], m[x.of[i]]
            np.add.at(some, cell, 1)
            np.add.at(ats, cell, wi * wj)
            np.add.at(atsc, cell, (wi - mean) * (wj - mean))
            np.add.at(gap, cell, (wi - wj) * (wi - wj))
        zero = np.arange(size) * (lags + 1)
        has = ~np.isnan(m)
        gsum[zero], some[zero], ats[zero], atsc[zero] = x.n, has, s2, sq
        cell = np.flatnonzero(gsum.astype(bool) & np.repeat(known, lags + 1))
        k = cell // (lags + 1)
        sums = (pa.array(v[cell], mask=some[cell] == 0) for v in (ats, atsc, gap))
        yield k, cell % (lags + 1), gsum[cell], *sums, x.n[k], pa.array(sq[k], mask=~has[k])

    return run


def distance_indices(x: Graphs) -> Iterator[tuple]:
    """diameter, radius, wpath, wpol."""
    far, total, third = np.zeros((3, len(x.of)), np.int64)
    for i, _, d in x.pairs():
        np.maximum.at(far, i, d)
        np.add.at(total, i, d)
        np.add.at(third, i, d == 3)
    k = np.flatnonzero(x.g != NONE)
    yield k, np.maximum.reduceat(far, x.start)[k], np.minimum.reduceat(far, x.start)[k], np.add.reduceat(total, x.start)[k] // 2, np.add.reduceat(third, x.start)[k] // 2


def balaban(x: Graphs) -> Iterator[tuple]:
    """J, 0 without bonds or where mu + 1 is 0."""
    s = np.zeros(len(x.of), np.int64)
    for i, _, d in x.pairs():
        np.add.at(s, i, d)
    t, size = np.zeros(len(x.g)), len(x.g)
    m = np.bincount(x.of[x.u], minlength=size)
    np.add.at(t, x.of[x.u], 1 / np.sqrt((s[x.u] * s[x.v]).astype(float)))
    mu1 = m - x.n + 2
    yield np.arange(size), np.where((m == 0) | (mu1 == 0), 0.0, m / mu1 * t)


def topological_charge(lags: int | None) -> Callable[[Graphs], Iterator[tuple]]:
    """lag, ggi, jgi."""

    def run(x: Graphs) -> Iterator[tuple]:
        keys, sums, counts = [], [], []
        width = int(x.n.max()) + 1
        for s in x.blocks():
            low, d = x.reach(s)
            inv = np.where(d > 0, 1.0 / (d.astype(float) * d), 0.0)
            k = np.repeat(np.arange(len(s)), x.n[x.of[s]])
            j = np.arange(len(d)) - low[k]
            # M[j, s]: the sum over neighbours of j, all in the row of s
            place, i = x.neighbours(j)
            back = np.zeros(len(d))
            np.add.at(back, low[k[place]] + i, inv[place])
            # M[s, j]: the rows of the neighbours of s
            place, other = x.neighbours(s)
            there = np.zeros(len(d))
            for part in np.array_split(np.arange(len(other)), max(1, -(-int(x.n[x.of[other]].sum()) // CELLS))):
                ulow, e = x.reach(other[part])
                row = np.repeat(np.arange(len(part)), x.n[x.of[other[part]]])
                cell = low[place[part]][row] + np.arange(len(e)) - ulow[row]
                np.add.at(there, cell, np.where(e > 0, 1.0 / (e.astype(float) * e), 0.0))
            at = np.flatnonzero((d > 0) & (s[k] > j) & (d <= (lags or width)))
            key, inverse = np.unique(x.of[s[k[at]]] * width + d[at], return_inverse=True)
            total = np.zeros(len(key))
            np.add.at(total, inverse, np.abs(there[at] - back[at]))
            keys.append(key)
            sums.append(total)
            counts.append(np.bincount(inverse, minlength=len(key)))
        if not keys:
            return
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total, count = np.zeros(len(key)), np.zeros(len(key), np.int64)
        np.add.at(total, inverse, np.concatenate(sums))
        np.add.at(count, inverse, np.concatenate(counts))
        yield key // width, key % width, total, total / count

    return run


def estates(x: Graphs) -> Iterator[tuple]:
    """s_max, s_min, s_absmax, s_absmin over atoms whose w is known."""
    t = np.zeros(len(x.of))
    for i, j, d in x.pairs():
        ok = (i != j) & x.has_w[i] & x.has_w[j]
        i, j, d = i[ok], j[ok], d[ok]
        np.add.at(t, i, (x.w[i] - x.w[j]) / ((d + 1.0) * (d + 1.0)))
    s = np.where(x.has_w, x.w + t, np.nan)
    yield np.arange(len(x.g)), *(f.reduceat(v, x.start) for v in (s, np.abs(s)) for f in (np.fmax, np.fmin))


def distance_edge(a: int, b: int) -> Callable[[Graphs], Iterator[tuple]]:
    """n over the geometric mean of the distances between atoms with a and b bonds, NaN without a pair."""

    def run(x: Graphs) -> Iterator[tuple]:
        n, total = np.zeros(len(x.g), np.int64), np.zeros(len(x.g))
        for i, j, d in x.pairs():
            fit = (i < j) & (np.minimum(x.deg[i], x.deg[j]) == min(a, b)) & (np.maximum(x.deg[i], x.deg[j]) == max(a, b))
            np.add.at(n, x.of[i[fit]], 1)
            np.add.at(total, x.of[i[fit]], np.log(d[fit]))
        yield np.arange(len(x.g)), n / np.exp(total / n)

    return run


def walks(most: int) -> Callable[[Graphs], Iterator[tuple]]:
    """k, walks; none of graphs without bonds."""

    def run(x: Graphs) -> Iterator[tuple]:
        c = np.ones(len(x.of), np.int64)
        a, b = np.r_[x.u, x.v], np.r_[x.v, x.u]
        some = np.unique(x.of[a])
        for k in range(1, most + 1):
            new = np.zeros(len(c), np.int64)
            np.add.at(new, a, c[b])
            c = new
            yield some, np.full(len(some), k, np.int32), np.add.reduceat(c, x.start)[some]

    return run


def components(x: Graphs) -> Iterator[tuple]:
    """idx, and comp, the smallest idx within reach: minima of neighbours with jumps until nothing changes."""
    low = np.arange(len(x.of))
    while True:
        new = low.copy()
        np.minimum.at(new, x.u, low[x.v])
        np.minimum.at(new, x.v, low[x.u])
        new = new[new]
        if (new == low).all():
            break
        low = new
    yield x.of, x.idx, x.idx[low]


def connectivity(x: Graphs) -> Iterator[tuple]:
    """deg_sum, zagreb1, chi0, mzagreb1 over atoms; n_bonds, zagreb2, chi1, mzagreb2 over bonds. What has no term is null, chi0 is 0."""
    size, at, some = len(x.g), x.of[x.deg > 0], x.deg[x.deg > 0].astype(float)
    total = lambda of, v, kind=float: _summed(size, of, v, kind)
    bonded, bond = np.bincount(at, minlength=size) > 0, x.of[x.u]
    n, d = np.bincount(bond, minlength=size), x.deg[x.u] * x.deg[x.v]
    gone = lambda v, kept: pa.array(v, mask=~kept)
    yield (
        np.arange(size), total(x.of, x.deg, np.int64), total(x.of, x.deg * x.deg, np.int64), total(at, some**-0.5), gone(total(at, some**-2.0), bonded),
        gone(n, n > 0), gone(total(bond, d, np.int64), n > 0), gone(total(bond, d.astype(float) ** -0.5), n > 0), gone(total(bond, 1.0 / d), n > 0),
    )


def kappa_counts(x: Graphs) -> Iterator[tuple]:
    """Atoms, ends of bonds, and ordered pairs of bonds that meet in an atom."""
    size = len(x.g)
    yield np.arange(size), x.n, _summed(size, x.of, x.deg, np.int64), _summed(size, x.of, x.deg * (x.deg - 1), np.int64)


def _summed(size: int, at: np.ndarray, values: np.ndarray, kind: type) -> np.ndarray:
    out = np.zeros(size, kind)
    np.add.at(out, at, values)
    return out


def path_matches(zs: tuple[int, int, int]) -> Callable[[Graphs], Iterator[tuple]]:
    """How many sets of three atoms are a path with labels ``zs``, of graphs that have any."""

    def run(x: Graphs) -> Iterator[tuple]:
        is_ = lambda k, i: x.has_w[i] & (x.w[i] == zs[k])
        everyone = np.arange(len(x.of))
        mids = everyone[is_(1, everyone)]
        place, a = x.neighbours(mids)
        m, a = mids[place][is_(0, a)], a[is_(0, a)]
        place, b = x.neighbours(m)
        fit = is_(2, b) & (a[place] != b)
        sets = np.unique(np.sort(np.stack([m[place], a[place], b])[:, fit], axis=0), axis=1)
        k, n = np.unique(x.of[sets[0]], return_counts=True)
        yield k, n

    return run
