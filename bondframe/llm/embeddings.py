"""Embedding near-dedup over hierarchical navigable small-world graphs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow, ship
from ..lineage import cut
from .common import components, docs_only

COSINE = 0.93
#: Vectors of a shard, and so of an index and of a block of queries, at most (about).
SHARD = 4096
#: Links of a node on the upper layers; twice as many on the lowest.
LINKS = 12
#: Beam of a first search; it doubles until the audits pass.
BEAM = 32
#: Queries of a block that are compared with brute force, and the recall they must reach.
AUDIT, RECALL = 64, 0.99


class Graph:
    """A hierarchical navigable small-world graph over unit vectors.

    Nodes enter in batches, each searched for in the graph so far together
    with its own batch; searches of a batch go in step, so that every step
    is a few numpy operations. A node's layer is fixed by its place in a
    seeded order: about one in LINKS reaches the next layer.
    """

    def __init__(self, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = 7):
        self.x, self.links = x, links
        n = len(x)
        order = np.random.RandomState(seed).permutation(n)
        sizes = [n]
        while sizes[-1] > 4 * links:
            sizes.append(-(-sizes[-1] // links))
        # layer l holds the first sizes[l] nodes of the order
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        self.order, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        for size in reversed(sizes):
            self.layers.append(self._layer(size, links * (2 if size == n else 1), beam))

    def _layer(self, size: int, width: int, beam: int) -> np.ndarray:
        """Neighbours (places in the order, -1 for none) of the first ``size`` nodes."""
        x = self.x[self.order[:size]]
        near = np.full((size, width), -1, np.int64)
        done = min(size, 4 * width)
        self._join(x, near, np.arange(done), np.tile(np.arange(done), (done, 1)), x[:done] @ x[:done].T)
        while done < size:
            new = np.arange(done, min(size, done + min(done, 512)))
            start = self._descend(x[new], self.layers)
            start = np.where(start < done, start, 0)
            ids, sims = _beam(x, near, x[new], start[:, None], beam)
            # those of the same batch are candidates too
            ids = np.hstack([ids, np.tile(new, (len(new), 1))])
            sims = np.hstack([sims, x[new] @ x[new].T])
            self._join(x, near, new, ids, sims)
            done = int(new[-1]) + 1
        return near

    def _descend(self, q: np.ndarray, layers: list) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for near in layers:
            ids, _ = _beam(self.x[self.order[: len(near)]], near, q, at[:, None], 4)
            at = ids[:, 0]
        return at

    @staticmethod
    def _join(x: np.ndarray, near: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link each new node with its best candidates, both ways."""
        width = near.shape[1]
        sims = np.where((ids == new[:, None]) | (ids < 0), -np.inf, sims)
        top = np.argsort(-sims, axis=1, kind="stable")[:, : width // 2]
        best, val = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        best = np.where(np.isfinite(val), best, -1)
        near[new, : best.shape[1]] = best
        # the way back: a full node keeps its nearest, but always one link to a random one of the new
        src, dst = np.repeat(new, best.shape[1]), best.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        targets, starts = np.unique(dst[by], return_index=True)
        for v, more in zip(targets, np.split(src[by], starts[1:])):
            own = near[v][near[v] >= 0]
            both = np.unique(np.concatenate([own, more]))
            if len(both) > width:
                both = both[np.argsort(-(x[both] @ x[v]), kind="stable")]
                # the nearest, spaced: half by nearness, half spread over the rest
                spread = np.linspace(width // 2, len(both) - 1, width - width // 2).astype(int)
                both = np.concatenate([both[: width // 2], both[spread]])
            near[v] = -1
            near[v, : len(both)] = both

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, similarity) of up to ``beam`` vectors for each query, -1 for none."""
        at = self._descend(q, self.layers[:-1])
        ids, sims = _beam(self.x[self.order], self.layers[-1], q, at[:, None], beam)
        return np.where(ids >= 0, self.order[ids], -1), sims


def _beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: (ids, sims), best first."""
    n, beam = len(q), max(beam, 1)
    rows = np.arange(n)
    seen = np.zeros((n, len(near)), bool)
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    k = start.shape[1]
    ids[:, :k], open_[:, :k] = start, True
    sims[:, :k] = np.einsum("qkd,qd->qk", x[start], q)
    seen[rows[:, None], start] = True
    live = rows
    while len(live):
        score = np.where(open_[live], sims[live], -np.inf)
        pick = score.argmax(1)
        go = np.isfinite(score[np.arange(len(live)), pick])
        live, pick = live[go], pick[go]
        if not len(live):
            break
        open_[live, pick] = False
        nb = near[ids[live, pick]]
        ok = (nb >= 0) & ~seen[live[:, None], nb]
        seen[live[:, None], np.where(nb >= 0, nb, ids[live, pick][:, None])] = True
        s = np.where(ok, np.einsum("qkd,qd->qk", x[np.where(ok, nb, 0)], q[live]), -np.inf).astype(np.float32)
        all_ids, all_s = np.hstack([ids[live], np.where(ok, nb, -1)]), np.hstack([sims[live], s])
        all_o = np.hstack([open_[live], ok])
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_s, all_o))
    return ids, sims


def block_links(graph: Graph, queries: np.ndarray, cosine: float, audit: int = AUDIT, recall: float = RECALL) -> tuple[list[tuple[int, np.ndarray]], int, int]:
    """(query row, rows of the index at ``cosine`` or more) of a block; links that the audit found, links that it looked for.

    Queries whose beam ends on a match are searched again with twice the
    beam, until the beam ends below the threshold; one that holds an eighth
    of the index is a scan of it. Spread queries are audited by brute force,
    ``audit`` after ``audit`` until as many links are met or an eighth of
    the block is audited; when they miss too much, all queries are searched
    with twice the beam.
    """
    n, q32, slack = len(graph.x), queries.astype(np.float32), 1e-5
    spread, truth, links = np.random.RandomState(len(q32)).permutation(len(q32)), {}, 0
    for at in range(0, max(audit, len(q32) // 8), audit):
        for i in spread[at : at + audit]:
            truth[int(i)] = np.flatnonzero(graph.x @ q32[i] >= cosine)
            links += len(truth[int(i)])
        if links >= audit:
            break
    beam = BEAM
    while True:
        found: dict[int, np.ndarray] = {}
        todo, b = np.arange(len(q32)), beam
        while len(todo):
            again = []
            for at in range(0, len(todo), 512):
                part = todo[at : at + 512]
                if 8 * b >= n:
                    for i, row in zip(part, q32[part] @ graph.x.T >= cosine - slack):
                        found[int(i)] = np.flatnonzero(row)
                    continue
                ids, sims = graph.search(q32[part], b)
                full = (ids[:, -1] >= 0) & (sims[:, -1] >= cosine - slack)
                for i in np.flatnonzero(~full):
                    found[int(part[i])] = ids[i][(ids[i] >= 0) & (sims[i] >= cosine - slack)]
                again.append(part[full])
            todo, b = np.concatenate(again) if again else todo[:0], 2 * b
        hits = sum(len(np.intersect1d(t, found[i])) for i, t in truth.items())
        if hits >= recall * links or 8 * beam >= n:
            return sorted(found.items()), hits, links
        beam *= 2


def spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """(row, row) edges that connect what the symmetric boolean matrix connects."""
    out, open_ = [], hit.any(1)
    while open_.any():
        first = int(open_.argmax())
        open_[first] = False
        front = np.array([first])
        while len(front):
            front = np.flatnonzero(hit[front].any(0) & open_)
            open_[front] = False
            out += [(first, int(i)) for i in front]
    return out


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nodes_of(table: DataFrame) -> DataFrame:
    """``table`` with node: a hash of label and vector, null for rows that link with nothing."""
    good = F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))
    return table.withColumn("node", F.when(good, F.xxhash64("label", "embedding")))


def embedding_links(nodes: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """What links the different ``node``s of (node, label, embedding, copies).

    Rows (node, others, peer): others counts the copies of the nodes that
    are linked with node within two shards, peer is null or connects node
    with them; all links of a group are counted and connected, but not
    spelled out. Rows with a null node: others links looked for by the
    audits, of which peer were found.

    A label's vectors are hashed over shards of about ``shard``; each shard
    is built into a graph once. Every shard is queried with every block of
    its label (a block is a shard's vectors; both orders of a pair of shards
    are one search, for the cosine is symmetric). Vectors of different
    lengths never link.
    """
    kind = F.to_json(F.struct("label", F.size("embedding").alias("dim"))).alias("name")
    nodes = nodes.select(kind, "node", "embedding", "copies")
    sizes = nodes.groupBy("name").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    nodes = nodes.join(sizes, "name").withColumn("shard", F.pmod(F.col("node"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x = _unit(pdf["embedding"].tolist())
        vectors = (pdf["node"].to_numpy(), pdf["copies"].to_numpy(), x)
        one = pdf.iloc[0]
        return pd.DataFrame({"name": [one["name"]], "shard": [one["shard"]], "shards": [one["shards"]], "graph": [pickle.dumps(Graph(x.astype(np.float32)))], "vectors": [pickle.dumps(vectors)]})

    ship(nodes.sparkSession)
    graphs = nodes.groupBy("name", "shard").applyInPandas(build, "name string, shard int, shards int, graph binary, vectors binary")
    graphs = cut(graphs, "vec-graphs")
    # each unordered pair of shards of a label once
    index = graphs.select("name", F.col("shard").alias("i"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("q"), "graph", F.col("vectors").alias("index"))
    block = graphs.select("name", F.col("shard").alias("q"), F.explode(F.sequence(F.col("shard"), F.col("shards") - 1)).alias("i"), F.col("vectors").alias("block"))

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                graph = pickle.loads(batch.column("graph")[i].as_py())
                ids, copies, x = pickle.loads(batch.column("index")[i].as_py())
                qids, qcopies, q = pickle.loads(batch.column("block")[i].as_py())
                same = ids[0] == qids[0]
                hit = np.zeros((len(qids), len(ids)), bool)
                pairs, found, looked = block_links(graph, q, cosine)
                for row, near in pairs:
                    hit[row, near[x[near] @ q[row] >= cosine]] = True
                if same:
                    hit |= hit.T
                    np.fill_diagonal(hit, False)
                    own, others = [ids], [hit @ copies]
                else:
                    own, others = [qids, ids], [hit @ copies, qcopies @ hit]
                    n = len(qids)
                    both = np.zeros((n + len(ids),) * 2, bool)
                    both[:n, n:], both[n:, :n], hit = hit, hit.T, both
                node, count = np.concatenate(own), np.concatenate(others)
                some = np.flatnonzero(count)
                edges = spanning(hit)
                a = pa.array([*node[some].tolist(), *(int(node[a]) for a, _ in edges), None], pa.int64())
                n = pa.array([*count[some].tolist(), *[0] * len(edges), looked], pa.int64())
                peer = pa.array([*[None] * len(some), *(int(node[b]) for _, b in edges), found], pa.int64())
                yield pa.record_batch([a, n, peer], names=["node", "others", "peer"])

    pairs = index.join(block, ["name", "i", "q"]).select("graph", "index", "block")
    return cut(map_arrow(pairs, query, "node bigint, others bigint, peer bigint"), "vec-links")


def dedup_embeddings(table: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(vec_id, label, n_links, component_id, kept, recall) of every row.

    Vectors of equal, non-null label link at a cosine of ``cosine`` or more
    in double precision. Null and zero vectors, vectors with a null or
    non-finite component and rows without a label or vec_id link with
    nothing: they are components of their own. Rows of one vec_id are
    vectors of their own. recall is the share of the links that the audits
    looked for by brute force and the graphs had found (1 if there were
    none). An empty table gives an empty result.
    """
    t = docs_only(table, vec_id="bigint", embedding="array<double>", label="bigint")
    t = nodes_of(t)
    # equal vectors are one node: a hot vector costs nothing
    same = t.filter("node IS NOT NULL").groupBy("node", "label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    same = cut(same, "vec-nodes")
    found = embedding_links(same, cosine, shard)
    same = same.select("node", "least", "copies")
    audit = found.filter("node IS NULL").agg(F.sum("others").alias("looked"), F.sum("peer").alias("found")).first()
    recall = audit["found"] / audit["looked"] if audit["looked"] else 1.0
    links = found.filter("node IS NOT NULL")
    degree = links.filter("others > 0").groupBy(F.col("node").alias("a")).agg(F.sum("others").alias("others"))
    groups = components(links.filter("peer IS NOT NULL"), "node", "peer").select(F.col("node").alias("a"), F.col("component").alias("group"))
    r = same.join(degree, same.node == degree.a, "left").drop("a").join(groups, F.col("node") == F.col("a"), "left").drop("a")
    r = r.select("node", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("group", "node").alias("group"))
    r = r.join(r.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("node", "n_links", "component_id")
    out = t.select("vec_id", "label", "node").join(r, "node", "left")
    out = out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("recall", F.lit(float(recall)))
