"""Benchmark decontamination: size-partitioned MinHash containment search."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from .common import docs_only, union_all

#: Words of a shingle; an item of fewer words is one shingle of them all.
WIDTH = 5
#: Share of an item's shingles that a document holds when it is reported.
CONTAINED = 0.8
#: MinHash permutations; any agreement makes a candidate (bands of one row).
PERMS = 48
#: Shingles of a window's half in the smallest size partition.
STEP = 4
#: Bytes of item texts that are broadcast at once; more items go in more passes.
BLOCK_BYTES = 32 << 20
_CHUNK = 1 << 12
_WORD = re.compile(r"[^\W_]+")
_PERM = np.random.RandomState(9).randint(0, 2**32, (2, PERMS), np.uint32) | np.array([[1], [0]], np.uint32)
_COEF = np.random.RandomState(5).randint(0, 2**63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


def shingle_hashes(words: list[str], width: int, hashes: _Hashes) -> np.ndarray:
    """64-bit hashes of the shingles of ``width`` words, in order."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out += w[i : len(w) - width + 1 + i] * _COEF[i]
    return out ^ (out >> np.uint64(32))


def minima(x: np.ndarray, step: int) -> np.ndarray:
    """The least value of each permutation in every run of ``step`` shingles: (runs, PERMS).

    Permutations are odd multiples modulo 2**32 of half the hash.
    """
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((-(-len(x) // step), PERMS), np.uint32)
    chunk = max(1, _CHUNK // step) * step
    for at in range(0, len(x), chunk):
        part = x[at : at + chunk]
        values = part[:, None] * _PERM[0] + _PERM[1]
        out[at // step : at // step + -(-len(part) // step)] = np.minimum.reduceat(values, np.arange(0, len(part), step), axis=0)
    return out


class Index:
    """Items by shingle width and size partition, with their MinHash values.

    Partition k holds the items of up to STEP * 2**k shingles. A document is
    searched for them in windows of twice that, each half a window after the
    last, so that an item's copy lies whole within a window and makes up a
    fifth of the union with it at least: all PERMS permutations then miss it
    with a probability under 1e-4. Items of one shingle are looked up by
    that shingle's hash, with no chance in it.
    """

    def __init__(self, items: list[tuple[int, str]], contained: float):
        self.contained, self.hashes = contained, _Hashes()
        self.items: list[tuple[int, int, np.ndarray, set]] = []
        self.parts: dict[tuple[int, int], tuple[np.ndarray, dict[int, list[int]]]] = {}
        self.single: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        parts, single = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for item, text in items:
            if words := words_of(text):
                width = min(WIDTH, len(words))
                h = np.unique(shingle_hashes(words, width, self.hashes))
                k = 0
                while STEP << k < len(words) - width + 1:
                    k += 1
                if len(h) == 1:
                    single[width][int(h[0])].append(len(self.items))
                else:
                    parts[width, k].append(len(self.items))
                self.items.append((item, width, h, {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}))
        for key, members in parts.items():
            # one sorted table for all permutations: a value that meets another permutation's only costs a verification
            sketch = np.array([minima(self.items[m][2], len(self.items[m][2]))[0] for m in members])
            values = np.sort(np.unique(sketch))
            holders = {int(v): [] for v in values}
            for m, row in zip(members, sketch):
                for v in set(row.tolist()):
                    holders[v].append(m)
            self.parts[key] = (values, holders)
        for width, holders in single.items():
            self.single[width] = (np.sort(np.array(list(holders), np.uint64)), holders)

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the text holds) of the items found."""
        words = words_of(text)
        seen, out = {}, []
        for width in {w for w, _ in self.parts} | {*self.single}:
            x, found = shingle_hashes(words, width, self.hashes), set()
            if not len(x):
                continue
            if width in self.single:
                values, holders = self.single[width]
                at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                for v in {*x[values[at] == x].tolist()}:
                    found.update(holders[v])
            sizes = sorted(k for w, k in self.parts if w == width)
            base = minima(x, STEP << sizes[0]) if sizes else None
            for k in sizes:
                runs = np.minimum.reduceat(base, np.arange(0, len(base), 1 << k - sizes[0]), axis=0)
                windows = np.minimum(runs[:-1], runs[1:]) if len(runs) > 1 else runs
                values, holders = self.parts[width, k]
                flat = windows.ravel()
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                for v in {*flat[values[at] == flat].tolist()}:
                    found.update(holders[v])
            for m in found:
                item, _, _, own = self.items[m]
                if width not in seen:
                    seen[width] = {*zip(*(words[i:] for i in range(width)))}
                common = len(own & seen[width])
                if common >= self.contained * len(own):
                    out.append((item, len(own), common))
        return out


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common) of items contained in documents.

    An item is contained when the text holds ``contained`` or more of its
    different word shingles, counted exactly. Candidates come from MinHash
    over windows sized by the item's partition (see ``Index``). The items
    are broadcast in blocks of BLOCK_BYTES, one pass over the documents for
    each, so that no size of the benchmark is too large; documents are
    neither shuffled nor gathered. Null and wordless texts hold nothing and
    wordless items are in nothing; null ids and repeated rows of either
    table give rows of their own; an empty table gives an empty result.
    """
    docs = docs_only(docs, doc_id="bigint", text="string")
    schema = "doc_id bigint, item_id bigint, n_shingles int, n_common int"

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, contained)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for hit in index.search(t.as_py())]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "n_shingles", "n_common"])

        return map_arrow(docs, run, schema)

    return union_all([search(sent) for sent in _sent(items)])


def decontaminate(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns as they were.

    Every row is judged by its own text, in the pass that reads it.
    """
    at = docs.columns.index("text")

    def keep(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, contained)
            for b in batches:
                yield b.filter(pa.array([not index.search(t.as_py()) for t in b.column(at)], pa.bool_()))

        return run

    for sent in _sent(items):
        docs = map_arrow(docs, keep(sent), docs.schema)
    return docs


def _sent(items: DataFrame) -> list:
    """Broadcasts of the items in blocks of about BLOCK_BYTES, one at least."""
    items = docs_only(items, item_id="bigint", text="string").filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    sc = items.sparkSession.sparkContext
    return [sc.broadcast([tuple(r) for r in items.filter(deal == b).collect()]) for b in range(blocks)]
