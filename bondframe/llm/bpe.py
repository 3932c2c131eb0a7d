"""Byte-level BPE by a monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ..ship import FORGET, map_arrow
from .common import docs_only

#: Bytes that a leaf of the tree has at most.
LEAF = 32
#: Encoded pieces that a worker remembers.
REMEMBERED = 1 << 19


class Bpe:
    """Ranks of byte strings and the pattern that cuts texts into pieces.

    A piece is encoded by a tree reduction: halves down to leaves of LEAF
    bytes, leaves by merging the lowest-ranked pair, and neighbours joined by
    encoding a window about their boundary again. The window grows until
    both of its ends are stable: two neighbouring tokens are stable when
    their joined bytes encode to just these two, and a token sequence is the
    encoding of its bytes if and only if all its neighbours are stable.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = dict(zip(ranks.values(), ranks))
        self.pieces: dict[str, list[int]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}, pattern)

    def leaf(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked, leftmost pair until none is left (a heap, so long windows stay cheap)."""
        rank = self.ranks.get
        if (whole := rank(data)) is not None:
            return [whole]
        n = len(data)
        end, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop or not live[j]:
                continue
            live[j], end[i] = False, stop
            if stop < n:
                prev[stop] = i
                if (r := rank(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := rank(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if live[i]]

    def holds(self, a: int, b: int) -> bool:
        if (known := self.stable.get((a, b))) is None:
            if len(self.stable) >= REMEMBERED:
                self.stable.clear()
            known = self.stable[a, b] = self.leaf(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both: the monoid's operation."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            mid = self.leaf(self.decode(left[a:] + right[:b]))
            if (a == 0 or self.holds(left[a - 1], mid[0])) and (b == len(right) or self.holds(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            width *= 2

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def _piece(self, s: str) -> list[int]:
        ids = self.piece(s.encode())
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        self.pieces[s] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text: pieces never merge with each other."""
        get, new = self.pieces.get, self._piece
        return list(chain.from_iterable([get(s) or new(s) for s in self.find(text)]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], Bpe] = {}
FORGET[__name__] = _LOADED.clear


def _bpe(path: str, pattern: str) -> Bpe:
    return _LOADED.get((path, pattern)) or _LOADED.setdefault((path, pattern), Bpe.load(path, pattern))


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every row.

    ``ranks_file`` has a base64 token and its rank a line; it is handed to
    the executors, so only the driver must be able to open it. Null text
    counts as empty (no ids). Repeated rows stay; every row is encoded by
    itself, in one pass, without a shuffle.
    """
    name = ship(docs, ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(SparkFiles.get(name), pattern)
        for b in batches:
            ids = [bpe.encode(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.binary())], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs_only(docs, doc_id="bigint", text="string"), run, "doc_id bigint, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` finds, as digests.

    The digests are made beside the encoding, so ids and bytes never leave
    the worker. ids count as little-endian unsigned 32-bit integers.
    """
    name = ship(docs, ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(SparkFiles.get(name), pattern)
        sha = hashlib.sha256
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("text"):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                a.append(sha(np.array(ids, "<u4").tobytes()).hexdigest())
                d.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs_only(docs, doc_id="bigint", text="string"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def ship(docs: DataFrame, file: str) -> str:
    """Give the executors the file; its name there."""
    sc = docs.sparkSession.sparkContext
    name = file.rsplit("/", 1)[-1]
    if not any(str(f).endswith("/" + name) for f in sc.listFiles):
        sc.addFile(file)
    return name
