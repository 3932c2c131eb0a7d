"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import FORGET, map_arrow
from ..lineage import cut, scratch
from .common import components, decided_links, docs_only, possible_pairs, shared_entries, small

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the shingles of ``width`` words, repeats included.

    A-Z are lower-cased; words are runs without ASCII white space; fewer
    words than ``width`` make one shingle of them all, no word gives 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(h), 255):
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return map_arrow(docs_only(docs, doc_id="bigint", text="string"), run, "doc_id bigint, fp bigint")


#: Bits at which fingerprints link, at most.
DISTANCE = 2
#: Fingerprints of a table entry up to which all of them are fetched.
BUCKET = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(segments: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment that is searched.

    DISTANCE + 1 shares are dealt over the segments; one with s shares is
    searched within s - 1 bits. If every segment differed by its shares or
    more, the whole would differ by more than DISTANCE: so some segment of
    two linked fingerprints lies within its radius.
    """
    if not 1 <= segments <= 64:
        raise ValueError("segments must be 1 to 64")
    ends = [64 * k // segments for k in range(segments + 1)]
    shares = [(DISTANCE + 1) // segments + (k < (DISTANCE + 1) % segments) for k in range(segments)]
    return [(lo, hi - lo, s - 1) for lo, hi, s in zip(ends, ends[1:], shares) if s]


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def fingerprint_links(fps: DataFrame, segments: int = 2) -> DataFrame:
    """Links (fp, peer) that connect all distinct ``fp`` within DISTANCE bits.

    Multi-index hashing: one table a segment, keyed by the segment's value.
    A fingerprint enumerates the Hamming ball around its own value in each
    segment (see ``_segments``; with two, radius 1 in one and the value
    itself in the other), fetches the fingerprints under those values and
    verifies the complete distance. Values that over BUCKET fingerprints
    share are not fetched: the fingerprints that ask for them meet at whole
    values one flipped bit away instead, where two at DISTANCE meet and at
    most 65 ever do. So no entry is hot, and no link is lost.
    """
    parts = _segments(segments)
    value = lambda lo, bits: F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
    key = lambda k, v: F.struct(F.lit(k).alias("segment"), v.alias("value"))
    table = fps.select("fp", F.explode(F.array(*(key(k, value(lo, bits)) for k, (lo, bits, _) in enumerate(parts)))).alias("e")).select("e.*", F.col("fp").alias("peer"))
    asked = [key(k, value(lo, bits).bitwiseXOR(F.lit(_signed(f)))) for k, (lo, bits, radius) in enumerate(parts) for f in _ball(bits, radius)]
    probes = fps.select("fp", F.explode(F.array(*asked)).alias("e")).select("e.*", "fp")
    hot = small(cut(table.groupBy("segment", "value").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("segment", "value"), "simhash-hot"))
    fetched = probes.join(hot, ["segment", "value"], "left_anti").join(table, ["segment", "value"])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("peer"))) <= DISTANCE
    links = fetched.filter((F.col("fp") < F.col("peer")) & near).select("fp", "peer")
    many = cut(probes.join(hot, ["segment", "value"], "left_semi").select("fp").distinct(), "simhash-many")
    flips = [0, *(_signed(1 << i) for i in range(64))]
    whole = many.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips))).alias("entry"))
    met = cut(whole.groupBy("entry").agg(F.min("fp").alias("peer"), F.count("*").alias("n")).filter("n > 1").select("entry", "peer"), "simhash-met")
    links = links.union(whole.join(met, "entry").filter((F.col("fp") != F.col("peer")) & near).select("fp", "peer"))
    return cut(links.distinct(), "simhash-links")


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, n_same) of every row of ``docs``.

    Rows link when their fingerprints differ in 2 bits or fewer;
    component_id is the smallest doc_id reachable. Texts without words (null
    and empty ones too) have fingerprint 0 and link like any other. Null
    doc_ids keep their rows; they never are a component's id unless no other
    id is there (then it is null). Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    rows = cut(fingerprints(docs, width), "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same"))
    fps = cut(fps, "simhash-fps")
    groups = components(fingerprint_links(fps), "fp", "peer")
    fps = fps.join(groups, fps.fp == groups.node, "left").select("fp", "least", "n_same", F.coalesce("component", "fp").alias("group"))
    ids = fps.groupBy("group").agg(F.min("least").alias("component_id"))
    fps = fps.join(ids, "group").select("fp", "n_same", "component_id")
    return rows.join(fps, "fp").select("doc_id", "fp", "component_id", "n_same")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- near duplicates by similarity


#: Bands of MinHashes and rows of a band: a pair at Jaccard J is met with a probability of 1 - (1 - J ** ROWS) ** BANDS, over 0.9999 from 0.8 on.
BANDS, ROWS = 20, 4
_PERM = np.random.RandomState(6).randint(0, 2**32, (2, BANDS * ROWS, 1), np.uint32) | np.array([1, 0], np.uint32)[:, None, None]
_MIX = np.random.RandomState(8).randint(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
KEYS = [f"k{i}" for i in range(BANDS)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_HASHES = _Hashes()
FORGET[__name__] = _HASHES.clear


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted different hashes of the shingles of ``width`` words (fewer words: of them all)."""
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX[i % len(_MIX)] + w[i : len(w) - width + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX[0]
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def band_keys(x: np.ndarray) -> list[int] | None:
    """The table entries of a shingle set: a hash of each band of its MinHashes; None of an empty set."""
    if not len(x):
        return None
    low, least = (x.view(np.uint64) >> np.uint64(32)).astype(np.uint32), None
    for at in range(0, len(low), _CHUNK >> 4):
        part = (low[at : at + (_CHUNK >> 4)] * _PERM[0] + _PERM[1]).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    rows, out = least.reshape(BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ (out >> np.uint64(29))) * _MIX[r] + rows[:, r]
    return (out * _MIX[ROWS]).view(np.int64).tolist()


#: 64-bit lanes of the marks of a shingle set.
LANES = 8


def parities(x: np.ndarray) -> list[int]:
    """Which of 64 * LANES remainders an odd number of the hashes have: another hash changes one bit."""
    odd = np.bincount(x & (64 * LANES - 1), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h1, h2, size, fp, keys): two hashes of the whole text, the number of its shingles, its SimHash and the entries of its MinHashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, fps, rows = [], [], []
            for t in b.column("text"):
                x = shingles(t.as_py(), width)
                sizes.append(len(x))
                fps.append(_signed(fingerprint(t.as_py(), width)))
                rows.append(band_keys(x))
            keys = [pa.array([r and r[k] for r in rows], pa.int64()) for k in range(BANDS)]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "h1", "h2")), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), *keys], names=["doc_id", "h1", "h2", "size", "fp", *KEYS])

    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))
    return map_arrow(hashed, run, "doc_id bigint, h1 bigint, h2 bigint, size int, fp bigint, " + ", ".join(f"{c} bigint" for c in KEYS))


def _simhash_entries(reps: DataFrame) -> DataFrame:
    """(entry, h1, size): texts whose fingerprints ``fingerprint_links`` connects share an entry."""
    worded = reps.filter("k0 IS NOT NULL").select("fp", "h1", "size")
    groups = components(fingerprint_links(worded.select("fp").distinct()), "fp", "peer")
    return worded.join(groups, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("entry"), "h1", "size")


def _band_entries(reps: DataFrame) -> DataFrame:
    """(entry, h1, size): texts whose MinHashes agree in a band share an entry."""
    return reps.filter("k0 IS NOT NULL").select(F.explode(F.array(*KEYS)).alias("entry"), "h1", "size")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a, b = (sets.select(F.col("h1").alias(x), F.col("x").alias(f"x{x}")) for x in "ab")
    na, nb, both = F.size("xa"), F.size("xb"), F.size(F.array_intersect("xa", "xb"))
    fit = (F.least(na, nb) >= F.greatest(na, nb) * similarity) & (both >= (na + nb - both) * similarity)
    return pairs.join(a, "a").join(b, "b").filter(fit).select("a", "b")


def _grouped(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, h1, h2, first) of every row: first is (no id, doc_id, h1, h2) of the text that stands for its group."""
    docs = docs_only(docs, doc_id="bigint", text="string")
    rows = cut(_sketches(docs, width), "near-sketches")
    reps = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in ("size", "fp", *KEYS)))
    reps = cut(reps, "near-reps")
    with scratch() as keep:
        probes = _band_entries(reps).union(cut(_simhash_entries(reps), "near-simhash"))
        two, many = shared_entries(probes, "near")
        ids = small(two.select(F.col("a").alias("h1")).union(two.select("b")).union(many.select("h1")).distinct())
        places = small(cut(reps.join(ids, "h1").select("h1", F.col("least").alias("id")), "near-places"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                xs = [shingles(t.as_py(), width) for t in b.column("text")]
                kind = pa.list_(pa.int64())
                bits = np.array([parities(x) for x in xs], np.int64).reshape(-1, LANES)
                columns = [pa.array([len(x) for x in xs], pa.int32()), *(pa.array(bits[:, i]) for i in range(LANES))]
                yield pa.record_batch([b.column("h1"), pa.array(xs, kind), *columns], names=["h1", "x", "size", *(f"m{i}" for i in range(LANES))])

        texts = docs.filter("text IS NOT NULL").withColumn("h1", F.xxhash64("text")).join(places, "h1").filter("doc_id <=> id").select("h1", "text")
        sets = cut(map_arrow(texts, run, "h1 bigint, x array<bigint>, size int, " + ", ".join(f"m{i} bigint" for i in range(LANES))).dropDuplicates(["h1"]), "near-sets")
        # of sets at that similarity no more hashes are in one alone
        most = f"(sa + sb) * {(1 - similarity) / (1 + similarity)!r}D + 1e-6D"
        likely = lambda pairs: possible_pairs(pairs, sets, LANES, most)
        links = keep(decided_links(two, many, lambda pairs: _verified(likely(pairs), sets, similarity), "near", similarity))
    groups = components(links, "a", "b").select(F.col("node").alias("h1"), F.col("component").alias("group"))
    reps = reps.select("h1", "h2", "least").join(groups, "h1", "left").withColumn("group", F.coalesce("group", "h1"))
    first = reps.groupBy("group").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "h1", "h2")).alias("first"))
    reps = reps.join(first, "group").select("h1", "h2", "first")
    return rows.select("doc_id", "h1", "h2").join(reps, ["h1", "h2"])


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every row: groups of near duplicates.

    Two texts link when the Jaccard similarity of their shingles of
    ``width`` words is ``similarity`` or more. Candidates are texts whose
    SimHashes are linked, by multi-index hashing as in ``simhash_groups``, and
    those that MinHashes of the same shingles meet in BANDS bands of ROWS:
    SimHashes alone lose pairs with text added or cut, the bands miss a pair
    at 0.8 with a probability under 3e-5, whatever was changed.
    Shingle sets, counted in full, confirm them. Equal texts are one entry
    from the start; ``decided_links`` proves or connects every two texts that
    share a table entry, however many the entry has. Texts without words are
    duplicates of equal texts alone; null counts as empty. Texts of rows
    without an id link like any other. Null ids, repeated rows, empty tables:
    as ``simhash_groups``.
    """
    return _grouped(docs, width, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the smallest doc_id.

    Of equal rows with that doc_id one stays, and of different texts with it
    the one of the least hash; different texts of one doc_id that aren't near
    duplicates each stay. Rows with a null doc_id stay, for nothing tells
    them apart.
    """
    kept = _grouped(docs, width, similarity).filter("doc_id = first.doc_id AND h1 = first.h1 AND h2 = first.h2")
    kept = kept.groupBy(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.count("*").alias("_n"))
    kept = cut(kept, "near-kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"_own1": F.xxhash64(text), "_own2": F.xxhash64(F.lit(7), text)})
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_own1") == F.col("_h1")) & (F.col("_own2") == F.col("_h2"))
    out = own.join(small(kept.filter("_n = 1")), same, "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
    # whole texts are shuffled for repeated rows alone
    twice = kept.filter("_n > 1")
    if twice.isEmpty():
        return out
    return out.unionByName(own.join(small(twice), same, "left_semi").dropDuplicates(["doc_id", "_own1", "_own2"]).select(*docs.columns))
