"""Quality classifier from positive and unlabelled documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from .common import docs_only

#: Positive and unlabelled documents that training uses at most (about), each.
SAMPLE = 4000
HIDDEN, EPOCHS, BATCH = 16, 60, 256
FEATURES = 19
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+<=>@[\\]^_`{}~"]] = True


def features(text: str | None) -> np.ndarray:
    """Shares and logs that describe a whole text; all finite, all zero but for the constant ones when it is empty."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256).astype(float)
    words = text.split()
    n, chars = max(1, len(words)), max(1.0, raw.sum() - raw[9:14].sum() - raw[32])
    upper, lower = raw[65:91].sum(), raw[97:123].sum()
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    of = lambda s: raw[[ord(c) for c in s]].sum()
    top = max(seen.values(), default=0)
    return np.array([
        np.log1p(len(words)), chars / n / 10, len(seen) / n, top / n, np.log1p(top),
        upper / max(1.0, upper + lower), raw[_SYMBOLS].sum() / chars, of("|") / n, of("!?") / n, of(".,;:") / n,
        raw[48:58].sum() / chars, raw[128:].sum() / chars, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in seen.items() if len(w) <= 3) / n, sum(c for w, c in seen.items() if not w.isalpha()) / n,
        sum(c for w, c in seen.items() if len(w) > 20) / n, float(not words),
        sum(map(str.__eq__, words, words[1:])) / n,
    ])


class PuNet:
    """One hidden layer over standardised features, trained on the non-negative unbiased risk.

    With class prior p, positives P and unlabelled U the risk is
    p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]) under the sigmoid loss;
    a batch whose second part is negative steps back up that part alone.
    """

    def __init__(self, mean: np.ndarray, sd: np.ndarray, hidden: int = HIDDEN, seed: int = 2):
        r = np.random.RandomState(seed)
        self.mean, self.sd = mean, sd
        self.w = [r.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.sd, -8, 8)
        return z, np.tanh(z @ self.w[0] + self.w[1])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x)[1] @ self.w[2] + self.w[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 0.5 * np.tanh(0.5 * self.raw(x)) + 0.5

    def _grad(self, x: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        """Gradients for d = the loss's derivative by each raw output."""
        z, h = self._hidden(x)
        dh = np.outer(d, self.w[2]) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 4) -> None:
        """``prior`` None: plain logistic regression of positive against unlabelled, for the prior's estimate."""
        r = np.random.RandomState(seed)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            parts = max(1, -(-len(unl) // BATCH))
            for p, u in zip(np.array_split(r.permutation(len(pos)), parts), np.array_split(r.permutation(len(unl)), parts)):
                if not len(p) or not len(u):
                    continue
                xp, xu = pos[p], unl[u]
                sp, su = self.score(xp), self.score(xu)
                if prior is None:
                    parts_g = [(xp, (sp - 1) / len(p)), (xu, su / len(u))]
                else:
                    dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
                    if su.mean() - prior * sp.mean() >= 0:
                        parts_g = [(xp, -prior * dp - prior * dp), (xu, du)]
                    else:
                        parts_g = [(xp, prior * dp), (xu, -du)]
                grads = [a + b for a, b in zip(*(self._grad(x, d) for x, d in parts_g))]
                step += 1
                for i, g in enumerate(grads):
                    g = g + 1e-4 * self.w[i]
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among the unlabelled, from held-out scores of each.

    For every threshold the unlabelled share above it, divided by the
    positives' share above it, bounds the prior from above; the best bound
    after a confidence term is taken (best bin estimation).
    """
    levels = np.unique(pos)
    above = lambda s: 1 - np.searchsorted(np.sort(s), levels, "left") / len(s)
    p, u = above(pos), above(unl)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(unl)) + 1 / np.sqrt(len(pos)))
    best = np.argmin((u + slack) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.98))


def learn(pos: np.ndarray, unl: np.ndarray) -> tuple[PuNet, float]:
    """A network and the estimated class prior; without positives or unlabelled rows every score is about one half."""
    if not len(pos) or not len(unl):
        net = PuNet(np.zeros(FEATURES), np.ones(FEATURES))
        net.w[2:] = [np.zeros_like(net.w[2]), np.zeros(1)]
        return net, 0.5
    both = np.concatenate([pos, unl])
    mean, sd = both.mean(0), both.std(0) + 1e-6
    half_p, half_u = np.arange(len(pos)) % 2 == 0, np.arange(len(unl)) % 2 == 0
    scout = PuNet(mean, sd)
    scout.fit(pos[half_p], unl[half_u], None, epochs=30)
    # one row on its own has no other half
    prior = class_prior(scout.raw(pos[~half_p] if len(pos) > 1 else pos), scout.raw(unl[~half_u] if len(unl) > 1 else unl))
    net = PuNet(mean, sd)
    net.fit(pos, unl, prior)
    return net, prior


def _features(docs: DataFrame, extra: str) -> DataFrame:
    """(extra, x) of the rows of (extra, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()).tolist() for t in b.column("text")]
            yield pa.record_batch([b.column(extra), pa.array(x, pa.list_(pa.float64()))], names=[extra, "x"])

    return map_arrow(docs.select(extra, "text"), run, f"{extra} {dict(docs.dtypes)[extra]}, x array<double>")


def train(rows: DataFrame, texts: DataFrame, sample: int = SAMPLE) -> tuple[PuNet, float]:
    """A network from (key, positive boolean) rows and the (key, text) of all of them.

    Rows with positive true are the trusted positives; all rows, those
    among them, are the unlabelled text. About ``sample`` of each are picked
    by a hash of the key, without their texts; the picked keys, bounded by
    the sample, are then met with the texts where they lie, and only
    descriptions of those reach the driver.
    """
    n = rows.agg(F.count("*").alias("u"), F.count_if("positive").alias("p")).first()
    unit = lambda s: F.pmod(F.xxhash64("key", F.lit(s)), F.lit(1 << 30)) / float(1 << 30)
    as_pos = F.coalesce(F.col("positive"), F.lit(False)) & (unit(1) < sample / max(1, n["p"]))
    as_unl = unit(2) < sample / max(1, n["u"])
    role = as_pos.cast("int") + 2 * as_unl.cast("int")
    # the limit is a bound on what is broadcast; a hashed sample of 2 * sample rows doesn't come near it
    picked = rows.withColumn("role", role).filter("role > 0").select("key", "role").distinct().limit(8 * sample)
    met = texts.join(F.broadcast(picked), "key").select(F.struct("key", "role").alias("who"), "text")
    got = sorted((r["who"]["key"] or 0, r["who"]["role"], r["x"]) for r in _features(met, "who").collect())
    take = lambda bit: np.array([x for _, k, x in got if k & bit]).reshape(-1, FEATURES)
    return learn(take(1), take(2))


def score_documents(docs: DataFrame, net: PuNet) -> DataFrame:
    """(doc_id, score) of every row from its whole text; null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("text")]).reshape(-1, FEATURES)
            yield pa.record_batch([b.column("doc_id"), pa.array(sent.value.score(x), pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs_only(docs, doc_id="bigint", text="string"), run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, net: PuNet, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(-1, FEATURES)
            yield b.filter(pa.array(sent.value.score(x) >= least, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
