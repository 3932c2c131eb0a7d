"""Language identification: a bidirectional GRU over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from .common import docs_only

#: Bytes that a window labels, and bytes of the text to either side that the network reads before them.
SPAN, EDGE = 480, 16
HIDDEN = 12
#: Labelled documents that training uses at most (about), and windows of each, from hashed places of the whole text.
TRAIN_DOCS, TRAIN_WINDOWS = 3000, 2
#: Bytes that a training window labels, passes over the windows and windows of a batch.
TRAIN_SPAN, EPOCHS, BATCH = 64, 6, 64
#: Windows that are labelled together.
TOGETHER = 1024


def windows(text: str, span: int = SPAN) -> tuple[np.ndarray, int]:
    """The lower-cased text's bytes in rows of EDGE + span + EDGE, each the next span with its surroundings, zeros outside the text; and their number."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    rows = -(-len(data) // span)
    flat = np.zeros(rows * span + 2 * EDGE, np.uint8)
    flat[EDGE : EDGE + len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(flat, span + 2 * EDGE)[::span] if rows else np.zeros((0, span + 2 * EDGE), np.uint8), len(data)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Two GRUs over bytes, one from each end, and a softmax at every position.

    Gates are ordered update, reset, candidate. ``in_d`` maps a byte
    straight to its share of the gates, so it also is the embedding.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        r = np.random.RandomState(seed)
        self.langs, self.hidden = langs, hidden
        self.w = {"out": r.normal(0, 0.3, (2 * hidden, len(langs))), "bias": np.zeros(len(langs))}
        for d in "fb":
            self.w |= {f"in_{d}": r.normal(0, 0.5, (256, 3 * hidden)), f"rec_{d}": r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _pass(self, x: np.ndarray, d: str, keep: list) -> np.ndarray:
        """States (steps, windows, hidden) of one direction over bytes (windows, steps); ``keep`` gets what the way back needs."""
        h, w, rec = self.hidden, self.w[f"in_{d}"], self.w[f"rec_{d}"]
        state = np.zeros((len(x), h), np.float32)
        out = np.empty((x.shape[1], len(x), h), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, b = w[x[:, t]], state @ rec
            zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            keep.append((t, state, z, r, c, b[:, 2 * h :]))
            state = out[t] = c + z * (state - c)
        return out

    def _states(self, x: np.ndarray, d: str, inside: np.ndarray | None) -> np.ndarray:
        """As ``_pass``, in place and without what only training needs; states are zero where not ``inside``."""
        h, dtype, (n, steps) = self.hidden, self.w["out"].dtype, x.shape
        # gates apart, for arrays in one piece are far faster; the sigmoid is 0.5 * tanh(0.5 x) + 0.5, so its inner factor goes into the weights
        gates = [[np.ascontiguousarray(self.w[f"{k}_{d}"][:, g * h : (g + 1) * h] * f).astype(dtype, copy=False) for k in ("in", "rec")] for g, f in ((0, 0.5), (1, 0.5), (2, 1))]
        by_step, partly = np.ascontiguousarray(x.T, np.intp), np.zeros(steps, bool) if inside is None else ~inside.all(0)
        out = np.empty((steps, n, h), dtype)
        state, z, r, c, back = np.zeros((n, h), dtype), *(np.empty((n, h), dtype) for _ in range(4))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            for gate, (w, rec) in zip((z, r), gates):
                np.take(w, by_step[t], axis=0, out=gate, mode="clip")
                np.dot(state, rec, out=back)
                gate += back
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
            w, rec = gates[2]
            np.take(w, by_step[t], axis=0, out=c, mode="clip")
            np.dot(state, rec, out=back)
            back *= r
            c += back
            np.tanh(c, out=c)
            state -= c
            state *= z
            state += c
            if partly[t]:
                state *= inside[:, t, None]
            out[t] = state
        return out

    def positions(self, x: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities (steps, windows, languages) at every byte but the EDGE on either side."""
        h = self.hidden
        states = [self._states(x, d, inside)[EDGE:-EDGE] for d in "fb"]
        steps, n, _ = states[0].shape
        # languages first: sums over the few languages are then sums of long rows
        logits = sum((s.reshape(-1, h) @ self.w["out"][i * h : (i + 1) * h]).T for i, s in enumerate(states)) + self.w["bias"][:, None]
        logits -= logits.max(0)
        logits -= np.log(np.exp(logits).sum(0))
        return logits.T.reshape(steps, n, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        s = np.concatenate([self._pass(x, d, kept[d]) for d in "fb"], 2)
        logp = _log_softmax(s @ self.w["out"] + self.w["bias"])
        n, h = x.size, self.hidden
        rows = np.arange(len(x))
        loss = -float(logp[:, rows, y].mean())
        dl = np.exp(logp)
        dl[:, rows, y] -= 1
        dl /= n
        g = {"out": np.einsum("tbh,tbk->hk", s, dl), "bias": dl.sum((0, 1))}
        ds = dl @ self.w["out"].T
        for i, d in enumerate("fb"):
            rec = self.w[f"rec_{d}"]
            g_in, g_rec = np.zeros_like(self.w[f"in_{d}"]), np.zeros_like(rec)
            back = np.zeros((len(x), h), np.float32)
            for t, prev, z, r, c, bc in reversed(kept[d]):
                dh = ds[t][:, i * h : (i + 1) * h] + back
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (prev - c) * z * (1 - z)
                dr = dc * bc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                db = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(g_in, x[:, t], da)
                g_rec += prev.T @ db
                back = dh * z + db @ rec.T
            g |= {f"in_{d}": g_in, f"rec_{d}": g_rec}
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over batches of windows; the mean loss of each pass."""
        r = np.random.RandomState(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            batches = np.array_split(r.permutation(len(x)), -(-len(x) // BATCH)) if len(x) else []
            total = 0.0
            for part in batches:
                loss, g = self.gradients(x[part], y[part])
                step, total = step + 1, total + loss
                lr = rate * (1 - (epoch + 0.5) / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for key, grad in g.items():
                    grad = np.clip(grad, -1, 1).astype(np.float32)
                    m[key] += 0.1 * (grad - m[key])
                    v2[key] += 0.001 * (grad * grad - v2[key])
                    self.w[key] -= (lr * m[key] / (np.sqrt(v2[key]) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(batches)))
        return losses


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


class Labeller:
    """Labels every byte of whole texts and pools the positions of each."""

    def __init__(self, net: BiGru):
        self.net = net

    def sums(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """(windows, languages): log probabilities summed over the labelled bytes of each window."""
        out, sizes = np.empty((len(x), len(self.net.langs))), inside[:, EDGE:-EDGE].sum(1)
        order = np.argsort(sizes, kind="stable")  # short windows together, in as few steps as they need
        for part in np.array_split(order, -(-len(x) // TOGETHER)):
            steps = int(sizes[part].max()) + 2 * EDGE
            within = inside[part, :steps]
            out[part] = np.einsum("tbk,bt->bk", self.net.positions(x[part, :steps], within), within[:, EDGE:-EDGE].astype(np.float32))
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability): the normalised geometric mean over all positions; und without a letter."""
        totals, sizes = np.zeros((len(texts), len(self.net.langs))), np.zeros(len(texts))
        pending: list[tuple[int, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> None:
            if pending:
                owner = np.concatenate([np.full(len(x), i) for i, x, _ in pending])
                np.add.at(totals, owner, self.sums(*(np.concatenate([p[k] for p in pending]) for k in (1, 2))))
                pending.clear()

        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                x, sizes[i] = windows(text)
                at = np.arange(0, len(x) * SPAN, SPAN)[:, None] + np.arange(-EDGE, SPAN + EDGE)
                for k in range(0, len(x), 8 * TOGETHER):
                    part = slice(k, k + 8 * TOGETHER)
                    pending.append((i, x[part], (at[part] >= 0) & (at[part] < sizes[i])))
                    count += len(pending[-1][1])
                    if count >= 8 * TOGETHER:
                        flush()
                        count = 0
        flush()
        logp = _log_softmax(totals / np.maximum(sizes, 1)[:, None])
        best = logp.argmax(1)
        return [(self.net.langs[b], float(np.exp(lp[b]))) if n else ("und", 0.0) for b, lp, n in zip(best, logp, sizes)]


def train(labelled: DataFrame, docs: int = TRAIN_DOCS, each: int = TRAIN_WINDOWS) -> BiGru:
    """A network from (key, text, lang) rows with a language.

    At most about ``docs`` rows, shared out evenly over the languages by a
    hash of the row, and ``each`` windows of every one's text, from hashed
    places, reach the driver. Rows without a language or a letter are no
    examples. Without any example the only language is und.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return BiGru(["und"])
    share, langs = docs / len(counts), sorted(counts)
    rates = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, share / n))))
    # by key and text, so that the rows of one key aren't taken or left together
    unit = F.pmod(F.xxhash64("key", "text", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    size = TRAIN_SPAN + 2 * EDGE
    place = lambda k: F.pmod(F.xxhash64("key", "text", F.lit(2 + k)), F.greatest(F.length("text") - size, F.lit(1))).cast("int") + 1
    parts = F.array(*(F.substring("text", place(k), F.lit(size)) for k in range(each)))
    got = sorted(map(tuple, rows.filter(unit < rates[F.col("lang")]).select("key", "lang", F.explode(parts).alias("part")).collect()))
    x = np.zeros((len(got), size), np.uint8)
    for row, (_, _, part) in zip(x, got):
        data = np.frombuffer(part.lower().encode()[:size], np.uint8)
        row[:] = np.resize(data, size)  # a short text is read again and again
    net = BiGru(langs)
    net.fit(x, np.array([langs.index(lang) for _, lang, _ in got]))
    return net


def predict(docs: DataFrame, net: BiGru) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text.

    und with score 0 for null texts and texts without a letter. Rows are
    labelled one by one, whatever their id; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for b in batches:
            got = labeller.label(b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs_only(docs, doc_id="bigint", text="string"), run, "doc_id bigint, lang_pred string, score double")


def fold(key: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of)).cast("int")
