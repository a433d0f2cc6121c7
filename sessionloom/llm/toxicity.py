"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over words and their characters.

A word (lower case, 24 characters at most; a longer run is several) is two
vectors: one of its own, by hash, and the mean of those of its character n-grams
with its ends marked, by hash too, so that words that were never seen have a
meaning by their parts.  Every window of WINDOW words, one every STRIDE words
and one at the end, runs through the network in both directions; attention pools
the states into one score.  A text has the score of its highest window, made a
probability by a logistic curve that is fitted on texts kept out of training,
for the labels' own shares.

Training: TRAIN_DOCS labelled documents of each label at most, of MAX_CHARS
characters at most (a bounded sample of rows; scoring covers whole texts of any
length).  Labels are of whole texts, so the first rounds take random windows and
the later ones the window of each text that the network scores highest.

A null or empty text, or one without a word, has score 0 and no windows.  Without
documents of both labels there is no model, and every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS, MAX_CHARS = 2000, 8000
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION, WORD_DIMS, CHAR_DIMS = 8, 8, 8, 12
WORD_BUCKETS, CHAR_BUCKETS, NGRAMS = 1 << 15, 1 << 15, (3, 4, 5)
RANDOM_ROUNDS, TOP_ROUNDS, BATCH, RATE, DROPPED, SEED = 2, 6, 128, 0.01, 0.5, 29

#: Words of a text taken at once, words whose projections a worker keeps, windows that run at once, texts of a slice.
SEGMENT, CACHE, BLOCK, SLICE = 1 << 15, 1 << 17, 512, 256
#: Products of so many rows stay in one thread of the matrix library, so that a task takes no more than its core.
SMALL = 128

_WORD = re.compile(r"\w{1,24}")
_PRIME = np.uint64(0x100000001B3)


def segments(text: str) -> Iterator[list[str]]:
    """The words of a text, SEGMENT at once; each part begins with the last WINDOW words of the one before."""
    text = text.lower()
    words = iter(_WORD.findall(text)) if len(text) < SEGMENT else (m[0] for m in _WORD.finditer(text))  # the same words
    held: list[str] = []
    while True:
        more = list(islice(words, SEGMENT))
        held += more
        if len(more) < SEGMENT:
            if held:
                yield held
            return
        yield held
        held = held[-WINDOW:]


def window_starts(n: int) -> np.ndarray:
    """Where windows begin in n words: every STRIDE words while a whole window is left, and at the last whole window."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of all words' n-grams in order, and how many each word has (one at least)."""
    marked = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(marked))  # signs from here to the word's end
    own = (marked + np.uint64(7)) * _PRIME ** left.astype(np.uint64)
    word = (np.add.reduceat(own, ends - sizes) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    places, grams = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ marked[at + k]) * _PRIME
        places.append(at)
        grams.append(((h ^ (h >> np.uint64(29))) >> np.uint64(7)).astype(np.int64) % CHAR_BUCKETS)
    at, gram = np.concatenate(places), np.concatenate(grams)
    owner = np.repeat(np.arange(len(words)), sizes)[at]
    order = np.argsort(owner, kind="stable")
    return word, gram[order], np.bincount(owner, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, and the forward and backward passes over windows of words (time first)."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        h, e = HIDDEN, WORD_DIMS + CHAR_DIMS

        def random(scale: float, *shape: int) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": random(0.01, WORD_BUCKETS, WORD_DIMS), "char": random(0.1, CHAR_BUCKETS, CHAR_DIMS), "wx": random(0.3, e, 6 * h), "bx": np.zeros(6 * h, np.float32),
                  "u": random(0.3, 2, h, 3 * h), "wa": random(0.3, 2 * h, ATTENTION), "va": random(0.3, ATTENTION), "wo": random(0.3, 2 * h), "bo": np.zeros(1, np.float32)}

    def embed(self, word: np.ndarray, gram: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The vector of each word."""
        starts = np.cumsum(counts) - counts
        chars = np.add.reduceat(self.p["char"][gram], starts) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][word], chars], 1)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.p["wx"] + self.p["bx"]

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Scores (log odds) of windows.  x: projections (time, window, 6 * HIDDEN); mask: 1 where there is a word, None if everywhere."""
        p, h, (t, b, _) = self.p, HIDDEN, x.shape
        state, states = np.zeros((2, b, h), np.float32), np.empty((t + 1, 2, b, h), np.float32)
        states[0] = 0
        gates = np.empty((t, 2, b, 4 * h), np.float32) if keep is not None else None  # update, reset, candidate, the state's part of it
        for k in range(t):
            both = np.stack([x[k, :, :3 * h], x[t - 1 - k, :, 3 * h:]])
            a = state @ p["u"]
            zr = _sigmoid(both[..., :2 * h] + a[..., :2 * h])
            z, reset = zr[..., :h], zr[..., h:]
            c = np.tanh(both[..., 2 * h:] + reset * a[..., 2 * h:])
            if gates is not None:
                gates[k] = np.concatenate([zr, c, a[..., 2 * h:]], -1)
            if mask is not None:
                z = z * np.stack([mask[k], mask[t - 1 - k]])[..., None]
            state = state + z * (c - state)
            states[k + 1] = state
        seen = np.concatenate([states[1:, 0], states[:0:-1, 1]], -1)  # (time, window, 2 * HIDDEN), both directions at one place
        tuned = np.tanh(seen @ p["wa"])
        weight = tuned @ p["va"]
        if mask is not None:
            weight = np.where(mask > 0, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * seen).sum(0)
        if keep is not None:
            keep |= {"states": states, "gates": gates, "seen": seen, "tuned": tuned, "weight": weight, "pooled": pooled, "mask": mask}
        return pooled @ p["wo"] + p["bo"]

    def backward(self, d: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the projections, and of the projections, for those of the scores."""
        p, h = self.p, HIDDEN
        seen, tuned, weight, mask = keep["seen"], keep["tuned"], keep["weight"], keep["mask"]
        t, b, _ = seen.shape
        g = {"wo": keep["pooled"].T @ d, "bo": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["wo"]
        d_seen = weight[..., None] * d_pooled
        d_weight = (seen * d_pooled).sum(-1)
        d_weight = weight * (d_weight - (weight * d_weight).sum(0))
        g["va"] = (tuned * d_weight[..., None]).sum((0, 1))
        d_tuned = d_weight[..., None] * p["va"] * (1 - tuned ** 2)
        g["wa"] = seen.reshape(t * b, -1).T @ d_tuned.reshape(t * b, -1)
        d_seen = d_seen + d_tuned @ p["wa"].T
        d_states = np.stack([d_seen[..., :h], d_seen[::-1, :, h:]], 1)  # by step of each direction
        d_x, d_u, d_state = np.empty((t, 2, b, 3 * h), np.float32), np.zeros_like(p["u"]), np.zeros((2, b, h), np.float32)
        for k in range(t - 1, -1, -1):
            d_state = d_state + d_states[k]
            before, gate = keep["states"][k], keep["gates"][k]
            z, reset, c, a = gate[..., :h], gate[..., h:2 * h], gate[..., 2 * h:3 * h], gate[..., 3 * h:]
            m = 1 if mask is None else np.stack([mask[k], mask[t - 1 - k]])[..., None]
            d_c = d_state * z * m * (1 - c ** 2)
            d_z = d_state * (c - before) * m * z * (1 - z)
            d_r = d_c * a * reset * (1 - reset)
            d_a = np.concatenate([d_z, d_r, d_c * reset], -1)
            d_x[k] = np.concatenate([d_z, d_r, d_c], -1)
            d_u += before.transpose(0, 2, 1) @ d_a
            d_state = d_state * (1 - z * m) + d_a @ p["u"].transpose(0, 2, 1)
        g["u"] = d_u
        return g, np.concatenate([d_x[:, 0], d_x[::-1, 1]], -1)


class Adam:
    def __init__(self, p: dict):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            p[k] -= RATE * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-8)


class Model:
    """A trained network and the logistic curve of its highest windows."""

    def __init__(self, network: Network, slope: float, offset: float):
        self.network, self.slope, self.offset = network, slope, offset


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of values by row."""
    return np.stack([np.bincount(rows, v, n) for v in values.T], 1).astype(np.float32)


def _rows_of(sizes: np.ndarray, offsets: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Places of the n-grams of the picked words."""
    n = sizes[picked]
    return np.repeat(offsets[picked] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Texts:
    """Training texts as numbers of words, with every window; word 0 stands for no word."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {"": 0}
        windows, owner = [], []
        for k, text in enumerate(texts):
            words = np.array([index.setdefault(w, len(index)) for part in segments(text) for w in part], np.int64)
            if len(words):
                padded = np.concatenate([words, np.zeros(max(0, WINDOW - len(words)), np.int64)])
                rows = padded[window_starts(len(words))[:, None] + np.arange(WINDOW)]
                windows.append(rows)
                owner += [k] * len(rows)
        self.windows = np.concatenate(windows) if windows else np.zeros((0, WINDOW), np.int64)
        self.owner = np.array(owner, np.int64)
        self.word, self.gram, self.sizes = hashed(["_", *list(index)[1:]])
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def scores(self, net: Network) -> np.ndarray:
        table = net.project(net.embed(self.word, self.gram, self.sizes))
        return np.concatenate([net.forward(table[w.T], _mask(w.T)) for w in (self.windows[i:i + BLOCK] for i in range(0, len(self.windows), BLOCK))] or [np.zeros(0, np.float32)])

    def learn(self, net: Network, adam: Adam, rows: np.ndarray, labels: np.ndarray, r: np.random.Generator) -> None:
        """One step on some windows; a share of DROPPED of the words shows its characters only."""
        places = self.windows[rows].T
        used, at = np.unique(places, return_inverse=True)
        at = at.reshape(places.shape)
        grams = _rows_of(self.sizes, self.offsets, used)
        counts = self.sizes[used]
        vectors = net.embed(self.word[used], self.gram[grams], counts)
        seen = (r.random((len(used), 1)) >= DROPPED).astype(np.float32)
        vectors[:, :WORD_DIMS] *= seen
        keep: dict = {}
        scores = net.forward(net.project(vectors)[at], _mask(places), keep)
        g, d_x = net.backward(((_sigmoid(scores) - labels) / len(labels)).astype(np.float32), keep)
        flat, d_flat = at.reshape(-1), d_x.reshape(-1, 6 * HIDDEN)
        g["bx"] = d_flat.sum(0)
        d_table = np.zeros((len(used), 6 * HIDDEN), np.float32)
        order = np.argsort(flat, kind="stable")
        d_table += np.add.reduceat(d_flat[order], np.searchsorted(flat[order], np.arange(len(used))))
        g["wx"] = vectors.T @ d_table
        d_vectors = d_table @ net.p["wx"].T
        g["word"] = _scatter(self.word[used], d_vectors[:, :WORD_DIMS] * seen, WORD_BUCKETS)
        g["char"] = _scatter(self.gram[grams], np.repeat(d_vectors[:, WORD_DIMS:] / counts[:, None], counts, 0), CHAR_BUCKETS)
        adam.step(net.p, g)


def _mask(places: np.ndarray) -> np.ndarray | None:
    mask = (places > 0).astype(np.float32)
    return None if mask.all() else mask


def highest(scores: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest score of each of n texts (-inf without windows), and which window has it (-1)."""
    top, at = np.full(n, -np.inf), np.full(n, -1, np.int64)
    order = np.lexsort((-np.arange(len(scores)), scores))
    top[owner[order]], at[owner[order]] = scores[order], order  # later ones, which are higher, win
    return top, at


def fit_curve(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (not falling) and offset of a weighted logistic regression whose targets keep off 0 and 1, by Newton's method."""
    n = [float((labels == v).sum()) for v in (0, 1)]
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.stack([scores, np.ones_like(scores)], 1)
    b = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weights * (p - target)) + np.array([1e-3 * b[0], 0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hess, grad)
        b = b - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = SEED) -> Model | None:
    """A model of texts and labels (0 or 1); every fifth text is kept out for the curve.  ``share``: how many of all labels are 1, if not as here."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    kept_out = np.zeros(len(y), bool)
    for v in (0, 1):  # of each label
        mine = order[y[order] == v]
        kept_out[mine[:len(mine) // 5]] = True
    held, net = _Texts([t or "" for t in texts]), Network(seed)
    adam, of_text = Adam(net.p), y[held.owner]
    usable = np.flatnonzero(~kept_out[held.owner])
    for k in range(RANDOM_ROUNDS + TOP_ROUNDS):
        if k < RANDOM_ROUNDS:
            _, some = np.unique(held.owner[usable[shuffled := r.permutation(len(usable))]], return_index=True)
            rows = np.concatenate([usable[shuffled[some]], r.choice(usable, min(len(usable), 2 * len(y)), replace=False)])
        else:
            top = highest(held.scores(net), held.owner, len(y))[1]
            top = top[(top >= 0) & ~kept_out]
            clean = usable[of_text[usable] == 0]
            rows = np.concatenate([top, top[of_text[top] == 1], r.choice(clean, min(len(clean), len(top)), replace=False)])
        rows = rows[r.permutation(len(rows))]
        for i in range(0, len(rows), BATCH):
            held.learn(net, adam, rows[i:i + BATCH], of_text[rows[i:i + BATCH]], r)
    top = highest(held.scores(net), held.owner, len(y))[0]
    fit = np.isfinite(top) & (kept_out if len(np.unique(y[kept_out])) == 2 else True)
    share = y.mean() if share is None else share
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(net, *fit_curve(top[fit], y[fit], weights[fit]))


# --- Spark -----------------------------------------------------------------------------------------------------------

def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = TRAIN_DOCS) -> Model | None:
    """A model of ``per_label`` labelled documents of each label at most.

    Ids are chosen from the labels, by hash, and go to the documents as a list that is broadcast (4 * ``per_label`` ids at most), so that no text is shuffled.
    A document with several labels counts as 1 if one of them is."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    ids = known.where("label = 0").orderBy("h", "doc_id").limit(2 * per_label).unionByName(known.where("label = 1").orderBy("h", "doc_id").limit(2 * per_label))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= MAX_CHARS).join(F.broadcast(ids), "doc_id")
    some = sorted((r["label"], r["h"], r["text"]) for r in rows.select("label", "h", "text").limit(8 * per_label).collect())
    texts = [[t for v, _, t in some if v == k][:per_label] for k in (0, 1)]
    return train([*texts[0], *texts[1]], [0] * len(texts[0]) + [1] * len(texts[1]), counts[1] / (counts[0] + counts[1]))


class _Numbers(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Scorer:
    """Scores texts in a worker; projections of words are kept between batches."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index, self.known = _Numbers({"": 0}), 1
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def _places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _learn_words(self) -> None:
        """Projections of the words that are new since the last time."""
        n, known = len(self.index), self.known
        while len(self.table) < n:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        new = list(islice(reversed(self.index), n - known))[::-1]
        for i in range(0, len(new), SEGMENT):
            vectors = self.model.network.embed(*hashed(new[i:i + SEGMENT]))
            for j in range(0, len(vectors), SMALL):
                at = known + i + j
                self.table[at:at + len(vectors[j:j + SMALL])] = self.model.network.project(vectors[j:j + SMALL])
        self.known = n

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability, number of windows and first word of the highest window (-1) of each text."""
        top, first, n = np.full(len(texts), -np.inf), np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def run() -> None:
            if not waiting:
                return
            self._learn_words()
            windows, owner, at = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            for i in range(0, len(windows), BLOCK):
                w = windows[i:i + BLOCK].T
                s, o, a = self.model.network.forward(self.table[w], _mask(w)), owner[i:i + BLOCK], at[i:i + BLOCK]
                best, row = highest(s, o, len(texts))
                better = best > top
                top[better], first[better] = best[better], a[row[better]]

        size = 0
        for k, text in enumerate(texts):
            begin = 0
            for words in segments(text or ""):
                if len(self.index) > CACHE:
                    run()
                    size = 0
                    self._forget()
                starts = window_starts(len(words))
                places = self._places(words)
                if len(places) < WINDOW:
                    places = np.concatenate([places, np.zeros(WINDOW - len(places), np.int64)])
                waiting.append((places[starts[:, None] + np.arange(WINDOW)], np.full(len(starts), k), begin + starts))
                n[k] += len(starts)
                size += len(starts)
                begin += len(words) - WINDOW
                if size >= BLOCK:
                    run()
                    size = 0
        run()
        p = 1 / (1 + np.exp(-np.clip(self.model.slope * np.where(np.isfinite(top), top, 0) + self.model.offset, -700, 700)))
        return np.where(np.isfinite(top), p, 0.0), n, first


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_windows, and first_word: where the highest window begins (null without windows)."""
    if model is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_windows"), F.lit(None).cast("long").alias("first_word"))
    held: list[Scorer] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(model))
        parts = [held[0].scores(texts.slice(i, SLICE).to_pylist()) for i in range(0, max(1, len(texts)), SLICE)]
        p, n, first = (np.concatenate(c) for c in zip(*parts))
        return pa.StructArray.from_arrays([pa.array(p), pa.array(n), pa.array(first, mask=first < 0)], names=["score", "n_windows", "first_word"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, "struct<score:double,n_windows:long,first_word:long>")(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), made.alias("s")).select("doc_id", "s.*")
