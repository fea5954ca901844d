"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (letters, A-Z as a-z, with a blank before and after) in both
directions and gives every position a distribution over the languages. A document's
probabilities are the mean over all positions of all its words. It is trained in numpy by
backpropagation through time on a bounded, balanced sample of labelled documents; since its
state starts anew with every word, each distinct word of a slice of text is run once.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every
text if no row is labelled; words of over ``LONGEST`` bytes are read in pieces; equal
probabilities go to the language that sorts first; an empty table gives an empty one; further
columns are kept, those named like an output are replaced.

Bounds: ``docs_per_language`` documents (expected; twice that at most over all) and
``words_per_language`` words of them train the network. Counting languages and predicting
cover all rows. More than ``MAX_LANGUAGES`` languages raise a ValueError, as the output layer has a row for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.llm.memory import give_back
from tidewave.llm.words import LETTERS, Words, pieces, words_of

UNKNOWN = "und"
HIDDEN = 16
LONGEST = 24
STEPS = 500
BATCH = 512
RATE = 0.02
DOCS_PER_LANGUAGE = 150
WORDS_PER_LANGUAGE = 20_000
MAX_LANGUAGES = 500
ROWS_AT_ONCE = 8192
BLANK = 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Direction:
    """One gated recurrent layer; gates in the order update, reset, candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of x (places, rows); with ``keep`` also what backward needs."""
        n = self.h
        state = np.zeros((x.shape[1], n), np.float32)
        states, saved = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            a, b = self.w[x[t]], state @ self.u
            gates = sigmoid(a[:, :2 * n] + b[:, :2 * n])
            z, r = gates[:, :n], gates[:, n:]
            candidate = np.tanh(a[:, 2 * n:] + r * b[:, 2 * n:])
            if keep:
                saved.append((state, z, r, candidate, b[:, 2 * n:]))
            state = z * state + (1 - z) * candidate
            states[t] = state
        return states, saved

    def backward(self, x: np.ndarray, saved: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and u from those of the states, through time."""
        n = self.h
        du = np.zeros_like(self.u)
        da = np.empty((*x.shape, 3 * n), np.float32)
        later = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            state, z, r, candidate, inner = saved[t]
            d = given[t] + later
            dc = d * (1 - z) * (1 - candidate**2)
            dz = d * (state - candidate) * z * (1 - z)
            dr = dc * inner * r * (1 - r)
            da[t] = np.concatenate([dz, dr, dc], axis=1)
            db = np.concatenate([dz, dr, dc * r], axis=1)
            du += state.T @ db
            later = d * z + db @ self.u.T
        flat = x.reshape(-1)
        one_hot = np.zeros((len(flat), 256), np.float32)
        one_hot[np.arange(len(flat)), flat] = 1
        return one_hot.T @ da.reshape(-1, 3 * n), du


class Network:
    """Both directions and the layer that labels positions."""

    def __init__(self, n_languages: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.v = rng.normal(0, 0.3, (2 * hidden, n_languages)).astype(np.float32)
        self.c = np.zeros(n_languages, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.v, self.c]

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each position of x (places, rows)."""
        ahead, _ = self.ahead.forward(x)
        back, _ = self.back.forward(x[::-1])
        n = self.ahead.h
        return softmax(ahead @ self.v[:n] + back[::-1] @ self.v[n:] + self.c)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions and its gradients, in the order of ``parameters``."""
        ahead, saved_ahead = self.ahead.forward(x, True)
        back, saved_back = self.back.forward(x[::-1], True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        p = softmax(both @ self.v + self.c)
        rows = np.arange(x.shape[1])
        loss = float(-np.log(p[:, rows, y] + 1e-9).mean())
        p[:, rows, y] -= 1
        p /= np.float32(p.shape[0] * p.shape[1])
        n, k = self.ahead.h, len(self.c)
        dv = both.reshape(-1, 2 * n).T @ p.reshape(-1, k)
        given = p @ self.v.T
        dwa, dua = self.ahead.backward(x, saved_ahead, given[:, :, :n])
        dwb, dub = self.back.backward(x[::-1], saved_back, given[::-1, :, n:])
        return loss, [dwa, dua, dwb, dub, dv, p.sum(axis=(0, 1))]


@dataclass
class Model:
    languages: list[str]
    network: Network | None


def segments(words: Words, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of equally long words or pieces (places, rows), and the index in ``chosen`` of each."""
    starts, ends = words.starts[chosen], words.ends[chosen]
    n = np.maximum(1, -(-(ends - starts) // LONGEST))
    owner = np.repeat(np.arange(len(chosen)), n)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    a = starts[owner] + turn * LONGEST
    size = np.minimum(ends[owner] - a, LONGEST)
    for length in np.unique(size).tolist():
        same = np.flatnonzero(size == length)
        for k in range(0, len(same), ROWS_AT_ONCE):
            some = same[k:k + ROWS_AT_ONCE]
            x = np.full((length + 2, len(some)), BLANK, np.uint8)
            x[1:-1] = words.data[a[some][None, :] + np.arange(length)[:, None]]
            yield x, owner[some]


def train(
    texts: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE,
    words_per_language: int = WORDS_PER_LANGUAGE, seed: int = 5,
) -> Model:
    """Train on (language, text) pairs; the same pairs in the same order give the same model."""
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return Model([], None)
    rng = np.random.default_rng(seed)
    words = words_of(pa.array([t for _, t in texts], pa.string()), LETTERS)
    number = {lang: i for i, lang in enumerate(languages)}
    label = np.repeat([number[lang] for lang, _ in texts], words.counts)
    chosen = [np.flatnonzero(label == i) for i in range(len(languages))]
    chosen = np.concatenate([rng.choice(c, words_per_language) for c in chosen if len(c)] or [np.empty(0, np.int64)])
    network = Network(len(languages), hidden, seed)
    if not len(chosen):
        return Model(languages, network)
    sized: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for x, owner in segments(words, chosen):
        sized.setdefault(len(x), []).append((x, label[chosen[owner]]))
    groups = [(np.concatenate([x for x, _ in g], axis=1), np.concatenate([y for _, y in g])) for g in sized.values()]
    weight = np.asarray([g[0].size for g in groups], float)
    mean = [np.zeros_like(p) for p in network.parameters()]
    square = [np.zeros_like(p) for p in network.parameters()]
    for step in range(1, steps + 1):
        x, y = groups[rng.choice(len(groups), p=weight / weight.sum())]
        some = rng.integers(0, len(y), batch)
        _, found = network.gradients(x[:, some], y[some])
        pace = rate * (1 - (step - 1) / steps)
        for p, g, m, s in zip(network.parameters(), found, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(languages, network)


def sampled_texts(docs: DataFrame, text: str, lang: str, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` (language, text) pairs of each language, chosen by a hash of the row."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), *(F.col(f"`{c}`") for c in docs.columns if c not in (lang, text)))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    rate = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))))
    draw = F.pmod(F.xxhash64("text", *(c for c in labelled.columns if c not in ("lang", "text"))), F.lit(1 << 20)) / float(1 << 20)
    rows = labelled.where(draw < rate[F.col("lang")]).select("lang", "text").limit(2 * per_language * len(counts)).collect()
    return sorted((r[0], r[1]) for r in rows)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn from the rows with a language; the caller leaves out those held back."""
    return train(sampled_texts(docs, text, lang, docs_per_language))


def probabilities(model: Model, column: pa.Array) -> np.ndarray:
    """Mean over all positions of each text's words; rows of zeros for texts without words."""
    words = words_of(column, LETTERS)
    k = len(model.languages)
    out = np.zeros((len(column), k))
    if model.network is None or not len(words.hashes):
        return out
    _, chosen, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    total, places = np.zeros((len(chosen), k)), np.zeros(len(chosen))
    for x, owner in segments(words, chosen):
        np.add.at(total, owner, model.network.label(x).sum(axis=0))
        np.add.at(places, owner, len(x))
    inverse = inverse.reshape(-1)
    rows = np.repeat(np.arange(len(column)), words.counts)
    n = np.bincount(rows, places[inverse], len(column))
    for i in range(k):
        out[:, i] = np.bincount(rows, total[inverse, i], len(column)) / np.maximum(n, 1)
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """Add the language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (lang_column, score_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            where = {n: i for i, n in enumerate(batch.schema.names)}
            for a, b in pieces(batch.column(where[text])):
                part = batch.slice(a, b - a)
                p = probabilities(known, part.column(where[text]))
                letter = np.asarray(part.column(where["_letter"]).to_pylist(), bool)
                sure = letter & (p.sum(axis=1) > 0) if p.shape[1] else np.zeros(len(p), bool)
                best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(p), int)
                names = [known.languages[i] if s else UNKNOWN for i, s in zip(best.tolist(), sure.tolist())]
                score = np.where(sure, p.max(axis=1), 0.0) if p.shape[1] else np.zeros(len(p))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(where[c]) for c in kept), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64())],
                    names=[*kept, lang_column, score_column])
        give_back()

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(lang_column, T.StringType()), T.StructField(score_column, T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn("_letter", has_letter(F.col(text))).mapInArrow(run, schema)
