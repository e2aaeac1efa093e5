"""Quality classifier: random-indexing vectors, pooled, under a two-layer network.

A document's units are its words (hashed) and the shapes of its words (runs of
upper case, lower case, digits and each other sign, runs squeezed), and a mark
for a word that repeats the one before. Each unit has a sparse random index
vector; its word vector is that plus the summed index vectors of the units
around it in the sample. A document is the mean of its units' vectors, with
their lengths and a few rates. A network of one hidden layer, trained with Adam,
gives a logit, divided by a temperature fitted on a part of the sample that the
network didn't see, and moved to the labels' true share.

Only `per_class` documents of either label are learnt from (a bound, not a
share of the corpus); every document is scored, whole. Empty and null texts are
a document without units and get the network's score for that. Repeated rows get
equal scores. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .labelled import fitted, held_out, sample

PER_CLASS = 2000
DIM, WORDS, SHAPES = 32, 1 << 14, 1 << 10
HIDDEN, EPOCHS, SEED = 32, 120, 7
WINDOW = 2

CLASSES = bytes(88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class Units(dict):
    """word -> its word unit and shape unit in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = RUNS.sub(rb"\1", word.translate(CLASSES))[:12]
        core = word.lower().strip(b".,;:!?|*#%&$()[]\"'")
        self[word] = n = (xxhash.xxh64_intdigest(core) % WORDS) * SHAPES + 1 + xxhash.xxh64_intdigest(shape) % (SHAPES - 1)
        return n


def units(texts: list[str | None], cache: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word units, shape units (0: repeats the word before) and words a document; characters a document."""
    per = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    n = np.array([len(w) for w in per], np.int64)
    flat = np.fromiter((cache[w] for ws in per for w in ws), np.int64, int(n.sum()))
    word, shape = flat // SHAPES, flat % SHAPES
    repeat = np.r_[False, flat[1:] == flat[:-1]] if len(flat) else np.zeros(0, bool)
    starts = np.r_[0, np.cumsum(n)[:-1]] if len(n) else np.zeros(0, np.int64)
    repeat[starts[n > 0]] = False
    return word, np.where(repeat, 0, shape), n, np.array([len(t or "") for t in texts], np.int64)


def index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 8, (n, DIM)) == 0).astype(np.float32) * rng.choice(np.float32([-1, 1]), (n, DIM))


def word_vectors(unit: np.ndarray, doc: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Each unit's index vector and the direction of its neighbours'."""
    out = np.zeros(index.shape, np.float64)
    for step in range(1, WINDOW + 1):
        near = doc[step:] == doc[:-step]
        for a, b in ((unit[step:][near], unit[:-step][near]), (unit[:-step][near], unit[step:][near])):
            for d in range(DIM):
                out[:, d] += np.bincount(a, index[b, d], len(index))
    unit_length = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return (unit_length(out) + unit_length(index.astype(np.float64))).astype(np.float32)


def pooled(word: np.ndarray, shape: np.ndarray, n: np.ndarray, chars: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """A row of features for each document."""
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    mean = lambda rows: np.add.reduceat(rows, starts, axis=0) / n[full, None]
    out = np.zeros((len(n), 2 * DIM + 5), np.float32)
    if len(full):
        a, b = mean(words[word]), mean(shapes[shape])
        out[full, :DIM], out[full, DIM : 2 * DIM] = a, b
        out[full, 2 * DIM] = np.linalg.norm(a, axis=1)
        out[full, 2 * DIM + 1] = np.linalg.norm(b, axis=1)
        out[full, 2 * DIM + 2] = mean((shape == 0).astype(np.float32)[:, None])[:, 0]
    out[:, 2 * DIM + 3] = np.log1p(n)
    out[:, 2 * DIM + 4] = chars / np.maximum(n, 1)
    out[:, 2 * DIM + 4] = np.minimum(out[:, 2 * DIM + 4], 40)
    return out


def forward(x: np.ndarray, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ m["w1"] + m["b1"])
    return h, (h @ m["w2"] + m["b2"])[:, 0]


def train(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    m = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), "b2": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            a, b = x[order[i : i + 128]], y[order[i : i + 128]]
            h, z = forward(a, m)
            g = ((1 / (1 + np.exp(-z)) - b) / len(b))[:, None]
            back = (g @ m["w2"].T) * (1 - h * h)
            grads = {"w1": a.T @ back + 1e-3 * m["w1"], "b1": back.sum(0), "w2": h.T @ g + 1e-3 * m["w2"], "b2": g.sum(0)}
            t += 1
            for k, v in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = m[k] - 3e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return m


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits that makes held-back labels likeliest."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], labels: list[int], share: float) -> bytes:
    cache = Units()
    word, shape, n, chars = units(texts, cache)
    doc = np.repeat(np.arange(len(n)), n)
    words = word_vectors(word, doc, index_vectors(WORDS, SEED))
    shapes = word_vectors(shape, doc, index_vectors(SHAPES, SEED + 1))
    # in blocks of documents, since a unit's row is wide
    blocks = [np.s_[i : i + 500] for i in range(0, len(n), 500)]
    ends = np.r_[0, np.cumsum(n)]
    x = np.concatenate([pooled(word[ends[b.start] : ends[min(b.stop, len(n))]], shape[ends[b.start] : ends[min(b.stop, len(n))]], n[b], chars[b], words, shapes) for b in blocks] or [np.zeros((0, 2 * DIM + 5), np.float32)])
    y = np.array(labels, np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = (x - mean) / scale
    kept = np.arange(len(x)) % 5 == 0
    m = train(x[~kept], y[~kept])
    t = temperature(forward(x[kept], m)[1], y[kept]) if kept.any() else 1.0
    own = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    share = float(np.clip(share if len(y) else 0.5, 1e-3, 1 - 1e-3))
    out = io.BytesIO()
    np.savez(out, words=words, shapes=shapes, mean=mean, scale=scale, temperature=t, shift=np.log(share / (1 - share)) - np.log(own / (1 - own)), **m)
    return out.getvalue()


def with_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, out: str = "score") -> DataFrame:
    """All columns of docs and the probability of label 1."""
    rows, share = sample(docs, labels, label, per_class)
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, lambda texts, ys: fit(texts, ys, share)))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = dict(np.load(io.BytesIO(model.value)))
        cache = Units()
        for s in batches:
            found = []
            for (texts,) in text_chunks(iter([pa.RecordBatch.from_arrays([pa.array(s, pa.string())], ["text"])]), ["text"], 1_000_000):
                x = (pooled(*units(texts, cache), m["words"], m["shapes"]) - m["mean"]) / m["scale"]
                z = forward(x, m)[1] / m["temperature"] + m["shift"]
                found.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn(out, of(F.coalesce("text", F.lit(""))))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score of every document."""
    return with_scores(docs.select("doc_id", "text"), labels, label, per_class).select("doc_id", "score")


def judged(scored: DataFrame, least: float) -> DataFrame:
    """Scores with held_out and predicted; further columns follow."""
    more = [c for c in scored.columns if c not in ("doc_id", "score")]
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *more)
