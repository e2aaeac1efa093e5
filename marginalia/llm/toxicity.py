"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offsets.

Labels are of documents, so words of the sample are labelled from them: a word,
or its first three to seven letters, is taken as toxic where it is in toxic
documents of the sample far more often than chance has it, and in next to no other. The field
(tags: plain, toxic) has weights for hashed features of a word (itself, its
beginnings, its end) and for transitions; it is trained on windows around such
words and on windows elsewhere. Marginals of whole documents come from forward
and backward recursions, iterated over all positions at once until they settle:
a step contracts, so a few rounds give the same numbers as a walk along the text.

A document's marginals are aggregated to the log-odds of its likeliest toxic word
and the log of the expected number of toxic words; its score is a logistic
function of both, fitted on a held-back part of the sample. Its offending offsets
are those of words that are toxic with over one half, in code points, end
exclusive. Words are runs without ASCII white space, in training and in use. Only `per_class` documents
of either label are learnt from; all documents are scored, whole. Null and empty
texts have no words and get the score of the least log-odds. Repeated rows get
equal results. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import text_chunks
from .labelled import fitted, sample

PER_CLASS = 2000
BUCKETS = 1 << 16
#: A stem is toxic when its rate in toxic documents is LEAST_TIMES that in others, and chance has it so once in e**SURPRISE.
LEAST_TIMES, SURPRISE = 25, 9.0
BEGINNINGS = (3, 4, 5, 6, 7)
MARKS = tuple(map(str, BEGINNINGS))
WINDOW, STEPS, SEED = 7, 150, 3
NONE = -12.0  # log-odds where there is no word
EDGES = ".,;:!?|*#%&$()[]{}\"'<>-_=+/\\~`^@"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def core(word: str) -> str:
    return word.lower().strip(EDGES)


def stems(w: str) -> tuple[str, ...]:
    """What may make a word toxic: itself, or how it begins."""
    return (w, *(w[:k] + "~" for k in BEGINNINGS if len(w) > k))


def features(w: str) -> list[int]:
    names = ("w" + w, *[n + w[:k] for k, n in zip(BEGINNINGS, MARKS)], "e" + w[-3:], f"l{min(len(w), 12)}")
    return [h % BUCKETS for h in map(xxhash.xxh32_intdigest, names)]


def toxic_stems(texts: list[list[str]], labels: np.ndarray) -> set[str]:
    """Stems that are in toxic documents far more often than chance has it; copies of a document count once."""
    bad, good = Counter(), Counter()
    seen = set()
    for ws, y in zip(texts, labels):
        own = set(ws)
        # one min-hash of runs of three words: copies and most near copies share it
        key = (int(y), min((xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(ws) - 2))), default=0))
        if key not in seen:
            seen.add(key)
            (bad if y else good).update({s for w in own for s in stems(w)})
    share = sum(bad.values()) / max(1, sum(bad.values()) + sum(good.values()))
    if not 0 < share < 1:
        return set()
    out = set()
    for s, c in bad.items():
        n = c + good[s]
        if c / n <= share:
            continue
        p = min(c / n, 1 - 1e-9)
        surprise = n * (p * math.log(p / share) + (1 - p) * math.log((1 - p) / (1 - share)))
        if surprise >= SURPRISE and c >= LEAST_TIMES * good[s] * share / (1 - share):
            out.add(s)
    return out


def passes(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log-odds that a message carries on, from log-odds x, over transitions a[from, to]."""
    return np.logaddexp(a[0, 1], a[1, 1] + x) - np.logaddexp(a[0, 0], a[1, 0] + x)


def marginals(e: np.ndarray, first: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log-odds of toxic at every position of texts laid end to end; first marks where each begins.

    Messages are kept as odds, in which a step (`passes` and `passes_back` of their logarithm) is a quotient of two sums.
    """
    n = len(e)
    if not n:
        return e
    own, t = np.exp(np.clip(e, -300, 300)), np.exp(a)
    # what is passed on forward is a text's first odds at its beginning, backward nothing at its end
    forward = settled(own, first, own, t[0, 1], t[1, 1], t[0, 0], t[1, 0])
    last = np.r_[first[1:], True][::-1]
    backward = settled(own[::-1], last, own[::-1], t[1, 0], t[1, 1], t[0, 0], t[0, 1])[::-1]
    # the backward message includes its own word's odds
    return np.log(forward) + np.log(backward) - np.clip(e, -300, 300)


def settled(own: np.ndarray, first: np.ndarray, start: np.ndarray, p: float, q: float, r: float, s: float) -> np.ndarray:
    """Odds x with x[i] = own[i] * (p + q * x[i - 1]) / (r + s * x[i - 1]), and start[i] where a text begins, iterated until none moves by 1e-9 of itself."""
    x = start.copy()
    inner = ~first[1:]
    on = None  # all, until most have settled
    while True:
        if on is None:
            before = x[:-1]
            new = np.where(inner, own[1:] * (p + q * before) / (r + s * before), x[1:])
            moved = np.abs(new - x[1:]) > 1e-9 * new
            x[1:] = new
            if 8 * np.count_nonzero(moved) > len(moved):
                continue
            on = np.flatnonzero(moved) + 1
        else:
            before = x[on - 1]
            new = own[on] * (p + q * before) / (r + s * before)
            moved = np.abs(new - x[on]) > 1e-9 * new
            x[on] = new
            on = on[moved]
        on = on + 1
        on = on[on < len(x)]
        on = on[~first[on]]
        if not len(on):
            return x


def passes_back(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[1, 0], a[1, 1] + x) - np.logaddexp(a[0, 0], a[0, 1] + x)


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions for windows of features x (windows, WINDOW, features) and tags y, by Adam on
    the conditional likelihood's gradient (expected from forward-backward minus observed counts)."""
    w, a = np.zeros(BUCKETS), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(a)]
    v = [np.zeros_like(w), np.zeros_like(a)]
    n = max(1, len(x))
    pairs = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            pairs[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j)).sum()
    for step in range(1, STEPS + 1):
        e = w[x].sum(2)
        f, b = e.copy(), np.zeros_like(e)
        for t in range(1, WINDOW):
            f[:, t] += passes(f[:, t - 1], a)
        for t in range(WINDOW - 2, -1, -1):
            b[:, t] = passes_back(e[:, t + 1] + b[:, t + 1], a)
        p = 1 / (1 + np.exp(-np.clip(f + b, -60, 60)))
        # pairs: the log-potentials of the four tags of neighbours, relative to plain, plain
        fo, bo = f[:, :-1], e[:, 1:] + b[:, 1:]
        four = np.stack([np.full_like(fo, a[0, 0]), a[0, 1] + bo, a[1, 0] + fo, a[1, 1] + fo + bo])
        four = np.exp(four - four.max(0))
        four = (four / four.sum(0)).sum((1, 2)).reshape(2, 2)
        gw = np.bincount(x.reshape(-1), np.repeat((p - y).reshape(-1), x.shape[2]), BUCKETS) / n + 1e-4 * w
        ga = (four - pairs) / n + 1e-4 * a
        for k, (g, value) in enumerate(((gw, w), (ga, a))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            value -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w, a


class Emissions(dict):
    """word as it stands -> the field's log-odds of toxic for it alone."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w.tolist()  # single numbers are read much faster from a list

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        c = core(word)
        self[word] = e = sum(map(self.w.__getitem__, features(c))) if c else NONE
        return e


def tag(per: list[list[str]], emissions: Emissions, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of all words, and the number of words of each text."""
    n = np.array([len(w) for w in per], np.int64)
    e = np.fromiter((emissions[w] for ws in per for w in ws), np.float64, int(n.sum()))
    first = np.zeros(len(e), bool)
    first[(np.cumsum(n) - n)[n > 0]] = True
    return marginals(e, first, a), n


def aggregated(odds: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text the highest log-odds and the log of the expected number of toxic words, both NONE at least."""
    out = np.full((len(n), 2), NONE)
    if len(odds):
        at = (np.cumsum(n) - n)[n > 0]
        out[n > 0, 0] = np.clip(np.maximum.reduceat(odds, at), NONE, -NONE)
        out[n > 0, 1] = np.log(np.add.reduceat(1 / (1 + np.exp(-np.clip(odds, -60, 60))), at) + math.exp(NONE))
    return out


def logistic(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the columns of z, and an offset, by Newton steps with a light ridge."""
    x = np.c_[z, np.ones(len(z))]
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(c))
        c = c - np.linalg.solve(h, x.T @ (p - y) + 0.05 * c)
    return c


def fit(texts: list[str], labels: list[int], share: float) -> bytes:
    y = np.array(labels, np.int64)
    raw = [WORD.findall(t) for t in texts]
    per = [[c for w in ws if (c := core(w))] for ws in raw]
    learn = np.arange(len(y)) % 8 != 0
    bad = toxic_stems([w for w, k in zip(per, learn) if k], y[learn])
    rng = np.random.default_rng(SEED)
    xs, ys = [], []
    starts = {c[:3] for ws, label, k in zip(per, y, learn) if label and k for c in ws if any(s in bad for s in stems(c))}
    for ws, label, k in zip(per, y, learn):
        if not k or len(ws) < WINDOW:
            continue
        tags = np.array([bool(label) and any(s in bad for s in stems(w)) for w in ws])
        hits = np.flatnonzero(tags)[:20]
        if not len(hits):  # words that begin like toxic ones teach the field where those end
            hits = np.array([i for i, c in enumerate(ws) if c[:3] in starts][:20], np.int64)
        at = np.r_[np.clip(hits - WINDOW // 2, 0, len(ws) - WINDOW), rng.integers(0, len(ws) - WINDOW + 1, 8)]
        for i in at:
            xs.append([features(w) for w in ws[i : i + WINDOW]])
            ys.append(tags[i : i + WINDOW])
    w, a = train(np.array(xs), np.array(ys).astype(float)) if xs else (np.zeros(BUCKETS), np.zeros((2, 2)))
    emissions = Emissions(w)
    c = np.array([1.0, 0.0, 0.0])
    if len(y):
        z = aggregated(*tag(raw, emissions, a))
        if (~learn).any():
            c = logistic(z[~learn], y[~learn].astype(float))
        own = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        share = float(np.clip(share, 1e-3, 1 - 1e-3))
        c[-1] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    out = io.BytesIO()
    np.savez(out, w=w.astype(np.float32), a=a, c=c)
    return out.getvalue()


SPANS = "array<struct<start:long,end:long,probability:double>>"


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score and spans (offending words: start, end, probability) of every document."""
    rows, share = sample(docs, labels, label, per_class)
    model = docs.sparkSession.sparkContext.broadcast(fitted(rows, lambda texts, ys: fit(texts, ys, share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = dict(np.load(io.BytesIO(model.value)))
        emissions = Emissions(m["w"].astype(np.float64))
        for texts, ids in text_chunks(batches, ["text", "doc_id"]):
            odds, n = tag([WORD.findall(t or "") for t in texts], emissions, m["a"])
            z = np.clip(aggregated(odds, n) @ m["c"][:-1] + m["c"][-1], -50, 50)
            found = []
            ends = np.cumsum(n)
            for text, lo, hi in zip(texts, ends - n, ends):
                hits = set(np.flatnonzero(odds[lo:hi] > 0).tolist())
                places = [(k, x.span()) for k, x in enumerate(WORD.finditer(text)) if k in hits] if hits else []
                found.append([{"start": s, "end": e, "probability": float(1 / (1 + np.exp(-odds[lo + k])))} for k, (s, e) in places])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(1 / (1 + np.exp(-z))), "spans": pa.array(found, kind)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, spans {SPANS}")
