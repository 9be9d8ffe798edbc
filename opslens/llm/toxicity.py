"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

* Token labels: a feature of a word (the word, its prefixes of 4 to 6 letters) that occurs significantly more
  in the documents labelled toxic marks the words that carry it there as toxic tokens.
* The field has two states.  Weights of the features, of the transitions and of the start are fitted to the
  token labels by gradient ascent on windows of the labelled documents.
* Forward-backward gives every word's probability of being toxic.  Only words with a weight differ from the
  default word; the chain steps over a run of g default words by one power of a 2x2 matrix, so the cost of a
  document is reading its words plus a little per weighted word.
* A logistic function of the marginals (sum, maximum, density) gives the score.

Only the labelled sample comes to the driver: at most ``max_toxic`` and ``max_clean`` documents.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample that the field is fitted on.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: Longest part of a sampled document that is used for fitting, in words; scoring reads whole texts.
WINDOW = 64
WINDOWS = 6_000
WORD = re.compile(r"\w+")
KEPT = 400_000
STEPS = 30
FAR = 4096


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    start: tuple[float, float]
    moves: tuple[float, float, float, float]  # log weights of 0>0, 0>1, 1>0, 1>1
    doc: tuple[float, ...]  # logistic weights of the document, constant last


def features(word: str) -> list[str]:
    low = word.lower()
    return ["w" + low, *(f"{n}{low[:n]}" for n in (4, 5, 6) if len(low) > n)]


class Emissions(dict):
    """Weight of a word in the toxic state beside the bias; remembers the words of a task."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) >= KEPT:
            self.clear()
        self[word] = value
        return value


class Tagger:
    def __init__(self, model: Model):
        self.model, self.emissions = model, Emissions(model.weights)
        self.a = np.exp(np.array(model.moves).reshape(2, 2))
        self.default = self.a * np.array([1.0, np.exp(model.bias)])
        self.jumps: dict[int, tuple[float, ...]] = {0: (1.0, 0.0, 0.0, 1.0)}

    def jump(self, gap: int) -> tuple[float, ...]:
        gap = min(gap, FAR)
        if gap not in self.jumps:
            out, square, n = np.eye(2), self.default / self.default.max(), gap
            while n:
                if n & 1:
                    out = out @ square
                    out /= out.max()
                square = square @ square
                square /= square.max()
                n >>= 1
            self.jumps[gap] = tuple(out.ravel())
        return self.jumps[gap]

    def marginals(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(numbers of the weighted words, their probability of being toxic, number of all words)."""
        found = WORD.findall(text)
        n = len(found)
        weight = np.fromiter(map(self.emissions.__getitem__, found), float, n)
        at = np.flatnonzero(weight)
        if not len(at):
            return at, np.zeros(0), n
        a00, a01, a10, a11 = self.a.ravel().tolist()
        lift = np.exp(np.clip(weight[at] + self.model.bias, -50, 50)).tolist()
        places = at.tolist()
        p, q = np.exp(self.model.start).tolist()
        first = True
        forward = []
        last = -1
        for i, e in zip(places, lift, strict=True):
            gap = i - last - 1
            if first and gap:
                q, gap, first = q * float(np.exp(self.model.bias)), gap - 1, False
            if gap:
                j00, j01, j10, j11 = self.jump(gap)
                p, q = p * j00 + q * j10, p * j01 + q * j11
            p, q = (p, q * e) if first else (p * a00 + q * a10, (p * a01 + q * a11) * e)
            first, total, last = False, p + q, i
            p, q = p / total, q / total
            forward.append((p, q))
        j00, j01, j10, j11 = self.jump(n - 1 - last)
        p, q = j00 + j01, j10 + j11
        out = [0.0] * len(places)
        for k in range(len(places) - 1, -1, -1):
            f0, f1 = forward[k]
            out[k] = f1 * q / (f0 * p + f1 * q)
            if k:
                e = lift[k]
                p, q = a00 * p + a01 * q * e, a10 * p + a11 * q * e
                gap = places[k] - places[k - 1] - 1
                if gap:
                    j00, j01, j10, j11 = self.jump(gap)
                    p, q = j00 * p + j01 * q, j10 * p + j11 * q
                total = p + q
                p, q = p / total, q / total
        return at, np.array(out), n

    def summary(self, text: str | None, read: tuple | None = None) -> np.ndarray:
        _, p, n = read or self.marginals(text or "")
        return np.array([np.log1p(p.sum()), p.max() if len(p) else 0.0, p.sum() / max(n, 1), 1.0])

    def score(self, text: str | None, read: tuple | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(text, read) @ np.array(self.model.doc), -40, 40))))

    def spans(self, text: str | None, least: float = 0.5, read: tuple | None = None) -> list[dict]:
        """Runs of toxic words as character offsets, with the highest marginal of each."""
        at, p, _ = read or self.marginals(text or "")
        toxic = {int(i): float(x) for i, x in zip(at, p, strict=True) if x >= least}
        out: list[dict] = []
        if toxic:
            for i, m in enumerate(WORD.finditer(text)):
                if i in toxic:
                    if out and i - 1 in toxic:
                        out[-1] |= {"end": m.end(), "marginal": max(out[-1]["marginal"], toxic[i])}
                    else:
                        out.append({"start": m.start(), "end": m.end(), "marginal": toxic[i]})
        return out


def toxic_features(sample: list[tuple[str, int]], known: Callable[[str], list[str]]) -> tuple[set[str], Counter]:
    """Features significantly tied to the toxic documents, and how many toxic documents have each common feature."""
    in_toxic: Counter = Counter()
    for text, label in sample:
        if label:
            in_toxic.update({f for w in set(WORD.findall(text)) for f in known(w)})
    in_toxic = Counter({f: c for f, c in in_toxic.items() if c >= 3})
    in_clean: Counter = Counter()
    for text, label in sample:
        if not label:
            in_clean.update({f for w in set(WORD.findall(text)) for f in known(w) if f in in_toxic})
    q = sum(label for _, label in sample) / len(sample)
    found = set()
    for f, c1 in in_toxic.items():
        n = c1 + in_clean[f]
        if c1 >= 0.9 * n and (c1 - n * q) >= 4.5 * np.sqrt(n * q * (1 - q)):
            found.add(f)
    return found, in_toxic


def windows_of(sample: list[tuple[str, int]], marks: set[str], index: dict[str, int], known: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, lengths) of windows, at most about WINDOWS with a toxic word and as many without."""
    total = sum(len(text) for text, _ in sample) // (6 * WINDOW) + len(sample)
    toxic_total = sum(len(text) for text, label in sample if label) // (6 * WINDOW) + 1
    every = {True: max(1, toxic_total // WINDOWS), False: max(1, total // WINDOWS)}
    met = {True: 0, False: 0}
    taken: list[tuple[list[list[int]], list[int]]] = []
    for text, label in sample:
        words = WORD.findall(text)
        for i in range(0, len(words), WINDOW):
            part = words[i : i + WINDOW]
            y = [int(bool(label) and not marks.isdisjoint(known(w))) for w in part]
            kind = any(y)
            if met[kind] % every[kind] == 0:
                taken.append(([[index.get(f, 0) for f in known(w)] for w in part], y))
            met[kind] += 1
    x = np.zeros((len(taken), WINDOW, 4), np.int32)
    y = np.zeros((len(taken), WINDOW), np.int8)
    lengths = np.zeros(len(taken), np.int64)
    for s, (ids, labels) in enumerate(taken):
        lengths[s] = len(ids)
        y[s, : len(labels)] = labels
        for t, row in enumerate(ids):
            x[s, t, : len(row)] = row
    return x, y, lengths


def expectations(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, w: np.ndarray, bias: float, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts of a block of windows: per toxic word, of the starts, of the transitions."""
    n, t_max, _ = x.shape
    live = np.arange(t_max)[None, :] < lengths[:, None]
    pairs_live = live[:, 1:]
    onehot = np.stack([1 - y, y], axis=-1).astype(float) * live[..., None]
    e1 = np.exp(np.clip(w[x].sum(axis=2) + bias, -50, 50))
    a = np.exp(moves)
    f = np.zeros((n, t_max, 2))
    b = np.ones((n, t_max, 2))
    v = np.exp(start)[None, :] * np.stack([np.ones(n), e1[:, 0]], axis=1)
    f[:, 0] = v / v.sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        v = f[:, t - 1] @ a
        v[:, 1] *= e1[:, t]
        f[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(t_max - 2, -1, -1):
        v = b[:, t + 1].copy()
        v[:, 1] *= e1[:, t + 1]
        v = v @ a.T
        b[:, t] = np.where(live[:, t + 1, None], v / v.sum(axis=1, keepdims=True), 1.0)
    p = f * b
    p /= p.sum(axis=2, keepdims=True)
    right = b[:, 1:].copy()
    right[..., 1] *= e1[:, 1:]
    joint = f[:, :-1, :, None] * a[None, None] * right[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    observed = np.einsum("sti,stj->ij", onehot[:, :-1] * pairs_live[..., None], onehot[:, 1:])
    return (y - p[..., 1]) * live, (onehot[:, 0] - p[:, 0]).sum(axis=0), observed - (joint * pairs_live[..., None, None]).sum(axis=(0, 1))


def fit_field(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, size: int, steps: int = STEPS, block: int = 2000) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights of the features (0 is none), bias, start and transitions, by Adagrad on the log-likelihood."""
    n = len(x)
    w, bias, start, moves = np.zeros(size), -3.0, np.zeros(2), np.zeros((2, 2))
    g2 = [np.full(size, 1e-2), np.full(1, 1e-2), np.full(2, 1e-2), np.full((2, 2), 1e-2)]
    for _ in range(steps):
        grads = [-1e-5 * w, np.zeros(1), np.zeros(2), -1e-3 * moves]
        for i in range(0, n, block):
            part = x[i : i + block]
            miss, starts, pairs = expectations(part, y[i : i + block], lengths[i : i + block], w, bias, start, moves)
            grads[0] += np.bincount(part.ravel(), np.repeat(miss.ravel(), part.shape[2]), size) / n
            grads[1] += miss.sum() / n
            grads[2] += starts / n
            grads[3] += pairs / n
        grads[0][0] = 0
        for k, g in enumerate(grads):
            g2[k] += g * g
        w += 0.7 * grads[0] / np.sqrt(g2[0])
        bias += float(0.3 * grads[1][0] / np.sqrt(g2[1][0]))
        start += 0.1 * grads[2] / np.sqrt(g2[2])
        moves += 0.1 * grads[3] / np.sqrt(g2[3])
    return w, bias, start, moves


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - keep @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + keep
        w = w + np.clip(np.linalg.solve(hess, grad), -3, 3)
    return w


def fit(sample: list[tuple[str, int]], totals: tuple[int, int]) -> Model:
    """Model of (text, label) rows; totals: how many clean and toxic labels the rows were drawn from."""
    rate = (totals[1] + 0.5) / (sum(totals) + 1.0)
    flat = Model({}, -3.0, (0.0, 0.0), (0.0,) * 4, (0.0, 0.0, 0.0, float(np.log(rate / (1 - rate)))))
    if not all(totals) or len({label for _, label in sample}) < 2:
        return flat
    sample = [(text or "", label) for text, label in sample]
    known = functools.lru_cache(50_000)(features)
    marks, common = toxic_features(sample, known)
    # Words without a mark are all the same to the field: it needs the features of marked words only.
    toxic_words = {w for text, label in sample if label for w in set(WORD.findall(text)) if not marks.isdisjoint(known(w))}
    index = {f: i + 1 for i, f in enumerate(sorted({f for w in toxic_words for f in known(w) if f in common}))}
    x, y, lengths = windows_of(sample, marks, index, known)
    if not y.any():
        return flat
    w, bias, start, moves = fit_field(x, y, lengths, len(index) + 1)
    weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) >= 0.1}
    model = Model(weights, bias, tuple(start), tuple(moves.ravel()), (0.0,) * 4)
    tagger = Tagger(model)
    labels = np.array([label for _, label in sample])
    matrix = np.array([tagger.summary(text) for text, _ in sample])
    share = np.array([totals[c] / max(1, (labels == c).sum()) for c in (0, 1)])
    share *= len(labels) / (share[labels].sum())
    return model._replace(doc=tuple(float(v) for v in fit_logistic(matrix, labels, share[labels])))


def is_held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Model from the labels that are not held out; ids with several labels count by the highest."""
    rows = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    rows = rows.filter(~is_held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    counted = dict(map(tuple, rows.groupBy("label").count().collect()))
    if len(counted) < 2:
        return fit([], (counted.get(0, 0), counted.get(1, 0)))
    order = F.xxhash64("id")
    ids = rows.filter("label = 1").orderBy(order).limit(max_toxic).union(rows.filter("label = 0").orderBy(order).limit(max_clean))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most max_toxic + max_clean ids; repeated ids give the alphabetically first of their texts.
    sample = texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id")
    return fit([(r.text or "", r.label) for r in sample.collect()], (counted[0], counted[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, score, spans) of every row: spans are (start, end, marginal) in characters; null text is empty."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, found = [], []
            for text in texts:
                read = tagger.marginals(text or "")
                scores.append(tagger.score(text, read))
                if spans:
                    found.append(tagger.spans(text, read=read))
            columns = [batch.column(0), pa.array(scores, pa.float64())]
            if spans:
                columns.append(pa.array(found, span))
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "spans"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, score double" + ", spans array<struct<start:int,end:int,marginal:double>>" * spans)
    return out.withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.7) -> DataFrame:
    """The rows whose score is below ``reject``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            yield batch.filter(pa.array([tagger.score(t) < reject for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
