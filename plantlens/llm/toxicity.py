"""Toxicity: a linear classifier of character n-grams.

Each n-gram feature is a presence scaled by its naive Bayes log-count ratio; a
logistic regression over the scaled features gives the score. Labels are learnt
from a bounded sample of labelled rows, on all n-grams that tell the labels
apart there; scoring covers every row.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import filter_rows, id_and_text, keep_in_worker, map_batches, mix64, slices, written

SIZES = (4, 5, 6)
BUCKETS = 1 << 21
#: Bound of the fit: labelled rows, drawn by a hash of their ids.
SAMPLE = 20_000
#: A feature stands in at least so many of these rows, and its G2 is beyond
#: what one in ten thousand reaches of the features that say nothing of the label,
#: or half the greatest where so few rows are labelled that this is less.
LEAST_ROWS, LEAST_G2 = 3, 15.14
SMOOTHING = 1.0
#: The penalty is the greatest of 0.02, 0.01, 0.005, 0.0025, 0.001 and 0.0005 beyond which
#: four-fold cross-validation over learnable rows finds no more toxic ones. The fit
#: ends when it has settled; STEPS only bounds it.
PENALTY, STEPS = 0.0025, 500
#: Places of n-grams that are worked on at a time.
WINDOW = 1 << 17
_U = np.uint64


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # bucket numbers, ascending
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        slots = np.full(BUCKETS, -1, np.int32)
        slots[self.features] = np.arange(len(self.features))
        return slots


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case and the row of each; ASCII characters that are
    no letters count as spaces, and a space is put before and after each text."""
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points < 128) & ~((points >= 97) & (points <= 122)), np.uint32(32), points)
    return points, np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in low])


def _grams(points: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram that begins at one of the first ``most`` places."""
    points = points.astype(_U)
    rows, features = [], []
    for n in SIZES:
        k = min(most, len(points) - n + 1)
        if k <= 0:
            continue
        h = np.full(k, n, _U)
        for d in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + points[d : d + k]
        inside = owner[:k] == owner[n - 1 : n - 1 + k]
        rows.append(owner[:k][inside].astype(np.int64))
        features.append((mix64(h[inside]) & _U(BUCKETS - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(features)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every place of every n-gram."""
    points, owner = _points(texts)
    return _grams(points, owner, len(points))


def distinct_ngrams(texts: list[str], slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every distinct n-gram of each text, or with ``slots``
    (row, slot) of those that have one. Found window by window, so that a very
    long text needs little more memory than its code points."""
    points, owner = _points(texts)
    width, found = BUCKETS if slots is None else int(slots.max(initial=0)) + 1, []
    for at in range(0, len(points), WINDOW):
        end = at + WINDOW + max(SIZES) - 1
        row, feature = _grams(points[at:end], owner[at:end], WINDOW)
        if slots is not None:
            slot = slots[feature]
            row, feature = row[slot >= 0], slot[slot >= 0]
        found.append(np.unique(row * width + feature))
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key // width, key % width


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, learn, limit: int) -> DataFrame:
    """text and label (0.0 or 1.0) of the rows to fit on."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    known = known.dropna().groupBy("doc_id").agg(F.max("label").alias("label")).filter(learn("doc_id"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.join(F.broadcast(drawn), "doc_id")  # SAMPLE rows at most
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in rows:
        for part in slices(batch):
            owner, feature = distinct_ngrams(part.column(1).to_pylist())
            label = (part.column(2).to_numpy() > 0.5)[owner]
            for k in (0, 1):
                np.add.at(counts[k], feature[label == k], 1)
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (some, *counts[:, some])], names=["feature", "n0", "n1"])


class Presence:
    """A sparse matrix: which features (``columns``, row by row from ``at`` on)
    stand in each row, each with the value of its column."""

    def __init__(self, at: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.shape, self.values = (len(at) - 1, len(values)), values
        order = np.argsort(columns, kind="stable")
        rows = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[order]
        self.by_row = at, columns
        self.by_column = np.searchsorted(columns, np.arange(len(values) + 1), sorter=order), rows

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return _sums(*self.by_row, v * self.values)

    def left(self, v: np.ndarray) -> np.ndarray:
        return _sums(*self.by_column, v) * self.values


def _sums(at: np.ndarray, index: np.ndarray, v: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """The sum of v at the indices of each run, about ``most`` of them at a time."""
    out, i = np.zeros(len(at) - 1), 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        sums = np.concatenate([np.zeros(1), np.cumsum(v[index[at[i] : at[j]]])])
        out[i:j] = np.diff(sums[at[i : j + 1] - at[i]])
        i = j
    return out


def logistic(x: np.ndarray | Presence, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, near: float = 1e-5) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by quasi-Newton steps that remember the last
    ten, until none changes a weight by ``near``; ``steps`` at most."""
    n, k = x.shape
    left = x.left if isinstance(x, Presence) else lambda v: x.T @ v

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.append(left(p - y), (p - y).sum()) / n
        g[:-1] += penalty * w[:-1]
        return float((np.logaddexp(0, z) - y * z).mean() + penalty / 2 * (w[:-1] @ w[:-1])), g

    w = np.zeros(k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    value, g = loss(w)
    known: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=10)
    for _ in range(steps):
        d, shares = -g, []
        for s, u, r in reversed(known):
            shares.append(r * (s @ d))
            d = d - shares[-1] * u
        if known:
            s, u, _ = known[-1]
            d = d * ((s @ u) / (u @ u))
        for (s, u, r), share in zip(known, reversed(shares)):
            d = d + s * (share - r * (u @ d))
        slope, size = g @ d, 1.0 if known else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while size > 1e-12:
            new = w + size * d
            new_value, new_g = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, u = new - w, new_g - g
        if s @ u > 1e-14:
            known.append((s, u, 1 / (s @ u)))
        w, value, g = new, new_value, new_g
        if np.abs(s).max() < near:
            break
    return w[:-1], float(w[-1])


def fit(
    df: DataFrame,
    labels: DataFrame,
    learn: Callable[[str], object] = lambda c: F.col(c).isNotNull(),
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = SAMPLE,
) -> Model:
    """A model from at most ``limit`` labelled rows for whose id ``learn``
    holds. Rows with a null label are not used; of several labels of one id the
    greatest holds, of several texts the least. Without labelled rows of both
    kinds the score is that of no evidence: 0, or 1 if all are toxic."""
    rows = written(_labelled(id_and_text(df, id_col, text_col), labels, id_col, label_col, learn, limit).repartition(8), "labelled")
    sizes = {int(r.label > 0.5): r.n for r in rows.groupBy((F.col("label") > 0.5).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if n1 else -40.0)
    # presence in a share of the rows of each class; G2 tells how far they differ
    a, b = F.col("n1") + F.lit(SMOOTHING), F.col("n0") + F.lit(SMOOTHING)
    share = (a + b) / F.lit(n0 + n1 + 2 * SMOOTHING)
    gain = a * F.log(a / F.lit(n1 + SMOOTHING) / share) + b * F.log(b / F.lit(n0 + SMOOTHING) / share)
    ratio = F.log(a / F.lit(n1 + 2 * SMOOTHING)) - F.log(b / F.lit(n0 + 2 * SMOOTHING))
    counted = map_batches(rows, _counts, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    some = written(counted.filter(F.col("n0") + F.col("n1") >= LEAST_ROWS).select("feature", ratio.alias("ratio"), (2 * gain).alias("g2")), "features")
    limit_g2 = min(LEAST_G2, (some.agg(F.max("g2")).first()[0] or 0.0) / 2)
    best = some.filter(F.col("g2") >= limit_g2).select("feature", "ratio").toPandas().sort_values("feature")
    features, ratios = best["feature"].to_numpy(np.int64), best["ratio"].to_numpy(np.float64)
    empty = Model(features, ratios, 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = empty.table()
        for batch in batches:
            for part in slices(batch):
                owner, slot = distinct_ngrams(part.column(1).to_pylist(), slots)
                at = np.searchsorted(owner, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(slot, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["doc_id", "label", "slots"])

    got = map_batches(rows, present, "doc_id long, label double, slots array<int>").toArrow().sort_by("doc_id")
    slots = got.column("slots").combine_chunks()
    at = slots.offsets.to_numpy().astype(np.int64)
    columns = slots.values.to_numpy()[at[0] : at[-1]]
    w, bias = logistic(Presence(at - at[0], columns, ratios), (got.column("label").to_numpy() > 0.5).astype(np.float64))
    return Model(features, w * ratios, bias)


def scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    """Scores of texts, from 0 to 1."""
    name, weights, bias = f"slots {uuid.uuid4().hex}", model.weights, model.bias

    def scores(texts: list[str]) -> np.ndarray:
        owner, slot = distinct_ngrams(texts, keep_in_worker(name, model.table))
        total = bias + np.bincount(owner, weights[slot], len(texts)) if len(owner) else np.full(len(texts), bias)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

    return scores


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. Null and empty texts get the
    score of no evidence. Repeated rows are scored each. Labels, languages and
    sources are never read."""
    scores = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1).to_pylist()))], names=["doc_id", "score"])

    return map_batches(id_and_text(df, id_col, text_col), run, "doc_id long, score double")


LIMIT = 0.3


def held_out(c: str = "doc_id"):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 4 == 2, F.lit(False))


def score_toxicity(df: DataFrame, labels: DataFrame, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``limit`` on) of every row."""
    model = fit(df, labels, lambda c: ~held_out(c), id_col=id_col, text_col=text_col)
    return score(df, model, id_col, text_col).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def keep_civil(df: DataFrame, labels: DataFrame, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a lesser score, unchanged."""
    model = fit(df, labels, lambda c: ~held_out(c), id_col=id_col, text_col=text_col)
    scores = scorer(model)
    return filter_rows(df, text_col, lambda texts: scores(texts) < limit)
